"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the number of their word n-grams, the classes doubling. An item
is sketched by its smallest n-gram hashes (bottom-k MinHash); k follows from the upper size of
the class: a text that holds the given share of the item lacks at most (1 - share) of its
n-grams, so of one more than that many it must hold one, and no item is missed, however long.
Texts with fewer n-grams than the item's share are no candidates, whatever they hold. Candidates
are verified by exact containment of the item's n-gram set. Only DataFrame functions.

Departure from the method: texts are not sketched, as the sketch of a long text says little about
a short part of it. All their n-grams are looked up among those of the sketched items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.llm.common import keep
from zonewright.sources.size import fits_broadcast

NOT_WORD = r"[^\p{L}\p{N}]+"


def grams(table: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, grams): hashes of all word n-grams of a text, in order. Words are runs of letters
    and digits in lower case. Fewer than ``n`` words, or null, give null.

    No filter stands on the arrays, and they are exploded with ``explode_outer``: Spark would
    push conditions on them down to the scan as expressions and split the text once a word.
    """
    text = F.lower(F.coalesce(col(text_col).cast("string"), F.lit("")))
    words = table.select(
        col(id_col).alias("id"),
        F.transform(
            F.filter(F.split(text, NOT_WORD, -1), lambda w: w != ""), lambda w: F.xxhash64(w)
        ).alias("words"),
    )
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    gram = F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(n)]))
    return words.select("id", F.when(F.size("words") >= n, gram).alias("grams"))


def sketch_sizes(share: float) -> Column:
    """How many hashes an item needs, from the upper size of its class, in column ``n``."""
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("n"))))
    return (F.floor(F.lit(1.0 - share) * upper + 1e-9) + 1).cast("int")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 5,
    share: float = 0.8,
) -> DataFrame:
    """(id, item, n_grams, n_shared, containment) wherever a text holds at least ``share`` of
    the distinct n-grams of an item.

    Texts or items with fewer than ``n`` words, null or empty, are in no pair; neither are rows
    with a null id. Rows with the same id are searched together as one text's n-grams, so
    repeated rows give one pair. Empty tables give an empty result; other columns are not read.
    """
    own = (
        grams(items, item_col, item_text_col, n)
        .where("id is not null")
        .select(F.col("id").alias("item"), F.explode_outer("grams").alias("gram"))
        .where("gram is not null")
        .distinct()
    )
    by_item = Window.partitionBy("item")
    parts = keep(
        own.withColumn("n", F.count("*").over(by_item))
        .withColumn("nth", F.row_number().over(by_item.orderBy("gram")))
        .withColumn("least", F.ceil(F.lit(share) * F.col("n") - 1e-9))
    )
    sketch = parts.where(F.col("nth") <= sketch_sizes(share)).select("item", "gram", "least")
    whole = parts.select("item", "gram", "n", "least")

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """Broadcast what is measured to be small, shuffle what is not."""
        return left.join(F.broadcast(right) if fits_broadcast(right) else right, on)

    texts = grams(docs, id_col, text_col, n).where("id is not null")
    hashed = texts.select("id", F.size("grams").alias("n_text"), F.explode_outer("grams").alias("gram"))
    candidates = keep(
        joined(hashed, sketch, ["gram"])
        .groupBy("id", "item")
        .agg(F.sum("n_text").alias("n_text"), F.first("least").alias("least"))
        .where("n_text >= least")
        .groupBy("id")
        .agg(F.collect_set("item").alias("items"))
    )
    near = texts.join(candidates, "id").select(
        "id", "items", F.explode_outer(F.array_distinct("grams")).alias("gram")
    )
    shared = (
        joined(near, whole, ["gram"])
        .where(F.array_contains("items", F.col("item")))
        .groupBy("id", "item")
        .agg(F.countDistinct("gram").alias("n_shared"), F.first("n").alias("n_grams"))
        .join(parts.where("nth = 1").select("item", "least"), "item")
        .where("n_shared >= least")
    )
    return shared.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        "n_grams",
        "n_shared",
        (F.col("n_shared") / F.col("n_grams")).alias("containment"),
    )
