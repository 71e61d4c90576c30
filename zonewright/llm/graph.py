"""Connected components as joins, without any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import keep


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``edges`` (a long, b long): the smallest node it is
    connected with. Nodes without an edge are not returned.

    Alternates between hooking the larger neighbours of a node, and then its smaller ones, to
    the smallest; the number of rounds grows with the logarithm of the longest path. Minima
    are combined before the shuffle, and a node with many neighbours is joined to its minimum,
    which adaptive execution can split. Raises if ``max_rounds`` are not enough.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = keep(pairs.distinct())
    last = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        large = keep(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        pairs = keep(small.select("e.a", "e.b").where("a <> b").distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            labels = pairs.groupBy("a").agg(F.min("b").alias("label"))
            roots = labels.select(F.col("label").alias("node"), "label").distinct()
            return labels.withColumnRenamed("a", "node").unionByName(roots)
        last = state
    raise RuntimeError(f"components not found after {max_rounds} rounds")
