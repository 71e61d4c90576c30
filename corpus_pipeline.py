"""Prepares a corpus of documents in stages; each works on all that the one before it kept.

The texts of ``documents`` change in the second stage; ``n_chars`` follows them, the other
columns stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm import language_id
from zonewright.llm.common import keep, table
from zonewright.llm.decontaminate import contaminated
from zonewright.llm.jaccard import near_duplicates
from zonewright.llm.line_dedup import dedup_lines
from zonewright.llm.packing import pack_documents

#: Below this certainty the languages of a text count as unknown.
LEAST_SCORE = 0.3


#: Rows that Python workers take at a time. Texts are long, so Spark's default of 10,000 rows fills
#: a worker's memory with input.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Sets the session to at most ``BATCH_ROWS``. Stages return what is not computed yet, so this
    stays; results do not depend on it."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose languages are known with some certainty, be they several: not those
    without a letter, nor those only in scripts that no learned language is written in."""
    _small_batches(spark)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.labelled(docs, model, keep=docs.columns)
    sure = F.col("label.certainty") >= LEAST_SCORE
    return found.where((F.col("label.lang_pred") != language_id.UNKNOWN) & sure).select("kept.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; a document left with nothing goes."""
    _small_batches(spark)
    found = dedup_lines(docs, keep=docs.columns)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.where(left).select(
        *[
            F.when(F.col("n_dropped") > 0, changed[c]).otherwise(F.col(f"kept.{c}")).alias(c)
            if c in changed
            else F.col(f"kept.{c}")
            for c in docs.columns
        ]
    )


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, a null id being the largest; of
    several rows with this id one. Groups are made of rows, so texts that share an id, or have
    none, are kept or dropped each by itself. Columns may have any names."""
    _small_batches(spark)
    return near_duplicates(docs, keep_columns=docs.columns).where("first").select("kept.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. Each is searched by itself, told apart by id and text,
    so texts that share an id, or have none, stay apart too. Columns may have any names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    told = F.concat_ws(" ", F.col("doc_id"), F.hex(F.xxhash64(text)), F.length(text)).alias("told")
    found = contaminated(docs.select(told, "text"), table(spark, sf_dir, "benchmark"), id_col="told")
    rows = docs.select(F.struct(*docs.columns).alias("kept"), told)
    return rows.join(found.select("told").distinct(), "told", "left_anti").select("kept.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    _small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", by_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: SQL has neither the language model nor the tokenizer nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
