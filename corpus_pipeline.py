"""Corpus pipeline over ``documents``: quality rules, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, in the columns of ``documents``;
the last returns their tokens. No stage needs SQL or the driver to see rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.llm import bpe, jaccard, mixing, pii, quality
from stridemill.llm.queries import vocabulary
from stridemill.plans.fixtures import table
from stridemill.scale import broadcast_if_small, checkpoint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ID_BYTES = 64


def _identity() -> Column:
    """A document by id and text, so that an id used twice for different texts stays two documents."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash"))


def _segments(docs: DataFrame) -> DataFrame:
    return docs.select(_identity().alias("segment_id"), "text", F.col("source").alias("env"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text fails."""
    return quality.rate_segments(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id. Rows alike in id and text are one."""
    rated = checkpoint(jaccard.join_segments(_segments(docs)))
    gone, _ = broadcast_if_small(checkpoint(rated.filter(~F.col("kept")).select(F.col("segment_id").alias("_gone")).distinct()), ID_BYTES)
    left = docs.select(*COLUMNS, _identity().alias("_id")).join(gone, F.col("_id").eqNullSafe(F.col("_gone")), "left_anti")
    repeated = rated.filter("kept").groupBy("segment_id").count().filter("count > 1").isEmpty()
    return (left if repeated else left.dropDuplicates(["_id"])).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; a text without any stays as it is."""
    segments = docs.withColumn("segment_id", F.col("doc_id"))
    found = pii.find_personal_data(segments, pii.train_tagger(segments))
    return found.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Rows alike in id and text share their copies evenly."""
    mixed = mixing.mix_segments(_segments(docs))
    copies = checkpoint(mixed.groupBy("segment_id").agg(F.round(F.avg("copies")).cast("int").alias("_copies")).filter("_copies > 0"))
    few, _ = broadcast_if_small(copies, ID_BYTES)
    taken = docs.select(*COLUMNS, _identity().alias("_id")).join(few, F.col("_id").eqNullSafe(F.col("segment_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``doc_id, part, n_tokens, ids, decoded_sha256`` (of the bytes decoded back)."""
    ranks, pattern = vocabulary()
    encoded = bpe.encode_segments(docs.withColumnRenamed("doc_id", "segment_id"), ranks, pattern)
    return bpe.decode_segments(encoded, ranks, pattern).select(
        F.col("segment_id").alias("doc_id"), "part", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("source_mix", source_mix), ("tokens", tokens),
]

#: A trained tagger and Newton rounds are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before has left in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
