"""Batched text embedding as a Spark job, and stored embeddings that only grow by changed texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.functions.text import tokenize
from stridemill.scale import lookup_join

DIM = 64
Embedder = Callable[[DataFrame, int], DataFrame]


class EmbeddingCountError(RuntimeError):
    """An embedder returned another number of vectors than texts sent."""


def token_bucket(token, dim: int):
    """Bucket of a token: first eight hex digits of its MD5, modulo the dimension."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dim


def hashing_embedder(texts: DataFrame, dim: int = DIM, column: str = "text") -> DataFrame:
    """Default embedder: token counts of ``column`` hashed into ``dim`` buckets. Adds ``vector`` and ``tokens``.

    Tokens and buckets are built-in expressions; the Arrow stage only counts
    buckets for a whole batch at once.
    """
    hashed = texts.withColumn("_b", F.transform(tokenize(F.col(column)), lambda t: token_bucket(t, dim).cast("int")))

    def count(batches):
        for batch in batches:
            buckets = batch.column("_b")
            n = len(buckets)
            sizes = np.diff(buckets.offsets.to_numpy())
            slot = np.repeat(np.arange(n), sizes) * dim + np.asarray(buckets.flatten())
            counts = np.bincount(slot, minlength=n * dim)[: n * dim].astype(np.float64)
            vectors = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(counts)
            )
            kept = {name: batch.column(name) for name in batch.schema.names if name != "_b"}
            yield pa.RecordBatch.from_pydict({**kept, "vector": vectors, "tokens": pa.array(sizes.astype(np.int64))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return hashed.mapInArrow(count, f"{fields}, vector array<double>, tokens long")


def batched(function: Callable[[list[str]], list[list[float]]], batch_size: int = 8) -> Embedder:
    """Embedder from a function over text lists; each call gets at most ``batch_size`` texts."""

    def embedder(texts: DataFrame, dim: int = DIM) -> DataFrame:
        def run(batches):
            for batch in batches:
                values = batch.column("text").to_pylist()
                vectors = []
                for start in range(0, len(values), batch_size):
                    sent = values[start : start + batch_size]
                    got = function(sent)
                    if len(got) != len(sent) or not all(len(v) for v in got):
                        raise EmbeddingCountError(f"{len(got)} vectors for {len(sent)} texts")
                    vectors.extend(got)
                kept = {name: batch.column(name) for name in batch.schema.names}
                tokens = pa.array([len(v.split()) for v in values], pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {**kept, "vector": pa.array(vectors, pa.list_(pa.float64())), "tokens": tokens})

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
        return texts.mapInArrow(run, f"{fields}, vector array<double>, tokens long")

    return embedder


def embed(rows: DataFrame, text: str, embedder: Embedder = hashing_embedder, dim: int = DIM) -> DataFrame:
    """Add ``vector`` and ``tokens`` to ``rows``. Equal texts are embedded once, or in place where that is cheaper than a join."""
    if embedder is hashing_embedder:
        return hashing_embedder(rows, dim, text)
    distinct = rows.select(F.col(text).alias("text")).distinct()
    vectors = embedder(distinct, dim).withColumnRenamed("text", "_text")
    return lookup_join(rows.withColumn("_text", F.col(text)), vectors, ["_text"]).drop("_text")


def refresh_embeddings(stored: DataFrame, wanted: DataFrame, embedder: Embedder = hashing_embedder, dim: int = DIM) -> DataFrame:
    """Stored vectors for the (skill_id, text) pairs still wanted, plus new vectors for changed texts only."""
    keep = stored.join(wanted, ["skill_id", "text"], "left_semi").withColumn("reused", F.lit(True))
    fresh = wanted.select("skill_id", "text").join(stored, ["skill_id", "text"], "left_anti")
    made = embedder(fresh, dim).withColumn("reused", F.lit(False))
    return keep.unionByName(made)


def embedding_usage(embedded: DataFrame, batch_size: int = 8) -> DataFrame:
    """Totals over the embedded texts: texts, batches of ``batch_size``, tokens."""
    n = F.count(F.lit(1))
    return embedded.agg(
        n.alias("texts"), F.ceil(n / batch_size).alias("batches"),
        F.coalesce(F.sum("tokens"), F.lit(0).cast("long")).alias("prompt_tokens"),
        F.coalesce(F.sum("tokens"), F.lit(0).cast("long")).alias("total_tokens"),
    )
