"""Shards of segments by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.scale import broadcast_if_small, checkpoint

SLOT_ROWS = 200_000
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key: the last jump below ``shards`` of the key's own sequence."""
    state = keys.astype(np.uint64)
    at, to = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = to[live]
        s = state[live] * _STEP + np.uint64(1)
        state[live] = s
        to[live] = ((at[live] + 1) * (float(1 << 31) / ((s >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[to[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Jump hash of a column of any type: its 64-bit hash, null included, chooses the shard."""

    @F.pandas_udf("int")
    def chosen(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().view(np.uint64), shards).astype(np.int32))

    return chosen(F.xxhash64(key))


def shard_segments(segments: DataFrame, shards: int, key: str = "segment_id", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Adds ``shard``, ``grown_shard`` and ``slot`` to ``segments`` (columns of these names are replaced).

    ``key`` and the shard count alone decide ``shard``; ``grown_shard`` is the shard with one more
    shard appended, which takes rows only into itself. ``slot`` counts a shard's rows from 0 without
    gaps: rows are numbered inside buckets of about ``slot_rows`` rows and bucket sizes are summed,
    so no task sorts a whole shard. Buckets follow a hash of the whole row, so a key with a third of the rows is
    spread; rows alike in every column are dealt over buckets when they are more than ``slot_rows``. Equal keys share
    a shard; a null key is a key of its own. Rows alike in every column may swap slots. Other columns are kept; an
    empty table stays empty.
    """
    whole = [f.name for f in segments.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "variant")]
    placed = checkpoint(
        segments.withColumn("_content", F.xxhash64(F.lit("slot"), *whole))
        .withColumn("shard", shard_of(F.col(key), shards))
        .withColumn("grown_shard", shard_of(F.col(key), shards + 1))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    buckets = max(1, placed.count() // (shards * slot_rows))
    # at most one row for every slot_rows rows
    alike = checkpoint(placed.groupBy("_content").count().filter(F.col("count") > slot_rows).select("_content", F.lit(True).alias("_many")))
    few, _ = broadcast_if_small(alike, 32)
    dealt = F.xxhash64("_content", F.when(F.col("_many"), F.col("_row")))
    held = placed.join(few, "_content", "left").withColumn("_bucket", F.pmod(dealt, F.lit(buckets)))
    sizes = held.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(key, "_content", "_row")
    return (
        held.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_bucket"])
        .withColumn("slot", F.col("_offset") + F.col("_at"))
        .drop("_bucket", "_content", "_at", "_offset", "_row", "_many")
    )
