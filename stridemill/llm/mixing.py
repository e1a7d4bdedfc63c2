"""Mix of segments from several environments to target token weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.llm.batches import bound_batches
from stridemill.scale import checkpoint, global_rank

WEIGHTS = (3.0, 1.0, 2.0)
ROUNDS = 200
BRACKET = float(1 << 20)
TOLERANCE = 1e-9
BLOCK_ROWS = 5_000
SPLIT_ROWS = 10_000
UNIT = 1 << 40


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Target tokens per ``env``: ``env, source_size, target`` from ``env, size``.

    Environments by code point, null last, take ``weights`` in turn and share ``share`` times all
    tokens; a target stops at ``cap`` times its environment's size and the excess is dealt again by
    weight, until none is above. One row per environment is kept; the driver sees sums only.
    """
    totals = sizes.groupBy("env").agg(F.sum("size").cast("long").alias("source_size"))
    order = [F.col("env").isNull(), F.col("env")]
    ranked = global_rank(totals, order, "_rank")
    turns = F.array(*[F.lit(float(w)) for w in weights])
    sources = checkpoint(ranked.withColumn("_weight", F.element_at(turns, (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))))
    limit = F.lit(cap) * F.col("source_size")
    all_tokens = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level rises until the capped targets add up; every round caps one more environment
        free = sources.filter(limit > F.lit(level) * F.col("_weight"))
        kept = free.agg(F.sum("_weight"), F.sum("source_size")).first()
        if not kept[0]:
            break
        higher = (share * all_tokens - cap * (all_tokens - kept[1])) / kept[0]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return sources.select("env", "source_size", F.least(limit, F.lit(level) * F.col("_weight")).cast("double").alias("target"))


def whole_units(x: Column) -> Column:
    """``x`` in multiples of 1 / ``UNIT``, as a decimal without fraction: sums of these do not depend on their order."""
    return F.round(x * float(UNIT)).cast("long").cast("decimal(38,0)")


def balanced_tilts(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, rounds: int = ROUNDS) -> DataFrame:
    """Dual variable per environment, ``env, target, scale, tilt, full``, from ``env, size, _rows`` and the targets.

    A segment's rate is ``cap / (1 + exp(-tilt * size / scale))``, the tilt of an even prior that is
    closest in entropy among the rates between 0 and ``cap`` that spend the target. The dual is convex
    and one-dimensional per environment; all are solved together by Newton rounds, each one aggregate
    over the (env, size) counts, kept inside a shrinking bracket. Rates enter the sums as whole multiples of
    1 / ``UNIT``, so every run finds the same tilts. ``full`` marks targets at the cap, where every rate is the
    cap. Raises ArithmeticError when an environment has not settled after ``rounds`` rounds.
    """
    counts = checkpoint(sizes.filter("size > 0").groupBy("env", "size").agg(F.sum("_rows").alias("n")))
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.greatest(F.lit(1), F.col("rows")))
    rows = counts.groupBy("env").agg(F.sum("n").alias("rows"))
    same = lambda a, b: a["env"].eqNullSafe(b["env"])
    state = targets.join(rows, same(targets, rows), "left").select(
        targets["env"], "target", F.coalesce(scale, F.lit(1.0)).alias("scale"), F.lit(0.0).alias("tilt"),
        F.lit(-BRACKET).alias("low"), F.lit(BRACKET).alias("high"),
        (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full"),
    )
    state = checkpoint(state)
    for _ in range(rounds):
        open_ = state.filter(~F.col("full"))
        z = F.col("size") / F.col("scale")
        rate = F.lit(cap) / (1 + F.exp(-F.col("tilt") * z))
        tokens = (F.col("n") * F.col("size")).cast("decimal(38,0)")
        moments = (
            counts.join(open_.select(F.col("env").alias("_env"), "tilt", "scale"), F.col("env").eqNullSafe(F.col("_env")))
            .groupBy("_env").agg(
                (F.sum((tokens * whole_units(rate)).cast("decimal(38,0)")).cast("double") / UNIT).alias("spent"),
                (F.sum((tokens * whole_units(F.least(z * rate * (1 - rate / cap), F.lit(BRACKET)))).cast("decimal(38,0)")).cast("double") / UNIT).alias("slope"),
            )
        )
        gap = F.coalesce("spent", F.lit(0.0)) - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap < 0, F.col("high")).otherwise(F.col("tilt"))
        newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        middle = (low + high) / 2
        moved = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
        near = F.abs(gap) <= TOLERANCE * F.col("target") + 1e-6
        state = checkpoint(
            state.join(moments, F.col("env").eqNullSafe(F.col("_env")), "left").select(
                "env", "target", "scale", F.when(F.col("full") | near, F.col("tilt")).otherwise(moved).alias("tilt"),
                low.alias("low"), high.alias("high"), "full", (F.col("full") | near | F.col("slope").isNull()).alias("_done"),
            )
        )
        if state.filter(~F.col("_done")).isEmpty():
            return state.select("env", "target", "scale", "tilt", "full")
        state = state.drop("_done")
    raise ArithmeticError(f"the mix has not settled after {rounds} rounds")


class Rounding:
    """Rates to copies along one block, the rounding debt in tokens carried from row to row.

    A row takes the copy above its rate's whole part when the debt with its own share reaches half of its tokens. Along
    rows of equal size and rate that is a step function of the row count, so a whole run of them is one expression; all
    numbers are integers in units of 1 / ``UNIT``.
    """

    def __init__(self) -> None:
        self.debt = 0

    def extras(self, size: int, rate: int, rows: np.ndarray) -> np.ndarray:
        """Rows that take one copy more, for each of several classes of ``rows`` equal rows."""
        part = rate % UNIT
        if not size or not part:
            return np.zeros(len(rows), np.int64)
        ends = np.cumsum(rows)
        steps = self.debt // size + UNIT // 2 + ends.astype(object) * part
        taken = np.clip(np.array([int(x) // UNIT for x in steps], np.int64), 0, ends)
        self.debt += size * (int(ends[-1]) * part - int(taken[-1]) * UNIT)
        return np.diff(taken, prepend=0)


def _rounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies of the classes of a partition sorted by block and size: rows with the smaller and with the larger number."""
    block, book = None, Rounding()
    for frame in frames:
        if not len(frame):
            continue
        columns = [frame[c].to_numpy() for c in ("_group", "_block", "size", "_rate")]
        change = np.zeros(len(frame), bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(frame)]
        group, part, size, rate = (c.tolist() for c in columns)
        rows = frame["_rows"].to_numpy()
        extra = np.zeros(len(frame), np.int64)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if (group[lo], part[lo]) != block:
                block, book = (group[lo], part[lo]), Rounding()
            extra[lo:hi] = book.extras(size[lo], rate[lo], rows[lo:hi])
        yield frame.drop(columns=["_group", "_block", "_rows"]).assign(_few=rows - extra, _more=extra)


def mix_segments(
    segments: DataFrame, size: Column | None = None, share: float = 1.5, cap: float = 2.0,
    weights: Sequence[float] = WEIGHTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Copies per segment so that every environment spends its target tokens.

    In: ``segment_id, env, text``; ``size`` counts a segment's tokens (default: words of the text, 0 for
    null). Out: one row per segment with ``segment_id, env, size, source_size, target, rate, copies,
    taken`` (``copies * size``). Environments follow ``source_targets``; rates follow
    ``balanced_tilts`` and are whole multiples of 1 / ``UNIT``. Rates become copies by carrying the rounding debt
    through blocks of about ``block_rows`` segments of one environment, large segments first, so an environment
    misses its target by about one small segment per block. Blocks and order come from hashes of id and text, and all
    sums are exact, so reruns agree under any partitioning.
    Empty segments take nothing, a null ``env`` is an environment of its own, repeated ids are separate
    rows, and an empty table gives an empty result. Rows equal in id, text and environment are rounded as one class
    and dealt out again, so even a third of all rows alike meet in no task. Other columns are not carried.
    """
    counted = segments.select(
        "segment_id", "env", (word_count(F.col("text")) if size is None else size).cast("long").alias("size"),
        F.xxhash64(F.lit("mix"), "segment_id", "text").alias("_hash"),
    )
    classes = checkpoint(counted.groupBy("segment_id", "env", "size", "_hash").agg(F.count("*").alias("_rows")))
    sized = classes.select("env", "size", "_rows")
    totals = sized.withColumn("size", F.col("size") * F.col("_rows"))
    targets = checkpoint(source_targets(totals, share, cap, weights))
    tilts = balanced_tilts(sized, targets, cap)
    known = targets.select(F.col("env").alias("_env"), "source_size").join(
        tilts.select(F.col("env").alias("_env2"), "target", "scale", "tilt", "full"), F.col("_env").eqNullSafe(F.col("_env2"))
    )
    blocks = classes.groupBy(F.col("env").alias("_env3")).agg(F.ceil(F.sum("_rows") / block_rows).alias("_blocks"))
    known = checkpoint(known.join(blocks, F.col("_env").eqNullSafe(F.col("_env3"))).drop("_env2", "_env3"))
    tilted = F.lit(cap) / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("scale")))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), cap).otherwise(tilted)
    ordered = classes.join(known, F.col("env").eqNullSafe(F.col("_env"))).select(
        "segment_id", "env", "size", "source_size", "target", F.round(rate * float(UNIT)).cast("long").alias("_rate"), "_rows",
        F.xxhash64("env").alias("_group"), F.pmod("_hash", "_blocks").alias("_block"), "_hash",
    ).repartition("_group", "_block").sortWithinPartitions("_group", "_block", F.desc("size"), "_hash", "segment_id").drop("_hash")
    bound_batches(segments.sparkSession, 10_000)
    kept = ["segment_id", "env", "size", "source_size", "target", "_rate"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.select(kept).schema)
    rounded = ordered.mapInPandas(_rounded, f"{fields}, _few long, _more long")
    whole = F.floor(F.col("_rate") / F.lit(float(UNIT))).cast("long")
    both = F.array(F.struct(whole.alias("copies"), F.col("_few").alias("rows")), F.struct((whole + 1).alias("copies"), F.col("_more").alias("rows")))
    dealt = rounded.select(*kept, F.inline(F.filter(both, lambda c: c["rows"] > 0)))
    if not classes.filter(F.col("_rows") > SPLIT_ROWS).isEmpty():
        parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / SPLIT_ROWS))
        dealt = dealt.withColumn("_part", F.explode(parts)).repartition("segment_id", "_part")
        dealt = dealt.withColumn("rows", F.least(F.lit(SPLIT_ROWS), F.col("rows") - F.col("_part") * SPLIT_ROWS))
    single = dealt.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows").cast("long"))))
    return single.select(
        "segment_id", "env", "size", "source_size", "target", (F.col("_rate") / float(UNIT)).alias("rate"), "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
