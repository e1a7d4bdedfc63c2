"""Sets of skills used together: all of them by listing, the frequent ones level by level, and their place among all.

Equal record sets are counted first, so a set costs the same however many records share it.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.scale import checkpoint, global_rank

SUBSET_BITS = 12
MAX_SET = 30
LIST_SET = 20
MAX_WIDE = 12


def record_sets(hits: DataFrame, record_keys: list[str]) -> DataFrame:
    """Distinct sets of two or more mid skills retrieved in one record, ``all`` in order, and ``n`` records of each."""
    mids = hits.filter("granularity = 'mid' and skill_id <> ''")
    sets = mids.groupBy(*record_keys).agg(F.array_sort(F.collect_set("skill_id")).alias("all"))
    return sets.filter(F.size("all") >= 2).groupBy("all").agg(F.count(F.lit(1)).alias("n"))


def listed_subsets(sets: DataFrame) -> DataFrame:
    """``mids, n`` for every subset of two or more skills of every set.

    The mask is split in two explodes, which keeps every intermediate array small for any set size.
    """
    split = sets.selectExpr(
        "all", "n",
        f"explode(sequence(0L, shiftleft(1L, greatest(size(all) - {SUBSET_BITS}, 0)) - 1)) high",
    ).selectExpr(
        "all", "n", "high", f"explode(sequence(0L, shiftleft(1L, least(size(all), {SUBSET_BITS})) - 1)) low",
    ).selectExpr("all", "n", f"high * {1 << SUBSET_BITS} + low mask").filter("bit_count(mask) >= 2")
    return split.selectExpr("filter(all, (x, i) -> (shiftright(mask, i) & 1) = 1) mids", "n")


def refused(sets: DataFrame, which, limit: int) -> DataFrame:
    """``sets`` with an error in place of those that ``which`` marks and that hold more than ``limit`` skills."""
    error = F.raise_error(F.lit(f"co-usage set of more than {limit} skills: raise max_set or retrieve fewer")).cast("array<string>")
    return sets.withColumn("all", F.when(which & (F.size("all") > limit), error).otherwise(F.col("all")))


def frequent_sets(sets: DataFrame, min_count: int, max_set: int = MAX_SET) -> DataFrame:
    """Sets of two or more skills used together in at least ``min_count`` records: ``mids, count``.

    A set of k + 1 skills is joined from two frequent sets of k that share all but their last skill, inside the records
    that hold both, so nothing below a rare set is ever formed and a wide record that is rare costs its
    frequent parts only. A record of more than ``max_set`` skills that is itself frequent makes all of its subsets
    frequent; such a result cannot be listed and is refused with an error.
    """
    held = checkpoint(refused(sets, F.col("n") >= min_count, max_set).withColumn("sid", F.monotonically_increasing_id()))
    none = F.array().cast("array<string>")
    level = held.select("sid", "n", none.alias("prefix"), F.explode("all").alias("last"))
    found = None
    while True:
        counted = level.groupBy("prefix", "last").agg(F.sum("n").alias("count")).filter(F.col("count") >= min_count)
        used = checkpoint(counted)
        if used.isEmpty():
            return found if found is not None else held.select(F.col("all").alias("mids"), F.col("n").alias("count")).limit(0)
        if not used.filter(F.size("prefix") > 0).isEmpty():
            sets_here = used.select(F.concat("prefix", F.array("last")).alias("mids"), "count")
            found = sets_here if found is None else found.unionByName(sets_here)
        kept = checkpoint(level.join(used.select("prefix", "last"), ["prefix", "last"], "left_semi"))
        other = kept.select("sid", "prefix", F.col("last").alias("next"))
        level = checkpoint(
            kept.join(other, ["sid", "prefix"]).filter("last < next")
            .select("sid", "n", F.concat("prefix", F.array("last")).alias("prefix"), F.col("next").alias("last"))
        )


def subsets_before(mids: list[str], wide: list[str]) -> int:
    """How many subsets of two or more of the sorted ``wide`` come before the sorted ``mids``; a prefix comes first."""
    total, low = 0, None
    inside = set(wide)
    for j, skill in enumerate(mids):
        total += sum(1 << len(wide) - 1 - i for i, x in enumerate(wide) if x < skill and (low is None or x > low))
        if skill not in inside:
            break
        total += j + 1 < len(mids)
        low = skill
    single = sum(x < mids[0] for x in wide) + (len(mids) > 1 and mids[0] in inside)
    return total - single


def signed_parts(wide: list[tuple[str, ...]]) -> list[tuple[int, list[str]]]:
    """Inclusion and exclusion over the power sets of ``wide``: sign and common skills of every choice of them."""
    sums: dict[tuple[str, ...], int] = {}
    for size in range(1, len(wide) + 1):
        for chosen in combinations(wide, size):
            common = tuple(sorted(set(chosen[0]).intersection(*chosen[1:])))
            if len(common) >= 2:
                sums[common] = sums.get(common, 0) + (1 if size % 2 else -1)
    return [(sign, list(common)) for common, sign in sums.items() if sign]


def numbered_sets(sets: DataFrame, used: DataFrame, list_set: int = LIST_SET, max_wide: int = MAX_WIDE) -> DataFrame:
    """Adds ``set_index`` to ``used``: the place of a set among all sets used together at least once, from 0.

    The subsets of records of up to ``list_set`` skills are listed and ranked; those of wider ones are counted by
    powers of two, never listed, for up to ``max_wide`` wide records of which none holds another (more raise ValueError). The
    index is a decimal, as a record of 80 skills has 2 ** 80 subsets.
    """
    sets = checkpoint(sets.select("all", "n"))
    broad = sets.filter(F.size("all") > list_set)
    rows = [tuple(r["all"]) for r in broad.select("all").limit(1000).collect()]
    tops = [w for w in rows if not any(w != o and set(w) <= set(o) for o in rows)]
    if len(tops) > max_wide or len(rows) == 1000:
        raise ValueError(f"more than {max_wide} records of over {list_set} skills: raise list_set or max_wide")
    parts = signed_parts(tops)
    within = F.lit(False)
    for w in tops:
        within = within | (F.size(F.array_except("mids", F.array(*[F.lit(x) for x in w]))) == 0)
    narrow = listed_subsets(sets.filter(F.size("all") <= list_set)).select("mids").distinct().filter(~within)
    both = narrow.withColumn("_kind", F.lit(0)).unionByName(used.select("mids", F.lit(1).alias("_kind")))
    ranked = global_rank(both, [F.col("mids"), F.col("_kind")], "_all").filter("_kind = 1").select("mids", "_all")
    own = global_rank(used, [F.col("mids")], "_own")
    listed = F.when(within, 0).otherwise(1)
    placed = own.join(ranked, "mids").withColumn("_index", F.col("_all") - F.col("_own") - listed)
    if not parts:
        return placed.withColumn("set_index", F.col("_index").cast("decimal(38,0)")).drop("_all", "_own", "_index")

    @F.pandas_udf("string")
    def counted(column: pd.Series) -> pd.Series:
        return pd.Series([str(sum(sign * subsets_before(list(m), common) for sign, common in parts)) for m in column], dtype=object)

    index = F.col("_index").cast("decimal(38,0)") + counted("mids").cast("decimal(38,0)")
    return placed.withColumn("set_index", index.cast("decimal(38,0)")).drop("_all", "_own", "_index")
