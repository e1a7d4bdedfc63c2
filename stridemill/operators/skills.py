"""Skill records: statistics, recent behaviour, top labels and templates, texts.

Skills are built from a member table (one row per skill key and segment).
Members are never gathered into a list; they stay a bridge table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.functions import text as tx
from stridemill.functions.numeric import safe_mean
from stridemill.scale import broadcast_if_small, checkpoint, lookup_join, top_rows

RECENT = 10
TOP = 5
STRIPES = 32
SEGMENT = ("trajectory_id", "label", "template", "success", "final_reward", "step_reward")
MEANS = ("success", "final_reward", "step_reward")


def top_counts(members: DataFrame, value: str, n: int = TOP, key: str = "key", name: str | None = None) -> DataFrame:
    """Per key, the ``n`` most frequent values as ``[{value, count}]``; ties by first appearance."""
    return _top(members.groupBy(key, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("count"), F.min("pos").alias("_first")), n, key, name or value)


def _top(counted: DataFrame, n: int, key: str, name: str) -> DataFrame:
    best = top_rows(counted, [key], [F.desc("count"), F.asc("_first")], n, "_r")
    listed = F.array_sort(F.collect_list(F.struct("_r", "value", "count")))
    return best.groupBy(key).agg(
        F.transform(listed, lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias(name)
    )


def _cell_counts(cells: DataFrame, value: str, name: str) -> DataFrame:
    """As ``top_counts`` of the members, from their cells."""
    return _top(cells.groupBy("key", F.col(value).alias("value")).agg(
        F.sum("n").alias("count"), F.min("first").alias("_first")), TOP, "key", name)


def skill_cells(members: DataFrame, key: str = "key") -> DataFrame:
    """Counts, sums and outermost places of the members by key, label, template and stripe of places, stored.

    One partial aggregate that statistics, top counts and the bound of the recent members are read from.
    """
    counted = [f(F.col(c).cast("double")).alias(f"{name}_{c}") for c in MEANS for name, f in (("sum", F.sum), ("count", F.count))]
    stripe = F.pmod(F.xxhash64("pos"), F.lit(STRIPES)).alias("_stripe")
    return checkpoint(members.groupBy(key, "label", "template", stripe).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), *counted))


def skill_statistics(members: DataFrame, cells: DataFrame, key: str = "key") -> DataFrame:
    """Support, outcome and reward means, distinct trajectories."""
    names = {"success": "success_rate", "final_reward": "avg_reward", "step_reward": "avg_step_reward"}
    means = [F.coalesce(F.try_divide(F.sum(f"sum_{c}"), F.sum(f"count_{c}")), F.lit(0.0)).alias(names[c]) for c in MEANS]
    summed = cells.groupBy(key).agg(F.sum("n").alias("support"), *means)
    seen = members.select("trajectory_id", key).distinct().groupBy(key).agg(F.count("trajectory_id").alias("trajectory_count"))
    return summed.join(seen, key, "left")


def recent_statistics(members: DataFrame, cells: DataFrame, key: str = "key", last: int = RECENT) -> DataFrame:
    """Success rate and mean reward of the last members by position.

    The last places of ``last`` stripes are as many members, so none before the first of them is among the last: only
    members from there on are ranked, and all of a key with fewer stripes.
    """
    ends = cells.groupBy(key, "_stripe").agg(F.max("last").alias("last")).filter(F.col("last").isNotNull())
    floors = top_rows(ends, [key], [F.desc("last")], last, "_r").filter(F.col("_r") == last).select(key, F.col("last").alias("_from"))
    floors, small = broadcast_if_small(checkpoint(floors), 128)
    narrow = members.select(key, "pos", "success", "final_reward")
    near = narrow.join(floors, key, "left") if small else lookup_join(narrow, floors, [key], "left")
    near = near.filter(F.col("_from").isNull() | (F.col("pos") >= F.col("_from")))
    return top_rows(near, [key], [F.desc("pos")], last, "_r").groupBy(key).agg(
        safe_mean(F.col("success")).alias("recent_success_rate"),
        safe_mean(F.col("final_reward")).alias("_recent_reward"),
    )


def default_content() -> Column:
    """Description for a skill that brings no text of its own."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Skill: "), "name"),
        F.concat(F.lit("Granularity: "), "granularity"),
        F.concat(F.lit("Event patterns: "), tx.counter_text(F.col("labels"))),
        F.concat(F.lit("Action templates: "), tx.counter_text(F.col("action_templates"))),
        F.format_string("Historical success rate: %.3f", "success_rate"),
        F.format_string("Historical reward: %.3f", "avg_reward"),
    )


def skill_text() -> Column:
    """Text a skill is matched by. The stored embedding text repeats it, which leaves every cosine unchanged."""
    return F.concat_ws("\n", "name", "granularity", "content")


def build_skills(members: DataFrame, heads: DataFrame, segment_count: Column, source_method: str) -> DataFrame:
    """Skill rows for ``heads`` (key, skill_id, pos, name, granularity, content and extras).

    The members are read three times: for their cells, the distinct trajectories and the last places.
    Every aggregate is partial before its shuffle and the joins are between skill-sized tables.
    """
    empty = F.array().cast("array<struct<value:string,count:bigint>>")
    cells = skill_cells(members)
    joined = (
        heads.join(skill_statistics(members, cells), "key", "left")
        .join(recent_statistics(members, cells), "key", "left")
        .join(_cell_counts(cells, "label", "labels"), "key", "left")
        .join(_cell_counts(cells, "template", "action_templates"), "key", "left")
        .withColumns({
            "support": F.coalesce("support", F.lit(0).cast("long")),
            "trajectory_count": F.coalesce("trajectory_count", F.lit(0).cast("long")),
            "labels": F.coalesce("labels", empty),
            "action_templates": F.coalesce("action_templates", empty),
            **{c: F.coalesce(c, F.lit(0.0)) for c in
               ("success_rate", "avg_reward", "avg_step_reward", "recent_success_rate", "_recent_reward")},
        })
        .withColumns({
            "coverage": F.coalesce(F.try_divide(F.col("support").cast("double"), segment_count), F.lit(0.0)),
            "failure_rate": F.lit(1.0) - F.col("success_rate"),
            "recent_reward_lift": F.col("_recent_reward") - F.col("avg_reward"),
        })
    )
    written = F.coalesce(F.nullif("content", F.lit("")), default_content())
    texted = joined.withColumn("content", written).withColumns({
        "embedding_text": F.concat_ws("\n", "name", "granularity", F.col("content")),
        "token_cost": tx.token_count(F.col("content")),
        "source_method": F.lit(source_method),
    })
    extras = {
        "tower_level": F.col("granularity"),
        "child_skill_ids": F.lit(None).cast("array<string>"),
        "deployment_utility": F.lit(None).cast("double"),
        "deployment_weight": F.lit(None).cast("double"),
        "refinement_action": F.lit(None).cast("string"),
    }
    full = texted.withColumns({k: v for k, v in extras.items() if k not in texted.columns})
    return full.drop("key", "_recent_reward")


def skill_members(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Bridge table ``skill_id, segment_id, pos``."""
    keyed = members.select("key", "segment_id", "pos")
    return lookup_join(keyed, heads.select("key", "skill_id"), ["key"]).select("skill_id", "segment_id", "pos")


def member_segments(bridge: DataFrame, segs: DataFrame) -> DataFrame:
    """Members with their segment columns; ids unknown to the model drop out. A bridge that carries these columns needs no join."""
    if set(SEGMENT) <= set(bridge.columns):
        return bridge.select(F.col("skill_id").alias("key"), "segment_id", "pos", *SEGMENT)
    known = segs.select("segment_id", *SEGMENT)
    return bridge.select(F.col("skill_id").alias("key"), "segment_id", "pos").join(known, "segment_id")


def members_of(bridge: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the bridge whose skill is listed in ``ids``, which is materialised first; few ids are broadcast."""
    few, _ = broadcast_if_small(checkpoint(ids.select("skill_id").distinct()), 64)
    return bridge.join(few, "skill_id", "left_semi")


def place_number(outer: Column, inside: Column) -> Column:
    """A place inside a place as one number in the same order, which aggregates keep in hash tables; null comes first inside."""
    whole = lambda c: c.cast("decimal(20,0)")
    return whole(outer) * whole(F.lit(str(1 << 65))) + F.coalesce(whole(inside), whole(F.lit(str(-(1 << 63) - 1))))


def unique_members(members: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per (key, segment): the first by ``order`` wins. The key pair keeps groups tiny."""
    first = members.groupBy(key, "segment_id").agg(
        F.min_by(F.struct(*[c for c in members.columns if c not in (key, "segment_id")]), F.struct(*order)).alias("_s")
    )
    return first.select(key, "segment_id", "_s.*")
