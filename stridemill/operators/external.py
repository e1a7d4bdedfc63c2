"""Exchange with other skill extractors: traces out as conversations, their libraries in as skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.functions.text import strip
from stridemill.operators.skills import build_skills, skill_members, unique_members
from stridemill.operators.tower import segment_total
from stridemill.scale import broadcast_if_small, checkpoint, global_rank, lookup_join

MEMBER_COLUMNS = ["segment_id", "trajectory_id", "label", "template", "success", "final_reward", "step_reward", "pos"]


class UnmappedSkillError(ValueError):
    """An imported skill names no source that exists among the segments."""


def conversation_heads(segs: DataFrame) -> DataFrame:
    """Per trajectory: goal and environment of its first segment, reward and outcome of its last."""
    return segs.groupBy("trajectory_id").agg(
        F.min_by("goal", "pos").alias("goal"), F.min_by("env", "pos").alias("env"),
        F.max_by("final_reward", "pos").alias("reward"),
        F.when(F.max_by("success", "pos"), "resolved").otherwise("unresolved").alias("outcome"),
        F.count(F.lit(1)).alias("segment_count"),
    )


def tool_call_messages(segs: DataFrame, tool_prefix: str = "trace") -> DataFrame:
    """Flat tool-call conversation: the goal, then an assistant and a tool message per segment.

    Message numbers follow from the step number, so no trajectory is gathered.
    """
    tool = F.concat_ws(".", F.lit(tool_prefix), "template")
    pair = F.array(
        F.struct(F.lit("assistant").alias("role"), F.col("action").alias("content"), tool.alias("tool"),
                 F.col("label").alias("label"), (F.col("step_index") * 2 - 1).alias("message")),
        F.struct(F.lit("tool").alias("role"), F.col("text").alias("content"), tool.alias("tool"),
                 F.lit(None).cast("string").alias("label"), (F.col("step_index") * 2).alias("message")),
    )
    turns = segs.select("trajectory_id", F.inline(pair))
    opening = conversation_heads(segs).select(
        "trajectory_id", F.lit("user").alias("role"), F.col("goal").alias("content"),
        F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("message"),
    )
    return opening.unionByName(turns)


def observation_steps(segs: DataFrame) -> DataFrame:
    """Flat role/observation trajectory: the goal, then one agent step per segment."""
    steps = segs.select(
        "trajectory_id", F.col("step_index").alias("position"), F.lit("agent").alias("role"),
        F.concat(F.lit("Action: "), "action").alias("content"), F.col("text").alias("observation"),
        "segment_id", "label", F.col("step_reward").alias("reward"),
    )
    opening = conversation_heads(segs).select(
        "trajectory_id", F.lit(0).cast("long").alias("position"), F.lit("user").alias("role"),
        F.col("goal").alias("content"), F.lit(None).cast("string").alias("observation"),
        F.lit(None).cast("string").alias("segment_id"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("double").alias("reward"),
    )
    return opening.unionByName(steps)


def nested_conversations(segs: DataFrame, messages: DataFrame, order: str) -> DataFrame:
    """One JSON record per trajectory, for export files only."""
    fields = [c for c in messages.columns if c not in ("trajectory_id", order)]
    history = messages.groupBy("trajectory_id").agg(
        F.array_sort(F.collect_list(F.struct(order, *fields))).alias("history"))
    return conversation_heads(segs).join(history, "trajectory_id")


def named_blocks(title: str, blocks: Column) -> Column:
    """References or scripts as a list text; null or empty gives an empty text.

    Each block has ``name, path, title, content, body``.
    """
    def line(b: Column) -> Column:
        name = F.coalesce(*[F.nullif(b[c], F.lit("")) for c in ("name", "path", "title")], F.lit("item"))
        value = F.coalesce(*[F.nullif(b[c], F.lit("")) for c in ("content", "body")], F.to_json(b))
        return F.concat(F.lit("- "), name, F.lit(": "), value)

    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0,
                  F.concat_ws("\n", F.lit(f"{title}:"), F.transform(blocks, line))).otherwise("")


def segments_for_sources(sources: DataFrame, segs: DataFrame) -> DataFrame:
    """Members of each key: segments whose trajectory id or goal equals one of its sources.

    ``sources``: ``key, spot, source``. A segment counts once per key, at its
    first place: by source, trajectory matches before goal matches, then by position.
    """
    carried = MEMBER_COLUMNS
    few, small = broadcast_if_small(checkpoint(sources), 256)
    rows = segs.select(*carried, "goal")
    if not small or not rows.groupBy("segment_id").count().filter("count > 1").isEmpty():
        hits = _source_hits(rows, carried)
        return unique_members(_placed(hits.join(few, "source") if small else lookup_join(hits, few, ["source"]), carried), "key", ["pos"])
    # with unique ids, a segment meets a key twice only if both its trajectory id and its goal are sources
    first = F.broadcast(few.groupBy("key", "source").agg(F.min("spot").alias("spot")))
    known = F.broadcast(few.select(F.col("source").alias("trajectory_id"), F.lit(True).alias("_known")).filter("trajectory_id <> ''").distinct())
    goals = known.select(F.col("trajectory_id").alias("goal"), F.col("_known").alias("_goal"))
    marked = rows.join(known, "trajectory_id", "left").join(F.broadcast(goals), "goal", "left")
    twice = F.col("_known").isNotNull() & F.col("_goal").isNotNull()
    once, several = [_placed(_source_hits(marked.filter(f), carried).join(first, "source"), carried) for f in (~twice, twice)]
    return once.unionByName(unique_members(several, "key", ["pos"]).select(*once.columns))


def _source_hits(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Both branches of every segment, read at once."""
    branches = F.array(*[F.struct(F.lit(i).alias("branch"), F.col(c).alias("source")) for i, c in enumerate(("trajectory_id", "goal"))])
    return rows.select(*carried, F.inline(branches)).filter("source <> ''")


def _placed(hits: DataFrame, carried: list[str]) -> DataFrame:
    return hits.withColumn("pos", F.struct("spot", "branch", "pos")).select("key", *carried)


def _place_number() -> Column:
    """A member's place as one number in the same order, which aggregates keep in hash tables; a null position comes first."""
    whole = lambda c: c.cast("decimal(20,0)")
    inside = F.coalesce(whole(F.col("pos.pos")), whole(F.lit(str(-(1 << 63) - 1))))
    outer = whole(F.col("pos.spot") * F.lit(2).cast("long") + F.col("pos.branch"))
    return outer * whole(F.lit(str(1 << 65))) + inside


def _imported(heads: DataFrame, sources: DataFrame, segs: DataFrame, method: str):
    # stored once for every aggregate over the members, as narrow rows, since the texts are not needed
    segs = checkpoint(segs.select(*MEMBER_COLUMNS, "goal"))
    members = segments_for_sources(sources, segs)
    lost = heads.join(members.select("key").distinct(), "key", "left_anti").select("name").take(5)
    if lost:
        raise UnmappedSkillError("no segment for: " + ", ".join(r["name"] for r in lost))
    skills = build_skills(members.withColumn("pos", _place_number()), heads, segment_total(segs), method)
    return skills, skill_members(members.withColumn("pos", F.col("pos.pos")), heads)


def import_planned_library(planning: DataFrame, items: DataFrame, segs: DataFrame, method: str = "planned"):
    """Planning (``task, plan``) and functional or atomic items
    (``granularity, index, name, document, content, tools, source_tasks``) as skills."""
    plans = global_rank(planning, [F.col("task")], "index").select(
        F.format_string(f"{method}_planning_%03d", "index").alias("key"), F.col("index").alias("pos"),
        F.concat(F.lit("Planning "), "task").alias("name"), F.lit("planning").alias("granularity"),
        F.concat_ws("\n", F.concat(F.lit("Task: "), "task"), F.coalesce("plan", F.lit(""))).alias("content"),
        F.array("task").alias("sources"),
    )
    tools = F.concat(F.lit("Tools: "), F.concat_ws(", ", F.coalesce("tools", F.array().cast("array<string>"))))
    rank = F.when(F.col("granularity") == "functional", 1).otherwise(2)
    others = items.select(
        F.concat(F.lit(f"{method}_"), "granularity", F.format_string("_%03d", "index")).alias("key"),
        (rank.cast("long") * (1 << 40) + F.col("index")).alias("pos"),
        F.coalesce(F.nullif("name", F.lit("")), F.concat(F.initcap("granularity"), F.format_string(" Skill %d", "index"))).alias("name"),
        "granularity",
        strip(F.concat_ws("\n", F.coalesce("document", F.lit("")), F.coalesce("content", F.lit("")), tools)).alias("content"),
        F.col("source_tasks").alias("sources"),
    )
    return _from_heads(plans.unionByName(others), segs, method)


def import_flat_library(items: DataFrame, segs: DataFrame, method: str = "flat"):
    """Flat items (``index, name, description, body, references, scripts, source_trajectories``) as skills."""
    heads = items.select(
        F.format_string(f"{method}_%03d", "index").alias("key"), F.col("index").alias("pos"),
        F.coalesce(F.nullif("name", F.lit("")), F.format_string("Flat Skill %d", "index")).alias("name"),
        F.lit("flat").alias("granularity"),
        strip(F.concat_ws(
            "\n", F.coalesce("description", F.lit("")), F.coalesce("body", F.lit("")),
            named_blocks("References", F.col("references")), named_blocks("Scripts", F.col("scripts")),
        )).alias("content"),
        F.col("source_trajectories").alias("sources"),
    )
    return _from_heads(heads, segs, method)


def _from_heads(heads: DataFrame, segs: DataFrame, method: str):
    sources = heads.select("key", F.posexplode("sources").alias("spot", "source"))
    kept = heads.withColumn("skill_id", F.col("key")).drop("sources")
    return _imported(kept, sources, segs, method)


def library_metadata(skills: DataFrame, method: str, source_path: str) -> DataFrame:
    """Provenance row of an imported model."""
    return skills.agg(F.count(F.lit(1)).alias("skill_count")).select(
        F.lit(method).alias("method"), F.lit(True).alias("imported"), F.lit(source_path).alias("official_output_path"),
        "skill_count")
