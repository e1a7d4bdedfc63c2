"""From logged steps to labelled segments, and the text views built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.functions import text as tx
from stridemill.scale import HOT_ROWS, global_rank, halo_chunks, lookup_join, number_rows, split_hot

TASK = ["task_id"]


def number_steps(logged: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the steps of every task from 1 and attach its step count and last reward.

    Ordinary tasks take one shuffle: the three windows share it. Tasks above
    ``hot_rows`` are numbered by range partitioning and summed separately.
    """
    last = F.struct(*order)
    cold, hot = split_hot(logged, TASK, hot_rows)
    task = Window.partitionBy(*TASK)
    numbered = cold.select(
        "*",
        F.row_number().over(task.orderBy(*order)).cast("long").alias("t"),
        F.count(F.lit(1)).over(task).alias("n_steps"),
        F.coalesce(F.max_by("reward", last).over(task), F.lit(0.0)).alias("final_reward"),
    )
    if hot is None:
        return numbered
    ranked = global_rank(hot, [F.col("task_id"), *[F.col(c) for c in order]], "_rank")
    heads = ranked.groupBy(*TASK).agg(
        F.min("_rank").alias("_first"),
        F.count(F.lit(1)).alias("n_steps"),
        F.coalesce(F.max_by("reward", last), F.lit(0.0)).alias("final_reward"),
    )
    slow = lookup_join(ranked, heads, TASK).withColumn("t", F.col("_rank") - F.col("_first") + 1)
    return numbered.unionByName(slow.select(*numbered.columns))


def cut_episodes(steps: DataFrame, max_steps: int) -> DataFrame:
    """Keep each task up to its first ``done`` step and at most ``max_steps`` steps.

    The stop is one small aggregate per task, so no running window is needed.
    """
    within = steps.filter(F.col("t") <= max_steps)
    stops = within.filter("done").groupBy(*TASK).agg(F.min("t").alias("_stop"))
    return (
        within.join(stops, TASK, "left")
        .filter(F.col("_stop").isNull() | (F.col("t") <= F.col("_stop")))
        .drop("_stop")
    )


def trajectories(steps: DataFrame) -> DataFrame:
    """Header row per task: outcome from the last reward (0 without one)."""
    return steps.groupBy(*TASK).agg(
        F.min_by("env", "t").alias("env"),
        F.min_by("goal", "t").alias("goal"),
        F.coalesce(F.max_by("reward", "t"), F.lit(0.0)).alias("final_reward"),
        F.count(F.lit(1)).alias("n_steps"),
        F.min("pos").alias("first_pos"),
    ).withColumn("success", F.col("final_reward") > 0)


def segment_text(env: Column, goal: Column, action: Column, observation: Column, success: Column, reward: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Env: "), env),
        F.concat(F.lit("Goal: "), goal),
        F.concat(F.lit("Action: "), action),
        F.concat(F.lit("Observation: "), F.substring(F.coalesce(observation, F.lit("")), 1, 500)),
        F.concat(F.lit("Outcome: success="), tx.python_bool(success), F.lit(", reward="), tx.float_text(reward)),
    )


def segments(steps: DataFrame) -> DataFrame:
    """One labelled segment per step; a pure projection once the outcome is on the step."""
    success = F.col("final_reward") > 0
    return steps.select(
        F.concat_ws("_seg_", "task_id", F.col("t").cast("string")).alias("segment_id"),
        F.col("task_id").alias("trajectory_id"),
        "env",
        "goal",
        F.col("t").alias("step_index"),
        tx.event_label(F.col("action")).alias("label"),
        tx.action_template(F.col("action")).alias("template"),
        "action",
        segment_text(
            F.col("env"), F.col("goal"), F.col("action"), F.col("observation"), success, F.col("final_reward")
        ).alias("text"),
        success.alias("success"),
        "final_reward",
        F.col("reward").alias("step_reward"),
        "done",
        "pos",
    )


def flatten_segments(records: DataFrame) -> DataFrame:
    """Segment records (nested metadata, defaults missing) to the flat segment table.

    Success falls back to a positive final reward when the flag is absent.
    """
    meta = F.col("metadata")
    action = F.coalesce(meta["action"], F.lit(""))
    reward = F.coalesce(meta["final_reward"], F.lit(0.0))
    return records.select(
        "segment_id",
        F.coalesce(meta["trajectory_id"], F.lit("unknown")).alias("trajectory_id"),
        F.coalesce(meta["env"], F.lit("")).alias("env"),
        F.coalesce(meta["goal"], F.lit("")).alias("goal"),
        F.coalesce("step_index", F.lit(0).cast("long")).alias("step_index"),
        F.coalesce("label", F.lit("Unknown")).alias("label"),
        tx.action_template(action).alias("template"),
        action.alias("action"),
        F.coalesce("text", F.lit("")).alias("text"),
        segment_success(records, reward).alias("success"),
        reward.alias("final_reward"),
        F.coalesce(meta["step_reward"], F.lit(0.0)).alias("step_reward"),
        F.coalesce(meta["done"], F.lit(False)).alias("done"),
        "pos",
    )


def segment_success(records: DataFrame, reward: Column) -> Column:
    """Present flag (null counts as false), else reward above zero.

    Readers that can tell a null flag from a missing key add ``flag_present``;
    without it a null flag is taken as missing.
    """
    flag = F.col("metadata")["trajectory_success"]
    if "flag_present" in records.columns:
        return F.when(F.col("flag_present"), F.coalesce(flag, F.lit(False))).otherwise(reward > 0)
    return F.coalesce(flag, reward > 0)


def sequence_edges(segs: DataFrame, relation: str = "next", order: str = "step_index") -> DataFrame:
    """Edge from every segment to its successor in the trajectory, weight 1."""
    pairs = step_pairs(segs, ["segment_id"], order)
    return pairs.select(
        F.col("segment_id").alias("source"),
        F.col("next_segment_id").alias("target"),
        F.lit(relation).alias("relation"),
        F.lit(1.0).alias("weight"),
    )


def segment_order(segs: DataFrame, order: str = "step_index") -> list[Column]:
    """List order of a trajectory's segments: ``order`` with null as 0, then place in the input, then id."""
    ties = [F.col(c) for c in ("pos", "segment_id") if c in segs.columns and c != order]
    return [F.coalesce(F.col(order), F.lit(0)), *ties]


def step_pairs(segs: DataFrame, columns: list[str], order: str = "step_index") -> DataFrame:
    """Neighbouring segments side by side; the successor's columns get the prefix ``next_``.

    Neighbours follow each other in ``segment_order``, whatever the gaps in ``order``; a dense number by that
    order lets the window be cut into bounded chunks.
    """
    dense = number_rows(segs, ["trajectory_id"], segment_order(segs, order), "_seq")
    chunked = halo_chunks(
        dense.select("trajectory_id", order, "_seq", *[c for c in columns if c not in ("trajectory_id", order)]), "_seq", after=1
    )
    window = Window.partitionBy("trajectory_id", "_chunk").orderBy("_seq")
    moved = [F.lead(c).over(window).alias(f"next_{c}") for c in columns]
    paired = chunked.select("*", F.lead(F.col(order)).over(window).alias("_next"), *moved)
    follows = F.lead("_seq").over(window).isNotNull()
    return paired.withColumn("_follows", follows).filter(F.col("_core") & F.col("_follows")).drop("_chunk", "_core", "_next", "_seq", "_follows")


def task_states(steps: DataFrame, recent: int = 5) -> DataFrame:
    """State before each step: what was last observed and the ``recent`` actions before it."""
    chunked = halo_chunks(steps, "t", before=recent)
    window = Window.partitionBy("task_id", "_chunk").orderBy("t")
    return (
        chunked.select(
            "task_id", "t", "env", "goal", "_core",
            F.coalesce(F.lag("observation").over(window), F.lit("")).alias("observation"),
            F.collect_list("action").over(window.rowsBetween(-recent, -1)).alias("recent_actions"),
        )
        .filter("_core")
        .drop("_core")
    )


def state_text(states: DataFrame) -> Column:
    """Query text of a live state: goal, environment, observation, recent actions."""
    return F.concat_ws(
        "\n", F.concat_ws("\n", "goal", "env", "observation"),
        F.when(F.size("recent_actions") > 0, F.concat_ws("\n", "recent_actions")),
    )


def task_texts(segs: DataFrame, first: int) -> DataFrame:
    """Query text of a logged task: goal, environment, label and text of its first segments.

    The first segments by ``segment_order``, whatever their numbers; each map task keeps that many per
    trajectory, so the list is bounded.
    """
    inside = Window.partitionBy("trajectory_id").orderBy(*segment_order(segs))
    head = segs.withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= first)
    parts = F.array_sort(F.collect_list(F.struct("_rank", "label", "text")))
    lines = F.flatten(F.transform(parts, lambda s: F.array(s["label"], s["text"])))
    return head.groupBy(F.col("trajectory_id").alias("task_id")).agg(
        F.concat_ws("\n", F.min("goal"), F.min("env"), F.concat_ws("\n", lines)).alias("text")
    )


def online_task_texts(segs: DataFrame, first: int = 5) -> DataFrame:
    """As ``task_texts``, with the empty observation line of a finished task."""
    return task_texts(segs, first).withColumn("text", F.concat("text", F.lit("\n")))


def graph_signature() -> Column:
    """Segment description with its template, as kept with the graph."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Label: "), "label"),
        F.concat(F.lit("Action template: "), "template"),
        F.concat(F.lit("Action: "), "action"),
        F.concat(F.lit("Goal: "), "goal"),
        F.concat(F.lit("Env: "), "env"),
        F.concat(F.lit("Observation: "), "text"),
    )


def embedding_signature() -> Column:
    """Segment description sent to the embedder."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Label: "), "label"),
        F.concat(F.lit("Action: "), "action"),
        F.concat(F.lit("Goal: "), "goal"),
        F.concat(F.lit("Environment: "), "env"),
        F.concat(F.lit("Observation and local outcome: "), "text"),
    )


def nested_records(steps: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """Nested JSON records per task, for export only.

    A task must fit one row of the JSON file by definition of the format;
    everything else in the package works on the flat tables.
    """
    fields = ["t", "observation", "action", "reward", "done", "info"]
    heads = steps.groupBy("task_id").agg(
        F.min_by("env", "t").alias("env"),
        F.min_by("goal", "t").alias("goal"),
        F.coalesce(F.max_by("reward", "t"), F.lit(0.0)).alias("final_reward"),
        F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"),
    )
    heads = heads.select(
        "task_id", "env", "goal", (F.col("final_reward") > 0).alias("success"), "final_reward", "steps"
    )
    if segs is None:
        return heads.withColumns({"token_cost": F.lit(0).cast("long"), "latency_sec": F.lit(0.0)})
    listed = segs.groupBy(F.col("trajectory_id").alias("task_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("step_index", segment_struct().alias("s")))), lambda x: x["s"]
        ).alias("segments")
    )
    return heads.join(listed, "task_id", "left")


def segment_struct() -> Column:
    """A flat segment row as the nested segment record."""
    return F.struct(
        "segment_id", "label", "step_index", "text",
        F.struct(
            "trajectory_id", "env", "goal", F.col("success").alias("trajectory_success"), "final_reward",
            "step_reward", "done", "action",
        ).alias("metadata"),
    )


def first_segments(segs: DataFrame) -> DataFrame:
    """Make ids unique on ingest: the last row of a repeated id wins."""
    newest = segs.groupBy("segment_id").agg(F.max("pos").alias("pos"))
    return segs.join(newest, ["segment_id", "pos"], "left_semi")
