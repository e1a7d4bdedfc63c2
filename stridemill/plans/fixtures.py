"""The given tables as engine inputs (FIXTURES.md): steps from events, graph nodes from
embeddings, dialogues from conversations. Column logic only, so each input grows with its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.operators import traces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    action = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("search[plan "), k.cast("string"), F.lit("]")))
        .when(F.col("event_type") == "view",
              F.concat(F.lit("click[b0"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit("]")))
        .when(F.col("event_type") == "click",
              F.element_at(F.array(*map(F.lit, ["click[description]", "click[large]", "click[next >]", "click[red]"])),
                           k % 4 + 1))
        .when(F.col("event_type") == "purchase", "click[buy now]")
        .otherwise(F.concat(F.lit("open page "), (k % 5).cast("string")))
    )
    return e.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 4).cast("string")).alias("run_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_"), F.date_format(ts, "yyyy-MM-dd")).alias("task_id"),
        F.lit("webshop").alias("env"),
        F.concat(F.lit("goal "), (F.col("user_id") % 20).cast("string")).alias("goal"),
        F.when(F.col("event_type") == "error", "Invalid action").otherwise(F.col("event_type")).alias("observation"),
        action.alias("action"),
        F.when(F.col("event_type") == "purchase", F.least(F.lit(1.0), F.col("value") / 500)).otherwise(0.0).alias("reward"),
        F.lit(False).alias("done"),
        F.to_json(F.struct(F.struct(k.alias("total_tokens")).alias("agent"))).alias("info"),
        F.col("event_id").alias("pos"),
        ts.alias("ts"),
        k.alias("k"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.number_steps(logged_steps(spark, sf_dir), ["ts", "pos"])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.segments(steps(spark, sf_dir))


def graph_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded segments: five vectors make a trajectory, even trajectories succeed."""
    e = table(spark, sf_dir, "embeddings")
    trajectory = F.floor(F.col("vec_id") / 5)
    action = F.when(F.col("label") % 2 == 0, "click[description]").otherwise("search[q]")
    success = trajectory % 2 == 0
    reward = F.when(success, 1.0).otherwise(0.0)
    return e.select(
        F.col("vec_id").cast("string").alias("segment_id"),
        trajectory.cast("string").alias("trajectory_id"),
        F.lit("webshop").alias("env"),
        F.concat(F.lit("goal "), (trajectory % 20).cast("string")).alias("goal"),
        (F.col("vec_id") % 5).cast("long").alias("step_index"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"),
        F.when(F.col("label") % 2 == 0, "inspect_product").otherwise("search_query").alias("template"),
        action.alias("action"),
        F.concat_ws(" ", F.lit("vector"), F.col("vec_id").cast("string")).alias("text"),
        success.alias("success"),
        reward.alias("final_reward"),
        F.lit(0.0).alias("step_reward"),
        F.lit(False).alias("done"),
        F.col("vec_id").alias("pos"),
        F.col("embedding").alias("vector"),
        F.col("label").alias("group"),
    )


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("task_id"), (F.col("turn") + 1).alias("t"), "role", "text"
    )
