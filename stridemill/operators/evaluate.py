"""Run metrics over logged steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.functions import text as tx
from stridemill.scale import halo_chunks

AGENT_TOKENS = "$.agent.total_tokens"
RETRIEVAL_TOKENS = "$.retrieval.embedding_total_tokens"


def flag_present(info: Column) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(info), "valid_action"), F.lit(False))


def flag_value(info: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(info), "$.valid_action", "boolean")


def step_flags(steps: DataFrame) -> DataFrame:
    """Per step: invalid or not, same action as the step before, token counts."""
    info = F.col("info")
    chunked = halo_chunks(steps, "t", before=1)
    window = Window.partitionBy("task_id", "_chunk").orderBy("t")
    looped = chunked.withColumn(
        "loop", F.coalesce(F.lag("action").over(window).eqNullSafe(F.col("action")) & F.lag("t").over(window).isNotNull(),
                           F.lit(False)))
    return looped.filter("_core").drop("_core", "_chunk").withColumns({
        "invalid": tx.is_invalid_step(flag_present(info), flag_value(info), F.col("observation")),
        "agent_tokens": F.coalesce(F.get_json_object(info, AGENT_TOKENS).cast("long"), F.lit(0).cast("long")),
        "retrieval_tokens": F.coalesce(F.get_json_object(info, RETRIEVAL_TOKENS).cast("long"), F.lit(0).cast("long")),
    })


def run_summary(steps: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Success, steps, reward, invalid, loop and token metrics, per run if ``runs`` is given.

    ``steps`` carries ``final_reward``. Each task contributes its outcome on
    its first step, so one aggregate over the steps is enough.
    """
    first = F.col("t") == 1
    episodes = F.count(F.when(first, 1))
    n = F.greatest(episodes, F.lit(1)).cast("double")
    all_steps = F.count(F.lit(1))
    total = F.greatest(all_steps, F.lit(1)).cast("double")
    agent = F.coalesce(F.sum("agent_tokens"), F.lit(0))
    search = F.coalesce(F.sum("retrieval_tokens"), F.lit(0))
    return step_flags(steps).groupBy(*(runs or [])).agg(
        (F.count(F.when(first & (F.col("final_reward") > 0), 1)) / n).alias("success_rate"),
        episodes.alias("episodes"),
        (all_steps / n).alias("avg_steps"),
        (F.coalesce(F.sum(F.when(first, F.col("final_reward"))), F.lit(0.0)) / n).alias("avg_reward"),
        (F.count(F.when(F.col("invalid"), 1)) / total).alias("invalid_action_rate"),
        (F.count(F.when(F.col("loop"), 1)) / total).alias("loop_rate"),
        (agent / n).alias("avg_token_cost"),
        (search / n).alias("avg_retrieval_embedding_token_cost"),
        ((agent + search) / n).alias("avg_total_token_cost"),
    )


def average_retrieved(records: DataFrame, found: DataFrame, record_keys: list[str], runs: list[str] | None = None) -> DataFrame:
    """Mean number of skills per retrieval record, records without any included."""
    runs = runs or []
    counts = found.groupBy(*record_keys).agg(F.count(F.lit(1)).alias("_n"))
    return records.join(counts, record_keys, "left").groupBy(*runs).agg(
        F.coalesce(F.avg(F.coalesce("_n", F.lit(0))), F.lit(0.0)).alias("avg_retrieved_skills")
    )
