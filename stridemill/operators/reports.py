"""Comparison tables over runs, models, selectors and skill levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.functions.numeric import safe_mean, success_per_1k_tokens, zero_if_null
from stridemill.functions.text import LEVEL_ORDER, method_label

MODEL_MEASURES = [
    "skill_count", "avg_skill_token_cost", "total_skill_token_cost", "avg_skill_support", "avg_skill_success_rate",
    "avg_skill_reward", "avg_skill_coverage",
]
UPDATES = ["split_child_count", "merged_skill_count", "promoted_high_skill_count", "reinforced_high_skill_count"]


def model_statistics(skills: DataFrame, keys: list[str]) -> DataFrame:
    """The seven measures of a library, per key."""
    return skills.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("skill_count"),
        safe_mean(zero_if_null(F.col("token_cost"))).alias("avg_skill_token_cost"),
        F.coalesce(F.sum(zero_if_null(F.col("token_cost"))), F.lit(0.0)).alias("total_skill_token_cost"),
        safe_mean(zero_if_null(F.col("support"))).alias("avg_skill_support"),
        safe_mean(zero_if_null(F.col("success_rate"))).alias("avg_skill_success_rate"),
        safe_mean(zero_if_null(F.col("avg_reward"))).alias("avg_skill_reward"),
        safe_mean(zero_if_null(F.col("coverage"))).alias("avg_skill_coverage"),
    )


def model_summary(skills: DataFrame, segment_counts: DataFrame, retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Mining summary per model: library size and cost, segments, retrieval averages.

    ``retrieved``: one row per retrieval record with ``n`` skills and ``embedding_total_tokens``.
    """
    looked = retrieved.groupBy(*keys).agg(
        safe_mean(F.col("n")).alias("avg_retrieved_skills"),
        safe_mean(zero_if_null(F.col("embedding_total_tokens"))).alias("avg_retrieval_embedding_token_cost"))
    stats = model_statistics(skills, keys).select(
        *keys, "skill_count", "avg_skill_token_cost", "total_skill_token_cost", "avg_skill_support")
    joined = segment_counts.join(stats, keys, "left").join(looked, keys, "left")
    return joined.select(*keys, "segment_count", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c not in (*keys, "segment_count")])


def flatten_components(summary: DataFrame, names: list[str]) -> DataFrame:
    """The ``components`` map as ``component_*`` columns."""
    return summary.withColumns({f"component_{n}": F.col("components")[n] for n in names}).drop("components")


def with_model_statistics(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Fill the measures a row does not bring itself."""
    renamed = stats.select(*keys, *[F.col(c).alias(f"_{c}") for c in MODEL_MEASURES])
    joined = rows.join(renamed, keys, "left")
    filled = {
        c: F.coalesce(*([F.col(c)] if c in rows.columns else []), F.col(f"_{c}"), F.lit(0)) for c in MODEL_MEASURES
    }
    return joined.withColumns(filled).drop(*[f"_{c}" for c in MODEL_MEASURES])


def with_refinement_statistics(rows: DataFrame, refined: DataFrame, keys: list[str]) -> DataFrame:
    """Refined skill count and the four update counts; null for rows that were never refined.

    ``refined``: keys, ``refined_skill_count`` and any of the update counts.
    """
    present = F.col("refined_skill_count").isNotNull()
    joined = rows.join(refined, keys, "left")
    return joined.withColumns({
        c: F.when(present, F.coalesce(c, F.lit(0)) if c in joined.columns else F.lit(0)) for c in UPDATES})


def run_method() -> Column:
    """First non-empty of deployment method, mined method and the model's own."""
    parts = [F.nullif(c, F.lit("")) for c in ("deployment_model_method", "model_method", "_model_method")]
    return F.coalesce(*parts, F.lit(""))


def run_rows(summaries: DataFrame, stats: DataFrame, refined: DataFrame, retrieved: DataFrame, methods: DataFrame) -> DataFrame:
    """One comparison row per run directory.

    ``retrieved``: ``experiment_dir`` with the two retrieval averages; ``methods``: ``experiment_dir, _model_method``.
    """
    keys = ["experiment_dir"]
    rows = summaries.withColumn("row_type", F.lit("run")).join(methods, keys, "left").withColumn("method", run_method())
    rows = with_refinement_statistics(with_model_statistics(rows, stats, keys), refined, keys)
    looked = retrieved.select(*keys, F.col("avg_retrieved_skills").alias("_r"), F.col("avg_deployment_retrieved_skills").alias("_d"))
    rows = rows.join(looked, keys, "left")
    own = lambda c, extra: F.coalesce(*([F.col(c)] if c in rows.columns else []), F.col(extra), F.lit(0.0))
    return rows.withColumns({
        "avg_retrieved_skills": own("avg_retrieved_skills", "_r"),
        "avg_deployment_retrieved_skills": own("avg_deployment_retrieved_skills", "_d"),
        "success_per_1k_tokens": success_per_1k_tokens(F.col("success_rate"), F.col("avg_total_token_cost"), F.col("avg_token_cost")),
    }).drop("_r", "_d", "_model_method")


def model_rows(summaries: DataFrame, stats: DataFrame, refined: DataFrame, methods: DataFrame) -> DataFrame:
    """One comparison row per mined model directory."""
    keys = ["experiment_dir"]
    rows = summaries.join(methods, keys, "left").withColumn("row_type", F.lit("mining_model"))
    rows = rows.withColumn("method", F.coalesce(F.nullif("method", F.lit("")), "_model_method", F.lit(""))).drop("_model_method")
    return with_refinement_statistics(with_model_statistics(rows, stats, keys), refined, keys).withColumn(
        "success_per_1k_tokens", F.lit(0.0))


def _selector_columns() -> list[Column]:
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("config", "records", "miner", "model_method")]
    split = [F.col("split")[c].alias(c) for c in ("train_records", "future_records", "train_segments", "skill_count", "future_ratio")]
    return ["selector_metrics_path", *text, F.coalesce("top_k", F.lit(0).cast("long")).alias("top_k"), *split]


def selector_rows(results: DataFrame) -> DataFrame:
    """One row per selector of every result document."""
    return results.select(*_selector_columns(), F.explode("selectors").alias("selector", "m")).select("*", "m.*").drop("m")


def selector_batch_rows(results: DataFrame) -> DataFrame:
    """One row per batch and selector of every result document."""
    batches = results.select(*_selector_columns(), F.explode("batches").alias("b"))
    spans = [F.coalesce(F.col(f"b.{c}"), F.lit(0).cast("long")).alias(c) for c in ("batch_index", "task_start", "task_end", "task_count")]
    kept = [c for c in batches.columns if c != "b"]
    return batches.select(*kept, *spans, F.explode("b.selectors").alias("selector", "m")).select("*", "m.*").drop("m")


def skill_rows(skills: DataFrame, row_type: str) -> DataFrame:
    """Skill rows of a report with defaults; ``skills`` carries ``experiment_dir``, ``method`` and ``member_count``."""
    measures = ["token_cost", "success_rate", "avg_reward", "coverage"]
    return skills.select(
        F.lit(row_type).alias("row_type"), "experiment_dir", "method", "skill_id", "name", "granularity",
        F.coalesce("support", "member_count", F.lit(0)).cast("double").alias("support"),
        *[zero_if_null(F.col(c)).alias(c) for c in measures],
    )


def granularity_rows(rows: DataFrame) -> DataFrame:
    """Skill counts and means per method, directory and level; a missing level is a group of its own."""
    return rows.groupBy("method", "experiment_dir", "granularity").agg(
        F.count("skill_id").alias("skill_count"), F.avg("support").alias("avg_support"),
        F.avg("token_cost").alias("avg_token_cost"), F.avg("success_rate").alias("avg_success_rate"),
        F.avg("avg_reward").alias("avg_reward"), F.avg("coverage").alias("avg_coverage"),
    )


def granularity_pivot(levels: DataFrame, order: list[str] = LEVEL_ORDER) -> DataFrame:
    """Skill counts by method label and level, known levels only, in fixed order."""
    usable = levels.filter("granularity is not null and skill_count is not null")
    present = {r[0] for r in usable.select("granularity").filter(F.col("granularity").isin(order)).distinct().collect()}
    columns = [c for c in order if c in present]
    return (
        usable.withColumn("method_label", method_label(F.col("method")))
        .groupBy("method_label").pivot("granularity", columns).agg(F.sum("skill_count")).na.fill(0, columns)
        .orderBy("method_label")
    )


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the generated tables."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


def collected_rows(summaries: DataFrame, skills: DataFrame, retrieved: DataFrame, methods: DataFrame) -> DataFrame:
    """The short result table: summary scalars, skill count, both retrieval averages."""
    keys = ["experiment_dir"]
    counts = skills.groupBy(*keys).agg(F.count(F.lit(1)).alias("_skills"))
    rows = summaries.join(counts, keys, "left").join(retrieved.select(
        *keys, F.col("avg_retrieved_skills").alias("_r"), F.col("avg_deployment_retrieved_skills").alias("_d")), keys, "left").join(methods, keys, "left")
    has = rows.columns
    method = [F.col("model_method")] if "model_method" in has else []
    return rows.withColumns({
        "model_method": F.coalesce(*method, F.col("_model_method"), F.lit("")),
        "skill_count": F.coalesce(*([F.col("skill_count")] if "skill_count" in has else []), F.col("_skills"), F.lit(0)),
        "avg_retrieved_skills": F.coalesce("_r", F.lit(0.0)),
        "avg_deployment_retrieved_skills": F.coalesce("_d", F.lit(0.0)),
    }).drop("_skills", "_r", "_d", "_model_method")


def report_columns(df: DataFrame) -> list[str]:
    """Columns with scalar values, the ones a flat report keeps."""
    return [f.name for f in df.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "array", "struct")]


