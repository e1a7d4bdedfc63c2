"""Queries on comparison tables. Four runs and their libraries are derived from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill import schemas
from stridemill.operators import evaluate, reports
from stridemill.plans import fixtures as fx
from stridemill.plans import library
from stridemill.plans.oracle import CTES
from stridemill.plans.registry import query, r6, rounded
from stridemill.plans.trace_queries import SUMMARY, flagged_steps

METHODS = ["tower", "planned", "flat", "no_skill"]

# a library per run: low by template, mid by event kind, the last kind without a level
CTES["rskills"] = """
SELECT run_id AS experiment_dir, ['tower', 'planned', 'flat', 'no_skill'][right(run_id, 1)::INT + 1] AS method, 'low_' || template AS skill_id, 'Low ' || template AS name, 'low' AS granularity,
 count(*) AS support, length(template)::DOUBLE AS token_cost, avg(success::INT) AS success_rate, avg(final_reward) AS avg_reward, NULL::DOUBLE AS coverage FROM segs GROUP BY run_id, template
UNION ALL SELECT run_id, ['tower', 'planned', 'flat', 'no_skill'][right(run_id, 1)::INT + 1], 'mid_' || cluster, 'Mid ' || cluster, CASE WHEN cluster < 3 THEN 'mid' END, NULL, 9.0, avg(success::INT), avg(final_reward), count(*) / 10000.0
 FROM clustered GROUP BY run_id, cluster"""
CTES["rrows"] = """
SELECT experiment_dir, method, skill_id, name, granularity, coalesce(support, 7)::DOUBLE AS support, token_cost, success_rate, avg_reward, coalesce(coverage, 0) AS coverage FROM rskills"""


def method_of(run: str = "run_id"):
    return F.element_at(F.array(*map(F.lit, METHODS)), F.substring(run, -1, 1).cast("int") + 1)


def run_segments(spark: SparkSession, sf: str) -> DataFrame:
    from stridemill.operators.traces import segments

    steps = fx.steps(spark, sf)
    # the run of a segment is the run of its user
    segs = library.clustered(segments(steps))
    user = F.regexp_extract("trajectory_id", "^u([0-9]+)_", 1).cast("long")
    return segs.withColumn("run_id", F.concat(F.lit("run_"), (user % 4).cast("string")))


def run_skills(spark: SparkSession, sf: str) -> DataFrame:
    segs = run_segments(spark, sf)
    outcome = [F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("final_reward").alias("avg_reward")]
    low = segs.groupBy("run_id", "template").agg(F.count(F.lit(1)).alias("support"), *outcome).select(
        "run_id", F.concat(F.lit("low_"), "template").alias("skill_id"), F.concat(F.lit("Low "), "template").alias("name"),
        F.lit("low").alias("granularity"), "support", F.length("template").cast("double").alias("token_cost"),
        "success_rate", "avg_reward", F.lit(None).cast("double").alias("coverage"))
    mid = segs.groupBy("run_id", "cluster").agg(F.count(F.lit(1)).alias("n"), *outcome).select(
        "run_id", F.format_string("mid_%d", "cluster").alias("skill_id"), F.format_string("Mid %d", "cluster").alias("name"),
        F.when(F.col("cluster") < 3, "mid").alias("granularity"), F.lit(None).cast("long").alias("support"),
        F.lit(9.0).alias("token_cost"), "success_rate", "avg_reward", (F.col("n") / 10000.0).alias("coverage"))
    both = low.unionByName(mid)
    return both.withColumn("method", method_of()).withColumn("member_count", F.lit(7).cast("long")).withColumnRenamed("run_id", "experiment_dir")


@query("M4 E23", f"SELECT experiment_dir, method, skill_id, name, granularity, {', '.join(r6(c) for c in ('support', 'token_cost', 'success_rate', 'avg_reward', 'coverage'))}, 'run' AS row_type FROM rrows")
def skill_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.skill_rows(run_skills(spark, sf), "run"))


GRANULARITY = "SELECT method, experiment_dir, granularity, count(skill_id) AS skill_count, avg(support) AS avg_support, avg(token_cost) AS avg_token_cost, avg(success_rate) AS avg_success_rate, avg(avg_reward) AS avg_reward, avg(coverage) AS avg_coverage FROM rrows GROUP BY ALL"
CTES["glevels"] = GRANULARITY


@query("E23", f"SELECT method, experiment_dir, granularity, skill_count, {', '.join(r6(c) for c in ('avg_support', 'avg_token_cost', 'avg_success_rate', 'avg_reward', 'avg_coverage'))} FROM glevels")
def granularity_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.granularity_rows(reports.skill_rows(run_skills(spark, sf), "run")))


@query("E24 B22", """SELECT CASE method WHEN 'tower' THEN 'Tower' WHEN 'planned' THEN 'Planned' WHEN 'no_skill' THEN 'No Skill' ELSE 'Flat' END AS method_label,
 sum(CASE WHEN granularity = 'low' THEN skill_count ELSE 0 END)::BIGINT AS low, sum(CASE WHEN granularity = 'mid' THEN skill_count ELSE 0 END)::BIGINT AS mid FROM glevels WHERE granularity IS NOT NULL GROUP BY ALL""")
def granularity_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return reports.granularity_pivot(reports.granularity_rows(reports.skill_rows(run_skills(spark, sf), "run")))


CTES["rstats"] = """
SELECT experiment_dir, count(*) AS skill_count, avg(token_cost) AS avg_skill_token_cost, sum(token_cost) AS total_skill_token_cost, avg(coalesce(support, 0)) AS avg_skill_support,
 avg(success_rate) AS avg_skill_success_rate, avg(avg_reward) AS avg_skill_reward, avg(coalesce(coverage, 0)) AS avg_skill_coverage FROM rskills GROUP BY experiment_dir"""
MEASURES = [c for c in reports.MODEL_MEASURES if c != "skill_count"]


@query("E21", f"SELECT experiment_dir, skill_count, {', '.join(r6(c) for c in MEASURES)} FROM rstats")
def model_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.model_statistics(run_skills(spark, sf), ["experiment_dir"]))


CTES["rsum"] = SUMMARY.format(keys="run_id AS experiment_dir, ", group=" GROUP BY run_id")


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.run_summary(flagged_steps(spark, sf), ["run_id"])
    last = F.substring("run_id", -1, 1).cast("int")
    return rows.select(
        F.col("run_id").alias("experiment_dir"), *[c for c in rows.columns if c != "run_id"],
        F.when(last == 0, "deployed").alias("deployment_model_method"), F.lit("").alias("model_method"),
        F.when(last == 1, F.lit(99).cast("long")).alias("skill_count"),
        F.create_map(F.lit("agent"), F.concat(F.lit("agent_"), last.cast("string")), F.lit("miner"), F.lit("tower")).alias("components"))


def retrieved_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.logged_steps(spark, sf).groupBy(F.col("run_id").alias("experiment_dir")).agg(
        F.avg((F.col("k") % 4).cast("double")).alias("avg_retrieved_skills"),
        F.avg((F.col("k") % 7).cast("double")).alias("avg_deployment_retrieved_skills"))


def refined_counts(spark: SparkSession, sf: str) -> DataFrame:
    return run_skills(spark, sf).groupBy("experiment_dir").agg(
        F.count(F.lit(1)).alias("refined_skill_count"), F.count(F.when(F.col("granularity") == "low", 1)).alias("split_child_count"))


CTES["rret"] = "SELECT run_id AS experiment_dir, avg(k % 4) AS ra, avg(k % 7) AS da FROM raw GROUP BY run_id"
CTES["rref"] = "SELECT experiment_dir, count(*) AS refined_skill_count, count(CASE WHEN granularity = 'low' THEN 1 END) AS split_child_count FROM rskills GROUP BY experiment_dir"
CTES["rmeth"] = "SELECT DISTINCT run_id AS experiment_dir, ['tower', 'planned', 'flat', 'no_skill'][right(run_id, 1)::INT + 1] AS m FROM raw"


def methods(spark: SparkSession, sf: str) -> DataFrame:
    return fx.logged_steps(spark, sf).select("run_id").distinct().select(F.col("run_id").alias("experiment_dir"), method_of().alias("_model_method"))


@query("M1 E21 E22 B21 C14", f"""SELECT experiment_dir, CASE WHEN experiment_dir = 'run_0' THEN 'deployed' ELSE m END AS method, 'agent_' || right(experiment_dir, 1) AS component_agent, 'tower' AS component_miner,
 CASE WHEN experiment_dir = 'run_1' THEN 99 ELSE coalesce(s.skill_count, 0) END AS skill_count, {r6('coalesce(avg_skill_token_cost, 0)', 'avg_skill_token_cost')}, refined_skill_count,
 split_child_count, CASE WHEN refined_skill_count IS NOT NULL THEN 0::BIGINT END AS merged_skill_count, {r6('ra', 'avg_retrieved_skills')}, {r6('da', 'avg_deployment_retrieved_skills')},
 round(CASE WHEN avg_total_token_cost > 0 THEN 1000.0 * success_rate / avg_total_token_cost ELSE 0 END, 3) + 0.0 AS success_per_1k_tokens
FROM rsum JOIN rmeth USING (experiment_dir) LEFT JOIN rstats s USING (experiment_dir) LEFT JOIN rret USING (experiment_dir) LEFT JOIN rref USING (experiment_dir)""")
def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    skills = run_skills(spark, sf)
    rows = reports.run_rows(
        reports.flatten_components(summaries(spark, sf), ["agent", "miner"]), reports.model_statistics(skills, ["experiment_dir"]),
        refined_counts(spark, sf), retrieved_counts(spark, sf), methods(spark, sf))
    return rounded(rows.withColumn("success_per_1k_tokens", F.round("success_per_1k_tokens", 3)).select(
        "experiment_dir", "method", "component_agent", "component_miner", "skill_count", "avg_skill_token_cost", "refined_skill_count",
        "split_child_count", "merged_skill_count", "avg_retrieved_skills", "avg_deployment_retrieved_skills", "success_per_1k_tokens"))


@query("M5 B21", f"""SELECT experiment_dir, m AS model_method, CASE WHEN experiment_dir = 'run_1' THEN 99 ELSE coalesce(s.skill_count, 0) END AS skill_count,
 {r6('ra', 'avg_retrieved_skills')}, {r6('da', 'avg_deployment_retrieved_skills')}, r.success_rate FROM rsum r JOIN rmeth USING (experiment_dir) LEFT JOIN rstats s USING (experiment_dir) LEFT JOIN rret USING (experiment_dir)""")
def collected_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.collected_rows(summaries(spark, sf).drop("model_method"), run_skills(spark, sf), retrieved_counts(spark, sf), methods(spark, sf))
    return rounded(rows.select("experiment_dir", "model_method", "skill_count", "avg_retrieved_skills", "avg_deployment_retrieved_skills", "success_rate"))


@query("E20 E19", f"""SELECT r.experiment_dir, n AS segment_count, coalesce(skill_count, 0) AS skill_count, {r6('coalesce(avg_skill_token_cost, 0)', 'avg_skill_token_cost')},
 {r6('coalesce(total_skill_token_cost, 0)', 'total_skill_token_cost')}, {r6('coalesce(avg_skill_support, 0)', 'avg_skill_support')}, {r6('ra', 'avg_retrieved_skills')}, {r6('tk', 'avg_retrieval_embedding_token_cost')}
FROM (SELECT run_id AS experiment_dir, count(*) AS n, avg(k % 4) AS ra, avg(k % 9) AS tk FROM raw GROUP BY run_id) r LEFT JOIN rstats s USING (experiment_dir)""")
def model_summaries(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.logged_steps(spark, sf).withColumnRenamed("run_id", "experiment_dir")
    counts = e.groupBy("experiment_dir").agg(F.count(F.lit(1)).alias("segment_count"))
    looked = e.select("experiment_dir", (F.col("k") % 4).alias("n"), (F.col("k") % 9).alias("embedding_total_tokens"))
    return rounded(reports.model_summary(run_skills(spark, sf), counts, looked, ["experiment_dir"]))


@query("M2 E22", f"""SELECT experiment_dir, 'mining_model' AS row_type, m AS method, coalesce(skill_count, 0) AS skill_count, {r6('coalesce(avg_skill_reward, 0)', 'avg_skill_reward')}, refined_skill_count
FROM rmeth LEFT JOIN rstats USING (experiment_dir) LEFT JOIN rref USING (experiment_dir)""")
def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    named = methods(spark, sf)
    heads = named.select("experiment_dir", F.lit("").alias("method"))
    rows = reports.model_rows(heads, reports.model_statistics(run_skills(spark, sf), ["experiment_dir"]), refined_counts(spark, sf), named)
    return rounded(rows.select("experiment_dir", "row_type", "method", "skill_count", "avg_skill_reward", "refined_skill_count"))


def selector_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Result documents with nested maps, one per run, measures taken from the events."""
    e = fx.logged_steps(spark, sf)
    kinds = e.groupBy("run_id", F.col("observation").alias("selector")).agg(F.avg("k").alias("m"))
    measures = F.struct(*[(F.col("m") + i).alias(c) for i, c in enumerate(schemas.SELECTOR_MEASURES)])
    maps = kinds.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("selector", measures))).alias("selectors"))
    batch = F.array(*[F.struct(F.lit(i).cast("long").alias("batch_index"), F.lit(i * 10).cast("long").alias("task_start"),
                               F.lit(i * 10 + 10).cast("long").alias("task_end"), F.lit(10).cast("long").alias("task_count"),
                               F.col("selectors").alias("selectors")) for i in range(2)])
    return maps.select(
        F.col("run_id").alias("selector_metrics_path"), F.lit(None).cast("string").alias("config"), F.lit("r").alias("records"),
        F.lit("tower").alias("miner"), F.lit("tower").alias("model_method"),
        F.create_map(F.lit("train_records"), F.lit(6.0), F.lit("future_records"), F.lit(4.0)).alias("split"),
        F.lit(3).cast("long").alias("top_k"), "selectors", batch.alias("batches"))


CTES["sdocs"] = "SELECT run_id AS selector_metrics_path, CASE WHEN event_type = 'error' THEN 'Invalid action' ELSE event_type END AS selector, avg(k) AS m FROM raw GROUP BY ALL"


@query("M3", f"""SELECT selector_metrics_path, selector, '' AS config, 3 AS top_k, 6.0::DOUBLE AS train_records, {r6('m', 'future_utility_pearson')}, {r6('m + 5', 'regret')} FROM sdocs""")
def selector_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.selector_rows(selector_documents(spark, sf))
    return rounded(rows.select("selector_metrics_path", "selector", "config", "top_k", "train_records", "future_utility_pearson", "regret"))


@query("M3", f"""SELECT selector_metrics_path, selector, b AS batch_index, b * 10 AS task_start, b * 10 + 10 AS task_end, {r6('m + 7', 'avg_selected_token_cost')} FROM sdocs, (SELECT unnest([0, 1]) AS b)""")
def selector_batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.selector_batch_rows(selector_documents(spark, sf))
    return rounded(rows.select("selector_metrics_path", "selector", "batch_index", "task_start", "task_end", "avg_selected_token_cost"))


@query("A9", """SELECT 'runs' AS table_name, count(*) AS row_count FROM rmeth UNION ALL SELECT 'skills', count(*) FROM rskills UNION ALL SELECT 'selectors', count(*) FROM sdocs
UNION ALL SELECT 'skill_granularity', count(*) FROM glevels""")
def report_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.skill_rows(run_skills(spark, sf), "run")
    return reports.manifest({
        "runs": summaries(spark, sf), "skills": rows, "selectors": reports.selector_rows(selector_documents(spark, sf)),
        "skill_granularity": reports.granularity_rows(rows)})


@query("A7 A11", f"SELECT method, experiment_dir, granularity, skill_count, {r6('avg_token_cost')} FROM glevels")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """A report written as CSV and JSON, then read back from the CSV."""
    import uuid

    from stridemill.scale import checkpoint_dir
    from stridemill.sources import runs

    folder = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    runs.write_report(reports.granularity_rows(reports.skill_rows(run_skills(spark, sf), "run")), folder, "c_skill_granularity")
    back = runs.read_reports(spark, folder, "skill_granularity")
    return rounded(back.select("method", "experiment_dir", "granularity", F.col("skill_count").cast("long").alias("skill_count"),
                               F.col("avg_token_cost").cast("double").alias("avg_token_cost")))


@query("A8", """SELECT experiment_dir, method, granularity, skill_count FROM glevels
UNION ALL SELECT experiment_dir, NULL, NULL, skill_count FROM rstats""")
def result_union(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two shapes in one CSV under all their columns, read back."""
    import uuid

    from stridemill.scale import checkpoint_dir
    from stridemill.sources import runs

    folder = f"{checkpoint_dir(spark)}/union-{uuid.uuid4().hex}"
    skills = run_skills(spark, sf)
    levels = reports.granularity_rows(reports.skill_rows(skills, "run"))
    runs.write_union([levels, reports.model_statistics(skills, ["experiment_dir"])], folder)
    back = spark.read.option("header", True).csv(folder)
    return back.select("experiment_dir", "method", "granularity", F.col("skill_count").cast("long").alias("skill_count"))
