"""Queries on skill scores, retrieval and selector evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill import schemas
from stridemill.operators import scoring, selectors, traces
from stridemill.operators.embedding import embed
from stridemill.plans import fixtures as fx
from stridemill.plans import library
from stridemill.plans.oracle import COST, CTES, pue_sql
from stridemill.plans.registry import query, r6, rounded
from stridemill.scale import checkpoint, checkpoint_dir
from stridemill.sources import models, records

LEVELS = {"high": 1, "mid": 2, "low": 3}


def ranked_sql(score: str, sims: str = "sims5", keys: str = "task_id", k: int = 3) -> str:
    return f"""SELECT {keys}, rank, skill_id, {r6('score')} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, pos) AS rank
 FROM (SELECT *, {score} AS score FROM {sims})) WHERE rank <= {k}"""


def best(spark: SparkSession, sf: str, name: str, **options) -> DataFrame:
    segs = fx.segments(spark, sf)
    found = scoring.retrieve(traces.online_task_texts(segs), library.build(segs).skills, name, **options)
    return rounded(found.select("task_id", "rank", "skill_id", "score"))


@query("I1 F2", ranked_sql("support"))
def retrieve_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "frequency")


@query("I2", ranked_sql("success_rate"))
def retrieve_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "success_rate")


@query("I3", ranked_sql("recent_reward_lift"))
def retrieve_recent_lift(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "recent_reward_lift")


@query("I4 I11 D11 J4 I14", ranked_sql("sim"))
def retrieve_similar(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "similarity")


@query("I6 I8 I11 F2", ranked_sql(pue_sql()))
def retrieve_pue(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "pue_full")


@query("I7", ranked_sql(pue_sql(cost=False)))
def retrieve_pue_no_cost(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "pue_no_cost")


@query("I7", ranked_sql(pue_sql(recent=False)))
def retrieve_pue_no_recent(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "pue_no_recent")


@query("I7", ranked_sql(pue_sql("0")))
def retrieve_pue_no_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "pue_no_similarity")


# hashed bag-of-words vectors of both sides
CTES["hskill"] = """
SELECT pos, dim, sum(c) AS c FROM (SELECT pos, (('0x' || substr(md5(token), 1, 8))::BIGINT) % 64 AS dim, c FROM skilltok) GROUP BY ALL"""
CTES["htask"] = """
SELECT task_id, dim, sum(c) AS c FROM (SELECT task_id, (('0x' || substr(md5(token), 1, 8))::BIGINT) % 64 AS dim, c FROM tok_text5) GROUP BY ALL"""
CTES["hsims"] = """
SELECT t.task_id, l.*, coalesce(d.dot / (t.n * s.n), 0) AS sim FROM (SELECT task_id, sqrt(sum(c * c)) AS n FROM htask GROUP BY task_id) t CROSS JOIN lib l
JOIN (SELECT pos, sqrt(sum(c * c)) AS n FROM hskill GROUP BY pos) s USING (pos)
LEFT JOIN (SELECT a.task_id, b.pos, sum(a.c * b.c) AS dot FROM htask a JOIN hskill b USING (dim) GROUP BY ALL) d ON d.task_id = t.task_id AND d.pos = l.pos"""


@query("I5 I10 C9 J1", ranked_sql("sim", "hsims"))
def retrieve_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "embedding_similarity")


@query("I9 I10", ranked_sql(pue_sql(), "hsims"))
def retrieve_embedding_pue(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf, "embedding_pue_full")


def leveled_sql(score: str, sims: str, keys: str) -> str:
    return f"""SELECT {keys}, CASE granularity WHEN 'high' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS level_spot, rank, skill_id, granularity, score
 FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, granularity ORDER BY round(score, 9) DESC, pos) AS rank
 FROM (SELECT *, {score} AS score FROM {sims})) WHERE rank <= CASE granularity WHEN 'high' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END"""


CTES["hits"] = leveled_sql(pue_sql(), "simstate", "task_id, t")


@query("F3 I11 E25", f"SELECT task_id, level_spot, rank, skill_id, {r6('score')} FROM ({leveled_sql(pue_sql(), 'sims5', 'task_id')})")
def retrieve_levels(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.segments(spark, sf)
    found = scoring.retrieve(traces.online_task_texts(segs), library.build(segs).skills, "pue", level_top_k=LEVELS)
    return rounded(found.select("task_id", "level_spot", "rank", "skill_id", "score"))


def step_hits(spark: SparkSession, sf: str, skills: DataFrame | None = None) -> DataFrame:
    steps = fx.steps(spark, sf)
    states = traces.task_states(steps)
    asked = states.select("task_id", "t", traces.state_text(states).alias("text"))
    skills = skills if skills is not None else library.build(traces.segments(steps)).skills
    found = scoring.retrieve(asked, skills, "pue", ["task_id", "t"], level_top_k=LEVELS)
    return found.withColumnRenamed("level", "granularity")


@query("I12 B10 B11", f"SELECT task_id, t, level_spot, rank, skill_id, {r6('score')} FROM hits")
def retrieve_per_step(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(step_hits(spark, sf).select("task_id", "t", "level_spot", "rank", "skill_id", "score"))


@query("I13 E25", f"""SELECT task_id, 'pue' AS retrieval_strategy, (SELECT count(*) FROM heads) AS candidates, sum(n)::BIGINT AS returned, 'high=1,low=3,mid=2' AS limits,
 string_agg(granularity || '=' || n, ',' ORDER BY granularity) AS by_level
 FROM (SELECT task_id, granularity, count(*) AS n FROM ({leveled_sql(pue_sql(), 'sims5', 'task_id')}) GROUP BY ALL) GROUP BY task_id""")
def retrieval_metadata(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.segments(spark, sf)
    skills = library.build(segs).skills
    asked = traces.online_task_texts(segs)
    found = scoring.retrieve(asked, skills, "pue", level_top_k=LEVELS)
    meta = scoring.retrieval_metadata(asked, found, skills, "pue", level_top_k=LEVELS)
    listed = lambda name: F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    entries, limits = listed("returned_by_level"), listed("level_top_k")
    return meta.select("task_id", "retrieval_strategy", F.col("candidate_skill_count").alias("candidates"),
                       F.col("returned_skill_count").alias("returned"), F.concat_ws(",", entries).alias("by_level"), F.concat_ws(",", limits).alias("limits"))


@query("E25", "SELECT granularity AS level, count(*) AS returned FROM hits GROUP BY ALL")
def returned_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.returned_by_level(step_hits(spark, sf).withColumnRenamed("granularity", "level"))


@query("F4", "SELECT skill_id, support FROM lib ORDER BY support DESC, pos LIMIT 5")
def top_by_support(spark: SparkSession, sf: str) -> DataFrame:
    model = library.of(spark, sf)
    skills = model.skills.withColumn("support", F.lit(None).cast("long"))
    return scoring.top_by_support(skills, model.members, 5).select("skill_id", "support")


@query("F5 I13", "SELECT DISTINCT trajectory_id AS task_id, 'none' AS retrieval_strategy, 0 AS candidates, 0 AS returned FROM segs")
def retrieve_none(spark: SparkSession, sf: str) -> DataFrame:
    """The empty retriever returns no skill, and one metadata row per task."""
    tasks = fx.segments(spark, sf).select(F.col("trajectory_id").alias("task_id")).distinct()
    nothing = scoring.no_skills(tasks)
    meta = scoring.retrieval_metadata(tasks, nothing, nothing, "none")
    return meta.select("task_id", "retrieval_strategy", F.col("candidate_skill_count").alias("candidates"), F.col("returned_skill_count").alias("returned"))


@query("I10 I13", """SELECT task_id, 'embedding_pue_full' AS retrieval_strategy, 'embedding' AS similarity_type, 3 AS returned, sum(c)::BIGINT AS tokens
FROM tok_text5 GROUP BY task_id""")
def embedding_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Token usage of embedding retrieval, per task."""
    segs = fx.segments(spark, sf)
    skills = library.build(segs).skills
    asked = checkpoint(embed(traces.online_task_texts(segs), "text"))
    found = scoring.retrieve(asked, skills, "embedding_pue_full")
    meta = scoring.retrieval_metadata(asked, found, skills, "embedding_pue_full", usage=asked)
    return meta.select(
        "task_id", "retrieval_strategy", F.col("retrieval_similarity_type").alias("similarity_type"),
        F.col("returned_skill_count").alias("returned"), F.col("embedding_total_tokens").alias("tokens"))


@query("A2 A4", f"SELECT task_id, t AS step, level_spot, rank, skill_id, granularity, {r6('score')} FROM hits")
def hit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Hits written as a retrieval log, read back, and joined by an absent log, which is an empty table."""
    hits = step_hits(spark, sf)
    one = F.struct("level_spot", "rank", F.struct(
        "skill_id", "granularity", F.struct(F.col("score").alias("retrieval_score"), F.lit("pue").alias("retrieval_strategy")).alias("metadata")).alias("s"))
    log = hits.groupBy("task_id", F.col("t").alias("step")).agg(
        F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("retrieved_skills"))
    folder = f"{checkpoint_dir(spark)}/hits-{uuid.uuid4().hex}"
    records.write_jsonl(log, folder)
    absent = records.read_jsonl_or_empty(spark, f"{folder}-absent", schemas.RETRIEVAL_RECORD).select("task_id", "step")
    back = records.read_hits(spark, folder).join(absent, ["task_id", "step"], "left_anti")
    spots = {"high": 0, "mid": 1, "low": 2}
    spot = F.create_map(*[F.lit(x) for pair in spots.items() for x in pair])[F.col("granularity")]
    return rounded(back.select("task_id", "step", spot.alias("level_spot"), F.col("level_rank").alias("rank"), "skill_id", "granularity", "score"))


@query("A5", """SELECT skill_id, granularity, support, support AS members, support AS document_members, (SELECT count(*) FROM segs) + (SELECT count(*) FROM lib) AS nodes FROM lib""")
def stored_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model written and read back both as tables and as a document in parts."""
    model = library.of(spark, sf)
    folder = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    models.write_model(model, f"{folder}/tables")
    tables = models.read_model(spark, f"{folder}/tables")
    models.write_model_parts(tables, f"{folder}/document")
    document, _ = models.read_model_document(spark, f"{folder}/document", parts=True)
    count = lambda rows, name: rows.groupBy("skill_id").agg(F.count(F.lit(1)).alias(name))
    nodes = document.nodes.agg(F.count(F.lit(1))).scalar()
    return (
        document.skills.select("skill_id", "granularity", "support")
        .join(count(tables.members, "members"), "skill_id").join(count(document.members, "document_members"), "skill_id")
        .withColumn("nodes", nodes)
    )


@query("E19", """SELECT round(avg(n), 6) + 0.0 AS avg_retrieved_skills FROM (SELECT task_id, t, count(*) AS n FROM hits GROUP BY ALL)""")
def average_retrieved(spark: SparkSession, sf: str) -> DataFrame:
    from stridemill.operators.evaluate import average_retrieved as average

    keys = ["task_id", "t"]
    return rounded(average(fx.steps(spark, sf).select(*keys), step_hits(spark, sf), keys))


# selector evaluation: skills from the first 60 % of tasks would move with the split, so the whole library is used
CTES["split"] = """
SELECT *, row_number() OVER (ORDER BY first_ts, task_id) - 1 AS p, round_even((SELECT count(*) FROM tasks) * 0.6, 0)::BIGINT AS cut FROM tasks"""
CTES["future"] = "SELECT * EXCLUDE (p, cut), p - cut AS task_pos FROM split WHERE p >= cut"


def future_tasks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    steps = fx.steps(spark, sf)
    heads = traces.trajectories(steps).join(steps.groupBy("task_id").agg(F.min("ts").alias("first_ts")), "task_id")
    return selectors.split_tasks(heads, 0.4, ["first_ts", "task_id"]), traces.segments(steps)


@query("F9", "SELECT task_id, CASE WHEN p >= cut THEN p - cut ELSE p END AS task_pos, p >= cut AS future FROM split")
def task_split(spark: SparkSession, sf: str) -> DataFrame:
    placed, _ = future_tasks(spark, sf)
    return placed.select("task_id", "task_pos", "future")


CTES["topl"] = """
SELECT pos, kind, v AS feature, c::DOUBLE AS c FROM (SELECT *, row_number() OVER (PARTITION BY skill_id, kind ORDER BY c DESC, f) AS rn FROM (
 SELECT skill_id, label AS v, count(*) AS c, min(m.pos) AS f, 'label' AS kind FROM members m GROUP BY ALL
 UNION ALL SELECT skill_id, template, count(*), min(pos), 'template' FROM members GROUP BY ALL)) JOIN (SELECT skill_id, pos FROM heads) USING (skill_id) WHERE rn <= 5"""
CTES["sfeat"] = """
SELECT pos, kind, feature, c / sqrt(sum(c * c) OVER (PARTITION BY pos, kind)) AS w FROM (SELECT pos, kind, feature, c FROM topl UNION ALL SELECT pos, 'text', token, c FROM skilltok)"""
CTES["tfeat"] = """
SELECT task_id, kind, feature, c / sqrt(sum(c * c) OVER (PARTITION BY task_id, kind)) AS w FROM (
 SELECT trajectory_id AS task_id, 'label' AS kind, label AS feature, count(*)::DOUBLE AS c FROM segs GROUP BY ALL
 UNION ALL SELECT trajectory_id, 'template', template, count(*) FROM segs GROUP BY ALL
 UNION ALL SELECT task_id, 'text', token, c FROM tok_text8) JOIN future USING (task_id)"""


@query("L1", f"SELECT pos, kind, feature, {r6('w')} FROM sfeat")
def skill_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selectors.skill_features(library.of(spark, sf).skills))


@query("L2 B12", f"SELECT task_id, kind, feature, {r6('w')} FROM tfeat")
def task_features(spark: SparkSession, sf: str) -> DataFrame:
    placed, segs = future_tasks(spark, sf)
    return rounded(selectors.task_features(placed.filter("future"), segs))


@query("G5", "SELECT kind, feature FROM sfeat UNION SELECT kind, feature FROM tfeat")
def feature_space(spark: SparkSession, sf: str) -> DataFrame:
    placed, segs = future_tasks(spark, sf)
    return selectors.feature_space(library.build(segs).skills, checkpoint(placed.filter("future")), segs)


CTES["dots"] = """
SELECT a.task_id, b.pos, sum(CASE WHEN kind = 'label' THEN a.w * b.w ELSE 0 END) AS lm, sum(CASE WHEN kind = 'template' THEN a.w * b.w ELSE 0 END) AS tm,
 sum(CASE WHEN kind = 'text' THEN a.w * b.w ELSE 0 END) AS xm FROM tfeat a JOIN sfeat b USING (kind, feature) GROUP BY ALL"""
CTES["cells"] = f"""
SELECT f.task_id, f.task_pos, l.pos, l.skill_id, l.token_cost::DOUBLE AS token_cost, l.* EXCLUDE (pos, skill_id, token_cost), coalesce(lm, 0) AS lm, coalesce(tm, 0) AS tm, coalesce(xm, 0) AS xm,
 round((0.55 * coalesce(lm, 0) + 0.45 * coalesce(tm, 0)) * (0.5 * f.final_reward + 0.35 * f.success::INT + 0.15 * (1 - f.n_steps / (SELECT max(n_steps) FROM future))) - 0.08 * {COST}, 12) AS utility
FROM future f CROSS JOIN lib l LEFT JOIN dots d ON d.task_id = f.task_id AND d.pos = l.pos"""


def offline_pue_sql(sim: str = "xm", cost: bool = True, recent: bool = True) -> str:
    return pue_sql(sim, cost, recent)


SELECTOR_SQL = {
    "frequency": "support", "success_rate": "success_rate", "similarity": "xm", "recent_reward_lift": "recent_reward_lift",
    "pue_no_cost": offline_pue_sql(cost=False), "pue_no_recent": offline_pue_sql(recent=False),
    "pue_no_similarity": offline_pue_sql("0"), "pue_full": offline_pue_sql(),
}
CTES["scored"] = " UNION ALL ".join(
    f"SELECT '{name}' AS selector, task_id, task_pos, pos, skill_id, token_cost, utility, round(({score})::DOUBLE, 12) AS score FROM cells"
    for name, score in SELECTOR_SQL.items())


def grid(spark: SparkSession, sf: str) -> DataFrame:
    placed, segs = future_tasks(spark, sf)
    segs = checkpoint(segs)
    return selectors.match_grid(checkpoint(placed.filter("future")), library.build(segs).skills, segs)


@query("L3 D10 D11", f"SELECT task_pos, pos, {r6('lm', 'label_match')}, {r6('tm', 'template_match')}, {r6('xm', 'text_match')}, {r6('utility')} FROM cells")
def utility_grid(spark: SparkSession, sf: str) -> DataFrame:
    cells = grid(spark, sf)
    return rounded(cells.select("task_pos", "pos", "label_match", "template_match", "text_match", selectors.future_utility().alias("utility")))


@query("L4 L5", f"SELECT selector, task_pos, pos, {r6('score')}, {r6('utility')} FROM scored")
def selector_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selectors.selector_scores(grid(spark, sf)).select("selector", "task_pos", "pos", "score", "utility"))


def metrics_sql(keys: str, source: str) -> str:
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score, pos, task_pos) AS rs, row_number() OVER (PARTITION BY {keys} ORDER BY utility, pos, task_pos) AS ru FROM {source}),
corrs AS (SELECT {keys}, CASE WHEN min(score) = max(score) OR min(utility) = max(utility) THEN 0 ELSE covar_pop(score, utility) / sqrt(var_pop(score) * var_pop(utility)) END AS pearson,
  covar_pop(rs, ru) / sqrt(var_pop(rs) * var_pop(ru)) AS spearman, count(CASE WHEN utility > 0 THEN 1 END)::DOUBLE AS np, count(CASE WHEN utility <= 0 THEN 1 END)::DOUBLE AS nn,
  sum(CASE WHEN utility > 0 THEN rs END)::DOUBLE AS rsum FROM r GROUP BY {keys}),
mine AS (SELECT {keys}, task_pos AS tp, avg(utility) AS u, avg(token_cost) AS c FROM (SELECT *, row_number() OVER (PARTITION BY selector, task_pos ORDER BY score DESC, pos) AS k FROM {source}) WHERE k <= 3 GROUP BY ALL),
orac AS (SELECT {keys}, task_pos AS tp, avg(utility) AS o FROM (SELECT *, row_number() OVER (PARTITION BY selector, task_pos ORDER BY utility DESC, pos) AS k FROM {source}) WHERE k <= 3 GROUP BY ALL),
sel AS (SELECT {keys}, avg(u) AS su, avg(o) AS ou, avg(o - u) AS regret, avg((u > 0)::INT) AS pr, avg(c) AS cost, min(tp) AS t0, max(tp) + 1 AS t1 FROM mine JOIN orac USING ({keys}, tp) GROUP BY {keys})
SELECT {keys}, {r6('pearson', 'future_utility_pearson')}, {r6('spearman', 'future_utility_spearman')}, {r6('CASE WHEN np = 0 OR nn = 0 THEN 0 ELSE (rsum - np * (np + 1) / 2) / (np * nn) END', 'positive_utility_auc')},
 {r6('su', 'avg_selected_utility')}, {r6('ou', 'avg_oracle_utility')}, {r6('regret')}, {r6('pr', 'positive_selection_rate')}, {r6('cost', 'avg_selected_token_cost')}"""


@query("L6 L7 L8 L9 F6 F7", metrics_sql("selector", "scored") + " FROM corrs JOIN sel USING (selector)")
def selector_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selectors.selector_metrics(selectors.selector_scores(selectors.stored_cells(grid(spark, sf)))))


CTES["batched"] = "SELECT *, task_pos // 200 AS batch_index FROM scored"


@query("L10 F8", metrics_sql("selector, batch_index", "batched") + ", t0 AS task_start, t1 AS task_end, t1 - t0 AS task_count FROM corrs JOIN sel USING (selector, batch_index)")
def selector_batches(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selectors.batch_metrics(selectors.selector_scores(selectors.stored_cells(grid(spark, sf), 200)), 200))


@query("F11", f"""SELECT task_id, selector, rank, skill_id, {r6('score')}, {r6('utility')} FROM (SELECT *, row_number() OVER (PARTITION BY selector, task_pos ORDER BY score DESC, pos) AS rank FROM scored) WHERE rank <= 3""")
def selector_choices(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selectors.choice_listing(selectors.selector_scores(grid(spark, sf))))


@query("L11 F9")
def selector_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Library from the training tasks, metrics on the future ones."""
    from stridemill.plans.evaluation import evaluate_selectors

    placed, segs = future_tasks(spark, sf)
    return evaluate_selectors(placed, segs, library.build).metrics
