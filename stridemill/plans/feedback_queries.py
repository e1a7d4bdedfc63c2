"""Queries on refinement from deployment feedback and on imported libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.operators import external, refine, traces
from stridemill.plans import fixtures as fx
from stridemill.plans import library
from stridemill.plans.oracle import COST, CTES, stats_sql
from stridemill.plans.registry import query, r6, rounded
from stridemill.plans.retrieval_queries import step_hits
from stridemill.plans.skill_queries import STATS
from stridemill.scale import checkpoint

# thresholds that make every action occur on these tables
OPTIONS = refine.RefineOptions(split_variance_threshold=0.16, promote_threshold=0.18, prune_threshold=0.14)
RECORD = ["task_id", "t"]
FLOATS = [c for c in STATS if c not in ("support", "trajectory_count", "token_cost")]
STATS6 = "support, trajectory_count, " + ", ".join(r6(c) for c in FLOATS)
MEASURED = ["support", "trajectory_count", *FLOATS]

CTES["outcomes"] = "SELECT task_id, success::INT::DOUBLE AS success, final_reward AS reward, 1 - n_steps / (SELECT max(n_steps) FROM tasks) AS step_save FROM tasks"
CTES["usage"] = "SELECT DISTINCT h.task_id, h.skill_id, o.success, o.reward, o.step_save FROM hits h JOIN outcomes o USING (task_id)"
CTES["used"] = f"""
SELECT l.skill_id, l.pos, l.granularity, coalesce(n, 0) AS deployment_usage_count, coalesce(0.45 * s + 0.35 * r + 0.15 * ss - 0.05 * {COST}, 0) AS deployment_utility, var
FROM lib l LEFT JOIN (SELECT skill_id, count(*) AS n, avg(success) AS s, avg(reward) AS r, avg(step_save) AS ss, var_pop(success) AS var FROM usage GROUP BY skill_id) USING (skill_id)"""
CTES["acted"] = """
SELECT *, CASE WHEN deployment_usage_count = 0 THEN 'unobserved' WHEN deployment_utility < 0.14 THEN 'downweight' WHEN deployment_usage_count >= 3 AND var >= 0.16 THEN 'split_candidate'
 WHEN granularity = 'mid' AND deployment_utility >= 0.18 THEN 'promote_candidate' ELSE 'stable' END AS refinement_action FROM used"""
CTES["weighted"] = """
SELECT *, CASE refinement_action WHEN 'unobserved' THEN 1.0 WHEN 'downweight' THEN 0.25 WHEN 'split_candidate' THEN least(0.5, greatest(0.5, least(2.0, 1 + deployment_utility)))
 ELSE greatest(0.5, least(2.0, 1 + deployment_utility)) END AS deployment_weight FROM acted"""


def scored(spark: SparkSession, sf: str):
    model = library.of(spark, sf, wide=True)
    tasks = traces.trajectories(fx.steps(spark, sf))
    hits = checkpoint(step_hits(spark, sf, model.skills).select("task_id", "t", "skill_id", "granularity"))
    usage = refine.skill_usage(hits, refine.task_outcomes(tasks))
    return model, hits, checkpoint(refine.score_skills(model.skills, usage, OPTIONS))


@query("E12", f"SELECT task_id, success, {r6('reward')}, {r6('step_save')} FROM outcomes")
def outcome_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(refine.task_outcomes(traces.trajectories(fx.steps(spark, sf))))


@query("D5", f"SELECT task_id, skill_id, success, {r6('reward')}, {r6('step_save')} FROM usage")
def skill_usage(spark: SparkSession, sf: str) -> DataFrame:
    tasks = traces.trajectories(fx.steps(spark, sf))
    return rounded(refine.skill_usage(step_hits(spark, sf), refine.task_outcomes(tasks)))


@query("D4 E14 K2 K3", f"SELECT skill_id, deployment_usage_count, {r6('deployment_utility')}, {r6('deployment_weight')}, refinement_action FROM weighted")
def scored_skills(spark: SparkSession, sf: str) -> DataFrame:
    _, _, rows = scored(spark, sf)
    return rounded(rows.select("skill_id", "deployment_usage_count", "deployment_utility", "deployment_weight", "refinement_action"))


@query("E26 K4", "SELECT refinement_action, count(*) AS skills, count(CASE WHEN refinement_action <> 'downweight' THEN 1 END) AS kept FROM weighted GROUP BY ALL")
def refinement_actions(spark: SparkSession, sf: str) -> DataFrame:
    _, _, rows = scored(spark, sf)
    pruned = refine.prune(rows, refine.RefineOptions(prune_downweighted=True)).groupBy("refinement_action").agg(F.count(F.lit(1)).alias("kept"))
    return refine.action_counts(rows).join(pruned, "refinement_action", "left").select("refinement_action", "skills", F.coalesce("kept", F.lit(0)).alias("kept"))


CTES["bits"] = "SELECT unnest(range(1, (1 << (SELECT greatest(2, max(c)) FROM (SELECT count(DISTINCT action) AS c FROM steps GROUP BY task_id)))::BIGINT)) AS mask"
CTES["midsets"] = """
SELECT mids, count(*) AS count FROM (SELECT list_filter(s.list, lambda x, i: (b.mask >> (i - 1)) & 1 = 1) AS mids FROM (
 SELECT task_id, t, list_sort(list(DISTINCT skill_id)) AS list FROM hits WHERE granularity = 'mid' GROUP BY ALL) s JOIN bits b ON b.mask < (1 << len(s.list)) AND bit_count(b.mask) >= 2) GROUP BY ALL"""


@query("E13", "SELECT array_to_string(mids, '|') AS mids, count FROM midsets")
def mid_co_usage(spark: SparkSession, sf: str) -> DataFrame:
    return refine.mid_co_usage(step_hits(spark, sf), RECORD).select(F.concat_ws("|", "mids").alias("mids"), "count")


@query("E13", """WITH s AS (SELECT task_id, list_sort(list(DISTINCT action)) AS l FROM steps GROUP BY task_id HAVING count(DISTINCT action) >= 2),
m AS (SELECT list_filter(s.l, lambda x, i: (b.mask >> (i - 1)) & 1 = 1) AS mids FROM s JOIN bits b ON b.mask < (1 << len(s.l)) AND bit_count(b.mask) >= 2)
SELECT array_to_string(mids, '|') AS mids, count(*) AS count FROM m GROUP BY ALL""")
def action_co_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Co-usage on larger sets: the distinct actions of a task."""
    used = fx.steps(spark, sf).select("task_id", F.col("action").alias("skill_id"), F.lit("mid").alias("granularity"))
    return refine.mid_co_usage(used, ["task_id"]).select(F.concat_ws("|", "mids").alias("mids"), "count")


CTES["splits"] = """
SELECT m.skill_id || '_split_' || CASE WHEN m.success THEN 'success' ELSE 'failure' END AS skill_id, m.* EXCLUDE (skill_id)
FROM members m JOIN (SELECT skill_id FROM weighted WHERE refinement_action = 'split_candidate') USING (skill_id)"""


@query("K5", f"SELECT skill_id, {STATS6} FROM ({stats_sql('splits')})")
def split_children(spark: SparkSession, sf: str) -> DataFrame:
    model, _, rows = scored(spark, sf)
    children, _, _ = refine.split_skills(rows, model.members, fx.segments(spark, sf), OPTIONS)
    return rounded(children.select("skill_id", *MEASURED))


@query("K5 G2", """SELECT skill_id || '_split_' || side AS source, skill_id AS target, 'split_from' AS relation, 1.0::DOUBLE AS weight
FROM weighted, (SELECT unnest(['success', 'failure']) AS side) WHERE refinement_action = 'split_candidate'
UNION ALL SELECT printf('tower_high_%03d', c // 2), printf('tower_mid_%03d', c), 'contains_mid_skill', 1.0 FROM (SELECT DISTINCT cluster AS c FROM clustered)""")
def refined_edges(spark: SparkSession, sf: str) -> DataFrame:
    model, _, rows = scored(spark, sf)
    edges = refine.split_edges(rows, model.members, fx.segments(spark, sf), OPTIONS)
    return model.edges.select("source", "target", "relation", "weight").unionByName(edges)


@query("D8 K6 K7", """WITH RECURSIVE l AS (SELECT src AS a, dst AS b FROM gsim s JOIN gseg x ON x.pos = s.src JOIN gseg y ON y.pos = s.dst WHERE sim >= 0.4 AND x.grp % 2 = y.grp % 2),
walk AS (SELECT DISTINCT a AS id, a AS component FROM l UNION SELECT l.b, w.component FROM walk w JOIN l ON l.a = w.id WHERE w.component < l.b),
c AS (SELECT id, min(component) AS component FROM walk GROUP BY id)
SELECT id AS pos, component, dense_rank() OVER (ORDER BY component) - 1 AS merge_index FROM c""")
def merge_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.graph_segments(spark, sf).select("pos", (F.col("group") % 2).cast("string").alias("granularity"), "vector")
    return refine.merge_components(rows, 0.4)


CTES["mmem"] = """
SELECT cluster // 2 AS mi, segment_id, trajectory_id, label, template, success, final_reward, step_reward, {'a': cluster, 'b': pos} AS pos FROM clustered"""


@query("K8 G6 G3", f"SELECT printf('tower_refined_merge_%03d', mi) AS skill_id, {STATS6} FROM ({stats_sql('mmem', 'mi')})")
def merged_skills(spark: SparkSession, sf: str) -> DataFrame:
    model = library.of(spark, sf, wide=True)
    mids = model.skills.filter("granularity = 'mid'")
    spot = F.substring("skill_id", -3, 3).cast("long")
    groups = checkpoint(mids.select("pos", F.floor(spot / 2).alias("component"), F.floor(spot / 2).alias("merge_index")))
    built, _, _ = refine.merged_skills(model.skills, groups, model.members, fx.segments(spark, sf))
    final = refine.replace_merged(model.skills, groups, built.select(*model.skills.columns))
    return rounded(final.filter("refinement_action = 'merged'").select("skill_id", *MEASURED))


CTES["cand"] = """
SELECT mids, count, idx, avg(deployment_utility) AS u, count(*) AS kids FROM (SELECT *, row_number() OVER (ORDER BY mids) - 1 AS idx FROM midsets) s
 JOIN (SELECT skill_id, deployment_utility FROM weighted WHERE granularity = 'mid') w ON list_contains(s.mids, w.skill_id) WHERE count >= 2 GROUP BY ALL HAVING count(*) >= 2 AND avg(deployment_utility) >= 0.18"""
CTES["highs"] = """
SELECT skill_id AS high_id, [printf('tower_mid_%03d', 2 * h), printf('tower_mid_%03d', 2 * h + 1)] AS mids FROM (SELECT skill_id, right(skill_id, 3)::INT AS h FROM heads WHERE granularity = 'high')"""


@query("K9 D12", f"""SELECT coalesce(high_id, printf('tower_refined_high_%03d', idx)) AS source, unnest(mids) AS target,
 CASE WHEN high_id IS NULL THEN 'promotes_mid_skill' ELSE 'reinforced_by_deployment' END AS relation, count::DOUBLE AS weight, {r6('u', 'utility')} FROM cand LEFT JOIN highs USING (mids)""")
def promotions(spark: SparkSession, sf: str) -> DataFrame:
    model, hits, rows = scored(spark, sf)
    qualified = refine.promotion_candidates(rows, refine.used_sets(hits, RECORD, OPTIONS), OPTIONS)
    name = F.coalesce("high_id", refine.promoted_id())
    relation = F.when(F.col("high_id").isNull(), "promotes_mid_skill").otherwise("reinforced_by_deployment")
    return rounded(qualified.select(
        name.alias("source"), F.explode("mids").alias("target"), relation.alias("relation"),
        F.col("count").cast("double").alias("weight"), F.col("avg_utility").alias("utility")))


CTES["pmem"] = """
SELECT idx, segment_id, trajectory_id, label, template, success, final_reward, step_reward, {'a': list_position(mids, printf('tower_mid_%03d', cluster)), 'b': pos} AS pos
FROM cand LEFT JOIN highs USING (mids) JOIN clustered ON list_contains(mids, printf('tower_mid_%03d', cluster)) WHERE high_id IS NULL"""


@query("K9", f"SELECT printf('tower_refined_high_%03d', idx) AS skill_id, {STATS6} FROM ({stats_sql('pmem', 'idx')})")
def promoted_skills(spark: SparkSession, sf: str) -> DataFrame:
    model, hits, rows = scored(spark, sf)
    promoted, _, _, _ = refine.promote(rows, refine.used_sets(hits, RECORD, OPTIONS), model.members, fx.segments(spark, sf), OPTIONS)
    return rounded(promoted.select("skill_id", *MEASURED))


@query("K10 D12", f"""SELECT w.skill_id, {r6("CASE WHEN c.u IS NULL THEN w.deployment_utility ELSE greatest(w.deployment_utility, c.u) END", 'deployment_utility')},
 {r6("CASE WHEN c.u IS NULL THEN w.deployment_weight ELSE greatest(w.deployment_weight, 1 + c.u) END", 'deployment_weight')}, CASE WHEN c.u IS NULL THEN w.refinement_action ELSE 'reinforced_high' END AS refinement_action
FROM weighted w LEFT JOIN (SELECT high_id AS skill_id, u FROM cand JOIN highs USING (mids)) c USING (skill_id)""")
def reinforced_skills(spark: SparkSession, sf: str) -> DataFrame:
    model, hits, rows = scored(spark, sf)
    _, reinforced, _, _ = refine.promote(rows, refine.used_sets(hits, RECORD, OPTIONS), model.members, fx.segments(spark, sf), OPTIONS)
    return rounded(reinforced.select("skill_id", "deployment_utility", "deployment_weight", "refinement_action"))


@query("G4 D9 B24", """SELECT segment_id AS node_id, 'segment' AS node_type, false AS historical FROM segs
UNION ALL SELECT skill_id, 'skill', granularity = 'low' FROM heads""")
def refined_nodes(spark: SparkSession, sf: str) -> DataFrame:
    model = library.of(spark, sf)
    kept = model.skills.filter("granularity <> 'low'")
    return refine.refined_nodes(model.nodes, kept).select("node_id", "node_type", "historical")


@query("K1 K11 G2 G4 E27")
def refined_library(spark: SparkSession, sf: str) -> DataFrame:
    segs = checkpoint(fx.segments(spark, sf))
    tasks = traces.trajectories(fx.steps(spark, sf))
    model = library.build(segs).stored()
    hits = step_hits(spark, sf, model.skills)
    settings = {"split_variance_threshold": 0.16, "promote_threshold": 0.18, "prune_threshold": 0.14}
    refined = refine.refine_library(model, segs, tasks, hits, RECORD, refine.RefineOptions.from_dict(settings))
    return refined.skills.select("skill_id", "pos", "granularity", "support", "deployment_utility", "deployment_weight", "refinement_action")


CTES["lsrc"] = """
SELECT 'planned_planning_' || printf('%03d', row_number() OVER (ORDER BY goal) - 1) AS key, 0 AS spot, goal AS source FROM (SELECT DISTINCT goal FROM segs)
UNION ALL SELECT 'planned_functional_' || printf('%03d', u), 0, 'goal ' || u FROM (SELECT DISTINCT user_id % 20 AS u FROM events)
UNION ALL SELECT 'planned_functional_' || printf('%03d', u), 1, task FROM (SELECT user_id % 20 AS u, min('u' || user_id || '_' || strftime(ts, '%Y-%m-%d')) AS task FROM events GROUP BY ALL)
UNION ALL SELECT 'planned_functional_' || printf('%03d', u), 2, 'goal ' || (u + 1) FROM (SELECT DISTINCT user_id % 20 AS u FROM events)"""
CTES["lmem"] = """
SELECT key, segment_id, min({'a': spot, 'b': b, 'c': pos}) AS pos, any_value(trajectory_id) AS trajectory_id, any_value(success) AS success, any_value(final_reward) AS final_reward, any_value(step_reward) AS step_reward FROM (
 SELECT l.key, l.spot, 0 AS b, s.* FROM lsrc l JOIN segs s ON s.trajectory_id = l.source UNION ALL SELECT l.key, l.spot, 1, s.* FROM lsrc l JOIN segs s ON s.goal = l.source) GROUP BY key, segment_id"""


def planned_library(spark: SparkSession, sf: str):
    segs = fx.segments(spark, sf)
    planning = segs.groupBy(F.col("goal").alias("task")).agg(F.min("action").alias("plan"))
    u = F.col("user_id") % 20
    ts = F.col("ts").cast("timestamp")
    task = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_"), F.date_format(ts, "yyyy-MM-dd"))
    items = fx.table(spark, sf, "events").groupBy(u.alias("index")).agg(F.min(task).alias("task")).select(
        F.lit("functional").alias("granularity"), "index", F.lit("").alias("name"), F.lit("Reads pages.").alias("document"),
        F.lit(None).cast("string").alias("content"), F.array(F.lit("open"), F.lit("click")).alias("tools"),
        F.array(F.format_string("goal %d", "index"), "task", F.format_string("goal %d", F.col("index") + 1)).alias("source_tasks"))
    return external.import_planned_library(planning, items, segs)


@query("N1 D7 E1", f"SELECT key AS skill_id, {STATS6} FROM ({stats_sql('lmem', 'key')})")
def planned_import(spark: SparkSession, sf: str) -> DataFrame:
    skills, _ = planned_library(spark, sf)
    return rounded(skills.select("skill_id", *MEASURED))


CTES["fitems"] = """
SELECT dense_rank() OVER (ORDER BY lang, source) - 1 AS i, lang, source, count(*) AS n, min(doc_id) AS d FROM documents GROUP BY lang, source"""


@query("N2 B23", """WITH t AS (SELECT 'flat_' || printf('%03d', i) AS skill_id, 'Flat Skill ' || i AS name, 'Docs of ' || lang || chr(10) || source || chr(10) || 'References:' || chr(10) || '- ' || source || ': seen ' || n || chr(10) || '- item: first ' || d AS content, 'goal ' || (i % 20) AS g FROM fitems)
SELECT skill_id, name, content, (SELECT count(*) FROM segs WHERE goal = g) AS support, len(regexp_extract_all(lower(content), '[a-z0-9]+')) AS token_cost FROM t""")
def flat_import(spark: SparkSession, sf: str) -> DataFrame:
    from stridemill.scale import global_rank

    docs = fx.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("d"))
    ranked = global_rank(docs, [F.col("lang"), F.col("source")], "index")
    none = F.lit(None).cast("string")

    def block(name, content):
        return F.struct(name.alias("name"), none.alias("path"), none.alias("title"), content.alias("content"), none.alias("body"))

    blocks = F.array(block(F.col("source"), F.concat(F.lit("seen "), F.col("n").cast("string"))),
                     block(none, F.concat(F.lit("first "), F.col("d").cast("string"))))
    items = ranked.select(
        "index", F.lit("").alias("name"), F.concat(F.lit("Docs of "), "lang").alias("description"), F.col("source").alias("body"),
        blocks.alias("references"), F.filter(blocks, lambda b: F.lit(False)).alias("scripts"),
        F.array(F.format_string("goal %d", F.col("index") % 20)).alias("source_trajectories"))
    skills, _ = external.import_flat_library(items, fx.segments(spark, sf))
    return skills.select("skill_id", "name", "content", "support", "token_cost")


@query("N3", "SELECT 'planned' AS method, true AS imported, 'library.json' AS official_output_path, count(DISTINCT key) AS skill_count FROM lsrc")
def import_provenance(spark: SparkSession, sf: str) -> DataFrame:
    skills, _ = planned_library(spark, sf)
    return external.library_metadata(skills, "planned", "library.json")
