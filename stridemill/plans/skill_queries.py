"""Queries on skills, the tower and the segment graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.functions import text as tx
from stridemill.operators import graph, neighbours, skills, spectral, tower
from stridemill.operators.components import connected_components
from stridemill.operators.traces import step_pairs
from stridemill.plans import fixtures as fx
from stridemill.plans import library, mining
from stridemill.plans.registry import query, r6, rounded
from stridemill.scale import checkpoint, checkpoint_alone

STATS = ["support", "coverage", "success_rate", "failure_rate", "avg_reward", "avg_step_reward", "recent_success_rate",
         "recent_reward_lift", "trajectory_count", "token_cost"]
STATS_SQL = ", ".join(r6(c) if c not in ("support", "trajectory_count", "token_cost") else c for c in STATS)


@query("E6 E1 E2 F12", f"SELECT skill_id, pos, name, content, {STATS_SQL} FROM lib WHERE granularity = 'low'")
def low_skills(spark: SparkSession, sf: str) -> DataFrame:
    low, _ = tower.low_skills(fx.segments(spark, sf))
    return rounded(low.select("skill_id", "pos", "name", "content", *STATS))


@query("E1 E2 G1 H19", f"SELECT skill_id, pos, granularity, {STATS_SQL} FROM lib")
def library_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(library.of(spark, sf).skills.select("skill_id", "pos", "granularity", *STATS))


@query("E3 C6 C7", """WITH c AS (SELECT skill_id, label AS v, count(*) AS c, min(pos) AS f, 'labels' AS kind FROM members GROUP BY ALL
UNION ALL SELECT skill_id, template, count(*), min(pos), 'action_templates' FROM members GROUP BY ALL)
SELECT skill_id, kind, string_agg(v || ' (' || c || ')', ', ' ORDER BY rn) AS counter FROM (SELECT *, row_number() OVER (PARTITION BY skill_id, kind ORDER BY c DESC, f) AS rn FROM c)
WHERE rn <= 5 GROUP BY ALL""")
def skill_counters(spark: SparkSession, sf: str) -> DataFrame:
    s = library.of(spark, sf).skills
    both = F.array(*[F.struct(F.lit(c).alias("kind"), tx.counter_text(F.col(c)).alias("counter")) for c in ("labels", "action_templates")])
    return s.select("skill_id", F.inline(both))


@query("E4")
def default_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    rows = library.clustered(fx.segments(spark, sf)).withColumn("key", F.col("cluster"))
    heads = library.mid_heads(rows).withColumn("content", F.lit(""))
    return skills.build_skills(rows, heads, tower.segment_total(rows), tower.METHOD).select("skill_id", "content", "token_cost")


@query("D6", "SELECT skill_id, segment_id, pos FROM members")
def skill_members(spark: SparkSession, sf: str) -> DataFrame:
    return library.of(spark, sf).members


@query("G3", """SELECT parity AS key, segment_id, first AS pos FROM (SELECT right(skill_id, 1)::INT % 2 AS parity, segment_id, min(pos) AS first FROM members GROUP BY ALL)""")
def unique_members(spark: SparkSession, sf: str) -> DataFrame:
    bridge = library.of(spark, sf).members
    keyed = bridge.select((F.substring("skill_id", -1, 1).cast("long") % 2).alias("key"), "segment_id", "pos", "skill_id")
    return skills.unique_members(keyed, "key", ["skill_id", "pos"]).select("key", "segment_id", "pos")


@query("E5 D3", f"SELECT label, template, {r6('avg(success::INT)', 'tendency')} FROM segs GROUP BY ALL")
def outcome_tendency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.outcome_tendency(fx.segments(spark, sf)))


CROSS = """WITH x AS (SELECT cluster AS key, next_label AS v, pos AS i, next_pos AS o FROM pairs WHERE cluster <> next_cluster
 UNION ALL SELECT next_cluster, label, next_pos, pos FROM pairs WHERE cluster <> next_cluster),
c AS (SELECT key, v, count(*) AS c, min({'a': i, 'b': o}) AS fo, min({'a': o, 'b': i}) AS fi FROM x GROUP BY ALL)"""


@query("E8 C7", CROSS + """
SELECT key, i.t AS incoming, o.t AS outgoing FROM
 (SELECT key, string_agg(v || ' (' || c || ')', ', ' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, fi) AS rn FROM c) WHERE rn <= 5 GROUP BY key) i
 JOIN (SELECT key, string_agg(v || ' (' || c || ')', ', ' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, fo) AS rn FROM c) WHERE rn <= 5 GROUP BY key) o USING (key)""")
def transition_context(spark: SparkSession, sf: str) -> DataFrame:
    pairs = step_pairs(library.clustered(fx.segments(spark, sf)), ["pos", "label", "cluster"])
    context = tower.transition_context(pairs)
    return context.select("key", tx.counter_text(F.col("incoming")).alias("incoming"), tx.counter_text(F.col("outgoing")).alias("outgoing"))


@query("E8", """SELECT cluster AS key, 'outgoing' AS direction, next_label AS label, count(*) AS count FROM pairs WHERE cluster <> next_cluster GROUP BY ALL
UNION ALL SELECT next_cluster, 'incoming', label, count(*) FROM pairs WHERE cluster <> next_cluster GROUP BY ALL""")
def directed_context(spark: SparkSession, sf: str) -> DataFrame:
    return tower.directed_context(step_pairs(library.clustered(fx.segments(spark, sf)), ["pos", "label", "cluster"]))


@query("E9", "SELECT cluster AS source, next_cluster AS target, count(*)::DOUBLE AS weight FROM pairs WHERE cluster <> next_cluster GROUP BY ALL")
def mid_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return tower.mid_transitions(library.clustered(fx.segments(spark, sf))).select("source", "target", "weight")


@query("E11", f"""WITH w AS (SELECT cluster // 2 AS community, cluster AS s, next_cluster AS d, count(*) AS w, min(pos) AS f FROM pairs
 WHERE cluster <> next_cluster AND cluster // 2 = next_cluster // 2 GROUP BY ALL)
SELECT c.community, coalesce(p.path, '{tower.NO_PATH}') AS path FROM (SELECT DISTINCT cluster // 2 AS community FROM clustered) c LEFT JOIN
 (SELECT community, string_agg(s || ':' || d, ' -> ' ORDER BY rn) AS path FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY w DESC, s, f) AS rn FROM w) WHERE rn <= 6 GROUP BY community) p USING (community)""")
def path_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = library.clustered(fx.segments(spark, sf))
    return tower.path_texts(tower.mid_transitions(rows), library.groups(spark))


@query("H19 E10", f"SELECT cluster // 2 AS community, count(*) AS segments, {r6('avg(success::INT)', 'success_rate')} FROM clustered GROUP BY ALL")
def community_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = tower.community_segments(library.clustered(fx.segments(spark, sf)), library.groups(spark))
    return rounded(rows.groupBy("community").agg(
        F.count(F.lit(1)).alias("segments"), F.avg(F.col("success").cast("double")).alias("success_rate")))


@query("H20", """SELECT printf('tower_high_%03d', c // 2) AS source, printf('tower_mid_%03d', c) AS target, 'contains_mid_skill' AS relation, 1.0::DOUBLE AS weight
FROM (SELECT DISTINCT cluster AS c FROM clustered)""")
def hierarchy_edges(spark: SparkSession, sf: str) -> DataFrame:
    return library.of(spark, sf).edges.select("source", "target", "relation", "weight")


@query("H9", """SELECT segment_id AS node_id, 'segment' AS node_type, label, text FROM segs
UNION ALL SELECT skill_id, 'skill', name, content FROM heads""")
def model_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return library.of(spark, sf).nodes.select("node_id", "node_type", "label", "text")


@query("H22 H23", "SELECT 'no_skill' AS method, 0 AS skill_count, count(*) AS segment_count FROM segs")
def no_skill_model(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.segments(spark, sf)
    control = mining.mine_nothing(segs)
    return control.skills.agg(F.count(F.lit(1)).alias("skill_count")).select(
        F.lit(control.method).alias("method"), "skill_count", F.lit(control.meta["segment_count"]).cast("long").alias("segment_count"))


@query("E7", f"SELECT grp AS cluster, dim - 1 AS dim, {r6('avg(v[dim])', 'value')} FROM gseg, (SELECT unnest(range(1, 65)) AS dim) GROUP BY ALL")
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.graph_segments(spark, sf).select(F.col("group").cast("long").alias("cluster"), F.col("vector").alias("v"))
    return rounded(tower.centroids(rows))


@query("D1 F1", f"SELECT src, dst, {r6('sim')} FROM gtop")
def nearest_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.graph_segments(spark, sf)
    return rounded(neighbours.nearest(rows.select(F.col("pos").alias("id"), "vector"), 8))


@query("H2", "SELECT src, dst, 1.0::DOUBLE AS transition FROM (SELECT src, dst FROM gnext UNION ALL SELECT dst, src FROM gnext)")
def transition_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.transition_edges(fx.graph_segments(spark, sf))


@query("H1 H3 H4 H8 F1", f"SELECT src, dst, {r6('semantic')}, {r6('transition')}, {r6('outcome')}, {r6('weight')} FROM gedges WHERE weight > 1e-9")
def affinity_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.affinity_edges(fx.graph_segments(spark, sf)).filter(F.col("weight") > graph.MIN_WEIGHT)
    return rounded(edges.select("src", "dst", "semantic", "transition", "outcome", "weight"))


@query("H5 H6 H7 H8 H10", f"""SELECT src::VARCHAR AS source, dst::VARCHAR AS target, {r6('weight')}, {r6('contrastive', 'contrastive_weight')}, {r6('greatest(0, contrastive)', 'positive')},
 src_success AND dst_success AS success_side, NOT src_success AND NOT dst_success AS failure_side FROM gcon""")
def contrastive_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.contrastive_edges(graph.affinity_edges(fx.graph_segments(spark, sf)), 0.65)
    both = e.withColumn("success_side", F.col("src_success") & F.col("dst_success")).withColumn(
        "failure_side", ~F.col("src_success") & ~F.col("dst_success"))
    return rounded(both.select(
        F.col("src_id").alias("source"), F.col("dst_id").alias("target"), "weight", F.col("contrastive").alias("contrastive_weight"),
        "positive", "success_side", "failure_side"))


LAPLACIAN = """WITH e AS (SELECT src, dst, w FROM (SELECT src, dst, contrastive AS w FROM {edges}) WHERE w <> 0), b AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e),
deg AS (SELECT src, greatest(sum(abs(w)), 1e-12) AS d FROM b GROUP BY src)
SELECT b.src, b.dst, round(-w / sqrt(p.d * q.d), 6) + 0.0 AS value FROM b JOIN deg p ON p.src = b.src JOIN deg q ON q.src = b.dst
UNION ALL SELECT pos, pos, CASE WHEN pos IN (SELECT src FROM deg) THEN 1.0 ELSE {lone} END FROM gseg"""


@query("H11", LAPLACIAN.format(edges="gcon", lone="1.0"))
def signed_laplacian(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.graph_segments(spark, sf)
    return rounded(graph.signed_laplacian(segs, checkpoint(graph.contrastive_edges(graph.affinity_edges(segs), 0.65))))


@query("H12", LAPLACIAN.format(edges="(SELECT src, dst, greatest(0, contrastive) AS contrastive FROM gcon)", lone="0.0"))
def unsigned_laplacian(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.graph_segments(spark, sf)
    return rounded(graph.signed_laplacian(segs, checkpoint(graph.contrastive_edges(graph.affinity_edges(segs), 0.0))))


@query("H13 H14 H15 H16 F10")
def spectral_clusters(spark: SparkSession, sf: str) -> DataFrame:
    segs = fx.graph_segments(spark, sf)
    edges = checkpoint_alone(lambda: graph.contrastive_edges(graph.affinity_edges(segs), 0.65))
    found = spectral.spectral_clusters(segs, edges)
    return found.embedding.select(
        F.col("node").alias("pos"), "cluster", F.lit(found.residual).alias("residual"),
        F.lit(found.spectrum_converged and found.clusters_converged).alias("converged"))


@query("H21 H17 H18 E7 E8 E10 E11 G1 H9 H20 J2 J3")
def mined_tower(spark: SparkSession, sf: str) -> DataFrame:
    model = mining.miner("tower")(fx.graph_segments(spark, sf))
    return model.skills.select("skill_id", "granularity", "support", "success_rate", "avg_reward", F.concat_ws(",", "child_skill_ids").alias("children"))


@query("K7", """WITH RECURSIVE l AS (SELECT event_id AS a, event_id + 150 AS b FROM events WHERE event_id + 150 IN (SELECT event_id FROM events)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), walk AS (SELECT DISTINCT a AS id, a AS component FROM u
 UNION SELECT u.b, w.component FROM walk w JOIN u ON u.a = w.id WHERE w.component < u.b)
SELECT id, min(component) AS component FROM walk GROUP BY id""")
def linked_components(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events")
    ids = e.select(F.col("event_id").alias("b"))
    links = e.select(F.col("event_id").alias("a"), (F.col("event_id") + 150).alias("b"))
    return connected_components(links.join(ids, "b", "left_semi"))
