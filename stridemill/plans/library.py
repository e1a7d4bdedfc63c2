"""A library with fixed clusters for the queries: low by template, mid by event kind, high by pairs of clusters.

Unlike a mined library its clusters follow from a column, so SQL can rebuild it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill import schemas
from stridemill.model import Model, columns_of
from stridemill.operators import tower
from stridemill.operators.skills import SEGMENT, build_skills
from stridemill.plans import fixtures as fx
from stridemill.scale import broadcast_if_small, checkpoint, lookup_join

KINDS = ["QueryFormulation", "CandidateInteraction", "PurchaseDecision"]


def clustered(segs: DataFrame) -> DataFrame:
    kind = F.lit(len(KINDS)).cast("long")
    for i, name in reversed(list(enumerate(KINDS))):
        kind = F.when(F.col("label") == name, F.lit(i).cast("long")).otherwise(kind)
    return segs.withColumn("cluster", kind)


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, c // 2) for c in range(len(KINDS) + 1)], "cluster long, community long")


def mid_heads(rows: DataFrame) -> DataFrame:
    c = F.col("key")
    return rows.select(F.col("cluster").alias("key")).distinct().select(
        "key", F.format_string("tower_mid_%03d", c).alias("skill_id"), c.alias("pos"),
        F.format_string("Mid Pattern %d", c).alias("name"), F.lit("mid").alias("granularity"),
        F.format_string("Mid-level behavior pattern %d", c).alias("content"))


def high_heads(rows: DataFrame) -> DataFrame:
    c = F.col("key")
    kids = F.array(*[F.format_string("tower_mid_%03d", c * 2 + i) for i in range(2)])
    return rows.select(F.floor(F.col("cluster") / 2).alias("key")).distinct().select(
        "key", F.format_string("tower_high_%03d", c).alias("skill_id"), c.alias("pos"),
        F.format_string("High Skill Routine %d", c).alias("name"), F.lit("high").alias("granularity"),
        F.format_string("High-level skill community %d", c).alias("content"), kids.alias("child_skill_ids"))


def build(segs: DataFrame, wide: bool = False) -> Model:
    """All levels in one pass: the members of every level feed the same aggregates.

    The narrow segment columns are kept while the aggregates read them. ``wide`` members carry the columns of their segment,
    for readers that would join them to it again.
    """
    rows = clustered(segs)
    narrow = rows.select(
        "segment_id", "trajectory_id", "pos", "label", "template", "action", "success", "final_reward", "step_reward", "cluster"
    ).persist()
    try:
        skills, bridge = _skills(narrow, rows, SEGMENT if wide else ())
    finally:
        narrow.unpersist()
    edges = tower.hierarchy_edges(skills.filter("granularity = 'high'"))
    for name in columns_of(schemas.EDGES):
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(None).cast("double"))
    nodes = tower.segment_nodes(rows).unionByName(tower.skill_nodes(skills))
    return Model(skills, bridge, nodes, edges)


def _skills(rows: DataFrame, source: DataFrame, carried: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    low = checkpoint(tower.low_heads(rows))
    empty = F.lit(None).cast("array<string>")
    shared = ["skill_id", "pos", "name", "granularity", "content", "child_skill_ids"]
    mid, high = mid_heads(rows), high_heads(rows)
    heads = tower.stacked([
        low.withColumn("child_skill_ids", empty).select(*shared), mid.withColumn("child_skill_ids", empty).select(*shared),
        high.select(*shared)]).withColumn("key", F.col("skill_id"))
    skills = checkpoint(build_skills(
        _members(rows, low), heads, tower.segment_total(rows), tower.METHOD).select(*columns_of(schemas.SKILLS)))
    return skills, _members(source, low).select(F.col("key").alias("skill_id"), "segment_id", "pos", *carried)


def _members(rows: DataFrame, low: DataFrame) -> DataFrame:
    ids = low.select(F.col("key").alias("template"), F.col("skill_id").alias("key"))
    names = F.array(
        F.format_string("tower_mid_%03d", "cluster"), F.format_string("tower_high_%03d", F.floor(F.col("cluster") / 2)))
    few, small = broadcast_if_small(ids, 128)
    named = rows.join(few, "template") if small else lookup_join(rows, ids, ["template"])
    return named.unionByName(rows.withColumn("key", F.explode(names)))


def of(spark: SparkSession, sf: str, wide: bool = False) -> Model:
    return build(fx.segments(spark, sf), wide)
