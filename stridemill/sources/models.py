"""Model tables on disk, and the single-document JSON form for exchange."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill import schemas
from stridemill.functions.text import action_template
from stridemill.model import Model, columns_of
from stridemill.scale import global_rank, number_rows

TABLES = ["skills", "members", "nodes", "edges"]
DOCUMENT_ROWS = 1_000_000
PART_ROWS = 20_000


def write_model(model: Model, path: str) -> None:
    for name in TABLES:
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = model.skills.sparkSession
    header = {"method": model.method, "description": model.description, "metadata": model.meta}
    spark.createDataFrame([(json.dumps(header, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_model(spark: SparkSession, path: str) -> Model:
    header = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return Model(*[spark.read.parquet(f"{path}/{name}") for name in TABLES], header["method"],
                 header["description"], header["metadata"])


def read_model_document(spark: SparkSession, path: str, parts: bool = False) -> tuple[Model, DataFrame]:
    """Import a one-document model, or with ``parts`` the lines of ``write_model_parts``: the model tables and its segments."""
    doc = spark.read.schema(schemas.MODEL_DOCUMENT).option("multiLine", not parts).json(path)
    place = lambda first: (F.coalesce(F.col(first), F.lit(0)) + F.col("pos")).alias("pos")
    every = doc.select("first_skill", F.posexplode("skills").alias("pos", "s"))
    exploded = every.filter("coalesce(s.first_member, 0) = 0").select(place("first_skill"), "s")
    meta = F.col("s.metadata")
    skills = exploded.select(
        "s.skill_id", F.col("pos").cast("long").alias("pos"), "s.name", "s.granularity",
        F.coalesce(F.nullif(meta["tower_level"], F.lit("")), F.col("s.granularity")).alias("tower_level"),
        F.coalesce("s.content", F.lit("")).alias("content"), "s.embedding_text",
        F.coalesce(meta["support"], F.size("s.members")).cast("long").alias("support"),
        meta["coverage"].alias("coverage"), meta["success_rate"].alias("success_rate"),
        meta["failure_rate"].alias("failure_rate"), meta["avg_reward"].alias("avg_reward"),
        meta["avg_step_reward"].alias("avg_step_reward"), meta["recent_success_rate"].alias("recent_success_rate"),
        meta["recent_reward_lift"].alias("recent_reward_lift"), meta["token_cost"].cast("long").alias("token_cost"),
        meta["trajectory_count"].alias("trajectory_count"), meta["labels"].alias("labels"),
        meta["action_templates"].alias("action_templates"), meta["source_method"].alias("source_method"),
        meta["child_skill_ids"].alias("child_skill_ids"), meta["deployment_utility"].alias("deployment_utility"),
        meta["deployment_weight"].alias("deployment_weight"), meta["refinement_action"].alias("refinement_action"),
    )
    members = every.select("s.skill_id", "s.first_member", F.posexplode("s.members").alias("pos", "segment_id")).select(
        "skill_id", "segment_id", place("first_member").cast("long").alias("pos"))
    listed = doc.select("first_node", F.posexplode("nodes").alias("pos", "n")).select(place("first_node"), "n.*")
    m = F.col("metadata")
    kind = F.when(m["node_type"] == "skill", "skill").otherwise("segment")
    nodes = listed.select(
        "node_id", kind.alias("node_type"), m["granularity"].alias("granularity"), "label", "text",
        m["refinement_action"].alias("refinement_action"),
        F.coalesce(m["historical_refinement_node"], F.lit(False)).alias("historical"))
    action = F.coalesce(m["action"], F.lit(""))
    reward = F.coalesce(m["final_reward"], F.lit(0.0))
    segs = listed.filter(kind == "segment").select(
        F.col("node_id").alias("segment_id"), F.coalesce(m["trajectory_id"], F.lit("unknown")).alias("trajectory_id"),
        F.coalesce(m["env"], F.lit("")).alias("env"), F.coalesce(m["goal"], F.lit("")).alias("goal"),
        F.coalesce("label", F.lit("Unknown")).alias("label"), action_template(action).alias("template"),
        action.alias("action"), "text", F.coalesce(m["trajectory_success"], reward > 0).alias("success"),
        reward.alias("final_reward"), F.coalesce(m["step_reward"], F.lit(0.0)).alias("step_reward"),
        F.col("pos").cast("long").alias("pos"))
    edges = doc.select(F.explode("edges").alias("e")).select(
        "e.source", "e.target", "e.relation", "e.weight", "e.metadata.semantic", "e.metadata.transition",
        "e.metadata.outcome_consistency", "e.metadata.contrastive_weight")
    head = doc.select("method", "description", "metadata").first()
    model = Model(skills.select(*columns_of(schemas.SKILLS)), members, nodes, edges, head["method"],
                  head["description"] or "", json.loads(head["metadata"] or "{}"))
    return model, segs


def _meta_fields() -> list[str]:
    return [c for c in columns_of(schemas.SKILLS)
            if c not in ("skill_id", "pos", "name", "granularity", "content", "embedding_text")]


def _node() -> Column:
    return F.struct(
        "node_id", "label", "text", F.struct("node_type", "granularity", "refinement_action",
                                             F.col("historical").alias("historical_refinement_node")).alias("metadata"))


def _edge() -> Column:
    return F.struct(
        "source", "target", "relation", "weight",
        F.struct("semantic", "transition", "outcome_consistency", "contrastive_weight").alias("metadata"))


def write_model_parts(model: Model, path: str, part_rows: int = PART_ROWS) -> None:
    """Export a model of any size as JSON lines: each line is a document of the same form with a part of the lists.

    ``first_skill``, ``first_node`` and a skill's ``first_member`` tell where a part goes on, so no row holds more
    than about ``part_rows`` entries. The parts of a skill after its first hold its id and members only.
    """
    placed = number_rows(model.members.select("skill_id", "segment_id", "pos"), ["skill_id"], [F.col("pos"), F.col("segment_id")], "_n")
    part = F.floor((F.col("_n") - 1) / part_rows)
    lists = placed.groupBy("skill_id", part.alias("_part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "segment_id"))), lambda x: x["segment_id"]).alias("members"))
    sizes = placed.groupBy("skill_id").agg(F.max("_n").alias("_size"))
    meta = [F.coalesce("support", "_size", F.lit(0).cast("long")).alias("support") if c == "support" else F.col(c) for c in _meta_fields()]
    ranked = global_rank(model.skills, [F.col("pos"), F.col("skill_id")], "_rank")
    first = ranked.join(sizes, "skill_id", "left").join(lists.filter("_part = 0"), "skill_id", "left").select("_rank", F.struct(
        "skill_id", "name", "granularity", F.coalesce("members", F.array().cast("array<string>")).alias("members"),
        "content", "embedding_text", F.struct(*meta).alias("metadata"), F.lit(0).cast("long").alias("first_member")).alias("s"))
    more = lists.filter("_part > 0").select(
        F.lit(0).cast("long").alias("_rank"),
        F.struct("skill_id", "members", (F.col("_part") * part_rows).alias("first_member")).alias("s"))
    skills = [rows.select(F.struct(F.col("_rank").alias("first_skill"), F.array("s").alias("skills")).alias("d")) for rows in (first, more)]

    def cut(rows: DataFrame, entry: Column, name: str) -> DataFrame:
        count = max(1, -(-rows.count() // part_rows))
        dealt = rows.select(entry.alias("e")).withColumn("_part", F.pmod(F.xxhash64(F.to_json("e")), F.lit(count)))
        grouped = dealt.groupBy("_part").agg(F.collect_list("e").alias(name))
        return grouped.select(F.struct((F.col("_part") * F.lit(1 << 33)).alias("first_node"), F.col(name)).alias("d"))

    parts = [*skills, cut(model.nodes, _node(), "nodes"), cut(model.edges, _edge(), "edges")]
    head = json.dumps({"method": model.method, "description": model.description, "metadata": model.meta}, default=str)
    body = model.skills.sparkSession.createDataFrame([(head,)], "value string")
    for rows in parts:
        body = body.unionByName(rows.select(F.concat(F.lit(head[:-1] + ","), F.substring(F.to_json("d"), 2, 1 << 30)).alias("value")))
    body.write.mode("overwrite").text(path)


def write_model_document(model: Model, path: str, limit: int = DOCUMENT_ROWS) -> None:
    """Export the one-document form. One JSON document is one row, so the size is checked first;
    larger models are exchanged as tables (``write_model``) or lines (``write_model_parts``)."""
    rows = model.members.count() + model.nodes.count() + model.edges.count()
    if rows > limit:
        raise ValueError(f"{rows} rows do not fit one JSON document; use write_model")
    lists = model.members.groupBy("skill_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment_id"))), lambda x: x["segment_id"]).alias("members"))
    meta_fields = _meta_fields()
    skills = model.skills.join(lists, "skill_id", "left").select("pos", F.struct(
        "skill_id", "name", "granularity", F.coalesce("members", F.array().cast("array<string>")).alias("members"),
        "content", "embedding_text", F.struct(*meta_fields).alias("metadata")).alias("s"))
    packed = skills.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json("s").alias("j")))), lambda x: x["j"]).alias("skills"))
    nodes = model.nodes.agg(F.collect_list(F.to_json(_node())).alias("nodes"))
    edges = model.edges.agg(F.collect_list(F.to_json(_edge())).alias("edges"))

    def listed(name: str):
        return F.concat(F.lit(f'"{name}":['), F.concat_ws(",", packed_row[name]), F.lit("]"))

    packed_row = {n: F.col(n) for n in ("nodes", "edges", "skills")}
    head = json.dumps({"method": model.method, "description": model.description, "metadata": model.meta}, default=str)
    one = packed.join(nodes, F.lit(True)).join(edges, F.lit(True))
    body = F.concat(F.lit(head[:-1] + ","), F.concat_ws(",", listed("nodes"), listed("edges"), listed("skills")), F.lit("}"))
    one.select(body.alias("value")).coalesce(1).write.mode("overwrite").text(path)
