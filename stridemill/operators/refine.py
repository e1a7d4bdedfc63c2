"""Refining a mined library from deployment feedback: reweight, split, merge, promote."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill import schemas
from stridemill.functions.numeric import population_variance, saturating_cost
from stridemill.model import Model, columns_of
from stridemill.operators import skills as sk
from stridemill.operators.components import connected_components
from stridemill.operators.embedding import Embedder, embed, embedding_usage, hashing_embedder
from stridemill.operators.frequent import MAX_SET, frequent_sets, listed_subsets, numbered_sets, record_sets, refused
from stridemill.operators.neighbours import similar_links
from stridemill.operators.tower import METHOD, skill_nodes
from stridemill.scale import broadcast_if_small, checkpoint, global_rank, lookup_join, stored_table

# fixed values
UTILITY_WEIGHTS = {"success": 0.45, "reward": 0.35, "step_save": 0.15, "cost": 0.05}


@dataclass(frozen=True)
class RefineOptions:
    weights: Mapping[str, float] = field(default_factory=lambda: dict(UTILITY_WEIGHTS))
    prune_threshold: float = 0.05
    prune_downweighted: bool = False
    promote_threshold: float = 0.55
    promote_min_usage: int = 2
    promote_min_avg_utility: float | None = None
    split_variance_threshold: float = 0.20
    min_split_support: int = 1
    merge_similarity_threshold: float = 0.985
    child_full_weight: bool = False

    @staticmethod
    def from_dict(values: Mapping[str, Any]) -> RefineOptions:
        """Settings override the defaults key by key, utility weights included."""
        known = {k: v for k, v in values.items() if k in RefineOptions.__dataclass_fields__ and k != "weights"}
        return RefineOptions(weights={**UTILITY_WEIGHTS, **values.get("utility_weights", {})}, **known)

    @property
    def promote_utility(self) -> float:
        given = self.promote_min_avg_utility
        return self.promote_threshold if given is None else given


def task_outcomes(tasks: DataFrame) -> DataFrame:
    """``task_id, success, reward, step_save``; steps saved against the longest task of all."""
    longest = tasks.agg(F.greatest(F.coalesce(F.max("n_steps"), F.lit(1)), F.lit(1))).scalar()
    return tasks.select(
        "task_id", F.col("success").cast("double").alias("success"),
        F.coalesce("final_reward", F.lit(0.0)).alias("reward"),
        (F.lit(1.0) - F.col("n_steps") / longest).alias("step_save"),
    )


def skill_usage(hits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per (task, skill) that was retrieved, with the task's outcome."""
    pairs = hits.filter("skill_id <> ''").select("task_id", "skill_id").distinct()
    return pairs.join(outcomes, "task_id")


def usage_statistics(usage: DataFrame) -> DataFrame:
    return usage.groupBy("skill_id").agg(
        F.count(F.lit(1)).alias("deployment_usage_count"),
        F.avg("success").alias("deployment_success_rate"),
        F.avg("reward").alias("deployment_avg_reward"),
        F.avg("step_save").alias("deployment_step_save"),
        population_variance(F.col("success")).alias("_variance"),
    )


def skill_utility(weights: Mapping[str, float]) -> Column:
    return (
        F.lit(float(weights["success"])) * F.col("deployment_success_rate")
        + F.lit(float(weights["reward"])) * F.col("deployment_avg_reward")
        + F.lit(float(weights["step_save"])) * F.col("deployment_step_save")
        - F.lit(float(weights["cost"])) * saturating_cost(F.col("token_cost").cast("double"))
    )


def refinement_action(o: RefineOptions) -> Column:
    utility = F.col("deployment_utility")
    return (
        F.when(F.col("deployment_usage_count") == 0, "unobserved")
        .when(utility < o.prune_threshold, "downweight")
        .when((F.col("deployment_usage_count") >= 3) & (F.col("_variance") >= o.split_variance_threshold), "split_candidate")
        .when((F.col("granularity") == "mid") & (utility >= o.promote_threshold), "promote_candidate")
        .otherwise("stable")
    )


def deployment_weight() -> Column:
    """From utility, within [0.5, 2]; a fixed 0.25 when downweighted; split parents at most 0.5."""
    clamped = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.lit(1.0) + F.col("deployment_utility")))
    action = F.col("refinement_action")
    return (
        F.when(action == "unobserved", 1.0).when(action == "downweight", 0.25)
        .when(action == "split_candidate", F.least(clamped, F.lit(0.5))).otherwise(clamped)
    )


def score_skills(skills: DataFrame, usage: DataFrame, o: RefineOptions = RefineOptions()) -> DataFrame:
    """Skills with usage, utility, action and weight; nothing is pruned here, so actions can be counted."""
    joined = skills.drop("deployment_utility", "deployment_weight", "refinement_action").join(
        usage_statistics(usage), "skill_id", "left")
    used = F.coalesce("deployment_usage_count", F.lit(0).cast("long"))
    return (
        joined.withColumn("deployment_utility", F.coalesce(skill_utility(o.weights), F.lit(0.0)))
        .withColumn("deployment_usage_count", used)
        .withColumn("refinement_action", refinement_action(o))
        .withColumn("deployment_weight", deployment_weight())
        .drop("_variance")
    )


def action_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("refinement_action").agg(F.count(F.lit(1)).alias("skills"))


def prune(scored: DataFrame, o: RefineOptions) -> DataFrame:
    return scored.filter("refinement_action <> 'downweight'") if o.prune_downweighted else scored


def _split_parents(scored: DataFrame, bridge: DataFrame, segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unstable skills and their members."""
    parents = scored.filter("refinement_action = 'split_candidate'")
    members = sk.member_segments(sk.members_of(bridge, parents), segs).withColumnRenamed("key", "parent")
    return parents, members


def _split_heads(parents: DataFrame, members: DataFrame, o: RefineOptions) -> DataFrame:
    """Two children of every parent with enough members of either outcome."""
    enough = checkpoint(members.groupBy("parent").agg(
        F.count(F.when(F.col("success"), 1)).alias("_s"), F.count(F.when(~F.col("success"), 1)).alias("_f")
    ).filter((F.col("_s") >= o.min_split_support) & (F.col("_f") >= o.min_split_support)).select("parent"))
    weight = F.lit(1.0) if o.child_full_weight else F.greatest(
        F.lit(0.5), F.coalesce(F.nullif("deployment_weight", F.lit(0.0)), F.lit(1.0)))
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("side")) for i, s in enumerate(("success", "failure"))])
    return (
        parents.join(enough.withColumnRenamed("parent", "skill_id"), "skill_id", "left_semi")
        .withColumn("_k", F.explode(kinds))
        .select(
            F.concat_ws("_split_", "skill_id", "_k.side").alias("key"),
            F.concat_ws("_split_", "skill_id", "_k.side").alias("skill_id"),
            (F.col("pos") * 2 + F.col("_k.i")).alias("pos"),
            F.concat(F.col("name"), F.lit(" ["), F.col("_k.side"), F.lit("]")).alias("name"),
            "granularity", "tower_level",
            F.concat_ws("\n", F.concat(F.lit("Split child of "), "name"),
                        F.concat(F.lit("Outcome partition: "), "_k.side"), "content").alias("content"),
            weight.alias("deployment_weight"), F.lit("split_child").alias("refinement_action"),
            F.col("skill_id").alias("parent_skill_id"),
        )
    )


def _split_edges(heads: DataFrame) -> DataFrame:
    return heads.select(F.col("skill_id").alias("source"), F.col("parent_skill_id").alias("target"),
                        F.lit("split_from").alias("relation"), F.lit(1.0).alias("weight"))


def split_edges(scored: DataFrame, bridge: DataFrame, segs: DataFrame, o: RefineOptions = RefineOptions()) -> DataFrame:
    """The edges of ``split_skills`` alone, which need no statistics of the children."""
    return _split_edges(_split_heads(*_split_parents(scored, bridge, segs), o))


def split_skills(scored: DataFrame, bridge: DataFrame, segs: DataFrame, o: RefineOptions = RefineOptions()):
    """Success and failure children of unstable skills, their members and ``split_from`` edges."""
    parents, members = _split_parents(scored, bridge, segs)
    members = stored_table(members)
    heads = checkpoint(_split_heads(parents, members, o))
    few, small = broadcast_if_small(checkpoint(heads.select(F.col("parent_skill_id").alias("parent")).distinct()), 64)
    members = members.join(few, "parent") if small else lookup_join(members, few, ["parent"])
    side = F.when(F.col("success"), "success").otherwise("failure")
    members = members.withColumn("key", F.concat_ws("_split_", "parent", side))
    children = sk.build_skills(members, heads, total_of(segs), METHOD)
    return children, sk.skill_members(members, heads), _split_edges(heads)


def total_of(segs: DataFrame) -> Column:
    return segs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")).scalar()


def merge_components(vectors: DataFrame, threshold: float) -> DataFrame:
    """``pos, component, merge_index`` of skills that have a near duplicate at their granularity.

    ``vectors``: ``pos, granularity, vector``. Components are numbered by their first skill.
    """
    links = similar_links(vectors.withColumnRenamed("pos", "id"), threshold, "granularity").filter("a <> b")
    found = connected_components(links)
    index = global_rank(found.select("component").distinct(), [F.col("component")], "merge_index")
    return found.join(index, "component").select(F.col("id").alias("pos"), "component", "merge_index")


def merged_skills(skills: DataFrame, groups: DataFrame, bridge: DataFrame, segs: DataFrame):
    """One skill per component: all members once, mean utility, largest weight, list of sources."""
    sources = skills.join(groups, "pos")
    listed = F.array_sort(F.collect_list(F.struct("pos", "skill_id", "name", "content")))
    first = F.min_by(F.struct("granularity", "tower_level"), "pos")
    weight = F.coalesce(F.nullif("deployment_weight", F.lit(0.0)), F.lit(1.0))
    heads = sources.groupBy("merge_index").agg(
        listed.alias("s"), first.alias("f"),
        F.avg(F.coalesce("deployment_utility", F.lit(0.0))).alias("deployment_utility"),
        F.max(weight).alias("deployment_weight"),
    ).select(
        F.col("merge_index").alias("key"),
        F.format_string("tower_refined_merge_%03d", "merge_index").alias("skill_id"),
        F.col("merge_index").alias("pos"),
        F.format_string("Merged %s Skill %d", F.initcap("f.granularity"), "merge_index").alias("name"),
        F.col("f.granularity").alias("granularity"), F.col("f.tower_level").alias("tower_level"),
        F.concat_ws(
            "\n", F.lit("Merged semantically overlapping skills."), F.lit("Merged sources:"),
            F.transform("s", lambda x: F.concat(F.lit("- "), x["name"])), F.lit(""),
            F.transform("s", lambda x: x["content"]),
        ).alias("content"),
        "deployment_utility", "deployment_weight", F.lit("merged").alias("refinement_action"),
        F.transform("s", lambda x: x["skill_id"]).alias("merged_skill_ids"),
    )
    owned = sk.member_segments(sk.members_of(bridge, sources), segs).withColumnRenamed("key", "skill_id")
    members = _placed_members(owned, sources.select("skill_id", F.col("pos").alias("spot"), F.col("merge_index").alias("key")))
    built = sk.build_skills(_numbered(members), heads, total_of(segs), METHOD)
    flat = sk.skill_members(members.withColumn("pos", F.col("pos.pos")), heads)
    edges = heads.select(F.col("skill_id").alias("source"), F.explode("merged_skill_ids").alias("target"),
                         F.lit("merged_from").alias("relation"), F.lit(1.0).alias("weight"))
    return built, flat, edges


def _placed_members(owned: DataFrame, places: DataFrame) -> DataFrame:
    """Members of the skills that ``places`` (``skill_id, key, spot``) puts together, each once at its first spot, stored."""
    places, small = broadcast_if_small(checkpoint(places), 128)
    placed = owned.join(places, "skill_id") if small else lookup_join(owned, places, ["skill_id"])
    return stored_table(sk.unique_members(
        placed.withColumn("pos", F.struct("spot", "pos")).drop("skill_id", "spot"), "key", ["pos"]))


def _numbered(members: DataFrame) -> DataFrame:
    return members.withColumn("pos", sk.place_number(F.col("pos.spot"), F.col("pos.pos")))


def replace_merged(skills: DataFrame, groups: DataFrame, merged: DataFrame) -> DataFrame:
    """Drop the merged inputs, append the merged rows behind them."""
    kept = skills.join(groups.select("pos"), "pos", "left_anti")
    return append(kept, merged)


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``second`` placed after all rows of ``first`` in model order."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return global_rank(both, [F.col("_part"), F.col("pos")], "_pos").withColumn("pos", F.col("_pos")).drop("_part", "_pos")


def mid_co_usage(hits: DataFrame, record_keys: list[str], max_set: int = MAX_SET) -> DataFrame:
    """Every set of two or more mid skills retrieved together, with the number of records: ``mids, count``.

    The listing doubles with every skill of a set: a record with more than ``max_set`` (at most 62) stops the query
    with an error, none is counted in part. ``used_sets`` has the frequent ones without the listing.
    """
    if max_set > 62:
        raise ValueError("max_set may be 62 at most")
    sets = refused(record_sets(hits, record_keys), F.lit(True), max_set)
    return listed_subsets(sets).groupBy("mids").agg(F.sum("n").alias("count"))


def used_sets(hits: DataFrame, record_keys: list[str], o: RefineOptions = RefineOptions()) -> DataFrame:
    """Sets used together often enough for promotion: ``mids, count, set_index``, the index being the place among all sets."""
    sets = checkpoint(record_sets(hits, record_keys))
    return numbered_sets(sets, checkpoint(frequent_sets(sets, o.promote_min_usage)))


def promoted_id() -> Column:
    """Name of a promoted set by its index, which may pass a long."""
    number = F.col("set_index").cast("string")
    return F.concat(F.lit("tower_refined_high_"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))


def promotion_candidates(skills: DataFrame, co_usage: DataFrame, o: RefineOptions = RefineOptions()) -> DataFrame:
    """Used sets that qualify: index over all sets, live children in order, mean utility, existing high skill.

    ``co_usage`` comes from ``used_sets``, or holds all sets from ``mid_co_usage``.
    """
    indexed = co_usage if "set_index" in co_usage.columns else global_rank(co_usage, [F.col("mids")], "set_index")
    used = checkpoint(indexed.filter(F.col("count") >= o.promote_min_usage))
    live = skills.filter("granularity = 'mid'").select(
        F.col("skill_id").alias("child"), F.col("name").alias("child_name"),
        F.coalesce("deployment_utility", F.lit(0.0)).alias("u"))
    children = used.select("set_index", F.explode("mids").alias("child")).join(live, "child")
    means = children.groupBy("set_index").agg(
        F.count(F.lit(1)).alias("children"), F.avg("u").alias("avg_utility"),
        F.array_sort(F.collect_list(F.struct("child", "child_name"))).alias("kids"))
    high = skills.filter("granularity = 'high' and size(child_skill_ids) > 0").groupBy(
        F.array_sort("child_skill_ids").alias("mids")).agg(F.max_by("skill_id", "pos").alias("high_id"))
    return (
        used.join(means, "set_index")
        .filter((F.col("children") >= 2) & (F.col("avg_utility") >= o.promote_utility))
        .join(high, "mids", "left")
    )


def promote(skills: DataFrame, co_usage: DataFrame, bridge: DataFrame, segs: DataFrame, o: RefineOptions = RefineOptions()):
    """Promoted skills, reinforced library, their members and edges."""
    qualified = checkpoint(promotion_candidates(skills, co_usage, o))
    fresh, known = qualified.filter("high_id is null"), qualified.filter("high_id is not null")
    number = F.col("set_index").cast("string")
    place = global_rank(fresh, [F.col("set_index")], "_place")
    heads = place.select(
        number.alias("key"),
        promoted_id().alias("skill_id"),
        F.col("_place").alias("pos"),
        F.concat(F.lit("Refined High Routine "), number).alias("name"),
        F.lit("high").alias("granularity"), F.lit("high").alias("tower_level"),
        F.concat_ws(
            "\n", F.lit("Promoted high-level routine from deployment co-use."),
            F.format_string("Deployment co-use count: %d", "count"), F.lit("Composed mid-level routines:"),
            F.transform("kids", lambda x: F.concat(F.lit("- "), x["child_name"])),
        ).alias("content"),
        F.col("mids").alias("child_skill_ids"), F.col("avg_utility").alias("deployment_utility"),
        F.greatest(F.lit(1.0), F.lit(1.0) + F.col("avg_utility")).alias("deployment_weight"),
        F.lit("promoted_high").alias("refinement_action"), F.col("count").alias("co_usage_count"), "kids",
    )
    kids = heads.select("key", F.posexplode("kids").alias("spot", "kid")).select("key", "spot", F.col("kid.child").alias("skill_id"))
    owned = sk.member_segments(sk.members_of(bridge, kids), segs).withColumnRenamed("key", "skill_id")
    members = _placed_members(owned, kids)
    promoted = sk.build_skills(_numbered(members), heads.drop("kids", "co_usage_count"), total_of(segs), METHOD)
    flat = sk.skill_members(members.withColumn("pos", F.col("pos.pos")), heads)
    edges = _child_edges(heads, F.col("skill_id"), "promotes_mid_skill", "co_usage_count").unionByName(
        _child_edges(known, F.col("high_id"), "reinforced_by_deployment", "count"))
    return promoted, reinforce(skills, known), flat, edges


def _child_edges(sets: DataFrame, source: Column, relation: str, weight: str) -> DataFrame:
    return sets.select(source.alias("source"), F.explode("kids").alias("k"), F.col(weight).cast("double").alias("weight")).select(
        "source", F.col("k.child").alias("target"), F.lit(relation).alias("relation"), "weight")


def reinforce(skills: DataFrame, known: DataFrame) -> DataFrame:
    """Raise utility and weight of high skills whose child set was used together."""
    gain = known.groupBy(F.col("high_id").alias("skill_id")).agg(F.max("avg_utility").alias("_u"))
    hit = F.col("_u").isNotNull()
    return skills.join(gain, "skill_id", "left").withColumns({
        "deployment_weight": F.when(hit, F.greatest(
            F.coalesce(F.nullif("deployment_weight", F.lit(0.0)), F.lit(1.0)), F.lit(1.0) + F.col("_u"))).otherwise(F.col("deployment_weight")),
        "deployment_utility": F.when(hit, F.greatest(F.coalesce("deployment_utility", F.lit(0.0)), F.col("_u"))).otherwise(F.col("deployment_utility")),
        "refinement_action": F.when(hit, "reinforced_high").otherwise(F.col("refinement_action")),
    }).drop("_u")


def refined_nodes(nodes: DataFrame, skills: DataFrame) -> DataFrame:
    """Segment nodes, replaced skill nodes flagged as historical, nodes of the current skills."""
    old = nodes.filter("node_type = 'skill'").join(
        skills.select(F.col("skill_id").alias("node_id")), "node_id", "left_anti").withColumn("historical", F.lit(True))
    return nodes.filter("node_type <> 'skill'").unionByName(old).unionByName(skill_nodes(skills))


def refine_library(model: Model, segs: DataFrame, tasks: DataFrame, hits: DataFrame, record_keys: list[str],
                   o: RefineOptions = RefineOptions(), embedder: Embedder = hashing_embedder) -> Model:
    """The whole refinement. ``tasks``: task headers; ``hits``: one row per retrieved skill of a record."""
    columns = columns_of(schemas.SKILLS)
    hits = checkpoint(hits.select(*dict.fromkeys([*record_keys, "task_id", "skill_id", "granularity"])))
    scored = checkpoint(score_skills(model.skills, skill_usage(hits, task_outcomes(tasks)), o))
    counts = {r["refinement_action"]: r["skills"] for r in action_counts(scored).collect()}
    current = prune(scored, o).select(*columns)

    children, child_members, split_edges = split_skills(current, model.members, segs, o)
    children = checkpoint(children.select(*columns))
    current = checkpoint(append(current, children))
    bridge = model.members.unionByName(child_members)
    edges = _edges(model.edges).unionByName(_edges(split_edges))
    merged_count, usage = 0, {"texts": 0, "total_tokens": 0}
    if current.count() >= 2:
        vectors = checkpoint(embed(current.withColumn("_t", sk.skill_text()), "_t", embedder))
        usage = embedding_usage(vectors).first().asDict()
        groups = checkpoint(merge_components(vectors.select("pos", "granularity", "vector"), o.merge_similarity_threshold))
        merged_count = groups.select("component").distinct().count()
        if merged_count:
            merged, merged_members, merge_edges = merged_skills(current, groups, bridge, segs)
            merged = checkpoint(merged.select(*columns))
            current = checkpoint(replace_merged(current, groups, merged).select(*columns))
            bridge = bridge.unionByName(merged_members)
            edges = edges.unionByName(_edges(merge_edges))
    bridge = checkpoint(bridge)
    promoted, reinforced, promoted_members, promote_edges = promote(
        current, used_sets(hits, record_keys, o), bridge, segs, o)
    promoted = checkpoint(promoted.select(*columns))
    reinforced = checkpoint(reinforced.select(*columns))
    final = checkpoint(append(reinforced, promoted).select(*columns))
    meta = {
        **model.meta,
        "record_count": tasks.count(),
        "utility_weights": dict(o.weights),
        "action_counts": counts,
        "structural_updates": {
            "split_child_count": children.count(),
            "merged_skill_count": merged_count,
            "promoted_high_skill_count": promoted.count(),
            "reinforced_high_skill_count": reinforced.filter("refinement_action = 'reinforced_high'").count(),
        },
        "merge_embedding": usage,
    }
    return replace(
        model, skills=final, members=bridge.unionByName(promoted_members).join(final.select("skill_id"), "skill_id", "left_semi"),
        nodes=refined_nodes(model.nodes, final), edges=edges.unionByName(_edges(promote_edges)), meta=meta)


def _edges(edges: DataFrame) -> DataFrame:
    for name in columns_of(schemas.EDGES):
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(None).cast("double"))
    return edges.select(*columns_of(schemas.EDGES))
