"""The three skill levels: action templates, behaviour clusters, communities of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.functions import text as tx
from stridemill.operators.communities import wide_communities
from stridemill.operators.skills import build_skills, skill_members, top_counts
from stridemill.operators.traces import step_pairs
from stridemill.scale import global_rank, lookup_join, top_rows

MAX_MIDS = 2048
METHOD = "tower"
NO_PATH = "single routine or no repeated cross-mid transition"


def segment_total(segs: DataFrame) -> Column:
    """Segment count as a scalar subquery: one partial count, no driver step."""
    return segs.agg(F.count(F.lit(1)).cast("double")).scalar()


def low_heads(segs: DataFrame) -> DataFrame:
    """One head per action template, numbered in template order, with its eight commonest actions."""
    keyed = segs.withColumn("key", F.col("template"))
    actions = top_counts(keyed, "action", 8)
    ranked = global_rank(actions, [F.col("key")], "pos")
    lines = F.transform("action", lambda a: F.concat(F.lit("- "), a["value"]))
    return ranked.select(
        "key",
        F.format_string("tower_low_%03d", "pos").alias("skill_id"),
        "pos",
        F.concat(F.lit("Low "), "key").alias("name"),
        F.lit("low").alias("granularity"),
        F.concat_ws(
            "\n", F.concat(F.lit("Low-level action template: "), "key"), F.lit("Representative actions:"), lines
        ).alias("content"),
    )


def low_skills(segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    members = segs.withColumn("key", F.col("template"))
    heads = low_heads(segs)
    return build_skills(members, heads, segment_total(segs), METHOD), skill_members(members, heads)


def transition_context(pairs: DataFrame) -> DataFrame:
    """Labels met just outside each cluster, as ``incoming`` and ``outgoing`` counters.

    The transition weight is symmetric, so both counts of a label agree; only
    the tie order differs. ``pairs`` comes from ``step_pairs`` with cluster, label and pos.
    """
    crossing = pairs.filter("cluster <> next_cluster")
    sides = crossing.select(
        F.col("cluster").alias("key"), F.col("next_label").alias("value"),
        F.col("pos").alias("inside"), F.col("next_pos").alias("outside"),
    ).unionByName(crossing.select(
        F.col("next_cluster").alias("key"), F.col("label").alias("value"),
        F.col("next_pos").alias("inside"), F.col("pos").alias("outside"),
    ))
    counts = sides.groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct("inside", "outside")).alias("out_first"),
        F.min(F.struct("outside", "inside")).alias("in_first"),
    )
    lists = None
    for name, tie in (("incoming", "in_first"), ("outgoing", "out_first")):
        best = top_rows(counts, ["key"], [F.desc("count"), F.asc(tie)], 5, "_r").groupBy("key").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_r", "value", "count"))),
                lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")),
            ).alias(name)
        )
        lists = best if lists is None else lists.join(best, "key", "full")
    return lists


def directed_context(pairs: DataFrame) -> DataFrame:
    """Label counts by true direction, which the symmetric form cannot show."""
    crossing = pairs.filter("cluster <> next_cluster")
    out = crossing.select(F.col("cluster").alias("key"), F.lit("outgoing").alias("direction"), F.col("next_label").alias("label"))
    into = crossing.select(F.col("next_cluster").alias("key"), F.lit("incoming").alias("direction"), "label")
    return out.unionByName(into).groupBy("key", "direction", "label").count()


def mid_heads(clustered: DataFrame) -> DataFrame:
    """One head per cluster; ``clustered`` is the segment table with a ``cluster`` column."""
    keyed = clustered.withColumn("key", F.col("cluster"))
    pairs = step_pairs(clustered, ["pos", "label", "cluster"])
    context = transition_context(pairs)
    shaped = (
        top_counts(keyed, "label").join(top_counts(keyed, "template"), "key").join(context, "key", "left")
    )
    ranked = global_rank(shaped, [F.col("key")], "pos")
    around = F.concat(
        F.lit("incoming=["), tx.counter_text(F.col("incoming")), F.lit("], outgoing=["),
        tx.counter_text(F.col("outgoing")), F.lit("]"),
    )
    return ranked.select(
        "key",
        F.format_string("tower_mid_%03d", "pos").alias("skill_id"),
        "pos",
        F.concat(F.lit("Mid Pattern "), F.col("pos").cast("string")).alias("name"),
        F.lit("mid").alias("granularity"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("Mid-level behavior pattern "), F.col("key").cast("string")),
            F.concat(F.lit("Dominant events: "), tx.counter_text(F.col("label"))),
            F.concat(F.lit("Dominant action templates: "), tx.counter_text(F.col("template"))),
            F.concat(F.lit("Typical transition context: "), around),
        ).alias("content"),
    )


def mid_skills(clustered: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    members = clustered.withColumn("key", F.col("cluster"))
    heads = heads if heads is not None else mid_heads(clustered)
    return build_skills(members, heads, segment_total(clustered), METHOD), skill_members(members, heads)


def centroids(embedding: DataFrame) -> DataFrame:
    """Mean embedding per cluster, in long form ``cluster, dim, value``."""
    return embedding.select("cluster", F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(
        F.avg("x").alias("value")
    )


def mid_transitions(clustered: DataFrame) -> DataFrame:
    """Counts of steps that change cluster: ``source, target, weight, first``."""
    pairs = step_pairs(clustered, ["pos", "cluster"]).filter("cluster <> next_cluster")
    return pairs.groupBy(F.col("cluster").alias("source"), F.col("next_cluster").alias("target")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.min("pos").alias("first")
    )


def greedy_modularity(nodes: list[int], links: dict[tuple[int, int], float]) -> list[set[int]]:
    """Communities of a small weighted graph: merge the best pair while modularity does not fall.

    Larger communities come first, then those with the smaller first member.
    """
    total = sum(links.values())
    if not total:
        return [{n} for n in nodes]
    groups = {n: {n} for n in nodes}
    load = dict.fromkeys(nodes, 0.0)
    between: dict[tuple[int, int], float] = {}
    for (a, b), w in links.items():
        load[a] += w
        load[b] += w
        between[min(a, b), max(a, b)] = between.get((min(a, b), max(a, b)), 0.0) + w
    while between:
        gain, pair = max(
            ((w / total - load[a] * load[b] / (2 * total * total), (-a, -b)) for (a, b), w in between.items())
        )
        if gain < 0:
            break
        a, b = -pair[0], -pair[1]
        groups[a] |= groups.pop(b)
        load[a] += load.pop(b)
        merged: dict[tuple[int, int], float] = {}
        for (x, y), w in between.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                merged[min(x, y), max(x, y)] = merged.get((min(x, y), max(x, y)), 0.0) + w
        between = merged
    return sorted(groups.values(), key=lambda g: (-len(g), min(g)))


def communities(spark: SparkSession, clusters: DataFrame, transitions: DataFrame, method: str = "greedy") -> DataFrame:
    """``cluster, community``. Two-way weights are summed.

    ``greedy`` merges pairs on the driver, for the few clusters a miner usually has; the size is checked before anything is
    fetched. ``moves`` runs as Spark jobs for any number of clusters; its communities may differ from the greedy ones.
    """
    if method == "moves":
        return wide_communities(clusters, transitions)
    if method != "greedy":
        raise ValueError(f"unknown community method: {method}")
    mids = clusters.count()
    if mids > MAX_MIDS:
        raise ValueError(f"{mids} mid clusters are more than {MAX_MIDS}: choose the community method 'moves'")
    nodes = sorted(r[0] for r in clusters.collect())
    links: dict[tuple[int, int], float] = {}
    for r in transitions.select("source", "target", "weight").collect():
        pair = (min(r[0], r[1]), max(r[0], r[1]))
        links[pair] = links.get(pair, 0.0) + r[2]
    rows = [(node, i) for i, group in enumerate(greedy_modularity(nodes, links)) for node in sorted(group)]
    return spark.createDataFrame(rows, "cluster long, community long")


def path_texts(transitions: DataFrame, groups: DataFrame) -> DataFrame:
    """Per community, its six heaviest inner transitions as ``a:b -> ...``."""
    inner = (
        transitions.join(groups.withColumnRenamed("cluster", "source"), "source")
        .join(groups.select(F.col("cluster").alias("target"), F.col("community").alias("_c")), "target")
        .filter("community = _c")
    )
    best = top_rows(inner, ["community"], [F.desc("weight"), F.asc("source"), F.asc("first")], 6, "_r")
    step = F.concat(F.col("source").cast("string"), F.lit(":"), F.col("target").cast("string"))
    texts = best.groupBy("community").agg(
        F.concat_ws(" -> ", F.transform(F.array_sort(F.collect_list(F.struct("_r", step.alias("s")))), lambda x: x["s"])).alias("path")
    )
    return groups.select("community").distinct().join(texts, "community", "left").select(
        "community", F.coalesce("path", F.lit(NO_PATH)).alias("path")
    )


def community_segments(clustered: DataFrame, groups: DataFrame) -> DataFrame:
    """Segments with the community of their cluster."""
    return lookup_join(clustered, groups, ["cluster"])


def high_skills(clustered: DataFrame, mids: DataFrame, groups: DataFrame, transitions: DataFrame):
    """High skills, their members and ``contains_mid_skill`` edges.

    ``mids`` gives ``key`` (cluster), ``skill_id`` and ``name`` of the mid skills.
    """
    children = groups.join(mids.select(F.col("key").alias("cluster"), F.col("skill_id").alias("child"),
                                       F.col("name").alias("child_name")), "cluster")
    listed = F.array_sort(F.collect_list(F.struct("cluster", "child", "child_name")))
    heads = (
        children.groupBy("community").agg(listed.alias("kids"))
        .join(path_texts(transitions, groups), "community")
        .select(
            F.col("community").alias("key"),
            F.format_string("tower_high_%03d", "community").alias("skill_id"),
            F.col("community").alias("pos"),
            F.format_string("High Skill Routine %d", "community").alias("name"),
            F.lit("high").alias("granularity"),
            F.concat_ws(
                "\n",
                F.format_string("High-level skill community %d", "community"),
                F.lit("Composed mid-level routines:"),
                F.transform("kids", lambda k: F.concat(F.lit("- "), k["child_name"])),
                F.concat(F.lit("Common execution order: "), "path"),
            ).alias("content"),
            F.transform("kids", lambda k: k["child"]).alias("child_skill_ids"),
        )
    )
    members = community_segments(clustered, groups).withColumn("key", F.col("community"))
    skills = build_skills(members, heads, segment_total(clustered), METHOD)
    return skills, skill_members(members, heads), hierarchy_edges(skills)


def hierarchy_edges(skills: DataFrame, relation: str = "contains_mid_skill") -> DataFrame:
    return skills.select(
        F.col("skill_id").alias("source"), F.explode("child_skill_ids").alias("target"),
        F.lit(relation).alias("relation"), F.lit(1.0).alias("weight"),
    )


def segment_nodes(segs: DataFrame) -> DataFrame:
    return segs.select(
        F.col("segment_id").alias("node_id"), F.lit("segment").alias("node_type"),
        F.lit(None).cast("string").alias("granularity"), "label", "text",
        F.lit(None).cast("string").alias("refinement_action"), F.lit(False).alias("historical"),
    )


def skill_nodes(skills: DataFrame) -> DataFrame:
    return skills.select(
        F.col("skill_id").alias("node_id"), F.lit("skill").alias("node_type"), "granularity",
        F.col("name").alias("label"), F.col("content").alias("text"),
        F.coalesce("refinement_action", F.lit("")).alias("refinement_action"), F.lit(False).alias("historical"),
    )


def stacked(levels: list[DataFrame]) -> DataFrame:
    """Skills of all levels in model order: level by level, positions renumbered."""
    out = None
    for i, level in enumerate(levels):
        placed = level.withColumn("_level", F.lit(i))
        out = placed if out is None else out.unionByName(placed)
    ranked = global_rank(out, [F.col("_level"), F.col("pos")], "_pos")
    return ranked.withColumn("pos", F.col("_pos")).drop("_level", "_pos")
