"""Offline selector evaluation: feature match, future utility, score grids, rank metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.functions.numeric import correlation, saturating_cost
from stridemill.functions.text import tokenize
from stridemill.operators.postings import Slice, grid, slice_ranges, stored_if_read_twice, term_bytes, text_side
from stridemill.operators.scoring import skill_terms, text_terms, unit_terms
from stridemill.operators.traces import task_texts
from stridemill.scale import broadcast_if_small, checkpoint, global_rank, lookup_join, top_rows

PART_CELLS = 250_000


def split_tasks(tasks: DataFrame, future_ratio: float, order: list[str]) -> DataFrame:
    """Add ``task_pos`` (overall order) and ``future`` (bool); the cut rounds half to even, 1..n-1."""
    if not 0 < future_ratio < 1:
        raise ValueError("future_ratio must lie between 0 and 1")
    placed = global_rank(tasks, [F.col(c) for c in order], "task_pos")
    n = placed.agg(F.count(F.lit(1))).scalar()
    cut = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(1.0 - future_ratio), 0)), n - 1)
    return placed.withColumn("_cut", cut).withColumn("future", F.col("task_pos") >= F.col("_cut")).withColumn(
        "task_pos", F.when(F.col("future"), F.col("task_pos") - F.col("_cut").cast("long")).otherwise(F.col("task_pos"))
    ).drop("_cut")


def counter_terms(skills: DataFrame, column: str) -> DataFrame:
    """Label or template weights of the skills, normalised per skill."""
    entries = skills.select("pos", F.explode_outer(column).alias("e")).select(
        "pos", F.nullif("e.value", F.lit("")).alias("token"), F.coalesce("e.count", F.lit(0)).cast("double").alias("c")
    )
    return unit_terms(entries, "pos")


def segment_terms(tasks: DataFrame, segs: DataFrame, column: str) -> DataFrame:
    """Label or template counts of the tasks."""
    counts = segs.groupBy(F.col("trajectory_id").alias("task_id"), F.col(column).alias("token")).agg(
        F.count(F.lit(1)).cast("double").alias("c")
    )
    return counts.join(tasks.select("task_id"), "task_id", "left_semi")


def skill_features(skills: DataFrame) -> DataFrame:
    """Long feature table of the skills: ``pos, kind, feature, w``."""
    parts = [
        counter_terms(skills, "labels").withColumn("kind", F.lit("label")),
        counter_terms(skills, "action_templates").withColumn("kind", F.lit("template")),
        skill_terms(skills).withColumn("kind", F.lit("text")),
    ]
    return _stack(parts, "pos")


def task_features(tasks: DataFrame, segs: DataFrame, first: int = 8) -> DataFrame:
    """Long feature table of the tasks: ``task_id, kind, feature, w``."""
    mine = segs.join(tasks.select(F.col("task_id").alias("trajectory_id")), "trajectory_id", "left_semi")
    texts = task_texts(mine, first)
    parts = [
        unit_terms(segment_terms(tasks, segs, "label"), "task_id").withColumn("kind", F.lit("label")),
        unit_terms(segment_terms(tasks, segs, "template"), "task_id").withColumn("kind", F.lit("template")),
        text_terms(texts, "task_id", F.col("text")).withColumn("kind", F.lit("text")),
    ]
    return _stack(parts, "task_id")


def _stack(parts: list[DataFrame], key: str) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("token").isNotNull()).select(key, "kind", F.col("token").alias("feature"), "w")


def feature_space(skills: DataFrame, tasks: DataFrame, segs: DataFrame, first: int = 8) -> DataFrame:
    """Distinct features of both sides; those of the tasks need no counts."""
    mine = segs.join(tasks.select(F.col("task_id").alias("trajectory_id")), "trajectory_id", "left_semi")
    pair = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("feature"))
    texts = task_texts(mine, first).select(F.lit("text").alias("kind"), F.explode(tokenize(F.col("text"))).alias("feature"))
    both = mine.select(F.inline(F.array(pair("label"), pair("template")))).unionByName(texts).unionByName(
        skill_features(skills).select("kind", "feature"))
    return both.filter("feature <> ''").distinct()


def known_terms(terms: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """``task_id, <name>_tokens, <name>_counts, <name>_length``: a task's counts of the features that the library knows.

    The length covers all of its features; the lists hold no more than the library's features.
    """
    vocabulary, _ = broadcast_if_small(checkpoint(weights.filter(F.col("token").isNotNull()).select("token", F.lit(True).alias("_known")).distinct()), 64)
    marked = terms.join(vocabulary, "token", "left")
    listed = F.collect_list(F.when(F.col("_known"), F.struct("token", "c")))
    return marked.groupBy("task_id").agg(listed.alias("_l"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias(f"{name}_length")).select(
        "task_id", F.col("_l.token").alias(f"{name}_tokens"), F.col("_l.c").alias(f"{name}_counts"), f"{name}_length"
    )


def match_grid(tasks: DataFrame, skills: DataFrame, segs: DataFrame, first: int = 8, part_cells: int = PART_CELLS) -> DataFrame:
    """Every (task, skill) cell with its label, template and text match.

    Cells are what the metrics are defined on, so they are all produced; each task brings its features once and meets
    the library as an index, slice by slice, so no cell comes from a join.
    """
    # a task without segments or text matches nothing, but stays
    asked = tasks.select("task_id", "task_pos", "final_reward", "success", "n_steps")
    weights = {}
    for name, column, counter in (("label_match", "label", "labels"), ("template_match", "template", "action_templates")):
        weights[name] = checkpoint(counter_terms(skills, counter))
        asked = asked.join(known_terms(segment_terms(tasks, segs, column), weights[name], name), "task_id", "left")
        for part, kind in (("tokens", "array<string>"), ("counts", "array<double>")):
            asked = asked.withColumn(f"{name}_{part}", F.coalesce(f"{name}_{part}", F.array().cast(kind)))
        asked = asked.withColumn(f"{name}_length", F.coalesce(f"{name}_length", F.lit(0.0)))
    weights["text_match"] = checkpoint(skill_terms(skills))
    texts = task_texts(segs, first).select("task_id", tokenize(F.col("text")).alias("text_match_tokens"))
    asked = asked.join(texts, "task_id", "left").withColumn(
        "text_match_tokens", F.coalesce("text_match_tokens", F.array().cast("array<string>")))
    longest = tasks.agg(F.greatest(F.max("n_steps"), F.lit(1))).scalar()
    asked = asked.withColumn("efficiency", F.lit(1.0) - F.col("n_steps") / longest)
    every = weights["label_match"].unionByName(weights["template_match"]).unionByName(weights["text_match"])
    ranges = slice_ranges(term_bytes(every))
    if not ranges:
        raise ValueError("selector evaluation needs at least one skill")
    # a few bytes of a task become a row per skill and selector: bounded numbers of cells let later sorts be bounded too
    parts = -(-tasks.count() * skills.count() // part_cells)
    if parts > 1:
        asked = asked.repartition(max(parts, int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "task_pos")
    asked = stored_if_read_twice(asked, len(ranges))
    carried = ["task_id", "task_pos", "final_reward", "success", "n_steps", "efficiency"]
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    fields = ", ".join(f"{c} {kinds[c]}" for c in carried) + ", pos long, " + ", ".join(f"{n} double" for n in weights)
    cells = None
    for low, high in ranges:
        inside = F.col("pos").between(low, high)
        pos = skills.filter(inside).select("pos").toArrow()["pos"].combine_chunks()
        at = pos.to_numpy()
        same = Slice.of(at, np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at)))
        sides = {name: (text_side(w.filter(inside), at, same.blocks), same) for name, w in weights.items()}
        found = grid(asked, sides, carried, {"pos": pos}, fields)
        cells = found if cells is None else cells.unionByName(found)
    attributes = skills.select(
        F.col("pos"), "skill_id", "support", "success_rate", "avg_reward", "coverage",
        F.coalesce("recent_success_rate", "success_rate").alias("recent_success_rate"), "recent_reward_lift",
        F.coalesce("failure_rate", F.lit(1.0) - F.col("success_rate")).alias("failure_rate"), "token_cost",
    )
    heads, _ = broadcast_if_small(checkpoint(attributes), 160)
    return cells.join(heads, "pos")


def stored_cells(cells: DataFrame, batch_size: int | None = None) -> DataFrame:
    """The grid for several passes: what the scores read, stored once, with ``utility_rank`` overall or inside each batch.

    Utility does not depend on the selector, so its order is found on the cells, not on every selector's copy of them.
    """
    read = [c for c in cells.columns if c not in ("n_steps", "label_match", "template_match", "final_reward", "success", "efficiency")]
    stored = "utility" in cells.columns
    narrow = cells.drop("utility_rank") if stored else cells.withColumn("utility", F.round(future_utility(), 12)).select(*read, "utility")
    batch = [] if batch_size is None else [F.floor(F.col("task_pos") / max(1, batch_size))]
    return global_rank(narrow, [*batch, F.col("utility"), F.col("pos"), F.col("task_pos")], "utility_rank", stored=stored)


def future_utility() -> Column:
    match = F.lit(0.55) * F.col("label_match") + F.lit(0.45) * F.col("template_match")
    value = (
        F.lit(0.5) * F.col("final_reward") + F.lit(0.35) * F.col("success").cast("double")
        + F.lit(0.15) * F.col("efficiency")
    )
    return match * value - F.lit(0.08) * saturating_cost(F.col("token_cost"))


def offline_pue(use_cost: bool = True, use_recent: bool = True, use_similarity: bool = True) -> Column:
    """Offline score: no deployment terms, unlike live retrieval."""
    zero = F.lit(0.0)
    return (
        F.lit(1.2) * (F.col("recent_success_rate") if use_recent else zero)
        + F.lit(0.9) * F.col("avg_reward") + F.lit(0.6) * F.col("coverage")
        + F.lit(0.4) * (F.col("recent_reward_lift") if use_recent else zero)
        + F.lit(0.3) * F.least(F.lit(1.0), F.col("support") / 20.0)
        - F.lit(0.8) * F.col("failure_rate")
        - F.lit(0.5) * (saturating_cost(F.col("token_cost")) if use_cost else zero)
        + F.lit(0.5) * (F.col("text_match") if use_similarity else zero)
    )


SELECTORS: dict[str, Callable[[], Column]] = {
    "frequency": lambda: F.col("support").cast("double"),
    "success_rate": lambda: F.col("success_rate"),
    "similarity": lambda: F.col("text_match"),
    "recent_reward_lift": lambda: F.col("recent_reward_lift"),
    "pue_no_cost": lambda: offline_pue(use_cost=False),
    "pue_no_recent": lambda: offline_pue(use_recent=False),
    "pue_no_similarity": lambda: offline_pue(use_similarity=False),
    "pue_full": offline_pue,
}
ALIASES = {"pue": "pue_full"}


def selector_scores(grid: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``selector, task_id, task_pos, pos, skill_id, score, utility, token_cost`` for every cell."""
    names = names or list(SELECTORS)
    for name in names:
        if ALIASES.get(name, name) not in SELECTORS:
            raise ValueError(f"unknown selector: {name}")
    # cells equal to twelve digits tie, so that summation order cannot decide a rank
    entries = F.array(*[
        F.struct(F.lit(n).alias("selector"), F.round(SELECTORS[ALIASES.get(n, n)](), 12).alias("score")) for n in names
    ])
    ranked = "utility_rank" in grid.columns
    utility = [F.col("utility"), F.col("utility_rank")] if ranked else [F.round(future_utility(), 12).alias("utility")]
    return grid.select(
        "task_id", "task_pos", "pos", "skill_id", *utility, F.col("token_cost").cast("double").alias("token_cost"), F.inline(entries),
    )


def with_ranks(scores: DataFrame, groups: list[str], average_ties: bool = False) -> DataFrame:
    """Add ``score_rank`` and ``utility_rank``, contiguous inside each group.

    Ranks come from range partitioning, whose keys include the tie columns, so
    a selector that scores every cell alike spreads as well as any other. They
    start at a group-specific offset, which no correlation sees.
    """
    ties = [F.col("pos"), F.col("task_pos")]
    ranked = scores
    for value in ("score", "utility"):
        ranked = global_rank(ranked, [*[F.col(g) for g in groups], F.col(value), *ties], f"{value}_rank")
        if average_ties:
            means = ranked.groupBy(*groups, value).agg(F.avg(f"{value}_rank").alias("_mean"))
            ranked = lookup_join(ranked, means, [*groups, value]).withColumn(f"{value}_rank", F.col("_mean")).drop("_mean")
    return ranked


def rank_metrics(ranked: DataFrame, groups: list[str]) -> DataFrame:
    """Pearson, Spearman and AUC per group, all from one partial aggregate."""
    positive = F.col("utility") > 0
    p = F.count(F.when(positive, 1)).cast("double")
    n = F.count(F.lit(1)).cast("double") - p
    offset = F.min("score_rank")
    rank_sum = F.coalesce(F.sum(F.when(positive, F.col("score_rank"))), F.lit(0)) - p * offset + p
    auc = F.coalesce(F.try_divide(rank_sum - p * (p + 1) / 2, p * n), F.lit(0.0))
    return ranked.groupBy(*groups).agg(
        correlation(F.col("score"), F.col("utility")).alias("future_utility_pearson"),
        correlation(F.col("score_rank").cast("double"), F.col("utility_rank").cast("double")).alias("future_utility_spearman"),
        auc.alias("positive_utility_auc"),
    )


def sorted_metrics(scores: DataFrame, groups: list[str]) -> DataFrame:
    """As ``rank_metrics`` of ``with_ranks``, for scores that carry ``utility_rank``: one sort, nothing stored.

    A row's score rank is its place in its sorted partition plus what comes before. Both ranks enter sums only, so
    every partition adds up its own part per group, and the offsets are put in on those few sums.
    """
    order = [*[F.col(g) for g in groups], F.col("score"), F.col("pos"), F.col("task_pos")]
    placed = scores.select(*groups, "score", "utility", "utility_rank", "pos", "task_pos").repartitionByRange(*order).sortWithinPartitions(*order)
    slot = F.monotonically_increasing_id()
    placed = placed.select(
        *groups, "score", "utility", F.shiftright(slot, 33).alias("_part"), slot.bitwiseAND(F.lit((1 << 33) - 1)).alias("_slot"), "utility_rank")
    x, y, u, v = F.col("score"), F.col("utility"), F.col("_slot").cast("double"), F.col("utility_rank").cast("double")
    positive = F.col("utility") > 0
    part = checkpoint(placed.groupBy(*groups, "_part").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(positive, 1)).alias("p"), F.min("_slot").alias("first"),
        F.sum(u).alias("su"), F.sum(F.when(positive, u)).alias("pu"), F.sum(v).alias("sv"),
        F.sum(u * v).alias("uv"), F.min(x).alias("lx"), F.max(x).alias("hx"), F.min(y).alias("ly"), F.max(y).alias("hy"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    n, start = F.col("n").cast("double"), F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    shifted = part.withColumn("o", start.cast("double")).withColumn("u", F.col("su") + F.col("o") * n).withColumn("uv", F.col("uv") + F.col("o") * F.col("sv")).withColumn(
        "pu", F.coalesce("pu", F.lit(0.0)) + F.col("o") * F.col("p"))
    every = Window.partitionBy(*groups)
    gx, gy = (F.sum(F.col(m) * n).over(every) / F.sum(n).over(every) for m in ("mx", "my"))
    dx, dy = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")
    sums = shifted.withColumns({"gx": gx, "gy": gy}).groupBy(*groups).agg(
        F.sum(n).alias("n"), F.sum("p").cast("double").alias("p"), F.sum("u").alias("u"), F.sum("pu").alias("pu"), F.sum("sv").alias("v"),
        F.sum("uv").alias("uv"), (F.min("lx") == F.max("hx")).alias("flat_x"), (F.min("ly") == F.max("hy")).alias("flat_y"),
        F.sum(n * (F.col("cxy") + dx * dy)).alias("sxy"), F.sum(n * (F.col("vx") + dx * dx)).alias("sxx"), F.sum(n * (F.col("vy") + dy * dy)).alias("syy"))
    n, p = F.col("n"), F.col("p")
    spread = n * (n * n - 1) / 12  # of ranks 0 to n - 1
    pearson = F.when(F.col("flat_x") | F.col("flat_y"), 0.0).otherwise(F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))))
    rank_sum = F.col("pu") + p
    return sums.select(
        *groups, F.coalesce(pearson, F.lit(0.0)).alias("future_utility_pearson"),
        F.coalesce(F.try_divide(F.col("uv") - F.col("u") * F.col("v") / n, spread), F.lit(0.0)).alias("future_utility_spearman"),
        F.coalesce(F.try_divide(rank_sum - p * (p + 1) / 2, p * (n - p)), F.lit(0.0)).alias("positive_utility_auc"))


def _ranked_metrics(scores: DataFrame, groups: list[str], average_ties: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scores for further passes, and their rank metrics."""
    if "utility_rank" in scores.columns and not average_ties:
        return scores, sorted_metrics(scores, groups)
    stored = checkpoint(scores)
    return stored, rank_metrics(with_ranks(stored, groups, average_ties), groups)


def chosen(scores: DataFrame, value: str, k: int) -> DataFrame:
    """The k best skills per (selector, task); k is cut to the library size by itself."""
    return top_rows(scores, ["selector", "task_pos"], [F.desc(value), F.asc("pos")], max(1, k))


def selection_metrics(scores: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Utility of the chosen skills, of the best possible choice, and the gap."""
    keys = list(dict.fromkeys([*groups, "selector", "task_pos"]))
    mine = chosen(scores, "score", k).groupBy(*keys).agg(
        F.avg("utility").alias("_mine"), F.avg("token_cost").alias("_cost"))
    best = chosen(scores, "utility", k).groupBy(*keys).agg(F.avg("utility").alias("_best"))
    return mine.join(best, keys).groupBy(*groups).agg(
        F.avg("_mine").alias("avg_selected_utility"),
        F.avg("_best").alias("avg_oracle_utility"),
        F.avg(F.col("_best") - F.col("_mine")).alias("regret"),
        F.avg((F.col("_mine") > 0).cast("double")).alias("positive_selection_rate"),
        F.avg("_cost").alias("avg_selected_token_cost"),
    )


def selector_metrics(scores: DataFrame, k: int = 3, average_ties: bool = False) -> DataFrame:
    groups = ["selector"]
    stored, metrics = _ranked_metrics(scores, groups, average_ties)
    return metrics.join(selection_metrics(stored, groups, k), groups)


def with_batch(scores: DataFrame, batch_size: int) -> DataFrame:
    return scores.withColumn("batch_index", F.floor(F.col("task_pos") / max(1, batch_size)))


def batch_metrics(scores: DataFrame, batch_size: int = 10, k: int = 3) -> DataFrame:
    """The same metrics per batch of tasks; ranks restart inside the batch."""
    groups = ["selector", "batch_index"]
    stored, metrics = _ranked_metrics(with_batch(scores, batch_size), groups)
    spans = stored.groupBy(*groups).agg(
        F.min("task_pos").alias("task_start"), (F.max("task_pos") + 1).alias("task_end"),
        (F.max("task_pos") - F.min("task_pos") + 1).alias("task_count"))
    return (
        spans.join(metrics, groups)
        .join(selection_metrics(stored, groups, k), groups)
    )


def choice_listing(scores: DataFrame, k: int = 3) -> DataFrame:
    """Chosen skills per task and selector with score and utility."""
    return chosen(scores, "score", k).select("task_id", "selector", "rank", "skill_id", "score", "utility")
