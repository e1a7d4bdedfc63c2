"""Selector evaluation driver: mine on the earlier tasks, score on the later ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.model import Model
from stridemill.operators import selectors
from stridemill.scale import checkpoint


@dataclass
class Evaluation:
    """Result tables; ``metrics`` and the others are None when the miner found no skill.

    ``batches`` needs its own order of the cells, which is made when it is asked for.
    """

    split: dict[str, float]
    metrics: DataFrame | None = None
    by_batch: Callable[[], DataFrame | None] = lambda: None
    choices: DataFrame | None = None

    @cached_property
    def batches(self) -> DataFrame | None:
        return self.by_batch()


def evaluate_selectors(
    placed: DataFrame, segs: DataFrame, mine: Callable[[DataFrame], Model], names: list[str] | None = None,
    top_k: int = 3, batch_size: int = 10, future_ratio: float = 0.4,
) -> Evaluation:
    """``placed`` comes from ``split_tasks``; ``segs`` holds the segments of all tasks."""
    placed = checkpoint(placed)
    sizes = {r["future"]: r["count"] for r in placed.groupBy("future").count().collect()}
    if sum(sizes.values()) < 2:
        raise ValueError("selector evaluation needs at least two tasks")
    train = placed.filter(~F.col("future")).select(F.col("task_id").alias("trajectory_id"))
    train_segs = checkpoint(segs.join(train, "trajectory_id", "left_semi"))
    model = mine(train_segs)
    split = {
        "train_records": sizes.get(False, 0), "future_records": sizes.get(True, 0),
        "train_segments": train_segs.count(), "skill_count": model.skills.count(), "future_ratio": future_ratio,
    }
    if not split["skill_count"]:
        return Evaluation({**split, "train_segments": 0})
    future = placed.filter("future")
    later = segs.join(future.select(F.col("task_id").alias("trajectory_id")), "trajectory_id", "left_semi")
    cells = selectors.stored_cells(selectors.match_grid(future, model.skills, later))
    scores = selectors.selector_scores(cells, names)

    def by_batch() -> DataFrame:
        return selectors.batch_metrics(selectors.selector_scores(selectors.stored_cells(cells, batch_size), names), batch_size, top_k)

    return Evaluation(split, selectors.selector_metrics(scores, top_k), by_batch, selectors.choice_listing(scores, top_k))
