"""Helpers the Arrow-backed operators share: bounded batches, text slices, sorted group streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

BATCH_ROWS = 256
SLICE_CHARS = 1 << 17


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send at most ``rows`` rows at a time to Python, so that long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def sorted_groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of a partition sorted by ``keys``, each as arrays by column. The caller's keys bound a group's size."""
    held: list[dict[str, np.ndarray]] = []
    last = None

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for frame in frames:
        if not len(frame):
            continue
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        change = np.zeros(len(frame), bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(frame)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(columns[k][lo] for k in keys)
            if held and key != last:
                yield whole()
                held = []
            held.append({c: v[lo:hi] for c, v in columns.items()})
            last = key
    if held:
        yield whole()
