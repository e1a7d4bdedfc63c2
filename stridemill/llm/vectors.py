"""Near-duplicate skills by their embeddings: subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.batches import bound_batches, sorted_groups
from stridemill.llm.pairs import Links, block_pairs, meeting
from stridemill.llm.words import mixed
from stridemill.operators.components import connected_components
from stridemill.scale import checkpoint

BLOCKS = 8
GRID = 3
BLOCK_NODES = 1024
SLACK = 1e-9


@lru_cache(8)
def rotation(size: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))[0]


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # keeps squares of very small and large components in range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def subspaces(size: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """Ranges of dimensions, as even as can be."""
    cuts = np.linspace(0, size, min(blocks, size) + 1).round().astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def budgets(size: int, cosine: float) -> np.ndarray:
    """Squared distance each block may use: its share of the dimensions in the distance that ``cosine`` allows."""
    return np.array([(hi - lo) / size for lo, hi in subspaces(size)]) * (2 - 2 * cosine) + SLACK


def _corners(rotated: np.ndarray, block: int, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest grid cell, per leading dimension of a block, that a box of one radius around a point meets."""
    lo, hi = subspaces(rotated.shape[1])[block]
    lead = rotated[:, lo : min(lo + GRID, hi)]
    radius = np.sqrt(budget)
    width = 2 * radius
    return np.floor((lead - radius / 2) / width).astype(np.int64), np.floor((lead + radius / 2) / width).astype(np.int64)


def _cell(block: int, corner: np.ndarray) -> np.ndarray:
    key = np.full(len(corner), block + 1, np.uint64)
    for column in corner.T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return key.view(np.int64)


def cells(vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, blocks and cells of unit vectors: two vectors within a block's budget share a cell of that block."""
    rotated = vectors @ rotation(vectors.shape[1])
    rows, at, keys = [], [], []
    for b, budget in enumerate(budgets(vectors.shape[1], cosine)):
        low, high = _corners(rotated, b, budget)
        for mask in range(1 << low.shape[1]):
            bits = np.array([mask >> k & 1 for k in range(low.shape[1])], bool)
            use = np.all(~bits | (high > low), axis=1)
            rows.append(np.flatnonzero(use))
            at.append(np.full(int(use.sum()), b, np.int32))
            keys.append(_cell(b, np.where(bits, high[use], low[use])))
    return np.concatenate(rows), np.concatenate(at), np.concatenate(keys)


def owned_pairs(vectors: np.ndarray, own: np.ndarray, block: int, cell: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell with the cosine, left out where an earlier block or another cell finds them too."""
    u = units(vectors)
    rotated = u @ rotation(u.shape[1])
    limits = budgets(u.shape[1], cosine)
    ranges = subspaces(u.shape[1])
    lo, hi = ranges[block]
    part = rotated[:, lo:hi]
    square = (part * part).sum(1)
    apart = square[:, None] + square[None, :] - 2 * part @ part.T
    a, b = np.nonzero(own & (apart <= limits[block] + SLACK))
    if not len(a):
        return a, b
    exact = np.empty(len(a))
    for s in range(0, len(a), 65536):
        exact[s : s + 65536] = np.einsum("ij,ij->i", u[a[s : s + 65536]], u[b[s : s + 65536]])
    a, b = a[exact >= cosine], b[exact >= cosine]
    if not len(a):
        return a, b
    first = np.ones(len(a), bool)
    for other in range(block + 1):
        x, y = ranges[other]
        near = np.empty(len(a), bool)
        for s in range(0, len(a), 65536):
            gap = rotated[a[s : s + 65536], x:y] - rotated[b[s : s + 65536], x:y]
            near[s : s + 65536] = (gap * gap).sum(1) <= limits[other]
        first &= near if other == block else ~near
    low, _ = _corners(rotated, block, limits[block])
    first &= _cell(block, np.maximum(low[a], low[b])) == cell
    return a[first], b[first]


def link_skills(skills: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per skill: ``skill_id, n_links, component_id, kept``.

    In: ``skill_id, embedding, granularity``. Skills of equal, non-null granularity are linked when their
    embeddings' cosine in double precision is ``cosine`` or more; embeddings that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do embeddings of different length.
    ``n_links`` counts the other skills linked directly, ``component_id`` is the smallest id reachable by
    links (its own without any), ``kept`` marks the skill with that id.

    Equal embeddings are one class. Unit vectors are rotated and cut into ``BLOCKS`` blocks: if two are
    within the distance that the cosine allows, at least one block is within its share of it. A grid over
    the leading dimensions of every block brings such pairs into one cell; there the block's distance and
    then the cosine are computed, and each link is counted in the first block and cell that find it. Hot
    cells are cut into block pairs; no pair is written. Extra columns are not carried.
    """
    spark = skills.sparkSession
    bound_batches(spark, 4096)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = (
        F.col("granularity").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", number)
        & F.exists("embedding", lambda x: x != 0)
    )
    keyed = checkpoint(
        skills.select("skill_id", "granularity", "embedding", F.coalesce(usable, F.lit(False)).alias("_usable"))
        .withColumns({"_a": F.xxhash64("embedding"), "_b": F.hash("embedding")})
    )
    classes = checkpoint(
        keyed.filter("_usable").groupBy("granularity", "_a", "_b").agg(
            F.min("skill_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
        ).withColumn("node", F.monotonically_increasing_id())
    )

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length = frame["embedding"].map(len).to_numpy()
            for size in np.unique(length):
                group = frame[length == size]
                rows, block, key = cells(units(np.stack(group["embedding"])), cosine)
                yield pd.DataFrame({
                    "node": group["node"].to_numpy()[rows], "size": int(size), "block": block, "cell": key,
                    "_label": group["_label"].to_numpy()[rows],
                })

    label = F.xxhash64("granularity").alias("_label")
    grid = checkpoint(
        classes.select("node", "embedding", label).mapInPandas(placed, "node long, size int, block int, cell long, _label long")
    )
    keys = ["_label", "size", "block", "cell"]
    crowded = grid.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    meet = block_pairs(grid.join(crowded, keys), "node", F.ceil(F.col("_n") / BLOCK_NODES)).drop("_n")
    group_keys = [*keys, "_i", "_j"]

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links = Links()
        for group in sorted_groups(frames, group_keys):
            if len(group["node"]) < 2:
                continue
            a, b = owned_pairs(np.stack(group["embedding"]), meeting(group), int(group["block"][0]), int(group["cell"][0]), cosine)
            if len(a):
                links.add(group["node"], group["copies"], a, b)
            if links.rows >= 100_000:
                yield links.take()
        yield links.take()

    links = checkpoint(
        meet.join(classes.select("node", "embedding", "copies"), "node")
        .repartition(*group_keys).sortWithinPartitions(*group_keys)
        .mapInPandas(linked, "node long, links long, root long")
    )
    joined = connected_components(links.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    counts = links.groupBy("node").agg(F.sum("links").alias("_links"))
    told = (
        classes.drop("embedding").join(joined.withColumnRenamed("id", "node"), "node", "left").join(counts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = told.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = told.join(smallest, "component").select(
        "granularity", "_a", "_b", "component_id", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_total")
    )
    out = keyed.drop("embedding").withColumn("granularity", F.when(F.col("_usable"), F.col("granularity"))).join(told, ["granularity", "_a", "_b"], "left")
    component = F.when(F.col("_usable"), F.col("component_id")).otherwise(F.col("skill_id"))
    return out.select(
        "skill_id", F.coalesce("_total", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("skill_id").eqNullSafe(component).alias("kept"),
    )
