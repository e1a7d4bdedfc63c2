"""Connected components by joins, after each task has contracted the links it holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.scale import checkpoint

PART_LINKS = 500_000


def _stars(edges: DataFrame) -> DataFrame:
    """Every node's neighbours hang on the smallest of them and itself. ``src, dst`` with ``src > dst`` in and out.

    Neighbours above a node move to the smallest id around it, then those below move to the smallest
    among themselves. Each half is one partial aggregate and one join of the edges with one row per node,
    which adaptive execution may split where a hub has many edges; the number of edges never grows.
    """
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    lowest = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("_low"))
    above = both.filter(F.col("dst") > F.col("src")).join(lowest, "src")
    large = checkpoint(above.select(F.col("dst").alias("src"), F.col("_low").alias("dst")).distinct())
    lowest = large.groupBy("src").agg(F.min("dst").alias("_low"))
    below = large.join(lowest, "src").filter(F.col("dst") != F.col("_low")).select(F.col("dst").alias("src"), F.col("_low").alias("dst"))
    return checkpoint(below.unionByName(lowest.select("src", F.col("_low").alias("dst"))).distinct())


def _linked(edges: DataFrame) -> DataFrame:
    """``id, component`` of the distinct edges ``src > dst``.

    Edges become stars in rounds of ``_stars``, until every node has one edge and no node is both
    ends; what is left names the component of each node.
    """
    while True:
        inner = edges.select("src").join(edges.select(F.col("dst").alias("src")), "src", "left_semi")
        several = edges.groupBy("src").count().filter("count > 1")
        if several.isEmpty() and inner.isEmpty():
            break
        edges = _stars(edges)
    roots = edges.select(F.col("dst").alias("id")).distinct()
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component")))


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, ascending, and the smallest id each reaches over them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    high, low = np.maximum(at[: len(a)], at[len(a) :]), np.minimum(at[: len(a)], at[len(a) :])
    root = np.arange(len(ids))
    while len(high):
        # every root hangs on the smallest root it is linked to, then every node on its last root
        np.minimum.at(root, high, low)
        while not np.array_equal(root, above := root[root]):
            root = above
        one, other = root[high], root[low]
        high, low = np.maximum(one, other), np.minimum(one, other)
        high, low = high[high != low], low[high != low]
    return ids, ids[root]


def _contracted(links: DataFrame, part_links: int) -> DataFrame:
    """``id, root`` of every node of every part of ``part_links`` links: the smallest id it reaches inside the part."""
    kind = links.schema["a"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")))
            rows += batch.num_rows
            if rows >= part_links:
                yield from stars(held)
                held, rows = [], 0
        yield from stars(held)

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            ids, root = _smallest(*(np.concatenate(side) for side in zip(*held)))
            for at in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + (1 << 16)]), pa.array(root[at : at + (1 << 16)])], names=["id", "root"])

    return links.select("a", "b").mapInArrow(parts, f"id {kind}, root {kind}")


def connected_components(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """Smallest reachable id for every linked id: ``id, component``.

    The ``a, b`` links are sorted by their upper end over the partitions, and every part of ``part_links`` links is contracted
    where it is. Only nodes that several parts hold under different roots link these roots further, so rounds of ``_stars``
    run on the links between parts; links without any order leave as many of them as there were.
    A node linked to itself only is its own.
    """
    ends = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null"))
    stars = checkpoint(_contracted(ends.repartitionByRange("a", "b").sortWithinPartitions("a", "b"), part_links))
    nodes = checkpoint(stars.groupBy("id").agg(F.min("root").alias("low"), F.max("root").alias("high")))
    shared = nodes.filter("low < high").select("id", "low")
    edges = checkpoint(stars.join(shared, "id").filter("root <> low").select(F.col("root").alias("src"), F.col("low").alias("dst")).distinct())
    if edges.isEmpty():
        return nodes.select("id", F.col("low").alias("component"))
    found = checkpoint(_linked(edges)).withColumnRenamed("id", "low")
    return nodes.join(found, "low", "left").select("id", F.coalesce("component", "low").alias("component"))
