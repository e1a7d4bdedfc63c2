"""Near-duplicate segments: n-gram Jaccard join with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm import words
from stridemill.llm.batches import bound_batches, sorted_groups, text_slices
from stridemill.llm.pairs import Links, block_pairs, meeting
from stridemill.operators.components import connected_components
from stridemill.scale import broadcast_if_small, checkpoint

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 22, 3
STEP = 11
TOLERANCE = 1e-5
BLOCK_NODES = 512
BLOCK_BYTES = 8 << 20

_RNG = np.random.default_rng(11)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word windows of each text; a shorter text is one window of all its words."""
    s = words.tabulate(texts)
    at, hashes = s.windows(n)
    lo, hi = np.searchsorted(at, s.first), np.searchsorted(at, s.last)
    out = []
    for first, last, a, b in zip(s.first, s.last, lo, hi, strict=True):
        if last - first >= n:
            out.append(np.unique(hashes[a:b]))
        elif last > first:
            out.append(s.word_hash.ranges(np.array([first]), np.array([last])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each set and its MinHash values (0 for empty sets)."""
    keys, signature = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), BANDS * ROWS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        keys[full, 0] = np.add.reduceat(words.mixed(flat), starts)
        keys[full, 1] = np.add.reduceat(words.mixed(flat ^ np.uint64(0x5DEECE66D)), starts)
        for k in range(BANDS * ROWS):
            signature[full, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts) >> np.uint64(32)
    return keys.view(np.int64), np.array([len(s) for s in sets], np.int64), signature


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """After how many compared values how many must match to go on.

    With an even prior the similarity of a pair with m of n equal values has a Beta(m + 1, n - m + 1)
    posterior; its chance to reach ``threshold`` is a binomial sum. Pairs below ``tolerance`` are dropped.
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        reach = lambda m: sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))  # noqa: E731, B023
        out.append((n, next(m for m in range(n + 1) if reach(m) >= tolerance)))
    return out


def surviving(signature: np.ndarray, a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the Bayesian test keeps, values compared ``STEP`` at a time."""
    matches, done = np.zeros(len(a), np.int64), 0
    for n, least in limits:
        matches += (signature[a, done:n] == signature[b, done:n]).sum(1)
        keep = matches >= least
        a, b, matches, done = a[keep], b[keep], matches[keep], n
    return a, b


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning links of the pairs that survive in each bucket."""
    limits = least_matches()
    links = Links()

    def told() -> pd.DataFrame:
        found = links.take()
        return found.loc[found["node"] != found["root"], ["node", "root"]].drop_duplicates()

    for group in sorted_groups(frames, ["bucket", "_i", "_j"]):
        nodes = group["node"]
        if len(nodes) < 2:
            continue
        signature = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(len(nodes), -1)
        pairs = np.nonzero(meeting(group)) if len(nodes) > 2 else (np.zeros(1, int), np.ones(1, int))
        a, b = surviving(signature, *pairs, limits)
        if len(a):
            links.add(nodes, np.ones(len(nodes), np.int64), a, b)
        if links.rows >= 100_000:
            yield told()
    yield told()


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of bounded slices of the incidence matrix."""
    sizes = [len(s) for s in sets]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    use = shared[inverse]
    owner, column = owner[use], place[inverse[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), columns):
        x, y = np.searchsorted(column, [lo, lo + columns])
        block = np.zeros((len(sets), min(columns, int(shared.sum()) - lo)), np.float32)
        block[owner[x:y], column[x:y] - lo] = 1
        total += block @ block.T
    return total.round().astype(np.int64)


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact links inside each block pair of a candidate component."""
    links = Links()
    for group in sorted_groups(frames, ["component", "_i", "_j"]):
        texts = group["text"].tolist()
        if len(texts) < 2:
            continue
        sets = [s for lo, hi in text_slices(texts) for s in shingle_sets(texts[lo:hi])]
        sizes = np.array([len(s) for s in sets])
        common = overlaps(sets)
        # common / union >= 4 / 5 in whole numbers, for THRESHOLD = 0.8
        near = common * 1000 >= round(THRESHOLD * 1000) * (sizes[:, None] + sizes[None, :] - common)
        a, b = np.nonzero(near & meeting(group))
        if len(a):
            links.add(group["node"], group["copies"], a, b)
        if links.rows >= 100_000:
            yield links.take()
    yield links.take()


def join_segments(segments: DataFrame) -> DataFrame:
    """One row per segment: ``segment_id, n_links, component_id, kept``.

    Two segments are linked when the Jaccard similarity of their sets of five-word windows is 0.8 or
    more; words are runs without ASCII white space, case counts, and a text of fewer than five words has one
    window of all its words. Texts with the same set are linked as copies; texts without words
    (null, empty) link with nothing. ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id reachable by links and ``kept`` marks the segment with that id.

    Segments with equal sets form a class and are compared once. Classes that share a MinHash band meet in a
    bucket, where pairs are dropped as soon as the posterior chance of reaching 0.8 falls below
    ``TOLERANCE``; what is left is joined to candidate components, whose pairs are verified exactly. With
    22 bands of 3 values a pair at 0.8 is missed with probability 7e-7. Neither step writes pairs: a group tells
    link counts and a spanning forest. Hot buckets and components are cut into block pairs, so the work
    for a group of different near copies is quadratic, as its count of links is, but no task is.
    Repeated ids are rows of their own; extra columns are not carried. The texts are checkpointed under a row number,
    and each class ships the text of its first row, however often that row's id is used.
    """
    spark = segments.sparkSession
    bound_batches(spark)
    texts = checkpoint(segments.select("segment_id", "text").withColumn("_row", F.monotonically_increasing_id()))

    @F.pandas_udf("key_a long, key_b long, shingles long, signature binary")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ["" if t is None else t for t in batch]
            parts = [sketches(shingle_sets(rows[lo:hi])) for lo, hi in text_slices(rows)]
            keys, sizes, signature = (np.concatenate([p[i] for p in parts]) for i in range(3))
            yield pd.DataFrame({"key_a": keys[:, 0], "key_b": keys[:, 1], "shingles": sizes, "signature": [s.tobytes() for s in signature]})

    sketch = checkpoint(
        texts.select("segment_id", "_row", F.octet_length("text").alias("bytes"), sketched("text").alias("s"))
        .select("segment_id", "_row", "bytes", "s.*")
    )
    classes = checkpoint(
        sketch.filter("shingles > 0").groupBy("key_a", "key_b").agg(
            F.min("segment_id").alias("rep"), F.min("_row").alias("_row"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"),
            F.first("signature").alias("signature"),
        ).withColumn("node", F.monotonically_increasing_id())
    )

    @F.pandas_udf("array<long>")
    def banded(signatures: pd.Series) -> pd.Series:
        if not len(signatures):
            return pd.Series([], dtype=object)
        values = np.stack([np.frombuffer(s, np.uint32) for s in signatures]).astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2])
        for r in range(ROWS):
            key = words.mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
        return pd.Series(list(key.view(np.int64)))

    bands = checkpoint(classes.select("node", F.explode(banded("signature")).alias("bucket")))
    crowded = bands.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1")
    meet = block_pairs(bands.join(crowded, "bucket"), "node", F.ceil(F.col("_n") / BLOCK_NODES)).drop("_n")
    keys = ["bucket", "_i", "_j"]
    near = (
        meet.join(classes.select("node", "signature"), "node")
        .repartition(*keys).sortWithinPartitions(*keys)
        .mapInPandas(_candidates, "node long, root long").distinct()
    )
    components = connected_components(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = checkpoint(
        components.withColumnRenamed("id", "node").join(classes.select("node", "_row", "copies", "bytes"), "node")
    )
    sizes = members.groupBy("component").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("bytes") / BLOCK_BYTES)).alias("_wanted")
    )
    cut = checkpoint(block_pairs(members.join(sizes, "component"), "node", F.col("_wanted")).drop("_wanted", "bytes"))
    few, _ = broadcast_if_small(cut, 80)
    keys = ["component", "_i", "_j"]
    links = checkpoint(
        texts.filter("text is not null").select("_row", "text").join(few, "_row").drop("_row")
        .repartition(*keys).sortWithinPartitions(*keys)
        .mapInPandas(_verified, "node long, links long, root long")
    )
    joined = connected_components(links.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    counts = links.groupBy("node").agg(F.sum("links").alias("_links"))
    told = (
        classes.drop("signature", "bytes", "_row").join(joined.withColumnRenamed("id", "node"), "node", "left").join(counts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = told.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = told.join(smallest, "component").select(
        "key_a", "key_b", "component_id", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = sketch.select("segment_id", "key_a", "key_b", "shingles").join(told, ["key_a", "key_b"], "left")
    empty = F.col("shingles") == 0
    component = F.when(empty, F.col("segment_id")).otherwise(F.col("component_id"))
    return out.select(
        "segment_id", F.when(empty, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("segment_id").eqNullSafe(component).alias("kept"),
    )
