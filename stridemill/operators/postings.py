"""Skill similarities in one pass over the tasks: an inverted index with block maxima, or unit vectors with cell bounds.

Skills are cut into blocks of ``BLOCK``. The index of a library slice is an array per block, bounded by ``INDEX_BYTES`` and held by
every task; a larger library is read in several slices. For the best few skills a block's bound, its largest static score plus
the most that a similarity can add, is compared with each task's k-th score so far, blocks with large bounds first, and
only tasks that a block can still change compute its similarities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.scale import checkpoint

BLOCK = 64
INDEX_BYTES = 64 * 1024 * 1024
CELLS = 1 << 20
TIE = 1e-8


@dataclass(frozen=True)
class Terms:
    """Token counts of a batch of texts: known tokens by row, and the length of every row's whole vector."""

    row: np.ndarray
    token: np.ndarray
    count: np.ndarray
    length: np.ndarray

    def of(self, rows: np.ndarray) -> Terms:
        """The same for some rows, in ascending order."""
        place = np.full(len(self.length), -1)
        place[rows] = np.arange(len(rows))
        keep = place[self.row] >= 0
        return Terms(place[self.row[keep]], self.token[keep], self.count[keep], self.length[rows])

    def product(self, table: np.ndarray, local: np.ndarray | None = None) -> np.ndarray:
        """Sums of ``count * table[token]`` over every row, divided by the row's length."""
        token = self.token if local is None else local[self.token]
        out = np.zeros((len(self.length), table.shape[1]))
        if len(token):
            starts = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]])
            out[self.row[starts]] = np.add.reduceat(self.count[:, None] * table[token], starts)
        return out / np.maximum(self.length, 1e-12)[:, None]


class TextSide:
    """Token weights of one library slice by block."""

    def __init__(self, pos: np.ndarray, tokens: pa.Array, owner: np.ndarray, weight: np.ndarray, blocks: list[np.ndarray]):
        self.vocabulary = pc.unique(tokens)
        code = pc.index_in(tokens, value_set=self.vocabulary).to_numpy()
        size = len(self.vocabulary)
        where = {int(p): (b, i) for b, members in enumerate(blocks) for i, p in enumerate(pos[members])}
        at = np.array([where[int(p)] for p in owner]).reshape(-1, 2)
        self.tables, self.local = [], []
        self.peaks = np.zeros((size, len(blocks)))
        order = np.argsort(at[:, 0], kind="stable")
        cuts = np.searchsorted(at[order, 0], np.arange(len(blocks) + 1))
        for b, members in enumerate(blocks):
            mine = order[cuts[b] : cuts[b + 1]]
            own = np.unique(code[mine])
            local = np.full(size, len(own), np.int32)
            local[own] = np.arange(len(own))
            table = np.zeros((len(own) + 1, len(members)))
            np.add.at(table, (local[code[mine]], at[mine, 1]), weight[mine])
            self.tables.append(table)
            self.local.append(local)
            self.peaks[own, b] = table[:-1].max(axis=1)

    def features(self, column: pa.Array, counts: pa.Array | None = None, length: np.ndarray | None = None) -> Terms:
        """From token lists; with ``counts`` every token is listed once and ``length`` covers unlisted ones too."""
        offsets = column.offsets.to_numpy()
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        flat = column.flatten()
        if counts is None:
            coded = flat.dictionary_encode()
            codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            keys, number = np.unique(row * max(1, len(names)) + codes, return_counts=True)
            row, codes, count = keys // max(1, len(names)), keys % max(1, len(names)), number.astype(np.float64)
            length = np.sqrt(np.bincount(row, count * count, len(column)))
            token = pc.index_in(names, value_set=self.vocabulary).fill_null(-1).to_numpy()[codes] if len(names) else codes
        else:
            count = np.asarray(counts.flatten().to_numpy(zero_copy_only=False), np.float64)
            token = pc.index_in(flat, value_set=self.vocabulary).fill_null(-1).to_numpy()
        known = token >= 0
        return Terms(row[known], token[known], count[known], length)

    def most(self, features: Terms) -> np.ndarray:
        """Upper bound of the similarity of every row with any skill of every block."""
        return np.minimum(features.product(self.peaks), 1.0)

    def sims(self, features: Terms, block: int) -> np.ndarray:
        return features.product(self.tables[block], self.local[block])


class VectorSide:
    """Unit vectors of one library slice by block, with a centre and a radius per block."""

    def __init__(self, vectors: np.ndarray, blocks: list[np.ndarray]):
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        self.parts = [unit[members] for members in blocks]
        centres = np.stack([p.mean(axis=0) for p in self.parts])
        self.centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        self.radius = np.array([np.arccos(np.clip((p @ c).min(), -1, 1)) for p, c in zip(self.parts, self.centres, strict=True)])
        # a zero vector has no angle: such a block is never ruled out
        self.radius[[not (p.any(axis=1).all() and c.any()) for p, c in zip(self.parts, self.centres, strict=True)]] = np.pi

    def features(self, column: pa.Array) -> np.ndarray:
        rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def most(self, features: np.ndarray) -> np.ndarray:
        angle = np.arccos(np.clip(features @ self.centres.T, -1, 1))
        return np.cos(np.maximum(angle - self.radius - 1e-7, 0.0))

    def sims(self, features: np.ndarray, block: int) -> np.ndarray:
        return features @ self.parts[block].T


@dataclass(frozen=True)
class Slice:
    """Skills of a slice in blocks that share a level; scores are ``base + slope * similarity``."""

    pos: np.ndarray
    level: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    blocks: list[np.ndarray]

    @classmethod
    def of(cls, pos: np.ndarray, level: np.ndarray, base: np.ndarray, slope: np.ndarray, size: int = BLOCK) -> Slice:
        """Inside a level, skills that may score high come first, so that the k-th score rises early."""
        blocks = []
        for name in sorted(set(level.tolist()), key=str):
            mine = np.flatnonzero(level == name)
            mine = mine[np.lexsort((pos[mine], -(base + np.maximum(slope, 0))[mine]))]
            blocks += [mine[i : i + size] for i in range(0, len(mine), size)]
        return cls(pos, level, base, slope, blocks)

    def best(self, side, features, rows: int, limits: list[tuple[set | None, int]]) -> dict[str, np.ndarray]:
        """Best skills of every row, per group of levels with its limit: row, skill, similarity, score, rank."""
        most = side.most(features) if self.blocks else np.zeros((rows, 0))
        found: dict[str, list[np.ndarray]] = {name: [] for name in ("row", "skill", "sim", "score", "rank")}
        for levels, k in limits:
            mine = [b for b, m in enumerate(self.blocks) if levels is None or self.level[m[0]] in levels]
            if not mine or k <= 0:
                continue
            top = {"score": np.full((rows, k), -np.inf), "skill": np.full((rows, k), -1), "sim": np.zeros((rows, k))}
            places = np.append(self.pos, np.iinfo(np.int64).max)
            gain = [max(float(self.slope[self.blocks[b]].max()), 0.0) for b in mine]
            loss = [max(float(-self.slope[self.blocks[b]].min()), 0.0) for b in mine]
            bound = np.stack([self.base[self.blocks[b]].max() + g * most[:, b] + n for b, g, n in zip(mine, gain, loss, strict=True)])
            for i in np.argsort(-bound.max(axis=1, initial=-np.inf), kind="stable") if rows else []:
                open_ = np.flatnonzero(bound[i] > top["score"][:, -1] - TIE)
                if not len(open_):
                    continue
                members = self.blocks[mine[i]]
                part = features if len(open_) == rows else features.of(open_) if isinstance(features, Terms) else features[open_]
                sims = side.sims(part, mine[i])
                score = np.concatenate([top["score"][open_], self.base[members] + self.slope[members] * sims], axis=1)
                skill = np.concatenate([top["skill"][open_], np.broadcast_to(members, sims.shape)], axis=1)
                sim = np.concatenate([top["sim"][open_], sims], axis=1)
                order = np.lexsort((places[skill], -np.round(score, 9)), axis=1)[:, :k]
                for name, values in (("score", score), ("skill", skill), ("sim", sim)):
                    top[name][open_] = np.take_along_axis(values, order, axis=1)
            row, rank = np.nonzero(top["skill"] >= 0)
            found["row"].append(row)
            found["rank"].append(rank + 1)
            for name in ("skill", "sim", "score"):
                found[name].append(top[name][row, rank])
        return {name: np.concatenate(v) if v else np.zeros(0, np.int64) for name, v in found.items()}


def slice_ranges(weights: DataFrame, limit: int = INDEX_BYTES, block: int = BLOCK) -> list[tuple[int, int]]:
    """Ranges of skill positions whose index stays below ``limit`` bytes, from ``pos, bytes`` per skill."""
    sums = weights.groupBy(F.floor(F.col("pos") / block).alias("b")).agg(F.sum("bytes").alias("n")).collect()
    ranges, start, used = [], None, 0
    for b, n in sorted((r["b"], r["n"]) for r in sums):
        if start is not None and used + n > limit:
            ranges.append((start, b * block - 1))
            start, used = None, 0
        start = b * block if start is None else start
        used += n
    return [*ranges, (start, max(r["b"] for r in sums) * block + block - 1)] if sums else []


def text_side(terms: DataFrame, pos: np.ndarray, blocks: list[np.ndarray]) -> TextSide:
    """From ``pos, token, w`` of a slice, which ``slice_ranges`` has sized."""
    table = terms.filter(F.col("token").isNotNull()).select("pos", "token", "w").toArrow()
    tokens = table["token"].combine_chunks() if len(table) else pa.array([], pa.string())
    return TextSide(pos, tokens, table["pos"].to_numpy(), table["w"].to_numpy(), blocks)


def term_bytes(terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """Bytes each skill adds to the index at most: a row of its block's array per token."""
    return terms.groupBy("pos").agg((F.count("token") * 8 * block + 64).alias("bytes"))


def grid(
    tasks: DataFrame, sides: dict[str, tuple[TextSide, Slice]], carried: list[str], skill_columns: dict[str, pa.Array], schema: str,
) -> DataFrame:
    """Every (task, skill) cell of a slice with one similarity per side.

    ``tasks`` has ``carried`` and, per side, ``<side>_tokens``; optionally ``<side>_counts`` and ``<side>_length``. All sides list the
    same skills in the same order.
    """
    some = next(iter(sides.values()))[1]
    order = np.concatenate(some.blocks)
    fields = set(tasks.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // len(order))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.num_rows
                out = {name: part.column(name).take(pa.array(np.repeat(np.arange(n), len(order)))) for name in carried}
                out |= {name: values.take(pa.array(np.tile(order, n))) for name, values in skill_columns.items()}
                for name, (side, _) in sides.items():
                    column = pa.concat_arrays([part.column(f"{name}_tokens")])
                    if f"{name}_counts" in fields:
                        length = part.column(f"{name}_length").to_numpy(zero_copy_only=False)
                        features = side.features(column, pa.concat_arrays([part.column(f"{name}_counts")]), length)
                    else:
                        features = side.features(column)
                    out[name] = pa.array(np.concatenate([side.sims(features, b) for b in range(len(some.blocks))], axis=1).ravel())
                yield pa.RecordBatch.from_pydict(out)

    return tasks.mapInArrow(run, schema)


def best_skills(
    tasks: DataFrame, keys: list[str], column: str, side, part: Slice, names: pa.Array, limits: list[tuple[set | None, int]],
) -> DataFrame:
    """Best skills of every task row: ``keys, rank, level, skill_id, pos, score, similarity``."""
    levels = pa.array(part.level.tolist(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = part.best(side, side.features(batch.column(column)), batch.num_rows, limits)
            skill = found["skill"]
            yield pa.RecordBatch.from_pydict({
                **{name: batch.column(name).take(pa.array(found["row"])) for name in keys},
                "rank": pa.array(found["rank"].astype(np.int32)), "level": levels.take(pa.array(skill)),
                "skill_id": names.take(pa.array(skill)), "pos": pa.array(part.pos[skill].astype(np.int64)),
                "score": pa.array(found["score"].astype(np.float64)), "similarity": pa.array(found["sim"].astype(np.float64)),
            })

    narrow = tasks.select(*keys, column)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name in keys)
    return narrow.mapInArrow(run, f"{fields}, rank int, level string, skill_id string, pos long, score double, similarity double")


def stored_if_read_twice(tasks: DataFrame, slices: int) -> DataFrame:
    return checkpoint(tasks) if slices > 1 else tasks
