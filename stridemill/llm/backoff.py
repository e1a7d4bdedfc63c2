"""Language-model scores of segment texts: smoothed n-grams as a weighted automaton with failure arcs.

The counts of all n-grams grow with the corpus and are never in one place. Texts are packed into batches of bounded
size. Every batch sends its distinct n-grams, as sorted hashes with their training counts, to hash ranges; a range adds
up what all batches sent and answers each of them in the order it asked. A batch then holds the counts of exactly the
n-grams it meets, builds their part of the automaton and reads its texts through it from left to right.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.llm import words
from stridemill.llm.batches import bound_batches
from stridemill.scale import checkpoint, checkpoint_alone

ORDER = 3
PRIOR = 0.5
BATCH_CHARS = 4_000_000
PIECE_CHARS = 1_000_000
SHARD_GRAMS = 2_000_000
SPARE_BITS = 24

_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_SPACE, _WORD = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")


def _shrink(raw: bytes, level: int) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _grow(body: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(body, decompressed_size=size, asbytes=True) if size else b""


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that high bytes that are zero cost nothing once compressed."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _values(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


@dataclass(frozen=True)
class Piece:
    """A text, or a part of one: ``lead`` words of context first. ``opens`` and ``closes`` mark a text's two ends."""

    text: str
    lead: int
    fresh: bool
    opens: bool
    closes: bool


def text_pieces(text: str, order: int, limit: int) -> Iterator[Piece]:
    """Cuts a long text at white space; a later piece repeats the ``order - 1`` words before it as context."""
    start, context = 0, []
    while True:
        cut = _SPACE.search(text, start + limit) if len(text) - start > limit else None
        end = cut.start() if cut else len(text)
        body = text[start:end]
        yield Piece(" ".join([*context, body]), len(context), len(context) < order - 1, start == 0, cut is None)
        if cut is None:
            return
        reach = 64
        while reach < len(body) and len(_WORD.findall(body[-reach:])) <= order:
            reach *= 4
        known = _WORD.findall(body[-reach:])
        context = [*context, *known[-order:]][-(order - 1) :] if order > 1 else []
        start = end


class Tokens:
    """Tokens of a batch of pieces in one sequence, and the hashes of the n-grams that end at each of them."""

    def __init__(self, raw: list[bytes], lead: np.ndarray, fresh: np.ndarray, opens: np.ndarray, closes: np.ndarray, train: np.ndarray, bits: int):
        table = words.tabulate_bytes(raw)
        counts = table.last - table.first
        sizes = counts + fresh + closes
        self.bits = bits
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        total = int(self.end[-1]) if len(sizes) else 0
        token = np.empty(total, np.uint64)
        token[np.repeat(self.start + fresh - table.first, counts) + np.arange(int(counts.sum()))] = table.hashes
        token[self.start[fresh]] = _START
        token[self.end[closes] - 1] = _END
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.body = self.start + fresh + lead
        self.place = np.arange(total) - self.start[self.owner]
        self.scored = self.place >= (fresh + lead)[self.owner]
        mark = np.zeros(total, bool)
        mark[self.start[fresh & opens]] = True
        self.weight = train[self.owner] & (self.scored | mark)
        self.token, self.rolling = token, words.Rolling(token)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of ``k + 1`` tokens end, and their hashes; none begins before its piece."""
        ends = np.flatnonzero(self.place >= k)
        return ends, self.token[ends] if k == 0 else self.rolling.ranges(ends - k, ends + 1) >> np.uint64(64 - self.bits)

    def questions(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams by hash, and how often each occurs in training."""
        ends, keys = self.grams(k)
        asked = np.sort(keys)
        asked = asked[np.concatenate(([True], asked[1:] != asked[:-1]))] if len(asked) else asked
        trained = np.sort(keys[self.weight[ends]])
        first = np.searchsorted(trained, asked)
        return asked, (np.searchsorted(trained, asked, side="right") - first).astype("<u4")

    def numbered(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of every position's n-gram among the distinct ones (-1 without one), and a position of each."""
        ends, keys = self.grams(k)
        order = np.argsort(keys)
        ranked = keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        index = np.full(len(self.token), -1, np.int64)
        index[ends[order]] = np.cumsum(fresh) - 1
        return index, ends[order[fresh]]


def _shards(hashes: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Hash ranges of sorted hashes: first position of every range, and the end."""
    at = (hashes >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)
    return np.searchsorted(at.astype(np.int64), np.arange(shards + 1))


class Automaton:
    """States are the n-grams seen in training with an order below the highest, and the root.

    From a state an arc leaves for every word seen behind it, with the word's smoothed log-probability, to the longest
    seen n-gram that ends there. For other words the failure arc leads to the state without its first word, at the
    logarithm of the weight its interpolation gives the shorter history. The root has an arc for every word. An arc is
    found by the n-gram of the state and the word, so a batch numbers its n-grams once and no table is searched.
    """

    def __init__(self, tokens: Tokens, counts: list[np.ndarray], total: int, distinct: int, means: list[float]):
        order = len(counts)
        chance = (counts[0] + PRIOR) / (total + PRIOR * (distinct + 1))
        index, _ = tokens.numbered(0)
        self.known = counts[0][index] > 0
        self.unigram = np.log10(chance)[index]
        #: by state order and position: the weight of the arc over the token (NaN without one), of the failure arc before it
        self.arcs, self.failures = [self.unigram], []
        for k in range(1, order):
            shorter, history = index, np.full(len(index), -1, np.int64)
            history[1:] = index[:-1]
            bow = np.log10(means[k] / (counts[k - 1] + means[k]))
            self.failures.append(bow[history])
            index, where = tokens.numbered(k)
            g = np.flatnonzero(counts[k] > 0)
            at = where[g]
            behind = np.maximum(counts[k - 1][shorter[at - 1]], counts[k][g])
            longer = np.full(len(counts[k]) + 1, np.nan)
            longer[g] = (counts[k][g] + means[k] * chance[shorter[at]]) / (behind + means[k])
            self.arcs.append(np.log10(longer)[index])
            chance = longer

    def read(self, start: int, end: int, body: int) -> float:
        """Log-probability of the tokens from ``body`` on, one traversal from the root; those before only set the state."""
        top = len(self.arcs) - 1
        state, score = 0, 0.0
        arcs = zip(*[a[start:end].tolist() for a in self.arcs], strict=True)
        failures = zip(*[f[start:end].tolist() for f in self.failures], strict=True) if top else [()] * (end - start)
        at = start
        for arc, failure, known in zip(arcs, failures, self.known[start:end].tolist(), strict=True):
            if at == body:
                score = 0.0
            at += 1
            weight = arc[state]
            while weight != weight:  # no arc over this token: fail to the state without its first word
                state -= 1
                score += failure[state]
                weight = arc[state]
            score += weight
            if state < top and (state or known):
                state += 1
        return score if end > body else 0.0


def _packed(segments: DataFrame, train: Column, order: int, batch_chars: int, piece_chars: int) -> DataFrame:
    """Texts in batches: one row per batch with the ids and marks of its pieces and their compressed bytes."""
    kind = segments.schema["segment_id"].dataType.simpleString()
    schema = (
        f"batch long, shard int, ids array<{kind}>, row array<long>, part array<int>, lead array<int>, fresh array<boolean>, "
        "opens array<boolean>, closes array<boolean>, train array<boolean>, sizes array<int>, body binary"
    )
    names = ["batch", "shard", "ids", "row", "part", "lead", "fresh", "opens", "closes", "train", "sizes", "body"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        held, ids, chars, number, rows = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            raw = [p.text.encode("utf-8", "replace").lower() for _, _, p, _ in held]
            column = lambda values, type_: pa.array([values], pa.list_(type_))
            flags = lambda name: column([getattr(p, name) for _, _, p, _ in held], pa.bool_())
            every = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([base + number]), pa.array([-1], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every),
                    column([r for r, _, _, _ in held], pa.int64()), column([n for _, n, _, _ in held], pa.int32()),
                    column([p.lead for _, _, p, _ in held], pa.int32()), flags("fresh"), flags("opens"), flags("closes"),
                    column([t for _, _, _, t in held], pa.bool_()), column([len(r) for r in raw], pa.int32()),
                    pa.array([_shrink(b"".join(raw), 9)], pa.binary()),
                ],
                names=names,
            )

        for batch in batches:
            key = batch.column(0)
            for i, (text, used) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for part, piece in enumerate(text_pieces(text or "", order, piece_chars)):
                    held.append((base + rows, part, piece, used))
                    ids.append(key.slice(i, 1))
                    chars += len(piece.text) + 1
                    if chars >= batch_chars:
                        yield flush()
                        held, ids, chars, number = [], [], 0, number + 1
                rows += 1
        if held:
            yield flush()

    return segments.select("segment_id", "text", F.coalesce(train, F.lit(False))).mapInArrow(packed, schema)


def _tokens(row: dict, bits: int) -> Tokens:
    sizes = np.asarray(row["sizes"], np.int64)
    raw = _grow(row["body"], int(sizes.sum()))
    ends = np.cumsum(sizes)
    pieces = [raw[lo:hi] for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    marks = [np.asarray(row[n], bool) for n in ("fresh", "opens", "closes", "train")]
    return Tokens(pieces, np.asarray(row["lead"], np.int64), *marks, bits)


def _asked(packed: DataFrame, order: int, bits: int, shards: int) -> DataFrame:
    """Every batch's distinct n-grams with their training counts, cut into hash ranges."""

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                tokens = _tokens(row, bits)
                grams = [tokens.questions(k) for k in range(order)]
                grams = [(h, n, _shards(h, 64 if k == 0 else bits, shards)) for k, (h, n) in enumerate(grams)]
                del tokens
                out = {"shard": [], "sizes": [], "body": []}
                for s in range(shards):
                    sizes, parts = [], []
                    for hashes, counts, edge in grams:
                        part = hashes[edge[s] : edge[s + 1]]
                        sizes.append(len(part))
                        parts += [_planes(np.diff(part, prepend=np.uint64(0))), _planes(counts[edge[s] : edge[s + 1]])]
                    if any(sizes):
                        out["shard"].append(s)
                        out["sizes"].append(sizes)
                        out["body"].append(_shrink(b"".join(parts), 1))
                yield pd.DataFrame({"batch": row["batch"], **out})

    needed = packed.select("batch", "lead", "fresh", "opens", "closes", "train", "sizes", "body")
    return needed.mapInPandas(asked, "batch long, shard int, sizes array<int>, body binary")


def _answered(asked: DataFrame, order: int) -> DataFrame:
    """What other batches add to each batch's counts, in the order in which it asked.

    ``seen`` holds, on one row of every range, its number of distinct training n-grams by order and its tokens.
    """

    def answer(shard: int, rows: list[tuple[int, np.ndarray, bytes]]) -> pd.DataFrame:
        sizes = np.array([r[1] for r in rows])
        bodies = [_grow(r[2], 12 * int(r[1].sum())) for r in rows]
        at = np.zeros(len(rows), np.int64)
        told: list[list[bytes]] = [[] for _ in rows]
        seen, tokens = [], 0
        for k in range(order):
            hashes, counts = [], []
            for i, body in enumerate(bodies):
                n = int(sizes[i, k])
                hashes.append(np.cumsum(_values(body[at[i] : at[i] + 8 * n], "<u8"), dtype=np.uint64))
                counts.append(_values(body[at[i] + 8 * n : at[i] + 12 * n], "<u4"))
                at[i] += 12 * n
            distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
            sums = np.bincount(which, np.concatenate(counts), len(distinct)).astype("<u8")
            seen.append(int((sums > 0).sum()))
            tokens = tokens if k else int(sums.sum())
            ends = np.cumsum(sizes[:, k])
            for i, (lo, hi) in enumerate(zip((ends - sizes[:, k]).tolist(), ends.tolist(), strict=True)):
                told[i].append(_planes(sums[which[lo:hi]] - counts[i]))
        seen.append(tokens)
        none = [0] * len(seen)
        return pd.DataFrame({
            "batch": [r[0] for r in rows], "shard": shard, "sizes": sizes.tolist(), "body": [_shrink(b"".join(t), 9) for t in told],
            "seen": [seen if i == 0 else none for i in range(len(rows))],
        })

    def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray, bytes]] = []
        current = None
        for frame in frames:
            for batch, shard, sizes, body in zip(frame["batch"], frame["shard"], frame["sizes"], frame["body"], strict=True):
                if held and shard != current:
                    yield answer(current, held)
                    held = []
                current = shard
                held.append((batch, np.asarray(sizes, np.int64), body))
        if held:
            yield answer(current, held)

    schema = "batch long, shard int, sizes array<int>, body binary, seen array<long>"
    return asked.repartition("shard").sortWithinPartitions("shard", "batch").mapInPandas(answered, schema)


def _scored(packed: DataFrame, answers: DataFrame, order: int, bits: int, total: int, vocabulary: int, means: list[float]) -> DataFrame:
    """Scores of every piece, batch by batch."""
    kind = packed.schema["ids"].dataType.elementType.simpleString()
    schema = f"segment_id {kind}, row long, part int, n_tokens long, n_known long, base_score double, score double"

    def score(row: dict, ids: pa.Array, answers: list[tuple[list[int], bytes]]) -> pa.RecordBatch:
        tokens = _tokens(row, bits)
        parts: list[list[np.ndarray]] = [[] for _ in range(order)]
        for sizes, body in answers:
            raw, at = _grow(body, 8 * sum(sizes)), 0
            for k, n in enumerate(sizes):
                parts[k].append(_values(raw[at : at + 8 * n], "<u8"))
                at += 8 * n
        counts = []
        for k, more in enumerate(parts):
            counts.append(np.concatenate(more).astype(np.int64) + tokens.questions(k)[1])
        machine = Automaton(tokens, counts, total, vocabulary, means)
        pieces = len(tokens.start)
        spans = zip(tokens.start.tolist(), tokens.end.tolist(), tokens.body.tolist(), strict=True)
        scores = [machine.read(start, end, body) for start, end, body in spans]
        owner = tokens.owner[tokens.scored]
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array(row["row"], pa.int64()), pa.array(row["part"], pa.int32()), pa.array(np.bincount(owner, minlength=pieces).astype(np.int64)),
                pa.array(np.bincount(owner, machine.known[tokens.scored], pieces).astype(np.int64)),
                pa.array(np.bincount(owner, machine.unigram[tokens.scored], pieces)), pa.array(np.array(scores, np.float64)),
            ],
            names=["segment_id", "row", "part", "n_tokens", "n_known", "base_score", "score"],
        )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, answers = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("shard")[i].as_py() == -1:
                    if current is not None:
                        yield score(current, ids, answers)
                    current = {n: batch.column(n)[i].as_py() for n in ("row", "part", "lead", "fresh", "opens", "closes", "train", "sizes", "body")}
                    ids, answers = batch.column("ids")[i].values, []
                else:
                    answers.append((batch.column("sizes")[i].as_py(), batch.column("body")[i].as_py()))
        if current is not None:
            yield score(current, ids, answers)

    both = packed.unionByName(answers.drop("seen"), allowMissingColumns=True)
    return both.repartition("batch").sortWithinPartitions("batch", "shard").mapInArrow(scored, schema)


def score_segments(
    segments: DataFrame, train: Column, order: int = ORDER, batch_chars: int = BATCH_CHARS, piece_chars: int = PIECE_CHARS,
    shard_grams: int = SHARD_GRAMS,
) -> DataFrame:
    """Log10 probability of every segment text under an n-gram model of the segments that ``train`` marks.

    In: ``segment_id, text`` and the columns ``train`` reads. Out: one row per segment with ``segment_id, n_tokens, n_known,
    train_tokens, base_score, score``. A-Z are lower-cased; tokens are runs of anything but ASCII white space, then one end
    token. ``n_known`` counts tokens met in training, ``train_tokens`` all tokens there. ``base_score`` is the unigram model
    with 0.5 added to every count and to one unknown token. ``score`` interpolates orders 1 to ``order``: a word behind a history
    has probability (c(history, word) + m p(word | shorter history)) / (c(history) + m), m being the mean number of different
    words seen behind a history of that order; order 1 is the unigram model. Nothing is pruned and no count is capped.

    A null text is an empty one and holds the end token only; a null ``train`` is false. Without training segments all tokens
    are unknown. Words are told apart by 64-bit hashes, longer n-grams by as many bits as the number of tokens
    needs and ``SPARE_BITS`` more, so that a lookup meets a stranger with probability 2 ** -24. Texts above ``piece_chars`` are cut between
    words, with the words before the cut as context, and added up in order. Repeated and null ids are rows of their own. Other
    columns are not carried; an empty table gives an empty result.

    A batch holds about ``batch_chars`` characters and a hash range about ``shard_grams`` n-grams, whatever the input. An n-gram
    reaches its range once per batch, so one that holds a third of all tokens weighs no more there than the number of batches.
    """
    bound_batches(segments.sparkSession, 64)
    chars = segments.agg(F.sum(F.char_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars // 5 * order / shard_grams))
    bits = min(64, max(40, (chars // 6).bit_length() + SPARE_BITS))
    packed = checkpoint(_packed(segments, train, order, batch_chars, piece_chars))
    bound_batches(segments.sparkSession, 32)
    answers = checkpoint_alone(lambda: _answered(_asked(packed, order, bits, shards), order))
    seen = answers.agg(*[F.sum(F.col("seen")[k]) for k in range(order + 1)]).first()
    opened = F.filter(F.arrays_zip("train", "opens", "fresh"), lambda p: p["train"] & p["opens"] & p["fresh"])
    texts = packed.agg(F.sum(F.size(opened))).first()[0] or 0
    distinct = [seen[k] or 0 for k in range(order)]
    total = (seen[order] or 0) - texts  # the start mark is a history, never a token
    means = [1.0, *[distinct[k] / max(1, distinct[k - 1]) or 1.0 for k in range(1, order)]]
    parts = _scored(packed, answers, order, bits, total, distinct[0] - (texts > 0), means)
    sums = F.array_sort(F.collect_list(F.struct("part", "base_score", "score")))
    add = lambda name: F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p[name]).alias(name)
    whole = parts.groupBy("row").agg(
        F.first("segment_id").alias("segment_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), sums.alias("_parts")
    )
    return whole.select("segment_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), add("base_score"), add("score"))
