"""Byte-level BPE of segment texts by overlapping chunks, and its decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.batches import bound_batches, sorted_groups
from stridemill.scale import checkpoint

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 11

_SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])")


class Tokenizer:
    """Ranks and pre-token pattern of a vocabulary file in tiktoken's form.

    ``pattern`` must match from the front on without looking behind, and must never let a piece
    go on from another character into a space; every single space between two other characters is then a
    boundary in any context.
    """

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the encoder's white space is Unicode's property, without the separators U+001C to U+001F
        spaces = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(spaces)
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def boundaries(self, text: str) -> list[int]:
        """Starts of all pieces of ``text``."""
        return [m.start() for m in self.pattern.finditer(text)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that begins and ends at piece boundaries."""
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@lru_cache(4)
def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    """One per worker process."""
    return Tokenizer(ranks_path, pattern)


def first_common(tail: np.ndarray, head: np.ndarray) -> int | None:
    """Where a chunk takes over from the one before it: the first boundary that both have found, or None.

    ``tail`` are boundaries the earlier chunk found behind its own stretch, ``head`` those at the front of
    the later one. A piece depends on nothing before it, so from a common boundary on both agree.
    """
    common = np.intersect1d(tail, head)
    return int(common[0]) if len(common) else None


def _long_pieces(texts: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Parts of long texts that begin and end at piece boundaries: ``_row, part, piece``."""
    chunks = texts.select(
        "_row", F.char_length("text").alias("_chars"), "text",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.char_length("text") - 1) / chunk))).alias("part"),
    ).select("_row", "part", "_chars", F.substring("text", F.col("part") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
    chunks = checkpoint(chunks.repartition("_row", "part"))

    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(ranks_path, pattern)
        for frame in frames:
            rows = []
            for part, text in zip(frame["part"], frame["text"], strict=True):
                at = np.array(tok.boundaries(text), np.int64)
                head = at[at < overlap]
                # the last piece may go on behind the cut; white space is split by what follows it, so none may end a part
                tail = at[(at >= chunk) & (at < at[-1])] if len(text) > chunk and len(at) else at[:0]
                tail = tail[[not text[t - 1].isspace() for t in tail]] if len(tail) else tail
                rows.append((part * chunk + head, part * chunk + tail, bool(_SAFE.search(text, 0, chunk))))
            yield pd.DataFrame({
                "_row": frame["_row"], "part": frame["part"], "head": [h for h, _, _ in rows],
                "tail": [t for _, t, _ in rows], "safe": [s for _, _, s in rows],
            })

    found = chunks.mapInPandas(edges, "_row long, part long, head array<long>, tail array<long>, safe boolean")

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, row, run = None, None, 0
        for frame in frames:
            cuts, runs = [], []
            for r, part, head, after, safe in zip(*[frame[c] for c in ("_row", "part", "head", "tail", "safe")], strict=True):
                cut = 0 if r != row else first_common(tail, head)
                if cut is not None:
                    run = part
                elif not safe:  # nowhere in step with the text before it, so its tail proves nothing
                    after = after[:0]
                cuts.append(cut)
                runs.append(run)
                row, tail = r, after
            yield pd.DataFrame({"_row": frame["_row"], "part": frame["part"], "cut": pd.array(cuts, dtype="Int64"), "run": runs})

    cuts = checkpoint(
        found.repartition("_row").sortWithinPartitions("_row", "part")
        .mapInPandas(joined, "_row long, part long, cut long, run long")
    )
    # chunks without a common boundary stay with the run before them; the run's text is put together again
    runs = cuts.groupBy("_row", "run").agg(F.max("cut").alias("from"), F.max("part").alias("last"))
    follow = cuts.filter("cut is not null").select(F.col("_row"), (F.col("part") - 1).alias("last"), F.col("cut").alias("to"))
    ranges = runs.join(follow, ["_row", "last"], "left")
    located = chunks.join(cuts.select("_row", "part", "run"), ["_row", "part"]).join(ranges.drop("last"), ["_row", "run"])

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["_row", "run"]):
            own = group["text"].tolist()
            whole = "".join(t[:chunk] for t in own[:-1]) + own[-1]
            base = int(group["part"][0]) * chunk
            start, to = int(group["from"][0]), group["to"][0]
            yield pd.DataFrame({
                "_row": group["_row"][:1], "part": group["run"][:1],
                "piece": [whole[start - base : None if pd.isna(to) else int(to) - base]],
            })

    near = located.repartition("_row", "run").sortWithinPartitions("_row", "run", "part")
    return near.mapInPandas(pieces, "_row long, part long, piece string")


def encode_segments(
    segments: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """Token ids of every whole ``text``: ``segment_id, row, parted, part, ids`` (unsigned 32-bit, little-endian, as binary).

    A text of up to ``chunk`` characters is one part, numbered 0. A longer one is cut into chunks that run
    ``overlap`` characters into the next and are pre-tokenised apart; neighbours are stitched at their
    first common boundary, and where the overlap has none (one very long piece) they are joined. The
    stitched parts are encoded in parallel; parts of a segment in order of ``part`` make up its ids. A
    null or empty text has one part without ids. ``parted`` tells the parts of long texts, whose ``row`` keeps
    rows with equal ids apart and has no meaning beyond that; it is 0 elsewhere. Other columns are not carried.
    """
    spark = segments.sparkSession
    bound_batches(spark)
    texts = segments.select("segment_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.char_length("text")

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(ranks_path, pattern)
        for batch in batches:
            yield pd.Series([tok.encode(t).tobytes() for t in batch])

    ids = F.pandas_udf(encoded, "binary")
    short = texts.filter(size <= chunk).select(
        "segment_id", F.lit(0).cast("long").alias("row"), F.lit(False).alias("parted"), F.lit(0).cast("long").alias("part"),
        ids("text").alias("ids"),
    )
    long_ = checkpoint(texts.filter(size > chunk).withColumn("_row", -1 - F.monotonically_increasing_id()))
    if long_.isEmpty():
        return short
    parts = _long_pieces(long_, ranks_path, pattern, chunk, overlap).join(long_.select("_row", "segment_id"), "_row")
    return short.unionByName(parts.select(
        "segment_id", F.col("_row").alias("row"), F.lit(True).alias("parted"), "part", ids("piece").alias("ids")
    ))


def decode_segments(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids``; parts put side by side give the text's bytes."""

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(ranks_path, pattern)
        for batch in batches:
            yield pd.Series([tok.decode(np.frombuffer(i, "<u4")) for i in batch])

    bound_batches(encoded.sparkSession)
    return encoded.withColumn("decoded", F.pandas_udf(decoded, "binary")("ids"))


def digests(decoded: DataFrame) -> DataFrame:
    """``segment_id, n_tokens, ids_sha256, decoded_sha256`` per encoded segment.

    One-part segments are digested where they are; only the parts of long ones are brought together,
    in order, and hashed as they stream by. ``parted`` is constant in each branch, so neither side encodes the other's texts.
    """
    alone = decoded.filter("not parted").select(
        "segment_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )

    def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, owner, tokens, a, b = None, None, 0, None, None
        for frame in frames:
            done = []
            for r, s, i, d in zip(frame["row"], frame["segment_id"], frame["ids"], frame["decoded"], strict=True):
                if r != row:
                    if row is not None:
                        done.append((owner, tokens, a.hexdigest(), b.hexdigest()))
                    row, owner, tokens, a, b = r, s, 0, hashlib.sha256(), hashlib.sha256()
                tokens += len(i) // 4
                a.update(i)
                b.update(d)
            yield pd.DataFrame(done, columns=names)
        if row is not None:
            yield pd.DataFrame([(owner, tokens, a.hexdigest(), b.hexdigest())], columns=names)

    names = ["segment_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = dict(decoded.dtypes)["segment_id"]
    long_ = decoded.filter("parted").repartition("row").sortWithinPartitions("row", "part")
    return alone.unionByName(long_.mapInPandas(streamed, f"segment_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
