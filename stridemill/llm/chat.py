"""Chat formatting of trajectory messages on token level."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridemill.llm.batches import bound_batches
from stridemill.llm.bpe import tokenizer
from stridemill.scale import checkpoint

# control strings of the template (fixed values); each has its first character nowhere else in it
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, ROLE, TEXT, END)

_IN_TEXT = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    """A back slash more behind the first character of every control string, escaped or not."""
    return _IN_TEXT.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _assembled(parts: list[list[np.ndarray]], trained: list[list[bool]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Token ids and loss mask of each message from its parts; the mask comes from prefix sums of part lengths."""
    flat = [p for message in parts for p in message]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(lengths)
    chosen = np.fromiter((t for message in trained for t in message), bool, len(flat))
    change = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
    np.add.at(change, (ends - lengths)[chosen], 1)
    np.add.at(change, ends[chosen], -1)
    mask = np.cumsum(change[:-1]).astype(bool)
    ids = np.concatenate(flat) if flat else np.zeros(0, "<u4")
    cuts = ends[np.cumsum([len(m) for m in parts])[:-1] - 1] if len(parts) > 1 else []
    return np.split(ids, cuts), np.split(mask, cuts)


def format_messages(
    messages: DataFrame, ranks_path: str, pattern: str, trained_role: str = "assistant"
) -> DataFrame:
    """Tokens of every message in its trajectory's training sequence.

    In: ``trajectory_id, t, role, text``, one row per message. Out: one row per message with
    ``trajectory_id, t, seq`` (0, 1, .. by ``t``, role and text), ``ids`` and ``loss_mask`` (binary: unsigned
    32-bit little-endian ids, one byte 0 or 1 per id) and ``token_start``, the place of its first id in the
    sequence. Rows of a trajectory in order of ``seq`` make up the sequence.

    A message reads ``[INST]role[/INST]text</s>``, the first one ``<s>`` before it. The four controls
    are reserved ids behind the vocabulary; role and text are encoded by themselves, so neither can
    merge with a control, and control strings inside them are escaped (see ``escape``). The mask covers
    the text of ``trained_role`` only. A null role or text counts as empty, a null ``t`` comes first;
    repeated rows are messages of their own. A trajectory of any length is never gathered: messages are
    encoded where they are, only their numbers need the trajectory's order.
    """
    bound_batches(messages.sparkSession)
    base = tokenizer(ranks_path, pattern).size
    begin, role_id, text_id, end = (np.array([base + i], "<u4") for i in range(4))
    texts = messages.select(
        "trajectory_id", "t", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("trajectory_id").orderBy("t", "role", "text")
    numbered = checkpoint(texts.withColumn("seq", (F.row_number().over(order) - 1).cast("long")))

    @F.pandas_udf("ids binary, loss_mask binary")
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(ranks_path, pattern)
        for seqs, roles, bodies in batches:
            parts, trained = [], []
            for seq, role, body in zip(seqs, roles, bodies, strict=True):
                head = [begin, role_id] if seq == 0 else [role_id]
                parts.append([*head, tok.encode(escape(role)), text_id, tok.encode(escape(body)), end])
                trained.append([*[False] * (len(head) + 2), role == trained_role, False])
            ids, masks = _assembled(parts, trained)
            yield pd.DataFrame({"ids": [i.tobytes() for i in ids], "loss_mask": [m.tobytes() for m in masks]})

    out = numbered.withColumn("_tokens", encoded("seq", "role", "text")).select(
        "trajectory_id", "t", "seq", F.col("_tokens.ids").alias("ids"), F.col("_tokens.loss_mask").alias("loss_mask")
    )
    before = Window.partitionBy("trajectory_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return checkpoint(out).withColumn(
        "token_start", F.coalesce(F.sum(F.octet_length("ids") / 4).over(before), F.lit(0)).cast("long")
    )


def read_messages(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Messages back from their tokens: ``trajectory_id, seq, role, text, trained, formatted``.

    ``role`` and ``text`` are the original strings, ``trained`` is the unescaped text under the loss
    mask, ``formatted`` the message as a string with its control strings.
    """
    base = tokenizer(ranks_path, pattern).size

    @F.pandas_udf("role string, text string, trained string, formatted string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(ranks_path, pattern)
        for ids_column, masks in batches:
            rows = []
            for raw, flags in zip(ids_column, masks, strict=True):
                ids, mask = np.frombuffer(raw, "<u4"), np.frombuffer(flags, bool)
                marks = np.flatnonzero(ids >= base)
                kinds = ids[marks] - base
                at = {int(k): int(m) for k, m in zip(kinds, marks, strict=True)}
                role = tok.decode(ids[at[1] + 1 : at[2]]).decode()
                body = tok.decode(ids[at[2] + 1 : at[3]]).decode()
                said = tok.decode(ids[mask]).decode()
                shown = (BEGIN if 0 in at else "") + ROLE + role + TEXT + body + END
                rows.append((unescape(role), unescape(body), unescape(said), shown))
            yield pd.DataFrame(rows, columns=["role", "text", "trained", "formatted"])

    bound_batches(formatted.sparkSession)
    got = formatted.withColumn("_read", read("ids", "loss_mask"))
    return got.select("trajectory_id", "seq", *[F.col(f"_read.{n}").alias(n) for n in ("role", "text", "trained", "formatted")])


def conversation_digests(read: DataFrame) -> DataFrame:
    """One row per trajectory from ``read_messages``: counts and running SHA-256 in message order.

    ``trajectory_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Messages stream
    by in order; none of a trajectory's text is held.
    """
    names = ["trajectory_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None
        for frame in frames:
            done = []
            for key, seq, role, text, said, shown in zip(
                frame["trajectory_id"], frame["seq"], frame["role"], frame["text"], frame["trained"], frame["formatted"], strict=True
            ):
                if seq == 0:
                    if state:
                        done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
                    state = [None if pd.isna(key) else key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(said)
                state[4].update(said.encode())
                state[5] += len(shown)
            yield pd.DataFrame(done, columns=names)
        if state:
            yield pd.DataFrame([(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])], columns=names)

    kind = dict(read.dtypes)["trajectory_id"]
    return read.repartition("trajectory_id").sortWithinPartitions("trajectory_id", "seq").mapInPandas(
        streamed, f"trajectory_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
