"""Periodic runs of words in segment texts (an agent caught in a cycle, a page that repeats itself)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.batches import bound_batches, text_slices
from stridemill.llm.grammar import Grammar

MIN_LENGTH = 12
SLICE_CHARS = 1 << 20
TABLE_WORDS = 1 << 15

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TABLE: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _harmonic_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid pairs (k*p, (k+1)*p) below ``TABLE_WORDS`` by their second position, and how many a text of each size has."""
    if not _TABLE:
        second = np.concatenate([np.arange(p, TABLE_WORDS, p, dtype=np.int32) for p in range(1, TABLE_WORDS)])
        period = np.repeat(np.arange(1, TABLE_WORDS, dtype=np.int32), (TABLE_WORDS - 1) // np.arange(1, TABLE_WORDS))
        order = np.argsort(second, kind="stable")
        sizes = np.searchsorted(second[order], np.arange(TABLE_WORDS + 1, dtype=np.int32))
        _TABLE.append((second[order] - period[order], second[order], sizes))
    return _TABLE[0]


def grid_candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid pairs of equal words: a run of period p holds two neighbours of the grid 0, p, 2p, ... of its period."""
    size = len(words)
    if size <= TABLE_WORDS:
        first, second, sizes = _harmonic_table()
        last = sizes[size]
        equal = np.flatnonzero(words[first[:last]] == words[second[:last]])
        i, j = first[equal].astype(np.int64), second[equal].astype(np.int64)
        short = 2 * (j - i) <= size
        return i[short], j[short]
    low, high = [], []
    for p in range(1, size // 2 + 1):
        at = np.flatnonzero(words[:-p:p] == words[p::p]) * p
        if len(at):
            low.append(at)
            high.append(at + p)
    return (np.concatenate(low), np.concatenate(high)) if low else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_runs(texts: list[list[str]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Runs of every text as rows (start, length, period) by start, then period.

    One grammar serves all texts. Of the grid pairs inside a run only the first is kept, so a run is found once for
    each multiple of its smallest period, and the smallest wins.
    """
    barrier = 0
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.full(int((sizes + 1).sum()) + 1, barrier, np.int32)
    inside = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols[inside] = pd.factorize(np.array([w for words in texts for w in words], dtype=object))[0] + 1
    owner, first, second = [], [], []
    for t, words in enumerate(texts):
        if len(words) < min_length:
            continue
        i, j = grid_candidates(symbols[starts[t] : starts[t] + len(words)])
        owner.append(np.full(len(i), t))
        first.append(i + starts[t])
        second.append(j + starts[t])
    found = [np.zeros((0, 3), np.int64)] * len(texts)
    if not owner:
        return found
    t, i, j = np.concatenate(owner), np.concatenate(first), np.concatenate(second)
    if not len(t):
        return found
    grammar = Grammar(symbols, barrier)
    period = j - i
    size = len(symbols)
    back = grammar.mirrored().extensions(size - i, size - j)
    head = np.flatnonzero(back < period)
    t, i, j, period, back = t[head], i[head], j[head], period[head], back[head]
    length = back + period + grammar.extensions(i, j)
    keep = length >= np.maximum(min_length, 2 * period)
    t, start, length, period = t[keep], (i - back)[keep], length[keep], period[keep]
    order = np.lexsort((period, length, start))
    t, start, length, period = t[order], start[order], length[order], period[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    t, start, length, period = t[fresh], start[fresh], length[fresh], period[fresh]
    order = np.lexsort((period, start))
    rows = np.stack([start - starts[t], length, period], 1)[order]
    cuts = np.searchsorted(t[order], np.arange(len(texts) + 1))
    return [rows[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """Words outside runs and the first period of every run, joined by one space; a word any run repeats goes."""
    if not len(runs):
        return " ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def periodic_runs(segments: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Adds ``n_words``, ``runs`` and ``collapsed_text`` to ``segments`` (``text`` and any other columns).

    Words are runs of anything but ASCII white space. A run is a stretch of words with smallest period q, of at least
    ``min_length`` and 2q words, that neither neighbour extends; ``runs`` lists all of a text as ``start, length,
    period`` in words, by start, then period. ``collapsed_text`` is the text without the words that lie in any run
    behind that run's first period, joined by one space.

    A null or empty text has no words, no runs and an empty ``collapsed_text``. Whole texts are read, one at a time in
    memory (some 200 bytes a word); texts are worked on in slices of about a million characters and never meet
    each other, so repeated segments give repeated rows and no key gathers rows. Columns of the same names are
    replaced, all others kept; an empty table gives an empty result.
    """

    @F.pandas_udf("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            counts, runs, kept = [], [], []
            for lo, hi in text_slices(texts, SLICE_CHARS):
                words = [_WORD.findall(t) for t in texts[lo:hi]]
                for w, r in zip(words, word_runs(words, min_length), strict=True):
                    counts.append(len(w))
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in r.tolist()])
                    kept.append(collapsed(w, r))
            yield pd.DataFrame({"n_words": np.array(counts, np.int64), "runs": pd.Series(runs, dtype=object), "collapsed_text": pd.Series(kept, dtype=object)})

    bound_batches(segments.sparkSession)
    names = ["n_words", "runs", "collapsed_text"]
    out = segments.withColumn("_found", found("text"))
    return out.withColumns({n: F.col(f"_found.{n}") for n in names}).drop("_found")
