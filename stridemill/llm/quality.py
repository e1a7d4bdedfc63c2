"""Quality rules on segment texts: base counts and repetition coverage by rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm import words
from stridemill.llm.batches import bound_batches, text_slices

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """``base_failed`` below ``min_words`` or above ``max_repeat_share`` of words in repeated 3-word windows; the
    coverage rules reject above these shares of word characters: inside repeated lines, and inside word windows of
    each length that occurred before in the text."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_line_share: float = 0.3
    max_window_share: tuple[tuple[int, float], ...] = ((5, 0.30), (7, 0.30), (10, 0.30))


def measures(texts: list[str], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts per text; ``line_chars`` and ``window_<n>_chars`` are characters of words inside repeats."""
    s = words.tabulate(texts)
    word_chars = words.totals(s.lead, s.start, s.end)
    symbols = words.totals(words.SYMBOL[s.buffer], s.text_start, s.text_end)
    salt = words.mixed(np.arange(1, len(texts) + 1, dtype=np.uint64))

    breaks = np.flatnonzero(s.buffer == 10)
    line_start = np.concatenate(([0], breaks[:-1] + 1))
    in_line = np.searchsorted(s.start, line_start), np.searchsorted(s.start, breaks)
    full = in_line[1] > in_line[0]
    lo, hi = in_line[0][full], in_line[1][full]
    owner = s.owner[lo] if len(lo) else lo
    _, later = words.repeated(s.bytes_hash.ranges(line_start[full], breaks[full]) ^ salt[owner])
    line_chars = words.totals(word_chars, lo, hi)

    out = {
        "n_words": s.last - s.first,
        "word_chars": words.totals(word_chars, s.first, s.last),
        "n_symbols": symbols,
        "n_dup_lines": np.bincount(owner[later], minlength=len(texts)),
        "line_chars": np.bincount(owner[later], line_chars[later], minlength=len(texts)).astype(np.int64),
    }
    at, hashes = s.windows(3)
    every, _ = words.repeated(hashes ^ salt[s.owner[at]])
    out["n_repeat_words"] = words.totals(words.covered(len(s.start), at[every], 3), s.first, s.last)
    for n in lengths:
        at, hashes = s.windows(n)
        _, later = words.repeated(hashes ^ salt[s.owner[at]])
        out[f"window_{n}_chars"] = words.totals(words.covered(len(s.start), at[later], n) * word_chars, s.first, s.last)
    return out


def rate_segments(segments: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Adds the base counts, the repeat coverage, ``base_failed`` and ``kept`` to ``segments``.

    Reads the whole ``text``. A null or empty text has no words and fails the base rule. Repeats are
    counted inside a text only, so copies of a segment are rated alike. Columns of the same names are
    replaced, all others kept; an empty table gives an empty result.
    """
    rules = rules or Rules()
    lengths = tuple(n for n, _ in rules.max_window_share)
    names = [*BASE, "line_chars", *[f"window_{n}_chars" for n in lengths]]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            parts = [measures(texts[lo:hi], lengths) for lo, hi in text_slices(texts)]
            yield pd.DataFrame({n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in names})

    bound_batches(segments.sparkSession)
    out = segments.withColumn("_rated", rated("text"))
    out = out.withColumns({n: F.col(f"_rated.{n}") for n in names}).drop("_rated")
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") > rules.max_repeat_share * F.col("n_words"))
    fine = F.col("line_chars") <= rules.max_line_share * F.col("word_chars")
    for n, share in rules.max_window_share:
        fine &= F.col(f"window_{n}_chars") <= share * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
