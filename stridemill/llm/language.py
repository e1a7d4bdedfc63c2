"""Language of segment texts: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.llm.batches import bound_batches, text_slices

ROWS_PER_LABEL = 3000
BUCKET_BITS = 15
SMOOTHING = 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_GAP = "  "


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all two- and three-letter windows, one row each, with every text's range of windows."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((_GAP + _GAP.join(lowered) + _GAP + _GAP).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    start = np.concatenate(([0], np.cumsum(sizes + len(_GAP))[:-1])) + 1
    a, b, c = points[:-2], points[1:-1], points[2:]
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    three = (two ^ (two >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BUCKET_BITS)
    return np.stack([two * np.uint32(0x2545F491) >> shift, three * np.uint32(0x2545F491) >> shift], 1), start, start + sizes + 1


@dataclass(frozen=True)
class LanguageModel:
    """Labels in order and the log-probabilities: one row per bucket, one column per label, prior apart."""

    labels: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log joint probability of every text and label."""
        buckets, lo, hi = grams(texts)
        each = self.weights[buckets[:, 0]]
        each += self.weights[buckets[:, 1]]
        sums = np.zeros((len(each) + 1, each.shape[1]))
        np.cumsum(each, axis=0, dtype=np.float64, out=sums[1:])
        return sums[hi] - sums[lo] + self.prior

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best label and its posterior; the smaller label wins a tie."""
        label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if _LETTER.search(t)] if self.labels else []
        picked = [texts[i] for i in known]
        for lo, hi in text_slices(picked, 1 << 18):
            joint = self.scores(picked[lo:hi])
            best = joint.argmax(1)
            posterior = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
            for k, (b, p) in enumerate(zip(best, posterior, strict=True)):
                label[known[lo + k]] = self.labels[b]
                score[known[lo + k]] = p
        return label, score


def train_language(
    segments: DataFrame, label: str = "lang", id_column: str = "segment_id", rows_per_label: int = ROWS_PER_LABEL
) -> LanguageModel:
    """Fit on rows with text and label: about ``rows_per_label`` of each label, chosen by the hash of ``id_column``.

    Counts are added up in Spark; what reaches the driver is one row per label and bucket in use, so it
    grows with the number of labels only. Priors come from all labelled rows. Null texts and labels are
    not learned; without any labelled row the model knows no label.
    """
    bound_batches(segments.sparkSession)
    known = segments.filter(F.col(label).isNotNull() & F.col("text").isNotNull())
    rows = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    labels = sorted(rows)
    if not labels:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    shares = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, rows_per_label / rows[k]))])
    draw = F.pmod(F.xxhash64(F.lit("language"), id_column), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(draw < shares[F.col(label)]).select(F.col(label).alias("label"), "text")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for name, group in frame.groupby("label"):
                texts = group["text"].tolist()
                for lo, hi in text_slices(texts, 1 << 18):
                    buckets, first, last = grams(texts[lo:hi])
                    inside = np.zeros(len(buckets) + 1, np.int8)
                    inside[first] += 1
                    inside[last] -= 1
                    counts = np.bincount(buckets[np.cumsum(inside[:-1]) > 0].ravel(), minlength=1 << BUCKET_BITS)
                    sums[name] = sums.get(name, 0) + counts
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"label": name, "bucket": used, "n": counts[used]})

    found = (
        sample.mapInPandas(counted, "label string, bucket long, n long")
        .groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = np.full((1 << BUCKET_BITS, len(labels)), SMOOTHING)
    column = {k: i for i, k in enumerate(labels)}
    np.add.at(counts, (found["bucket"].to_numpy(np.int64), found["label"].map(column).to_numpy(np.int64)), found["n"].to_numpy())
    total = np.array([rows[k] for k in labels], float)
    return LanguageModel(labels, np.log(counts / counts.sum(0)), np.log(total / total.sum()))


def predict_language(segments: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds ``lang_pred`` and ``lang_score`` (its posterior) from the whole ``text`` alone.

    Null texts and texts without a letter get ``und`` and 0, as do all texts when the model knows no
    label. The matrix of log-probabilities, one column per label, is broadcast. Columns of these
    names are replaced, all others kept.
    """
    shared = segments.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            label, score = shared.value.predict(["" if t is None else t for t in batch])
            yield pd.DataFrame({"lang_pred": label, "lang_score": score})

    bound_batches(segments.sparkSession)
    out = segments.withColumn("_language", predicted("text"))
    return out.withColumns({n: F.col(f"_language.{n}") for n in ("lang_pred", "lang_score")}).drop("_language")


def held_out(key: Column, folds: int = 5) -> Column:
    """One fold in ``folds`` by the CRC of the key's text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == 0
