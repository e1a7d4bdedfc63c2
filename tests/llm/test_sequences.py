"""Language-model scores, whitening and periodic runs against plain loops."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from stridemill.llm import backoff, mixing, repeats, whitening
from stridemill.llm.grammar import Grammar

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "x", "é" * 3, "one two three four", "a" * 5000, "w " * 3000, "x y z " * 50]


def documents():
    return duckdb.connect().execute(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


# --- language model

def plain_scores(texts, train, order=3):
    """Counts in a dictionary, the interpolation as a recursion."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    rows = [["<s>", *WORD.findall(lower(t)), "</s>"] for t in texts]
    seen = collections.Counter()
    for row, used in zip(rows, train, strict=True):
        if used:
            seen[("<s>",)] += 1
            for i in range(1, len(row)):
                seen.update(tuple(row[i - k + 1 : i + 1]) for k in range(1, order + 1) if i - k + 1 >= 0)
    distinct = collections.Counter(map(len, seen))
    total = sum(n for g, n in seen.items() if len(g) == 1) - seen[("<s>",)]
    vocabulary = distinct[1] - (seen[("<s>",)] > 0)
    mean = {k: distinct[k] / max(1, distinct[k - 1]) or 1.0 for k in range(2, order + 1)}

    def chance(history, word):
        if not history:
            return (seen[(word,)] + 0.5) / (total + 0.5 * (vocabulary + 1))
        m = mean[len(history) + 1]
        return (seen[(*history, word)] + m * chance(history[1:], word)) / (seen[history] + m)

    return [
        (len(r) - 1, sum(seen[(w,)] > 0 for w in r[1:]), total, sum(math.log10(chance((), w)) for w in r[1:]),
         sum(math.log10(chance(tuple(r[max(0, i - order + 1) : i]), r[i])) for i in range(1, len(r))))
        for r in rows
    ]


def alike(got, expected):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[5], 6))
    for g, e in zip(sorted(got, key=order), sorted(expected, key=order), strict=True):
        assert g[:4] == e[:4] and g[4:] == pytest.approx(e[4:], rel=1e-9)


@pytest.mark.parametrize("options", [{}, {"batch_chars": 300, "piece_chars": 60, "shard_grams": 50}, {"order": 4, "batch_chars": 900, "piece_chars": 33}])
def test_scores_equal_the_recursion_over_plain_counts(spark, options):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "B", "c", "dé", "e\nf"]) for _ in range(rnd.choice([1, 2, 40, 300]))) for _ in range(60)] + ODD + ODD[:3]
    train = [rnd.random() < 0.7 for _ in texts]
    ids = [None if i % 7 == 0 else i % 40 for i in range(len(texts))]
    rows = spark.createDataFrame(list(zip(ids, texts, train, ["clash"] * len(texts), strict=True)), "segment_id long, text string, used boolean, score string")
    got = backoff.score_segments(rows.repartition(3), F.col("used"), **options).collect()
    alike([tuple(r) for r in got], [(i, *x) for i, x in zip(ids, plain_scores(texts, train, options.get("order", 3)), strict=True)])


def test_scores_without_training_rows_or_without_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "segment_id long, text string")
    out = {r.segment_id: r for r in backoff.score_segments(rows, F.lit(None).cast("boolean")).collect()}
    assert out[1].n_known == 0 and out[1].train_tokens == 0 and out[1].base_score == pytest.approx(0.0) and out[2].n_tokens == 1
    assert backoff.score_segments(rows.limit(0), F.lit(True)).collect() == []


def test_scores_of_the_whole_table(spark):
    docs = documents()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in docs]
    got = queries()["op11_backoff"](spark, SF).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: h for (i, _, _), h in zip(docs, held, strict=True)}
    expected = plain_scores([t for _, t, _ in docs], [not h for h in held])
    alike([(r[0], *r[2:]) for r in got], [(i, *x) for (i, _, _), x in zip(docs, expected, strict=True)])
    told = [r for r in got if r.held_out]
    assert sum(r.score for r in told) > sum(r.base_score for r in told)


# --- whitening

def test_whitening_equals_a_dense_eigensolver(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 9)) @ rng.normal(size=(9, 9))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(i, base[0].tolist()) for i in range(200)] + [
        (None, base[1].tolist()), (900, None), (901, [None, *base[0][1:].tolist()]), (902, [float("nan")] * 9), (903, [float("inf")] * 9),
    ]
    segments = spark.createDataFrame([(*r, "clash") for r in rows], "segment_id long, vector array<double>, whitened string").repartition(5)
    out = whitening.whiten_segments(segments, 9).collect()
    x = np.floor(64 * base).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    values, axes = np.linalg.eigh(np.cov(distinct.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(out) == 501 * 9
    signs = {r.component: np.sign(r.whitened * ((x[299] - sums / n) @ axes[:, r.component - 1])) for r in out if r.segment_id == 299}
    spread = collections.Counter()
    for r in out:
        assert r.n == n and r.identity_error < 1e-8 and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-8)
        v = [x[r.segment_id], x[0]] if r.segment_id is not None else [x[1]]
        told = [(int(((n * a - sums) ** 2).sum()), ((a - sums / n) @ axes[:, r.component - 1]) / math.sqrt(values[r.component - 1])) for a in v]
        spread[r.segment_id] += 1
        assert any(int(r.deviation) == d and r.whitened == pytest.approx(signs[r.component] * z, rel=1e-6, abs=1e-7) for d, z in told)
    assert set(spread) == {None, *range(300)} and all(spread[i] == (18 if i is not None and i < 200 else 9) for i in spread)
    assert sorted(out, key=str) == sorted(whitening.whiten_segments(segments.repartition(2), 9).collect(), key=str)


def test_whitening_of_flat_huge_and_missing_vectors(spark):
    kind = "segment_id long, vector array<float>"
    flat = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [2.0, 4.0, 6.0])], kind)
    assert {(r.segment_id, r.component) for r in whitening.whiten_segments(flat).collect()} == {(1, 1), (2, 1), (3, 1)}
    for rows in ([], [(1, None)], [(1, [])], [(1, [5.0, 6.0]), (2, [5.0, 6.0])]):
        assert whitening.whiten_segments(spark.createDataFrame(rows, kind)).collect() == []
    huge = spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e12, 2.0]), (3, [0.5, 9.0])], kind)
    x = [[2**52 + 10**6, 10**6 + 64], [int(np.float32(-1e12)) * 64 + 10**6, 10**6 + 128], [10**6 + 32, 10**6 + 576]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    expected = {i + 1: sum((3 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for i, row in enumerate(x)}
    assert {r.segment_id: int(r.deviation) for r in whitening.whiten_segments(huge).collect()} == expected
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten_segments(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], kind))


def test_limbs_multiply_exactly():
    rng = np.random.default_rng(6)
    y = rng.integers(-(1 << 52), 1 << 52, (50, 3))
    exact = y.astype(object).T @ y.astype(object)
    total = sum((gram.astype(object) << power for power, gram in whitening.limb_grams(y)), np.zeros((3, 3), object))
    assert (total == exact).all()


# --- periodic runs

def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(least, 2 * p) and i > start:
                found.setdefault((start, i - start + p), p)
            i += i == start or i + p < len(words)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_a_scan_of_every_period(least):
    rnd = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(6):
            words = [str(rnd.randrange(rnd.choice([1, 2, 3, 12]))) for _ in range(rnd.choice([0, 1, 7, 40, 150]))]
            if words and rnd.random() < 0.5:
                a, p = rnd.randrange(len(words)), 1 + rnd.randrange(1 + len(words) // 3)
                words = [words[min(len(words) - 1, k if k < a else a + (k - a) % p)] for k in range(len(words))]
            texts.append(words)
        for words, runs in zip(texts, repeats.word_runs(texts, least), strict=True):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(words, least)


def test_candidates_of_texts_beyond_the_table_are_the_same():
    words = np.random.default_rng(1).integers(0, 3, 400)
    table = {tuple(p) for p in zip(*map(np.ndarray.tolist, repeats.grid_candidates(words)), strict=True)}
    plain = {(k * p, k * p + p) for p in range(1, 201) for k in range(400 // p) if k * p + p < 400 and words[k * p] == words[k * p + p]}
    assert table == plain
    old, repeats.TABLE_WORDS = repeats.TABLE_WORDS, 10
    try:
        assert {tuple(p) for p in zip(*map(np.ndarray.tolist, repeats.grid_candidates(words)), strict=True)} == plain
    finally:
        repeats.TABLE_WORDS = old


def test_extensions_of_the_grammar():
    rnd = random.Random(2)
    for size, kinds in ((2000, 1), (3000, 2), (500, 40)):
        symbols = np.array([0, *[1 + rnd.randrange(kinds) for _ in range(size)], 0])
        i = np.array([rnd.randrange(1, size) for _ in range(300)])
        j = np.array([rnd.randrange(1, size) for _ in range(300)])
        i, j = i[i != j], j[i != j]
        grammar = Grammar(symbols, 0)
        forward, back = grammar.extensions(i, j), grammar.mirrored().extensions(len(symbols) - i, len(symbols) - j)
        for a, b, f, g in zip(i.tolist(), j.tolist(), forward.tolist(), back.tolist(), strict=True):
            n = 0
            while symbols[a + n] == symbols[b + n] and max(a, b) + n < len(symbols) - 1:
                n += 1
            m = 0
            while min(a, b) - m - 1 >= 0 and symbols[a - m - 1] == symbols[b - m - 1]:
                m += 1
            assert (f, g) == (n, m)


def test_runs_of_odd_segments(spark):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*ODD, *ODD])], "segment_id long, text string, runs string")
    got = repeats.periodic_runs(rows).collect()
    assert len(got) == 2 * len(ODD)
    for r in got:
        words = WORD.findall(r.text or "")
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == plain_runs(words) and r.collapsed_text is not None
    assert {r.collapsed_text for r in got if r.text == ODD[8]} == {"x y z"}
    assert repeats.periodic_runs(rows.limit(0)).count() == 0


# --- mix

def test_mix_equals_a_plain_dual_and_a_plain_debt(spark):
    rnd = random.Random(8)
    rows = [(i % 50 if i % 3 else 7, rnd.choice(["a", "b", None]), "w " * rnd.choice([0, 1, 3, 20, 90])) for i in range(900)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "segment_id long, env string, text string, rate string")
    out = mixing.mix_segments(table, block_rows=10**9).collect()
    assert sorted(out, key=str) == sorted(mixing.mix_segments(table.repartition(7), block_rows=10**9).collect(), key=str)
    for env in ("a", "b", None):
        mine = [r for r in out if r.env == env]
        sizes = [r.size for r in mine if r.size]
        scale = sum(sizes) / len(sizes)
        rate = lambda t, s: 2 / (1 + math.exp(-t * s / scale))
        low, high = -200.0, 200.0
        for _ in range(200):
            t = (low + high) / 2
            low, high = (t, high) if sum(s * rate(t, s) for s in sizes) < mine[0].target else (low, t)
        for r in mine:
            full = r.target >= 2 * r.source_size * (1 - 1e-12)
            assert r.rate == pytest.approx(2.0 if full and r.size else rate(low, r.size) if r.size else 0.0, abs=1e-6)
        debt, copies = 0, collections.Counter()
        for size, unit in sorted(((r.size, round(r.rate * mixing.UNIT)) for r in mine), reverse=True):
            n, part = divmod(unit, mixing.UNIT)
            more = size and part and 2 * (debt + part * size) >= size * mixing.UNIT
            debt += size * (part - bool(more) * mixing.UNIT)
            copies[size, n + bool(more)] += 1
        assert copies == collections.Counter((r.size, r.copies) for r in mine)


def test_mix_of_one_id_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPLIT_ROWS", 50)
    rows = spark.createDataFrame([(None, "a", "w w w")] * 700 + [(1, "b", "w")] * 3, "segment_id long, env string, text string")
    out = mixing.mix_segments(rows, block_rows=20).collect()
    assert len(out) == 703
    spent = collections.Counter()
    for r in out:
        spent[r.env] += r.taken
    assert all(abs(spent[r.env] - r.target) <= 3 for r in out)


def test_digest_of_runs_covers_planted_periods(spark):
    rows = {r.doc_id: r for r in queries()["op13_repeats"](spark, SF).collect()}
    for i, text, _ in documents():
        words, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        if len(words) > 3000:
            continue
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert rows[i].n_runs == len(runs) and rows[i].runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
