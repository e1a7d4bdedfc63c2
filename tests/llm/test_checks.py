"""Queries with check SQL against it, and the rest against plain loops, on whole small tables."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken.load

from __spark_entry__ import oracle_sql, queries
from stridemill.llm.checks import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(tuple(r) for r in df.select(columns).collect())
    assert rows == sorted(result.fetchall()) and len(rows) > 20


def documents(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents").fetchall()


def test_shards_hold_every_document_once(spark, duck):
    rows = queries()["op1_sharding"](spark, SF).collect()
    texts = {i: t for i, t, _ in documents(duck)}
    slots = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(raw))
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tokens_are_the_encoders(spark, duck):
    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in queries()["op8_bpe"](spark, SF).collect()}
    for i, text, _ in documents(duck):
        ids = plain.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_mix_spends_each_sources_target(spark, duck):
    rows = queries()["op6_mixing"](spark, SF).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in documents(duck)}
    sources = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r.size == size[r.doc_id] and r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        s = sources[r.source]
        s[0], s[1], s[2] = s[0] + r.size, s[1] + r.taken, r.target
    for held, taken, target in sources.values():
        assert target <= 2 * held + 1e-6 and abs(taken - target) <= max(0.02 * target, max(size.values()))
    assert abs(sum(s[2] for s in sources.values()) - 1.5 * sum(size.values())) < 1
