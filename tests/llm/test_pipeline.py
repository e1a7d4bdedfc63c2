"""The stages on a small table: what each keeps, and that all ten queries are registered."""

import corpus_pipeline
import public_tokenizers

from __spark_entry__ import queries
from stridemill.llm import bpe


def test_all_queries_are_registered():
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages(spark):
    clean = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(6)]
    texts = [*clean, clean[0], clean[0] + " end", "short", None, "again and again " * 60, clean[1] + "z 10.20.30.40"]
    docs = spark.createDataFrame(
        [(i, t, "en", None if i % 3 else "s", len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", len(texts[0]))],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).selectExpr("*", "1 AS _copies", "'x' AS clean_text")
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 11]
    single = corpus_pipeline.near_duplicates(spark, kept, "")
    assert sorted(r.doc_id for r in single.collect()) == [0, 1, 2, 3, 4, 5]
    private = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, kept, "").collect()}
    assert private[11].text.endswith("z [IP]") and private[11].n_chars == len(private[11].text) and private[2].text == clean[2]
    mixed = corpus_pipeline.source_mix(spark, single, "")
    assert mixed.columns == corpus_pipeline.COLUMNS and 6 <= mixed.count() <= 12
    out = corpus_pipeline.tokens(spark, single, "").collect()
    tok = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.ids) for r in out} == {i: tok.encode(clean[i]).tobytes() for i in range(6)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
