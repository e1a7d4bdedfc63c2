"""The dealt queries: thin steps from the given tables to the operators' records and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.llm import backoff, bpe, chat, html, jaccard, language, mixing, pii, quality, repeats, sharding, vectors, whitening
from stridemill.llm.checks import ORACLE_SQL  # noqa: F401
from stridemill.plans.fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SHARDS = 40


def vocabulary() -> tuple[str, str]:
    """Rank file and pre-token pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def segments(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as segments: the source is the environment."""
    names = {"doc_id": "segment_id", "source": "env"}
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more).withColumnsRenamed(names)


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = segments(spark, sf_dir).select(
        "segment_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    return sharding.shard_segments(sized, SHARDS).select(
        F.col("segment_id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir, "lang")
    held = language.held_out(F.col("segment_id"))
    model = language.train_language(rows.filter(~held))
    return language.predict_language(rows.drop("lang"), model).select(
        F.col("segment_id").alias("doc_id"), held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_segments(segments(spark, sf_dir)).drop("text").withColumnRenamed("segment_id", "doc_id")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_segments(segments(spark, sf_dir, "source")).select(
        F.col("segment_id").alias("doc_id"), F.col("env").alias("source"), "size", "source_size", "target", "rate", "copies", "taken"
    )


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    awkward = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = turns.withColumnsRenamed({"conv_id": "trajectory_id", "turn": "t"})
    formatted = chat.format_messages(messages, ranks, pattern)
    return chat.conversation_digests(chat.read_messages(formatted, ranks, pattern)).withColumnRenamed("trajectory_id", "conv_id")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    encoded = bpe.encode_segments(segments(spark, sf_dir), ranks, pattern)
    return bpe.digests(bpe.decode_segments(encoded, ranks, pattern)).withColumnRenamed("segment_id", "doc_id")


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    found = pii.find_personal_data(rows, pii.train_tagger(rows))
    place = {k: i for i, k in enumerate(pii.KINDS)}
    order = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    every = F.array_sort(F.transform(
        F.concat("base_spans", "added_spans"),
        lambda s: F.struct(order[s["kind"]].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    ))
    return found.select(
        F.col("segment_id").alias("doc_id"), *[count(k) for k in pii.KINDS],
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(every).alias("spans"),
    )


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_segments(segments(spark, sf_dir)).withColumnRenamed("segment_id", "doc_id")


@query
def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = table(spark, sf_dir, "embeddings").withColumnsRenamed({"vec_id": "skill_id", "label": "granularity"})
    return vectors.link_skills(skills).withColumnRenamed("skill_id", "vec_id")


@query
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("observation"))
    return html.extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op11_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.encode(F.col("segment_id").cast("string"), "UTF-8")) % 5 == 1
    return backoff.score_segments(segments(spark, sf_dir), ~held).select(
        F.col("segment_id").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), F.col("embedding").alias("vector"))
    return whitening.whiten_segments(vectors).select(
        F.col("segment_id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained",
        "identity_error",
    )


@query
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text by hash is first made periodic from a word on, as the contract of the query says."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    planted = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumns(
        {"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)}
    )
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    planted = planted.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("words", (place(i) + 1).cast("int")))
    text = F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text"))
    found = repeats.periodic_runs(planted.select(F.col("doc_id").alias("segment_id"), text.alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("_longest", longest).select(
        F.col("segment_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.s")).alias("start"),
        F.col("_longest.l").alias("length"), (-F.col("_longest.p")).alias("period"),
        F.floor(1000 * F.col("_longest.l") / -F.col("_longest.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
