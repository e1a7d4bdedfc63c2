import time
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridemill import scale
from stridemill.operators import traces
from stridemill.operators.refine import mid_co_usage


def skewed(spark, n=3000):
    """A third of all rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("key"), (F.col("id") * 7919 % n).alias("pos"))


def test_number_rows_hot_keys(spark):
    df = skewed(spark)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("pos")).cast("long"))
    split = scale.number_rows(df, ["key"], [F.col("pos")], "n", hot_rows=100)
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_global_rank_with_ties(spark):
    df = spark.range(1000).select(F.lit(1.0).alias("v"), "id")
    for small_rows in (10, 10_000):
        ranks = scale.global_rank(df, [F.col("v"), F.col("id")], "r", small_rows).collect()
        assert len(ranks) == 1000 and all(r["r"] == r["id"] for r in ranks)


def test_halo_windows(spark):
    steps = spark.range(1, 101).select(F.lit("a").alias("task_id"), F.col("id").alias("t"), F.col("id").cast("string").alias("action"))
    rows = scale.halo_chunks(steps, "t", before=5, after=1, size=10)
    window = Window.partitionBy("task_id", "_chunk").orderBy("t")
    seen = rows.select("t", "_core", F.collect_list("action").over(window.rowsBetween(-5, -1)).alias("last"),
                       F.lead("t").over(window).alias("next")).filter("_core").orderBy("t").collect()
    assert [r["t"] for r in seen] == list(range(1, 101))
    for r in seen:
        assert r["last"] == [str(i) for i in range(max(1, r["t"] - 5), r["t"])]
        assert r["next"] == (r["t"] + 1 if r["t"] < 100 else None)


def test_lookup_join(spark):
    df = skewed(spark)
    lookup = df.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    assert scale.lookup_join(df, lookup, ["key"]).agg(F.count(F.lit(1))).first()[0] == df.count()


def test_number_steps_both_ways(spark):
    logged = skewed(spark).select(F.col("key").cast("string").alias("task_id"), "pos", (F.col("pos") % 5).cast("double").alias("reward"))
    columns = ["task_id", "pos", "t", "n_steps", "final_reward"]
    a = traces.number_steps(logged, ["pos"]).select(*columns)
    b = traces.number_steps(logged, ["pos"], hot_rows=100).select(*columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_co_usage_beyond_one_mask_block(spark):
    ids = [(1, f"m{i:02d}", "mid") for i in range(14)]
    counted = mid_co_usage(spark.createDataFrame(ids, "task_id int, skill_id string, granularity string"), ["task_id"])
    assert counted.count() == 2**14 - 14 - 1
    assert counted.filter(F.size("mids") == 14).count() == 1


def test_shuffle_files_of_a_stored_table_are_dropped(spark, monkeypatch):
    from stridemill.llm import backoff

    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {p for d in folders for p in Path(d).rglob("shuffle_*.data")}

    def table():
        return spark.range(5000).repartition("id").groupBy((F.col("id") % 7).alias("g")).count()

    before = files()
    kept = scale.checkpoint(table())
    plain = files()
    assert plain - before
    alone = scale.checkpoint_alone(table)
    assert wait(lambda: not files() - plain) and sorted(alone.collect()) == sorted(kept.collect())
    assert spark.conf.get(scale.SHUFFLE_CLEANUP) == "false"

    stored = []
    monkeypatch.setattr(backoff, "checkpoint_alone", lambda make: stored.append(scale.checkpoint_alone(make)) or stored[-1])
    backoff.score_segments(spark.createDataFrame([(1, "a b"), (2, "b")], "segment_id long, text string"), F.lit(True))
    assert "sizes" in stored[0].columns


def wait(done, seconds=10):
    until = time.time() + seconds
    while not done() and time.time() < until:
        time.sleep(0.1)
    return done()
