"""JSON-lines records in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill import schemas
from stridemill.operators.traces import flatten_segments, segment_struct
from stridemill.scale import global_rank


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records of a fixed schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_jsonl``, an empty table when there is no such file."""
    return read_jsonl(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema).limit(0)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines with their position over all files: by file, split and line."""
    lines = spark.read.text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_line")
    )
    kept = lines.filter(F.trim("value") != "")
    order = [F.col("file_path"), F.col("file_block_start"), F.col("_line")]
    return global_rank(kept, order, "pos").select("value", "pos")


def read_segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Flat segment table from segment records, telling a null success flag from a missing one."""
    lines = numbered_lines(spark, path)
    keys = F.json_object_keys(F.get_json_object("value", "$.metadata"))
    parsed = lines.select(
        F.from_json("value", schemas.SEGMENT_RECORD).alias("r"), "pos",
        F.coalesce(F.array_contains(keys, "trajectory_success"), F.lit(False)).alias("flag_present"),
    )
    return flatten_segments(parsed.select("r.*", "pos", "flag_present"))


def read_records(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Run records to (task headers, flat segments)."""
    lines = numbered_lines(spark, path)
    parsed = lines.select(F.from_json("value", schemas.RECORD).alias("r"), F.col("pos").alias("record_pos"))
    tasks = parsed.select(
        "r.task_id", "r.env", "r.goal", F.coalesce("r.success", F.lit(False)).alias("success"),
        F.coalesce("r.final_reward", F.lit(0.0)).alias("final_reward"),
        F.coalesce(F.size("r.steps"), F.lit(0)).cast("long").alias("n_steps"), F.col("record_pos").alias("first_pos"),
    )
    nested = parsed.select("record_pos", F.posexplode("r.segments").alias("_i", "s")).select(
        "s.*", F.struct("record_pos", "_i").alias("_at"))
    ranked = global_rank(nested, [F.col("_at")], "pos").drop("_at")
    return tasks, flatten_segments(ranked)


def read_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Retrieval log, one row per retrieved skill: its place in the record, and among the record's skills of its granularity."""
    log = read_jsonl(spark, path, schemas.RETRIEVAL_RECORD)
    every = F.col("retrieved_skills")
    placed = F.transform(every, lambda s, i: F.struct(
        (i + 1).alias("rank"),
        F.size(F.filter(F.slice(every, F.lit(1), i + 1), lambda x: x["granularity"].eqNullSafe(s["granularity"]))).alias("level_rank"),
        s.alias("s")))
    return log.select("task_id", "step", F.inline(placed)).select(
        "task_id", "step", "rank", "level_rank", F.coalesce("s.skill_id", F.lit("")).alias("skill_id"),
        F.col("s.granularity").alias("granularity"), F.col("s.metadata.retrieval_score").alias("score"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_segments(segs: DataFrame, path: str) -> None:
    write_jsonl(segs.select(segment_struct().alias("s")).select("s.*"), path)


def write_run(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame]) -> None:
    """Run output as parquet tables partitioned by run; earlier runs stay."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")


def read_run(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{name}")
    return df if run_id is None else df.filter(F.col("run_id") == run_id)
