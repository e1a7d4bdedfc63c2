"""Finding and reading run outputs, and writing report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill import schemas

# fixed values
SUMMARY_FILES = ["summary.json", "model_summary.json", "selector_metrics.json", "deployment_summary.json", "mining_summary.json"]
SORT_COLUMNS = ["row_type", "method", "selector", "experiment_dir"]


def _documents(spark: SparkSession, paths: list[str], pattern: str, recursive: bool) -> DataFrame:
    """Whole JSON documents with their path; listing and reading are Spark's."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("path"))


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/[^/]*$", ""), "^file:/+", "/")


def discover(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """``kind, location`` of runs, models and selector results under folders or named by files.

    Folder summaries point at their runs; a configuration file points at its output folder.
    """
    folders = [p for p in paths if not p.endswith(".json")]
    files = [p for p in paths if p.endswith(".json")]
    docs = None
    if folders:
        docs = _documents(spark, folders, "{" + ",".join(SUMMARY_FILES) + "}", recursive)
    if files:
        named = _documents(spark, files, "*.json", False)
        docs = named if docs is None else docs.unionByName(named)
    name = F.element_at(F.split("path", "/"), -1)
    folder = parent(F.col("path"))
    nested = F.from_json("value", "runs array<struct<experiment_dir:string>>, models array<struct<model_dir:string>>, "
                                  "runtime struct<output_dir:string>")
    one = lambda kind, place: F.array(F.struct(F.lit(kind).alias("kind"), place.alias("location")))
    found = (
        F.when(name == "summary.json", one("run", folder))
        .when(name == "model_summary.json", one("model", folder))
        .when(name == "selector_metrics.json", one("selector", F.regexp_replace("path", "^file:/+", "/")))
        .when(name == "deployment_summary.json", F.transform(
            F.col("d.runs"), lambda r: F.struct(F.lit("run").alias("kind"), r["experiment_dir"].alias("location"))))
        .when(name == "mining_summary.json", F.transform(
            F.col("d.models"), lambda r: F.struct(F.lit("model").alias("kind"), r["model_dir"].alias("location"))))
        .otherwise(one("run", F.col("d.runtime.output_dir")))
    )
    rows = docs.withColumn("d", nested).select(F.explode(found).alias("f")).select("f.*")
    return rows.filter("location <> ''").distinct().orderBy("kind", "location")


def read_summaries(spark: SparkSession, folders: list[str], name: str = "summary.json", schema: str = schemas.SUMMARY) -> DataFrame:
    """One row per folder that has the file, with ``experiment_dir``."""
    docs = _documents(spark, folders, name, False)
    return docs.select(F.from_json("value", schema).alias("s"), parent(F.col("path")).alias("experiment_dir")).select("s.*", "experiment_dir")


def read_selector_results(spark: SparkSession, files: list[str]) -> DataFrame:
    docs = _documents(spark, files, "*.json", False)
    return docs.select(F.from_json("value", schemas.SELECTOR_METRICS).alias("s"),
                       F.regexp_replace("path", "^file:/+", "/").alias("selector_metrics_path")).select("s.*", "selector_metrics_path")


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def sorted_report(df: DataFrame) -> DataFrame:
    keys = [c for c in SORT_COLUMNS if c in df.columns]
    return df.orderBy(*keys) if keys else df


def write_report(df: DataFrame, folder: str, name: str) -> None:
    """A report table as CSV with header and as JSON lines, sorted; NaN becomes null."""
    ordered = sorted_report(nan_to_null(df))
    ordered.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    ordered.write.mode("overwrite").json(f"{folder}/{name}.json")


def write_union(frames: list[DataFrame], path: str) -> DataFrame:
    """Rows of different shapes under the sorted union of their columns."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    merged = merged.select(*sorted(merged.columns))
    merged.write.mode("overwrite").option("header", True).csv(path)
    return merged


def read_reports(spark: SparkSession, folder: str, suffix: str, prefix: str = "") -> DataFrame | None:
    """All report CSVs with a suffix, stacked; None without any. Empty files add nothing."""
    pattern = f"{prefix}_{suffix}.csv" if prefix else f"*_{suffix}.csv"
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter("length > 1").select("path")
    folders = sorted({p for p in _report_folders(names, pattern)})
    if not folders:
        return None
    frames = [spark.read.option("header", True).csv(p) for p in folders]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def _report_folders(names: DataFrame, pattern: str) -> list[str]:
    like = "/" + pattern.replace(".", r"\.").replace("*", "[^/]*")
    matched = names.filter(F.col("path").rlike(like + "(/|$)")).select(
        F.regexp_extract("path", "^(.*" + like + ")(/.*)?$", 1).alias("p")).distinct()
    return [r["p"] for r in matched.collect()]
