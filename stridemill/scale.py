"""Session set-up and the skew-safe building blocks every operator shares.

One key may hold a third of all rows, so nothing here may put an unbounded
group into one task or one broadcast:

* ``checkpoint``    cuts lineage in the shared checkpoint folder (``checkpoint_alone``: and drops the shuffle files)
* ``handed_on``     the same for a table made from one stored before, whose files are removed
* ``stored_table``  the same as columns, for wide rows read several times
* ``global_rank``   ordinal position by range partitioning (ties and hot keys split)
* ``number_rows``   row number inside keys; hot keys leave the window for ``global_rank``
* ``halo_chunks``   bounded windows over long sequences
* ``lookup_join``   row table to lookup table, broadcast if small, salted otherwise
* ``top_rows``      first k rows per key (planned with a map-side group limit)
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
CHUNK_ROWS = 4096
BROADCAST_BYTES = 32 * 1024 * 1024
LOOKUP_SALTS = 16
SMALL_ROWS = 50_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "stridemill", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    parts = "8" if cpus == "*" else str(cpus)
    settings = {
        "spark.sql.shuffle.partitions": parts,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage is cut into: the session's own, else a local one in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="stridemill-ckpt-")
    context.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and forget how it was computed."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """``checkpoint`` of the table ``make`` builds, whose shuffle files are dropped as soon as it is stored.

    For tables whose shuffle outweighs the result, so that both need not fit the disk along with the next shuffle.
    """
    spark = SparkSession.active()
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return checkpoint(make())
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def handed_on(make: Callable[[], DataFrame], before: DataFrame | None) -> DataFrame:
    """``checkpoint_alone`` of a table made from ``before``, a result of ``checkpoint`` that nothing reads any more; its files are removed.

    For long chains of tables: the files of a checkpoint stay until the driver happens to collect its garbage.
    """
    table = checkpoint_alone(make)
    if before is not None:
        drop_checkpoint(before)
    return table


def drop_checkpoint(df: DataFrame) -> None:
    """Remove the files of a result of ``checkpoint`` that nothing reads any more."""
    context = df.sparkSession.sparkContext
    kept = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if kept.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored_table(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder as columns and read back.

    For wide rows read several times, each time for a few columns; a checkpoint would hold whole rows uncompressed.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. The rank filter lets Spark cut each map task to k rows per key."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def _partition_offsets(stored: DataFrame) -> DataFrame:
    """First rank of every range partition; one row per partition, so small by construction."""
    sizes = {r["_part"]: r["count"] for r in stored.groupBy("_part").count().collect()}
    rows, start = [], 0
    for part in sorted(sizes):
        rows.append((part, start))
        start += sizes[part]
    return stored.sparkSession.createDataFrame(rows, "_part long, _start long")


def global_rank(df: DataFrame, order: list, name: str, small_rows: int = SMALL_ROWS, stored: bool = False) -> DataFrame:
    """Zero-based position of every row in the total order ``order``.

    Range partitioning splits long runs of equal leading values by the later
    columns, so no task sees more than its share, whatever the skew. A table of up to
    ``small_rows`` rows, as counted, is ranked by one window instead. ``stored`` says that ``df`` is read from storage already.
    """
    held = df if stored else checkpoint(df)
    if held.count() <= small_rows:
        return held.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    placed = (
        held.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_slot", 33))
    )
    kept = checkpoint(placed)
    within = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        kept.join(F.broadcast(_partition_offsets(kept)), "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_part", "_start", "_slot")
    )


def split_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of keys above ``hot_rows`` (None when there are none)."""
    heavy = df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys)
    if heavy.isEmpty():
        return df, None
    # at most rows / hot_rows keys
    heavy = checkpoint(heavy)
    return df.join(heavy, keys, "left_anti"), df.join(heavy, keys, "left_semi")


def number_rows(df: DataFrame, keys: list[str], order: list, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row number from 1 inside ``keys``; hot keys are numbered by range partitioning."""
    cold, hot = split_hot(df, keys, hot_rows)
    numbered = cold.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    if hot is None:
        return numbered
    ranked = global_rank(hot, [F.col(k) for k in keys] + list(order), "_rank")
    first = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    slow = (
        lookup_join(ranked, first, keys)
        .withColumn(name, F.col("_rank") - F.col("_first") + 1)
        .drop("_rank", "_first")
    )
    return numbered.unionByName(slow)


def halo_chunks(df: DataFrame, seq: str, before: int = 0, after: int = 0, size: int = CHUNK_ROWS) -> DataFrame:
    """Cut long sequences into chunks of ``size`` with the neighbours a window needs copied in.

    Adds ``_chunk`` (use it in the window's partition keys) and ``_core`` (keep
    only these rows afterwards). ``seq`` must be dense inside its key.
    """
    home = F.floor(F.col(seq) / size)
    at = F.pmod(F.col(seq), F.lit(size))
    homes = F.array_compact(
        F.array(
            home,
            F.when(at >= size - before, home + 1) if before else F.lit(None).cast("long"),
            F.when(at < after, home - 1) if after else F.lit(None).cast("long"),
        )
    )
    return df.withColumn("_chunk", F.explode(homes)).withColumn("_core", F.col("_chunk") == home)


def estimated_bytes(df: DataFrame, row_bytes: int) -> int:
    return df.count() * row_bytes


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", salts: int = LOOKUP_SALTS
) -> DataFrame:
    """Join many rows to one lookup row per key without gathering a hot key in one task.

    The lookup side is repeated under ``salts`` salts and the row side spread
    over them. Spark swaps in a broadcast at run time when the lookup is small.
    """
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*_atomic(rows)), F.lit(salts)))
    copied = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copied, [*keys, "_salt"], how).drop("_salt")


def _atomic(df: DataFrame) -> list[str]:
    """Columns xxhash64 accepts."""
    return [f.name for f in df.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "variant")]


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Mark an already materialised table for broadcast only when its measured size allows."""
    small = estimated_bytes(df, row_bytes) <= limit
    return (F.broadcast(df) if small else df), small
