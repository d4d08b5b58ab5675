"""Session defaults, shared-folder materialisation and size checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows one task may sort or buffer for a single group before an operator
# switches to its range-partitioned form. Override per session with
# spark.conf.set("nestgrain.rowsPerTask", ...).
ROWS_PER_TASK = 2_000_000

# What may be broadcast to every executor: both limits hold, and both are measured.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


# Rows of one side that a task sorts or hashes at once where an operator deals out its rows itself.
ROWS_PER_PART = 500_000


def build_session(app: str = "nestgrain", master: str | None = None, cores: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores))
        builder = builder.config("spark.driver.memory", "8g")
    return builder.getOrCreate()


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get("nestgrain.rowsPerTask", str(ROWS_PER_TASK)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("nestgrain.broadcastRows", str(BROADCAST_ROWS)))


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions that leave each about ``ROWS_PER_PART`` rows, never fewer than the session's."""
    per_part = int(spark.conf.get("nestgrain.rowsPerPart", str(ROWS_PER_PART)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def dealt(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """``df`` partitioned on ``keys`` into ``parts``, by default as many as its own rows need.

    Shuffles that Spark plans have a fixed number of partitions, and merging small ones goes by compressed
    bytes, so a task's rows grow with the input; these do not. Later groupings and joins on ``keys`` need
    no other shuffle. Rows of one key stay together: for keys that are unique or nearly so.
    """
    return df.repartition(parts or parts_for(df.sparkSession, df.count()), *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a temp folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="nestgrain-checkpoint-")
    context.setCheckpointDir(shared)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back from there.

    Needed where a value depends on physical placement (a range partition id) or
    where a loop would otherwise grow the lineage without bound.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the biggest key group: a map-side combined count, then one max."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")) if keys else df.agg(F.count(F.lit(1)).alias("__n"))
    return int(counts.agg(F.max("__n")).first()[0] or 0)


def is_at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows: one plain count, combined before the shuffle."""
    return df.count() <= rows


def _row_bytes(df: DataFrame) -> Column:
    """Approximate size of one row: text by its bytes, arrays by their length, nested values by their JSON."""
    width = F.lit(0).cast("bigint")
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            part = F.octet_length(column)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            part = F.size(column) * 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            part = F.octet_length(F.to_json(F.struct(column)))
        else:
            part = F.lit(8)
        width = width + F.greatest(F.coalesce(part, F.lit(0)), F.lit(0))
    return width


def fits_broadcast(df: DataFrame) -> bool:
    """Measured rows and bytes within the broadcast limits: one aggregate, one small row per partition in the shuffle."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    return found["n"] <= broadcast_rows(df.sparkSession) and (found["b"] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast when its measured size allows, else leave the choice to Spark."""
    return F.broadcast(df) if fits_broadcast(df) else df


def spread(df: DataFrame) -> tuple[DataFrame, int]:
    """Store ``df`` once, spread evenly, before several passes of heavy per-row work, whatever its size.

    Left to itself every pass would run everything upstream again, and a small table sits in one
    or two file splits and would run on as many cores. Round-robin over the shuffle partitions,
    whose number comes back too.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialise(df.repartition(tasks)), tasks
