"""Shared scratch tables and positions that survive the loss of executors."""

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
COMPACT = "zstd"
_REMOVAL_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_own_folder: list[Callable[[SparkSession], str]] = []
_open_scope: ContextVar[list[str] | None] = ContextVar("landed tables", default=None)


def use_folder(folder: str | Callable[[SparkSession], str]) -> None:
    """A folder for sessions that do not name one; it must be one that all executors share."""
    _own_folder[:] = [folder if callable(folder) else lambda spark: folder]


def default_folder(folder: str | Callable[[SparkSession], str]) -> None:
    """As ``use_folder``, unless one was given before."""
    if not _own_folder:
        use_folder(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, else the one given to ``use_folder``."""
    folder = spark.conf.get(CHECKPOINT_SETTING, "")
    if folder:
        return folder
    if not _own_folder:
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder that all executors share, or call use_folder.")
    return _own_folder[0](spark)


@contextmanager
def landed_tables(spark: SparkSession) -> Iterator[None]:
    """Tables landed inside are removed at the end: read what needs them before."""
    paths: list[str] = []
    token = _open_scope.set(paths)
    try:
        yield
    finally:
        _open_scope.reset(token)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside go when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_REMOVAL_SETTING, "false")
    spark.conf.set(_REMOVAL_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVAL_SETTING, before)


def evaluated(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    The optimizer copies a projected expression into every filter and projection that uses
    it, which multiplies long ones. It does not copy expressions out of a generator.
    """
    one = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return rows.select("*", F.inline(one))


def land(rows: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """Write ``rows`` once to the shared folder and read them back.

    For frames that are read several times and whose input is costly to recompute. The table
    stays until the enclosing ``landed_tables`` ends, or else until its folder is cleaned. ``compact``
    saves disk for some CPU time: a denser codec, and the shuffle files of the write are removed at its end.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/modcensus/{label}-{uuid.uuid4().hex}"
    if (scope := _open_scope.get()) is not None:
        scope.append(path)
    if compact:
        with shuffles_removed(spark):
            rows.write.option("compression", COMPACT).parquet(path)
    else:
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def with_position(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Sort over the whole cluster and number the rows 1, 2, 3, ...; ``is_last`` marks the last.

    A window without partitions would pull all rows into one task. Here the range
    sort runs once and lands with (partition, place in partition); the only data
    gathered afterwards is one row count per sort partition.
    """
    place_bits = 33  # monotonically_increasing_id keeps the place in the low 33 bits
    numbered = rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    landed = land(numbered, "sorted").withColumn("_part", F.shiftright("_place", place_bits))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        landed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
            F.sum("_rows").over(Window.partitionBy()).alias("_total"),
        )
    )
    # bounded: at most one row per sort partition
    placed = landed.join(F.broadcast(offsets), "_part")
    position = F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << place_bits) - 1)) + 1
    return placed.select(
        *rows.columns, position.alias(name), (position == F.col("_total")).alias("is_last")
    )
