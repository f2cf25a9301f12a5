"""Joins with a side that has at most one row per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

SALTS = 8
FEW_SALTS = 2  # where the single side is about as large as the other: fewer copies, the rest is left to Spark


def never_broadcast(rows: DataFrame) -> DataFrame:
    """The side of an equi-join that grows with the data: exchanged and sorted, at any estimate of its size.

    Before a join runs, Spark estimates sizes from compressed files and the widths of columns; parsed payloads,
    exploded arrays and copies count as nothing. What it takes for a few megabytes may be gigabytes, which a
    broadcast gathers on the driver.
    """
    return rows.hint("merge")


def join_single(
    many: DataFrame, single: DataFrame, keys: list[str], how: str, spread: list[str] | None = None, salts: int = SALTS
) -> DataFrame:
    """Inner or left join of ``many`` with ``single``, whatever share of ``many`` one key holds.

    Rows of a key go to several tasks by the hash of ``spread``, or without it by that of all plain columns and
    of the task that reads them, so that equal rows part as well; a task that is run again gives its rows the
    same salt, in whatever order they come. ``single`` is copied to each.
    Besides, adaptive execution only splits a skewed partition when both sides are shuffled for
    the join itself; a ``single`` side that was just grouped by the same keys would not be. The
    salt makes it so. A side that Spark takes for small is still broadcast, unless it is ``never_broadcast``.
    """
    plain = [field.name for field in many.schema if isinstance(field.dataType, AtomicType)]
    by = F.xxhash64(*(spread or [*plain, F.spark_partition_id()]))
    salt = F.pmod(by, F.lit(salts)).cast("int")
    copies = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")
