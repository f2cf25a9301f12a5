"""First rows per group, safe for groups of any size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

BUCKETS = 64


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, spread: list[str]) -> DataFrame:
    """The first ``n`` rows of every group, in two rounds.

    A group is cut into buckets by the hash of ``spread``, each bucket keeps its first ``n``
    rows, and only those meet in one task. The result is exact: every row among the first
    ``n`` of its group is also among the first ``n`` of its bucket.

    Each task drops what its own rows rule out before the first shuffle. Rows that come from a
    join or aggregate on the group key alone would stay in its partitions, a big group in one:
    hand over rows spread by a further key, as ``join_single`` leaves them.
    """
    bucket = F.pmod(F.xxhash64(*spread), F.lit(BUCKETS)).alias("_bucket")
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    in_group = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.select("*", bucket)
        .withColumn("_rank", F.row_number().over(in_bucket))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(in_group))
        .where(F.col("_rank") <= n)
        .drop("_bucket", "_rank")
    )
