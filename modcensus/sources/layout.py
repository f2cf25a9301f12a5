"""A landing layout for file contents, made for scans of some owners and for attaching texts.

Contents are partitioned by a bucket of their owner and, within, bucketed and sorted by (host, full name, path):

* a scan of some owners reads their partitions only. The list of wanted buckets joins on the partition
  column, so Spark prunes partitions with it at run time, whatever the list's size;
* a join on (host, full name, path) finds the texts where they lie. Only the other side, without
  texts, is exchanged into as many partitions as there are buckets. The path is part of the key, so a
  repository with very many files is spread over all buckets.

The folder keeps the layout's numbers in ``layout``, so that another session opens it as it was written.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modcensus.runtime import COMPACT, shuffles_removed
from modcensus.schemas import FILE_CONTENTS

KEY = ["host", "full_name", "path"]
BUCKET = "owner_bucket"
OWNER_BUCKETS, BUCKETS = 256, 1_024
WRITERS = 1_024  # tasks of a write at most, or as many as buckets


def owner_bucket(host: Column, full_name: Column, buckets: int) -> Column:
    """The bucket of a repository's top-level owner on its host; nested groups share that of the topmost."""
    return F.pmod(F.xxhash64(host, F.substring_index(full_name, "/", 1)), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class ContentsLayout:
    """Contents in a folder that all executors see."""

    folder: str
    owner_buckets: int = OWNER_BUCKETS
    buckets: int = BUCKETS

    @property
    def table(self) -> str:
        """The catalog's name for the folder in this session."""
        return "modcensus_contents_" + "".join(f"{byte:02x}" for byte in self.folder.encode()[-40:])

    def write(self, contents: DataFrame, **late: Column) -> None:
        """Land a ``file_contents`` table; texts are exchanged here once, and in no join afterwards.

        ``late`` gives columns that ``contents`` has in a smaller form: they are computed of its other columns behind
        the exchange. Each task sorts a bucket's part, for some of the owner buckets, so that what is spilled at a time is small.
        """
        spark = contents.sparkSession
        rows = contents.withColumn(BUCKET, owner_bucket(F.col("host"), F.col("full_name"), self.owner_buckets))
        parts = max(1, min(self.owner_buckets, WRITERS // self.buckets))
        bucket = F.pmod(F.hash(*KEY), F.lit(self.buckets))  # Spark's own
        dealt = rows.repartitionById(self.buckets * parts, (bucket * parts + F.col(BUCKET) % parts).cast("int"))
        names = [*spark.createDataFrame([], FILE_CONTENTS).columns, BUCKET]
        landed = dealt.select(*[late[name].alias(name) if name in late else F.col(name) for name in names])
        writer = landed.write.partitionBy(BUCKET).bucketBy(self.buckets, *KEY).sortBy(*KEY).option("compression", COMPACT)
        with shuffles_removed(spark):
            writer.option("path", f"{self.folder}/contents").format("parquet").saveAsTable(self.table)
        numbers = spark.createDataFrame([(self.owner_buckets, self.buckets)], "owner_buckets INT, buckets INT")
        numbers.coalesce(1).write.parquet(f"{self.folder}/layout")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "ContentsLayout":
        """The layout of a written folder, known to this session's catalog."""
        layout = cls(folder, *spark.read.parquet(f"{folder}/layout").first())
        if not spark.catalog.tableExists(layout.table):
            keys = ", ".join(KEY)
            spark.sql(
                f"CREATE TABLE {layout.table} ({FILE_CONTENTS}, {BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET}) "
                f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout.buckets} BUCKETS LOCATION '{folder}/contents'"
            )
            spark.sql(f"ALTER TABLE {layout.table} RECOVER PARTITIONS")
        return layout

    def read(self, spark: SparkSession) -> DataFrame:
        """The ``file_contents`` columns and the partition column."""
        return spark.table(self.table)


def of_listed_owners(contents: DataFrame, repositories: DataFrame, owner_buckets: int) -> DataFrame:
    """Contents in the partitions of the listed repositories' owners; others are not read.

    The wanted buckets are at most ``owner_buckets`` rows, so they are broadcast at any size of the list.
    """
    buckets = repositories.select(owner_bucket(F.col("host"), F.col("full_name"), owner_buckets).alias(BUCKET)).distinct()
    # a comparison on the list's side is what makes Spark expect that pruning pays
    return contents.join(F.broadcast(buckets.where(F.col(BUCKET) >= 0)), BUCKET, "left_semi")
