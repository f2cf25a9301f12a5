"""Incremental scans: newly landed files are extracted once and added to the call tables.

Extraction keeps no state, so the stream needs none either. Usage counts add up, so every
batch writes its own counts and a summary only sums them; nothing is read again.

The landing folder is append-only: a file that is landed anew, with other contents, is a further
file to the summary. Land changed repositories in a folder of their own, or scan them whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modcensus.operators.extract import module_calls
from modcensus.operators.usage import usage_counts
from modcensus.schemas import IAC_FILES


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the ``iac_files`` rows in a folder of Parquet files."""
    return spark.readStream.schema(IAC_FILES).parquet(folder)


def scan_incrementally(files: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed and stop; start again to process what came since.

    Each batch owns the folders ``calls/batch=N`` and ``usage/batch=N`` and replaces them when
    it is repeated after a failure, so no call is counted twice.
    """
    def write_batch(batch: DataFrame, number: int) -> None:
        calls_folder = f"{output}/calls/batch={number}"
        module_calls(batch).write.mode("overwrite").parquet(calls_folder)
        landed = batch.sparkSession.read.parquet(calls_folder)
        landed.transform(usage_counts).write.mode("overwrite").parquet(f"{output}/usage/batch={number}")

    return (
        files.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_calls(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/calls").drop("batch")


def read_usage(spark: SparkSession, output: str) -> DataFrame:
    """Usage counts over all batches, as ``usage_counts`` gives them."""
    batches = spark.read.parquet(f"{output}/usage")
    return batches.groupBy("type", "source", "version").agg(F.sum("n").alias("n"))
