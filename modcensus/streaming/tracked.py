"""Usage counts that follow files as they change.

Each file (repository, path) has a keyed state in the stream: what it was last seen with, and how often it
names each source and version. A file that is landed anew, with other contents, takes its old counts back
and adds the new ones; one that is landed again unchanged changes nothing. What is written are these
differences, so a summary is their sum, and neither old files nor old results are read again.

Texts end where they are read: the state gets each file's sources only. State and differences are
kept by the checkpoint, so a restart goes on where the last run ended. With very many files choose the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modcensus.operators.extract import file_sources
from modcensus.schemas import IAC_FILES

KEY = ["repository", "path"]
DIFFERENCE = "type STRING, source STRING, version STRING, n LONG"
STATE = "usage STRING"


def landed_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the ``iac_files`` rows in a folder of Parquet files, with the time they were landed as ``landed_at``."""
    rows = spark.readStream.schema(IAC_FILES).parquet(folder)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("landed_at"))


def _differences(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a file's landings in a batch the last counts; equal times go to the greater sha, then usage."""
    last = max((row for frame in frames for row in zip(frame["landed_at"], frame["sha"].fillna(""), frame["usage"], strict=True)), key=lambda row: row)
    before = Counter({tuple(call): n for call, n in json.loads(state.get[0])} if state.exists else {})
    after = Counter(tuple(call) for call in json.loads(last[2]))
    if after != before or not state.exists:
        state.update((json.dumps(sorted(after.items(), key=repr)),))
    rows = [(*call, after[call] - before[call]) for call in sorted(before | after, key=repr) if after[call] != before[call]]
    yield pd.DataFrame(rows, columns=["type", "source", "version", "n"])


def usage_differences(files: DataFrame) -> DataFrame:
    """(type, source, version, n): by how much the counts change, from a stream with ``landed_at``."""
    sources = file_sources(files.select(*KEY, "file_type", "sha", "landed_at", "content"))
    # a file may change its kind with its name only, so the kind is part of the counts
    calls = F.transform("sources", lambda call: F.array(F.col("file_type"), call["source"], call["version"]))
    rows = sources.select(*KEY, "sha", "landed_at", F.to_json(calls).alias("usage"))
    return rows.groupBy(*KEY).applyInPandasWithState(_differences, DIFFERENCE, STATE, "append", GroupStateTimeout.NoTimeout)


def track_usage(files: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed and stop; start again to process what came since."""
    return (
        usage_differences(files).writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def tracked_usage(spark: SparkSession, output: str) -> DataFrame:
    """Usage counts of the files as they are now, as ``usage_counts`` gives them."""
    rows = spark.read.schema(DIFFERENCE).parquet(output)
    return rows.groupBy("type", "source", "version").agg(F.sum("n").alias("n")).where("n > 0")
