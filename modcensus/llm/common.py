"""What several operators share: tables, landed frames and files in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from modcensus.llm.vectext import portions
from modcensus.runtime import CHECKPOINT_SETTING, default_folder, land, shared_folder

__all__ = ["fresh_folder", "file_system", "fold", "land", "sampled_labels", "sampled_texts", "shared_folder", "table", "whole_text", "with_results"]


@cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="modcensus-llm-")


def _own_folder(spark: SparkSession) -> str:
    """A local folder, for local sessions that name none."""
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder that all executors share.")
    return _temporary()


default_folder(_own_folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder's address in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/modcensus/{label}-{uuid.uuid4().hex}"


def file_system(address: str) -> tuple[fs.FileSystem, str]:
    """Where tasks put files that are not Spark's; a bare path is a local one."""
    if address.startswith("file:"):
        address = "/" + address[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(address)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(key: Column, folds: int) -> Column:
    """The remainder of the key's crc32; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def with_results(docs: DataFrame, compute, fields: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and those that ``compute`` makes of each whole text.

    ``compute`` gets a string array of few texts without nulls and returns the arrays of ``fields``.
    Tasks hold some megabytes of text at a time, or one longer text.
    """
    rows = docs.select(*keep, whole_text(text).alias("_whole_text_"))
    schema = T.StructType([*(docs.schema[name] for name in keep), *T._parse_datatype_string(fields)])
    out = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(keep)
        for batch in portions(batches, last):
            made = compute(batch.column(last))
            columns = [*batch.columns[:last], *(pa.array(x, f.type) for x, f in zip(made, list(out)[last:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return rows.mapInArrow(read, schema)


def sampled_labels(labels: DataFrame, label: str, bound: int, allowed: Column) -> tuple[DataFrame, float]:
    """(doc_id, label) of about ``bound`` ids for each label 0 and 1, and the share of label 1.

    Ids with different labels, or none, are left out. The ids are chosen by their hash.
    """
    known = labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").select("doc_id", "label")
    counts = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    space = 1 << 30
    below = F.when(F.col("label") == 1, int(space * min(1, bound / max(counts.get(1, 0), 1)))).otherwise(int(space * min(1, bound / max(counts.get(0, 0), 1))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(space)) < below)
    return chosen, counts.get(1, 0) / max(sum(counts.values()), 1)


def sampled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, label, text) of the chosen ids; of several texts of an id the least."""
    # bounded: sampled_labels keeps some thousand ids, whatever the table's size
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
