"""Token ids as flat binary files with 64-bit document offsets, made for memory mapping.

A data set is a folder of parts. Part p has ``<stem>.ids`` (unsigned 16 or 32 bit integers, little
endian, one document after the other), ``<stem>.offsets`` (n + 1 unsigned 64 bit places in it) and
``<stem>.keys`` (the documents' keys, an Arrow file). Parts follow each other in ascending key
order; the manifest has one row a part with its first id's place in the whole: the prefix sum of the
ids of the parts before.

A task writes under a name of its own attempt, and the manifest names only parts of attempts that
were committed, so lost executors leave at most files that nobody reads.

Defined cases: null texts are empty ones; each document gets the end id, so none has no ids; null
keys come first; repeated keys stay, ordered by a hash of their texts; an empty table gives an empty data set.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modcensus.llm.bpe import text_encoder
from modcensus.llm.common import file_system, fresh_folder, whole_text

PART = "part INT, stem STRING, dtype STRING, documents LONG, ids LONG"
READ_ROWS, READ_IDS = 2_000, 1 << 18  # of a batch that is read back, at most; a longer document is one of its own


def _write_part(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        encoder = text_encoder(tokenizer)
        dtype = "<u2" if max(encoder.vocabulary - 1, end_id) < 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        stem = f"part-{part:06d}-{uuid.uuid4().hex}"
        files, path = file_system(folder)
        end = np.array([end_id], "<u4").tobytes()
        offsets = [np.zeros(1, "<u8")]
        total = documents = 0
        with files.open_output_stream(f"{path}/{stem}.ids") as ids_file, files.open_output_stream(f"{path}/{stem}.keys") as keys_file:
            keys = pa.schema([batch.schema.field(0).with_name("key")])
            with pa.ipc.new_file(keys_file, keys) as keys_out:
                while batch is not None:
                    lengths = []
                    for text in batch.column(1):
                        ids = np.frombuffer(encoder.encode(text.as_py()) + end, "<u4")
                        ids_file.write(ids.astype(dtype).tobytes())
                        lengths.append(len(ids))
                    offsets.append(total + np.cumsum(lengths, dtype="<u8"))
                    total += sum(lengths)
                    documents += len(lengths)
                    keys_out.write_batch(pa.record_batch([batch.column(0)], schema=keys))
                    batch = next(batches, None)
        with files.open_output_stream(f"{path}/{stem}.offsets") as offsets_file:
            for some in offsets:
                offsets_file.write(some.tobytes())
        row = {"part": part, "stem": stem, "dtype": dtype, "documents": documents, "ids": total}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("stem", pa.string()), ("dtype", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Encode whole texts, write the parts below ``folder``, and return the manifest.

    Without ``parts``, Spark chooses their number. Equal rows part by the task they were read in, so that
    any number of them is spread. The manifest's columns: part, stem, dtype, documents, ids, base, folder. It is also kept as
    Parquet in ``<folder>/manifest``.
    """
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"), F.spark_partition_id().alias("_from_"))
    spread = [*([parts] if parts else []), "key", F.xxhash64("text"), "_from_"]
    ordered = rows.repartitionByRange(*spread).select("key", "text").sortWithinPartitions("key", F.xxhash64("text"))
    ordered.mapInArrow(_write_part(folder, tokenizer, end_id), PART).write.parquet(f"{folder}/parts")
    written = docs.sparkSession.read.schema(PART).parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each written part, so the window is over as many rows as there were tasks
    manifest = written.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).withColumn("folder", F.lit(folder))
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _mapped(files, path: str) -> pa.Buffer:
    if files.type_name == "local":
        with pa.memory_map(path) as file:
            return file.read_buffer()
    with files.open_input_file(path) as file:
        return file.read_buffer()


def _read_parts(key_type: pa.DataType):
    out = pa.schema([("key", key_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                files, path = file_system(part["folder"])
                stem = f"{path}/{part['stem']}"
                offsets = np.frombuffer(_mapped(files, f"{stem}.offsets"), "<u8").astype("int64")
                ids = np.frombuffer(_mapped(files, f"{stem}.ids"), part["dtype"])
                keys = pa.ipc.open_file(pa.BufferReader(_mapped(files, f"{stem}.keys"))).read_all().column("key")
                at = 0
                while at < part["documents"]:
                    to = int(np.searchsorted(offsets, offsets[at] + READ_IDS, "right")) - 1
                    to = min(max(to, at + 1), at + READ_ROWS, part["documents"])
                    starts, ends = offsets[at:to], offsets[at + 1 : to + 1]
                    found = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)]
                    some = pa.array(keys.slice(at, to - at).to_pylist(), key_type)
                    yield pa.record_batch([some, starts + part["base"], ends - starts, pa.array(found, pa.binary())], schema=out)
                    at = to

    return read


def read_token_files(manifest: DataFrame, key_type: str = "LONG") -> DataFrame:
    """A row for each document: key, start (ids before it), n_tokens, ids (little-endian u32)."""
    types = {"LONG": pa.int64(), "INT": pa.int32(), "STRING": pa.string()}
    # a number is kept by adaptive execution, which would merge the manifest's few bytes into one task
    rows = manifest.repartitionByRange(max(1, manifest.count()), "part")
    return rows.mapInArrow(_read_parts(types[key_type.upper()]), f"key {key_type}, start LONG, n_tokens LONG, ids BINARY")


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The round trip through files in the shared folder."""
    folder = fresh_folder(spark, "token-files")
    manifest = write_token_files(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer, end_id, folder)
    return read_token_files(manifest)


