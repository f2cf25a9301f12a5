"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the hash of (key, shard); the record goes to the shard with the
smallest ``-ln(u) / weight``. One more shard only adds one more draw: a record either stays or goes
to the new shard. Everything is a column expression; no text crosses the network.

Defined cases: a null key is a key of its own; a null text is an empty text; rows that repeat a key
all go to that key's shard (the law of the method) and have slots of their own; empty tables give
empty results. Columns called ``shard``, ``slot`` or like the temporary ones are no obstacle, as only
the key and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modcensus.llm.common import land, whole_text
from modcensus.runtime import evaluated

DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double
ROW_BYTES = 8


def stable_key(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))


def draw(key: Column, of: Column) -> Column:
    """A whole number below 16 ** DIGITS out of the key and a further value."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), of).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def costs(key: Column, weights: Sequence[float]) -> list[Column]:
    """For each shard a struct (cost, shard); the least one wins."""
    if not weights or not all(w > 0 and math.isfinite(w) for w in weights):
        raise ValueError("weights must be positive and finite, one for each shard")
    uniform = [(draw(key, F.lit(str(i))) + 0.5) / float(16**DIGITS) for i in range(len(weights))]
    return [
        F.struct((-F.log(u) / float(w)).alias("cost"), F.lit(i).alias("shard"))
        for i, (u, w) in enumerate(zip(uniform, weights, strict=True))
    ]


def with_shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """All columns of ``docs`` and the shard of each row; no shuffle."""
    return docs.withColumn(name, F.array_min(F.array(*costs(stable_key(F.col(key)), weights)))["shard"])


def write_shards(docs: DataFrame, weights: Sequence[float], folder: str, key: str = "doc_id", name: str = "shard") -> None:
    """Whole records as Parquet, one folder for each shard; any task may write to any shard."""
    with_shard(docs, weights, key, name).write.partitionBy(name).parquet(folder)


def shard_slots(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, gapless place within it, and the shard under the weights ``grown``.

    ``grown`` starts with ``weights``. Places follow a hash of the key, so that neighbours in the
    table are no neighbours in a shard. One range sort over (shard, place's hash, key, row) splits
    any shard, and any repeated key, over many tasks; a shard's places then need one row count for
    each run of a shard in a sort partition.
    """
    if list(grown[: len(weights)]) != list(weights):
        raise ValueError("grown must start with weights")
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("_text"))
    rows = rows.select(
        "doc_id",
        (F.octet_length("_text") + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.col("_text").cast("binary")).alias("text_crc32"),
        stable_key(F.col("doc_id")).alias("_key"),
    )
    drawn = evaluated(rows, _costs=F.array(*costs(F.col("_key"), grown)), _order=draw(F.col("_key"), F.lit("order")))
    placed = land(
        drawn.select(
            "doc_id",
            "size",
            "text_crc32",
            F.array_min(F.slice("_costs", 1, len(weights)))["shard"].alias("shard"),
            F.array_min("_costs")["shard"].alias("grown_shard"),
            "_order",
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shards",
    )
    order = ["shard", "_order", "doc_id", "text_crc32", "size", "_row"]
    # the id's high bits are the sort partition, its low bits the place there
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = land(ordered.withColumn("_place", F.monotonically_increasing_id()), "slots")
    ordered = ordered.withColumn("_part", F.shiftright("_place", 33))
    runs = ordered.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # bounded: one row for each sort partition, and one more for each shard
    slots = ordered.join(F.broadcast(starts), ["shard", "_part"])
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("_place") - F.col("_first") + F.col("_before")).alias("slot"),
        "grown_shard",
    )
