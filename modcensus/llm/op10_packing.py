"""Best-fit packing of tokenized documents, with repacking where a lower bound leaves a gap.

Only documents longer than a sequence are cut, into full sequences and one shorter piece, their
first. Full pieces are sequences of their own. The others are dealt at random into groups of bounded
size, and each group runs best-fit decreasing. Dual feasible functions bound the number of sequences
any packing of the group needs; a group that meets its bound is certified and final. Groups with a
gap keep their full sequences and exchange the documents of all others: these are dealt anew among
fewer groups and packed again, as long as that saves sequences.

Defined cases: a null or empty text is the end id alone; repeated rows and repeated ids are pieces
of their own; an empty table gives no rows. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modcensus.llm.bpe import ID_BYTES, text_encoder
from modcensus.llm.common import land, whole_text

PIECES = "doc_id LONG, piece INT, start LONG, length LONG, ids_crc32 LONG"
GROUP = 20_000  # pieces that one task packs together
OUT_ROWS = 20_000


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter."""
    first = length % most or min(length, most)
    return [(0, first), *((at, most) for at in range(first, length, most))]


def _pieces(tokenizer: str, end_id: int, most: int, with_ids: bool):
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    out = pa.schema(kinds + [("ids", pa.binary())] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, key = encoder.encode(text.as_py()) + end, key.as_py()
                for k, (start, length) in enumerate(cut(len(ids) // ID_BYTES, most)):
                    own = ids[start * ID_BYTES : (start + length) * ID_BYTES]
                    rows.append((key, k, start, length, zlib.crc32(own)) + (own,) * with_ids)
                if len(rows) >= OUT_ROWS:
                    yield _batch(rows, out)
                    rows = []
            if rows:
                yield _batch(rows, out)

    return read


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece; ``with_ids`` adds its ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, most, with_ids), PIECES + ", ids BINARY" * with_ids)


def lower_bound(lengths: np.ndarray, most: int) -> int:
    """Sequences that any packing of ``lengths`` needs, by two families of dual feasible functions.

    One rounds down to multiples of most / (k + 1) unless exact; the other takes lengths over
    ``most - e`` as full and drops those under ``e``. All sums are exact integers.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=most + 1).astype(np.int64)
    sizes = np.arange(most + 1, dtype=np.int64)
    best = -(-int(count @ sizes) // most)
    for k in range(1, 33):
        value = np.where((k + 1) * sizes % most == 0, sizes * k, (k + 1) * sizes // most * most)
        best = max(best, -(-int(count @ value) // (k * most)))
    for e in range(1, most // 2 + 1):
        value = np.where(sizes > most - e, most, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int(count @ value) // most))
    return best


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length its sequence and its place there; and what each sequence holds."""
    into, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(most + 1)]  # sequences by the room they have left
    held: list[int] = []
    open_rooms = 0  # bit r: some sequence has room r
    for at in np.argsort(-lengths, kind="stable"):
        length = int(lengths[at])
        fitting = open_rooms >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            sequence = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            left, sequence = most, len(held)
            held.append(0)
        into[at], offset[at] = sequence, held[sequence]
        held[sequence] += length
        room[left - length].append(sequence)
        open_rooms |= 1 << (left - length)
    return into, offset, np.array(held, np.int64)


def _pack_group(most: int, packing_round: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        into, offset, held = best_fit_decreasing(lengths, most)
        # 18 bits for the round, 25 for the group and 20 for its sequence
        rows["sequence_id"] = ((np.int64(packing_round) << 25 | np.int64(key[0])) << 20) | into
        rows["offset"] = offset
        gap = len(held) - lower_bound(lengths, most)
        # a certified group is final, and so are full sequences
        rows["_final"] = (held[into] == most) if gap else True
        return rows.drop(columns="_group")

    return pack


def _packed(rows: DataFrame, count: int, most: int, packing_round: int, group: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id LONG, offset LONG, _final BOOLEAN"
    groups = -(-count // group)
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_piece", F.lit(packing_round)), F.lit(groups)))
    return land(dealt.groupBy("_group").applyInPandas(_pack_group(most, packing_round), schema), f"packed-{packing_round}")


def pack(pieces: DataFrame, most: int, group: int = GROUP) -> DataFrame:
    """All columns of ``pieces`` (``length`` from 1 to ``most``), sequence_id and offset.

    Groups have ``group`` pieces on average whatever the table's size; documents are exchanged
    until a round saves no sequence. Every round's rows are landed, so nothing is packed twice.
    """
    landed = land(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == most
    done = [landed.where(full).withColumn("sequence_id", -1 - F.col("_piece")).withColumn("offset", F.lit(0).cast("long"))]
    open_rows = landed.where(~full)
    count = open_rows.count()
    packing_round = 0
    if count:
        current = _packed(open_rows, count, most, 0, group)
    while count:
        settled, released = current.where("_final"), current.where("NOT _final")
        count, before = released.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        packing_round += 1
        if not count:
            done.append(current)
            break
        again = _packed(released.drop("sequence_id", "offset", "_final"), count, most, packing_round, group)
        after = again.select("sequence_id").distinct().count()
        if after >= before:
            done.append(current)
            break
        done.append(settled)
        current = again
    columns = [*pieces.columns, "sequence_id", "offset"]
    result = done[0].select(*columns)
    for rows in done[1:]:
        result = result.unionByName(rows.select(*columns))
    return result


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, most: int = 1024, with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack whole documents."""
    return pack(token_pieces(docs, tokenizer, end_id, most, with_ids), most)
