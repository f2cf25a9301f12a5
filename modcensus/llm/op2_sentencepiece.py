"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

Pieces are those of the library's byte-pair model. A sequence of pieces is the encoding of a text
exactly if each two neighbours are what their own concatenation is encoded to. So the encoding is the
one path through the lattice of pieces whose steps are all allowed: steps score 0, others minus
infinity, and the best path is found by max-plus products.

A giant document is cut into chunks at fixed places. The state at a cut is the piece that holds the
character before it. A chunk yields the matrix of best scores from each state at its left cut to each
at its right one; matrices are combined associatively, in blocks of bounded size and level by level;
from the states at its cuts each chunk is then backtraced on its own. Inside a chunk no path passes
the start of a word with a piece, so between its first and last word the library encodes directly.

Defined cases: null texts are empty and have no ids; repeated rows and ids are encoded each; an empty
table gives no rows; a literal word mark decodes to a blank, as the library has it. Memory follows the
longest text that is not yet cut, and the chunk after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from modcensus.llm.common import land, whole_text
from modcensus.llm.vectext import portions

CHUNK = 16_384  # characters
FAN = 64  # matrices that one task multiplies
MARK = "▁"
START = -1
ROWS = "uid LONG, doc_id LONG, text_crc32 LONG, chunk INT, chunks INT"
_ROWS = [("uid", pa.int64()), ("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32())]


def _packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class Pieces:
    """The library's model, and which of its pieces may follow each other."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        bare = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        bare.normalizer_spec.add_dummy_prefix = False  # parts of a text get no blank before them
        self._plain = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        size = self.library.vocab_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) or self.library.is_byte(i) for i in range(size)]
        self._vocabulary = {self.library.id_to_piece(i) for i in range(size) if not special[i]}
        self.longest = max(map(len, self._vocabulary))
        # words can be encoded on their own if no piece goes on past a word's end
        self._words_part = not any(MARK in piece.lstrip(MARK) for piece in self._vocabulary)
        self._surface = [self.library.id_to_piece(i) for i in range(size)]
        self._bytes = {i: int(self._surface[i][3:5], 16) for i in range(size) if self.library.is_byte(i)}
        for i in range(size):
            if special[i] and i not in self._bytes:
                self._surface[i] = ""
        self._allowed: dict[tuple[str, str], bool] = {}
        self._single: dict[str, tuple[int, ...] | None] = {}

    def normalized(self, text: str) -> str:
        return self.library.normalize(text)

    def ids(self, part: str) -> list[int]:
        """The encoding of a normalized part on its own."""
        return self._plain.encode(part)

    def unit(self, part: str) -> tuple[int, ...] | None:
        """The ids of one piece, or of one character without a piece; None for anything else."""
        if part not in self._single:
            found = None
            if part in self._vocabulary or len(part) == 1:
                ids = tuple(self.ids(part))
                found = ids if len(part) == 1 or len(ids) == 1 else None
            self._single[part] = found
        return self._single[part]

    def starting(self, text: str, at: int) -> list[int]:
        """The ends of the pieces that start at a place."""
        most = min(self.longest, len(text) - at)
        return [at + n for n in range(1, most + 1) if (n == 1 or text[at : at + n] in self._vocabulary) and self.unit(text[at : at + n])]

    def allowed(self, first: str, second: str) -> bool:
        if (first, second) not in self._allowed:
            if len(self._allowed) > 500_000:
                self._allowed.clear()
            self._allowed[first, second] = tuple(self.ids(first + second)) == self.unit(first) + self.unit(second)
        return self._allowed[first, second]

    def word_start(self, text: str, at: int) -> bool:
        return self._words_part and 0 < at < len(text) and text[at] == MARK and text[at - 1] != MARK

    def decoded(self, ids: list[int]) -> str:
        """The text of ids, with the blank before its first word."""
        parts, pending = [], bytearray()
        for i in ids:
            if i in self._bytes:
                pending.append(self._bytes[i])
                continue
            if pending:
                parts.append(pending.decode("utf-8", "replace"))
                pending.clear()
            parts.append(self._surface[i])
        return "".join(parts).replace(MARK, " ") + pending.decode("utf-8", "replace")


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Chunk:
    """One chunk with the characters around it that pieces over its cuts may hold.

    ``text`` starts ``left`` characters before the left cut; ``first`` and ``last`` tell whether
    the document ends there. A state is the (start, end) of the piece over a cut, relative to it.
    """

    def __init__(self, model: Pieces, text: str, left: int, size: int, first: bool, last: bool):
        self._model, self._text, self._from, self._to = model, text, left, left + size
        self._first, self._last = first, last

    def states(self, cut: int) -> list[tuple[int, int]]:
        """The pieces that hold the character before a cut, as places in the text."""
        found = [(s, e) for s in range(max(0, cut - self._model.longest), cut) for e in self._model.starting(self._text, s) if e >= cut]
        return [x for x in found if x[1] == cut] if cut == self._to and self._last else found

    def entries(self) -> list[tuple[int, int] | None]:
        return [None] if self._first else self.states(self._from)

    def code(self, state: tuple[int, int] | None, cut: int) -> int:
        return START if state is None else (cut - state[0]) << 16 | state[1] - cut

    def _walk(self, sources: dict, start: int, end: int) -> dict:
        """Best paths from source pieces over ``start`` to all pieces that end at or after ``end``.

        ``sources`` maps a piece to a mask of sources; the result maps each piece to the mask of the
        sources that reach it and the pieces before it.
        """
        reached: dict = {piece: (mask, []) for piece, mask in sources.items()}
        by_end: dict[int, list] = {}
        for piece in sources:
            by_end.setdefault(piece[1] if piece else start, []).append(piece)
        for at in range(start, end):
            ends = self._model.starting(self._text, at) if at in by_end else ()
            for before in by_end.get(at, ()):
                mask = reached[before][0]
                for e in ends:
                    piece = (at, e)
                    # a word's first piece may follow any piece
                    if before and not self._model.word_start(self._text, at) and not self._model.allowed(self._text[before[0] : before[1]], self._text[at:e]):
                        continue
                    if piece in reached:
                        reached[piece] = (reached[piece][0] | mask, [*reached[piece][1], before])
                    else:
                        reached[piece] = (mask, [before])
                        by_end.setdefault(e, []).append(piece)
        return reached

    def _middle(self) -> tuple[int, int] | None:
        """The starts of the first and the last word whose neighbourhood lies in the chunk."""
        if not self._model._words_part:
            return None
        lead = self._model.longest
        low = next((i for i in range(self._from + lead, self._to - lead) if self._model.word_start(self._text, i)), None)
        if low is None:
            return None
        return low, next(i for i in range(self._to - lead, low - 1, -1) if self._model.word_start(self._text, i))

    def matrix(self) -> list[tuple[int, int]]:
        """The (entry, exit) pairs of score 0; all others are minus infinity."""
        entries, exits = self.entries(), self.states(self._to)
        sources = {state: 1 << i for i, state in enumerate(entries)}
        middle = self._middle()
        if middle:
            head = self._walk(sources, self._from, middle[0])
            into = self._at(head, middle[0])
            tail = self._walk({None: 1}, middle[1], self._to)
            pairs = [(i, x) for i in range(len(entries)) if into >> i & 1 for x in exits if x in tail]
        else:
            reached = self._walk(sources, self._from, self._to)
            pairs = [(i, x) for x in exits if x in reached for i in range(len(entries)) if reached[x][0] >> i & 1]
        return [(self.code(entries[i], self._from), self.code(x, self._to)) for i, x in pairs]

    @staticmethod
    def _at(reached: dict, end: int) -> int:
        mask = 0
        for piece, (some, _) in reached.items():
            if piece and piece[1] == end:
                mask |= some
        return mask

    def backtrace(self, entry: int, exit_: int) -> list[int]:
        """The ids of the pieces that start in the chunk, between the states at its cuts."""
        source = None if entry == START else (self._from - (entry >> 16), self._from + (entry & 0xFFFF))
        target = (self._to - (exit_ >> 16), self._to + (exit_ & 0xFFFF))
        middle = self._middle()
        if middle:
            head = self._walk({source: 1}, self._from, middle[0])
            end = next(piece for piece in head if piece and piece[1] == middle[0] and piece[0] >= self._from)
            tail = self._walk({None: 1}, middle[1], self._to)
            found = self._back(head, end, source)
            ids = [i for s, e in found for i in self._model.unit(self._text[s:e])]
            ids += self._model.ids(self._text[middle[0] : middle[1]])
            found = self._back(tail, target, None)
        else:
            ids = []
            found = self._back(self._walk({source: 1}, self._from, self._to), target, source)
        return ids + [i for s, e in found for i in self._model.unit(self._text[s:e])]

    @staticmethod
    def _back(reached: dict, piece, source) -> list[tuple[int, int]]:
        path = []
        while piece != source:
            path.append(piece)
            piece = reached[piece][1][0]  # there is one allowed path
        return path[::-1]


def _cut(path: str, size: int):
    out = pa.schema([*_ROWS, ("text", pa.string()), ("left", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in portions(batches, 3, rows=1):
            uid, doc, crc, text = (column[0].as_py() for column in batch.columns)
            text = model.normalized(text)
            chunks = -(-len(text) // size)
            for at in range(0, chunks, FAN):
                rows = []
                for k in range(at, min(at + FAN, chunks)):
                    left = min(k * size, model.longest)
                    rows.append((uid, doc, crc, k, chunks, text[k * size - left : (k + 1) * size + model.longest], left))
                yield _batch(rows, out)

    return read


def _encode(path: str):
    out = pa.schema([*_ROWS, ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 3):
            ids = pieces(path).library.encode(batch.column(3).to_pylist(), num_threads=1)
            chunk, chunks = pa.array([0] * len(ids), pa.int32()), pa.array([1] * len(ids), pa.int32())
            yield pa.record_batch([*batch.columns[:3], chunk, chunks, pa.array(map(_packed, ids), pa.binary())], schema=out)

    return read


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _chunk(model: Pieces, size: int, row: dict) -> Chunk:
    last = row["chunk"] == row["chunks"] - 1
    own = len(row["text"]) - row["left"] if last else size
    return Chunk(model, row["text"], row["left"], own, row["chunk"] == 0, last)


def _transfer(path: str, size: int):
    out = pa.schema([("uid", pa.int64()), ("place", pa.int64()), ("pairs", pa.list_(pa.list_(pa.int64())))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["uid"], r["chunk"], [list(p) for p in _chunk(pieces(path), size, r).matrix()]) for r in batch.to_pylist()]
            if rows:
                yield _batch(rows, out)

    return read


def _retrace(path: str, size: int):
    out = pa.schema([*_ROWS, ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _chunk(pieces(path), size, row).backtrace(row["entry"], row["exit"])
                yield _batch([(*(row[name] for name, _ in _ROWS), _packed(ids))], out)

    return read


# --- the scan --------------------------------------------------------------------------------
def _dense(pairs, rows: list[int], columns: list[int]) -> np.ndarray:
    matrix = np.full((len(rows), len(columns)), -np.inf)
    at, to = {s: i for i, s in enumerate(rows)}, {s: i for i, s in enumerate(columns)}
    for a, b in pairs:
        matrix[at[a], to[b]] = 0.0
    return matrix


def max_plus(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first[:, :, None] + second[None, :, :]).max(axis=1, initial=-np.inf)


def _states(pairs_by_place: list) -> list[list[int]]:
    """The states at each cut; a state that only one side knows leads nowhere."""
    cuts = [sorted({int(p[0]) for p in pairs_by_place[0]})]
    for pairs, after in zip(pairs_by_place, [*pairs_by_place[1:], None], strict=True):
        cuts.append(sorted({int(p[1]) for p in pairs} | ({int(p[0]) for p in after} if after is not None else set())))
    return cuts


def _multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    pairs = list(rows["pairs"])
    cuts = _states(pairs)
    product = _dense(pairs[0], cuts[0], cuts[1])
    for i, some in enumerate(pairs[1:], 1):
        product = max_plus(product, _dense(some, cuts[i], cuts[i + 1]))
    made = [[cuts[0][i], cuts[-1][j]] for i, j in zip(*np.nonzero(product == 0), strict=True)]
    return pd.DataFrame({"uid": [key[0]], "place": [key[1]], "pairs": [made]})


def _settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The states at each cut of a block, from those at its two ends (``exit`` -1: any)."""
    rows = rows.sort_values("place")
    pairs = list(rows["pairs"])
    cuts = _states(pairs)
    matrices = [_dense(some, cuts[i], cuts[i + 1]) for i, some in enumerate(pairs)]
    entry, last = int(rows["entry"].iloc[0]), int(rows["exit"].iloc[0])
    forward = [np.where(np.array(cuts[0]) == entry, 0.0, -np.inf)]
    for matrix in matrices:
        forward.append((forward[-1][:, None] + matrix).max(axis=0))
    backward = [np.where((np.array(cuts[-1]) == last) | (last == START), 0.0, -np.inf)]
    for matrix in reversed(matrices):
        backward.append((matrix + backward[-1][None, :]).max(axis=1))
    found = [cut[int(np.argmax(f + b))] for cut, f, b in zip(cuts, forward, reversed(backward), strict=True)]
    return pd.DataFrame({"uid": key[0], "place": rows["place"].to_numpy(), "entry": found[:-1], "exit": found[1:]})


def scan(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(uid, place, entry, exit) for each matrix (uid, place, pairs): the states of the best path.

    Up: products of ``fan`` neighbours at a time, until each document is one. Down: from the states
    at a block's ends follow those inside. No task holds more than ``fan`` matrices of a document.
    """
    block = F.floor(F.col("place") / fan).cast("long")
    most = matrices.agg(F.max("place")).first()[0]
    ends = matrices.withColumn("block", block)
    if most is None or most < fan:
        ends = ends.withColumn("entry", F.lit(START).cast("long")).withColumn("exit", F.lit(START).cast("long"))
    else:
        products = land(ends.groupBy("uid", "block").applyInPandas(_multiply, "uid LONG, place LONG, pairs ARRAY<ARRAY<LONG>>"), "products")
        ends = ends.join(scan(products, fan).withColumnRenamed("place", "block"), ["uid", "block"])
    tasks = int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are small, the work is not
    found = ends.select("uid", "block", "place", "pairs", "entry", "exit").repartition(tasks, "uid", "block")
    return land(found.groupBy("uid", "block").applyInPandas(_settle, "uid LONG, place LONG, entry LONG, exit LONG"), "states")


def encoded(docs: DataFrame, model: str, size: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, text_crc32, chunk, chunks, ids): rows of documents in one chunk, and of the others' chunks.

    A document of fewer than ``size`` characters is one chunk; the others are landed in theirs.
    ids are little-endian u32, text_crc32 is that of the whole text, uid numbers the documents.
    """
    text = whole_text()
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32"), text.alias("text")]
    giants, others = docs.where(F.length(text) >= size), docs.where(F.length(text) < size)
    row = F.monotonically_increasing_id()
    whole = others.select((-1 - row).alias("uid"), *columns).mapInArrow(_encode(model), ROWS + ", ids BINARY")
    giant = land(giants.select(row.alias("uid"), *columns).mapInArrow(_cut(model, size), ROWS + ", text STRING, left INT"), "chunks")
    matrices = land(giant.mapInArrow(_transfer(model, size), "uid LONG, place LONG, pairs ARRAY<ARRAY<LONG>>"), "matrices")
    states = scan(matrices, fan).select("uid", F.col("place").cast("int").alias("chunk"), "entry", "exit")
    traced = giant.join(states, ["uid", "chunk"]).mapInArrow(_retrace(model, size), ROWS + ", ids BINARY")
    return whole, traced


def _decode(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [model.decoded(np.frombuffer(ids, "<u4").tolist()) for ids in batch.column("ids").to_pylist()]
            texts = [text[1:] if not chunk else text for text, chunk in zip(texts, batch.column("chunk").to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return read


def decoded(chunks: DataFrame, model: str) -> DataFrame:
    """The rows of ``encoded`` and their texts; every chunk is decoded on its own."""
    return chunks.mapInArrow(_decode(model), ROWS + ", ids BINARY, text STRING")


def whole_documents(whole: DataFrame, chunks: DataFrame) -> DataFrame:
    """(uid, doc_id, text_crc32, chunks, ids, text) of both decoded parts; one row a document, as long as it."""
    columns = ["uid", "doc_id", "text_crc32", "chunks"]
    parts = chunks.groupBy(*columns).agg(F.sort_array(F.collect_list(F.struct("chunk", "ids", "text"))).alias("parts"))
    ids = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), ""))
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    return whole.select(*columns, "ids", "text").unionByName(parts.select(*columns, ids.alias("ids"), text.alias("text")))
