"""Token counts of whole texts without their ids.

A byte-level tokenizer cuts a text into pre-tokens (words with the blank before them, numbers, runs of
other signs, white space) and then merges within each. So a text's count is the sum of its pre-tokens'
counts, and a pre-token's pieces are counted once for the whole table, however often it occurs:

1. a pass over the texts gives the distinct pre-tokens and their occurrences (combined in the tasks
   and before the shuffle), and each distinct one is encoded once;
2. a second pass gives each document's pre-token frequencies. The ``frequent`` most frequent
   pre-tokens of the table, a few megabytes whatever its size, travel with the tasks and are summed
   there; the frequencies of all others are joined with the counts and summed by document.

No ids are kept anywhere. Keys of the join are at most 64 bytes: a longer pre-token is known by its
SHA-256. As the most frequent pre-tokens never reach the join, none of its keys is hot; should more than ``frequent``
be about as frequent as the first, each of them is a small part of all.

Strings of special tokens inside a text are one token each, as is the library's default; a text is cut
there first.

Defined cases: null texts are empty ones and have no tokens; repeated rows and ids stay, each with its
own count; an empty table gives no rows; only the columns asked for are carried. Memory follows the
longest text.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from modcensus.llm.common import land, whole_text
from modcensus.llm.vectext import portions

FREQUENT = 1 << 18  # pre-tokens that travel with the tasks: with keys of 64 bytes, 16 MB
STEPS = 16  # of a doubling of occurrences
KEY_BYTES = 64
HELD = 1 << 17  # distinct pre-tokens that a task holds before it passes them on
HELD_BYTES = 1 << 24
_LONG = b"\xff"  # starts no UTF-8 text
#: fixed values: the byte-level cut and the white space that it means
_SPACE = r"\t-\r \x85\xa0  -     　"
_CUT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: characters that both libraries class alike, whatever their Unicode versions; a test goes through all of them
PLAIN = r"\x00-՗‐-⁰　-ヿ一-鿯가-힣"
_PLAIN = regex.compile(f"[{PLAIN}]*+")


class PreTokens:
    """Cuts texts into pre-tokens and counts the pieces of one."""

    def __init__(self, path: str):
        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("A byte-level tokenizer without normalizer is needed.")
        special = spec.get("added_tokens", [])
        if any(token.get(flag) for token in special for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("Added tokens that take their surroundings into account are not supported.")
        names = sorted((token["content"] for token in special), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, names))) if names else None

    def cut(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special tokens)."""
        parts = self._special.split(text) if self._special else [text]
        found: list[str] = []
        for part in parts:
            if _PLAIN.fullmatch(part):
                found += _CUT.findall(part)
            else:
                found += [part[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(part)]
        return found, len(parts) - 1

    def pieces(self, pre_token: str) -> int:
        return len(self._library.encode(pre_token, add_special_tokens=False))


@cache
def _pre_tokens(path: str) -> PreTokens:
    """One for each worker process."""
    return PreTokens(path)


def key_of(pre_token: str) -> bytes:
    """The pre-token's bytes, or a mark and the SHA-256 of a long one's."""
    plain = pre_token.encode()
    return plain if len(plain) <= KEY_BYTES else _LONG + hashlib.sha256(plain).digest()


def _key(pre_token: Column) -> Column:
    long = F.concat(F.lit(_LONG), F.unhex(F.sha2(pre_token.cast("binary"), 256)))
    return F.when(F.octet_length(pre_token) <= KEY_BYTES, pre_token.cast("binary")).otherwise(long)


def _occurrences(path: str):
    out = pa.schema([("pre_token", pa.string()), ("occurrences", pa.int64())])

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _pre_tokens(path).cut
        held: Counter = Counter()
        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.update(cut(text.as_py())[0])
                size += len(text.as_py())
                # the bytes held are at most those read
                if len(held) > HELD or (size > HELD_BYTES and sum(map(len, held)) > HELD_BYTES):
                    yield rows(held)
                    held.clear()
                    size = 0
        if held:
            yield rows(held)

    return read


def _counted(path: str):
    out = pa.schema([("key", pa.binary()), ("occurrences", pa.int64()), ("pieces", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _pre_tokens(path).pieces
        for batch in portions(batches, 0, 10_000):
            pieces = pa.array(map(count, batch.column(0).to_pylist()), pa.int64())
            yield pa.record_batch([batch.column(1), batch.column(2), pieces], schema=out)

    return read


def pre_token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """key, occurrences and pieces of each distinct pre-token of the table."""
    found = docs.select(whole_text(text).alias("text")).mapInArrow(_occurrences(tokenizer), "pre_token STRING, occurrences LONG")
    distinct = found.groupBy("pre_token").agg(F.sum("occurrences").alias("occurrences"))
    rows = distinct.select("pre_token", _key(F.col("pre_token")).alias("key"), "occurrences")
    return rows.mapInArrow(_counted(tokenizer), "key BINARY, occurrences LONG, pieces LONG")


def most_frequent(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """Pieces of the most frequent pre-tokens, ``most`` at most; they come to the driver.

    A histogram of the logarithms of ``occurrences``, some hundred rows, tells from where on they are
    so few; a sort would bring ``most`` rows of every task to one.
    """
    counts = counts.withColumn("step", F.floor(F.log2("occurrences") * STEPS))
    steps = sorted(((row["step"], row["n"]) for row in counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for step, n in steps:
        total += n
        if total > most:
            break
        least = step
    if least is None:
        return {}
    rows = counts.where(F.col("step") >= least).select("key", "pieces").toArrow()
    return dict(zip(rows.column("key").to_pylist(), rows.column("pieces").to_pylist(), strict=True))


def _frequencies(path: str, known: dict[bytes, int], keep: int, out: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _pre_tokens(path).cut
        for batch in portions(batches, keep):
            size, total, rare = [], [], []
            for text in batch.column(keep).to_pylist():
                found, tokens = cut(text)
                others = []
                for pre_token, times in Counter(found).items():
                    key = key_of(pre_token)
                    pieces = known.get(key)
                    if pieces is None:
                        others.append({"key": key, "times": times})
                    else:
                        tokens += pieces * times
                size.append(len(text.encode()))
                total.append(tokens)
                rare.append(others)
            made = [pa.array(x, f.type) for x, f in zip((size, total, rare), list(out)[keep:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *made], schema=out)

    return read


def document_frequencies(docs: DataFrame, tokenizer: str, known: dict[bytes, int], keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, ``_bytes_``, ``_known_`` (tokens of the pre-tokens in ``known``) and ``_rare_`` (key and times of the others)."""
    rows = docs.select(*keep, whole_text(text).alias("_whole_text_"))
    made = T._parse_datatype_string("_bytes_ LONG, _known_ LONG, _rare_ ARRAY<STRUCT<key: BINARY, times: LONG>>")
    schema = T.StructType([*(docs.schema[name] for name in keep), *made])
    return rows.mapInArrow(_frequencies(tokenizer, known, len(keep), to_arrow_schema(schema)), schema)


def token_counts(docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """The columns ``keep``, n_bytes (UTF-8) and n_tokens of each row of ``docs``."""
    counts = land(pre_token_counts(docs, tokenizer, text), "pre-tokens")
    found = document_frequencies(docs, tokenizer, most_frequent(counts, frequent), keep, text)
    found = land(found.withColumn("_row_", F.monotonically_increasing_id()), "frequencies")
    rare = found.select("_row_", F.inline("_rare_")).join(counts.select("key", "pieces"), "key")
    sums = rare.groupBy("_row_").agg(F.sum(F.col("times") * F.col("pieces")).alias("_sum_"))
    total = F.col("_known_") + F.coalesce("_sum_", F.lit(0))
    rows = found.drop("_rare_").join(sums, "_row_", "left")
    return rows.select(*keep, F.col("_bytes_").alias("n_bytes"), total.alias("n_tokens"))
