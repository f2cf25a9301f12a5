"""Language identification by compression.

Each language has a raw zstandard dictionary of sampled texts. A text is reduced to lower-case words,
cut into pieces of about a kilobyte, and compressed with every dictionary; the language of the least
size wins. The margin is the share by which the next language needs more. Narrow margins are rejected.

The sample of a language is about ``SAMPLE`` of its distinct texts, so copies count once. At most the
``LANGUAGES`` most frequent values of ``lang`` are learned, and all dictionaries together take at most about
``DICTIONARIES`` bytes: with many languages, pieces of long texts get shorter. All dictionaries are used
with the same tables and window.

Defined cases: null texts and texts without letters are ``und`` with score 0, and rejected; ties go
to the first language in order; repeated rows get equal results; without learned languages every text
is ``und``; an empty table gives no rows. Memory follows the longest text.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modcensus.llm.common import whole_text, with_results

UNKNOWN = "und"
SAMPLE = 250  # distinct texts that a language's dictionary is made from
SAMPLE_BYTES = 1 << 15  # of a longer text, a piece of so many bytes
LANGUAGES = 200  # learned at most
DICTIONARIES = 1 << 26  # bytes of all samples together
PIECE = 1_000  # letters compressed at once
LEVEL = 3
NARROW = 0.01
_NO_LETTER = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> str:
    return _NO_LETTER.sub(" ", text.lower()).strip()


@lru_cache(1)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    # sizes are compared, so one set of parameters for all: it fits the longest dictionary
    longest = max(len(content) for _, content in dictionaries)
    bits = max(longest.bit_length(), 12)
    chosen = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=longest, source_size=PIECE, hash_log=bits - 2, chain_log=bits - 2, window_log=bits + 1, write_content_size=False, write_dict_id=False)
    made = []
    for _, content in dictionaries:
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=chosen)
        made.append(zstandard.ZstdCompressor(compression_params=chosen, dict_data=raw))
    return made


def classify(text: str, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    """(language, margin)."""
    plain = letters(text)
    if not plain or not dictionaries:
        return UNKNOWN, 0.0
    pieces = [plain[i : i + PIECE].encode() for i in range(0, len(plain), PIECE)]
    sizes = [sum(len(c.compress(p)) for p in pieces) for c in _compressors(dictionaries)]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    others = [size for i, size in enumerate(sizes) if i != best]
    return dictionaries[best][0], 1 - sizes[best] / min(others) if others else 1.0


def _piece(most: int) -> Column:
    """The whole text, or the middle of one of more than ``most`` bytes, of so many bytes at most."""
    # characters have up to four bytes
    middle = F.substring("text", F.greatest(F.lit(1), F.length("text") / 2 - most // 8).cast("int"), F.lit(most // 4))
    return F.when(F.octet_length("text") <= most, F.col("text")).otherwise(middle)


def learn(docs: DataFrame, allowed: Column, sample: int = SAMPLE) -> tuple[tuple[str, bytes], ...]:
    """A dictionary of an equal sample for each language of the allowed documents.

    One row for each of at most ``LANGUAGES`` languages, and the samples, come to the driver.
    """
    known = docs.where(allowed & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), whole_text().alias("text"))
    known = known.where(F.octet_length("text") > 0).withColumn("order", F.xxhash64("text"))
    distinct = known.groupBy("lang", "order").agg(F.count(F.lit(1)).alias("times"))
    sizes = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"))
    counts = {row["lang"]: row["n"] for row in sizes.orderBy(F.desc("times"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return ()
    space = 1 << 30
    below = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(space * min(1, sample / n)))))
    most = min(SAMPLE_BYTES, DICTIONARIES // (sample * len(counts)))
    chosen = known.where(F.pmod("order", F.lit(space)) < below[F.col("lang")]).groupBy("lang", "order").agg(F.min(_piece(most)).alias("text"))
    found: dict[str, list[bytes]] = {lang: [] for lang in sorted(counts)}
    for row in sorted(chosen.collect(), key=lambda row: row["order"]):
        found[row["lang"]].append(letters(row["text"]).encode())
    return tuple((lang, b" ".join(parts)) for lang, parts in found.items() if sum(map(len, parts)) >= 8)


def _identify(dictionaries, narrow: float):
    def compute(column: pa.Array):
        made = [classify(text, dictionaries) for text in column.to_pylist()]
        return [lang for lang, _ in made], [score for _, score in made], [lang == UNKNOWN or score < narrow for lang, score in made]

    return compute


def identified(docs: DataFrame, dictionaries: tuple[tuple[str, bytes], ...], keep: list[str], narrow: float = NARROW) -> DataFrame:
    """The columns ``keep``, lang_pred, score (the margin) and ``rejected``."""
    return with_results(docs, _identify(dictionaries, narrow), "lang_pred STRING, score DOUBLE, rejected BOOLEAN", keep)


def accepted_documents(docs: DataFrame, dictionaries: tuple[tuple[str, bytes], ...], narrow: float = NARROW) -> DataFrame:
    """The documents with a clear language, with all their columns."""
    compute = _identify(dictionaries, narrow)
    rows = with_results(docs, lambda column: compute(column)[-1:], "_rejected_ BOOLEAN", docs.columns)
    return rows.where("NOT _rejected_").drop("_rejected_")
