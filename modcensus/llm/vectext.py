"""Words, windows and hashes of many texts at once, in numpy over Arrow's own buffers.

A word is a run of bytes other than blank and the controls 9 to 13. Hashes have 64 bits and depend on
the bytes only, so they are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18  # bytes of a portion, and hashed at once: a dozen arrays of eight bytes for each are alive
_FACTOR = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """From 64-bit hashes to numbers of 0 up to 1."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


@dataclass
class Texts:
    data: np.ndarray  # all bytes
    offsets: np.ndarray  # n + 1 places

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts(column: pa.Array) -> Texts:
    """A string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def portions(batches: Iterator[pa.RecordBatch], text: int, rows: int = 500, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of few rows and bytes; a longer text is a slice of its own."""
    for batch in batches:
        ends = texts(batch.column(text)).offsets[1:]
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + size, "right"))
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def lower_ascii(found: Texts) -> Texts:
    return Texts(_LOWER[found.data], found.offsets)


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # each word's text
    counts: np.ndarray  # words of each text


def words(found: Texts) -> Words:
    return _runs(found, ~_SPACE[found.data])


def _runs(found: Texts, inside: np.ndarray) -> Words:
    size = len(found.data)
    # edges of texts cut runs
    cuts = found.offsets[(found.offsets > 0) & (found.offsets < size)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(found.offsets, starts, "right") - 1
    return Words(starts, ends, doc, np.bincount(doc, minlength=len(found)))


def _power(kind: str, size: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < size:
        factor = _FACTOR if kind == "up" else pow(_FACTOR, -1, 1 << 64)
        row = np.full(max(size, BLOCK * 2), factor, np.uint64)
        row[0] = 1
        known = np.cumprod(row, dtype=np.uint64)
        if size > BLOCK * 2:
            return known
        _powers[kind] = known
    return known


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span of bytes; ``starts`` and ``ends`` ascend."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        s, e = starts[at:to] - base, ends[at:to] - base
        part = data[base : base + e[-1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _power("up", len(part))[: len(part)], out=sums[1:])
        down = _power("down", len(part) + 1)
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of ``width`` words that lies in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        total = mix(total * np.uint64(_FACTOR) + hashes[at + j])
    return total, at


def word_windows(found: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the windows; a text of fewer words has one window of all of them."""
    of = words(found)
    hashes = span_hashes(found.data, of.starts, of.ends)
    full, at = windows(hashes, of.doc, width)
    doc = of.doc[at]
    for short in range(1, width):
        few = np.flatnonzero((of.counts == short)[of.doc])
        if len(few):
            some, first = windows(hashes[few], of.doc[few], short)
            full, doc = np.append(full, mix(some + np.uint64(short))), np.append(doc, of.doc[few][first])
    return full, doc
