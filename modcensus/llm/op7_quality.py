"""Quality of documents: counted rules, and a calibrated classifier learned from labelled rows.

The classifier is a logistic regression over hashed words and byte 3-grams, fitted on a bounded
sample of ``labels.quality``, calibrated on held-back rows, and applied to Arrow batches against a
fixed threshold. A document is kept if no rule fails and the probability of quality 1 reaches it.

Defined cases: a null or empty text has counts of 0 and fails the rules; with labels of one kind or
none the probability is that kind's share (1 without labels: the rules alone decide); repeated rows
get equal results; an empty table gives no rows. Memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modcensus.llm.common import sampled_labels, with_results
from modcensus.llm.linear import Features, LinearModel
from modcensus.llm.training import fitted
from modcensus.llm.vectext import _SPACE, Texts, _runs, span_hashes, texts, windows, words

FEATURES = Features(anywhere=(3,))
SAMPLE = 2_000  # labelled rows of each kind that the model is fitted on
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50
FIELDS = "n_words LONG, word_chars LONG, n_symbols LONG, n_dup_lines LONG, n_repeat_words LONG, base_failed BOOLEAN, quality DOUBLE, kept BOOLEAN"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(found: Texts, marks: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(marks, dtype=np.int64))
    return sums[found.offsets[1:]] - sums[found.offsets[:-1]]


def rule_counts(found: Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    of = words(found)
    in_word = ~_SPACE[found.data]
    chars = _per_text(found, in_word & ((found.data & 0xC0) != 0x80))
    lines = _runs(found, found.data != 10)
    sums = np.append(0, np.cumsum(in_word, dtype=np.int64))
    with_word = sums[lines.ends] > sums[lines.starts]
    starts, ends, doc = lines.starts[with_word], lines.ends[with_word], lines.doc[with_word]
    hashes = span_hashes(found.data, starts, ends)
    distinct = np.unique(np.stack([doc.astype(np.uint64), hashes], 1), axis=0)[:, 0].astype(np.int64)
    doubled = np.bincount(doc, minlength=len(found)) - np.bincount(distinct, minlength=len(found))
    return [of.counts, chars, _per_text(found, _SYMBOL[found.data]), doubled, _repeated(found, of)]


def _repeated(found: Texts, of) -> np.ndarray:
    """Words in three-word windows that occur at least twice in their text."""
    hashes, at = windows(span_hashes(found.data, of.starts, of.ends), of.doc, 3)
    order = np.lexsort((hashes, of.doc[at]))
    h, d = hashes[order], of.doc[at][order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    twice = np.append(False, same) | np.append(same, False)
    covered = np.zeros(len(of.doc), bool)
    for j in range(3):
        covered[at[order[twice]] + j] = True
    return np.bincount(of.doc[covered], minlength=len(found))


def _judge(model: LinearModel | None, threshold: float):
    def compute(column: pa.Array):
        found = texts(column)
        counts = rule_counts(found)
        failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEATED * counts[0])
        good = model.probabilities(found) if model else np.ones(len(found))
        return [*counts, failed, good, ~failed & (good >= threshold)]

    return compute


def quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LinearModel | None:
    """None without any usable label."""
    chosen, share = sampled_labels(labels, "quality", sample, F.lit(True))
    if not chosen.head(1):
        return None
    return fitted(docs, chosen, share, FEATURES)


def judged(docs: DataFrame, model: LinearModel | None, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of ``docs``, the counts, ``quality`` (a probability) and ``kept``."""
    return with_results(docs, _judge(model, threshold), FIELDS, keep)


def kept_documents(docs: DataFrame, model: LinearModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of quality with all their columns."""
    compute = _judge(model, threshold)
    rows = with_results(docs, lambda column: compute(column)[-1:], "_kept_ BOOLEAN", docs.columns)
    return rows.where("_kept_").drop("_kept_")
