"""Toxicity after noisy-channel deobfuscation.

A character trigram model is counted over all texts. Every token that may be read in another way
(letters written as digits or signs, letters repeated) and every run of three or more single
characters becomes a lattice of what each character may stand for; the Viterbi path under channel
costs and the character model restores it, or keeps it as written. A logistic regression over hashed
words and parts of words, fitted on labelled rows, scores the restored text.

Defined cases: null and empty texts are scored like any text without features (the calibrated bias);
without labels the score is 0, with labels of one kind that kind's share; repeated rows get equal
results; an empty table gives no rows. Memory follows the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modcensus.llm.common import sampled_labels, whole_text, with_results
from modcensus.llm.linear import Features, LinearModel
from modcensus.llm.training import fitted
from modcensus.llm.vectext import Texts, lower_ascii, portions, texts

FEATURES = Features(within=(4,), beginnings=(3, 5), presence=True)
SIGNIFICANT = 4.0
SAMPLE = 2_000  # labelled rows of each kind that the model is fitted on
TOXIC = 0.7
REMEMBERED = 50_000  # decoded tokens kept between texts; for speed only

#: what a sign may stand for
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
#: log chances of the channel
SUBSTITUTED, DOUBLED, REPEATED, SET_APART, REAL_BREAK = -1.0, -4.0, -2.0, -0.3, -1.0
#: log chances of a sign that is meant as written: before or between letters, standing apart, and
#: (digits, other signs) behind the last letter, where more of the same sign cost nothing
LITERAL_SIGN, LITERAL_APART, LITERAL_DIGIT, LITERAL_END = -12.0, -4.0, -4.0, -1.0
BETWEEN = -3.0  # a sign that only sets letters apart
SYMBOLS = 64
_BREAK = 0
_OTHER = 59
_TOKEN = r"[^\W_]|[@$!|+]"
_NO_TOKEN = r"(?:(?![^\W_]|[@$!|+])[\s\S])"
#: a token with more than one reading has a sign next to a letter or a letter twice in a row
_TRIGGER = re.compile(r"[0-9@$!|+](?=[^\W\d_])|(?<=[^\W\d_])[0-9@$!|+]|([^\W\d_])(?i:\1)")
_IN_TOKEN = re.compile(_TOKEN)
_REST = re.compile(f"(?:{_TOKEN})*")
_ONE = rf"(?:{_TOKEN})(?!{_TOKEN})"
#: three or more single characters, up to three others between them
_APART = re.compile(rf"(?<![^\W_])(?<![@$!|+]){_ONE}(?:{_NO_TOKEN}{{1,3}}{_ONE}){{2,}}")


def _symbol_of(character: str) -> int:
    low = character.lower()[:1]
    if "a" <= low <= "z":
        return ord(low) - 96
    if "\xdf" <= low <= "\xff" and low.isalpha():
        return 27 + ord(low) - 0xDF - (low > "\xf7")
    return _OTHER if character.isalpha() else _BREAK


_SYMBOLS: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """The numbers of the text's letters; anything else is a break, and breaks do not repeat."""
    if not _SYMBOLS:
        _SYMBOLS.append(np.array([_symbol_of(chr(c)) if c < 0x250 else _OTHER * chr(c).isalpha() for c in range(0x110000)], np.uint8))
    found = _SYMBOLS[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    keep = found != _BREAK
    keep[1:] |= found[:-1] != _BREAK
    return found[keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in portions(batches, 0):
        # line feeds keep the texts apart
        found = symbols("\n" + "\n".join(batch.column(0).to_pylist()) + "\n").astype(np.int64)
        counts += np.bincount((found[:-2] * SYMBOLS + found[1:-1]) * SYMBOLS + found[2:], minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.record_batch([at, counts[at]], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log chances [a, b, c] of symbol c after a and b, counted over all whole texts.

    Each task sends its counts of the grams it met; the driver gets the sums, 64 ** 3 rows at most.
    """
    parts = docs.select(whole_text().alias("text")).mapInArrow(_count, "gram LONG, n LONG")
    found = parts.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[found["gram"].to_numpy(np.int64)] = found["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(0)
    after = (two + 1) / (two.sum(1, keepdims=True) + SYMBOLS)
    return np.log((three + 8 * after) / (three.sum(2, keepdims=True) + 8)).astype(np.float32)


class Restorer:
    def __init__(self, model: np.ndarray):
        self._model = model
        self._known: dict[str, str] = {}

    def decoded(self, token: str) -> str:
        if token not in self._known:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[token] = self._viterbi(token)
        return self._known[token]

    def _options(self, token: str, i: int, last: int, apart: bool) -> list[tuple[str, float]]:
        """What character i may stand for, with the channel's log chances.

        ``last`` is the place of the token's last letter; ``apart`` tells a run of single characters.
        """
        character = token[i]
        if character.isalpha():
            again = [i >= n and token[i - n].lower() == character.lower() for n in (1, 2)]
            return [(character, 0.0)] + [("", REPEATED if again[1] else DOUBLED)] * again[0]
        if character not in STANDS_FOR:
            return [(character, 0.0)] if _IN_TOKEN.match(character) else [("", SET_APART), (character, REAL_BREAK)]
        again = i > 0 and token[i - 1] == character
        found = [(letter, SUBSTITUTED) for letter in STANDS_FOR[character]] + [("", REPEATED)] * again
        if apart:
            return [*found, (character, LITERAL_APART)]
        if i > last:
            return [*found, (character, LITERAL_DIGIT if character.isdigit() else 0.0 if again else LITERAL_END)]
        between = [("", BETWEEN)] if i and not character.isdigit() else []
        return [*found, *between, (character, LITERAL_SIGN)]

    def _viterbi(self, token: str) -> str:
        """The best reading; a state is the last two symbols, paths are linked backwards.

        Without any letter the token stays.
        """
        last = max((i for i, character in enumerate(token) if character.isalpha()), default=-1)
        if last < 0:
            return token
        apart = not all(map(_IN_TOKEN.match, token))
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(_BREAK, _BREAK): (0.0, None)}
        for i in range(len(token)):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for text, cost in self._options(token, i, last, apart):
                symbol = _symbol_of(text) if text else None
                for (a, b), (score, path) in best.items():
                    if symbol is None:
                        state, total, linked = (a, b), score + cost, path
                    elif symbol == _BREAK and b == _BREAK:  # breaks do not repeat in the model
                        state, total, linked = (a, b), score + cost, (path, text)
                    else:
                        state, total, linked = (b, symbol), score + cost + float(self._model[a, b, symbol]), (path, text)
                    if state not in following or total > following[state][0]:
                        following[state] = (total, linked)
            best = following

        def ended(state: tuple[int, int], score: float) -> float:
            return score if state[1] == _BREAK else score + float(self._model[*state, _BREAK])

        _, path = max(((ended(state, score), path) for state, (score, path) in best.items()), key=lambda x: x[0])
        parts = []
        while path:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))

    def restored(self, text: str) -> str:
        """The text with the best readings of its tokens and of its runs of single characters.

        Tokens without a trigger have one reading, that as written.
        """
        parts, at = [], 0
        for run in _APART.finditer(text):
            parts += [self._restored_tokens(text[at : run.start()]), self.decoded(run[0])]
            at = run.end()
        return "".join(parts) + self._restored_tokens(text[at:])

    def _restored_tokens(self, text: str) -> str:
        parts, at = [], 0
        for trigger in _TRIGGER.finditer(text):
            start = trigger.start()
            if start < at:
                continue
            while start > at and _IN_TOKEN.match(text[start - 1]):
                start -= 1
            end = _REST.match(text, start).end()
            parts += [text[at:start], self.decoded(text[start:end])]
            at = end
        return "".join(parts) + text[at:]


def suspicious(found: Texts) -> np.ndarray:
    """Of each text whether it has a token or a run with more than one reading."""
    data = found.data.tobytes()
    whole = [data[a:b].decode() for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
    return np.array([bool(_TRIGGER.search(text) or _APART.search(text)) for text in whole], bool)


def _prepare(model: np.ndarray):
    restorer: list[Restorer] = []

    def prepare(column: pa.Array) -> Texts:
        if not restorer:
            restorer.append(Restorer(model))
        found = texts(column)
        odd = suspicious(found)
        if odd.any():
            plain = [restorer[0].restored(column[i].as_py()) if odd[i] else column[i].as_py() for i in range(len(column))]
            found = texts(pa.array(plain, pa.large_string()))
        return lower_ascii(found)

    return prepare


def restored_texts(docs: DataFrame, model: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``restored``."""

    def compute(column: pa.Array):
        restorer = Restorer(model)
        return ([restorer.restored(text) for text in column.to_pylist()],)

    return with_results(docs, compute, "restored STRING", keep)


def toxicity_model(docs: DataFrame, labels: DataFrame, allowed: Column, characters: np.ndarray, sample: int = SAMPLE) -> LinearModel | None:
    """None without any usable label."""
    chosen, share = sampled_labels(labels, "toxic", sample, allowed)
    if not chosen.head(1):
        return None
    return fitted(docs, chosen, share, FEATURES, _prepare(characters), SIGNIFICANT)


def scored(docs: DataFrame, model: LinearModel | None, characters: np.ndarray, keep: list[str], toxic: float = TOXIC) -> DataFrame:
    """The columns ``keep``, score (probability of label 1) and predicted."""
    prepare = _prepare(characters)

    def compute(column: pa.Array):
        chance = model.probabilities(prepare(column)) if model else np.zeros(len(column))
        return chance, (chance >= toxic).astype(np.int32)

    return with_results(docs, compute, "score DOUBLE, predicted INT", keep)
