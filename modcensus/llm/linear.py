"""Logistic regression over hashed words and character n-grams, with calibrated probabilities.

Features are counted per text, so their values depend on nothing outside it. The model is a few
arrays of fixed size, whatever the data, and travels with the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from modcensus.llm.vectext import Texts, mix, span_hashes, words

BITS = 18
POWER = 4  # how fast features of less significance count less


@dataclass(frozen=True)
class Features:
    """Which n-grams count: of bytes anywhere, of bytes within words, and words' beginnings."""

    anywhere: tuple[int, ...] = ()
    within: tuple[int, ...] = ()
    beginnings: tuple[int, ...] = ()
    presence: bool = False  # a feature's value is 1; else log(1 + count), scaled to length 1

    def of(self, found: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value), each pair of text and feature once, in their order."""
        mask = np.uint64((1 << BITS) - 1)
        parts = []

        def add(hashes: np.ndarray, doc: np.ndarray, kind: int) -> None:
            parts.append((doc.astype(np.int64) << BITS) | (mix(hashes + np.uint64(kind)) & mask).astype(np.int64))

        of = words(found)
        add(span_hashes(found.data, of.starts, of.ends), of.doc, 1)
        for n in self.beginnings:
            long = (of.ends - of.starts) > n
            add(span_hashes(found.data, of.starts[long], of.starts[long] + n), of.doc[long], 2)
        for grams, kind in ((self.anywhere, 3), (self.within, 4)):
            for n in grams:
                if len(found.data) < n:
                    continue
                code = np.zeros(len(found.data) - n + 1, np.uint64)
                for j in range(n):
                    code = (code << np.uint64(8)) | found.data[j : len(found.data) - n + 1 + j]
                at = np.arange(len(code))
                if kind == 4:
                    at = at[_stays(of.starts, of.ends, len(found.data), n)]
                else:
                    at = at[_stays(found.offsets[:-1], found.offsets[1:], len(found.data), n)]
                add(code[at] * np.uint64(31) + np.uint64(n), np.searchsorted(found.offsets, at, "right") - 1, kind)
        cells, times = np.unique(np.concatenate(parts), return_counts=True)
        doc, feature = cells >> BITS, (cells & ((1 << BITS) - 1)).astype(np.int64)
        if self.presence:
            return doc, feature, np.ones(len(doc), np.float32)
        value = np.log1p(times)
        norm = np.sqrt(np.bincount(doc, value * value, minlength=len(found)))
        return doc, feature, (value / norm[doc]).astype(np.float32)


def _stays(starts: np.ndarray, ends: np.ndarray, size: int, n: int) -> np.ndarray:
    """Places from which n bytes stay in one of the spans."""
    inside = np.zeros(size + 1, np.int8)
    long = (ends - starts) >= n
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - n + 1, -1)
    return np.cumsum(inside[: size - n + 1]) > 0


@dataclass
class LinearModel:
    features: Features
    weights: np.ndarray
    bias: float
    slope: float  # of the calibration
    shift: float

    def margins(self, found: Texts) -> np.ndarray:
        doc, feature, value = self.features.of(found)
        return np.bincount(doc, self.weights[feature] * value, minlength=len(found)) + self.bias

    def probabilities(self, found: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(found) + self.shift, -40, 40)))


def _descend(doc, feature, value, labels, size, weight, rounds, step, ridge) -> tuple[np.ndarray, float]:
    """Full-batch descent with a step for each feature."""
    w, b = np.zeros(size), 0.0
    seen, seen_b = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        margin = np.bincount(doc, w[feature] * value, minlength=len(labels)) + b
        slack = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels)
        slope = np.bincount(feature, slack[doc] * value, minlength=size) + ridge * w
        seen += slope * slope
        w -= step * slope / np.sqrt(seen)
        seen_b += slack.sum() ** 2
        b -= step * slack.sum() / np.sqrt(seen_b)
    return w, b


def fit(features: Features, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, significant: float = 0, folds: int = 3, rounds: int = 120, step: float = 0.3, ridge: float = 2e-4) -> LinearModel:
    """From (feature, value) arrays of labelled texts.

    The calibration is a slope and a shift of the margin, fitted to probabilities under ``prior``,
    the share of label 1 in the data that the rows were drawn from. Its margins are those of models
    that were fitted without the row (cross-fitting over ``folds``).
    Features seen in one row only are left out. With ``significant``, features whose shares of the
    rows of either label differ by fewer standard errors count less, the ridge penalty on their
    weights growing with the shortfall; none is left out for it.
    """
    if not len(labels) or labels.min() == labels.max():
        chance = float(labels.mean()) if len(labels) else prior
        odds = np.log(max(chance, 1e-6) / max(1 - chance, 1e-6))
        return LinearModel(features, np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(odds))
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature, value = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    value = value.astype(np.float64)
    share = labels.mean()
    importance = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))

    def trained(own: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of all features, from the rows ``own``; both labels count alike."""
        trust = _trust(doc, feature, labels, own, significant)
        telling = trust > 0
        used = np.flatnonzero(telling)
        keep = telling[feature] & own[doc]
        weight = own * np.where(labels == 1, 0.5 / max((own & (labels == 1)).sum(), 1), 0.5 / max((own & (labels == 0)).sum(), 1))
        w, b = _descend(doc[keep], (np.cumsum(telling) - 1)[feature[keep]], value[keep] * trust[feature[keep]], labels, len(used), weight, rounds, step, ridge / 10)
        full = np.zeros(1 << BITS)
        full[used] = w * trust[used]
        return full, b

    turn = np.empty(len(labels), np.int64)
    for label in (0, 1):  # each fold has its part of both labels
        turn[labels == label] = np.arange((labels == label).sum()) % folds
    margin = np.empty(len(labels))
    for k in range(folds):
        w, b = trained(turn != k)
        aside = turn[doc] == k
        sums = np.bincount(doc[aside], w[feature[aside]] * value[aside], minlength=len(labels)) + b
        margin[turn == k] = sums[turn == k]
    slope, shift = _calibrate(margin, labels, importance)
    w, b = trained(np.ones(len(labels), bool))
    return LinearModel(features, w.astype(np.float32), b, slope, shift)


def _trust(doc, feature, labels, own, significant) -> np.ndarray:
    """A factor of each feature's value, up to 1; only the rows ``own`` have a say.

    A factor t is a ridge penalty 1 / t ** 2 times as strong; 0 is a feature of fewer than two rows.
    """
    ones, zeros = (labels == 1) & own, (labels == 0) & own
    seen = [np.bincount(feature, rows[doc], minlength=1 << BITS) for rows in (ones, zeros)]
    repeated = seen[0] + seen[1] > 1
    if not significant:
        return repeated.astype(np.float64)
    n, m = max(ones.sum(), 1), max(zeros.sum(), 1)
    mean = (seen[0] + seen[1]) / (n + m)
    error = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n + 1 / m))
    away = np.abs(seen[0] / n - seen[1] / m) / (significant * error)
    return repeated * np.minimum(away, 1) ** POWER


def _calibrate(margin: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back margins, by Newton steps.

    Labels are drawn in by one part in the class's size plus two, so that classes that separate
    fully still give finite curves; a slope is never negative.
    """
    ones, zeros = (labels == 1).sum(), (labels == 0).sum()
    wanted = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    spread = margin.std() or 1.0
    x = np.stack([margin / spread, np.ones(len(margin))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        slope = x.T @ (weight * (p - wanted)) + 1e-3 * at
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(bend, slope)
    return float(max(at[0], 0.0) / spread), float(at[1])
