"""Fits the linear model on a bounded sample of labelled documents."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from modcensus.llm.common import sampled_texts, with_results
from modcensus.llm.linear import Features, LinearModel, fit
from modcensus.llm.vectext import texts


def _featured(features: Features, prepare):
    def compute(column: pa.Array):
        found = prepare(column)
        doc, feature, value = features.of(found)
        edges = np.searchsorted(doc, np.arange(len(found) + 1))
        parts = list(zip(edges[:-1], edges[1:], strict=True))
        return [feature[a:b].astype("<i4").tobytes() for a, b in parts], [value[a:b].astype("<f4").tobytes() for a, b in parts]

    return compute


def fitted(docs: DataFrame, chosen: DataFrame, share: float, features: Features, prepare=texts, significant: float = 0) -> LinearModel:
    """Features are taken where the texts are; the sampled rows' n-grams come to the driver.

    ``chosen`` bounds them to some thousand rows of at most 2 ** 18 features each. Rows are put in the
    order of their ids, so the model does not depend on how tasks ended.
    """
    rows = with_results(sampled_texts(docs, chosen), _featured(features, prepare), "features BINARY, share BINARY", ["doc_id", "label"])
    found = rows.toPandas().sort_values("doc_id", key=lambda ids: ids.astype(str).map(hash_of))
    pairs = [(np.frombuffer(f, "<i4"), np.frombuffer(v, "<f4")) for f, v in zip(found["features"], found["share"], strict=True)]
    return fit(features, pairs, found["label"].to_numpy(), share, significant)


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode())
