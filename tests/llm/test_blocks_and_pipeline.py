"""Nearest neighbours over several blocks, and the pipeline to its end."""

import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from modcensus.llm import op8_neighbours
from tests.llm.test_near_copies import window_sets


def exact(vectors, queries, k):
    """query -> [(vec_id, score)] from (id, vector) rows; all rows of an id are candidates of the others."""
    found = {}
    for query in {i for i, _ in vectors if i in queries}:
        own = [v for i, v in vectors if i == query]
        scores = [(float(np.dot(q, v)), i) for q in own for i, v in vectors if i != query]
        found[query] = [(i, score) for score, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return found


@pytest.mark.parametrize("repeated", [False, True])
def test_blocks_are_merged(spark, repeated):
    draw = np.random.default_rng(5)
    vectors = [(i, draw.standard_normal(24)) for i in range(900)]
    if repeated:  # two vectors under one id
        vectors += [(i, draw.standard_normal(24)) for i in range(0, 900, 45)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id LONG, embedding ARRAY<DOUBLE>")
    rows = op8_neighbours.neighbours(table, F.col("vec_id") % 20 == 0, block=100).collect()
    wanted = exact(vectors, set(range(0, 900, 20)), 20)
    got = {}
    for row in sorted(rows, key=lambda row: (row.query_id, row.rank)):
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert set(got) == set(wanted) and all(len(found) == 20 for found in got.values())
    assert sorted({row.rank for row in rows}) == list(range(1, 21))
    hits = sum(len(set(i for i, _ in got[q]) & set(i for i, _ in wanted[q])) for q in wanted)
    assert hits >= 0.95 * sum(len(set(i for i, _ in found)) for found in wanted.values())
    for query, found in got.items():
        assert [score for _, score in found] == sorted((score for _, score in found), reverse=True)
        assert query not in {i for i, _ in found}


def sentences(draw, words, count):
    return "\n".join(" ".join(draw.choice(words) for _ in range(12)).capitalize() + "." for _ in range(count))


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    draw = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    english = ["".join(draw.choice(letters[:13]) for _ in range(draw.randrange(2, 8))) for _ in range(300)]
    other = ["".join(draw.choice(letters[13:] + "äöü") for _ in range(draw.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(80):
        text = sentences(draw, (english, other)[i % 2], 10)
        rows.append((i, text, ("en", "de")[i % 2]))
    rows[10] = (10, rows[11][1], "de")  # a copy
    rows[20] = (20, rows[21][1] + " zuletzt", "de")  # a near copy
    rows[30] = (30, rows[30][1] + "\npassword = hunter2hunter2", "en")
    rows[40] = (40, "#### $$$$ |||| " * 40, "en")  # no letters
    rows[41] = (41, None, None)
    rows[42] = (42, "short text", "en")
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    return folder, {i: t for i, t, _ in rows}


def test_pipeline_to_its_end(spark, small_corpus):
    """Rejected documents go, one of each class stays, secrets are masked, and what is left is packed whole."""
    folder, text = small_corpus
    # without labels only the rules judge quality
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {row.doc_id for row in rows}
    assert not kept & {40, 41, 42}
    assert len(kept & {10, 11}) <= 1 and len(kept & {20, 21}) <= 1
    sets = dict(zip(sorted(kept), window_sets([(i, (text[i] or "").lower()) for i in sorted(kept)]), strict=True))
    for a in kept:
        for b in kept:
            common = len(sets[a] & sets[b])
            assert a == b or common < 0.8 * (len(sets[a]) + len(sets[b]) - common)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in kept:
        masked = re.sub(r"password = hunter2hunter2", lambda m: "*" * len(m.group()), text[i])
        assert sum(row.length for row in rows if row.doc_id == i) == len(library.encode(masked, add_special_tokens=False).ids) + 1
    for sequence in {row.sequence_id for row in rows}:
        at = 0
        for row in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= 1024
    assert len(kept) > 60


def test_a_search_holds_candidates_of_a_portion_only():
    """All of a block may be met by each query: what is kept of it must not grow with the queries."""
    rng = np.random.default_rng(3)
    points, queries = rng.standard_normal((3_000, 16)), rng.standard_normal((1_500, 16))
    forest = op8_neighbours.Forest(points, float(np.linalg.norm(points, axis=1).max()), trees=4)
    tracemalloc.start()
    found = forest.search(queries, [np.zeros(0, int)] * len(queries), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = np.argsort(-(queries @ points.T), axis=1)[:, :5]
    assert np.mean([len(set(at) & set(best)) / 5 for (at, _), best in zip(found, exact, strict=True)]) > 0.9
    assert peak < 16_000_000
