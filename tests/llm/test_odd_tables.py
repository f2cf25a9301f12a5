"""Every query over tables of nulls, empty, long and repeated rows, and over empty tables."""

import pytest

import corpus_pipeline
from modcensus.llm import queries
from tests.llm.conftest import TEXTS, odd_rows

PER_DOCUMENT = [name for name in queries.queries() if name not in ("op8_neighbours", "op10_packing", "op12_conversations", "op13_spellings")]


@pytest.fixture(scope="module")
def results(spark, odd_folder):
    return {name: query(spark, odd_folder).collect() for name, query in queries.queries().items()}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty_folder, name):
    assert queries.queries()[name](spark, empty_folder).collect() == []


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_every_row_has_a_result(results, name):
    ids = sorted((row.doc_id is None, row.doc_id or 0) for row in results[name])
    assert ids == sorted((row.doc_id is None, row.doc_id or 0) for row in odd_rows())


@pytest.mark.parametrize("name", ["op1_language", "op3_toxicity", "op6_secrets", "op7_quality"])
def test_repeated_rows_are_alike(results, name):
    one, two = (row for row in results[name] if row.doc_id == 5)
    assert one == two


def by_id(rows):
    return {row.doc_id: row for row in rows}


def test_language(results):
    rows = by_id(results["op1_language"])
    for i in (0, 1, 2, 11):
        assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    assert rows[7].lang_pred == "de" and rows[5].lang_pred == "en"


def test_sentencepiece(results):
    rows = by_id(results["op2_sentencepiece"])
    assert rows[0].n_tokens == rows[1].n_tokens == 0
    assert all(row.round_trip for row in results["op2_sentencepiece"])
    assert rows[10].chunks > 1 and rows[8].chunks > 1


def test_toxicity(results):
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.7) for row in results["op3_toxicity"])
    rows = by_id(results["op3_toxicity"])
    assert rows[0].score == rows[1].score == rows[2].score


def test_near_duplicates(results):
    rows = by_id(results["op4_near_duplicates"])
    assert [rows[i].class_id for i in (0, 1, 2, 3, 4, 5, 6)] == [0, 1, 2, 3, 3, 5, 5]
    assert rows[9].class_id == 8 and rows[10].class_id == 10
    assert rows[None].class_id == 7
    kept = [row for row in results["op4_near_duplicates"] if row.kept]
    assert len(kept) == len({row.class_id for row in kept}) == len({row.class_id for row in results["op4_near_duplicates"]})


def test_token_files(results):
    rows = results["op5_token_files"]
    at = 0
    for row in sorted(rows, key=lambda row: row.start):
        assert row.start == at and row.n_tokens >= 1
        at += row.n_tokens
    assert by_id(rows)[0].n_tokens == by_id(rows)[1].n_tokens == 1
    assert sorted(rows, key=lambda row: row.start)[0].doc_id is None


def test_secrets(results):
    rows = by_id(results["op6_secrets"])
    assert (rows[12].n_assign, rows[12].n_access, rows[12].n_hex) == (1, 1, 1)
    assert rows[0].spans == rows[1].spans == ""


def test_quality(results):
    rows = by_id(results["op7_quality"])
    assert [rows[i].n_words for i in (0, 1, 2, 3)] == [0, 0, 0, 3]
    assert all(rows[i].base_failed and not rows[i].kept for i in (0, 1, 2, 3))
    assert rows[8].n_dup_lines == 899


def test_neighbours(results):
    rows = results["op8_neighbours"]
    assert not {row.vec_id for row in rows} & set(range(100, 141)) and {row.query_id for row in rows} == {0, 20, 40}
    assert not any(row.vec_id == row.query_id for row in rows)
    # vectors of equal value tie, smaller ids first
    first = [row.vec_id for row in sorted((r for r in rows if r.query_id == 40), key=lambda r: r.rank)]
    assert first[:7] == [6, 13, 20, 27, 34, 41, 5]


def test_sharding(results):
    rows = results["op9_sharding"]
    for shard in {row.shard for row in rows}:
        assert sorted(row.slot for row in rows if row.shard == shard) == list(range(sum(row.shard == shard for row in rows)))
    assert by_id(rows)[0].size == 8 and by_id(rows)[1].text_crc32 == 0


def test_packing(results):
    rows = results["op10_packing"]
    assert {row.doc_id for row in rows} == {*range(len(TEXTS)), None}
    assert by_id([row for row in rows if row.doc_id in (0, 1)])[0].length == 1
    for sequence in {row.sequence_id for row in rows}:
        at = 0
        for row in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= 1024


def test_token_counts(results):
    rows = by_id(results["op11_token_counts"])
    assert (rows[0].n_bytes, rows[0].n_tokens, rows[0].over_limit) == (rows[1].n_bytes, rows[1].n_tokens, False) == (0, 0, False)
    assert rows[8].over_limit and rows[10].n_bytes == 40_000


def test_conversations(results):
    rows = {row.conv_id: row for row in results["op12_conversations"]}
    assert set(rows) == {None, 1, 2}
    assert rows[None].audit == "D" * rows[None].blank


def test_spellings(results):
    rows = {row.word: row for row in results["op13_spellings"]}
    assert rows["consectetur"].n >= 1800 and rows["schnelle"].n >= 2
    assert all((row.form is None) == (row.form_n is None) for row in rows.values())


def test_a_pipeline_of_odd_rows(spark, odd_folder, empty_folder):
    for folder in (odd_folder, empty_folder):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns, name
            assert kept.count() <= docs.count()
    assert corpus_pipeline.run(spark, empty_folder).collect() == []
