"""Token counts, conversation repair and spelling variants against plain versions."""

import hashlib
import random
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from modcensus.llm import op11_token_counts, op12_conversations, op13_spellings, queries, sql
from tests.llm.conftest import SMALL, odd_rows

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")


# token counts


def test_plain_characters_are_cut_alike():
    cut = op11_token_counts.PreTokens(BYTE_LEVEL)
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and op11_token_counts._PLAIN.fullmatch(chr(c))]
    assert len(plain) > 30_000
    for a in range(0, len(plain), 2000):
        text = "".join(f"a{c}1{c}!{c} {c}'s" for c in plain[a : a + 2000])
        own = op11_token_counts._CUT.findall(text)
        assert own == [text[x:y] for _, (x, y) in cut._library.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("frequent", [0, 3, op11_token_counts.FREQUENT])
def test_token_counts_are_those_of_the_library(spark, frequent):
    library = Tokenizer.from_file(BYTE_LEVEL)
    texts = [row.text for row in odd_rows()]
    texts += ["a  b\n\n c\t\td  ", "<|endoftext|><|endoftext|> x <|endoftext|>", "don't we'll '5", "ա։ ֐ 𐡀 ﷽ ஃ", "\x85\x1c\xa0x", "z" * 300 + " " + "z" * 300, "  　x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").repartition(3)
    rows = op11_token_counts.token_counts(docs, BYTE_LEVEL, ["doc_id"], frequent=frequent).collect()
    found = {row.doc_id: (row.n_bytes, row.n_tokens) for row in rows}
    wanted = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts)}
    assert found == wanted and len(rows) == len(texts)


def test_each_pre_token_is_counted_once(spark):
    docs = spark.createDataFrame([("a b a",), ("a b",), (None,), ("x" * 100,)], "text STRING").repartition(2)
    rows = op11_token_counts.pre_token_counts(docs, BYTE_LEVEL).collect()
    found = {bytes(row.key): row.occurrences for row in rows}
    assert len(found) == len(rows) == 4 and found[b"a"] == 2 and found[b" b"] == 2 and found[b" a"] == 1
    assert found[op11_token_counts.key_of("x" * 100)] == 1


def test_the_most_frequent_are_at_most_so_many(spark):
    rows = [(bytes([65 + i]), 2**i, i) for i in range(20)]
    counts = spark.createDataFrame(rows, "key BINARY, occurrences LONG, pieces LONG")
    for most in (0, 1, 7, 50):
        assert op11_token_counts.most_frequent(counts, most) == {key: pieces for key, _, pieces in rows[::-1][:most]}


# conversations


def least_edits(rows):
    """All ways row by row, the least (cost, audit) of each state: a plain forward pass."""

    def inserted(ways):
        while True:
            more = dict(ways)
            for state, (cost, audit) in ways.items():
                to, way = op12_conversations.STEPS[state, op12_conversations.DUE[state]], (cost + 3, audit + "I")
                more[to] = min(more.get(to, way), way)
            if more == ways:
                return ways
            ways = more

    ways = inserted({0: (0, "")})
    for initial, wrong, copies in rows:
        after: dict = {}
        for state, (cost, audit) in ways.items():
            options = [(state, 4, "D")]
            if wrong not in ("blank", "duplicate"):
                lost = 3 if wrong == "truncated" else 0
                options += [(to, lost, "K") for (at, by), to in op12_conversations.STEPS.items() if (at, by) == (state, initial)]
                options.append((op12_conversations.STEPS[state, op12_conversations.DUE[state]], 3 + lost, "R"))
            for to, more, letter in options:
                way = (cost + more + 4 * copies, audit + letter + "D" * copies)
                after[to] = min(after.get(to, way), way)
        ways = inserted(after)
    return min(ways[state] for state in (0, 3) if state in ways)


def random_lattice(draw, size):
    return [(draw.choice("suauaux") if draw.random() > 0.05 else "", draw.choice(["", "", "", "truncated", "blank", "duplicate"]), draw.choice([0, 0, 0, 2])) for _ in range(size)]


def test_two_heaps_find_the_least_edits_and_audit():
    draw = random.Random(4)
    for _ in range(600):
        rows = random_lattice(draw, draw.randrange(12))
        out, into = op12_conversations.edit_edges(rows)
        found = op12_conversations.cheapest(out, into, [(0, 0)], [(len(rows), state) for state in op12_conversations.FINAL])
        assert found == least_edits(rows), rows


def test_segments_chain_to_the_same_edits():
    draw = random.Random(5)
    for _ in range(150):
        rows = random_lattice(draw, draw.randrange(1, 14))
        width = draw.randrange(1, 5)
        cost, parts = op12_conversations.chained([op12_conversations.segment_ways(rows[i : i + width]) for i in range(0, len(rows), width)])
        assert (cost, "".join(audit for _, audit in parts)) == least_edits(rows), rows
        whole = op12_conversations.repaired("".join(audit for _, audit in parts), [(initial, "t", copies) for initial, _, copies in rows])
        pieces = [op12_conversations.repaired(audit, [(initial, "t", copies) for initial, _, copies in rows[i * width : (i + 1) * width]], start) for i, (start, audit) in enumerate(parts)]
        assert [row for piece in pieces for row in piece] == whole


def plain_report(rows):
    """conv_id -> the report's values, from (conv_id, turn, role, text) rows."""
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    found = {}
    for conv, group in groups.items():
        group.sort()
        seen, lattice = set(), []
        for _, _, role, text in group:
            bare = text.strip(" \t\n\x0b\x0c\r")
            wrong = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            lattice.append((role[:1], wrong, 0))
        cost, audit = least_edits(lattice)
        result = op12_conversations.repaired(audit, [(role, text, 0) for _, _, role, text in group])
        turns = {turn for known, turn, _, _ in group if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(lattice, lattice[1:], strict=False))
        text = "\n".join(f"{role}:{text}" for role, text in result)
        counts = [sum(wrong == name for _, wrong, _ in lattice) for name in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def odd_conversations():
    draw = random.Random(6)
    rows = []
    for conv in (None, 1, 2, 3, 4, 5):
        for _ in range({1: 90, 2: 1}.get(conv, 9)):
            rows.append((conv, draw.choice([None, *range(40)]), draw.choice(["system", "user", "user", "assistant", "assistant", "", None, "tool"]), draw.choice([None, "", "yes", "no.", "what?", "so \n", "x" * 5000, "漢!"])))
    rows += [(1, 3, "user", "again.")] * 20  # one row many times
    return rows


@pytest.mark.parametrize("most", [3, 16, op12_conversations.ROWS])
def test_reports_of_short_and_long_conversations(spark, most):
    rows = odd_conversations()
    docs = spark.createDataFrame([(*row, 7) for row in rows], "conv_id LONG, turn LONG, role STRING, text STRING, segment INT").repartition(5)
    found = op12_conversations.repair_report(docs, most).collect()
    names = [*op12_conversations.COUNTERS, "cost", "audit", "repaired_sha256"]
    assert {row.conv_id: tuple(row[name] for name in names) for row in found} == plain_report(rows)
    assert len(found) == 6


def test_repaired_texts(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "assistant", "c")]
    whole, segments = op12_conversations.repaired_parts(spark.createDataFrame(rows, "conv_id INT, turn LONG, role STRING, text STRING"))
    row = whole.collect()[0]
    assert (row.audit, row.found.cost) == ("KKIKK", 6)
    assert [(r.role, r.text) for r in row.repaired] == [("system", "s."), ("user", "a."), ("assistant", ""), ("user", "b."), ("assistant", "c")]
    assert segments.collect() == []


def test_conversations_query_keeps_every_conversation(spark, tmp_path):
    rows = [(i, t, "user", "x.") for i in (None, *range(60)) for t in (0,)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {row.conv_id: row for row in queries.op12_conversations_query(spark, str(tmp_path)).collect()}
    assert set(found) == {None, *range(60)}
    for i in range(60):
        if zlib.crc32(f"{i}:0".encode()) % 20 == 0:
            assert (found[i].audit, found[i].cost, found[i].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())


# spelling variants


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def made_words(count=250):
    draw = random.Random(3)
    words: set = set()
    while len(words) < count:
        word = "".join(draw.choice("aebéÉñxyzqÿ×") for _ in range(draw.choice([3, 4, 5, 6, 70, 64])))
        words.add(word)
        i = draw.randrange(len(word))
        letter = draw.choice("aebéñ")
        words |= {word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]}
    return sorted(words - {""})


@pytest.mark.parametrize(("subtree", "visitors"), [(100_000, 50_000), (40, 30), (2, 5)])
def test_near_pairs_are_all_pairs_at_one_edit(spark, subtree, visitors):
    words = made_words() + ["stale", "least", "tales", "steal", "slate", "stalf"]  # equal vectors too
    table = spark.createDataFrame([(word, i + 1) for i, word in enumerate(words)], "word STRING, n LONG").repartition(4)
    rows = op13_spellings.near_pairs(table, subtree, visitors).collect()
    found = [tuple(sorted((row.word, row.other))) for row in rows]
    wanted = {tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1 :] if distance_one(a, b)}
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 200
    number = {word: i + 1 for i, word in enumerate(words)}
    assert all((row.n, row.other_n) == (number[row.word], number[row.other]) for row in rows)


def test_forms_ties_and_roots(spark):
    words = [("colours", 5000), ("colourz", 400), ("coloura", 400), ("colourza", 20), ("colourzab", 2), ("aolourz", 40)]
    rows = {row.word: row for row in op13_spellings.spelling_forms(spark.createDataFrame(words, "word STRING, n INT")).collect()}
    assert rows["colours"].form is None and rows["colours"].root == "colours" and rows["colours"].n_near == 2
    assert (rows["colourza"].form, rows["colourza"].form_n, rows["colourza"].root) == ("coloura", 400, "colours")
    assert (rows["colourzab"].form, rows["colourzab"].root, rows["colourzab"].n_near) == ("colourza", "colours", 1)
    assert rows["aolourz"].form == "colourz"


# queries against SQL


@pytest.mark.parametrize("name", ["op12_conversations", "op13_spellings"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [part[0] for part in result.description]
    rows = queries.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, result.fetchall()))
