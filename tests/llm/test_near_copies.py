"""Groups of near copies: all links found, and pairs in proportion to the texts."""

import random
from itertools import combinations

import pytest

from modcensus.llm import op4_near_duplicates


def near_copies(count: int) -> list[tuple[int, str]]:
    """One text of 160 words, up to eight of them changed in each copy."""
    draw = random.Random(count)
    words = [f"w{i}" for i in range(5000)]
    base = [draw.choice(words) for _ in range(160)]
    rows = []
    for i in range(count):
        copy = list(base)
        for _ in range(draw.randrange(9)):
            copy[draw.randrange(160)] = draw.choice(words)
        rows.append((i, " ".join(copy)))
    return rows


def window_sets(rows, width=5):
    split = [text.split() for _, text in rows]
    return [{tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} for words in split]


def classes_by_all_pairs(rows, similar=0.8):
    sets, root = window_sets(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common >= similar * (len(sets[a]) + len(sets[b]) - common):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(len(rows))]


def test_pairs_grow_with_the_copies(spark, monkeypatch):
    land, tested = op4_near_duplicates.land, []

    def watched(rows, label):
        landed = land(rows, label)
        if label == "tested":
            tested.append(landed)
        return landed

    monkeypatch.setattr(op4_near_duplicates, "land", watched)
    pairs = []
    for count in (200, 400):
        rows = near_copies(count)
        found = op4_near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)).collect()
        assert {row.doc_id: row.class_id for row in found} == dict(enumerate(classes_by_all_pairs(rows)))
        pairs.append(tested[-1].count())
    assert pairs[1] <= 2.3 * pairs[0], pairs


@pytest.mark.parametrize("weighted", [False, True])
def test_linked_texts_share_a_rare_bucket(spark, weighted):
    draw = random.Random(9)
    words = "a b c d e f g h i j k l m n o p".split()
    rows = []
    for i in range(60):
        text = [draw.choice(words) for _ in range(draw.choice([6, 20, 60]))] * draw.choice([1, 2])
        for copy in range(3):
            changed = list(text)
            for _ in range(draw.randrange(3)):
                changed[draw.randrange(len(changed))] = draw.choice(words)
            rows.append((3 * i + copy, " ".join(changed[draw.randrange(2) :])))
    texts = spark.createDataFrame(rows, "uid LONG, text STRING")
    prepared = op4_near_duplicates.signed(texts.withColumnRenamed("uid", "doc_id"), weighted=weighted)
    left = prepared.selectExpr("doc_id AS uid", "windows", "doc_id AS class")
    tested = spark.createDataFrame([], "a LONG, b LONG, similarity DOUBLE")
    dealt: dict = {}
    for row in op4_near_duplicates.rare_buckets(left, texts, tested, 0.8, 5, weighted).collect():
        dealt.setdefault(row.bucket, []).append(row.uid)
    met = {pair for uids in dealt.values() for pair in combinations(sorted(uids), 2)}

    def counted(text):
        split = text.split()
        found: dict = {}
        for i in range(len(split) - 4):
            found[tuple(split[i : i + 5])] = found.get(tuple(split[i : i + 5]), 0) + 1
        return found if weighted else dict.fromkeys(found, 1)

    sets = [counted(text) for _, text in rows]
    linked = set()
    for a, b in combinations(range(len(rows)), 2):
        common = sum(min(n, sets[b].get(window, 0)) for window, n in sets[a].items())
        if common >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - common):
            linked.add((a, b))
    assert linked and linked <= met and len(met) < len(rows) * (len(rows) - 1) / 8


def test_sizes_out_of_reach_make_no_rows(spark):
    """A window that texts of very many sizes share is dealt to the sizes in reach only, not to all of them."""
    rows = [(i, " ".join(["a b c d e", *(f"w{i}x{j}" for j in range(4 * i + 2))])) for i in range(120)]
    texts = spark.createDataFrame(rows, "uid LONG, text STRING")
    left = texts.selectExpr("uid", "CAST(size(split(text, ' ')) - 4 AS LONG) AS windows", "uid AS class")
    tested = spark.createDataFrame([], "a LONG, b LONG, similarity DOUBLE")
    frames, land = [], op4_near_duplicates.land
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(op4_near_duplicates, "land", lambda rows, label: frames.append((label, rows)) or land(rows, label))
        op4_near_duplicates.rare_buckets(left, texts, tested, 0.8, 5, False)
    plan = dict(frames)["dealt"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(filter(steps" in plan and "explode(steps" not in plan


def test_texts_stay_where_they_lie(spark):
    rows = spark.range(0, 70_000, 1, 3).selectExpr("monotonically_increasing_id() AS uid", "id AS text")
    wanted = rows.where("text % 997 = 3 OR text IN (0, 32768, 69999)")
    found = op4_near_duplicates._among(rows, wanted.select("uid").unionAll(wanted.select("uid")))
    assert sorted(r.text for r in found.collect()) == sorted(r.text for r in wanted.collect())
    assert op4_near_duplicates._among(rows, wanted.where("false").select("uid")).count() == 0


def test_large_buckets_in_proportion_are_done_at_once(spark, monkeypatch):
    """Three texts outside a large class meet all its members, each pair once."""
    members = [(1, uid, 100, 1, 0 if uid < 30 else uid, 1, False, uid >= 30) for uid in range(33)]
    rows = spark.createDataFrame(members, "bucket LONG, uid LONG, windows LONG, meets LONG, class LONG, size LONG, small BOOLEAN, outside BOOLEAN")
    pairs = [tuple(r) for r in op4_near_duplicates._across(rows, 0.8).collect()]
    assert sorted(pairs) == sorted([(a, b) for b in (30, 31, 32) for a in range(b) if a < 30 or a >= 30])
