"""The methods against brute force, the libraries and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modcensus.llm import op1_language, op2_sentencepiece, op3_toxicity, op4_near_duplicates, op6_secrets, op9_sharding, op10_packing, queries
from modcensus.llm.bpe import TextEncoder
from modcensus.llm.components import components
from modcensus.llm.linear import Features, fit
from modcensus.llm.vectext import mix
from tests.llm.conftest import MEDIUM, SMALL

WORDS = ["the", "tion", "▁", "  ", "é", "漢字", "😀", "aaaa", "ing", "\n", "\t", "12", "don't", "A.", "??", "\x1c", "\xa0", " ", "ﬁ", "́", "Σας", "THE!!", "<|endoftext|>", "\n\n", " \n"]


def texts(folder):
    return dict(zip(*(pq.read_table(f"{folder}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")), strict=True))


def nasty(n, size, seed=5):
    pick = random.Random(seed)
    return ["".join(pick.choice(WORDS) for _ in range(pick.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    encoder, library = TextEncoder(public_tokenizers.path(name), 500), Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    for text in [*nasty(3000, 12), *list(texts(SMALL).values())]:
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_language_of_held_out_rows(spark):
    rows = queries.op1_language_query(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet"), "doc_id")
    right = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_dictionaries_hold_the_whole_sample(spark):
    def words(start, n):
        return " ".join("".join(chr(97 + int(d)) for d in str(i)) for i in range(start, start + n))

    rows = [("xx", words(10_000 + 1000 * i, 1000)) for i in range(40)] + [("yy", words(900_000, 9_000)), ("zz", "漢" * 30_000)]
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id LONG, lang STRING, text STRING")
    made = dict(op1_language.learn(docs, F.lit(True)))
    assert sorted(made) == ["xx", "yy", "zz"]
    assert all(text.encode() in made["xx"] for lang, text in rows if lang == "xx")
    assert all(4_000 < len(made[lang]) <= op1_language.SAMPLE_BYTES for lang in ("yy", "zz"))


def test_all_of_a_long_dictionary_is_used():
    pick = random.Random(1)
    content = bytes(pick.choices(b"abcdefghijklmnopqrstuvwxyz ", k=2_500_000))
    compressor = op1_language._compressors((("xx", content),))[0]
    assert all(len(compressor.compress(content[at : at + 1000])) < 100 for at in range(0, len(content), 100_000))


def test_pieces_of_chunks_are_those_of_the_library():
    model = op2_sentencepiece.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for text in [*nasty(40, 200), "a" * 700, " " * 700, "internationalization" * 40, "漢字" * 100]:
        plain = model.normalized(text)
        for size in (20, 64, 300):
            count = -(-len(plain) // size)
            rows = [{"chunk": k, "chunks": count, "left": min(k * size, model.longest), "text": plain[k * size - min(k * size, model.longest) : (k + 1) * size + model.longest]} for k in range(count)]
            chunks = [op2_sentencepiece._chunk(model, size, row) for row in rows]
            if not chunks:
                continue
            frame = pd.DataFrame({"place": range(count), "pairs": [[list(p) for p in c.matrix()] for c in chunks], "entry": -1, "exit": -1})
            states = op2_sentencepiece._settle((0,), frame)
            found = [i for c, a, b in zip(chunks, states["entry"], states["exit"], strict=True) for i in c.backtrace(a, b)]
            assert found == model.library.encode(text), text


def test_scan_over_levels(spark):
    """With two matrices a task the products go up and down several levels."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = {1: "internationalization of " * 90, 2: "aaaaaaab" * 200, 3: "short", 4: ""}
    frame = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING")
    parts = op2_sentencepiece.encoded(frame, path, 100, fan=2)
    rows = op2_sentencepiece.whole_documents(*(op2_sentencepiece.decoded(part, path) for part in parts)).collect()
    library = op2_sentencepiece.Pieces(path).library
    for row in rows:
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode(docs[row.doc_id])
        assert row.text == docs[row.doc_id]
    assert len(rows) == 4


def test_disguises_are_restored(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    restorer = op3_toxicity.Restorer(op3_toxicity.character_model(docs))
    for plain, disguised in (("moron", "m0r0n"), ("idiot", "1d10t"), ("idiot", "i d i o t"), ("moron", "m-o-r-o-n"), ("trash", "tr@$h"), ("clown", "cl0wn"), ("disgusting", "diiisgusting")):
        assert restorer.restored(f"so {disguised} it") == f"so {plain} it"
    for clean in ("THE!! END!!", "+1 (499) 555-6503", "a$$$ the%%%", "1 2 3 4 5"):
        assert restorer.restored(clean) == clean
    found = op3_toxicity.texts(pa.array(["plain text, a to b", "m0r0n", "xrrry", "i d i o t"]))
    assert op3_toxicity.suspicious(found).tolist() == [False, True, True, True]


def decoded_everywhere(restorer, text):
    """Unrestricted: every token and every run of single characters is decoded."""
    token = r"(?:[^\W_]|[@$!|+])"
    units = re.compile(rf"(?<![^\W_])(?<![@$!|+]){token}(?!{token})(?:(?:(?!{token})[\s\S]){{1,3}}{token}(?!{token})){{2,}}|{token}+")
    return units.sub(lambda unit: restorer.decoded(unit[0]), text)


def test_every_token_that_may_be_disguised_is_decoded(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    restorer = op3_toxicity.Restorer(op3_toxicity.character_model(docs))
    spelled = ["iiddiioott", "idio+", "idi07", "i  d  i  o  t", "i/d/i/o/t", "i,d,i,o,t", "i. d. i. o. t", "i.d-i.o-t", "i\u2009d\u2009i\u2009o\u2009t", "i·d·i·o·t"]
    for plain, disguised in [*(("idiot", x) for x in spelled), ("moron", "moorroon"), ("stupid", "stuupidd"), ("Trash", "TrRrash"), ("ass", "a s s")]:
        assert restorer.restored(f"so {disguised} it") == f"so {plain} it"
        assert op3_toxicity.suspicious(op3_toxicity.texts(pa.array([disguised]))).all()
    for literal in ("a$$$ as$ that! was!!", "hello 22 hunter22", "3.5 + 4.0 = 7.5", "1/2/3/4"):
        assert restorer.restored(literal) == literal
    pick = random.Random(3)
    odd = ["".join(pick.choice("idotTa$07+!1 .-é/\n漢_²") for _ in range(pick.randint(0, 25))) for _ in range(3000)]
    for text in [*odd, *nasty(500, 12), *filter(None, texts(MEDIUM).values())]:
        assert restorer.restored(text) == decoded_everywhere(restorer, text)
    changed = [text for text in odd if restorer.restored(text) != text]
    assert op3_toxicity.suspicious(op3_toxicity.texts(pa.array(changed))).all()


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity_query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert rows[rows.toxic == 1].predicted.mean() > 0.75  # a part of these labels is noise
    assert rows[rows.toxic == 0].predicted.mean() < 0.01


def test_rare_toxic_words_keep_a_weight():
    features, pick = Features(presence=True), random.Random(2)
    for ones, zeros in ((1000, 1000), (300, 2000)):
        labels = np.array([1] * ones + [0] * zeros)
        plain = [" ".join(pick.choice("abcdefgh") for _ in range(6)) + " filler" for _ in labels]
        told = [f"{text} slur" if i % (ones // 8) == 0 and label else f"{text} insult" if label and i % 2 else text for i, (text, label) in enumerate(zip(plain, labels, strict=True))]
        rows = [features.of(op3_toxicity.texts(pa.array([text])))[1:] for text in told]
        model = fit(features, rows, labels, 0.1, op3_toxicity.SIGNIFICANT)
        with_slur, without = model.margins(op3_toxicity.texts(pa.array(["a b filler slur", "a b filler"])))
        assert with_slur > without + 0.1


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(docs):
    """All pairs that share a window, by brute force."""
    sets = {i: shingles(text) for i, text in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, some in sets.items():
        for window in some:
            where.setdefault(window, []).append(i)
    common = Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in docs}


def near_copies(n, seed=2):
    """Copies of one text at many distances, so that links are there and not there."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(400)}" for _ in range(160)]
    docs = {}
    for i in range(n):
        words = list(base)
        for _ in range(pick.randrange(9)):
            words[pick.randrange(len(words))] = f"x{pick.randrange(9000)}"
        docs[i] = " ".join(words)
    return docs


@pytest.mark.parametrize("few", [4, 128])
def test_near_duplicates_are_all_found(spark, monkeypatch, few):
    monkeypatch.setattr(op4_near_duplicates, "FEW", few)
    docs = texts(SMALL) | {10_000 + i: text for i, text in near_copies(60).items()}
    frame = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING")
    found = {row.doc_id: row.class_id for row in op4_near_duplicates.near_duplicate_classes(frame).collect()}
    assert found == classes(docs)


def test_sizes_exclude_no_link(spark):
    sizes = spark.createDataFrame([(8, 10), (10, 8), (4, 5), (1, 1), (7, 10)], "x LONG, y LONG")
    assert [row[0] for row in sizes.select(op4_near_duplicates._near("x", "y", 0.8)).collect()] == [True] * 4 + [False]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = mix(np.arange(300, dtype=np.uint64) * np.uint64(7919))
    one = rng.integers(1, 20, 300).astype(float)
    two = np.where(rng.random(300) < 0.7, one, rng.integers(1, 20, 300))
    owner = np.repeat([0, 1], 300)
    signatures = op4_near_duplicates.dart_signatures(np.tile(elements, 2), np.append(one, two), owner, 3, 4000)
    assert abs((signatures[0] == signatures[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.03
    assert not signatures[2].any()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 103), (103, 101), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    assert found == {**dict.fromkeys(range(21), 0), 100: 100, 103: 100, 101: 100}


@pytest.mark.parametrize("name", ["op5_token_files", "op10_packing"])
def test_token_ids_of_documents(spark, name):
    file, end = {"op5_token_files": ("word_bpe_49k.json", 1), "op10_packing": ("byte_bpe_50k.json", 2)}[name]
    library = Tokenizer.from_file(public_tokenizers.path(file))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, end], "<u4") for i, t in sorted(texts(SMALL).items())}
    rows = queries.queries()[name](spark, SMALL).collect()
    if name == "op5_token_files":
        at = 0
        found = {row.doc_id: row for row in rows}
        for i, own in ids.items():
            assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
            at += len(own)
    else:
        for row in rows:
            assert zlib.crc32(ids[row.doc_id][row.start : row.start + row.length].tobytes()) == row.ids_crc32
        assert sum(row.length for row in rows) == sum(map(len, ids.values()))
        lengths = np.array([row.length for row in rows])
        assert op10_packing.lower_bound(lengths, 1024) <= len({row.sequence_id for row in rows}) <= 1.01 * lengths.sum() / 1024 + 1


def test_packing_exchanges_between_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(n)) for i, n in enumerate(rng.choice([1, 250, 511, 513, 700], 4000))]
    pieces = spark.createDataFrame(rows, "doc_id LONG, length LONG")
    found = op10_packing.pack(pieces, 1024, group=300).toPandas()
    assert len(found) == 4000 and found.groupby("sequence_id")["length"].sum().max() <= 1024
    alone = op10_packing.best_fit_decreasing(np.array([n for _, n in rows]), 1024)[2]
    assert op10_packing.lower_bound(np.array([n for _, n in rows]), 1024) <= len(alone)
    assert found["sequence_id"].nunique() <= 1.03 * len(alone)


def test_packing_exchanges_until_a_round_saves_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(200, 600, 1500))], "doc_id LONG, length LONG")
    counts, packed = [], op10_packing._packed

    def counted(rows, *bounds):
        made = packed(rows, *bounds)
        open_ones = made.where("NOT _final")
        counts.append((made.select("sequence_id").distinct().count(), open_ones.select("sequence_id").distinct().count()))
        return made

    monkeypatch.setattr(op10_packing, "_packed", counted)
    found = op10_packing.pack(pieces, 1024, group=30).toPandas()
    assert len(found) == 1500 and found.groupby("sequence_id")["length"].sum().max() <= 1024 and found["sequence_id"].min() >= 0
    assert len(counts) > 4
    assert counts[-1][1] == 0 or counts[-1][0] >= counts[-2][1]


def test_bounds_hold_for_best_packings():
    assert op10_packing.lower_bound(np.array([600, 600, 600]), 1024) == 3
    assert op10_packing.lower_bound(np.array([512] * 4), 1024) == 2
    assert op10_packing.lower_bound(np.array([342] * 6), 1024) == 3


def test_secrets_by_plain_search(spark):
    found = {r.doc_id: r for r in queries.op6_secrets_query(spark, MEDIUM).collect()}
    patterns = [(rule, re.compile(rule.pattern)) for rule in op6_secrets.RULES]
    for i, text in texts(MEDIUM).items():
        spans = sorted((m.start(), k, m.end()) for k, (rule, p) in enumerate(patterns) for m in p.finditer(text) if rule.counts(m))
        write = lambda some: ",".join(f"{op6_secrets.RULES[k].kind}:{a}:{b}" for a, k, b in some)
        assert found[i].spans == write(spans)
        assert found[i].base_sha256 == hashlib.sha256(write([s for s in spans if s[1] < 3]).encode()).hexdigest()


def test_trigram_queries():
    query = op6_secrets.trigram_query
    assert query("[0-9a-f]+") is None and query("ab|xyz") is None
    assert query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert query("(abcd|efg)x") == {frozenset({"abc", "bcd", "cdx"}), frozenset({"efg", "fgx"})}
    assert query("ab?cd") == {frozenset({"abc", "bcd"}), frozenset({"acd"})}


def test_quality_counts(spark):
    found = {r.doc_id: r for r in queries.op7_quality_query(spark, SMALL).collect()}
    for i, text in texts(SMALL).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        triples = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        often = Counter(triples)
        covered = {k for j, t in enumerate(triples) if often[t] > 1 for k in (j, j + 1, j + 2)}
        row = found[i]
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_agrees_with_labels(spark):
    rows = queries.op7_quality_query(spark, MEDIUM).withColumnRenamed("quality", "chance").join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    assert (rows.kept == (rows.quality == 1)).mean() > 0.97


def test_neighbours_recall(spark):
    table = pq.read_table(f"{MEDIUM}/embeddings.parquet").to_pandas().sort_values("vec_id", ignore_index=True)
    vectors = np.stack(table["embedding"]).astype(float)
    rows = queries.op8_neighbours_query(spark, MEDIUM).toPandas()
    hits = 0
    for query, own in rows.groupby("query_id"):
        scores = vectors @ vectors[query]
        scores[query] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(scores)), -scores))[:20]) & set(own["vec_id"]))
        assert own.sort_values("rank")["rank"].tolist() == list(range(1, 21))
    assert hits >= 0.9 * len(rows)


def test_rendezvous_moves_rows_only_into_the_new_shard(spark):
    rows = queries.op9_sharding_query(spark, MEDIUM).collect()
    assert {row.grown_shard for row in rows if row.grown_shard != row.shard} == {24}
    assert 10 < sum(row.grown_shard != row.shard for row in rows) < 90


def test_sharding_in_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    wanted = connection.sql(queries.oracle_sql()["op9_sharding"]).df()[columns].sort_values("doc_id")
    found = queries.op9_sharding_query(spark, SMALL).toPandas()[columns].sort_values("doc_id")
    assert found.values.tolist() == wanted.values.tolist()


def test_weighted_shards(spark):
    rows = op9_sharding.with_shard(spark.range(20_000).select(F.col("id").alias("doc_id")), [1.0, 3.0]).groupBy("shard").count().collect()
    share = {row["shard"]: row["count"] / 20_000 for row in rows}
    assert abs(share[1] - 0.75) < 0.02
    with pytest.raises(ValueError):
        op9_sharding.costs(F.lit("k"), [1.0, 0.0])
