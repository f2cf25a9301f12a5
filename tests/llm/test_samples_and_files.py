"""Language samples, and token files of several parts."""

import random

import numpy as np
import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modcensus.llm import op1_language, op5_token_files, queries
from modcensus.llm.common import fold, fresh_folder
from tests.llm.conftest import SMALL


def sentence(words: str, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(words.split()) for _ in range(80))


def test_copies_do_not_crowd_out_a_language(spark):
    english, german = "the of and to in that was he for it with as his on be", "der die und in den von zu das mit sich des auf für ist im"
    rows = [(i, "en", sentence(english, i % 3)) for i in range(3000)] + [(9000 + i, "de", sentence(german, i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id LONG, lang STRING, text STRING")
    learned = op1_language.learn(docs, F.lit(True))
    assert [lang for lang, _ in learned] == ["de", "en"]
    found = op1_language.identified(docs, learned, ["lang"]).groupBy("lang", "lang_pred").count().collect()
    assert sorted((row.lang, row.lang_pred) for row in found) == [("de", "de"), ("en", "en")]


def test_numbers_are_no_letters():
    dictionaries = (("xx", b"some letters of a language"),)
    for text in ("²", "½ ①", "12 ٣", "_", ""):
        assert op1_language.classify(text, dictionaries) == (op1_language.UNKNOWN, 0.0)
    assert op1_language.classify("é", dictionaries)[0] == "xx"


def test_many_languages_share_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(op1_language, "DICTIONARIES", 250 * 2 * 400)
    monkeypatch.setattr(op1_language, "LANGUAGES", 2)
    rows = [("aa", "a word " * 500), ("aa", "more words " * 500), ("bb", "other ones " * 500), ("bb", "still others " * 500), ("cc", "rare " * 500)]
    learned = dict(op1_language.learn(spark.createDataFrame(rows, "lang STRING, text STRING"), F.lit(True)))
    assert set(learned) == {"aa", "bb"} and all(len(content) <= 2 * 400 for content in learned.values())


def test_languages_equal_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    learned = op1_language.learn(docs, fold(F.col("doc_id"), 5) != 0)
    longest = max(len(content) for _, content in learned)
    bits = longest.bit_length()
    chosen = zstandard.ZstdCompressionParameters.from_level(3, dict_size=longest, source_size=1000, hash_log=bits - 2, chain_log=bits - 2, window_log=bits + 1, write_content_size=False, write_dict_id=False)
    text = {row.doc_id: row.text for row in docs.collect()}
    wanted = {}
    for doc, whole in text.items():
        plain = " ".join("".join(c if c.isalpha() else " " for c in (whole or "").lower()).split())
        sizes = {}
        for lang, content in learned:
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            compressor = zstandard.ZstdCompressor(compression_params=chosen, dict_data=raw)
            sizes[lang] = sum(len(compressor.compress(plain[i : i + 1000].encode())) for i in range(0, len(plain), 1000))
        best = min(sizes, key=lambda lang: (sizes[lang], lang))
        second = min(size for lang, size in sizes.items() if lang != best)
        wanted[doc] = (best, round(1 - sizes[best] / second, 9)) if plain else ("und", 0.0)
    found = {row.doc_id: (row.lang_pred, round(row.score, 9)) for row in queries.op1_language_query(spark, SMALL).collect()}
    assert found == wanted


def test_several_parts_are_read_in_as_many_tasks(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(7, "one row many times")], "doc_id LONG, text STRING").crossJoin(spark.range(100)).select("doc_id", "text"))
    manifest = op5_token_files.write_token_files(docs, path, 1, fresh_folder(spark, "several"), parts=6)
    parts = sorted(manifest.collect(), key=lambda row: row.part)
    assert len(parts) > 3
    assert [row.base for row in parts] == [0, *np.cumsum([row.ids for row in parts])[:-1]]
    read = op5_token_files.read_token_files(manifest)
    assert read.rdd.getNumPartitions() == len(parts)
    rows = sorted(read.collect(), key=lambda row: row.start)
    assert [row.key for row in rows] == sorted(row.doc_id for row in docs.collect())
    assert [row.start for row in rows] == [0, *np.cumsum([row.n_tokens for row in rows])[:-1]]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    wanted = sorted((row.doc_id, tuple([*library.encode(row.text or "", add_special_tokens=False).ids, 1])) for row in docs.collect())
    assert sorted((row.key, tuple(np.frombuffer(row.ids, "<u4").tolist())) for row in rows) == wanted
