"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modcensus.llm import (
    op1_language,
    op2_sentencepiece,
    op3_toxicity,
    op4_near_duplicates,
    op5_token_files,
    op6_secrets,
    op7_quality,
    op8_neighbours,
    op9_sharding,
    op10_packing,
    op11_token_counts,
    op12_conversations,
    op13_spellings,
    sql,
)
from modcensus.llm.common import fold, table

SHARDS = 24
TOKEN_LIMIT = 512
WORD_LETTERS = 7


def op1_language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 5)
    rows = op1_language.identified(docs, op1_language.learn(docs, part != 0), ["doc_id"])
    return rows.select("doc_id", (part == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    parts = op2_sentencepiece.encoded(table(spark, sf_dir, "documents"), model)
    rows = op2_sentencepiece.whole_documents(*(op2_sentencepiece.decoded(part, model) for part in parts))
    return rows.select(
        "doc_id",
        "chunks",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"),
    )


def op3_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 3)
    characters = op3_toxicity.character_model(docs)
    model = op3_toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"), part != 1, characters)
    rows = op3_toxicity.scored(docs, model, characters, ["doc_id"])
    return rows.select("doc_id", (part == 1).alias("held_out"), "score", "predicted")


def op4_near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op4_near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id", "kept")


def op5_token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = op5_token_files.write_and_read(spark, table(spark, sf_dir, "documents"), tokenizer, 1)
    return rows.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op6_secrets.found_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.withColumn("base_sha256", F.sha2(F.col("base_spans").cast("binary"), 256)).drop("base_spans")


def op7_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op7_quality.quality_model(docs, table(spark, sf_dir, "labels"))
    return op7_quality.judged(docs, model, ["doc_id"])


def op8_neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op9_sharding.shard_slots(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return op10_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer)


def op11_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = op11_token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer, ["doc_id"])
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def damaged_conversations(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by a hash of conversation and turn."""
    name, turn = (F.coalesce(F.col(column).cast("string"), F.lit(" ")) for column in ("conv_id", "turn"))
    damage = F.crc32(F.concat(name, F.lit(":"), turn).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), damage.alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("damage") == 3, 2).otherwise(1)
    rows = rows.where("damage != 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op12_conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = op12_conversations.repair_report(damaged_conversations(conversations)).withColumnRenamed("conv_id", "_conv_id_")
    named = conversations.select("conv_id").distinct()
    rows = named.join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id_")), "left")
    counts = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in (*op12_conversations.COUNTERS, "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def misspelt_words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, some with a letter left out, by a hash of document and run."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\u00C0-\u00FF]{{{WORD_LETTERS},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    runs = runs.withColumn("hash", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("hash") % F.length("run")).cast("int")
    less = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("hash") % 31 == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= WORD_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def op13_spellings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_spellings.spelling_forms(misspelt_words(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language_query,
        "op2_sentencepiece": op2_sentencepiece_query,
        "op3_toxicity": op3_toxicity_query,
        "op4_near_duplicates": op4_near_duplicates_query,
        "op5_token_files": op5_token_files_query,
        "op6_secrets": op6_secrets_query,
        "op7_quality": op7_quality_query,
        "op8_neighbours": op8_neighbours_query,
        "op9_sharding": op9_sharding_query,
        "op10_packing": op10_packing_query,
        "op11_token_counts": op11_token_counts_query,
        "op12_conversations": op12_conversations_query,
        "op13_spellings": op13_spellings_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_sharding": sql.sharding(SHARDS), "op12_conversations": sql.conversations(), "op13_spellings": sql.spellings(WORD_LETTERS)}
