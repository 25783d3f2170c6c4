"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainledger.llm import (
    archive,
    contamination,
    mixing,
    periodic,
    phrases,
    quality,
    sharding,
    simhash,
    substring,
    suffixes,
    tokens,
    toxicity,
    urlfilter,
)
from plainledger.llm.common import table

SHARDS = 24
END_ID = 2
URL_RULES = [
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, table(spark, sf, "labels"))
    return mixed.select("doc_id", "n_tokens", "posterior", "domain", "rate", "copies")


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op3_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_files(table(spark, sf, "documents"), vocabulary(), END_ID)


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_substring(spark: SparkSession, sf: str) -> DataFrame:
    return substring.parse(table(spark, sf, "documents")).drop("spans")


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return sharding.shard(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return archive.archive_round_trip(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op12_periods(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.find_runs(periodic.with_periods(table(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # Greatest length, then smallest start and period; null without runs.
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("under"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("_top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"),
        (-F.col("_top.under")).alias("length"), F.col("_top.period").alias("period"),
        F.floor(-1000 * F.col("_top.under") / F.col("_top.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf, "documents")).drop("spans")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_tokens": op3_tokens,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_substring": op6_substring,
    "op7_sharding": op7_sharding,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_phrases": op11_phrases,
    "op12_periods": op12_periods,
    "op13_suffixes": op13_suffixes,
}

ORACLE: dict[str, str] = {}
