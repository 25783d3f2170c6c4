"""Writers: sorted line JSON, bulk export, generation export, idempotent append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = (
    "id", "kind", "airport_lid", "state", "title", "source_url", "completeness", "content_sha256",
)


def write_sorted_jsonl(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Line JSON in key order: a range sort, so files are ordered and parallel."""
    df.orderBy(*keys).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def bulk_rows(documents: DataFrame, listed: Column) -> DataFrame:
    """Listed documents in the eight export columns, nulls as empty text."""
    return documents.filter(listed).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT_COLUMNS]
    )


def write_bulk(documents: DataFrame, listed: Column, path: str) -> None:
    bulk_rows(documents, listed).orderBy("id").write.mode("overwrite").option("header", "true").csv(
        f"{path}/csv"
    )
    documents.filter(listed).orderBy("id").write.mode("overwrite").json(f"{path}/json")


def generation_manifest(entities: DataFrame) -> DataFrame:
    """One row per generation and entity type: rows and a digest of the payloads."""
    return entities.groupBy("generation_id", "entity_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("entity_key", "payload_sha256")).alias("digest"),
    )


def write_generation(entities: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").partitionBy("generation_id", "entity_type").json(f"{path}/rows")
    generation_manifest(entities).write.mode("overwrite").json(f"{path}/manifest")


def new_events(events: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Events whose key is not on file yet; the first of a repeated key is kept."""
    fresh = events.join(known.select(key).distinct(), key, "left_anti")
    keyed, free = fresh.filter(F.col(key).isNotNull()), fresh.filter(F.col(key).isNull())
    rest = [c for c in events.columns if c != key]
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("at")).alias("_row"))
    return first.select(key, "_row.*").unionByName(free.select(key, *rest))


def append_events(events: DataFrame, path: str, key: str) -> None:
    """Append only what is new, so a repeated run adds nothing."""
    spark = events.sparkSession
    known = spark.read.schema(events.schema).parquet(path)
    new_events(events, known, key).write.mode("append").parquet(path)
