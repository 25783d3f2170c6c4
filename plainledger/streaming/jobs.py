"""Structured Streaming jobs over append-only logs, and the tables they keep.

Every job writes into the shared folder. A micro-batch goes to a folder of its own
that a rerun overwrites, so a batch that is replayed after a lost executor or driver
leaves the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainledger.operators import documents as doc
from plainledger.operators import ops
from plainledger.operators import web
from plainledger.rules import ops as rules
from plainledger.rules.web import LinkRules
from plainledger.streaming.state import KeyTable, on_keys

BATCH = "batch_id"


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str,
                files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder whose names fit a pattern, and the files of subfolders that fit it.

    A table may be one file or a folder of parts. The pattern is part of the path, in
    braces so that a plain name counts as a pattern as well.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{{{pattern}}}")


def run_batches(stream: DataFrame, path: str, mode: str,
                make: Callable[[DataFrame, int], DataFrame] | None = None,
                after: Callable[[DataFrame, int], None] | None = None) -> list[dict]:
    """Drain the source once; each micro-batch is written to its own folder.

    `after` gets the rows a batch wrote, to keep its state. Returns the progress of
    the batches.
    """
    def write(rows: DataFrame, batch: int) -> None:
        out = rows if make is None else make(rows, batch)
        folder = f"{path}/rows/{BATCH}={batch}"
        out.write.mode("overwrite").parquet(folder)
        if after is not None:
            after(out.sparkSession.read.schema(out.schema).parquet(folder), batch)

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    return [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def read_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(
        T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())]))
    return reader.parquet(f"{path}/rows")


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Last row per key over all batches of an update-mode job."""
    rows = read_rows(spark, path)
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row")).select(*keys, "_row.*")


# --- stateful plans ----------------------------------------------------------------

def entity_state(stream: DataFrame) -> DataFrame:
    """Last job and touch times per entity, kept up to date (update mode)."""
    return ops.latest_status(stream)


def monthly_quota(stream: DataFrame, caps: DataFrame, late_hours: int = 36) -> DataFrame:
    """Charges per provider and calendar month with the crossing of the cap (update mode).

    A month's counters are kept until events of the month after the next one show that
    its end lies more than a month and `late_hours` back; charges that come later are
    dropped, and a provider has at most three months of state.
    """
    ends = (F.date_trunc("month", "at") + F.expr("interval 1 month") - F.expr("interval 1 microsecond")).alias("month_ends")
    keyed = stream.select("provider", ends).withWatermark("month_ends", f"{31 * 24 + late_hours} hours")
    counted = keyed.join(caps, "provider").groupBy("provider", "month_ends").agg(
        F.count(F.lit(1)).alias("asked"), F.max("cap").alias("cap"))
    return counted.select(
        "provider", F.date_format("month_ends", "yyyy-MM").alias("month"), "asked", "cap",
        (F.col("asked") >= F.col("cap")).alias("exhausted"))


def daily_counts(stream: DataFrame, at: str, column: str, delay: str) -> DataFrame:
    """Counts per day and value; a day is final once the watermark has passed it."""
    return (
        stream.withWatermark(at, delay).groupBy(F.window(at, "1 day"), column)
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), column, "n"))


# --- jobs on top of a growing table ---------------------------------------------------

def first_events(stream: DataFrame, path: str, keys: Sequence[str], at: str, **state: int) -> list[dict]:
    """The first event of every key: earliest in its batch, and only if no earlier batch held the key.

    A null key is a key. A batch reads the state of its own keys' buckets only; `state`
    sets the buckets and how often they are merged.
    """
    keys, schema = list(keys), stream.schema
    rest = [c for c in schema.names if c not in (*keys, at)]
    known = KeyTable(stream.sparkSession, f"{path}/keys", schema_of(schema, keys), keys, **state)

    def make(rows: DataFrame, batch: int) -> DataFrame:
        first = rows.groupBy(*keys).agg(F.min(F.struct(at, *rest)).alias("_row")).select(*keys, "_row.*")
        return on_keys(first, known.before(batch, known.touched(rows)), keys, "left_anti").select(*schema.names)

    return run_batches(stream, path, "append", make, lambda rows, batch: known.save(batch, rows.select(*keys)))


def schema_of(schema: T.StructType, columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, schema[c].dataType) for c in columns])


def retention(stream: DataFrame, path: str, key: str, at: str, days: int = rules.RETENTION_DAYS, **state: int) -> list[dict]:
    """Keep the first sight of every life of a key with its expiry; repeats change nothing.

    The state is the end of each key's last life; a batch reads that of its own keys'
    buckets.
    """
    expiry = T.StructField("expires_at", stream.schema[at].dataType)
    schema = T.StructType([*stream.schema.fields, expiry])
    ends = KeyTable(stream.sparkSession, f"{path}/ends", T.StructType([*schema_of(schema, [key]).fields, expiry]), [key], **state)

    def make(rows: DataFrame, batch: int) -> DataFrame:
        known = ends.before(batch, ends.touched(rows)).withColumnRenamed("expires_at", "_ends")
        fresh = on_keys(rows, known, [key], "left").filter(F.col("_ends").isNull() | (F.col(at) >= F.col("_ends"))).drop("_ends")
        return ops.first_seen_retention(fresh, key, at, days).select(*schema.names)

    def keep(rows: DataFrame, batch: int) -> None:
        ends.save(batch, rows.groupBy(key).agg(F.max("expires_at").alias("expires_at")))

    return run_batches(stream, path, "append", make, keep)


def stage_changes(stream: DataFrame, path: str, **state: int) -> list[dict]:
    """A row whenever an entity's stage changes, from the touches of its log.

    Events: entity, kind, status, at, seq. The state holds each entity's touches and its
    stage; batches count as one after the other in time.
    """
    schema = T.StructType.fromDDL(", ".join(
        ["entity " + stream.schema["entity"].dataType.simpleString(), *[f"{c} boolean" for c in ops.STAGE_TOUCHES], "stage string"]))
    held = KeyTable(stream.sparkSession, f"{path}/stages", schema, ["entity"], **state)

    def sink(rows: DataFrame, batch: int) -> None:
        known = held.before(batch, held.touched(rows))
        ops.stage_changes(rows, known).write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={batch}")
        held.save(batch, ops.stage_state(rows, known))

    query = (
        stream.writeStream.option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).foreachBatch(sink).start())
    query.awaitTermination()
    return [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def page_candidates(stream: DataFrame, path: str, pack: LinkRules, bare_names: bool = True, **state: int) -> list[dict]:
    """Links of arriving pages with their role, each page and URL once."""
    schema = T.StructType.fromDDL("page_id long, url string, label string, media string, role string, kind string, confirm boolean")
    keys = ["page_id", "url"]
    known = KeyTable(stream.sparkSession, f"{path}/keys", schema_of(schema, keys), keys, **state)

    def make(rows: DataFrame, batch: int) -> DataFrame:
        links = web.classified_links(web.page_links(rows, "page_id", "url", "html", bare_names), pack)
        out = links.withColumn("confirm", web.worth_confirm("role", "kind", "label", pack)).select(*schema.names)
        return on_keys(out, known.before(batch, known.touched(out)), keys, "left_anti")

    return run_batches(stream, path, "append", make, lambda rows, batch: known.save(batch, rows.select(*keys).distinct()))


def document_changes(stream: DataFrame, path: str, current: DataFrame) -> None:
    """Change events of arriving versions against the table of current ones."""
    run_batches(stream, path, "append", lambda rows, batch: doc.change_events(current, rows))


def bucketed(stream: DataFrame, job: Column | str, review: Column | str) -> DataFrame:
    return stream.withColumn("bucket", ops.outcome_bucket(job, review))
