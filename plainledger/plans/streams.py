"""Streaming jobs over the event, page and conversation tables, run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from plainledger.functions import html
from plainledger.operators import ops as audit
from plainledger.plans import bindings as b
from plainledger.plans import documents as document_plans
from plainledger.plans import ops as batch
from plainledger.plans import web
from plainledger.rules import ops as rules
from plainledger.session import run_dir
from plainledger.streaming import jobs


def event_stream(spark, folder, pattern="events.parquet", schema=None):
    rows = jobs.read_stream(spark, folder, pattern, schema or b.table(spark, folder, "events").schema)
    kind = F.col("event_type")
    job = (F.when(kind == "view", "explore").when(kind == "click", "fetch").when(kind == "purchase", "vet")
           .when(kind == "signup", "discovery").otherwise("check"))
    outcome = F.when(kind == "error", "dead").when(kind == "purchase", "preserved").when(kind == "signup", "live").when(kind == "click", "pending")
    return rows.select(
        F.col("user_id").alias("entity"), job.alias("kind"), F.when(F.col("value") < 8, "dead").otherwise("ok").alias("status"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("provider"), outcome.alias("job_status"))


FILES = 6


def in_files(spark, sf):
    """The event log as files of equal stretches of time, written one after the other, one for each micro-batch."""
    folder, log = run_dir(spark, "log"), b.table(spark, sf, "events")
    low, high = log.agg(F.min("ts"), F.max("ts")).first()
    for i in range(FILES):
        start, end = (low + (high - low) * k / FILES for k in (i, i + 1))
        last = F.lit(True) if i == FILES - 1 else F.col("ts") < F.lit(end)
        log.filter((F.col("ts") >= F.lit(start)) & last).write.mode("append").parquet(folder)
    return folder


def event_batches(spark, sf):
    return event_stream(spark, in_files(spark, sf), "*.parquet", b.table(spark, sf, "events").schema)


def stream_first_events(spark, sf):
    path = run_dir(spark, "first")
    keyed = event_batches(spark, sf).withColumn("event_key", F.concat_ws(":", "entity", "provider"))
    jobs.first_events(keyed.select("event_key", "entity", "provider", "at"), path, ["event_key"], "at")
    return jobs.read_rows(spark, path).select("event_key", "entity", "provider", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def stream_event_state(spark, sf):
    path = run_dir(spark, "state")
    jobs.run_batches(jobs.entity_state(event_stream(spark, sf)), path, "update")
    out = jobs.latest_rows(spark, path, ["entity"])
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last_job_at", "explored_at", "snapshot_at", "vetted_at", "discovery_at")]
    return out.select("entity", "last_job_kind", "last_job_status", *shown)


def stream_quota(spark, sf):
    path = run_dir(spark, "quota")
    caps = audit.provider_table(spark, (
        rules.Provider("click", 5.0, 0.0, 5.0), rules.Provider("view", 5.0, 5.0, 5.0), rules.Provider("purchase", 1.0, 0.0, 5.0, free=100, per_prompt=4.0)))
    jobs.run_batches(jobs.monthly_quota(event_batches(spark, sf), caps), path, "update")
    return jobs.latest_rows(spark, path, ["provider", "month"])


def stream_daily_buckets(spark, sf):
    """Outcome buckets per day; days the watermark has not passed stay open."""
    path = run_dir(spark, "daily")
    rows = jobs.bucketed(event_stream(spark, sf), "job_status", F.lit(None).cast("string"))
    jobs.run_batches(jobs.daily_counts(rows, "at", "bucket", "36 hours"), path, "append")
    return jobs.read_rows(spark, path).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "bucket", "n")


def stream_retention(spark, sf):
    path = run_dir(spark, "retention")
    rows = event_batches(spark, sf).select(F.concat_ws("-", "entity", "provider").alias("key"), "at", "kind")
    jobs.retention(rows, path, "key", "at", 20)
    kept = audit.live_rows(jobs.read_rows(spark, path), "expires_at", F.lit(batch.NOW).cast("timestamp"))
    return kept.select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "kind",
                       F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


def stream_stage_changes(spark, sf):
    path = run_dir(spark, "stages")
    jobs.stage_changes(event_batches(spark, sf).select("entity", "kind", "status", "at", "seq"), path)
    return jobs.read_rows(spark, path).select("entity", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "seq", "previous", "stage")


def stream_page_candidates(spark, sf):
    path = run_dir(spark, "pages")
    schema = b.table(spark, sf, "pages").schema
    raw = jobs.read_stream(spark, sf, "pages.parquet", schema)
    jobs.page_candidates(web.rewritten(raw), path, web.PAGE_RULES, bare_names=False)
    return jobs.read_rows(spark, path).select("page_id", "url", "media", "role", "kind", "confirm")


def stream_document_changes(spark, sf):
    """Turns arrive as versions; the table of current ones holds the turn before."""
    path = run_dir(spark, "changes")
    schema = b.table(spark, sf, "conversations").schema

    def versions(rows, shift):
        return rows.select(
            F.concat_ws("-", F.col("conv_id"), F.col("turn") + shift).alias("id"), F.sha2("text", 256).alias("content_sha256"),
            html.text_hash("text").alias("text_sha256"), F.sha2("role", 256).alias("images_sha256"))

    current = versions(b.table(spark, sf, "conversations"), 1)
    arriving = versions(jobs.read_stream(spark, sf, "conversations.parquet", schema), 0)
    jobs.document_changes(arriving, path, current)
    return jobs.read_rows(spark, path).drop(jobs.BATCH)


QUERIES = {f.__name__: f for f in (
    stream_first_events, stream_event_state, stream_quota, stream_daily_buckets, stream_retention,
    stream_stage_changes, stream_page_candidates, stream_document_changes,
)}

ORACLE = {
    "stream_first_events": f"SELECT user_id || ':' || event_type AS event_key, user_id AS entity, event_type AS provider, {batch.TS.format('min(ts)')} AS \"at\" FROM events GROUP BY ALL",
    "stream_event_state": batch.ORACLE["status_latest"],
    "stream_quota": """SELECT event_type AS provider, strftime(ts, '%Y-%m') AS month, count(*) AS asked, CAST(max(cap) AS BIGINT) AS cap, count(*) >= max(cap) AS exhausted
FROM events JOIN (VALUES ('click', 1000), ('view', 2000), ('purchase', 150)) x(provider, cap) ON provider = event_type GROUP BY 1, 2""",
    "stream_daily_buckets": """WITH e AS (SELECT CAST(ts AS DATE) AS d, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'accepted' ELSE 'uncertain' END AS bucket FROM events)
SELECT CAST(d AS VARCHAR) AS day, bucket, count(*) AS n FROM e WHERE d + 1 <= (SELECT max(ts) - INTERVAL 36 HOUR FROM events) GROUP BY ALL""",
    "stream_retention": batch.retention_sql("""CASE event_type WHEN 'view' THEN 'explore' WHEN 'click' THEN 'fetch' WHEN 'purchase' THEN 'vet'
  WHEN 'signup' THEN 'discovery' ELSE 'check' END""", "kind"),
    "stream_stage_changes": batch.ORACLE["stage_changes"],
    "stream_page_candidates": web.ORACLE["page_link_roles"],
    "stream_document_changes": document_plans.ORACLE["document_changes"],
}
