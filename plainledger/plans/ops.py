"""Audit and status queries over events, orders, customers and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plainledger.functions import values as v
from plainledger.operators import documents as doc
from plainledger.operators import funding
from plainledger.operators import ops
from plainledger.plans import bindings as b
from plainledger.plans.bindings import DOCS_SQL, GRANTS_SQL
from plainledger.rules import ops as rules

NOW = "2024-01-25 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def events(spark, sf):
    kind = F.col("event_type")
    job = F.when(kind == "error", "dead").when(kind == "purchase", "preserved").when(kind == "signup", "live").when(kind == "click", "pending")
    review = F.when(F.col("value") > 100, "published").when(F.col("value") > 50, "needs_human").when(F.col("value") > 40, "pending")
    return b.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("at"), F.col("user_id").alias("entity"), "event_type", "value",
        job.alias("job_status"), review.alias("review_status"), "props")


def bucketed(spark, sf):
    scores = {"confirm_score": F.col("value") / 10, "publish_score": F.col("value") / 5, "explore_score": F.lit(9.0)}
    return events(spark, sf).withColumn("bucket", ops.outcome_bucket("job_status", "review_status", scores))


def outcome_buckets(spark, sf):
    return bucketed(spark, sf).select("event_id", "bucket")


def outcome_stats(spark, sf):
    return ops.outcome_stats(bucketed(spark, sf), F.col("event_type") == "view")


def outcome_last(spark, sf):
    return ops.last_per_bucket(bucketed(spark, sf), "bucket", "event_id", rules.TRAINING_LIMITS).select("event_id", "bucket", "pos")


def outcome_recent(spark, sf):
    return ops.recent(bucketed(spark, sf), "event_id", 200, F.col("bucket") == "failed").select("event_id", "at", "entity")


def classification_recent(spark, sf):
    """The last classifications, with what they say."""
    return ops.recent(classified(spark, sf), "event_id", rules.RECENT_CLASSIFICATIONS).select(
        "event_id", "evaluation", "category", "classifier")


def review_documents(spark, sf):
    """Pending documents, more asked for than are ever shown."""
    return ops.review_list(b.documents(spark, sf).drop("text"), "pending", 5000).select("id", "kind", "n")


def outcome_compact(spark, sf):
    rows = bucketed(spark, sf).select(
        F.col("event_id").alias("id"), "bucket", "job_status", F.coalesce("review_status", F.lit("")).alias("review_status"),
        F.col("props").alias("text"), F.struct(F.lit(True).alias("confirm"), F.lit("x").alias("noise")).alias("gold"))
    return ops.compact(rows, rules.OUTCOME_COLUMNS, "gold", ["confirm"]).select("id", "compact")


def reject_compact(spark, sf):
    """Events as rejected files: blank fields, a zero size and a body that may not be shown."""
    rows = events(spark, sf).select(
        "event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.sha2("props", 256).alias("sha256"),
        F.when(F.col("value") > 20, ".pdf").otherwise("").alias("suffix"),
        F.when(F.col("event_type") == "view", 0).otherwise(F.col("entity")).alias("bytes"),
        (F.col("value") > 50).alias("stored"), F.col("job_status").alias("reason"), F.col("props").alias("body"),
        F.col("props").alias("excerpt"), F.when(F.col("event_type") == "error", 404).alias("http_status"))
    return ops.compact(rows, rules.REJECT_COLUMNS).select("event_id", "compact")


def classified(spark, sf):
    return events(spark, sf).select(
        "event_id", "at", F.col("event_type").alias("evaluation"), F.when(F.col("value") > 10, "high").otherwise("low").alias("category"),
        F.when(F.col("value") > 30, "llm").otherwise("rules").alias("classifier"))


def classification_stats(spark, sf):
    return ops.classification_stats(classified(spark, sf), "2024-01")


def audit_log(spark, sf):
    rows = events(spark, sf)
    a = rows.filter("event_type = 'view'").select("at", "event_id", F.lit("a").alias("log"))
    c = rows.filter("event_type <> 'view'").select("at", "event_id", F.lit("c").alias("log"), "value")
    return ops.as_of(ops.merged_log(a, c), "at", now())


def retention_live(spark, sf):
    rows = events(spark, sf).select(F.concat_ws("-", "entity", "event_type").alias("key"), "at", "event_type")
    kept = ops.first_seen_retention(rows, "key", "at", 20)
    return ops.live_rows(kept, "expires_at", now()).select(
        "key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type",
        F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


def status_events(spark, sf):
    kind = F.col("event_type")
    job = (F.when(kind == "view", "explore").when(kind == "click", "fetch").when(kind == "purchase", "vet")
           .when(kind == "signup", "discovery").otherwise("check"))
    return events(spark, sf).select(
        "entity", job.alias("kind"), F.when(F.col("value") < 8, "dead").otherwise("ok").alias("status"), "at", F.col("event_id").alias("seq"))


def status_latest(spark, sf):
    out = ops.latest_status(status_events(spark, sf))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last_job_at", "explored_at", "snapshot_at", "vetted_at", "discovery_at")]
    return out.select("entity", "last_job_kind", "last_job_status", *shown)


def stage_changes(spark, sf):
    out = ops.stage_changes(status_events(spark, sf))
    return out.select("entity", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "seq", "previous", "stage")


def numbered_docs(spark, sf):
    return b.documents(spark, sf).drop("text").withColumn("entity", F.col("id"))


def sparse_status(spark, sf):
    """All touches, spread over every seventh entity, so touched and untouched ones occur."""
    return ops.latest_status(status_events(spark, sf).withColumn("entity", F.col("entity") * 7))


def staged(spark, sf):
    return ops.coverage_stages(b.entities(spark, sf), numbered_docs(spark, sf), sparse_status(spark, sf))


def coverage_stages(spark, sf):
    out = staged(spark, sf)
    return out.select("entity", "stage", ops.stage_banner("stage", "last_job_at").alias("banner"),
                      ops.panel_text("stage", F.lit("master_plan"), F.col("entity") < 500).alias("panel"))


def coverage_counts(spark, sf):
    return ops.stage_counts(staged(spark, sf))


def work_ranking(spark, sf):
    docs = numbered_docs(spark, sf)
    entities = b.entities(spark, sf).withColumn("in_registry", F.col("balance") > 3000)
    funded = funding.funded_total(b.grants(spark, sf, outlays=False), rules.FUNDED_LEVELS)
    published = doc.entities_with_verified_plans(entities.select("key"), docs)
    return ops.ranked_work(entities, funded, sparse_status(spark, sf), published, now(), 10)


def jobs(spark, sf):
    status = F.col("o_orderstatus")
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("entity"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") + 1).alias("parent_id"),
        F.when(status == "P", "pending").when(status == "F", "succeeded").otherwise("active").alias("state"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 2000).alias("priority"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderkey").alias("seq"))


def jobs_next(spark, sf):
    busy = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"))
    at = F.lit("2001-09-01 00:00:00").cast("timestamp")
    return ops.next_jobs(jobs(spark, sf), at, 50, busy).select("id", "entity", "aged")


def jobs_per_entity(spark, sf):
    return ops.next_per_entity(jobs(spark, sf).filter("state = 'pending'").select("entity", "id", "seq"), "seq", 100)


def job_batches(spark, sf):
    return ops.batches(b.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 400)


def job_rotation(spark, sf):
    return ops.rotating_slice(b.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 14990, 25)


def quota_meter(spark, sf):
    caps = ops.provider_table(spark, (
        rules.Provider("click", 5.0, 0.0, 5.0), rules.Provider("view", 5.0, 5.0, 5.0), rules.Provider("purchase", 1.0, 0.0, 5.0, free=100, per_prompt=4.0)))
    charges = events(spark, sf).select(F.col("event_type").alias("provider"), "at")
    meter = ops.quota_meter(charges, caps)
    reported = charges.filter("provider <> 'view'").groupBy("provider", F.date_format("at", "yyyy-MM").alias("month")).agg(
        (F.count(F.lit(1)) - 7).alias("used"))
    return ops.quota_drift(meter, reported).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


def quota_rate_limits(spark, sf):
    """Headers built from each order's own numbers; some lists do not align."""
    key = F.col("o_orderkey")
    rows = b.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("1;w=1, "), key + 15000, F.lit(";w=2592000")).alias("policy"),
        F.concat(F.lit("1, "), key + 15000).alias("limits"),
        F.when(F.col("o_orderstatus") == "P", "1").otherwise(F.concat(F.lit("1, "), F.col("o_custkey"))).alias("remaining"),
        F.when(F.col("o_orderstatus") == "F", F.lit("1, 1419704")).alias("reset"))
    return rows.withColumn("w", ops.rate_limit("policy", "limits", "remaining", "reset")).select(
        "o_orderkey", "w.limit", "w.remaining", "w.used", F.col("w.reset").alias("reset_seconds"))


def datasets(spark, sf):
    """Nations as datasets, each depending on its region's first one."""
    kind = F.col("n_nationkey")
    return b.table(spark, sf, "nation").select(
        F.col("n_name").alias("name"),
        F.when(kind > F.col("n_regionkey"), F.array(F.concat(F.lit("NATION_"), "n_regionkey"))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        F.when(kind == 3, "failed").when(kind == 8, "building").when(kind == 9, "stale").when(kind == 11, "missing").otherwise("ready").alias("status"),
        (kind != 12).alias("available"), F.when(kind == 14, False).alias("healthy"), F.when(kind == 3, "disk").alias("error"))


def dataset_readiness(spark, sf):
    """Datasets that customers, as jobs, ask for."""
    wanted = b.entities(spark, sf).select(
        F.col("key").alias("job"), F.array(F.concat(F.lit("NATION_"), "region"), F.when(F.col("balance") < 500, "NATION_9").otherwise("NATION_0")).alias("requires"))
    return ops.readiness(wanted, datasets(spark, sf), allow_stale=False)


def link_checks(spark, sf):
    """Link checks of the documents: codes and final URLs follow from their length."""
    docs = b.documents(spark, sf).drop("text").withColumn(
        "mirrors", F.when(F.col("kind") == "alp", F.array("source_url")).otherwise(F.array(F.lit("http://m.example.org/a"))))
    n = F.col("n_text")
    code = F.when(n < 600, 404).when(n < 900, 500).when(n < 1000, F.lit(None)).otherwise(200)
    final = F.when(n > 2000, F.concat("source_url", F.lit("/"))).when(n > 1500, F.concat(F.lit("https://new.example.org/"), "id")).otherwise(F.col("source_url"))
    probes = docs.withColumn("code", code.cast("int")).withColumn("final_url", final).withColumn("checked_at", F.lit("2024-02-01T00:00:00Z"))
    probes = probes.withColumn("status", ops.probe_status("code", "source_url", "final_url", F.col("code").isNull()))
    return docs, probes.select("id", "status", "final_url", "checked_at")


def link_patches(spark, sf):
    docs, probes = link_checks(spark, sf)
    patches = ops.probe_patches(probes, docs)
    return patches.withColumn("mirrors", F.array_join("mirrors", " "))


def link_recovery(spark, sf):
    docs, probes = link_checks(spark, sf)
    slim = docs.withColumn("content_sha256", F.when(F.col("kind") == "notice", F.lit("")).otherwise(F.col("content_sha256")))
    mirrors = docs.filter("kind = 'alp'").select("id", F.posexplode("mirrors").alias("pos", "url")).withColumn("status", F.lit("live")).withColumn("final_url", F.lit(""))
    captures = docs.select("id", F.concat(F.lit("https://archive/"), "id").alias("archive_url"))
    return ops.recovery_url(slim, probes, mirrors, captures)


def link_due(spark, sf):
    docs = b.documents(spark, sf).drop("text")
    return ops.due_documents(docs, F.lit("2024-03-01").cast("date"), 40).select("id", "retrieved_at", "source_status")


def document_profile(spark, sf):
    return ops.document_profile(b.documents(spark, sf).drop("text"), ["review_status", "completeness", "kind", "edition"])


def stale_entities(spark, sf):
    docs = b.documents(spark, sf).drop("text").withColumn("entity", F.col("id"))
    old = F.col("retrieved_at") < F.lit("2023-06-01").cast("date")
    return ops.stale_keys(docs, old, F.col("edition").isNull(), 200).select("entity", "fault", "pos", "n")


def catalogue_counts(spark, sf):
    """Every supplier is a budget of its nation; one below zero has no total."""
    amount = v.half_even("s_acctbal")
    budgets = b.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("region"), F.when(amount >= 0, amount).alias("total"))
    return ops.catalogue_counts(
        b.entities(spark, sf), numbered_docs(spark, sf), b.grants(spark, sf, outlays=False), ops.stage_counts(staged(spark, sf)),
        b.table(spark, sf, "nation"), budgets, jobs(spark, sf))


def gone_files(spark, sf):
    rows = events(spark, sf).select(F.col("entity").alias("key"), "at", "event_type")
    return ops.live_rows(ops.first_seen_retention(rows, "key", "at", 24), "expires_at", now())


def job_ids(rows):
    """Jobs of an array in order, as one text."""
    return F.array_join(F.transform(rows, lambda j: F.concat_ws(":", j["id"], j["entity"])), " ")


def snapshot_report(spark, sf):
    scoped = b.entities(spark, sf).filter(F.col("city") == "BUILDING")
    out = ops.snapshot_report(
        jobs(spark, sf), ops.stage_counts(staged(spark, sf)), ops.latest_status(status_events(spark, sf)), gone_files(spark, sf), scoped)
    return out.withColumns({
        "last_job_at": F.date_format("last_job_at", "yyyy-MM-dd HH:mm:ss"), "next_jobs": job_ids("next_jobs"),
        "active_jobs": job_ids("active_jobs")})


def health_report(spark, sf):
    """Orders as jobs, their priority as kind; errors are the worker's log."""
    kinds = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    rows = jobs(spark, sf).join(kinds, "id")
    log = events(spark, sf).filter("event_type = 'error'")
    out = ops.health_report(rows, datasets(spark, sf), ["NATION_7", "NATION_4"], "NATION_12", log, gone_files(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("blocking", "pending_kinds", "active_kinds")})


def spend_spot_check(spark, sf):
    rows = b.purposes(b.grants(spark, sf, described=True)).select(
        "grant_id", "description", F.col("purpose").alias("spend_category"),
        F.when(F.col("level") == "federal", "rules").otherwise("llm").alias("spend_classifier"))
    return ops.spot_check(rows)


QUERIES = {f.__name__: f for f in (
    outcome_buckets, outcome_stats, outcome_last, outcome_recent, outcome_compact, classification_stats,
    classification_recent, review_documents, reject_compact, health_report,
    audit_log, retention_live, status_latest, stage_changes, coverage_stages, coverage_counts, work_ranking, jobs_next,
    jobs_per_entity, job_batches, job_rotation, quota_meter, quota_rate_limits, dataset_readiness,
    link_patches, link_recovery, link_due, document_profile, stale_entities, catalogue_counts,
    snapshot_report, spend_spot_check,
)}

EVENTS_SQL = """
ev AS (SELECT event_id, ts AS "at", user_id AS entity, event_type, value, props,
    CASE event_type WHEN 'error' THEN 'dead' WHEN 'purchase' THEN 'preserved' WHEN 'signup' THEN 'live' WHEN 'click' THEN 'pending' END AS job_status,
    CASE WHEN value > 100 THEN 'published' WHEN value > 50 THEN 'needs_human' WHEN value > 40 THEN 'pending' END AS review_status FROM events),
bu AS (SELECT *, CASE WHEN job_status = 'dead' THEN 'failed' WHEN review_status = 'needs_human' THEN 'needs_human' WHEN review_status = 'published' THEN 'accepted'
    WHEN abs(value / 10 - 2.5) < 1 OR abs(value / 5 - 3.5) < 1 THEN 'uncertain' WHEN review_status = 'pending' OR job_status IN ('pending', 'preserved') THEN 'uncertain'
    WHEN job_status = 'live' THEN 'accepted' ELSE 'uncertain' END AS bucket FROM ev)"""

STATUS_SQL = EVENTS_SQL + """,
se AS (SELECT entity, CASE event_type WHEN 'view' THEN 'explore' WHEN 'click' THEN 'fetch' WHEN 'purchase' THEN 'vet' WHEN 'signup' THEN 'discovery' ELSE 'check' END AS kind,
    CASE WHEN value < 8 THEN 'dead' ELSE 'ok' END AS status, "at", event_id AS seq FROM ev)"""


def latest_sql(source: str) -> str:
    def touch(kind: str, name: str) -> str:
        return f"""max("at") FILTER (WHERE kind = '{kind}') AS {name}"""

    touches = ", ".join(touch(k, c) for k, c in rules.TOUCH_KINDS.items())
    return f"""(SELECT entity, arg_max(kind, row("at", seq)) AS last_job_kind, arg_max(status, row("at", seq)) AS last_job_status,
  max("at") AS last_job_at, {touches} FROM {source} GROUP BY entity)"""


SPARSE_SQL = STATUS_SQL + """,
sp0 AS (SELECT * REPLACE (entity * 7 AS entity) FROM se),
sp AS """ + latest_sql("sp0")

STAGES_SQL = SPARSE_SQL + "," + DOCS_SQL + """,
fl AS (SELECT id AS entity, listed AND kind IN ('master_plan', 'alp') AND completeness = 'complete' AS ver,
   review_status = 'pending' AND kind <> 'notice' AND completeness = 'complete' AS pen, listed AND kind IN ('master_plan', 'alp') AS lis FROM docs),
stg AS (SELECT c_custkey AS entity, sp.last_job_at, CASE WHEN ver THEN 'published' WHEN pen THEN 'snapshot_pending'
   WHEN lis THEN CASE WHEN discovery_at IS NOT NULL OR explored_at IS NOT NULL OR snapshot_at IS NOT NULL THEN 'published' ELSE 'untouched' END
   WHEN explored_at IS NOT NULL OR snapshot_at IS NOT NULL THEN CASE WHEN snapshot_at IS NULL AND explored_at IS NOT NULL AND last_job_status = 'dead' THEN 'no_plan_found' ELSE 'explored' END
   WHEN discovery_at IS NOT NULL THEN 'searched' ELSE 'untouched' END AS stage
  FROM customer LEFT JOIN fl ON fl.entity = c_custkey LEFT JOIN sp ON sp.entity = c_custkey),
stc AS (SELECT x.pos, x.stage, x.label, (SELECT count(*) FROM stg WHERE stg.stage = x.stage) AS n FROM (VALUES """ + ", ".join(
    f"({i}, '{s}', '{rules.STAGE_LABELS[s]}')" for i, s in enumerate(rules.STAGE_ORDER)) + ") x(pos, stage, label))"


def case_sql(column: str, mapping: dict, fallback: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in mapping.items())
    return f"CASE {column} {whens}{'' if fallback is None else f' ELSE {fallback!r}'} END"


JOBS_SQL = """
jb AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS entity, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey + 1 END AS parent_id,
   CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'succeeded' ELSE 'active' END AS state, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 2000 AS priority, o_orderdate AS created_at FROM orders)"""

LINKS_SQL = DOCS_SQL + """,
pr AS (SELECT *, CASE WHEN length(text) < 600 THEN 'dead' WHEN length(text) < 1000 THEN 'error' WHEN length(text) > 2000 THEN 'live' WHEN length(text) > 1500 THEN 'moved' ELSE 'live' END AS st,
   CASE WHEN length(text) > 2000 THEN source_url || '/' WHEN length(text) > 1500 THEN 'https://new.example.org/' || id ELSE source_url END AS fin FROM docs)"""

GONE_SQL = """f AS (SELECT entity, min("at") AS "at" FROM ev GROUP BY 1 UNION ALL SELECT f.entity, min(ev."at") FROM f JOIN ev ON ev.entity = f.entity AND ev."at" >= f."at" + INTERVAL 24 DAY GROUP BY f.entity, f."at")"""

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def retention_sql(value: str, name: str) -> str:
    """Lives of 20 days per key that have not ended; each starts at the first sighting after the one before."""
    return f"""WITH RECURSIVE {EVENTS_SQL}, k AS (SELECT entity || '-' || event_type AS key, "at", {value} AS {name} FROM ev),
f AS (SELECT key, min("at") AS "at", arg_min({name}, "at") AS {name} FROM k GROUP BY 1
  UNION ALL SELECT f.key, min(k."at"), arg_min(k.{name}, k."at") FROM f JOIN k ON k.key = f.key AND k."at" >= f."at" + INTERVAL 20 DAY GROUP BY f.key, f."at")
SELECT key, {TS.format('"at"')} AS "at", {name}, {TS.format('"at" + INTERVAL 20 DAY')} AS expires_at FROM f WHERE "at" + INTERVAL 20 DAY > TIMESTAMP '{NOW}'"""


ORACLE = {
    "outcome_buckets": f"WITH {EVENTS_SQL} SELECT event_id, bucket FROM bu",
    "outcome_stats": f"""WITH {EVENTS_SQL}
SELECT x.bucket, count(event_id) AS count, count(*) FILTER (WHERE event_type = 'view') AS labelled, (SELECT count(*) FROM ev) AS n, count(event_id)::DOUBLE / (SELECT count(*) FROM ev) AS rate
FROM (VALUES ('accepted'), ('uncertain'), ('needs_human'), ('failed')) x(bucket) LEFT JOIN bu ON bu.bucket = x.bucket GROUP BY 1""",
    "outcome_last": f"""WITH {EVENTS_SQL}, r AS (SELECT event_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY event_id DESC) AS pos FROM bu)
SELECT * FROM r WHERE pos <= CASE bucket WHEN 'accepted' THEN 20 ELSE 80 END""",
    "outcome_recent": f"""WITH {EVENTS_SQL} SELECT event_id, "at", entity FROM bu WHERE bucket = 'failed' ORDER BY event_id DESC LIMIT 200""",
    "outcome_compact": f"""WITH {EVENTS_SQL}
SELECT event_id AS id, '{{"bucket":"' || bucket || '","id":' || event_id || coalesce(',"job_status":"' || job_status || '"', '') || coalesce(',"review_status":"' || review_status || '"', '') || ',"gold":{{"confirm":true}}}}' AS compact FROM bu""",
    "classification_recent": f"""WITH {EVENTS_SQL} SELECT event_id, event_type AS evaluation, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS category, CASE WHEN value > 30 THEN 'llm' ELSE 'rules' END AS classifier
FROM ev ORDER BY event_id DESC LIMIT 50""",
    "review_documents": f"""WITH {DOCS_SQL} SELECT id, kind, (SELECT count(*) FROM docs WHERE review_status = 'pending') AS n FROM docs WHERE review_status = 'pending' ORDER BY id LIMIT 2000""",
    "reject_compact": f"""WITH {EVENTS_SQL}
SELECT event_id, '{{"at":"' || {TS.format('"at"')} || '","sha256":"' || sha256(props) || '"' || CASE WHEN value > 20 THEN ',"suffix":".pdf"' ELSE '' END || ',"bytes":' || CASE event_type WHEN 'view' THEN 0 ELSE entity END ||
  ',"stored":' || (value > 50) || coalesce(',"reason":"' || job_status || '"', '') || CASE event_type WHEN 'error' THEN ',"http_status":404' ELSE '' END || '}}' AS compact FROM ev""",
    "classification_stats": f"""WITH {EVENTS_SQL}, c AS (SELECT "at", event_type AS evaluation, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS category, CASE WHEN value > 30 THEN 'llm' ELSE 'rules' END AS classifier FROM ev)
SELECT evaluation, category, classifier, count(*) AS n, count(*) FILTER (WHERE strftime("at", '%Y-%m') = '2024-01') AS n_month FROM c GROUP BY GROUPING SETS ((evaluation, category), (classifier), ())""",
    "audit_log": f"""WITH {EVENTS_SQL} SELECT "at", event_id, CASE WHEN event_type = 'view' THEN 'a' ELSE 'c' END AS log, CASE WHEN event_type <> 'view' THEN value END AS value FROM ev WHERE "at" <= TIMESTAMP '{NOW}'""",
    "retention_live": retention_sql("event_type", "event_type"),
    "stage_changes": f"""WITH e AS (SELECT user_id AS entity, ts, event_id AS seq, CASE WHEN value < 8 THEN 'dead' ELSE 'ok' END AS status, event_type AS t FROM events),
f AS (SELECT *, bool_or(t = 'view') OVER w AS x, bool_or(t = 'click') OVER w AS s, bool_or(t = 'signup') OVER w AS d FROM e WINDOW w AS (PARTITION BY entity ORDER BY ts, seq)),
g AS (SELECT *, CASE WHEN x OR s THEN CASE WHEN NOT s AND status = 'dead' THEN 'no_plan_found' ELSE 'explored' END WHEN d THEN 'searched' ELSE 'untouched' END AS stage FROM f),
h AS (SELECT *, lag(stage, 1, 'untouched') OVER (PARTITION BY entity ORDER BY ts, seq) AS previous FROM g)
SELECT entity, {TS.format('ts')} AS "at", seq, previous, stage FROM h WHERE previous <> stage""",
    "status_latest": f"""WITH {STATUS_SQL}
SELECT entity, last_job_kind, last_job_status, {', '.join(f'{TS.format(c)} AS {c}' for c in ('last_job_at', 'explored_at', 'snapshot_at', 'vetted_at', 'discovery_at'))} FROM {latest_sql('se')}""",
    "coverage_stages": f"""WITH {STAGES_SQL}
SELECT entity, stage, replace({case_sql('stage', rules.STAGE_BANNERS)}, '{{date}}', coalesce(strftime(last_job_at, '%Y-%m-%d'), 'a recent pass')) AS banner,
  CASE WHEN entity < 500 AND stage NOT IN ('untouched', 'published') THEN '{rules.PANEL_ALONE}' ELSE {case_sql('stage', rules.PANEL_EMPTY, rules.PANEL_EMPTY['untouched'])} END AS panel FROM stg""",
    "coverage_counts": f"WITH {STAGES_SQL} SELECT * FROM stc",
    "work_ranking": f"""WITH {SPARSE_SQL}, {DOCS_SQL}, {GRANTS_SQL.strip()},
fu AS (SELECT entity, CAST(sum(coalesce(nullif(obligated, 0), nullif(amount, 0), 0)) AS BIGINT) AS funded FROM grants WHERE level IN ('federal', 'state', 'local') GROUP BY 1 HAVING funded > 0),
j AS (SELECT c_custkey AS key, c_nationkey AS region, c_acctbal > 3000 AS in_registry, funded, sp.*, coalesce(discovery_at, explored_at, last_job_at) AS seen,
   c_custkey IN (SELECT id FROM docs WHERE listed AND kind IN ('master_plan', 'alp') AND completeness = 'complete') AS pub
  FROM customer LEFT JOIN fu ON fu.entity = c_custkey LEFT JOIN sp ON sp.entity = c_custkey)
SELECT key, region, in_registry, CASE WHEN pub THEN 5 WHEN snapshot_at IS NULL AND explored_at IS NOT NULL AND last_job_status = 'dead' THEN 4
   WHEN NOT coalesce(seen >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY, false) THEN CASE WHEN funded IS NOT NULL THEN 0 ELSE 1 END ELSE CASE WHEN funded IS NOT NULL THEN 2 ELSE 3 END END AS tier,
  CASE WHEN seen IS NULL THEN 0 ELSE 1 END AS never, coalesce(funded, 0) AS funded FROM j""",
    "jobs_next": f"""WITH {JOBS_SQL}
SELECT id, entity, CAST(priority + floor(epoch(TIMESTAMP '2001-09-01 00:00:00' - created_at) / 3600) AS BIGINT) AS aged FROM jb
WHERE state = 'pending' AND (parent_id IS NULL OR parent_id IN (SELECT id FROM jb WHERE state = 'succeeded')) AND (entity IS NULL OR entity NOT IN (SELECT s_suppkey FROM supplier))
ORDER BY aged DESC, id LIMIT 50""",
    "jobs_per_entity": f"""WITH {JOBS_SQL}, p AS (SELECT entity, id, id AS seq FROM jb WHERE state = 'pending')
SELECT * FROM (SELECT * FROM p WHERE entity IS NULL UNION ALL SELECT entity, min(id), min(id) FROM p WHERE entity IS NOT NULL GROUP BY entity) ORDER BY seq LIMIT 100""",
    "job_batches": "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 400 AS BIGINT) AS batch FROM orders",
    "job_rotation": """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS c FROM orders)
SELECT o_orderkey, CAST(((p - 14990 % c) + c) % c AS BIGINT) AS place FROM n WHERE ((p - 14990 % c) + c) % c < 25""",
    "quota_meter": f"""WITH {EVENTS_SQL}, c AS (SELECT event_type AS provider, strftime("at", '%Y-%m') AS month, count(*) AS asked, max("at") AS last_at FROM ev GROUP BY ALL),
p AS (SELECT * FROM (VALUES ('click', 1000), ('view', 2000), ('purchase', 150)) x(provider, cap))
SELECT provider, month, asked, least(asked, cap) AS charged, CAST(cap AS BIGINT) AS cap, greatest(cap - asked, 0) AS remaining, asked >= cap AS exhausted, {TS.format('last_at')} AS last_at,
  CASE WHEN provider <> 'view' THEN asked - 7 END AS used, CASE WHEN provider <> 'view' THEN least(asked, cap) - (asked - 7) END AS drift FROM c JOIN p USING (provider)""",
    "quota_rate_limits": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey + 15000 END AS "limit", CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS remaining,
  CASE WHEN o_orderstatus <> 'P' THEN greatest(o_orderkey + 15000 - o_custkey, 0) END AS used, CASE WHEN o_orderstatus = 'F' THEN 1419704 END AS reset_seconds FROM orders""",
    "dataset_readiness": """WITH s AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name,
   CASE n_nationkey WHEN 3 THEN n_name || ': failed (disk)' WHEN 8 THEN n_name || ': building' WHEN 9 THEN n_name || ': stale' WHEN 11 THEN n_name || ': missing' WHEN 12 THEN n_name || ': missing' WHEN 14 THEN n_name || ': unhealthy' END AS fault FROM nation),
n AS (SELECT c_custkey AS job, 0 AS pos, c_nationkey AS k FROM customer UNION ALL SELECT c_custkey, 1, CASE WHEN c_acctbal < 500 THEN 9 ELSE 0 END FROM customer),
a AS (SELECT job, pos, 1 AS own, k FROM n UNION ALL SELECT job, pos, 0, s.r FROM n JOIN s ON s.k = n.k AND s.k > s.r),
f AS (SELECT a.*, fault FROM a JOIN s ON s.k = a.k)
SELECT job, bool_and(fault IS NULL) AS ready, arg_min(fault, row(pos, own)) FILTER (WHERE fault IS NOT NULL) AS reason FROM f GROUP BY job""",
    "link_patches": f"""WITH {LINKS_SQL}
SELECT id, '2024-02-01T00:00:00Z' AS source_retrieved_at, CASE WHEN st <> 'error' THEN st END AS source_status, CASE st WHEN 'live' THEN 'complete' WHEN 'dead' THEN 'preserved_only' END AS completeness,
  CASE WHEN st = 'moved' THEN fin END AS source_url, CASE WHEN st = 'moved' THEN CASE WHEN kind = 'alp' THEN source_url ELSE 'http://m.example.org/a ' || source_url END END AS mirrors FROM pr""",
    "link_recovery": f"""WITH {LINKS_SQL}
SELECT id, st AS status, CASE WHEN st = 'moved' THEN fin WHEN st = 'dead' THEN CASE WHEN kind = 'alp' THEN source_url WHEN kind = 'notice' THEN 'https://archive/' || id END END AS fetch_url FROM pr""",
    "link_due": f"""WITH {DOCS_SQL}
SELECT id, retrieved_at, source_status FROM docs WHERE DATE '2024-03-01' - retrieved_at >= CASE WHEN source_status = 'dead' THEN 30 ELSE 7 END ORDER BY retrieved_at, id LIMIT 40""",
    "document_profile": f"""WITH {DOCS_SQL}
SELECT x.field, x.value, count(*) AS n FROM (SELECT unnest([{{'field': 'review_status', 'value': review_status}}, {{'field': 'completeness', 'value': completeness}}, {{'field': 'kind', 'value': kind}}, {{'field': 'edition', 'value': coalesce(edition, 'unset')}}]) AS x FROM docs) GROUP BY ALL""",
    "stale_entities": f"""WITH {DOCS_SQL}, t AS (SELECT id AS entity, 'stale' AS fault FROM docs WHERE retrieved_at < DATE '2023-06-01' UNION ALL SELECT id, 'empty' FROM docs WHERE edition IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY fault ORDER BY entity) AS pos, count(*) OVER (PARTITION BY fault) AS n FROM t) SELECT * FROM r WHERE pos <= 200""",
    "catalogue_counts": f"""WITH {STAGES_SQL}, {GRANTS_SQL.strip()}, {JOBS_SQL.strip()},
b AS (SELECT c_custkey, CASE WHEN d.id IS NOT NULL THEN CASE completeness WHEN 'missing' THEN 'missing' ELSE completeness END ELSE 'missing' END AS s FROM customer LEFT JOIN docs d ON d.id = c_custkey AND listed AND kind IN ('master_plan', 'alp')),
e AS (SELECT count(*) AS entities, {', '.join(f"count(*) FILTER (WHERE s = '{s}') AS entities_{s}" for s in ('complete', 'link_only', 'preserved_only', 'no_plan_known', 'missing'))} FROM b),
d AS (SELECT count(*) FILTER (WHERE listed) AS documents_listed, count(*) FILTER (WHERE listed AND completeness = 'complete') AS documents_complete, count(*) FILTER (WHERE listed AND completeness = 'link_only') AS documents_link_only,
  0 AS statutes, count(*) FILTER (WHERE listed AND kind = 'master_plan') AS entities_with_master_plan, count(*) FILTER (WHERE listed AND kind = 'alp') AS entities_with_alp FROM docs),
g AS (SELECT count(*) AS grants, {', '.join(f"CAST(sum(CASE WHEN level = '{s}' THEN coalesce(nullif(obligated, 0), nullif(amount, 0), 0) ELSE 0 END) AS BIGINT) AS funding_{s}, count(DISTINCT CASE WHEN level = '{s}' THEN entity END) AS funding_{s}_entities" for s in ('federal', 'local'))} FROM grants)
SELECT *, (SELECT n FROM stc WHERE stage = 'snapshot_pending') AS snapshot_pending, (SELECT CAST(sum(n) AS BIGINT) FROM stc WHERE stage IN ('searched', 'explored')) AS searched,
  documents_complete AS saved_copies, entities_complete AS entities_with_plans, (SELECT count(*) FROM nation) AS states,
  (SELECT CAST(sum(CASE WHEN s_acctbal >= -0.5 THEN round_even(s_acctbal, 0) END) AS BIGINT) FROM supplier) AS funding_state_budget_total, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS funding_states_with_budgets,
  (SELECT count(*) FROM jb WHERE state = 'pending') AS queue_pending, (SELECT count(*) FROM jb WHERE state = 'active') AS queue_active,
  CAST(round_even(100.0 * (entities - (SELECT n FROM stc WHERE stage = 'untouched')) / entities, 0) AS BIGINT) AS pct_reviewed,
  CAST(round_even(100.0 * entities_with_master_plan / entities, 0) AS BIGINT) AS pct_master_plan, CAST(round_even(100.0 * entities_with_alp / entities, 0) AS BIGINT) AS pct_alp FROM e, d, g""",
    "snapshot_report": f"""WITH RECURSIVE {STAGES_SQL}, {JOBS_SQL.strip()},
{GONE_SQL}, l AS (SELECT * FROM {latest_sql('se')} ORDER BY last_job_at DESC, entity DESC LIMIT 1)
SELECT count(*) FILTER (WHERE state = 'pending') AS jobs_pending, count(*) FILTER (WHERE state = 'active') AS jobs_active, count(*) FILTER (WHERE state = 'succeeded') AS jobs_succeeded, 0 AS jobs_failed,
  {', '.join(f"(SELECT n FROM stc WHERE stage = '{s}') AS stage_{s}" for s in rules.STAGES)},
  (SELECT {TS.format('last_job_at')} FROM l) AS last_job_at, (SELECT entity FROM l) AS last_job_entity, (SELECT last_job_kind FROM l) AS last_job_kind, (SELECT last_job_status FROM l) AS last_job_status,
  (SELECT count(*) FROM f WHERE "at" + INTERVAL 24 DAY > TIMESTAMP '{NOW}') AS live_rejects, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS scoped_entities,
  (SELECT string_agg(concat_ws(':', id, entity), ' ' ORDER BY id) FROM (SELECT * FROM jb AS p WHERE state = 'pending' AND (entity IS NULL OR NOT EXISTS (FROM jb AS q WHERE q.state = 'pending' AND q.entity = p.entity AND q.id < p.id)) ORDER BY id LIMIT 10)) AS next_jobs,
  (SELECT string_agg(concat_ws(':', id, entity), ' ' ORDER BY id) FROM (SELECT * FROM jb WHERE state = 'active' ORDER BY id LIMIT 10)) AS active_jobs FROM jb""",
    "health_report": f"""WITH RECURSIVE {EVENTS_SQL}, {JOBS_SQL.strip()}, {GONE_SQL}, w AS (SELECT jb.*, o_orderpriority AS kind FROM jb JOIN orders ON o_orderkey = id),
c AS (SELECT count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'active') AS active,
  string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE state = 'pending') AS pending_kinds, string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE state = 'active') AS active_kinds FROM w),
n AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name,
   CASE n_nationkey WHEN 3 THEN n_name || ': failed (disk)' WHEN 8 THEN n_name || ': building' WHEN 11 THEN n_name || ': missing' WHEN 12 THEN n_name || ': missing' WHEN 14 THEN n_name || ': unhealthy' END AS fault FROM nation),
a AS (SELECT k, CASE k WHEN 7 THEN 0 ELSE 1 END AS pos, 1 AS own FROM n WHERE k IN (4, 7) UNION ALL SELECT r, CASE k WHEN 7 THEN 0 ELSE 1 END, 0 FROM n WHERE k IN (4, 7) AND k > r),
d AS (SELECT arg_min(fault, row(pos, own)) FILTER (WHERE fault IS NOT NULL) AS detail FROM a JOIN n USING (k)),
l AS (SELECT count(*) AS worker_lines FROM ev WHERE event_type = 'error'), g AS (SELECT count(*) AS live_rejects FROM f WHERE "at" + INTERVAL 24 DAY > TIMESTAMP '{NOW}')
SELECT detail IS NULL AS search_ready, detail, c.*, worker_lines, live_rejects, concat_ws(',', detail, (SELECT fault FROM n WHERE k = 12)) AS blocking,
  NOT (active > 0 AND pending = 0 AND worker_lines = 0) AS worker_ok, CASE WHEN active > 0 AND pending = 0 AND worker_lines = 0 THEN '{rules.WEDGED}' END AS worker_detail,
  detail IS NULL AND NOT (active > 0 AND pending = 0 AND worker_lines = 0) AS ok FROM c, d, l, g""",
    "spend_spot_check": f"""WITH {GRANTS_SQL} SELECT grant_id, nullif(description, '') AS description, purpose AS spend_category, 'llm' AS spend_classifier FROM grants WHERE purpose = 'other' AND level <> 'federal'""",
}
