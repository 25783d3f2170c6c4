"""Audit, status and work tables: buckets, stages, quotas, readiness, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainledger.functions import urls
from plainledger.functions import values as v
from plainledger.operators import documents as doc
from plainledger.operators.skew import ordered_position, spread_join
from plainledger.rules import documents as doc_rules
from plainledger.rules import ops as rules
from plainledger.session import cut


# --- outcomes ------------------------------------------------------------------

def outcome_bucket(job: Column | str, review: Column | str, scores: dict[str, Column] | None = None) -> Column:
    """Bucket of a job: failed, needs_human, accepted or uncertain, in that priority."""
    job = F.trim(F.coalesce(v.col(job), F.lit("")))
    review = F.trim(F.coalesce(v.col(review), F.lit("")))
    near = F.lit(False)
    if scores:
        near = v.any_of(*[
            F.abs(F.coalesce(scores[n], F.lit(0.0)) - t) < rules.NEAR for n, t in rules.THRESHOLDS.items() if n in scores])
    return (
        F.when(job.isin(*rules.FAILED_JOBS), "failed")
        .when((job == "needs_human") | (review == "needs_human"), "needs_human")
        .when(review.isin(*rules.ACCEPTED_REVIEWS) | job.isin(*rules.ACCEPTED_REVIEWS), "accepted")
        .when(near, "uncertain")
        .when((review == "pending") | job.isin("pending", "preserved"), "uncertain")
        .when(job.isin("live", "moved"), "accepted")
        .otherwise("uncertain")
    )


def outcome_stats(events: DataFrame, labelled: Column) -> DataFrame:
    """Count, labelled count and rate per bucket; every bucket has a row."""
    found = events.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.count_if(labelled).alias("labelled"))
    spark = events.sparkSession
    frame = spark.createDataFrame([(x,) for x in rules.BUCKETS], "bucket string")
    whole = events.agg(F.count(F.lit(1)).alias("n"))
    # One row of totals and four buckets: both sides are fixed in size.
    joined = frame.join(found, "bucket", "left").na.fill(0, ["count", "labelled"]).join(F.broadcast(whole))
    return joined.withColumn("rate", F.col("count") / F.greatest(F.col("n"), F.lit(1)))


def classification_stats(events: DataFrame, month: str) -> DataFrame:
    """Counts by evaluation and category, by classifier, and the month's total, in one pass."""
    this_month = F.date_format("at", "yyyy-MM") == month
    return events.groupingSets(
        [["evaluation", "category"], ["classifier"], []], "evaluation", "category", "classifier"
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(this_month).alias("n_month"))


def compact(df: DataFrame, columns: Sequence[str], gold: str | None = None,
            gold_fields: Sequence[str] = ()) -> DataFrame:
    """Whitelisted, non-blank fields of a row as JSON; text bodies never get through."""
    kept = [c for c in columns if c in df.columns and c not in rules.BANNED_COLUMNS or c == "bytes" and c in df.columns]
    fields = []
    for c in kept:
        if c == gold and gold_fields:
            fields.append(F.struct(*[F.col(f"{c}.{g}").alias(g) for g in gold_fields]).alias(c))
        elif df.schema[c].dataType.simpleString() == "string":
            fields.append(v.first_text(c).alias(c))
        else:
            fields.append(F.col(c))
    return df.withColumn("compact", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}))


def last_per_bucket(events: DataFrame, bucket: str, seq: str, limits: dict[str, int]) -> DataFrame:
    """Latest rows of every bucket, each with its own limit; limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(F.col(seq).desc()))
    top = events.withColumn("pos", rank).filter(F.col("pos") <= max(limits.values()))
    return top.filter(F.col("pos") <= v.lookup(limits, F.col(bucket)))


def recent(events: DataFrame, seq: str, limit: int, condition: Column | None = None) -> DataFrame:
    chosen = events if condition is None else events.filter(condition)
    return chosen.orderBy(F.col(seq).desc()).limit(limit)


def review_list(docs: DataFrame, review: str | None, limit: int | None = None, key: str = "id") -> DataFrame:
    """Documents of a review status (blank: of any) by key, with `n`, the number that match.

    The limit is held between 1 and MAX_LISTED; without one it is LISTED.
    """
    shown = rules.LISTED if limit is None else max(1, min(limit, rules.MAX_LISTED))
    chosen = docs.filter(F.col("review_status") == review) if (review or "").strip() else docs
    # A single row of totals.
    return chosen.orderBy(key).limit(shown).join(F.broadcast(chosen.agg(F.count(F.lit(1)).alias("n"))))


def live_rows(df: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows not yet expired; a row without expiry stays."""
    return df.filter(F.col(expires).isNull() | (F.col(expires) > now))


def as_of(df: DataFrame, at: str, cutoff: Column) -> DataFrame:
    return df.filter(F.col(at) <= cutoff)


def merged_log(*logs: DataFrame) -> DataFrame:
    """Audit logs as one, in time order."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out.orderBy("at")


def first_seen_retention(rows: DataFrame, key: str, at: str, days: int = rules.RETENTION_DAYS) -> DataFrame:
    """One row per life of a key, with its expiry; a repeat within a life never extends it.

    A sighting at or after the expiry opens the key's next life. Every sighting gets a
    pointer to the one that would open the life after its own (`next_sightings`); the
    lives are the first sighting of a key and what its pointers lead to, and pointers
    that double reach it in as many rounds as the number of lives has binary digits.
    Of equal sightings the smallest row stays.
    """
    rest = [c for c in rows.columns if c not in (key, at)]
    sights = cut(rows.groupBy(key, at).agg(F.min(F.struct(*rest)).alias("_row")))
    pointers = cut(next_sightings(sights.select(key, at), key, at, days))
    lives = sights.groupBy(key).agg(F.min(at).alias(at))
    # A key has no more lives than spans of time in which it was seen.
    spans = sights.groupBy(key).agg(F.count_distinct(_span(F.col(at), days)).alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(int(spans - 1).bit_length()):
        lives = lives.unionByName(_follow(lives, pointers, key, at).select(key, F.col("_to").alias(at)))
        further = _follow(pointers.select(key, F.col(at).alias("_from"), F.col("_to").alias(at)), pointers, key, at)
        pointers = cut(further.select(key, F.col("_from").alias(at), "_to"))
    expires = (F.col(at) + F.expr(f"interval {days} days")).alias("expires_at")
    kept = sights.join(lives.select(F.col(key).alias("_key"), F.col(at).alias("_life")),
                       F.col(key).eqNullSafe(F.col("_key")) & (F.col(at) == F.col("_life")), "left_semi")
    return kept.select(key, at, "_row.*", expires)


def _span(at: Column, days: int) -> Column:
    """Number of a stretch of `days` days; it only splits the work and bounds the lives."""
    return F.floor(F.datediff(at, F.lit("1970-01-01").cast("date")) / days)


def _follow(rows: DataFrame, pointers: DataFrame, key: str, at: str) -> DataFrame:
    """Rows with `_to`, where the pointer of (key, at) leads; rows whose pointer ends are left out."""
    steps = pointers.select(F.col(key).alias("_key"), F.col(at).alias("_at"), "_to")
    return rows.join(steps, F.col(key).eqNullSafe(F.col("_key")) & (F.col(at) == F.col("_at"))).drop("_key", "_at")


def next_sightings(sights: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """(key, at, _to): for each sighting the first one of its key `days` days later or after that.

    An as-of search: expiries and sightings of one span of time are sorted together, so a
    hot key is split by time; where a span has none, the next span with a sighting
    follows from one row per key and span.
    """
    probe = F.col(at) + F.expr(f"interval {days} days")
    both = sights.select(key, F.col(at).alias("_at"), F.lit(None).cast(sights.schema[at].dataType).alias("_from")).unionByName(
        sights.select(key, probe.alias("_at"), F.col(at).alias("_from"))).withColumn("_span", _span(F.col("_at"), days))
    is_probe = F.col("_from").isNotNull()
    # From the latest on, sightings before expiries of the same time.
    back = Window.partitionBy(key, "_span").orderBy(F.col("_at").desc(), is_probe).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_to", F.min(F.when(~is_probe, F.col("_at"))).over(back)).filter(is_probe)
    spans = both.groupBy(key, "_span").agg(F.min(F.when(~is_probe, F.col("_at"))).alias("_first"))
    later = Window.partitionBy(key).orderBy(F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = spans.select(F.col(key).alias("_key"), F.col("_span").alias("_of"), F.min("_first").over(later).alias("_after"))
    found = here.join(after, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_of")))
    return found.select(key, F.col("_from").alias(at), F.coalesce("_to", "_after").alias("_to")).filter("_to is not null")


# --- links -----------------------------------------------------------------------

def probe_status(code: Column | str, url: Column | str, final: Column | str, failed: Column) -> Column:
    """live, moved, dead or error from an HTTP code and the final URL."""
    code = v.col(code)
    fine = code.between(200, 299) | (code == 304)
    return (
        F.when(failed | code.isNull(), "error")
        .when(code.isin(*doc_rules.DEAD_HTTP), "dead")
        .when(fine, F.when(urls.same_resource(url, final), "live").otherwise("moved"))
        .otherwise("error")
    )


def probe_patches(probes: DataFrame, docs: DataFrame) -> DataFrame:
    """Patch rows after a link check: only the columns that change are set.

    Probes: id, status, final_url, checked_at. A set column is marked by the flags
    in `present`, so a null that was not set stays apart from one that was.
    """
    state = docs.select("id", "source_url", "completeness", "content_sha256", "mirrors")
    joined = probes.join(state, "id")
    status, stored = F.col("status"), v.first_text("content_sha256").isNotNull()
    moved = (status == "moved") & v.first_text("final_url").isNotNull() & ~urls.same_resource("source_url", "final_url")
    known = F.array_contains("mirrors", F.col("source_url"))
    mirrors = F.when(known, F.col("mirrors")).otherwise(F.concat("mirrors", F.array("source_url")))
    completeness = (
        F.when((status == "live") & stored, "complete").when((status == "dead") & stored, "preserved_only")
        .when((status == "dead") & (F.col("completeness") == "link_only"), "missing")
    )
    return joined.select(
        "id", F.col("checked_at").alias("source_retrieved_at"),
        F.when(status != "error", status).alias("source_status"),
        completeness.alias("completeness"),
        F.when(moved, F.col("final_url")).alias("source_url"),
        F.when(moved, mirrors).alias("mirrors"),
    )


def recovery_url(docs: DataFrame, probes: DataFrame, mirror_probes: DataFrame, captures: DataFrame) -> DataFrame:
    """URL to fetch next: the moved target, the first live mirror, or an archive copy.

    Mirror probes: id, pos, status, final_url. Captures: id, archive_url.
    """
    live = mirror_probes.filter(F.col("status").isin("live", "moved")).groupBy("id").agg(
        F.min_by(v.first_text("final_url", "url"), "pos").alias("_mirror"))
    joined = (
        docs.select("id", "content_sha256").join(probes.select("id", "status", "final_url"), "id")
        .join(live, "id", "left").join(captures.select("id", "archive_url"), "id", "left"))
    stored = v.first_text("content_sha256").isNotNull()
    found = F.when(F.col("status") == "moved", v.first_text("final_url")).when(
        F.col("status") == "dead", F.coalesce("_mirror", F.when(~stored, F.col("archive_url"))))
    return joined.select("id", "status", found.alias("fetch_url"))


def is_due(url: Column | str, status: Column | str, checked: Column | str, now: Column) -> Column:
    window = F.when(v.col(status) == "dead", doc_rules.DEAD_RECHECK_DAYS).otherwise(doc_rules.LIVE_RECHECK_DAYS)
    old = F.datediff(now, v.col(checked)) >= window
    return urls.is_http(url) & F.coalesce(old, F.lit(True))


def due_documents(docs: DataFrame, now: Column, limit: int = 40) -> DataFrame:
    """Documents to check again, oldest check first."""
    due = docs.filter(is_due("source_url", "source_status", "retrieved_at", now))
    return due.orderBy(F.coalesce(F.col("retrieved_at").cast("string"), F.lit("")), "id").limit(limit)


# --- status per entity ----------------------------------------------------------

def latest_status(events: DataFrame) -> DataFrame:
    """Last job and per-kind touch times of every entity, from its event log.

    Events: entity, kind, status, at, seq. Grouped maxima only, so a hot entity is
    combined before the shuffle.
    """
    last = F.max_by(F.struct("kind", "status", "at"), F.struct("at", "seq"))
    touches = [F.max(F.when(F.col("kind") == k, F.col("at"))).alias(c) for k, c in rules.TOUCH_KINDS.items()]
    out = events.groupBy("entity").agg(last.alias("_last"), *touches)
    return out.select(
        "entity", F.col("_last.kind").alias("last_job_kind"), F.col("_last.status").alias("last_job_status"),
        F.col("_last.at").alias("last_job_at"), *rules.TOUCH_KINDS.values())


def last_evaluated() -> Column:
    return F.coalesce("discovery_at", "explored_at", "last_job_at")


def no_plan_found() -> Column:
    return F.col("snapshot_at").isNull() & F.col("explored_at").isNotNull() & v.yes(
        F.col("last_job_status").isin(*rules.NO_PLAN_STATUSES))


# Touches that decide a stage, in the order of `touch_stage`.
STAGE_TOUCHES = ("explored_at", "snapshot_at", "discovery_at")


def touch_stage(explored: Column, snapshot: Column, discovered: Column, last_status: Column) -> Column:
    """Stage of an entity without plans, from whether it was touched and how its last job ended."""
    without_plan = ~snapshot & explored & v.yes(last_status.isin(*rules.NO_PLAN_STATUSES))
    return F.when(explored | snapshot, F.when(without_plan, "no_plan_found").otherwise("explored")).when(
        discovered, "searched").otherwise("untouched")


def _touched_events(events: DataFrame, before: DataFrame | None) -> DataFrame:
    """Events of entities with what had been touched by then, the stage after each, and the stage before all."""
    events = events.filter(F.col("entity").isNotNull())
    kinds = {c: k for k, c in rules.TOUCH_KINDS.items()}
    place = F.struct("at", "seq")
    firsts = events.groupBy("entity").agg(*[
        F.min(F.when(F.col("kind") == kinds[c], place)).alias(f"_first_{c}") for c in STAGE_TOUCHES])
    if before is None:
        known = firsts.select("*", *[F.lit(False).alias(f"_had_{c}") for c in STAGE_TOUCHES], F.lit("untouched").alias("_was"))
    else:
        old = before.select("entity", *[F.col(c).alias(f"_had_{c}") for c in STAGE_TOUCHES], F.col("stage").alias("_was"))
        known = firsts.join(old, "entity", "left").na.fill(False, [f"_had_{c}" for c in STAGE_TOUCHES]).na.fill("untouched", ["_was"])
    # One entity may hold a third of all events.
    joined = spread_join(events, known, ["entity"], place, "inner")
    for c in STAGE_TOUCHES:
        joined = joined.withColumn(c, F.col(f"_had_{c}") | v.yes(F.col(f"_first_{c}") <= place))
    return joined.withColumn("stage", touch_stage(*[F.col(c) for c in STAGE_TOUCHES], F.col("status")))


def stage_changes(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(entity, at, seq, previous, stage): events after which an entity's stage is another one.

    Events: entity, kind, status, at, seq; those without an entity count for none.
    Before: entity, touches and stage as of earlier events (`stage_state`). An entity's
    events are compared day by day, and each day's first with the last of the day before.
    """
    staged = _touched_events(events, before).withColumn("_day", F.to_date("at"))
    inside = Window.partitionBy("entity", "_day").orderBy("at", "seq")
    lagged = staged.withColumn("_lag", F.lag("stage").over(inside))
    days = staged.groupBy("entity", "_day").agg(F.max_by("stage", F.struct("at", "seq")).alias("_last"))
    earlier = Window.partitionBy("entity").orderBy("_day")
    ends = days.select("entity", "_day", F.lag("_last").over(earlier).alias("_end"))
    first = lagged.filter(F.col("_lag").isNull()).join(ends, ["entity", "_day"]).withColumn("_lag", F.coalesce("_end", "_was")).drop("_end")
    rows = first.unionByName(lagged.filter(F.col("_lag").isNotNull()))
    return rows.filter(F.col("stage") != F.col("_lag")).select(
        "entity", "at", "seq", F.col("_lag").alias("previous"), "stage")


def stage_state(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Touches and stage of the entities of some events after the last of them."""
    staged = _touched_events(events, before)
    last = F.max_by(F.struct(*STAGE_TOUCHES, "stage"), F.struct("at", "seq"))
    return staged.groupBy("entity").agg(last.alias("_last")).select("entity", "_last.*")


def coverage_stages(entities: DataFrame, docs: DataFrame, status: DataFrame) -> DataFrame:
    """Coverage stage of every entity from its plans, pending files and touches."""
    listed_plan = doc.listed("review_status") & F.col("kind").isin(*doc_rules.WORK_KINDS)
    flags = docs.groupBy("entity").agg(
        F.bool_or(doc.verified_plan("review_status", "kind", "completeness")).alias("_verified"),
        F.bool_or(doc.pending_plan("review_status", "kind", "completeness")).alias("_pending"),
        F.bool_or(listed_plan).alias("_listed"))
    joined = entities.select(F.col("key").alias("entity")).join(flags, "entity", "left").join(status, "entity", "left")
    touched = v.any_of(*[F.col(c).isNotNull() for c in ("discovery_at", "explored_at", "snapshot_at")])
    by_touch = touch_stage(*[F.col(c).isNotNull() for c in STAGE_TOUCHES], F.col("last_job_status"))
    stage = (
        F.when(v.yes(F.col("_verified")), "published")
        .when(v.yes(F.col("_pending")), "snapshot_pending")
        .when(v.yes(F.col("_listed")), F.when(touched, "published").otherwise("untouched"))
        .otherwise(by_touch)
    )
    return joined.withColumn("stage", stage).drop("_verified", "_pending", "_listed")


def stage_counts(stages: DataFrame) -> DataFrame:
    """Count per stage in display order; every stage has a row."""
    spark = stages.sparkSession
    frame = spark.createDataFrame(
        [(i, s, rules.STAGE_LABELS[s]) for i, s in enumerate(rules.STAGE_ORDER)], "pos int, stage string, label string")
    counts = stages.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counts, "stage", "left").na.fill(0, ["n"])


def stage_banner(stage: Column | str, at: Column | str) -> Column:
    text = v.lookup(rules.STAGE_BANNERS, v.col(stage))
    day = F.coalesce(F.date_format(v.col(at), "yyyy-MM-dd"), F.lit(rules.NO_DATE))
    return F.replace(text, F.lit("{date}"), day)


def panel_text(stage: Column | str, kind: Column | str, alp_listed: Column) -> Column:
    stage = v.col(stage)
    alone = (v.col(kind) == "master_plan") & alp_listed & ~stage.isin("untouched", "published")
    empty = F.coalesce(v.lookup(rules.PANEL_EMPTY, stage), F.lit(rules.PANEL_EMPTY["untouched"]))
    return F.when(alone, rules.PANEL_ALONE).otherwise(empty)


def ranked_work(entities: DataFrame, funded: DataFrame, status: DataFrame, published: DataFrame,
                now: Column, days: int = rules.RECENCY_DAYS) -> DataFrame:
    """Entities in the order they should be visited, with their tier.

    The order is a range sort over the whole table, never one task.
    """
    joined = (
        entities.join(funded.select(F.col("entity").alias("key"), "funded"), "key", "left")
        .join(status.withColumnRenamed("entity", "key"), "key", "left")
        .join(published.select("key").distinct().withColumn("_published", F.lit(True)), "key", "left"))
    seen = last_evaluated()
    is_recent = v.yes(seen >= now - F.expr(f"interval {days} days"))
    has_money = F.col("funded").isNotNull()
    tier = (
        F.when(F.col("_published"), rules.TIER_PUBLISHED).when(no_plan_found(), rules.TIER_NO_PLAN)
        .when(~is_recent, F.when(has_money, rules.TIER_FUNDED_STALE).otherwise(rules.TIER_STALE))
        .otherwise(F.when(has_money, rules.TIER_FUNDED_RECENT).otherwise(rules.TIER_RECENT))
    )
    return (
        joined.withColumn("tier", tier)
        .withColumn("never", F.when(seen.isNull(), 0).otherwise(1))
        .withColumn("funded", F.coalesce("funded", F.lit(0)))
        .select("key", "region", "in_registry", "tier", "never", "funded")
        .orderBy("tier", "never", F.col("funded").desc(), F.when(F.col("in_registry"), 0).otherwise(1),
                 F.upper(F.coalesce(F.col("region").cast("string"), F.lit(""))), "key")
    )


def next_jobs(jobs: DataFrame, now: Column, limit: int, busy: DataFrame | None = None) -> DataFrame:
    """Pending jobs by aged priority: priority plus whole hours waited.

    Jobs: id, entity, parent_id, state, priority, created_at, seq. A parent must have
    succeeded; jobs of busy entities wait.
    """
    done = jobs.filter(F.col("state") == "succeeded").select(F.col("id").alias("parent_id"), F.lit(True).alias("_done"))
    open_jobs = jobs.filter(F.col("state") == "pending").join(done, "parent_id", "left")
    ready = open_jobs.filter(F.col("parent_id").isNull() | F.col("_done")).drop("_done")
    if busy is not None:
        ready = ready.join(busy.select("entity"), "entity", "left_anti")
    waited = F.floor((F.unix_seconds(now) - F.unix_seconds(F.col("created_at"))) / 3600)
    return ready.withColumn("aged", (F.col("priority") + waited).cast("long")).orderBy(
        F.col("aged").desc(), "seq").limit(limit)


def next_per_entity(jobs: DataFrame, seq: str, limit: int) -> DataFrame:
    """First jobs in order, one per entity; jobs without an entity all count."""
    free = jobs.filter(F.col("entity").isNull())
    rest = [c for c in jobs.columns if c not in ("entity",)]
    one = jobs.filter(F.col("entity").isNotNull()).groupBy("entity").agg(
        F.min_by(F.struct(*rest), F.col(seq)).alias("_row")).select("entity", "_row.*")
    return one.unionByName(free.select("entity", *rest)).orderBy(seq).limit(limit)


def batches(df: DataFrame, order: str, size: int, tie: Sequence[str] = ()) -> DataFrame:
    """Batch number of every row in order, without a single-task window."""
    placed = ordered_position(df, order, tie, name="_position")
    return placed.withColumn("batch", F.floor((F.col("_position") - 1) / size).cast("long")).drop("_position")


def rotating_slice(df: DataFrame, order: str, start: int, size: int) -> DataFrame:
    """`size` rows from a cursor on, wrapping round; with the place in the slice."""
    placed = ordered_position(df, order, name="_position")
    whole = df.agg(F.count(F.lit(1)).alias("_n"))
    # A single row of totals.
    joined = placed.join(F.broadcast(whole))
    place = F.pmod(F.col("_position") - 1 - F.pmod(F.lit(start), F.col("_n")), F.col("_n"))
    return joined.withColumn("place", place.cast("long")).filter(F.col("place") < size).drop("_position", "_n")


# --- quotas and readiness ---------------------------------------------------------

def provider_table(spark, providers: Sequence[rules.Provider] = rules.PROVIDERS) -> DataFrame:
    return spark.createDataFrame([(p.name, p.monthly_cap()) for p in providers], "provider string, cap long")


def quota_meter(charges: DataFrame, caps: DataFrame, reserve: int = 0) -> DataFrame:
    """Charged, remaining and exhausted per provider and month.

    Charges past the cap are refused, so charged never exceeds it.
    """
    counted = charges.groupBy("provider", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("asked"), F.max("at").alias("last_at"))
    joined = counted.join(caps, "provider")
    charged = F.least("asked", "cap")
    left = F.greatest(F.col("cap") - charged, F.lit(0))
    return joined.select(
        "provider", "month", "asked", charged.alias("charged"), "cap", left.alias("remaining"),
        (left <= reserve).alias("exhausted"), "last_at")


def quota_drift(meter: DataFrame, reported: DataFrame) -> DataFrame:
    """Own count against the use a provider reports; null where it reports nothing."""
    return meter.join(reported.select("provider", "month", "used"), ["provider", "month"], "left").withColumn(
        "drift", F.col("charged") - F.col("used"))


def rate_limit(policy: Column | str, limits: Column | str, left: Column | str, resets: Column | str) -> Column:
    """Longest window of aligned rate-limit headers; null when they do not align."""
    def ints(c: Column | str) -> Column:
        parts = F.transform(F.split(F.coalesce(v.col(c), F.lit("")), ","), lambda x: F.trim(x).try_cast("long"))
        return F.filter(parts, lambda x: x.isNotNull())

    text = F.coalesce(v.col(policy), F.lit(""))
    pattern = F.lit(r"(\d+);w=(\d+)")
    limit = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: x.cast("long"))
    window = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda x: x.cast("long"))
    remaining, reset = ints(left), ints(resets)
    rows = F.transform(
        F.sequence(F.lit(0), F.size(window) - 1),
        lambda i: F.struct(
            F.get(window, i).alias("window"), (-i).alias("early"), F.get(limit, i).alias("limit"),
            F.get(remaining, i).alias("remaining"), F.get(reset, i).alias("reset"),
            F.greatest(F.get(limit, i) - F.get(remaining, i), F.lit(0)).alias("used")))
    aligned = (F.size(window) > 0) & (F.size(ints(limits)) == F.size(window)) & (F.size(remaining) == F.size(window))
    return F.when(aligned, F.array_max(rows))


def dataset_fault(allow_stale: bool = True) -> Column:
    """First reason a dataset cannot be used, null when it can."""
    status = F.coalesce("status", F.lit("missing"))
    name = F.concat(F.col("name"), F.lit(": "))
    return (
        F.when(status == "building", F.concat(name, F.lit("building")))
        .when(status == "failed", F.concat(name, F.lit("failed ("), F.coalesce(v.first_text("error"), F.lit("unknown")), F.lit(")")))
        .when((status == "missing") | ~v.yes(F.col("available")), F.concat(name, F.lit("missing")))
        .when((status == "stale") & F.lit(not allow_stale), F.concat(name, F.lit("stale")))
        .when(~status.isin(*rules.USABLE), F.concat(name, status))
        .when(~F.coalesce(F.col("healthy"), F.lit(True)), F.concat(name, F.lit("unhealthy")))
    )


def readiness(jobs: DataFrame, datasets: DataFrame, allow_stale: bool = True) -> DataFrame:
    """Whether a job's datasets and their upstream ones can be used, with the first reason.

    Jobs: job, requires array. Datasets: name, depends_on array, status, available,
    healthy, error. Upstream datasets are asked before the one that needs them.
    """
    need = jobs.select("job", F.posexplode("requires").alias("pos", "dataset"))
    own = need.select("job", "pos", F.lit(1).alias("own"), F.lit(0).alias("sub"), F.col("dataset").alias("name"))
    deps = datasets.select(F.col("name").alias("dataset"), F.posexplode("depends_on").alias("sub", "name"))
    up = need.join(deps, "dataset").select("job", "pos", F.lit(0).alias("own"), "sub", "name")
    asked = own.unionByName(up).join(datasets, "name", "left").withColumn("fault", dataset_fault(allow_stale))
    return asked.groupBy("job").agg(
        F.bool_and(F.col("fault").isNull()).alias("ready"),
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.struct("pos", "own", "sub"))).alias("reason"))


# --- reports -----------------------------------------------------------------------

def document_profile(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value of several columns in one pass; null counts as unset."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unset")).alias("value")) for c in columns])
    return docs.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def stale_keys(rows: DataFrame, stale: Column, empty: Column, limit: int = 200) -> DataFrame:
    """First stale and first empty keys in order, up to a limit each, with the full counts."""
    tagged = rows.select("entity", F.explode(F.array_compact(F.array(
        F.when(stale, "stale"), F.when(empty, "empty")))).alias("fault"))
    counts = tagged.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("fault").orderBy("entity"))
    top = tagged.withColumn("pos", rank).filter(F.col("pos") <= limit)
    return top.join(counts, "fault")


def catalogue_counts(entities: DataFrame, docs: DataFrame, grants: DataFrame, stages: DataFrame,
                     regions: DataFrame, budgets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Headline figures of the whole catalogue in one row.

    Budgets: region, total. Each table is read once into a single-row aggregate; the
    rows are put side by side, so no side of these joins is larger than one row.
    """
    status = doc.best_completeness(entities, docs)
    per_status = status.agg(
        F.count(F.lit(1)).alias("entities"),
        *[F.count_if(F.col("completeness") == s).alias(f"entities_{s}") for s in doc_rules.COMPLETENESS_RANK])
    seen = doc.listed("review_status")
    per_docs = docs.agg(
        F.count_if(seen).alias("documents_listed"),
        F.count_if(seen & (F.col("completeness") == "complete")).alias("documents_complete"),
        F.count_if(seen & (F.col("completeness") == "complete")).alias("saved_copies"),
        F.count_if(seen & (F.col("completeness") == "link_only")).alias("documents_link_only"),
        F.count_if(seen & F.col("kind").isin("statute", "sasp")).alias("statutes"),
        F.countDistinct(F.when(seen & (F.col("kind") == "master_plan"), F.col("entity"))).alias("entities_with_master_plan"),
        F.countDistinct(F.when(seen & (F.col("kind") == "alp"), F.col("entity"))).alias("entities_with_alp"))
    base = v.first_number("obligated", "amount")

    def money(level: str) -> list[Column]:
        at = F.col("level") == level
        return [F.coalesce(F.sum(F.when(at, base)), F.lit(0)).alias(f"funding_{level}"),
                F.countDistinct(F.when(at, F.col("entity"))).alias(f"funding_{level}_entities")]

    per_grants = grants.agg(F.count(F.lit(1)).alias("grants"), *money("federal"), *money("local"))
    per_stage = stages.agg(
        F.sum("n").alias("_stages"),
        F.sum(F.when(F.col("stage") == "untouched", F.col("n")).otherwise(0)).alias("_untouched"),
        F.sum(F.when(F.col("stage") == "snapshot_pending", F.col("n")).otherwise(0)).alias("snapshot_pending"),
        F.sum(F.when(F.col("stage").isin("searched", "explored"), F.col("n")).otherwise(0)).alias("searched"))
    per_budget = budgets.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("funding_state_budget_total"),
        F.countDistinct("region").alias("funding_states_with_budgets"))
    per_job = jobs.agg(*[F.count_if(F.col("state") == s).alias(f"queue_{s}") for s in ("pending", "active")])
    one = per_status.withColumn("entities_with_plans", F.col("entities_complete"))
    for other in (per_docs, per_grants, per_stage, regions.agg(F.count(F.lit(1)).alias("states")), per_budget, per_job):
        one = one.join(F.broadcast(other))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, v.half_even(100 * part / whole))

    return (
        one.withColumn("pct_reviewed", share(F.col("_stages") - F.col("_untouched"), F.col("_stages")))
        .withColumn("pct_master_plan", share(F.col("entities_with_master_plan"), F.col("entities")))
        .withColumn("pct_alp", share(F.col("entities_with_alp"), F.col("entities")))
        .drop("_stages", "_untouched"))


def first_jobs(jobs: DataFrame, limit: int = rules.SHOWN_JOBS) -> DataFrame:
    """One row with the first jobs in order as an array; no longer than the limit."""
    top = jobs.orderBy("seq").limit(limit)
    return top.agg(F.array_sort(F.collect_list(F.struct("seq", "id", "entity"))).alias("jobs"))


def snapshot_report(jobs: DataFrame, stages: DataFrame, status: DataFrame, live_rejects: DataFrame,
                    scoped: DataFrame) -> DataFrame:
    """One status row: job counts, active and next jobs, scope, coverage, last job, live rejects.

    Of the active jobs the first SHOWN_JOBS are named, `jobs_active` counts them all; the
    next jobs are the first pending ones, one per entity (`next_per_entity`). Scoped: the
    entities in the search scope.
    """
    counts = jobs.agg(*[F.count_if(F.col("state") == s).alias(f"jobs_{s}") for s in ("pending", "active", "succeeded", "failed")])
    cover = stages.agg(*[
        F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("n"))), F.lit(0)).alias(f"stage_{s}") for s in rules.STAGES])
    last = status.agg(F.max(F.struct(F.col("last_job_at").alias("at"), "entity", F.col("last_job_kind").alias("kind"), F.col("last_job_status").alias("status"))).alias("_l"))
    last = last.select(*[F.col(f"_l.{c}").alias(f"last_job_{c}") for c in ("at", "entity", "kind", "status")])
    gone = live_rejects.agg(F.count(F.lit(1)).alias("live_rejects"))
    waiting = jobs.filter("state = 'pending'").select("entity", "id", "seq")
    following = first_jobs(next_per_entity(waiting, "seq", rules.SHOWN_JOBS)).withColumnRenamed("jobs", "next_jobs")
    running = first_jobs(jobs.filter("state = 'active'")).withColumnRenamed("jobs", "active_jobs")
    wide = scoped.agg(F.count(F.lit(1)).alias("scoped_entities"))
    out = counts
    for one_row in (cover, last, gone, following, running, wide):
        out = out.join(F.broadcast(one_row))
    return out


def kinds_in(state: str) -> Column:
    """Aggregate: kinds of the jobs in a state, in order; kinds are few."""
    return F.array_sort(F.collect_set(F.when(F.col("state") == state, F.col("kind"))))


def health_report(jobs: DataFrame, datasets: DataFrame, requires: Sequence[str], critical: str,
                  worker_log: DataFrame, live_rejects: DataFrame) -> DataFrame:
    """One row: whether the next search can run, what blocks it, and how the worker does.

    Jobs: state, kind. Datasets as in `readiness`. The search needs the datasets
    `requires`; a fault of the dataset `critical` blocks as well, named once. The worker
    is wedged when jobs are active, none waits and its log has no line.
    """
    spark = jobs.sparkSession
    job = spark.createDataFrame([("search", list(requires))], "job string, requires array<string>")
    # One row, also when nothing is required.
    ready = readiness(job, datasets).agg(
        F.coalesce(F.bool_and("ready"), F.lit(True)).alias("search_ready"), F.min("reason").alias("detail"))
    one = spark.createDataFrame([(critical,)], "name string").join(datasets, "name", "left").select(dataset_fault().alias("_critical"))
    queue = jobs.agg(
        F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "active").alias("active"),
        kinds_in("pending").alias("pending_kinds"), kinds_in("active").alias("active_kinds"))
    out = ready
    for row in (one, queue, worker_log.agg(F.count(F.lit(1)).alias("worker_lines")), live_rejects.agg(F.count(F.lit(1)).alias("live_rejects"))):
        out = out.join(F.broadcast(row))
    wedged = (F.col("active") > 0) & (F.col("pending") == 0) & (F.col("worker_lines") == 0)
    return (
        out.withColumn("blocking", F.array_distinct(F.array_compact(F.array("detail", "_critical"))))
        .withColumn("worker_ok", ~wedged)
        .withColumn("worker_detail", F.when(wedged, rules.WEDGED))
        .withColumn("ok", F.col("search_ready") & F.col("worker_ok")).drop("_critical"))


def spot_check(grants: DataFrame) -> DataFrame:
    """Rows a model put in the other category, for a human look."""
    return grants.filter((F.col("spend_classifier") == "llm") & (F.col("spend_category") == "other"))
