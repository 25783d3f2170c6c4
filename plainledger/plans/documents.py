"""Document queries over texts, labels, conversations, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plainledger.functions import html, urls
from plainledger.operators import documents as ops
from plainledger.operators import funding
from plainledger.plans import bindings as b
from plainledger.plans.bindings import BLANKS_SQL, DOCS_SQL, GRANTS_SQL, briefing_sql, normal_sql


def slim(spark, sf):
    return b.documents(spark, sf).drop("text", "n_text")


def document_visibility(spark, sf):
    return slim(spark, sf).select(
        "id", ops.listed("review_status").alias("listed"),
        ops.feed_visible("review_status", "kind", "completeness").alias("in_feed"),
        ops.verified_plan("review_status", "kind", "completeness").alias("verified"),
        ops.pending_plan("review_status", "kind", "completeness").alias("pending"),
        ops.is_whole_work().alias("whole"), ops.is_volume().alias("volume"),
        urls.inferred_media("media", "source_url").alias("media"),
        urls.media_for("source_url").alias("link_media"),
    )


def document_roots(spark, sf):
    return ops.hierarchy_roots(slim(spark, sf))


def _members(spark, sf):
    docs = slim(spark, sf)
    # German texts head their own chains, so a work can span several sources.
    return ops.edition_members(docs, ops.hierarchy_roots(docs))


def document_editions(spark, sf):
    works = ops.edition_works(_members(spark, sf))
    return works.select("entity", "kind", "study_year", "n_documents", "hub_id", "title", "edition", "summary", "work_rank")


def document_work_parts(spark, sf):
    members = _members(spark, sf)
    return ops.work_parts(members, ops.edition_works(members))


def document_best_completeness(spark, sf):
    docs = slim(spark, sf)
    entities = docs.select(F.col("entity").alias("key")).distinct()
    return ops.best_completeness(entities, docs)


def document_verified_entities(spark, sf):
    docs = slim(spark, sf)
    entities = docs.select(F.col("entity").alias("key"), "region").distinct()
    return ops.entities_with_verified_plans(entities, docs)


def document_entities_with_data(spark, sf):
    docs = slim(spark, sf)
    grants = b.table(spark, sf, "lineitem").select(F.concat(F.lit("src"), "l_suppkey").alias("entity"))
    return ops.entities_with_data(docs, grants)


def document_page_order(spark, sf):
    return ops.page_order(slim(spark, sf)).select("entity", "kind_rank", "name", "id")


def document_twins(spark, sf):
    docs = b.documents(spark, sf).select(
        "id", "seq", F.col("region").alias("entity"), html.text_hash("text").alias("text_sha256"),
        F.sha2(F.lit(""), 256).alias("images_sha256"))
    return ops.content_twins(docs)


def document_prior_editions(spark, sf):
    return ops.prior_editions(slim(spark, sf).withColumn("part_of", F.lit(None).cast("long")))


def document_changes(spark, sf):
    """Each turn of a conversation is the next version of the one before it."""
    turns = b.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.sha2("text", 256).alias("content_sha256"),
        html.text_hash("text").alias("text_sha256"), F.sha2("role", 256).alias("images_sha256"))
    ident = F.concat_ws("-", "conv_id", "turn")
    incoming = turns.withColumn("id", ident).drop("conv_id", "turn")
    current = turns.withColumn("id", F.concat_ws("-", F.col("conv_id"), F.col("turn") + 1)).drop("conv_id", "turn")
    return ops.change_events(current, incoming)


def document_review_requests(spark, sf):
    docs = slim(spark, sf)
    wanted = (
        F.when(F.col("kind") == "alp", "curated").when(F.col("kind") == "notice", "bogus").otherwise("published"))
    expected = F.when(F.col("source_status") == "dead", F.lit("0")).otherwise(F.col("content_sha256"))
    requests = docs.select("id", wanted.alias("requested"), expected.alias("expected_sha256"))
    return ops.apply_reviews(requests, docs).select("id", "requested", "outcome", "review_status")


def document_review_rules(spark, sf):
    docs = slim(spark, sf)
    status, fault = ops.review_transition(F.col("review_status"), F.when(F.col("kind") == "alp", "operator").otherwise("machine"))
    return docs.select(
        "id", ops.review_after_snapshot("review_status").alias("after_snapshot"),
        ops.review_after_vet(F.col("completeness") == "complete", F.col("source_status") == "live", F.col("kind")).alias("after_vet"),
        status.alias("status"), fault.alias("error"))


def document_source_issues(spark, sf):
    docs = slim(spark, sf)
    failures = docs.select(
        "id", F.lit("2024-02-01").alias("at"), F.lit("not a plan").alias("issue"),
        F.lit("changed_rejected").alias("source_status"),
        F.when(F.col("kind") == "alp", F.col("content_sha256")).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("candidate_sha256"))
    return ops.source_issues(failures, docs)


def document_supersedes(spark, sf):
    docs = slim(spark, sf).withColumn("supersedes", F.col("part_of"))
    return ops.visible_supersedes(docs).select("id", "supersedes")


def document_preview(spark, sf):
    return slim(spark, sf).withColumn("p", ops.preview(official=True)).select("id", "p.src", "p.media", "p.origin")


def document_incremental_overview(spark, sf):
    """Briefings stored per user at their first event; last month's are recomputed."""
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    grants = b.grants(spark, sf)
    stored = b.table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(
        F.min("ts").cast("timestamp").alias("generated_at"), F.count(F.lit(1)).alias("n"))
    stored = stored.select("entity", "n", F.lit(None).cast("long").alias("total"), "generated_at")

    def fresh(keys):
        rows = funding.briefing(grants.join(keys, "entity", "left_semi"), ["entity"])
        return rows.select("entity", "n", "total", now.alias("generated_at"))

    out = ops.recompute_stale(grants.select("entity"), stored, fresh, now)
    return out.withColumn("generated_at", F.date_format("generated_at", "yyyy-MM-dd HH:mm"))


QUERIES = {f.__name__: f for f in (
    document_visibility, document_roots, document_editions, document_work_parts,
    document_best_completeness, document_verified_entities, document_entities_with_data,
    document_page_order, document_twins, document_prior_editions, document_changes,
    document_review_requests, document_review_rules, document_source_issues, document_supersedes,
    document_preview, document_incremental_overview,
)}

W = "WITH " + DOCS_SQL
BLOB = "replace(replace(lower(coalesce(title, '') || ' ' || id), '_', ' '), '-', ' ')"
CHAPTER = f"regexp_matches({BLOB}, 'inventory|forecast|alternative|facility requirement|implementation|introduction|chapter|appendix')"
VOLUME = f"regexp_matches({BLOB}, 'existing condition|inventory|chapter|sheet|appendix|forecast|alternative|facility requirement|implementation|introduction|table of contents')"
WHOLE = f"(kind IN ('master_plan', 'alp') AND part_of IS NULL AND NOT {CHAPTER})"

ROOTS_SQL = """
walk(id, node) AS (
  SELECT id, id FROM docs
  UNION ALL
  SELECT w.id, d.part_of FROM walk w JOIN docs d ON d.id = w.node WHERE d.part_of IS NOT NULL),
roots AS (SELECT w.id, w.node AS root FROM walk w JOIN docs d ON d.id = w.node WHERE d.part_of IS NULL)"""

# Ids hold no four-digit part unless they are four digits long.
YEAR = "CASE WHEN length(CAST({0}.id AS VARCHAR)) = 4 THEN CAST({0}.id AS INTEGER) ELSE {0}.edition_year END"

MEMBERS_SQL = f"""{ROOTS_SQL},
members AS (SELECT d.*, coalesce(nullif({YEAR.format('p')}, 0), {YEAR.format('d')}) AS study_year,
    {WHOLE.replace('title', 'd.title').replace(' id', ' d.id').replace('part_of', 'd.part_of').replace('(kind', '(d.kind')} AS whole,
    {VOLUME.replace('title', 'd.title').replace(' id', ' d.id')} AS volume,
    row(coalesce(CAST(d.published_at AS VARCHAR), ''), d.edition_year, coalesce(CAST(d.retrieved_at AS VARCHAR), ''),
        coalesce(d.edition, ''), coalesce(nullif(d.title, ''), CAST(d.id AS VARCHAR))) AS recency
  FROM docs d JOIN roots r ON r.id = d.id JOIN docs p ON p.id = r.root WHERE d.kind IN ('master_plan', 'alp')),
hubs AS (
  SELECT entity, kind, study_year, id, title, edition, summary FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, kind, study_year ORDER BY volume, recency DESC, id) AS rn
    FROM members WHERE whole) WHERE rn = 1),
bare AS (SELECT *, trim(regexp_replace(trim(coalesce(title, '')), '(?i)\\s+(?:chapters?\\s+\\d+(?:\\s*-\\s*\\d+)?\\b.*|appendix\\s+[a-z]\\b.*|introduction\\b.*)$', ''), ' -') AS bt FROM members),
tn AS (SELECT entity, kind, study_year, coalesce(nullif(bt, ''), nullif(trim(title), ''), CAST(id AS VARCHAR)) AS name, count(*) AS n, min(id) AS f FROM bare GROUP BY ALL),
tm AS (SELECT entity, kind, study_year, name FROM (SELECT *, row_number() OVER (PARTITION BY entity, kind, study_year ORDER BY n DESC, f) AS rn FROM tn) WHERE rn = 1),
en AS (SELECT entity, kind, study_year, edition, count(*) AS n, min(id) AS f FROM members WHERE edition IS NOT NULL GROUP BY ALL),
em AS (SELECT entity, kind, study_year, edition FROM (SELECT *, row_number() OVER (PARTITION BY entity, kind, study_year ORDER BY n DESC, f) AS rn FROM en) WHERE rn = 1),
works AS (SELECT entity, kind, study_year, count(*) AS n_documents, max(recency) AS recency FROM members GROUP BY ALL)"""

MONTH = "date_trunc('month', ({0})::TIMESTAMP - INTERVAL 8 HOUR)"

ORACLE = {
    "document_visibility": f"""{W}
SELECT id, listed, listed AND (kind = 'notice' OR completeness = 'complete') AS in_feed,
  listed AND kind IN ('master_plan', 'alp') AND completeness = 'complete' AS verified,
  review_status = 'pending' AND kind <> 'notice' AND completeness = 'complete' AS pending,
  {WHOLE} AS whole, {VOLUME} AS volume,
  CASE WHEN n_chars > 900 THEN 'pdf' ELSE 'html' END AS media, CASE WHEN n_chars > 900 THEN 'pdf' ELSE 'html' END AS link_media
FROM docs""",
    "document_roots": f"WITH RECURSIVE {DOCS_SQL}, {ROOTS_SQL} SELECT * FROM roots",
    "document_editions": f"""WITH RECURSIVE {DOCS_SQL}, {MEMBERS_SQL}
SELECT w.entity, w.kind, w.study_year, n_documents, h.id AS hub_id, coalesce(nullif(h.title, ''), tm.name) AS title,
  coalesce(h.edition, em.edition) AS edition, h.summary,
  row_number() OVER (PARTITION BY w.entity, w.kind ORDER BY recency DESC, w.study_year DESC) AS work_rank
FROM works w LEFT JOIN hubs h USING (entity, kind, study_year) LEFT JOIN tm USING (entity, kind, study_year)
LEFT JOIN em USING (entity, kind, study_year)""",
    "document_work_parts": f"""WITH RECURSIVE {DOCS_SQL}, {MEMBERS_SQL}
SELECT entity, kind, study_year, id,
  CASE WHEN {BLOB} LIKE '%chapter %' THEN 1 WHEN {BLOB} LIKE '%introduction%' THEN 0 WHEN {BLOB} LIKE '%appendix %' THEN 3 ELSE 2 END AS part_group,
  CAST(CASE WHEN {BLOB} LIKE '%chapter %' THEN n_chars % 12 WHEN {BLOB} LIKE '%introduction%' THEN 1 WHEN {BLOB} LIKE '%appendix %' THEN 98 ELSE 50 END AS BIGINT) AS part_number,
  coalesce(nullif(title, ''), CAST(id AS VARCHAR)) AS part_name
FROM members WHERE id NOT IN (SELECT id FROM hubs)""",
    "document_best_completeness": f"""{W},
r AS (SELECT entity, completeness, CASE completeness WHEN 'complete' THEN 4 WHEN 'link_only' THEN 3 WHEN 'preserved_only' THEN 2
        WHEN 'no_plan_known' THEN 1 ELSE 0 END AS k FROM docs WHERE listed AND kind IN ('master_plan', 'alp'))
SELECT e.entity, coalesce((SELECT arg_max(completeness, k) FROM r WHERE r.entity = e.entity), 'missing') AS completeness
FROM (SELECT DISTINCT entity FROM docs) e""",
    "document_verified_entities": f"""{W}
SELECT DISTINCT entity AS key, region FROM docs WHERE entity IN
  (SELECT entity FROM docs WHERE listed AND kind IN ('master_plan', 'alp') AND completeness = 'complete')""",
    "document_entities_with_data": f"""{W}
SELECT entity FROM docs WHERE kind IN ('master_plan', 'alp') UNION SELECT 'src' || l_suppkey FROM lineitem""",
    "document_page_order": f"""{W}
SELECT entity, CASE kind WHEN 'alp' THEN 0 WHEN 'master_plan' THEN 1 WHEN 'other' THEN 2 ELSE 9 END AS kind_rank,
  coalesce(nullif(title, ''), CAST(id AS VARCHAR)) AS name, id FROM docs WHERE listed""",
    "document_twins": f"""WITH h AS (SELECT doc_id AS id, lang, sha256({normal_sql('text')}) AS t FROM documents),
m AS (SELECT *, min(id) OVER (PARTITION BY lang, t) AS twin_id FROM h)
SELECT id, twin_id FROM m WHERE id <> twin_id""",
    "document_prior_editions": f"""{W},
w AS (SELECT * FROM docs WHERE kind IN ('master_plan', 'alp') AND NOT {CHAPTER}),
u AS (SELECT entity, kind, source_url, max(row(coalesce(edition, ''), CAST(retrieved_at AS VARCHAR), -id)) AS age,
        arg_max(id, row(coalesce(edition, ''), CAST(retrieved_at AS VARCHAR), -id)) AS pid FROM w GROUP BY ALL),
c AS (SELECT w.id, u.pid, row_number() OVER (PARTITION BY w.id ORDER BY u.age DESC) AS rn
      FROM w JOIN u ON u.entity = w.entity AND u.kind = w.kind AND u.source_url <> w.source_url)
SELECT w.id, c.pid AS prior_id FROM w LEFT JOIN c ON c.id = w.id AND c.rn = 1""",
    "document_changes": f"""WITH t AS (SELECT conv_id, turn, sha256(text) AS c, sha256({normal_sql('text')}) AS x, sha256(role) AS i FROM conversations)
SELECT n.conv_id || '-' || n.turn || '-' || substr(n.c, 1, 12) AS event_id, n.conv_id || '-' || n.turn AS document_id,
  o.c AS from_sha256, n.c AS to_sha256,
  CASE WHEN o.x <> n.x OR o.i <> n.i THEN 'Text or drawings changed at the official URL.'
       ELSE 'Official file was replaced; text and drawings are unchanged.' END AS note
FROM t n JOIN t o ON o.conv_id = n.conv_id AND o.turn + 1 = n.turn WHERE o.c <> n.c""",
    "document_review_requests": f"""{W},
r AS (SELECT *, CASE kind WHEN 'alp' THEN 'curated' WHEN 'notice' THEN 'bogus' ELSE 'published' END AS requested FROM docs),
o AS (SELECT id, requested, CASE WHEN requested = 'bogus' THEN 'invalid'
    WHEN requested = 'curated' THEN CASE WHEN completeness = 'link_only' THEN 'accepted' ELSE 'invalid' END
    WHEN completeness <> 'complete' THEN 'invalid' WHEN source_status = 'dead' THEN 'stale_review' ELSE 'accepted' END AS outcome FROM r)
SELECT *, CASE WHEN outcome = 'accepted' THEN requested END AS review_status FROM o""",
    "document_review_rules": f"""{W}
SELECT id, CASE WHEN review_status IN ('published', 'auto_pass', 'needs_human') THEN review_status ELSE 'pending' END AS after_snapshot,
  CASE WHEN kind IN ('master_plan', 'alp') AND completeness = 'complete' AND source_status = 'live' THEN 'auto_pass' ELSE 'pending' END AS after_vet,
  CASE WHEN kind = 'alp' OR review_status IN ('pending', 'auto_pass') THEN review_status END AS status,
  CASE WHEN kind <> 'alp' AND review_status NOT IN ('pending', 'auto_pass') THEN 'machine cannot set review status: ' || review_status END AS error
FROM docs""",
    "document_source_issues": f"""{W}
SELECT id, 'changed_rejected' AS source_status, '2024-02-01' AS source_retrieved_at,
  CASE WHEN kind <> 'alp' THEN sha256(CAST(id AS VARCHAR)) END AS source_candidate_sha256, 'not a plan' AS source_issue
FROM docs WHERE listed""",
    "document_supersedes": f"""{W}
SELECT d.id, CASE WHEN t.listed THEN d.part_of END AS supersedes FROM docs d LEFT JOIN docs t ON t.id = d.part_of""",
    "document_preview": f"""{W},
m AS (SELECT *, CASE WHEN n_chars > 900 THEN 'pdf' ELSE 'html' END AS md FROM docs),
o AS (SELECT *, CASE WHEN kind = 'notice' THEN NULL WHEN preserved_url IS NOT NULL THEN 'saved'
        WHEN md = 'pdf' AND source_status <> 'dead' THEN 'official' END AS origin FROM m)
SELECT id, CASE origin WHEN 'saved' THEN preserved_url || CASE WHEN md = 'pdf' THEN '#zoom=page-width' ELSE '' END
    WHEN 'official' THEN '/files/preview/' || id || '.pdf#zoom=page-width' END AS src,
  CASE WHEN origin IS NOT NULL THEN md END AS media, origin FROM o""",
    "document_incremental_overview": f"""WITH {GRANTS_SQL},
s AS (SELECT user_id AS entity, min(ts) AS g, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT *, {MONTH.format('g')} = DATE '2024-01-01' AS fresh FROM s),
k AS (SELECT DISTINCT entity FROM grants),
due AS (SELECT entity FROM k WHERE entity NOT IN (SELECT entity FROM t WHERE fresh)),
f AS (SELECT entity, {briefing_sql()} FROM grants WHERE entity IN (SELECT entity FROM due) GROUP BY entity)
SELECT entity, n, CAST(NULL AS BIGINT) AS total, strftime(g, '%Y-%m-%d %H:%M') AS generated_at FROM t
WHERE entity NOT IN (SELECT entity FROM due)
UNION ALL SELECT entity, n, total, '2024-01-15 12:00' FROM f""",
}
