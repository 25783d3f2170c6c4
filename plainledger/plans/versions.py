"""Versioned-table queries: yearly generations of customer totals, patches, scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plainledger.functions import values as v
from plainledger.operators import documents as doc
from plainledger.operators import versions as ops
from plainledger.plans import bindings as b
from plainledger.plans.bindings import DOCS_SQL
from plainledger.sources import exports
from plainledger.session import run_dir


def generations(spark, sf):
    """Customer totals as they stood at each year's end, one generation per year.

    Years are summed per customer before they are repeated for the later generations.
    """
    orders = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("year"), v.half_even("o_totalprice").alias("amount"))
    years = orders.filter("year is not null").groupBy("key", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    # One row: the last year of the data.
    last = years.agg(F.max("year").alias("_last"))
    upto = years.join(F.broadcast(last)).withColumn("generation", F.explode(F.sequence(F.col("year"), F.col("_last"))))
    sums = upto.groupBy("generation", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    named = sums.select("generation", *[F.col(c) for c in ("key", "n", "total")])
    payload = ops.canonical(["key", "n", "total"])
    return named.select(
        "generation", F.lit("customer").alias("entity_type"), F.col("key").cast("string").alias("entity_key"),
        payload.alias("payload"), F.sha2(payload, 256).alias("sha"))


def generation_history(spark, sf):
    return ops.version_history(generations(spark, sf))


def generation_versions(spark, sf):
    return ops.entity_versions(generations(spark, sf))


def generation_snapshot(spark, sf):
    rows = generations(spark, sf)
    return ops.snapshot(ops.memberships(rows), ops.entity_versions(rows), 1998)


def _pair(spark, sf):
    rows = generations(spark, sf)
    poor = b.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("entity_key"))
    old = rows.filter("generation = 1995").drop("generation")
    new = rows.filter("generation = 1996").drop("generation").join(poor, "entity_key", "left_anti")
    return old, new


def generation_diff(spark, sf):
    old, new = _pair(spark, sf)
    return ops.replace_diff(old, new)


def generation_apply(spark, sf):
    """The old snapshot plus the change set; it must equal the new snapshot."""
    old, new = _pair(spark, sf)
    return ops.apply_changes(old, ops.replace_diff(old, new))


def generation_equality(spark, sf):
    """Rows that tell two snapshots apart, with the side they are on."""
    rows = generations(spark, sf).select("generation", "entity_key", "sha")
    return ops.snapshots_equal(rows.filter("generation = 1995").drop("generation"), rows.filter("generation = 1996").drop("generation"))


def generation_duplicates(spark, sf):
    """Lines keyed by order and line number: keys that occur more than once."""
    lines = b.table(spark, sf, "lineitem").select(
        F.lit("line").alias("entity_type"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("entity_key"))
    return ops.duplicate_keys(lines)


def generation_export(spark, sf):
    """Generations written as files by generation and type, read back and counted."""
    rows = generations(spark, sf).withColumnRenamed("sha", "payload_sha256").withColumnRenamed("generation", "generation_id")
    path = run_dir(spark, "generation")
    exports.write_generation(rows, path)
    back = spark.read.schema("entity_key string, payload string, payload_sha256 string, generation_id int, entity_type string").json(f"{path}/rows")
    return back.groupBy("generation_id", "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("entity_key").alias("least"), F.max("payload_sha256").alias("last_sha"))


def table_digest_unchanged(spark, sf):
    """Orders in another partitioning and order have the same digest."""
    orders = b.table(spark, sf, "orders")
    return ops.unchanged(orders, orders.repartition(13, "o_custkey").sortWithinPartitions("o_totalprice"))


def table_digest_changed(spark, sf):
    orders = b.table(spark, sf, "orders")
    other = orders.withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")))
    return ops.unchanged(orders, other)


def entity_keys(spark, sf):
    """Orders keyed by clerk number where they have one, else by content hash."""
    rows = b.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("N"), "o_orderkey")).otherwise(" ").alias("number"))
    return ops.as_entities(rows, "grant", "number", ["o_custkey", "o_orderkey"]).select("entity_type", "entity_key", "sha")


def record_patches(spark, sf):
    """Customers patched by supplier rows: set, set to null, new, and too thin to be new."""
    current = b.entities(spark, sf).select("key", "name", "city", F.lit("missing").alias("completeness"))
    s = b.table(spark, sf, "part")
    patch = (
        F.when(F.col("p_size") < 10, F.concat(F.lit('{"city":"'), "p_type", F.lit('"}')))
        .when(F.col("p_size") < 20, F.lit('{"city":null,"completeness":"complete"}'))
        .when(F.col("p_size") < 40, F.concat(F.lit('{"name":"'), "p_name", F.lit('","city":"'), "p_brand", F.lit('"}')))
        .otherwise(F.lit('{"name":"thin"}')))
    updates = s.select(F.col("p_partkey").alias("key"), patch.alias("patch"))
    return ops.patch_rows(current, updates, "key", ["name", "city", "completeness"], ["name", "city"], {"completeness": "missing"})


def record_folded_patches(spark, sf):
    """Events of a user folded into one patch: the last value of every field."""
    kind = F.col("event_type")
    patch = F.when(kind == "view", F.concat(F.lit('{"seen":"'), "event_id", F.lit('"}'))).when(
        kind == "click", F.concat(F.lit('{"seen":"'), "event_id", F.lit('","name":null}'))).otherwise(
        F.concat(F.lit('{"name":"'), "event_type", F.lit('"}')))
    updates = b.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), patch.alias("patch"))
    return ops.last_patch(updates, "key", "seq")


def overlay_fallback(spark, sf):
    """An empty overlay leaves the suppliers; a filled one replaces the customers."""
    suppliers = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("src"))
    customers = b.entities(spark, sf).select("key", F.lit("customer").alias("src"))
    nothing = customers.filter("key < 0")
    return ops.fallback_table(nothing, suppliers).unionByName(ops.fallback_table(suppliers.withColumn("src", F.lit("overlay")), customers))


def revoked_documents(spark, sf):
    """Texts listed before that would not be listed under a stricter review."""
    docs = b.documents(spark, sf).drop("text")
    before = docs.filter(doc.listed("review_status"))
    after = before.filter(F.col("review_status") == "published")
    return ops.revoked(before, after, "id")


def artifact_reconcile(spark, sf):
    docs = b.documents(spark, sf).drop("text")
    expected = docs.filter(doc.listed("review_status")).select(F.col("content_sha256").alias("path"))
    present = docs.filter("completeness = 'complete'").select(F.col("content_sha256").alias("path"))
    return ops.reconcile(expected, present, "path")


def import_verdicts(spark, sf):
    """Lines imported by order and number; the import kept one row per key."""
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("entity_type"),
        F.when(F.col("l_quantity") > 2, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("entity_key"))
    return ops.import_check(lines, lines.filter("entity_key is not null").distinct())


def key_sets(spark, sf):
    """Customer ids against user ids: union, difference and intersection, counted."""
    a = b.entities(spark, sf).select("key")
    c = b.table(spark, sf, "events").select(F.col("user_id").alias("key"))
    parts = [
        a.union(c).distinct().withColumn("op", F.lit("union")), a.exceptAll(c.distinct()).withColumn("op", F.lit("difference")),
        a.intersect(c).withColumn("op", F.lit("intersection"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("total"))


def _changes(spark, sf):
    docs = b.documents(spark, sf).drop("text")
    named = docs.filter("source_status = 'dead'").select(F.lit("document").alias("page"), F.col("id").cast("string").alias("key"))
    entities = docs.filter("n_text > 20000").select(F.lit("entity").alias("page"), F.col("entity").alias("key")).distinct()
    return docs, named.unionByName(entities)


def _homes(docs):
    return docs.groupBy(F.col("entity").alias("key")).agg(F.min("region").alias("region"))


def rebuild_scope(spark, sf):
    docs, changes = _changes(spark, sf)
    return ops.impact_scope(changes, docs, _homes(docs))


def rebuild_documents(spark, sf):
    docs, changes = _changes(spark, sf)
    scope = ops.impact_scope(changes, docs, _homes(docs)).filter("page <> 'region'")
    return ops.wanted_documents(docs, scope)


QUERIES = {f.__name__: f for f in (
    generation_history, generation_versions, generation_snapshot, generation_diff, generation_apply,
    generation_equality, generation_duplicates, generation_export, table_digest_unchanged, table_digest_changed,
    entity_keys, record_patches, record_folded_patches, overlay_fallback, revoked_documents,
    artifact_reconcile, import_verdicts, key_sets, rebuild_scope, rebuild_documents,
)}

GEN_SQL = """
o AS (SELECT o_custkey AS key, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(round_even(o_totalprice, 0) AS BIGINT) AS amount FROM orders),
u AS (SELECT key, amount, CAST(unnest(range(y, (SELECT max(y) FROM o) + 1)) AS INTEGER) AS generation FROM o),
s AS (SELECT generation, key, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM u GROUP BY ALL),
gen AS (SELECT generation, 'customer' AS entity_type, CAST(key AS VARCHAR) AS entity_key, '{"key":' || key || ',"n":' || n || ',"total":' || total || '}' AS payload,
   sha256('{"key":' || key || ',"n":' || n || ',"total":' || total || '}') AS sha FROM s)"""

PAIR_SQL = GEN_SQL + """,
old AS (SELECT * FROM gen WHERE generation = 1995),
new AS (SELECT * FROM gen WHERE generation = 1996 AND entity_key NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0))"""

SCOPE_SQL = DOCS_SQL + """,
hm AS (SELECT entity AS key, min(region) AS region FROM docs GROUP BY 1),
cd AS (SELECT * FROM docs WHERE source_status = 'dead'),
ce AS (SELECT DISTINCT entity FROM docs WHERE length(text) > 20000),
he AS (SELECT entity FROM cd UNION SELECT entity FROM ce),
scope AS (SELECT 'document' AS page, CAST(id AS VARCHAR) AS key FROM cd UNION SELECT 'entity', entity FROM he UNION SELECT 'region', region FROM cd
  UNION SELECT 'region', region FROM hm JOIN he ON he.entity = hm.key)"""

ORACLE = {
    "generation_history": f"""WITH {GEN_SQL},
l AS (SELECT *, lag(sha) OVER (PARTITION BY entity_key ORDER BY generation) AS previous_sha FROM gen),
c AS (SELECT *, CASE WHEN previous_sha IS NULL THEN 'added' WHEN previous_sha <> sha THEN 'changed' ELSE 'same' END AS change FROM l)
SELECT generation, entity_type, entity_key, sha, previous_sha, change, CAST(sum(CASE WHEN change = 'same' THEN 0 ELSE 1 END) OVER (PARTITION BY entity_key ORDER BY generation) AS BIGINT) AS version FROM c""",
    "generation_versions": f"WITH {GEN_SQL} SELECT entity_type, entity_key, sha, any_value(payload) AS payload, min(generation) AS first_generation FROM gen GROUP BY ALL",
    "generation_snapshot": f"WITH {GEN_SQL} SELECT * FROM gen WHERE generation = 1998",
    "generation_diff": f"""WITH {PAIR_SQL}
SELECT 'customer' AS entity_type, coalesce(a.entity_key, b.entity_key) AS entity_key, a.sha AS old_sha, b.sha AS new_sha, b.payload,
  CASE WHEN a.sha IS NULL THEN 'inserted' WHEN b.sha IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM old a FULL JOIN new b ON a.entity_key = b.entity_key WHERE a.sha IS DISTINCT FROM b.sha""",
    "generation_apply": f"WITH {PAIR_SQL} SELECT entity_type, entity_key, sha, payload FROM new",
    "generation_equality": f"""WITH {GEN_SQL}, a AS (SELECT entity_key, sha FROM gen WHERE generation = 1995), b AS (SELECT entity_key, sha FROM gen WHERE generation = 1996)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "generation_duplicates": "SELECT 'line' AS entity_type, l_orderkey || '-' || l_linenumber AS entity_key, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1",
    "generation_export": f"WITH {GEN_SQL} SELECT generation AS generation_id, entity_type, count(*) AS n, min(entity_key) AS least, max(sha) AS last_sha FROM gen GROUP BY ALL",
    "table_digest_unchanged": "SELECT true AS same, count(*) AS n_before, count(*) AS n_after FROM orders",
    "table_digest_changed": "SELECT false AS same, count(*) AS n_before, count(*) AS n_after FROM orders",
    "entity_keys": """SELECT 'grant' AS entity_type, CASE WHEN o_orderstatus <> 'P' THEN 'N' || o_orderkey ELSE sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}') END AS entity_key,
  sha256('{"number":"' || CASE WHEN o_orderstatus <> 'P' THEN 'N' || o_orderkey ELSE ' ' END || '","o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}') AS sha FROM orders""",
    "record_patches": """WITH j AS (SELECT coalesce(c_custkey, p_partkey) AS key, c.*, p.* FROM customer c FULL JOIN part p ON p_partkey = c_custkey)
SELECT key, CASE WHEN p_size BETWEEN 20 AND 39 THEN p_name WHEN p_size >= 40 THEN 'thin' ELSE c_name END AS name,
  CASE WHEN p_size < 10 THEN p_type WHEN p_size < 20 THEN NULL WHEN p_size < 40 THEN p_brand ELSE c_mktsegment END AS city,
  CASE WHEN p_size BETWEEN 10 AND 19 THEN 'complete' ELSE 'missing' END AS completeness
FROM j WHERE c_custkey IS NOT NULL OR p_size BETWEEN 20 AND 39""",
    "record_folded_patches": """WITH f AS (SELECT user_id AS key, max(event_id) FILTER (WHERE event_type IN ('view', 'click')) AS seen,
   arg_max(CASE WHEN event_type = 'click' THEN 'null' ELSE '"' || event_type || '"' END, event_id) FILTER (WHERE event_type <> 'view') AS nm FROM events GROUP BY 1)
SELECT key, '{' || concat_ws(',', '"name":' || nm, '"seen":"' || seen || '"') || '}' AS patch FROM f""",
    "overlay_fallback": "SELECT s_suppkey AS key, 'supplier' AS src FROM supplier UNION ALL SELECT s_suppkey, 'overlay' FROM supplier",
    "revoked_documents": f"WITH {DOCS_SQL} SELECT id FROM docs WHERE review_status = 'auto_pass'",
    "artifact_reconcile": f"""WITH {DOCS_SQL}, e AS (SELECT DISTINCT content_sha256 AS path FROM docs WHERE listed), p AS (SELECT DISTINCT content_sha256 AS path FROM docs WHERE completeness = 'complete')
SELECT coalesce(e.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'publish' WHEN e.path IS NULL THEN 'remove' ELSE 'keep' END AS state FROM e FULL JOIN p ON p.path = e.path""",
    "import_verdicts": """WITH k AS (SELECT l_returnflag AS t, CASE WHEN l_quantity > 2 THEN l_orderkey || '-' || l_linenumber END AS k, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT t AS entity_type, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE n > 1 AND k IS NOT NULL) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS malformed,
  count(*) FILTER (WHERE k IS NOT NULL) AS imported, false AS ok FROM k GROUP BY t""",
    "key_sets": """WITH a AS (SELECT c_custkey AS key FROM customer), c AS (SELECT DISTINCT user_id AS key FROM events),
p AS (SELECT 'union' AS op, key FROM (SELECT key FROM a UNION SELECT key FROM c) UNION ALL SELECT 'difference', key FROM (SELECT key FROM a EXCEPT SELECT key FROM c) UNION ALL SELECT 'intersection', key FROM (SELECT key FROM a INTERSECT SELECT key FROM c))
SELECT op, count(*) AS n, CAST(sum(key) AS BIGINT) AS total FROM p GROUP BY op""",
    "rebuild_scope": f"WITH {SCOPE_SQL} SELECT page, key FROM scope",
    "rebuild_documents": f"WITH {SCOPE_SQL} SELECT id FROM docs WHERE source_status = 'dead' OR entity IN (SELECT entity FROM he)",
}
