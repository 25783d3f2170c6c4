"""Registry queries over customers, parts, suppliers, nations, orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from plainledger.functions import urls
from plainledger.functions import values as v
from plainledger.operators import registry as ops
from plainledger.plans import bindings as b
from plainledger.rules import registry as rules


def raw_registry(spark, sf):
    """Parts written out as an all-text registry file."""
    price = F.col("p_retailprice")
    fuel = (
        F.when(F.col("p_type") == "STANDARD", "100LL A").when(F.col("p_type") == "ECONOMY", "80,100LL")
        .when(F.col("p_type") == "LARGE", "JET A,MOGAS").when(F.col("p_type") == "SMALL", "none sold")
        .otherwise("")
    )
    return b.table(spark, sf, "part").select(
        F.concat(F.lit(" p"), "p_partkey").alias("ARPT_ID"),
        F.col("p_name").alias("ARPT_NAME"),
        F.upper("p_name").alias("CITY"),
        F.col("p_brand").alias("STATE_CODE"),
        F.col("p_type").alias("COUNTY_NAME"),
        F.when(F.col("p_size") < 10, " ").otherwise(F.concat(F.lit("K"), "p_size")).alias("ICAO_ID"),
        F.when(F.col("p_size") == 13, "N/A").otherwise(price.cast("int").cast("string")).alias("LAT_DECIMAL"),
        F.when(F.col("p_size") == 14, "oops").otherwise("").alias("LONG_DECIMAL"),
        F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("ELEV"),
        F.lit("").alias("OWNERSHIP_TYPE_CODE"),
        F.when(F.col("p_type") == "PROMO", "PR").otherwise("PU").alias("FACILITY_USE_CODE"),
        F.when(F.col("p_size") <= 25, "a").when(F.col("p_size") <= 40, "C").otherwise("H").alias("SITE_TYPE_CODE"),
        F.lit(" ").alias("EFF_DATE"),
        fuel.alias("FUEL_TYPES"),
        F.when(F.col("p_size") > 30, "y").otherwise("n").alias("TRNS_STRG_HGR_FLAG"),
        F.when(F.col("p_size") > 35, " yes ").alias("TRNS_STRG_TIE_FLAG"),
    )


def registry_admission(spark, sf):
    rows = ops.admitted_rows(raw_registry(spark, sf), "ARPT_ID", "FACILITY_USE_CODE", "SITE_TYPE_CODE")
    return ops.typed_registry(rows)


def registry_runways(spark, sf):
    lines = b.wide(b.table(spark, sf, "lineitem"), "l_orderkey").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.concat(F.col("l_linenumber").cast("string"), F.lit(" - "), (F.col("l_linenumber") + 18).cast("string")).alias("ident"),
        (F.col("l_extendedprice") / 10).alias("length"), F.col("l_quantity").alias("width"),
        F.when(F.col("l_returnflag") == "R", "closed").alias("status"), "l_linestatus",
        F.col("l_orderkey").cast("string").alias("key"),
    )
    out = ops.valid_runways(lines, "key", "ident", "length", "width", "status", "l_linestatus")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "runway", "length_ft", "width_ft", "surface")


def registry_b(spark, sf):
    hub = F.when(F.col("p_size") <= 2, "L").when(F.col("p_size") <= 4, "N").when(F.col("p_size") <= 5, "X")
    role = F.when(F.col("p_size") <= 20, F.concat(F.lit(" "), "p_type"))
    service = F.when(F.col("p_size") <= 30, "P").when(F.col("p_size") <= 40, "GA").when(F.col("p_size") <= 45, "?")
    return b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.when(F.col("p_size") != 50, F.col("p_name")).alias("name"),
        F.col("p_type").alias("city"), F.col("p_brand").alias("region"),
        F.when(F.col("p_size") > 25, "PU").alias("ownership"), ops.role_for(hub, role, service).alias("role"),
    )


def registry_a(spark, sf):
    return b.entities(spark, sf).select(
        "key", F.upper("name").alias("name"), "city", F.col("region").cast("string").alias("region"),
        F.when(F.col("balance") < 0, "PR").alias("ownership"),
    )


def merged(spark, sf):
    return ops.merge_registries(registry_a(spark, sf), registry_b(spark, sf), ("a", "b"))


def registry_merge(spark, sf):
    return merged(spark, sf).withColumn("sources", F.array_join("sources", ","))


def registry_carry_forward(spark, sf):
    snapshot = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(False).alias("admitted"))
    old = b.entities(spark, sf).select("key", "name", (F.col("balance") < 0).alias("admitted"))
    referenced = b.table(spark, sf, "events").select(F.col("user_id").alias("key"))
    return ops.carry_forward(snapshot, old, referenced)


def external_rows(spark, sf):
    """Orders as rows of the third registry; only settled and open ones say something."""
    status = F.col("o_orderstatus")
    return b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"),
        F.when(status == "F", F.concat(F.lit("http://site/"), "o_orderkey")).otherwise("").alias("website"),
        F.when(status == "O", F.concat(F.lit("I"), "o_orderkey")).alias("iata"),
    )


def registry_best_ranked(spark, sf):
    return ops.best_ranked(external_rows(spark, sf), "key", F.col("rank"), ["website", "iata"], "seq")


def third_registry(spark, sf):
    """Orders as raw rows of the third registry, with the keys, types and links people write."""
    status, rank = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    key = F.col("o_custkey").cast("string")
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(rank == "5", "CA").when(rank == "1", " us ").otherwise("US").alias("country"),
        F.when(status == "F", F.concat(F.lit(" a"), key)).when(status == "O", "").alias("local"),
        F.when(status == "O", F.concat(F.lit("k"), F.lpad(key, 3, "0"))).otherwise(F.concat(F.lit("p-"), key)).alias("ident"),
        F.when(rank == "2", "Large_Airport ").when(rank == "3", "heliport").when(rank == "4", "closed").otherwise("other").alias("type"),
        F.when(F.col("o_totalprice") > 200000, F.concat(F.lit(" http://site.example/"), "o_orderkey"))
        .when(F.col("o_totalprice") > 100000, "ftp://site.example/").alias("home"),
        F.when(F.col("o_totalprice") < 150000, F.concat(F.lit("i"), F.col("o_orderkey"), F.lit(" "))).otherwise(" ").alias("code"))


def registry_site_keys(spark, sf):
    return third_registry(spark, sf).select(
        "seq", ops.external_key("country", "local", "ident").alias("key"), ops.site_rank("type").alias("rank"))


def registry_best_sites(spark, sf):
    """Website and code per key of the third registry, from its raw rows."""
    rows = third_registry(spark, sf).select(
        ops.external_key("country", "local", "ident").alias("key"), "seq", "type",
        urls.http_url("home").alias("website"), F.upper(F.trim("code")).alias("iata"))
    return ops.best_ranked(rows.filter("key is not null"), "key", ops.site_rank("type"), ["website", "iata"], "seq")


def registry_fill_blanks(spark, sf):
    base = merged(spark, sf).withColumn(
        "website", F.when(F.col("in_b"), F.concat(F.lit("http://own/"), "key")).otherwise(F.lit(""))
    ).withColumn("iata", F.lit(None).cast("string"))
    extra = ops.best_ranked(external_rows(spark, sf), "key", F.col("rank"), ["website", "iata"], "seq")
    out = ops.fill_blanks(base, extra, ["website", "iata"], "c")
    return out.select("key", "website", "iata", F.array_join("sources", ",").alias("sources"))


def registry_reference_overlay(spark, sf):
    current = merged(spark, sf).select(
        "key", "name", "city", F.col("role").alias("icao"), "ownership", "sources")
    cases = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("case town").alias("city"),
        F.lit(None).cast("string").alias("icao"), F.lit("MR").alias("ownership"),
        F.array(F.struct(F.col("s_name").alias("id"), F.lit("alp").alias("kind")),
                F.struct(F.concat("s_name", F.lit("-b")).alias("id"), F.lit("master_plan").alias("kind"))).alias("documents"),
    )
    out = ops.overlay_reference(current, cases, prefer=["name", "icao"], fill=["city", "ownership"], source="reference")
    docs = ops.case_documents(cases).groupBy("key").agg(F.count(F.lit(1)).alias("n_documents"))
    return out.join(docs, "key", "left").withColumn("sources", F.array_join("sources", ","))


def registry_entity_rows(spark, sf):
    wanted = b.entities(spark, sf).filter(F.col("balance") < 0)
    rows = b.grants(spark, sf, outlays=False)
    return ops.rows_for_entities(wanted, rows, [F.col("award_date").desc(), F.col("grant_id")]).select(
        "entity", "grant_id", "award_date", "amount")


def registry_region_lookup(spark, sf):
    """Nation and region names of every supplier; nations without a region are listed."""
    nation, region = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    return b.table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        "s_suppkey", "n_name", "r_name")


def registry_unknown_keys(spark, sf):
    """User ids of events that no supplier carries, with their count."""
    users = b.table(spark, sf, "events").select(F.col("user_id").alias("key"))
    known = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))
    return ops.unknown_keys(users, known, "key")


def placed(spark, sf):
    """Customers live in the place of their nation's number; some places are no states."""
    names = F.array(*[F.lit(name) for name in sorted(rules.PLACE_CODES)])
    place = F.when(F.col("balance") < 0, F.initcap("city")).otherwise(F.element_at(names, F.col("region").cast("int") * 2 + 1))
    return b.entities(spark, sf).select("key", place.alias("place"))


def registry_places(spark, sf):
    return ops.in_places(placed(spark, sf), ops.place_dimension(spark), "place").select("key", "code", "region")


def registry_unknown_places(spark, sf):
    return ops.unknown_keys(placed(spark, sf), ops.place_dimension(spark), "place")


def registry_per_region(spark, sf):
    regions = b.table(spark, sf, "part").select(F.col("p_size").alias("region")).distinct()
    return ops.count_by_region(b.entities(spark, sf), regions)


def registry_scope(spark, sf):
    codes = ops.parse_scope("BUILDING; machinery", ["BUILDING", "MACHINERY", "FURNITURE"])
    return b.entities(spark, sf).filter(ops.in_scope("city", codes)).select("key", "city")


def registry_row_scope(spark, sf):
    """Lines keep their own flag as region when they have one, else their order's customer's."""
    orders = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"), "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.lpad(F.substring("o_orderpriority", 1, 1), 1, " ")).otherwise(" ").alias("region"))
    homes = b.entities(spark, sf).withColumn("region", F.col("region").cast("string"))
    return ops.rows_in_region_scope(orders, homes, "5").select("o_orderkey", "entity", "region")


def registry_quota_sample(spark, sf):
    sized = b.entities(spark, sf).select(
        "key", "region",
        F.when(F.col("balance") < 1000, "large").when(F.col("balance") < 4000, "medium").otherwise("small").alias("size"))
    forced = b.table(spark, sf, "supplier").filter(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("key"))
    return ops.quota_sample(sized, "key", ["region", "size"], "size",
                            {"large": 1, "medium": 2, "small": 3}, 200, "20260820", forced)


def registry_display(spark, sf):
    m = b.entities(spark, sf).join(
        b.table(spark, sf, "nation"), F.col("region") == F.col("n_nationkey"), "left")
    county = F.when(F.col("balance") < 0, F.concat("city", F.lit(" Parish"))).otherwise(F.initcap("city"))
    use = F.when(F.col("balance") > 5000, "PU").when(F.col("balance") > 2000, "PR")
    labels = ops.identity_labels(use, F.when(F.col("balance") > 8000, "mr").otherwise("ZZ"), F.lit("large_hub"))
    return m.select(
        "key", ops.place_line(F.col("name"), county, F.col("n_name"), F.col("region").cast("string")).alias("place"),
        F.array_join(labels, "; ").alias("labels"),
        ops.completeness_phrase(F.when(F.col("balance") < 0, "missing").otherwise("complete")).alias("phrase"),
    )


def form_bodies(spark, sf):
    url = F.when(F.col("balance") > 0, F.concat(F.lit("https://x.gov/"), "key", F.lit(" extra"))).otherwise("_No response_")
    kind = F.when(F.col("city") == "BUILDING", "State aviation or land-use statute").otherwise("Airport Layout Plan (ALP)")
    place = F.when(F.col("city") == "MACHINERY", "kpdx, Portland").when(F.col("city") == "FURNITURE", "_No response_").otherwise("4s9.")
    body = F.concat(
        F.lit("### What should we do?\n\nAdd a missing document\n\n### What kind of document?\n\n"), kind,
        F.lit("\n\n### Airport\n\n"), place, F.lit("\n\n### State\n\n"), F.lit("or (Oregon)"),
        F.lit("\n\n### Official URL\n\n"), url, F.lit("\n\n### Notes\n\n"), F.col("name"), F.lit("\n"),
    )
    return b.entities(spark, sf).select("key", body.alias("body"))


def registry_intake_forms(spark, sf):
    form = ops.parse_form("body")
    rows = form_bodies(spark, sf).withColumn("form", form)
    status = F.when(F.col("form.url").isNull(), "needs_human").otherwise("preserved")
    return rows.select(
        "key", "form.*", ops.form_can_queue(F.col("form")).alias("can_queue"),
        ops.form_resolution(status).alias("resolution"))


QUERIES = {f.__name__: f for f in (
    registry_admission, registry_runways, registry_merge, registry_carry_forward,
    registry_best_ranked, registry_fill_blanks, registry_reference_overlay, registry_entity_rows,
    registry_site_keys, registry_best_sites, registry_places, registry_unknown_places,
    registry_region_lookup, registry_unknown_keys, registry_per_region, registry_scope,
    registry_row_scope, registry_quota_sample, registry_display, registry_intake_forms,
)}

TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"

MERGED_SQL = """
a AS (SELECT c_custkey AS key, upper(c_name) AS name, c_mktsegment AS city, CAST(c_nationkey AS VARCHAR) AS region,
        CASE WHEN c_acctbal < 0 THEN 'PR' END AS ownership FROM customer),
b AS (SELECT p_partkey AS key, CASE WHEN p_size <> 50 THEN p_name END AS name, p_type AS city, p_brand AS region,
        CASE WHEN p_size > 25 THEN 'PU' END AS ownership,
        CASE WHEN p_size <= 2 THEN 'large_hub' WHEN p_size <= 4 THEN 'nonhub' WHEN p_size <= 5 THEN 'x'
             WHEN p_size <= 20 THEN lower(p_type) WHEN p_size <= 30 THEN 'primary' WHEN p_size <= 40 THEN 'general_aviation' END AS role
      FROM part),
merged AS (SELECT coalesce(a.key, b.key) AS key,
    coalesce(b.name, 'Customer' || substr(a.name, 9), CAST(b.key AS VARCHAR)) AS name,
    coalesce(b.city, a.city) AS city, coalesce(a.region, b.region) AS region,
    coalesce(b.ownership, a.ownership) AS ownership, b.role, b.key IS NOT NULL AS in_b,
    concat_ws(',', CASE WHEN a.key IS NOT NULL THEN 'a' END, CASE WHEN b.key IS NOT NULL THEN 'b' END) AS sources
  FROM a FULL JOIN b ON a.key = b.key)"""

BEST_SQL = """
x AS (SELECT o_custkey AS key, o_orderkey AS seq, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank,
        CASE WHEN o_orderstatus = 'F' THEN 'http://site/' || o_orderkey END AS website,
        CASE WHEN o_orderstatus = 'O' THEN 'I' || o_orderkey END AS iata FROM orders),
u AS (SELECT *, min(rank) OVER (PARTITION BY key) AS best FROM x WHERE website IS NOT NULL OR iata IS NOT NULL),
best AS (SELECT key, arg_min(website, seq) FILTER (WHERE website IS NOT NULL) AS website,
        arg_min(iata, seq) FILTER (WHERE iata IS NOT NULL) AS iata FROM u WHERE rank = best GROUP BY key)"""

PLACED_SQL = """
pd(place, code, region) AS (VALUES """ + ", ".join(
    f"('{name}', '{code}', " + next((f"'{r}'" for r, codes in rules.REGION_PLACES.items() if code in codes), "NULL") + ")"
    for name, code in rules.PLACE_CODES.items()) + """),
pc AS (SELECT c_custkey AS key, CASE WHEN c_acctbal < 0 THEN c_mktsegment[1] || lower(c_mktsegment[2:])
  ELSE (SELECT list(place ORDER BY place) FROM pd)[c_nationkey * 2 + 1] END AS place FROM customer)"""

SITES_SQL = """
raw AS (SELECT o_orderkey AS seq, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS st, CAST(o_custkey AS VARCHAR) AS k, o_totalprice AS t FROM orders),
lpk AS (SELECT *, CASE WHEN length(k) >= 3 THEN k[1:3] ELSE lpad(k, 3, '0') END AS k3 FROM raw),
ky AS (SELECT *, CASE WHEN p <> '5' THEN CASE WHEN st = 'F' THEN 'A' || k WHEN st = 'O' THEN k3 END END AS key,
  CASE p WHEN '2' THEN 0 WHEN '3' THEN 8 WHEN '4' THEN 9 ELSE 5 END AS rank,
  CASE WHEN t > 200000 THEN 'http://site.example/' || seq END AS website, CASE WHEN t < 150000 THEN 'I' || seq END AS iata FROM lpk)"""

ORACLE = {
    "registry_admission": f"""
SELECT upper('p' || p_partkey) AS key, p_name AS name, {TITLE.format('upper(p_name)')} AS city,
  upper(p_brand) AS region, upper(p_type[1]) || lower(p_type[2:]) AS county,
  CASE WHEN p_size >= 10 THEN 'K' || p_size END AS icao,
  CASE WHEN p_size <> 13 THEN CAST(CAST(floor(p_retailprice) AS INTEGER) AS DOUBLE) END AS latitude,
  CAST(NULL AS DOUBLE) AS longitude, CAST(round_even(p_size + 0.5, 0) AS INTEGER) AS elevation_ft,
  CAST(NULL AS VARCHAR) AS ownership, 'PU' AS facility_use, CASE WHEN p_size <= 25 THEN 'A' ELSE 'C' END AS site_type,
  CAST(NULL AS VARCHAR) AS effective,
  CASE p_type WHEN 'STANDARD' THEN 'Jet A · 100LL' WHEN 'ECONOMY' THEN '100LL · 80' WHEN 'LARGE' THEN 'Jet A · mogas'
       WHEN 'SMALL' THEN 'none sold' END AS fuel,
  p_size > 30 AS hangar_storage, p_size > 35 AS tiedown_storage
FROM part WHERE p_type <> 'PROMO' AND p_size <= 40""",
    "registry_runways": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linenumber || '/' || (l_linenumber + 18) AS runway,
  CAST(round_even(l_extendedprice / 10, 0) AS BIGINT) AS length_ft, CAST(l_quantity AS BIGINT) AS width_ft, l_linestatus AS surface
FROM lineitem WHERE l_returnflag <> 'R' AND round_even(l_extendedprice / 10, 0) >= 500 AND l_quantity BETWEEN 20 AND 400""",
    "registry_merge": f"WITH {MERGED_SQL} SELECT * FROM merged",
    "registry_carry_forward": """
SELECT s_suppkey AS key, s_name AS name, false AS admitted FROM supplier
UNION ALL
SELECT c_custkey, c_name, true FROM customer
WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
  AND (c_acctbal < 0 OR c_custkey IN (SELECT user_id FROM events))""",
    "registry_best_ranked": f"WITH {BEST_SQL} SELECT * FROM best",
    "registry_fill_blanks": f"""WITH {MERGED_SQL}, {BEST_SQL}
SELECT m.key, CASE WHEN in_b THEN 'http://own/' || m.key ELSE t.website END AS website, t.iata,
  sources || CASE WHEN (NOT in_b AND t.website IS NOT NULL) OR t.iata IS NOT NULL THEN ',c' ELSE '' END AS sources
FROM merged m LEFT JOIN best t ON t.key = m.key""",
    "registry_reference_overlay": f"""WITH {MERGED_SQL}
SELECT coalesce(m.key, s_suppkey) AS key, coalesce(s_name, name) AS name, role AS icao,
  coalesce(city, CASE WHEN s_suppkey IS NOT NULL THEN 'case town' END) AS city,
  coalesce(ownership, CASE WHEN s_suppkey IS NOT NULL THEN 'MR' END) AS ownership,
  coalesce(sources, 'reference') AS sources, CAST(CASE WHEN s_suppkey IS NOT NULL THEN 2 END AS BIGINT) AS n_documents
FROM merged m FULL JOIN supplier ON s_suppkey = m.key""",
    "registry_entity_rows": """
SELECT o_custkey AS entity, o_orderkey AS grant_id, CAST(o_orderdate AS DATE) AS award_date,
  CAST(round_even(o_totalprice, 0) AS BIGINT) AS amount
FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal < 0""",
    "registry_site_keys": f"WITH {SITES_SQL} SELECT seq, key, rank FROM ky",
    "registry_best_sites": f"""WITH {SITES_SQL}, u AS (SELECT *, min(rank) OVER (PARTITION BY key) AS best FROM ky WHERE key IS NOT NULL AND coalesce(website, iata) IS NOT NULL)
SELECT key, arg_min(website, seq) FILTER (WHERE website IS NOT NULL) AS website, arg_min(iata, seq) FILTER (WHERE iata IS NOT NULL) AS iata FROM u WHERE rank = best GROUP BY key""",
    "registry_places": f"WITH {PLACED_SQL} SELECT key, code, region FROM pc LEFT JOIN pd USING (place)",
    "registry_unknown_places": f"WITH {PLACED_SQL} SELECT place, count(*) AS n FROM pc WHERE place NOT IN (SELECT place FROM pd) GROUP BY 1",
    "registry_region_lookup": """
SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey""",
    "registry_unknown_keys": """
SELECT user_id AS key, count(*) AS n FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
    "registry_per_region": """
SELECT r.region, count(c_custkey) AS n FROM (SELECT DISTINCT p_size AS region FROM part) r
LEFT JOIN customer ON c_nationkey = r.region GROUP BY 1""",
    "registry_scope": """
SELECT c_custkey AS key, c_mktsegment AS city FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
    "registry_row_scope": """
SELECT o_orderkey, o_custkey AS entity, CASE WHEN o_orderstatus <> 'P' THEN substr(o_orderpriority, 1, 1) ELSE ' ' END AS region
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey = 5
WHERE CASE WHEN o_orderstatus <> 'P' THEN substr(o_orderpriority, 1, 1) = '5' ELSE c_custkey IS NOT NULL END""",
    "registry_quota_sample": """
WITH s AS (SELECT c_custkey AS key, c_nationkey AS region,
    CASE WHEN c_acctbal < 1000 THEN 'large' WHEN c_acctbal < 4000 THEN 'medium' ELSE 'small' END AS size,
    sha256(c_custkey || '|20260820') AS draw FROM customer),
f AS (SELECT * FROM s WHERE key IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)),
h AS (SELECT region, size, count(*) AS have FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY region, size ORDER BY draw, key) AS rn
      FROM s WHERE key NOT IN (SELECT key FROM f)),
q AS (SELECT r.* FROM r LEFT JOIN h ON h.region = r.region AND h.size = r.size
      WHERE rn <= CASE r.size WHEN 'large' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END - coalesce(have, 0)),
t AS (SELECT key, region, size, draw, 0 AS tier FROM f UNION ALL SELECT key, region, size, draw, 1 FROM q
      UNION ALL SELECT key, region, size, draw, 2 FROM r WHERE key NOT IN (SELECT key FROM q))
SELECT key, region, size FROM t ORDER BY tier, draw, key LIMIT 200""",
    "registry_display": """
SELECT c_custkey AS key, c_name || ', ' || CASE WHEN c_acctbal < 0 THEN c_mktsegment || ' Parish'
    ELSE c_mktsegment[1] || lower(c_mktsegment[2:]) || ' County' END || ', ' || n_name AS place,
  concat_ws('; ', CASE WHEN c_acctbal > 5000 THEN 'Public-use' WHEN c_acctbal > 2000 THEN 'Private-use' END,
    CASE WHEN c_acctbal > 8000 THEN 'Army' ELSE 'ZZ' END, 'large hub') AS labels,
  CASE WHEN c_acctbal < 0 THEN 'No master plan or Airport Layout Plan listed yet.'
    ELSE 'Official link and a saved copy are both on file.' END AS phrase
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "registry_intake_forms": """
SELECT c_custkey AS key, 'add' AS report_type, CASE WHEN c_mktsegment = 'BUILDING' THEN 'statute' ELSE 'alp' END AS kind,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'PDX' WHEN 'FURNITURE' THEN NULL ELSE '4S9' END AS entity, 'OR' AS region,
  CASE WHEN c_acctbal > 0 THEN 'https://x.gov/' || c_custkey END AS url, c_name AS notes,
  c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR c_mktsegment <> 'FURNITURE') AS can_queue,
  CASE WHEN c_acctbal > 0 THEN 'close' ELSE 'open' END AS resolution
FROM customer""",
}
