"""Search and source queries: records, scoped search, feeds, query texts, readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainledger.functions import dates
from plainledger.functions import values as v
from plainledger.operators import funding
from plainledger.operators import search as ops
from plainledger.operators import text as text_ops
from plainledger.plans import bindings as b
from plainledger.plans import web
from plainledger.plans.bindings import BLANKS_SQL, DOCS_SQL, GRANTS_SQL
from plainledger.rules import funding as funding_rules
from plainledger.rules.web import SKIP_HOSTS
from plainledger.session import cut, run_dir
from plainledger.sources import exports, tables


def entities(spark, sf):
    return b.entities(spark, sf).select(
        "key", "name", "city", F.col("region").cast("string").alias("region"),
        F.when(F.col("balance") < 0, "reliever").alias("role"),
        F.when(F.col("balance") > 5000, "growing").when(F.col("balance") < 0, "declining").when(F.col("balance") < 500, "odd").alias("outlook"))


def documents(spark, sf):
    return b.documents(spark, sf).withColumn("preserved_url", F.when(F.col("kind") == "alp", F.col("preserved_url")))


def grants(spark, sf):
    return b.grants(spark, sf, described=True).select(
        "entity", F.when(F.col("fiscal_year") != 1997, F.col("grant_number")).alias("grant_number"), "fiscal_year",
        F.when(F.col("fiscal_year") != 1997, F.col("description")).otherwise(F.concat_ws("/", "grant_id", "description")).alias("description"),
        F.col("own_region").cast("string").alias("region"), F.col("level").alias("programs"))


def pages(spark, sf):
    rows = b.documents(spark, sf).select("id", F.split("text", "\n").alias("pages"))
    return text_ops.page_rows(rows, "id", "pages")


def records(spark, sf):
    regions = b.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"),
        F.when(F.col("n_regionkey") == 1, F.concat(F.lit("Agency "), "n_nationkey")).alias("agency"))
    docs = documents(spark, sf).drop("text")
    return ops.union_records([
        ops.entity_records(entities(spark, sf)), ops.region_records(regions), ops.document_records(docs),
        ops.page_records(docs, pages(spark, sf)), ops.funding_records(grants(spark, sf))], "g1")


def search_records(spark, sf):
    return records(spark, sf)


def search_gate(spark, sf):
    shown = documents(spark, sf).filter(F.col("review_status").isin("published", "auto_pass")).select("id")
    least = (
        b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
        .union(b.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"))).union(shown)
        .agg(F.count(F.lit(1)).alias("minimum")))
    return ops.completeness_gate(records(spark, sf), least, "g1")


def queries(spark, sf):
    """Needles users would type: every brand, type and segment once per scope."""
    words = (
        b.table(spark, sf, "part").select(F.lower("p_type").alias("needle"))
        .union(b.table(spark, sf, "part").select("p_name")).union(b.table(spark, sf, "customer").select("c_mktsegment"))
        .union(b.table(spark, sf, "documents").select("source")).distinct())
    scope = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(o).alias("outlook")) for s, o in (
        ("all", ""), ("plans", ""), ("projects", ""), ("all", "growing"))]))
    return words.select("needle", scope.alias("s")).select(
        F.concat_ws("|", "needle", "s.scope", "s.outlook").alias("query_id"), "needle", "s.scope", "s.outlook")


def search_scoped(spark, sf):
    # A search reads the stored record table.
    return ops.search(cut(records(spark, sf)), queries(spark, sf)).select("query_id", "id", "attribute", "pos")


def search_last_hits(spark, sf):
    """The page of hits that the cap on all hits cuts short."""
    return ops.search(cut(records(spark, sf)), queries(spark, sf), offset=96).select("query_id", "id", "attribute", "pos")


def search_changed_documents(spark, sf):
    """Short documents changed: their old records go, their fresh ones carry a new stamp."""
    docs = documents(spark, sf).drop("text")
    changed = docs.filter("n_text < 700")
    fresh = ops.union_records([ops.document_records(changed), ops.page_records(changed, pages(spark, sf))], "g2")
    return ops.apply_document_changes(records(spark, sf), changed, fresh).select("type", "id", "_generation")


def search_refreshed_entities(spark, sf):
    """Entities with settled grants have a new fact sheet: their records, texts included, are made anew."""
    settled = b.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    sheets = entities(spark, sf).withColumn("outlook", F.when(F.col("outlook") == "growing", "maintaining").otherwise(F.col("outlook")))
    return ops.refresh_entities(records(spark, sf), sheets, "g2", settled).select("type", "id", "outlook", "_generation")


def search_missing_text(spark, sf):
    stored = documents(spark, sf).select("content_sha256", F.md5("source_url").alias("manifest_key"), F.md5("kind").alias("manifest_sha256")).distinct()
    known = documents(spark, sf).filter("kind <> 'alp'").select(
        "content_sha256", F.md5("source_url").alias("manifest_key"),
        F.md5(F.when(F.col("n_text") > 900, F.col("kind")).otherwise("stale")).alias("manifest_sha256"))
    return ops.missing_projections(stored, known)


def feed_items(spark, sf):
    g = b.grants(spark, sf, described=True)
    money = g.select("entity", funding.grant_title("description").alias("item"), F.col("award_date").alias("date"), F.col("grant_id").alias("seq"))
    own = entities(spark, sf).select(F.col("key").alias("entity"), F.col("name").alias("item"), F.lit(None).cast("date").alias("date"), F.lit(0).cast("long").alias("seq"))
    docs = b.documents(spark, sf).select(F.col("id").alias("entity"), F.col("kind").alias("item"), F.col("published_at").alias("date"), "seq")
    return ops.feed_items([own, money, docs], 5)


def feed_recent(spark, sf):
    return ops.recently_listed(b.documents(spark, sf).drop("text")).select("id", "retrieved_at", "title")


def page_last_modified(spark, sf):
    docs = b.documents(spark, sf).select("entity", "retrieved_at", "published_at", "edition")
    dates = docs.select(F.concat(F.lit("/d/"), "entity").alias("loc"), F.explode(F.array(
        F.concat(F.col("retrieved_at").cast("string"), F.lit("T00:00:00Z")), F.col("published_at").cast("string"), F.col("edition"))).alias("value"))
    old = b.table(spark, sf, "supplier").select(F.concat(F.lit("/d/src"), "s_suppkey").alias("loc"), F.lit("2001-01-01").alias("day"))
    return ops.last_modified(dates, old)


def query_texts_entity(spark, sf):
    rows = b.entities(spark, sf).select(
        "key", F.when(F.col("balance") > 0, F.col("name")).otherwise(" ").alias("name"), F.when(F.col("balance") > 3000, F.col("city")).alias("city"),
        F.lit("").alias("state"), F.when(F.col("balance") > 6000, F.concat(F.lit("https://www.Site"), "key", F.lit(".gov/x"))).alias("website"))
    return ops.entity_queries(rows)


def query_texts_region(spark, sf):
    """Suppliers as regions: some with an agency, some with a site."""
    rows = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("Dept "), "s_suppkey")).alias("agency"),
        F.when(F.col("s_acctbal") < 7000, F.concat(F.lit("http://r"), "s_suppkey", F.lit(".gov"))).alias("website"))
    return ops.region_queries(rows)


def query_seed_steps(spark, sf):
    rows = b.entities(spark, sf).select(
        "key", "name", F.when(F.col("balance") > 6000, "https://facebook.com/x").when(F.col("balance") > 0, "https://www.a.gov/").alias("website"))
    return ops.seed_steps(rows, SKIP_HOSTS)


def query_followups(spark, sf):
    from plainledger.operators import web as web_ops

    hits = web.triaged(spark, sf)
    known = web.websites(spark, sf)
    hosts = web_ops.best_hosts(web_ops.host_votes(hits, known), 5)
    signals = web_ops.hit_signals(hits).join(known.select("entity", F.concat("entity", F.lit(".example.gov")).alias("known_host")), "entity")
    ran = known.select("entity", F.concat(F.lit("site:example.gov "), "entity", F.lit(' "master plan"')).alias("query"))
    return ops.followup_steps(signals, hosts, web_ops.hit_years(hits), ran)


# --- sources and sinks ---------------------------------------------------------------

def value_texts(spark, sf):
    """Figures of an order written as texts and read again."""
    rows = b.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    number = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2), F.lit(" ")))
    words = F.when(F.col("o_orderpriority") == "1-URGENT", "Seven").when(F.col("o_orderpriority") == "2-HIGH", "dozens").otherwise(F.format_number(key, 0))
    return rows.select(
        "o_orderkey", v.money(number).alias("amount"), v.serial_date((key * 10).cast("string")).alias("day"),
        v.fiscal_year(F.lit(None).cast("string"), F.concat(F.lit("FY_"), F.year("o_orderdate")), F.lit("/2001/")).alias("fiscal_year"),
        v.edition_range(F.concat(F.lit("x-2025-2029-"), key)).alias("edition"), v.count_from_text(words).alias("count"),
        v.to_int(F.concat(key, F.lit(".5"))).alias("rounded"), v.slug(F.concat_ws(" / ", "o_orderpriority", "o_orderstatus")).alias("slug"))


def date_texts(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit("soon")).otherwise(
        dates.iso_text(F.col("ts").cast("timestamp_ntz"))).alias("text"))
    at = dates.parse_iso("text")
    return rows.select("event_id", dates.rfc822("text").alias("feed"), dates.month_key(at).alias("month"), dates.zone_month(at).alias("local_month"),
                       dates.within_days(at, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 7).alias("recent"))


def source_csv_round_trip(spark, sf):
    """Parts written as header CSV and read back as text, then typed."""
    path = run_dir(spark, "csv")
    part = b.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("p_name"), "p_size")
    part.write.option("header", "true").option("escape", '"').csv(path)
    rows = tables.read_csv(spark, path, ["p_partkey", "p_name", "p_size"])
    return tables.typed(rows, {"p_partkey": "long", "p_name": "string", "p_size": "int", "p_extra": "string"}, {"p_extra": "none"})


def source_json_lines(spark, sf):
    """Event properties parsed as lines; every error event's line is broken."""
    rows = b.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "props")).otherwise(F.col("props")).alias("line"))
    parsed = tables.parse_json_lines(rows, "line", "k long", "report")
    return parsed.select("event_id", "k", F.col(tables.BAD_LINE).alias("bad_line"))


def source_bad_lines(spark, sf):
    """Order lines as line JSON, a file in parts per status, the largest quantities cut off: each with its file and line number."""
    folder = run_dir(spark, "lines")
    whole = F.to_json(F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    line = F.when(F.col("l_quantity") == 50, F.substring(whole, 1, 20)).otherwise(whole)
    rows = b.table(spark, sf, "lineitem").select(F.concat_ws("", "l_returnflag", "l_linestatus").alias("status"), "l_orderkey", "l_linenumber", "l_quantity", line.alias("value"))
    order = ["status", "l_orderkey", "l_linenumber", "l_quantity"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("status", "value").write.partitionBy("status").text(folder)
    schema = T.StructType.fromDDL("l_orderkey long, l_linenumber long, l_quantity double")
    found = tables.read_jsonl(spark, f"{folder}/*", schema, "report", parts=True).filter(F.col(tables.BAD_LINE).isNotNull())
    return found.select(F.regexp_extract("_file", "status=([A-Z]+)", 1).alias("status"), F.col("_line").alias("line"), F.col(tables.BAD_LINE).alias("text"))


def source_typed(spark, sf):
    rows = b.table(spark, sf, "orders").withColumn("level", b.level_of(F.col("o_orderpriority")))
    return tables.typed(rows, {"o_orderkey": "long", "level": "string", "programs": "array<string>", "o_totalprice": "decimal(12,2)"},
                        {"programs": [], "level": "federal"}, {"level": (funding_rules.LEVELS, "other")}).select(
        "o_orderkey", "level", F.size("programs").alias("n_programs"), v.half_even("o_totalprice").alias("amount"))


def sheet_cells(spark, sf):
    """Orders as the cells of three sheets, each with its own header wording and row."""
    orders = b.table(spark, sf, "orders")
    sheet = F.col("o_orderstatus")
    body = orders.select(sheet.alias("sheet"), (F.col("o_orderkey") + 10).alias("row"), F.explode(F.array(
        F.struct(F.lit(1).alias("col"), F.concat(F.lit(" c"), "o_custkey").alias("value")),
        F.struct(F.lit(2).alias("col"), F.lit("1").alias("value")),
        F.struct(F.lit(3).alias("col"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("value")),
        F.struct(F.lit(4).alias("col"), F.concat(F.lit("Repair of "), "o_orderpriority").alias("value")),
    )).alias("c")).select("sheet", "row", "c.*")
    names = F.when(F.col("sheet") == "F", F.array(*[F.lit(x) for x in ("LocID", "Total", "Total Amount", "Project Summary")])).when(
        F.col("sheet") == "O", F.array(*[F.lit(x) for x in ("Loc ID", "Notes", "AIP  Federal-Funds", "Brief Description")])).otherwise(
        F.array(*[F.lit(x) for x in ("ARPT ID", "Nothing", "total", "Description")]))
    heads = orders.select(sheet.alias("sheet")).distinct()
    header = heads.select("sheet", F.when(F.col("sheet") == "F", 3).otherwise(5).cast("long").alias("row"), F.posexplode(names).alias("p", "value"))
    title = heads.select("sheet", F.lit(1).cast("long").alias("row"), F.lit(1).alias("col"), F.concat(F.lit("FY 2025 "), "sheet").alias("value"))
    return body.unionByName(header.select("sheet", "row", (F.col("p") + 1).alias("col"), "value")).unionByName(title)


def source_sheet_rows(spark, sf):
    rows = tables.map_sheet(sheet_cells(spark, sf), funding_rules.GRANT_HEADERS, "entity")
    return rows.select("sheet", "row", F.upper(F.trim("entity")).alias("entity"), v.money("total").alias("amount"), "description",
                       funding.program_tags(v.money("entitlement"), v.money("discretionary"), v.money("aig"), v.money("total"))[0].alias("tag"))


def source_sheet_titles(spark, sf):
    titles = tables.sheet_titles(sheet_cells(spark, sf), funding_rules.GRANT_HEADERS, "entity")
    return titles.withColumn("fiscal_year", v.fiscal_year("title"))


def source_listing_pages(spark, sf):
    """Orders as listing pages that link to yearly pages and workbooks."""
    year = F.year("o_orderdate").cast("string")
    html = F.concat(
        F.lit('<a href="/airports/aip/grant_histories/20'), F.lpad(F.substring("o_orderpriority", 1, 1), 2, "0"), F.lit('/first">a</a><a HREF=\'/airports/aip/grant_histories/20'),
        F.lpad(F.substring("o_orderpriority", 1, 1), 2, "0"), F.lit("/?k="), "o_orderkey", F.lit('\'>b</a><a href="/x/'), year, F.lit('">c</a>'))
    rows = b.table(spark, sf, "orders").select("o_orderkey", html.alias("html"))
    return tables.year_pages(rows, "html", r"/airports/aip/grant_histories/(20\d{2})(?:/|$|\?|#)", "https://www.example.gov", ["o_orderkey"])


def source_workbooks(spark, sf):
    name = F.concat(F.lit("fy"), F.year("o_orderdate"))
    html = F.concat(
        F.lit('<a href="/f/'), name, F.lit('-by-state.xlsx">s</a><a href="/f/z'), name, F.when(F.col("o_orderstatus") == "P", ".pdf").otherwise(".XLSX"),
        F.lit('">g</a><a href="/f/grants-'), "o_orderkey", F.when(F.col("o_orderstatus") == "F", ".xlsx").otherwise(".doc"), F.lit('">g</a>'))
    rows = b.table(spark, sf, "orders").select("o_orderkey", html.alias("html"))
    return tables.best_workbook(rows, "html", "https://www.example.gov", ["o_orderkey"])


def source_current_cycle(spark, sf):
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('<a href="/d/'), F.date_format(day, "dd_MMM_yyyy"), F.lit('_APT_CSV.zip">')))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Subscription effective "), F.date_format(day, "MMMM d, yyyy")))
        .otherwise(F.concat(F.lit('<a href="../NASR_Subscription/'), F.date_format(day, "yyyy-MM-dd"), F.lit('">'))))
    return b.table(spark, sf, "orders").select("o_orderkey", tables.current_cycle_file(text).alias("url"))


def sink_bulk_export(spark, sf):
    """Listed documents as the eight-column export, written as CSV and read back."""
    docs = b.documents(spark, sf).select(
        "id", "kind", F.col("entity").alias("airport_lid"), F.col("region").alias("state"), "title", "source_url", "completeness",
        F.when(F.col("kind") != "alp", F.col("content_sha256")).alias("content_sha256"), "review_status")
    path = run_dir(spark, "bulk")
    exports.write_bulk(docs, F.col("review_status").isin("published", "auto_pass"), path)
    rows = tables.read_csv(spark, f"{path}/csv", exports.EXPORT_COLUMNS, multi_line=True)
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in exports.EXPORT_COLUMNS])


def sink_sorted_lines(spark, sf):
    path = run_dir(spark, "lines")
    rows = b.table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    exports.write_sorted_jsonl(rows, path, ["c_custkey"])
    return tables.read_jsonl(spark, path, rows.schema, "fail")


def sink_idempotent_append(spark, sf):
    """Events appended twice by key: the second run adds nothing."""
    path = run_dir(spark, "append")
    rows = b.table(spark, sf, "events").select(
        F.concat_ws(":", "user_id", "event_type").alias("event_key"), F.col("ts").alias("at"), "event_id")
    rows.limit(0).write.parquet(path)
    exports.append_events(rows, path, "event_key")
    exports.append_events(rows, path, "event_key")
    return spark.read.schema(rows.schema).parquet(path)


def sink_release_inventory(spark, sf):
    """Pages released as files; their inventory equals the saved one, bar one folder."""
    path = run_dir(spark, "release")
    b.table(spark, sf, "pages").withColumn("half", F.length("html") > 2000).write.option("maxRecordsPerFile", 1000).partitionBy("half").json(path)
    now = tables.file_inventory(spark, path).filter(F.col("path").endswith(".json"))
    saved = now.withColumn("sha256", F.when(F.col("path").contains("half=true"), F.col("sha256")).otherwise("0"))
    return tables.compare_inventory(now, saved).select(F.regexp_extract("path", "half=([a-z]+)", 0).alias("folder"), "state").distinct()


QUERIES = {f.__name__: f for f in (
    search_records, search_gate, search_scoped, search_last_hits, search_changed_documents, search_refreshed_entities,
    search_missing_text, feed_items, feed_recent,
    page_last_modified, query_texts_entity, query_texts_region, query_seed_steps, query_followups,
    value_texts, date_texts, source_csv_round_trip, source_json_lines, source_bad_lines, source_typed, source_sheet_rows, source_sheet_titles,
    source_listing_pages, source_workbooks, source_current_cycle, sink_bulk_export, sink_sorted_lines,
    sink_idempotent_append, sink_release_inventory,
)}

NO = "CAST(NULL AS VARCHAR)"
RECORDS_SQL = DOCS_SQL + "," + GRANTS_SQL + f""",
pg AS (SELECT id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM docs WHERE listed AND kind <> 'notice'),
px AS (SELECT id, CAST(page AS INTEGER) AS page, trim(regexp_replace(raw, '{BLANKS_SQL}', ' ', 'g')) AS t FROM pg),
gd AS (SELECT *, CASE WHEN fiscal_year <> 1997 THEN nullif(description, '') ELSE concat_ws('/', grant_id, nullif(description, '')) END AS ds, CASE WHEN fiscal_year <> 1997 THEN grant_number END AS gn FROM grants),
gt AS (SELECT *, coalesce(nullif(trim(split_part(trim(regexp_replace(coalesce(ds, ''), '\\s+', ' ', 'g')), ',', 1)), ''), 'Grant') AS ti FROM gd),
gs AS (SELECT *, regexp_replace(coalesce(gn, entity || '-' || fiscal_year || '-' || ti), '[^\\p{{L}}\\p{{N}}]', '-', 'g') AS sl FROM gt),
cb AS (SELECT *, CASE WHEN c_acctbal > 5000 THEN 'growing' WHEN c_acctbal < 0 THEN 'declining' END AS band FROM customer),
records AS (
 SELECT 'airport-' || c_custkey AS id, 'airport' AS type, c_custkey || ' ' || c_name AS title, '/airports/' || c_custkey || '/' AS url, CAST(c_nationkey AS VARCHAR) AS region, CAST(c_custkey AS VARCHAR) AS entity,
   {NO} AS kind, {NO} AS completeness, band AS outlook, '' AS summary, concat_ws(' ', c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'reliever' END, 'planning outlook ' || band) AS text, {NO} AS document_id, CAST(NULL AS INTEGER) AS page FROM cb
 UNION ALL SELECT 'state-' || n_nationkey, 'state', n_name, '/states/' || n_nationkey || '/', CAST(n_nationkey AS VARCHAR), {NO}, {NO}, {NO}, {NO}, '', concat_ws(' ', n_nationkey, CASE WHEN n_regionkey = 1 THEN 'Agency ' || n_nationkey END, 'budget law awards'), {NO}, NULL FROM nation
 UNION ALL SELECT 'document-' || id, 'document', coalesce(nullif(title, ''), CAST(id AS VARCHAR)), '/documents/' || id || '/', region, entity, kind, completeness, {NO}, coalesce(summary, ''), concat_ws(' ', id, kind, edition, nullif(summary, '')), CAST(id AS VARCHAR), NULL FROM docs WHERE listed
 UNION ALL SELECT 'page-' || d.id || '-' || px.page, 'page', coalesce(nullif(title, ''), CAST(d.id AS VARCHAR)) || ' p. ' || px.page, CASE WHEN kind = 'alp' THEN preserved_url || '#page=' || px.page ELSE '/documents/' || d.id || '/' END, region, entity, kind, completeness, {NO}, coalesce(summary, ''), px.t, CAST(d.id AS VARCHAR), px.page FROM px JOIN docs d ON d.id = px.id WHERE px.t <> ''
 UNION ALL SELECT 'funding-' || CASE WHEN length(sl) > 80 THEN substr(sl, 1, 80) || '-' || substr(md5(sl), 1, 12) ELSE sl END, 'funding', entity || ' ' || ti, '/airports/' || entity || '/#funding', CAST(own_region AS VARCHAR), CAST(entity AS VARCHAR), 'funding', {NO}, {NO}, '', concat_ws(' ', gn, ds, level), {NO}, NULL FROM gs)"""

VOTES_SQL = web.ORACLE["search_host_votes"].rsplit("SELECT * FROM (SELECT *", 1)[0]

ORACLE = {
    "search_records": f"WITH {RECORDS_SQL} SELECT *, 'g1' AS _generation FROM records",
    "search_gate": f"""WITH {RECORDS_SQL}, c AS (SELECT count(*) AS n FROM records), m AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM docs WHERE listed) AS minimum)
SELECT n, n AS n_generation, minimum, n >= minimum AS ok FROM c, m""",
    "search_scoped": f"""WITH {RECORDS_SQL},
w AS (SELECT DISTINCT needle FROM (SELECT lower(p_type) AS needle FROM part UNION SELECT p_name FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT source FROM documents)),
q AS (SELECT needle || '|' || scope || '|' || outlook AS query_id, lower(needle) AS nd, scope, outlook AS ol FROM w, (VALUES ('all', ''), ('plans', ''), ('projects', ''), ('all', 'growing')) x(scope, outlook)),
h AS (SELECT q.query_id, r.id, CASE WHEN contains(lower(coalesce(r.entity, '')), nd) THEN 1 WHEN contains(lower(coalesce(title, '')), nd) THEN 2 WHEN contains(lower(coalesce(r.text, '')), nd) THEN 3 ELSE 4 END AS attribute
  FROM records r JOIN q ON contains(lower(coalesce(title, '') || ' ' || coalesce(r.text, '')), nd)
   AND CASE WHEN ol <> '' THEN r.type = 'airport' AND coalesce(r.outlook = ol, false) WHEN scope = 'plans' THEN coalesce(r.kind, r.type) IN ('master_plan', 'alp', 'other') WHEN scope = 'projects' THEN r.type = 'funding' ELSE true END),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY attribute, id) AS pos FROM h)
SELECT * FROM p WHERE {{pos}}""",
    "search_changed_documents": f"""WITH {RECORDS_SQL}
SELECT type, r.id, CASE WHEN d.id IS NULL THEN 'g1' ELSE 'g2' END AS _generation FROM records r LEFT JOIN docs d ON CAST(d.id AS VARCHAR) = document_id AND length(d.text) < 700""",
    "search_refreshed_entities": f"""WITH {RECORDS_SQL}, n AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_orderstatus = 'F')
SELECT r.type, r.id, CASE WHEN n.k IS NOT NULL AND r.outlook = 'growing' THEN 'maintaining' ELSE r.outlook END AS outlook, CASE WHEN n.k IS NULL THEN 'g1' ELSE 'g2' END AS _generation
FROM records r LEFT JOIN n ON r.type = 'airport' AND n.k = r.entity""",
    "search_missing_text": f"""WITH {DOCS_SQL}
SELECT DISTINCT content_sha256, md5(source_url) AS manifest_key, md5(kind) AS manifest_sha256 FROM docs
EXCEPT SELECT content_sha256, md5(source_url), md5(CASE WHEN length(text) > 900 THEN kind ELSE 'stale' END) FROM docs WHERE kind <> 'alp'""",
    "feed_items": f"""WITH {DOCS_SQL}, {GRANTS_SQL},
i AS (SELECT c_custkey AS entity, c_name AS item, CAST(NULL AS VARCHAR) AS date, 0 AS part, 0 AS seq FROM customer
  UNION ALL SELECT entity, coalesce(nullif(description, ''), 'Grant'), CAST(award_date AS VARCHAR), 1, grant_id FROM grants
  UNION ALL SELECT id, kind, CAST(published_at AS VARCHAR), 2, id FROM docs),
p AS (SELECT entity, item, date, row_number() OVER (PARTITION BY entity ORDER BY date DESC NULLS LAST, part, seq) AS pos FROM i)
SELECT * FROM p WHERE pos <= 5""",
    "feed_recent": f"""WITH {DOCS_SQL}
SELECT id, retrieved_at, title FROM docs WHERE listed AND (kind = 'notice' OR completeness = 'complete')
ORDER BY retrieved_at DESC, CASE WHEN nullif(summary, '') IS NOT NULL THEN 1 ELSE 0 END DESC, coalesce(title, '') DESC, id LIMIT 12""",
    "page_last_modified": f"""WITH {DOCS_SQL}, n AS (SELECT '/d/' || entity AS loc, CAST(max(greatest(retrieved_at, published_at)) AS VARCHAR) AS day FROM docs GROUP BY 1)
SELECT * FROM n UNION ALL SELECT '/d/src' || s_suppkey, '2001-01-01' FROM supplier WHERE '/d/src' || s_suppkey NOT IN (SELECT loc FROM n)""",
    "query_texts_entity": "WITH e AS (SELECT c_custkey AS lid, CASE WHEN c_acctbal > 0 THEN '\"' || c_name || '\"' ELSE CAST(c_custkey AS VARCHAR) END AS name, CASE WHEN c_acctbal > 3000 THEN c_mktsegment END AS place, "
        "CASE WHEN c_acctbal > 6000 THEN 'site' || c_custkey || '.gov' END AS host FROM customer)\n" + "\nUNION ALL ".join(
        "SELECT lid AS entity, '{f}' AS family, {i} AS ord, {t} AS query FROM e WHERE true{h}{p}".format(
            f=f, i=i, t="'" + t.replace("{name}", "' || name || '").replace("{lid}", "' || lid || '").replace("{host}", "' || host || '").replace("{place}", "' || place || '") + "'",
            h=" AND host IS NOT NULL" if h else "", p=" AND place IS NOT NULL" if p else "") for i, (f, h, p, t) in enumerate(ops.ENTITY_QUERIES)),
    "query_texts_region": "WITH e AS (SELECT s_suppkey AS code, s_name AS name, '\"' || CASE WHEN s_acctbal > 5000 THEN 'Dept ' || s_suppkey ELSE s_name || ' Department of Aviation' END || '\"' AS wide, "
        "'\"' || CASE WHEN s_acctbal > 5000 THEN 'Dept ' || s_suppkey ELSE s_name END || '\"' AS near, CASE WHEN s_acctbal < 7000 THEN 'r' || s_suppkey || '.gov' END AS host FROM supplier)\n" + "\nUNION ALL ".join(
        "SELECT code AS region, '{f}' AS family, {i} AS ord, {t} AS query FROM e WHERE true{h}".format(
            f=f, i=i, t="'" + t.replace("{name}", "' || name || '").replace("{agency}", "' || near || '" if h else "' || wide || '").replace("{host}", "' || host || '") + "'",
            h=" AND host IS NOT NULL" if h else "") for i, (f, h, t) in enumerate(ops.REGION_QUERIES)),
    "query_seed_steps": """SELECT c_custkey AS entity, 0 AS ord, 'open_web' AS step, '"' || c_name || '" ' || c_custkey || ' "master plan"' AS query FROM customer
UNION ALL SELECT c_custkey, 1, 'seed_host', 'site:a.gov ' || c_custkey || ' "master plan"' FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 6000""",
    "query_followups": f"""{VOTES_SQL},
top AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, host) AS pos FROM sc QUALIFY pos <= 5),
best AS (SELECT entity, arg_min(host, pos) AS best FROM top GROUP BY 1),
sg AS (SELECT entity, coalesce(bool_or(confirm AND kind = 'master_plan'), false) AS has_whole, coalesce(bool_or(confirm AND kind = 'alp'), false) AS has_alp, coalesce(bool_or(confirm AND kind = 'chapter'), false) AS has_chapter FROM tr GROUP BY 1),
y AS (SELECT entity, seq, unnest(ys) AS year, unnest(range(len(ys))) AS p FROM (SELECT entity, seq, list_concat(regexp_extract_all(coalesce(title, ''), '\\b(19[89]\\d|20[0-2]\\d)\\b', 1),
   regexp_extract_all(url, '\\b(19[89]\\d|20[0-2]\\d)\\b', 1), regexp_extract_all(coalesce(snippet, ''), '\\b(19[89]\\d|20[0-2]\\d)\\b', 1)) AS ys FROM tr WHERE confirm OR explore)),
yr AS (SELECT entity, arg_min(year, row(seq, p)) AS year FROM y WHERE year <> '2008' GROUP BY 1),
c AS (SELECT entity, 'lock_host' AS step, pos AS r, 'site:' || host || ' ' || entity || ' "master plan"' AS query FROM top WHERE host <> 'example.gov' AND host <> entity || '.example.gov'
  UNION ALL SELECT entity, 'fill_alp', 100, 'site:' || best || ' ' || entity || ' "airport layout plan"' FROM best JOIN sg USING (entity) WHERE NOT has_alp
  UNION ALL SELECT entity, 'fill_whole', 101, 'site:' || best || ' ' || entity || ' ' || coalesce(year || ' AMP OR "final" "master plan"', '"final" AMP OR "complete" "master plan"') FROM best JOIN sg USING (entity) LEFT JOIN yr USING (entity) WHERE has_chapter AND NOT has_whole
  UNION ALL SELECT entity, 'fill_diagram', 102, 'site:' || best || ' ' || entity || ' "airport diagram"' FROM best JOIN sg USING (entity) WHERE NOT has_alp),
d AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY r, query) AS pos FROM c WHERE query <> 'site:example.gov ' || entity || ' "master plan"')
SELECT entity, query, step, pos FROM d WHERE pos <= 2""",
    "value_texts": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(round_even(round_even(o_totalprice, 2), 0) AS BIGINT) END AS amount,
  CASE WHEN o_orderkey * 10 BETWEEN 20000 AND 80000 THEN DATE '1899-12-30' + CAST(o_orderkey * 10 AS INTEGER) END AS day, CASE WHEN year(o_orderdate) >= 2000 THEN CAST(year(o_orderdate) AS INTEGER) ELSE 2001 END AS fiscal_year, '2025-2029' AS edition,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 7 WHEN o_orderpriority <> '2-HIGH' AND o_orderkey > 0 AND o_orderkey < 5000000 THEN o_orderkey END AS count,
  CAST(round_even(o_orderkey + 0.5, 0) AS BIGINT) AS rounded, regexp_replace(o_orderpriority || ' / ' || o_orderstatus, '[^A-Za-z0-9]', '-', 'g') AS slug FROM orders""",
    "date_texts": """SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') END AS feed, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m') END AS month,
  CASE WHEN event_type <> 'error' THEN strftime(ts - INTERVAL 8 HOUR, '%Y-%m') END AS local_month, event_type <> 'error' AND date_trunc('second', ts) >= TIMESTAMP '2024-01-13 00:00:00' AS recent FROM events""",
    "source_csv_round_trip": """SELECT p_partkey, p_name || ', "' || p_type || '"' AS p_name, p_size, 'none' AS p_extra FROM part""",
    "source_json_lines": """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_type = 'error' THEN 'x' || props END AS bad_line FROM events""",
    "source_typed": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'federal' WHEN '2-HIGH' THEN 'state' WHEN '3-MEDIUM' THEN 'local' ELSE 'other' END AS level, 0 AS n_programs, CAST(round_even(o_totalprice, 0) AS BIGINT) AS amount FROM orders""",
    "source_sheet_rows": """SELECT o_orderstatus AS sheet, o_orderkey + 10 AS row, 'C' || o_custkey AS entity, CAST(round_even(round_even(o_totalprice, 2), 0) AS BIGINT) AS amount, 'Repair of ' || o_orderpriority AS description, 'CARES' AS tag FROM orders""",
    "source_sheet_titles": """SELECT DISTINCT o_orderstatus AS sheet, 'FY 2025 ' || o_orderstatus AS title, 2025 AS fiscal_year FROM orders""",
    "source_listing_pages": """SELECT o_orderkey, 2000 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS year, 'https://www.example.gov/airports/aip/grant_histories/200' || substr(o_orderpriority, 1, 1) || '/?k=' || o_orderkey AS url FROM orders""",
    "source_workbooks": """SELECT o_orderkey, 'https://www.example.gov/f/' || CASE o_orderstatus WHEN 'F' THEN 'grants-' || o_orderkey || '.xlsx' WHEN 'O' THEN 'zfy' || year(o_orderdate) || '.XLSX' ELSE 'fy' || year(o_orderdate) || '-by-state.xlsx' END AS url FROM orders""",
    "source_current_cycle": "SELECT o_orderkey, 'https://nfdc.faa.gov/webContent/28DaySub/extra/' || strftime(o_orderdate, '%d_%b_%Y') || '_APT_CSV.zip' AS url FROM orders",
    "sink_bulk_export": f"""WITH {DOCS_SQL} SELECT CAST(id AS VARCHAR) AS id, kind, entity AS airport_lid, region AS state, title, source_url, completeness, CASE WHEN kind <> 'alp' THEN content_sha256 ELSE '' END AS content_sha256 FROM docs WHERE listed""",
    "sink_sorted_lines": "SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer",
    "sink_idempotent_append": "SELECT user_id || ':' || event_type AS event_key, min(ts) AS at, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1".replace(" AS at", ' AS "at"'),
    "sink_release_inventory": "SELECT 'half=false' AS folder, 'changed' AS state WHERE EXISTS (SELECT 1 FROM pages WHERE length(html) <= 2000)",
}
ORACLE["search_last_hits"] = ORACLE["search_scoped"].replace("{pos}", "pos BETWEEN 97 AND 100")
ORACLE["search_scoped"] = ORACLE["search_scoped"].replace("{pos}", "pos <= 8")
ORACLE["source_bad_lines"] = """WITH l AS (SELECT l_returnflag || l_linestatus AS status, l_orderkey, l_linenumber, l_quantity,
  row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY l_orderkey, l_linenumber, l_quantity) AS line FROM lineitem)
SELECT status, line, substr('{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber, 1, 20) AS text FROM l WHERE l_quantity = 50"""
