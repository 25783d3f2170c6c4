"""Audit and status operators against literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from plainledger.operators import ops, search, versions, web
from plainledger.rules import ops as rules
from plainledger.sources import exports, tables


def test_buckets(one):
    def bucket(job, review, **scores):
        return one(ops.outcome_bucket(F.lit(job), F.lit(review), {k: F.lit(x) for k, x in scores.items()}))

    assert [bucket(s, None) for s in ("ssi", "dead", "not_plan")] == ["failed"] * 3
    assert bucket("needs_human", None) == "needs_human"
    assert bucket(None, "auto_pass") == "accepted"
    assert bucket(None, "pending") == "uncertain" and bucket("preserved", None) == "uncertain"
    assert bucket("live", None, confirm_score=3.0, publish_score=9.0, explore_score=9.0) == "uncertain"
    assert bucket("live", None) == "accepted"


def test_probe(one):
    def probe(code, final="http://h/x"):
        return one(ops.probe_status(F.lit(code), F.lit("http://h/x/"), F.lit(final), F.lit(False)))

    assert [probe(404), probe(503), probe(200), probe(200, "http://h/y"), probe(403)] == ["dead", "error", "live", "moved", "error"]


def test_recheck(one):
    day = F.lit(dt.date(2026, 8, 1))

    def due(status, checked, url="http://x"):
        return one(ops.is_due(F.lit(url), F.lit(status), F.lit(checked).cast("date"), day))

    assert due("live", "2026-07-25") and not due("live", "2026-07-26")
    assert due("dead", "2026-07-02") and not due("dead", "2026-07-25")
    assert due("live", None) and not due("live", None, "ftp://x")


def test_tiers(spark):
    now = F.lit("2026-08-22 00:00:00").cast("timestamp")
    entities = spark.createDataFrame([(k, "OR", r) for k, r in (("PDX", True), ("TTD", False), ("EUG", False), ("OLD", True), ("NOP", False), ("PUB", False))],
                                     "key string, region string, in_registry boolean")
    funded = spark.createDataFrame([("PDX", 100), ("EUG", 200)], "entity string, funded long")
    rows = [("PDX", "ok", dt.datetime(2026, 8, 20), None, dt.datetime(2026, 8, 20)), ("OLD", "ok", dt.datetime(2026, 1, 1), None, dt.datetime(2026, 1, 1)),
            ("NOP", "dead", dt.datetime(2026, 8, 20), dt.datetime(2026, 8, 20), None)]
    status = spark.createDataFrame(rows, "entity string, last_job_status string, last_job_at timestamp, explored_at timestamp, discovery_at timestamp") \
        .withColumn("snapshot_at", F.lit(None).cast("timestamp"))
    published = spark.createDataFrame([("PUB",)], "key string")
    out = [(r["key"], r["tier"]) for r in ops.ranked_work(entities, funded, status, published, now).collect()]
    assert out == [("EUG", 0), ("TTD", 1), ("OLD", 1), ("PDX", 2), ("NOP", 4), ("PUB", 5)]


def test_first_sight_keeps_its_expiry(spark):
    rows = spark.createDataFrame([("h", dt.datetime(2026, 1, 1), "a"), ("h", dt.datetime(2026, 2, 1), "b")], "sha string, at timestamp, reason string")
    out = ops.first_seen_retention(rows, "sha", "at").first()
    assert (out["reason"], out["expires_at"]) == ("a", dt.datetime(2026, 4, 1))


def test_caps_and_rate_limits(one):
    assert [p.monthly_cap() for p in rules.PROVIDERS] == [6000, 5446, 6000]
    row = one(ops.rate_limit(F.lit("1;w=1, 15000;w=2592000"), F.lit("1, 15000"), F.lit("1, 14000"), F.lit("1, 1419704")))
    assert (row["limit"], row["remaining"], row["used"], row["reset"]) == (15000, 14000, 1000, 1419704)
    assert one(ops.rate_limit(F.lit("1;w=1, 15000;w=2592000"), F.lit("1, 15000"), F.lit("1"), F.lit(""))) is None


def test_next_per_entity(spark):
    rows = spark.createDataFrame([("PDX", 1), ("PDX", 2), (None, 3), (None, 4), ("TTD", 5)], "entity string, seq int")
    assert [r["seq"] for r in ops.next_per_entity(rows, "seq", 10).collect()] == [1, 3, 4, 5]


def test_numbering_survives_a_hot_value(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("v"))
    out = [r["batch"] for r in ops.batches(rows, "v", 100, ["id"]).orderBy("v", "id").collect()]
    assert out == [i // 100 for i in range(3000)]


def test_patches(spark):
    current = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y")], "id string, kind string, note string")
    ups = spark.createDataFrame([("a", '{"note":null}'), ("n", '{"kind":"k","source_url":"u"}'), ("thin", '{"kind":"k"}')], "id string, patch string")
    base = current.withColumn("source_url", F.lit("s")).withColumn("completeness", F.lit("complete"))
    out = {r["id"]: (r["kind"], r["note"], r["completeness"]) for r in versions.patch_rows(
        base, ups, "id", ["kind", "note", "source_url", "completeness"], ["source_url", "kind"], {"completeness": "missing"}).collect()}
    assert out == {"a": ("x", None, "complete"), "b": ("x", "y", "complete"), "n": ("k", None, "missing")}


def test_patch_of_a_list(spark):
    current = spark.createDataFrame([("a", ["x"], 1), ("b", ["x"], 2)], "id string, mirrors array<string>, n int")
    ups = spark.createDataFrame([("a", '{"mirrors":["y","z"],"n":7}'), ("n", '{"n":3}')], "id string, patch string")
    out = {r["id"]: (r["mirrors"], r["n"]) for r in versions.patch_rows(current, ups, "id", ["mirrors", "n"], ["n"], {"mirrors": "[]"}).collect()}
    assert out == {"a": (["y", "z"], 7), "b": (["x"], 2), "n": ([], 3)}


def test_replace_deletes_only_in_the_new_generation(spark):
    schema = "entity_type string, entity_key string, payload string, sha string"
    old = spark.createDataFrame([("d", "a", "1", "1"), ("d", "b", "2", "2"), ("d", "c", "3", "3")], schema)
    new = spark.createDataFrame([("d", "a", "1", "1"), ("d", "b", "9", "9"), ("d", "n", "4", "4")], schema)
    diff = versions.replace_diff(old, new)
    assert {r["entity_key"]: r["change"] for r in diff.collect()} == {"b": "changed", "c": "deleted", "n": "inserted"}
    after = versions.apply_changes(old, diff)
    assert versions.snapshots_equal(after.select("entity_key", "sha"), new.select("entity_key", "sha")).count() == 0
    assert old.count() == 3


def test_digest_ignores_order(spark):
    rows = spark.range(1000).withColumn("x", F.when(F.col("id") % 7 == 0, None).otherwise("v"))
    same = versions.unchanged(rows, rows.orderBy(F.col("id").desc()).repartition(5)).first()
    assert same["same"]
    twice = rows.unionByName(rows.limit(2))
    assert not versions.unchanged(rows, twice).first()["same"]


def test_redaction(one):
    text = 'x "apiKey" : "AIzaSyABC" data-sitekey="k1" sk_live_9Z name="csrf-token"  content="t" end'
    clean = one(web.redact("x0"), x0=text)
    assert "AIzaSy" not in clean and "sk_live_9Z" not in clean and 'data-sitekey="REDACTED"' in clean
    assert one(web.has_secret("x0"), x0=text) is True and one(web.has_secret("x0"), x0=clean) is False
    assert one(web.redact_log("x0", ["topsecret1"]), x0="via socks5://u:p@h Bearer abc topsecret1") == "via socks5h://redacted Bearer redacted redacted"


def test_gate(one):
    def gate(url, content, html=False):
        return one(web.gate(F.lit(url), F.lit(None).cast("string"), F.lit(content), F.lit(len(content)), html))

    assert gate("https://x/PDX_ALP_SSI_sheet.pdf", "%PDF") == "ssi"
    assert gate("https://x/news/a.pdf", "%PDF") == "not_plan"
    assert gate("https://en.wikipedia.org/a.pdf", "%PDF") == "not_plan"
    assert gate("https://x/a", "<html>", True) == "ok" and gate("https://x/a", "<html>") == "not_file"


def test_source_families(one):
    def family(**k):
        base = dict(status=200, error=None, artifacts=0, followups=0, hub="other", url="http://x/")
        base.update(k)
        return one(web.source_family(*[F.lit(base[n]) for n in ("status", "error", "artifacts", "followups", "hub", "url")]))

    assert [family(status=403), family(status=404), family(followups=1), family(artifacts=40), family(hub="master_plan"), family()] == [
        "bot_wall", "dead", "sharepoint_list", "document_dump", "plan_hub", "facility_page"]
    assert family(url="http://x/wp-content/", artifacts=2) == "wordpress_docs" and family(url="http://x/a.pdf", artifacts=1) == "bound_pdf"


def test_links_first_use(spark):
    html = '<a href="/a.pdf#p">Master Plan</a><a href="/a.pdf">again</a><a href="mailto:x">m</a><a href="/p/">self</a><a href=\'../ALP.pdf\'>x <b>y</b></a><a href="http://en.wikipedia.org/w">w</a>'
    pages = spark.createDataFrame([(1, "https://h/p", html)], "id int, url string, html string")
    links = web.classified_links(web.page_links(pages, "id", "url", "html"))
    out = {r["url"]: (r["label"], r["role"], r["kind"]) for r in links.collect()}
    assert out == {"https://h/a.pdf": ("Master Plan", "artifact", "master_plan"), "https://h/ALP.pdf": ("x y", "artifact", "alp"),
                   "http://en.wikipedia.org/w": ("w", "not_plan", "unknown")}


def test_search_limit_and_rank(spark):
    rows = [(f"page-{i}", "page", f"t{i}", "u", None, None, "master_plan", None, None, "", "the Runway plan", "d", i) for i in range(20)]
    rows.append(("airport-RUN", "airport", "RUN Runway Field", "u", "OR", "RUNWAY", None, None, "growing", "", "", None, None))
    records = spark.createDataFrame(rows, "id string, type string, title string, url string, region string, entity string, kind string, completeness string, "
                                          "outlook string, summary string, text string, document_id string, page int")
    queries = spark.createDataFrame([("q1", "RUNWAY", "all", ""), ("q2", "runway", "plans", ""), ("q3", "runway", "all", "growing")],
                                    "query_id string, needle string, scope string, outlook string")
    out = search.search(records, queries).collect()
    assert [len([r for r in out if r["query_id"] == q]) for q in ("q1", "q2", "q3")] == [8, 8, 1]
    assert [r["id"] for r in out if r["query_id"] == "q1" and r["pos"] == 1] == ["airport-RUN"]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("k", dt.datetime(2026, 1, 1), 1), ("k", dt.datetime(2026, 1, 2), 2), (None, dt.datetime(2026, 1, 3), 3)], "key string, at timestamp, n int")
    rows.limit(0).write.parquet(path)
    for _ in range(2):
        exports.append_events(rows.filter("key is not null"), path, "key")
    assert [r["n"] for r in spark.read.parquet(path).collect()] == [1]


def test_sheet_with_shared_alias(spark):
    cells = [("s", 1, 1, "FY 2025 grants"), ("s", 3, 1, "LocID"), ("s", 3, 2, "Total"), ("s", 3, 3, "Total Amount"), ("s", 3, 4, "CARES Amount"),
             ("s", 4, 1, "PDX"), ("s", 4, 2, "1"), ("s", 4, 3, "500000"), ("s", 4, 4, "500000"), ("s", 5, 1, "*AKS"), ("s", 5, 3, "7")]
    from plainledger.functions import values as v
    from plainledger.operators import funding
    from plainledger.rules.funding import GRANT_HEADERS

    rows = tables.map_sheet(spark.createDataFrame(cells, "sheet string, row int, col int, value string"), GRANT_HEADERS, "entity")
    kept = rows.filter(~F.col("entity").startswith("*")).select(
        v.money("total").alias("amount"), funding.program_tags(v.money("entitlement"), v.money("discretionary"), v.money("aig"), v.money("cares")).alias("tags")).collect()
    assert [tuple(r) for r in kept] == [(500000, ["CARES"])]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a":1}\nnot json\n{"a":2,"b":3}\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType())])
    assert [r["a"] for r in tables.read_jsonl(spark, str(path), schema, "skip").collect()] == [1, 2]
    bad = [r[tables.BAD_LINE] for r in tables.read_jsonl(spark, str(path), schema, "report").collect()]
    assert bad == [None, "not json", None]
    try:
        tables.read_jsonl(spark, str(path), schema, "fail").collect()
    except Exception:
        return
    raise AssertionError("a malformed line was accepted")


def test_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    saved = tables.file_inventory(spark, str(tmp_path)).collect()
    table = spark.createDataFrame(saved, "path string, bytes long, sha256 string")
    (tmp_path / "a.txt").write_text("three")
    (tmp_path / "b.txt").rename(tmp_path / "c.txt")
    states = {r["path"].rsplit("/", 1)[-1]: r["state"] for r in tables.compare_inventory(tables.file_inventory(spark, str(tmp_path)), table).collect()}
    assert states == {"a.txt": "changed", "b.txt": "removed", "c.txt": "added"}


def test_review_list_limits_and_counts(spark):
    docs = spark.createDataFrame([(k, "pending" if k % 2 else "published") for k in range(9)], "id long, review_status string")
    assert [(r["id"], r["n"]) for r in ops.review_list(docs, "pending", 0).collect()] == [(1, 4)]
    assert sorted(r["id"] for r in ops.review_list(docs, " ", 99_999).collect()) == list(range(9))
    assert ops.review_list(docs, "none").count() == 0


def test_health_names_each_blocker_once(spark):
    sets = spark.createDataFrame(
        [("a", [], "failed", True, None, "disk")], "name string, depends_on array<string>, status string, available boolean, healthy boolean, error string")
    jobs = spark.createDataFrame([("active", "fetch")], "state string, kind string")
    none = jobs.filter("false")
    row = ops.health_report(jobs, sets, ["a"], "a", none, none).first()
    assert row["blocking"] == ["a: failed (disk)"] and row["worker_detail"] and not row["worker_ok"] and not row["ok"]
    assert ops.health_report(jobs, sets, [], "a", jobs, none).first()["worker_ok"]
