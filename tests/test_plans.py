"""Plan shapes: pushdown, no row-by-row Python, no products, hot keys spread."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from plainledger.operators import funding, search, skew
from plainledger.operators import text as ops
from plainledger.sources import tables

SF = "/root/testdata/sf0.001"
# Streams and sinks run their job when called; their plan is that of a plain read.
EAGER = ("stream_", "sink_", "generation_export", "source_csv", "document_roots", "document_editions", "document_work_parts")
PYTHON = {"text_assertions"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if not n.startswith(EAGER)])
def test_plan(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text
    assert ("ArrowEvalPython" in text) == (name in PYTHON)


def test_projection_reaches_the_scan(spark):
    text = plan(entry.queries()["funding_total_by_entity"](spark, SF))
    scan = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "o_orderdate" not in scan and "o_totalprice" in scan


def test_filter_reaches_the_scan(spark):
    text = plan(entry.queries()["registry_entity_rows"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(c_acctbal", text)


def test_top_k_is_limited_before_the_shuffle(spark):
    text = plan(entry.queries()["funding_top_lines"](spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_either_or_join_is_an_equi_join(spark):
    text = plan(entry.queries()["funding_by_region"](spark, SF))
    assert "NestedLoop" not in text


def test_search_joins_on_keys(spark):
    assert "NestedLoop" not in plan(entry.queries()["search_scoped"](spark, SF))


def test_search_of_many_needles(spark):
    """50,000 needles, short, empty, null, odd and absent ones among them, against a plain scan."""
    texts = ["Harbour North-24 plan", "", None, "a\nb \U0001f600x", "north", "ab", "İstanbul 100%", "1234512345"]
    records = spark.createDataFrame(
        [(f"d{i}", "document", None if i == 1 else "Title", "/u", None, None, None, t) for i, t in enumerate(texts)],
        "id string, type string, title string, url string, kind string, outlook string, entity string, text string")
    words = ["", None, "a", "ab", "north", "NORTH", "\U0001f600x", "\U0001f600", "b \U0001f600", "title", "e a", "0%", "451", "zzz", "\n"]
    words += [str(n) for n in range(50_000)]
    asked = spark.createDataFrame([(i, w, "all", "") for i, w in enumerate(words)], "query_id long, needle string, scope string, outlook string")
    got = {(r["query_id"], r["id"]) for r in search.search(records, asked, limit=100).collect()}
    hays = {f"d{i}": f"{'' if i == 1 else 'Title'} {t or ''}".lower() for i, t in enumerate(texts)}
    want = {(i, d) for i, w in enumerate(words) if w is not None for d, h in hays.items() if w.lower() in h}
    assert got == want


def test_spread_join_equals_plain_join(spark):
    big = spark.range(5000).select("id", F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    for how in ("left", "inner", "left_semi"):
        a = skew.spread_join(big, small, ["k"], F.col("id"), how)
        b = big.join(small, "k", how)
        assert a.count() == b.count()
        assert a.select(b.columns).exceptAll(b).count() == 0


def test_hot_key_spans_tasks(spark):
    big = spark.range(20000).select("id", F.lit(1).alias("k"))
    small = spark.createDataFrame([(1, "x")], "k int, x string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = skew.spread_join(big, small, ["k"], F.col("id"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 10000


@pytest.mark.parametrize("key", ["case when id % 10 < 9 then null else id end", "case when id % 100 < 2 then 1 else id end"])
def test_null_and_lesser_hot_keys_span_tasks(spark, key):
    big = spark.range(40000).select("id", F.expr(key).cast("long").alias("k"))
    small = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = skew.spread_join(big, small, ["k"], F.col("id"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 40000 and max(sizes) < 40000 / 8 * 1.4


def test_numbering_within_groups(spark):
    rows = spark.range(2000).select(F.col("id").alias("v"), (F.col("id") % 3).alias("g"))
    out = skew.ordered_position(rows, "v", within=["g"]).collect()
    assert all(r["position"] == r["v"] // 3 + 1 for r in out)


def plain_search(records, needle, scope, band, low, high):
    found = []
    for r in records:
        hay = ((r["title"] or "") + " " + (r["text"] or "")).lower()
        shown = r["kind"] or r["type"]
        if band:
            fits = r["type"] == "airport" and r["outlook"] == band
        else:
            fits = shown in search.SCOPE_KINDS if scope == "plans" else r["type"] == "funding" if scope == "projects" else True
        if fits and needle.lower() in hay:
            rank = next((k for k, c in ((1, "entity"), (2, "title"), (3, "text")) if r[c] is not None and needle.lower() in r[c].lower()), 4)
            found.append((rank, r["id"]))
    return [(i, rank, pos) for pos, (rank, i) in enumerate(sorted(found), 1) if low < pos <= high]


def test_search_stops_at_the_best_hits(spark, monkeypatch):
    """A needle that all records hold confirms its heads only; rare needles of common grams meet the rest."""
    import random

    rnd = random.Random(6)
    words = ["plan", "airport", "runway", "and", "The", "ann", "abab", "bab", "x"]
    rows = []
    for i in range(1500):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 7))) + " common"
        kind = rnd.choice(["airport", "funding", "document"])
        rows.append((f"r{i:04}", kind, rnd.choice([None, "", "Plan x", "Title"]), f"/{i}", rnd.choice([None, "alp", "notice"]),
                     rnd.choice([None, "growing"]), rnd.choice([None, str(i), "AN"]), None if i % 50 == 0 else text + (" zebra plan" if i == 1400 else "")))
    schema = "id string, type string, title string, url string, kind string, outlook string, entity string, text string"
    records = spark.createDataFrame(rows, schema)
    needles = ["common", "plan", "an", "", "zebra plan", "abab bab", "nothing here", "PLAN X", "e c", "title "]
    asked = [(f"{n}|{s}|{o}", n, s, o) for n in needles for s, o in (("all", ""), ("plans", ""), ("projects", ""), ("all", "growing"))]
    asked.append(("null", None, "all", ""))
    queries = spark.createDataFrame(asked, "query_id string, needle string, scope string, outlook string")
    confirmed, pairs = search.confirmed, []
    monkeypatch.setattr(search, "confirmed", lambda p, r: pairs.append(p) or confirmed(p, r))
    plain = [dict(zip(schema.replace(" string", "").split(", "), r)) for r in rows]
    for limit, offset, heads in ((8, 0, 10), (8, 96, 64), (200, 0, 5)):
        pairs.clear()
        got = search.search(records, queries, limit, offset, heads).collect()
        want = {(q, *hit) for q, n, s, o in asked if n is not None for hit in plain_search(plain, n, s, o, offset, min(offset + limit, 100))}
        assert {(r["query_id"], r["id"], r["attribute"], r["pos"]) for r in got} == want
        if limit == 8 and not offset:
            # A query confirms at most its heads in each of the 18 groups, and the common needle nothing beyond.
            first = {r["query_id"]: r["count"] for r in pairs[0].groupBy("query_id").count().collect()}
            assert max(first.values()) <= 18 * heads
            assert not {"common|all|", "|all|"} & {r["query_id"] for r in pairs[1].select("query_id").distinct().collect()}


def test_only_the_rarest_grams_get_postings(spark, monkeypatch):
    """Grams are counted without postings, short, empty and odd ones as well; a needle of many takes one."""
    texts = ["north plan", "north", "", "a\U0001f600b", "é" * 5]
    rows = spark.createDataFrame(
        [(f"d{i}", "document", None, "/u", "alp" if i % 2 else None, None, "k", t) for i, t in enumerate(texts)],
        "id string, type string, title string, url string, kind string, outlook string, entity string, text string")
    asked = spark.createDataFrame([(i, w, "all", "") for i, w in enumerate(["north plan", "north", "", "\U0001f600", "é", "zz"])],
                                  "query_id long, needle string, scope string, outlook string")
    made, taken = search.postings, []
    monkeypatch.setattr(search, "postings", lambda r, g: taken.append({x["gram"] for x in g.collect()}) or made(r, g))
    got = {(r["query_id"], r["id"]) for r in search.search(rows, asked).collect()}
    assert got == {(0, "d0"), (1, "d0"), (1, "d1"), *((2, f"d{i}") for i in range(5)), (3, "d3"), (4, "d4")}
    assert len(taken[0]) <= 6

    monkeypatch.setattr(search, "PIECE_CHARS", 4)
    hays = rows.select("id", "type", F.coalesce("kind", "type").alias("_shown"), "outlook", "entity", "title", F.col("text").alias("_hay"))
    grams = ["nor", "n", "", "an", "\U0001f600b", "ééé", "xyz"]
    counts = search.group_counts(hays, spark.createDataFrame([(g,) for g in grams], "gram string"))
    want = {(g, "alp" if i % 2 else "document"): sum(g in t for t in texts[i % 2::2]) for g in grams for i in (0, 1)}
    assert {(r["gram"], r["_shown"]): r["n"] for r in counts.collect()} == {k: n for k, n in want.items() if n}


def test_search_by_group_and_depth_confirms_few(spark, monkeypatch):
    """A gram that others hold as well is followed a few steps, not to its end; a group without one of a needle's grams not at all."""
    key, first = F.col("id"), F.array(*map(F.lit, ("blue anvil", "large anvil", "blue plate", "large plate")))
    second = F.array(*map(F.lit, ("green bolt", "red bolt", "green vice")))
    rows = spark.range(2300).select(
        F.format_string("r%04d", key).alias("id"), F.when(key < 2000, "funding").otherwise("airport").alias("type"), F.lit("T").alias("title"),
        F.lit("/u").alias("url"), F.lit(None).cast("string").alias("kind"), F.when(key >= 2000, "growing").alias("outlook"), F.lit("k").alias("entity"),
        F.when(key < 2000, F.concat_ws(", ", F.get(first, key % 4), F.get(second, key % 3))).otherwise("iron bridge").alias("text"))
    asked = [("near", "blue anvil", "projects", ""), ("absent", "green bolt", "all", "growing"), ("rare", "plate, red", "all", "")]
    queries = spark.createDataFrame(asked, "query_id string, needle string, scope string, outlook string")
    confirmed, pairs = search.confirmed, []
    monkeypatch.setattr(search, "confirmed", lambda p, r: pairs.append(p) or confirmed(p, r))
    got = search.search(rows, queries, heads=4).collect()
    plain = [r.asDict() for r in rows.collect()]
    assert {(r["query_id"], r["id"], r["attribute"], r["pos"]) for r in got} == {
        (q, *hit) for q, n, s, o in asked for hit in plain_search(plain, n, s, o, 0, 8)}
    counts = {"near": 0, "absent": 0, "rare": 0}
    for p in pairs:
        counts |= {r["query_id"]: counts[r["query_id"]] + r["count"] for r in p.groupBy("query_id").count().collect()}
    assert counts["absent"] == 0 and counts["near"] <= 4 * search.DEEPER and counts["rare"] <= 4 * search.DEEPER


def large_sheet(spark):
    """One sheet of 2,000,000 cells below its title and header."""
    key = F.col("id")
    value = F.when(key == 0, "FY 2025").when(key == 2, "LocID").otherwise(F.concat(F.lit("c"), "id"))
    return spark.range(1 << 21).select(F.lit("F").alias("sheet"), key.alias("row"), F.lit(1).alias("col"), value.alias("value")).filter("row <> 1")


def test_cells_of_a_large_sheet_stay_in_their_tasks(spark):
    rows = tables.map_sheet(large_sheet(spark), {"entity": ["locid"]}, "entity")
    assert "SortMergeJoin" not in plan(rows)
    assert rows.filter("row in (3, 2097151)").orderBy("row").collect() == [("F", 3, "c3"), ("F", 2097151, "c2097151")]


def test_title_of_a_large_sheet_is_found_without_a_shuffle(spark):
    titles = tables.sheet_titles(large_sheet(spark), {"entity": ["locid"]}, "entity")
    assert "SortMergeJoin" not in plan(titles)
    assert titles.collect() == [("F", "FY 2025")]


def test_lines_of_a_file_in_parts_are_numbered_through(spark, tmp_path):
    for folder, name, text in (("a", "part-0", '{"k":1}\nx\n\n'), ("a", "part-1", "y\n"), ("b", "part-0", "z\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    bad = tables.read_jsonl(spark, f"{tmp_path}/*", T.StructType.fromDDL("k long"), "report", parts=True).filter(F.col(tables.BAD_LINE).isNotNull())
    assert sorted((r[tables.BAD_LINE], r["_line"]) for r in bad.collect()) == [("x", 2), ("y", 4), ("z", 1)]


def test_allocation_cube_holds_one_slice_at_a_time(spark):
    rows = spark.createDataFrame([(1, "a", 2000, 7, 5), (1, "a", 2001, 7, 3), (1, "b", None, 7, None), (1, None, 2000, 8, 1)],
                                 "region int, purpose string, fiscal_year int, entity long, amount long")
    cube = funding.allocation_cube(rows, "region")
    assert "Expand" not in plan(cube)
    got = {(r["slice"], r["purpose"], r["fiscal_year"], r["entity"], r["total"], r["n"], r["year_min"], r["year_max"]) for r in cube.collect()}
    assert {g for g in got if g[0] in ("entity", "purpose", "year")} == {
        ("entity", None, None, 7, 8, 3, 2000, 2001), ("entity", None, None, 8, 1, 1, 2000, 2000),
        ("purpose", "a", None, None, 8, 2, 2000, 2001), ("purpose", "b", None, None, 0, 1, None, None),
        ("purpose", None, None, None, 1, 1, 2000, 2000), ("year", None, 2000, None, 6, 2, 2000, 2000), ("year", None, 2001, None, 3, 1, 2001, 2001)}
    assert len(got) == 16


def test_words_are_shuffled_once_at_most(spark):
    text = plan(entry.queries()["text_word_pages"](spark, SF))
    exchange = re.findall(r"\n[^\n]*Exchange hashpartitioning\(([^\n]*)", text)
    assert len([e for e in exchange if "REPARTITION_BY_NUM" not in e]) == 1
    assert text.count("Generate ") == 1  # lines only: no row per word
    words = spark.createDataFrame([], "doc int, block int, par int, line int, seq int, text string, conf double")
    assert plan(ops.words_to_pages(words, ["doc"])).count("Exchange") == 1
