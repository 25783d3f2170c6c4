"""Scalar rules against literal rows."""

import datetime

from pyspark.sql import functions as F

from plainledger.functions import dates, html, urls
from plainledger.functions import values as v
from plainledger.operators import funding, registry
from plainledger.sources import tables


def test_numbers(one):
    assert one(v.to_float("x0"), x0="N/A") is None
    assert one(v.to_float("x0"), x0="oops") is None
    assert one(v.to_int("x0"), x0="2.5") == 2
    assert one(v.to_int("x0"), x0="3.5") == 4
    assert one(v.money("x0"), x0="$1,234.50") == 1234
    assert one(v.count_from_text("x0"), x0="11,000") == 11000
    assert one(v.count_from_text("x0"), x0="Two") == 2
    assert one(v.count_from_text("x0"), x0="0") is None
    assert one(v.first_number("a", "b"), a=0, b=7) == 7


def test_names_and_flags(one):
    assert one(v.place_name("x0"), x0="O'HARE") == "O'Hare"
    assert one(v.place_name("x0"), x0="McAllen") == "McAllen"
    assert one(v.to_flag("x0"), x0=" yes ") is True
    assert one(v.to_flag("x0"), x0="n") is False


def test_dates(one):
    assert one(v.serial_date("x0"), x0="45847") == datetime.date(2025, 7, 9)
    assert one(v.serial_date("x0"), x0="12") is None
    assert one(v.fiscal_year("a", "b"), a="x", b="FY_2025 list") == 2025
    assert one(dates.rfc822("x0"), x0="2026-08-09T07:05:03Z") == "Sun, 09 Aug 2026 07:05:03 +0000"
    assert one(dates.rfc822("x0"), x0="2026-08-09") is None
    assert one(dates.zone_month(dates.parse_iso("x0")), x0="2026-08-01T03:00:00Z") == "2026-07"


def test_fuel(one):
    assert one(registry.fuel_labels("x0"), x0="A 100LL") == "Jet A · 100LL"
    assert one(registry.fuel_labels("x0"), x0="100LL,MOGAS") == "100LL · mogas"
    assert one(registry.fuel_labels("x0"), x0="none") == "none"


def test_grant_texts(one):
    text = "Reconstruct Taxiway, Rehabilitate Taxiway, Rehabilitate Taxiway"
    assert one(funding.grant_title("x0"), x0=text) == "Reconstruct Taxiway"
    assert one(funding.grant_brief("x0"), x0=text) == "Rehabilitate Taxiway, Rehabilitate Taxiway"
    assert one(funding.award_key("x0"), x0="3-41-0048-064-2025") == "34100480642025"
    assert one(funding.award_key("x0"), x0="PDX") is None


def test_spend_category(one):
    def kind(text, planning=False):
        return one(funding.spend_category("x0", "p"), x0=text, p=planning)

    assert kind("Reconstruct Taxiway") == "maintenance"
    assert kind("Construct New Runway 3") == "growth"
    assert kind("Expand Terminal Concourse") == "growth"
    assert kind("anything", True) == "planning"
    assert kind("Zero Emissions Infrastructure") == "other"


def test_urls(one):
    def join(base, href):
        return one(urls.resolve("a", "b"), a=base, b=href)

    assert join("https://x.com/a/b/c.html?x=1", "../d.pdf#z") == "https://x.com/a/d.pdf"
    assert join("http://h/a", "//o/x") == "http://o/x"
    assert join("http://h/a/", "?q") == "http://h/a/?q"
    assert one(urls.file_name("x0"), x0="https://h/a/b%20c+d.pdf?q") == "b c+d.pdf"
    assert one(urls.file_name("x0"), x0="https://h/") == "download"
    assert one(urls.host("x0"), x0="https://WWW.Port.Gov/x") == "port.gov"
    assert one(urls.same_resource("a", "b"), a="http://h/x/", b="http://H/x") is True
    assert one(urls.host_matches("x0", "example.com"), x0="https://a.example.com:8080/") is True
    assert one(urls.host_matches("x0", "example.com"), x0="https://badexample.com/") is False
    assert one(urls.prose_urls("x0"), x0="see http://a/b). and http://a/b") == ["http://a/b"]


def test_html(one):
    assert one(html.clean_text("x0"), x0="<p>a&nbsp;&amp; b&#233;</p>\n<br>c") == "a & bé c"
    assert one(html.page_title("x0"), x0="<TITLE>\n A &lt;b </title>") == "A <b"
    long = "word " * 200
    assert one(html.page_excerpt("x0"), x0=long) == ("word " * 80).strip()


def test_chunks_cover_the_text():
    text = " ".join(f"w{i}" for i in range(5000)) + "x" * 900
    chunks = list(html.cut_text(text, 500))
    assert all(0 < len(c) <= 500 for c in chunks)
    assert "".join(chunks).replace(" ", "") == text.replace(" ", "")


def test_sniff(one):
    assert one(tables.sniff_media("x0"), x0="%PDF-1.7") == "pdf"
    assert one(tables.sniff_media("x0"), x0=" \n<!doctype HTML><p>") == "html"
    assert one(tables.sniff_media("x0"), x0="<head></head><body>") == "html"
    assert one(tables.sniff_media("x0"), x0="PK") == "other"


def test_scope():
    assert registry.parse_scope(None, ["OR", "WA"]) == ["OR"]
    assert registry.parse_scope("or; wa", ["OR", "WA"]) == ["OR", "WA"]
    assert registry.parse_scope("*", ["OR"]) is None
    try:
        registry.parse_scope("ZZ", ["OR"])
    except ValueError:
        return
    raise AssertionError("unknown code was accepted")


def test_truthy_and_percent(one):
    assert one(v.percent(F.lit(5), F.lit(40))) == 12
    assert one(v.percent(F.lit(5), F.lit(0))) == 0


def test_bad_lines_of_a_split_file(spark, tmp_path):
    """Files of many splits, blank lines and line ends of both kinds: each bad line has its own number."""
    from pyspark.sql import types as T

    want = set()
    for name in ("one", "two"):
        lines = []
        for i in range(1, 4001):
            bad, blank = i % 371 == 5, i % 100 == 0
            lines.append("" if blank else f'{{"k": {i}' if bad else f'{{"k": {i}, "t": "{"x" * (i % 50)}"}}')
            if bad and not blank:
                want.add((name, i, lines[-1]))
        (tmp_path / f"{name}.json").write_bytes(("\r\n" if name == "two" else "\n").join(lines).encode())
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "5000")
    try:
        rows = tables.read_jsonl(spark, str(tmp_path), T.StructType.fromDDL("k long, t string"), "report")
        assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = rows.collect()
    finally:
        spark.conf.set(key, old)
    bad = {(r["_file"].rsplit("/", 1)[1][:3], r["_line"], r[tables.BAD_LINE]) for r in got if r[tables.BAD_LINE] is not None}
    assert bad == want
    assert all(r["_line"] == r["k"] for r in got if r[tables.BAD_LINE] is None) and len(got) == 2 * 3960


def test_names_without_semicolon_are_a_choice(one):
    raw = "<title>the&amp;&amp</title> &copy; &amp&amp; &lt &#65;"
    assert one(html.clean_text("x0"), x0=raw) == "the&& © && < A"
    assert one(html.clean_text("x0", bare_names=False), x0=raw) == "the&&amp © &amp& &lt A"


def test_report_titles_keep_open_names(spark):
    from plainledger.operators import web

    rows = spark.createDataFrame([(1, "https://a.gov/x", "<title>the&amp;&amp</title><a href='/b'>on&amp</a>")], "page_id int, url string, html string")
    links = web.classified_links(web.page_links(rows, "page_id", "url", "html", bare_names=False))
    follows = web.list_followups(rows, "page_id", "url", "html")
    report = web.page_report(rows, links, follows, "page_id", "url", "html", bare_names=False).first()
    assert (report["title"], report["n_links"], links.first()["label"]) == ("the&&amp", 1, "on&amp")
