"""Text operators against literal passages."""

import pytest
from pyspark.sql import functions as F

from plainledger.operators import text as ops


def facts(spark, text):
    rows = spark.createDataFrame([(1, text)], "id int, text string")
    return {r["label"]: r["value"] for r in ops.fact_rows(rows, ["id"], "text").collect()}


def outlook(spark, text):
    rows = spark.createDataFrame([(text,)], "text string")
    return ops.signal_scores(rows, "text").select(ops.trajectory("decline", "grow", "hold").alias("t")).first()["t"]


def test_runways_of_a_table(spark):
    found = facts(spark, "PDX has two parallel runways, Runways 10R-28L (south runway) and 10L-28R (north runway), and a crosswind runway, Runway 3-21. "
                         "Table 3-1 Dimensions 11,000' x 150' 9,825' x 150' 6,000' x 150'.")
    assert found["Runways"] == "10R/28L, 11,000 by 150 ft\n3/21, 9,825 by 150 ft"


def test_runway_phrases(spark):
    assert facts(spark, "Runway 14/32 is 3,425 feet long and 100 feet wide. There are currently 58 based aircraft.") == {
        "Runways": "14/32, 3,425 by 100 ft", "Based aircraft": "58 based"}
    assert facts(spark, "It has one paved runway (7/25). The usable length is 2,800 feet. The runway is 60 feet wide.")["Runways"] == "7/25, 2,800 by 60 ft"
    assert facts(spark, "The field has three runways.")["Runways"] == "3"
    assert facts(spark, "This chapter states the study purpose only.") == {}


def test_aircraft_and_hangars(spark):
    found = facts(spark, "Of these 30 are stored in hangars, while the remaining ten are stored outside. A 10-unit T-hangar, (8 unit) T-hangar, 7 hangar buildings. "
                         "The field is non-towered with a pilot lounge, no FBO, and tiedown spots.")
    assert found["Based aircraft"] == "40 based"
    assert found["Hangared aircraft"] == "30 in hangars · 10 on tiedowns"
    assert found["Hangars"] == "2 T-hangars (18 units) · 7 buildings"
    assert found["Facilities"] == "Non-towered · pilot lounge · no FBO · tiedowns"


def test_operations_skip_forecasts(spark):
    pad = "word " * 40
    assert facts(spark, f"There were 12,500 annual operations in 2019. {pad} The forecast is 99,000 annual operations in 2035.")["Operations"] == "12,500 a year (2019)"
    assert facts(spark, "The field currently sees over 8,000 annual operations.")["Operations"] == "8,000 a year"


def test_surface(one):
    assert one(ops.runway_line(F.lit("7/25"), F.lit(3040), F.lit(75), F.lit("ASPH"))) == "7/25, 3,040 by 75 ft · Asphalt"
    assert one(ops.surface_label(F.lit("ASPH-CONC-G"))) == "Asphalt and concrete"
    assert one(ops.with_surface(F.lit("10L/28R, 9,825 by 150 ft"), F.create_map(F.lit("10L/28R"), F.lit("ASPH")))) == "10L/28R, 9,825 by 150 ft · Asphalt"


@pytest.mark.parametrize("text", [
    "The preferred alternative includes a runway extension and additional hangars so the airport can expand capacity for based aircraft over the next twenty years.",
    "The preferred development alternative includes T-hangar development of one row and a proposed apron expansion with taxilane extensions to serve new hangars so the airport can expand capacity over the next twenty years.",
    "PAC input, crafting a preferred alter-\nnative with project phasing and future hangar development on the north side of the airfield.",
])
def test_growth(spark, text):
    found = outlook(spark, text)
    assert found["band"] == "growing" and found["position"] > 0.35


def test_holding(spark):
    found = outlook(spark, "The preferred alternative is to maintain existing length. There are no plans to extend the runway. Reconstruct the runway pavement and "
                           "continue to operate as a reliever airport serving the same class of aircraft.")
    assert found["band"] == "maintaining" and abs(found["position"]) <= 0.35


def test_denied_growth(spark):
    found = outlook(spark, "There are absolutely no plans to extend the runway beyond its present length. The city will maintain existing facilities and reconstruct "
                           "pavement as needed so the airport can continue to operate for general aviation.")
    assert found is None or found["band"] == "maintaining"


@pytest.mark.parametrize("text", [
    "This chapter states the study purpose only.",
    "Runway 7/25 is a 4,500-foot runway. The inventory chapter lists hangars and the existing terminal building only.",
    "The inventory lists existing hangar development areas and the corporate hangar development located closest to Runway 20. This chapter states the study purpose only.",
])
def test_weak_signal(spark, text):
    assert outlook(spark, text) is None


def test_excerpt(one):
    toc = "Table of contents " + "...." * 30
    body = "Narrative padding " + "word " * 10
    assert one(ops.excerpt(F.array(F.lit(toc), F.lit("short"), F.lit(body), F.lit(body)))) == body.strip() + "\n\n" + body.strip()


def test_assertions(spark):
    pages = spark.createDataFrame([(57, "CITY OF  BROOKINGS airport fees 13,100 and contingency $131,003 ﬁnal")], "page int, text string")
    rows = [(57, "city", "sequence", ["City of Brookings"], None, None), (57, "fees", "sequence", ["3,100"], None, None),
            (57, "both", "all_of", ["131003", "final"], None, None), (57, "near", "window", ["131,003"], "contingency", 30),
            (57, "far", "window", ["131,003"], "city", 30)]
    asserted = spark.createDataFrame(rows, "page int, id string, kind string, terms array<string>, anchor string, max_characters int")
    assert sorted(r["id"] for r in ops.assertion_misses(pages, asserted, "page").collect()) == ["far", "fees"]


def test_every_name_of_html(spark):
    """All names of the HTML standard, with text around them, as Python's parser decodes them."""
    import html as plain
    from html.entities import html5

    from plainledger.functions import html

    texts = [f"x &{name} y&{name}z &amp;{name}" for name in html5] + [
        "&notit; &notin; &copy2024 &ampamp; &unknown; && & &; &#65;&#x42; &#0; &#xD800; plain", "&CounterClockwiseContourIntegral;&x",
        None, "", "&amp;lt; &#38;lt; &AMP;&amp", "a &ltb &gtc"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = {r["i"]: r["x"] for r in rows.select("i", html.decode_entities("t").alias("x")).collect()}
    kept = {"&#0;": "\ufffd", "&#xD800;": "\ufffd"}
    for i, text in enumerate(texts):
        want = text if text is None else plain.unescape(text)
        for reference, mark in kept.items():
            if text and reference in text:
                want = want.replace(mark, reference, 1)
        assert got[i] == want, text


def test_chunks_of_a_long_text(spark):
    """Twenty million characters in linear time: nothing is lost, and twice the text takes no four times as long."""
    import time

    from plainledger.functions import html

    def took(n):
        started = time.perf_counter()
        parts = list(html.cut_text("word and more " * (n // 14), 2000))
        return time.perf_counter() - started, parts

    short, _ = took(10_000_000)
    long, parts = took(20_000_000)
    assert long < 4 * short + 1 and " ".join(parts).split() == ["word", "and", "more"] * (20_000_000 // 14)
    assert max(map(len, parts)) <= 2000
    rows = [(1, "aaa bb  c\tdd " * 3, "k"), (2, None, "k"), (3, "  ", "k"), (4, "x" * 25, "k"), (5, "word and more " * 100_000, "k")]
    df = spark.createDataFrame(rows, "id int, text string, chunk_of string")
    got = html.text_chunks(df, "text", 10)
    assert got.columns == ["id", "chunk_of", "pos", "chunk"]
    found = {}
    for r in got.orderBy("id", "pos").collect():
        found.setdefault(r["id"], []).append(r["chunk"])
    assert found[4] == ["x" * 10, "x" * 10, "x" * 5] and set(found) == {1, 4, 5}
    assert found[1] == list(html.cut_text(rows[0][1], 10)) and all(len(c) <= 10 for c in found[1])
    assert " ".join(found[5]).split() == rows[4][1].split()


def test_signals_equal_a_plain_scan(spark):
    """Overlapping, negated and capped hits, the default signals included, as a scan by hand counts them."""
    import random
    import re

    from pyspark.sql import functions as F

    from plainledger.operators import text as ops
    from plainledger.rules import text as rules

    def scan(text, pattern, negatable):
        n = 0
        for match in re.finditer(f"(?i){pattern}", text):
            before = text[max(0, match.start() - rules.NEGATION_REACH):match.start()]
            n += not (negatable and re.search(rf"(?i)\b(?:{'|'.join(rules.NEGATIONS)})\b", before))
        return n

    rnd = random.Random(8)
    words = ["not", "No", "cannot", "the", "airport", "close", "closing", "runway", "shorten", "reduced", "length", "expand",
             "hangar", "development", "industrial", "surplus", "property", "ab", "aba", "x" * 20, "land", "release", "neither."]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += ["no " + "y" * 45 + "close the airport", "no " + "y" * 46 + " close the airport", "not close airport closing", "abababa no ababa"]
    signals = [(p, n) for _, p, _, n in rules.SIGNALS] + [("aba", True), ("(a)b(a)", True), ("aba", False), (r"airport clos\w+|closing the", True)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    columns = [ops.signal_hits(F.col("t"), p, n).alias(f"c{k}") for k, (p, n) in enumerate(signals)]
    total = 0
    for row in df.select("i", *columns).collect():
        want = [scan(texts[row["i"]], p, n) for p, n in signals]
        assert list(row)[1:] == want, texts[row["i"]]
        total += sum(want)
    assert total > 100


def test_surfaces_only_where_a_line_shows_none(spark):
    facts = spark.createDataFrame(
        [(1, "Runways", "3/21, 5,000 by 75 ft\n4/22, 900 by 60 ft"), (2, "Runways", "3/21, 5,000 by 75 ft · Turf"), (3, "Runways", "2")],
        "entity long, label string, value string")
    rows = spark.createDataFrame([(1, 1, "3-21", "CONC"), (1, 2, "3 - 21", "ASPH"), (2, 1, "3/21", "CONC")], "key long, seq long, runway string, surface string")
    got = {r["entity"]: r["value"] for r in ops.with_surfaces(facts, rows).collect()}
    assert got == {1: "3/21, 5,000 by 75 ft · Asphalt\n4/22, 900 by 60 ft", 2: "3/21, 5,000 by 75 ft · Turf", 3: "2"}


def test_words_to_pages_in_order_and_without_blanks(spark):
    words = spark.createDataFrame(
        [(1, 1, 1, 1, 2, " b ", 7.0), (1, 1, 1, 1, 1, "a", -1.0), (1, 1, 2, 0, 1, "d", 4.0), (1, 2, 1, 0, 1, "e", None),
         (1, 1, 1, 2, 1, "c", 1.0), (1, 1, 1, 3, 1, " ", 90.0), (2, 1, 1, 1, 1, "x", -1.0), (3, 1, 1, 1, 1, "", 5.0)],
        "doc int, block int, par int, line int, seq int, text string, conf double")
    lists = words.groupBy("doc", "block", "par", "line").agg(F.collect_list(F.struct("seq", "text", "conf")).alias("words"))
    for pages in (ops.words_to_pages(words, ["doc"]), ops.lines_to_pages(lists, ["doc"])):
        assert sorted(map(tuple, pages.collect())) == [(1, "a b\nc\nd\ne", 5, 4.0), (2, "x", 1, None)]
