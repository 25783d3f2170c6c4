"""Evidence scoring and gated answers against labelled cases."""

import json
import re

import pytest
from pyspark.sql import functions as F

from plainledger.operators import evaluation as ev
from plainledger.operators import evidence as ops
from plainledger.rules.evidence import FIELDS

# (lid, name, url, label) and (same_airport, kind, confirm, explore, publish); address and label only.
CASES = [
    (("4S9", "Mulino State Airport", "https://www.oregon.gov/aviation/airports/Documents/4S9/Master%20Plan/2019/Mulino%20Final%20AMP%20July%202019.pdf", "Master Plan"), (True, "master_plan", True, False, True)),
    (("4S9", "Mulino State Airport", "https://www.oregon.gov/aviation/airports/Documents/4S9/ODA_Doc_4S9_ALP.pdf", "Airport Diagram"), (True, "alp", True, False, True)),
    (("4S9", "Mulino State Airport", "https://www.oregon.gov/aviation/Airports/Documents/4S9/Projects/Draft%20EA%206-11-2019%20completePart-2.pdf", "Draft Environmental Assessment"), (True, "not_plan", False, False, False)),
    (("4S9", "Mulino State Airport", "https://dochub.clackamas.us/documents/drupal/ce55dda2-3240-47ff-a5cc-9084415b5723", "Appendix A.6"), (False, "not_plan", False, False, False)),
    (("4S9", "Mulino State Airport", "https://en.wikipedia.org/wiki/Mulino_State_Airport", "Mulino State Airport"), (True, "not_plan", False, False, False)),
    (("4S9", "Mulino State Airport", "https://www.oregon.gov/aviation/Airports/Documents/UAO/Master%20Plan/6.%20Chapter%203%20-%20Forecasts.pdf", "Chapter Three Forecasts"), (False, "chapter", False, False, False)),
    (("4S9", "Mulino State Airport", "https://www.oregon.gov/aviation/agency/about/pages/be-informed.aspx", "Notice - Mulino State Airport - Waterline and Hangar Construction"), (True, "notice", False, False, False)),
    (("PDX", "Portland International Airport", "https://example.com/PDX_ALP_SSI_sheet.pdf", "ALP sheet"), (True, "alp", False, False, False)),
    (("PDX", "Portland International Airport", "https://www.oregon.gov/aviation/example/2025-27-LAB.pdf", "Legislatively Adopted Budget"), (False, "not_plan", False, False, False)),
    (("HIO", "Hillsboro Airport", "https://cdn.portofportland.com/pdfs/HIO_Ch1_Inventory.pdf", "Inventory"), (True, "chapter", True, False, True)),
    (("BVY", "Beverly Regional Airport", "https://beverlyairport.com/wp-content/uploads/2024/03/Commission-minutes.pdf", "Commission minutes"), (True, "notice", False, False, False)),
    (("DEN", "Denver International Airport", "https://www.flydenver.com/about-den/master-plan/", "Denver International Airport Master Plan"), (True, "hub", False, True, False)),
    (("ANC", "Ted Stevens Anchorage International Airport", "https://dot.alaska.gov/anc/passengers-master-plan.shtml", "Master Plan"), (True, "hub", False, True, False)),
    (("ANC", "Ted Stevens Anchorage International Airport", "https://dot.alaska.gov/anc/about/docs/Appendix%20K_Airport%20Layout%20Plan_Final.pdf", "Appendix K Airport Layout Plan"), (True, "alp", True, False, True)),
    (("AUS", "Austin-Bergstrom International Airport", "https://www.austintexas.gov/sites/default/files/images/Airport/Environmental/Master_Plan/Master_Plan_Chp7_Part1.pdf", "Chapter 7 Implementation Plan and Schedule"), (True, "chapter", True, False, True)),
    (("LEX", "Blue Grass Airport", "https://www.bluegrassairport.com/wp-content/uploads/2024/08/Economic-Impact-Study-Comprehensive-Report.pdf", "Economic Impact Study Comprehensive Report"), (True, "not_plan", False, False, False)),
    (("BHM", "Birmingham-Shuttlesworth International Airport", "https://www.dot.state.al.us/publications/Aero/pdf/aldoteconomicimpactstudytechnicalreport.pdf", "ALDOT Aviation System Plan and Economic Impact Study"), (False, "not_plan", False, False, False)),
    (("HNL", "Daniel K. Inouye International Airport", "https://hidot.hawaii.gov/airports/files/2013/01/PFC-App-Final-Agency-Decision.pdf", "FAA Final Agency Decision"), (False, "not_plan", False, False, False)),
    (("4S9", "Mulino State Airport", "https://www.oregon.gov/aviation/Airports/Documents/4S9/Master%20Plan/2008/Chapter%206%20-%20ALP%20Narrative.pdf", "Chapter 6 ALP Narrative"), (True, "alp", True, False, True)),
    (("HIO", "Hillsboro Airport", "https://cdn.portofportland.com/pdfs/HIO_Summary_Report_Final.pdf", "Master Plan Summary Report"), (True, "master_plan", True, False, True)),
    (("PDX", "Portland International Airport", "https://cdn.portofportland.com/pdfs/PDX-2045-Forecast-Report-Executive-Summary.pdf", "Forecast Report Executive Summary"), (True, "chapter", True, False, True)),
    (("BVY", "Beverly Regional Airport", "https://beverlyairport.com/wp-content/uploads/2024/03/Chapter-6-Airport-Layout-Plan.pdf", "Chapter 6 Airport Layout Plan"), (True, "alp", True, False, True)),
]
PACKET = "id int, lid string, name string, url string, label string, body string, outline array<string>, source_bytes long"


@pytest.fixture(scope="module")
def packets(spark):
    return spark.createDataFrame([(i, *p, "", [], 0) for i, (p, _) in enumerate(CASES)], PACKET)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, *g) for i, (_, g) in enumerate(CASES)], "id int, same_airport boolean, kind string, confirm boolean, explore boolean, publish boolean")


def test_labelled_cases(packets, labels):
    judged = ev.against_gold(ops.score(packets), labels, "id", FIELDS)
    misses = [(CASES[r["id"]][0][2], r["fail"], r["kind"]) for r in judged.filter("not ok").collect()]
    assert misses == []


def test_body_signals(spark):
    row = [(1, "TTD", "Portland-Troutdale Airport", "https://h/pdfs/TTD-PAC-report.pdf", "Shaping Our Future",
            "Airport Master Plan. Inventory and forecasts. Alternatives. Implementation. " + "text " * 1700, ["Inventory", "Forecasts"], 10)]
    out = ops.score(spark.createDataFrame(row, PACKET)).first()
    assert (out["kind"], out["confirm"], out["publish"], out["f_shape_count"], out["f_outline_n"]) == ("master_plan", True, True, 4.0, 2.0)


def test_statewide_body(spark):
    row = [(1, "BHM", "Birmingham-Shuttlesworth International Airport", "https://d/aldot.pdf", "ALDOT Aviation System Plan", "Birmingham (BHM) enplanements", [], 0)]
    out = ops.score(spark.createDataFrame(row, PACKET)).first()
    assert (out["same_airport"], out["kind"]) == (False, "not_plan")


def test_ablation_equals_rescoring(packets, labels):
    from plainledger.rules.evidence import CONFIRM, EXPLORE, KINDS, PUBLISH, ScoreConfig

    name = "filename_alp"
    shifted = {r["id"]: tuple(r[f] for f in FIELDS) for r in ops.variant_scores(
        ops.with_scores(ops.features(packets)), [v for v in ops.ablation_variants() if v["feature"] == name]).collect()}

    def without(w):
        return {k: (0.0 if k == name else x) for k, x in w.items()}

    config = ScoreConfig(without(CONFIRM), without(EXPLORE), without(PUBLISH), {k: without(w) for k, w in KINDS.items()})
    direct = {r["id"]: tuple(r[f] for f in FIELDS) for r in ops.score(packets, config=config).collect()}
    assert shifted == direct and len(direct) == len(CASES)


HIT = "id int, lid string, name string, artifact_url string, page_url string, prose string, answer string"


def answer(**k):
    base = {"same_airport": True, "hit_type": "artifact", "kind_guess": "alp", "fetch": "yes", "artifact_urls": [], "page_urls": [], "reason": "r"}
    return json.dumps({**base, **k})


def gated(spark, **k):
    base = dict(lid="PDX", name="Portland Intl", artifact_url="https://port.gov/a.pdf", page_url="https://port.gov/p", prose="plan", answer=answer())
    base.update(k)
    row = (1, *[base[c] for c in ("lid", "name", "artifact_url", "page_url", "prose", "answer")])
    return ev.gated_hits(spark.createDataFrame([row], HIT)).first()


def test_gated_answers(spark):
    assert gated(spark, answer="no object")["fetch"] == "needs_human"
    assert gated(spark, answer="{broken")["reason"] == "model JSON missing"
    assert gated(spark, artifact_url="https://port.gov/ssi_sheet.pdf")["fetch"] == "needs_human"
    assert gated(spark, answer=answer(same_airport=False))["fetch"] == "no"
    out = gated(spark, answer="ok " + answer(artifact_urls=["https://invented.com/x.pdf"]))
    assert out["artifact_urls"] == ["https://port.gov/a.pdf"] and out["page_urls"] == ["https://port.gov/p"]
    assert gated(spark, answer=answer(fetch="no"))["fetch"] == "yes"
    off = gated(spark, prose="environmental assessment", lid="ZZZ", name="")
    assert (off["fetch"], off["hit_type"], off["same_airport"]) == ("no", "not_plan", False)
    hub = gated(spark, artifact_url="", answer=answer(hit_type="nonsense"))
    assert (hub["hit_type"], hub["fetch"], hub["page_urls"]) == ("hub_page", "yes", ["https://port.gov/p"])
    far = gated(spark, artifact_url="", page_url="", prose="see https://far.com/x.pdf.")
    assert far["artifact_urls"] == ["https://far.com/x.pdf"]


def test_hybrid_precedence(spark):
    rows = spark.createDataFrame([(1, "h1", "growth", "h1", "llm", "other", True), (2, "h2", "growth", "old", "llm", "other", True),
                                  (3, "h3", None, None, None, "maintenance", False), (4, "h4", None, None, None, "other", True), (5, "h5", None, None, None, "other", True)],
                                 "id int, input_hash string, stored_label string, stored_hash string, stored_by string, rule string, review boolean")
    said = spark.createDataFrame([("h1", '{"label":"planning"}'), ("h2", 'x {"label":" Planning ","reason":"why"}'), ("h3", '{"label":"planning"}'), ("h4", '{"label":"bogus"}')], "input_hash string, answer string")
    forced = spark.createDataFrame([(5, "planning", "by hand")], "id int, label string, reason string")
    out = {r["id"]: (r["label"], r["labelled_by"]) for r in ev.hybrid_labels(rows, said, forced, ("maintenance", "growth", "planning", "other")).collect()}
    assert out == {1: ("growth", "llm"), 2: ("planning", "llm"), 3: ("maintenance", "rules"), 4: ("other", "llm"), 5: ("planning", "human")}
    audit = ev.label_audit(ev.hybrid_labels(rows, said, forced, ("planning",)), "t", F.lit("now"))
    assert audit.count() == 4


def test_merge_keeps_the_first(spark):
    a = spark.createDataFrame([("a", "http://x/", 1), ("b", "", 2)], "id string, url string, seq int")
    b = spark.createDataFrame([("c", "http://x", 1), ("d", "http://y", 2)], "id string, url string, seq int")
    assert sorted(r["id"] for r in ev.merge_cases([a, b], "seq").collect()) == ["a", "d"]
    assert [r["id"] for r in ev.novel_cases(b, a).collect()] == ["d"]


def test_an_entity_called_like_a_year(spark):
    """Its name is no year the packet must show; a year beside it is one."""
    said = json.dumps({"queries": [{"query": q} for q in ("1999 ALP 1999", "1999 ALP 2001", "1999 master plan", "ALP 2012 of 1999")]})
    row = [(1, "1999", "hits from 2012", ["a.gov"], [], said), (2, "19", "hits from 2012", ["a.gov"], [], said)]
    schema = "id int, lid string, packet_text string, allowed_hosts array<string>, ran array<string>, answer string"
    got = sorted(tuple(r) for r in ev.gated_hints(spark.createDataFrame(row, schema)).select("id", "rank", "query").collect())
    assert got == [(1, 1, "1999 master plan"), (1, 2, "ALP 2012 of 1999")]


def test_patterns_tried_where_their_words_stand(spark):
    """Every pattern finds in random texts what it finds when tried on the whole of them, odd letters included."""
    import random

    from plainledger.functions import values as v
    from plainledger.rules import evidence as rules

    rnd = random.Random(5)
    words = [w for parts in rules.PARTS.values() for w, _ in parts] + [
        "amp", "Amped", "champ", "MASTER_PLAN", "master  plan", "mastermind", "demand-capacity", "demands", "principal", "Alternatives", "alternativeness",
        "pavement conditions", "NEPA", "nepal", "fon\u017fi", "\u0130nventory", "payroll", "sea", "EA", "e\u0301a\u0301", "inventory\u0301", "\u212aa", "\u03a3 x"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", ". ", "-", "", "\u00e9", "x" * 40]) for _ in range(rnd.randint(0, 5))) for _ in range(400)] + [""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("low", F.lower("t")).withColumn("odd", v.has_odd_case("t"))
    for pattern, parts in rules.PARTS.items():
        got = v.found(F.col("t"), F.col("low"), F.col("odd"), pattern, parts)
        assert rows.filter(got != F.col("t").rlike(pattern)).select("t").collect() == [], pattern


def test_features_of_pages_and_limits(spark):
    """Features are the same when all patterns are tried on whole texts: pages have no body text, openings are cut."""
    from plainledger.rules.evidence import EvidenceRules

    body = "x" * 30 + " economic impact NEPA statewide aviation Harbor_Field final amp"
    rows = spark.createDataFrame(
        [(i, "ABC", name, url, label, text, ["Inventory"], 10) for i, (name, url, label, text) in enumerate(
            (n, u, l, t) for n in ("Harbor Field", "Harbor", "", "Field-X y") for u in ("https://a.gov/x", "https://a.gov/x.pdf")
            for l in ("", "Meeting", "harbor  field") for t in (body, "", None, "harbor -field"))],
        "id int, lid string, name string, url string, label string, body string, outline array<string>, source_bytes long")
    for limits in ({}, {"first_page": 40, "first_lines": 50}, {"first_page": 80}):
        a, b = ops.features(rows, **limits), ops.features(rows, EvidenceRules(parts={}), **limits)
        assert a.exceptAll(b).collect() == []
    plain = {r["id"]: r["f_name_in_text"] for r in ops.features(rows).collect()}
    for r in rows.collect():
        blob = " ".join(x for x in (r["label"], r["url"], r["body"], "Inventory") if x)
        fold = lambda x: re.sub(r"[_\-]+", " ", x.lower())
        assert plain[r["id"]] == float(r["name"] != "" and fold(r["name"]) in fold(blob)), r
