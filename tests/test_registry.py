"""Registry operators against literal rows."""

import pytest
from plainledger.operators import registry as ops

BASE = ("ARPT_ID", "ARPT_NAME", "CITY", "STATE_CODE", "COUNTY_NAME", "ICAO_ID", "LAT_DECIMAL", "LONG_DECIMAL", "ELEV",
        "OWNERSHIP_TYPE_CODE", "FACILITY_USE_CODE", "SITE_TYPE_CODE", "EFF_DATE", "FUEL_TYPES", "TRNS_STRG_HGR_FLAG", "TRNS_STRG_TIE_FLAG")


def row(key, use="PU", site="A", lat="45.5", long="-122.6"):
    return (key, "Portland Intl", "PORTLAND", "or", "MULTNOMAH", "KPDX", lat, long, "30.5", "PU", use, site, "2026-07-09", "A 100LL", "Y", "N")


def test_admission_and_types(spark):
    rows = spark.createDataFrame([row("pdx"), row("59S", site="C"), row("2S1"), row("PVT", use="PR"), row("H1", site="H"), row(" ")],
                                 ", ".join(f"{c} string" for c in BASE))
    out = ops.typed_registry(ops.admitted_rows(rows, "ARPT_ID", "FACILITY_USE_CODE", "SITE_TYPE_CODE"))
    found = {r["key"]: r for r in out.collect()}
    assert set(found) == {"PDX", "59S", "2S1"}
    pdx = found["PDX"]
    assert (pdx["city"], pdx["region"], pdx["county"], pdx["elevation_ft"]) == ("Portland", "OR", "Multnomah", 30)
    assert pdx["hangar_storage"] and not pdx["tiedown_storage"]


def test_bad_coordinates_keep_the_row(spark):
    rows = spark.createDataFrame([row("PDX", lat="N/A", long="oops")], ", ".join(f"{c} string" for c in BASE))
    out = ops.typed_registry(rows).first()
    assert out["latitude"] is None and out["longitude"] is None


def test_runways(spark):
    rows = spark.createDataFrame([("PDX", "10R-28L", "11000", "150", "ASPH", ""), ("PDX", "H1", "40", "40", "", ""), ("PDX", "3/21", "6000", "150", "", "CLSD")],
                                 "k string, i string, l string, w string, s string, st string")
    out = ops.valid_runways(rows, "k", "i", "l", "w", "st", "s").collect()
    assert [(r["runway"], r["length_ft"], r["width_ft"]) for r in out] == [("10R/28L", 11000, 150)]


def test_merge(spark):
    schema = "key string, name string, city string, region string, ownership string"
    a = spark.createDataFrame([("PDX", "PORTLAND INTL", "Portland", "OR", "PU"), ("59S", "EVERGREEN", "Seattle", "WA", None)], schema)
    b = spark.createDataFrame([("PDX", "Portland International", "Portland", "OR", "Public", "large_hub"), ("ZZZ", "Zed", "Z", "OR", None, None)],
                              schema + ", role string")
    out = {r["key"]: r for r in ops.merge_registries(a, b, ("nasr", "npias")).collect()}
    assert set(out) == {"PDX", "59S", "ZZZ"}
    assert (out["PDX"]["name"], out["PDX"]["role"], out["PDX"]["sources"]) == ("Portland International", "large_hub", ["nasr", "npias"])
    assert out["59S"]["name"] == "Evergreen" and not out["59S"]["in_b"]
    assert out["ZZZ"]["sources"] == ["npias"]


def test_carry_forward(spark):
    schema = "key string, name string, admitted boolean"
    new = spark.createDataFrame([("PDX", "new", False)], schema)
    old = spark.createDataFrame([("PDX", "old", False), ("XYZ", "kept", True), ("GON", "gone", False), ("REF", "ref", False)], schema)
    out = {r["key"]: (r["name"], r["admitted"]) for r in ops.carry_forward(new, old, spark.createDataFrame([("REF",)], "key string")).collect()}
    assert out == {"PDX": ("new", False), "XYZ": ("kept", True), "REF": ("ref", True)}


def test_best_ranked_prefers_the_open_site(spark):
    rows = spark.createDataFrame([
        ("PDX", "closed", "http://old", "", 1), ("PDX", "large_airport", "", "PDX", 2), ("PDX", "large_airport", "http://new", "", 3), ("NON", "large_airport", "", "", 4)],
        "key string, type string, website string, iata string, seq int")
    out = ops.best_ranked(rows, "key", ops.site_rank("type"), ["website", "iata"], "seq").collect()
    assert [tuple(r) for r in out] == [("PDX", "http://new", "PDX")]


def test_fill_blanks(spark):
    base = spark.createDataFrame([("A", "", ["x"]), ("B", "http://own", ["x"])], "key string, website string, sources array<string>")
    extra = spark.createDataFrame([("A", "http://new"), ("B", "http://other")], "key string, website string")
    out = {r["key"]: (r["website"], r["sources"]) for r in ops.fill_blanks(base, extra, ["website"], "c").collect()}
    assert out == {"A": ("http://new", ["x", "c"]), "B": ("http://own", ["x"])}


def test_roles_and_keys(one):
    from pyspark.sql import functions as F

    assert one(ops.role_for(F.lit("L"), F.lit(""), F.lit("P"))) == "large_hub"
    assert one(ops.role_for(F.lit(""), F.lit(" Local "), F.lit("GA"))) == "local"
    assert one(ops.role_for(F.lit(""), F.lit(""), F.lit("R"))) == "reliever"
    assert one(ops.external_key(F.lit("US"), F.lit(""), F.lit("KTTD"))) == "TTD"
    assert one(ops.external_key(F.lit("CA"), F.lit("X"), F.lit("KTTD"))) is None
    assert one(ops.county_label(F.lit("Clark"))) == "Clark County"
    assert one(ops.county_label(F.lit("Orleans Parish"))) == "Orleans Parish"


def test_places(spark):
    places = {r["place"]: (r["code"], r["region"]) for r in ops.place_dimension(spark).collect()}
    assert len(places) == 56
    assert places["Oregon"] == ("OR", "northwest_mountain") and places["Guam"] == ("GU", None)


def test_unknown_place_stops_the_job(spark):
    rows = spark.createDataFrame([(" Oregon ",), (None,)], "place string")
    assert [r[0] for r in rows.select(ops.place_code("place")).collect()] == ["OR", None]
    with pytest.raises(Exception, match="unknown place Nowhere"):
        spark.createDataFrame([("Nowhere",)], "place string").select(ops.place_code("place")).collect()
