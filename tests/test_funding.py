"""Funding operators against literal rows."""

import datetime

from plainledger.operators import funding as ops

SCHEMA = ("grant_id int, entity string, fiscal_year int, amount long, obligated long, outlayed long, level string, "
          "is_planning boolean, description string, grant_number string, award_date date")


def grants(spark, *rows):
    full = [(i, e, y, a, o, s, lv, p, d, f"N-{i:012d}", None) for i, (e, y, a, o, s, lv, p, d) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_briefing(spark):
    rows = grants(spark, ("PDX", 2025, 100, 100, 40, "federal", True, ""), ("PDX", 2024, 50, 50, 0, "federal", False, ""))
    out = ops.briefing(rows, ["entity"]).first()
    assert (out["n"], out["total"], out["year_min"], out["year_max"], out["n_planning"]) == (2, 150, 2024, 2025, 1)
    assert (out["spent"], out["remaining"], out["n_outlays"]) == (40, 110, 2)


def test_briefing_without_outlays(spark):
    out = ops.briefing(grants(spark, ("PDX", 2025, 100, None, None, "federal", False, "")), ["entity"]).first()
    assert out["spent"] is None and out["remaining"] is None


def test_remaining(one):
    from pyspark.sql import functions as F

    def left(a, o, s):
        return one(ops.remaining(F.lit(a).cast("long"), F.lit(o).cast("long"), F.lit(s).cast("long")))

    assert (left(100, 110, 10), left(100, None, 0), left(100, None, None)) == (100, 100, None)


def test_year_bars(spark):
    rows = grants(spark, *[("PDX", y, a, None, None, "federal", False, "") for y, a in ((2025, 100), (2025, 50), (2024, 50))])
    out = {r["fiscal_year"]: (r["n"], r["total"], r["pct"]) for r in ops.year_bars(rows, ["entity"]).collect()}
    assert out == {2025: (2, 150, 100), 2024: (1, 50, 33)}


def test_allocations(spark):
    rows = grants(spark, ("PDX", 2025, 100, None, None, "federal", False, "Reconstruct Taxiway"),
                  ("HIO", 2025, 40, None, None, "federal", False, "Construct New Runway 3"),
                  ("PDX", 2024, 60, None, None, "federal", False, "Rehabilitate Runway"))
    from pyspark.sql import functions as F

    tagged = rows.withColumn("region", F.lit("OR")).withColumn("purpose", ops.spend_category("description", "is_planning"))
    cube = ops.allocation_cube(tagged, "region").collect()
    by = {(r["slice"], r["fiscal_year"], r["entity"], r["purpose"]): r["total"] for r in cube}
    assert by[("purpose", None, None, "maintenance")] == 160 and by[("purpose", None, None, "growth")] == 40
    assert by[("entity", None, "PDX", None)] == 160 and by[("year", 2025, None, None)] == 140
    assert by[("year+entity+purpose", 2024, "PDX", "maintenance")] == 60
    shares = {r["purpose"]: (r["pct"], r["offset"]) for r in ops.purpose_shares(tagged, "region").collect()}
    assert shares == {"maintenance": (80, 0), "growth": (20, 80)}


def test_sections_show_every_level(spark):
    out = ops.level_sections(grants(spark, ("PDX", 2025, 1, None, None, "bogus", False, "")), ["entity"]).collect()
    assert {r["level"]: r["n"] for r in out} == {"federal": 0, "state": 0, "local": 0, "other": 1}


def test_funded_total(spark):
    rows = grants(spark, ("PDX", 2025, 5, 100, None, "federal", False, ""), ("EUG", 2025, 200, None, None, "state", False, ""),
                  ("HIO", 2025, 50, 0, None, "local", False, ""), ("HIO", 2025, 9999, None, None, "other", False, ""))
    out = {r["entity"]: r["funded"] for r in ops.funded_total(rows, ["federal", "state", "local"]).collect()}
    assert out == {"PDX": 100, "EUG": 200, "HIO": 50}


def test_preview_groups(spark):
    rows = grants(spark, *[("PDX", 2020 + i, 1, None, None, "federal", False, "") for i in range(5)], ("HIO", 2025, 1, None, None, "federal", False, ""))
    out = ops.project_groups(rows, "grant_id").collect()
    assert sorted((r["entity"], r["pos"], r["more"]) for r in out) == [("HIO", 1, 0), ("PDX", 1, 2), ("PDX", 2, 2), ("PDX", 3, 2)]


def test_lines_and_dates(spark, one):
    from pyspark.sql import functions as F

    rows = grants(spark, ("PDX", 2025, 5000, None, 1000, "federal", False, "Widen Taxiway, mark it"))
    assert ops.top_lines(rows, "grant_id").first()["line"] == "FY 2025 Widen Taxiway · $4,000 not yet spent"
    assert one(ops.grant_date(F.lit(datetime.date(2025, 7, 9)), F.lit(2025))) == "9 Jul 2025"
    assert one(ops.grant_date(F.lit(None).cast("date"), F.lit(2025))) == "FY 2025"


def test_region_rows_come_once(spark):
    rows = grants(spark, ("PDX", 2025, 1, None, None, "federal", False, ""), ("TTD", 2025, 1, None, None, "federal", False, ""))
    from pyspark.sql import functions as F

    own = rows.withColumn("own_region", F.when(F.col("entity") == "PDX", "OR").otherwise("WA"))
    homes = spark.createDataFrame([("PDX", "OR"), ("TTD", "OR")], "key string, region string")
    out = sorted((r["entity"], r["region"]) for r in ops.grants_by_region(own, homes).collect())
    assert out == [("PDX", "OR"), ("TTD", "OR"), ("TTD", "WA")]


def test_reconciliation_reports_a_gap(spark):
    budgets = spark.createDataFrame([("a", 10), ("b", 10)], "id string, total long")
    lines = spark.createDataFrame([("a", "program", 10), ("a", "fund", 10), ("b", "program", 9), ("b", "fund", 10)], "id string, line_group string, amount long")
    out = {r["id"]: (r["ok"], r["double_total"]) for r in ops.reconcile_budget(budgets, lines, "id").collect()}
    assert out == {"a": (True, 20), "b": (False, 19)}


def test_a_repeated_prior_never_multiplies_a_grant(spark):
    cols = "grant_number string, description string, spend_category string, spend_reason string, spend_classified_at string, spend_classifier string"
    prior = spark.createDataFrame([("n", "d", "growth", "", "2024-01-01", "llm"), ("n", "d", "other", "", "2024-02-01", "llm")], cols)
    grants = spark.createDataFrame([("n", "d")], "grant_number string, description string")
    assert [r["spend_category"] for r in ops.carry_classification(grants, prior).collect()] == ["other"]
