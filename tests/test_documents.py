"""Document operators against literal rows."""

from pyspark.sql import functions as F

from plainledger.operators import documents as ops

SCHEMA = ("id string, seq long, entity string, kind string, title string, edition string, source_url string, completeness string, "
          "review_status string, part_of string, published_at string, retrieved_at string, summary string, text_sha256 string, images_sha256 string")


def docs(spark, *rows):
    base = dict(entity="PDX", kind="master_plan", title="Master Plan", edition=None, completeness="complete", review_status="published",
                part_of=None, published_at=None, retrieved_at=None, summary=None, text_sha256=None, images_sha256=None)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    full = []
    for i, row in enumerate(rows):
        item = {**base, "seq": i, "source_url": f"https://example.com/{row['id']}.pdf", **row}
        full.append(tuple(item[n] for n in names))
    return spark.createDataFrame(full, SCHEMA)


def test_whole_works(spark):
    rows = docs(spark, {"id": "4s9-2008-inventory", "title": "Inventory"}, {"id": "plan", "title": "Airport Master Plan"}, {"id": "law", "kind": "statute", "entity": None})
    out = {r["id"]: r["w"] for r in rows.select("id", ops.is_whole_work().alias("w")).collect()}
    assert out == {"4s9-2008-inventory": False, "plan": True, "law": False}


def test_prior_editions(spark):
    rows = docs(spark, {"id": "pdx-2010", "edition": "2010"}, {"id": "pdx-2024", "edition": "2024"}, {"id": "a-inventory", "title": "Inventory"})
    out = {r["id"]: r["prior_id"] for r in ops.prior_editions(rows).collect()}
    assert out == {"pdx-2010": "pdx-2024", "pdx-2024": "pdx-2010"}


def test_twins(spark):
    rows = docs(spark, {"id": "one", "text_sha256": "aa", "images_sha256": "bb"}, {"id": "two", "text_sha256": "aa", "images_sha256": "bb"},
                {"id": "other", "text_sha256": "aa", "images_sha256": "cc"})
    assert [tuple(r) for r in ops.content_twins(rows).collect()] == [("two", "one")]


def test_roots_with_missing_parent_and_cycles(spark):
    rows = spark.createDataFrame(
        [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone"), ("x", "y"), ("y", "x"), ("z", "x"), ("self", "self")], "id string, part_of string")
    out = {r["id"]: r["root"] for r in ops.hierarchy_roots(rows).collect()}
    assert [out[k] for k in "abcd"] == ["a"] * 4 and out["e"] == "e"
    # A loop ends where the walk would step on a parent it has seen.
    assert (out["x"], out["y"], out["z"], out["self"]) == ("x", "y", "y", "self")


def test_roots_of_long_chains_and_cycles(spark):
    """Against a plain walk: a chain of 70, a cycle of 41 with tails of 20, a 3-cycle, a fork."""
    up = {f"c{i}": f"c{i - 1}" for i in range(1, 70)} | {"c0": None}
    up |= {f"r{i}": f"r{(i + 1) % 41}" for i in range(41)} | {"t0": "r7", "u": "r7"} | {f"t{i}": f"t{i - 1}" for i in range(1, 20)}
    up |= {"p": "q", "q": "s", "s": "p", "fork": "q", "twig": "fork", "twig2": "fork"}

    def walk(at):
        seen = []
        while up.get(at) in up and up[at] not in seen:
            at = up[at]
            seen.append(at)
        return at

    rows = spark.createDataFrame(list(up.items()), "id string, part_of string")
    out = {r["id"]: r["root"] for r in ops.hierarchy_roots(rows).collect()}
    assert out == {k: walk(k) for k in up}


def test_editions_prefer_the_whole_file(spark):
    rows = docs(
        spark, {"id": "pdx-2020-plan", "edition": "2020"}, {"id": "pdx-2020-chapter-2", "title": "Plan Chapter 2", "edition": "2020", "part_of": "pdx-2020-plan"},
        {"id": "pdx-2020-appendix", "title": "Plan Appendix B", "part_of": "pdx-2020-plan"}, {"id": "pdx-2008-chapter-1", "title": "Old Plan Chapter 1", "edition": "2008"},
        {"id": "pdx-2008-intro", "title": "Old Plan Introduction", "edition": "2008"})
    members = ops.edition_members(rows, ops.hierarchy_roots(rows))
    works = {r["study_year"]: r for r in ops.edition_works(members).collect()}
    assert works[2020]["hub_id"] == "pdx-2020-plan" and works[2020]["work_rank"] == 1
    assert works[2008]["hub_id"] is None and works[2008]["title"] == "Old Plan" and works[2008]["work_rank"] == 2
    parts = [r["id"] for r in ops.work_parts(members, ops.edition_works(members)).collect()]
    assert parts == ["pdx-2008-intro", "pdx-2008-chapter-1", "pdx-2020-chapter-2", "pdx-2020-appendix"]


def test_change_notes(one):
    def differs(a, b, c, d):
        return one(ops.content_changed(*[F.lit(x) for x in (a, b, c, d)]))

    assert differs("t", "i", "t", "i") is False and differs("t", "i", "u", "i") is True
    assert differs(None, None, "t", "i") is None
    assert one(ops.change_note(F.lit(True), F.lit(False))).startswith("Official file was replaced")
    assert one(ops.change_note(F.lit(False), F.lit(True))) is None


def test_reviews(spark):
    rows = spark.createDataFrame([("a", "link_only", None), ("b", "complete", "h1"), ("c", "complete", "h2"), ("d", "missing", None)],
                                 "id string, completeness string, content_sha256 string")
    asked = spark.createDataFrame([("a", "curated", None), ("b", "published", "h1"), ("c", "published", "old"), ("d", "published", None), ("q", "published", None)],
                                  "id string, requested string, expected_sha256 string")
    out = {r["id"]: r["outcome"] for r in ops.apply_reviews(asked, rows).collect()}
    assert out == {"a": "accepted", "b": "accepted", "c": "stale_review", "d": "invalid", "q": "invalid"}


def test_stale_month(one):
    now = F.lit("2026-08-02 12:00:00").cast("timestamp")
    assert one(ops.stale_month(F.lit("2026-08-01 03:00:00").cast("timestamp"), now)) is True
    assert one(ops.stale_month(F.lit("2026-08-01 09:00:00").cast("timestamp"), now)) is False
    assert one(ops.stale_month(F.lit(None).cast("timestamp"), now)) is True
