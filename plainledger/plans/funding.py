"""Funding queries over orders, lines, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plainledger.functions import values as v
from plainledger.operators import funding as ops
from plainledger.plans import bindings as b
from plainledger.plans.bindings import GRANTS_SQL, PART_SPEND, briefing_sql


def funding_briefing(spark, sf):
    return ops.briefing(b.grants(spark, sf), ["entity"])


def funding_level_sections(spark, sf):
    return ops.level_sections(b.grants(spark, sf), ["entity"]).drop("label")


def funding_year_bars(spark, sf):
    return ops.year_bars(b.grants(spark, sf, outlays=False), ["entity"])


def funding_money_overview(spark, sf):
    return ops.money_overview(b.grants(spark, sf), ["entity"])


def funding_row_types(spark, sf):
    rows = b.grants(spark, sf, described=True)
    return rows.select(
        "grant_id",
        ops.normal_level("level").alias("level"),
        ops.remaining("amount", "obligated", "outlayed").alias("remaining"),
        ops.spend_category("description", "is_planning", PART_SPEND).alias("category"),
        ops.needs_review(
            "description", ops.spend_category("description", "is_planning", PART_SPEND), PART_SPEND
        ).alias("review"),
        ops.award_url("grant_number").alias("award_url"),
        ops.year_summary_url("fiscal_year").alias("year_url"),
        ops.input_hash("description", "grant_number").alias("input_hash"),
        ops.grant_date("award_date", "fiscal_year").alias("shown_date"),
    )


def funding_titles(spark, sf):
    lines = b.wide(b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")
    part = b.table(spark, sf, "part")
    text = F.concat_ws(", ", F.initcap("p_type"), "p_name", "p_brand")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        ops.grant_title(text).alias("title"),
        ops.grant_brief(text).alias("brief"),
    )


def funding_allocation_cube(spark, sf):
    rows = b.purposes(b.grants(spark, sf, described=True))
    homes = b.entities(spark, sf).select(F.col("key").alias("entity"), "region")
    return ops.allocation_cube(rows.join(homes, "entity"), "region")


def funding_purpose_shares(spark, sf):
    rows = b.purposes(b.grants(spark, sf, described=True))
    homes = b.entities(spark, sf).select(F.col("key").alias("entity"), "region")
    return ops.purpose_shares(rows.join(homes, "entity"), "region")


def funding_project_groups(spark, sf):
    return ops.project_groups(b.grants(spark, sf), "grant_id")


def funding_top_lines(spark, sf):
    return ops.top_lines(b.grants(spark, sf, described=True), "grant_id")


def funding_total_by_entity(spark, sf):
    return ops.funded_total(b.grants(spark, sf, outlays=False), ["federal", "state", "local"])


def funding_award_status(spark, sf):
    """Orders are the grants; settled lines are the status feed, newest line last."""
    rows = b.grants(spark, sf, outlays=False).withColumn("obligated", F.lit(None).cast("long"))
    feed = b.wide(b.table(spark, sf, "lineitem"), "l_orderkey").select(
        ops.award_key(
            F.concat(F.lit("G-"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
        ).alias("award_key"),
        v.half_even("l_extendedprice").alias("obligated"),
        v.half_even(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("outlayed"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    out = ops.apply_award_status(rows, feed, "seq")
    return out.select("grant_id", "award_key", "obligated", "outlayed")


def funding_carry_classification(spark, sf):
    """Prior labels were given to settled orders under the same number and wording."""
    rows = b.grants(spark, sf, described=True)
    prior = rows.select(
        "grant_number",
        F.when(F.col("obligated").isNotNull(), F.col("description"))
        .otherwise(F.lit("wording since changed")).alias("description"),
        F.when(F.col("level") != "federal", "growth").alias("spend_category"),
        F.lit("earlier review").alias("spend_reason"),
        F.col("award_date").alias("spend_classified_at"),
        F.lit("human").alias("spend_classifier"),
    )
    kept = ops.carry_classification(
        rows.select("grant_id", "grant_number", "description", "is_planning"), prior
    )
    rule = ops.spend_category("description", "is_planning", PART_SPEND)
    return kept.select(
        "grant_id", "spend_category", "spend_reason", "spend_classified_at", "spend_classifier",
        "spend_input_hash", ops.effective_category("spend_category", rule).alias("effective"),
    )


def funding_by_region(spark, sf):
    rows = b.grants(spark, sf, described=True)
    return ops.grants_by_region(rows, b.entities(spark, sf)).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"),
        F.countDistinct("entity").alias("n_entities"),
    )


def budget_lines(spark, sf):
    """Two views of one sum: lines by return flag as programs, by status as funds."""
    lines = b.table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("budget"), v.half_even("l_extendedprice").alias("amount"),
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber",
    )
    view = F.array(
        F.struct(F.lit("program").alias("line_group"), F.col("l_returnflag").alias("category"), F.lit(0).alias("v")),
        F.struct(F.lit("fund").alias("line_group"), F.col("l_linestatus").alias("category"), F.lit(1).alias("v")),
    )
    return (
        lines.withColumn("view", F.explode(view))
        .select("budget", "amount", "view.line_group", "view.category",
                F.struct("l_orderkey", "l_linenumber", "view.v").alias("seq"))
    )


def budget_line_groups(spark, sf):
    return ops.budget_groups(budget_lines(spark, sf), ["budget"])


def budget_reconciliation(spark, sf):
    stated = (
        b.table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("budget"))
        .agg(F.sum(v.half_even("l_extendedprice")).alias("total"))
    )
    return ops.reconcile_budget(stated, budget_lines(spark, sf), "budget")


def funding_expectation_gate(spark, sf):
    """Order totals per level against the totals of their lines' own count."""
    rows = b.grants(spark, sf, outlays=False)
    actual = rows.groupBy(F.col("level").alias("figure")).agg(F.sum("amount").alias("value"))
    expected = rows.groupBy(ops.normal_level("level").alias("figure")).agg(F.sum("amount").alias("value"))
    return ops.check_expectations(actual, expected, "figure")


QUERIES = {
    "funding_briefing": funding_briefing,
    "funding_level_sections": funding_level_sections,
    "funding_year_bars": funding_year_bars,
    "funding_money_overview": funding_money_overview,
    "funding_row_types": funding_row_types,
    "funding_titles": funding_titles,
    "funding_allocation_cube": funding_allocation_cube,
    "funding_purpose_shares": funding_purpose_shares,
    "funding_project_groups": funding_project_groups,
    "funding_top_lines": funding_top_lines,
    "funding_total_by_entity": funding_total_by_entity,
    "funding_award_status": funding_award_status,
    "funding_carry_classification": funding_carry_classification,
    "funding_by_region": funding_by_region,
    "budget_line_groups": budget_line_groups,
    "budget_reconciliation": budget_reconciliation,
    "funding_expectation_gate": funding_expectation_gate,
}

W = "WITH " + GRANTS_SQL
HASH = "substr(sha256(lower(trim(coalesce(description, ''))) || '|' || grant_number), 1, 16)"

ORACLE = {
    "funding_briefing": f"{W} SELECT entity, {briefing_sql()} FROM grants GROUP BY entity",
    "funding_level_sections": f"""{W},
leveled AS (SELECT * REPLACE (CASE WHEN level IN ('federal','state','local') THEN level ELSE 'other' END AS level) FROM grants),
stats AS (SELECT entity, level, {briefing_sql()} FROM leveled GROUP BY entity, level),
frame AS (SELECT DISTINCT entity, x.level FROM grants,
          (VALUES ('federal'), ('state'), ('local'), ('other')) x(level))
SELECT f.entity, f.level, coalesce(n, 0) AS n, total, year_min, year_max,
       coalesce(n_planning, 0) AS n_planning, spent, remaining, coalesce(n_outlays, 0) AS n_outlays
FROM frame f LEFT JOIN stats s ON s.entity = f.entity AND s.level = f.level""",
    "funding_year_bars": f"""{W},
y AS (SELECT entity, fiscal_year, count(*) AS n, CAST(sum(nullif(amount, 0)) AS BIGINT) AS total
      FROM grants GROUP BY entity, fiscal_year)
SELECT entity, fiscal_year, n, total,
  CAST(round_even(100.0 * coalesce(total, 0) / coalesce(nullif(max(total) OVER (PARTITION BY entity), 0), 1), 0) AS BIGINT) AS pct
FROM y""",
    "funding_money_overview": f"""{W},
s AS (SELECT entity, {briefing_sql()} FROM grants GROUP BY entity),
t AS (SELECT *, spent IS NOT NULL OR remaining IS NOT NULL AS has_split,
        coalesce(spent, 0) + coalesce(remaining, 0) AS whole FROM s),
u AS (SELECT *, CASE WHEN whole > 0 THEN CAST(round_even(100.0 * coalesce(spent, 0) / whole, 0) AS BIGINT) ELSE 0 END AS spent_pct FROM t)
SELECT * EXCLUDE (whole), CASE WHEN whole > 0 THEN 100 - spent_pct ELSE 0 END AS remaining_pct FROM u""",
    "funding_row_types": f"""{W}
SELECT grant_id, CASE WHEN level IN ('federal','state','local') THEN level ELSE 'other' END AS level,
  CAST(rem AS BIGINT) AS remaining, purpose AS category,
  purpose = 'other' OR regexp_matches(description, '(?i)\\b(?:widget|gear)\\b') AS review,
  'https://www.usaspending.gov/award/ASST_NON_' || replace(grant_number, '-', '') || '_069' AS award_url,
  'https://www.faa.gov/airports/aip/grant_histories/' || fiscal_year AS year_url,
  {HASH} AS input_hash,
  strftime(award_date, '%-d %b %Y') AS shown_date
FROM grants""",
    "funding_titles": """
SELECT l_orderkey, l_linenumber, l_partkey,
  upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS title,
  p_name || ', ' || p_brand AS brief
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "funding_allocation_cube": f"""{W},
g AS (SELECT c.c_nationkey AS region, grants.* FROM grants JOIN customer c ON c.c_custkey = entity),
k AS (SELECT region, purpose, fiscal_year, entity, grouping(purpose) AS gp, grouping(fiscal_year) AS gy,
        grouping(entity) AS ge, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n,
        min(fy) AS year_min, max(fy) AS year_max
      FROM (SELECT *, fiscal_year AS fy FROM g)
      GROUP BY GROUPING SETS ((region, purpose), (region, fiscal_year), (region, entity),
        (region, entity, purpose), (region, fiscal_year, entity), (region, fiscal_year, entity, purpose)))
SELECT region, purpose, fiscal_year, entity, total, n, year_min, year_max,
  concat_ws('+', CASE WHEN gy = 0 THEN 'year' END, CASE WHEN ge = 0 THEN 'entity' END, CASE WHEN gp = 0 THEN 'purpose' END) AS slice
FROM k""",
    "funding_purpose_shares": f"""{W},
s AS (SELECT c.c_nationkey AS region, purpose, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n
      FROM grants JOIN customer c ON c.c_custkey = entity GROUP BY ALL),
p AS (SELECT *, CAST(round_even(100.0 * total / sum(total) OVER (PARTITION BY region), 0) AS BIGINT) AS pct,
        list_position(['maintenance','growth','planning','other'], purpose) AS ord FROM s WHERE total <> 0)
SELECT region, purpose, total, n, pct,
  CAST(coalesce(sum(pct) OVER (PARTITION BY region ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CASE purpose WHEN 'maintenance' THEN 'Maintenance' WHEN 'growth' THEN 'Growth and expansion'
       WHEN 'planning' THEN 'Planning studies' ELSE 'Other' END AS label
FROM p""",
    "funding_project_groups": f"""{W},
s AS (SELECT entity, {briefing_sql()}, greatest(count(*) - 3, 0) AS more FROM grants GROUP BY entity),
r AS (SELECT entity, grant_id, amount, row_number() OVER (PARTITION BY entity
        ORDER BY award_date DESC, fiscal_year DESC, grant_number DESC, grant_id) AS pos FROM grants)
SELECT r.pos, r.grant_id, r.amount, s.* FROM r JOIN s ON s.entity = r.entity WHERE pos <= 3""",
    "funding_top_lines": f"""{W},
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN coalesce(rem, 0) <> 0 THEN 0 ELSE 1 END,
        fiscal_year DESC, amount DESC, grant_id) AS pos FROM grants)
SELECT entity, pos, 'FY ' || fiscal_year || ' ' || coalesce(nullif(description, ''), 'Grant') ||
  CASE WHEN coalesce(rem, 0) <> 0 THEN ' · $' || format('{{:,}}', CAST(rem AS BIGINT)) || ' not yet spent'
       WHEN amount <> 0 THEN ' · $' || format('{{:,}}', amount) || ' awarded' ELSE '' END AS line
FROM r WHERE pos <= 4""",
    "funding_total_by_entity": f"""{W}
SELECT entity, CAST(sum(coalesce(nullif(obligated, 0), nullif(amount, 0), 0)) AS BIGINT) AS funded
FROM grants WHERE level IN ('federal', 'state', 'local') GROUP BY entity HAVING funded > 0""",
    "funding_award_status": f"""{W},
f AS (SELECT 'G' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS award_key,
        max({{'a': l_shipdate, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice,
             'o': CAST(round_even(l_extendedprice, 0) AS BIGINT),
             'p': CAST(round_even(l_extendedprice * (1 - l_discount), 0) AS BIGINT)}}) AS m
      FROM lineitem GROUP BY 1)
SELECT grant_id, replace(grant_number, '-', '') AS award_key, f.m.o AS obligated, f.m.p AS outlayed
FROM grants g LEFT JOIN f ON f.award_key = replace(g.grant_number, '-', '')""",
    "funding_carry_classification": f"""{W},
k AS (SELECT *, obligated IS NOT NULL AND level <> 'federal' AS kept FROM grants)
SELECT grant_id, CASE WHEN kept THEN 'growth' END AS spend_category,
  CASE WHEN kept THEN 'earlier review' END AS spend_reason,
  CASE WHEN kept THEN award_date END AS spend_classified_at,
  CASE WHEN kept THEN 'human' END AS spend_classifier,
  CASE WHEN kept THEN {HASH} END AS spend_input_hash,
  CASE WHEN kept THEN 'growth' ELSE purpose END AS effective
FROM k""",
    "funding_by_region": f"""{W},
r AS (SELECT grant_id, entity, amount, own_region AS region FROM grants WHERE own_region IS NOT NULL
      UNION SELECT grant_id, entity, amount, c_nationkey FROM grants JOIN customer ON c_custkey = entity)
SELECT region, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total, count(DISTINCT entity) AS n_entities
FROM r GROUP BY region""",
    "budget_line_groups": """
WITH v AS (
  SELECT year(l_shipdate) AS budget, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS amount, l_orderkey AS k, l_linenumber AS n, 0 AS v, 'program' AS line_group FROM lineitem
  UNION ALL
  SELECT year(l_shipdate), CAST(round_even(l_extendedprice, 0) AS BIGINT), l_orderkey, l_linenumber, 1, 'fund' FROM lineitem),
s AS (SELECT budget, line_group, count(*) AS n_lines, CAST(sum(amount) AS BIGINT) AS total, min({'k': k, 'n': n, 'v': v}) AS f FROM v GROUP BY ALL)
SELECT CAST(budget AS INTEGER) AS budget, line_group, n_lines, total,
  CAST(row_number() OVER (PARTITION BY budget ORDER BY f) AS INTEGER) AS pos,
  CASE line_group WHEN 'program' THEN 'By program' ELSE 'By fund type' END AS label
FROM s""",
    "budget_reconciliation": """
WITH s AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS budget, CAST(sum(CAST(round_even(l_extendedprice, 0) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1)
SELECT budget, total, total AS program_total, total AS fund_total, 2 * total AS double_total, true AS ok FROM s""",
    "funding_expectation_gate": f"""{W},
a AS (SELECT level AS figure, CAST(sum(amount) AS BIGINT) AS actual FROM grants GROUP BY 1),
e AS (SELECT CASE WHEN level IN ('federal','state','local') THEN level ELSE 'other' END AS figure, CAST(sum(amount) AS BIGINT) AS expected FROM grants GROUP BY 1)
SELECT coalesce(e.figure, a.figure) AS figure, expected, actual FROM e FULL JOIN a ON a.figure = e.figure
WHERE expected IS DISTINCT FROM actual""",
}
