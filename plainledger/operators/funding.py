"""Funding rows: typing, classification, joins to outlays, rollups and rankings.

Canonical grant columns: entity, fiscal_year, amount, obligated, outlayed, level,
is_planning, description, grant_number, award_date. Callers rename their own.
Every rollup is a plain grouped aggregate, so a hot entity is combined before the
shuffle; every top-k is `row_number() <= k`, which Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainledger.functions import values as v
from plainledger.rules import funding as rules
from plainledger.rules.funding import SpendRules
from plainledger.session import cut


# --- row level -------------------------------------------------------------

def normal_level(level: Column | str) -> Column:
    level = F.coalesce(v.first_text(level), F.lit("federal"))
    return F.when(level.isin(*rules.LEVELS), level).otherwise(F.lit("other"))


def program_tags(entitlement: Column, discretionary: Column, aig: Column, cares: Column) -> Column:
    tags = F.array_compact(
        F.array(
            F.when((v.first_number(entitlement) != 0) | (v.first_number(discretionary) != 0), "AIP"),
            F.when(v.first_number(aig) != 0, "AIG"),
            F.when(v.first_number(cares) != 0, "CARES"),
        )
    )
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("AIP")))


def is_planning(description: Column | str, pack: SpendRules = SpendRules()) -> Column:
    return v.yes(v.col(description).rlike(pack.planning))


def spend_category(description: Column | str, planning: Column | str,
                   pack: SpendRules = SpendRules()) -> Column:
    text = F.coalesce(v.col(description), F.lit(""))
    return (
        F.when(v.yes(v.col(planning)), "planning")
        .when(text.rlike(pack.growth), "growth")
        .when(text.rlike(pack.maintenance), "maintenance")
        .otherwise("other")
    )


def effective_category(stored: Column | str, rule: Column | str) -> Column:
    kept = F.lower(F.trim(v.col(stored)))
    return F.when(kept.isin(*rules.CATEGORIES), kept).otherwise(v.col(rule))


def needs_review(description: Column | str, rule: Column | str,
                 pack: SpendRules = SpendRules()) -> Column:
    return (v.col(rule) == "other") | v.yes(v.col(description).rlike(pack.ambiguous))


def remaining(amount: Column | str, obligated: Column | str, outlayed: Column | str) -> Column:
    """Unspent balance; unknown when no outlay or no base is known."""
    base = F.coalesce(v.col(obligated), v.col(amount))
    gap = base - v.col(outlayed)
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0)))


def award_key(number: Column | str) -> Column:
    bare = F.regexp_replace(v.col(number), "[^A-Za-z0-9]", "")
    return F.when(F.length(bare) >= 10, bare)


def award_url(number: Column | str) -> Column:
    head, tail = rules.AWARD_URL.split("{key}")
    return F.concat(F.lit(head), award_key(number), F.lit(tail))


def year_summary_url(year: Column | str) -> Column:
    head, _ = rules.YEAR_SUMMARY_URL.split("{year}")
    return F.concat(F.lit(head), v.number_or_null(year).cast("string"))


def input_hash(description: Column | str, number: Column | str) -> Column:
    blob = F.concat(
        F.lower(F.trim(F.coalesce(v.col(description), F.lit("")))),
        F.lit("|"),
        F.coalesce(v.col(number).cast("string"), F.lit("")),
    )
    return F.substring(F.sha2(blob, 256), 1, 16)


def grant_title(description: Column | str) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(v.col(description), F.lit("")), r"\s+", " "))
    head = F.trim(F.split_part(text, F.lit(","), F.lit(1)))
    return F.when(text == "", "Grant").otherwise(v.first_text(head, text))


def grant_brief(description: Column | str) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(v.col(description), F.lit("")), r"\s+", " "))
    title = grant_title(text)
    rest = F.substring(text, F.length(title) + 1, F.length(text))
    return F.when((text == "") | (text == title), "").otherwise(F.ltrim(rest, F.lit(" ,")))


def grant_date(award_date: Column | str, year: Column | str) -> Column:
    day = v.col(award_date)
    return F.coalesce(
        F.date_format(day, "d MMM yyyy"),
        F.concat(F.lit("FY "), v.number_or_null(year).cast("string")),
        F.lit(""),
    )


# --- rollups ---------------------------------------------------------------

def _measures() -> list[Column]:
    left = remaining("amount", "obligated", "outlayed")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(v.number_or_null("amount")).alias("total"),
        F.min("fiscal_year").alias("year_min"),
        F.max("fiscal_year").alias("year_max"),
        F.count_if(v.yes(F.col("is_planning"))).alias("n_planning"),
        F.sum("outlayed").alias("spent"),
        F.sum(left).alias("remaining"),
        F.count("outlayed").alias("n_outlays"),
    ]


def briefing(grants: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grants.groupBy(*keys).agg(*_measures())


def level_sections(grants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Briefing per key and level; all levels appear for every key."""
    stats = briefing(grants.withColumn("level", normal_level("level")), [*keys, "level"])
    frame = (
        stats.select(*keys).distinct()
        .withColumn("level", F.explode(F.array(*[F.lit(x) for x in rules.LEVELS])))
    )
    return (
        frame.join(stats, [*keys, "level"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("n_planning", F.coalesce("n_planning", F.lit(0)))
        .withColumn("n_outlays", F.coalesce("n_outlays", F.lit(0)))
        .withColumn("label", v.lookup(rules.LEVEL_LABELS, F.col("level")))
    )


def year_bars(grants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and total per key and year, with the percent of the key's peak year."""
    years = (
        grants.filter(F.col("fiscal_year").isNotNull())
        .groupBy(*keys, "fiscal_year")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(v.number_or_null("amount")).alias("total"))
    )
    peak = F.max("total").over(Window.partitionBy(*keys))
    shown = F.coalesce(F.col("total"), F.lit(0))
    scale = F.coalesce(v.number_or_null(peak), F.lit(1))
    return years.withColumn("pct", v.half_even(100 * shown / scale))


def money_overview(grants: DataFrame, keys: Sequence[str]) -> DataFrame:
    stats = briefing(grants, keys)
    spent = F.coalesce("spent", F.lit(0))
    left = F.coalesce("remaining", F.lit(0))
    whole = spent + left
    return (
        stats.withColumn("has_split", F.col("spent").isNotNull() | F.col("remaining").isNotNull())
        .withColumn("spent_pct", v.percent(spent, whole))
        .withColumn("remaining_pct", F.when(whole > 0, 100 - F.col("spent_pct")).otherwise(0).cast("long"))
    )


def allocation_cube(grants: DataFrame, scope: str) -> DataFrame:
    """Totals by purpose, year, entity and their crosses.

    The finest cells are summed first and written, an entity's cells side by side; every
    coarser slice is a sum of cells, summed before its shuffle. A task holds the groups
    of one slice at a time, not of all six.
    """
    amount = F.coalesce("amount", F.lit(0))
    sums = [F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max")]
    cells = cut(grants.groupBy(scope, "purpose", "fiscal_year", "entity").agg(
        F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"),
        F.min("fiscal_year").alias("year_min"), F.max("fiscal_year").alias("year_max")).repartition(scope, "entity"))
    out = None
    for axes in (["purpose"], ["fiscal_year"], ["entity"], ["entity", "purpose"], ["fiscal_year", "entity"],
                 ["fiscal_year", "entity", "purpose"]):
        part = cells if len(axes) == 3 else cells.groupBy(scope, *axes).agg(*sums)
        if "fiscal_year" in axes:
            part = part.filter(F.col("fiscal_year").isNotNull())
        shown = [F.col(c) if c in axes else F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in ("purpose", "fiscal_year", "entity")]
        named = "+".join(n for n, c in (("year", "fiscal_year"), ("entity", "entity"), ("purpose", "purpose")) if c in axes)
        part = part.select(scope, *shown, "total", "n", "year_min", "year_max", F.lit(named).alias("slice"))
        out = part if out is None else out.unionByName(part)
    return out


def purpose_shares(grants: DataFrame, scope: str) -> DataFrame:
    """Share of the scope's total per purpose, with the running offset of shares."""
    order = F.array_position(F.array(*[F.lit(x) for x in rules.CATEGORIES]), F.col("purpose"))
    sums = (
        grants.groupBy(scope, "purpose")
        .agg(F.sum(F.coalesce("amount", F.lit(0))).alias("total"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("total") != 0)
        .withColumn("ord", order)
    )
    whole = F.sum("total").over(Window.partitionBy(scope))
    before = Window.partitionBy(scope).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("pct", v.half_even(100 * F.col("total") / whole))
        .withColumn("offset", F.coalesce(F.sum("pct").over(before), F.lit(0)))
        .withColumn("label", v.lookup(rules.CATEGORY_LABELS, F.col("purpose")))
        .drop("ord")
    )


def newest_first(tie: str) -> list[Column]:
    return [
        F.coalesce(F.col("award_date").cast("string"), F.lit("")).desc(),
        F.coalesce("fiscal_year", F.lit(0)).desc(),
        F.coalesce(F.col("grant_number").cast("string"), F.lit("")).desc(),
        F.col(tie),
    ]


def project_groups(grants: DataFrame, tie: str, preview: int = 3) -> DataFrame:
    """First rows per entity with the count of the rest and the entity's briefing."""
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(*newest_first(tie)))
    shown = (
        grants.select("entity", tie, "award_date", "fiscal_year", "grant_number", "amount")
        .withColumn("pos", rank).filter(F.col("pos") <= preview)
        .select("entity", "pos", tie, "amount")
    )
    stats = briefing(grants, ["entity"]).withColumn(
        "more", F.greatest(F.col("n") - preview, F.lit(0))
    )
    return shown.join(stats, "entity")


def top_lines(grants: DataFrame, tie: str, limit: int = 4) -> DataFrame:
    """Leading funding lines per entity: open balance, then newest, then largest."""
    left = remaining("amount", "obligated", "outlayed")
    order = [
        F.when(F.coalesce(left, F.lit(0)) != 0, 0).otherwise(1),
        F.coalesce("fiscal_year", F.lit(0)).desc(),
        F.coalesce("amount", F.lit(0)).desc(),
        F.col(tie),
    ]
    ranked = (
        grants.withColumn("left", left)
        .withColumn("pos", F.row_number().over(Window.partitionBy("entity").orderBy(*order)))
        .filter(F.col("pos") <= limit)
    )
    title = grant_title("description")
    head = F.when(
        F.coalesce("fiscal_year", F.lit(0)) != 0,
        F.concat(F.lit("FY "), F.col("fiscal_year").cast("string"), F.lit(" "), title),
    ).otherwise(title)
    tail = (
        F.when(F.coalesce("left", F.lit(0)) != 0,
               F.concat(F.lit(" · $"), v.thousands("left"), F.lit(" not yet spent")))
        .when(F.coalesce("amount", F.lit(0)) != 0,
              F.concat(F.lit(" · $"), v.thousands("amount"), F.lit(" awarded")))
        .otherwise("")
    )
    return ranked.select("entity", "pos", F.concat(head, tail).alias("line"))


def funded_total(grants: DataFrame, levels: Sequence[str]) -> DataFrame:
    base = v.first_number("obligated", "amount")
    return (
        grants.filter(F.col("level").isin(*levels))
        .groupBy("entity").agg(F.sum(base).alias("funded"))
        .filter(F.col("funded") > 0)
    )


# --- joins -----------------------------------------------------------------

def apply_award_status(grants: DataFrame, status: DataFrame, seq: str) -> DataFrame:
    """Bring obligated and outlayed from a status table by derived award key.

    The last status row per key wins; grants without a match keep their values.
    """
    last = (
        status.select(F.col("award_key"), "obligated", "outlayed", seq)
        .groupBy("award_key")
        .agg(F.max_by(F.struct("obligated", "outlayed"), F.col(seq)).alias("_status"))
    )
    keyed = grants.withColumn("award_key", award_key("grant_number"))
    hit = F.col("_status").isNotNull()
    return (
        keyed.join(last, "award_key", "left")
        .withColumn("obligated", F.when(hit, F.col("_status.obligated")).otherwise(F.col("obligated")))
        .withColumn("outlayed", F.when(hit, F.col("_status.outlayed")).otherwise(F.col("outlayed")))
        .drop("_status")
    )


CLASSIFIED = ("spend_category", "spend_reason", "spend_classified_at", "spend_classifier")


def carry_classification(grants: DataFrame, prior: DataFrame) -> DataFrame:
    """Keep the newest earlier category while description and number hash alike."""
    old = prior.filter(v.first_text("spend_category").isNotNull()).select(
        F.col("grant_number"),
        input_hash("description", "grant_number").alias("_hash"),
        F.struct("spend_classified_at", F.struct(*CLASSIFIED).alias("row")).alias("_dated"),
    ).groupBy("grant_number", "_hash").agg(F.max("_dated").alias("_dated")).select(
        "grant_number", "_hash", F.col("_dated.row").alias("_old"))
    bare = grants.drop(*CLASSIFIED)
    new = bare.withColumn("_hash", input_hash("description", "grant_number"))
    joined = new.join(old, ["grant_number", "_hash"], "left")
    carried = joined.select("*", *[F.col(f"_old.{c}").alias(c) for c in CLASSIFIED])
    return carried.withColumn(
        "spend_input_hash", F.when(F.col("_old").isNotNull(), F.col("_hash"))
    ).drop("_hash", "_old")


def grants_by_region(grants: DataFrame, entities: DataFrame) -> DataFrame:
    """A grant belongs to its own region and to its entity's region, once each.

    The either-or condition becomes two candidate regions per row, so the plan is
    one equi join instead of a nested loop.
    """
    homes = entities.select(F.col("key").alias("entity"), F.col("region").alias("_home"))
    both = F.array_compact(F.array_distinct(F.array("own_region", "_home")))
    return (
        grants.join(homes, "entity", "left")
        .withColumn("region", F.explode(both))
        .drop("_home")
    )


# --- budgets and gates -----------------------------------------------------

def budget_groups(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines per group, groups in first-seen order."""
    name = F.coalesce(v.first_text("line_group"), F.lit("program"))
    sums = (
        lines.withColumn("line_group", name)
        .groupBy(*keys, "line_group")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("amount").alias("total"),
             F.min("seq").alias("_first"))
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))
    label = F.coalesce(v.lookup(rules.BUDGET_GROUP_LABELS, F.col("line_group")), F.col("line_group"))
    return sums.withColumn("pos", place).withColumn("label", label).drop("_first")


def reconcile_budget(budgets: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Program total, fund total and stated total must agree per budget."""
    group = F.coalesce(v.first_text("line_group"), F.lit("program"))
    amount = F.coalesce("amount", F.lit(0))
    sums = lines.groupBy(key).agg(
        F.sum(F.when(group == "program", amount).otherwise(0)).alias("program_total"),
        F.sum(F.when(group == "fund", amount).otherwise(0)).alias("fund_total"),
        F.sum(amount).alias("double_total"),
    )
    filled = {c: 0 for c in ("program_total", "fund_total", "double_total")}
    return (
        budgets.select(key, "total").join(sums, key, "left").na.fill(filled)
        .withColumn(
            "ok",
            v.yes((F.col("program_total") == F.col("total")) & (F.col("fund_total") == F.col("total"))),
        )
    )


def check_expectations(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Named figures against frozen expectations; rows that differ or are absent."""
    got = actual.select(key, F.col("value").alias("actual"))
    want = expected.select(key, F.col("value").alias("expected"))
    return want.join(got, key, "full_outer").filter(~F.col("actual").eqNullSafe(F.col("expected")))
