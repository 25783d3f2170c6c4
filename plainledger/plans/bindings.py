"""Adapters from the star-schema tables to the library's canonical tables.

Each adapter reads whole tables. The SQL strings next to them say the same thing
for the oracle, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainledger.functions import values as v
from plainledger.operators import funding
from plainledger.rules.funding import SpendRules
from plainledger.session import SPREAD_KEY

# Vocabulary of the part descriptions, in place of the grant vocabulary.
PART_SPEND = SpendRules(
    planning=r"(?i)\bsmall ring\b",
    growth=r"(?i)\b(?:large|promo|new)\b",
    maintenance=r"(?i)\b(?:standard|economy)\b",
    ambiguous=r"(?i)\b(?:widget|gear)\b",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that lies in too few file splits, where the session asks for it.

    A file of one row group is read by one task. `SPREAD_KEY` names the tasks such a
    table is dealt to before row-heavy work; a session without the setting, as on a
    cluster with many splits, never shuffles a table for this. Its size decides nothing.
    """
    tasks = df.sparkSession.conf.get(SPREAD_KEY, None)
    return df.repartition(int(tasks), key) if tasks else df


def level_of(priority: Column) -> Column:
    return (
        F.when(priority == "1-URGENT", "federal")
        .when(priority == "2-HIGH", "state")
        .when(priority == "3-MEDIUM", "local")
        .otherwise(priority)
    )


def line_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: paid total of settled lines, and its first line."""
    paid = v.half_even(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (
        wide(table(spark, sf, "lineitem"), "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(F.when(F.col("l_linestatus") == "F", paid)).alias("outlayed"),
            F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first"),
        )
    )


def grants(spark: SparkSession, sf: str, *, described: bool = False,
           outlays: bool = True) -> DataFrame:
    """Orders as grant rows; outlays and wording come from their lines."""
    orders = table(spark, sf, "orders")
    amount = v.half_even("o_totalprice")
    day = F.col("o_orderdate").cast("date")
    out = orders.select(
        F.col("o_orderkey").alias("grant_id"),
        F.col("o_custkey").alias("entity"),
        F.year("o_orderdate").alias("fiscal_year"),
        amount.alias("amount"),
        F.when(F.col("o_orderstatus") != "P", amount).alias("obligated"),
        (F.col("o_orderstatus") == "P").alias("is_planning"),
        level_of(F.col("o_orderpriority")).alias("level"),
        F.concat(F.lit("G-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("grant_number"),
        day.alias("award_date"),
        F.col("o_orderkey"),
    )
    if not (described or outlays):
        return out.drop("o_orderkey").withColumn("outlayed", F.lit(None).cast("long"))
    out = out.join(line_totals(spark, sf), "o_orderkey", "left")
    if described:
        part = table(spark, sf, "part").select(
            F.col("p_partkey"), F.concat_ws(" ", "p_type", "p_name").alias("description")
        )
        supplier = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("own_region"))
        out = (
            out.join(part, F.col("first.l_partkey") == F.col("p_partkey"), "left")
            .join(supplier, F.col("first.l_suppkey") == F.col("s_suppkey"), "left")
            .drop("p_partkey", "s_suppkey")
        )
    return out.drop("o_orderkey", "first")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("region"),
        F.col("c_mktsegment").alias("city"),
        F.col("c_acctbal").alias("balance"),
    )


def purposes(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "purpose", funding.spend_category("description", "is_planning", PART_SPEND)
    )


LINES_SQL = """
lines AS (
  SELECT l_orderkey,
         sum(CASE WHEN l_linestatus = 'F'
             THEN CAST(round_even(l_extendedprice * (1 - l_discount), 0) AS BIGINT) END) AS outlayed,
         min({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS first_line
  FROM lineitem GROUP BY l_orderkey
)"""

GRANTS_SQL = LINES_SQL + """,
grants AS (
  SELECT o.o_orderkey AS grant_id, o.o_custkey AS entity,
         CAST(year(o.o_orderdate) AS INTEGER) AS fiscal_year,
         CAST(round_even(o.o_totalprice, 0) AS BIGINT) AS amount,
         CASE WHEN o.o_orderstatus <> 'P' THEN CAST(round_even(o.o_totalprice, 0) AS BIGINT) END AS obligated,
         CAST(l.outlayed AS BIGINT) AS outlayed,
         o.o_orderstatus = 'P' AS is_planning,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'federal' WHEN '2-HIGH' THEN 'state'
              WHEN '3-MEDIUM' THEN 'local' ELSE o.o_orderpriority END AS level,
         'G-' || lpad(CAST(o.o_orderkey AS VARCHAR), 12, '0') AS grant_number,
         CAST(o.o_orderdate AS DATE) AS award_date,
         concat_ws(' ', p.p_type, p.p_name) AS description,
         s.s_nationkey AS own_region,
         CASE WHEN o.o_orderstatus = 'P' THEN 'planning'
              WHEN regexp_matches(concat_ws(' ', p.p_type, p.p_name), '(?i)\\b(?:large|promo|new)\\b') THEN 'growth'
              WHEN regexp_matches(concat_ws(' ', p.p_type, p.p_name), '(?i)\\b(?:standard|economy)\\b') THEN 'maintenance'
              ELSE 'other' END AS purpose,
         CASE WHEN l.outlayed IS NULL THEN NULL
              ELSE greatest(coalesce(CASE WHEN o.o_orderstatus <> 'P' THEN CAST(round_even(o.o_totalprice, 0) AS BIGINT) END,
                                     CAST(round_even(o.o_totalprice, 0) AS BIGINT)) - l.outlayed, 0) END AS rem
  FROM orders o LEFT JOIN lines l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON p.p_partkey = l.first_line.p
  LEFT JOIN supplier s ON s.s_suppkey = l.first_line.s
)"""


def briefing_sql(extra: str = "") -> str:
    return """count(*) AS n, CAST(sum(nullif(amount, 0)) AS BIGINT) AS total,
       min(fiscal_year) AS year_min, max(fiscal_year) AS year_max,
       count(*) FILTER (WHERE is_planning) AS n_planning,
       CAST(sum(outlayed) AS BIGINT) AS spent, CAST(sum(rem) AS BIGINT) AS remaining,
       count(outlayed) AS n_outlays""" + extra


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as document records; labels give the review, the text the rest."""
    labels = table(spark, sf, "labels")
    docs = wide(table(spark, sf, "documents"), "doc_id").join(labels, "doc_id", "left")
    n = F.col("n_chars")
    kind = (
        F.when(F.col("lang") == "en", "master_plan").when(F.col("lang") == "fr", "alp")
        .when(F.col("lang") == "de", "other").otherwise("notice")
    )
    review = (
        F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 0, "needs_human")
        .when(F.col("toxic") == 1, "auto_pass").otherwise("published")
    )
    status = (
        F.when(n > 1200, "complete").when(n > 800, "link_only").when(n > 500, "preserved_only")
        .when(n > 300, "no_plan_known").otherwise("missing")
    )
    words = F.split_part("text", F.lit(" "), F.lit(1))
    title = (
        F.when(n < 600, F.concat(F.lit("Chapter "), (n % 12).cast("string"), F.lit(" "), words))
        .when(n < 700, F.concat(words, F.lit(" Appendix B")))
        .when(n < 800, F.lit("Introduction")).when(n < 1000, F.lit("")).otherwise(words)
    )
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("source").alias("entity"),
        F.col("lang").alias("region"), kind.alias("kind"), title.alias("title"),
        F.when(n > 400, F.concat(F.lit("Rev "), (F.lit(2000) + n % 25).cast("string"))).alias("edition"),
        F.concat(F.lit("https://"), "lang", F.lit(".example.gov/"), "source", F.lit("/"), "n_chars",
                 F.when(n > 900, ".pdf").otherwise(".html")).alias("source_url"),
        status.alias("completeness"), review.alias("review_status"),
        F.when(F.col("lang") != "de", F.floor(F.col("doc_id") / 2)).alias("_half"),
        F.when(n > 2000, F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int"))).alias("published_at"),
        F.date_add(F.lit("2023-01-01").cast("date"), (n % 600).cast("int")).alias("retrieved_at"),
        F.when(n < 500, "dead").otherwise("live").alias("source_status"),
        F.when(n > 3000, words).alias("summary"), F.lit(None).cast("string").alias("media"),
        F.sha2("text", 256).alias("content_sha256"), F.length("text").alias("n_text"), F.col("text"),
        F.when(F.col("quality") == 1, F.concat(F.lit("/files/"), "doc_id", F.lit(".pdf"))).alias("preserved_url"),
    ).withColumn("part_of", F.when(F.col("_half") != F.col("id"), F.col("_half"))).drop("_half")


DOCS_SQL = """
docs AS (
  SELECT d.doc_id AS id, d.doc_id AS seq, source AS entity, lang AS region,
    CASE lang WHEN 'en' THEN 'master_plan' WHEN 'fr' THEN 'alp' WHEN 'de' THEN 'other' ELSE 'notice' END AS kind,
    CASE WHEN n_chars < 600 THEN 'Chapter ' || (n_chars % 12) || ' ' || split_part(text, ' ', 1)
         WHEN n_chars < 700 THEN split_part(text, ' ', 1) || ' Appendix B' WHEN n_chars < 800 THEN 'Introduction'
         WHEN n_chars < 1000 THEN '' ELSE split_part(text, ' ', 1) END AS title,
    CASE WHEN n_chars > 400 THEN 'Rev ' || (2000 + n_chars % 25) END AS edition,
    CASE WHEN n_chars > 400 THEN CAST(2000 + n_chars % 25 AS INTEGER) ELSE 0 END AS edition_year,
    'https://' || lang || '.example.gov/' || source || '/' || n_chars || CASE WHEN n_chars > 900 THEN '.pdf' ELSE '.html' END AS source_url,
    CASE WHEN n_chars > 1200 THEN 'complete' WHEN n_chars > 800 THEN 'link_only' WHEN n_chars > 500 THEN 'preserved_only'
         WHEN n_chars > 300 THEN 'no_plan_known' ELSE 'missing' END AS completeness,
    CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 0 THEN 'needs_human' WHEN toxic = 1 THEN 'auto_pass' ELSE 'published' END AS review_status,
    CASE WHEN quality = 1 THEN true ELSE false END AS listed,
    CASE WHEN lang <> 'de' AND d.doc_id // 2 <> d.doc_id THEN d.doc_id // 2 END AS part_of,
    CASE WHEN n_chars > 2000 THEN DATE '2024-01-01' + CAST(n_chars % 300 AS INTEGER) END AS published_at,
    DATE '2023-01-01' + CAST(n_chars % 600 AS INTEGER) AS retrieved_at,
    CASE WHEN n_chars < 500 THEN 'dead' ELSE 'live' END AS source_status,
    CASE WHEN n_chars > 3000 THEN split_part(text, ' ', 1) END AS summary,
    sha256(text) AS content_sha256, text, n_chars,
    CASE WHEN quality = 1 THEN '/files/' || d.doc_id || '.pdf' END AS preserved_url
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

# Blanks as the oracle's pattern language writes them.
BLANKS_SQL = r"[\s\x0B\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normal_sql(text: str) -> str:
    return f"lower(trim(regexp_replace({text}, '{BLANKS_SQL}', ' ', 'g')))"
