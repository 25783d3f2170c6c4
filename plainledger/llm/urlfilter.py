"""URL filter by the ratio of two character language models.

Rules on hosts and paths come first. Urls that a rule allows or blocks train two
smoothed variable-order Markov models (orders 0 to 2, each interpolated with the next
lower by Witten-Bell weights, the lowest with the uniform distribution) over the
characters of host and path. All other urls are judged by the difference of the two
log-likelihoods per character, against a threshold calibrated on rule-judged urls
that were not trained on. The models are one array of log ratios with a cell per
character triple, whatever the data size, and reach the rows as a literal, so scoring
is row-local.

Defined results: a null url or one without `://` has an empty host and path, fits no
rule and is judged as the empty string; without judged urls the ratio is zero and
everything else is allowed; repeated rows get one result each; an empty table gives
an empty table; extra columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainledger.llm.common import constant

# Character classes; digits are one class, anything unlisted is the last but one, and
# the last marks both ends.
LETTERS = string.ascii_lowercase + "0./-_%"
KINDS = len(LETTERS) + 2
_OTHER, _EDGE = KINDS - 2, KINDS - 1
BIN = 0.02
HOLD_OUT = 4

Rule = tuple[str, str]  # verdict and host/path, as in ("block", "example.com/de/")


def parts(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of the longest rule that fits, or null."""
    known = F.array(*[
        F.struct(F.lit(len(text)).alias("size"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"),
                 F.lit(text.partition("/")[0]).alias("host"), F.lit("/" + text.partition("/")[2]).alias("path"))
        for verdict, text in rules])
    return F.array_max(F.filter(known, lambda r: (
        (host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])))


def codes(host: Column, path: Column) -> Column:
    """Classes of the characters of host and path, with two marks before and one after."""
    text = F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    inner = F.transform(chars, lambda c: F.coalesce(
        F.nullif(F.instr(F.lit(LETTERS), c), F.lit(0)) - 1, F.lit(_OTHER)))
    edge = F.lit(_EDGE)
    return F.concat(F.array(edge, edge), inner, F.array(edge))


def cells(code: Column) -> Column:
    """One cell number per character and its two predecessors."""
    n = F.size(code) - 2
    return F.zip_with(
        F.zip_with(F.slice(code, F.lit(1), n), F.slice(code, F.lit(2), n), lambda a, b: a * KINDS + b),
        F.slice(code, F.lit(3), n), lambda ab, c: ab * KINDS + c)


def _model(counts: DataFrame, column: str) -> DataFrame:
    """(cell, log probability) of every cell under one class's counts."""
    spark = counts.sparkSession
    grid = spark.range(KINDS ** 3).select(F.col("id").cast("int").alias("cell"))
    n = F.coalesce(F.col(column), F.lit(0)).cast("double")
    full = grid.join(counts, "cell", "left").select(
        "cell", n.alias("n3"), F.floor(F.col("cell") / KINDS).cast("int").alias("ab"),
        (F.col("cell") % (KINDS * KINDS)).alias("bc"))
    full = full.withColumn("b", F.floor(F.col("bc") / KINDS).cast("int")).withColumn("c", F.col("cell") % KINDS)
    own = lambda *keys: Window.partitionBy(*keys)
    # The table has KINDS ** 3 rows at any scale.
    full = (
        full.withColumn("t3", F.sum("n3").over(own("ab"))).withColumn("k3", F.sum((F.col("n3") > 0).cast("int")).over(own("ab")))
        .withColumn("n2", F.sum("n3").over(own("bc"))))
    two = full.groupBy("bc", "b", "c").agg(F.sum("n3").alias("n2"))
    two = two.withColumn("t2", F.sum("n2").over(own("b"))).withColumn("k2", F.sum((F.col("n2") > 0).cast("int")).over(own("b")))
    one = two.groupBy("c").agg(F.sum("n2").alias("n1"))
    one = one.withColumn("t1", F.sum("n1").over(own())).withColumn("k1", F.sum((F.col("n1") > 0).cast("int")).over(own()))
    # A context never seen leaves all weight to the shorter one.
    blend = lambda n, t, k, low: F.when(t > 0, (n + k * low) / (t + k)).otherwise(low)
    one = one.select("c", blend(F.col("n1"), F.col("t1"), F.col("k1"), F.lit(1.0 / KINDS)).alias("p1"))
    two = two.join(one, "c").select("bc", blend(F.col("n2"), F.col("t2"), F.col("k2"), F.col("p1")).alias("p2"))
    return full.join(two, "bc").select(
        "cell", F.log(blend(F.col("n3"), F.col("t3"), F.col("k3"), F.col("p2"))).alias("logp"))


def log_ratios(judged: DataFrame) -> DataFrame:
    """One row, `ratios`: accepted over rejected log probability of each cell."""
    counts = judged.select(F.col("verdict"), F.explode(cells(F.col("code"))).alias("cell")).groupBy("cell").agg(
        F.count_if(F.col("verdict") == "allow").alias("yes"), F.count_if(F.col("verdict") == "block").alias("no"))
    yes, no = _model(counts, "yes").withColumnRenamed("logp", "y"), _model(counts, "no").withColumnRenamed("logp", "n")
    both = yes.join(no, "cell").select("cell", (F.col("y") - F.col("n")).alias("v"))
    return both.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda s: s["v"]).alias("ratios"))


def _ratio_table(judged: DataFrame) -> Column:
    """The log ratios, rounded to seven digits, as one literal of KINDS ** 3 numbers."""
    return constant([round(x, 7) for x in log_ratios(judged).first()["ratios"]])


def score(code: Column, ratios: Column) -> Column:
    """Mean log ratio per character."""
    own = cells(code)
    total = F.aggregate(own, F.lit(0.0), lambda s, cell: s + F.get(ratios, cell))
    return total / F.size(own)


def threshold(scored: DataFrame) -> DataFrame:
    """One row, `cut`: the score bin that best parts allowed from blocked urls."""
    place = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-1000)), F.lit(1000)).cast("int")
    bins = scored.groupBy(place.alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("yes"), F.count_if(F.col("verdict") == "block").alias("no"))
    # At most 2,001 bins.
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    gain = (
        (F.sum("yes").over(whole) - F.coalesce(F.sum("yes").over(below), F.lit(0))) / F.greatest(F.sum("yes").over(whole), F.lit(1))
        + F.coalesce(F.sum("no").over(below), F.lit(0)) / F.greatest(F.sum("no").over(whole), F.lit(1)))
    best = bins.withColumn("gain", gain)
    return best.agg(F.coalesce(F.max_by("bin", F.struct("gain", -F.abs("bin"))) * BIN, F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """`pages` with host, path, rule, score and verdict."""
    host, path = parts(F.col("url"))
    names = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c.lower() not in names]
    located = pages.select(*kept, host.alias("host"), path.alias("path"))
    ruled = located.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    judged = ruled.filter(F.col("_rule").isNotNull()).select(
        F.col("_rule.verdict").alias("verdict"), codes(F.col("host"), F.col("path")).alias("code"),
        F.pmod(F.xxhash64("host", "path"), F.lit(HOLD_OUT)).alias("fold"))
    ratios = _ratio_table(judged.filter(F.col("fold") != 0))
    test = judged.filter(F.col("fold") == 0).select("verdict", score(F.col("code"), ratios).alias("score"))
    limit = threshold(test).first()["cut"]
    scored = ruled.withColumn("_code", codes(F.col("host"), F.col("path"))).withColumn(
        "score", score(F.col("_code"), ratios))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return scored.select(*kept, "host", "path", F.col("_rule.rule").alias("rule"), "score", verdict.alias("verdict"))
