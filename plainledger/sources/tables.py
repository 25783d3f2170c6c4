"""Readers and typed projections: header CSV, line JSON, cells of a sheet, media."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainledger.functions import urls
from plainledger.functions import values as v
from plainledger.session import cut

STRICT = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "report": "PERMISSIVE"}
BAD_LINE = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = False) -> DataFrame:
    """Header CSV in UTF-8 with every column read as text.

    A file is split over tasks. Ask for `multi_line` where quoted values hold line
    breaks; such a file cannot be split.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8",
                          multiLine=multi_line, escape='"', enforceSchema=False)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, mode: str = "fail", parts: bool = False) -> DataFrame:
    """Line JSON: fail on a bad line, skip it, or report it with its file and line number.

    A file that lies in parts in a folder of its own is named with `parts`: its lines are
    numbered through all parts of the folder, in the order of their names.
    """
    if mode != "report":
        return spark.read.option("mode", STRICT[mode]).schema(schema).json(path)
    full = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    lines, before = _placed_lines(spark, path, parts)
    options = {"mode": STRICT[mode], "columnNameOfCorruptRecord": BAD_LINE}
    rows = lines.filter(F.trim("value") != "").withColumn("_row", F.from_json("value", full, options))
    # One row per block of a file, and a block is read by one task.
    numbered = rows.join(before, (F.col("_file") == F.col("_of")) & (F.col("_block") == F.col("_start")))
    return numbered.select("_row.*", "_file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("_line"))


def _placed_lines(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines with their file, block and running id; and of each block its first id and the lines before it.

    A file is split over tasks. Ids run on within a block, so lines are counted once per
    block and a sum over a file's blocks in order gives each block's first line number.
    With `parts` the sum goes over all files of a folder.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = F.regexp_replace("_file", "/[^/]*$", "") if parts else F.col("_file")
    earlier = Window.partitionBy(whole).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        F.col("_file").alias("_of"), F.col("_block").alias("_start"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return lines, before


def parse_json_lines(df: DataFrame, column: str, schema: str, mode: str = "skip") -> DataFrame:
    """Line JSON already in a column: parsed struct `row`, or the bad line itself."""
    full = f"{schema}, {BAD_LINE} string"
    parsed = F.from_json(F.col(column), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE})
    out = df.withColumn("_parsed", parsed)
    bad = F.col("_parsed").isNull() | F.col(f"_parsed.{BAD_LINE}").isNotNull()
    if mode == "skip":
        out = out.filter(~bad)
    elif mode == "fail":
        guard = F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.col(column))))
        out = out.withColumn("_parsed", F.coalesce(guard.cast(_struct(full)), F.col("_parsed")))
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    return out.select(
        *[c for c in df.columns], *[F.col(f"_parsed.{f}").alias(f) for f in fields],
        F.when(bad, F.col(column)).alias(BAD_LINE),
    )


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def typed(df: DataFrame, fields: Mapping[str, str], defaults: Mapping[str, object] = {},
          enums: Mapping[str, tuple[Sequence[str], str]] = {}) -> DataFrame:
    """Project to the fields: unknown columns go, missing ones get their default.

    An enum outside its values becomes the stated fallback.
    """
    out: list[Column] = []
    for name, kind in fields.items():
        c = F.col(name) if name in df.columns else F.lit(None)
        c = c.cast(kind)
        if name in defaults:
            value = defaults[name]
            fill = F.array() if isinstance(value, list) and not value else F.lit(value)
            c = F.coalesce(c, fill.cast(kind))
        if name in enums:
            allowed, fallback = enums[name]
            c = F.when(c.isin(*allowed), c).otherwise(F.lit(fallback))
        out.append(c.alias(name))
    return df.select(*out)


def header_text(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(v.col(c)), "[^a-z0-9]+", " "))


def map_sheet(cells: DataFrame, aliases: Mapping[str, Sequence[str]], required: str,
              keys: Sequence[str] = ("sheet",)) -> DataFrame:
    """Cells (`row`, `col`, `value`) of sheets to one row per data row.

    The header is the first row with an alias of the required field. The first
    alias found names a field's column; when two columns share it, the last wins.
    Rows above the header are titles, see `sheet_titles`.
    """
    keys = list(keys)
    spark = cells.sparkSession
    table = spark.createDataFrame(
        [(f, a, i) for f, names in aliases.items() for i, a in enumerate(names)],
        "field string, alias string, rank int",
    )
    # The alias table is a fixed handful of rows.
    named = cells.withColumn("alias", header_text("value")).join(F.broadcast(table), "alias")
    # Headers and columns are written, so that the planner knows how few there are and
    # the cells of a large sheet stay in the tasks that read them.
    header = cut(
        named.filter(F.col("field") == required).groupBy(*keys).agg(F.min("row").alias("_header"))
    )
    columns = cut(
        named.join(header, keys).filter(F.col("row") == F.col("_header"))
        .groupBy(*keys, "field", "rank").agg(F.max("col").alias("col"))
        .groupBy(*keys, "field").agg(F.min_by("col", "rank").alias("col"))
    )
    body = cells.join(columns.join(header, keys), [*keys, "col"]).filter(F.col("row") > F.col("_header"))
    return (
        body
        .groupBy(*keys, "row")
        .pivot("field", list(aliases))
        .agg(F.first("value"))
    )


def sheet_titles(cells: DataFrame, aliases: Mapping[str, Sequence[str]], required: str,
                 keys: Sequence[str] = ("sheet",)) -> DataFrame:
    """Text of the last row above the header, its cells joined in column order."""
    keys = list(keys)
    is_key = header_text("value").isin(*aliases[required])
    # Written, so that the planner knows how few headers there are and no sheet is shuffled.
    header = cut(cells.filter(is_key).groupBy(*keys).agg(F.min("row").alias("_header")))
    above = cells.join(header, keys).filter((F.col("row") < F.col("_header")) & (F.col("value") != ""))
    last = cut(above.groupBy(*keys).agg(F.max("row").alias("row")))
    texts = above.join(last, [*keys, "row"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("col", "value"))).alias("_cells")
    )
    return texts.select(*keys, F.array_join(F.transform("_cells", lambda x: x["value"]), " ").alias("title"))


def sniff_media(content: Column | str) -> Column:
    """pdf, html or other from the leading text of a payload."""
    raw = v.col(content)
    head = F.lower(F.substring(F.regexp_replace(F.substring(raw, 1, 4096), r"^\s+", ""), 1, 512))
    page = head.contains("<html") | head.startswith("<!doctype html")
    parts = head.contains("<head") & (head.contains("<body") | head.contains("<title"))
    return F.when(raw.startswith("%PDF"), "pdf").when(page | parts, "html").otherwise("other")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_inventory(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Files added, removed or changed against a saved inventory."""
    now = current.select("path", F.struct("bytes", "sha256").alias("now"))
    old = saved.select("path", F.struct("bytes", "sha256").alias("old"))
    state = (
        F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(F.col("old") != F.col("now"), "changed")
    )
    return now.join(old, "path", "full_outer").withColumn("state", state).filter("state is not null")


# --- listing pages -----------------------------------------------------------

HREF = r"(?i)href=[\"']([^\"']+)[\"']"


def hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(v.col(html), F.lit("")), F.lit(HREF), F.lit(1))


def year_pages(pages: DataFrame, html: str, pattern: str, origin: str,
               keys: Sequence[str]) -> DataFrame:
    """Year pages a listing links to: the last link of a year wins."""
    links = pages.select(*keys, F.posexplode(hrefs(html)).alias("pos", "href"))
    year = F.regexp_extract("href", pattern, 1)
    return (
        links.withColumn("year", F.nullif(year, F.lit("")).cast("int")).filter("year is not null")
        .groupBy(*keys, "year")
        .agg(F.max_by("href", "pos").alias("href"))
        .select(*keys, "year", urls.resolve(F.lit(origin + "/"), "href").alias("url"))
    )


def best_workbook(pages: DataFrame, html: str, origin: str, keys: Sequence[str]) -> DataFrame:
    """Workbook link of a page, copies split by state put last."""
    links = pages.select(*keys, F.explode(hrefs(html)).alias("href")).filter(
        F.lower("href").endswith(".xlsx")
    )
    url = urls.resolve(F.lit(origin + "/"), "href")
    low = F.lower("url")
    rank = F.struct(
        (low.contains("by-state") | low.contains("by_state")).alias("copy"),
        (~low.contains("grant") & ~low.contains("aip")).alias("unnamed"),
        F.col("url"),
    )
    return links.select(*keys, url.alias("url")).groupBy(*keys).agg(F.min(rank)["url"].alias("url"))


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
CYCLE_BASE = "https://nfdc.faa.gov/webContent/28DaySub/extra/"


def current_cycle_file(html: Column | str) -> Column:
    """URL of the current 28-day file: a direct link, a stated date, a dated link."""
    text = F.coalesce(v.col(html), F.lit(""))
    names = "|".join(MONTHS)
    links = hrefs(text)
    file = rf"(?i)(\d{{2}}_(?:{names})_\d{{4}}_APT_CSV\.zip)"
    dated = r"NASR_Subscription/(\d{4})-(\d{2})-(\d{2})"
    direct = F.try_element_at(F.filter(links, lambda h: h.rlike(file)), F.lit(1))
    direct_url = F.when(direct.startswith("http"), direct).otherwise(
        F.concat(F.lit(CYCLE_BASE), F.regexp_extract(direct, file, 1))
    )
    stated = r"(?i)Subscription effective ([A-Za-z]+) (\d{1,2}), (\d{4})"
    month = F.initcap(F.substring(F.regexp_extract(text, stated, 1), 1, 3))
    stated_url = F.when(month.isin(*MONTHS), F.concat(
        F.lit(CYCLE_BASE), F.lpad(F.regexp_extract(text, stated, 2), 2, "0"), F.lit("_"), month,
        F.lit("_"), F.regexp_extract(text, stated, 3), F.lit("_APT_CSV.zip"),
    ))
    first = F.try_element_at(F.filter(links, lambda h: h.rlike(dated)), F.lit(1))
    number = F.regexp_extract(first, dated, 2).try_cast("int")
    dated_url = F.concat(
        F.lit(CYCLE_BASE), F.regexp_extract(first, dated, 3), F.lit("_"),
        F.try_element_at(F.array(*[F.lit(m) for m in MONTHS]), number), F.lit("_"),
        F.regexp_extract(first, dated, 1), F.lit("_APT_CSV.zip"),
    )
    return F.coalesce(F.when(F.exists(links, lambda h: h.rlike(file)), direct_url), stated_url, dated_url)
