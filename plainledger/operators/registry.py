"""Entity registries: row rules, merges with per-column precedence, scopes, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainledger.functions import urls
from plainledger.functions import values as v
from plainledger.rules import registry as rules


# --- row rules -------------------------------------------------------------

def admitted_rows(df: DataFrame, key: str, use_code: str, site_type: str,
                  use: str = rules.USE_CODE,
                  sites: Sequence[str] = rules.SITE_TYPES) -> DataFrame:
    """Rows open to the public with an accepted site type; keys in upper case."""
    clean = F.upper(F.trim(F.col(key)))
    return (
        df.withColumn(key, clean)
        .filter(F.col(key) != "")
        .filter(F.trim(F.col(use_code)) == use)
        .filter(F.upper(F.trim(F.col(site_type))).isin(*sites))
    )


def typed_registry(df: DataFrame) -> DataFrame:
    """All-text registry rows with the library's types; unreadable numbers are null."""
    return df.select(
        F.upper(F.trim("ARPT_ID")).alias("key"),
        F.trim("ARPT_NAME").alias("name"),
        v.place_name("CITY").alias("city"),
        F.upper(F.trim("STATE_CODE")).alias("region"),
        F.nullif(v.place_name("COUNTY_NAME"), F.lit("")).alias("county"),
        v.text_or_null("ICAO_ID").alias("icao"),
        v.to_float("LAT_DECIMAL").alias("latitude"),
        v.to_float("LONG_DECIMAL").alias("longitude"),
        v.to_int("ELEV").cast("int").alias("elevation_ft"),
        v.text_or_null("OWNERSHIP_TYPE_CODE").alias("ownership"),
        F.trim("FACILITY_USE_CODE").alias("facility_use"),
        F.upper(F.trim("SITE_TYPE_CODE")).alias("site_type"),
        v.text_or_null("EFF_DATE").alias("effective"),
        fuel_labels("FUEL_TYPES").alias("fuel"),
        v.to_flag("TRNS_STRG_HGR_FLAG").alias("hangar_storage"),
        v.to_flag("TRNS_STRG_TIE_FLAG").alias("tiedown_storage"),
    )


def fuel_labels(raw: Column | str,
                tokens: Sequence[tuple[str, str]] = rules.FUEL_TOKENS) -> Column:
    """Labels of the codes in a text, each code taken out once as it is read."""
    text = F.trim(F.coalesce(v.col(raw), F.lit("")))
    start = F.struct(
        F.concat(F.lit(" "), F.replace(F.upper(text), F.lit(","), F.lit(" ")), F.lit(" ")).alias("rest"),
        F.array().cast("array<string>").alias("labels"),
    )
    codes = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(n).alias("label")) for t, n in tokens])

    def take(acc: Column, code: Column) -> Column:
        at = F.instr(acc["rest"], code["token"])
        shorter = F.concat(
            F.substring(acc["rest"], F.lit(1), at - 1),
            F.lit(" "),
            F.substring(acc["rest"], at + F.length(code["token"]), F.length(acc["rest"])),
        )
        return F.struct(
            F.when(at > 0, shorter).otherwise(acc["rest"]).alias("rest"),
            F.when(at > 0, F.array_append(acc["labels"], code["label"]))
            .otherwise(acc["labels"]).alias("labels"),
        )

    read = F.aggregate(codes, start, take, lambda acc: acc["labels"])
    return F.when(text == "", F.lit(None)).otherwise(
        F.when(F.size(read) > 0, F.array_join(read, " · ")).otherwise(text)
    )


def valid_runways(df: DataFrame, key: str, ident: str, length: str, width: str,
                  status: str | None = None, surface: str | None = None) -> DataFrame:
    """Open runways with believable sizes, one row each.

    Kept as rows rather than an array per entity, so no entity is gathered whole.
    """
    bare = F.regexp_replace(F.replace(F.col(ident), F.lit("-"), F.lit("/")), r"\s+", "")
    shut = v.yes(F.upper(F.trim(F.col(status))).isin(*rules.CLOSED_MARKS)) if status else F.lit(False)
    low, high = rules.RUNWAY_WIDTH
    out = df.select(
        "*",
        F.upper(F.trim(F.col(key))).alias("_key"),
        bare.alias("_ident"),
        v.to_int(F.col(length).cast("string")).alias("length_ft"),
        v.to_int(F.col(width).cast("string")).alias("width_ft"),
        (v.text_or_null(surface) if surface else F.lit(None).cast("string")).alias("surface"),
    )
    return (
        out.filter((F.col("_key") != "") & F.col("_ident").contains("/") & ~shut)
        .filter(F.col("length_ft") >= rules.RUNWAY_MIN_LENGTH)
        .filter(F.col("width_ft").between(low, high))
        .withColumn("runway", F.col("_ident"))
        .drop("_key", "_ident")
    )


def role_for(hub: Column | str, role: Column | str, service: Column | str) -> Column:
    hub, role, service = v.col(hub), v.col(role), v.col(service)
    return (
        F.when(F.coalesce(hub, F.lit("")) != "",
               F.coalesce(v.lookup(rules.HUB_ROLES, hub), F.lower(hub)))
        .when(F.coalesce(role, F.lit("")) != "", F.lower(F.trim(role)))
        .otherwise(v.lookup(rules.SERVICE_ROLES, service))
    )


# --- merges ----------------------------------------------------------------

def last_row(df: DataFrame, keys: Sequence[str], seq: Column | str) -> DataFrame:
    """Last row per key by an explicit order."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), v.col(seq)).alias("_row"))
        .select(*keys, "_row.*")
    )


def first_row(df: DataFrame, keys: Sequence[str], seq: Column | str) -> DataFrame:
    """First row per key by an explicit order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), v.col(seq)).alias("_row"))
        .select(*keys, "_row.*")
    )


def merge_registries(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Full outer merge on `key`: name, city and ownership from B, the rest from A.

    Both sides hold one row per key (use `last_row`). `sources` records which
    registries knew the key, `in_b` whether the second one did.
    """
    left = a.select("key", F.struct("name", "city", "region", "ownership").alias("a"))
    right = b.select("key", F.struct("name", "city", "region", "ownership", "role").alias("b"))
    both = left.join(right, "key", "full_outer")
    in_a, in_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    own_name = F.coalesce(v.first_text("a.name"), F.col("key").cast("string"))
    return both.select(
        "key",
        F.coalesce(v.first_text("b.name"), v.place_name(own_name)).alias("name"),
        F.coalesce(v.first_text("b.city", "a.city"), F.lit("")).alias("city"),
        F.coalesce(v.first_text(F.col("a.region").cast("string"), F.col("b.region").cast("string")),
                   F.lit("")).alias("region"),
        v.first_text("b.ownership", "a.ownership").alias("ownership"),
        F.col("b.role").alias("role"),
        in_b.alias("in_b"),
        F.array_compact(
            F.array(F.when(in_a, F.lit(names[0])), F.when(in_b, F.lit(names[1])))
        ).alias("sources"),
    )


def carry_forward(snapshot: DataFrame, old: DataFrame, referenced: DataFrame) -> DataFrame:
    """Old rows missing from the snapshot stay if admitted or referenced."""
    gone = old.join(snapshot.select("key"), "key", "left_anti")
    kept = (
        gone.join(referenced.select("key").distinct().withColumn("_ref", F.lit(True)), "key", "left")
        .filter(v.yes(F.col("admitted")) | F.col("_ref").isNotNull())
        .drop("_ref")
        .withColumn("admitted", F.lit(True))
    )
    return snapshot.unionByName(kept)


def best_ranked(df: DataFrame, key: str, rank: Column, columns: Sequence[str], seq: str) -> DataFrame:
    """Best rank per key, then the first non-blank value per column inside that rank.

    Rows with all columns blank are ignored first. Two grouped aggregates replace
    an ordered window, so a hot key is combined before it is shuffled.
    """
    cleaned = df.select(F.col(key), rank.alias("_rank"), F.col(seq).alias("_seq"),
                        *[v.first_text(c).alias(c) for c in columns])
    useful = cleaned.filter(F.coalesce(*[F.col(c) for c in columns]).isNotNull())
    per_rank = useful.groupBy(key, "_rank").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in columns]
    )
    return (
        per_rank.groupBy(key).agg(F.min_by(F.struct(*columns), F.col("_rank")).alias("_best"))
        .select(key, "_best.*")
    )


def site_rank(kind: Column | str) -> Column:
    return F.coalesce(v.lookup(rules.TYPE_RANK, F.lower(F.trim(v.col(kind)))), F.lit(rules.OTHER_RANK))


def external_key(country: Column | str, local: Column | str, ident: Column | str) -> Column:
    """Registry key of a row in the third registry, null when it has none."""
    code = F.upper(F.trim(F.coalesce(v.col(local), F.lit(""))))
    name = F.upper(F.trim(F.coalesce(v.col(ident), F.lit(""))))
    key = (
        F.when(code != "", code)
        .when(name.startswith("K") & (F.length(name) == 4), F.substring(name, 2, 3))
        .when(name.rlike(r"^[\p{L}\p{N}]{3,4}$"), name)
    )
    return F.when(F.upper(F.trim(v.col(country))) == "US", key)


def fill_blanks(df: DataFrame, extra: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """Fill blank columns from a lookup; note the source only where a value changed."""
    renamed = extra.select("key", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(renamed, "key", "left")
    changed = v.any_of(*[
        v.first_text(c).isNull() & v.first_text(f"_{c}").isNotNull() for c in columns
    ])
    out = joined.withColumn("_changed", changed)
    for c in columns:
        out = out.withColumn(c, v.first_text(c, f"_{c}"))
    noted = F.when(F.col("_changed"), F.array_union("sources", F.array(F.lit(source)))).otherwise(F.col("sources"))
    return out.withColumn("sources", noted).drop("_changed", *[f"_{c}" for c in columns])


def overlay_reference(current: DataFrame, cases: DataFrame, *, prefer: Sequence[str],
                      fill: Sequence[str], source: str) -> DataFrame:
    """Reviewed cases over the registry: some columns replace, the others only fill.

    Cases without a registry row become rows of their own.
    """
    columns = [*prefer, *fill]
    a = current.select("key", F.struct(*columns, "sources").alias("a"))
    c = cases.select("key", F.struct(*columns).alias("c"))
    both = a.join(c, "key", "full_outer")

    def pick(name: str) -> Column:
        order = ("c", "a") if name in prefer else ("a", "c")
        kind = current.schema[name].dataType.simpleString()
        sides = [F.col(f"{s}.{name}") for s in order]
        return (v.first_text(*sides) if kind == "string" else F.coalesce(*sides)).alias(name)

    return both.select(
        "key", *[pick(name) for name in columns],
        F.coalesce("a.sources", F.array(F.lit(source))).alias("sources"),
    )


def case_documents(cases: DataFrame) -> DataFrame:
    return cases.select("key", F.explode("documents").alias("document")).select("key", "document.*")


# --- scope, lookups, dimensions ---------------------------------------------

def place_dimension(spark) -> DataFrame:
    """Name, code and region of every known place; a fixed small dimension."""
    region = {code: name for name, codes in rules.REGION_PLACES.items() for code in codes}
    rows = [(name, code, region.get(code)) for name, code in rules.PLACE_CODES.items()]
    return spark.createDataFrame(rows, "place string, code string, region string")


def place_code(place: Column | str) -> Column:
    """Code of a place name; a name the dimension does not know stops the job."""
    name = F.trim(v.col(place))
    known = v.lookup(rules.PLACE_CODES, name)
    return F.when(name.isNotNull(), F.coalesce(known, F.raise_error(F.concat(F.lit("unknown place "), name)).cast("string")))


def in_places(rows: DataFrame, dimension: DataFrame, place: str) -> DataFrame:
    """Rows with the code and region of their place; both null where it is not known."""
    return rows.join(F.broadcast(dimension.withColumnRenamed("place", place)), place, "left")


def unknown_keys(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Key values of the rows that the dimension does not know, with their count."""
    return df.join(dimension.select(key), key, "left_anti").groupBy(key).agg(
        F.count(F.lit(1)).alias("n")
    )


def parse_scope(text: str | None, known: Sequence[str],
                default: Sequence[str] = rules.DEFAULT_SCOPE) -> list[str] | None:
    """Scope codes of a setting; None means everything. Unknown codes raise."""
    raw = (text or "").strip()
    if not raw:
        return list(default)
    if raw.upper() in rules.ALL_SCOPE:
        return None
    codes = [c.strip().upper() for c in raw.replace(";", ",").split(",") if c.strip()]
    wrong = [c for c in codes if c not in set(known)]
    if wrong:
        raise ValueError(f"unknown scope code {wrong[0]}")
    return codes or list(default)


def in_scope(region: Column | str, codes: Sequence[str] | None) -> Column:
    if codes is None:
        return F.lit(True)
    return F.upper(F.trim(F.coalesce(v.col(region).cast("string"), F.lit("")))).isin(*codes)


def rows_in_region_scope(rows: DataFrame, entities: DataFrame, region: str) -> DataFrame:
    """A row's own region decides; a blank one asks the entity it belongs to."""
    scoped = (
        entities.filter(F.upper(F.trim(F.col("region").cast("string"))) == region)
        .select(F.col("key").alias("entity")).distinct().withColumn("_in", F.lit(True))
    )
    own = v.first_text(F.upper(F.trim(F.col("region").cast("string"))))
    keep = F.when(own.isNotNull(), own == region).otherwise(F.col("_in").isNotNull())
    return rows.join(scoped, "entity", "left").filter(keep).drop("_in")


def count_by_region(entities: DataFrame, regions: DataFrame) -> DataFrame:
    counts = entities.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    return regions.join(counts, "region", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rows_for_entities(entities: DataFrame, rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows of the wanted entities in a fixed order."""
    return rows.join(entities.select(F.col("key").alias("entity")), "entity", "left_semi").orderBy(
        "entity", *order
    )


def quota_sample(df: DataFrame, key: str, strata: Sequence[str], size: str,
                 quota: Mapping[str, int], total: int, seed: str,
                 forced: DataFrame | None = None) -> DataFrame:
    """Sample of `total` rows: forced keys, then a quota per stratum, then a fill.

    The shuffle order is a hash of key and seed, so it is the same on every run.
    Each stratum and the fill are top-k by that hash, limited before the shuffle.
    """
    draw = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)), 256)
    wanted = v.lookup(dict(quota), F.col(size))
    base = df.withColumn("_draw", draw)
    must = (
        base.join(forced.select(key).distinct(), key, "left_semi") if forced is not None
        else base.limit(0)
    )
    have = must.groupBy(*strata).agg(F.count(F.lit(1)).alias("_have"))
    free = base.join(must.select(key), key, "left_anti")
    top = max(quota.values())
    ranked = (
        free.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy("_draw", key)))
        .filter(F.col("_rank") <= top)
        .join(have, list(strata), "left")
        .filter(F.col("_rank") <= wanted - F.coalesce("_have", F.lit(0)))
        .drop("_rank", "_have")
    )
    picked = must.withColumn("_tier", F.lit(0)).unionByName(ranked.withColumn("_tier", F.lit(1)))
    rest = free.join(ranked.select(key), key, "left_anti").withColumn("_tier", F.lit(2))
    return picked.unionByName(rest).orderBy("_tier", "_draw", key).limit(total).drop("_tier", "_draw")


# --- display and intake ------------------------------------------------------

def county_label(value: Column | str) -> Column:
    text = F.trim(F.coalesce(v.col(value), F.lit("")))
    named = v.any_of(*[F.lower(text).contains(w) for w in rules.COUNTY_WORDS])
    return F.when((text == "") | named, text).otherwise(F.concat(text, F.lit(" County")))


def place_line(city: Column, county: Column, state_name: Column, state: Column) -> Column:
    return v.joined(", ", city, F.nullif(county_label(county), F.lit("")), v.first_text(state_name, state))


def identity_labels(use: Column, ownership: Column, role: Column) -> Column:
    owner = F.coalesce(v.lookup(rules.OWNERSHIP_LABELS, F.upper(ownership)), ownership)
    return F.filter(
        F.array(
            F.when(use == "PU", "Public-use").when(use == "PR", "Private-use"),
            owner,
            F.replace(role, F.lit("_"), F.lit(" ")),
        ),
        lambda x: x.isNotNull() & (x != ""),
    )


def completeness_phrase(value: Column | str) -> Column:
    return F.coalesce(v.lookup(rules.COMPLETENESS_PHRASE, v.col(value)), F.lit(""))


def form_section(body: Column | str, heading: str) -> Column:
    """Text under one `### heading` of a form body."""
    quoted = heading.replace("?", r"\?").replace("(", r"\(").replace(")", r"\)")
    found = F.regexp_extract(v.col(body), rf"(?s)### {quoted}[ \t\x0B\f\r]*\n\s*(.*?)(?=\n### |\z)", 1)
    return F.trim(F.btrim(F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")), F.lit("_")))


def parse_form(body: Column | str) -> Column:
    """Form text as a struct: report type, kind, entity key, region, URL, notes."""
    no_answer = "No response"

    def answered(heading: str) -> Column:
        text = form_section(body, heading)
        return F.when((text != "") & (text != no_answer), text)

    token = F.upper(F.btrim(F.split_part(F.regexp_replace(answered("Airport"), r"\s+", " "), F.lit(" "), F.lit(1)), F.lit(",.")))
    key = F.when(token.rlike(r"^K\p{L}{3}$"), F.substring(token, 2, 3)).otherwise(token)
    return F.struct(
        F.coalesce(v.lookup(rules.REPORT_TYPES, form_section(body, "What should we do?")), F.lit("other")).alias("report_type"),
        F.coalesce(v.lookup(rules.FORM_KINDS, form_section(body, "What kind of document?")), F.lit("other")).alias("kind"),
        key.alias("entity"),
        F.substring(F.upper(answered("State")), 1, 2).alias("region"),
        F.split_part(F.regexp_replace(answered("Official URL"), r"\s+", " "), F.lit(" "), F.lit(1)).alias("url"),
        form_section(body, "Notes").alias("notes"),
    )


def form_can_queue(form: Column) -> Column:
    has_url = v.first_text(form["url"]).isNotNull()
    return has_url & ((form["kind"] == "statute") | v.first_text(form["entity"]).isNotNull())


def form_resolution(status: Column | str) -> Column:
    return F.when(v.col(status).isin(*rules.FORM_CLOSING), "close").otherwise("open")


def website(url: Column | str) -> Column:
    return urls.http_url(url)
