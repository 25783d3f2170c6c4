"""Page text: page rows, routing, excerpts, word tables, facts, outlook, assertions."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainledger.functions import html
from plainledger.functions import values as v
from plainledger.operators.skew import spread_join
from plainledger.rules import text as rules
from plainledger.rules.text import OutlookRules
from plainledger.session import cut


# --- pages -------------------------------------------------------------------

def page_rows(docs: DataFrame, key: str, pages: str, limit: int | None = None) -> DataFrame:
    """One row per non-empty page: blanks collapsed, numbers from 1 kept.

    `limit` cuts a page's text; by default the whole text stays.
    """
    rows = docs.select(F.col(key), F.posexplode(pages).alias("_pos", "_raw"))
    text = F.trim(F.regexp_replace(F.coalesce("_raw", F.lit("")), html.BLANKS, " "))
    out = rows.select(key, (F.col("_pos") + 1).alias("page"), text.alias("text")).filter("text <> ''")
    return out if limit is None else out.withColumn("text", F.substring("text", 1, limit))


def routed_pages(pages: DataFrame, ocr: bool = True) -> DataFrame:
    """Text source of every page: native, ocr, supervised or empty, with its error.

    Pages: native (text), image_pixels, recognised (text or null).
    """
    native = F.trim(F.coalesce("native", F.lit("")))
    short = F.length(native) < rules.MIN_NATIVE_CHARS
    picture = short & (F.coalesce("image_pixels", F.lit(0)) >= rules.MIN_IMAGE_PIXELS)
    read = F.trim(F.coalesce("recognised", F.lit(""))) if ocr else F.lit("")
    method = (
        F.when(picture, F.when(read != "", "ocr").otherwise("supervised"))
        .when(native == "", "empty").otherwise("native")
    )
    fault = "ocr_empty" if ocr else "ocr_unavailable"
    text = F.when(picture & F.lit(ocr), read).otherwise(native)
    return (
        pages.withColumn("method", method).withColumn("text", text)
        .withColumn("characters", F.length("text"))
        .withColumn("text_sha256", F.sha2("text", 256))
        .withColumn("error", F.when(F.col("method") == "supervised", F.lit(fault)))
    )


def manifests(pages: DataFrame, key: str) -> DataFrame:
    """Per document: status, pages per method, total characters, errors."""
    def n(method: str) -> Column:
        return F.count_if(F.col("method") == method).alias(f"n_{method}")

    out = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pages"), n("native"), n("ocr"), n("supervised"), n("empty"),
        F.sum("characters").alias("total_characters"), F.count("error").alias("n_errors"),
    )
    status = (
        F.when(F.col("n_errors") == 0, "completed")
        .when(F.col("total_characters") > 0, "partial").otherwise("failed")
    )
    return out.withColumn("status", status)


def is_body_page(text: Column) -> Column:
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return (F.length(text) >= rules.MIN_PAGE_CHARS) & ~(
        text.rlike(rules.CONTENTS) & (dots > rules.CONTENTS_DOTS))


def excerpt(pages: Column | str) -> Column:
    """Body pages of a document in page order, a blank line between them."""
    trimmed = F.transform(v.col(pages), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(trimmed, is_body_page), "\n\n")


def words_to_pages(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Word table to page text: words to lines, lines to pages, in order.

    Words: keys, block, par, line, seq, text, conf. A page is one row of the
    result, so what is gathered is never more than one page. A word is shuffled
    once, to its page.
    """
    keys = list(keys)
    kept = words.filter(F.trim("text") != "").repartition(*keys)
    lines = kept.groupBy(*keys, "block", "par", "line").agg(
        F.collect_list(F.struct("seq", "text", "conf")).alias("words"))
    return lines_to_pages(lines, keys)


def lines_to_pages(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Word lists to page text, as `words_to_pages`: a row holds the words of a whole line.

    Lines: keys, block, par, line, words (seq, text, conf). Words become the line's
    text and its sums in their row, so only those are shuffled.
    """
    keys = list(keys)
    kept = lines.withColumn("_words", F.array_sort(F.transform(
        F.filter("words", lambda w: F.trim(w["text"]) != ""),
        lambda w: F.struct(w["seq"].alias("seq"), F.trim(w["text"]).alias("text"), w["conf"].alias("conf")))))
    good = F.filter("_words", lambda w: w["conf"] >= 0)
    whole = kept.filter(F.size("_words") > 0).select(
        *keys, "block", "par", "line", F.array_join(F.transform("_words", lambda w: w["text"]), " ").alias("_line"),
        F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda total, w: total + w["conf"])).alias("_sum"),
        F.size(good).alias("_n"), F.size("_words").alias("_all"))
    return whole.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("block", "par", "line", "_line"))).alias("_lines"),
        F.sum("_all").alias("word_count"),
        F.round(F.sum("_sum") / F.sum("_n"), 3).alias("mean_confidence"),
    ).select(
        *keys, F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("text"),
        "word_count", "mean_confidence")


def citation_faults(citations: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Citations that miss their page, its text hash, or have a bad box.

    Citations: key, page, text_sha256, bbox struct<x,y,width,height> or null.
    """
    known = pages.select(key, "page", F.col("text_sha256").alias("_want"))
    box = F.col("bbox")
    bad_box = box.isNotNull() & ~v.yes(
        (box["x"] >= 0) & (box["y"] >= 0) & (box["width"] > 0) & (box["height"] > 0))
    fault = (
        F.when(F.col("_want").isNull(), "page out of range")
        .when(~v.yes(F.col("_want") == F.col("text_sha256")), "text hash differs")
        .when(bad_box, "bad box")
    )
    return citations.join(known, [key, "page"], "left").withColumn("fault", fault).drop("_want").filter("fault is not null")


def uncited(results: DataFrame, citations: DataFrame, key: str) -> DataFrame:
    """Results without a single citation."""
    return results.join(citations.select(key), key, "left_anti")


# --- facts -------------------------------------------------------------------

def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def match_spans(text: Column, pattern: str) -> Column:
    """Hits of a pattern with their start (from 1): array<struct<start, hit>>."""
    hits = _all(text, pattern, 0)
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<start: int, hit: string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["next"] + F.length(pair["gap"])
        return F.struct(
            (at + F.length(pair["hit"])).cast("int").alias("next"),
            F.array_append(acc["out"], F.struct(at.cast("int").alias("start"), pair["hit"].alias("hit"))).alias("out"),
        )

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def runway_id(raw: Column) -> Column:
    return F.regexp_replace(F.translate(raw, "–-", "//"), r"(?U)\s+", "")


def usable(length: Column, width: Column) -> Column:
    return v.yes((length >= 500) & width.between(20, 400))


def surface_label(raw: Column | str) -> Column:
    """Display name of a surface code; a phrase that is one already stays."""
    text = F.trim(F.coalesce(v.col(raw), F.lit("")))
    phrase = text.rlike(r"^\p{Lu}") & (F.upper(text) != text) & ~text.contains("-")
    code = F.translate(F.replace(F.upper(text), F.lit(" "), F.lit("")), "_", "-")
    named = F.coalesce(*[
        F.when((code == c) | code.startswith(c + "-"), F.lit(name)) for c, name in rules.SURFACES.items()
    ])
    return F.when(text == "", F.lit(None)).when(phrase, text).otherwise(named)


def runway_line(ident: Column, length: Column, width: Column, surface: Column | None = None) -> Column:
    line = F.concat(ident, F.lit(", "), v.thousands(length), F.lit(" by "), v.thousands(width), F.lit(" ft"))
    label = surface_label(surface) if surface is not None else F.lit(None).cast("string")
    return F.concat(line, F.coalesce(F.concat(F.lit(" · "), label), F.lit("")))


def _runway_rows(hits: Column, pattern: str) -> Column:
    return F.transform(hits, lambda h: F.struct(
        runway_id(F.regexp_extract(h, pattern, 1)).alias("id"),
        v.count_from_text(F.regexp_extract(h, pattern, 2)).alias("length"),
        v.count_from_text(F.regexp_extract(h, pattern, 3)).alias("width")))


def phrases(text: str, lowered: str, odd_case: str) -> dict[str, Column]:
    """What each phrase pattern finds in a text: the one pass over the text itself.

    A pattern is tried only in texts that hold its words, where it can from the first of
    them on. The facts below are built from these small columns, so no pattern runs twice.
    """
    blob, low, odd = F.col(text), F.col(lowered), F.col(odd_case)

    def near(*words: str) -> Column:
        """The text from the first of the words that a pattern's matches begin with."""
        return v.from_first(blob, low, odd, words)

    def holding(*words: str) -> Column:
        """The text if it holds all words that a match holds, else an empty one."""
        return F.when(odd | v.all_of(*[F.contains(low, F.lit(w)) for w in words]), blob).otherwise("")

    def spans(pattern: str, back: int, ahead: int, *words: str) -> Column:
        """Hits with the lower-case text from `back` before to `ahead` after their start."""
        def around(m: Column) -> Column:
            left = F.greatest(m["start"] - back, F.lit(1))
            return F.struct(m["hit"].alias("hit"), F.lower(F.substring(blob, left, m["start"] + ahead - left)).alias("window"))

        return F.transform(match_spans(holding(*words), pattern), around)

    runway = near("runway")
    primes = F.when(odd | F.contains(low, F.lit("'")) | F.contains(low, F.lit("′")), blob).otherwise("")
    return {
        "_long_wide": _all(runway, rules.RWY_LONG_WIDE, 0),
        "_by": _all(runway, rules.RWY_BY, 0),
        "_one_id": _first(holding("one", "runway"), rules.RWY_ID),
        "_usable": _first(near("usable"), rules.RWY_USABLE),
        "_wide": _first(runway, rules.RWY_WIDE),
        "_pairs": _all(runway, rules.RWY_PAIR, 0),
        "_primes": _all(primes, rules.RWY_PRIME, 0),
        "_count": _first(holding("has", "runway"), rules.RWY_COUNT),
        "_based": F.coalesce(_first(near("currently"), rules.BASED_NOW), _first(holding("based aircraft at the airport"), rules.BASED_AT)),
        "_hangared": _first(holding("stored in hangars"), rules.HANGARED),
        "_rest": _first(near("stored in hangars,"), rules.TIEDOWN_REST),
        "_over": F.slice(spans(rules.OPS_OVER, 80, 0, "over", "annual operations"), 1, 1),
        "_annual": spans(rules.OPS_ANNUAL, 120, 40, "annual", "operations"),
        "_units": _all(holding("t-hangar"), rules.T_UNIT, 0),
        "_buildings": _first(holding("hangar buildings"), rules.HANGAR_BUILDINGS),
        "_no_tower": low.rlike(rules.NO_TOWER),
        "_lounge": low.contains("pilot lounge"),
        "_fuel": low.rlike(rules.FUEL),
        "_no_fbo": low.rlike(rules.NO_FBO),
        "_fbo": low.rlike(rules.FBO),
        "_tiedown": low.contains("tiedown"),
    }


COUNTS = ("_usable", "_wide", "_count", "_based", "_hangared", "_rest", "_buildings")


def parsed() -> dict[str, Column]:
    """Second step: counts and lists read from the short hits."""
    pairs = F.transform("_pairs", lambda h: runway_id(F.concat(
        F.regexp_extract(h, rules.RWY_PAIR, 1), F.lit("/"), F.regexp_extract(h, rules.RWY_PAIR, 2))))
    sizes = F.transform("_primes", lambda h: F.struct(
        v.count_from_text(F.regexp_extract(h, rules.RWY_PRIME, 1)).alias("length"),
        v.count_from_text(F.regexp_extract(h, rules.RWY_PRIME, 2)).alias("width")))
    numbers = F.transform("_units", lambda h: v.count_from_text(F.regexp_extract(h, r"(\d+)", 1)))
    current = F.try_element_at("_over", F.lit(1))
    rows = F.concat(_runway_rows(F.col("_long_wide"), rules.RWY_LONG_WIDE), _runway_rows(F.col("_by"), rules.RWY_BY))
    return {
        **{name: v.count_from_text(name) for name in COUNTS},
        "_one_id": runway_id(F.col("_one_id")),
        "_stated": F.filter(rows, lambda r: (r["id"] != "") & usable(r["length"], r["width"])),
        "_names": F.slice(F.array_distinct(pairs), 1, 3),
        "_dims": F.slice(F.filter(sizes, lambda d: usable(d["length"], d["width"])), 1, 3),
        "_numbers": F.filter(numbers, lambda n: n.isNotNull()),
        "_current": F.when(current["window"].contains("currently"),
                           v.count_from_text(F.regexp_extract(current["hit"], rules.OPS_OVER, 1))),
        "_dated": F.transform("_annual", lambda m: F.struct(
            v.count_from_text(F.regexp_extract(m["hit"], rules.OPS_ANNUAL, 1)).alias("n"),
            _first(m["hit"], rules.OPS_ANNUAL, 2).try_cast("int").alias("year"), m["window"].alias("window"))),
    }


def runways() -> Column:
    """Runway lines by the first phrasing that yields any, at most three."""
    ids = F.transform("_stated", lambda r: r["id"])
    once = F.filter("_stated", lambda r, i: F.array_position(ids, r["id"]) == i + 1)
    lines = F.array_join(F.transform(F.slice(once, 1, 3), lambda r: runway_line(r["id"], r["length"], r["width"])), "\n")
    single = F.when(F.col("_one_id").isNotNull() & usable(F.col("_usable"), F.col("_wide")),
                    runway_line(F.col("_one_id"), F.col("_usable"), F.col("_wide")))
    both = F.filter(F.arrays_zip(F.col("_names").alias("id"), F.col("_dims").alias("d")), lambda z: z["id"].isNotNull() & z["d"].isNotNull())
    paired = F.array_join(F.transform(both, lambda z: runway_line(z["id"], z["d"]["length"], z["d"]["width"])), "\n")
    return F.coalesce(F.nullif(lines, F.lit("")), single, F.nullif(paired, F.lit("")), F.col("_count").cast("string"))


def based_aircraft() -> Column:
    count = F.coalesce(F.when(F.col("_based") <= rules.MAX_BASED, F.col("_based")), F.col("_hangared") + F.col("_rest"))
    return F.concat(v.thousands(count), F.lit(" based"))


def hangared_aircraft() -> Column:
    rest = F.concat(F.lit(" · "), v.thousands("_rest"), F.lit(" on tiedowns"))
    return F.concat(v.thousands("_hangared"), F.lit(" in hangars"), F.coalesce(rest, F.lit("")))


def operations() -> Column:
    """Yearly operations: the newest dated count, forecasts left out.

    A count introduced by "currently ... over" stands until a dated one replaces it.
    """
    current = F.col("_current")
    start = F.struct(current.alias("n"), F.lit(None).cast("int").alias("year"))

    def step(best: Column, m: Column) -> Column:
        out = v.any_of(*[m["window"].contains(w) for w in rules.OPS_FORECAST]) | (
            m["window"].contains("in 2006") & current.isNotNull())
        newer = m["year"].isNotNull() & (best["year"].isNull() | (m["year"] >= best["year"]))
        take = v.yes(m["n"] >= rules.MIN_OPS) & ~out & (best["n"].isNull() | v.yes(newer))
        return F.struct(F.when(take, m["n"]).otherwise(best["n"]).alias("n"),
                        F.when(take, m["year"]).otherwise(best["year"]).alias("year"))

    def shown(best: Column) -> Column:
        year = F.concat(F.lit(" ("), best["year"].cast("string"), F.lit(")"))
        return F.concat(v.thousands(best["n"]), F.lit(" a year"), F.coalesce(year, F.lit("")))

    return F.aggregate("_dated", start, step, shown)


def hangars() -> Column:
    n, buildings = F.size("_numbers"), F.col("_buildings")
    total = F.aggregate("_numbers", F.lit(0).cast("long"), lambda a, x: a + x)
    more = F.when(buildings > n, F.concat(F.lit(" · "), buildings.cast("string"), F.lit(" buildings")))
    rows = F.concat(n.cast("string"), F.lit(" T-hangars ("), v.thousands(total), F.lit(" units)"), F.coalesce(more, F.lit("")))
    return F.when(n > 0, rows).otherwise(F.concat(v.thousands(buildings), F.lit(" buildings")))


def facilities() -> Column:
    items = F.array_compact(F.array(
        F.when(F.col("_no_tower"), "Non-towered"), F.when(F.col("_lounge"), "pilot lounge"),
        F.when(F.col("_fuel"), "fuel"), F.when(F.col("_no_fbo"), "no FBO").when(F.col("_fbo"), "FBO"),
        F.when(F.col("_tiedown"), "tiedowns"),
    ))
    return F.nullif(F.array_join(items, " · "), F.lit(""))


def fact_rows(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Facts of a text as rows (keys, label, value); the text itself is left behind."""
    # The text in lower case is a column of its own, so it is made once.
    lowered = docs.select(*keys, F.coalesce(v.col(text), F.lit("")).alias("_blob")).withColumns(
        {"_low": F.lower("_blob"), "_odd": v.has_odd_case("_blob")})
    found = lowered.select(*keys, *[c.alias(name) for name, c in phrases("_blob", "_low", "_odd").items()])
    ready = found.withColumns(parsed())
    facts = {
        "Runways": runways(), "Based aircraft": based_aircraft(), "Hangared aircraft": hangared_aircraft(),
        "Operations": operations(), "Hangars": hangars(), "Facilities": facilities(),
    }
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), c.alias("value")) for x, c in facts.items()])
    return ready.select(*keys, F.explode(pairs).alias("f")).select(*keys, "f.*").filter("value is not null")


def registry_facts(entities: DataFrame, runway_rows: DataFrame) -> DataFrame:
    """Facts a registry row already knows: (entity, label, value).

    Entities: key, elevation_ft, fuel, hangar_storage, tiedown_storage. Runways: key,
    seq, runway, length_ft, width_ft, surface; the first three ids are shown.
    """
    first = runway_rows.groupBy("key", "runway").agg(
        F.min_by(F.struct("length_ft", "width_ft", "surface"), "seq").alias("r"), F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("seq", "runway"))
    shown = first.withColumn("pos", rank).filter("pos <= 3")
    lines = shown.select("key", "pos", runway_line(F.col("runway"), F.col("r.length_ft"), F.col("r.width_ft"), F.col("r.surface")).alias("line"))
    runway = lines.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l")).select(
        F.col("key").alias("entity"), F.lit("Runways").alias("label"),
        F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("value"))
    bits = v.joined(" · ", F.trim("fuel"), F.when(F.col("hangar_storage"), "hangar storage"), F.when(F.col("tiedown_storage"), "tiedowns"))
    pairs = F.array(
        F.struct(F.lit("Elevation").alias("label"), F.concat(v.thousands("elevation_ft"), F.lit(" ft")).alias("value")),
        F.struct(F.lit("Facilities").alias("label"), F.nullif(bits, F.lit("")).alias("value")))
    rest = entities.select(F.col("key").alias("entity"), F.explode(pairs).alias("f")).select("entity", "f.*")
    return rest.filter("value is not null").unionByName(runway)


def with_surface(plan: Column, surfaces: Column) -> Column:
    """Add the surface to the plan's runway lines; `surfaces` maps id to code."""
    zipped = F.arrays_zip(_all(plan, rules.RWY_LINE, 1).alias("a"), _all(plan, rules.RWY_LINE, 2).alias("b"), _all(plan, rules.RWY_LINE, 3).alias("c"))
    lines = F.transform(zipped, lambda r: runway_line(
        r["a"], v.count_from_text(r["b"]), v.count_from_text(r["c"]), F.try_element_at(surfaces, r["a"])))
    return F.coalesce(F.nullif(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), F.lit("")), plan)


def with_surfaces(facts: DataFrame, runway_rows: DataFrame) -> DataFrame:
    """Runway lines with the surface the registry knows; lines that show one stay as they are.

    Facts: entity, label, value, one row per entity and label (`merge_facts`). Runways:
    key, seq, runway, surface; the last row of a runway counts. Only the surfaces of the runways a line names are looked
    up, so an entity with many runways brings no more than its lines ask for.
    """
    bare = (F.col("label") == "Runways") & ~v.yes(F.col("value").rlike(r"ft\s*·\s*\S"))
    known = runway_rows.groupBy(F.col("key").alias("entity"), runway_id(F.col("runway")).alias("_id")).agg(
        F.max_by("surface", "seq").alias("_surface"))
    ids = F.array_distinct(F.transform(_all(F.col("value"), rules.RWY_LINE, 1), runway_id))
    asked = facts.filter(bare).select("entity", F.explode(ids).alias("_id"))
    found = asked.join(known, ["entity", "_id"]).filter("_surface is not null").groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.struct("_id", "_surface"))).alias("_surfaces"))
    joined = facts.join(found, "entity", "left")
    value = F.when(bare & F.col("_surfaces").isNotNull(), with_surface(F.col("value"), F.col("_surfaces"))).otherwise(F.col("value"))
    return joined.withColumn("value", value).drop("_surfaces")


def merge_facts(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """One value per entity and label: the best-ranked work's, else the registry's.

    Facts: entity, work_rank, label, value. A bare runway count yields to the
    registry's lines. Position follows the fixed label order.
    """
    best = facts.groupBy("entity", "label").agg(F.min_by("value", "work_rank").alias("plan"))
    known = registry.select("entity", "label", F.col("value").alias("own"))
    both = best.join(known, ["entity", "label"], "full_outer")
    bare = (F.col("label") == "Runways") & v.yes(F.trim("plan").rlike(r"^\d+$"))
    value = F.when(bare, F.coalesce("own", "plan")).otherwise(F.coalesce("plan", "own"))
    order = F.array_position(F.array(*[F.lit(x) for x in rules.FACT_ORDER]), F.col("label"))
    return both.select("entity", "label", value.alias("value"), order.cast("int").alias("pos"))


# --- outlook -----------------------------------------------------------------

def signal_hits(text: Column, pattern: str, negatable: bool) -> Column:
    """Matches of a pattern from left to right, none overlapping, that no negation precedes closely.

    Every match is consumed, negated or not. Each comes with what stands before it, up
    to the reach of a negation, in a group of a look-behind.
    """
    if not negatable:
        return F.regexp_count(text, F.lit(f"(?i){pattern}"))
    reach = rules.NEGATION_REACH
    before = rf"(?<=(\A[\s\S]{{0,{reach - 1}}}|[\s\S]{{{reach}}}))"
    own = re.compile(pattern).groups
    # The pattern is tried first: it fails sooner than the look-behind.
    found = F.regexp_extract_all(text, F.lit(f"(?i)(?=(?:{pattern})){before}(?:{pattern})"), F.lit(own + 1))
    negated = rf"(?i)\b(?:{'|'.join(rules.NEGATIONS)})\b"
    return F.size(F.filter(found, lambda c: ~c.rlike(negated)))


def signal_scores(docs: DataFrame, text: str, pack: OutlookRules = OutlookRules(),
                  preferred_limit: int | None = None) -> DataFrame:
    """Add decline, grow and hold scores of a text.

    Preferred passages weigh three times the body; each pattern counts at most
    twice per source. The text columns made here are dropped again at once.
    """
    blob = docs.withColumn("_blob", html.outlook_text(text))
    seen = F.col("_blob") if preferred_limit is None else F.substring("_blob", 1, preferred_limit)
    staged = blob.withColumn("_best", F.array_join(_all(seen, pack.preferred, 0), " "))

    def hits(source: str, pattern: str, negatable: bool) -> Column:
        return F.least(signal_hits(F.col(source), pattern, negatable), F.lit(rules.MAX_HITS))

    def score(group: str) -> Column:
        terms = [
            (hits("_blob", p, n) + rules.PREFERRED_WEIGHT * hits("_best", p, n)) * w
            for g, p, w, n in pack.signals if g == group
        ]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return F.when(F.length("_blob") < rules.MIN_OUTLOOK_CHARS, 0).otherwise(total).cast("long").alias(group)

    return staged.select(*docs.columns, score("decline"), score("grow"), score("hold"))


def trajectory(decline: Column | str, grow: Column | str, hold: Column | str) -> Column:
    """(band, position, needle_x, needle_y); null when the signal is too weak."""
    d, g, h = v.col(decline), v.col(grow), v.col(hold)
    total = d + g + h
    raw = F.when((h > 0) & (d == 0) & (g == 0), F.lit(0.0)).otherwise((g - d) / total)
    pos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    band = F.when(pos < -rules.BAND_EDGE, "declining").when(pos > rules.BAND_EDGE, "growing").otherwise("maintaining")
    angle = F.radians(180 - (pos + 1) * 90)
    return F.when(total >= rules.MIN_SIGNAL, F.struct(
        band.alias("band"), F.bround(pos, 3).alias("position"),
        F.bround(100 + 72 * F.cos(angle), 1).alias("needle_x"),
        F.bround(100 - 72 * F.sin(angle), 1).alias("needle_y")))


def combine_outlooks(scores: DataFrame, order: Column, key: str = "entity") -> DataFrame:
    """Scores of an entity's works summed by rank weight: newest 4, second 3, others 1.

    `order` ranks the works, greatest first, and must tell them apart. The scores are
    written once, with nothing but numbers. Every work counts with the least weight and
    the two newest, found by a limit that acts before the shuffle, once more with the
    rest of theirs: one sum, no join, so an entity that holds most works is no hot key.
    """
    first, second, other = rules.EDITION_WEIGHTS
    parts = ("decline", "grow", "hold")
    plain = cut(scores.select(key, order.alias("_order"), *parts))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_order").desc()))
    top = plain.withColumn("_rank", rank).filter("_rank <= 2")
    extra = F.when(F.col("_rank") == 1, first - other).otherwise(second - other)
    weighed = plain.select(key, *[(F.col(c) * other).alias(c) for c in parts]).unionByName(
        top.select(key, *[(F.col(c) * extra).alias(c) for c in parts]))
    sums = weighed.groupBy(key).agg(*[F.sum(c).alias(c) for c in parts])
    return sums.withColumn("trajectory", trajectory(*parts))


def with_funding_outlook(works: DataFrame, lines: DataFrame, pack: OutlookRules = OutlookRules()) -> DataFrame:
    """The outlook of funding lines replaces a missing or a maintaining one.

    Works: entity, trajectory. Lines: entity, line; at most a handful per entity.
    """
    text = lines.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l")).select(
        "entity", F.array_join(F.transform("_l", lambda x: x["line"]), " ").alias("text"))
    scored = signal_scores(text, "text", pack)
    first = rules.EDITION_WEIGHTS[0]
    other = scored.select("entity", trajectory(F.col("decline") * first, F.col("grow") * first, F.col("hold") * first).alias("_other"))
    both = works.join(other, "entity", "full_outer")
    steady = F.col("trajectory.band") == "maintaining"
    swap = F.col("trajectory").isNull() | v.yes(steady & (F.col("_other.band") != "maintaining"))
    return both.withColumn("trajectory", F.when(swap, F.col("_other")).otherwise(F.col("trajectory"))).drop("_other")


def outlook_lists(entities: DataFrame, outlooks: DataFrame) -> DataFrame:
    """Growing and declining entities by region, name and key."""
    chosen = outlooks.filter(F.col("band").isin("growing", "declining")).select(F.col("entity").alias("key"), "band")
    return entities.join(chosen, "key").orderBy(
        "band", F.coalesce(F.col("region").cast("string"), F.lit("")), F.lower(F.coalesce("name", F.lit(""))), "key")


# --- assertions ------------------------------------------------------------------

def _folded(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def _nfkc(text: Column) -> Column:
    return F.pandas_udf(_folded, "string")(text)


def plain_tokens(text: Column) -> Column:
    """Lower-case letters and digits between single blanks; digit groups joined.

    Compatibility folding runs in Python, only for text beyond ASCII.
    """
    folded = F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    joined = F.regexp_replace(F.lower(folded), r"(?<=\d)[,$-](?=\d)", "")
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def _holds(text: Column, term: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))


# Tests of one page that meet its text together.
PAGE_TESTS = 1000


def assertion_misses(pages: DataFrame, assertions: DataFrame, key: str) -> DataFrame:
    """Assertions that a page's text does not meet: (key, id).

    Assertions: key, id, kind (sequence, all_of, window), terms, anchor, max_characters.
    A term counts only as whole tokens. A page's tests are gathered before they meet
    its text, at most about PAGE_TESTS in a row, so the text is there once and not once
    per assertion and term; what leaves that row are the ids of the misses.
    """
    wanted = assertions.withColumn("_terms", F.filter(F.col("terms"), lambda t: t.isNotNull()))
    terms = wanted.select(key, "id", "kind", "max_characters", "anchor", F.explode_outer("_terms").alias("term"))
    tests = terms.select(
        key, "id", (F.col("kind") == "window").alias("windowed"), "max_characters",
        plain_tokens(F.coalesce("anchor", F.lit(""))).alias("anchor"), plain_tokens(F.coalesce("term", F.lit(""))).alias("term"))
    many = tests.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PAGE_TESTS)
    dealt = spread_join(tests, many, [key], F.struct("id", "term", "anchor"))
    rows = F.greatest(F.lit(1), F.ceil(F.coalesce("_n", F.lit(0)) / PAGE_TESTS)).cast("long")
    group = dealt.withColumn("_group", F.pmod(F.xxhash64("id", "term", "anchor"), rows)).groupBy(key, "_group").agg(
        F.collect_set(F.struct("id", "windowed", "max_characters", "anchor", "term")).alias("_tests"))
    texts = pages.select(key, plain_tokens(F.col("text")).alias("_text"))

    def held(t: Column) -> Column:
        text, spaced = F.col("_text"), F.concat(F.lit(" "), F.col("_text"), F.lit(" "))
        at = F.instr(spaced, F.concat(F.lit(" "), t["anchor"], F.lit(" ")))
        window = F.when(at > 0, F.substring(text, at, t["max_characters"])).otherwise("")
        return v.yes(F.when(t["windowed"], (window != "") & _holds(window, t["term"])).otherwise(_holds(text, t["term"])))

    missed = F.array_distinct(F.transform(F.filter("_tests", lambda t: ~held(t)), lambda t: t["id"]))
    found = group.join(texts, key, "left").select(key, missed.alias("_missed"))
    return found.select(key, F.explode("_missed").alias("id")).distinct()
