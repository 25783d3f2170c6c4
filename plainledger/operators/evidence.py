"""Evidence features, linear scores, kind decision and flags of URL packets.

Packets: id, lid, name, url, label, body, outline (array), source_bytes. Features
are built in steps, each a set of columns, so every pattern runs once per row; the
body is dropped as soon as the features stand.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainledger.functions import urls
from plainledger.functions import values as v
from plainledger.operators.web import from_encyclopedia
from plainledger.rules import evidence as rules
from plainledger.rules import web as web_rules
from plainledger.rules.evidence import EvidenceRules, ScoreConfig


def _fold(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[_\-]+", " ")


def name_tokens(name: Column | str) -> Column:
    """Words of a name that tell it apart: longer than three letters, no stop words."""
    words = F.regexp_extract_all(_fold(F.coalesce(v.col(name), F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda t: (F.length(t) > 3) & ~t.isin(*rules.NAME_STOP))


def _names(blob: Column, low: Column, name: Column) -> Column:
    """Whether a text holds a name when both are folded; `low` is the text in lower case.

    A text is folded only if it may hold the name in other words than as it is: all of
    its words, the first one before a blank or a mark that folds to one.
    """
    folded = _fold(name)
    words = F.split(folded, " ", -1)
    lead = F.element_at(words, 1)
    likely = (F.size(words) > 1) & v.any_of(*[F.contains(low, F.concat(lead, F.lit(c))) for c in " _-"]) & F.forall(
        words, lambda w: F.contains(low, w))
    return (name != "") & (F.contains(low, folded) | (likely & F.contains(_fold(blob), folded)))


def token_hits(tokens: Column, text: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.contains(F.lower(text), t)))


def _has(text: Column, needle: Column) -> Column:
    return (needle != "") & F.contains(F.lower(text), F.lower(needle))


def features(packets: DataFrame, pack: EvidenceRules = EvidenceRules(), keep: Sequence[str] = ("id",),
             first_page: int | None = None, first_lines: int | None = None) -> DataFrame:
    """Packet features as doubles, named `f_...`, next to the kept columns.

    `first_page` and `first_lines` limit the two signals of a document's opening to so
    many characters (`rules.FIRST_PAGE` and `rules.FIRST_LINES` are usual); by default
    they read the whole text.
    """
    def opening(value: Column, chars: int | None) -> Column:
        return value if chars is None else F.substring(value, 1, chars)

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    base = packets.select(
        *keep, text("url").alias("_url"), text("label").alias("_label"), text("body").alias("_body"),
        F.trim(text("lid")).alias("_lid"), F.trim(text("name")).alias("_airport"),
        F.array_join("outline", " ").alias("_outline"), F.size("outline").alias("_outline_n"),
        F.coalesce("source_bytes", F.lit(0)).alias("_bytes"), name_tokens("name").alias("_tokens"))
    parts = base.withColumns({
        "_path": urls.path("_url"), "_name": urls.file_name("_url"), "_host": urls.host("_url"),
        "_text": F.concat_ws(" ", "_label", "_body", "_outline"),
        "_blob": v.joined(" ", F.col("_label"), F.col("_url"), F.col("_body"), F.col("_outline")),
    }).withColumns({
        "_low": F.lower("_path"), "_low_body": F.lower("_body"), "_odd": v.has_odd_case("_text"),
    }).withColumns({
        "_low_text": F.concat_ws(" ", F.lower("_label"), "_low_body", F.lower("_outline")),
        "_low_blob": v.joined(" ", F.lower("_label"), F.lower("_url"), F.col("_low_body"), F.lower("_outline")),
    })
    name, label, body, url = F.col("_name"), F.col("_label"), F.col("_body"), F.col("_url")
    pdf = F.col("_low").endswith(".pdf") | F.lower(name).endswith(".pdf") | (
        url.rlike(rules.GUID) & ~F.col("_low").rlike(rules.PAGE_END))

    def in_text(pattern: str) -> Column:
        return v.found(F.col("_text"), F.col("_low_text"), F.col("_odd"), pattern, pack.parts.get(pattern))

    def in_body(text: Column, pattern: str, chars: int | None = None) -> Column:
        """Match in a text that is the body, its opening of so many characters or empty."""
        parts = pack.parts.get(pattern)
        hit = v.found(text, opening(F.col("_low_body"), chars), F.col("_odd"), pattern, parts)
        return (text != "") & hit if parts else hit

    shape = reduce(lambda a, c: a + c, [in_text(p).cast("int") for p in pack.shapes.values()])
    staged = parts.withColumns({
        "_pdf": pdf, "_shape": shape,
        "_n_amp": name.rlike(pack.amp), "_n_alp": name.rlike(pack.alp) & ~F.lower(name).contains("narrative"),
        "_n_chapter": name.rlike(pack.chapter), "_diagram": label.rlike(rules.DIAGRAM),
    }).withColumns({
        "_html": ~F.col("_pdf") & (url != ""),
        "_planned": (F.col("_n_amp") & ~F.col("_n_chapter")) | F.col("_n_chapter") | F.col("_n_alp") | F.col("_diagram") | (F.col("_shape") >= 3),
    }).withColumns({
        "_source": F.when(F.col("_html"), "").otherwise(body),
        "_hrefs": F.when(F.col("_html") & F.contains("_low_body", F.lit("href=")), F.regexp_extract_all(body, F.lit(rules.PDF_HREF), F.lit(1))).otherwise(F.array().cast("array<string>")),
    }).withColumns({
        "_first": opening(F.when(F.col("_source") != "", F.col("_source")).otherwise(F.when(F.col("_html"), body).otherwise("")), first_page),
        "_surface": F.concat_ws(" ", label, url, name),
        "_label_name": F.concat_ws(" ", label, name),
    })
    source, html, planned = F.col("_source"), F.col("_html"), F.col("_planned")
    path, low, host, lid, tokens = F.col("_path"), F.col("_low"), F.col("_host"), F.col("_lid"), F.col("_tokens")

    def off_plan(pattern: str, other: Column) -> Column:
        return ~planned & F.when(source != "", in_body(source, pattern)).otherwise(other.rlike(pattern))

    def capped(n: Column, cap: int) -> Column:
        return F.least(n, F.lit(cap))

    others = F.regexp_extract_all(path, F.lit(rules.OTHER_KEY), F.lit(1))
    strange = F.exists(others, lambda t: (F.upper(t) != F.upper(lid)) & ~F.lower(t).isin(*rules.PATH_STOP) & ~t.rlike(r"^\d+$"))
    hrefs = F.col("_hrefs")
    found = {
        "lid_in_url": _has(url, lid), "lid_in_text": (lid != "") & F.contains("_low_text", F.lower(lid)),
        "lid_in_filename": _has(name, lid), "lid_in_label": _has(label, lid),
        "name_in_text": _names(F.col("_blob"), F.col("_low_blob"), F.col("_airport")),
        "name_in_filename": token_hits(tokens, name) >= 1,
        "name_token_host": capped(token_hits(tokens, host), 3),
        "name_token_host_strong": capped(token_hits(F.filter(tokens, lambda t: F.length(t) >= 6), host), 3),
        "name_token_path": capped(token_hits(tokens, low), 3),
        "other_lid_in_url": strange,
        "host_gov": host.endswith(".gov") | host.endswith(".mil"),
        "host_encyclopedia": from_encyclopedia("_url"),
        "ssi_name": F.concat_ws(" ", name, url).rlike(web_rules.SENSITIVE),
        "news_path": name.rlike(web_rules.NEWS) | path.rlike(web_rules.NEWS),
        "filename_amp": F.col("_n_amp") & ~F.col("_n_chapter"),
        "filename_alp": F.col("_n_alp"),
        "filename_ea": name.rlike(pack.ea) | path.rlike(pack.ea),
        "filename_chapter": F.col("_n_chapter"),
        "filename_abstract": name.rlike(rules.ABSTRACT) | url.rlike(rules.GUID) | name.rlike(rules.GUID),
        "filename_pfc": name.rlike(rules.PFC_NAME),
        "path_master_plan": low.contains("master") & low.contains("plan"),
        "path_projects": low.contains("/projects/"),
        "path_environmental": low.contains("environmental"),
        "label_minutes": label.rlike(rules.MINUTES), "label_notice": label.rlike(rules.NOTICE),
        "label_diagram": F.col("_diagram"), "label_economic_impact": label.rlike(pack.econ),
        "label_amp": label.rlike(pack.amp) & ~label.rlike(pack.chapter),
        "label_alp": label.rlike(pack.alp), "label_chapter": label.rlike(pack.chapter),
        "label_appendix": label.rlike(pack.appendix) | name.rlike(pack.appendix),
        "label_statewide": F.col("_label_name").rlike(pack.statewide),
        "text_amp": in_text(pack.amp), "first_page_amp": in_body(F.col("_first"), pack.amp, first_page),
        "packet_not_plan": F.col("_surface").rlike(pack.not_plan),
        "body_nepa": ~planned & in_body(source, pack.ea),
        "body_economic_impact": off_plan(pack.econ, label),
        "body_budget": off_plan(pack.budget, F.col("_surface")),
        "body_pavement": off_plan(pack.pave, F.col("_surface")),
        "body_statewide": F.when(source != "", in_body(
            opening(F.col("_first"), first_lines), pack.statewide, min((n for n in (first_page, first_lines) if n is not None), default=None))).otherwise(
            F.col("_label_name").rlike(pack.statewide)),
        "shape_count": F.col("_shape"), "outline_n": capped(F.col("_outline_n"), 8),
        "body_short": F.col("_pdf") & (F.length(source) < rules.SHORT_BODY),
        "body_long": F.length(source) >= rules.LONG_BODY,
        "scanned_pdf": F.col("_pdf") & (F.col("_bytes") > rules.SCANNED_BYTES) & (F.length(source) < rules.SCANNED_BODY),
        "media_pdf": F.col("_pdf"), "media_html": html,
        "sharepoint": F.lower(url).contains("sharepoint") | low.contains("lists/"),
        "html_pdf_links": capped(F.size(hrefs), 8),
        "html_amp_links": capped(F.size(F.filter(hrefs, lambda h: h.rlike(pack.amp))), 4),
        "html_alp_links": capped(F.size(F.filter(hrefs, lambda h: h.rlike(pack.alp))), 4),
        "html_plan_hrefs": F.array_join(hrefs, " ").rlike(pack.amp) | F.array_join(hrefs, " ").rlike(pack.alp),
    }
    return staged.select(*keep, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{n}") for n, c in found.items()])


FEATURES = (
    "lid_in_url", "lid_in_text", "lid_in_filename", "lid_in_label", "name_in_text", "name_in_filename",
    "name_token_host", "name_token_host_strong", "name_token_path", "other_lid_in_url", "host_gov",
    "host_encyclopedia", "ssi_name", "news_path", "filename_amp", "filename_alp", "filename_ea",
    "filename_chapter", "filename_abstract", "filename_pfc", "path_master_plan", "path_projects",
    "path_environmental", "label_minutes", "label_notice", "label_diagram", "label_economic_impact",
    "label_amp", "label_alp", "label_chapter", "label_appendix", "label_statewide", "text_amp",
    "first_page_amp", "packet_not_plan", "body_nepa", "body_economic_impact", "body_budget",
    "body_pavement", "body_statewide", "shape_count", "outline_n", "body_short", "body_long",
    "scanned_pdf", "media_pdf", "media_html", "sharepoint", "html_pdf_links", "html_amp_links",
    "html_alp_links", "html_plan_hrefs",
)


def on(name: str) -> Column:
    return F.col(f"f_{name}") != 0


def weighted(weights: dict[str, float]) -> Column:
    terms = [F.col(f"f_{n}") * F.lit(w) for n, w in weights.items()]
    return reduce(lambda a, t: a + t, terms)


def same_entity() -> Column:
    known = v.any_of(*[on(n) for n in ("lid_in_url", "lid_in_text", "lid_in_filename", "lid_in_label")])
    placed = on("lid_in_url") | on("lid_in_filename")
    host, path = F.col("f_name_token_host"), F.col("f_name_token_path")
    named = (
        known | on("name_in_text") | on("name_in_filename") | (host >= 2) | on("name_token_host_strong")
        | ((host >= 1) & (path >= 1)) | (path >= 2))
    return (
        F.when(on("other_lid_in_url") & ~known, F.lit(False))
        .when(on("label_statewide") | on("body_statewide"), placed)
        .when(on("filename_pfc") & ~placed, F.lit(False)).otherwise(named))


def with_scores(df: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Add confirm, explore, publish and per-kind scores."""
    return df.withColumns({
        "confirm_score": weighted(config.confirm), "explore_score": weighted(config.explore),
        "publish_score": weighted(config.publish), **{f"kind_{k}": weighted(w) for k, w in config.kinds.items()}})


def kind_decision(floor: Column) -> Column:
    """Kind of a packet: pages first, then forced kinds, then the best score."""
    def score(k: str) -> Column:
        return F.col(f"kind_{k}")

    no, notice = score("not_plan"), score("notice")
    page = (
        F.when((no >= floor) & (no >= notice), "not_plan").when(notice >= floor, "notice").otherwise("hub"))
    alp = on("filename_alp") | on("label_diagram") | on("label_alp")
    chapter = on("filename_chapter") | on("label_chapter")
    plan = v.any_of(*[on(n) for n in ("filename_amp", "label_amp", "path_master_plan", "text_amp")])
    ranked = [k for k in rules.KINDS if k != "hub"]
    best = F.array_max(F.array(*[
        F.struct(score(k).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(ranked)]))
    low = (
        F.when(v.any_of(*[on(n) for n in ("filename_ea", "packet_not_plan", "filename_abstract")]), "not_plan")
        .when(chapter, "chapter").when(alp, "alp").when(plan, "master_plan").otherwise("not_plan"))
    return (
        F.when(on("media_html"), page)
        .when(v.any_of(*[on(n) for n in ("filename_pfc", "filename_ea", "label_economic_impact", "label_statewide")]), "not_plan")
        .when(alp & (no < score("alp") + 2), "alp")
        .when(chapter & ~on("filename_ea") & ~on("filename_alp") & (score("chapter") >= no), "chapter")
        .when(best["s"] < floor, low).otherwise(best["k"]))


def with_decisions(scored: DataFrame, thresholds: dict[str, Column]) -> DataFrame:
    """Add same_airport, kind, confirm, explore and publish to scored features."""
    staged = scored.withColumn("same_airport", same_entity()).withColumn("kind", kind_decision(thresholds["kind"]))
    plan = F.col("kind").isin("master_plan", "alp", "chapter") & on("media_pdf") & ~on("ssi_name") & F.col("same_airport")
    flagged = staged.withColumn("confirm", plan & (F.col("confirm_score") >= thresholds["confirm"])).withColumn(
        "publish", plan & (F.col("publish_score") >= thresholds["publish"]))
    explore = (
        F.col("same_airport") & (F.col("explore_score") >= thresholds["explore"]) & ~on("ssi_name")
        & ~F.col("confirm") & on("media_html") & ~F.col("kind").isin("not_plan", "notice"))
    return flagged.withColumn("explore", explore)


def score(packets: DataFrame, pack: EvidenceRules = EvidenceRules(), config: ScoreConfig = ScoreConfig(),
          keep: Sequence[str] = ("id",)) -> DataFrame:
    """Packets to features, scores and decisions."""
    limits = {k: F.lit(t) for k, t in config.thresholds.items()}
    return with_decisions(with_scores(features(packets, pack, keep), config), limits)


# --- variants -------------------------------------------------------------------------

def ablation_variants(config: ScoreConfig = ScoreConfig()) -> list[dict]:
    """One variant per feature: the feature's weights all taken out."""
    tables = {"confirm_score": config.confirm, "explore_score": config.explore, "publish_score": config.publish,
              **{f"kind_{k}": w for k, w in config.kinds.items()}}
    return [
        {"variant": f"without {n}", "feature": n, "deltas": {t: -w[n] for t, w in tables.items() if n in w}}
        for n in FEATURES]


def variant_scores(scored: DataFrame, variants: Sequence[dict], config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Decisions of every packet under every variant.

    A variant shifts the weights of one feature, or a threshold. Scores are linear,
    so a shift is one product per score: features are never computed again and no
    join is needed; each packet row meets the fixed list of variants in place.
    """
    targets = ["confirm_score", "explore_score", "publish_score", *[f"kind_{k}" for k in config.kinds]]
    limits = list(config.thresholds)
    rows = [F.struct(
        F.lit(x["variant"]).alias("variant"), F.lit(x.get("feature") or "").alias("feature"),
        *[F.lit(float(x.get("deltas", {}).get(t, 0.0))).alias(f"d_{t}") for t in targets],
        *[F.lit(float(x.get("thresholds", {}).get(k, config.thresholds[k]))).alias(f"t_{k}") for k in limits]) for x in variants]
    named = F.map_from_arrays(F.array(*[F.lit(n) for n in FEATURES]), F.array(*[F.col(f"f_{n}") for n in FEATURES]))
    spread = scored.withColumn("_values", named).withColumn("_v", F.explode(F.array(*rows)))
    value = F.coalesce(F.try_element_at("_values", F.col("_v.feature")), F.lit(0.0))
    staged = spread.withColumn("_value", value)
    shifted = staged.withColumns({t: F.col(t) + F.col("_value") * F.col(f"_v.d_{t}") for t in targets})
    out = with_decisions(shifted, {k: F.col(f"_v.t_{k}") for k in limits})
    return out.withColumn("variant", F.col("_v.variant")).drop("_values", "_value", "_v")
