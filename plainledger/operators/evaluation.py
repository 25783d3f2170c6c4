"""Evaluation against labels, gated model answers, and labelled-case sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainledger.functions import urls
from plainledger.functions import values as v
from plainledger.operators.registry import first_row
from plainledger.operators.web import json_object
from plainledger.rules import evidence as evidence_rules
from plainledger.rules import ops as ops_rules
from plainledger.rules import web as web_rules

# Allowed answers of the recorded evaluations.
HIT_TYPES = ("artifact", "hub_page", "both", "notice", "not_plan")
HIT_KINDS = ("master_plan", "alp", "chapter", "unknown")
FETCH = ("yes", "no", "needs_human")
PLAN_KINDS = ("master_plan", "alp", "notice", "not_plan", "other")
FINANCE_KINDS = (
    "issued_grants", "program_budget", "project_list", "cip_proposed", "pfc", "bond", "other", "not_finance",
)
FINANCE_SCOPES = ("airport", "state", "national")
LINE_KINDS = ("program", "fund", "project", "airport_allocation")
HINT_WORDS = r"(?iu)master plan|\bAMP\b|\bALP\b|airport layout|airport diagram|\bchapter\b"
HINT_BAD = r"(?iu)https?://|\.pdf\b|wikipedia\.org"
HINT_CHARS = 160
HINT_LIMIT = 2
REASON_CHARS = 120


@dataclass(frozen=True)
class Evaluation:
    """A named task: its labels and how rows become predictions."""

    name: str
    labels: tuple[str, ...]
    predict: Callable[[DataFrame], DataFrame]


# --- labels -------------------------------------------------------------------------

def against_gold(predicted: DataFrame, gold: DataFrame, key: str, fields: Sequence[str],
                 keep: Sequence[str] = ()) -> DataFrame:
    """Predictions next to labels with the list of failing fields.

    A field whose label is null is not judged.
    """
    want = gold.select(key, *[F.col(f).alias(f"gold_{f}") for f in fields])
    return judged(predicted.select(key, *keep, *fields).join(want, key), fields)


def judged(joined: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows that hold predictions and their labels, named `gold_...`, with the failing fields."""
    fails = F.array_compact(F.array(*[
        F.when(F.col(f"gold_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"gold_{f}")), f) for f in fields]))
    return joined.withColumn("fail", fails).withColumn("ok", F.size("fail") == 0)


def accuracy(judged: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Case accuracy, field accuracy and hits per field."""
    hits = [F.count_if(~F.array_contains("fail", f)).alias(f"hits_{f}") for f in fields]
    out = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), *hits)
    right = F.lit(0)
    for f in fields:
        right = right + F.col(f"hits_{f}")
    return out.withColumn("case_accuracy", F.col("n_ok") / F.greatest("n", F.lit(1))).withColumn(
        "field_accuracy", right / F.greatest(F.col("n") * len(fields), F.lit(1)))


def confusion(judged: DataFrame, field: str, keys: Sequence[str] = ()) -> DataFrame:
    return judged.groupBy(*keys, F.col(f"gold_{field}").alias("gold"), F.col(field).alias("got")).agg(
        F.count(F.lit(1)).alias("n"))


def run_evaluation(task: Evaluation, rows: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Judge one registered task; labels outside its set count as misses."""
    predicted = task.predict(rows)
    known = predicted.withColumn("label", F.when(F.col("label").isin(*task.labels), F.col("label")))
    return against_gold(known, gold, key, ["label"])


def bare_url(url: Column | str) -> Column:
    return F.rtrim(F.coalesce(v.col(url), F.lit("")), F.lit("/"))


def merge_cases(groups: Sequence[DataFrame], seq: str) -> DataFrame:
    """Cases of several groups, the first of a URL wins; earlier groups come first."""
    out = None
    for i, group in enumerate(groups):
        tagged = group.withColumn("_order", F.struct(F.lit(i).alias("g"), F.col(seq).alias("s")))
        out = tagged if out is None else out.unionByName(tagged)
    named = out.withColumn("_bare", bare_url("url")).filter("_bare <> ''")
    return first_row(named, ["_bare"], F.col("_order")).drop("_bare", "_order")


def novel_cases(cases: DataFrame, known: DataFrame) -> DataFrame:
    seen = known.select(bare_url("url").alias("_bare"))
    return cases.withColumn("_bare", bare_url("url")).filter("_bare <> ''").join(seen, "_bare", "left_anti").drop("_bare")


def gold_export(outcomes: DataFrame) -> DataFrame:
    """Labelled outcomes fit to become cases: a real http URL, no example address."""
    return outcomes.filter(F.col("gold").isNotNull() & F.col("url").startswith("http") & ~urls.is_example("url"))


def training_cases(rejects: DataFrame) -> DataFrame:
    """Stored rejects of a known reason as negative labelled cases."""
    fit = F.col("reason").isin(*ops_rules.TRAIN_REASONS) & F.col("url").startswith("http") & v.yes(F.col("stored"))
    return rejects.filter(fit).select(
        F.concat(F.lit("reject-"), F.substring("sha256", 1, 12)).alias("id"), "lid", "state", "url",
        F.coalesce(v.first_text("label"), urls.file_name("url")).alias("label"),
        F.struct(F.lit(True).alias("same_airport"), F.lit("not_plan").alias("kind"), F.lit(False).alias("confirm"),
                 F.lit(False).alias("explore"), F.lit(False).alias("publish")).alias("gold"),
        F.col("reason").alias("reject_reason"), F.col("sha256").alias("reject_sha256"))


def candidate_recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of labelled URLs found, per entity."""
    hit = gold.select("entity", "url").distinct().join(
        found.select("entity", "url").distinct().withColumn("_hit", F.lit(1)), ["entity", "url"], "left")
    return hit.groupBy("entity").agg(F.count(F.lit(1)).alias("n_gold"), F.count("_hit").alias("n_found")).withColumn(
        "recall", F.col("n_found") / F.col("n_gold"))


def hint_verdicts(cases: DataFrame) -> DataFrame:
    """Verdict on proposed queries per case.

    Cases: id, queries, forbid_http, allow_hosts, must_include, must_include_any (arrays).
    """
    site = F.lit(r"(?i)\bsite:([a-z0-9.-]+)")
    queries = F.col("queries")
    hosts = F.flatten(F.transform(queries, lambda q: F.regexp_extract_all(q, site, F.lit(1))))
    named = F.transform(hosts, lambda h: F.regexp_replace(F.lower(h), r"^www\.", ""))
    allow = F.transform("allow_hosts", F.lower)
    outside = F.exists(named, lambda h: ~F.exists(allow, lambda a: (h == a) | F.endswith(h, F.concat(F.lit("."), a))))
    linked = F.exists(queries, lambda q: q.contains("http://") | q.contains("https://"))

    def fits(q: Column) -> Column:
        every = F.forall("must_include", lambda t: F.contains(F.lower(q), F.lower(t)))
        some = (F.size("must_include_any") == 0) | F.exists("must_include_any", lambda t: F.contains(F.lower(q), F.lower(t)))
        return every & some

    verdict = (
        F.when(v.yes(F.col("forbid_http")) & linked, "http_url").when((F.size(allow) > 0) & outside, "off_host")
        .when(F.exists(queries, fits), "ok").otherwise("no_matching_query"))
    return cases.withColumn("verdict", verdict)


# --- gated answers -------------------------------------------------------------------

ANSWER = "same_airport boolean, hit_type string, kind_guess string, fetch string, artifact_urls array<string>, page_urls array<string>, reason string"


def answer(raw: Column | str, schema: str) -> Column:
    """Struct of a noisy JSON answer; null when there is no readable object."""
    parsed = F.from_json(json_object(raw), f"{schema}, _malformed string", {"columnNameOfCorruptRecord": "_malformed"})
    return F.when(parsed["_malformed"].isNull(), parsed)


def one_of(value: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(v.yes(value.isin(*allowed)), value).otherwise(F.lit(default))


def gated_hits(packets: DataFrame) -> DataFrame:
    """Recorded answers about search packets, held to rules the answer cannot override.

    Packets: id, lid, name, artifact_url, page_url, prose, answer (raw text). URLs must
    come from the packet; sensitive, empty, foreign and non-plan packets are refused;
    a plan-like packet of the right entity is fetched even when the answer says no.
    """
    seeds = ["artifact_url", "page_url"]
    listed = packets.withColumn("_listed", urls.prose_urls("prose", seeds=seeds)).withColumn(
        "_prose", F.coalesce("prose", F.lit("")))
    staged = listed.withColumn("_allowed", urls.trusted_urls(F.col("_listed"), seeds)).withColumn(
        "_a", answer("answer", ANSWER))
    none = F.array().cast("array<string>")
    allowed = F.col("_allowed")

    def packet_urls(field: str) -> Column:
        return F.filter(F.coalesce(F.col(f"_a.{field}"), none), lambda u: F.array_contains(allowed, u))

    everything = F.concat_ws(" ", "_prose", F.array_join(allowed, " "))
    off_plan = everything.rlike(evidence_rules.NOT_PLAN) | F.exists(allowed, lambda u: urls.host(u).contains("wikipedia.org"))
    mentioned = F.contains(F.lower(everything), F.lower("lid")) | (
        (F.trim("name") != "") & F.contains(F.lower(everything), F.lower(F.trim("name"))))
    read = staged.withColumns({
        "_bad": F.col("_a").isNull(),
        "_same": F.coalesce(F.col("_a.same_airport"), F.lit(False)),
        "_type": one_of(F.col("_a.hit_type"), HIT_TYPES, "not_plan"),
        "_kind": one_of(F.col("_a.kind_guess"), HIT_KINDS, "unknown"),
        "_fetch": one_of(F.col("_a.fetch"), FETCH, "no"),
        "_artifacts": packet_urls("artifact_urls"), "_pages": packet_urls("page_urls"),
        "_pdfs": F.filter(allowed, urls.looks_like_pdf), "_off": off_plan, "_named": mentioned,
        "_secret": F.exists(allowed, lambda u: u.rlike(web_rules.SENSITIVE)) | ((F.size(allowed) > 0) & F.col("_prose").rlike(web_rules.SENSITIVE)),
        "_has_page": F.array_contains(allowed, F.coalesce("page_url", F.lit(""))),
    })
    has_pdf, same = F.size("_pdfs") > 0, F.col("_same")
    rule = (
        F.when(F.col("_secret") | (F.size(allowed) == 0), "human").when(~same, "foreign").when(F.col("_off"), "off")
        .when((F.col("_type") == "notice") & ~has_pdf, "notice")
        .when((F.col("_fetch") == "no") & F.col("_type").isin("artifact", "hub_page", "both") & (F.col("_has_page") | has_pdf), "upgrade")
        .otherwise("as said"))
    ruled = read.withColumn("_rule", F.when(F.col("_bad"), "bad").otherwise(rule)).withColumns({
        "_want": F.when(F.col("_rule").isin("bad", "human"), "needs_human").when(F.col("_rule").isin("foreign", "off", "notice"), "no")
        .when(F.col("_rule") == "upgrade", "yes").otherwise(F.col("_fetch")),
        "_type": F.when(F.col("_rule").isin("off", "bad"), "not_plan").otherwise(F.col("_type")),
        "_kind": F.when(F.col("_rule").isin("off", "bad"), "unknown").otherwise(F.col("_kind")),
        "_same": F.when(F.col("_rule") == "bad", False).when(F.col("_rule") == "off", same & F.col("_named")).otherwise(same),
    })
    lead = F.array_contains("_pdfs", F.coalesce("artifact_url", F.lit("")))
    artifacts = F.array_distinct(F.concat(
        F.when(lead & ~F.array_contains("_artifacts", F.col("artifact_url")), F.array("artifact_url")).otherwise(none),
        F.col("_artifacts"), F.col("_pdfs")))
    page_here = F.col("_has_page") & ~urls.looks_like_pdf("page_url")
    pages = F.array_distinct(F.concat(
        F.when(page_here & ~F.array_contains("_pages", F.col("page_url")), F.array("page_url")).otherwise(none), F.col("_pages")))
    listed_urls = ruled.withColumn("_arts", artifacts).withColumn("_pgs", pages)
    empty = (F.size("_arts") == 0) & (F.size("_pgs") == 0)
    # With neither named, every packet URL that is no file counts as a page.
    final = listed_urls.withColumn("_pgs", F.when(empty, F.filter("_allowed", lambda u: ~urls.looks_like_pdf(u))).otherwise(F.col("_pgs")))
    go = (F.col("_want") == "yes") & ((F.size("_arts") > 0) | (F.size("_pgs") > 0))
    fetch = F.when((F.col("_want") == "yes") & ~go, "no").otherwise(F.col("_want"))
    hub = go & (F.col("_type") == "not_plan") & page_here & (F.size("_pdfs") == 0)
    return final.select(
        "id", F.col("_same").alias("same_airport"), F.when(hub, "hub_page").otherwise(F.col("_type")).alias("hit_type"),
        F.col("_kind").alias("kind_guess"), fetch.alias("fetch"),
        F.when(go, F.col("_arts")).otherwise(none).alias("artifact_urls"),
        F.when(go, F.col("_pgs")).otherwise(none).alias("page_urls"),
        F.when(F.col("_bad"), "model JSON missing").otherwise(F.coalesce(F.col("_a.reason"), F.lit(""))).alias("reason"))


def hit_verdicts(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Verdict per packet: first rule of the label that a decision breaks, else ok.

    Gold: id, same_airport, fetch, artifact_urls, page_urls, forbid_urls, packet (arrays).
    """
    want = gold.select("id", *[F.col(c).alias(f"g_{c}") for c in ("same_airport", "fetch", "artifact_urls", "page_urls", "forbid_urls", "packet")])
    named = F.concat("artifact_urls", "page_urls")
    verdict = (
        F.when(F.col("same_airport") != F.col("g_same_airport"), "same_airport")
        .when(F.col("fetch") != F.col("g_fetch"), "fetch")
        .when(F.size(F.array_except(named, F.col("g_packet"))) > 0, "invented_url")
        .when(F.arrays_overlap(named, "g_forbid_urls"), "forbid_url")
        .when((F.col("g_fetch") == "yes") & (F.size(F.array_except("g_artifact_urls", "artifact_urls")) > 0), "missing_artifact")
        .when((F.col("g_fetch") == "yes") & (F.size(F.array_except("g_page_urls", "page_urls")) > 0), "missing_page")
        .when((F.col("g_fetch") == "no") & (F.size("artifact_urls") > 0), "enqueue_on_no").otherwise("ok"))
    return predicted.join(want, "id").select("id", verdict.alias("verdict"))


PLAN_ANSWER = "official_plan boolean, kind string, same_airport boolean, publisher string, published_at string, pdf_urls array<string>, new_edition boolean, reason string"
FINANCE_ANSWER = "official_finance boolean, finance_kind string, scope string, same_entity boolean, publisher string, published_at string, pdf_urls array<string>, has_locid_rows boolean, reason string"


def _http_only(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda u: u.startswith("http"))


def verified_plans(rows: DataFrame) -> DataFrame:
    """Recorded verdicts on fetched plans: whitelisted kind, http links only."""
    a = rows.withColumn("_a", answer("answer", PLAN_ANSWER))
    return a.filter("_a is not null").select(
        "id", F.coalesce("_a.official_plan", F.lit(False)).alias("official_plan"), one_of(F.col("_a.kind"), PLAN_KINDS, "other").alias("kind"),
        F.coalesce("_a.same_airport", F.lit(False)).alias("same_airport"), "_a.publisher", "_a.published_at",
        _http_only(F.col("_a.pdf_urls")).alias("pdf_urls"), F.coalesce("_a.new_edition", F.lit(False)).alias("new_edition"),
        F.coalesce("_a.reason", F.lit("")).alias("reason"))


def verified_finance(rows: DataFrame) -> DataFrame:
    a = rows.withColumn("_a", answer("answer", FINANCE_ANSWER))
    return a.filter("_a is not null").select(
        "id", F.coalesce("_a.official_finance", F.lit(False)).alias("official_finance"),
        one_of(F.col("_a.finance_kind"), FINANCE_KINDS, "other").alias("finance_kind"), one_of(F.col("_a.scope"), FINANCE_SCOPES, "airport").alias("scope"),
        F.coalesce("_a.same_entity", F.lit(False)).alias("same_entity"), _http_only(F.col("_a.pdf_urls")).alias("pdf_urls"),
        F.coalesce("_a.has_locid_rows", F.lit(False)).alias("has_locid_rows"), F.coalesce("_a.reason", F.lit("")).alias("reason"))


def gated_hints(sessions: DataFrame) -> DataFrame:
    """Proposed next queries that pass every rule, at most two per session.

    Sessions: id, lid, packet_text, allowed_hosts (array), ran (array), answer. Each
    proposal must name the entity and a plan word, hold no URL, stay short, and keep
    to hosts and years the packet has shown; the entity's own name is no year.
    """
    parsed = answer("answer", "queries array<struct<query: string, why: string>>")
    rows = sessions.select("id", "lid", "packet_text", "allowed_hosts", "ran", F.posexplode(parsed["queries"]).alias("pos", "q"))
    query = F.trim(F.regexp_replace(F.coalesce("q.query", F.lit("")), r"\s+", " "))
    clean = rows.withColumn("query", query)
    q = F.col("query")
    hosts = F.transform(F.regexp_extract_all(q, F.lit(r"(?i)\bsite:([a-z0-9.-]+)"), F.lit(1)), lambda h: F.regexp_replace(F.lower(h), r"^www\.", ""))
    allowed = F.col("allowed_hosts")

    def known(h: Column) -> Column:
        under = F.exists(allowed, lambda a: (h == a) | F.endswith(h, F.concat(F.lit("."), a)) | F.endswith(a, F.concat(F.lit("."), h)))
        return ~h.isin("gov", "com", "org", "net", "us", "") & under

    named = F.regexp_extract_all(q, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    # An entity that is called like a year is named once before the rest counts as years.
    years = F.filter(named, lambda y, i: i + 1 != F.array_position(named, F.col("lid")))
    seen = (F.coalesce("packet_text", F.lit("")) == "") | F.forall(years, lambda y: F.contains(F.col("packet_text"), y))
    ok = v.all_of(
        q != "", ~F.array_contains("ran", q), F.contains(F.lower(q), F.lower("lid")), ~q.rlike(HINT_BAD),
        ~q.rlike(web_rules.SENSITIVE), q.rlike(HINT_WORDS), F.length(q) <= HINT_CHARS, F.forall(hosts, known), seen)
    once = first_row(clean.filter(ok).select("id", "query", "pos", F.substring(F.coalesce("q.why", F.lit("")), 1, 80).alias("why")), ["id", "query"], F.col("pos"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return once.withColumn("rank", place).filter(F.col("rank") <= HINT_LIMIT).drop("pos")


def hybrid_labels(rows: DataFrame, answers: DataFrame, overrides: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Label with its source: a person's, else a kept one, else a gated answer, else the rule.

    Rows: id, input_hash, stored_label, stored_hash, stored_by, rule, review (whether
    the rule is weak). Answers: input_hash, answer. Overrides: id, label, reason. A
    stored label is kept while the input hash is equal and a model or person gave it.
    """
    said = answers.groupBy("input_hash").agg(F.max("answer").alias("answer")).select("input_hash", answer("answer", "label string, reason string").alias("_a"))
    forced = overrides.groupBy("id").agg(F.max(F.struct("label", "reason")).alias("_o")).select(
        "id", F.col("_o.label").alias("_forced"), F.col("_o.reason").alias("_why"))
    joined = rows.join(said, "input_hash", "left").join(forced, "id", "left")
    kept = v.yes((F.col("stored_hash") == F.col("input_hash")) & F.col("stored_by").isin("llm", "human")) & v.first_text("stored_label").isNotNull()
    asked = F.col("review") & F.col("_a").isNotNull()
    low = F.lower(F.trim(F.col("_a.label")))
    given = F.when(v.yes(low.isin(*labels)), low).otherwise(F.col("rule"))
    by = F.when(F.col("_forced").isNotNull(), "human").when(kept, F.col("stored_by")).when(asked, "llm").otherwise("rules")
    label = F.when(F.col("_forced").isNotNull(), F.col("_forced")).when(kept, F.col("stored_label")).when(asked, given).otherwise(F.col("rule"))
    why = F.when(F.col("_forced").isNotNull(), F.col("_why")).when(~kept & asked, F.substring(F.coalesce("_a.reason", F.lit("")), 1, REASON_CHARS)).otherwise("")
    return joined.select("id", "input_hash", label.alias("label"), by.alias("labelled_by"), F.coalesce(why, F.lit("")).alias("reason"))


def label_audit(labelled: DataFrame, evaluation: str, at: Column) -> DataFrame:
    """Audit rows of labels that a model or a person gave."""
    return labelled.filter(F.col("labelled_by") != "rules").select(
        at.alias("at"), F.lit(evaluation).alias("evaluation"), F.col("id").alias("input_id"),
        F.col("label").alias("category"), F.col("labelled_by").alias("classifier"), F.substring("reason", 1, 200).alias("reason"))
