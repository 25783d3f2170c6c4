"""Evidence, evaluation and gated-answer queries over texts, events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plainledger.operators import evaluation as ev
from plainledger.operators import evidence as ops
from plainledger.operators import funding
from plainledger.plans import bindings as b
from plainledger.plans import funding as funding_plans
from plainledger.plans.bindings import DOCS_SQL, GRANTS_SQL
from plainledger.plans.funding import HASH
from plainledger.rules import evidence as rules
from plainledger.rules import web as web_rules
from plainledger.rules.evidence import EvidenceRules
from plainledger.rules.funding import CATEGORIES

# The prose holds the short words of the pattern by chance, so they are left out.
EA = r"(?i)environmental assessment|\bNEPA\b"
PACK = EvidenceRules(ea=EA, parts={**rules.PARTS, EA: (("environmental assessment", None), ("nepa", r"(?i)\bNEPA\b"))})


def packets(spark, sf):
    """Texts as URL packets; address, label and closing sentence follow from the row."""
    rows = b.wide(b.table(spark, sf, "documents"), "doc_id")
    lang, n = F.col("lang"), F.col("n_chars")
    url = (
        F.when(lang == "en", F.concat(F.lit("https://www.harbor.gov/"), "source", F.lit("/projects/final_master_plan_"), "doc_id", F.lit(".pdf")))
        .when(lang == "fr", F.concat(F.lit("https://lists.example.org/docs/"), "doc_id", F.lit("/alp_sheet.pdf")))
        .when(lang == "de", F.concat(F.lit("https://"), "source", F.lit(".example.org/abcd/"), F.when(n > 900, "news").otherwise("hub"), F.lit("/"), "doc_id"))
        .otherwise(F.concat(F.lit("https://sharepoint.example.gov/x/environmental/chapter-"), "doc_id", F.lit(".pdf"))))
    label = (
        F.when(n < 500, "Airport Master Plan").when(n < 700, "Chapter 3 Inventory").when(n < 900, "Meeting minutes")
        .when(n < 1100, "Airport diagram").when(n < 1500, "Economic impact").when(n < 2500, F.concat(F.lit("ALP "), "source"))
        .when(n < 3500, "State aviation system plan").otherwise("Appendix A"))
    tail = (
        F.when(n > 3000, " The airport master plan with inventory, forecast, alternatives and implementation.")
        .when(n > 1000, " An environmental assessment under way.").when(n > 600, " Pavement condition and PFC.").otherwise(""))
    links = F.when(lang == "de", " <a href='files/amp.pdf?x'>a</a> <a href=\"/x/alp.PDF\">b</a>").otherwise("")
    return rows.select(
        F.col("doc_id").alias("id"), F.col("source").alias("lid"), F.concat(F.lit("Harbor "), "source").alias("name"),
        url.alias("url"), label.alias("label"), F.concat("text", tail, links).alias("body"),
        F.when(n > 2000, F.array(F.lit("Inventory"), F.lit("Forecasts"))).otherwise(F.array().cast("array<string>")).alias("outline"),
        (n * 3000).alias("source_bytes"))


def gold(spark, sf):
    """Labels of the texts as gold: toxic ones are no plans, the rest publish."""
    rows = b.table(spark, sf, "labels")
    good = F.col("quality") == 1
    return rows.select(
        F.col("doc_id").alias("id"), good.alias("same_airport"), F.when(good, "alp").otherwise("not_plan").alias("kind"),
        (F.col("toxic") == 0).alias("confirm"), F.lit(False).alias("explore"), F.when(F.col("toxic") == 0, good).alias("publish"))


def evidence_features(spark, sf):
    return ops.features(packets(spark, sf), PACK)


def evidence_scores(spark, sf):
    out = ops.score(packets(spark, sf), PACK)
    return out.select("id", "same_airport", "kind", "confirm", "explore", "publish",
                      *[F.round(c, 6).alias(c) for c in ("confirm_score", "explore_score", "publish_score")])


def _judged(spark, sf):
    return ev.against_gold(ops.score(packets(spark, sf), PACK), gold(spark, sf), "id", rules.FIELDS)


def evidence_misses(spark, sf):
    return _judged(spark, sf).filter(~F.col("ok")).select("id", F.array_join("fail", ",").alias("fail"))


def evidence_accuracy(spark, sf):
    out = ev.accuracy(_judged(spark, sf), rules.FIELDS)
    return out.withColumn("case_accuracy", F.round("case_accuracy", 9)).withColumn("field_accuracy", F.round("field_accuracy", 9))


def evidence_confusion(spark, sf):
    return ev.confusion(_judged(spark, sf), "kind")


def evidence_ablation(spark, sf):
    """Accuracy of every variant that leaves one feature out, worst first."""
    # Labels meet the packets before a packet becomes one row per variant.
    labels = gold(spark, sf).select("id", *[F.col(f).alias(f"gold_{f}") for f in rules.FIELDS])
    known = packets(spark, sf).join(labels, "id")
    scored = ops.with_scores(ops.features(known, PACK, labels.columns))
    variants = ops.ablation_variants() + [{"variant": "publish 5", "thresholds": {"publish": 5.0}}, {"variant": "alp +3", "feature": "label_alp", "deltas": {"kind_alp": 3.0}}]
    judged = ev.judged(ops.variant_scores(scored, variants), rules.FIELDS)
    out = ev.accuracy(judged, rules.FIELDS, ["variant"])
    return out.select("variant", "n", "n_ok", *[f"hits_{f}" for f in rules.FIELDS]).orderBy("n_ok", "variant")


def gold_merge(spark, sf):
    """Cases of pages and of texts by address, the pages first."""
    pages = b.table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.regexp_replace("url", "[?#].*$", "").alias("url"), F.col("page_id").alias("seq"))
    again = pages.select(F.concat(F.lit("q"), F.substring("id", 2, 20)).alias("id"), F.concat("url", F.lit("/")).alias("url"), "seq")
    docs = b.documents(spark, sf).select(F.concat(F.lit("d"), "id").alias("id"), F.col("source_url").alias("url"), "seq")
    return ev.merge_cases([pages, again, docs], "seq")


def gold_novel(spark, sf):
    docs = b.documents(spark, sf).select("id", F.concat("source_url", F.lit("/")).alias("url"), "kind")
    return ev.novel_cases(docs.select("id", "url"), docs.filter("kind = 'alp'").select(F.regexp_replace("url", "/$", "").alias("url")))


def gold_from_outcomes(spark, sf):
    rows = b.table(spark, sf, "pages").select(
        "page_id", F.when(F.col("page_id") > 100, F.regexp_replace("url", r"\.example\.", ".sample.")).otherwise(F.col("url")).alias("url"),
        F.when(F.length("html") > 1500, F.struct(F.lit("hub").alias("kind"))).alias("gold"))
    return ev.gold_export(rows).select("page_id", "url")


def gold_from_rejects(spark, sf):
    rows = b.documents(spark, sf).select(
        F.col("entity").alias("lid"), F.col("region").alias("state"), F.col("source_url").alias("url"), F.col("content_sha256").alias("sha256"),
        F.when(F.col("kind") == "alp", F.col("title")).alias("label"), F.when(F.col("kind") == "notice", "timeout").otherwise("not_plan").alias("reason"),
        (F.col("n_text") > 600).alias("stored"))
    out = ev.training_cases(rows)
    return out.withColumn("gold", F.to_json("gold"))


def gold_recall(spark, sf):
    docs = b.documents(spark, sf)
    wanted = docs.select("entity", F.col("source_url").alias("url"))
    found = docs.filter("kind <> 'alp'").select("entity", F.col("source_url").alias("url"))
    return ev.candidate_recall(found, wanted).withColumn("recall", F.round("recall", 9))


def hint_verdicts(spark, sf):
    name = F.col("key").cast("string")
    rows = b.entities(spark, sf).select(
        F.col("key").alias("id"), F.array(
            F.concat(F.lit("site:www.a.gov "), name, F.lit(" master plan")),
            F.when(F.col("balance") < 0, F.concat(F.lit("see http://x "), name)).when(F.col("balance") > 8000, F.lit("site:b.com plan")).otherwise(F.lit("plain"))).alias("queries"),
        F.lit(True).alias("forbid_http"), F.array(F.lit("A.gov")).alias("allow_hosts"),
        F.array(name, F.when(F.col("balance") > 5000, "diagram").otherwise("plan")).alias("must_include"),
        F.array(F.lit("master"), F.lit("alp")).alias("must_include_any"))
    return ev.hint_verdicts(rows).select("id", "verdict")


def answers_hits(spark, sf):
    """Search packets per text with a recorded answer, some noisy, some broken."""
    return ev.gated_hits(_hit_packets(spark, sf)).select(
        "id", "same_airport", "hit_type", "kind_guess", "fetch", F.array_join("artifact_urls", " ").alias("artifact_urls"),
        F.array_join("page_urls", " ").alias("page_urls"), "reason")


def _hit_packets(spark, sf):
    docs = b.documents(spark, sf)
    n = F.col("n_text")
    answer = F.concat(
        F.lit('Sure: {"same_airport": '), F.when(n < 450, "false").otherwise("true"), F.lit(', "hit_type": "'),
        F.when(n < 900, "artifact").when(n < 1300, "notice").when(n < 1500, "nonsense").otherwise("hub_page"),
        F.lit('", "kind_guess": "alp", "fetch": "'), F.when(n < 1000, "no").otherwise("yes"),
        F.lit('", "artifact_urls": ["https://invented.example.com/a.pdf"], "page_urls": [], "reason": "because"} end'))
    return docs.select(
        "id", F.col("entity").alias("lid"), F.lit("Harbor Field").alias("name"),
        F.when(F.col("kind") != "notice", F.col("source_url")).otherwise("").alias("artifact_url"),
        F.when(n > 600, F.concat(F.lit("https://"), "region", F.lit(".example.gov/"), "entity")).otherwise("").alias("page_url"),
        F.concat(F.lit("About "), "entity", F.lit(", see https://far.example.com/x.pdf. "),
                 F.when(n < 560, "NEPA notes").when(n < 640, "SSI drawing").otherwise("")).alias("prose"),
        F.when(n < 420, F.lit("no json")).when(n < 430, F.lit("{broken")).otherwise(answer).alias("answer"))


def answers_verdicts(spark, sf):
    packets_ = _hit_packets(spark, sf)
    none = F.array().cast("array<string>")
    labels = packets_.select(
        "id", F.lit(True).alias("same_airport"), F.when(F.length("artifact_url") > 0, "yes").otherwise("no").alias("fetch"),
        F.when(F.col("artifact_url").endswith(".pdf"), F.array("artifact_url")).otherwise(none).alias("artifact_urls"), none.alias("page_urls"),
        F.when(F.col("page_url").contains("src1"), F.array("page_url")).otherwise(none).alias("forbid_urls"),
        F.array("artifact_url", "page_url").alias("packet"))
    return ev.hit_verdicts(ev.gated_hits(packets_), labels)


def answers_plans(spark, sf):
    rows = b.documents(spark, sf).select("id", F.concat(
        F.lit('```{"official_plan": true, "kind": "'), "kind", F.lit('", "same_airport": false, "pdf_urls": ["ftp://x", "'), "source_url", F.lit('"], "reason": null}```')).alias("answer"))
    return ev.verified_plans(rows).select("id", "official_plan", "kind", "same_airport", "publisher", F.array_join("pdf_urls", " ").alias("pdf_urls"), "new_edition", "reason")


def answers_finance(spark, sf):
    rows = b.documents(spark, sf).select("id", F.concat(
        F.lit('{"official_finance": true, "finance_kind": "'), F.when(F.col("kind") == "alp", "pfc").otherwise(F.col("kind")), F.lit('", "scope": "'),
        F.when(F.col("kind") == "notice", "state").otherwise("city"), F.lit('", "same_entity": true, "has_locid_rows": true}')).alias("answer"))
    return ev.verified_finance(rows).select("id", "official_finance", "finance_kind", "scope", "same_entity", F.size("pdf_urls").alias("n_urls"), "has_locid_rows")


def answers_hints(spark, sf):
    key = F.col("key").cast("string")
    answer = F.concat(
        F.lit('{"queries": [{"query": "site:a.gov  '), key, F.lit(' master plan", "why": "w"}, {"query": "'), key, F.lit(' ALP 1999"}, {"query": "'), key,
        F.lit(' ALP 2012"}, {"query": "site:evil.com '), key, F.lit(' ALP"}, {"query": "'), key, F.lit(' chapter two"}, {"query": "other ALP"}, {"query": "'),
        key, F.lit(' nothing"}]}'))
    rows = b.entities(spark, sf).select(
        F.col("key").alias("id"), key.alias("lid"), F.lit("hits from 2012").alias("packet_text"), F.array(F.lit("www.a.gov"), F.lit("a.gov")).alias("allowed_hosts"),
        F.when(F.col("balance") > 0, F.array(F.concat(key, F.lit(" ALP 2012")))).otherwise(F.array().cast("array<string>")).alias("ran"), answer.alias("answer"))
    return ev.gated_hints(rows)


def hybrid_rows(spark, sf):
    """Grant rows with stored labels, recorded answers by input hash, and overrides."""
    g = b.purposes(b.grants(spark, sf, described=True))
    hashed = g.withColumn("input_hash", funding.input_hash("description", "grant_number"))
    rows = hashed.select(
        F.col("grant_id").alias("id"), "input_hash", F.when(F.col("level") == "federal", "growth").alias("stored_label"),
        F.when(F.col("obligated").isNotNull(), F.col("input_hash")).otherwise("old").alias("stored_hash"), F.lit("llm").alias("stored_by"),
        F.col("purpose").alias("rule"), funding.needs_review("description", "purpose", b.PART_SPEND).alias("review"))
    said = hashed.filter("fiscal_year >= 1997").select("input_hash", F.concat(
        F.lit('{"label": "'), F.when(F.col("level") == "state", "Maintenance ").otherwise("bogus"), F.lit('", "reason": "r'), "fiscal_year", F.lit('"}')).alias("answer"))
    forced = hashed.filter("amount > 490000").select(F.col("grant_id").alias("id"), F.lit("planning").alias("label"), F.lit("by hand").alias("reason"))
    return rows, said, forced


def hybrid_labels(spark, sf):
    return ev.hybrid_labels(*hybrid_rows(spark, sf), CATEGORIES)


def hybrid_audit(spark, sf):
    out = ev.hybrid_labels(*hybrid_rows(spark, sf), CATEGORIES)
    return ev.label_audit(out, "grant_spend", F.lit("2024-01-01"))


def budget_line_labels(spark, sf):
    """Budget lines by group through the evaluation registry, against their own status."""
    lines = funding_plans.budget_lines(spark, sf).select(F.struct("seq.*").alias("id"), "line_group", "category")
    rows = lines.groupBy("line_group", "category").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.concat_ws("-", "line_group", "category"))
    task = ev.Evaluation("budget_line", ev.LINE_KINDS, lambda df: df.select("id", F.when(F.col("category") == "A", "unheard of").otherwise(F.col("line_group")).alias("label")))
    labels = rows.select("id", F.when(F.col("category") == "O", "project").otherwise(F.col("line_group")).alias("label"))
    return ev.run_evaluation(task, rows, labels, "id").select("id", "label", "gold_label", F.array_join("fail", ",").alias("fail"), "ok")


QUERIES = {f.__name__: f for f in (
    evidence_features, evidence_scores, evidence_misses, evidence_accuracy, evidence_confusion, evidence_ablation,
    gold_merge, gold_novel, gold_from_outcomes, gold_from_rejects, gold_recall, hint_verdicts, answers_hits,
    answers_verdicts, answers_plans, answers_finance, answers_hints, hybrid_labels, hybrid_audit, budget_line_labels,
)}

# --- oracle ---------------------------------------------------------------------------

def rx(column: str, pattern: str) -> str:
    shown = pattern.replace("(?iu)", "(?i)").replace("'", "''")
    return f"regexp_matches({column}, '{shown}')"


URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"

PACKETS_SQL = """
pk AS (SELECT doc_id AS id, source AS lid, 'Harbor ' || source AS airport, lang, n_chars AS n,
  CASE lang WHEN 'en' THEN 'https://www.harbor.gov/' || source || '/projects/final_master_plan_' || doc_id || '.pdf' WHEN 'fr' THEN 'https://lists.example.org/docs/' || doc_id || '/alp_sheet.pdf'
    WHEN 'de' THEN 'https://' || source || '.example.org/abcd/' || CASE WHEN n_chars > 900 THEN 'news' ELSE 'hub' END || '/' || doc_id ELSE 'https://sharepoint.example.gov/x/environmental/chapter-' || doc_id || '.pdf' END AS url,
  CASE WHEN n_chars < 500 THEN 'Airport Master Plan' WHEN n_chars < 700 THEN 'Chapter 3 Inventory' WHEN n_chars < 900 THEN 'Meeting minutes' WHEN n_chars < 1100 THEN 'Airport diagram' WHEN n_chars < 1500 THEN 'Economic impact'
    WHEN n_chars < 2500 THEN 'ALP ' || source WHEN n_chars < 3500 THEN 'State aviation system plan' ELSE 'Appendix A' END AS label,
  text || CASE WHEN n_chars > 3000 THEN ' The airport master plan with inventory, forecast, alternatives and implementation.' WHEN n_chars > 1000 THEN ' An environmental assessment under way.' WHEN n_chars > 600 THEN ' Pavement condition and PFC.' ELSE '' END
   || CASE WHEN lang = 'de' THEN ' <a href=''files/amp.pdf?x''>a</a> <a href="/x/alp.PDF">b</a>' ELSE '' END AS body,
  CASE WHEN n_chars > 2000 THEN 'Inventory Forecasts' ELSE '' END AS outline, CASE WHEN n_chars > 2000 THEN 2 ELSE 0 END AS outline_n, n_chars * 3000 AS bytes FROM documents)"""

SHAPE_SQL = " + ".join(f"CAST({rx('txt', p)} AS INTEGER)" for p in PACK.shapes.values())

FEATURES_SQL = PACKETS_SQL + f""",
p1 AS (SELECT *, regexp_extract(url, '{URI}', 3) AS path, regexp_replace(regexp_extract(url, '{URI}', 2), '^www\\.', '') AS host, label || ' ' || body || ' ' || outline AS txt,
   concat_ws(' ', label, url, body, nullif(outline, '')) AS blob FROM pk),
p2 AS (SELECT *, coalesce(nullif(regexp_extract(path, '([^/]*)$', 1), ''), 'download') AS name, lower(path) AS low,
   list_filter(regexp_extract_all(lower(airport), '[a-z0-9]+'), lambda t: length(t) > 3) AS tok, {SHAPE_SQL} AS shape FROM p1),
p3 AS (SELECT *, ends_with(low, '.pdf') AS pdf, {rx('name', PACK.amp)} AS n_amp, {rx('name', PACK.alp)} AND NOT contains(lower(name), 'narrative') AS n_alp,
   {rx('name', PACK.chapter)} AS n_ch, {rx('label', rules.DIAGRAM)} AS diag FROM p2),
p4 AS (SELECT *, NOT pdf AS html, CASE WHEN pdf THEN body ELSE '' END AS src, body AS first, (n_amp AND NOT n_ch) OR n_ch OR n_alp OR diag OR shape >= 3 AS planned,
   CASE WHEN NOT pdf THEN regexp_extract_all(body, '{rules.PDF_HREF.replace("'", "''")}', 1) ELSE [] END AS hrefs, concat_ws(' ', label, url, name) AS surface, label || ' ' || name AS ln FROM p3)"""


def _hits_sql(tokens: str, column: str) -> str:
    return f"len(list_filter({tokens}, lambda t: contains(lower({column}), t)))"


EXPR = {
    "lid_in_url": "contains(lower(url), lower(lid))", "lid_in_text": "contains(lower(txt), lower(lid))",
    "lid_in_filename": "contains(lower(name), lower(lid))", "lid_in_label": "contains(lower(label), lower(lid))",
    "name_in_text": "contains(regexp_replace(lower(blob), '[_\\-]+', ' ', 'g'), lower(airport))",
    "name_in_filename": _hits_sql("tok", "name") + " >= 1",
    "name_token_host": f"least({_hits_sql('tok', 'host')}, 3)",
    "name_token_host_strong": f"least({_hits_sql('list_filter(tok, lambda t: length(t) >= 6)', 'host')}, 3)",
    "name_token_path": f"least({_hits_sql('tok', 'low')}, 3)",
    "other_lid_in_url": "len(list_filter(regexp_extract_all(path, '(?i)/([A-Z0-9]{3,4})(?:/|$)', 1), lambda t: upper(t) <> upper(lid) AND lower(t) NOT IN ("
        + ", ".join(f"'{x}'" for x in rules.PATH_STOP) + ") AND NOT regexp_matches(t, '^\\d+$'))) > 0",
    "host_gov": "ends_with(host, '.gov') OR ends_with(host, '.mil')", "host_encyclopedia": "contains(host, 'wikipedia.org')",
    "ssi_name": rx("name || ' ' || url", web_rules.SENSITIVE), "news_path": f"{rx('name', web_rules.NEWS)} OR {rx('path', web_rules.NEWS)}",
    "filename_amp": "n_amp AND NOT n_ch", "filename_alp": "n_alp", "filename_ea": f"{rx('name', PACK.ea)} OR {rx('path', PACK.ea)}", "filename_chapter": "n_ch",
    "filename_abstract": f"{rx('name', rules.ABSTRACT)} OR {rx('url', rules.GUID)}", "filename_pfc": rx("name", rules.PFC_NAME),
    "path_master_plan": "contains(low, 'master') AND contains(low, 'plan')", "path_projects": "contains(low, '/projects/')", "path_environmental": "contains(low, 'environmental')",
    "label_minutes": rx("label", rules.MINUTES), "label_notice": rx("label", rules.NOTICE), "label_diagram": "diag", "label_economic_impact": rx("label", PACK.econ),
    "label_amp": f"{rx('label', PACK.amp)} AND NOT {rx('label', PACK.chapter)}", "label_alp": rx("label", PACK.alp), "label_chapter": rx("label", PACK.chapter),
    "label_appendix": f"{rx('label', PACK.appendix)} OR {rx('name', PACK.appendix)}", "label_statewide": rx("ln", PACK.statewide),
    "text_amp": rx("txt", PACK.amp), "first_page_amp": rx("first", PACK.amp), "packet_not_plan": rx("surface", PACK.not_plan),
    "body_nepa": f"{rx('src', PACK.ea)} AND NOT planned",
    "body_economic_impact": rx("(CASE WHEN src <> '' THEN src ELSE label END)", PACK.econ) + " AND NOT planned",
    "body_budget": rx("(CASE WHEN src <> '' THEN src ELSE surface END)", PACK.budget) + " AND NOT planned",
    "body_pavement": rx("(CASE WHEN src <> '' THEN src ELSE surface END)", PACK.pave) + " AND NOT planned",
    "body_statewide": rx("(CASE WHEN src <> '' THEN first ELSE ln END)", PACK.statewide),
    "shape_count": "shape", "outline_n": "outline_n", "body_short": "pdf AND length(src) < 400", "body_long": "length(src) >= 8000",
    "scanned_pdf": "pdf AND bytes > 2000000 AND length(src) < 800", "media_pdf": "pdf", "media_html": "html",
    "sharepoint": "contains(lower(url), 'sharepoint') OR contains(low, 'lists/')", "html_pdf_links": "least(len(hrefs), 8)",
    "html_amp_links": f"least(len(list_filter(hrefs, lambda h: {rx('h', PACK.amp)})), 4)",
    "html_alp_links": f"least(len(list_filter(hrefs, lambda h: {rx('h', PACK.alp)})), 4)",
    "html_plan_hrefs": f"{rx(chr(34) + 'hj' + chr(34), PACK.amp)} OR {rx(chr(34) + 'hj' + chr(34), PACK.alp)}",
}
FEATURES_SQL += """,
p5 AS (SELECT *, array_to_string(hrefs, ' ') AS hj FROM p4),
ft AS (SELECT id, """ + ", ".join(f"CAST(({EXPR[n]}) AS DOUBLE) AS f_{n}" for n in ops.FEATURES) + " FROM p5)"


def _sum_sql(weights: dict) -> str:
    return " + ".join(f"f_{n} * {w}::DOUBLE" for n, w in weights.items())


def _on(*names: str) -> str:
    return "(" + " OR ".join(f"f_{n} <> 0" for n in names) + ")"


BEST = "list_max([" + ", ".join(f"{{'s': kind_{k}, 'o': {-i}, 'k': '{k}'}}" for i, k in enumerate(x for x in rules.KINDS if x != "hub")) + "])"


def _decide_sql(source: str, confirm: str = "2.5", publish: str = "3.5") -> str:
    known = _on("lid_in_url", "lid_in_text", "lid_in_filename", "lid_in_label")
    placed = _on("lid_in_url", "lid_in_filename")
    alp, chapter = _on("filename_alp", "label_diagram", "label_alp"), _on("filename_chapter", "label_chapter")
    return f"""
d1 AS (SELECT *, CASE WHEN {_on('other_lid_in_url')} AND NOT {known} THEN false WHEN {_on('label_statewide', 'body_statewide')} THEN {placed}
    WHEN {_on('filename_pfc')} AND NOT {placed} THEN false
    ELSE {known} OR {_on('name_in_text', 'name_in_filename')} OR f_name_token_host >= 2 OR {_on('name_token_host_strong')} OR (f_name_token_host >= 1 AND f_name_token_path >= 1) OR f_name_token_path >= 2 END AS same_airport,
  CASE WHEN {_on('media_html')} THEN CASE WHEN kind_not_plan >= 2 AND kind_not_plan >= kind_notice THEN 'not_plan' WHEN kind_notice >= 2 THEN 'notice' ELSE 'hub' END
    WHEN {_on('filename_pfc', 'filename_ea', 'label_economic_impact', 'label_statewide')} THEN 'not_plan' WHEN {alp} AND kind_not_plan < kind_alp + 2 THEN 'alp'
    WHEN {chapter} AND NOT {_on('filename_ea', 'filename_alp')} AND kind_chapter >= kind_not_plan THEN 'chapter'
    WHEN {BEST}.s < 2 THEN CASE WHEN {_on('filename_ea', 'packet_not_plan', 'filename_abstract')} THEN 'not_plan' WHEN {chapter} THEN 'chapter' WHEN {alp} THEN 'alp'
      WHEN {_on('filename_amp', 'label_amp', 'path_master_plan', 'text_amp')} THEN 'master_plan' ELSE 'not_plan' END
    ELSE {BEST}.k END AS kind FROM {source}),
d2 AS (SELECT *, kind IN ('master_plan', 'alp', 'chapter') AND f_media_pdf <> 0 AND f_ssi_name = 0 AND same_airport AS plan_ok FROM d1),
d3 AS (SELECT *, plan_ok AND confirm_score >= {confirm} AS confirm, plan_ok AND publish_score >= {publish} AS publish FROM d2),
dec AS (SELECT *, same_airport AND explore_score >= 2.5 AND f_ssi_name = 0 AND NOT confirm AND f_media_html <> 0 AND kind NOT IN ('not_plan', 'notice') AS explore FROM d3)"""


SCORES = {"confirm_score": rules.CONFIRM, "explore_score": rules.EXPLORE, "publish_score": rules.PUBLISH, **{f"kind_{k}": w for k, w in rules.KINDS.items()}}
SCORED_SQL = FEATURES_SQL + ",\nsc AS (SELECT *, " + ", ".join(f"{_sum_sql(w)} AS {t}" for t, w in SCORES.items()) + " FROM ft)"
DECIDED_SQL = SCORED_SQL + "," + _decide_sql("sc")
GOLD_SQL = """
gold AS (SELECT doc_id AS id, quality = 1 AS g_same_airport, CASE WHEN quality = 1 THEN 'alp' ELSE 'not_plan' END AS g_kind, toxic = 0 AS g_confirm, false AS g_explore, CASE WHEN toxic = 0 THEN quality = 1 END AS g_publish FROM labels)"""
FAILS = ", ".join(f"CASE WHEN g_{f} IS NOT NULL AND {f} IS DISTINCT FROM g_{f} THEN '{f}' END" for f in rules.FIELDS)
JUDGED_SQL = DECIDED_SQL + "," + GOLD_SQL + f""",
jd AS (SELECT dec.*, gold.* EXCLUDE (id), list_filter([{FAILS}], lambda x: x IS NOT NULL) AS fail FROM dec JOIN gold ON gold.id = dec.id)"""
HITS = ", ".join(f"count(*) FILTER (WHERE NOT list_contains(fail, '{f}')) AS hits_{f}" for f in rules.FIELDS)

# Variants as rows: what each shifts, next to the weights it shifts.
VARIANTS = ops.ablation_variants() + [{"variant": "publish 5", "thresholds": {"publish": 5.0}}, {"variant": "alp +3", "feature": "label_alp", "deltas": {"kind_alp": 3.0}}]
VARIANT_ROWS = ", ".join(
    "('{v}', '{f}', {t}::DOUBLE, {d})".format(v=x["variant"], f=x.get("feature", ""), t=x.get("thresholds", {}).get("publish", 3.5),
                                              d=", ".join(f"{x.get('deltas', {}).get(t, 0.0)}::DOUBLE" for t in SCORES)) for x in VARIANTS)
VALUE = "CASE v.feature " + " ".join(f"WHEN '{n}' THEN f_{n}" for n in ops.FEATURES) + " ELSE 0 END"
ABLATION_SQL = SCORED_SQL + "," + GOLD_SQL + f""",
vr AS (SELECT * FROM (VALUES {VARIANT_ROWS}) v(variant, feature, t_publish, {', '.join('d_' + t for t in SCORES)})),
sv AS (SELECT s.* REPLACE ({', '.join(f's.{t} + ({VALUE}) * v.d_{t} AS {t}' for t in SCORES)}), v.variant, v.t_publish FROM sc s JOIN gold USING (id), vr v),""" + _decide_sql("sv", publish="t_publish") + f""",
jd AS (SELECT dec.*, gold.* EXCLUDE (id), list_filter([{FAILS}], lambda x: x IS NOT NULL) AS fail FROM dec JOIN gold ON gold.id = dec.id)"""

HITPK_SQL = DOCS_SQL + """,
hp AS (SELECT id, entity AS lid, length(text) AS n, kind, CASE WHEN kind <> 'notice' THEN source_url ELSE '' END AS art, CASE WHEN length(text) > 600 THEN 'https://' || region || '.example.gov/' || entity ELSE '' END AS pg,
   region || '.example.gov' AS h, length(text) < 430 AS bad, length(text) >= 450 AS same0 FROM docs),
al AS (SELECT *, CASE WHEN art = '' AND pg = '' THEN ['https://far.example.com/x.pdf'] ELSE list_filter([art, pg], lambda u: u <> '') END AS allowed FROM hp),
ty AS (SELECT *, CASE WHEN n < 900 THEN 'artifact' WHEN n < 1300 THEN 'notice' WHEN n < 1500 THEN 'not_plan' ELSE 'hub_page' END AS t0, CASE WHEN n < 1000 THEN 'no' ELSE 'yes' END AS f0,
   list_filter(allowed, lambda u: ends_with(u, '.pdf')) AS pdfs, n >= 560 AND n < 640 AS secret, n < 560 AS off FROM al),
ru AS (SELECT *, CASE WHEN bad THEN 'bad' WHEN secret THEN 'human' WHEN NOT same0 THEN 'foreign' WHEN off THEN 'off' WHEN t0 = 'notice' AND len(pdfs) = 0 THEN 'notice'
   WHEN f0 = 'no' AND t0 IN ('artifact', 'hub_page', 'both') AND (pg <> '' OR len(pdfs) > 0) THEN 'upgrade' ELSE 'as said' END AS rule FROM ty),
wa AS (SELECT *, CASE WHEN rule IN ('bad', 'human') THEN 'needs_human' WHEN rule IN ('foreign', 'off', 'notice') THEN 'no' WHEN rule = 'upgrade' THEN 'yes' ELSE f0 END AS want,
   CASE WHEN rule IN ('off', 'bad') THEN 'not_plan' ELSE t0 END AS t1, CASE WHEN pg <> '' THEN [pg] ELSE [] END AS pgs0 FROM ru),
fi AS (SELECT *, CASE WHEN len(pdfs) = 0 AND len(pgs0) = 0 THEN list_filter(allowed, lambda u: NOT ends_with(u, '.pdf')) ELSE pgs0 END AS pgs FROM wa),
res AS (SELECT id, lid, art, pg, n, CASE WHEN rule = 'bad' THEN false WHEN rule = 'off' THEN same0 ELSE same0 END AS same_airport,
   CASE WHEN want = 'yes' AND (len(pdfs) > 0 OR len(pgs) > 0) AND t1 = 'not_plan' AND pg <> '' AND len(pdfs) = 0 THEN 'hub_page' ELSE t1 END AS hit_type, CASE WHEN rule IN ('off', 'bad') THEN 'unknown' ELSE 'alp' END AS kind_guess,
   CASE WHEN want = 'yes' AND len(pdfs) = 0 AND len(pgs) = 0 THEN 'no' ELSE want END AS "fetch", CASE WHEN want = 'yes' THEN pdfs ELSE [] END AS artifact_urls, CASE WHEN want = 'yes' THEN pgs ELSE [] END AS page_urls,
   CASE WHEN bad THEN 'model JSON missing' ELSE 'because' END AS reason FROM fi)"""

HYBRID_SQL = GRANTS_SQL + f""",
hb AS (SELECT *, {HASH.replace('description', "nullif(description, '')")} AS input_hash, purpose = 'other' OR regexp_matches(coalesce(description, ''), '(?i)\\b(?:widget|gear)\\b') AS review, level = 'federal' AND obligated IS NOT NULL AS kept FROM grants),
hl AS (SELECT grant_id AS id, input_hash, CASE WHEN amount > 490000 THEN 'planning' WHEN kept THEN 'growth' WHEN review AND fiscal_year >= 1997 THEN CASE WHEN level = 'state' THEN 'maintenance' ELSE purpose END ELSE purpose END AS label,
  CASE WHEN amount > 490000 THEN 'human' WHEN kept THEN 'llm' WHEN review AND fiscal_year >= 1997 THEN 'llm' ELSE 'rules' END AS labelled_by,
  CASE WHEN amount > 490000 THEN 'by hand' WHEN NOT kept AND review AND fiscal_year >= 1997 THEN 'r' || fiscal_year ELSE '' END AS reason FROM hb)"""

ORACLE = {
    "evidence_features": f"WITH {FEATURES_SQL} SELECT * FROM ft",
    "evidence_scores": f"WITH {DECIDED_SQL} SELECT id, same_airport, kind, confirm, explore, publish, round(confirm_score, 6) AS confirm_score, round(explore_score, 6) AS explore_score, round(publish_score, 6) AS publish_score FROM dec",
    "evidence_misses": f"WITH {JUDGED_SQL} SELECT id, array_to_string(fail, ',') AS fail FROM jd WHERE len(fail) > 0",
    "evidence_accuracy": f"""WITH {JUDGED_SQL}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE len(fail) = 0) AS n_ok, {HITS} FROM jd)
SELECT *, round(n_ok::DOUBLE / n, 9) AS case_accuracy, round(({' + '.join('hits_' + f for f in rules.FIELDS)})::DOUBLE / (5 * n), 9) AS field_accuracy FROM a""",
    "evidence_confusion": f"WITH {JUDGED_SQL} SELECT g_kind AS gold, kind AS got, count(*) AS n FROM jd GROUP BY ALL",
    "evidence_ablation": f"WITH {ABLATION_SQL} SELECT variant, count(*) AS n, count(*) FILTER (WHERE len(fail) = 0) AS n_ok, {HITS} FROM jd GROUP BY variant",
    "gold_merge": f"""WITH {DOCS_SQL}, c AS (SELECT 'p' || page_id AS id, regexp_replace(url, '[?#].*$', '') AS url, page_id AS seq, 0 AS g FROM pages
  UNION ALL SELECT 'q' || page_id, regexp_replace(url, '[?#].*$', '') || '/', page_id, 1 FROM pages UNION ALL SELECT 'd' || id, source_url, seq, 2 FROM docs)
SELECT id, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY g, seq) AS rn FROM c) WHERE rn = 1""",
    "gold_novel": f"WITH {DOCS_SQL} SELECT id, source_url || '/' AS url FROM docs WHERE source_url NOT IN (SELECT source_url FROM docs WHERE kind = 'alp')",
    "gold_from_outcomes": r"""WITH p AS (SELECT page_id, CASE WHEN page_id > 100 THEN regexp_replace(url, '\.example\.', '.sample.', 'g') ELSE url END AS url FROM pages WHERE length(html) > 1500)
SELECT * FROM p WHERE NOT regexp_matches(url, '^https?://([^/?#]*\.)?example\.com([/?#]|$)') AND NOT contains(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/example/')""",
    "gold_from_rejects": f"""WITH {DOCS_SQL}
SELECT 'reject-' || substr(content_sha256, 1, 12) AS id, entity AS lid, region AS state, source_url AS url, coalesce(CASE WHEN kind = 'alp' THEN nullif(title, '') END, regexp_extract(source_url, '([^/]*)$', 1)) AS label,
  '{{"same_airport":true,"kind":"not_plan","confirm":false,"explore":false,"publish":false}}' AS gold, 'not_plan' AS reject_reason, content_sha256 AS reject_sha256 FROM docs WHERE kind <> 'notice' AND length(text) > 600""",
    "gold_recall": f"""WITH {DOCS_SQL}, w AS (SELECT DISTINCT entity, source_url AS url FROM docs), f AS (SELECT DISTINCT entity, source_url AS url FROM docs WHERE kind <> 'alp')
SELECT w.entity, count(*) AS n_gold, count(f.url) AS n_found, round(count(f.url)::DOUBLE / count(*), 9) AS recall FROM w LEFT JOIN f ON f.entity = w.entity AND f.url = w.url GROUP BY 1""",
    "hint_verdicts": """SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'http_url' WHEN c_acctbal > 8000 THEN 'off_host' WHEN c_acctbal <= 5000 THEN 'ok' ELSE 'no_matching_query' END AS verdict FROM customer""",
    "answers_hits": f"""WITH {HITPK_SQL} SELECT id, same_airport, hit_type, kind_guess, "fetch", array_to_string(artifact_urls, ' ') AS artifact_urls, array_to_string(page_urls, ' ') AS page_urls, reason FROM res""",
    "answers_verdicts": f"""WITH {HITPK_SQL}, g AS (SELECT *, CASE WHEN art <> '' THEN 'yes' ELSE 'no' END AS gf, CASE WHEN ends_with(art, '.pdf') THEN [art] ELSE [] END AS ga, CASE WHEN contains(pg, 'src1') THEN [pg] ELSE [] END AS fb, list_concat(artifact_urls, page_urls) AS named FROM res)
SELECT id, CASE WHEN NOT same_airport THEN 'same_airport' WHEN "fetch" <> gf THEN 'fetch' WHEN len(list_filter(named, lambda u: NOT list_contains([art, pg], u))) > 0 THEN 'invented_url' WHEN len(list_intersect(named, fb)) > 0 THEN 'forbid_url'
  WHEN gf = 'yes' AND len(list_filter(ga, lambda u: NOT list_contains(artifact_urls, u))) > 0 THEN 'missing_artifact' WHEN gf = 'no' AND len(artifact_urls) > 0 THEN 'enqueue_on_no' ELSE 'ok' END AS verdict FROM g""",
    "answers_plans": f"WITH {DOCS_SQL} SELECT id, true AS official_plan, kind, false AS same_airport, CAST(NULL AS VARCHAR) AS publisher, source_url AS pdf_urls, false AS new_edition, '' AS reason FROM docs",
    "answers_finance": f"WITH {DOCS_SQL} SELECT id, true AS official_finance, CASE kind WHEN 'alp' THEN 'pfc' ELSE 'other' END AS finance_kind, CASE kind WHEN 'notice' THEN 'state' ELSE 'airport' END AS scope, true AS same_entity, 0 AS n_urls, true AS has_locid_rows FROM docs",
    "answers_hints": """SELECT c_custkey AS id, 'site:a.gov ' || c_custkey || ' master plan' AS query, 'w' AS why, 1 AS rank FROM customer
UNION ALL SELECT c_custkey, c_custkey || CASE WHEN c_acctbal > 0 THEN ' chapter two' ELSE ' ALP 2012' END, '', 2 FROM customer""",
    "hybrid_labels": f"WITH {HYBRID_SQL} SELECT * FROM hl",
    "hybrid_audit": f"""WITH {HYBRID_SQL} SELECT '2024-01-01' AS "at", 'grant_spend' AS evaluation, id AS input_id, label AS category, labelled_by AS classifier, reason FROM hl WHERE labelled_by <> 'rules'""",
    "budget_line_labels": """SELECT * FROM (VALUES ('program-A', NULL, 'program', 'label', false), ('program-N', 'program', 'program', '', true), ('program-R', 'program', 'program', '', true), ('fund-F', 'fund', 'fund', '', true), ('fund-O', 'fund', 'project', 'label', false)) v(id, label, gold_label, fail, ok)""",
}
