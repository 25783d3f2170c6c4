"""Web pages: links, link roles, gates, redaction, host votes, candidate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainledger.functions import html, urls
from plainledger.functions import values as v
from plainledger.operators.registry import first_row
from plainledger.rules import web as rules
from plainledger.rules.web import LinkRules
from plainledger.sources.tables import sniff_media


def from_encyclopedia(url: Column | str) -> Column:
    return v.any_of(*[urls.host(url).contains(h) for h in rules.ENCYCLOPEDIA_HOSTS])


# --- links -----------------------------------------------------------------

def page_links(pages: DataFrame, page_id: str, url: str, markup: str, bare_names: bool = True) -> DataFrame:
    """Links of every page: (page_id, url, pos, found_on, label), first use of a URL.

    All of a page's links sit in its own row, so a repeated URL is dropped there:
    link extraction needs no shuffle. Attributes and inner text come from one pass
    each over the markup. `bare_names`: names of HTML count without their semicolon.
    """
    anchor = F.lit(r"(?is)<a\b([^>]*)>(.*?)</a>")
    text = F.coalesce(F.col(markup), F.lit(""))

    def href(attrs: Column) -> Column:
        found = F.regexp_extract(attrs, r"(?i)\bhref=[\"']([^\"']+)[\"']", 1)
        return F.trim(F.when(found.contains("&"), html.decode_entities(found, bare_names)).otherwise(found))

    read = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("found_on"), urls.base_parts(url).alias("_base"),
        F.transform(F.regexp_extract_all(text, anchor, F.lit(1)), href).alias("_hrefs"),
        F.regexp_extract_all(text, anchor, F.lit(2)).alias("_inner"))

    def target(h: Column) -> Column:
        linked = (h != "") & ~h.rlike(rules.SKIP_HREF)
        return F.when(linked, urls.resolve_from(F.col("_base"), F.substring_index(h, "#", 1)))

    resolved = read.withColumn("_urls", F.transform("_hrefs", target))
    own = F.rtrim("found_on", F.lit("/"))

    def first_use(u: Column, i: Column) -> Column:
        return u.startswith("http") & (F.rtrim(u, F.lit("/")) != own) & (F.array_position("_urls", u) == i + 1)

    kept = F.filter(
        F.transform("_urls", lambda u, i: F.when(first_use(u, i), F.struct(i.alias("pos"), u.alias("url")))),
        lambda x: x.isNotNull())
    links = resolved.select("page_id", "found_on", "_inner", F.explode(kept).alias("k"))
    return links.select(
        "page_id", "k.url", "k.pos", "found_on", html.clean_text(F.get("_inner", F.col("k.pos")), bare_names).alias("label"))


def with_link_role(df: DataFrame, url: str, label: Column | str, pack: LinkRules = LinkRules()) -> DataFrame:
    """Add media, role and kind of a link from its URL and label, first matching rule.

    The parts are columns of their own, so each is computed once per row.
    """
    text = F.coalesce(v.col(label), F.lit(""))
    parts = df.withColumn("media", urls.media_for(url)).withColumn("_label", text).withColumn(
        "_blob", F.concat("_label", F.lit(" "), F.col(url)))
    pdf, blob = F.col("media") == "pdf", F.col("_blob")
    decision = (
        F.when(from_encyclopedia(url) | blob.rlike(pack.not_plan), "not_plan unknown")
        .when(urls.raw_path(url).rlike(pack.news) | F.col("_label").rlike(pack.news), "notice unknown")
        .when(pdf & blob.rlike(pack.alp), "artifact alp")
        .when(pdf & blob.rlike(pack.part), "part chapter")
        .when(pdf & blob.rlike(pack.plan), "artifact master_plan")
        .when(pdf, "artifact unknown")
        .when(blob.rlike(pack.plan), "hub_page master_plan")
        .when(blob.rlike(pack.alp), "hub_page alp")
        .otherwise("hub_page unknown")
    )
    return (
        parts.withColumn("_decision", decision)
        .withColumn("role", F.split_part("_decision", F.lit(" "), F.lit(1)))
        .withColumn("kind", F.split_part("_decision", F.lit(" "), F.lit(2)))
        .drop("_label", "_blob", "_decision")
    )


def classified_links(links: DataFrame, pack: LinkRules = LinkRules()) -> DataFrame:
    return with_link_role(links, "url", "label", pack)


def worth_confirm(role: Column | str, kind: Column | str, label: Column | str,
                  pack: LinkRules = LinkRules()) -> Column:
    text = F.coalesce(v.col(label), F.lit(""))
    return (
        ~v.yes(v.col(role).isin(*rules.CLOSED_ROLES))
        & ~text.rlike(pack.skip_label) & ~F.trim(text).rlike(rules.DATE_LABEL)
        & v.yes(v.col(kind).isin(*rules.CONFIRM_KINDS))
    )


def hub_kind(title: Column | str, excerpt: Column | str, pack: LinkRules = LinkRules()) -> Column:
    title = v.col(title)
    blob = F.concat_ws(" ", title, v.col(excerpt))
    facility = F.lower(title).contains("airport") & title.contains("[")
    plan = blob.rlike(pack.plan) & ~blob.rlike(pack.not_plan)
    return F.when(facility, "other").when(plan, "master_plan").otherwise("other")


def source_family(status: Column, error: Column, artifacts: Column, followups: Column,
                  hub: Column, url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    docs = low.contains("wp-content") | low.contains("/documents")
    return (
        F.when(v.yes(status == 403), "bot_wall")
        .when(v.first_text(error).isNotNull() | v.yes(status.isin(404, 410)), "dead")
        .when(followups > 0, "sharepoint_list")
        .when(artifacts >= 40, "document_dump")
        .when(docs, F.when(artifacts > 0, "wordpress_docs").otherwise("facility_page"))
        .when(hub == "master_plan", "plan_hub")
        .when(artifacts == 0, "facility_page")
        .when((artifacts == 1) & low.endswith(".pdf"), "bound_pdf")
        .otherwise("unknown")
    )


def list_followups(pages: DataFrame, page_id: str, url: str, markup: str) -> DataFrame:
    """List pointers embedded in a hub page as follow-up URLs, first use per page."""
    # A pointer's name is plain letters, so only pages that show it, or that hold
    # numeric entities, need decoding at all.
    likely = F.col(markup).contains("webPartProperties") | F.col(markup).contains("&#")
    pages = pages.filter(likely)
    text = html.decode_entities(F.coalesce(F.col(markup), F.lit("")))
    blobs = F.regexp_extract_all(text, F.lit(r"webPartProperties:\s*\{([^}]*)\}"), F.lit(1))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("found_on"), F.posexplode(blobs).alias("pos", "blob"))

    def value(name: str) -> Column:
        return F.regexp_extract("blob", rf'(?i)"{name}"\s*:\s*"([^"]+)"', 1)

    path = F.trim(F.regexp_replace(value("sharePointListUrl"), r"\s+", " "))
    web, view = value("sharePointWebUrl"), value("sharePointViewName")
    origin = F.concat(urls.scheme("found_on"), F.lit("://"), F.regexp_extract("found_on", urls.URI, 2))
    base = F.concat(origin, F.rtrim(web, F.lit("/")), F.lit("/"))
    target = (
        F.when(path.startswith("http"), path)
        .when(path.startswith("/"), F.concat(origin, path))
        .when(web != "", urls.resolve(base, path))
        .otherwise(urls.resolve("found_on", path))
    )
    found = rows.filter(value("sharePointListUrl") != "").select(
        "page_id", target.alias("url"), "pos", "found_on",
        F.when(view != "", view).alias("view_name"),
        F.coalesce(F.nullif(view, F.lit("")), F.substring_index(path, "/", -1)).alias("label"),
    )
    return first_row(found, ["page_id", "url"], F.col("pos"))


def page_heads(pages: DataFrame, page_id: str, url: str, markup: str,
               pack: LinkRules = LinkRules(), keep: Sequence[str] = (), bare_names: bool = True) -> DataFrame:
    """Title, excerpt and hub kind of every page; the markup is cleaned once."""
    cleaned = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), *keep,
        html.page_title(markup, bare_names).alias("title"), html.clean_text(markup, bare_names).alias("_text"))
    heads = cleaned.select("page_id", "url", *keep, "title", html.excerpt(F.col("_text")).alias("excerpt"))
    return heads.withColumn("hub_kind", hub_kind("title", "excerpt", pack))


def page_report(pages: DataFrame, links: DataFrame, followups: DataFrame, page_id: str, url: str,
                markup: str, pack: LinkRules = LinkRules(), bare_names: bool = True) -> DataFrame:
    """Per page: title, hub kind, source family and counts of what it links to.

    Links: output of `classified_links`. Counts are grouped per page before they
    meet the page rows, and the markup is dropped before the joins.
    """
    artifact = F.col("role").isin("artifact", "part")
    counts = links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(artifact).alias("n_artifacts"),
        F.count_if(artifact & worth_confirm("role", "kind", "label", pack)).alias("n_confirm"),
    )
    follows = followups.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_followups"))
    heads = page_heads(pages, page_id, url, markup, pack, bare_names=bare_names)
    out = heads.join(counts, "page_id", "left").join(follows, "page_id", "left").na.fill(
        0, ["n_links", "n_artifacts", "n_confirm", "n_followups"])
    family = source_family(F.lit(200), F.lit(None).cast("string"), F.col("n_artifacts"),
                           F.col("n_followups"), F.col("hub_kind"), F.col("url"))
    return out.withColumn("source_family", family)


# --- gates and redaction ------------------------------------------------------

def gate(url: Column | str, name: Column | str, content: Column | str, size: Column | str,
         allow_html: bool = False) -> Column:
    """First failing check of a fetched payload, else ok."""
    url, name = v.col(url), F.coalesce(v.first_text(name), urls.file_name(url))
    media = sniff_media(content)
    fine = (media == "pdf") | (F.lit(allow_html) & (media == "html"))
    return (
        F.when(F.concat(name, F.lit(" "), url).rlike(rules.SENSITIVE), "ssi")
        .when(name.rlike(rules.NEWS) | urls.raw_path(url).rlike(rules.NEWS), "not_plan")
        .when(from_encyclopedia(url), "not_plan")
        .when(v.col(size) > rules.MAX_BYTES, "too_large")
        .when(fine, "ok").otherwise("not_file")
    )


def intake_status(result: Column | str) -> Column:
    r = v.col(result)
    return F.when(r == "not_file", "not_plan").when(r == "too_large", "needs_human").when(r != "ok", r)


def payload_fault(suffix: Column | str, content: Column | str, size: Column | str) -> Column:
    """Reason a labelled source's payload is no original, null when it is fine."""
    suffix, size = v.col(suffix), v.col(size)
    head = F.lower(F.substring(v.col(content), 1, 1000))
    blocked = v.any_of(*[head.contains(m) for m in rules.BLOCK_MARKS])
    fake = (suffix == ".html") & ((size < rules.MIN_PAGE_BYTES) | blocked)
    return (
        F.when(fake, F.concat(F.lit("not original page ("), size.cast("string"), F.lit(" bytes)")))
        .when((suffix == ".pdf") & ~v.col(content).startswith("%PDF"), "not a PDF")
    )


def redact(text: Column | str, rules_list=rules.REDACTIONS) -> Column:
    out = v.col(text)
    for pattern, replacement in rules_list:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def has_secret(text: Column | str) -> Column:
    return v.col(text).rlike(rules.LEFT_SECRET)


def redact_log(text: Column | str, literals: Sequence[str] = ()) -> Column:
    out = redact(text, rules.LOG_REDACTIONS)
    for value in literals:
        if len(value) >= 8:
            out = F.replace(out, F.lit(value), F.lit("redacted"))
    return out


# --- search hits ---------------------------------------------------------------

def usable_url(url: Column | str) -> Column:
    url = v.col(url)
    host = urls.host(url)
    redirect = v.any_of(*[url.contains(p) for p in rules.REDIRECT_PARTS])
    under = v.any_of(*[host.endswith(s) for s in rules.REDIRECT_SUFFIXES])
    return url.startswith("http") & ~redirect & ~host.isin(*rules.SKIP_HOSTS) & ~under


def triaged_hits(hits: DataFrame, pack: LinkRules = LinkRules()) -> DataFrame:
    """Search hits with role, kind, and whether to confirm or explore them.

    Hits: entity, seq, title, url, snippet.
    """
    label = F.coalesce(v.first_text("title"), F.col("snippet"), F.lit(""))
    blob = F.concat_ws(" ", F.coalesce("title", F.lit("")), "url", F.coalesce("snippet", F.lit("")))
    out = with_link_role(hits, "url", label, pack).drop("media").withColumn("_text", blob)
    path = F.lower(urls.raw_path("url"))
    named = F.lower(F.col("entity").cast("string"))
    hub = F.col("role") == "hub_page"
    explore = ~F.lower("url").endswith(".pdf") & (
        (hub & F.col("kind").isin("master_plan", "alp"))
        | path.contains("master-plan") | path.contains("masterplan")
        | F.rtrim(path, F.lit("/")).endswith("/documents")
        | (hub & (named != "") & F.lower("_text").contains(named))
    )
    return out.withColumn("confirm", worth_confirm("role", "kind", "_text", pack)).withColumn(
        "explore", v.yes(explore)).drop("_text")


def hit_hosts(hits: DataFrame, pack: LinkRules = LinkRules()) -> DataFrame:
    """Hosts named by every triaged hit, once per hit: (entity, seq, host, weight)."""
    blob = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), "url")
    low = F.lower(blob)
    named = low.contains(F.lower(F.col("entity").cast("string"))) | low.contains("master plan")
    bare = F.transform(F.regexp_extract_all(blob, F.lit(rules.BARE_HOST), F.lit(1)), F.lower)
    linked = F.transform(urls.prose_urls("snippet"), urls.host)
    found = F.concat(F.array(urls.host("url")), linked, F.when(named, bare).otherwise(F.array().cast("array<string>")))
    kept = F.filter(F.array_distinct(found), lambda h: (h != "") & ~h.isin(*rules.SKIP_HOSTS))
    weight = (
        F.when(F.col("explore"), 4).when(F.col("confirm"), 3).otherwise(1)
    )
    return hits.select("entity", "seq", weight.alias("weight"), F.explode(kept).alias("host"))


def host_votes(hits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Score and rank of hosts per entity; a known website adds one vote."""
    votes = hit_hosts(hits).select("entity", "host", "weight")
    if known is not None:
        own = known.select("entity", urls.host("website").alias("host"), F.lit(1).alias("weight"))
        votes = votes.unionByName(own.filter((F.col("host") != "") & ~F.col("host").isin(*rules.SKIP_HOSTS)))
    return votes.groupBy("entity", "host").agg(F.sum("weight").alias("score"))


def best_hosts(votes: DataFrame, limit: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("score").desc(), "host"))
    return votes.withColumn("pos", rank).filter(F.col("pos") <= limit)


def hit_years(hits: DataFrame) -> DataFrame:
    """Years named by useful hits per entity, with the place each was first seen."""
    def years(c: str) -> Column:
        return F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(rules.YEAR), F.lit(1))

    every = F.concat(years("title"), years("url"), years("snippet"))
    useful = F.when(F.col("confirm") | F.col("explore"), every)
    named = hits.select("entity", "seq", F.posexplode(useful).alias("pos", "year"))
    return named.groupBy("entity", "year").agg(F.min(F.struct("seq", "pos")).alias("first"))


def hit_signals(hits: DataFrame) -> DataFrame:
    """Per entity: counts of hits, hubs, artifacts and skipped ones, and kinds found."""
    skipped = ~F.col("confirm") & F.col("role").isin("not_plan", "notice")
    artifact = F.col("confirm") & F.col("role").isin("artifact", "part")

    def has(kind: str) -> Column:
        return F.coalesce(F.bool_or(F.col("confirm") & (F.col("kind") == kind)), F.lit(False))

    return hits.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.count_if(skipped).alias("n_skipped"),
        F.count_if(F.col("explore")).alias("n_hub_hits"),
        F.count_if(artifact).alias("n_artifact_hits"),
        has("master_plan").alias("has_whole"), has("alp").alias("has_alp"), has("chapter").alias("has_chapter"),
    ).withColumn("has_hub", F.col("n_hub_hits") > 0)


def done_searching() -> Column:
    return F.col("has_hub") | (F.col("has_whole") & F.col("has_alp"))


def needs_hint() -> Column:
    return (F.col("n_hits") > 0) & ~(F.col("has_whole") & F.col("has_alp"))


def candidate_jobs(hits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Fetch and explore candidates per entity, one row per URL; exploring comes first."""
    fetch_kind = F.coalesce(v.lookup(rules.JOB_KIND, F.col("kind")), F.lit("other"))

    def job(name: str, kind: Column, tier: int) -> Column:
        return F.struct(F.lit(name).alias("job"), kind.alias("kind"),
                        F.struct(F.lit(tier).alias("tier"), F.col("seq").alias("at")).alias("order"))

    wanted = F.array_compact(F.array(
        F.when(F.col("explore"), job("explore", F.lit("other"), 1)),
        F.when(F.col("confirm"), job("fetch", fetch_kind, 2))))
    linked = F.when(F.col("url").startswith("http"), wanted)
    rows = hits.select("entity", "url", F.explode(linked).alias("_j")).select("entity", "url", "_j.*")
    if known is not None:
        seq = hits.schema["seq"].dataType
        own = known.filter(F.col("website").startswith("http")).select(
            "entity", F.col("website").alias("url"), F.lit("explore").alias("job"), F.lit("other").alias("kind"),
            F.struct(F.lit(0).alias("tier"), F.lit(None).cast(seq).alias("at")).alias("order"))
        rows = rows.unionByName(own)
    return first_row(rows, ["entity", "url"], F.col("order"))


# --- payloads of a search service --------------------------------------------------

PAYLOAD = (
    "struct<candidates: array<struct<"
    "content: struct<parts: array<struct<text: string>>>,"
    "groundingMetadata: struct<groundingChunks: array<struct<web: struct<uri: string, url: string>>>>,"
    "grounding_metadata: struct<grounding_chunks: array<struct<web: struct<uri: string, url: string>>>>>>>"
)
HITS = "struct<hits: array<struct<title: string, url: string, snippet: string>>>"


def json_object(text: Column | str) -> Column:
    """Outermost braces of a noisy text, null when there are none."""
    found = F.regexp_extract(v.col(text), r"(?s)(\{.*\})", 1)
    return F.nullif(found, F.lit(""))


def payload_urls(payload: Column | str) -> Column:
    """Usable URLs of a nested payload in first-seen order: listed, grounded, in prose."""
    doc = F.from_json(v.col(payload), PAYLOAD)
    none = F.array().cast("array<string>")
    texts = F.flatten(F.transform(F.coalesce(doc["candidates"], F.from_json(F.lit('{"candidates":[]}'), PAYLOAD)["candidates"]), lambda c: F.coalesce(
        F.transform(F.filter(c["content"]["parts"], lambda p: v.first_text(p["text"]).isNotNull()), lambda p: p["text"]), none)))
    text = F.array_join(texts, "\n")
    listed = F.coalesce(F.transform(F.from_json(json_object(text), HITS)["hits"], lambda h: h["url"]), none)

    def chunk_urls(c: Column) -> Column:
        chunks = F.coalesce(c["groundingMetadata"]["groundingChunks"], c["grounding_metadata"]["grounding_chunks"])
        return F.coalesce(F.transform(chunks, lambda g: v.first_text(g["web"]["uri"], g["web"]["url"])), none)

    grounded = F.coalesce(F.flatten(F.transform(doc["candidates"], chunk_urls)), none)
    every = F.concat(listed, grounded, urls.prose_urls(text))
    return F.array_distinct(F.filter(every, lambda u: u.isNotNull() & usable_url(u)))


def recorded_answers(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Recorded hits of the asked queries, rows without a URL dropped.

    Answers: query and an array of hits, one row per query text.
    """
    hits = answers.select("query", F.posexplode("hits").alias("pos", "hit")).filter(
        v.first_text("hit.url").isNotNull())
    joined = queries.join(hits, "query")
    return joined.select(*queries.columns, "pos", "hit.*")
