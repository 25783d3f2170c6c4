"""Document records: visibility, lineage, editions, twins, changes, reviews, links.

Canonical columns: id, entity, region, kind, title, edition, source_url,
completeness, review_status, part_of, published_at, retrieved_at, summary, media,
content_sha256, text_sha256, images_sha256, preserved_url, mirrors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainledger.functions import urls
from plainledger.functions import values as v
from plainledger.operators.skew import hot_of, spread_join
from plainledger.rules import documents as rules
from plainledger.session import cut, discard


# --- predicates ------------------------------------------------------------

def review_of(review: Column | str) -> Column:
    return F.coalesce(v.first_text(review), F.lit("pending"))


def listed(review: Column | str) -> Column:
    return review_of(review).isin(*rules.LISTED)


def feed_visible(review: Column | str, kind: Column | str, completeness: Column | str) -> Column:
    return listed(review) & (
        v.yes(v.col(kind).isin(*rules.PASS_KINDS)) | v.yes(v.col(completeness) == "complete")
    )


def verified_plan(review: Column | str, kind: Column | str, completeness: Column | str) -> Column:
    return listed(review) & v.yes(v.col(kind).isin(*rules.WORK_KINDS)) & v.yes(v.col(completeness) == "complete")


def pending_plan(review: Column | str, kind: Column | str, completeness: Column | str) -> Column:
    return (
        (review_of(review) == "pending") & v.yes(v.col(kind).isin(*rules.PENDING_KINDS))
        & v.yes(v.col(completeness) == "complete")
    )


def name_blob(title: Column | str, ident: Column | str) -> Column:
    text = F.concat_ws(" ", F.coalesce(v.col(title), F.lit("")), v.col(ident).cast("string"))
    return F.translate(F.lower(text), "_-", "  ")


def has_work_key(kind: Column | str, entity: Column | str) -> Column:
    return v.yes(v.col(kind).isin(*rules.WORK_KINDS)) & v.first_text(v.col(entity).cast("string")).isNotNull()


def is_whole_work() -> Column:
    """A whole plan, not a named chapter of one."""
    blob = name_blob("title", "id")
    chapter = v.any_of(*[blob.contains(w) for w in rules.CHAPTER_WORDS])
    return (
        has_work_key("kind", "entity")
        & v.first_text(F.col("part_of").cast("string")).isNull() & ~chapter
    )


def is_volume() -> Column:
    blob = name_blob("title", "id")
    return v.any_of(*[blob.contains(w) for w in rules.VOLUME_WORDS])


# --- hierarchy and editions ---------------------------------------------------

def hierarchy_roots(docs: DataFrame) -> DataFrame:
    """(id, root) for every document by following `part_of` upwards.

    A missing parent ends a chain. A walk that runs into a cycle ends where its next
    step would be a parent it has seen: an id on a cycle is its own root, an id below
    one takes the cycle id that comes just before its entry point. So the chains are
    climbed once, and the ids under a cycle once more with the cycle's links left out.
    """
    links = docs.select("id", F.col("part_of").alias("up")).filter(F.col("up").isNotNull())
    known = docs.select(F.col("id").alias("up"))
    links = cut(links.join(known, "up", "left_semi"))
    done, circling = _climb(links)
    scratch = [links, done]
    if circling is not None:
        # After as many steps as there are links, a walk stands on a cycle, and every cycle id is stood on.
        ring = cut(circling.select(F.col("up").alias("id")).distinct())
        below = cut(links.join(circling.select("id"), "id", "left_semi").join(ring, "id", "left_anti"))
        entries, _ = _climb(below)
        before = links.join(ring, "id", "left_semi").select("up", F.col("id").alias("_last"))
        under = entries.join(before, "up").select("id", F.col("_last").alias("up"))
        done = done.unionByName(under)
        scratch += [circling, ring, below, entries]
    roots = done.select("id", F.col("up").alias("root"))
    out = cut(docs.select("id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    discard(*scratch)
    return out


def _climb(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Ids with the end of their chain, and those that go in circles (None if there are none).

    Pointer doubling: each round doubles the distance looked ahead, so it takes about
    log2 of the number of links in rounds at most. Each round goes straight into a written
    table, so adaptive execution is free to split a parent that holds many children;
    the table before it is then deleted.
    """
    n = links.count()
    state = cut(links.withColumn("open", F.lit(True)))
    for _ in range(n.bit_length() + 1):
        table = state.select(F.col("id").alias("up"), F.col("up").alias("_further"))
        moved = state.filter("open").join(table, "up", "left")
        further = moved.select("id", F.coalesce("_further", "up").alias("up"), F.col("_further").isNotNull().alias("open"))
        before, state = state, cut(state.filter("not open").unionByName(further))
        discard(before)
        if state.filter("open").isEmpty():
            return state.drop("open"), None
    return state.filter("not open").drop("open"), state.filter("open").drop("open")


def edition_year(edition: Column | str) -> Column:
    runs = F.regexp_extract_all(F.coalesce(v.col(edition), F.lit("")), F.lit(r"\d+"), F.lit(0))
    years = F.transform(F.filter(runs, lambda x: F.length(x) == 4), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(years), F.lit(0))


def study_year(ident: Column | str, edition: Column | str) -> Column:
    parts = F.split(v.col(ident).cast("string"), "[-_]")
    own = F.try_element_at(F.filter(parts, lambda x: x.rlike(r"^\d{4}$")), F.lit(1)).cast("int")
    return F.coalesce(own, edition_year(edition))


def recency() -> Column:
    return F.struct(
        F.coalesce(F.col("published_at").cast("string"), F.lit("")).alias("published"),
        edition_year("edition").alias("year"),
        F.coalesce(F.col("retrieved_at").cast("string"), F.lit("")).alias("retrieved"),
        F.coalesce("edition", F.lit("")).alias("edition"),
        F.coalesce(v.first_text("title"), F.col("id").cast("string")).alias("name"),
    )


def part_order(title: Column | str, ident: Column | str) -> Column:
    """Reading order of a part: contents, introduction, chapters, others, appendices."""
    blob = name_blob(title, ident)
    chapter = F.regexp_extract(blob, rules.CHAPTER_NUMBER, 1)
    letter = F.regexp_extract(blob, rules.APPENDIX_LETTER, 1)
    name = F.coalesce(v.first_text(title), v.col(ident).cast("string"))

    def place(group: int, number: Column) -> Column:
        return F.struct(F.lit(group).alias("part_group"), number.cast("long").alias("part_number"), name.alias("part_name"))

    number = F.coalesce(chapter.try_cast("long"), v.lookup(v.NUMBER_WORDS, F.lower(chapter)).cast("long"))
    return (
        F.when(blob.contains("table of contents"), place(0, F.lit(0)))
        .when(chapter != "", place(1, number))
        .when(blob.contains("introduction"), place(0, F.lit(1)))
        .when(letter != "", place(3, F.ascii(F.lower(letter))))
        .otherwise(place(2, F.lit(50)))
    )


def edition_members(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """Plan documents with the study they belong to: (entity, kind, study_year)."""
    root_years = (
        docs.select(F.col("id").alias("root"), study_year("id", "edition").alias("_root_year"))
    )
    rooted = spread_join(
        docs.join(roots, "id"), root_years, ["root"], F.col("id"), "left"
    )
    year = F.coalesce(v.number_or_null("_root_year"), study_year("id", "edition"))
    return rooted.filter(has_work_key("kind", "entity")).withColumn("study_year", year).drop("_root_year", "root")


WORK = ("entity", "kind", "study_year")


def edition_works(members: DataFrame) -> DataFrame:
    """One row per study: hub, parts, title, edition, and its place among the others.

    Hub: newest core whole, else newest whole. Title and edition come from the hub,
    else from the most frequent value of the parts, the first seen winning ties.
    """
    tagged = members.withColumn("_whole", is_whole_work()).withColumn("_volume", is_volume()).withColumn(
        "_recency", recency()
    )
    order = F.struct(F.col("_recency"), (-F.col("seq")).alias("first"))
    picked = F.struct("id", "title", "edition", "summary")
    core = F.col("_whole") & ~F.col("_volume")
    heads = tagged.groupBy(*WORK).agg(
        F.max_by(picked, F.when(core, order)).alias("_core"),
        F.max_by(picked, F.when(F.col("_whole"), order)).alias("_any"),
        F.max("_recency").alias("_recency"),
        F.count(F.lit(1)).alias("n_documents"),
    )
    heads = heads.withColumn("hub", F.coalesce("_core", "_any")).drop("_core", "_any")
    title = F.trim(F.coalesce("title", F.lit("")))
    bare = F.btrim(F.regexp_replace(title, rules.PART_TAIL, ""), F.lit(" -"))
    name = F.coalesce(v.first_text(bare), v.first_text(title), F.col("id").cast("string"))
    names = first_mode(members.withColumn("_name", name), WORK, "_name", "seq")
    editions = first_mode(members.filter(v.first_text("edition").isNotNull()), WORK, "edition", "seq")
    works = (
        heads.join(names.withColumnRenamed("_name", "_part_title"), list(WORK), "left")
        .join(editions.withColumnRenamed("edition", "_part_edition"), list(WORK), "left")
    )
    # At most one study per four-digit year, so this window stays small.
    rank = F.row_number().over(Window.partitionBy("entity", "kind").orderBy(F.col("_recency").desc(), F.col("study_year").desc()))
    return works.select(
        *WORK, "n_documents",
        F.col("hub.id").alias("hub_id"),
        F.coalesce(v.first_text("hub.title"), "_part_title").alias("title"),
        F.coalesce(v.first_text("hub.edition"), "_part_edition").alias("edition"),
        F.col("hub.summary").alias("summary"),
        F.col("_recency").alias("recency"),
        rank.alias("work_rank"),
    )


def work_parts(members: DataFrame, works: DataFrame) -> DataFrame:
    """Parts of every study in reading order, as rows.

    The order is a range sort over all studies, so a hot study spans many tasks.
    """
    hubs = works.filter(F.col("hub_id").isNotNull()).select(F.col("hub_id").alias("id"))
    parts = members.join(hubs, "id", "left_anti").select(*WORK, "id", part_order("title", "id").alias("place"))
    return parts.select(*WORK, "id", "place.*").orderBy(*WORK, "part_group", "part_number", "part_name", "id")


def first_mode(df: DataFrame, keys, column: str, seq: str) -> DataFrame:
    """Most frequent value per key; among equals the one seen first."""
    counts = df.groupBy(*keys, column).agg(
        F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first")
    )
    return counts.groupBy(*keys).agg(
        F.max_by(column, F.struct("_n", (-F.col("_first")).alias("_early"))).alias(column)
    )


# --- statuses per entity -------------------------------------------------------

def best_completeness(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Best status of the listed plans per entity; missing when there is none."""
    rank = F.coalesce(v.lookup(rules.COMPLETENESS_RANK, F.col("completeness")), F.lit(0))
    plans = docs.filter(F.col("kind").isin(*rules.WORK_KINDS) & listed("review_status"))
    best = plans.groupBy("entity").agg(F.max(F.struct(rank.alias("r"), F.col("completeness").alias("s"))).alias("_best"))
    status = F.when(F.col("_best.r") > 0, F.col("_best.s")).otherwise("missing")
    return (
        entities.select(F.col("key").alias("entity")).join(best, "entity", "left")
        .select("entity", status.alias("completeness"))
    )


def entities_with_verified_plans(entities: DataFrame, docs: DataFrame) -> DataFrame:
    good = docs.filter(verified_plan("review_status", "kind", "completeness"))
    return entities.join(good.select(F.col("entity").alias("key")), "key", "left_semi")


def entities_with_data(docs: DataFrame, grants: DataFrame) -> DataFrame:
    plans = docs.filter(has_work_key("kind", "entity")).select("entity")
    return plans.union(grants.filter(F.col("entity").isNotNull()).select("entity")).distinct()


def page_order(docs: DataFrame) -> DataFrame:
    """Listed documents per entity by kind, then title."""
    rank = F.coalesce(v.lookup(rules.KIND_ORDER, F.col("kind")), F.lit(9))
    name = F.coalesce(v.first_text("title"), F.col("id").cast("string"))
    return (
        docs.filter(listed("review_status"))
        .withColumn("kind_rank", rank).withColumn("name", name)
        .orderBy("entity", "kind_rank", "name", "id")
    )


# --- twins, prior editions, changes ---------------------------------------------

def content_twins(docs: DataFrame) -> DataFrame:
    """Earlier document of the same entity with equal text and images, if any.

    Only repeated contents are joined back, and a hot group of copies is spread.
    """
    keys = ["entity", "text_sha256", "images_sha256"]
    full = docs.filter(v.all_of(*[F.col(k).isNotNull() for k in keys])).select("id", "seq", *keys)
    counted = full.groupBy(*keys).agg(F.min_by("id", "seq").alias("twin_id"), F.count(F.lit(1)).alias("_n"))
    groups = counted.filter(F.col("_n") > 1).drop("_n")
    # The hot contents follow from the counts at hand.
    joined = spread_join(full, groups, keys, F.col("id"), "inner", hot_of(counted))
    return joined.filter(F.col("id") != F.col("twin_id")).select("id", "twin_id")


def prior_editions(docs: DataFrame) -> DataFrame:
    """Newest other whole work of the same entity and kind at another URL.

    The two newest URLs per work answer it for every member, so no pairs are built:
    a member takes the newest, or the second when it is at the newest one's URL.
    """
    group = ["entity", "kind"]
    wholes = docs.filter(is_whole_work())
    age = F.struct(
        F.coalesce("edition", F.lit("")).alias("e"),
        F.coalesce(F.col("retrieved_at").cast("string"), F.lit("")).alias("r"),
        (-F.col("seq")).alias("s"),
    )
    per_url = wholes.groupBy(*group, "source_url").agg(
        F.max_by("id", age).alias("prior_id"), F.max(age).alias("_age"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_age").desc()))
    top = per_url.withColumn("_rank", rank).filter(F.col("_rank") <= 2)
    pair = top.groupBy(*group).agg(
        F.max(F.when(F.col("_rank") == 1, F.struct("source_url", "prior_id"))).alias("_newest"),
        F.max(F.when(F.col("_rank") == 2, F.struct("source_url", "prior_id"))).alias("_second"),
    )
    joined = spread_join(wholes.select("id", "source_url", *group), pair, group, F.col("id"), "left")
    prior = F.when(F.col("source_url") != F.col("_newest.source_url"), F.col("_newest.prior_id")).otherwise(
        F.col("_second.prior_id"))
    return joined.select("id", prior.alias("prior_id"))


def content_changed(old_text: Column, old_images: Column, new_text: Column, new_images: Column) -> Column:
    """Whether text or images differ; null when there is nothing to compare."""
    nothing = (v.first_text(old_text).isNull() & v.first_text(old_images).isNull()) | (
        v.first_text(new_text).isNull() | v.first_text(new_images).isNull())
    differs = ~old_text.eqNullSafe(new_text) | ~old_images.eqNullSafe(new_images)
    return F.when(~nothing, differs)


def change_note(bytes_changed: Column, differs: Column) -> Column:
    return F.when(
        bytes_changed,
        F.when(differs, rules.NOTE_CHANGED).when(~differs, rules.NOTE_SAME).otherwise(rules.NOTE_BYTES),
    )


def change_events(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Events for documents whose stored bytes differ from the incoming ones."""
    hashes = ("content_sha256", "text_sha256", "images_sha256")
    old = current.select("id", *[F.col(h).alias(f"old_{h}") for h in hashes])
    joined = incoming.join(old, "id")
    changed = (v.first_text("old_content_sha256").isNotNull()) & (F.col("content_sha256") != F.col("old_content_sha256"))
    differs = content_changed(
        F.col("old_text_sha256"), F.col("old_images_sha256"), F.col("text_sha256"), F.col("images_sha256"))
    return joined.filter(changed).select(
        F.concat(F.col("id").cast("string"), F.lit("-"), F.substring("content_sha256", 1, 12)).alias("event_id"),
        F.col("id").alias("document_id"),
        F.col("old_content_sha256").alias("from_sha256"),
        F.col("content_sha256").alias("to_sha256"),
        change_note(F.lit(True), differs).alias("note"),
    )


# --- reviews and patches ---------------------------------------------------------

def review_after_snapshot(previous: Column | str) -> Column:
    return F.when(v.col(previous).isin(*rules.KEPT_REVIEWS), v.col(previous)).otherwise("pending")


def review_after_vet(official: Column, same: Column, kind: Column) -> Column:
    return F.when(v.yes(kind.isin(*rules.VETTED_KINDS)) & official & same, "auto_pass").otherwise("pending")


def review_transition(requested: Column, authority: Column) -> tuple[Column, Column]:
    """(status, error) of a requested review status under an authority."""
    error = (
        F.when(~v.yes(requested.isin(*rules.REVIEWS)), F.concat(F.lit("unknown review status: "), F.coalesce(requested, F.lit(""))))
        .when(~v.yes(authority.isin("machine", "operator")), F.concat(F.lit("unknown review authority: "), F.coalesce(authority, F.lit(""))))
        .when((authority == "machine") & ~requested.isin(*rules.MACHINE_REVIEWS),
              F.concat(F.lit("machine cannot set review status: "), requested))
    )
    return F.when(error.isNull(), requested), error


def apply_reviews(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Operator review requests against the current records: accepted, stale or invalid.

    Requests: id, requested, expected_sha256.
    """
    state = docs.select("id", "completeness", "content_sha256", F.lit(True).alias("_known"))
    joined = requests.join(state, "id", "left")
    status, fault = review_transition(F.col("requested"), F.lit("operator"))
    publishing = F.col("requested").isin("auto_pass", "published")
    stale = v.first_text("expected_sha256").isNull() | ~F.col("content_sha256").eqNullSafe(F.col("expected_sha256"))
    outcome = (
        F.when(F.col("_known").isNull() | fault.isNotNull(), "invalid")
        .when((F.col("requested") == "curated") & (F.col("completeness") != "link_only"), "invalid")
        .when(publishing & (F.col("completeness") != "complete"), "invalid")
        .when(publishing & stale, "stale_review")
        .otherwise("accepted")
    )
    return joined.withColumn("outcome", outcome).withColumn(
        "review_status", F.when(F.col("outcome") == "accepted", status)
    ).drop("_known", "completeness", "content_sha256")


def source_issues(failures: DataFrame, docs: DataFrame) -> DataFrame:
    """Patch rows for failed refetches of listed documents.

    The candidate hash is kept only when it differs from the stored one.
    """
    state = docs.filter(listed("review_status")).select("id", "content_sha256")
    candidate = F.when(~F.col("candidate_sha256").eqNullSafe(F.col("content_sha256")), F.col("candidate_sha256"))
    return failures.join(state, "id").select(
        "id", "source_status", F.col("at").alias("source_retrieved_at"),
        candidate.alias("source_candidate_sha256"), F.col("issue").alias("source_issue"))


def visible_supersedes(docs: DataFrame) -> DataFrame:
    """Keep a superseded-document link only when its target is listed."""
    targets = docs.select(F.col("id").alias("supersedes"), listed("review_status").alias("_seen"))
    joined = spread_join(docs, targets, ["supersedes"], F.col("id"), "left")
    return joined.withColumn("supersedes", F.when(F.col("_seen"), F.col("supersedes"))).drop("_seen")


def preview(official: bool = False) -> Column:
    """Inline file of a document page: (src, media, origin), null when there is none."""
    media = urls.inferred_media("media", "source_url")
    zoom = F.concat(F.substring_index("preserved_url", "#", 1), F.lit("#zoom=page-width"))
    saved = F.struct(
        F.when(media == "pdf", zoom).otherwise(F.col("preserved_url")).alias("src"),
        media.alias("media"), F.lit("saved").alias("origin"))
    local = F.struct(
        F.concat(F.lit("/files/preview/"), F.col("id").cast("string"), F.lit(".pdf#zoom=page-width")).alias("src"),
        media.alias("media"), F.lit("official").alias("origin"))
    shown = media.isin("pdf", "html") & ~v.yes(F.col("kind") == "notice")
    reach = (media == "pdf") & ~v.yes(F.col("source_status") == "dead") & v.text_or_null("source_url").isNotNull()
    return F.when(shown & v.first_text("preserved_url").isNotNull(), saved).when(
        shown & reach & F.lit(official), local)


# --- incremental recompute --------------------------------------------------------

def stale_month(stamp: Column | str, now: Column, zone: str = "America/Los_Angeles") -> Column:
    """Missing, unreadable, or from another calendar month in the zone."""
    def month(t: Column) -> Column:
        return F.date_trunc("month", F.from_utc_timestamp(t, zone))

    return ~v.yes(month(v.col(stamp)) == month(now))


def recompute_stale(keys: DataFrame, stored: DataFrame, compute, now: Column) -> DataFrame:
    """Rows for keys with data: stored ones kept while current, the rest recomputed.

    `compute` maps a DataFrame of keys to fresh rows with the stored columns.
    Stored rows of keys without data are kept.
    """
    current = stored.filter(~stale_month("generated_at", now)).select("entity")
    due = keys.select("entity").distinct().join(current, "entity", "left_anti")
    kept = stored.join(due, "entity", "left_anti")
    return kept.unionByName(compute(due))
