"""Search records: union, change sets, scoped search, feeds, completeness, queries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainledger.functions import urls
from plainledger.functions import values as v
from plainledger.operators import documents as doc
from plainledger.operators import funding
from plainledger.operators.registry import first_row
from plainledger.session import cut

# Columns of a search record, kinds of a scope, hit limits, bands.
COLUMNS = (
    "id", "type", "title", "url", "region", "entity", "kind", "completeness", "outlook", "summary",
    "text", "document_id", "page",
)
SCOPE_KINDS = ("master_plan", "alp", "other")
BANDS = ("declining", "growing", "maintaining")
SUGGEST_LIMIT = 8
MAX_HITS = 100
SLUG_CHARS = 80
GRAM = 3
# Postings of a gram and group that a search confirms first, and how many times as many next.
HEADS = 64
DEEPER = 16
# Bits of the filter of grams that the tasks get, however many grams there are; bits of
# a character in a gram's number; characters of records that a task looks at together.
FILTER_BITS = 22
CHAR_BITS = 21
PIECE_CHARS = 1 << 20


def _record(**fields: Column) -> list[Column]:
    types = {"page": "int"}
    return [
        (fields[c] if c in fields else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in COLUMNS]


def entity_records(entities: DataFrame) -> DataFrame:
    """Entities: key, name, city, region, role, outlook."""
    key = F.col("key").cast("string")
    band = F.when(F.col("outlook").isin(*BANDS), F.col("outlook"))
    text = v.joined(" ", F.col("city"), F.col("role"), F.concat(F.lit("planning outlook "), band))
    return entities.select(*_record(
        id=F.concat(F.lit("airport-"), key), type=F.lit("airport"), title=F.concat_ws(" ", key, "name"),
        url=F.concat(F.lit("/airports/"), key, F.lit("/")), region=F.col("region"), entity=key, outlook=band,
        summary=F.lit(""), text=text))


def region_records(regions: DataFrame) -> DataFrame:
    """Regions: code, name, agency."""
    code = F.col("code").cast("string")
    return regions.select(*_record(
        id=F.concat(F.lit("state-"), code), type=F.lit("state"), title=F.col("name"),
        url=F.concat(F.lit("/states/"), code, F.lit("/")), region=code, summary=F.lit(""),
        text=v.joined(" ", code, F.col("agency"), F.lit("budget law awards"))))


def document_records(docs: DataFrame) -> DataFrame:
    key = F.col("id").cast("string")
    return docs.filter(doc.listed("review_status")).select(*_record(
        id=F.concat(F.lit("document-"), key), type=F.lit("document"), title=F.coalesce(v.first_text("title"), key),
        url=F.concat(F.lit("/documents/"), key, F.lit("/")), region=F.col("region"), entity=F.col("entity"),
        kind=F.col("kind"), completeness=F.col("completeness"), summary=F.coalesce("summary", F.lit("")),
        text=v.joined(" ", key, F.col("kind"), F.col("edition"), F.col("summary")), document_id=key))


def page_records(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages: id (of the document), page, text. Hidden documents and notices carry none."""
    key = F.col("id").cast("string")
    shown = docs.filter(doc.listed("review_status") & ~v.yes(F.col("kind") == "notice") & v.first_text("content_sha256").isNotNull())
    joined = pages.select("id", "page", F.col("text").alias("_text")).join(shown, "id")
    stored = v.first_text("preserved_url")
    url = F.coalesce(F.concat(stored, F.lit("#page="), F.col("page")), F.concat(F.lit("/documents/"), key, F.lit("/")))
    return joined.select(*_record(
        id=F.concat_ws("-", F.lit("page"), key, F.col("page")), type=F.lit("page"),
        title=F.concat(F.coalesce(v.first_text("title"), key), F.lit(" p. "), F.col("page")), url=url,
        region=F.col("region"), entity=F.col("entity"), kind=F.col("kind"), completeness=F.col("completeness"),
        summary=F.coalesce("summary", F.lit("")), text=F.col("_text"), document_id=key, page=F.col("page")))


def slug_id(slug: Column, chars: int = SLUG_CHARS) -> Column:
    """A slug of up to `chars` characters; a longer one is cut and gets a hash of the whole, so ids stay apart."""
    tail = F.concat(F.lit("-"), F.substring(F.md5(slug), 1, 12))
    return F.when(F.length(slug) > chars, F.concat(F.substring(slug, 1, chars), tail)).otherwise(slug)


def funding_records(grants: DataFrame) -> DataFrame:
    """Grants: entity, grant_number, description, fiscal_year, region, programs (text)."""
    title = funding.grant_title("description")
    number = F.coalesce(v.first_text("grant_number"), F.concat_ws("-", "entity", "fiscal_year", title))
    key = F.col("entity").cast("string")
    return grants.filter(F.col("entity").isNotNull()).select(*_record(
        id=F.concat(F.lit("funding-"), slug_id(v.slug(number))), type=F.lit("funding"),
        title=F.concat_ws(" ", key, title), url=F.concat(F.lit("/airports/"), key, F.lit("/#funding")),
        region=F.col("region"), entity=key, kind=F.lit("funding"), summary=F.lit(""),
        text=v.joined(" ", F.col("grant_number"), F.col("description"), F.col("programs"))))


def union_records(parts: Sequence[DataFrame], generation: str) -> DataFrame:
    """All records in one schema, stamped with their generation."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("_generation", F.lit(generation))


def completeness_gate(records: DataFrame, expected: int | DataFrame, generation: str) -> DataFrame:
    """One row: records, records of the generation, least expected, verdict."""
    counts = records.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_generation") == generation).alias("n_generation"))
    want = expected if isinstance(expected, DataFrame) else counts.sparkSession.createDataFrame([(expected,)], "minimum long")
    joined = counts.join(F.broadcast(want))
    return joined.withColumn("ok", (F.col("n") >= F.col("minimum")) & (F.col("n") == F.col("n_generation")))


def apply_document_changes(records: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Records of changed documents go, their fresh ones come; hidden ones only go."""
    gone = changed.select(F.col("id").cast("string").alias("_gone"))
    # Records without a document match nothing; their own ids keep them out of one task.
    own = F.coalesce("document_id", F.concat(F.lit("\x00"), "id"))
    return records.join(gone, own == F.col("_gone"), "left_anti").unionByName(fresh)


def refresh_entities(records: DataFrame, entities: DataFrame, generation: str, keys: DataFrame | None = None) -> DataFrame:
    """Records with those of the entities `keys` names made anew; without keys, of all entities.

    A refreshed record replaces the one with its id or is added. Records of other
    entities stay as they are, and so does one whose entity is no longer in the table.
    """
    chosen = entities if keys is None else entities.join(keys.select("key"), "key", "left_semi")
    fresh = entity_records(chosen).withColumn("_generation", F.lit(generation))
    return records.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def missing_projections(stored: DataFrame, projections: DataFrame) -> DataFrame:
    """Stored contents without a text projection of the same manifest."""
    keys = ["content_sha256", "manifest_key", "manifest_sha256"]
    return stored.join(projections.select(*keys), keys, "left_anti")


def runs(text: Column) -> Column:
    """Distinct runs of GRAM characters of a text, with the shorter ones at its end."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{GRAM}}}))"), F.lit(1)))


def gram_number(gram: str) -> int:
    """A gram as one number: its characters' codes and one more, so that none is zero."""
    codes = [ord(c) + 1 for c in gram] + [0] * (GRAM - len(gram))
    return sum(c << CHAR_BITS * (GRAM - 1 - i) for i, c in enumerate(codes))


def gram_text(number: int) -> str:
    codes = [number >> CHAR_BITS * i & (1 << CHAR_BITS) - 1 for i in reversed(range(GRAM))]
    return "".join(chr(c - 1) for c in codes if c)


def _bit(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)


def _salts(batch) -> np.ndarray:
    """A number for each row of a batch, the same for rows of one group."""
    known: dict[tuple, int] = {}
    groups = zip(*(batch.column(c).to_pylist() for c in GROUP))
    return np.array([known[g] if g in known else known.setdefault(g, zlib.crc32(repr(g).encode())) for g in groups], dtype=np.int64)


def gram_filter(asked: DataFrame) -> tuple[np.ndarray, bool]:
    """A bit for every gram asked for, in a table of fixed size; and whether some are shorter than GRAM.

    It spares the tasks most grams that nobody asked for; a join by the grams follows. Grams
    asked for in some groups only have bits for those.
    """
    import pyarrow as pa

    grouped = set(GROUP) <= set(asked.columns)

    def bits(batches: Iterator) -> Iterator:
        for batch in batches:
            numbers = np.array([gram_number(g) for g in batch.column("gram").to_pylist()], dtype=np.int64)
            bit = _bit(numbers ^ _salts(batch) if grouped else numbers)
            yield pa.RecordBatch.from_arrays([pa.array(bit.astype(np.int64) + 1)], names=["bit"])

    table = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
    parts = asked.select("gram", *(GROUP if grouped else ())).mapInArrow(bits, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    for row in parts.collect():
        part = np.frombuffer(row["bits"], dtype=np.uint8)[: len(table)]
        at = (row["bucket"] - 1) * 4096
        table[at: at + len(part)] = part
    return table, not asked.filter(F.length("gram") < GRAM).isEmpty()


def _found_grams(hays, bits: np.ndarray, short: bool, salts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(rows, places, grams) of the texts of a batch: row rows[i] holds grams[places[i]], each pair once."""
    at = 0
    while at < len(hays):
        texts, size, first = [], 0, at
        while at < len(hays) and size < PIECE_CHARS:
            texts.append(hays[at].as_py())
            size += len(texts[-1])
            at += 1
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        # Every text ends in zeros, so that runs at its end are the shorter ones.
        starts = np.arange(len(rows)) + (GRAM - 1) * rows
        codes = np.zeros(len(rows) + (GRAM - 1) * len(texts), dtype=np.int64)
        codes[starts] = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64) + 1
        numbers = np.zeros(len(rows), dtype=np.int64)
        for n in range(GRAM):
            numbers = numbers << CHAR_BITS | codes[starts + n]
        if short:
            every = [numbers >> CHAR_BITS * n << CHAR_BITS * n for n in range(GRAM)]
            numbers = np.concatenate([*every, np.zeros(len(texts), dtype=np.int64)])
            rows = np.concatenate([rows] * GRAM + [np.arange(len(texts))])
        bit = _bit(numbers if salts is None else numbers ^ salts[first + rows])
        asked = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        known, places = np.unique(numbers[asked], return_inverse=True)
        if len(known):
            pairs = np.unique(rows[asked] * len(known) + places)
            yield first + pairs // len(known), pairs % len(known), [gram_text(int(k)) for k in known]


# What a scope can tell records apart by: postings are kept per group of equal values.
GROUP = ("type", "_shown", "outlook")


def group_counts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, type, _shown, outlook, n) of the grams asked for: how many records of a group hold one.

    Counted in the tasks, so that no posting of a frequent gram leaves them.
    """
    import pyarrow as pa

    bits, short = gram_filter(asked)

    def count(batches: Iterator) -> Iterator:
        for batch in batches:
            groups: dict[tuple, int] = {}
            of = np.array([groups.setdefault(g, len(groups)) for g in zip(*(batch.column(c).to_pylist() for c in GROUP))], dtype=np.int64)
            names = list(groups)
            for at, places, found in _found_grams(batch.column("_hay"), bits, short):
                both, n = np.unique(places * len(names) + of[at], return_counts=True)
                owners = [names[i] for i in both % len(names)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([found[i] for i in both // len(names)], pa.string()),
                     *(pa.array([o[k] for o in owners], pa.string()) for k in range(len(GROUP))), pa.array(n, pa.int64())],
                    names=["gram", *GROUP, "n"])

    schema = ", ".join(f"{c} string" for c in ("gram", *GROUP)) + ", n long"
    parts = rows.select(*GROUP, "_hay").mapInArrow(count, schema).groupBy("gram", *GROUP).agg(F.sum("n").alias("n"))
    return parts.join(asked, "gram", "left_semi")


def postings(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, id, type, _shown, outlook, cls) of the grams asked for in a group, without texts.

    Asked: gram, type, _shown, outlook.

    `cls` is the best attribute a needle with that gram can have in the record: key,
    title, or text and beyond.
    """
    import pyarrow as pa

    bits, short = gram_filter(asked)
    kept = ["id", *GROUP, "_key", "_name"]

    def post(batches: Iterator) -> Iterator:
        for batch in batches:
            others = batch.select(kept)
            for at, places, found in _found_grams(batch.column("_hay"), bits, short, _salts(batch)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()).take(pa.array(places)), *others.take(pa.array(at)).columns], names=["gram", *kept])

    own = rows.withColumn("_key", F.lower("entity")).withColumn("_name", F.lower("title"))
    best = F.when(v.yes(F.contains("_key", F.col("gram"))), 1).when(v.yes(F.contains("_name", F.col("gram"))), 2).otherwise(3)
    found = own.select(*kept, "_hay").mapInArrow(post, ", ".join(f"{c} string" for c in ("gram", *kept)))
    return found.join(*_same(asked, ("gram", *GROUP)), "left_semi").select("gram", "id", *GROUP, best.alias("cls"))


def in_scope() -> Column:
    """Whether a record of a group belongs to a query's scope."""
    banded = F.coalesce("_band", F.lit("")) != ""
    return (
        F.when(banded, (F.col("type") == "airport") & v.yes(F.col("outlook") == F.col("_band")))
        .when(F.col("scope") == "plans", F.col("_shown").isin(*SCOPE_KINDS))
        .when(F.col("scope") == "projects", F.col("type") == "funding").otherwise(F.lit(True)))


def confirmed(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, id, type, title, url, attribute) of the pairs (query_id, needle, id) whose record holds the needle."""
    # Written, so that the planner knows how few there are and texts need not be shuffled.
    wanted = cut(pairs.select("query_id", "needle", F.col("id").alias("_id")).distinct())

    def within(c: str) -> Column:
        return v.yes(F.contains(F.lower(F.col(c)), F.col("needle")))

    rank = F.when(within("entity"), 1).when(within("title"), 2).when(within("text"), 3).otherwise(4)
    return rows.join(wanted, (F.col("id") == F.col("_id")) & F.contains(F.col("_hay"), F.col("needle"))).select(
        "query_id", "id", "type", "title", "url", rank.alias("attribute"))


def search(records: DataFrame, queries: DataFrame, limit: int = SUGGEST_LIMIT, offset: int = 0, heads: int = HEADS) -> DataFrame:
    """Case-insensitive substring search: per query the hits after `offset`, at most `limit`, none beyond MAX_HITS.

    Queries: query_id, needle, scope (all, plans, projects) and outlook, as many as
    there are. Rank: key, title, text, summary, then id. An empty needle is in every
    record, a null one in none.

    Equi joins over postings only. Grams are counted first, by group. A group that lacks a
    gram of a needle has no record with it; in every other group the needle takes its rarest
    gram there, and only those get postings. A needle shorter than a gram is a gram itself.
    Of a gram's postings the first `heads` of every group come first, in the order of the
    best attribute they can have, then DEEPER times as many, in the end all; only the best
    ones are kept before that. They are confirmed against the records, and a query is done
    if its groups have no more or if its last wanted hit ranks no later than all that was
    left out: so a needle that every record holds costs its heads, one that shares its gram
    with others a few times as many. Only the other queries, with a rare needle of common
    grams, meet the rest of their postings, and of those only what can still enter the result.
    """
    last, keys = min(offset + limit, MAX_HITS), ("gram", *GROUP)
    asked = queries.select("query_id", F.lower("needle").alias("needle"), "scope", F.col("outlook").alias("_band"))
    rows = records.select(
        "id", "type", "title", "url", "kind", "outlook", "entity", "text", F.coalesce(v.first_text("kind"), F.col("type")).alias("_shown"),
        F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))).alias("_hay"))
    own = F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(
        F.filter(runs(F.col("needle")), lambda g: F.length(g) == GRAM))
    parts = cut(asked.select("needle").distinct().select("needle", F.size(own).alias("_grams"), F.explode(own).alias("gram")))
    counts = group_counts(rows, cut(parts.select("gram").distinct()))
    rarest = parts.join(counts, "gram").groupBy("needle", "_grams", *GROUP).agg(
        F.count(F.lit(1)).alias("_held"), F.min(F.struct("n", "gram")).alias("_best")).filter(F.col("_held") == F.col("_grams"))
    wanted = cut(asked.join(rarest.select("needle", *GROUP, "_best.n", "_best.gram"), "needle").filter(in_scope()).select(
        "query_id", "needle", "n", *keys))

    place, most = F.struct("cls", "id"), heads * DEEPER
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("cls", "id"))
    head = cut(postings(rows, cut(wanted.select(*keys).distinct())).withColumn("_at", at).filter(F.col("_at") <= most))
    best = F.struct(F.col("attribute").alias("cls"), "id")
    left, found, done = wanted.withColumn("_last", F.lit(None).cast("struct<cls:int,id:string>")), None, 0
    for step in (heads, most, None):
        if step is None:
            held = postings(rows, cut(left.select(*keys).distinct()))
        else:
            held = head.filter((F.col("_at") > done) & (F.col("_at") <= step))
        if done:
            held = held.join(*_same(head.filter(F.col("_at") <= done), ("id", *keys)), "left_anti")
        renamed, equal = _same(left, keys, ("query_id", "needle", "_last"))
        # Postings are the many: a join may hold the queries of one gram, not the postings.
        pairs = held.join(renamed, equal).filter(F.col("_last").isNull() | (place < F.col("_last")))
        hits = cut(confirmed(pairs, rows))
        found = hits if found is None else found.unionByName(hits)
        if step is None:
            break
        # What is left out of a group ranks after its last head, and a query's last wanted hit is one row.
        ends = head.filter(F.col("_at") == step).withColumn("_end", place)
        more, equal = _same(left.filter(F.col("n") > step).select("query_id", *keys), keys, ("query_id",))
        bounds = ends.join(more, equal).groupBy("query_id").agg(F.min("_end").alias("_end"))
        ranked = found.withColumn("_pos", F.row_number().over(Window.partitionBy("query_id").orderBy("attribute", "id")))
        lasts = ranked.filter(F.col("_pos") == last).select("query_id", best.alias("_last"))
        open_ = cut(bounds.join(lasts, "query_id", "left").filter(F.col("_last").isNull() | (F.col("_last") > F.col("_end"))))
        if open_.isEmpty():
            break
        left = wanted.filter(F.col("n") > step).join(open_.select("query_id", "_last"), "query_id")
        done = step
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("attribute", "id"))
    return found.withColumn("pos", pos).filter((F.col("pos") <= last) & (F.col("pos") > offset))


def _same(other: DataFrame, columns: Sequence[str], kept: Sequence[str] = ()) -> tuple[DataFrame, Column]:
    """A table to join by equal columns, nulls included, with the columns kept, and the condition."""
    renamed = other.select(*kept, *[F.col(c).alias(f"_on_{c}") for c in columns])
    return renamed, v.all_of(*[F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in columns])


# --- feeds and page dates -----------------------------------------------------------

def feed_items(parts: Sequence[DataFrame], limit: int = 50) -> DataFrame:
    """Items of every entity: dated newest first, then undated, up to a limit.

    Parts: entity, item, date (text or null), seq; earlier parts win among equals.
    """
    out = None
    for i, part in enumerate(parts):
        tagged = part.select("entity", "item", F.nullif(F.col("date").cast("string"), F.lit("")).alias("date"), "seq", F.lit(i).alias("part"))
        out = tagged if out is None else out.unionByName(tagged)
    order = [F.col("date").desc_nulls_last(), F.col("part"), F.col("seq")]
    place = F.row_number().over(Window.partitionBy("entity").orderBy(*order))
    return out.withColumn("pos", place).filter(F.col("pos") <= limit).drop("seq", "part")


def recently_listed(docs: DataFrame, limit: int = 12) -> DataFrame:
    shown = docs.filter(doc.feed_visible("review_status", "kind", "completeness"))
    return shown.orderBy(
        F.coalesce(F.col("retrieved_at").cast("string"), F.lit("")).desc(),
        F.when(v.first_text("summary").isNotNull(), 1).otherwise(0).desc(),
        F.coalesce("title", F.lit("")).desc(), "id").limit(limit)


def iso_day(value: Column | str) -> Column:
    """Leading `YYYY-MM-DD` of a text, null when it has none."""
    day = F.substring(F.trim(v.col(value).cast("string")), 1, 10)
    return F.when((F.length(day) == 10) & (F.substring(day, 5, 1) == "-") & (F.substring(day, 8, 1) == "-"), day)


def last_modified(dates: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Newest day per page; pages not emitted now keep their earlier day.

    Dates: loc, value. Previous: loc, day.
    """
    now = dates.groupBy("loc").agg(F.max(iso_day("value")).alias("day"))
    if previous is None:
        return now
    return now.unionByName(previous.select("loc", "day").join(now.select("loc"), "loc", "left_anti"))


# --- query families -------------------------------------------------------------------

def _quoted(name: Column, fallback: Column) -> Column:
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return F.when(trimmed != "", F.concat(F.lit('"'), trimmed, F.lit('"'))).otherwise(fallback)


def _fill(template: str, parts: dict[str, Column]) -> Column:
    out: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        out += [F.lit(head), parts[name]]
    return F.concat(*out, F.lit(rest))


# Fixed values: (family, needs host, needs place, text) of the queries about an entity.
ENTITY_QUERIES = (
    ("plan", True, False, 'site:{host} {name} {lid} "master plan" filetype:pdf'),
    ("plan", True, False, 'site:{host} {name} {lid} AMP OR "airport master plan" filetype:pdf'),
    ("plan", True, False, 'site:{host} {lid} ALP OR "airport layout plan" filetype:pdf'),
    ("plan", True, False, 'site:{host} {lid} "airport diagram" ALP filetype:pdf'),
    ("plan", False, False, '{name} {lid} "master plan" filetype:pdf'),
    ("plan", False, False, '{name} {lid} AMP OR "airport master plan" filetype:pdf'),
    ("plan", False, False, '{name} {lid} "airport layout plan" OR ALP filetype:pdf'),
    ("plan", False, False, '{name} {lid} "airport diagram" ALP filetype:pdf'),
    ("plan", False, False, '{name} {lid} "master plan" site:.gov'),
    ("plan", False, False, '{name} {lid} ALP OR "airport layout plan" site:.gov'),
    ("plan", False, True, '{name} {place} "master plan" filetype:pdf'),
    ("cip", True, False, 'site:{host} {lid} CIP OR "capital improvement" filetype:pdf'),
    ("cip", False, False, '{name} {lid} "capital improvement" OR CIP airport filetype:pdf'),
    ("cip", False, False, '{name} {lid} "airport capital improvement" site:.gov'),
    ("pfc", True, False, 'site:{host} {lid} PFC OR "passenger facility charge"'),
    ("pfc", False, False, '{name} {lid} "passenger facility charge" OR PFC filetype:pdf'),
    ("pfc", False, False, '{name} {lid} PFC application OR "PFC collection" site:.gov'),
)
# Fixed values: (family, needs host, text) of the queries about a region.
REGION_QUERIES = (
    ("budget", True, "site:{host} {agency} budget OR appropriation filetype:pdf"),
    ("budget", False, '{agency} "legislatively adopted budget" filetype:pdf'),
    ("budget", False, '"{name}" aviation "legislatively adopted budget" OR "enacted budget" site:.gov filetype:pdf'),
    ("budget", False, '{agency} appropriation OR "operating budget" site:.gov filetype:pdf'),
    ("awards", True, "site:{host} {agency} grant OR award airport filetype:pdf"),
    ("awards", False, '{agency} "airport grant" OR "aviation grant awards" site:.gov filetype:pdf'),
    ("awards", False, '"{name}" "ASAP" OR "Connect Oregon" OR "aviation grant" award site:.gov'),
    ("awards", False, '{agency} "project awards" OR "grant awards" airport site:.gov'),
    ("law", True, 'site:{host} "aviation system plan" OR SASP OR statute filetype:pdf'),
    ("law", False, '"{name}" "state aviation system plan" OR SASP filetype:pdf'),
    ("law", False, '{agency} "airport" statute OR "landing field" site:.gov'),
    ("law", False, '"{name}" aviation code OR "airport zoning" site:.gov'),
)


def entity_queries(entities: DataFrame) -> DataFrame:
    """Query texts about every entity: (entity, family, ord, query).

    Entities: key, name, city, state, website.
    """
    lid = F.trim(F.col("key").cast("string"))
    host = urls.host(F.trim(F.coalesce("website", F.lit(""))))
    place = v.joined(" ", F.trim("city"), F.trim("state"))
    parts = {"lid": lid, "host": host, "place": place, "name": _quoted(F.col("name"), lid)}
    rows = [
        F.struct(F.lit(f).alias("family"), F.lit(i).alias("ord"),
                 F.when((F.lit(not h) | (host != "")) & (F.lit(not p) | (place != "")), _fill(t, parts)).alias("query"))
        for i, (f, h, p, t) in enumerate(ENTITY_QUERIES)]
    return entities.select(F.col("key").alias("entity"), F.explode(F.array(*rows)).alias("q")).select("entity", "q.*").filter("query is not null")


def region_queries(regions: DataFrame) -> DataFrame:
    """Query texts about every region: (region, family, ord, query).

    Regions: code, name, agency, website. A host query names the region where the
    agency is unknown, the others a department of aviation.
    """
    name = F.trim("name")
    host = urls.host(F.trim(F.coalesce("website", F.lit(""))))
    agency = v.first_text(F.trim(F.coalesce("agency", F.lit(""))))
    quote = F.lit('"')
    wide = F.concat(quote, F.coalesce(agency, F.concat(name, F.lit(" Department of Aviation"))), quote)
    near = F.concat(quote, F.coalesce(agency, name), quote)
    rows = [
        F.struct(F.lit(f).alias("family"), F.lit(i).alias("ord"),
                 F.when(F.lit(not h) | (host != ""), _fill(t, {"host": host, "name": name, "agency": near if h else wide})).alias("query"))
        for i, (f, h, t) in enumerate(REGION_QUERIES)]
    return regions.select(F.col("code").alias("region"), F.explode(F.array(*rows)).alias("q")).select("region", "q.*").filter("query is not null")


def seed_steps(entities: DataFrame, skip_hosts: Sequence[str]) -> DataFrame:
    """Opening queries per entity: open web, then the known host."""
    lid = F.trim(F.col("key").cast("string"))
    host = urls.host(F.coalesce("website", F.lit("")))
    known = (host != "") & ~host.isin(*skip_hosts)
    rows = F.array_compact(F.array(
        F.struct(F.lit("open_web").alias("step"), F.concat(_quoted(F.col("name"), lid), F.lit(" "), lid, F.lit(' "master plan"')).alias("query")),
        F.when(known, F.struct(F.lit("seed_host").alias("step"), F.concat(F.lit("site:"), host, F.lit(" "), lid, F.lit(' "master plan"')).alias("query")))))
    return entities.select(F.col("key").alias("entity"), F.posexplode(rows).alias("ord", "s")).select("entity", "ord", "s.*")


def followup_steps(signals: DataFrame, hosts: DataFrame, years: DataFrame, ran: DataFrame, limit: int = 2) -> DataFrame:
    """Narrower queries from what the hits taught: lock a host, then fill what is missing.

    Signals: output of `hit_signals` with the known host. Hosts: entity, host, pos, at
    most `limit` + 1 locked hosts matter. Ran: entity, query. Years: entity, year, first.
    """
    lid = F.col("entity").cast("string")

    def step(kind: str, rank: int, query: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("step"), F.lit(rank).alias("rank"), query.alias("query")))

    def site(host: Column, tail: Column | str) -> Column:
        return F.concat(F.lit("site:"), host, F.lit(" "), lid, F.lit(" "), F.lit(tail) if isinstance(tail, str) else tail)

    top = hosts.groupBy("entity").agg(F.min_by("host", "pos").alias("best"))
    year = years.filter("year <> '2008'").groupBy("entity").agg(F.min_by("year", "first").alias("year"))
    asked = ran.select("entity", F.regexp_extract("query", r"site:(\S+)", 1).alias("host")).filter("host <> ''").distinct()
    base = signals.join(top, "entity").join(year, "entity", "left")
    whole = F.coalesce(
        F.concat("year", F.lit(' AMP OR "final" "master plan"')), F.lit('"final" AMP OR "complete" "master plan"'))
    fills = base.select("entity", F.explode(F.array_compact(F.array(
        step("fill_alp", 100, site(F.col("best"), '"airport layout plan"'), ~F.col("has_alp")),
        step("fill_whole", 101, site(F.col("best"), whole), F.col("has_chapter") & ~F.col("has_whole")),
        step("fill_diagram", 102, site(F.col("best"), '"airport diagram"'), ~F.col("has_alp"))))).alias("s")).select("entity", "s.*")
    free = hosts.join(asked, ["entity", "host"], "left_anti").join(signals.select("entity", "known_host"), "entity")
    locks = free.filter(~F.col("host").eqNullSafe(F.col("known_host"))).select(
        "entity", F.lit("lock_host").alias("step"), F.col("pos").alias("rank"), site(F.col("host"), '"master plan"').alias("query"))
    fresh = locks.unionByName(fills).join(ran.select("entity", "query"), ["entity", "query"], "left_anti")
    once = first_row(fresh, ["entity", "query"], F.col("rank"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy("rank", "query"))
    return once.withColumn("pos", place).filter(F.col("pos") <= limit).drop("rank")
