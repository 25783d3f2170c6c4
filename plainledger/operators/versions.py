"""Versioned tables: digests, generations, snapshots, diffs, patches, impact scopes.

Entities travel as (entity_type, entity_key, payload): the payload is canonical JSON
with sorted keys, and its SHA-256 tells versions apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainledger.functions import values as v

KEYS = ("entity_type", "entity_key")


# --- digests --------------------------------------------------------------------

def canonical(columns: Sequence[str]) -> Column:
    """Row as JSON with its fields in name order; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def as_entities(df: DataFrame, entity_type: str, key: str, fallback: Sequence[str] = ()) -> DataFrame:
    """Rows as entities; a row without key is named by the hash of its identity columns."""
    own = v.text_or_null(F.col(key).cast("string"))
    named = F.coalesce(own, F.sha2(canonical(fallback), 256)) if fallback else own
    payload = canonical(df.columns)
    return df.select(F.lit(entity_type).alias("entity_type"), named.alias("entity_key"), payload.alias("payload")).withColumn(
        "sha", F.sha2("payload", 256))


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row that is equal for equal tables, whatever the row order.

    Row hashes are folded by sums and an xor on the way, so nothing is gathered.
    """
    h = F.sha2(canonical(columns or df.columns), 256)
    parts = [F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(20,0)") for i in (1, 9, 17, 25)]
    hashed = df.select(F.xxhash64(h).alias("x"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    sums = [F.sum(f"p{i}").cast("string") for i in range(4)]
    return hashed.agg(
        F.count(F.lit(1)).alias("n"),
        F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.bit_xor("x").cast("string"), *sums), 256).alias("digest"))


def unchanged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tables have equal digests: one row, used to skip a rebuild."""
    left, right = table_digest(a).alias("a"), table_digest(b).alias("b")
    # Both sides are a single row.
    return left.join(F.broadcast(right), F.lit(True)).select(
        (F.col("a.digest") == F.col("b.digest")).alias("same"), F.col("a.n").alias("n_before"), F.col("b.n").alias("n_after"))


# --- generations -------------------------------------------------------------------

def entity_versions(entities: DataFrame) -> DataFrame:
    """Distinct payloads of every entity over all generations."""
    return entities.groupBy(*KEYS, "sha").agg(
        F.any_value("payload").alias("payload"), F.min("generation").alias("first_generation"))


def memberships(entities: DataFrame) -> DataFrame:
    return entities.select("generation", *KEYS, "sha")


def snapshot(members: DataFrame, versions: DataFrame, generation: Column | int) -> DataFrame:
    """Entities of one generation: its memberships joined to their versions."""
    chosen = members.filter(F.col("generation") == generation)
    return chosen.join(versions.select(*KEYS, "sha", "payload"), [*KEYS, "sha"])


def duplicate_keys(entities: DataFrame) -> DataFrame:
    return entities.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def replace_diff(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Change set that turns one snapshot into another: inserted, deleted, changed."""
    a = current.select(*KEYS, F.col("sha").alias("old_sha"))
    b = incoming.select(*KEYS, F.col("sha").alias("new_sha"), "payload")
    change = (
        F.when(F.col("old_sha").isNull(), "inserted").when(F.col("new_sha").isNull(), "deleted")
        .when(F.col("old_sha") != F.col("new_sha"), "changed"))
    return a.join(b, list(KEYS), "full_outer").withColumn("change", change).filter("change is not null")


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot after a change set: deleted and changed rows out, new payloads in."""
    kept = current.select(*KEYS, "sha", "payload").join(changes.select(*KEYS), list(KEYS), "left_anti")
    new = changes.filter("change <> 'deleted'").select(*KEYS, F.col("new_sha").alias("sha"), "payload")
    return kept.unionByName(new)


def version_history(entities: DataFrame) -> DataFrame:
    """Per entity and generation: previous hash, change kind and version number.

    An entity's earlier row is its previous one only if it stands in the generation
    just before; that neighbour comes from one aggregate over the list of generations,
    joined by an equi join. Windows are per entity only.
    """
    gens = entities.select("generation").distinct()
    listed = gens.agg(F.sort_array(F.collect_set("generation")).alias("_all"))
    at = F.posexplode(F.col("_all")).alias("_i", "generation")
    order = listed.select("_all", at).select("generation", F.get("_all", F.col("_i") - 1).alias("_before"))
    per_key = Window.partitionBy(*KEYS).orderBy("generation")
    placed = entities.join(order, "generation").select("generation", "_before", *KEYS, "sha").withColumns({
        "_last": F.lag("generation").over(per_key), "_sha": F.lag("sha").over(per_key)})
    flagged = placed.withColumn("previous_sha", F.when(F.col("_last") == F.col("_before"), F.col("_sha")))
    kind = F.when(F.col("previous_sha").isNull(), "added").when(F.col("previous_sha") != F.col("sha"), "changed").otherwise("same")
    upto = per_key.rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("change", kind).withColumn(
        "version", F.sum(F.when(F.col("change") == "same", 0).otherwise(1)).over(upto)).drop("_before", "_last", "_sha")


# --- patches ----------------------------------------------------------------------

def patch_rows(current: DataFrame, updates: DataFrame, key: str, columns: Sequence[str],
               required: Sequence[str], defaults: Mapping[str, str]) -> DataFrame:
    """Presence-based upsert. Updates: key and `patch`, a JSON object.

    A key named in the patch overwrites, even with null; an absent one keeps the
    stored value. A patch of an unknown row makes a new one only when it names all
    the required columns; the other columns take their defaults.
    """
    fields = F.from_json(F.col("patch"), "map<string,string>")
    ups = updates.select(key, fields.alias("_p"))
    joined = current.withColumn("_known", F.lit(True)).join(ups, key, "full_outer")
    new = F.col("_known").isNull()
    complete = v.all_of(*[F.map_contains_key("_p", c) for c in required])

    def merged(c: str) -> Column:
        kind = current.schema[c].dataType
        nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
        raw = F.try_element_at("_p", F.lit(c))
        given = F.from_json(raw, kind.simpleString()) if nested else raw.cast(kind)
        default = F.lit(defaults.get(c)).cast("string" if nested else kind)
        default = F.from_json(default, kind.simpleString()) if nested else default
        return F.when(v.yes(F.map_contains_key("_p", c)), given).when(new, default).otherwise(F.col(c)).alias(c)

    return joined.filter(~new | v.yes(complete)).select(key, *[merged(c) for c in columns])


def last_patch(updates: DataFrame, key: str, seq: str) -> DataFrame:
    """Several patches of a row folded into one, later keys over earlier ones.

    Folding is by field, so a hot row's patches meet only as one value per field.
    """
    fields = F.from_json(F.col("patch"), "map<string,string>")
    pairs = updates.select(key, seq, F.explode(fields).alias("name", "value"))
    last = pairs.groupBy(key, "name").agg(F.max_by(F.struct("value"), seq).alias("v"))
    return last.groupBy(key).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("v.value").alias("value")))))).alias("patch"))


def fallback_table(overlay: DataFrame, baseline: DataFrame) -> DataFrame:
    """The overlay when it has any row, else the baseline; decided inside the plan."""
    empty = overlay.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    # A single row: whether the overlay is empty.
    kept = baseline.join(F.broadcast(empty)).filter(F.col("_n") == 0).drop("_n")
    return overlay.unionByName(kept)


# --- comparisons --------------------------------------------------------------------

def revoked(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that were visible and no longer are."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def reconcile(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Artifacts to publish, keep or remove."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(True))
    b = present.select(key).distinct().withColumn("_p", F.lit(True))
    state = F.when(F.col("_p").isNull(), "publish").when(F.col("_e").isNull(), "remove").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def snapshots_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only one side has, with the side; empty when the snapshots are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right")))


def import_check(rows: DataFrame, imported: DataFrame) -> DataFrame:
    """Per entity type: rows, imported rows, duplicate keys, malformed lines, verdict.

    Rows: entity_type, entity_key (null when malformed).
    """
    keyed = rows.groupBy("entity_type", "entity_key").agg(F.count(F.lit(1)).alias("n"))
    per = keyed.groupBy("entity_type").agg(
        F.sum("n").alias("rows"),
        F.count_if((F.col("n") > 1) & F.col("entity_key").isNotNull()).alias("duplicate_keys"),
        F.sum(F.when(F.col("entity_key").isNull(), F.col("n")).otherwise(0)).alias("malformed"))
    got = imported.groupBy("entity_type").agg(F.count(F.lit(1)).alias("imported"))
    joined = per.join(got, "entity_type", "full_outer").na.fill(0)
    fine = (F.col("rows") == F.col("imported")) & (F.col("duplicate_keys") == 0) & (F.col("malformed") == 0)
    return joined.withColumn("ok", fine)


def impact_scope(changes: DataFrame, docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pages to rebuild after a change set, as distinct (page, key).

    Changes: page (document, entity, region), key as text. A document pulls in its
    entity and regions, an entity its region.
    """
    def of(page: str) -> DataFrame:
        return changes.filter(F.col("page") == page).select(F.col("key").alias("_key"))

    changed_docs = docs.select(
        F.col("id").cast("string").alias("_key"), F.col("entity").cast("string").alias("entity"), F.col("region").cast("string").alias("region")
    ).join(of("document"), "_key", "left_semi")
    from_docs = changed_docs.select(F.explode(F.array(
        F.struct(F.lit("document").alias("page"), F.col("_key").alias("key")),
        F.struct(F.lit("entity").alias("page"), F.col("entity").alias("key")),
        F.struct(F.lit("region").alias("page"), F.col("region").alias("key")))).alias("p")).select("p.*")
    hit = from_docs.filter("page = 'entity'").select(F.col("key").alias("_key")).unionByName(of("entity")).filter("_key is not null").distinct()
    homes = entities.select(F.col("key").cast("string").alias("_key"), F.col("region").cast("string").alias("region")).join(hit, "_key")
    from_entities = homes.select(F.lit("region").alias("page"), F.col("region").alias("key")).unionByName(
        hit.select(F.lit("entity").alias("page"), F.col("_key").alias("key")))
    direct = changes.select("page", "key")
    return from_docs.unionByName(from_entities).unionByName(direct).filter(v.first_text("key").isNotNull()).distinct()


def wanted_documents(docs: DataFrame, scope: DataFrame) -> DataFrame:
    """Documents a scope asks to rebuild: named, or under a named entity or region."""
    names = F.array(
        F.struct(F.lit("document").alias("page"), F.col("id").cast("string").alias("key")),
        F.struct(F.lit("entity").alias("page"), F.col("entity").cast("string").alias("key")),
        F.struct(F.lit("region").alias("page"), F.col("region").cast("string").alias("key")))
    reach = docs.select("id", F.explode(names).alias("n")).select("id", "n.*")
    return reach.join(scope, ["page", "key"], "left_semi").select("id").distinct()
