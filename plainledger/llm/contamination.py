"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by size (the power of two of their number of five-word
shingles). An item's sketch is its smallest shingle hashes, one more than may be
missing at the wanted containment: a document that contains the item to that degree
holds at least one of them, so the search loses nothing. A document's sketch is its
shingle hashes up to the largest sketch value of the partitions whose items it is long
enough to contain; only these are looked up. Documents that share a sketch value with
an item are candidates, and candidates are verified by exact shingle containment on
the words themselves.

Words are runs of letters and digits in lower case. The lookup side holds sketches
only; it is written first, so the planner broadcasts it when it is small and shuffles
when it is not.

Defined results: null and short texts (under five words) have no shingle and are
neither found nor contained; repeated items are found each; in `find` rows that share a
doc_id are one document and rows without an id are passed over, in `decontaminate` every
row counts by its text; equal similarities need no order, as every pair is returned; very
long texts are read whole; empty tables give an empty table; extra columns are ignored by
`find` and kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainledger.llm.common import carry
from plainledger.session import cut

SHINGLE = 5
CONTAINMENT = 0.8


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _neighbours(array: str, size: int) -> Column:
    """Rows of `size` neighbours of an array column."""
    n = F.greatest(F.size(array) - (size - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(F.col(array), F.lit(k + 1), n).alias(f"w{k}") for k in range(size)])


def _exploded(rows: DataFrame, array: str, keep: list[str]) -> DataFrame:
    zipped = rows.select(*keep, _neighbours(array, SHINGLE).alias("_z"))
    return zipped.select(*keep, F.inline("_z").alias(*[f"w{k}" for k in range(SHINGLE)]))


def hashed_shingles(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per shingle: `keep` and the shingle's hash, from hashes of its words."""
    hashes = rows.withColumn("_words", F.transform(plain_words(F.col("text")), lambda w: F.xxhash64(w)))
    sized = hashes.withColumn("_size", F.size("_words") - (SHINGLE - 1))
    return _exploded(sized, "_words", [*keep, "_size"]).select(
        *keep, "_size", F.xxhash64(*[f"w{k}" for k in range(SHINGLE)]).alias("hash"))


def text_shingles(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct shingles as text."""
    words = rows.withColumn("_words", plain_words(F.col("text")))
    return _exploded(words, "_words", keep).select(
        *keep, F.concat_ws(" ", *[f"w{k}" for k in range(SHINGLE)]).alias("shingle")).distinct()


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, part, n_item, hash): the smallest hashes of each item."""
    hashes = hashed_shingles(items.select("item_id", "text"), ["item_id"])
    per_item = hashes.groupBy("item_id").agg(F.array_sort(F.collect_set("hash")).alias("all"))
    n = F.size("all")
    allowed = n - F.ceil(n * F.lit(containment) - 1e-9).cast("int")
    return per_item.select(
        "item_id", F.floor(F.log2(n)).cast("int").alias("part"), n.alias("n_item"),
        F.explode(F.slice("all", F.lit(1), allowed + 1)).alias("hash"))


def candidates(docs: DataFrame, sketch: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id) pairs that share a sketch value."""
    # One row per partition: at most one for each power of two.
    limits = sketch.groupBy("part").agg(F.max("hash").alias("most"), F.min("n_item").alias("least")).collect()
    held = hashed_shingles(docs.select("doc_id", "text"), ["doc_id"])
    fits = F.lit(False)
    for part in limits:
        fits = fits | ((F.col("_size") >= part["least"] * containment - 1e-9) & (F.col("hash") <= part["most"]))
    own = held.filter(fits)
    pairs = own.join(sketch.select("item_id", "n_item", F.col("hash").alias("same")), F.col("hash") == F.col("same"))
    return pairs.filter(F.col("_size") >= F.col("n_item") * containment - 1e-9).select("doc_id", "item_id").distinct()


def find(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of every pair at or above the limit."""
    docs = docs.select("doc_id", "text")
    sketch = cut(sketches(items, containment))
    pairs = cut(candidates(docs, sketch, containment))
    names = cut(pairs.select(F.col("doc_id").alias("of")).distinct())
    some = docs.join(names, F.col("doc_id") == F.col("of"), "left_semi")
    held = text_shingles(some, ["doc_id"])
    wanted = cut(text_shingles(items.select("item_id", "text"), ["item_id"]))
    sizes = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    shared = (
        held.join(wanted, "shingle").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
        .join(pairs.select(F.col("doc_id").alias("_d"), F.col("item_id").alias("_i")),
              (F.col("doc_id") == F.col("_d")) & (F.col("item_id") == F.col("_i")), "left_semi"))
    ratio = F.col("n_shared") / F.col("n_item")
    return shared.join(sizes, "item_id").select(
        "doc_id", "item_id", "n_item", "n_shared", ratio.alias("containment")).filter(
        F.col("containment") >= containment - 1e-9)


def text_key(text: Column) -> Column:
    """128 bits of hashes that stand for a text."""
    return F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit("again"), text)))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Documents that contain no test item; the columns of `docs`.

    Texts are judged, not ids: documents and items without an id or with a repeated one
    count like all others, and equal texts share one verdict.
    """
    docs, restore = carry(docs, ("text",))
    own = text_key(F.col("text"))
    found = cut(find(docs.select(own.alias("doc_id"), "text"), items.select(own.alias("item_id"), "text"), containment)
                .select(F.col("doc_id").alias("_found")).distinct())
    return restore(docs.withColumn("_own", own).join(found, F.col("_own") == F.col("_found"), "left_anti"))
