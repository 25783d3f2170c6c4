"""Repeated word windows by hashes of windows, filed under blocks chosen by content.

This stands in for a relative Lempel-Ziv parse: no factor is extended against a
reference block. Each window of `WINDOW` words is filed under the smallest hash among its
`BLOCK`-word blocks, so equal windows anywhere are filed under the same block, and
neighbouring windows mostly share one. A block held by a single document cannot match.
The windows filed under blocks that several documents hold (or one document repeatedly)
are looked up by two 64-bit hashes, which give each window sequence the first document and
place where it starts; both rest on one 64-bit hash per word. A document's marked windows
are merged into spans from left to right; a span is a duplicate. Windows are judged on the
input, never on what is left.

A document whose whole text an earlier one has repeats it in one factor; it is marked
by two 64-bit hashes of the text and files no blocks.

Spark moves block hashes, then one number per block that is not shared (its place in
the document), then the windows filed under shared blocks, and the place of each first
window. Texts move once. A sequence that a third of all documents hold is one
combinable group.

Defined results: null text has no words; documents with fewer than `WINDOW` words keep
all; rows that share a doc_id are ordered by their text; equal rows are one document
and get one result each; a null doc_id sorts first; an empty table gives an empty
table; extra columns are ignored by `parse` and kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainledger.llm import words as w
from plainledger.llm.common import carry, per_batch, utf8
from plainledger.operators.skew import spread_join
from plainledger.session import cut

WINDOW = 20
BLOCK = 8


def blocks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct filing blocks of a document, and for each window which of them it has."""
    low = w.lowest(w.runs(words, BLOCK), WINDOW - BLOCK + 1)
    return np.unique(low, return_inverse=True)


def candidates(words: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Places of the windows filed under a block that is not `single` to the document."""
    found, filed = blocks(words)
    shared = np.ones(len(found), dtype=bool)
    shared[single] = False
    # A block that the document itself holds at several places may repeat a window in it.
    places = w.runs(words, BLOCK)
    values, counts = np.unique(places, return_counts=True)
    shared |= np.isin(found, values[counts > 1])
    return np.flatnonzero(shared[filed])


def first_places(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of the distinct windows at `at`, where each is first, and which of `at` are repeats."""
    one, two = w.runs(words, WINDOW)[at], w.runs(words, WINDOW, other=True)[at]
    _, first, back = np.unique(one, return_index=True, return_inverse=True)
    return one[first], two[first], at[first], first[back] != np.arange(len(at))


def factors(hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) word spans of maximal runs of matching windows; overlapping runs meet."""
    found: list[tuple[int, int]] = []
    for start in np.flatnonzero(hit).tolist():
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], start + WINDOW)
        else:
            found.append((start, start + WINDOW))
    return found


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _block_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, owners, ranks = [], [], []
    for owner, text, copied in zip(_ids(batch, "_doc").tolist(), utf8(batch, "text"), batch.column("copied").to_pylist()):
        words = () if copied else w.hashes(text)
        if len(words) >= WINDOW:
            found = blocks(words)[0]
            keys.append(found.view(np.int64))
            owners.append(np.full(len(found), owner, dtype=np.int64))
            ranks.append(np.arange(len(found), dtype=np.int32))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(join(keys, np.int64)), pa.array(join(owners, np.int64)), pa.array(join(ranks, np.int32))],
        names=["block", "_doc", "rank"])


def _window_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts: list[list[np.ndarray]] = [[], [], [], []]
    copies = batch.column("copied").to_pylist()
    for owner, text, copied, single in zip(_ids(batch, "_doc").tolist(), utf8(batch, "text"), copies, batch.column("single")):
        words = () if copied else w.hashes(text)
        if len(words) < WINDOW:
            continue
        at = candidates(words, _places(single))
        if len(at):
            one, two, first, _ = first_places(words, at)
            for part, value in zip(parts, (one.view(np.int64), two.view(np.int64), np.full(len(first), owner, np.int64), first.astype(np.int32))):
                part.append(value)
    kinds = (np.int64, np.int64, np.int64, np.int32)
    arrays = [pa.array(np.concatenate(p) if p else np.zeros(0, dtype=k)) for p, k in zip(parts, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["one", "two", "_doc", "place"])


def _places(value: pa.Scalar) -> np.ndarray:
    if not value.is_valid:
        return np.zeros(0, dtype=np.int64)
    return value.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _parse_one(text: bytes, copied: bool, single: pa.Scalar, first: pa.Scalar) -> tuple[list[bytes], list[tuple[int, int]]]:
    plain = text.split()
    if len(plain) < WINDOW:
        return plain, []
    if copied:
        return plain, [(0, len(plain))]
    words = w.hashes(text)
    at = candidates(words, _places(single))
    if not len(at):
        return plain, []
    _, _, starts, again = first_places(words, at)
    hit = np.zeros(len(plain), dtype=bool)
    hit[starts] = True
    hit[_places(first)] = False
    hit[at[again]] = True
    return plain, factors(hit)


def _ordered(docs: DataFrame) -> DataFrame:
    """Rows with `_doc`, a 64-bit number in the order of doc_id, one per distinct document.

    A long doc_id without repeats is its own number. Else documents are numbered by
    (doc_id, text) range by range, without one task that sees them all.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind in ("bigint", "int", "smallint", "tinyint"):
        twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(
            (F.col("n") > 1) | F.col("doc_id").isNull()).limit(1)
        if twice.isEmpty():
            return docs.withColumn("_doc", F.col("doc_id").cast("long"))
    tagged = docs.withColumn("_text", F.xxhash64("text"))
    keys = tagged.select("doc_id", "_text").distinct()
    ranges = keys.repartitionByRange("doc_id", "_text").sortWithinPartitions("doc_id", "_text")
    # Written once: partition number and place in it are the order.
    order = cut(ranges.withColumn("_doc", F.monotonically_increasing_id())).select(
        F.col("doc_id").alias("_id"), F.col("_text").alias("_same"), "_doc")
    return tagged.join(order, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_same"))).drop(
        "_id", "_same", "_text")


def _copies(docs: DataFrame) -> DataFrame:
    """(_copy): documents whose whole text an earlier document has."""
    sums = docs.select("_doc", F.xxhash64("text").alias("one"), F.xxhash64(F.lit("again"), "text").alias("two"))
    firsts = sums.groupBy("one", "two").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")).filter(
        F.col("first") < F.col("last"))
    again = spread_join(sums, firsts, ["one", "two"], F.col("_doc"), "inner")
    return cut(again.filter(F.col("_doc") != F.col("first")).select(F.col("_doc").alias("_copy")).distinct())


def _with_matches(docs: DataFrame) -> DataFrame:
    """Each document with a mark for copies, the blocks only it holds and its first-of-all window places."""
    docs = docs.join(_copies(docs), F.col("_doc") == F.col("_copy"), "left").withColumn(
        "copied", F.col("_copy").isNotNull()).drop("_copy")
    found = docs.select("_doc", "text", "copied").mapInArrow(per_batch(_block_rows), "block long, _doc long, rank int")
    # Equal rows file the same block under the same number: distinct owners count.
    single = (
        found.groupBy("block")
        .agg(F.min("_doc").alias("_doc"), F.max("_doc").alias("_last"), F.max("rank").alias("rank"))
        .filter(F.col("_doc") == F.col("_last"))
        .groupBy("_doc").agg(F.collect_list("rank").alias("single")))
    parsed = docs.join(single.withColumnRenamed("_doc", "_own"), F.col("_doc") == F.col("_own"), "left").drop("_own")
    # All columns, as the last step needs them: so both share one exchange of the texts.
    windows = parsed.mapInArrow(per_batch(_window_rows), "one long, two long, _doc long, place int")
    first = (
        windows.groupBy("one", "two").agg(F.min("_doc").alias("_of"), F.min_by("place", "_doc").alias("place"))
        .groupBy("_of").agg(F.collect_list("place").alias("first")))
    return parsed.join(first, F.col("_doc") == F.col("_of"), "left").drop("_of")


def parse(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, end in words) and kept_sha256 of every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], []]
        for text, copied, single, first in zip(
                utf8(batch, "text"), batch.column("copied").to_pylist(), batch.column("single"), batch.column("first")):
            plain, spans = _parse_one(text, copied, single, first)
            kept = _kept(plain, spans)
            for column, value in zip(rows, (
                    len(plain), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans],
                    hashlib.sha256(b" ".join(kept)).hexdigest())):
                column.append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), span, pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds))],
            names=["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ready = _with_matches(_ordered(docs.select("doc_id", "text")))
    return ready.select("doc_id", "text", "copied", "single", "first").mapInArrow(
        per_batch(one),
        f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def _kept(plain: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    if not spans:
        return plain
    out, at = [], 0
    for a, b in spans:
        out.extend(plain[at:a])
        at = b
    return out + plain[at:]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated words out of `text`; texts that lose none are unchanged."""

    docs, restore = carry(docs, ("doc_id", "text"))
    names = docs.columns

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, valid, copied, single, first in zip(
                utf8(batch, "text"), batch.column("text").is_valid(), batch.column("copied").to_pylist(),
                batch.column("single"), batch.column("first")):
            plain, spans = _parse_one(text, copied, single, first)
            whole = text if not spans else b" ".join(_kept(plain, spans))
            texts.append(whole.decode("utf-8", "replace") if valid.as_py() else None)
        return pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    ready = _with_matches(_ordered(docs))
    return restore(ready.select(*docs.columns, "copied", "single", "first").mapInArrow(per_batch(strip), ddl))
