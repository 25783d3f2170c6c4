"""Phrase collocations by mergeable Misra-Gries summaries and one exact second count.

First pass: every n-gram of 1 to `longest` words falls by its hash into one of P hash
partitions. A task keeps one counter table per partition and hands it on as a summary
(sorted 32-bit fingerprints, counts, mass) whenever its counters reach `TASK_COUNTERS`.
The summaries of a partition are merged one after the other under a capacity of
`SLACK` times the partition's mass divided by the threshold: beyond it the next largest
count is taken off all counters, and the sum of what was taken off bounds what any
n-gram may have lost. A fingerprint survives if its counter plus that bound reaches the
threshold, so every n-gram that occurs often enough survives, whatever collides or is
skewed; P grows with the text, so the counters of a partition do not.

Second pass: survivors set bits in one bitmap of at most `MOST_BITS` bits, which is all
that is broadcast; a phrase whose bit is set is counted exactly, by its words and not by
a hash. A full bitmap only lets more phrases into the exact count. Since no phrase
occurs more often than a part of it, all parts of a frequent phrase are counted as well.

A candidate of words w1..wm is cut after each of its first words; the score of a cut is
floor(1000 * a * n / (l * r)) in decimals of 38 digits (exact while 1000 * a * n stays
below 1e38), and the lowest score counts. A candidate goes if a longer one contains its
words and occurs `share` percent as often: it is enough to look at candidates of one
word more, since any longer one contains such a one that occurs at least as often.

Defined results: null texts are empty, a null lang is `und` (also where a row says
`und`); texts of any length are taken whole, in pieces that hand on their last words;
words keep every character but A-Z, which is lower-cased; repeated rows count as often
as they occur; ties go by count, then phrase in byte order; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plainledger.llm import words as w
from plainledger.llm.common import pack, unpack
from plainledger.operators.skew import spread_join
from plainledger.session import cut

THRESHOLD = 100
LONGEST = 5
LIMIT = 2000
SHARE = 100
# Counters of a partition per (mass / threshold); the more, the fewer false survivors.
SLACK = 8
# Counters a task keeps before it hands its summaries on.
TASK_COUNTERS = 1_500_000
# Counters of one hash partition that its merge should hold, and the fewest partitions.
PARTITION_COUNTERS = 1 << 20
PARTITIONS = 64
# Text of one language that is taken apart at once.
BUFFER = 2 << 20
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
SEGMENT_BITS = 1 << 20

_LOWER = bytes(
    (c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?" or 10 <= c <= 13 else c) for c in range(256))
_TOKEN = re.compile(rb"[^ \n]+|\n[ \n]*")
_SEPARATOR = re.compile(rb"[ \n]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


# --- words of a task -------------------------------------------------------------------

def pieces(text: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """Tokens of a text, piece by piece, and how many of the first are handed on from the piece before.

    A token that starts with a line feed ends a stretch of words.
    """
    text = text.translate(_LOWER)
    at, handed = 0, []
    while at < len(text):
        found = _SEPARATOR.search(text, at + BUFFER) if len(text) - at > BUFFER else None
        end = found.start() if found else len(text)
        tokens = handed + _TOKEN.findall(text, at, end)
        yield tokens, len(handed)
        handed = tokens[max(0, len(tokens) - longest + 1):]
        for k in range(len(handed) - 1, -1, -1):
            if handed[k][0] == 10:
                handed = handed[k + 1:]
                break
        at = end


class Stretch:
    """Texts of one language as word numbers, with the place where each stretch of words ends."""

    def __init__(self, lang: str, parts: list[tuple[list[bytes], int]]):
        flat: list[bytes] = []
        old: list[tuple[int, int]] = []
        for tokens, handed in parts:
            if handed:
                old.append((len(flat), handed))
            flat.extend(tokens)
            flat.append(b"\n")
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        self.lang = lang
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        border = np.array([x[:1] == b"\n" for x in self.words], dtype=bool)[self.ids]
        n = len(self.ids)
        # Words from each place on up to the next border; a border itself has none.
        stop = np.where(border, np.arange(n), n)
        self.left = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
        self.fresh = ~border
        for start, count in old:
            self.fresh[start:start + count] = False
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in self.words), dtype=np.uint64, count=len(self.words))
        self.hashes = hashes[self.ids]

    def grams(self, size: int, before: np.ndarray | None, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of `at` where `size` words start, and their hashes from those of one word less."""
        keep = self.left[at] >= size
        at = at[keep]
        last = self.hashes[at + size - 1]
        return at, w.mix(last + _STEP if before is None else before[keep] * _STEP + last)

    def counted(self, at: np.ndarray, size: int) -> np.ndarray:
        """Whether the words starting at `at` end in this piece, not in what was handed on."""
        return self.fresh[at + size - 1]


def stretches(batches, longest: int) -> Iterator[Stretch]:
    """The texts of a task by language, a bounded amount at a time."""
    held: dict[str, list[tuple[list[bytes], int]]] = {}
    size = 0
    for batch in batches:
        texts = batch.column("text")
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            data = text.as_py()
            if not data:
                continue
            for part in pieces(data.encode() if isinstance(data, str) else data, longest):
                held.setdefault(UNKNOWN if lang is None else lang, []).append(part)
                size += min(len(data), BUFFER)
                if size >= BUFFER:
                    for name, parts in held.items():
                        yield Stretch(name, parts)
                    held, size = {}, 0
    for name, parts in held.items():
        yield Stretch(name, parts)


# --- summaries -------------------------------------------------------------------------

def place(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Hash partition in the upper and fingerprint in the lower 32 bits."""
    low = np.uint64(0xFFFFFFFF)
    return ((hashes >> np.uint64(32)) % np.uint64(partitions) << np.uint64(32)) | (hashes & low)


def add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal keys, in key order."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def merge(have: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray, counts: np.ndarray, taken: int,
          capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries merge: counters add up; beyond the capacity the next largest count is taken off all."""
    k, c = add(np.concatenate([have[0], keys]), np.concatenate([have[1], counts]))
    lost = have[2] + taken
    if len(k) > capacity:
        off = int(np.partition(c, len(c) - capacity - 1)[len(c) - capacity - 1])
        k, c = k[c > off], c[c > off] - off
        lost += off
    return k, c, lost


SUMMARY = "part long, mass long, n long, keys binary, counts binary"
_SUMMARY = pa.schema([("part", pa.int64()), ("mass", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _summary_rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    part = (keys >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, dtype=np.int64)
    rows = []
    for start, stop in zip(at.tolist(), np.append(at[1:], len(part)).tolist()):
        own = (keys[start:stop] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        # Gaps are small numbers, and so are nearly all counts.
        gaps = np.diff(own, prepend=np.uint32(0)).astype(np.uint32)
        rows.append((int(part[start]), int(counts[start:stop].sum()), stop - start, pack(gaps), pack(counts[start:stop])))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMMARY)], schema=_SUMMARY)


def task_summaries(partitions: int, longest: int):
    """Tables of a task's counters, one row per hash partition and hand-over."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = merged = 0
        for stretch in stretches(batches, longest):
            before, at = None, np.arange(len(stretch.ids))
            found = []
            for n in range(1, longest + 1):
                at, before = stretch.grams(n, before, at)
                found.append(place(before[stretch.counted(at, n)], partitions))
            keys = np.sort(np.concatenate(found))
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
            held.append((keys[first], np.diff(np.append(first, len(keys))).astype(np.int64)))
            size += len(first)
            if size >= 2 * TASK_COUNTERS or size - merged >= TASK_COUNTERS:
                held = [add(*(np.concatenate(x) for x in zip(*held)))]
                size = merged = len(held[0][0])
                if size >= TASK_COUNTERS:
                    yield from _summary_rows(*held[0])
                    held, size, merged = [], 0, 0
        if held:
            yield from _summary_rows(*add(*(np.concatenate(x) for x in zip(*held))))

    return run


def merged_survivors(threshold: int, slack: int):
    """Fingerprints of each partition that may reach the threshold; rows come by partition."""

    def run(batches):
        part, have, mass = None, None, 0

        def out():
            keys = have[0][have[1] + have[2] >= threshold]
            bits = (np.uint64(part) << np.uint64(32)) | keys.astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(bits.view(np.int64))], names=["key"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield out()
                    part, mass = row["part"], row["whole"]
                    have = (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), 0)
                keys = np.cumsum(unpack(row["keys"], row["n"], np.uint32), dtype=np.uint32)
                counts = unpack(row["counts"], row["n"], np.int64)
                have = merge(have, keys, counts, 0, slack * (mass // threshold) + 1)
        if part is not None:
            yield out()

    return run


def survivors(docs: DataFrame, threshold: int, longest: int, partitions: int) -> DataFrame:
    """(key): place of every n-gram that may occur `threshold` times, and of few others."""
    rows = docs.mapInArrow(task_summaries(partitions, longest), SUMMARY)
    by_part = Window.partitionBy("part")
    whole = rows.withColumn("whole", F.sum("mass").over(by_part))
    return whole.select("part", "whole", "n", "keys", "counts").mapInArrow(merged_survivors(threshold, SLACK), "key long")


# --- exact counts ------------------------------------------------------------------------

def bit_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return w.mix(keys) & np.uint64(bits - 1)


def bitmap(found: DataFrame, bits: int) -> bytes:
    """One bit per survivor; at most MOST_BITS in all, put together from segments made by tasks."""

    def places(batches):
        for batch in batches:
            at = bit_of(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at // SEGMENT_BITS).astype(np.int32)), pa.array((at % SEGMENT_BITS).astype(np.int32))],
                                             names=["segment", "bit"])

    def segment(table: pa.Table) -> pa.Table:
        mark = np.zeros(SEGMENT_BITS, dtype=np.uint8)
        mark[table.column("bit").to_numpy()] = 1
        return pa.table({"segment": table.column("segment")[:1], "marks": pa.array([np.packbits(mark).tobytes()], pa.binary())})

    at = found.mapInArrow(places, "segment int, bit int").distinct()
    rows = at.groupBy("segment").applyInArrow(segment, "segment int, marks binary").collect()
    out = bytearray(bits // 8)
    for row in rows:
        start = row["segment"] * SEGMENT_BITS // 8
        out[start:start + SEGMENT_BITS // 8] = row["marks"]
    return bytes(out)


def exact_counts(partitions: int, longest: int, bits: int, marks):
    """(lang, size, phrase, f) of each part of a task: phrases whose bit is set; size 0 counts all words."""
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def rows(lang, size, phrases, counts):
        n = len(phrases)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array([size] * n, pa.int32()),
             pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], schema=schema)

    def run(batches):
        table = np.frombuffer(marks.value, dtype=np.uint8)
        for stretch in stretches(batches, longest):
            number = len(stretch.words)
            before, at, group = None, np.arange(len(stretch.ids)), None
            for n in range(1, longest + 1):
                keep = stretch.left[at] >= n
                group = None if group is None else group[keep]
                at, before = stretch.grams(n, before, at)
                spot = bit_of(place(before, partitions), bits)
                hit = (table[(spot >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (spot & np.uint64(7))).astype(np.uint8)) & 1 == 1
                if n == 1:
                    yield rows(stretch.lang, 0, [b""], [int(stretch.counted(at, 1).sum())])
                at, before = at[hit], before[hit]
                last = stretch.ids[at + n - 1]
                pair = last if group is None else group[hit] * number + last
                _, first, group, _ = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                counts = np.bincount(group[stretch.counted(at, n)], minlength=len(first))
                some = np.flatnonzero(counts)
                names = [b" ".join([stretch.words[k] for k in stretch.ids[i:i + n].tolist()]) for i in at[first[some]].tolist()]
                if names:
                    yield rows(stretch.lang, n, names, counts[some])

    return run


def frequent(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """lang, size, phrase, f of all phrases that occur `threshold` times; size 0 holds each lang's words.

    A text without words leaves no row of its lang.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("lang").cast("string"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word takes some five bytes; the number only balances the partitions.
    mass = longest * size / 5
    partitions = max(PARTITIONS, math.ceil(mass * SLACK / threshold / PARTITION_COUNTERS))
    found = cut(survivors(texts, threshold, longest, partitions))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * max(1, found.count()) - 1).bit_length()))
    marks = spark.sparkContext.broadcast(bitmap(found, bits))
    counted = texts.mapInArrow(exact_counts(partitions, longest, bits, marks), "lang string, size int, phrase string, f long")
    sums = counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return cut(sums.filter((F.col("f") >= threshold) | (F.col("size") == 0)))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST,
                 share: int = SHARE, limit: int | None = LIMIT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 words and more, best first; `limit` per lang."""
    counts = frequent(docs, threshold, longest)
    totals = counts.filter(F.col("size") == 0).select("lang", F.col("f").alias("n"))
    single = counts.filter(F.col("size") > 0).select("lang", "phrase", "f")
    several = counts.filter(F.col("size") > 1)
    size = F.col("size")
    shorter = F.expr("array(substring_index(phrase, ' ', size - 1), substring_index(phrase, ' ', 1 - size))")
    inside = (
        several.filter(size > 2).select("lang", F.explode(shorter).alias("phrase"), F.col("f").alias("more"))
        .groupBy("lang", "phrase").agg(F.max("more").alias("more")))
    alone = several.join(inside, ["lang", "phrase"], "left").filter(
        F.col("more").isNull() | (F.col("more") * 100 < F.col("f") * share)).drop("more")
    cuts = alone.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parted = cuts.selectExpr("*", "substring_index(phrase, ' ', k) AS first", "substring_index(phrase, ' ', k - size) AS rest")
    # Many phrases share a first or last word.
    row = F.struct("phrase", "k")
    for part, name in (("first", "l"), ("rest", "r")):
        lookup = single.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        parted = spread_join(parted, lookup, ["lang", part], row, "inner")
    whole = "decimal(38,0)"
    top = F.lit(1000).cast(whole) * F.col("a").cast(whole) * F.col("n").cast(whole)
    scored = parted.join(totals, "lang").withColumn("_top", top.cast(whole)).withColumn(
        "_under", (F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")).cast(whole))
    scored = scored.withColumn("score", F.expr("_top div _under").cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("_best")).select(
        "lang", "phrase", "_best.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
