"""Repeated byte strings by external induced sorting of shards of suffixes.

A string of `length` bytes that starts in a document of smaller doc_id is a repeat;
every byte that a repeat covers goes. Shards are made by Spark so that equal strings
meet in one of them: every window of `length` bytes belongs to its anchor, the smallest
hash among its blocks of `BLOCK` bytes, and equal windows have equal anchors. An anchor
that one document alone holds cannot start a repeat. The stretches of text whose
windows belong to the other anchors go to the shard of their anchor, each distinct
stretch once, from its first document. A stretch none of whose windows has a hash
that comes twice shares no window, so its first document keeps it. Of the others a shard
sorts all suffixes and carries their common prefixes (`induced`); neighbours with
`length` common bytes start with the same string, and of such a group the document of
smallest doc_id keeps its bytes. Only these first places go back to the documents: any
other window under a shared anchor is a repeat.

Anchors that many documents hold (found on a sample that only balances the work) go
out window by window, so the text around a passage that a third of all documents share
spreads over all shards, and the windows inside it are equal rows that a task sends
once. A shard gets the stretches of about `SHARD_BYTES` of documents; the queues of the
sorter write to disk what does not fit.

Defined results: a null text is empty; texts shorter than `length` keep all bytes;
texts of any length are taken whole; repeats inside one document stay; rows that share
a doc_id are ordered by their text; equal rows are one document and get one result
each; a null doc_id sorts first; an empty table gives an empty table; extra columns are
ignored by `repeats` and kept by `remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainledger.llm import induced
from plainledger.llm import words as w
from plainledger.llm.common import pack, per_batch, unpack, utf8
from plainledger.llm.substring import _ordered

LENGTH = 50
BLOCK = 16
# Windows of one stretch; a bit each.
MOST_WINDOWS = 63
# Documents' bytes whose stretches one shard sorts.
SHARD_BYTES = 4 << 20
# Documents' bytes whose anchors one task compares.
PART_BYTES = 256 << 20
# Bytes of text hashed at once, so that the hashes stay in a core's cache; a longer text alone.
GROUP_BYTES = 256 << 10
# An anchor goes out window by window if a sample shows it in this share of the documents, or
# in this many of them; the sample has HOT_SAMPLE documents, or more if it takes more to show
# HOT_LEAST documents of so many.
HOT_SHARE, HOT_DOCUMENTS, HOT_SAMPLE, HOT_LEAST = 0.01, 100_000, 20_000, 40
# Ends a stretch: no byte of UTF-8.
END = 0xFF


def block_hashes(at: np.ndarray) -> np.ndarray:
    """Hash of the BLOCK bytes from each place on where so many are left, from the eight bytes there."""
    count = len(at) - BLOCK + 1
    value = at[:count] * np.uint64(0xD6E8FEB86659FD93)
    for k in range(8, BLOCK, 8):
        value ^= value >> np.uint64(32)
        value += at[k:count + k]
        value *= np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end."""
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).view("<u8")[:, 0] if data else np.zeros(0, dtype=np.uint64)


class Windows:
    """Runs of windows with one anchor in several texts: text, first window, end, anchor, number in the text."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.data = b"".join(texts)
        self.start = np.cumsum(sizes) - sizes
        n = len(self.data)
        blocks = length - BLOCK + 1
        anchor = w.lowest(block_hashes(eights(self.data)), blocks) if n >= length else np.zeros(0, dtype=np.uint64)
        count = max(0, n - length + 1)
        anchor = anchor[:count]
        # A run ends where the anchor changes and where a text ends; windows across texts are none.
        change = np.ones(count, dtype=bool)
        np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
        for border in (self.start, self.start + sizes - length + 1):
            change[border[(border >= 0) & (border < count)]] = True
        first = np.flatnonzero(change)
        text = np.searchsorted(self.start + sizes, first, "right")
        keep = first + length <= (self.start + sizes)[text] if len(first) else np.zeros(0, dtype=bool)
        last = np.append(first[1:], count)[:len(first)]
        self.first, self.last, self.text = first[keep], last[keep], text[keep]
        self.anchor = anchor[self.first]
        self.rank = np.arange(len(self.text)) - np.searchsorted(self.text, self.text)


def _groups(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], Windows]]:
    """Rows of a batch, a bounded amount of text at a time, with their windows."""
    rows, texts, size = [], [], 0
    for k, text in enumerate(utf8(batch, "text")):
        rows.append(k)
        texts.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield rows, Windows(texts, length)
            rows, texts, size = [], [], 0
    if rows:
        yield rows, Windows(texts, length)


def _anchor_rows(length: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        owners = batch.column("_doc").to_numpy(zero_copy_only=False)
        for rows, found in _groups(batch, length):
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.anchor.view(np.int64)), pa.array(owners[np.array(rows)[found.text]]),
                 pa.array(found.rank.astype(np.int32))], names=["anchor", "_doc", "rank"])

    return per_batch(run)


ANCHORS = "part int, n int, anchors binary, docs binary, ranks binary"
_ANCHORS = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("anchors", pa.binary()), ("docs", pa.binary()), ("ranks", pa.binary())])
# An anchor is told by its hash partition and so many more bits; a collision only sends a stretch in vain.
ANCHOR_BITS = 32


def _runs_of(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Equal neighbours and where they are."""
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, dtype=np.int64)
    for start, stop in zip(at.tolist(), np.append(at[1:], len(part)).tolist()):
        yield int(part[start]), slice(start, stop)


def _anchor_tables(length: int, parts: int):
    """The runs of a batch by hash partition of their anchors, as columns of numbers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners = batch.column("_doc").to_numpy(zero_copy_only=False)
        columns: list[list[np.ndarray]] = [[], [], []]
        for rows, found in _groups(batch, length):
            for column, value in zip(columns, (found.anchor, owners[np.array(rows)[found.text]], found.rank.astype(np.int32))):
                column.append(value)
        anchor, owner, rank = (np.concatenate(c) for c in columns)
        part = ((anchor >> np.uint64(ANCHOR_BITS)) % np.uint64(parts)).astype(np.int64)
        low = anchor & np.uint64((1 << ANCHOR_BITS) - 1)
        order = np.argsort(part.astype(np.uint64) << np.uint64(ANCHOR_BITS) | low)
        part, low, owner, rank = part[order], low[order], owner[order], rank[order]
        out = []
        for number, own in _runs_of(part):
            gaps = np.diff(low[own], prepend=np.uint64(0))
            out.append((number, own.stop - own.start, pack(gaps), pack(owner[own]), pack(rank[own])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, _ANCHORS)], schema=_ANCHORS)

    return per_batch(run)


def _single_runs(batches):
    """(_own, rank): runs whose anchor one document alone holds; rows come by partition."""
    part, held = None, []

    def solve():
        anchor, owner, rank = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(anchor)
        anchor, owner, rank = anchor[order], owner[order], rank[order]
        start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        alone = np.minimum.reduceat(owner, start) == np.maximum.reduceat(owner, start)
        size = np.where(alone, np.diff(np.append(start, len(anchor))), 0)
        at = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return pa.RecordBatch.from_arrays([pa.array(owner[at]), pa.array(rank[at])], names=["_own", "rank"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                if held:
                    yield solve()
                part, held = row["part"], []
            n = row["n"]
            held.append((np.cumsum(unpack(row["anchors"], n, np.uint64)), unpack(row["docs"], n, np.int64), unpack(row["ranks"], n, np.int32)))
    if held:
        yield solve()


def hot_anchors(docs: DataFrame, length: int, share: float = HOT_SHARE, most: int = HOT_DOCUMENTS) -> np.ndarray:
    """Anchors that many documents hold, by a sample: it only decides how their windows travel.

    There are at most (runs of the sampled texts) / HOT_LEAST of them.
    """
    rows = max(1, docs.count())
    fraction = min(1.0, max(HOT_SAMPLE / rows, HOT_LEAST / most))
    part = docs if fraction == 1.0 else docs.sample(False, fraction, 7)
    least = max(HOT_LEAST, fraction * min(share * rows, most))
    found = part.mapInArrow(_anchor_rows(length), "anchor long, _doc long, rank int").groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return np.sort(np.array([r["anchor"] for r in found.collect()], dtype=np.int64))


def stretches(text: bytes, runs: Iterator[tuple[int, int, int, bool]], length: int, sent: dict[bytes, int], owner: int) -> Iterator[tuple[bytes, int, int, int, int]]:
    """What a text sends of its shared runs (first, last, anchor, hot): (bytes, key, owner, rank, shift).

    Rank and shift say where the answer goes: it marks windows of the rank's stretch. A
    stretch that an earlier document has sent is not sent again, a hot one not taken apart again.
    """
    for rank, (first, last, anchor, hot) in enumerate(runs):
        data = text[first:last + length - 1]
        if not hot:
            if sent.setdefault(data, owner) == owner:
                yield data, anchor, owner, rank, 0
        elif sent.setdefault(data + b"\xff", owner) == owner:
            for shift in range(last - first):
                part = data[shift:shift + length]
                if sent.setdefault(part, owner) == owner:
                    yield part, xxhash.xxh3_64_intdigest(part), owner, rank, shift


def cut_runs(found: Windows, single: list, hot: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whether each run under a shared anchor is hot, and the numbers of those of each text.

    Changes `found`: its runs become those under shared anchors, none over MOST_WINDOWS windows.
    """
    shared = np.ones(len(found.first), dtype=bool)
    borders = np.searchsorted(found.text, np.arange(len(single) + 1))
    for k, alone in enumerate(single):
        shared[borders[k] + alone] = False
    keep = np.flatnonzero(shared)
    pieces = -(-(found.last[keep] - found.first[keep]) // MOST_WINDOWS)
    back = np.repeat(keep, pieces)
    step = np.arange(len(back)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = found.first[back] + step * MOST_WINDOWS
    found.last = np.minimum(found.last[back], first + MOST_WINDOWS)
    found.first, found.text, found.anchor = first, found.text[back], found.anchor[back]
    spot = np.searchsorted(hot, found.anchor.view(np.int64))
    is_hot = hot[np.minimum(spot, len(hot) - 1)] == found.anchor.view(np.int64) if len(hot) else np.zeros(len(first), dtype=bool)
    borders = np.searchsorted(found.text, np.arange(len(single) + 1))
    return is_hot, [np.arange(int(a), int(b)) for a, b in zip(borders[:-1], borders[1:])]


def _places(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, dtype=np.int32)


STRETCHES = "shard int, n int, size long, docs binary, ranks binary, shifts binary, data binary"
_STRETCHES = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), *((c, pa.binary()) for c in ("docs", "ranks", "shifts", "data"))])


def _stretch_tables(length: int, hot: np.ndarray, shards: int):
    """The stretches of a batch by shard, each distinct one from its first document only."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        # In the order of the documents, so that the first to send a stretch is its first document here.
        batch = batch.take(pc.sort_indices(batch, sort_keys=[("_doc", "ascending")]))
        owners = batch.column("_doc").to_pylist()
        single = [_places(x) for x in batch.column("single")]
        sent: dict[bytes, int] = {}
        out: list[tuple] = []
        for rows, found in _groups(batch, length):
            is_hot, own = cut_runs(found, [single[r] for r in rows], hot)
            runs = zip(*(c.tolist() for c in (found.first, found.last, found.anchor, is_hot)))
            for k, row in enumerate(rows):
                out.extend(stretches(found.data, itertools.islice(runs, len(own[k])), length, sent, owners[row]))
        texts, *numbers = zip(*out) if out else [()] * 5
        key, owner, rank, shift = (np.array(c, dtype=k) for c, k in zip(numbers, (np.uint64, np.int64, np.int32, np.int8)))
        shard = (key % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        tables = []
        for number, own in _runs_of(shard[order]):
            chosen = order[own]
            text = b"\xff".join([texts[i] for i in chosen.tolist()])
            tables.append((number, len(chosen), len(text), pack(owner[chosen]), pack(rank[chosen]), pack(shift[chosen]),
                           pa.compress(text, codec="zstd", asbytes=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*tables) if tables else [[]] * 7, _STRETCHES)], schema=_STRETCHES)

    return per_batch(run)


def partnered(parts: list[bytes], length: int) -> np.ndarray:
    """Numbers of the stretches that may share a window: a hash of one comes twice. A collision only sorts a stretch in vain."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    counts = sizes - length + 1
    ends = np.cumsum(sizes)
    found = []
    for rows in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(ends // GROUP_BYTES)) + 1):
        blocks = block_hashes(eights(b"".join(parts[rows[0]:rows[-1] + 1])))
        first = ends[rows] - sizes[rows] - (ends[rows[0]] - sizes[rows[0]])
        n = counts[rows]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        middle, last = blocks[at + (length - BLOCK) // 2], blocks[at + length - BLOCK]
        found.append(blocks[at] + middle * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xD6E8FEB86659FD93))
    hashes = np.concatenate(found)
    order = np.argsort(hashes)
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    twice = np.zeros(len(hashes), dtype=bool)
    twice[order[same]] = twice[order[same + 1]] = True
    return np.unique(np.repeat(np.arange(len(parts)), counts)[twice])


def first_windows(owners: np.ndarray, parts: list[bytes], length: int, memory: int, base: int) -> np.ndarray:
    """Which windows of each stretch no document of smaller number has: one bit for each."""
    text = np.frombuffer(b"".join(p + b"\xff" for p in parts), dtype=np.uint8)
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    start = np.cumsum(sizes) - sizes
    part_of = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    marks = np.zeros(len(parts), dtype=np.int64)
    # Places where a window of a stretch starts.
    window = np.arange(len(text)) - np.repeat(start, sizes) + length < np.repeat(sizes, sizes)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        """Whole groups: of each, the stretches of the smallest document keep the window."""
        places, group = np.concatenate([h[0] for h in held]), np.cumsum(np.concatenate([h[1] for h in held]))
        # Its members start with the same bytes, so a group fits into its stretches whole or not at all.
        whole = window[places]
        places, group = places[whole], group[whole]
        part = part_of[places]
        shift = places - start[part]
        if len(part):
            new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            owner = owners[part]
            least = np.repeat(np.minimum.reduceat(owner, new), np.diff(np.append(new, len(part))))
            hit = owner == least
            np.bitwise_or.at(marks, part[hit], np.int64(1) << shift[hit])

    waiting = 0
    for at, lcp in induced.descending(text, length, memory, base):
        new = lcp < length
        held.append((at, new))
        waiting += len(at)
        # The last group may go on in the next block.
        if waiting >= induced.BLOCK and len(ends := np.flatnonzero(new)):
            last = int(ends[-1])
            held[-1] = at[:last], new[:last]
            settle()
            held = [(at[last:], new[last:])]
            waiting = len(at) - last
    if held:
        settle()
    return marks


def _shard_rows(length: int, memory: int, base: int):
    """Sort each shard; rows come by shard."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        owners, ranks, shifts = (np.concatenate([h[k] for h in held]) for k in range(3))
        number: dict[bytes, int] = {}
        same = np.array([number.setdefault(data, len(number)) for h in held for data in h[3]], dtype=np.int64)
        parts = list(number)
        owner = np.full(len(parts), np.iinfo(np.int64).max)
        np.minimum.at(owner, same, owners)
        # A stretch that shares no window is its first document's; only the rest is sorted.
        sort = partnered(parts, length)
        marks = ~(np.int64(-1) << np.array([len(p) - length + 1 for p in parts], dtype=np.int64))
        if len(sort):
            marks[sort] = first_windows(owner[sort], [parts[k] for k in sort.tolist()], length, memory, base)
        mark = marks[same]
        sent = np.flatnonzero((owners == owner[same]) & (mark != 0))
        return pa.RecordBatch.from_arrays(
            [pa.array(owners[sent]), pa.array(ranks[sent]), pa.array(mark[sent] << shifts[sent].astype(np.int64))],
            names=["_of", "rank", "marks"])

    def run(batches):
        shard, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if held:
                        yield solve(held)
                    shard, held = row["shard"], []
                n = row["n"]
                numbers = (unpack(row[c], n, k) for c, k in (("docs", np.int64), ("ranks", np.int32), ("shifts", np.int8)))
                held.append((*numbers, pa.decompress(row["data"], row["size"], codec="zstd", asbytes=True).split(b"\xff")))
        if held:
            yield solve(held)

    return run


def _with_firsts(docs: DataFrame, length: int, memory: int, base: int, hot_share: float) -> tuple[DataFrame, np.ndarray]:
    """Documents with the anchors that only they hold and the first places of their windows; and the hot anchors."""
    spark = docs.sparkSession
    texts = docs.select("_doc", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot = hot_anchors(texts, length, hot_share)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHARD_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))
    found = texts.mapInArrow(_anchor_tables(length, parts), ANCHORS)
    # Equal rows have the same number and runs, so they are one document here too.
    single = (
        found.repartition("part").sortWithinPartitions("part").mapInArrow(_single_runs, "_own long, rank int")
        .groupBy("_own").agg(F.collect_list("rank").alias("single")))
    parsed = docs.join(single, F.col("_doc") == F.col("_own"), "left").drop("_own")
    # All columns, as the last step needs them: so both share one exchange of the texts.
    sent = parsed.mapInArrow(_stretch_tables(length, hot, shards), STRETCHES)
    sorted_ = sent.repartition("shard").sortWithinPartitions("shard")
    first = (
        sorted_.mapInArrow(_shard_rows(length, memory, base), "_of long, rank int, marks long")
        .groupBy("_of").agg(F.collect_list(F.struct("rank", "marks")).alias("firsts")))
    return parsed.join(first, F.col("_doc") == F.col("_of"), "left").drop("_of"), hot


def _spans(batch: pa.RecordBatch, length: int, hot: np.ndarray) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Text and repeated (start, end) byte spans of every row."""
    single = [_places(x) for x in batch.column("single")]
    firsts = batch.column("firsts")
    for rows, found in _groups(batch, length):
        sizes = np.append(found.start, len(found.data))
        _, own = cut_runs(found, [single[r] for r in rows], hot)
        # Windows marked by the shards are first places; all others under shared anchors are repeats.
        marks = np.zeros(len(found.first), dtype=np.int64)
        for k, row in enumerate(rows):
            answer = firsts[row]
            if answer.is_valid:
                items = answer.values
                np.bitwise_or.at(marks, own[k][0] + items.field(0).to_numpy(), items.field(1).to_numpy())
        counts = found.last - found.first
        shift = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        repeat = np.zeros(len(found.data), dtype=bool)
        repeat[np.repeat(found.first, counts) + shift] = (np.repeat(marks, counts) >> shift) & 1 == 0
        covered = w.covered(repeat, length, len(found.data)).view(np.int8)
        for k in range(len(rows)):
            begin, end = int(sizes[k]), int(sizes[k + 1])
            spans: list[tuple[int, int]] = []
            if len(own[k]):
                edges = np.flatnonzero(np.diff(covered[begin:end], prepend=0, append=0))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
            yield found.data[begin:end], spans


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def repeats(docs: DataFrame, length: int = LENGTH, memory: int = induced.MEMORY, base: int = induced.BASE,
            hot_share: float = HOT_SHARE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end in bytes) and kept_sha256 of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ready, hot = _with_firsts(_ordered(docs.select("doc_id", "text")), length, memory, base, hot_share)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], []]
        for text, spans in _spans(batch, length, hot):
            for column, value in zip(rows, (
                    len(text), sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans],
                    hashlib.sha256(_kept(text, spans)).hexdigest())):
                column.append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    return ready.select("doc_id", "text", "single", "firsts").mapInArrow(
        per_batch(one),
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, memory: int = induced.MEMORY, base: int = induced.BASE,
                   hot_share: float = HOT_SHARE) -> DataFrame:
    """`docs` with the repeated bytes out of `text`, and what is left of a character that was cut in two."""
    extra = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    ready, hot = _with_firsts(_ordered(docs.select("doc_id", "text", extra)), length, memory, base, hot_share)

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [_kept(text, spans).decode("utf-8", "ignore") for text, spans in _spans(batch, length, hot)]
        return pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "_kept"])

    kept = ready.select("_row", "text", "single", "firsts").mapInArrow(
        per_batch(strip), f"_row {docs.select(extra).schema['_row'].dataType.simpleString()}, _kept string")
    return kept.select(*[
        F.when(F.col("_row.text").isNotNull(), F.col("_kept")).alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c)
        for c in docs.columns])
