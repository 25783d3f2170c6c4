"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a longest stretch of words with smallest period q that holds at least
`min_exponent` periods and `min_length` words; no neighbouring word goes on with the
period. Texts are rows, so Spark only deals them out; a task sorts the suffixes of a
few texts at a time. The enhanced suffix array is the suffix array, its inverse (ISA)
and the common-prefix lengths (LCP); an LCP interval is read off as the nearest smaller
values on both sides of its LCP entry, no tree is built. In every interval of depth d
the suffixes i of all children but the largest are tested: if ISA[i + d] or ISA[i - d]
falls into the same interval, the two suffixes start a square of period d, and if the
words after them differ the square branches. A branching square is the right end of a
run: it is rotated to the left as long as words d apart are equal, and squares with the
same right end that a smaller period explains are merged into its run. Since a run of
`min_exponent` periods has as many suffixes in its interval, smaller intervals are
skipped and the squares further left are looked up in the interval too.

Defined results: a null or blank text has no words and no runs; a text of any length is
taken whole (memory grows with its words, times the logarithm of its longest repeat);
equal periods at one place are one run; repeated rows, rows sharing a doc_id and rows
without one get one result each; an empty table gives an empty table; extra columns are
ignored by `find_runs` and kept by `collapse`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainledger.llm.common import per_batch, utf8, word_array

MIN_EXPONENT = 4
MIN_LENGTH = 6
# Texts are sorted together up to about this many bytes; a longer one alone.
GROUP_BYTES = 1 << 21

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_ranks(ids: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ.

    A suffix ends with its text. Equal ranks in a list mean equal first words; the last
    list is the inverse suffix array. Each list has one more entry, -1, for the end.
    """
    n = len(ids)
    key = owner.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(fresh)
    rank = np.full(n + 1, -1, dtype=np.int32)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    ends = np.append(np.flatnonzero(np.diff(owner)) + 1, n)[owner - owner[0]]
    open_ = order[np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n)))]
    levels, width = [rank], 1
    while len(open_):
        have = levels[-1]
        after = open_ + width
        follow = np.where(after < ends[open_], have[np.minimum(after, n)], -1).astype(np.int64)
        key = have[open_].astype(np.int64) * (n + 1) + follow + 1
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        group = have[open_]
        new_group, new_key = np.ones(len(key), dtype=bool), np.ones(len(key), dtype=bool)
        new_group[1:], new_key[1:] = group[1:] != group[:-1], key[1:] != key[:-1]
        at = np.arange(len(key))
        first_of_group = np.maximum.accumulate(np.where(new_group, at, 0))
        first_of_key = np.maximum.accumulate(np.where(new_key, at, 0))
        rank = have.copy()
        rank[open_] = group + (first_of_key - first_of_group)
        levels.append(rank)
        firsts = np.flatnonzero(new_key)
        sizes = np.diff(np.append(firsts, len(key)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        width *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
    """lcp[r]: equal words of the suffixes at r - 1 and r; 0 at both ends."""
    n = len(sa)
    lcp = np.zeros(n + 1, dtype=np.int64)
    one = levels[0]
    at = np.flatnonzero(one[sa[1:]] == one[sa[:-1]]) + 1
    left, right, total = sa[at - 1].copy(), sa[at].copy(), np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][left] == levels[k][right]
        step = same.astype(np.int64) << k
        left += step
        right += step
        total += step
    lcp[at] = total
    return lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, start and end (exclusive) of the LCP interval of every entry above zero.

    Nearest smaller entries by pointer jumping: whatever lies between an entry and its
    pointer is no smaller than the entry.
    """
    before, after = np.arange(len(lcp)) - 1, np.arange(len(lcp)) + 1
    inner = np.flatnonzero(lcp > 0)
    for pointer in (before, after):
        active = inner
        while len(active):
            active = active[lcp[pointer[active]] >= lcp[active]]
            pointer[active] = pointer[pointer[active]]
    return inner, before[inner], after[inner]


def smaller_children(at: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval start, interval end, first suffix, size) of all children but one largest of each interval.

    Entries of equal depth in one interval are the borders between its children.
    """
    order = np.lexsort((at, end, start))
    at, start, end = at[order], start[order], end[order]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    last = np.append(first[1:], True)
    # One child ends at each border, one more after the last border of an interval.
    opened = np.where(first, start, np.append(0, at[:-1]))
    kid = np.concatenate([opened, at[last]])
    size = np.concatenate([at, end[last]]) - kid
    lo, hi = np.concatenate([start, start[last]]), np.concatenate([end, end[last]])
    order = np.lexsort((-size, hi, lo))
    lo, hi, kid, size = lo[order], hi[order], kid[order], size[order]
    drop = np.ones(len(lo), dtype=bool)
    drop[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[~drop], hi[~drop], kid[~drop], size[~drop]


def member(isa: np.ndarray, suffix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which suffixes lie in the interval from `low` to before `high`."""
    place = isa[np.clip(suffix, 0, len(isa) - 1)]
    return (suffix >= 0) & (place >= low) & (place < high)


def branching_squares(ids: np.ndarray, owner: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """End (exclusive) and period of every branching square that `exponent` periods lead up to."""
    none = np.zeros(0, dtype=np.int64)
    n = len(ids)
    if n < exponent:
        return none, none
    levels = suffix_ranks(ids, owner)
    isa = levels[-1]
    sa = np.empty(n, dtype=np.int64)
    sa[isa[:n]] = np.arange(n)
    lcp = common_prefixes(levels, sa)
    del levels
    at, start, end = intervals(lcp)
    big = end - start >= exponent
    if not big.any():
        return none, none
    lo, hi, kid, size = smaller_children(at[big], start[big], end[big])
    # The depth of an interval is the smallest common prefix inside it: that of any border.
    depth_of = depths(at[big], start[big], end[big], lcp, lo, hi)
    tail = np.append(ids, -1)
    stop = np.append(np.flatnonzero(np.diff(owner)) + 1, n)[owner - owner[0]]
    ends, periods = [], []
    # Leaves of the children in pieces, so that memory stays bounded.
    for piece in _pieces(size):
        counts = size[piece]
        total = int(counts.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        i = sa[np.repeat(kid[piece], counts) + inside]
        l, r, d = (np.repeat(x[piece], counts) for x in (lo, hi, depth_of))

        for square, other in ((i, i + d), (i - d, i - d)):
            hit = np.flatnonzero(member(isa, other, l, r))
            if not len(hit):
                continue
            s, p, low, high = square[hit], d[hit], l[hit], r[hit]
            edge = s + 2 * p
            branch = (edge >= stop[s]) | (tail[np.minimum(edge, n)] != tail[s + p])
            for t in range(3, exponent + 1):
                branch &= member(isa, edge - t * p, low, high)
            ends.append(edge[branch])
            periods.append(p[branch])
    if not ends:
        return none, none
    pairs = np.unique(np.stack([np.concatenate(ends), np.concatenate(periods)]), axis=1)
    return pairs[0], pairs[1]


def depths(at, start, end, lcp, lo, hi) -> np.ndarray:
    """Depth of each (lo, hi) interval, looked up among the borders."""
    width = np.int64(len(lcp) + 1)
    keys = start * width + end
    order = np.argsort(keys, kind="stable")
    return lcp[at[order][np.searchsorted(keys[order], lo * width + hi)]]


def _pieces(size: np.ndarray, most: int = 1 << 21) -> Iterator[slice]:
    """Slices of the children that hold about `most` leaves each."""
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield slice(at, stop)
        at = stop


def rotate_left(ids: np.ndarray, start: int, period: int, low: int) -> int:
    """Smallest start to which the period reaches, in steps that double."""
    step = 16
    while start > low:
        step = min(step, start - low)
        differ = np.flatnonzero(ids[start - step:start] != ids[start - step + period:start + period])
        if len(differ):
            return start - step + int(differ[-1]) + 1
        start -= step
        step *= 2
    return start


def text_runs(ids: np.ndarray, lengths: list[int], exponent: int, length: int) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each of several texts, given as word numbers end to end."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    used = np.flatnonzero(np.asarray(lengths))
    if not len(used):
        return found
    sizes = np.asarray(lengths)[used]
    owner = np.repeat(np.arange(len(used)), sizes)
    ends, periods = branching_squares(ids, owner, exponent)
    first = np.cumsum(sizes) - sizes
    known: list[tuple[int, int]] = []
    here = -1
    for end, period in zip(ends.tolist(), periods.tolist()):
        if end != here:
            here, known = end, []
        text = int(owner[end - 1])
        if any(period % q == 0 and end - 2 * period >= s for q, s in known):
            continue  # a multiple of a smaller period
        low = int(first[text])
        start = rotate_left(ids, end - exponent * period, period, low)
        known.append((period, start))
        if end - start >= length:
            found[used[text]].append((start - low, end - start, period))
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    return found


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run repeats: a run keeps its first period, unless another run drops words of it."""
    if not runs:
        return words
    drop = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        drop[start + period:start + length] = True
    return [w for w, gone in zip(words, drop.tolist()) if not gone]


def _groups(batch: pa.RecordBatch, exponent: int, length: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text of a batch, a bounded number of texts at a time."""
    texts: list[list[bytes]] = []
    size = 0

    def flush():
        flat = pa.array([w for words in texts for w in words], pa.binary())
        ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        yield from zip(texts, text_runs(ids, [len(words) for words in texts], exponent, length))

    for text in utf8(batch, "text"):
        texts.append(text.split())
        size += len(text)
        if size >= GROUP_BYTES:
            yield from flush()
            texts, size = [], 0
    if texts:
        yield from flush()


def _structs(runs: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs]


def find_runs(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and `collapsed`, the text without repeated periods."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, runs, collapsed = [], [], []
        for words, found in _groups(batch, min_exponent, min_length):
            counts.append(len(words))
            runs.append(_structs(found))
            collapsed.append(b" ".join(kept_words(words, found)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, _RUN),
             pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        per_batch(one), f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def collapse(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """`docs` with the repeated periods out of `text`; a text without runs is unchanged."""

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for (words, found), text in zip(_groups(batch, min_exponent, min_length), batch.column("text")):
            texts.append(b" ".join(kept_words(words, found)).decode("utf-8") if found else text.as_py())
        at = batch.schema.get_field_index("text")
        columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(per_batch(strip), docs.schema)


def with_periods(docs: DataFrame, salt: str = "doc_id", every: int = 10) -> DataFrame:
    """doc_id and text, where one text of `every` repeats a period from one of its words on.

    Which texts, from where and how often follows from the CRC-32 of `salt` as text:
    texts without a salt, like texts without words, stay as they are.
    """
    crc = F.crc32(F.encode(F.col(salt).cast("string"), "utf-8"))
    chosen = docs.select("doc_id", "text", crc.alias("_h")).withColumn("_g", F.floor(F.col("_h") / every))
    words = F.when(F.col("_h") % every == 0, word_array("text"))
    sized = chosen.withColumn("_words", words).withColumn("_n", F.size("_words"))
    start = F.col("_g") % F.col("_n")
    placed = sized.withColumn("_a", F.when(F.col("_n") > 0, start).cast("int")).withColumn(
        "_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail = F.transform(
        F.sequence(F.col("_a"), F.col("_n") - 1),
        lambda i: F.element_at("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1))
    made = F.concat_ws(" ", F.slice("_words", F.lit(1), F.col("_a")), tail)
    return placed.select("doc_id", F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))
