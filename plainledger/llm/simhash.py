"""SimHash fingerprints and their near pairs by a binary trie self-join.

Fingerprints are linked when they differ in at most `budget` bits. By the pigeonhole
rule such a pair agrees on one of `budget + 1` blocks, so the bits are rotated once
per block and each rotation is a trie whose first level is that block: all pairs
below different block nodes spent an error there and are found in another rotation.
Below a block node the trie is joined with itself: pairs of nodes go down together,
add up the bits in which they differ and end when the budget is exceeded. A node pair
with too many leaves for one task is first replaced, in Spark, by the pairs of its
children that are still within the budget.

Copies share a fingerprint and enter the trie once. Tasks return spanning links, not
all pairs; components are joined by alternating stars.

Defined results: null, empty and blank texts have fingerprint zero and are linked like
any other; repeated rows share a component; a component without any doc_id has a null
component_id; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainledger.llm import nearcopies
from plainledger.llm.common import carry, per_batch, utf8
from plainledger.llm.graph import components
from plainledger.operators.skew import spread_join
from plainledger.session import cut

BUDGET = 3
SHINGLE = 3
SEED = 42
BLOCK = 16  # 64 bits over budget + 1 blocks
STEP = 4  # bits by which a crowded node pair is refined
NODE_LIMIT = 1 << 13
TASK_ROWS = 1 << 16
LEAF_PAIRS = 64
FRONTIER = 1 << 19


@lru_cache(maxsize=1)
def _bits_of_bytes() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit set, lowest bit first."""
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _bits_of_bytes() for k in range(8)])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats included."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(found) >= size:
        starts, ends = starts[: len(found) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 1 << 15):
        part = slice(at, at + (1 << 15))
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist())], dtype="<u8")
        ones += bit_counts(hashes)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > len(starts)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit number) of every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t) for t in utf8(batch, "text")), dtype=np.uint64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_batch(one), f"doc_id {id_type}, fingerprint long")


def _rotate(value: Column, by: int) -> Column:
    if not by:
        return value
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def trie_rows(prints: DataFrame) -> DataFrame:
    """One row per distinct fingerprint and rotation, under its block node.

    A task is a pair of nodes (a, b) of equal depth in one trie; `side` tells which
    node the leaf is below, `spent` how many bits the two nodes differ in.
    """
    turned = F.array(*[
        F.struct(F.lit(r).alias("trie"), _rotate(F.col("fingerprint"), r * BLOCK).alias("leaf"))
        for r in range(BUDGET + 1)])
    rows = prints.select(F.inline(turned))
    node = F.shiftrightunsigned(F.col("leaf"), 64 - BLOCK)
    return rows.select("trie", node.alias("a"), node.alias("b"), F.lit(0).alias("spent"), F.lit(0).alias("side"), "leaf")


def refined(rows: DataFrame, depth: int) -> DataFrame:
    """Rows of crowded node pairs under the pairs of child nodes within the budget."""
    fan = 1 << STEP
    child = F.shiftrightunsigned(F.col("leaf"), 64 - depth - STEP).bitwiseAND(F.lit(fan - 1))
    mate = F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("mate")
    spread = rows.select("*", child.alias("child"), mate).withColumn(
        "spent", F.col("spent") + F.bit_count(F.col("child").bitwiseXOR(F.col("mate").cast("long")))
    ).filter(F.col("spent") <= BUDGET)
    own = F.col("a") * fan + F.col("child")
    other = F.col("a") * fan + F.col("mate")
    same = F.col("a") == F.col("b")
    return spread.select(
        "trie",
        F.when(same, F.least(own, other)).otherwise(F.col("a") * fan + F.when(F.col("side") == 0, F.col("child")).otherwise(F.col("mate"))).alias("a"),
        F.when(same, F.greatest(own, other)).otherwise(F.col("b") * fan + F.when(F.col("side") == 0, F.col("mate")).otherwise(F.col("child"))).alias("b"),
        "spent",
        F.when(same, (own > other).cast("int")).otherwise(F.col("side")).alias("side"),
        "leaf",
    )


def split_crowded(rows: DataFrame, limit: int = NODE_LIMIT) -> DataFrame:
    """Replace node pairs with more than `limit` leaves until none is left."""
    task = ["trie", "a", "b"]
    done, depth = None, BLOCK
    while depth < 64:
        crowded = cut(rows.groupBy(*task).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).drop("n"))
        if crowded.isEmpty():
            break
        calm = rows.join(crowded, task, "left_anti")
        done = calm if done is None else done.unionByName(calm)
        rows = cut(refined(rows.join(crowded, task, "left_semi"), depth))
        depth += STEP
    return rows if done is None else done.unionByName(rows)


def _expand(lo1, n1, lo2, n2):
    """All index pairs of the given range pairs."""
    total = n1 * n2
    owner = np.repeat(np.arange(len(total)), total)
    rank = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    return lo1[owner] + rank // n2[owner], lo2[owner] + rank % n2[owner]


def _close(leaves: np.ndarray, i: np.ndarray, j: np.ndarray):
    near = (i < j) & (np.bitwise_count(leaves[i] ^ leaves[j]) <= BUDGET)
    return i[near], j[near]


def trie_pairs(leaves: np.ndarray, starts: np.ndarray, mids: np.ndarray, ends: np.ndarray, spent: np.ndarray):
    """Index pairs within the budget; leaves are sorted inside each side of each task.

    Task k joins leaves[starts[k]:mids[k]] with leaves[mids[k]:ends[k]], or the first
    range with itself when the second is empty. Yields arrays, never all pairs at once.
    """
    own = mids == ends
    lo2, hi2 = np.where(own, starts, mids), np.where(own, mids, ends)
    stack = [(0, starts, mids, lo2, hi2, spent)]
    counts: dict[int, np.ndarray] = {}
    while stack:
        depth, lo1, hi1, lo2, hi2, used = stack.pop()
        n1, n2 = hi1 - lo1, hi2 - lo2
        live = (n1 > 0) & (n2 > 0) & (used <= BUDGET) & ~((lo1 == lo2) & (n1 == 1))
        small = live & (n1 * n2 <= LEAF_PAIRS)
        if depth == 64:
            small = live
        if small.any():
            at = np.flatnonzero(small)
            for k in range(0, len(at), FRONTIER // LEAF_PAIRS):
                some = at[k: k + FRONTIER // LEAF_PAIRS]
                yield _close(leaves, *_expand(lo1[some], n1[some], lo2[some], n2[some]))
        rest = np.flatnonzero(live & ~small)
        if not len(rest):
            continue
        if len(rest) > FRONTIER:
            for half in np.array_split(rest, 2):
                stack.append((depth, lo1[half], hi1[half], lo2[half], hi2[half], used[half]))
            continue
        if depth not in counts:
            bit = (leaves >> np.uint64(63 - depth)) & np.uint64(1)
            counts[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        ones = counts[depth]
        a, b, c, d, used = lo1[rest], hi1[rest], lo2[rest], hi2[rest], used[rest]
        m1, m2 = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        parts = [(a, m1, c, m2, used), (m1, b, m2, d, used), (a, m1, m2, d, used + 1),
                 tuple(x[~same] for x in (m1, b, c, m2, used + 1))]
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))


def spanning(n: int, pairs) -> np.ndarray:
    """Smallest index connected to each of n nodes by the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def _links(table: pa.Table) -> pa.RecordBatch:
    """Spanning links of the tasks in a table sorted by task, side and leaf."""
    trie, a, b, spent, side = (table.column(c).to_numpy().astype(np.int64) for c in ("trie", "a", "b", "spent", "side"))
    leaves = table.column("leaf").to_numpy().view(np.uint64)
    order = np.lexsort((leaves, side, b, a, trie))
    trie, a, b, spent, side, leaves = (x[order] for x in (trie, a, b, spent, side, leaves))
    new = np.ones(len(trie), dtype=bool)
    new[1:] = (trie[1:] != trie[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(trie))
    right = np.concatenate([[0], np.cumsum(side)])
    mids = ends - (right[ends] - right[starts])
    # A task of two nodes of which one is empty holds no pair.
    whole = (a[starts] == b[starts]) | ((mids > starts) & (mids < ends))
    starts, mids, ends = starts[whole], mids[whole], ends[whole]
    turn = (trie * BLOCK).astype(np.uint64)
    back = np.where(turn == 0, leaves, (leaves >> turn) | (leaves << ((np.uint64(64) - turn) & np.uint64(63))))
    names, index = np.unique(back.view(np.int64), return_inverse=True)
    root = spanning(len(names), ((index[i], index[j]) for i, j in trie_pairs(leaves, starts, mids, ends, spent[starts])))
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays(
        [pa.array(names[linked]), pa.array(names[root[linked]])], names=["u", "v"])


def _join_tasks(batches):
    """Cut the sorted rows of a partition at task borders and join each part."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < TASK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(c).to_numpy() for c in ("trie", "a", "b")]
        last = np.ones(len(table), dtype=bool)
        for key in keys:
            last &= key == key[-1]
        border = len(table) - int(np.count_nonzero(last))
        if border:
            yield _links(table.slice(0, border))
            held = table.slice(border).to_batches()
            rows = len(table) - border
    if rows:
        yield _links(pa.Table.from_batches(held))


def near_links(prints: DataFrame, limit: int = NODE_LIMIT) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within the budget."""
    rows = split_crowded(trie_rows(prints), limit)
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, math.ceil(prints.count() * (BUDGET + 1) / (4 * TASK_ROWS)))
    return (
        rows.repartition(tasks, "trie", "a", "b")
        .sortWithinPartitions("trie", "a", "b")
        .mapInArrow(_join_tasks, "u long, v long")
    )


def near_duplicates(docs: DataFrame, limit: int = NODE_LIMIT) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of `docs`."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(distinct.select("fingerprint"), limit))
    grouped = cut(
        distinct.join(roots, F.col("fingerprint") == F.col("node"), "left")
        .select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")))
    ids = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # A component with many distinct texts is a hot root; one with many copies a hot fingerprint.
    named = spread_join(grouped, ids, ["root"], F.col("fingerprint")).select("fingerprint", "component_id")
    out = spread_join(prints, named, ["fingerprint"], F.col("doc_id"))
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, if one has an id.

    Near copies are those of `nearcopies` (five-word shingles, similarity 0.8), not pairs
    of fingerprints. A row is known by its doc_id and its text: unlike texts under one id
    (or none) are judged apart, and of rows equal in both one stays.
    """
    docs, restore = carry(docs, ("doc_id", "text"))
    keep = nearcopies.firsts(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_same"))
    kept = docs.withColumn("_hash", F.xxhash64("text")).join(
        keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_same")), "left_semi")
    return restore(kept.dropDuplicates(["doc_id", "_hash"]))
