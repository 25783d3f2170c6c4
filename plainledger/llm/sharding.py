"""Uniform sharding by a hypergeometric communication matrix.

Law `rows`: shard sizes are fixed first and differ by one row at most. The rows of a
block (scan partitions, folded into at most `BLOCKS`) are a sample without replacement
of all places, so how many of them go to each shard is drawn from the multivariate
hypergeometric distribution, block after block, from what the shards still lack. Each
block is permuted locally by a seeded hash and dealt by those counts, then rows are
exchanged, and each shard is permuted again by a second hash, in hash ranges whose
counts give every range its first slot. Every placement is equally likely and the
sizes are exact; no task sees a whole shard.

The matrix has at most BLOCKS x shards counts and is the only thing drawn on the
driver. Rows are tagged once in a written table, so a retried task deals them alike.

Defined results: nulls in any column and equal rows are dealt like any others; fewer
rows than shards leave shards empty; an empty table gives an empty table; columns of
the input named `shard` or `slot` are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plainledger.llm.common import carry
from plainledger.session import cut

BLOCKS = 4096
RANGE_ROWS = 1 << 16


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most and add up to `rows`."""
    return np.full(shards, rows // shards, dtype=np.int64) + (np.arange(shards) < rows % shards)


# Totals that numpy's own draws take.
PLAIN_TOTAL = 1_000_000_000


def hypergeometric(dice: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` rows out of good + bad are good ones, for totals of any size.

    Inversion over the probabilities around the mode, each from the one next to it by
    their exact ratio; beyond 40 standard deviations they are far below the last bit.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    total = good + bad
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = 40 * (1 + math.isqrt(drawn * good // total * bad // total))
    up = np.arange(mode, min(high, mode + spread), dtype=np.float64)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    rising = np.cumprod((good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1)))
    falling = np.cumprod(down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1)))
    sums = np.cumsum(np.concatenate([falling[::-1], [1.0], rising]))
    return mode - len(falling) + int(np.searchsorted(sums, dice.random() * sums[-1], side="right"))


def communication(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each block that go to each shard; both margins are exact."""
    left = shard_sizes(sum(blocks), shards)
    dice = np.random.Generator(np.random.Philox(seed))
    out = np.zeros((len(blocks), shards), dtype=np.int64)
    for k, size in enumerate(blocks):
        if left.sum() < PLAIN_TOTAL:
            out[k] = dice.multivariate_hypergeometric(left, size, method="marginals")
        else:
            # One shard after the other, out of what the later ones hold.
            others, wanted = int(left.sum()), size
            for j, own in enumerate(left.tolist()):
                others -= own
                out[k, j] = hypergeometric(dice, own, others, wanted) if others else wanted
                wanted -= int(out[k, j])
        left -= out[k]
    return out


def shard(docs: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """`docs` with `shard` and a gapless `slot` from 0 in each shard."""
    spark = docs.sparkSession
    docs, restore = carry(docs, ())
    place = F.monotonically_increasing_id()
    tagged = cut(docs.withColumn("_place", place))
    # The high bits of the place are the partition that wrote the row.
    block = (F.shiftright("_place", 33) % BLOCKS).cast("int")
    tagged = tagged.withColumn("_block", block)
    counts = sorted((r["_block"], r["n"]) for r in tagged.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        empty = tagged.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).filter("false")
        return restore(empty, "shard", "slot")
    matrix = communication([n for _, n in counts], shards, seed)
    plan = spark.createDataFrame(
        [(b, np.cumsum(row).tolist()) for (b, _), row in zip(counts, matrix)], "_of int, _ends array<long>")
    dealt = _in_block(tagged, seed).join(plan, F.col("_block") == F.col("_of")).withColumn(
        "shard", F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))).cast("int")).drop("_of", "_ends", "_block", "_rank")
    ranges = max(1, math.ceil(sum(n for _, n in counts) / shards / RANGE_ROWS))
    return restore(_in_shard(dealt, ranges, seed), "shard", "slot")


def _in_block(rows: DataFrame, seed: int) -> DataFrame:
    """Place of each row in its block's permutation, from 0."""
    order = Window.partitionBy("_block").orderBy(F.xxhash64("_place", F.lit(seed)), "_place")
    return rows.withColumn("_rank", F.row_number().over(order) - 1)


def _in_shard(rows: DataFrame, ranges: int, seed: int) -> DataFrame:
    """Slots by a second hash: a range's first slot is the count of the ranges before it."""
    mixed = F.xxhash64("_place", F.lit(seed + 1), F.lit("slot"))
    step = F.floor(F.shiftrightunsigned(mixed, 33) * ranges / F.lit(float(1 << 31))).cast("int")
    placed = rows.withColumn("_mixed", mixed).withColumn("_range", step)
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("shard").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_mixed", "_place")) - 1
    return (
        placed.withColumn("_inside", inside)
        .join(starts, (F.col("shard") == F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("slot", (F.col("_first") + F.col("_inside")).cast("long"))
        .drop("_mixed", "_range", "_inside", "_first", "_s", "_r")
    )
