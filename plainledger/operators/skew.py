"""Helpers that keep a hot key, group or order from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A task should hold about this many rows of one key, fewer in a small table: at most
# PIECE_SHARE of it. A table is never cut into more than MAX_PIECES pieces, which
# bounds the hot keys, so the table of them may be broadcast whatever the data size.
PIECE_ROWS = 1_000_000
PIECE_SHARE = 0.01
MAX_PIECES = 65_536
# Quantile ranges of an ordered numbering; each is cut into as many widths as its rows need.
QUANTILES = 64
WIDTHS = 64


def piece(total: Column) -> Column:
    """Rows of one key that one task takes, in a table of `total` rows."""
    return F.greatest(F.least(total * PIECE_SHARE, F.lit(float(PIECE_ROWS))), total / MAX_PIECES)


def hot_of(counts: DataFrame, n: str = "_n") -> DataFrame:
    """Keys of a count table that hold more than one piece, and how many `_pieces`."""
    # One row of totals.
    whole = counts.agg(piece(F.sum(n)).alias("_piece"))
    return counts.join(F.broadcast(whole)).filter(F.col(n) > F.col("_piece")).withColumn(
        "_pieces", F.ceil(F.col(n) / F.col("_piece")).cast("int")).drop("_piece", n)


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hot keys of a table and their `_pieces`; at most MAX_PIECES of them."""
    return hot_of(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))


def spread_join(big: DataFrame, small: DataFrame, keys: Sequence[str], row_id: Column,
                how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join a side with hot keys to a lookup side, each hot key over as many tasks as it needs.

    Only rows of hot or null keys are spread and only lookup rows of hot keys are
    repeated. The hot-key table is broadcast; MAX_PIECES bounds it. A caller that has
    counted its keys already passes `hot_of` its counts.
    """
    keys = list(keys)
    # A null key meets nothing, so its rows may lie anywhere.
    empty = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    found = hot_keys(big, keys) if hot is None else hot
    hot = F.broadcast(found.select(*keys, "_pieces"))
    place = F.xxhash64(row_id)
    salted = big.join(hot, keys, "left").withColumn("_salt", F.when(empty, F.pmod(place, F.lit(MAX_PIECES))).otherwise(
        F.pmod(place, F.coalesce("_pieces", F.lit(1)))).cast("int")).drop("_pieces")
    copies = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    repeated = small.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_pieces")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def ordered_position(df: DataFrame, order: str, tie: Sequence[str] = (),
                     within: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Row number by a numeric order column without sorting a whole group in one task.

    Quantile boundaries cut the order into ranges and each range into equal widths;
    a small count table turns them into offsets; rows are numbered inside their
    range. Boundaries only balance the work: any boundaries give the same numbers.
    """
    within = list(within)
    number = F.col(order).cast("double")
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    cuts = df.agg(
        F.percentile_approx(number, steps, 10000).alias("_cuts"), F.min(number).alias("_low"), F.max(number).alias("_high"),
        F.greatest(F.lit(WIDTHS), F.ceil(F.count(F.lit(1)) / (QUANTILES * PIECE_ROWS))).cast("int").alias("_widths"))
    # One row of boundaries.
    joined = df.join(F.broadcast(cuts)).withColumn(
        "_part", F.size(F.filter("_cuts", lambda c: c < number)))
    low = F.coalesce(F.get("_cuts", F.col("_part") - 1), F.col("_low"))
    high = F.coalesce(F.get("_cuts", F.col("_part")), F.col("_high"))
    inner = F.coalesce(F.floor((number - low) / F.nullif(high - low, F.lit(0.0)) * F.col("_widths")), F.lit(0))
    place = F.col("_part") * F.col("_widths") + F.least(F.greatest(inner, F.lit(0)), F.col("_widths") - 1)
    placed = joined.withColumn("_range", F.coalesce(place.cast("int"), F.lit(-1))).drop("_cuts", "_low", "_high", "_part", "_widths")
    sizes = placed.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(order, *tie))
    numbered = placed.withColumn("_inside", inside)
    out = _null_safe(numbered, offsets, [*within, "_range"])
    return out.withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long")).drop(
        "_inside", "_offset", "_range"
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right
    on = None
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
        term = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        on = term if on is None else on & term
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])
