"""What the operators of this subpackage share."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but these bytes.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carry(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """`docs` with its columns beyond `own` under names nothing else has, and what gives them their names back.

    The second part takes a result that holds all columns of the first, and the names of
    columns added to it: those follow the columns of `docs`, whose own column of such a
    name gives way.
    """
    names = [c.lower() if c.lower() in own else f"carried_{i}" for i, c in enumerate(docs.columns)]

    def restore(out: DataFrame, *added: str) -> DataFrame:
        kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns) if c.lower() not in added]
        return out.select(*kept, *added)

    return docs.toDF(*names), restore


def word_array(text: Column | str) -> Column:
    """Words of a text; an empty array for null or blank text."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS)
    return F.filter(parts, lambda w: w != "")


def constant(value: list) -> Column:
    """A (nested) list of numbers as one literal array, folded once when the query is planned."""
    depth, inner = 0, value
    while isinstance(inner, list):
        depth, inner = depth + 1, inner[0] if inner else 0.0
    return F.from_json(F.lit(json.dumps(value)), "array<" * depth + "double" + ">" * depth)


def per_batch(make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]):
    """A mapInArrow function from a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = make(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return run


def utf8(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """Texts of a column as UTF-8 bytes, null as empty."""
    column = batch.column(name)
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    for value in column:
        yield value.as_py() or b""


def pack(values: np.ndarray) -> bytes:
    """Numbers with their equal bytes side by side, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)
