"""Quality rules with cross-document line frequency.

Lines are normalised (ASCII lower case, blanks collapsed) and hashed. For each host
(`source`) a line is boilerplate when it occurs in at least `min_texts` distinct
texts and in more than `max_share` of the host's distinct texts; copies of one text
count once, so a group of copies never makes its own lines boilerplate. Boilerplate
lines are removed, and a document that loses more than `max_loss` of its words is
depleted and rejected. Base rules: fewer than `min_words` words, or more than half of
the words in repeated 3-word windows.

Only hashes and counts leave the row: one short row per distinct line of a document.

Defined results: null text counts as empty (no words, base_failed); a null host is a
host of its own; repeated rows are each judged, and count once as a text; an empty
table gives an empty table; extra columns are ignored by `judge` and kept by `clean`,
where the operator's own columns never clash because only `text` and `n_chars` change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainledger.llm import words as w
from plainledger.llm.common import carry, per_batch, utf8
from plainledger.session import cut

MIN_WORDS = 50
MIN_TEXTS = 10
MAX_SHARE = 0.02
MAX_LOSS = 0.8

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

_DIGEST = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64())),
])
DIGEST = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "lines array<long>, line_words array<long>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(line: bytes) -> int:
    """Signed hash of a normalised line; equal for lines that differ in case or blanks only."""
    return _signed(xxhash.xxh64_intdigest(b" ".join(line.lower().split())))


def line_counts(text: bytes) -> tuple[dict[int, int], int]:
    """Words per distinct normalised line, and how many lines equal an earlier one."""
    found: dict[int, int] = {}
    exact: set[bytes] = set()
    n_lines = 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            n_lines += 1
            exact.add(line)
            key = line_hash(line)
            found[key] = found.get(key, 0) + n
    return found, n_lines - len(exact)


def base_counts(text: bytes) -> tuple[int, int, int, int]:
    """Words, their code points, symbols, and words in repeated 3-word windows."""
    hashes = w.hashes(text)
    data = np.frombuffer(text, dtype=np.uint8)
    chars = int(np.count_nonzero(((data & 0xC0) != 0x80) & ~w._blank()[data]))
    symbols = int(np.count_nonzero(_SYMBOLS[data]))
    repeated = 0
    windows = w.runs(hashes, 3)
    if len(windows) > 1:
        _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        hit = counts[back] > 1
        if hit.any():
            repeated = int(np.count_nonzero(w.covered(hit, 3, len(hashes))))
    return len(hashes), chars, symbols, repeated


def digests(docs: DataFrame) -> DataFrame:
    """Per row: its id and host, the base counts and the hashes of its distinct lines."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in _DIGEST]
        for text in utf8(batch, "text"):
            lines, dup = line_counts(text)
            n, chars, symbols, repeated = base_counts(text)
            row = (n, chars, symbols, dup, repeated, list(lines), list(lines.values()))
            for column, value in zip(columns, row):
                column.append(value)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _DIGEST)]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "host", "text_hash")), *arrays],
            names=["doc_id", "host", "text_hash", *_DIGEST.names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("source").cast("string").alias("host"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        per_batch(one), f"doc_id {id_type}, host string, text_hash long, {DIGEST}")


def boilerplate(digest: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, n_texts) of the lines above the limits."""
    lines = digest.select("host", "text_hash", F.explode("lines").alias("line"))
    # Two combinable aggregates: copies of a text meet first, then texts are counted.
    texts = lines.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("one"))
    counts = texts.groupBy("host", "line").agg(F.count("one").alias("n_texts")).filter(F.col("n_texts") >= min_texts)
    sizes = (digest.groupBy("host", "text_hash").agg(F.lit(1).alias("one"))
             .groupBy(F.col("host").alias("of")).agg(F.count("one").alias("host_texts")))
    return counts.join(sizes, F.col("host").eqNullSafe(F.col("of"))).filter(
        F.col("n_texts") > F.col("host_texts") * max_share).select("host", "line", "n_texts")


def judge(docs: DataFrame, min_words: int = MIN_WORDS, min_texts: int = MIN_TEXTS,
          max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS) -> DataFrame:
    """Base counts, removed words and lines, and the verdict of every row of `docs`."""
    digest = cut(digests(docs).withColumn("row_id", F.monotonically_increasing_id()))
    common = cut(boilerplate(digest, min_texts, max_share)).select(
        F.col("host").alias("of"), F.col("line").alias("removed"))
    lines = digest.select("row_id", "host", F.inline(F.arrays_zip("lines", "line_words")))
    lost = (
        lines.join(common, (F.col("lines") == F.col("removed")) & F.col("host").eqNullSafe(F.col("of")))
        .groupBy(F.col("row_id").alias("row"))
        .agg(F.sum("line_words").alias("words"), F.collect_list("removed").alias("removed_lines"))
    )
    n = F.col("n_words")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > 50 * n)
    removed = F.coalesce(F.col("words"), F.lit(0)).cast("long")
    return (
        digest.join(lost, F.col("row_id") == F.col("row"), "left")
        .withColumn("base_failed", failed)
        .withColumn("n_removed_words", removed)
        .withColumn("kept", ~failed & ~(removed > n * max_loss))
        .select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "n_removed_words", "removed_lines", "kept")
    )


def clean(docs: DataFrame, **limits) -> DataFrame:
    """Accepted documents without their boilerplate lines; the columns of `docs`.

    Verdicts are joined by id, host and text, so the rows of one id with different
    texts keep their own verdicts.
    """

    docs, restore = carry(docs, ("doc_id", "source", "text", "n_chars"))

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, gone in zip(utf8(batch, "text"), batch.column("_gone").to_pylist()):
            removed = set(gone or ())
            if removed:
                text = b"\n".join(x for x in text.split(b"\n") if not x.split() or line_hash(x) not in removed)
            texts.append(text.decode("utf-8", "replace"))
        names = [n for n in batch.schema.names if n != "_gone"]
        arrays = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    verdict = judge(docs, **limits).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash"),
        F.col("removed_lines").alias("_gone")).groupBy("_id", "_host", "_hash").agg(F.first("_gone").alias("_gone"))
    kept = docs.join(
        verdict,
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_host"))
        & (F.xxhash64("text") == F.col("_hash")))
    kept = kept.select(*docs.columns, "_gone")
    out = kept.mapInArrow(per_batch(strip), _ddl(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return restore(out)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

