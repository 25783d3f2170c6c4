"""WARC archives through a chunked record table.

A payload becomes rows of record id and chunk number, none longer than `chunk_bytes`:
the first chunk is a response record, the others are its continuation records with
segment numbers, as the format's segmentation has it. Each chunk carries the digest of
its own block and the first that of the whole payload; readers add the chunks of a
record to a running digest in order, so no record is put together again. A payload of
at least `min_bytes` that equals one with a smaller page_id is a revisit record
without a body.

Rows are written by Spark's text writer, so files appear only when their task is
committed, in any store Spark can write. The header's first field holds a boundary
drawn once per archive: version line and boundary begin every record and cannot occur
in a payload, so Spark's reader can split an archive anywhere between records.

Defined results: null html is an empty payload; a null url is an empty target URI; an
empty page, and one below `min_bytes`, is a response; rows that share a page_id become
records of their own, which readers cannot tell apart, so of rows with the same
page_id and payload one record is returned per row; a null page_id sorts last among
equal payloads; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainledger.session import cut, run_dir

CHUNK_BYTES = 1 << 20
MIN_BYTES = 100
_END = "\r\n"


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(revisit, refers_to): pages whose payload an earlier page_id has."""
    sums = cut(pages.select("page_id", _payload().alias("payload")).select(
        "page_id", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest")
    ).filter(F.col("bytes") >= min_bytes).select("page_id", F.unhex("digest").alias("digest")))
    first = sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > 1).select(F.col("digest").alias("same"), "refers_to")
    return cut(
        sums.join(first, F.col("digest") == F.col("same"))
        .filter(F.col("page_id") != F.col("refers_to"))
        .select(F.col("page_id").alias("revisit"), "refers_to").distinct())


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")


def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per chunk: page_id, url, record_type, refers_to, chunk, chunks, bytes, digest, body."""
    again = revisits(pages, min_bytes)
    payload = F.col("payload")
    known = (
        pages.select("page_id", "url", _payload().alias("payload"))
        .join(again, F.col("page_id") == F.col("revisit"), "left").drop("revisit")
        .withColumn("bytes", F.octet_length("payload").cast("long"))
        .withColumn("digest", F.sha2("payload", 256))
        # A short payload is never a revisit, whatever an equal page_id may be.
        .withColumn("refers_to", F.when(F.col("bytes") >= min_bytes, F.col("refers_to")))
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    )
    pieces = F.greatest(F.ceil(F.col("bytes") / chunk_bytes), F.lit(1)).cast("int")
    rows = known.withColumn("chunks", F.when(F.col("record_type") == "revisit", 1).otherwise(pieces))
    rows = rows.withColumn("record", F.expr("uuid()")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(
        F.substring(payload, (F.col("chunk") - 1) * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.withColumn("body", body).drop("payload")


def _field(name: str, value: Column) -> Column:
    """A header field, or nothing when its value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def _record(boundary: str, stamp: str) -> Column:
    """The bytes of a record but for its last line break, which the text writer adds."""
    first = F.col("chunk") == 1
    many = F.col("chunks") > 1
    name = F.concat(F.lit("<urn:uuid:"), F.col("record"), F.lit(">"))
    part = F.when(first, name).otherwise(
        F.concat(F.lit("<urn:uuid:"), F.substring(F.sha2(F.concat_ws("/", "record", "chunk"), 256), 1, 32), F.lit(">")))
    header = F.concat(
        F.lit(f"WARC/1.0{_END}WARC-Boundary: {boundary}{_END}"),
        _field("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        _field("WARC-Record-ID", part),
        _field("WARC-Date", F.lit(stamp)),
        _field("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        _field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("body", 256))),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("digest")))),
        _field("WARC-Payload-Length", F.when(first, F.col("bytes"))),
        _field("WARC-Page-ID", F.col("page_id")),
        _field("WARC-Refers-To-Page", F.when(first, F.col("refers_to"))),
        _field("WARC-Profile", F.when(
            first & (F.col("record_type") == "revisit"),
            F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _field("WARC-Segment-Number", F.when(many, F.col("chunk"))),
        _field("WARC-Segment-Origin-ID", F.when(~first, name)),
        _field("WARC-Segment-Total-Length", F.when(many & (F.col("chunk") == F.col("chunks")), F.col("bytes"))),
        _field("Content-Type", F.when(first, F.lit("text/html"))),
        _field("Content-Length", F.octet_length("body")),
        F.lit(_END),
    )
    return F.concat(F.encode(header, "utf-8"), F.col("body"), F.lit(b"\r\n\r")).cast("string")


def write_archive(pages: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES,
                  stamp: str = "2000-01-01T00:00:00Z") -> str:
    """Write the archives and return the boundary to read them with."""
    boundary = uuid.uuid4().hex
    chunk_rows(pages, chunk_bytes, min_bytes).select(_record(boundary, stamp).alias("value")).write.text(folder, lineSep="\n")
    return boundary


def read_archive(spark: SparkSession, folder: str, boundary: str) -> DataFrame:
    """One row per chunk record: its header fields and body."""
    begin = f"WARC/1.0{_END}WARC-Boundary: {boundary}{_END}"
    raw = spark.read.text(folder, lineSep=f"{_END}{_END}{begin}").select(F.col("value").cast("binary").alias("raw"))
    # Only the first record of a file still has its own beginning.
    size = len(begin)
    starts = F.substring("raw", 1, size) == F.lit(begin.encode())
    raw = raw.select(F.when(starts, F.substring(F.col("raw"), F.lit(size + 1), F.octet_length("raw"))).otherwise(F.col("raw")).alias("raw"))
    split = F.position(F.lit(b"\r\n\r\n"), F.col("raw"))
    cutting = raw.withColumn("head", F.decode(F.substring(F.col("raw"), F.lit(1), split - 1), "utf-8")).withColumn("at", split + 4)

    def field(name: str) -> Column:
        found = F.regexp_extract(F.concat(F.lit(_END), F.col("head"), F.lit(_END)), f"{_END}{name}: ([^\r\n]*){_END}", 1)
        return F.when(found != "", found)

    fields = cutting.select(
        field("WARC-Type").alias("kind"), field("WARC-Record-ID").alias("own"), field("WARC-Segment-Origin-ID").alias("origin"),
        field("WARC-Page-ID").alias("page_id"), field("WARC-Target-URI").alias("url"),
        field("WARC-Refers-To-Page").alias("refers_to"), field("WARC-Payload-Digest").alias("told_digest"),
        field("WARC-Payload-Length").cast("long").alias("told_bytes"),
        field("WARC-Segment-Number").cast("int").alias("segment"), field("Content-Length").cast("int").alias("length"), "raw", "at")
    return fields.select(
        F.coalesce("origin", "own").alias("record"), "kind", "page_id", "url", "refers_to", "told_digest", "told_bytes",
        F.coalesce("segment", F.lit(1)).alias("chunk"), F.col("segment").isNotNull().alias("segmented"),
        F.substring(F.col("raw"), F.col("at"), F.col("length")).alias("body"))


def running_digests(chunks: DataFrame) -> DataFrame:
    """(record, bytes, digest) of segmented records, chunk after chunk in order."""

    def run(batches):
        record, digest, size = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for name, body in zip(batch.column("record").to_pylist(), batch.column("body")):
                if name != record:
                    if record is not None:
                        out.append((record, size, digest.hexdigest()))
                    record, digest, size = name, hashlib.sha256(), 0
                part = body.as_buffer() if body.is_valid else b""
                digest.update(part)
                size += len(part)
            if out:
                yield _digest_batch(out)
        if record is not None:
            yield _digest_batch([(record, size, digest.hexdigest())])

    return (
        chunks.select("record", "chunk", "body").repartition("record").sortWithinPartitions("record", "chunk")
        .mapInArrow(run, "record string, bytes long, digest string"))


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names, sizes, digests = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
        names=["record", "bytes", "digest"])


def read_records(spark: SparkSession, folder: str, boundary: str, id_type: str = "long") -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those of the payload read; a revisit, which
    has none, tells those of the payload it refers to.
    """
    chunks = read_archive(spark, folder, boundary)
    whole = chunks.filter(~F.col("segmented"))
    revisit = F.col("kind") == "revisit"
    single = whole.select(
        "page_id", "url", F.when(revisit, F.col("told_bytes")).otherwise(F.octet_length("body").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring("told_digest", 8, 64)).otherwise(F.sha2("body", 256)).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to")
    parts = chunks.filter("segmented")
    heads = parts.filter(F.col("chunk") == 1).select(
        F.col("record").alias("of"), "page_id", "url", F.col("kind").alias("record_type"), "refers_to")
    long = running_digests(parts).join(heads, F.col("record") == F.col("of")).select(
        "page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    both = single.unionByName(long)
    return both.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive_round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives of `pages` in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = run_dir(spark, "warc")
    boundary = write_archive(pages, folder, chunk_bytes, min_bytes)
    return read_records(spark, folder, boundary, pages.schema["page_id"].dataType.simpleString())
