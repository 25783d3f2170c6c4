"""State of a streaming job per key, kept as a bucketed table in the shared folder.

A micro-batch writes the state rows it changed, one file per bucket it touched, into a
folder of its own; a rerun overwrites that folder, and what it reads lies in earlier
ones. Before a batch only the buckets of its own keys are read: their files of the last
`merge_every` batches and of the merged table before them, so the files read are
bounded whatever the history. Null keys are keys like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
MERGE_EVERY = 16


class KeyTable:
    """Latest state row of every key: `keys` and the value columns of `schema`."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str],
                 buckets: int = BUCKETS, merge_every: int = MERGE_EVERY):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)
        self.buckets, self.merge_every = buckets, merge_every
        self.values = [c for c in schema.names if c not in self.keys]

    # --- folders ------------------------------------------------------------------

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(conf)

    def _numbers(self, folder: str) -> dict[int, str]:
        """Numbered subfolders, such as batch=3, of a folder; only those written to the end."""
        make, files = self._files()
        root = make(f"{self.path}/{folder}")
        if not files.exists(root):
            return {}
        found = {}
        for item in files.listStatus(root):
            name = item.getPath().getName()
            if "=" in name and (name.startswith("bucket=") or files.exists(make(f"{self.path}/{folder}/{name}/_SUCCESS"))):
                found[int(name.partition("=")[2])] = f"{self.path}/{folder}/{name}"
        return found

    def _delete(self, folder: str) -> None:
        make, files = self._files()
        files.delete(make(folder), True)

    # --- rows -----------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of some rows: at most `buckets` numbers."""
        return sorted(r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def _folders(self, batch: int, touched: Sequence[int] | None) -> list[tuple[int, str]]:
        """(number, folder) of what holds the state before a batch, oldest first."""
        merged = {n: f for n, f in self._numbers("merged").items() if n < batch}
        upto = max(merged, default=-1)
        steps = [(upto, f"merged/upto={upto}")] if merged else []
        steps += [(n, f"state/batch={n}") for n in sorted(self._numbers("state")) if upto < n < batch]
        out = []
        for number, folder in steps:
            for bucket, place in sorted(self._numbers(folder).items()):
                if touched is None or bucket in touched:
                    out.append((number, place))
        return out

    def before(self, batch: int, touched: Sequence[int] | None = None) -> DataFrame:
        """State of the keys in some buckets (all, if none are named) before a batch."""
        found = self._folders(batch, touched)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = None
        for number in sorted({n for n, _ in found}):
            # Older folders first; a merged table has the number of its last batch.
            part = self.spark.read.schema(self.schema).parquet(*[f for n, f in found if n == number]).withColumn("_batch", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        if not self.values:
            return rows.select(*self.keys).distinct()
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.values), "_batch").alias("_last"))
        return last.select(*self.keys, "_last.*").select(*self.schema.names)

    def save(self, batch: int, rows: DataFrame) -> None:
        """Write the changed state rows of a batch, then merge if many batches have gathered."""
        self._write(f"{self.path}/state/batch={batch}", rows)
        merged = self._numbers("merged")
        upto = max((n for n in merged if n < batch), default=-1)
        # The batch before this one is committed, so its state will not change any more.
        if batch - upto > self.merge_every:
            self._write(f"{self.path}/merged/upto={batch - 1}", self.before(batch))
            for number, folder in self._numbers("state").items():
                if number < upto:
                    self._delete(folder)
            for number, folder in merged.items():
                if number < upto:
                    self._delete(folder)

    def _write(self, folder: str, rows: DataFrame) -> None:
        tagged = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        tagged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where null equals null; the right side's keys are left out."""
    renamed, condition = right, F.lit(True)
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_on_{key}")
        condition = condition & F.col(key).eqNullSafe(F.col(f"_on_{key}"))
    out = left.join(renamed, condition, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_on_{k}" for k in keys])
