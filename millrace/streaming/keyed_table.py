"""A table of items in buckets by path, of which a micro-batch rewrites only the buckets that it touches.

``<base>/data/<mark>/bucket=<k>`` holds a version of a bucket.  A pointer file ``<base>/pointers/<number>.json`` names the version of every bucket and, for each
stream, the last micro-batch that is in.  A commit writes the new versions, then a pointer under a temporary name, and renames it to the next number: that
fails if another writer was first, and the commit is tried anew on what is there.  Readers follow the greatest number.  So a micro-batch that broke off left
no trace but files that no pointer names, and one that runs again finds its mark.  Versions that none of the last KEEP pointers name are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.catalogue import diff_listing, upsert_items

BUCKETS = 64
KEEP = 2
TRIES = 5


class KeyedTable:
    """``buckets`` is fixed by the first commit; a table of n rows gets n / buckets rows a bucket."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS) -> None:
        self.spark, self.base, self._buckets = spark, base.rstrip("/"), buckets
        self._fs_classes = spark.sparkContext._jvm.org.apache.hadoop.fs

    # -- files --

    def _path(self, *parts: str):
        return self._fs_classes.Path("/".join([self.base, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs().exists(self._path("pointers")):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path("pointers"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _read(self, number: int) -> dict:
        stream = self._fs().open(self._path("pointers", f"{number}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def pointer(self) -> tuple[int, dict]:
        """The greatest number and what its file says."""
        numbers = self._numbers()
        return (numbers[-1], self._read(numbers[-1])) if numbers else (-1, {"buckets": self._buckets, "versions": {}, "streams": {}})

    def _swap(self, number: int, pointer: dict) -> bool:
        fs, tmp = self._fs(), self._path("pointers", f".{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(json.dumps(pointer).encode())
        out.close()
        done = not fs.exists(self._path("pointers", f"{number}.json")) and fs.rename(tmp, self._path("pointers", f"{number}.json"))
        if not done:
            fs.delete(tmp, False)
        return done

    def _clean(self) -> None:
        numbers, fs = self._numbers(), self._fs()
        old, kept = numbers[:-KEEP], [self._read(n)["versions"] for n in numbers[-KEEP:]]
        named = {(k, v) for versions in kept for k, v in versions.items()}
        for n in old:
            for bucket, version in self._read(n)["versions"].items():
                if (bucket, version) not in named:
                    fs.delete(self._path("data", version, f"bucket={bucket}"), True)
            fs.delete(self._path("pointers", f"{n}.json"), False)

    # -- rows --

    def bucket(self, column: str = "path"):
        return F.pmod(F.xxhash64(column), F.lit(self.pointer()[1]["buckets"])).cast("int")

    def _rows(self, pointer: dict, buckets: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.base}/data/{v}/bucket={k}" for k, v in pointer["versions"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The table as of now; null before the first commit and where every row was deleted."""
        return self._rows(self.pointer()[1])

    def _commit(self, keys: DataFrame, change: Callable[[DataFrame | None], DataFrame], stream: str | None, epoch: int) -> bool:
        """Rewrite the buckets of ``keys (path)`` by ``change(rows there)``; false if the stream's micro-batch is in already."""
        touched = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # as many as the table has buckets at most
        for _ in range(TRIES):
            number, pointer = self.pointer()
            if stream is not None and pointer["streams"].get(stream, -1) >= epoch:
                return False
            versions, streams = dict(pointer["versions"]), dict(pointer["streams"])
            if touched:
                mark = uuid.uuid4().hex
                rows = change(self._rows(pointer, touched)).withColumn("bucket", self.bucket())
                rows.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.base}/data/{mark}")
                there = {s.getPath().getName().removeprefix("bucket=") for s in self._fs().listStatus(self._path("data", mark)) if s.isDirectory()}
                versions = {k: v for k, v in versions.items() if int(k) not in touched} | dict.fromkeys(there - {"_temporary"}, mark)
            if stream is not None:
                streams[stream] = epoch
            if self._swap(number + 1, {"buckets": pointer["buckets"], "versions": versions, "streams": streams}):
                self._clean()
                return True
        raise RuntimeError(f"other writers were first {TRIES} times")

    def upsert(self, changes: DataFrame, stream: str | None = None, epoch: int = 0) -> bool:
        """Insert or replace by path; a hash that is there stays.  Of rows with one path any counts."""
        new = changes.filter(F.col("path").isNotNull()).dropDuplicates(["path"])
        return self._commit(new, lambda old: new if old is None else upsert_items(old, new), stream, epoch)

    def delete(self, keys: DataFrame) -> bool:
        """Remove the rows with the paths of ``keys``."""
        there = self.read()
        if there is None:
            return False
        gone = there.join(keys.select("path"), "path", "left_semi").select("path")
        return self._commit(gone, lambda old: old.join(keys.select("path"), "path", "left_anti"), None, 0)

    def reconcile(self, listing: DataFrame) -> DataFrame | None:
        """Delete what a listing ``(path, mtime)`` of the files doesn't hold, as a stream never reports it; returns ``path, change`` against the table before."""
        there = self.read()
        if there is None:
            return None
        found = diff_listing(listing, there)
        self.delete(found.filter("change = 'deleted'"))
        return found


def stream_to_table(stream: DataFrame, base_path: str, checkpoint: str, prepare=lambda df: df, buckets: int = BUCKETS) -> DataFrame:
    """Upsert micro-batches of items into the keyed table below ``base_path`` and stop when drained; returns the table."""
    held = KeyedTable(stream.sparkSession, base_path, buckets)
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def apply(batch: DataFrame, epoch: int) -> None:
        held.upsert(prepare(batch), name, epoch)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return held.read()
