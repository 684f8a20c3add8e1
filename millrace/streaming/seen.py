"""Keys seen for ever, as a bucketed table that a micro-batch meets without moving it.

The table lies below ``<base>/v<number>-<buckets>``, bucketed by key, so that a join moves only the new rows to its buckets.  Every row carries the stream and the
micro-batch that added it: a micro-batch that runs again doesn't take its own keys for seen, and decides as it did before.  Each addition adds a file to the buckets;
``compact`` writes a new version with one row a key and one file a bucket.  Readers follow the greatest version that is whole.  One writer at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.catalogue import latest
from millrace.session import listed, qualified, remove

BUCKETS = 256


class SeenTable:
    """Keys are texts; null and blank ones are never seen and never new.  ``buckets`` counts for a table that doesn't exist yet."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS) -> None:
        self.spark, self.base = spark, qualified(spark, base.rstrip("/"))
        if not self._versions():
            self._write(spark.createDataFrame([], "key string, stream string, epoch long"), 0, buckets)
        self._open()

    def _versions(self) -> list[tuple[int, int]]:
        """(number, buckets) of the versions that are whole, the last one last."""
        names = [n for n in listed(self.spark, self.base) if n.startswith("v")]
        whole = [n for n in names if "_whole" in listed(self.spark, f"{self.base}/{n}")]
        return sorted(tuple(map(int, n[1:].split("-"))) for n in whole)

    def _path(self, number: int, buckets: int) -> str:
        return f"{self.base}/v{number}-{buckets}"

    def _name(self, number: int, buckets: int) -> str:
        return "seen_" + hashlib.md5(self._path(number, buckets).encode()).hexdigest()

    def _declare(self, number: int, buckets: int) -> str:
        """The catalogue's name of a version; another session finds the same files by the same declaration."""
        name = self._name(number, buckets)
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (key STRING, stream STRING, epoch BIGINT) USING parquet
            CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self._path(number, buckets)}/rows'""")
        return name

    def _write(self, rows: DataFrame, number: int, buckets: int) -> None:
        """A new version; what a broken attempt left under its number goes first."""
        remove(self.spark, self._path(number, buckets))
        name = self._declare(number, buckets)
        rows.repartition(buckets, "key").select("key", "stream", "epoch").write.insertInto(name)
        self.spark.range(1).coalesce(1).write.parquet(f"{self._path(number, buckets)}/_whole")

    def _open(self) -> None:
        self.number, self.buckets = self._versions()[-1]
        self.name = self._declare(self.number, self.buckets)
        self.spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        """``key, stream, epoch``; a key may stand several times."""
        return self.spark.table(self.name)

    def unseen(self, rows: DataFrame, key: str, order: list[Column], stream: str | None = None, epoch: int | None = None) -> DataFrame:
        """The first row, in ``order``, of each key that the table doesn't hold; what this ``epoch`` of ``stream`` added doesn't count.

        The rows move once, to the buckets of the table, and meet it there; the table stays where it is."""
        text = F.col(key).cast("string")
        at = rows.filter(F.trim(text) != "").withColumn("_key", text).repartition(self.buckets, "_key")
        held = self.read()
        if stream is not None:
            held = held.filter(~(F.col("stream").eqNullSafe(F.lit(stream)) & (F.col("epoch") >= epoch)))
        held = held.select(F.col("key").alias("_held"))
        return latest(at, ["_key"], order).join(held, F.col("_key") == F.col("_held"), "left_anti").drop("_key")

    def add(self, keys: DataFrame, key: str, stream: str | None = None, epoch: int | None = None) -> None:
        """Add keys; ones that are there stay."""
        text = F.col(key).cast("string")
        new = keys.select(text.alias("key")).filter(F.trim("key") != "").repartition(self.buckets, "key").dropDuplicates(["key"])
        new.select("key", F.lit(stream).cast("string").alias("stream"), F.lit(epoch).cast("long").alias("epoch")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self, buckets: int | None = None) -> None:
        """One row a key and one file a bucket, of a new number of buckets if given; the version before the last is removed.

        The earliest addition of a key stays, so that a micro-batch of which some keys were there before still finds them."""
        before = self._versions()
        first = self.read().groupBy("key").agg(F.min_by(F.struct("stream", "epoch"), F.struct(F.coalesce("epoch", F.lit(-1)), F.coalesce("stream", F.lit("")))).alias("s"))
        self._write(first.select("key", "s.stream", "s.epoch"), self.number + 1, buckets or self.buckets)
        self._open()
        for number, of in before[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(number, of)}")
            remove(self.spark, self._path(number, of))


def stream_first_seen(stream: DataFrame, key: str, order: list[Column], seen: str, path: str, checkpoint: str, buckets: int = BUCKETS) -> SeenTable:
    """Write the first row of each key that was never seen before, however long ago, below ``path`` and stop when drained.

    Each micro-batch has a folder of its own there.  It is written before its keys are added; broken off anywhere and run again, it writes the same rows."""
    table = SeenTable(stream.sparkSession, seen, buckets)
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def apply(batch: DataFrame, epoch: int) -> None:
        target = f"{path}/epoch={epoch}"
        table.unseen(batch, key, order, name, epoch).write.mode("overwrite").parquet(target)
        table.add(table.spark.read.schema(batch.schema).parquet(target), key, name, epoch)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table
