"""Rolling admission: at most so many rows of a key in any 60 seconds, and a least gap between them, as a batch and as a stream.

A row is admitted if fewer than ``most`` rows of its key were admitted in the 60 seconds before it, and the last one at least ``gap`` seconds before it.
Refused rows don't count.  A cap of 0 or none is no limit, and so is a gap of 0.

Nothing older than the reach, the greater of 60 seconds and the gap, matters for a decision.  So the batch form cuts the rows of a key into runs wherever
that much time passes between two of them, and each run is walked for itself; only a key that never rests for that long is one run.  The stream form keeps
the admitted times that still matter and the last one, and drops them once the watermark is past the reach.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW = 60.0  # seconds
SECONDS = "seconds_of_admission"  # names with an underscore first don't reach a stateful processor


class Limit:
    """The decisions for one key, in order of time."""

    def __init__(self, most: int | None, gap: float, admitted=(), last: float | None = None) -> None:
        self.most = most if most and most > 0 else None
        self.gap, self.last, self.admitted = gap, last, deque(admitted)

    def admit(self, at: float) -> bool:
        while self.admitted and self.admitted[0] <= at - WINDOW:
            self.admitted.popleft()
        if self.most is not None and len(self.admitted) >= self.most:
            return False
        if self.gap > 0 and self.last is not None and at - self.last < self.gap:
            return False
        self.last = at
        if self.most is not None:
            self.admitted.append(at)
        return True


def reach(gap: float) -> float:
    return max(WINDOW, gap)


def with_runs(rows: DataFrame, key: str, seconds: str, pause: float) -> DataFrame:
    """Add ``_run``: rows of a key with at least ``pause`` seconds between them and their neighbours are of different runs.

    Such a pause lies between two stretches of ``pause`` seconds, so the least and the last time of each stretch tell all of them; these are what is put in
    order for each key, and there are as many as the key's time has stretches, however many rows."""
    rows = rows.withColumn("_stretch", F.floor(F.col(seconds) / pause))
    ends = rows.groupBy(F.col(key).alias("_of"), F.col("_stretch").alias("_in")).agg(F.min(seconds).alias("_least"), F.max(seconds).alias("_most"))
    order = Window.partitionBy("_of").orderBy("_in")
    begins = F.coalesce(F.col("_least") - F.lag("_most").over(order) >= pause, F.lit(True))
    # Inside a stretch no pause is that long, but one may end or begin there.
    runs = ends.select("_of", "_in", F.when(begins, F.col("_in")).alias("_first"))
    runs = runs.select("_of", "_in", F.last("_first", ignorenulls=True).over(order).alias("_run"))
    return rows.join(runs, (F.col(key) == F.col("_of")) & (F.col("_stretch") == F.col("_in"))).drop("_stretch", "_of", "_in")


def rolling_admission(events: DataFrame, key: str, seconds: Column, most: int | None, gap: float, tie: list[str]) -> DataFrame:
    """The admitted rows of a batch; rows without a key are refused, those at the same time go by ``tie``.

    Spark sorts the runs; a walk holds a batch of rows and the last ``most`` times, however many rows a run has."""
    rows = events.withColumn("_s", seconds.cast("double")).filter(F.col(key).isNotNull() & F.col("_s").isNotNull())
    if not (most and most > 0) and gap <= 0:
        return rows.drop("_s")

    def admit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, limit = None, Limit(most, gap)
        for pdf in frames:
            take = []
            for run, k, s in zip(pdf["_run"], pdf[key], pdf["_s"], strict=True):
                if (run, k) != at:
                    at, limit = (run, k), Limit(most, gap)
                take.append(limit.admit(s))
            yield pdf[take].drop(columns=["_s", "_run"])

    ordered = with_runs(rows, key, "_s", reach(gap)).repartition(F.col(key), F.col("_run")).sortWithinPartitions(key, "_run", "_s", *tie)
    return ordered.mapInPandas(admit, events.schema)


class Admission(StatefulProcessor):
    """The stream form for one key; ``at`` names the column with the seconds."""

    def __init__(self, most: int | None, gap: float, at: str, tie: list[str]) -> None:
        self.most, self.gap, self.at, self.tie = most, gap, at, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        limit = Limit(self.most, self.gap, [t[0] for t in self.times.get()] if self.times.exists() else (), before)
        batch = pd.concat(list(rows)).sort_values([self.at, *self.tie], kind="stable")
        # A row that comes after later ones is judged as if it came with the last admitted one.
        take = [limit.admit(s if limit.last is None else max(s, limit.last)) for s in batch[self.at]]
        if limit.last is not None and limit.last != before:
            self.last.update((float(limit.last),))
            if limit.admitted:
                self.times.put([(float(t),) for t in limit.admitted])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((limit.last + reach(self.gap)) * 1000) + 1)
        yield batch[take].drop(columns=[self.at])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_admission(events: DataFrame, key: str, ts: str, most: int | None, gap: float, tie: list[str], delay: str = "1 minute") -> DataFrame:
    """The admitted rows of a stream with event time ``ts``, micro-batch by micro-batch; needs the RocksDB state store.

    Rows later than ``delay`` are dropped.  What a key is remembered by goes once the watermark is past the reach of its last admission."""
    rows = events.withWatermark(ts, delay).filter(F.col(key).isNotNull())
    schema = rows.schema
    rows = rows.withColumn(SECONDS, F.unix_micros(ts) / 1e6)
    return rows.groupBy(key).transformWithStateInPandas(Admission(most, gap, SECONDS, tie), schema, "Append", "EventTime")
