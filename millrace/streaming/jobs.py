"""Structured Streaming forms: counts, sliding spend, dedup, crossings, admission and indexing.

Watermarks are this package's addition: rows later than the delay are dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.catalogue import new_items
from millrace.streaming.admission import rolling_admission, stream_admission
from millrace.streaming.keyed_table import KeyedTable, stream_to_table
from millrace.streaming.scoring import ScoredStream, judge_stream
from millrace.streaming.seen import SeenTable, stream_first_seen

__all__ = ["KeyedTable", "ScoredStream", "SeenTable", "first_seen", "judge_stream", "rolling_admission", "score_stream", "stream_admission", "stream_crossings", "stream_first_seen", "stream_to_table", "windowed_counts"]


def windowed_counts(events: DataFrame, key: str, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour", value: str = "value") -> DataFrame:
    """Counts and sums per key and window; works on streams and on batches. ``ts`` is a timestamp."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    out = rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def first_seen(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; a stream forgets keys after the delay."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
    return new_items(events, events.limit(0), key, [F.asc("ts")])


def score_stream(stream: DataFrame, scorer, schema: str, path: str, checkpoint: str) -> None:
    """Score micro-batches with a user's ``scorer(iterator of frames)`` and append the answers once."""

    def apply(batch: DataFrame, epoch: int) -> None:
        batch.mapInPandas(scorer, schema).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_crossings(counts: DataFrame, threshold: int) -> DataFrame:
    """Rows ``hook, tick, n`` of a stream whose count reaches the threshold from below.

    The state of a hook is its last count; hooks don't disturb each other."""

    def fire(key, frames, state):
        last = state.get[0] if state.exists else -1
        out = []
        for row in (r for f in frames for r in f.sort_values("tick").itertuples()):
            if last < threshold <= row.n:
                out.append((key[0], row.tick, row.n))
            last = int(row.n)
        state.update((last,))
        yield pd.DataFrame(out, columns=["hook", "tick", "n"])

    return counts.groupBy("hook").applyInPandasWithState(fire, "hook string, tick long, n long", "last long", "append", "NoTimeout")
