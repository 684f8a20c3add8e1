"""A stream of rows that a user's model judges, with another try in later micro-batches for rows that it didn't answer.

Below ``<base>`` each of ``answers``, ``judged``, ``given_up`` and ``waiting`` has folders ``epoch=<micro-batch>/round=<n>``.  A round scores its rows once, writes
the judged and the given up ones, and the waiting ones last: their ``_SUCCESS`` closes the round.  A micro-batch that broke off writes the same folders
anew, one that is closed does nothing, so no row is judged twice.  Round 0 of a micro-batch takes its rows and what waited after the last round of
the one before; further rounds, without new rows, finish what waits when a stream has ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import tee

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.plans.routing import apply_scores
from millrace.session import listed, remove
from millrace.sources.media import AUDIT

ATTEMPTS = 3
# One series of answers for each frame of rows; null where the model gave none.  What it sets up before its loop is set up once for each partition.
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[Iterable]]


def with_answers(rows: DataFrame, scorer: Scorer, answer: str = "string") -> DataFrame:
    """``rows`` with the column ``answer`` of that type; a scorer that loses or adds frames or answers fails."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, shown = tee(frames)
        for frame, answers in zip(kept, scorer(shown), strict=True):
            yield frame.assign(answer=pd.Series(list(answers), index=frame.index, dtype=object))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInPandas(ask, ", ".join([*fields, f"answer {answer}"]))


def judged_answers(rows: DataFrame, taxonomy: tuple[str, ...], ovr_min: int = 0, rel_min: int = 0) -> DataFrame:
    """The JSON objects in ``answer`` as columns, judged by ``apply_scores``; columns of the rows with the same names give way."""
    audit = F.from_json(scalars.model_object(F.col("answer")), AUDIT)
    names = [f.split()[0] for f in AUDIT.split(", ")]
    return apply_scores(rows.drop(*names).withColumn("_audit", audit).select("*", "_audit.*").drop("_audit"), taxonomy, ovr_min, rel_min)


class ScoredStream:
    """``scorer`` sees the rows with ``attempt``, 1 the first time.  ``judge`` gets the rows with an answer that is ``readable``, a
    JSON object unless another condition is given; the others wait, and are given up after ``attempts`` tries."""

    def __init__(self, spark: SparkSession, base: str, scorer: Scorer, judge: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS, readable: Column | None = None) -> None:
        self.spark, self.base, self.scorer, self.judge, self.attempts = spark, base.rstrip("/"), scorer, judge, attempts
        self.readable = F.coalesce(scalars.model_object(F.col("answer")).isNotNull() if readable is None else readable, F.lit(False))

    def _closed(self, epoch: int, turn: int) -> bool:
        return "_SUCCESS" in listed(self.spark, f"{self.base}/waiting/epoch={epoch}/round={turn}")

    def _last_round(self, epoch: int) -> int:
        """The last closed round of a micro-batch, -1 if it has none."""
        turns = [int(n.removeprefix("round=")) for n in listed(self.spark, f"{self.base}/waiting/epoch={epoch}")]
        return max((t for t in turns if self._closed(epoch, t)), default=-1)

    def waiting(self, epoch: int) -> DataFrame | None:
        """What waits after a micro-batch, with the number of tries in ``attempt``."""
        turn = self._last_round(epoch)
        return None if turn < 0 else self.spark.read.parquet(f"{self.base}/waiting/epoch={epoch}/round={turn}")

    def read(self, what: str) -> DataFrame | None:
        """All rows ``judged`` or ``given_up``, with ``epoch`` and ``round``; null before the first round."""
        folder = f"{self.base}/{what}"
        return self.spark.read.option("basePath", folder).parquet(f"{folder}/epoch=*/round=*") if listed(self.spark, folder) else None

    def run(self, rows: DataFrame, epoch: int, turn: int) -> None:
        """Score ``rows``, of which ``attempt`` tells the tries before, as a round."""
        if self._closed(epoch, turn):
            return
        at = f"epoch={epoch}/round={turn}"
        answers = f"{self.base}/answers/{at}"
        with_answers(rows.withColumn("attempt", F.col("attempt") + 1), self.scorer).write.mode("overwrite").parquet(answers)
        scored = self.spark.read.parquet(answers)
        self.judge(scored.filter(self.readable)).write.mode("overwrite").parquet(f"{self.base}/judged/{at}")
        missing, over = scored.filter(~self.readable).drop("answer"), F.col("attempt") >= self.attempts
        missing.filter(over).write.mode("overwrite").parquet(f"{self.base}/given_up/{at}")
        missing.filter(~over).write.mode("overwrite").parquet(f"{self.base}/waiting/{at}")
        remove(self.spark, answers)

    def batch(self, batch: DataFrame, epoch: int) -> None:
        """A micro-batch: new rows and what waits.  Of what waited, the micro-batch before is kept, as this one may run again."""
        before = self.waiting(epoch - 1)
        rows = batch.withColumn("attempt", F.lit(0))
        self.run(rows if before is None else rows.unionByName(before), epoch, 0)
        remove(self.spark, f"{self.base}/waiting/epoch={epoch - 2}")

    def finish(self) -> None:
        """Rounds of what still waits after the last micro-batch, until nothing does; ``attempts`` bounds their number."""
        epochs = [int(n.removeprefix("epoch=")) for n in listed(self.spark, f"{self.base}/waiting")]
        epoch = max((e for e in epochs if self._last_round(e) >= 0), default=None)
        while epoch is not None and not (rows := self.waiting(epoch)).isEmpty():
            self.run(rows, epoch, self._last_round(epoch) + 1)


def judge_stream(stream: DataFrame, scored: ScoredStream, checkpoint: str, finish: bool = True) -> DataFrame | None:
    """Judge a stream's micro-batches and stop when drained; returns the judged rows so far."""
    stream.writeStream.foreachBatch(scored.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if finish:
        scored.finish()
    return scored.read("judged")
