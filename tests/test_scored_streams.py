"""Seen tables and scored streams: restarts, repeated and broken micro-batches, retries."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.streaming import jobs as streams
from millrace.streaming.scoring import ScoredStream, judged_answers, with_answers
from millrace.streaming.seen import SeenTable

EVENTS = "id long, k string, day int"


def put(spark, tmp_path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def stream(spark, tmp_path, schema=EVENTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_seen_keys_stay_where_they_are(spark, tmp_path):
    table = SeenTable(spark, str(tmp_path / "seen"), 8)
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    table.add(keys.filter("id < 300"), "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = table.unseen(keys.unionByName(keys), "k", [F.asc("id")])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 8 out of 8" in plan and "SortMergeJoin" in plan
        assert sorted(r.id for r in got.collect()) == list(range(300, 500)) and got.columns == ["k", "id"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "k1"), (5, "new"), (6, "new")], "id long, k string")
    assert [r.id for r in table.unseen(odd, "k", [F.asc("id")]).collect()] == [5]
    assert table.unseen(odd.limit(0), "k", [F.asc("id")]).count() == 0
    assert sorted(r.id for r in table.unseen(spark.range(3).withColumn("key", F.lit(1)), "id", [F.asc("id")]).collect()) == [0, 1, 2]


def test_versions_and_other_sessions(spark, tmp_path):
    base = str(tmp_path / "seen")
    table = SeenTable(spark, base, 4)
    rows = spark.createDataFrame([(i, f"k{i % 10}", 0) for i in range(30)], EVENTS)
    for _ in range(3):
        table.add(rows, "k", "s", 1)
    assert table.read().count() == 30
    table.compact(16)
    other = SeenTable(spark.newSession(), base, 99)
    assert (other.number, other.buckets) == (1, 16) and sorted(map(tuple, other.read().collect())) == sorted((f"k{i}", "s", 1) for i in range(10))
    table.compact()
    assert sorted(p.name for p in (tmp_path / "seen").iterdir() if p.name.startswith("v")) == ["v1-16", "v2-16"]
    (tmp_path / "seen/v3-16/rows").mkdir(parents=True)  # a compaction that broke off
    assert SeenTable(spark, base).number == 2
    table.compact()
    assert table.number == 3 and table.read().count() == 10
    assert table.unseen(rows, "k", [F.asc("id")], "s", 1).count() == 10 and table.unseen(rows, "k", [F.asc("id")], "s", 2).count() == 0


def test_first_seen_for_ever(spark, tmp_path):
    def drain():
        return streams.stream_first_seen(stream(spark, tmp_path), "k", [F.asc("id")], f"{tmp_path}/seen", f"{tmp_path}/out", f"{tmp_path}/c", 4)

    put(spark, tmp_path, [(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, None, 0)])
    drain()
    put(spark, tmp_path, [(5, "a", 40), (6, "c", 40)])  # forty days later, after a restart
    table = drain()
    ids = lambda: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert ids() == [1, 3, 6]
    # The second micro-batch runs again: its keys are in the table, and yet it writes what it wrote.
    again = spark.createDataFrame([(5, "a", 40), (6, "c", 40)], EVENTS)
    for _ in range(2):
        assert [r.id for r in table.unseen(again, "k", [F.asc("id")], "c", 1).collect()] == [6]
        table.compact()
    put(spark, tmp_path, [(7, "c", 80), (8, "d", 80)])
    drain()
    assert ids() == [1, 3, 6, 8]


ROWS = "id long, fails int"


def failing_scorer():
    """A scorer that doesn't answer a row ``fails`` times; made here, as the workers can't import tests."""
    said = json.dumps({"OVR_Quality_Score": 80, "REL_Quality_Score": 70, "category": "Top", "description": "a lake"})

    def scorer(frames):
        for f in frames:
            yield [None if row.attempt <= row.fails else f"<think>well</think>{said}" for row in f.itertuples()]

    return scorer


def test_a_row_that_fails_twice_is_judged_in_the_third_batch(spark, tmp_path):
    scored = ScoredStream(spark, f"{tmp_path}/scored", failing_scorer(), lambda df: judged_answers(df, ("Top", "Mid"), 40))
    put(spark, tmp_path, [(1, 0), (2, 2), (3, 9)], ROWS)
    run = lambda finish=False: streams.judge_stream(stream(spark, tmp_path, ROWS), scored, f"{tmp_path}/c", finish)
    run()
    assert sorted(map(tuple, scored.waiting(0).select("id", "attempt").collect())) == [(2, 1), (3, 1)]
    put(spark, tmp_path, [(4, 1)], ROWS)
    run()
    put(spark, tmp_path, [(5, 1)], ROWS)
    rows = run()
    assert sorted((r.id, r.epoch, r.round, r.attempt, r.category) for r in rows.collect()) == [(1, 0, 0, 1, "Top"), (2, 2, 0, 3, "Top"), (4, 2, 0, 2, "Top")]
    assert [(r.id, r.epoch, r.attempt) for r in scored.read("given_up").collect()] == [(3, 2, 3)]
    scored.batch(spark.createDataFrame([(5, 1)], ROWS), 2)  # a closed micro-batch that runs again does nothing
    rows = run(finish=True)  # nothing new came: a further round for the row that waits
    assert [(r.epoch, r.round) for r in rows.filter("id = 5").collect()] == [(2, 1)] and rows.count() == 4
    put(spark, tmp_path, [(6, 0)], ROWS)
    assert sorted(r.id for r in run(finish=True).collect()) == [1, 2, 4, 5, 6]


def test_a_round_that_broke_off(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], ROWS + ", attempt int")
    broken = ScoredStream(spark, f"{tmp_path}/s", failing_scorer(), lambda df: df.select(F.raise_error("stopped")))
    with pytest.raises(Exception, match="stopped"):
        broken.run(rows, 0, 0)
    assert broken.waiting(0) is None
    whole = ScoredStream(spark, f"{tmp_path}/s", failing_scorer(), lambda df: df.select("id"))
    whole.batch(rows.drop("attempt"), 0)
    assert [r.id for r in whole.read("judged").collect()] == [1] and [r.id for r in whole.waiting(0).collect()] == [2]
    whole.finish()
    assert sorted((r.id, r.round) for r in whole.read("judged").collect()) == [(1, 0), (2, 1)]


def test_answers_keep_to_their_rows(spark):
    rows = spark.range(10).withColumn("text", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")))
    got = with_answers(rows, lambda frames: (f["id"] * 2 for f in frames), "long")
    assert sorted(map(tuple, got.collect())) == [(i, str(i) if i % 2 == 0 else None, 2 * i) for i in range(10)]
    with pytest.raises(Exception, match="Length|length|shorter"):
        with_answers(rows, lambda frames: (pd.Series([1]) for _ in frames), "long").collect()
    assert with_answers(rows.limit(0), lambda frames: (f["id"] for f in frames), "long").count() == 0
