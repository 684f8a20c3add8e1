"""Streams that keep state or a table: admission and the keyed table, with restarts and repeated micro-batches."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.streaming import admission
from millrace.streaming import jobs as streams
from millrace.streaming.keyed_table import KeyedTable

START = datetime(2026, 1, 1, tzinfo=UTC)
ROWS = "id long, k string, ts timestamp"


def walked(rows, most, gap):
    """(id) of the admitted (id, key, seconds), by a plain walk over each key."""
    out = []
    for k in {r[1] for r in rows if r[1] is not None}:
        times = []
        for i, _, s in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            full = most and most > 0 and sum(t > s - 60 for t in times) >= most
            if not full and not (gap > 0 and times and s - times[-1] < gap):
                times.append(s)
                out.append(i)
    return sorted(out)


def some_rows(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", "c", None]), float(rng.choice([0, 300, 1000, 5000]) + rng.randrange(0, 2000) / 4)) for i in range(n)]


@pytest.mark.parametrize(("most", "gap"), [(3, 0), (3, 1.5), (2, 90), (0, 75), (None, 75), (1, 0), (0, 0), (1000, 0.25)])
def test_admission_of_a_batch_equals_a_walk(spark, most, gap):
    rows = some_rows(most or 7)
    df = spark.createDataFrame(rows, "id long, k string, s double")
    got = streams.rolling_admission(df, "k", F.col("s"), most, gap, ["id"])
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == walked(rows, most, gap)
    assert streams.rolling_admission(df.limit(0), "k", F.col("s"), most, gap, ["id"]).count() == 0


def test_rests_cut_a_key_into_runs(spark):
    rows = [(i, "hot", float(s)) for i, s in enumerate([0, 59, 118, 178, 237, 400, 459.9, 519.9, 1000])]
    runs = admission.with_runs(spark.createDataFrame(rows, "id long, k string, s double"), "k", "s", 60.0)
    by = {r.id: r._run for r in runs.collect()}
    assert [len({by[i] for i in group}) for group in ([0, 1, 2], [3, 4], [5, 6], [7], [8])] == [1] * 5
    assert len(set(by.values())) == 5


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize(("most", "gap"), [(3, 1.0), (2, 90.0)])
def test_admission_of_a_stream_equals_the_batch_across_a_restart(rocks, tmp_path, most, gap):
    spark = rocks
    rows = sorted((r for r in some_rows(11, 250)), key=lambda r: (r[2], r[0]))
    parts = [rows[i * 50 : (i + 1) * 50] for i in range(5)]

    def put(n):
        spark.createDataFrame([(i, k, START + timedelta(seconds=s)) for i, k, s in parts[n]], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def drain():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = streams.stream_admission(stream, "k", "ts", most, gap, ["id"], "0 seconds")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    put(0), put(1)
    drain()
    put(2), put(3), put(4)
    drain()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.id for r in got.collect()) == walked([r for p in parts for r in p], most, gap)
    # The last rows come long after those of 'z', which are forgotten.
    parts += [[(900, "z", 20_000.0)], [(901, "y", 90_000.0)], [(902, "y", 90_001.0)]]
    for n in (5, 6, 7):
        put(n)
        drain()
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/c")
    assert [r.key.k for r in state.select("key").collect()] == ["y"]


ITEMS = "path string, status string, phash string, mtime double"


def test_a_micro_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    held = KeyedTable(spark, f"{tmp_path}/t", 8)
    assert held.read() is None
    assert held.upsert(spark.range(400).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("queue").alias("status"), F.lit("h").alias("phash"), F.lit(1.0).alias("mtime")), "s", 0)
    before = held.pointer()[1]["versions"]
    assert len(before) == 8
    one = spark.createDataFrame([("p7", "sorted", "other", 2.0), ("p7", "sorted", "other", 2.0), (None, "x", None, None)], ITEMS)
    assert held.upsert(one, "s", 1)
    after = held.pointer()[1]["versions"]
    assert sum(before[k] != after[k] for k in before) == 1
    rows = {r.path: r for r in held.read().collect()}
    assert len(rows) == 400
    assert (rows["p7"].status, rows["p7"].phash) == ("sorted", "h")
    # A micro-batch that runs again changes nothing, not even a pointer.
    number = held.pointer()[0]
    assert not held.upsert(spark.createDataFrame([("p7", "again", None, 9.0)], ITEMS), "s", 1)
    assert held.pointer()[0] == number
    assert held.upsert(spark.createDataFrame([("p7", "third", None, 9.0)], ITEMS), "other", 0)
    # Old versions go, and so do old pointers.
    for n in range(2, 6):
        held.upsert(one, "s", n)
    assert len(held._numbers()) == 2
    files = [p for p in (tmp_path / "t/data").rglob("bucket=*") if p.is_dir()]
    assert len(files) <= 8 + 1


def test_reconciling_deletes_what_is_gone(spark, tmp_path):
    held = KeyedTable(spark, f"{tmp_path}/t", 4)
    held.upsert(spark.createDataFrame([(f"p{i}", "queue", None, 1.0) for i in range(20)], ITEMS))
    listing = spark.createDataFrame([(f"p{i}", 2.0 if i == 3 else 1.0) for i in range(3, 22)], "path string, mtime double")
    found = {r.path: r.change for r in held.reconcile(listing).collect()}
    assert {k for k, v in found.items() if v == "deleted"} == {"p0", "p1", "p2"}
    assert found["p3"] == "updated" and found["p21"] == "added"
    assert {r.path for r in held.read().collect()} == {f"p{i}" for i in range(3, 20)}
    held.delete(held.read())
    assert held.read() is None


def test_a_lost_race_is_tried_anew(spark, tmp_path, monkeypatch):
    one, two = KeyedTable(spark, f"{tmp_path}/t", 2), KeyedTable(spark, f"{tmp_path}/t", 2)
    one.upsert(spark.createDataFrame([("a", "queue", None, 1.0)], ITEMS))
    swap = KeyedTable._swap

    def late(self, number, pointer):
        monkeypatch.setattr(KeyedTable, "_swap", swap)
        two.upsert(spark.createDataFrame([("b", "queue", None, 1.0)], ITEMS))
        return swap(self, number, pointer)

    monkeypatch.setattr(KeyedTable, "_swap", late)
    one.upsert(spark.createDataFrame([("c", "queue", None, 1.0)], ITEMS))
    assert {r.path for r in one.read().collect()} == {"a", "b", "c"}
    assert json.loads((tmp_path / "t/pointers/2.json").read_text())["buckets"] == 2
