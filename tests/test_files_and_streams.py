"""Images, tars, requeueing and stateful streams on generated files."""

import io
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.plans import export, jobs, routing
from millrace.sources import images
from millrace.streaming import jobs as streams


def png(gray: np.ndarray) -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes(r) for r in gray.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    ramp = np.tile(np.linspace(0, 250, 300), (300, 1))
    board = (np.indices((300, 300)) // 8).sum(axis=0) % 2 * 255
    for name, g in {"ramp": ramp, "shifted": np.roll(ramp, 1, axis=1), "board": board, "flat": np.full((300, 300), 5)}.items():
        (tmp_path / f"{name}.png").write_bytes(png(g))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "empty.png").write_bytes(b"")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in routing.quality_gate(images.image_metrics(images.read_images(spark, str(tmp_path)))).collect()}
    apart = lambda a, b: (int(rows[a].phash, 16) ^ int(rows[b].phash, 16)).bit_count()
    assert apart("ramp.png", "shifted.png") <= 10 < apart("ramp.png", "board.png")
    assert rows["board.png"].ok and rows["board.png"].blur > 1500
    assert "too dark" in rows["flat.png"].reasons and rows["bad.png"].reasons == ["undecodable"] and rows["bad.png"].score == 0


def test_tars(spark, tmp_path):
    rows = []
    for i in range(5):
        (tmp_path / f"{i}.png").write_bytes(b"p%d" % i)
        rows.append((f"file://{tmp_path}/{i}.png", "Keep", "web", "same", ".png", f"c{i}", None))
    df = spark.createDataFrame(rows, "path string, category string, source string, stem string, ext string, caption string, audit string")
    plan = export.plan(df, "webdataset", shard=2)
    written = export.write_tars(plan, f"file://{tmp_path}/out").collect()
    assert sorted(r.n for r in written) == [1, 2, 2]
    with tarfile.open(fileobj=io.BytesIO((tmp_path / "out/shard-000000.tar").read_bytes())) as tar:
        assert sorted(tar.getnames()) == ["same.json", "same.png", "same.txt", "same_1.json", "same_1.png", "same_1.txt"]


def test_published_exports(spark, tmp_path):
    rng, rows = np.random.default_rng(3), []
    for i, size in enumerate([0, 17, export.CHUNK, 2 * export.CHUNK + 5]):
        (tmp_path / f"{i}.mp4").write_bytes(rng.bytes(size))
        rows.append((f"file://{tmp_path}/{i}.mp4", "Keep", "web", f"s{i}", ".mp4", None if i == 0 else f"c{i}", None))
    schema = "path string, category string, source string, stem string, ext string, caption string, audit string"
    df = spark.createDataFrame(rows, schema)
    out, base = f"file://{tmp_path}/out", tmp_path / "out"
    planned = export.plan(df, "folders")
    lost = planned.withColumn("path", F.when(F.col("name") == "s3", F.concat("path", F.lit(".gone"))).otherwise(F.col("path")))
    parts = lambda: [p for p in base.rglob("*") if p.name.startswith(export.TEMPORARY)]
    for _ in range(2):
        with pytest.raises(Exception, match="gone"):
            export.publish(lost, out)
        assert not (base / "_manifest/_SUCCESS").exists() and not parts()
        manifest = export.publish(planned, out).collect()
        assert sorted(r.size for r in manifest) == [0, 17, export.CHUNK, 2 * export.CHUNK + 5] and not parts()
        for r in manifest:
            stem = r.written.rsplit("/", 1)[-1].removesuffix(".mp4")
            assert (tmp_path / f"{stem[1:]}.mp4").read_bytes() == open(r.written, "rb").read()
            assert open(r.written.removesuffix(".mp4") + ".txt").read() == ("" if stem == "s0" else f"c{stem[1:]}")
    tars = export.publish(export.plan(df, "webdataset", shard=3), f"file://{tmp_path}/tars", export.write_tars).collect()
    assert sorted(r.n for r in tars) == [1, 3]
    members = {}
    for r in tars:
        with tarfile.open(r.written) as tar:
            members |= {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
    assert len(members) == 12 and all(members[f"s{i}.mp4"] == (tmp_path / f"{i}.mp4").read_bytes() for i in range(4))
    assert members["s0.json"] == b"{}" and members["s2.txt"] == b"c2"
    assert export.publish(planned.limit(0), out).count() == 0


def test_job_joins(spark):
    presets = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["y"])], "slug string, ovr_min int, tags array<string>")
    over = spark.createDataFrame([("a", None, ["z"])], "slug string, ovr_min int, tags array<string>")
    assert sorted(map(tuple, jobs.overlay_gates(presets, over, "slug").collect())) == [("a", 1, ["z"]), ("b", 2, ["y"])]
    fleet = spark.createDataFrame([("m1", 0), ("m2", 1), ("m3", 2), ("m4", 3)], "id string, position int")
    probes = spark.createDataFrame([("m1", True, None), ("m2", True, 40), ("m3", False, 1)], "id string, ok boolean, latency_ms int")
    assert [r.id for r in jobs.pick_healthy(fleet, probes).collect()] == ["m2", "m1"]
    items = spark.createDataFrame([("p1", "sorted", "s", "w", "Keep", "keep_id7_1700000000_123", ".png", True), ("p2", "sorted", "s", "w", "Keep", "other", ".png", True), ("p3", "sorted", "s", "w", "Keep", "lone", ".png", False)], "path string, status string, topic_slug string, source string, category string, stem string, ext string, has_text boolean")
    moves, lone = jobs.requeue(items, spark.createDataFrame([("queue/s/w/other.png",)], "path string"), slug="s")
    assert [(r.target, r.archive) for r in moves.collect()] == [("queue/s/w/id7.png", None)] and [(r.path, r.target) for r in lone.collect()] == [("p3", ".quarantine/Keep/w/lone.png")]
    assert '"requeued_from":"Keep/w/keep_id7_1700000000_123.png"' in moves.first().meta


def test_stream_crossings(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 2, 12), ("a", 3, 15), ("a", 4, 3), ("a", 5, 11), ("b", 1, 20)]
    spark.createDataFrame(rows, "hook string, tick long, n long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("hook string, tick long, n long").parquet(str(tmp_path / "in"))
    q = streams.stream_crossings(stream, 10).writeStream.format("memory").queryName("fired").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("fired").collect())) == [("a", 2, 12), ("a", 5, 11), ("b", 1, 20)]


def test_stream_index_and_scores(spark, tmp_path):
    schema = "path string, status string, phash string"
    spark.createDataFrame([("a", "queue", "h"), ("b", "queue", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    base = str(tmp_path / "table")
    assert streams.stream_to_table(stream, base, str(tmp_path / "c1")).count() == 2
    spark.createDataFrame([("a", "sorted", "other"), ("c", "queue", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, streams.stream_to_table(stream, base, str(tmp_path / "c1")).select("path", "status", "phash").collect())) == [("a", "sorted", "h"), ("b", "queue", None), ("c", "queue", None)]
    # Another stream with a checkpoint of its own goes on from the table.
    spark.createDataFrame([("d", "queue", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in2"))
    second = spark.readStream.schema(schema).parquet(str(tmp_path / "in2"))
    assert streams.stream_to_table(second, base, str(tmp_path / "c2")).count() == 4

    def scorer(frames):
        for f in frames:
            yield f[["path"]].assign(score=1)

    streams.score_stream(stream, scorer, "path string, score long", str(tmp_path / "scores"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "scores")).agg(F.sum("score")).first()[0] == 4
