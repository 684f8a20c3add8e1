"""Export plans: which file goes where, as a frame, and the writers that act on it."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import HUB_IMAGES, HUB_VIDEOS, duration_label, fps_label, resolution_label, split_bucket, trigger_word
from millrace.operators.catalogue import TERMINAL, unique_stems
from millrace.operators.ranking import with_rank_in_group
from millrace.session import remove

CHUNK = 4 << 20
TEMPORARY = "_temporary-"
PROFILES = ("kohya", "folders", "webdataset", "clips")


def samples(items: DataFrame, kept: tuple[str, ...], requested: tuple[str, ...] | None = None) -> DataFrame:
    """Sorted items of the requested kept categories; terminal ones never, hidden sources neither."""
    wanted = [c for c in kept if c.upper() not in TERMINAL and (requested is None or c in requested)]
    rows = items.filter((F.col("status") == "sorted") & F.col("category").isin(*wanted))
    return rows.filter(~F.col("source").startswith("."))


def checked(profile: str, split: float | None, repeats: int, shard: int) -> None:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    if split is not None and not 0 <= split < 1:
        raise ValueError("the validation share lies in [0, 1)")
    if repeats < 0 or shard <= 0:
        raise ValueError("repeats are at least 0, shard sizes at least 1")


def plan(rows: DataFrame, profile: str, split: float | None = None, repeats: int = 0, concept: str = "subject", bucket: str | None = None, trigger: str = "", shard: int = 1000) -> DataFrame:
    """``folder, name, caption`` for each sample, and ``shard`` for archives.

    The folder is ``[split]/[leaf]/[bucket]``; names are unique in a folder, in the order category,
    source, path."""
    checked(profile, split, repeats, shard)
    labels = {"resolution": lambda: resolution_label(F.col("width"), F.col("height")), "duration": lambda: duration_label(F.col("duration")), "fps": lambda: fps_label(F.col("fps"))}
    if bucket is not None and bucket not in labels:
        raise ValueError(f"unknown bucketing: {bucket}")
    leaf = {"kohya": F.lit(f"{repeats}_{concept}" if repeats else None), "folders": F.col("category")}.get(profile, F.lit(None)).cast("string")
    rows = rows.withColumn("split", split_bucket(F.col("stem"), split))
    rows = rows.withColumn("bucket", labels[bucket]() if bucket else F.lit(None).cast("string"))
    rows = rows.withColumn("folder", F.concat_ws("/", "split", leaf, "bucket")).withColumn("caption", trigger_word(F.col("caption"), trigger))
    order = ["category", "source", "path"]
    if profile == "webdataset":
        rows = with_rank_in_group(rows, "folder", [F.col(c).asc() for c in order], "_nth")
        rows = rows.withColumn("shard", F.format_string("shard-%06d.tar", F.floor(F.col("_nth") / shard).cast("int"))).drop("_nth")
        return unique_stems(rows.withColumn("_home", F.concat_ws("/", "folder", "shard")), "_home", "stem", order).drop("_home")
    return unique_stems(rows, "folder", "stem", order)


def shard_summary(planned: DataFrame) -> DataFrame:
    """One row: samples, splits, archives, categories and how many samples each bucket has (a folder lies in one bucket)."""
    by = planned.groupBy("bucket").agg(F.count("*").alias("sample_count"), F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_distinct("folder", "shard").alias("shard_count"), F.collect_set("category").alias("_categories"))
    buckets = F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.concat_ws("=", "bucket", F.col("sample_count").cast("string")))))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sample_count", "n_val", "n_train", "shard_count")]
    return by.agg(*sums, F.array_sort(F.array_distinct(F.flatten(F.collect_list("_categories")))).alias("categories"), buckets.alias("buckets"))


def hub_metadata(rows: DataFrame, include_video: bool = False) -> DataFrame:
    """Rows of ``metadata.jsonl`` for files ``(category, file, caption, score, source)`` that a hub takes; null fields are left out when written."""
    taken = HUB_IMAGES + (HUB_VIDEOS if include_video else ())
    rows = rows.filter(F.lower(F.regexp_extract("file", r"(\.[^.]+)$", 1)).isin(*taken))
    return rows.select(F.concat_ws("/", "category", "file").alias("file_name"), F.coalesce("caption", F.lit("")).alias("caption"), "category", "score", F.nullif("source", F.lit("")).alias("source"))


def write_hub_metadata(rows: DataFrame, path: str, include_video: bool = False) -> None:
    """One row per sample, ordered, as JSON lines in the export folder."""
    hub_metadata(rows, include_video).repartitionByRange("file_name").sortWithinPartitions("file_name").write.mode("overwrite").json(path)


def _copied(source: BinaryIO, target: BinaryIO) -> int:
    """Copy a stream by chunks, so that no file is in memory as a whole; returns its size."""
    size = 0
    while chunk := source.read(CHUNK):
        target.write(chunk)
        size += len(chunk)
    return size


@contextmanager
def _finished(target, root: str, run: str, path: str) -> Iterator[BinaryIO]:
    """A stream to a file in the run's own folder, which takes its name when it is whole; a task that runs again puts the same file there.

    ``publish`` removes that folder."""
    folder = path.rsplit("/", 1)[0]
    target.create_dir(folder)
    target.create_dir(f"{root}/{TEMPORARY}{run}")
    part = f"{root}/{TEMPORARY}{run}/{uuid.uuid4().hex}"
    with target.open_output_stream(part) as out:
        yield out
    target.move(part, path)


def copy_files(planned: DataFrame, destination: str, run: str = "") -> DataFrame:
    """Copy each sample and write its caption on the executors, and its audit record, ``{}`` if it has none, where the plan has a
    column ``audit``; returns ``written, size`` of the samples.  Only paths move through Spark."""

    def copy(batches):
        target, root = fs.FileSystem.from_uri(destination)
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                stem = f"{root}/{row['folder']}".rstrip("/") + f"/{row['name']}"
                source, path = fs.FileSystem.from_uri(row["path"])
                with source.open_input_stream(path) as read, _finished(target, root, run, stem + row["ext"]) as out:
                    size = _copied(read, out)
                for ext, text in ({".txt": row["caption"] or ""} | ({".json": row["audit"] or "{}"} if "audit" in row else {})).items():
                    with _finished(target, root, run, stem + ext) as out:
                        out.write(text.encode())
                done.append({"written": stem + row["ext"], "size": size})
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("written", pa.string()), ("size", pa.int64())]))

    return planned.select("path", "folder", "name", "ext", "caption", *(["audit"] if "audit" in planned.columns else [])).mapInArrow(copy, "written string, size long")


def write_tars(planned: DataFrame, destination: str, run: str = "") -> DataFrame:
    """One tar per folder and shard, its members image, ``.txt`` and ``.json`` sharing a stem; returns ``written, n``.

    A shard has a bounded number of samples; only paths, captions and audit texts are shuffled, bytes are read where the tar is written."""

    def write(pdf):
        target, root = fs.FileSystem.from_uri(destination)
        path = f"{root}/{pdf['folder'].iloc[0]}".rstrip("/") + f"/{pdf['shard'].iloc[0]}"
        with _finished(target, root, run, path) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for row in pdf.sort_values("path").itertuples():
                source, where = fs.FileSystem.from_uri(row.path)
                info = tarfile.TarInfo(row.name + row.ext)
                info.size = source.get_file_info(where).size
                with source.open_input_stream(where) as read:
                    tar.addfile(info, read)
                for ext, text in ((".txt", row.caption or ""), (".json", row.audit or "{}")):
                    info, data = tarfile.TarInfo(row.name + ext), text.encode()
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"written": [path], "n": [len(pdf)]})

    rows = planned.select("path", "folder", "shard", "name", "ext", "caption", "audit")
    return rows.groupBy("folder", "shard").applyInPandas(write, "written string, n long")


def publish(planned: DataFrame, destination: str, write: Callable[[DataFrame, str, str], DataFrame] = copy_files) -> DataFrame:
    """Run a writer and publish what it wrote as the table ``_manifest`` in the destination, which it returns.

    The manifest of an earlier run goes first and the new one is whole or absent, so an export without one broke off.  Files of an earlier run stay and may
    be outside the manifest.  What killed tasks left is removed in either case; a task that ran twice is in the manifest once."""
    spark, run, manifest = planned.sparkSession, uuid.uuid4().hex, f"{destination.rstrip('/')}/_manifest"
    try:
        write(planned, destination, run).write.mode("overwrite").parquet(manifest)
    finally:
        remove(spark, f"{destination.rstrip('/')}/{TEMPORARY}{run}")
    return spark.read.parquet(manifest)
