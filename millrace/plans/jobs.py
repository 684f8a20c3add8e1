"""Job settings, model fleets and requeueing as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import recover_id
from millrace.operators.catalogue import latest


def overlay_gates(presets: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Settings of each preset with the overrides that aren't null; lists are replaced whole."""
    mine = overrides.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o_{c}") for c in overrides.columns if c != key])
    out = presets.join(mine, F.col(key) == F.col("_key"), "left")
    return out.select(*[F.coalesce(f"_o_{c}", c).alias(c) if c != key and c in overrides.columns else F.col(c) for c in presets.columns])


def pick_healthy(fleet: DataFrame, probes: DataFrame) -> DataFrame:
    """The members whose probe is well, fastest first, unknown latency last, then by position."""
    return fleet.join(probes.filter("ok").select("id", "latency_ms"), "id").orderBy(F.asc_nulls_last("latency_ms"), "position")


def fleet_union(fleets: DataFrame) -> DataFrame:
    """One row for each provider, address and model over all jobs; the first position wins."""
    return latest(fleets, ["provider", "base_url", "model"], [F.asc("position"), F.asc("id")])


def requeue(items: DataFrame, queued: DataFrame, slug: str | None = None, categories: tuple[str, ...] = (), limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items to move, images to quarantine): sorted pairs go back to their queue, lone images to ``.quarantine``.

    Names lose category, time and random part; what is queued already stays. ``items`` has
    ``stem, ext, has_text`` and ``has_audit`` if audit records are to be archived.  Items to move have their ``target``, the ``meta``
    record to write beside it, and ``archive``, where the audit record goes; of items with one target the first by path moves."""
    rows = items.filter("status = 'sorted'")
    if slug is not None:
        rows = rows.filter(F.col("topic_slug") == slug)
    if categories:
        rows = rows.filter(F.col("category").isin(*categories))
    target = F.concat_ws("/", F.lit("queue"), "topic_slug", "source", F.concat(recover_id(F.col("stem")), F.col("ext")))
    moves = rows.filter("has_text").withColumn("target", target).join(queued.select(F.col("path").alias("target")), "target", "left_anti")
    moves = latest(moves, ["target"], [F.asc("path")])
    came = F.concat_ws("/", "category", "source", F.concat("stem", "ext"))
    meta = F.to_json(F.struct(recover_id(F.col("stem")).alias("message_id"), F.col("source").alias("source_channel"), came.alias("requeued_from")))
    has_audit = F.col("has_audit") if "has_audit" in rows.columns else F.lit(False)
    archive = F.when(has_audit, F.concat_ws("/", F.lit("_archive"), "category", "source", F.concat("stem", F.lit(".vision.json"))))
    moves = moves.withColumns({"meta": meta, "archive": archive})
    if limit is not None:
        moves = moves.orderBy("path").limit(limit)
    lone = rows.filter("NOT has_text").withColumn("target", F.concat_ws("/", F.lit(".quarantine"), came))
    return moves, lone
