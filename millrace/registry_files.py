"""Queries of file heads, seen tables and scored streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.headers import image_header
from millrace.registry import query
from millrace.session import shared_dir, table
from millrace.streaming.scoring import ScoredStream, judge_stream, judged_answers
from millrace.streaming.seen import SeenTable


def _hex(value: Column, size: int, little: bool = False) -> Column:
    """A number as hexadecimal text of ``size`` bytes."""
    text = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(size - 1, -1, -1)]) if little else text


def heads(documents: DataFrame) -> DataFrame:
    """``doc_id, content``: heads of PNG, JPEG (after up to 99 comments), GIF and WebP files of sizes by the row, then the text; plain texts between."""
    width, height = F.col("n_chars") % 4000 + 1, F.col("doc_id") % 3000 + 1
    comment = F.concat(F.lit("FFFE0022"), F.hex(F.encode(F.md5(F.coalesce("text", F.lit(""))), "UTF-8")))
    head = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(width, 4), _hex(height, 4)))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("FFD8"), F.repeat(comment, (F.col("doc_id") % 100).cast("int")), F.lit("FFC0000B08"), _hex(height, 2), _hex(width, 2)))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("474946383961"), _hex(width, 2, True), _hex(height, 2, True)))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit("524946460000000057454250565038580A00000010000000"), _hex(width - 1, 3, True), _hex(height - 1, 3, True)))
        .otherwise("")
    )
    return documents.select("doc_id", F.concat(F.unhex(head), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))


query(
    "src4_image_headers",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' END AS kind,
    CASE WHEN doc_id % 5 < 4 THEN CAST(n_chars % 4000 + 1 AS INT) END AS width, CASE WHEN doc_id % 5 < 4 THEN CAST(doc_id % 3000 + 1 AS INT) END AS height
    FROM documents""",
)(lambda spark, d: heads(table(spark, d, "documents")).select("doc_id", image_header(F.col("content")).alias("h")).select("doc_id", "h.*"))


@query(
    "j2_seen_table",
    """SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_orderkey""",
)
def seen_table(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each order that isn't among the urgent ones, which a seen table holds."""
    seen = SeenTable(spark, f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}", 16)
    seen.add(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), "o_orderkey")
    return seen.unseen(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", [F.asc("l_linenumber")])


def _model():
    """A stand-in for a model: it doesn't answer some rows the first time and others never."""

    def ask(frames):
        for f in frames:
            never, late = f["doc_id"] % 11 == 0, (f["doc_id"] % 7 == 0) & (f["attempt"] == 1)
            said = '{"category": "' + f["doc_id"].mod(2).map({0: "Top", 1: "Mid"}) + '", "OVR_Quality_Score": ' + (f["n_chars"].fillna(0).astype("int64") % 101).astype(str) + "}"
            yield said.mask(never | late)

    return ask


@query(
    "st7_scored_stream",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 3 WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS attempt,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN coalesce(n_chars, 0) % 101 < 40 THEN 'DISCARD' WHEN doc_id % 2 = 0 THEN 'Top' ELSE 'Mid' END AS category FROM documents""",
)
def scored_stream(spark: SparkSession, d: str) -> DataFrame:
    """All documents as a stream, scored and judged, with two further rounds for rows without an answer; the given up ones have no category."""
    base = f"{shared_dir(spark)}/scored-{uuid.uuid4().hex}"
    schema = table(spark, d, "documents").select("doc_id", "n_chars").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")  # a pattern finds a file as well as a folder of files
    scored = ScoredStream(spark, f"{base}/rows", _model(), lambda df: judged_answers(df, ("Top", "Mid"), 40).select("doc_id", "attempt", "category"))
    judged = judge_stream(stream, scored, f"{base}/checkpoint").select("doc_id", "attempt", "category")
    return judged.unionByName(scored.read("given_up").select("doc_id", "attempt"), allowMissingColumns=True)
