"""The catalogue ("items") view over the driver's tables and its SQL twin.

``documents`` left-joined with ``labels`` stands in for media items; the scores are
invented numbers that exercise the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import table

ITEMS_SQL = """
SELECT concat('doc/', d.doc_id, '.txt') AS path,
       CASE WHEN d.doc_id % 5 = 0 THEN 'queue' ELSE 'sorted' END AS status,
       d.lang AS topic_slug, d.source AS source,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN l.toxic = 1 THEN 'DISCARD' WHEN l.quality = 1 THEN 'Keep'
            WHEN l.quality = 0 THEN 'Borderline' ELSE 'OffTopic' END AS category,
       CAST(d.doc_id AS DOUBLE) AS mtime, d.n_chars AS size,
       CAST(d.n_chars % 101 AS INT) AS ovr, CAST((d.n_chars * 7) % 101 AS INT) AS rel,
       CAST(1 + d.n_chars % 10 AS INT) AS quality, coalesce(l.toxic, 0) = 1 AS nsfw, d.text AS prompt
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

#: For oracles: ``WITH items AS (...)``.
ITEMS_CTE = "items AS (" + ITEMS_SQL.format(documents="documents", labels="labels") + ")"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ITEMS_SQL, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
