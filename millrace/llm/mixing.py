"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Sources in code-point order, null last, weigh 3, 1, 2, repeating.  Together they get
``budget`` times all words; no source gets more than ``max_repeat`` times its own words,
and what it can't take is shared again by weight among the others.

Inside a source every document expects ``target / source_size`` copies.  The documents
are put in order of size, the expected copies are summed up along that order, one random
offset for the source is added, and a document is emitted once for each integer that its
interval crosses.  In order of size, the words taken follow the target to within about
the largest document.  A distributed rank stands for the prefix sum, since all steps
inside a source are equal.

Defined cases: a null text has size 0; null sources form one source, the last; a source
without words has target 0 and takes nothing; documents that are equal in size go by
doc_id, null first, then by the hash of their text and in ``expand`` of all their columns, and so reruns agree on ties;
repeated rows are separate documents; an empty table gives no rows;
further columns are ignored by the query and kept by ``expand``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import with_global_rank
from millrace.session import stored, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEAT = 2.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source: ``source_size``, ``target``, ``rate`` (copies expected of a document), ``first_rank``.

    The shares solve ``target = min(cap, level * weight)``.  With sources in order of
    ``cap / weight``, the level that would follow if exactly the earlier ones were capped
    rises to the right one and falls after it, so the level is its maximum.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", pick.cast("double").alias("weight"), (F.lit(max_repeat) * F.col("source_size")).alias("cap"), F.coalesce(F.sum("n_docs").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_rank"))
    total = F.lit(budget) * F.sum("source_size").over(every)
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - capped) / rest)
    target = F.least(F.col("cap"), F.col("weight") * F.max("level").over(every))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"), "first_rank")


def with_copies(sizes: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """Add ``source_size, target, copies`` to a materialised frame that has ``source, size, doc_id``."""
    targets = source_targets(sizes, **how)
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_first()]
    ranked = with_global_rank(sizes, [*order, *[F.col(c).asc() for c in ("_text", "_row") if c in sizes.columns]])
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("")))), 1, 4), 16, 10).cast("double") / 65536
    joined = ranked.alias("r").join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    at = F.col("rank") - F.col("first_rank")
    crossed = F.floor(F.col("rate") * (at + 1) + start) - F.floor(F.col("rate") * at + start)
    most = int(how.get("max_repeat", MAX_REPEAT))
    return joined.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).drop("rank", "rate", "first_rank")


def measured(docs: DataFrame, *extra: Column) -> DataFrame:
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"), *extra), "sizes")


def expand(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it was drawn.

    A row is found again by the hash of all its columns; of rows that are equal in all
    of them, one stands for the draws of all.
    """
    cols = docs.columns
    key = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    drawn = with_copies(measured(docs, key.alias("_row")), **how)
    drawn = drawn.groupBy("doc_id", "_row").agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    drawn = drawn.withColumnsRenamed({"doc_id": "_doc", "_row": "_key"})
    one = Window.partitionBy("id", "key").orderBy(F.lit(1))
    # The rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("doc_id").alias("id"), key.alias("key"))
    rows = rows.join(drawn, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_doc")))
    rows = rows.withColumn("n", F.row_number().over(one)).filter("n = 1")
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_copies(measured(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP1_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
        CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM p),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM p)
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM l)) AS target,
        ('0x' || substr(md5('mix-1:' || coalesce(source, '')), 1, 4))::INT / 65536.0::DOUBLE AS u FROM l),
r AS (SELECT s.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) - 1 AS k
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(least(floor(rate * (k + 1) + u) - floor(rate * k + u), 2) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""
