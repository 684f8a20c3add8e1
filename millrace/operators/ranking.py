"""A global row number that no hot key can gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import stored


def with_global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add ``name``: 0-based position of each row in ``order`` over the whole frame.

    Rows are range-partitioned (equal keys are split by a tie column, so a key that
    holds a third of all rows is spread as well), written once with the partition
    number, and numbered inside each partition.  The per-partition counts, one row
    for each partition, give the offsets; they are the only thing broadcast.  Rows
    that are equal in ``order`` get consecutive numbers in no particular order.
    """
    keys = [*order, F.col("_tie").asc()]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_part", "_before", "_tie")
    )


def with_rank_in_group(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Add ``name``: 0-based position of each row in ``order`` among those of its ``group``.

    Rows are ordered by group first and range-partitioned as in ``with_global_rank``, so that only the first group of a partition can have rows
    before it; how many is one row for each partition at most, and broadcast.  Nothing is gathered by group alone: one with most of the rows is no task of its own."""
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_tie").asc()]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("_part", F.col(group).alias("_group")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_at"), "_group", F.sum("_rows").over(before).alias("_before")).filter("_before > 0")
    inside = Window.partitionBy("_part", group).orderBy(*keys[1:])
    numbered = ranged.withColumn(name, (F.row_number().over(inside) - 1).cast("long"))
    out = numbered.join(F.broadcast(offsets), (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_tie", "_at", "_group", "_before")
