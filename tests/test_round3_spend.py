"""Rolling spend of crowded hours and of rows without a time."""

from math import isnan, nan
from time import time

from pyspark.sql import functions as F

from millrace.operators import accounting

HOUR = accounting.HOUR


def test_rows_without_time_nulls_and_nan(spark):
    rows = [("a", None, 1.0), ("a", None, 2.0), ("a", 5, None), ("a", 5 + HOUR, 4.0), ("a", 6 + HOUR, 8.0), ("b", 0, nan), ("b", HOUR, 1.0), ("b", HOUR + 1, 1.0), (None, 7, 3.0), ("c", 1, None), ("c", HOUR, None), ("c", -1, 2.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, us long, cost double")
    got = [r.hourly for r in accounting.hourly_spend(df, "k", F.col("us"), "cost").orderBy("i").collect()]
    assert isnan(got[5]) and isnan(got[6])
    assert got[:5] == [3.0, 3.0, None, 4.0, 12.0] and got[7:] == [2.0, 3.0, 2.5, None, 2.5]


def test_a_crowded_hour_is_linear(spark):
    """Each row once: a sum of 200,000 rows for each of 200,000 rows took minutes."""
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 1000).alias("us"), F.lit(1.0).alias("cost"))
    began = time()
    total = accounting.hourly_spend(df, "k", F.col("us"), "cost").agg(F.sum("hourly")).first()[0]
    assert total == n * (n + 1) / 2
    assert time() - began < 60
