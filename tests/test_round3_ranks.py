"""Ranks in groups: no exchange by the group alone, and the numbers of a walk."""

import random
import re

from millrace.operators import ranking
from pyspark.sql import functions as F


def test_ranks_of_a_large_group_are_not_gathered_by_group(spark):
    draw = random.Random(7)
    rows = [(i, draw.choice(["a"] * 20 + ["b", "c", None, ""]), draw.randrange(50)) for i in range(3000)] + [(3000 + i, f"own {i}", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, g string, o int").repartition(7)
    ranked = ranking.with_rank_in_group(df, "g", [F.col("o").desc(), F.col("i").asc()], "n")
    got = {r.i: r.n for r in ranked.collect()}
    seen, want = {}, {}
    for i, g, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        want[i] = seen[g] = seen.get(g, -1) + 1
    assert got == want and ranked.columns == ["i", "g", "o", "n"] and dict(ranked.dtypes)["n"] == "bigint"
    dealt = ranking.with_rank_in_group(df.withColumn("text", F.lit("x")), "g", [F.col("i").asc()], "n")
    dealt.collect()
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert wide and not [x for x in wide if re.search(r"hashpartitioning\((coalesce\()?g#\d+", x)], wide


def test_a_group_over_many_partitions_is_numbered_through(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).selectExpr("id", "if(id < 4900, 'a', 'b') AS g")
        assert {(r.g, r.n - (r.id if r.g == "a" else r.id - 4900)) for r in ranking.with_rank_in_group(df, "g", [F.col("id").asc()], "n").collect()} == {("a", 0), ("b", 0)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
