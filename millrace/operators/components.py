"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import remove, stored_at

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least node among them and itself.

    The least neighbour is an aggregate and is joined back, so that a node with very many
    neighbours is summed up before the shuffle and its join can be split."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = both.groupBy("src").agg(F.min("dst").alias("_least"))
    least = least.select(F.col("src").alias("_at"), F.least("src", "_least").alias("_least"))
    joined = both.join(least, F.col("src") == F.col("_at"))
    if large:
        out = joined.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("_least").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("_least").alias("dst")).unionByName(least.select(F.col("_at").alias("src"), F.col("_least").alias("dst")))
    return out.filter(F.col("src") != F.col("dst"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node that has an edge; the component is its least node.

    ``edges`` has columns ``src`` and ``dst`` of one orderable type, in any direction.
    Ends when a double step changes nothing: then each edge leads from a node to the least
    node of its component.  Each round is written to the shared folder, and the round before it removed."""
    ordered = edges.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))

    def counted(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()

    now, path = stored_at(ordered.distinct(), "edges")
    before = counted(now)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        old = path
        now, path = stored_at(_star(_star(now, large=True), large=False).distinct(), "edges")
        found = counted(now)
        remove(edges.sparkSession, old)
        if found == before:
            break
        before = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
