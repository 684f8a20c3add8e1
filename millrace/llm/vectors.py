"""Embedding near-duplicates by passes over random signs; vectors with equal leading signs are compared.

1. Equal vectors form one node; copies, however many, go no further.
2. A pass orders nodes by the concatenated signs of their random projections and compares the whole run of nodes whose leading
   signs are equal, at every size of the table.  The number of leading signs follows from the number of nodes (runs, or buckets, of BUCKET
   nodes, where vectors are spread evenly; one sign at least), and the number of passes from both: a pair at the
   threshold shares no bucket with probability MISS at most, a nearer pair with less.
3. All members of a bucket are compared with each other, however many there are: a bucket of
   more than two BLOCKs is dealt into blocks, and each two blocks meet in a task of their own.
   A pair counts in the first pass that brings it together, which both sides' keys tell.
   Candidates are found in single and confirmed in double precision.
4. Two blocks return for each node how many rows it is linked with and one node that it is
   connected with there, and so a group of n near vectors gives rows in proportion to n.
5. Those links are united across blocks and passes into components.

Work grows with the square of the largest bucket.

Defined cases: null vectors, zero vectors, and vectors with null or non-finite components link with
nothing and are kept; vectors of different lengths don't link; repeated rows are copies; a null
vec_id counts as the largest; an empty table gives no rows; further columns are ignored; very long vectors
are multiplied whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.session import stored, table

THRESHOLD = 0.9
MISS = 1e-4
BUCKET, BLOCK = 4096, 4096
ROWS, PAIRS = 256, 65_536
MARGIN = 1e-4


def plan(n: int, threshold: float = THRESHOLD, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """The number of passes and the number of signs in each."""
    signs = max(1, math.ceil(math.log2(max(n, 1) / bucket)))
    together = (1 - math.acos(threshold) / math.pi) ** signs
    return math.ceil(math.log(miss) / math.log1p(-together)), signs


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pass_keys(nodes: DataFrame, passes: int, signs: int) -> DataFrame:
    """``nodes`` with ``keys``: for each pass its signs as one number."""

    def keys(batches):
        weights = np.int64(1) << np.arange(signs, dtype=np.int64)
        planes = {}
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                dims = batch.column(2).to_numpy()
                out = np.zeros((len(dims), passes), np.int64)
                for d in np.unique(dims):
                    rows = np.flatnonzero(dims == d)
                    if d not in planes:
                        planes[d] = np.random.Generator(np.random.PCG64(1000 + int(d))).standard_normal((int(d), passes * signs))
                    found = _matrix(batch.column(3).take(pa.array(rows))) @ planes[d] > 0
                    out[rows] = found.reshape(len(rows), passes, signs) @ weights
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, passes), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "size", "dim", "vector", "keys"])

    return nodes.select("node", "size", "dim", "vector").mapInArrow(keys, "node long, size long, dim int, vector array<double>, keys array<long>")


def block_links(threshold: float):
    """For two blocks of a bucket, or one with itself, the links that this pass is the first to find."""

    def links(table_: pa.Table) -> pa.Table:
        t = table_.combine_chunks()
        column = lambda c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
        node, size, part, lo, hi, turn = (column(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "part", "lo", "hi", "pass"))
        keys, exact = _matrix(column("keys")), _matrix(column("vector")).astype(np.float64)
        exact /= np.abs(exact).max(axis=1, keepdims=True)
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        unit = exact.astype(np.float32)
        one = lo[0] == hi[0]
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        linked, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for a in range(0, len(left), ROWS):
            rows, others = left[a : a + ROWS], right[a:] if one else right
            close = (unit[rows] @ unit[others].T).ravel()
            near = np.flatnonzero(close >= threshold - MARGIN)
            for s in range(0, len(near), PAIRS):
                at = near[s : s + PAIRS]
                i, j, sure = rows[at // len(others)], others[at % len(others)], close[at] >= threshold + MARGIN
                if one:
                    i, j, sure = i[j > i], j[j > i], sure[j > i]
                new = (keys[i] == keys[j]).argmax(axis=1) == turn[0]
                i, j, sure = i[new], j[new], sure[new]
                doubt = np.flatnonzero(~sure)
                sure[doubt] = np.einsum("ij,ij->i", exact[i[doubt]], exact[j[doubt]]) >= threshold
                i, j = i[sure], j[sure]
                for x, y in ((i, j), (j, i)):
                    linked += np.bincount(x, size[y], len(node)).astype(np.int64)
                while (root[i] != root[j]).any():
                    x, y = root[i], root[j]
                    np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                    while (root[root] != root).any():
                        root = root[root]
        some = np.flatnonzero(linked)
        return pa.table({"node": node[some], "root": node[root[some]], "linked": linked[some]})

    return links


def near_links(nodes: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """``node, root, linked``: in how many rows a node has partners, and a node of the same component.

    ``nodes`` is a materialised frame ``node, size, dim, vector``; a node comes once for each two blocks that link it."""
    keyed = stored(pass_keys(nodes, *plan(nodes.count(), threshold, bucket, miss)), "keys")
    place = ["dim", "pass", "key"]
    counts = keyed.select("dim", F.posexplode("keys").alias("pass", "key")).groupBy(*place).agg(F.count("*").alias("_n"))
    large = stored(counts.filter(F.col("_n") > 2 * block).select(*place, F.ceil(F.col("_n") / block).alias("_blocks")), "large")
    dealt = keyed.select("*", F.posexplode("keys").alias("pass", "key")).join(large, place, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", "pass"), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.select("node", "size", "vector", "keys", *place, "part", F.least("part", "_other").alias("lo"), F.greatest("part", "_other").alias("hi"))
    return dealt.groupBy(*place, "lo", "hi").applyInArrow(block_links(threshold), "node long, root long, linked long")


def links_and_components(vectors: DataFrame, **how) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for a frame ``vec_id, embedding``."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("embedding"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumns({"usable": usable, "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), F.col("embedding"))})
    nodes = rows.filter("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("embedding").alias("vector"))
    # The number of a node only has to be its own, and stands once written; ids that repeat in different vectors don't disturb it.
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first", "size", F.size("vector").alias("dim"), "vector"), "nodes")
    links = stored(near_links(nodes, **how), "links")
    found = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    linked = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    labels = nodes.select("node", "h1", "h2", "first", "size").join(linked, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = stored(labels, "labels")
    least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = labels.join(least, "component").select("h1", "h2", "component_id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "h1", "h2", "usable").join(labels, ["h1", "h2"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_and_components(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT c.a AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.a) AS n_links, component_id, c.a = component_id AS kept FROM c
"""
