"""Near-duplicates of perceptual hashes and vectors, vector search, similarity-capped sampling."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb, inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import vector_cells, vector_index
from millrace.operators.components import connected_components
from millrace.operators.ranking import with_rank_in_group
from millrace.session import stored

BITS, MOST_PROBES = 64, 200
#: Blocks of values that meet each other, their least and largest size, and how many comparisons of values in a block cost as much as a row of a join.
BLOCKS, LEAST_BLOCK, MOST_BLOCK, ROW = 64, 1024, 65_536, 100
CELLS = 1 << 21


def signature(vector: Column) -> Column:
    """64 sign bits of the first 64 components, as a long."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.lit(1).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def hex_hash(text: Column) -> Column:
    """A 16-digit hexadecimal hash as a long; null for other text."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("long"))


def band_plan(n: int, threshold: int) -> int:
    """How many bands make the least work among n values, by the probes of a value and the values each meets; 0 for all with all.

    A value has MOST_PROBES probes at most in a band, so that what is shuffled stays in proportion to the values."""

    def work(bands: int) -> float:
        width, radius = BITS // bands, threshold // bands
        probes = sum(comb(width, r) for r in range(radius + 1))
        return ROW * bands * probes * (1 + n / 2**width) if probes <= MOST_PROBES else inf

    best = min(range(2, 9), key=work)
    return best if work(best) < n else 0


def _near_in_blocks(left: np.ndarray, right: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of values of two blocks, the lesser first; CELLS at a time are compared."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        i, j = np.nonzero(np.bitwise_count((part[:, None] ^ right[None, :]).view(np.uint64)) <= threshold)
        found.append((part[i], right[j]))
    x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    return np.minimum(x, y), np.maximum(x, y)


def _all_close(distinct: DataFrame, n: int, threshold: int) -> DataFrame:
    """All values with all, a block with a block: each block meets itself and half of the others, as many as any other."""
    blocks = -(-n // min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))) or 1
    packed = distinct.groupBy(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("_b")).agg(F.collect_list("v").alias("_left"))
    packed = stored(packed, "blocks")
    left = packed.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(blocks // 2)))).withColumn("_c", F.pmod(F.col("_b") + F.col("_d"), F.lit(blocks)))
    left = left.filter((2 * F.col("_d") < blocks) | (F.col("_b") < F.col("_c")))
    # Blocks are few bytes and much work: their number of partitions is given, else small ones are put together or the exploded side is broadcast.
    right = packed.select(F.col("_b").alias("_c"), F.col("_left").alias("_right")).repartition(2 * blocks, "_c")
    met = left.repartition(2 * blocks, "_c").join(right.hint("merge"), "_c").select("_d", "_left", "_right")

    def compare(batches):
        for batch in batches:
            for r in range(len(batch)):
                left, right = (batch.column(c)[r].values.to_numpy() for c in (1, 2))
                v, w = _near_in_blocks(left, right, threshold)
                if not batch.column(0)[r].as_py():  # a block with itself has each pair twice
                    own = v < w
                    v, w = np.unique(np.stack([v[own], w[own]]), axis=1) if own.any() else (v[:0], w[:0])
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w)], names=["v", "w"])

    return met.mapInArrow(compare, "v long, w long")


def _close_values(distinct: DataFrame, threshold: int) -> DataFrame:
    """``v, w``: distinct 64-bit values (v < w) that differ in at most ``threshold`` bits.

    Multi-index hashing: of b bands some one differs in at most ``threshold // b`` bits, so one side is probed with all such variants of
    each band and meets the other in an equality join.  The number of bands follows from the number of values; where probes
    cost more than they save, as for wide thresholds or few values, all values meet in blocks."""
    n = distinct.count()
    bands = band_plan(n, threshold)
    if not bands:
        return _all_close(distinct, n, threshold)
    close = F.bit_count(F.col("v").bitwiseXOR(F.col("w"))) <= threshold
    width = BITS // bands
    masks = [sum(1 << i for i in bits) for r in range(threshold // bands + 1) for bits in combinations(range(width), r)]
    parts = F.posexplode(F.array(*[F.shiftrightunsigned("v", width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for i in range(bands)]))
    banded = distinct.select("v", parts.alias("band", "part"))
    probes = banded.withColumn("_m", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).select(F.col("v").alias("w"), "band", F.col("part").bitwiseXOR(F.col("_m")).alias("part"))
    # Spark takes exploded probes to be as small as the values: without the hint it broadcasts them, all through the driver.
    return banded.join(probes.hint("merge"), ["band", "part"]).filter((F.col("v") < F.col("w")) & close).select("v", "w").distinct()


def near_hash_pairs(df: DataFrame, key: str, value: str, threshold: int = 10) -> DataFrame:
    """``a, b, distance``: all pairs of keys (a < b) whose 64-bit values differ in at most ``threshold`` bits.

    The list itself grows with the square of a group of copies; ``near_hash_groups`` doesn't."""
    if threshold < 0:
        return df.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance")).limit(0)
    rows = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    pairs = _close_values(rows.select("v").distinct(), threshold)
    left, right = rows.withColumnsRenamed({"k": "ka", "v": "va"}), rows.withColumnsRenamed({"k": "kb", "v": "vb"})
    across = pairs.join(left, F.col("v") == F.col("va")).join(right, F.col("w") == F.col("vb")).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.bit_count(F.col("v").bitwiseXOR(F.col("w"))).alias("distance"))
    same = left.join(right, (F.col("va") == F.col("vb")) & (F.col("ka") < F.col("kb"))).select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.lit(0).alias("distance"))
    return across.unionByName(same)


def near_hash_groups(df: DataFrame, key: str, value: str, threshold: int = 10) -> DataFrame:
    """``key, component``: the least key that near hashes lead to; null hashes stand alone.

    Copies are one value, however many there are, and join their value's component at the end."""
    rows = df.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    found = connected_components(_close_values(rows.filter("_v IS NOT NULL").select(F.col("_v").alias("v")).distinct(), max(0, threshold)).toDF("src", "dst"))
    values = rows.filter("_v IS NOT NULL").groupBy("_v").agg(F.min("_k").alias("_least"))
    values = values.join(found, F.col("_v") == F.col("node"), "left").withColumn("component", F.coalesce("component", "_v"))
    least = values.groupBy("component").agg(F.min("_least").alias("_first"))
    labels = values.join(least, "component").select(F.col("_v").alias("_value"), "_first")
    out = rows.join(labels, F.col("_v") == F.col("_value"), "left")
    return out.select(F.col("_k").alias(key), F.coalesce("_first", "_k").alias("component"))


def near_vector_pairs(df: DataFrame, key: str, vector: str, threshold: float = 0.92) -> DataFrame:
    """``a, b, cosine``: pairs of keys (a < b) at or above the threshold; vectors of one length only.

    Exact; the list itself grows with the square of a group of near vectors, ``clusters`` doesn't."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return vector_cells.near_pairs(rows, threshold)


def near_groups(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``key, component`` of every row; a row without a pair is its own component."""
    found = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    out = df.select(key).join(found, F.col(key) == F.col("node"), "left")
    return out.select(key, F.coalesce("component", key).alias("component"))


def first_of_groups(groups: DataFrame, key: str, cap: int) -> DataFrame:
    """The first ``cap`` rows, by key, of each component of ``groups (key, component)``; none at all for a cap of 0 or less."""
    nth = F.row_number().over(Window.partitionBy("component").orderBy(key))
    return groups.withColumn("_n", nth).filter(F.col("_n") <= cap).drop("_n")


def balance(df: DataFrame, pairs: DataFrame, key: str, cap: int) -> DataFrame:
    """The first ``cap`` rows, by key, of each similarity cluster; none at all for a cap of 0 or less."""
    return first_of_groups(near_groups(df, pairs, key), key, cap)


def semantic_search(df: DataFrame, queries: list[tuple[str, list[float], int | None]], key: str, vector: str) -> DataFrame:
    """``query_id, key, cosine, nth``: the nearest rows of each query, which the caller lists; one pass over the table for all of them.

    Each task multiplies its rows with all queries and keeps of each batch the nearest of each query.  Vectors of another length, and those with null or
    non-finite components, are skipped; top_k null or below 0 means all; ties go by key.  For many queries, or searches again and again, see ``vector_index``."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter(vector_index.sound("v"))
    wanted = [(i, q, -1 if n is None or n < 0 else n) for i, q, n in queries]

    def nearest(frames):
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len)):
                asked = [(i, np.asarray(q, np.float64), n) for i, q, n in wanted if len(q) == dim]
                if not asked:
                    continue
                keys, m = part["k"].to_numpy(), vector_index.unit(part["v"])
                for query_id, q, n in asked:
                    length = np.linalg.norm(q)
                    cosine = vector_index.cosines(m, q / length) if length > 0 else np.zeros(len(part))
                    near = np.lexsort((keys, -cosine))[: n if n >= 0 else None]
                    yield pd.DataFrame({"query_id": query_id, "k": keys[near], "cosine": cosine[near], "top_k": n})

    id_kind = "string" if not queries or isinstance(queries[0][0], str) else "long"
    hits = rows.mapInPandas(nearest, f"query_id {id_kind}, k {kind}, cosine double, top_k int")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.col("k").asc())
    few = hits.filter("top_k >= 0").withColumn("nth", F.row_number().over(order)).filter("nth <= top_k").drop("top_k")
    found = [few]
    if any(n < 0 for _, _, n in wanted):
        ranked = with_rank_in_group(hits.filter("top_k < 0"), "query_id", [F.desc("cosine"), F.col("k").asc()], "nth")
        found.append(ranked.withColumn("nth", (F.col("nth") + 1).cast("int")).drop("top_k"))
    out = reduce(DataFrame.unionByName, found)
    return out.select("query_id", F.col("k").alias(key), "cosine", "nth")


def put_vectors(base: DataFrame, new: DataFrame) -> DataFrame:
    """Append and compact: the vector with the highest ``seq`` of each key."""
    both = base.unionByName(new)
    return both.groupBy("key").agg(F.max_by("vec", "seq").alias("vec"), F.max("seq").alias("seq"))


def clusters(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """``key, component`` of every row: the least key that near vectors lead to.

    Copies are one node, however many there are, and join its component at the end.  Null vectors, those that aren't finite, and
    for thresholds above 0 zero vectors are near nothing."""
    v = F.col("_v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    can = finite & F.lit(threshold <= 1) & (F.lit(threshold <= 0) | F.exists(v, lambda x: x != 0))
    rows = df.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    rows = rows.withColumn("_v", F.when(can, v)).withColumn("_h", F.xxhash64("_v"))
    nodes = stored(rows.filter("_v IS NOT NULL").groupBy("_h", "_v").agg(F.min("_k").alias("k")), "nodes")
    links = vector_cells.near_links(nodes.select("k", F.col("_v").alias("v")), threshold)
    labels = nodes.join(connected_components(links), F.col("k") == F.col("node"), "left")
    labels = labels.select(F.col("_h").alias("_hash"), F.col("_v").alias("_vector"), F.coalesce("component", "k").alias("component"))
    out = rows.join(labels, (F.col("_h") == F.col("_hash")) & (F.col("_v") == F.col("_vector")), "left")
    return out.select(F.col("_k").alias(key), F.coalesce("component", "_k").alias("component"))
