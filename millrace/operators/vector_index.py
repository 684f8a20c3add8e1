"""An inverted-file index of vectors: rows by the cell of their nearest centroid, searched exactly by the triangle inequality of angles.

Centroids are fitted by a few rounds of spherical k-means on a sample of about SAMPLE rows, twice as many at most, chosen by a hash; every row is indexed.  A row stores its
angle to its centroid, and the table is ordered by cell and angle, so that a filter on cells prunes row groups.  For a query at an angle ``a`` to a centroid no
row of the cell is nearer than ``a`` less the cell's radius.

All queries are searched in one go.  First each visits the nearest cells that together hold as many rows as it wants, which tells an angle that its
results cannot exceed; then those further cells that can hold a row within that angle.  Neighbouring cells are put together in blocks of rows, and a cell with
many rows is split; a block meets all queries that visit some cell of it in one multiplication for each cell.  Of vectors spread evenly over many dimensions
all cells can hold a near row, so that all queries meet all rows: that is quadratic, in tasks of at most ``block`` rows and QUERIES queries.

Rows whose vector is null or has null or non-finite components are skipped, and so are rows of another length than the query's.  Zero vectors have cosine 0 with
everything; they lie in a cell that every query visits.  Ties go by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import stored

SAMPLE = 16_384
ROWS_A_CELL = 1000
MOST_CELLS = 1024
ROUNDS = 8
BLOCK = 8192
QUERIES = 16_384
#: Cosines that are in memory at once, rows that are placed or ask at once, and candidates that are multiplied again.
CELLS, STEP, AGAIN = 1 << 21, 1024, 1 << 16
FLAT = -1  # the cell of zero vectors
SLACK = 1e-6
ERROR = 1e-9  # of a product of matrices, with much to spare


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; zero vectors stay."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm != 0)


def cosines(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rounded, so that equal rows tie wherever they stand."""
    return np.round(np.clip(m @ q, -1, 1), 12)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its cosine, some rows at a time."""
    home, cosine = np.zeros(len(m), np.int64), np.zeros(len(m))
    for at in range(0, len(m), STEP):
        c = m[at : at + STEP] @ centroids.T
        home[at : at + STEP], cosine[at : at + STEP] = c.argmax(axis=1), c.max(axis=1)
    return home, cosine


def fit(m: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors; those that lose all rows keep their place."""
    found = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)].copy()
    for _ in range(ROUNDS):
        home = nearest(m, found)[0]
        sums = np.zeros_like(found)
        np.add.at(sums, home, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), found)
    return found


@dataclass
class VectorIndex:
    """``rows (k, v, dim, cell, angle)``, the centroids of each vector length, and ``(rows, radius)`` of each of its cells."""

    rows: DataFrame
    centroids: dict[int, np.ndarray]
    sizes: dict[int, dict[int, tuple[int, float]]]


def sound(vector: str) -> Column:
    """Whether a vector has components, all of them finite."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def build(df: DataFrame, key: str, vector: str, rows_a_cell: int = ROWS_A_CELL) -> VectorIndex:
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter(sound("v"))
    counts = {r.dim: r.n for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row for each vector length
    few = F.pmod(F.xxhash64("k", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1, SAMPLE / max(1, sum(counts.values()))))
    sample = rows.filter(few).limit(2 * SAMPLE).toPandas()
    centroids = {}
    for dim, n in counts.items():
        m = unit(sample["v"][sample["v"].map(len) == dim]) if (sample["v"].map(len) == dim).any() else np.zeros((0, dim))
        m = m[m.any(axis=1)]
        centroids[dim] = fit(m, min(MOST_CELLS, max(1, n // rows_a_cell))) if len(m) else np.eye(1, dim)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len)):
                m = unit(part["v"])
                home, cosine = nearest(m, centroids[dim])
                flat = ~m.any(axis=1)
                yield part.assign(dim=dim, cell=np.where(flat, FLAT, home), angle=np.where(flat, 0.0, np.arccos(np.clip(cosine, -1, 1))))

    kind = rows.schema["k"].dataType.simpleString()
    placed = rows.mapInPandas(place, f"k {kind}, v array<double>, dim int, cell int, angle double")
    table = stored(placed.repartitionByRange("dim", "cell", "angle", "k").sortWithinPartitions("dim", "cell", "angle"), "vectors")
    sizes: dict[int, dict[int, tuple[int, float]]] = {dim: {} for dim in counts}
    for r in table.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # at most MOST_CELLS + 1 rows for each length
        sizes[r.dim][r.cell] = (r.n, r.radius)
    return VectorIndex(table, centroids, sizes)


def _blocks(index: VectorIndex, block: int) -> dict[int, list[tuple[list[int], int, int]]]:
    """``(cells, first, parts)`` of each vector length: neighbouring cells with at most ``block`` rows together have number ``first``, a larger
    cell has ``parts`` numbers from there on."""
    out: dict[int, list[tuple[list[int], int, int]]] = {}
    number = 0
    for dim, cells in index.sizes.items():
        out[dim], held, rows = [], [], 0
        for cell in [*sorted(cells), None]:
            n = cells[cell][0] if cell is not None else block + 1
            if held and rows + n > block:
                parts = -(-rows // block)
                out[dim].append((held, number, parts))
                number, held, rows = number + parts, [], 0
            if cell is not None:
                held, rows = [*held, cell], rows + n
    return out


def _chosen(index: VectorIndex, dim: int, part: pd.DataFrame, cells: np.ndarray, first: bool) -> np.ndarray:
    """For each query whether it visits each of the cells; ``first``: those that fill ``top_k``, else those that hold rows within ``within`` and weren't among them."""
    k, sizes = part["top_k"].to_numpy()[:, None], index.sizes[dim]
    n, radius = np.array([sizes[c][0] for c in cells], np.int64), np.array([sizes[c][1] for c in cells])
    out = np.zeros((len(part), len(cells)), bool)
    flat = cells == FLAT
    if not flat.all():
        m = unit(part["q"])
        some = m.any(axis=1)[:, None]
        to = angles(m, index.centroids[dim][cells[~flat]])
        order = np.argsort(to, axis=1, kind="stable")
        n = n[~flat][order]
        early = np.zeros(to.shape, bool)
        np.put_along_axis(early, order, (n.cumsum(axis=1) - n < k) | (k < 0) | ~some, axis=1)  # a query of zeros is at cosine 0 with all
        least = np.maximum(0, to - radius[~flat] - SLACK) * some
        out[:, ~flat] = early if first else ~early & (least <= part["within"].to_numpy()[:, None]) & (k != 0)
    out[:, flat] = first
    return out


def _visits(index: VectorIndex, queries: DataFrame, first: bool, blocks: dict[int, list[tuple[list[int], int, int]]]) -> DataFrame:
    """``queries`` with a row for each block that has cells to visit, and those ``cells``."""
    sizes, centroids = index.sizes, index.centroids

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = VectorIndex(None, centroids, sizes)
        for frame in frames:
            for dim, whole in frame.groupby(frame["q"].map(len)):
                cells = np.array(sorted(sizes.get(dim, {})), np.int64)
                for part in (whole.iloc[at : at + STEP] for at in range(0, len(whole) if len(cells) else 0, STEP)):
                    chosen = _chosen(held, dim, part, cells, first)
                    for own, number, parts in blocks[dim]:
                        at = np.searchsorted(cells, own)
                        asks, which = np.nonzero(chosen[:, at])
                        if len(asks):
                            rows, starts = np.unique(asks, return_index=True)
                            ask = part.iloc[rows].assign(cells=np.fromiter((x.tolist() for x in np.split(cells[at][which], starts[1:])), object, len(rows)))
                            for i in range(parts):
                                yield ask.assign(block=number + i)

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "q", "top_k", "within", "turn").mapInPandas(choose, f"query_id {kind}, q array<double>, top_k int, within double, turn int, cells array<int>, block int")


def _nearest_in(m: np.ndarray, cell: np.ndarray, place: np.ndarray, q: np.ndarray, top_k: np.ndarray, within: np.ndarray, visited: list) -> tuple[np.ndarray, ...]:
    """``ask, row, cosine`` of the ``top_k`` nearest rows (below 0: all) of each query in the cells that it visits, and the number of rows that each was multiplied
    with.  Rows lie in order of their cells; ties go by ``place``."""
    low, looked = np.cos(np.minimum(within, np.pi)) - ERROR, np.zeros(len(q), np.int64)
    asks_of = np.repeat(np.arange(len(q)), [len(x) for x in visited])
    cells_of = np.concatenate([np.asarray(x, np.int64) for x in visited])

    def cut(ask: np.ndarray, row: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((place[row], -cosine, ask))
        ask = ask[order]
        order = order[kept := (top_k[ask] < 0) | (np.arange(len(ask)) - np.searchsorted(ask, ask) < top_k[ask])]
        return ask[kept], row[order], cosine[order]

    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    names, starts = np.unique(cell, return_index=True)
    for name, lo, hi in zip(names, starts, [*starts[1:], len(cell)], strict=True):
        asking = asks_of[cells_of == name]
        looked[asking] += hi - lo
        step = max(1, CELLS // (hi - lo))
        for at in (asking[x : x + step] for x in range(0, len(asking), step)):
            c = m[lo:hi] @ q[at].T
            near = c >= low[at]
            over = (top_k[at] >= 0) & (near.sum(axis=0) > top_k[at])
            for k in np.unique(top_k[at][over]):  # a query with more rows than it wants needs none below the last of them
                own = over & (top_k[at] == k)
                low[at[own]] = np.maximum(low[at[own]], np.partition(c[:, own], hi - lo - k, axis=0)[hi - lo - k] - ERROR if k else 2.0)
                near[:, own] = c[:, own] >= low[at[own]]
            rows, which = np.nonzero(near)
            ask, row = at[which], rows + lo
            # Summed row by row, equal rows have equal cosines wherever they stand.
            cosine = [(m[row[x : x + AGAIN]] * q[ask[x : x + AGAIN]]).sum(axis=1) for x in range(0, len(row), AGAIN)]
            found.append(cut(ask, row, np.round(np.clip(np.concatenate([np.zeros(0), *cosine]), -1, 1), 12)))
    return *cut(*(np.concatenate(x) for x in zip(*found, strict=True))), looked


def _hits(index: VectorIndex, queries: DataFrame, first: bool, block: int, turns: int) -> DataFrame:
    """``query_id, top_k, k, cosine, looked``: of each visited block the nearest ``top_k`` rows within the query's angle, and a row with the number of rows
    multiplied, ``looked``; -1 for hits."""
    blocks = _blocks(index, block)
    places = index.rows.sparkSession.createDataFrame([(dim, c, number, parts) for dim, own in blocks.items() for cells, number, parts in own for c in cells], "dim int, cell int, first int, parts int")
    number = F.col("first") + F.pmod(F.xxhash64("k", "v"), F.col("parts")).cast("int")
    rows = index.rows.join(F.broadcast(places), ["dim", "cell"]).select("k", "v", "cell", number.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    asks = _visits(index, queries, first, blocks)
    kinds = {"k": index.rows.schema["k"].dataType.simpleString(), "query_id": queries.schema["query_id"].dataType.simpleString()}
    names = ["query_id", "top_k", "k", "cosine", "looked"]

    def compare(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in names})
        held = held.sort_values("cell", kind="stable", ignore_index=True)
        keys, place = held["k"].to_numpy(), np.empty(len(held), np.int64)
        place[np.argsort(keys, kind="stable")] = np.arange(len(held))
        ids, top_k = asked["query_id"].to_numpy(), asked["top_k"].to_numpy()
        ask, row, cosine, looked = _nearest_in(unit(held["v"]), held["cell"].to_numpy(), place, unit(asked["q"]), top_k, asked["within"].to_numpy(), list(asked["cells"]))
        hits = pd.DataFrame({"query_id": ids[ask], "top_k": top_k[ask], "k": keys[row], "cosine": cosine, "looked": -1})
        read = pd.DataFrame({"query_id": ids, "top_k": top_k, "k": keys[:1].repeat(len(ids)), "cosine": np.nan, "looked": looked})
        return pd.concat([hits, read], ignore_index=True)

    # Few bytes and much work: the number of partitions is given, else small ones are put together.
    by, tasks = ["block", "turn"], 2 * turns * max(1, sum(parts for own in blocks.values() for _, _, parts in own))
    both = asks.repartition(tasks, *by).groupBy(*by).cogroup(rows.repartition(tasks, *by).groupBy(*by))
    return both.applyInPandas(compare, f"query_id {kinds['query_id']}, top_k int, k {kinds['k']}, cosine double, looked long")


def _nearest(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.col("k").asc())
    return hits.filter("looked < 0").withColumn("nth", F.row_number().over(order)).filter("top_k < 0 OR nth <= top_k")


def search(index: VectorIndex, queries: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``query_id, k, cosine, nth`` of the nearest rows of each query ``(query_id, q, top_k)``, and ``query_id, rows_read``.

    ``query_id`` is unique; a ``top_k`` of null or below 0 means all rows."""
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.greatest(F.coalesce(F.col("top_k").cast("int"), F.lit(-1)), F.lit(-1)).alias("top_k")).filter(sound("q"))
    asked = stored(asked.filter(F.size("q").isin(list(index.sizes) or [0])).withColumn("within", F.lit(np.pi)), "queries")
    turns = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
    one = stored(_hits(index, asked, True, block, turns), "first")
    full = _nearest(one).groupBy("query_id").agg(F.min("cosine").alias("_worst"), F.count("*").alias("_n"))
    known = asked.drop("within").join(full.withColumnRenamed("query_id", "_id"), F.col("query_id") == F.col("_id"), "left")
    within = F.when(F.col("_n") >= F.col("top_k"), F.acos("_worst") + SLACK).otherwise(np.pi)
    again = stored(_hits(index, known.select("query_id", "q", "top_k", within.alias("within"), "turn"), False, block, turns), "second")
    both = one.unionByName(again)
    read = both.groupBy("query_id").agg(F.sum(F.greatest("looked", F.lit(0))).alias("rows_read"))
    return _nearest(both).select("query_id", "k", "cosine", F.col("nth").cast("int").alias("nth")), read
