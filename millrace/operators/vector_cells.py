"""Near vectors by pivot cells: exact for any threshold, pruned by the triangle inequality of angles.

1. A bounded sample gives pivots, none of them within the threshold of another.
2. Each vector is at home with its nearest pivot.  It visits another pivot's cell only where a vector at home there
   can be within the threshold's angle of it: where that pivot is at most twice the angle farther than its own.
3. Of two cells one hosts the pairs across them, so that each pair is compared once.  The homes and the probes of a cell
   are dealt into blocks, and each block of homes meets each block of probes in a task of its own.
4. Where blocks meet, most pairs are settled by a few components: along the leading axes of the sample a pair's dot product is multiplied out, and the rest is
   at most the product of what the two vectors have left beside them.  Only pairs whose bound reaches the threshold are multiplied in full.  How many axes
   pay, or none, is estimated on the sample.
5. For components, a vector within the threshold of its pivot is linked with it at once and with others of that kind
   through it; only the rest are compared, so that a dense group costs what its rows do.

Where vectors are spread evenly over many dimensions all cells are visited, and step 4 looks at all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import stored

LEAST_PIVOTS, MOST_PIVOTS, TRIES = 16, 1024, 4
BLOCK, ROWS, BATCH = 4096, 256, 2048
SLACK = 1e-6
#: Rows that axes are fitted on; a full product of single pairs takes FULL_COST times its share of a product of blocks; axes must save a fifth.
AXES_SAMPLE, FULL_COST, NO_GAIN = 1024, 8, 0.8


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; zero vectors stay, and what isn't finite becomes NaN, which is near nothing."""
    m = np.stack(vectors.to_numpy())
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        return np.divide(m, norm, out=np.zeros_like(m), where=norm != 0)


def leading(m: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The components of rows along the axes, and the length of what is left: the dot product of two such rows bounds that of the whole ones."""
    head = m @ axes
    rest = np.einsum("ij,ij->i", m, m) - np.einsum("ij,ij->i", head, head)
    return np.hstack([head, np.sqrt(np.maximum(rest, 0))[:, None]])


def axes_for(m: np.ndarray, threshold: float) -> np.ndarray | None:
    """As many principal axes of sampled rows as cost least: the share of a dot product that they are, and what the pairs that they leave open take in full."""
    dim = m.shape[1]
    if len(m) < 8 or dim < 8:
        return None
    m = m[:AXES_SAMPLE]
    axes = np.linalg.eigh(m.T @ m)[1][:, ::-1]
    best, found = NO_GAIN, None
    for h in sorted({max(2, dim // 8), dim // 4, dim // 2, 3 * dim // 4}):
        g = leading(m, axes[:, :h])
        open_share = ((g @ g.T >= threshold - SLACK).sum() - len(m)) / max(1, len(m) * (len(m) - 1))
        cost = (h + 1) / dim + FULL_COST * open_share
        if cost < best:
            best, found = cost, axes[:, :h].copy()
    return found


def pivots_of(rows: DataFrame, threshold: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Keys and unit vectors of the pivots, and the leading axes, by vector length.

    One pivot for each BLOCK rows, so that where nothing is pruned a row is sent about as often as when all blocks meet; MOST_PIVOTS bounds them."""
    most = min(MOST_PIVOTS, max(LEAST_PIVOTS, rows.count() // BLOCK))
    sample = rows.select("k", "v").orderBy(F.xxhash64("k", "v")).limit(max(AXES_SAMPLE, TRIES * most)).toPandas()
    found = {}
    for dim, part in sample.groupby(sample["v"].map(len)):
        m, keys, kept = _unit(part["v"]), part["k"].to_numpy(), []
        sound = np.flatnonzero(np.isfinite(m).all(axis=1) & (m != 0).any(axis=1))
        for r in sound[: TRIES * most]:
            if len(kept) < most and (not kept or (m[kept] @ m[r]).max() < threshold):
                kept.append(r)
        if kept:
            found[int(dim)] = (keys[kept], m[kept], axes_for(m[sound], threshold))
    return found


def placed(rows: DataFrame, threshold: float, found: dict | None = None) -> DataFrame:
    """``rows (k, v)`` with ``dim``, ``home``, the ``pivot``'s key where it is within the threshold, and ``visits``.

    Written once, so that all that follows sees the same cells."""
    found = pivots_of(rows, threshold) if found is None else found
    reach = 2 * math.acos(min(1.0, max(-1.0, threshold))) + SLACK

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths = frame["v"].map(len)
            for at in range(0, len(frame), BATCH):
                for dim, part in frame.iloc[at : at + BATCH].groupby(lengths.iloc[at : at + BATCH]):
                    if dim not in found:
                        yield part.assign(dim=dim, home=0, pivot=None, visits=[[]] * len(part))
                        continue
                    keys, m, _ = found[dim]
                    cosine = np.nan_to_num(_unit(part["v"]) @ m.T)
                    home, row = cosine.argmax(axis=1), np.arange(len(part))
                    angle = np.arccos(np.clip(cosine, -1, 1))
                    cells = np.arange(len(keys))
                    hosts = ((home[:, None] + cells) % 2 == 0) == (cells < home[:, None])
                    visited = (angle <= angle[row, home][:, None] + reach) & hosts & (cells != home[:, None])
                    pivot = pd.Series(keys[home], index=part.index, dtype=object).where(cosine[row, home] >= threshold, None)
                    yield part.assign(dim=dim, home=home, pivot=pivot, visits=[np.flatnonzero(v) for v in visited])

    kind = rows.schema["k"].dataType.simpleString()
    return stored(rows.select("k", "v").mapInPandas(place, f"k {kind}, v array<double>, dim int, home int, pivot {kind}, visits array<int>"), "cells")


def _meetings(cells: DataFrame, probing: Column, block: int) -> DataFrame:
    """``k, v, home, cell, is_home``, dealt to the block pairs of each cell; homes that are ``probing`` meet the others at home there."""
    role = lambda cell, is_home: F.struct(cell.alias("cell"), F.lit(is_home).alias("is_home"))
    own = F.filter(F.array(role(F.col("home"), False)), lambda r: probing)
    roles = F.concat(F.array(role(F.col("home"), True)), own, F.transform("visits", lambda c: role(c, False)))
    rows = cells.withColumn("_role", F.explode(roles)).select("k", "v", "dim", "home", "_role.*")
    blocks = lambda side: F.ceil(F.count_if(side) / block)
    sizes = rows.groupBy("dim", "cell").agg(blocks(F.col("is_home")).alias("_homes"), blocks(~F.col("is_home")).alias("_probes")).filter("_homes > 0 AND _probes > 0")
    rows = rows.join(sizes, ["dim", "cell"])
    mine, others = F.when(F.col("is_home"), F.col("_homes")).otherwise(F.col("_probes")), F.when(F.col("is_home"), F.col("_probes")).otherwise(F.col("_homes"))
    rows = rows.withColumn("_mine", F.pmod(F.xxhash64("k", "v"), mine)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    return rows.select("k", "v", "dim", "home", "cell", "is_home", F.when(F.col("is_home"), F.col("_mine")).otherwise(F.col("_other")).alias("_h"), F.when(F.col("is_home"), F.col("_other")).otherwise(F.col("_mine")).alias("_p"))


def _near(pdf: pd.DataFrame, threshold: float, axes: dict[int, np.ndarray | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of near probes and homes in ``pdf``, and their cosines, some probes at a time."""
    is_home = pdf["is_home"].to_numpy()
    x, y = np.flatnonzero(~is_home), np.flatnonzero(is_home)
    if not len(x) or not len(y):
        return
    m = _unit(pdf["v"])
    few = axes.get(m.shape[1])
    yield from near_rows(m, x, y, threshold, few)


def near_rows(m: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, axes: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``i`` of ``x`` and ``j`` of ``y`` with a cosine at or above the threshold, and the cosine."""
    homes = m[y].T
    short = None if axes is None else leading(m, axes)
    bounds = None if short is None else short[y].T
    for at in range(0, len(x), ROWS):
        probes = x[at : at + ROWS]
        if bounds is not None:
            i, j = np.nonzero(short[probes] @ bounds >= threshold - SLACK)
            if len(i) * FULL_COST < len(probes) * len(y):
                cosine = np.clip(np.einsum("ij,ij->i", m[probes[i]], m[y[j]]), -1, 1)
                near = cosine >= threshold
                yield probes[i[near]], y[j[near]], cosine[near]
                continue
        cosine = np.clip(m[probes] @ homes, -1, 1)
        i, j = np.nonzero(cosine >= threshold)
        yield probes[i], y[j], cosine[i, j]


def near_pairs(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b, cosine``: all pairs of different keys (a < b) of ``rows (k, v)`` at or above the threshold."""
    kind = rows.schema["k"].dataType.simpleString()
    fitted = pivots_of(rows, threshold)
    axes = {dim: few for dim, (_, _, few) in fitted.items()}

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, visits = pdf["k"].to_numpy(), (pdf["home"] != pdf["cell"]).to_numpy()
        found = [pd.DataFrame({"a": keys[:0], "b": keys[:0], "cosine": np.zeros(0)})]
        for x, y, cosine in _near(pdf, threshold, axes):
            a, b = keys[x], keys[y]
            keep = np.where(visits[x], a != b, a < b).astype(bool)
            found.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": cosine[keep]}))
        return pd.concat(found)

    return _meetings(placed(rows, threshold, fitted), F.lit(True), block).groupBy("dim", "cell", "_h", "_p").applyInPandas(compare, f"a {kind}, b {kind}, cosine double")


def _united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` after linking each i with its j: the least position reachable."""
    while True:
        low = root.copy()
        np.minimum.at(low, root[i], root[j])
        np.minimum.at(low, root[j], root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_links(nodes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``src, dst``: links that connect what pairs at or above the threshold connect, no more of them than rows that meet.

    ``nodes (k, v)`` are different vectors."""
    kind = nodes.schema["k"].dataType.simpleString()
    fitted = pivots_of(nodes, threshold)
    axes = {dim: few for dim, (_, _, few) in fitted.items()}

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, root = pdf["k"].to_numpy(), np.arange(len(pdf))
        for x, y, _ in _near(pdf, threshold, axes):
            root = _united(root, x, y)
        some = np.flatnonzero(keys != keys[root])
        return pd.DataFrame({"src": keys[some], "dst": keys[root[some]]})

    cells = placed(nodes, threshold, fitted)
    met = _meetings(cells, F.col("pivot").isNull(), block).groupBy("dim", "cell", "_h", "_p").applyInPandas(link, f"src {kind}, dst {kind}")
    return met.unionByName(cells.filter("pivot IS NOT NULL AND pivot <> k").select(F.col("k").alias("src"), F.col("pivot").alias("dst")))
