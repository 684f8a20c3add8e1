"""Ranked lexical search by k2-treaps over grids of terms and documents.

Documents are dealt in shards as they are read, and each shard becomes one k2-treap (k = 2): a square grid with a row for each term of the shard, by
falling frequency, and a column for each document.  A cell holds the impact of the term in the document.  The grid is cut in four again and again;
a node has a mask of four bits that tells which quarters hold cells, and the greatest impact below it.  Nodes are stored level by level, so that a
node's children follow from the number of bits set before its own, and need no pointers.  Maxima are stored as what they lack to their parents',
mostly zeros.

1. One job counts the documents with terms and all terms, which impacts depend on.
2. One job builds the shards and writes them as a table: the index.  It holds every term of every document.
3. Items are worked off in blocks of BLOCK_ITEMS, in order of a global rank, whose terms go to the tasks.  The frequencies of their terms are summed up
   from the index, of which this job reads the columns ``terms`` and ``frequencies`` only.
4. In each shard an item's rows descend jointly: a range of documents has for each row the node in which the range lies, and its bound is the sum of
   the nodes' maxima times the terms' weights.  The ranges with the highest bounds are halved first, WIDTH at a time; at single documents the bound
   is the score.  It ends when no bound reaches the score of the item's last place.  PROBES shards are searched first; the score of the last
   place there is the least that the documents of the other shards must have.

Bounds are sums of exact integers, so results are exact; no document or term is left out.

Defined cases: a null text has no terms; documents without terms aren't counted in N and never found; null doc_ids come last among equal scores;
repeated documents are ranked each for itself, those with equal doc_id in any order; repeated items and null item_ids are items of their own; an item
without terms, or whose terms no document holds, gives no rows; empty tables give no rows; very long texts are one column, their words taken piece by piece,
and a shard ends at SHARD_CELLS cells, but holds one document at least; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.words import as_bytes, batches_of, word_pieces
from millrace.operators.ranking import with_global_rank
from millrace.session import stored, table

MOST = 50  # places of an item
SHARD_DOCS = 2048
SHARD_CELLS = 700_000
BLOCK_ITEMS = 1000
PROBES = 4
#: Ranges of documents that are halved at a time.
WIDTH = 192

_BITS = np.array([bin(i).count("1") for i in range(16)], np.uint8)
INDEX = "shard long, doc_ids array<long>, terms binary, frequencies binary, depth int, sizes array<long>, masks binary, lacks binary"


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of a term that occurs tf times in a document of n terms."""
    m = 50 + (50 * n * n_docs) // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def term_weight(n_docs: int, df: int) -> int:
    return int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))


# ---- the grid ----


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x at even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def grid(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Masks of the levels above the cells, and maxima of all levels, from the root down."""
    codes = (_spread(rows) << np.uint64(1)) | _spread(cols)
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order].astype(np.uint32)
    masks, maxima = [], [values]
    for _ in range(depth):
        parent = codes >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        bits = np.left_shift(1, (codes & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        masks.append(np.bitwise_or.reduceat(bits, first))
        values = np.maximum.reduceat(values, first)
        maxima.append(values)
        codes = parent[first]
    return masks[::-1], maxima[::-1]


def lacking(masks: list[np.ndarray], maxima: list[np.ndarray]) -> np.ndarray:
    """Maxima of all levels, below the root as what they lack to the maximum of their parent."""
    return np.concatenate([maxima[0], *[np.repeat(up, _BITS[mask]) - down for mask, up, down in zip(masks, maxima[:-1], maxima[1:], strict=True)]])


def packed(data) -> bytes:
    """Compressed here, so that Spark never holds a treap in full size."""
    return zstandard.ZstdCompressor(level=1).compress(memoryview(data).cast("B"))


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Shard:
    """A k2-treap read back: all levels in one array, each node with the place of its first child."""

    def __init__(self, row: dict, wanted: set[bytes]) -> None:
        self.doc_ids, self.depth, sizes = row["doc_ids"], row["depth"], np.array(row["sizes"], np.int64)
        self.rows = {t: i for i, t in enumerate(unpacked(row["terms"]).split(b" ")) if t in wanted}
        self.masks, self.maxima = np.frombuffer(unpacked(row["masks"]), np.uint8), np.frombuffer(unpacked(row["lacks"]), np.uint32).copy()
        bits = _BITS[self.masks]
        at = 0
        for n, below in zip(sizes, sizes[1:], strict=False):
            end = at + n + below
            self.maxima[at + n : end] = np.repeat(self.maxima[at : at + n], bits[at : at + n]) - self.maxima[at + n : end]
            at += n
        # Levels follow each other and a level's nodes stand in the order of their parents: all children stand in order of all parents.
        self.child = (np.cumsum(bits, dtype=np.int64) - bits + 1).astype(np.int32)
        self.col_bits = max(1, int(len(self.doc_ids) - 1).bit_length())

    def step(self, nodes: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """The children of nodes in the given quarters; -1 where there is none."""
        at = np.maximum(nodes, 0)
        mask = self.masks[at]
        has = (nodes >= 0) & ((mask >> quarter) & 1 > 0)
        return np.where(has, self.child[at] + _BITS[mask & ((1 << quarter) - 1)], -1)

    def search(self, terms: list[tuple[bytes, int]], most: int, floor: int) -> list[tuple[int, int]]:
        """(score, column) of the ``most`` best documents whose score is ``floor`` at least, and of more where scores tie."""
        held = [(self.rows[t], w) for t, w in terms if t in self.rows and w > 0]
        if not held:
            return []
        rows, weights = np.array([r for r, _ in held], np.int64), np.array([w for _, w in held], np.int64)
        nodes = np.zeros((1, len(rows)), np.int32)
        level = 0
        while self.depth - level > self.col_bits:  # all documents lie left
            nodes = self.step(nodes, (((rows >> (self.depth - 1 - level)) & 1) << 1)[None, :].astype(np.uint8))
            level += 1
        bound = self._bounds(nodes, weights)
        ranges = [(np.array([level]), np.zeros(1, np.int64), nodes, bound)]  # depth, column prefix, nodes, bounds
        found: list[np.ndarray] = []
        floor = max(floor, 1)
        while ranges:
            depth, prefix, nodes, bound = (np.concatenate(x) for x in zip(*ranges, strict=True)) if len(ranges) > 1 else ranges[0]
            live = bound >= floor
            if not live.all():
                depth, prefix, nodes, bound = depth[live], prefix[live], nodes[live], bound[live]
            if not len(bound):
                break
            if len(bound) > WIDTH:
                order = np.argpartition(-bound, WIDTH)
                now, later = order[:WIDTH], order[WIDTH:]
                ranges = [(depth[later], prefix[later], nodes[later], bound[later])]
                depth, prefix, nodes = depth[now], prefix[now], nodes[now]
            else:
                ranges = []
            half = (((rows[None, :] >> (self.depth - 1 - depth)[:, None]) & 1) << 1).astype(np.uint8)
            depth = np.concatenate([depth, depth]) + 1
            prefix = np.concatenate([2 * prefix, 2 * prefix + 1])
            nodes = np.concatenate([self.step(nodes, half), self.step(nodes, half + np.uint8(1))])
            bound = self._bounds(nodes, weights)
            cell = depth == self.depth
            live = bound >= floor
            if (hit := cell & live).any():
                found.append(np.stack([bound[hit], prefix[hit]], axis=1))
                scores = np.concatenate([f[:, 0] for f in found])
                if len(scores) >= most:
                    floor = max(floor, int(np.partition(scores, len(scores) - most)[len(scores) - most]))
            if (open_ := live & ~cell).any():
                ranges.append((depth[open_], prefix[open_], nodes[open_], bound[open_]))
        every = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return [(int(s), int(c)) for s, c in every[every[:, 0] >= floor]]

    def _bounds(self, nodes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (np.where(nodes >= 0, self.maxima[np.maximum(nodes, 0)].astype(np.int64), 0) * weights[None, :]).sum(axis=1)

    def best(self, terms: list[tuple[bytes, int]], most: int, floor: int) -> list[tuple[int, int | None]]:
        found = [(s, self.doc_ids[c]) for s, c in self.search(terms, most, floor)]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        return found[:most]


# ---- the index ----


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""

    def count(frames):
        n, terms = 0, 0
        for batch in frames:
            for _, texts in batches_of(batch.column("text")):
                for text in texts:
                    k = sum(map(len, word_pieces(text)))
                    n, terms = n + (k > 0), terms + k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([terms], pa.int64())], ["n", "terms"])

    n, terms = docs.select("text").mapInArrow(count, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return n or 0, terms or 0


class _Builder:
    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.doc_ids: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.n: list[int] = []
        self.cells = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts: Counter[bytes] = Counter()
        for words in word_pieces(text):
            counts.update(words)
        if not counts:
            return
        number = self.number
        self.terms.append(np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int64, len(counts)))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        self.tf.append(tf)
        self.n.append(int(tf.sum()))
        self.doc_ids.append(doc_id)
        self.cells += len(counts)

    def row(self, shard: int, n_docs: int, n_terms: int) -> dict:
        sizes = [len(t) for t in self.terms]
        terms, tf = np.concatenate(self.terms), np.concatenate(self.tf)
        cols = np.repeat(np.arange(len(sizes)), sizes)
        df = np.bincount(terms, minlength=len(self.number))
        order = np.argsort(-df, kind="stable")  # frequent terms side by side, so that their cells share nodes
        row_of = np.empty(len(order), np.int64)
        row_of[order] = np.arange(len(order))
        depth = max(1, (len(order) - 1).bit_length(), (len(sizes) - 1).bit_length())
        masks, maxima = grid(row_of[terms], cols, impact(tf, np.repeat(np.array(self.n, np.int64), sizes), n_docs, n_terms), depth)
        names = list(self.number)
        return {
            "shard": shard, "doc_ids": self.doc_ids, "terms": packed(b" ".join(names[i] for i in order)), "frequencies": packed(df[order].astype(np.uint32)),
            "depth": depth, "sizes": [len(m) for m in maxima], "masks": packed(np.concatenate(masks)), "lacks": packed(lacking(masks, maxima)),
        }


def _schema() -> pa.Schema:
    longs, raw = pa.list_(pa.int64()), pa.binary()
    return pa.schema([("shard", pa.int64()), ("doc_ids", longs), ("terms", raw), ("frequencies", raw), ("depth", pa.int32()), ("sizes", longs), ("masks", raw), ("lacks", raw)])


def build(docs: DataFrame, n_docs: int, n_terms: int, shard_docs: int = SHARD_DOCS, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """The index of ``docs (doc_id, text)``, one row for each shard, written to the shared folder."""

    def shards(frames):
        from pyspark import TaskContext

        part, made, b = TaskContext.get().partitionId() << 32, 0, _Builder()
        for batch in frames:
            ids = batch.column("doc_id").to_pylist()
            for row, texts in batches_of(batch.column("text")):
                for k, text in enumerate(texts):
                    b.add(ids[row + k], text)
                    if len(b.doc_ids) >= shard_docs or b.cells >= shard_cells:
                        yield pa.RecordBatch.from_pylist([b.row(part + made, n_docs, n_terms)], _schema())
                        made, b = made + 1, _Builder()
        if b.doc_ids:
            yield pa.RecordBatch.from_pylist([b.row(part + made, n_docs, n_terms)], _schema())

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(shards, INDEX), "treaps")


# ---- search ----


def frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the wanted terms stands; terms of no document are left out."""

    def look(frames):
        for batch in frames:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("frequencies").to_pylist(), strict=True):
                df = np.frombuffer(unpacked(counts), np.uint32)
                hits = [(t, int(df[i])) for i, t in enumerate(unpacked(terms).split(b" ")) if t in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in hits], pa.binary()), pa.array([n for _, n in hits], pa.int64())], ["term", "df"])

    rows = index.select("terms", "frequencies").mapInArrow(look, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # at most the wanted terms
    return {bytes(r.term): r.df for r in rows}


def _search(index: DataFrame, items: list[tuple[int, list[tuple[bytes, int]], int]], wanted: set[bytes], most: int) -> DataFrame:
    """``item, doc_id, score``: each shard's best documents of each ``(item, terms with weights, least score)``."""

    def find(frames):
        for batch in frames:
            for k in range(batch.num_rows):
                shard = Shard(batch.slice(k, 1).to_pylist()[0], wanted)
                hits = [(item, d, s) for item, terms, floor in items for s, d in shard.best(terms, most, floor)]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in range(3)], ["item", "doc_id", "score"])

    return index.mapInArrow(find, "item long, doc_id long, score long")


def _top(hits: DataFrame, most: int) -> DataFrame:
    """Spark keeps ``most`` rows of an item in each task before they are shuffled."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def search(index: DataFrame, n_docs: int, items: DataFrame, most: int = MOST, block_items: int = BLOCK_ITEMS, probes: int = PROBES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``most`` best documents of each row of ``items (item_id, text)``."""
    spark = index.sparkSession
    ranked = stored(with_global_rank(items.select("item_id", "text"), [F.col("item_id").asc_nulls_last(), F.col("text").asc()], "item"), "items")
    n_items = ranked.count()
    first = [r.shard for r in index.select("shard").orderBy("shard").limit(probes).collect()]
    probe, rest = index.filter(F.col("shard").isin(first)), index.filter(~F.col("shard").isin(first))
    blocks = []
    for low in range(0, n_items, block_items):
        block = ranked.filter(F.col("item").between(low, low + block_items - 1)).select("item", "text").toArrow()  # at most block_items rows
        terms = [set().union(*word_pieces(t)) for t in as_bytes(block.column("text").combine_chunks())]
        df = frequencies(index, set().union(*terms))
        queries = [(i, sorted((t, term_weight(n_docs, df[t])) for t in ts if t in df), 1) for i, ts in zip(block.column("item").to_pylist(), terms, strict=True)]
        wanted = {t for _, ts, _ in queries for t, _ in ts}
        hits = stored(_top(_search(probe, queries, wanted, most), most), "probed")
        least = {r.item: r.score for r in hits.filter(F.col("rank") == most).select("item", "score").collect()}  # at most one for each item
        queries = [(i, ts, least.get(i, 1)) for i, ts, _ in queries]
        both = hits.drop("rank").unionByName(_search(rest, queries, wanted, most))
        blocks.append(stored(_top(both, most), "hits"))
    if not blocks:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = reduce(DataFrame.unionByName, blocks)
    return found.join(ranked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs, n_terms = totals(docs)
    return search(build(docs, n_docs, n_terms), n_docs, table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH x AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM x),
c AS MATERIALIZED (SELECT side, id, term, count(*)::BIGINT AS tf FROM w GROUP BY ALL),
d AS (SELECT id, sum(tf)::BIGINT AS n FROM c WHERE side = 0 GROUP BY id),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
f AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM a) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM c WHERE side = 0 GROUP BY term),
m AS (SELECT id, 100 - 50 + (50 * n * (SELECT docs FROM a)) // (SELECT terms FROM a) AS m FROM d),
s AS (SELECT q.id AS item_id, c.id AS doc_id, sum(f.weight * ((1000000000 * c.tf) // (1000 * c.tf + 20 * m.m)))::BIGINT AS score
      FROM c AS q JOIN c ON q.side = 1 AND c.side = 0 AND c.term = q.term JOIN f ON f.term = c.term JOIN m ON m.id = c.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
