"""Importance resampling of a corpus towards a target distribution.

Features are all runs of one to RUNS consecutive words, hashed into BUCKETS buckets by their CRC-32.  The corpus and the target are counted by
bucket, and a bucket's gain is the scaled logarithm of the ratio of its two smoothed frequencies.  A document's weight is the sum of the gains
of its features, looked up in an array; a Gumbel noise from a hash of doc_id is added, and the highest scores are drawn, which samples
without replacement by the weights.

1. Each task counts its rows into one array of BUCKETS numbers, whatever it reads; Spark sums these by bucket.
2. With the gains (BUCKETS numbers) every document is scored where it is read, and the scores are written as a table.
3. The cutoff is found by bisection over the table: each job counts exactly how many candidates lie above some thresholds inside the interval that
   is left, first over the scores, then, among the scores that tie there, over doc_id.  No row leaves the executors.
4. Rows beyond the cutoff are range-partitioned and numbered.  Nothing is sorted or gathered but what is drawn.

The checksum of a run of words follows from those of its words: appending n bytes to a text maps its CRC linearly, by a table for n.
So each distinct word is hashed once in a task, and runs are combined by numpy.

Defined cases: a null text has no words, weight 0 and no features, and isn't a candidate where ``least_words`` is 1 or more; a null doc_id counts as
the empty string in the hash and comes last among ties; of rows with equal scores and doc_id those with the lesser text hash are drawn first, and
rows that are equal in that too are drawn singly, any of them; repeated rows are separate documents that score alike; very long texts are worked off
in pieces, a run across a seam counted once; an empty corpus gives no rows, and an empty target gives gains all the same; further columns are
ignored by ``scored`` and kept by ``resampled``.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.words import batches_of, word_pieces
from millrace.operators.ranking import with_global_rank
from millrace.session import stored, table

BUCKETS = 10_000
RUNS = 3
SHARE = 5  # percent of the candidates
LEAST_WORDS = 20
SEED = 42
#: Distinct words that a task remembers before it starts anew.
MOST_WORDS = 1 << 19
#: Thresholds counted by one job of the bisection.
THRESHOLDS = 15


# ---- CRC-32 of runs ----


def _append_zero(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(8)) ^ _CRC[crc & np.uint32(255)]


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & np.uint32(1), (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    return crc


_CRC = _crc_table()
_SHORT = 64
_UNITS = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])


def _tables() -> np.ndarray:
    """[n][k][b]: what byte k of a CRC, if it is b, becomes once n bytes follow."""
    out = [_UNITS]
    for _ in range(_SHORT - 1):
        out.append(_append_zero(out[-1]))
    return np.stack(out)


_AFTER = _tables().reshape(-1)


def _apply(flat: np.ndarray, base, crc: np.ndarray) -> np.ndarray:
    out = flat[base + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ flat[base + (256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64))]
    return out


def followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that a text with this CRC has in the CRC of itself and ``n`` further bytes."""
    out = _apply(_AFTER, np.minimum(n, _SHORT - 1) * 1024, crc)
    long = np.flatnonzero(n >= _SHORT)
    if len(long):
        value, left, double = crc[long], n[long], _append_zero(_UNITS)
        while left.any():
            value = np.where(left & 1, _apply(double.reshape(-1), 0, value), value)
            left = left >> 1
            double = _apply(double.reshape(-1), 0, double.reshape(-1)).reshape(4, 256)
        out[long] = value
    return out


class _Words(dict):
    """A number for each word; beside it the CRC of the word, of a space and the word, and the latter's length."""

    def __init__(self) -> None:
        super().__init__()
        self.first, self.next, self.length = array("I"), array("I"), array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.first)
        self.first.append(zlib.crc32(word))
        self.next.append(zlib.crc32(b" " + word))
        self.length.append(len(word) + 1)
        return n


def _segments(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], int]]:
    """(row, words, how many of them only lead in) of each text or piece of one."""
    for row, text in enumerate(texts):
        lead: list[bytes] = []
        for words in word_pieces(text):
            words = lead + words
            yield row, words, len(lead)
            lead = words[-(RUNS - 1) :]


def features(texts: list[bytes], memo: _Words, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Rows of the segments; for runs of 1 to RUNS words the buckets at each word and the segments' first and end there; words of each row."""
    rows, skip, sizes, ids = [], [], [], array("q")
    for row, words, lead in _segments(texts):
        rows.append(row)
        skip.append(lead)
        sizes.append(len(words))
        ids.extend(map(memo.__getitem__, words))
    rows, skip, sizes = (np.array(x, np.int64) for x in (rows, skip, sizes))
    ids = np.frombuffer(ids, np.int64) if len(ids) else np.zeros(0, np.int64)
    end = np.cumsum(sizes)
    start = end - sizes
    n_words = np.zeros(len(texts), np.int64)
    np.add.at(n_words, rows, sizes - skip)
    first, follow, length = (np.array(x) for x in (memo.first, memo.next, memo.length))
    out, crc = [], first.astype(np.uint32)[ids] if len(ids) else np.zeros(0, np.uint32)
    for k in range(RUNS):
        if k:
            new = ids[k:]
            crc = followed(crc[: len(new)], length[new]) ^ follow[new].astype(np.uint32) if len(new) else np.zeros(0, np.uint32)
        low = np.minimum(start + np.maximum(skip - k, 0), len(crc))
        out.append(((crc % np.uint32(buckets)).astype(np.int64), low, np.clip(end - k, low, None).clip(max=len(crc)).clip(min=low)))
    return rows, out, n_words


def _slices(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], _Words]]:
    memo = _Words()
    for batch in frames:
        for row, texts in batches_of(batch.column("text")):
            if len(memo) > MOST_WORDS:
                memo = _Words()
            yield batch.slice(row, len(texts)), texts, memo


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: the features of ``df (text)`` in each bucket that has any."""

    def count(frames):
        total = np.zeros(buckets, np.int64)
        for _, texts, memo in _slices(frames):
            for codes, low, end in features(texts, memo, buckets)[1]:
                inside = np.zeros(len(codes) + 1, np.int32)
                np.add.at(inside, low, 1)
                np.add.at(inside, end, -1)
                total += np.bincount(codes[np.cumsum(inside)[:-1] > 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return df.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight, from the ``bucket_counts`` of both: ``buckets`` numbers."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()  # at most one row for each bucket
    s, t = np.zeros(buckets), np.zeros(buckets)
    for out, name in ((s, "s"), (t, "t")):
        out[rows.column("bucket").to_numpy()] = rows.column(name).to_numpy()
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, key: Column | None = None) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, text_hash`` (and ``key``, a long, if given) of every row of ``docs (doc_id, text)``."""
    extra = [] if key is None else ["key"]

    def score(frames):
        for part, texts, memo in _slices(frames):
            rows, runs, n_words = features(texts, memo, len(gain))
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for codes, low, end in runs:
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[codes])])
                np.add.at(weight, rows, sums[end] - sums[low])
                np.add.at(n, rows, end - low)
            kept = [part.column(c) for c in ("doc_id", "text_hash", *extra)]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (n_words, n, weight))], ["doc_id", "text_hash", *extra, "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), *[key.alias("key") for _ in extra])
    out = rows.mapInArrow(score, f"doc_id {kind}, text_hash long{', key long' * len(extra)}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return out.withColumn("score", F.col("weight") + noise)


# ---- the draw ----


def cutoff(rows: DataFrame, value: str, k: int, highest: bool, thresholds: int = THRESHOLDS) -> int | None:
    """The k-th highest (or least) of an integer column of a written table, k from 1; null if it has fewer values.

    Each job counts the rows at or beyond some thresholds inside the interval that is left, which shrinks ``thresholds + 1`` times."""
    column = F.col(value) if highest else -F.col(value)
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not 1 <= k <= n:
        return None
    while low < high:  # at least k values are >= low, fewer than k are > high
        marks = sorted({low + (high - low) * (i + 1) // (thresholds + 1) for i in range(thresholds)} - {low} | {high})
        counts = rows.agg(*[F.count_if(column >= m) for m in marks]).first()
        above = [m for m, c in zip(marks, counts, strict=True) if c >= k]
        under = [m for m, c in zip(marks, counts, strict=True) if c < k]
        low, high = max([low, *above]), min([high, *[m - 1 for m in under]])
    return low if highest else -low


def with_rank(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` (1, 2, ... by falling score, then doc_id) to the rows drawn of a written table; null for the others."""
    candidate = F.col("n_words") >= least_words
    candidates = rows.filter(candidate)
    k = share * candidates.count() // 100
    score = cutoff(candidates, "score", k, highest=True)
    if score is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    over = candidates.filter(F.col("score") > score).count()
    tied = candidates.filter(F.col("score") == score)
    last = cutoff(tied, "doc_id", k - over, highest=False)  # null: rows without doc_id are needed too
    within = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(False))
    taken = candidate & ((F.col("score") > score) | ((F.col("score") == score) & within))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    ranked = with_global_rank(rows.filter(taken), order).withColumn("rank", F.when(F.col("rank") < k, (F.col("rank") + 1).cast("long")))
    rest = rows.filter(~taken).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, key: Column | None = None) -> DataFrame:
    """Scores of every row of ``docs (doc_id, text)`` with the ``rank`` of those drawn towards ``target (text)``."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    return with_rank(stored(scored(docs, gain, seed, key), "scores"), share, least_words)


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns.  Of rows that are equal in all columns as many come as were drawn."""
    cols = docs.columns
    key = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    ranked = drawn(docs, target, key=key, **how)
    taken = ranked.filter(F.col("rank").isNotNull()).groupBy(F.col("key").alias("_key"), F.col("doc_id").alias("_doc")).agg(F.count("*").alias("_n"))
    # The rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("doc_id").alias("id"), key.alias("key"))
    first = rows.groupBy("key", "id").agg(F.first("row").alias("row"))
    out = first.join(taken, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_doc")))
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("row.*")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drawn(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH RECURSIVE tbl(i, c, k) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM tbl WHERE k < 8
), t AS MATERIALIZED (SELECT list(c ORDER BY i) AS l FROM tbl WHERE k = 8),
x AS (SELECT 0 AS side, doc_id AS id, coalesce(doc_id::VARCHAR, '') AS name, text FROM documents UNION ALL SELECT 1, item_id, '', text FROM benchmark),
w AS MATERIALIZED (SELECT side, id, name, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM x),
f AS (SELECT side, id, unnest(list_concat(l, [l[i] || ' ' || l[i + 1] FOR i IN range(1, len(l))], [l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] FOR i IN range(1, len(l) - 1)])) AS f FROM w),
n AS MATERIALIZED (SELECT side, id, f, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM n),
b AS MATERIALIZED (SELECT f, xor(list_reduce([('0x' || substr(h, 2 * i + 1, 2))::UBIGINT FOR i IN range(len(h) // 2)],
       lambda a, y: xor(a >> 8, list_extract(l, (xor(a, y) & 255)::BIGINT + 1)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket FROM d, t),
k AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM n JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM k) + 10000) / ((s + 1) * ((SELECT sum(t) FROM k) + 10000))))::BIGINT AS gain FROM k),
v AS (SELECT id, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM n JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
s AS (SELECT w.id AS doc_id, len(w.l) AS words, coalesce(v.n_features, 0) AS n_features, coalesce(v.weight, 0) AS weight,
        coalesce(v.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.name), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN v ON v.id IS NOT DISTINCT FROM w.id WHERE side = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS pos, count(*) OVER (PARTITION BY words >= 20) AS all_of FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND pos <= 5 * all_of // 100 THEN pos END AS rank FROM r
"""
