"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in segments of 64 from both sides, gives every position a
probability of each language, and a document gets the mean over all positions of its
whole text.  It is trained here, in numpy, by backpropagation through time; gates and
outputs are piecewise linear, which costs no accuracy and is fast in numpy.

Training reads labelled documents outside the held-out fold only: per language, about
SAMPLE_DOCS documents (by hash of doc_id) with up to SAMPLE_SEGMENTS of their segments, so
what reaches the driver is bounded by ``languages * SAMPLE_DOCS * SAMPLE_SEGMENTS`` segments
of 64 bytes; with very many languages each gives fewer documents, MOST_SAMPLED in all, but none is left out.
Prediction runs where the documents are read; only labels leave the tasks.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is every text if
there is nothing to learn from; a null doc_id is in neither fold (held_out false, not
learned from); ties in probability go to the first language by name; repeated rows get
equal results; an empty table gives no rows; further columns pass through ``keep_identified``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import shingles
from millrace.session import table

SEGMENT = 64
HIDDEN = 8
SAMPLE_DOCS, SAMPLE_SEGMENTS, MOST_SAMPLED, LEAST_SAMPLED = 300, 12, 100_000, 20
STEPS, BATCH, RATE = 220, 384, 0.02
BLOCK = 2048
FOLDS = 5
SURE = 0.9

Model = dict[str, np.ndarray]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each segment, its true length, segments of each row)."""
    lengths = np.diff(offsets)
    count = -(-lengths // SEGMENT)
    row = np.repeat(np.arange(len(lengths)), count)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
    size = np.minimum(lengths[row] - at, SEGMENT)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(SEGMENT, np.uint8)]), SEGMENT)
    parts = windows[offsets[row] + at]  # bytes are copied once, without a number for the place of each
    parts[np.arange(SEGMENT) >= size[:, None]] = 0
    return parts, size, count


def _direction(p: Model, side: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, hidden, batch) of one direction; x is (time, batch) in reading order."""
    steps, n = x.shape
    wx, u = p["wx" + side], p["u" + side]
    out, h = np.empty((steps, HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
    for t in range(steps):
        a = wx.take(x[t], axis=1)
        b = u @ h
        gates = a[: 2 * HIDDEN] + b[: 2 * HIDDEN]
        np.minimum(np.maximum(gates, 0, out=gates), 1, out=gates)
        z, r, m = gates[:HIDDEN], gates[HIDDEN:], b[2 * HIDDEN :]
        new = r * m
        new += a[2 * HIDDEN :]
        np.minimum(np.maximum(new, -1, out=new), 1, out=new)
        if keep is not None:
            keep.append((h, z, r, m, new))
        h = np.subtract(h, new)
        h *= z
        h += new
        out[t] = h
    return out


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def position_probabilities(p: Model, x: np.ndarray) -> np.ndarray:
    """(time, languages, batch) for bytes x of shape (time, batch)."""
    f, b = _direction(p, "f", x), _direction(p, "b", x[::-1])[::-1]
    v = p["v"]
    logits = np.matmul(v[:, :HIDDEN], f)
    logits += np.matmul(v[:, HIDDEN:], b)
    logits += p["c"][:, None]
    return _softmax(logits, 1)


def _backward(p: Model, g: Model, side: str, x: np.ndarray, kept: list, dout: np.ndarray) -> None:
    """Backpropagation through time; gates are 0.5-shifted lines clipped to [0, 1].

    The products here are small on purpose: the driver's BLAS then starts no threads for them."""
    u, H = p["u" + side], HIDDEN
    dh = np.zeros_like(dout[0])
    inputs = np.zeros((3 * H, *x.shape), dout.dtype)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, m, new = kept[t]
        dh = dh + dout[t]
        dnew = dh * (1 - z) * (np.abs(new) < 1)
        dz = dh * (h - new) * ((z > 0) & (z < 1))
        dr = dnew * m * ((r > 0) & (r < 1))
        da = np.concatenate([dz, dr, dnew])
        db = np.concatenate([dz, dr, dnew * r])
        g["u" + side] += db @ h.T
        inputs[:, t] = da
        dh = dh * z + u.T @ db
    flat = x.ravel().astype(np.int64)
    for k in range(3 * H):
        g["wx" + side][k] += np.bincount(flat, inputs[k].ravel(), 256)


def loss_and_gradients(p: Model, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, Model]:
    """Cross-entropy of every valid position against its document's language."""
    kf, kb = [], []
    f, b = _direction(p, "f", x, kf), _direction(p, "b", x[::-1], kb)[::-1]
    both = np.concatenate([f, b], axis=1)
    probs = _softmax(np.matmul(p["v"], both) + p["c"][:, None], 1)
    n = np.arange(x.shape[1])
    total = float(valid.sum())
    loss = -float((np.log(probs[:, y, n] + 1e-9) * valid).sum()) / total
    d = probs.copy()
    d[:, y, n] -= 1
    d *= valid[:, None, :] / total
    g = {k: np.zeros_like(w) for k, w in p.items()}
    g["v"] = np.einsum("tcn,thn->ch", d, both, optimize=True)
    g["c"] = d.sum(axis=(0, 2))
    back = np.matmul(p["v"].T, d)
    _backward(p, g, "f", x, kf, back[:, :HIDDEN])
    _backward(p, g, "b", x[::-1], kb, back[::-1, HIDDEN:])
    return loss, g


def start_model(languages: int, rng: np.random.Generator) -> Model:
    p = {}
    for s in "fb":
        p["wx" + s] = rng.normal(0, 0.3, (3 * HIDDEN, 256)).astype(np.float32)
        p["wx" + s][: 2 * HIDDEN] += 0.5
        p["u" + s] = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32)
    p["v"] = rng.normal(0, 0.3, (languages, 2 * HIDDEN)).astype(np.float32)
    p["c"] = np.zeros(languages, np.float32)
    return p


def train(rows: np.ndarray, sizes: np.ndarray, y: np.ndarray, languages: int, seed: int = 5) -> Model:
    """Adam on balanced batches of segments."""
    rng = np.random.default_rng(seed)
    p = start_model(languages, rng)
    first, second = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    by = [np.flatnonzero(y == c) for c in range(languages)]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(i, max(1, BATCH // languages)) for i in by if len(i)])
        valid = (np.arange(SEGMENT)[:, None] < sizes[pick]).astype(np.float32)
        _, g = loss_and_gradients(p, rows[pick].T, valid, y[pick])
        norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k in p:
            w = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * w
            second[k] = 0.98 * second[k] + 0.02 * w * w
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return p


def pooled(p: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, languages): the mean of the position probabilities of each row's bytes."""
    rows, size, count = segments(data, offsets)
    sums = np.zeros((len(rows), len(p["c"])))
    for a in range(0, len(rows), BLOCK):
        x, n = np.ascontiguousarray(rows[a : a + BLOCK].T), size[a : a + BLOCK]
        probs = position_probabilities(p, x)
        if (n < SEGMENT).any():
            probs *= (np.arange(SEGMENT)[:, None] < n)[:, None, :]
        sums[a : a + BLOCK] = probs.sum(axis=0).T
    total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
    ends = np.cumsum(count)
    return (total[ends] - total[ends - count]) / np.maximum(np.diff(offsets), 1)[:, None]


def training_segments(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, segment bytes, sizes, language numbers) of the bounded sample."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().orderBy("lang").collect()  # one row for each language
    none = np.zeros((0, SEGMENT), np.uint8)
    if not counts:
        return [], none, np.zeros(0, int), np.zeros(0, int)
    # A few rows in a rare language must not all be drawn away, so that every language has some.
    each = max(LEAST_SAMPLED, min(SAMPLE_DOCS, MOST_SAMPLED // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, _share double")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(F.broadcast(shares), "lang").filter(draw < F.col("_share")).select("lang", "text", F.xxhash64("doc_id", "text").alias("seed"))
    chosen = chosen.dropDuplicates(["lang", "seed"])  # a row that is there a million times is drawn once

    def cut(batches):
        for batch in batches:
            for row, data, offsets in shingles.slices(batch.column(1)):
                parts, _, count = segments(data, offsets)
                size = np.minimum(np.repeat(np.diff(offsets), count) - (np.arange(len(parts)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT, SEGMENT)
                langs, out, end = [], [], np.cumsum(count)
                for i, (a, b) in enumerate(zip((end - count).tolist(), end.tolist(), strict=True)):
                    pick = np.arange(a, b)
                    if len(pick) > SAMPLE_SEGMENTS:
                        pick = np.sort(np.random.default_rng(batch.column(2)[row + i].as_py() & (1 << 63) - 1).choice(pick, SAMPLE_SEGMENTS, replace=False))
                    langs += [batch.column(0)[row + i].as_py()] * len(pick)
                    out += [parts[k, : size[k]].tobytes() for k in pick]
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "part"])

    got = sorted((r[0], bytes(r[1])) for r in chosen.mapInArrow(cut, "lang string, part binary").collect())
    languages = sorted({g[0] for g in got})
    rows = np.zeros((len(got), SEGMENT), np.uint8)
    for i, (_, part) in enumerate(got):
        rows[i, : len(part)] = np.frombuffer(part, np.uint8)
    return languages, rows, np.array([len(part) for _, part in got], int), np.array([languages.index(g[0]) for g in got], int)


def fitted(docs: DataFrame) -> tuple[list[str], Model | None]:
    languages, rows, sizes, y = training_segments(docs)
    return languages, train(rows, sizes, y, len(languages)) if languages else None


def predict(docs: DataFrame, languages: list[str], model: Model | None, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs``, ``lang_pred`` and ``score``.

    A kept ``text`` is what is read, so that a batch has each text once."""
    schema = docs.select(*[F.col(f"`{k}`") for k in keep]).schema
    schema = T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    once = "text" in keep and isinstance(schema["text"].dataType, T.StringType)
    n_keep, read = len(keep), keep.index("text") if once else len(keep)

    def label(batches):
        for batch in batches:
            for row, data, offsets in shingles.slices(batch.column(read)):
                part = batch.slice(row, len(offsets) - 1)
                named = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool) if model else np.zeros(len(part), bool)
                best, score = np.zeros(len(part), int), np.zeros(len(part))
                if named.any():
                    probs = pooled(model, data, offsets)
                    best = probs.argmax(axis=1)
                    score = np.where(named, np.clip(probs.max(axis=1), 0, 1), 0.0)
                pred = [languages[b] if ok else "und" for b, ok in zip(best, named, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], pa.array(pred, pa.string()), pa.array(score)], names=[*part.schema.names[:n_keep], "lang_pred", "score"])

    texts = [] if once else [F.col("text").cast("string").alias("_text")]
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], *texts, lettered.alias("_lettered"))
    return rows.mapInArrow(label, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified; ``lang`` becomes the prediction where it is null or the score is SURE or more.

    Rejected are texts without a letter, null and empty ones included.  Repeated rows stay or go together and get one
    language; of equally likely languages the first by name counts; without anything to learn from, ``lang`` stays as it is;
    an empty table gives no rows; further columns pass through, whatever their names."""
    languages, model = fitted(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # The rows travel as one column, so that no name of theirs can clash, and the texts beside it, once.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    found = predict(rows, languages, model, "row", "text").filter("lang_pred != 'und'")
    lang = F.when(F.col("row.lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("row.lang"))
    return found.select(*[(lang if c == "lang" else F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return predict(rows, *fitted(docs), "doc_id", "held_out")
