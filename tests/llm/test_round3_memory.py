"""Language ID and slices of texts hold each text once in a worker."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from millrace.llm import langid, shingles


def test_a_kept_text_travels_once(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, w, lang, "s", len(w or "")) for i, (w, lang) in enumerate([("the cat sat", "en"), ("der hund lief", "de"), ("12", None), (None, "en"), ("the dog", None)] * 6)],
        "doc_id long, text string, lang string, source string, n_chars int",
    )
    sent, kind = [], type(docs)
    through = kind.mapInArrow

    def seen(self, *args, **kw):
        sent.append(self.schema.simpleString())
        return through(self, *args, **kw)

    monkeypatch.setattr(kind, "mapInArrow", seen)
    kept = langid.keep_identified(docs)
    labelled = sent[-1]
    # Strings beside the text itself: lang and source.
    assert labelled.count("string") == 3 and labelled.count("text") == 1
    assert kept.columns == docs.columns
    want = sorted((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in docs.collect() if r["text"] not in (None, "12"))
    assert sorted((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in kept.collect()) == want


def test_segments_take_little_more_than_their_bytes():
    size = 4 << 20
    data = np.random.default_rng(1).integers(0, 256, size, dtype=np.uint8)
    offsets = np.array([0, 0, 70, 70 + 64, size - 5, size])
    tracemalloc.start()
    parts, sizes, count = langid.segments(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * size
    assert count.tolist() == [0, 2, 1, -(-(size - 5 - 134) // 64), 1]
    at = 0
    for a, b, n in zip(offsets, offsets[1:], count, strict=False):
        flat = parts[at : at + n].ravel()
        assert sizes[at : at + n].sum() == b - a and (flat[: b - a] == data[a:b]).all() and not flat[b - a :].any()
        at += n
    none, _, count = langid.segments(np.zeros(0, np.uint8), np.array([0, 0, 0]))
    assert none.shape == (0, 64) and count.tolist() == [0, 0]


def test_slices_copy_no_text_for_nulls():
    texts = pa.array(["ab" * 1000, None, "", "é" * 700, None] * 800)
    before = pa.total_allocated_bytes()
    rows, most = [], 0
    for row, data, offsets in shingles.slices(texts):
        most = max(most, pa.total_allocated_bytes() - before)
        assert row == len(rows)
        rows += [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert rows == [t or "" for t in texts.to_pylist()]
    assert most < texts.nbytes / 10


def test_slices_leave_out_what_lies_under_a_null():
    bytes_ = pa.py_buffer(b"onehiddentwo")
    texts = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(b"\x05"), pa.py_buffer(np.array([0, 3, 9, 12], np.int32)), bytes_])
    assert texts.to_pylist() == ["one", None, "two"]
    for part in (texts, texts.slice(1), texts.slice(0, 0)):
        got = [(data.tobytes(), offsets.tolist()) for _, data, offsets in shingles.slices(part)]
        joined = "".join(t or "" for t in part.to_pylist()).encode()
        assert b"".join(d for d, _ in got) == joined
