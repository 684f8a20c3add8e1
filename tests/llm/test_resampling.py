"""Importance resampling against brute force, and its defined cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.llm import importance, words
from millrace.session import stored

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall((text or "").encode().lower())
    return [b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def plain_draw(docs, target, share=5, least=20, buckets=10_000):
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in plain_features(text)[0]:
                counts[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text in docs:
        fs, n = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, able[: share * len(able) // 100]


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("share", "least"), [(5, 20), (50, 1), (100, 0)])
def test_draw_equals_brute_force(spark, share, least):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    target = [r["text"] for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    every, best = plain_draw(docs, target, share, least)
    rank = {r[0]: i + 1 for i, r in enumerate(best)}
    got = importance.drawn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), share, least)
    assert rows_of(got) == sorted(((*r[:4], rank.get(r[0])) for r in every), key=repr)


def test_nulls_ties_repeats_and_clashing_names(spark):
    schema = "doc_id long, text string, rank string, score long, n_words int, key string, row string, id int"
    more = ("r", 1, 2, "k", "w", 3)
    rows = [(7, "a b c", *more)] * 5 + [(None, "a b c", *more)] * 3 + [(8, None, *more), (9, "", *more), (10, "... !", *more)]
    docs, target = spark.createDataFrame(rows, schema), spark.createDataFrame([("a b",), (None,)], "text string")
    for share in (10, 50, 100):
        out = importance.drawn(docs, target, share, 1).collect()
        assert len(out) == 11
        ranks = sorted(r["rank"] for r in out if r["rank"])
        assert ranks == list(range(1, share * 8 // 100 + 1))
        kept = importance.resampled(docs, target, share=share, least_words=1)
        assert kept.columns == docs.columns
        assert kept.count() == len(ranks)
    assert importance.drawn(docs.limit(0), target).count() == 0
    assert importance.resampled(docs.limit(0), target).count() == 0
    assert {r["rank"] for r in importance.drawn(docs, target.limit(0)).collect()} == {None}


def test_long_texts_in_pieces_count_runs_across_seams(monkeypatch):
    text = ("Wort é-x9 " * 50 + "z" * 300 + " ") * 20
    memo = importance._Words()
    whole = importance.features([b"a b", text.encode()], memo)
    monkeypatch.setattr(words.word_pieces, "__defaults__", (100,))
    parts = importance.features([b"a b", text.encode()], memo)
    assert whole[2].tolist() == parts[2].tolist()
    for (codes, low, end), (codes2, low2, end2) in zip(whole[1], parts[1], strict=True):
        one = np.concatenate([codes[a:b] for a, b in zip(low, end, strict=True)])
        two = np.concatenate([codes2[a:b] for a, b in zip(low2, end2, strict=True)])
        assert one.tolist() == two.tolist()
    assert len(parts[0]) > 50


def test_very_long_text(spark):
    text = "Alpha beta-gamma " * 600_000
    (row,) = importance.drawn(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("beta",)], "text string")).collect()
    assert row.n_features == 3 * 1_800_000 - 3


def test_cutoff_is_the_kth_value(spark):
    rng = np.random.default_rng(3)
    values = [int(v) for v in np.concatenate([rng.integers(-(10**12), 10**12, 500), np.full(200, 77), [-5, -5, 4]])]
    rows = stored(spark.createDataFrame([(v,) for v in [*values, None]], "v long"), "values")
    for k in (1, 2, 250, 400, 703):
        assert importance.cutoff(rows, "v", k, True) == sorted(values)[-k]
        assert importance.cutoff(rows, "v", k, False, thresholds=3) == sorted(values)[k - 1]
    assert importance.cutoff(rows, "v", 0, True) is None
    assert importance.cutoff(rows, "v", 704, True) is None
