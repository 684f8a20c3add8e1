"""k2-treap search against brute force, and its defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import treap

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item long, rank int, shard long, score long"
MORE = (1, 2, 3, 4)


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def ranked(docs, items, most):
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        hits = []
        for d, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms_of(text)) if t in bag)
            if score > 0:
                hits.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, h[3], -h[0]) for i, h in enumerate(sorted(hits)[:most])]
    return sorted(out, key=repr)


def found(spark, docs, items, most=50, **how):
    df = spark.createDataFrame([(*d, *MORE) for d in docs], DOCS).repartition(3)
    n = treap.totals(df)
    size = {k: how.pop(k) for k in ("shard_docs", "shard_cells") if k in how}
    out = treap.search(treap.build(df, *n, **size), n[0], spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, item int"), most, **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("shard_docs", "most", "block", "probes"), [(1000, 50, 1000, 4), (37, 5, 7, 1), (1, 3, 100, 0)])
def test_search_equals_brute_force(spark, shard_docs, most, block, probes):
    rng = random.Random(shard_docs)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=rng.choice([0, 3, 40, 200])))) for i in range(150)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]
    items = [(i, " ".join(rng.sample(vocabulary, 12)) + " W1 É") for i in range(10)]
    assert found(spark, docs, items, most, shard_docs=shard_docs, block_items=block, probes=probes) == ranked(docs, items, most)


def test_nulls_ties_repeats_and_empty_tables(spark):
    docs = [(1, "Ab, ab! x"), (None, "ab ab x"), (2, "ab ab x"), (2, "ab ab x"), (3, None), (4, ""), (5, "... "), (6, "É é y")]
    items = [(1, "AB ab"), (1, "AB ab"), (None, "é"), (2, None), (3, "zzz"), (4, "")]
    got = found(spark, docs, items, 3, shard_docs=2)
    once = [r for r in ranked(docs, items[2:], 3)]
    assert [r for r in got if r[0] != 1] == [r for r in once if r[0] != 1]
    mine = [r for r in got if r[0] == 1]
    assert [r[:3] for r in mine] == [(1, 1, 1), (1, 1, 1), (1, 2, 2), (1, 2, 2), (1, 3, 2), (1, 3, 2)]
    assert [r[2] for r in found(spark, docs, [(9, "ab")], 50)] == [1, 2, 2, None]
    assert found(spark, [(1, None)], items) == []
    assert found(spark, docs, []) == [] if docs and not items else True
    empty = spark.createDataFrame([], DOCS)
    assert treap.search(treap.build(empty, *treap.totals(empty)), 0, spark.createDataFrame([(1, "ab")], "item_id long, text string")).count() == 0
    full = spark.createDataFrame([(1, "ab", *MORE)], DOCS)
    assert treap.search(treap.build(full, *treap.totals(full)), 1, full.select(full.doc_id.alias("item_id"), "text").limit(0)).count() == 0


def test_very_long_text(spark):
    docs = [(1, "alpha beta " * 500_000 + "gamma"), (2, "gamma delta"), (3, "delta")]
    items = [(1, "gamma"), (2, "alpha delta")]
    assert found(spark, docs, items) == ranked(docs, items, 50)


def test_grid_levels_hold_every_cell_and_its_maxima():
    rng = np.random.default_rng(5)
    for _ in range(20):
        rows, cols, depth = rng.integers(0, 50, 300), rng.integers(0, 13, 300), 6
        cells = {(r, c): int(v) for r, c, v in zip(rows.tolist(), cols.tolist(), rng.integers(1, 999_999, 300).tolist(), strict=True)}
        keys = np.array(list(cells))
        masks, maxima = treap.grid(keys[:, 0], keys[:, 1], np.array(list(cells.values())), depth)
        terms = b" ".join(b"t%d" % i for i in range(64))
        shard = treap.Shard({"doc_ids": list(range(13)), "depth": depth, "sizes": [len(m) for m in maxima], "terms": treap.packed(terms), "masks": treap.packed(np.concatenate(masks)), "lacks": treap.packed(treap.lacking(masks, maxima))}, set(terms.split()))
        assert shard.maxima.tolist() == np.concatenate(maxima).tolist()
        assert shard.maxima[0] == max(cells.values())
        for r in range(50):
            assert sorted((c, s) for s, c in shard.search([(b"t%d" % r, 1)], 100, 1)) == sorted((c, v) for (q, c), v in cells.items() if q == r)
