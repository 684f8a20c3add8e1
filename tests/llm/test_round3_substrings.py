"""Strings of large groups, known inside a batch or by the join."""

import numpy as np

from millrace.llm import substrings


def test_strings_beside_each_other():
    one, two = np.array([5, 7, 5, 5, 9, 7], np.uint64), np.array([1, 2, 1, 3, 4, 2], np.uint64)
    assert substrings._beside(one, two).tolist() == [True, True, True, False, False, True]
    assert substrings._beside(one[:0], two[:0]).tolist() == []


def test_large_groups_equal_small_ones(spark):
    draw = np.random.default_rng(5)
    base = bytes(draw.integers(97, 123, 300, np.uint8)).decode()
    texts = [base[:at] + str(i) + base[at:] for i, at in enumerate(draw.integers(0, 300, 60).tolist())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = [sorted(tuple(r) for r in substrings.removed(df, length=40, seed=16, group=g).drop("kept").collect()) for g in (0, 10**6)]
    assert rows[0] == rows[1] and any(r[2] for r in rows[0])
