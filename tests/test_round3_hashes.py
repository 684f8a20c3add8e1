"""Hash pairs by blocks and by bands, and what a value is shuffled for."""

import random
from math import comb

import pytest
from millrace.operators import similarity


@pytest.mark.parametrize("threshold", [3, 15, 24])
@pytest.mark.parametrize("n", [0, 1, 2300])
def test_close_values_equal_brute_force(spark, monkeypatch, n, threshold):
    monkeypatch.setattr(similarity, "LEAST_BLOCK", 500)
    draw = random.Random(n)
    values = list({draw.getrandbits(64) - (1 << 63) for _ in range(n // 2)})
    values = list({*values, *(v ^ sum(1 << i for i in draw.sample(range(63), draw.randrange(1, 22))) for v in values)})
    want = {(min(a, b), max(a, b)) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= threshold}
    got = [(r.v, r.w) for r in similarity._close_values(spark.createDataFrame([(v,) for v in values], "v long"), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n", [10_256, 51_282, 3_000_000, 10**9])
def test_probes_of_a_value_stay_few(n):
    for threshold in range(33):
        bands = similarity.band_plan(n, threshold)
        assert not bands or sum(comb(64 // bands, r) for r in range(threshold // bands + 1)) <= 200


def test_groups_at_a_wide_threshold(spark):
    chain = [(1 << 12 * i) - 1 for i in range(6)]
    rows = [(i + 1, v) for i, v in enumerate(chain)] + [(90, chain[0]), (91, None), (92, -1)]
    got = similarity.near_hash_groups(spark.createDataFrame(rows, "k int, v long"), "k", "v", 15)
    assert {r.k: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 90: 1, 91: 91, 92: 1}


@pytest.mark.parametrize("threshold", [3, 15])
def test_probes_and_blocks_are_not_broadcast_nor_met_in_one_task(spark, threshold):
    values = spark.range(6000).selectExpr("xxhash64(id) AS v")
    near = similarity._close_values(values, threshold)
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert bool(similarity.band_plan(6000, threshold)) == (threshold == 3)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert threshold == 3 or near.rdd.getNumPartitions() == 2 * -(-6000 // similarity.LEAST_BLOCK)
