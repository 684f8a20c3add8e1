"""The vector index where all cells must be visited: what is shuffled follows the blocks, not the cells."""

import numpy as np
from millrace.operators import vector_index


def test_a_query_meets_blocks_of_cells_not_each_cell(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(1500, 16))
    m[1000:1400] = m[3]  # copies tie by key
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    index = vector_index.build(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 10)
    kept, stored = {}, vector_index.stored
    monkeypatch.setattr(vector_index, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    asked = spark.createDataFrame([(i, rows[i][1], 7) for i in range(40)], "query_id long, q array<double>, top_k int")
    found, _ = vector_index.search(index, asked, 500)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.nth):
        got.setdefault(r.query_id, []).append(r.k)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(40):
        c = np.round((unit * unit[i]).sum(axis=1), 12)
        assert got[i] == np.lexsort((np.arange(1500), -c))[:7].tolist()
    cells = sum(map(len, index.sizes.values()))
    assert cells > 60 and kept["second"].filter("looked >= 0").count() <= 40 * 10
