"""Every registered query against its SQL twin on the smallest tables."""

import duck
import pytest

from millrace import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    names, rows = duck.rows_of_frame(registry.QUERIES[name](spark, FOLDER))
    assert names
    if name in registry.SQL:
        assert (names, rows) == duck.rows_of_sql(duck.connect(FOLDER), registry.SQL[name])
