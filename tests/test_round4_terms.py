"""Texts on which first_positive_term and its SQL once parted."""

import duck
import duckdb
import pandas as pd
from pyspark.sql import functions as F

from millrace import registry
from millrace.plans import routing
from millrace.registry_judging import positive_terms_cte

PARTED = {
    "noñieesos, una que": None,  # a negation ends before a letter beyond ASCII
    "ñno der": None,
    "piano " + "x" * 56 + " the": None,  # the characters before the 60 aren't seen
    "piano " + "x" * 57 + " the": "the",
    "the\u0301 and": "and",  # marks, joiners and letters of private use belong to words
    "\u200dque der": "der",
    "the\ue000 and": "and",
    "MİSSİNG the": None,  # İ counts as i, and as one character
    "no " + "İ" * 56 + " the": None,
    "no " + "İ" * 57 + " the": "the",
}


def test_terms_equal_their_sql(spark, tmp_path):
    texts = dict(enumerate([*PARTED, "the²", "²the", "€the", "the’s", "", None]))
    rows = pd.DataFrame([(3 * i + k, t) for i, t in texts.items() for k in range(3)], columns=["doc_id", "text"])
    rows.to_parquet(tmp_path / "documents.parquet")
    name = "sc15_first_positive_term"
    df = registry.QUERIES[name](spark, str(tmp_path))
    assert duck.rows_of_frame(df) == duck.rows_of_sql(duck.connect(tmp_path), registry.SQL[name])
    got = {r.doc_id: r.term for r in df.collect()}
    assert {t: got[3 * i + 1] for i, t in texts.items() if t in PARTED} == PARTED


def test_mentions_of_a_term_do_not_overlap(spark):
    rows = pd.DataFrame([(0, "no " + "x" * 56 + " car car"), (1, "no " + "x" * 56 + " car car "), (2, "no " + "x" * 56 + " car  car "), (3, "a car car ")], columns=["id", "hay"]).assign(list="w")
    c = duckdb.connect()
    c.register("rows", rows)
    want = dict(c.execute(f"WITH {positive_terms_cte('rows', {'w': (' car ',)})} SELECT id, term FROM first_terms").fetchall())
    df = spark.createDataFrame(rows).select("id", routing.first_positive_term(F.col("hay"), (" car ",)).alias("f"))
    assert {r.id: r.f for r in df.collect()} == {0: None, 1: None, 2: " car ", 3: " car "} == {i: want.get(i) for i in range(4)}
