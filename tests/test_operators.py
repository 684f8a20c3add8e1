"""Behaviour of the curation operators on small fixtures."""

import json
import os
import random
import re
import shutil
import subprocess
import sys
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import keywords, scalars
from millrace.operators import accounting, catalogue, components, similarity, vector_cells, vector_index
from millrace.plans import export, routing
from millrace.streaming import jobs


@pytest.mark.parametrize(
    ("query", "text", "expected"),
    [("cat dog", "a DOG", True), ("cat AND dog", "dog", False), ("cat AND dog OR fish", "fish", True), ("NOT cat", "dog", True), ("NOT NOT cat", "cat", True), ('"red dog"', "a red dog", True), ('"red', "infrared", True), ("(cat OR dog) AND red", "red cat", True), ("", "x", False), ("(cat", "x", True), ("AND cat", "x", True), ("cat AND", "x", True), ("cat)", "x", True), ("cat NOT dog", "bird", True)],
)
def test_keyword_query(spark, query, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(keywords.keyword_query(F.col("t"), query)).first()[0] is expected


def test_keyword_setting():
    assert keywords.as_query("a, b,") == ["a", "b"]
    assert keywords.as_query("a and b") == "a and b"


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {a: find(a) for a in parent}


@pytest.mark.parametrize("threshold", [0, 5, 10, 15, 20])
def test_near_hash_pairs_equal_brute_force(spark, threshold):
    rnd = random.Random(threshold)
    base = [rnd.getrandbits(63) for _ in range(12)]
    rows = [(i, rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 12)))) for i in range(80)]
    got = {(r.a, r.b, r.distance) for r in similarity.near_hash_pairs(spark.createDataFrame(rows, "k int, v long"), "k", "v", threshold).collect()}
    assert got == {(i, j, (v ^ w).bit_count()) for i, v in rows for j, w in rows if i < j and (v ^ w).bit_count() <= threshold}


def test_vectors_of_different_lengths_and_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, None)], "k int, v array<double>")
    assert [(r.a, r.b) for r in similarity.near_vector_pairs(df, "k", "v", 0.9).collect()] == [(1, 2)]
    assert similarity.balance(df, similarity.near_vector_pairs(df, "k", "v", 0.9), "k", 0).count() == 0


@pytest.fixture(scope="module")
def clustered():
    """Vectors about a few centres, one of which holds a third, with copies, zero and odd ones."""
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((12, 6))
    picks = np.where(rnd.random(600) < 0.33, 0, rnd.integers(0, 12, 600))
    m = centres[picks] + rnd.standard_normal((600, 6)) * rnd.choice([0.0, 0.05, 0.3], 600)[:, None]
    rows = [(1000 + i, [float(x) for x in v]) for i, v in enumerate(m)]
    return rows + [(1, [0.0] * 6), (2, [0.0] * 6), (3, [float("nan")] * 6), (4, None), (5, [1.0, 2.0]), (6, [2.0, 4.0])]


def near_by_brute_force(rows, threshold):
    found = {}
    for n in (2, 6):
        part = [(k, np.array(v)) for k, v in rows if v is not None and len(v) == n]
        for i, (a, x) in enumerate(part):
            for b, y in part[i + 1 :]:
                norm = np.linalg.norm(x) * np.linalg.norm(y)
                cosine = x @ y / norm if norm else 0.0
                if cosine >= threshold:
                    found[min(a, b), max(a, b)] = cosine
    return found


@pytest.mark.parametrize("block", [64, 4096])
@pytest.mark.parametrize("threshold", [0.95, 0.6, -0.1])
def test_pivot_cells_equal_brute_force(spark, clustered, threshold, block):
    rows = spark.createDataFrame([r for r in clustered if r[1] is not None], "k long, v array<double>")
    want = near_by_brute_force(clustered, threshold)
    got = vector_cells.near_pairs(rows, threshold, block).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == set(want)
    assert all(abs(r.cosine - want[r.a, r.b]) < 1e-9 for r in got)
    least = {k: k for k, _ in clustered}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    df = spark.createDataFrame(clustered, "k long, v array<double>")
    groups = similarity.clusters(df, "k", "v", threshold)
    assert sorted((r.k, r.component) for r in groups.collect()) == sorted((k, find(k)) for k, _ in clustered)


def test_a_dense_group_is_linked_through_its_pivot(spark):
    rnd = np.random.default_rng(6)
    dense = np.ones((3000, 8)) + rnd.standard_normal((3000, 8)) * 0.01
    rows = [(f"k{i:05d}", [float(x) for x in v]) for i, v in enumerate(np.concatenate([dense, rnd.standard_normal((300, 8))]))]
    nodes = spark.createDataFrame(rows, "k string, v array<double>")
    cells = vector_cells.placed(nodes, 0.9)
    met = vector_cells._meetings(cells, F.col("pivot").isNull(), 4096).filter("NOT is_home AND home = cell")
    assert met.filter("k < 'k03000'").count() == 0
    got = {r.k: r.component for r in similarity.clusters(nodes, "k", "v", 0.9).collect()}
    assert {got[f"k{i:05d}"] for i in range(3000)} == {"k00000"}


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "k long, v array<double>, component string")
    assert similarity.clusters(df, "k", "v", 0.9).count() == 0
    assert similarity.near_vector_pairs(df, "k", "v", 0.9).count() == 0


def test_round_robin_equals_a_cursor_walk(spark):
    rnd = random.Random(4)
    rows = [(s, i) for s in "abc" for i in range(rnd.randint(1, 9))]
    weights = {"a": 3, "b": 1, "c": 2}
    df = catalogue.weighted_round_robin(spark.createDataFrame(rows, "slug string, i int"), spark.createDataFrame([(s, p, weights[s]) for p, s in enumerate("abc")], "slug string, pos int, weight int"), ["i"])
    got = [(r.slug, r.i) for r in df.orderBy("cycle", "pos", "slot").collect()]
    queues = {s: [r for r in rows if r[0] == s] for s in "abc"}
    walk = []
    while any(queues.values()):
        for s in "abc":
            walk += [queues[s].pop(0) for _ in range(min(weights[s], len(queues[s])))]
    assert got == walk


@pytest.mark.parametrize("seed", range(3))
def test_unique_stems_equal_a_walk(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("de"), rnd.choice(["a", "a", "a_1", "a_2", "a_1_1", "b", "b_7", "img_1", "img_2", "c"]), i) for i in range(60)] + [("d", "a", 60)]
    got = {r.i: r.name for r in catalogue.unique_stems(spark.createDataFrame(rows, "folder string, stem string, i int"), "folder", "stem", ["i"]).collect()}
    used, expected = {"d": set(), "e": set()}, {}
    for folder, stem, i in rows:
        name, k = stem, 0
        while name in used[folder]:
            k += 1
            name = f"{stem}_{k}"
        used[folder].add(name)
        expected[i] = name
    assert got == expected


def test_prices_take_the_longest_prefix(spark):
    usage = spark.createDataFrame([("GPT-4-2024",), ("gpt-3",), ("other",), (None,)], "model string")
    prices = spark.createDataFrame([("gpt", 1.0, 1.0), ("gpt-4", 5.0, 6.0)], "prefix string, price_in double, price_out double")
    assert {r.model: r.price_in for r in accounting.with_prices(usage, prices).collect()} == {"GPT-4-2024": 5.0, "gpt-3": 1.0, "other": 0.0, None: 0.0}


NEGATED = ["no watermark visible", "No cat. A watermark", "a doll-like robot", None, "", "without any logo or watermark; watermark", "nothing but a watermark", "not a robot, " + "x" * 60 + " robot", "it doesn't show a robot", "watermarks", "a watermark, no robot", "robot\nno watermark", "free of side by side panels", "side by side", "know robot", "no. robot"]


def positive_by_python(text, terms):
    """The rule as a walk over mentions."""
    hay = (text or "").lower()
    for t in terms:
        word = not re.search(r"[ \-/.,]", t)
        for m in re.finditer(rf"\b{re.escape(t)}\b" if word else re.escape(t), hay):
            before = re.split(r"[.;]", hay[max(0, m.start() - 60) : m.start()])[-1]
            if not any(n in before if re.search(r"[ ']", n) else re.search(rf"\b{n}\b", before) for n in routing.NEGATIONS):
                return t
    return None


def test_positive_terms_equal_a_walk(spark):
    terms = ("watermark", "side by side", "robot")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NEGATED)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", routing.first_positive_term(F.col("t"), terms).alias("f")).collect()}
    assert got == {i: positive_by_python(t, terms) for i, t in enumerate(NEGATED)}


def test_terms_that_start_alike_and_lists_in_one_scan(spark):
    terms = ("model a vs", "model ", "girls", "girl", "her hair", " her ", "wine glass", "glass", "a.b", "c++ x")
    texts = ["model a vs b", "a model girl", "girls", "the girl's", "cut her hair", "no wine glass, a glass", "a.b axb", "c++ x", "no model a vs b. Model x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: set(r.m) for r in df.select("i", routing.positive_mentions(F.col("t"), terms).alias("m")).collect()}
    assert got == {i: {u for u in terms if positive_by_python(t, (u,))} for i, t in enumerate(texts)}
    by = {r.i: r.f for r in df.select("i", routing.first_positive_term(F.col("t"), terms).alias("f")).collect()}
    assert by == {i: positive_by_python(t, terms) for i, t in enumerate(texts)}


def test_negated_terms(spark):
    df = spark.createDataFrame([("no watermark visible",), ("No cat. A watermark",), ("a doll-like robot",), (None,)], "t string")
    assert [r[0] for r in df.select(routing.first_positive_term(F.col("t"), ("watermark", "robot"))).collect()] == [None, "watermark", "robot", None]


def test_apply_scores(spark):
    schema = "description string, primary_subject string, art_medium string, photorealistic_style boolean, has_ai_flaws boolean, woman_present boolean, is_human_photograph boolean, nsfw boolean, OVR_Quality_Score int, REL_Quality_Score int, quality_score int, category string"
    rows = [
        ("a woman smiling", "woman", "photograph", False, False, False, True, False, 90, 90, 8, "Amateur"),
        ("a marble statue of a woman", "statue", "photograph", True, False, True, True, False, 90, 90, 8, "Amateur"),
        ("a woman, watermark bottom left", "woman", "photograph", True, False, True, True, False, 90, 90, 8, "Amateur"),
        ("a woman", "woman", "photograph", True, False, True, True, True, 1, 1, 8, "Amateur"),
        ("a woman", "woman", "photograph", True, False, True, True, False, 10, 90, 8, "Amateur"),
        ("a woman", "woman", "photograph", True, False, True, True, False, 900, None, 8, "Gone"),
    ]
    out = routing.apply_scores(spark.createDataFrame(rows, schema), ("Amateur", "NSFW", "Watermarked", "Unknown"), 40, 0).collect()
    assert [r.category for r in out] == ["Amateur", "DISCARD", "Watermarked", "NSFW", "DISCARD", "DISCARD"]
    assert out[4].score_reason == "OVR score under the least of 40: 10"
    assert out[5].OVR_Quality_Score == 100 and out[5].REL_Quality_Score == 0


def test_export_options():
    for bad in ({"profile": "x"}, {"split": 1.0}, {"repeats": -1}, {"shard": 0}):
        with pytest.raises(ValueError):
            export.checked(**({"profile": "kohya", "split": None, "repeats": 0, "shard": 1} | bad))


def test_copy_files(spark, tmp_path):
    (tmp_path / "in.png").write_bytes(b"x" * 10)
    df = spark.createDataFrame([(f"file://{tmp_path}/in.png", "train/c", "a", ".png", "hello")], "path string, folder string, name string, ext string, caption string")
    export.copy_files(df, f"file://{tmp_path}/out").collect()
    assert (tmp_path / "out/train/c/a.png").read_bytes() == b"x" * 10
    assert (tmp_path / "out/train/c/a.txt").read_text() == "hello"


def test_media_tree(spark, tmp_path):
    from millrace.sources import media

    root = tmp_path / "sorted"
    for name, text in {"demo/Keep/web/a.png": "p", "demo/Keep/web/a.txt": "caption", "demo/Keep/web/a.vision.json": '{"OVR_Quality_Score": 70}', "demo/Keep/.hid/b.png": "p", "demo/c.png": "p", "10_cat/d.JPG": "p"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = media.read_media(spark, str(root))
    assert {r.rel for r in files.select("rel").collect()} == {"demo/Keep/web/a.png", "demo/c.png", "10_cat/d.JPG"}
    rows = media.attach_sidecars(media.parse_layout(files, "sorted"), media.read_texts(spark, str(root), ".txt"), media.read_texts(spark, str(root), ".vision.json")).collect()
    assert [(r.topic_slug, r.category, r.source, r.prompt, r.ovr) for r in rows] == [("demo", "Keep", "web", "caption", 70)]
    assert [(r.repeats, r.concept) for r in media.kohya_folder(files).collect()] == [(10, "cat")]


def test_stream_counts_equal_batch(spark, tmp_path):
    batch = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("k"), F.lit(1.0).alias("value"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = jobs.windowed_counts(stream, "k", delay="10 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    expected = jobs.windowed_counts(batch, "k")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, expected.collect()))


def test_scalars(spark):
    df = spark.createDataFrame([("keep_ab_c_1700000000_123", "24000/1001", "A b  C!")], "s string, f string, t string")
    r = df.select(scalars.recover_id(F.col("s")), scalars.fps_fraction(F.col("f")), scalars.slugify(F.col("t")), scalars.titleize(scalars.slugify(F.col("t")))).first()
    assert r[0] == "ab_c" and abs(r[1] - 23.976) < 1e-3 and r[2] == "a_b_c" and r[3] == "A B C"


@pytest.mark.parametrize("threshold", [0, 10, 15, 18, 24])
def test_band_plans_lose_no_pair(spark, threshold, monkeypatch):
    rnd = random.Random(threshold)
    base = [rnd.getrandbits(63) for _ in range(10)]
    values = sorted({rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 20))) for _ in range(60)})
    expected = {(v, w) for v in values for w in values if v < w and (v ^ w).bit_count() <= threshold}
    for bands in (0, 3, 4, 6, 8):
        if bands and sum(comb(64 // bands, r) for r in range(threshold // bands + 1)) > similarity.MOST_PROBES:
            continue
        monkeypatch.setattr(similarity, "band_plan", lambda n, t, b=bands: b)
        got = similarity._close_values(spark.createDataFrame([(v,) for v in values], "v long"), threshold)
        assert {(r.v, r.w) for r in got.collect()} == expected


def test_bands_follow_from_the_number_of_values():
    assert similarity.band_plan(10, 10) == 0
    assert [similarity.band_plan(10**k, 10) for k in (6, 9)] == [similarity.band_plan(10**6, 10), similarity.band_plan(10**9, 10)]
    assert 2 <= similarity.band_plan(10**9, 10) <= similarity.band_plan(10**6, 10) <= 8


@pytest.mark.parametrize("threshold", [-0.2, 0.3, 0.8, 0.92, 1.0])
def test_leading_axes_lose_no_pair(threshold):
    rng = np.random.default_rng(7)
    spread = rng.normal(size=(400, 32))
    for m in (spread, spread * np.linspace(3, 0.01, 32), np.vstack([spread[:200], spread[:200] + 0.2 * rng.normal(size=(200, 32))])):
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        m[3], m[4] = 0, m[5]
        x, y = np.arange(0, 400, 2), np.arange(400)
        want = {(i, j) for i, j in zip(*np.nonzero(m[x] @ m[y].T >= threshold + 1e-12), strict=True)}
        for axes in (vector_cells.axes_for(m, threshold), np.eye(32)[:, :3], np.linalg.eigh(m.T @ m)[1][:, ::-1][:, :8]):
            got = {(i // 2, j) for a, b, _ in vector_cells.near_rows(m, x, y, threshold, axes) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
            assert want <= got
            assert all(m[2 * i] @ m[j] >= threshold - 1e-12 for i, j in got)


def test_search_with_and_without_a_limit(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(12)] + [(99, [1.0])], "k int, v array<double>")
    got = similarity.semantic_search(df, [("a", [1.0, 0.0], 3), ("b", [0.0, 1.0], None), ("c", [1.0], 5)], "k", "v").collect()
    rows = lambda q: [(r.k, r.nth) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.nth)]
    assert rows("a") == [(4, 1), (9, 2), (3, 3)] and [k for k, _ in rows("b")][:3] == [0, 5, 10] and len(rows("b")) == 12 and rows("c") == [(99, 1)]


@pytest.mark.parametrize(("block", "cells"), [(8192, 40), (7, 13)])
def test_vector_index_equals_a_scan_and_reads_less(spark, block, cells):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 8))
    m = centres[rng.integers(0, 12, 600)] + 0.1 * rng.normal(size=(600, 8))
    m[5], m[6], m[7] = 0, m[8], m[8]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, [1.0, 2.0]), (901, None), (902, [float("nan")] * 8), (903, [1.0, None] * 4), (904, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vector_index.build(df, "id", "v", cells)
    assert index.rows.count() == 601
    ask = [("a", rows[0][1], 5), ("b", rows[8][1], 2), ("flat", [0.0] * 8, 3), ("all", rows[3][1], None), ("many", rows[4][1], 10_000), ("none", rows[4][1], 0), ("two", [2.0, 1.0], 4), ("odd", [1.0] * 3, 4), ("far", [float(x) for x in rng.normal(size=8)], 7), ("empty", None, 3)]
    found, read = vector_index.search(index, spark.createDataFrame(ask, "query_id string, q array<double>, top_k int"), block)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.nth):
        got.setdefault(r.query_id, []).append(r.k)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for name, q, k in ask:
        if q is not None and len(q) == 8 and k != 0:
            c = np.round(unit @ (np.array(q) / max(np.linalg.norm(q), 1e-300)), 12)
            assert got[name] == np.lexsort((np.arange(600), -c))[:k].tolist(), name
    assert got["two"] == [900] and not {"none", "odd", "empty"} & set(got)
    rows_read = {r.query_id: r.rows_read for r in read.collect()}
    assert rows_read["a"] < 300 and rows_read["all"] == 600
    empty = vector_index.build(df.limit(0), "id", "v")
    assert vector_index.search(empty, spark.createDataFrame(ask, "query_id string, q array<double>, top_k int"))[0].count() == 0


def test_hourly_spend_equals_a_sum_over_pairs(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randrange(0, 5 * 3600) * 1_000_000, float(rnd.randrange(9))) for _ in range(200)] + [("a", 0, 1.0), ("a", 3_600_000_000, 1.0), ("a", 3_600_000_001, 1.0)]
    df = spark.createDataFrame(rows, "k string, us long, cost double")
    got = sorted((r.k, r._us, r.hourly) for r in accounting.hourly_spend(df, "k", F.col("us"), "cost").collect())
    assert got == sorted((k, t, sum(c for j, u, c in rows if j == k and t - 3_600_000_000 <= u <= t)) for k, t, _ in rows)


def test_png_and_workflow_prompts(spark):
    from millrace.functions import prompts

    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + b"0000"

    sig, long = b"\x89PNG\r\n\x1a\n", "a long prompt that has well over forty characters in it"
    graph = '{"1": {"class_type": "CLIPTextEncode", "inputs": {"text": " %s "}, "_meta": {"title": "%s"}}, "2": 5}'
    files = [
        (sig + chunk(b"tEXt", b"parameters\0" + long.encode() + b"Negative prompt: x"), long), (sig + chunk(b"tEXt", b"broken") + chunk(b"tEXt", b"parameters\0short"), None), (sig + chunk(b"IEND", b"") + chunk(b"tEXt", b"parameters\0" + long.encode()), None),
        (sig + chunk(b"tEXt", b"prompt\0" + (graph % ("cat", "Negative")).encode()), None), (sig + chunk(b"iTXt", b"workflow\0\0\0en\0w\0" + (graph % ("câ", "any")).encode()), "câ"), (sig + b"\0\0", None), (b"no png", None), (None, None),
    ]
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(files)], "i int, content binary")
    assert [r[1] for r in df.select("i", prompts.png_text_prompt("content")).orderBy("i").collect()] == [e for _, e in files]
    two = '{"1": {"class_type": "CLIPTextEncode", "inputs": {"text": "a"}}, "2": {"class_type": "CLIPTextEncode", "inputs": {"text": "b {"}, "_meta": {"title": "My Positive"}}, "3": {"class_type": "CLIPTextEncode", "inputs": {"text": ["4", 0]}, "_meta": {"title": "positive"}}, "4": {}}'
    texts = [('x "prompt": ' + two.replace("{\"}", "\"}"), "b"), ('"prompt": [1]', None), ("'prompt': " + graph % ("it\\'s", "any"), "it's"), ('x "prompt": ' + graph % ("cat", "positive"), "cat"), ('"prompt": {broken}', None), ('"prompt": none', None), ("nothing", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    assert [r[1] for r in df.select("i", prompts.yaml_prompt("t")).orderBy("i").collect()] == [e for _, e in texts]
    posts = [(None, ""), ("short", "short"), ("see " + "{a{" + "b" * 60 + "}} {c}", "{a{" + "b" * 60 + "}}"), ("open { and never closed prompt: go", "go"), ("so <Role>be kind</Role> to all of them", "<Role>be kind</Role>"), ("exactly twenty-one ch", ""), ("x" * 41, "x" * 41)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(posts)], "i int, t string")
    assert [r[1] for r in df.select("i", prompts.prompt_of_post(F.col("t"))).orderBy("i").collect()] == [e for _, e in posts]


def test_attachments_by_name_and_wide_ones(spark):
    from millrace.sources import feeds

    files = [("a", None, "a.png", 4000, 300), ("b", "image/png", "b", 4000, 300), ("c", "image/png", "c.png", 2048, 2048), ("d", "text/plain", "d.txt", 1, 1), ("e", None, "e.jpg", None, None)]
    value = json.dumps({"id": "1", "content": "said", "attachments": [{"url": f"u/{u}", "content_type": t, "filename": n, "width": w, "height": h} for u, t, n, w, h in files]})
    got = feeds.discord_messages(spark.createDataFrame([(value,)], "value string")).collect()
    assert sorted(r.key for r in got) == ["1_u/a", "1_u/b", "1_u/e"]


def test_entry_without_the_llm_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("millrace", "__spark_entry__.py"):
        source, target = os.path.join(root, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, target)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'f8_list_items' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_a_library_that_breaks_on_import_hides_its_queries_only(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "millrace"), tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    (tmp_path / "millrace/llm").mkdir()
    (tmp_path / "millrace/llm/__init__.py").write_text("")
    (tmp_path / "millrace/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_sets_of_keys(spark):
    from millrace.operators import sets

    one = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "path string, n int")
    two = spark.createDataFrame([("b", 2), (None, 3), ("c", 4)], "path string, n int")
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(sets.stale_paths(one, two)) == ["a"]
    assert paths(sets.known_keys([one, two], ["path"])) == ["a", "b", "c"]
    assert paths(sets.not_seen(two, one, ["path"])) == ["c"]
    assert paths(sets.in_both(one, two, ["path"])) == ["b"]
    assert sets.not_seen(two, one, ["path", "n"]).count() == 1
    both = sets.union_feeds([one, two.drop("n")])
    assert both.count() == 7 and both.filter("n IS NULL").count() == 3
    assert sets.stale_paths(one.limit(0), two).count() == 0 and sets.stale_paths(one, two.limit(0)).count() == 2
