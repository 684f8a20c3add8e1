"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import html, imatch, langid, minhash, mixing, packing, pii, sstable, substrings, tokenization, vectors

SMALL = "/root/testdata/sf0.001/documents.parquet"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, size int, score double, copies int, row string, spans string, node int"
ODD = [
    (1, "one two three four five six", "en", "a", 27, "x", 1), (1, "one two three four five six", "en", "a", 27, "x", 1), (2, "one two three four five six", "en", None, 27, None, 2),
    (None, None, None, None, None, None, None), (3, "", "en", "b", 0, "y", 3), (4, "... 12", "de", "b", 6, "z", 4), (1, "other words under the same id", "en", "a", 30, "x", 5), (5, "é" * 3000, "fr", "c", 3000, "q", 6),
]
ODD = [(*r, 0.5, 1, "r", "s", 7) for r in ODD]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SMALL)


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(SMALL).to_pylist()}


# ---- tokens ----


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piece_tokenizer_equals_the_library(texts, name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    own = tokenization.PieceTokenizer.of(public_tokenizers.path(name))
    for t in [*texts.values(), "a   b\n\n  c", "it's 'Sad ''s Don'T", "<|endoftext|> x", "ΑΣ İ ﬁ", "\xa0\x85\x1c", "日本", "", " "]:
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_strings_get_the_ids_of_an_unmodified_library(spark, tmp_path, name):
    library, path = Tokenizer.from_file(public_tokenizers.path(name)), public_tokenizers.path(name)
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|EndOfText|>", "plain"]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [tokenization.PieceTokenizer.of(path, specials=True).encode(t).tolist() for t in texts] == expected
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.length for r in packing.packed(df, path).collect()} == {i: len(e) + 1 for i, e in enumerate(expected)}
    sstable.write_shards(df, path, f"file://{tmp_path}/t")
    assert [sstable.lookup(spark, f"file://{tmp_path}/t", i)[0].tolist()[:-1] for i in range(3)] == expected


def laid_out(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by)


def test_packing(spark, docs, odd, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for doc_id, text in texts.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], np.uint32)
        assert sorted(got[doc_id]) == [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    total = sum(r.length for r in rows)
    assert laid_out(rows) <= 1.02 * total / 2048 + 2
    assert laid_out(packing.packed(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()) >= 1
    assert packing.packed(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.geometric(1 / [30, 400, 1500, 5000][seed], 3000))
    counts = np.bincount(lengths, minlength=2049)
    runs = packing.plan(counts)
    for length in np.flatnonzero(counts):
        first = runs[runs[:, 0] == length][:, 1]
        assert first[0] == 0 and (np.diff(first) > 0).all() and first[-1] < counts[length]


def test_sstable_round_trip(spark, tmp_path, docs, odd, texts):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(tokenizer)
    folder = f"file://{tmp_path}/t"
    manifest = sstable.write_shards(docs, tokenizer, folder, shard_bytes=30_000)
    assert manifest.count() > 2
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in sstable.with_starts(sstable.read_shards(spark, folder), manifest).collect()}
    at = 0
    for doc_id in sorted(texts):
        ids = np.array(library.encode(texts[doc_id], add_special_tokens=False).ids + [1], np.uint32)
        assert got[doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert sstable.lookup(spark, folder, 7)[0].tolist() == library.encode(texts[7], add_special_tokens=False).ids + [1]
    assert sstable.lookup(spark, folder, 10**9) == []
    for name, frame in (("odd", odd), ("none", docs.limit(0))):
        m = sstable.write_shards(frame, tokenizer, f"file://{tmp_path}/{name}")
        assert sstable.with_starts(sstable.read_shards(spark, f"file://{tmp_path}/{name}"), m).count() == frame.count()


# ---- mixing ----


def test_mixing(spark, odd):
    rows = [(i, " ".join(["w"] * (i % 40)), "en", "abc"[0 if i % 3 else i % 2 + 1], 0, "", 0, 0.5, 1, "r", "s", 7) for i in range(900)]
    out = mixing.with_copies(mixing.measured(spark.createDataFrame(rows, DOCS))).collect()
    taken, target, size = defaultdict(int), {}, {}
    for r in out:
        taken[r.source] += r.copies * r.size
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.copies <= 2
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 2 * 40
    again = mixing.with_copies(mixing.measured(spark.createDataFrame(rows, DOCS).repartition(7))).collect()
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in again)
    assert mixing.expand(odd).columns == odd.columns
    assert mixing.with_copies(mixing.measured(odd)).count() == len(ODD)
    assert mixing.with_copies(mixing.measured(odd.limit(0))).count() == 0


# ---- personal data ----

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def spans_by_python(text):
    tests = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": luhn, "phone": lambda s: 9 <= sum(c.isdigit() for c in s) <= 15}
    found = sorted((m.start(), k, m.end()) for k, (n, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if tests[n](m[0]))
    return ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in found)


def test_fixed_spans_equal_python(spark):
    rnd = random.Random(1)
    hard = ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "4111 1111-1111 1111 4111111111111111-", "+1 (988) 555-2485 +49 30 1234567890123456789", "é😀 a.b@c.d..e@f.g", "x" * 30000 + "@" + "a." * 9000 + "b", "1." * 20000 + "1", "5 " * 20000 + "4", None, "", "+1" + "(" * 9000 + "2"]
    hard += ["".join(rnd.choice("1234567890+ -.@ab()é") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.with_spans(df).select("doc_id", pii.joined("spans")).collect()}
    assert got == {i: spans_by_python(t or "") for i, t in enumerate(hard)}


def test_pii_of_a_very_long_text(spark):
    """20,000 spans of one kind among identifiers, some of which overlap others; positions and mask against a walk."""
    parts = [["a%d@x.org" % (i % 9), "10.0.%d.7" % (i % 250), "zz9-%d" % i, "+49 30 1234567"][i % 4] for i in range(40_000)]
    text = "é ".join(parts)
    at, spans, masked = 0, [], []
    kinds = {0: "email", 1: "ip", 3: "phone"}
    for i, p in enumerate(parts):
        end = at + len(p)
        if i % 4 in kinds:
            spans.append(f"{kinds[i % 4]}:{at}:{end}")
        masked.append(f"[{kinds[i % 4].upper()}]" if i % 4 in kinds else p)
        at = end + 2
    df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    (row,) = pii.with_spans(df).select(pii.joined("spans").alias("spans")).collect()
    assert row.spans.split(",") == spans
    (row,) = pii.mask(df).collect()
    assert row.text == "é ".join(masked)
    assert row.n_chars == len(row.text)


def test_contexts_find_unseen_identifiers(spark, odd):
    rows = [(i, f"see mail: u{i}@ex.org for more of case no 12 words") for i in range(30)] + [(100, "send mail: agent47x today"), (101, "plain room 47xx9912 words")]
    rows += [(200 + i, f"key = {hashlib.sha1(b'%d' % i).hexdigest()}") for i in range(8)] + [(210, "key = hunter2x"), (211, "commit " + hashlib.sha1(b"z").hexdigest())]
    got = {r.doc_id: r.spans for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined("all_spans").alias("spans")).collect()}
    assert got[100] == "email:11:19" and got[101] == "" and got[3] == "email:10:19"
    assert got[200] == "secret:6:46" and got[210] == "secret:6:14" and got[211] == ""
    assert pii.mask(odd).columns == odd.columns and pii.mask(odd).count() == len(ODD)
    assert pii.with_spans(odd.limit(0)).count() == 0


def test_a_field_with_a_third_of_known_values_gives_the_others(spark):
    long = "Q7" + "x" * 300
    rows = [(i, f"contact token: u{i}@ex.org") for i in range(10)] + [(100 + i, f"contact token: AB{i}X{i * 7}Q") for i in range(19)] + [(150, f"contact token: {long}")]
    rows += [(200 + i, f"built on date: 2024-01-{10 + i}") for i in range(9)] + [(300 + i, f"part: {'u%d@ex.org' % i if i < 5 else 'item%d' % i}") for i in range(300)]
    got = {r.doc_id: r.n for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("all_spans").alias("n")).collect()}
    assert all(got[i] == 1 for i, _ in rows if i < 200) and all(got[i] == 0 for i, _ in rows if 200 <= i < 300 or i >= 305)


def found_by_python(edges):
    """The graph's scoring, over {(pattern, m): k}."""
    by, seeds, found = defaultdict(list), {}, {}
    for (p, m), k in edges.items():
        by[p].append((m, k))
        if k >= 0:
            seeds[m] = max(k, seeds.get(m, -1))
    while True:
        known, sure = {**found, **seeds}, {}
        for p, members in by.items():
            kinds = [known[m] for m, _ in members if m in known]
            pos, neg, n, label = len(kinds), sum(k == pii.OTHER and m not in known for m, k in members), len(members), p[0] == "L"
            confidence = pos / ((pos + neg if label else n) + 1)
            if pos >= pii.LEAST_KNOWN and confidence >= pii.LEAST_CONFIDENCE and (not label or pos / n * np.log2(pos) >= pii.LEAST_GAIN):
                most, kind = max((kinds.count(k), k) for k in range(len(pii.ALL_KINDS)))
                sure[p] = (confidence * (1 if label else pii.RUNNING), kind if most >= pii.LEAST_SHARE * pos else pii.ID)
        doubt, best = defaultdict(lambda: 1.0), {}
        for (p, m), k in edges.items():
            if p in sure and (k < 0 or k == pii.SECRET):
                doubt[m] *= 1 - sure[p][0]
                best[m] = max(best.get(m, (0, 0, "")), (*sure[p], p))
        new = {m: best[m][1] for m in doubt if 1 - doubt[m] >= pii.LEAST_SCORE}
        if len(new) <= len(found):
            return new
        found = new


@pytest.mark.parametrize("seed", [1, 2])
def test_scoring_equals_python(spark, seed):
    rnd = random.Random(seed)
    words, sorts = ["red", "sea", "go"], {}
    rows = []
    for _ in range(900):
        m = f"v{rnd.randrange(120)}"
        k = sorts.setdefault(m, rnd.choice([0, 0, 1, 3, 4, -1, -1, -2]))
        label = {0: "mail: ", 1: "host = ", 3: "call: ", 4: "key: "}.get(k, "no: ") if rnd.random() < 0.8 else rnd.choice(["mail: ", "key: ", "id# "])
        rows.append((m, k, label if rnd.random() < 0.6 else f"{rnd.choice(words)} {rnd.choice(words)} ", f"{rnd.choice(words)} {'x' if k < 0 else 'y'}"))
    df = spark.createDataFrame(rows, "m string, k int, left string, right string")
    edges = {(r.pattern, r.m): r.k for r in pii.graph(df).collect()}
    got = {r.m: r.kind for r in pii.discovered(df).collect()}
    assert got and got == found_by_python(edges)


# ---- near-duplicates ----


def sets_by_python(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_minhash_equals_brute_force(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"z{rnd.randrange(300)}" for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(300, "A b"), (301, "a  B"), (302, None), (303, " "), (5, rows[9][1])]
    sets = [sets_by_python(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= 85 * len(x | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    expected = sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.groups(df).collect()) == expected


def test_buckets_in_blocks_bring_every_two_together(spark):
    rows = [(b, i) for b, n in ((1, 50), (2, 9), (3, 1)) for i in range(n)]
    a, b = minhash.in_blocks(spark.createDataFrame(rows, "band long, node long"), 4)
    got = sorted((r.a_band, r.a_node, r.b_node) for r in a.join(b, ["_band", "_i", "_j"]).filter("a_node < b_node").collect())
    assert got == sorted((band, i, j) for band, i in rows for other, j in rows if band == other and i < j)
    assert a.groupBy("_band", "_i", "_j").count().agg(F.max("count")).first()[0] < 15


def test_keep_one(spark, odd):
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [g for g in got if g[2].startswith("one")] == [(True, 1, "one two three four five six")]
    assert len(got) == len(ODD) - 2
    assert minhash.keep_one(odd.limit(0)).count() == 0


def test_the_pipeline_drops_near_copies_from_80_percent(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(40):  # one changed word leaves 45 of 55 shingles
        w = [f"w{rnd.randrange(10**6)}" for _ in range(54)]
        rows += [(2 * i if i < 30 else None, " ".join(w)), (2 * i + 1 if i < 20 else None, " ".join([*w[:27], "new", *w[28:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, df, "").count() == 40
    assert minhash.keep_one(df).count() == 80
    assert minhash.most_bits(85) == minhash.MOST_BITS and 178 <= minhash.most_bits(80) <= 190


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[80:1080])  # similarity 0.852
    sketch = minhash.odd_sketches(minhash.samples(np.concatenate([a, b]), np.array([0, 1000, 2000])))
    bits = sum(int(x).bit_count() for x in sketch[0] ^ sketch[1])
    k, n = minhash.SAMPLES, 64 * minhash.SKETCH_WORDS
    assert abs(1 + n / (4 * k) * np.log(1 - 2 * bits / n) - 920 / 1080) < 0.08


# ---- repeated substrings ----


def removed_by_python(rows, length):
    seen = defaultdict(int)
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "seed", "group"), [(200, 64, 1024), (40, 16, 2), (40, 16, 1000)])
def test_substrings_equal_brute_force(spark, length, seed, group):
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(3000))
    rows = [(i, None if i == 3 else "") for i in range(5)]
    for i in range(50):
        a = rnd.randint(0, 2500)
        x = list(base[a : a + rnd.randint(20, 700)])
        for _ in range(rnd.randint(0, 6)):
            x[rnd.randrange(len(x))] = "é"
        rows.append((10 + i, "".join(rnd.choice("klmnop") for _ in range(rnd.randint(0, 100))) + "".join(x)))
    rows += [(200, "ab" * 300), (201, "x" * 250), (202, "x" * 200), (203, "x" * 199), (10, rows[20][1]), (None, base[:300]), (None, base[100:500]), (300, base), (300, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in substrings.removed(df, length=length, seed=seed, group=group).drop("kept").collect()), key=repr)
    assert got == removed_by_python(rows, length)
    assert substrings.removed(df.limit(0)).count() == 0


# ---- vectors ----


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + rng.standard_normal(16) * 0.12).tolist()) for i in range(240)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, [0.0] * 16), (504, [float("nan")] + [1.0] * 15), (505, [1.0, None]), (506, [1.0, 0.0]), (507, [2.0, 0.1]), (508, [float("inf")] * 16)]
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j, w in good.items() if j != i and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9} for i, v in good.items()}
    component = {i: i for i, _ in rows}
    for _ in rows:
        for i, near in links.items():
            component[i] = min([component[i], *(component[j] for j in near)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.links_and_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (len(links.get(i, ())), component[i], component[i] == i) for i, _ in rows}


def test_dense_groups_keep_all_links(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(64) + rng.standard_normal(64) * [1e-6, 1e-3][i % 2]).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for how in ({}, {"bucket": 100, "block": 400}):
        got = vectors.links_and_components(df, **how)
        assert got.groupBy("n_links", "component_id").count().collect() == [(2999, 0, 3000)]


def test_vectors_of_empty_and_wide_tables(spark):
    wide = "vec_id long, embedding array<double>, node long, key long, part long, h1 long, n_links string"
    assert vectors.links_and_components(spark.createDataFrame([], wide)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 2, 3, 4, "x"), (1, [1.0, 0.0], 1, 2, 3, 4, "x"), (None, [2.0, 0.1], 1, 2, 3, 4, "y")], wide)
    assert sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in vectors.links_and_components(df).collect()) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]


def test_passes_follow_from_the_number_of_nodes(spark):
    assert vectors.plan(0)[1] == 1
    for n in (500, 10**5, 10**6, 10**8):
        passes, signs = vectors.plan(n)
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** signs) ** passes <= vectors.MISS and n / 2**signs <= vectors.BUCKET
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1500):  # pairs at cosine 0.9
        x, y = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        rows += [(2 * i, x.tolist()), (2 * i + 1, (0.9001 * x + (1 - 0.9001**2) ** 0.5 * y).tolist())]
    got = vectors.links_and_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), bucket=50, block=40)
    assert got.filter("n_links != 1 OR component_id != vec_id - vec_id % 2").count() <= 6


def test_the_registered_query_finds_the_links_of_every_fiftieth_vector(spark):
    """Recall of op4 as registered, against all pairs of the table."""
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, m = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist())
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {int(i): int((m @ m[k] >= 0.9).sum()) - 1 for k, i in enumerate(ids) if i % 50 == 0}
    got = {r.vec_id: r.n_links for r in vectors.op4_vectors(spark, "/root/testdata/sf0.1").collect() if r.vec_id % 50 == 0}
    assert got.keys() == want.keys()
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.9 * sum(want.values())


# ---- languages ----


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype("f8") for k, v in langid.start_model(3, rng).items()}
    x, valid, y = rng.integers(0, 256, (10, 6)), np.ones((10, 6)), rng.integers(0, 3, 6)
    _, g = langid.loss_and_gradients(p, x, valid, y)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-3
        down[k][i] -= 1e-3
        slope = (langid.loss_and_gradients(up, x, valid, y)[0] - langid.loss_and_gradients(down, x, valid, y)[0]) / 2e-3
        assert abs(slope - g[k][i]) < 1e-3 * max(1, abs(g[k][i]))


def test_every_language_is_learned(spark):
    rows = [(i, " ".join([chr(0x4E00 + 40 * (i % 80) + i // 80 % 5) * 8] * 3), f"l{i % 80:02}") for i in range(800)] + [(7, "same text", "l07")] * 50
    languages, parts, sizes, y = langid.training_segments(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == [f"l{k:02}" for k in range(80)] and set(y.tolist()) == set(range(80)) and len(parts) <= 2 * 800 * 4 / 5 + 60


def sigmoid_free_forward(p, data):
    """Position probabilities of one segment, number by number."""
    H = langid.HIDDEN
    clip = lambda v, lo, hi: min(max(v, lo), hi)
    states = {}
    for side, order in (("f", range(len(data))), ("b", range(len(data) - 1, -1, -1))):
        h = [0.0] * H
        for t in order:
            ux = [float(p["wx" + side][k][data[t]]) for k in range(3 * H)]
            uh = [sum(float(p["u" + side][k][j]) * h[j] for j in range(H)) for k in range(3 * H)]
            z = [clip(ux[k] + uh[k], 0, 1) for k in range(H)]
            r = [clip(ux[H + k] + uh[H + k], 0, 1) for k in range(H)]
            new = [clip(ux[2 * H + k] + r[k] * uh[2 * H + k], -1, 1) for k in range(H)]
            h = [z[k] * h[k] + (1 - z[k]) * new[k] for k in range(H)]
            states[side, t] = h
    out = []
    for t in range(len(data)):
        s = states["f", t] + states["b", t]
        e = np.exp([sum(float(w) * x for w, x in zip(row, s, strict=True)) + float(c) for row, c in zip(p["v"], p["c"], strict=True)])
        out.append(e / e.sum())
    return out


def test_pooled_equals_a_scalar_network():
    p = langid.start_model(3, np.random.default_rng(1))
    texts = [b"x", "kurz und gr\u00fcn".encode() * 12, bytes(range(97, 123)) * 5]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = langid.pooled(p, data, offsets)
    for row, raw in zip(got, texts, strict=True):
        # A segment is read to its full width; what lies behind the text's end is zeros for the backward direction.
        parts = [raw[a : a + langid.SEGMENT] for a in range(0, len(raw), langid.SEGMENT)]
        probs = [q for part in parts for q in sigmoid_free_forward(p, part + bytes(langid.SEGMENT - len(part)))[: len(part)]]
        assert np.allclose(row, np.mean(probs, axis=0), atol=1e-4)


def test_languages_on_the_held_out_fold(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, model = langid.fitted(docs)
    rows = langid.predict(docs.withColumn("held_out", langid.held_out(F.col("doc_id"))), languages, model, "doc_id", "lang", "held_out").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(odd, languages, model, "doc_id", "text").collect()}
    assert got[(None, None)] == got[(3, "")] == got[(4, "... 12")] == ("und", 0.0)
    assert langid.keep_identified(odd).columns == odd.columns
    assert langid.keep_identified(odd).count() == len(ODD) - 3
    assert langid.predict(odd, [], None, "doc_id").filter("lang_pred != 'und'").count() == 0
    assert langid.keep_identified(odd.limit(0)).count() == 0


# ---- pages ----


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="no-sidebar"><div class="content-sidebar"><article><header><h1>T &eacute;</h1></header><p>a<br>b  c<div class=ad>x</div><p>d</article></div><div id="comments"><article>no</article></div><aside>no</aside><footer>f</footer>', "T é\na b c\nd"),
        ('<p>x<script>var a="</p>"</script>y<!-- c --> z', "xy z"),
        ("", ""),
        ('<article><p>hi <b>u</b>n<section class="comment-list"><p>c</p></section><p title="a>b">q', "hi un\nq"),
        ("text only &lt;b&gt;", "text only <b>"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<main><ul><li>1<li>2</ul></main><nav>n", "1\n2"),
        ('<main><p>the long story that is told here</p><article>teaser</article></main>', "the long story that is told here\nteaser"),
        ('<article><div class="commentary">a</div><div id="promoter-profile">b</div><p class="share price">c</p><div class="comments">no</div></article>', "a\nb\nc"),
        ('<article><h2 id="how-to-search">a</h2><section id="related-work"><p>b</section><h3 class="social-history">c</h3><p>d <span id="notice-period" class="notice">e</span></p><div class="article-share-price">f</div><div class="ad">no</div>', "a\nb\nc\nd e\nf"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(html.parse(page)) == text


def test_site_templates(spark):
    rows = [(i, "http://a.org/x", f"<title>t{i}</title><article><p>own {i}</p><div><p>Read our great offer</p></div></article>") for i in range(12)] + [(50 + i, "http://b.org/", "<title>same</title><article><p>copied text</p></article>") for i in range(15)] + [(90, None, None)]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("own 3", 5) and got[50] == ("copied text", 11) and got[90] == ("", 0)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_on_a_tenth_of_a_large_host_and_under_one_title(spark):
    rows = [(i, "http://a.org/x", f"<title>t{i}</title><article><p>own {i}</p>{'<div><p>Join us</p></div>' if i % 10 == 0 else ''}</article>") for i in range(120)]
    rows += [(200 + i, "http://b.org/", f"<title>Site</title><article><h1>head {i}</h1><p>text {i}</p><div><p>Join us</p></div></article>") for i in range(12)]
    df = spark.createDataFrame([*rows, (300, None, None)], "page_id long, url string, html string")
    for how in ({}, {"most_listed": 0}, {"most_broadcast": 0}):
        got = {r.page_id: r.text for r in html.extract(df, **how).collect()}
        assert got == {i: f"own {i}" for i in range(120)} | {200 + i: f"head {i}\ntext {i}" for i in range(12)} | {300: ""}


def test_templates_equal_a_count_in_python(spark):
    rnd = random.Random(8)
    line = "A line that an author likes."
    rows = []
    for i in range(160):
        host = "big.org" if i < 100 else f"h{i % 12}.org"
        links = "".join(f"<li><a href=/{rnd.random()}>{rnd.choice('abc')}{i}</a></li>" for _ in range(rnd.randint(2, 5)))
        box = f"<div><div>Call {i} now</div></div>" if i % 4 else ""  # no tag or class tells it
        body = f"<h1>head {i}</h1><p>own {i}</p>" + (f"<p>{line}</p>" if i % 3 else "")
        rows.append((i, f"http://{host}/{i}", f"<title>t{i}</title><body><div><ul>{links}</ul></div>{box}" + (f"<article>{body}{box}</article>" if i % 2 else f"<div>{body}</div>")))
    pages, seen = defaultdict(set), defaultdict(set)
    for i, url, source in rows:
        host, page = url.split("/")[2], html.parse(source)
        pages[host].add(i)
        for h in {*page.hashes, *page.shapes} - {0}:
            seen[host, h].add(i)
    keep = defaultdict(set)
    for (host, h), at in seen.items():
        if len(at) >= min(10, max(3, -(-len(pages[host]) // 2))):
            keep[host].add(h)
    expected = {i: html.main_text(html.parse(source), frozenset(keep[url.split("/")[2]])) for i, url, source in rows}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == expected
    assert expected[1] == f"head 1\nown 1\n{line}" and "Call" not in expected[98] and expected[99] == "head 99\nown 99"
    odd = spark.createDataFrame([(1, "http://a.org", "<p>x", "h", [1])] * 2 + [(None, None, None, None, None), (2, "", "y " * 600_000, "", [])], "page_id long, url string, html string, _host string, _templates array<int>")
    assert sorted((r.page_id or 0, r.n_chars) for r in html.extract(odd).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1_199_999)]


# ---- fingerprints ----


def test_edited_texts(spark, odd):
    df = odd.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    got = imatch.with_edited(df).collect()
    assert len(got) == len(ODD)
    order = [None, 1, 2, 3, 4, 5]
    least = {d: min(r[1] or "" for r in ODD if r[0] == d) for d in order}
    for r in got:
        nxt, half = order[(order.index(r.id) + 1) % 6], len(r.text) // 2
        assert r.next_id == nxt and r.edited == r.text[: len(r.text) - half] + least[nxt][:half]
    lex = imatch.lexicon(imatch.band(df))
    prints = {r.text: r.f for r in imatch.with_fingerprint(df, "text", "f", lex).collect()}
    assert prints[""] == imatch.EMPTY * imatch.SUBSETS
    assert imatch.with_edited(df.limit(0)).count() == 0


def test_texts_of_a_million_characters(spark):
    rnd = random.Random(12)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(180_000))
    df = spark.createDataFrame([(1, long, "en", "a", len(long), "x"), (2, long, "en", "a", len(long), "x"), (3, "x" * 1_500_000, "en", "b", 1_500_000, "x")], "doc_id long, text string, lang string, source string, n_chars long, h string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert {r.size for r in mixing.measured(df).collect()} == {180_000, 1}
    lex = imatch.lexicon(imatch.band(df.select("text")))
    prints = {r.doc_id: r.f for r in imatch.with_fingerprint(df, "text", "f", lex).collect()}
    assert prints[1] == prints[2] != prints[3]
    assert {r.doc_id: r.n_removed for r in substrings.removed(df).collect()} == {1: len(long), 2: len(long), 3: 1_500_000}
    assert {r.doc_id: (r.component_id, r.kept) for r in minhash.groups(df).collect()} == {1: (1, True), 2: (1, False), 3: (3, True)}
    assert langid.predict(df, ["en"], langid.start_model(1, np.random.default_rng(0)), "doc_id").filter("lang_pred = 'en'").count() == 3
    sizes = {r.doc_id: r.n for r in packing.token_pieces(df, path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes[1] == sizes[2] > 180_000


# ---- the pipeline ----


def test_pipeline_stages(spark, odd):
    from millrace.session import stored

    docs = odd
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), "stage")
        assert docs.columns == odd.columns
        sizes.append(docs.count())
    assert sizes[:3] == [5, 3, 3]
    assert laid_out(stored(corpus_pipeline.STAGES[-1][1](spark, docs, ""), "stage").collect()) >= 1
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, ""), "stage")
        assert empty.count() == 0


def test_lexicon_keeps_terms_that_share_places(spark):
    rng = random.Random(4)
    inside = [f"{p:05x}{r:08x}" for p in (0, 1, 5, 77) for r in (0, 1, 2, 0x10000, 0x10001, 0x80000, 0xFFFFFFFF)]
    inside += [f"{0x40:05x}{(7 << 16) | r:08x}" for r in range(5)]
    outside = [f"{rng.randrange(100):05x}{rng.choice([0, 1, 3, 0x10000, 0x20001, rng.getrandbits(32)]):08x}" for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in {*inside, *outside}], "code string")
    lex = imatch.lexicon(spark.createDataFrame([(c,) for c in inside], "code string"))
    assert lex.rest
    assert {r.code for r in df.filter(lex.holds(F.col("code"))).collect()} == set(inside)
