"""License scans: rules against examples written out from them, intervals against brute force, and defined cases."""

import random
import re
import re._parser as sre

import pytest

from millrace.llm import licenses, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def examples(tree, most):
    """Strings that a parsed pattern matches: every branch and option up to ``most``; open words are ``x``."""
    outs = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            new = [chr(arg)]
        elif name in ("IN", "CATEGORY", "ANY"):
            new = [chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else chr(arg[0][1][0]) if str(arg[0][0]) == "RANGE" else "x"]
        elif name == "SUBPATTERN":
            new = examples(arg[-1], most)
        elif name == "BRANCH":
            new = [e for b in arg[1] for e in examples(b, most)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, sub = arg
            new = [e * n for n in {low, max(low, min(int(high), 2))} for e in examples(sub, most)]
        else:
            raise AssertionError(name)
        outs = [a + b for a in outs for b in new][:most]
    return outs


@pytest.mark.parametrize("k", range(len(licenses.rules())))
def test_rules_match_their_examples_and_need_their_keywords(k):
    rule = licenses.rules()[k]
    for text in examples(sre.parse(rule.pattern.pattern.decode()[len("(?<![^ ])(?:") : -len(")(?![^ ])")]), 60):
        text = " ".join(text.split())
        assert rule.keyword.decode() in text.split(), text
        assert rule.pattern.fullmatch(text.encode()), text
        assert len(text.split()) < licenses.LOOKAHEAD
        n, found = licenses.matches(f"Aa {text.upper()} zz".encode())
        assert n == len(text.split()) + 2
        assert licenses.Found(1, n - 1, k) in found or any(f.rule == k and f.start <= 1 < f.end for f in found), text


def test_open_repeats_stay_below_the_lookahead():
    for rule in licenses.rules():
        longest = sum(int(n) for n in re.findall(r"\{\d+,(\d+)\}", rule.pattern.pattern.decode())) + rule.pattern.pattern.count(b" ")
        assert longest < licenses.LOOKAHEAD


def plain_base(text):
    found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    places = [(i, label) for phrase, label, _ in licenses.BASE for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    return len(found), sorted(places)


def some_text(rng):
    parts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "GNU GPL v3", "cc by", "nc", "apache license", "under the", "mit license", "Mozilla Public License", "all rights reserved", "word", "É-9"]
    return " ".join(rng.choice(parts) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("seed", range(30))
def test_base_and_containment_equal_brute_force(seed):
    text = some_text(random.Random(seed))
    n_words, n_base, first, last, base_labels, labels, score = licenses.summary(text.encode())
    n, places = plain_base(text)
    assert (n_words, n_base) == (n, len(places))
    assert (first, last) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert base_labels == ",".join(sorted({p[1] for p in places}))
    assert set(base_labels.split(",")) - {""} <= set(labels.split(","))
    found, rules = licenses.matches(text.encode())[1], licenses.rules()

    def suppressed(f, g):
        mine, its = (rules[x.rule].priority for x in (f, g))
        inside = g.start <= f.start and f.end <= g.end
        same = g[:2] == f[:2]
        return mine > 0 and inside and (its < mine or (its == mine and (not same or g.rule < f.rule)))

    # Inside a match that is itself suppressed means inside the one that suppresses it.
    kept = sorted(f for f in found if not any(suppressed(f, g) for g in found))
    assert licenses.resolved(found) == kept
    assert labels == ",".join(sorted({rules[f.rule].label for f in kept}))
    assert 0 <= score <= 1
    assert bool(score) == bool(kept)


@pytest.mark.parametrize("seed", range(10))
def test_pieces_equal_the_whole_text(seed, monkeypatch):
    rng = random.Random(100 + seed)
    text = " ".join(some_text(rng) for _ in range(20)).encode()
    whole = licenses.matches(text, 30)
    monkeypatch.setattr(words.word_pieces, "__defaults__", (300,))
    assert len(list(words.word_pieces(text))) > 5
    assert (whole[0], sorted(whole[1])) == (licenses.matches(text, 30)[0], sorted(licenses.matches(text, 30)[1]))


def test_defined_cases(spark):
    rows = [(1, None, "r", 1), (2, "", "r", 1), (3, "Under the MIT licence. CC-BY-NC", "r", 1), (None, "Under the MIT License!", "r", 1), (None, "Under the MIT License!", "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n_words int")
    got = {r.row.doc_id: r for r in licenses.with_licenses(docs).collect()}
    assert got[1].n_words == got[2].n_words == 0
    assert got[1].licenses == []
    assert [(m.start, m.end, m.label) for m in got[3].licenses] == [(1, 4, "mit"), (4, 7, "cc-by-nc")]
    assert [(m.start, m.end, m.label, m.priority) for m in got[None].licenses] == [(0, 4, "mit", 0)]
    assert licenses.with_licenses(docs).count() == 5
    assert licenses.with_licenses(docs.limit(0)).count() == 0


def test_query_and_very_long_text(spark, tmp_path):
    long = "lorem ipsum " * 500_000 + "under the mit license " + "dolor " * 500_000 + "cc by nc"
    rows = [(1, long), (2, None), (3, "plain words"), (4, "gpl")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.op13_licenses(spark, str(tmp_path)).collect()}
    assert got == {1: (1_500_007, 2, 1_000_000, 1_500_004, "cc-by-nc,mit", "cc-by-nc,mit", 1.0), 2: (0, 0, None, None, "", "", 0.0), 3: (2, 0, None, None, "", "", 0.0), 4: (1, 0, None, None, "", "gpl", 0.4)}
