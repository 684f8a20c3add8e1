"""Licence scans by ordered signature rules, gated by keywords, with overlaps resolved by priority and containment.

1. A text becomes its words, A-Z lower-cased, joined by single spaces.  The words that are keywords of rules are picked out; a text without any, which
   is most of them, is searched by no pattern, and another only by the rules of its keywords.
2. Each rule finds its matches from left to right without overlaps; a match is an interval of words.
3. A match that lies inside one of a higher priority is suppressed, and so is one that lies inside a longer one of the same priority, or in an equal one of an
   earlier rule.  Matches that overlap in part both stay.
4. BASE phrases are rules too, before all others; every place of theirs counts, and none is suppressed.

The score is the confidence of the surest match that stays: 1 for a base phrase or wording of a licence itself, less for names and hints; 0 without any.

Defined cases: a null text counts as empty, with 0 words, empty labels, null places and score 0; ties are resolved by the rules' order; repeated rows
get equal results; very long texts are searched in pieces with LOOKAHEAD words of the next one, and no match is longer; an empty table gives no
rows; further columns are ignored, and ``with_licenses`` keeps them as one column, ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.license_rules import RULES
from millrace.llm.words import batches_of, word_pieces
from millrace.session import table

#: Phrases with their labels and keywords, of priority 0.
BASE = (("under the mit license", "mit", "mit"), ("apache license version 2", "apache-2", "apache"), ("cc by nc", "cc-by-nc", "nc"))
CONFIDENCE = (1.0, 1.0, 0.95, 0.85, 0.7, 0.4)
#: More words than any pattern can match; a test holds the rules to it.
LOOKAHEAD = 256


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: bytes
    pattern: re.Pattern


class Found(NamedTuple):
    """A match: words ``start`` to before ``end``, found by rule number ``rule``."""

    start: int
    end: int
    rule: int


def rule(priority: int, label: str, keyword: str, pattern: str) -> Rule:
    return Rule(priority, label, keyword.encode(), re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode()))


@lru_cache
def rules() -> tuple[Rule, ...]:
    """BASE and RULES in order."""
    lines = [line.split(" | ", 3) for line in RULES.strip().splitlines()]
    base = (rule(0, label, keyword, phrase) for phrase, label, keyword in BASE)
    return (*base, *(rule(int(p), label.strip(), keyword.strip(), pattern.strip()) for p, label, keyword, pattern in lines))


@lru_cache
def _by_keyword() -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for k, r in enumerate(rules()):
        out.setdefault(r.keyword, []).append(k)
    return out


def _windows(text: bytes, ahead: int) -> Iterator[tuple[list[bytes], int]]:
    """Pieces of a text's words, each with up to ``ahead`` words of what follows, and how many words are its own."""
    held: list[bytes] = []
    for words in word_pieces(text):
        if len(held) > ahead and len(words) >= ahead:
            yield held + words[:ahead], len(held)
            held = words
        else:  # a short piece can't lend enough words
            held = held + words
    yield held, len(held)


def matches(text: bytes, ahead: int = LOOKAHEAD) -> tuple[int, list[Found]]:
    """(words of the text, matches of all rules)."""
    by_keyword, all_rules = _by_keyword(), rules()
    at, out, free = 0, [], {}  # free: the first word that the last match of a rule leaves
    for words, own in _windows(text, ahead):
        keys = by_keyword.keys() & set(words)
        if keys:
            line = b" ".join(words)
            starts = np.cumsum([0, *(len(w) + 1 for w in words)])
            for k in sorted(k for key in keys for k in by_keyword[key]):
                begin = max(free.get(k, 0) - at, 0)
                if begin >= len(words):
                    continue
                for m in all_rules[k].pattern.finditer(line, int(starts[begin])):
                    first = int(np.searchsorted(starts, m.start()))
                    if first >= own:
                        break
                    last = int(np.searchsorted(starts, m.end(), "right"))
                    out.append(Found(at + first, at + last, k))
                    free[k] = at + last
        at += own
    return at, out


def _inside(intervals: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which intervals (start, end) lie inside one of the others."""
    if not len(others):
        return np.zeros(len(intervals), bool)
    others = others[np.argsort(others[:, 0], kind="stable")]
    reach = np.maximum.accumulate(others[:, 1])
    before = np.searchsorted(others[:, 0], intervals[:, 0], "right") - 1
    return (before >= 0) & (reach[np.maximum(before, 0)] >= intervals[:, 1])


def resolved(found: list[Found]) -> list[Found]:
    """The matches that stay, by start; see 3 and 4 above."""
    kept: list[Found] = []
    by_priority: dict[int, list[Found]] = {}
    for f in found:
        by_priority.setdefault(rules()[f.rule].priority, []).append(f)
    for priority in sorted(by_priority):
        level = sorted(by_priority[priority], key=lambda f: (f.start, -f.end, f.rule))
        if priority:
            reach, free = -1, []
            for f in level:  # an interval inside another starts after it, or equals it and has the later rule
                if f.end > reach:
                    free.append(f)
                    reach = f.end
            covered = _inside(np.array([f[:2] for f in free]), np.array([f[:2] for f in kept]).reshape(-1, 2))
            level = [f for f, c in zip(free, covered, strict=True) if not c]
        kept += level
    return sorted(kept)


def summary(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    n_words, found = matches(text)
    if not found:
        return n_words, 0, None, None, "", "", 0.0
    kept, every = resolved(found), rules()
    base = [f for f in kept if not every[f.rule].priority]
    labels = lambda fs: ",".join(sorted({every[f.rule].label for f in fs}))
    first, last = (base[0].start, max(f.start for f in base)) if base else (None, None)
    return n_words, len(base), first, last, labels(base), labels(kept), max(CONFIDENCE[every[f.rule].priority] for f in kept)


def _per_text(df: DataFrame, answer, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """``df (text, ...)`` with ``text`` replaced by the fields that ``answer`` gives for its bytes."""
    rest = [c for c in df.columns if c != "text"]

    def run(frames):
        for batch in frames:
            for row, texts in batches_of(batch.column("text")):
                part = batch.slice(row, len(texts))
                cols = list(zip(*map(answer, texts), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(v, t) for v, (_, t) in zip(cols, fields, strict=True))], [*rest, *(n for n, _ in fields)])

    kept = ", ".join(f"{c} {t}" for c, t in df.dtypes if c != "text")
    return df.mapInArrow(run, f"{kept}, {schema}")


_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))


def with_licenses(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs``), ``n_words`` and ``licenses``: the matches that stay, as (start, end, label, priority) by start."""

    def answer(text: bytes):
        n, found = matches(text)
        return n, [dict(start=f.start, end=f.end, label=rules()[f.rule].label, priority=rules()[f.rule].priority) for f in resolved(found)]

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return _per_text(rows, answer, [("n_words", pa.int64()), ("licenses", _MATCHES)], "n_words long, licenses array<struct<start:long,end:long,label:string,priority:int>>")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, name = pa.int64(), pa.string()
    fields = [("n_words", whole), ("n_base", whole), ("first_word", whole), ("last_word", whole), ("base_labels", name), ("labels", name), ("score", pa.float64())]
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return _per_text(table(spark, sf_dir, "documents").select("doc_id", "text"), summary, fields, schema)
