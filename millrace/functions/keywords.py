"""Keyword filters as column expressions: the query language, keyword lists and the topic gate."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words without signal in a topic, and the keywords two topic families add.
STOPWORDS = ("a", "an", "the", "of", "and", "or", "for", "with", "ai", "realistic", "real", "ultra", "generated", "style", "image", "images", "prompt", "prompts")
INFLUENCER = ("influencer", "instagram", "instagrammer")
INFLUENCER_ADDS = ("woman", "girl", "female", "model", "portrait", "selfie")
MAN = ("male", "man")
MAN_ADDS = ("man", "male", "guy", "portrait")

_LEXEME = re.compile(r'\s*(?:([()])|"([^"]*)(?:"|$)|([^\s()"]+))')


class _Malformed(ValueError):
    pass


def _lexemes(query: str) -> list[tuple[str, str]]:
    """(kind, text) with the OR that stands between two neighbouring operands put in."""
    out: list[tuple[str, str]] = []
    for m in _LEXEME.finditer(query.rstrip()):
        paren, quoted, word = m.groups()
        if paren:
            new = (paren, paren)
        elif word and word.lower() in ("and", "or", "not"):
            new = (word.lower(), word)
        else:
            new = ("term", word or quoted or "")
        if out and out[-1][0] in ("term", ")") and new[0] in ("term", "(", "not"):
            out.append(("or", ""))
        out.append(new)
    return out


def keyword_query(text: Column, query: str) -> Column:
    """AND, OR, NOT, parentheses and quotes over case-insensitive substrings.

    NOT binds before AND before OR; neighbours without an operator are alternatives; an
    unterminated quote runs to the end.  An empty query matches nothing, a malformed one everything.
    Precedence climbing builds one Column, so the whole query is a codegen filter."""
    items, at = _lexemes(query), 0
    if not items:
        return F.lit(False)
    hay = F.lower(text)
    binding = {"or": 1, "and": 2}

    def operand() -> Column:
        nonlocal at
        kind, value = items[at] if at < len(items) else ("end", "")
        at += 1
        if kind == "not":
            return ~operand()
        if kind == "(":
            inner = climb(1)
            if at >= len(items) or items[at][0] != ")":
                raise _Malformed
            at += 1
            return inner
        if kind != "term":
            raise _Malformed
        return hay.contains(value.lower())

    def climb(least: int) -> Column:
        nonlocal at
        left = operand()
        while at < len(items) and binding.get(items[at][0], 0) >= least:
            op = items[at][0]
            at += 1
            right = climb(binding[op] + 1)
            left = left & right if op == "and" else left | right
        return left

    try:
        found = climb(1)
        return found if at == len(items) else F.lit(True)
    except _Malformed:
        return F.lit(True)


def keyword_any(text: Column, words: list) -> Column:
    """Any of the trimmed, lower-cased words as a substring; blanks and non-strings are skipped."""
    hay = F.lower(text)
    hits = [hay.contains(w.strip().lower()) for w in words if isinstance(w, str) and w.strip()]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def as_query(raw: str) -> str | list[str]:
    """A setting's text as a query if it has query marks, else as a comma list."""
    raw = (raw or "").strip()
    if re.search(r'[()"]|\b(?:and|or|not)\b', raw, re.I):
        return raw
    return [w.strip() for w in raw.split(",") if w.strip()]


def _matches(text: Column, words) -> Column | None:
    """None where there is nothing to match."""
    if isinstance(words, str):
        return keyword_query(text, words) if words.strip() else None
    return keyword_any(text, words) if any(isinstance(w, str) and w.strip() for w in words or ()) else None


def topic_filter(df: DataFrame, context: str, prompt: str, required=(), banned=(), hints=(), min_length: int = 40, require_prompt: bool = True) -> DataFrame:
    """Add ``ok`` and ``reason``: the first failing check in order, else ``ok``."""
    text = F.trim(F.coalesce(F.col(prompt), F.lit("")))
    both = F.concat(F.coalesce(F.col(context), F.lit("")), F.lit("\n"), text)
    reason = F.when(F.lit(False), "")
    if require_prompt:
        reason = reason.when(F.length(text) < min_length, F.concat(F.lit("short prompt: "), F.length(text), F.lit(f" of {min_length} characters")))
    if (hit := _matches(both, banned)) is not None:
        reason = reason.when(hit, "holds a banned term")
    if (hit := _matches(both, required)) is not None:
        reason = reason.when(~hit, "lacks the required terms")
    if require_prompt and (hit := _matches(text, hints)) is not None:
        reason = reason.when(~hit, "lacks any hint")
    return df.withColumn("reason", reason.otherwise("ok")).withColumn("ok", F.col("reason") == "ok")


def auto_keywords(topic: Column) -> Column:
    """The words of a topic that carry signal, in order, and those its family adds."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(topic), F.lit("([a-z][a-z-]+)"))), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    none = F.array().cast("array<string>")

    def adds(family, more):
        return F.when(F.arrays_overlap(words, F.array(*map(F.lit, family))), F.array(*map(F.lit, more))).otherwise(none)

    return F.concat(words, adds(INFLUENCER, INFLUENCER_ADDS), adds(MAN, MAN_ADDS))
