"""Sets of items and keys: feeds put together, paths gone stale, keys known, new or asked for.

Rows with a null key are in no result but ``union_feeds``'s, where no key is looked at.  Results by key are distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(df: DataFrame, by: list[str]) -> DataFrame:
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    return df.select(*by).filter(present)


def union_feeds(feeds: list[DataFrame], columns: list[str] | None = None) -> DataFrame:
    """The rows of all feeds, repeated ones too, by column names; what a feed lacks is null."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
    return both.select(*columns) if columns else both


def stale_paths(base: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """The keys of the base that a listing of what is there no longer has."""
    return _keys(base, [key]).distinct().join(_keys(listing, [key]), key, "left_anti")


def known_keys(sets: list[DataFrame], by: list[str]) -> DataFrame:
    """The keys that any of the sets holds."""
    return reduce(DataFrame.union, [_keys(s, by) for s in sets]).distinct()


def not_seen(keys: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """The keys that a seen set lacks."""
    return _keys(keys, by).distinct().join(_keys(seen, by), by, "left_anti")


def in_both(kept: DataFrame, requested: DataFrame, by: list[str]) -> DataFrame:
    """The keys of one set that the other asks for."""
    return _keys(kept, by).distinct().join(_keys(requested, by), by, "left_semi")
