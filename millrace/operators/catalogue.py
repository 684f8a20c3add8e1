"""Catalogue queries: listing, counting, distributions and digests over an items frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import model_object, norm_score
from millrace.operators.ranking import with_rank_in_group

SORTS = {"newest": None, "oldest": None, "ovr": "ovr", "rel": "rel", "quality": "quality"}
TERMINAL = ("DISCARD", "CORRUPT")
GROUPABLE = ("source", "category", "topic_slug")


def order_of(key: str) -> list[Column]:
    """Sort order of a listing; ties end with the path."""
    if key == "oldest":
        return [F.asc("mtime"), F.asc("path")]
    column = SORTS.get(key)
    return ([F.desc_nulls_last(column)] if column else []) + [F.desc("mtime"), F.asc("path")]


def list_items(df: DataFrame, sources=(), categories=(), nsfw: bool | None = None, min_ovr: int | None = None, min_rel: int | None = None, slug: str | None = None) -> DataFrame:
    """Sorted items that pass the filters; an empty list doesn't filter, nsfw=False keeps unknown ones."""
    df = df.filter(F.col("status") == "sorted")
    if sources:
        df = df.filter(F.col("source").isin(*sources))
    if categories:
        df = df.filter(F.col("category").isin(*categories))
    if slug is not None:
        df = df.filter(F.col("topic_slug") == slug)
    if nsfw is not None:
        df = df.filter(F.col("nsfw") if nsfw else F.coalesce(~F.col("nsfw"), F.lit(True)))
    for name, least in (("ovr", min_ovr), ("rel", min_rel)):
        if least is not None:
            df = df.filter(F.col(name) >= least)
    return df


def page(df: DataFrame, sort: str = "newest", limit: int = 50, offset: int = 0) -> DataFrame:
    return df.orderBy(*order_of(sort)).offset(offset).limit(limit)


def top_gallery(df: DataFrame, slug: str, category: str, n: int) -> DataFrame:
    rows = list_items(df, categories=[category], slug=slug)
    return page(rows, "ovr", min(max(n, 1), 50)).withColumn("prompt", F.substring("prompt", 1, 800))


def sample_items(df: DataFrame, category: str, n: int, seed: str) -> DataFrame:
    """n rows of a category without replacement, drawn by a hash of path and seed."""
    return df.filter(F.col("category") == category).orderBy(F.md5(F.concat_ws("|", "path", F.lit(seed))), "path").limit(max(1, n))


def count_by_source(df: DataFrame, status: str) -> DataFrame:
    return df.filter(F.col("status") == status).groupBy("source").agg(F.count("*").alias("n"))


def count_queue_by_topic_source(df: DataFrame) -> DataFrame:
    key = F.concat_ws("/", F.coalesce(F.nullif("topic_slug", F.lit("")), F.lit("default")), F.col("source"))
    return df.filter(F.col("status") == "queue").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def count_sorted_by_topic_category(df: DataFrame) -> DataFrame:
    """Null and ``default`` slugs are summed up."""
    slug = F.coalesce(F.nullif("topic_slug", F.lit("")), F.lit("default"))
    return df.filter((F.col("status") == "sorted") & F.col("category").isNotNull()).groupBy(slug.alias("slug"), "category").agg(F.count("*").alias("n"))


def status_source_rollup(df: DataFrame) -> DataFrame:
    """Counts per status and source, per status, and of all, in one pass."""
    return df.rollup("status", "source").agg(F.count("*").alias("n"))


def ovr_histogram(df: DataFrame) -> DataFrame:
    """Counts by tens; 100 has a bucket of its own."""
    rows = df.filter((F.col("status") == "sorted") & F.col("ovr").isNotNull())
    return rows.groupBy((F.floor(F.col("ovr") / 10) * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def score_distribution(df: DataFrame) -> DataFrame:
    """ovr and rel by labelled tens, clamped; what isn't a number is ``unknown``."""

    def label(c: Column) -> Column:
        low = (F.floor(F.least(F.greatest(c.try_cast("int"), F.lit(0)), F.lit(100)) / 10) * 10).cast("int")
        return F.when(low.isNull(), "unknown").when(low == 100, "100-100").otherwise(F.concat_ws("-", low, low + 9))

    rows = df.filter(F.col("status") == "sorted").select(label(F.col("ovr")).alias("ovr"), label(F.col("rel")).alias("rel"))
    return rows.unpivot([], ["ovr", "rel"], "axis", "label").groupBy("axis", "label").agg(F.count("*").alias("n"))


def job_stats(df: DataFrame) -> DataFrame:
    """Per category: items, unsafe ones, those whose audit (``vision_json``) sees a text overlay, and those with a prompt."""
    rows = df.filter((F.col("status") == "sorted") & F.col("category").isNotNull())
    overlay = F.from_json("vision_json", "contains_text_overlay boolean")["contains_text_overlay"]
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if("nsfw").alias("n_nsfw"), F.count_if(overlay).alias("n_overlay"), F.count_if(F.coalesce(F.length(F.trim("prompt")), F.lit(0)) > 0).alias("n_prompt"))


def distinct_values(df: DataFrame, column: str, status: str | None = None) -> DataFrame:
    if column not in GROUPABLE:
        raise ValueError(f"not a listed column: {column}")
    if status:
        df = df.filter(F.col("status") == status)
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")


def digest_class(category: Column, kept: tuple[str, ...]) -> Column:
    """Ordered rules: terminal, borderline, off topic, kept, and the rest is discarded."""
    low = F.lower(category)
    out = F.when(category.isNull() | category.isin(*TERMINAL), "discarded").when(low.contains("borderline"), "borderline")
    return out.when(low.contains("off") & low.contains("topic"), "off_topic").when(category.isin(*kept), "kept").otherwise("discarded")


def digest(df: DataFrame, since: float, kept: tuple[str, ...], slug: str | None = None) -> DataFrame:
    """One row of totals over sorted items from ``since`` on; zeros when there are none."""
    rows = df.filter((F.col("status") == "sorted") & (F.col("mtime") >= since))
    if slug is not None:
        rows = rows.filter(F.col("topic_slug") == slug)
    kind, scored = digest_class(F.col("category"), kept), (F.col("ovr") > 0) | (F.col("rel") > 0)
    totals = [F.count_if(kind == k).alias(k) for k in ("kept", "borderline", "off_topic", "discarded")]
    means = [F.coalesce(F.round(F.avg(F.when(scored, norm_score(F.col(c)))), 4), F.lit(0.0)).alias(f"avg_{c}") for c in ("ovr", "rel")]
    return rows.agg(F.count("*").alias("total"), *totals, *means, F.count_if(scored).alias("sample_count"))


def digest_categories(df: DataFrame, since: float) -> DataFrame:
    rows = df.filter((F.col("status") == "sorted") & (F.col("mtime") >= since) & F.col("category").isNotNull())
    return rows.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def digest_top_keeps(df: DataFrame, since: float, kept: tuple[str, ...], n: int) -> DataFrame:
    rows = df.filter((F.col("status") == "sorted") & (F.col("mtime") >= since) & (digest_class(F.col("category"), kept) == "kept"))
    return rows.withColumn("score", norm_score(F.col("ovr"))).orderBy(F.desc("score"), F.desc("mtime"), "path").limit(n)


def digest_outliers(df: DataFrame, since: float, reason: str, known: tuple[str, ...], n: int = 3) -> DataFrame:
    """Newest rows whose reason is long or whose score is undecided."""
    score = norm_score(F.col("ovr"))
    rows = df.filter((F.col("status") == "sorted") & (F.col("mtime") >= since))
    odd = (F.length(reason) > 200) | ((score >= 0.4) & (score <= 0.6) & F.col("category").isin(*known))
    return rows.filter(odd).orderBy(F.desc("mtime"), "path").limit(n)


def round_robin(df: DataFrame, order: str) -> DataFrame:
    """``turn``: the i-th item of every source in turn, sources by name.  No source is numbered in one task."""
    return with_rank_in_group(df, "source", [F.col(order).asc()], "turn").withColumn("turn", F.col("turn") + 1)


def weighted_round_robin(df: DataFrame, weights: DataFrame, order: list[str]) -> DataFrame:
    """``cycle`` and ``slot``: a slug with weight w takes w turns per cycle (at least one).

    ``weights (slug, pos, weight)``; the order (cycle, pos, slot) is the fair order."""
    w = F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1))
    ranked = with_rank_in_group(df, "slug", [F.col(c).asc() for c in order], "slot")
    return ranked.join(weights, "slug", "left").withColumn("cycle", F.floor(F.col("slot") / w))


def unique_stems(df: DataFrame, folder: str, stem: str, order: list[str]) -> DataFrame:
    """``name``: the stem; one that is taken in its folder gets ``_1``, ``_2``... , the first that is free when its turn comes in ``order``.

    Where no made-up name meets a stem, that is the number of its copies before it.  Only rows of stems that
    meet, such as copies of ``a`` beside a real ``a_1``, are walked one by one, a family of stems at a time."""
    nth = F.row_number().over(Window.partitionBy(folder, stem).orderBy(*order)) - 1
    made = df.withColumn("_nth", nth).withColumn("name", F.when(F.col("_nth") == 0, F.col(stem)).otherwise(F.concat_ws("_", stem, F.col("_nth").cast("string"))))
    base = F.regexp_replace(stem, "(?:_[0-9]+)+$", "")
    counts = df.groupBy(F.col(folder).alias("_folder"), F.col(stem).alias("_stem")).agg(F.count("*").alias("_n")).withColumn("_base", F.regexp_replace("_stem", "(?:_[0-9]+)+$", ""))
    twice = counts.filter("_n > 1")
    child = counts.filter("_stem != _base").select("_folder", "_base", F.col("_stem").alias("_child"))
    # A stem s with copies is in danger if the folder also has a stem s_<number>.
    danger = twice.join(child, ["_folder", "_base"]).filter(F.col("_child").startswith(F.concat("_stem", F.lit("_"))) & F.regexp_like(F.expr("substring(_child, length(_stem) + 2)"), F.lit("^[0-9]+(?:_[0-9]+)*$")))
    danger = danger.groupBy("_folder", "_base").agg(F.collect_set("_stem").alias("_stems"))
    out = made.withColumn("_of", base).join(danger, F.col(folder).eqNullSafe(F.col("_folder")) & (F.col("_of") == F.col("_base")), "left")
    met = F.exists("_stems", lambda d: (F.col(stem) == d) | F.col(stem).startswith(F.concat(d, F.lit("_"))))
    out = out.withColumn("_met", F.coalesce(met, F.lit(False))).drop("_nth", "_folder", "_base", "_stems")
    walked = out.filter("_met")

    def walk(frame):
        used, names = set(), []
        for s in (frame := frame.sort_values(order))[stem]:
            name, k = s, 0
            while name in used:
                k += 1
                name = f"{s}_{k}"
            used.add(name)
            names.append(name)
        return frame.assign(name=names)

    walked = walked.groupBy(folder, "_of").applyInPandas(walk, walked.schema)
    return out.filter("NOT _met").unionByName(walked).drop("_of", "_met")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def new_items(df: DataFrame, seen: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First occurrences of keys that aren't in ``seen``."""
    return latest(df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), [key], order).join(seen.select(key).distinct(), key, "left_anti")


def diff_listing(listing: DataFrame, base: DataFrame) -> DataFrame:
    """``path, change``: added, updated (newer by over a microsecond), unchanged, deleted."""
    old = base.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"))
    both = listing.select("path", "mtime").join(old, F.col("path") == F.col("_path"), "full_outer")
    change = F.when(F.col("_path").isNull(), "added").when(F.col("path").isNull(), "deleted").when(F.col("mtime") > F.col("_mtime") + 1e-6, "updated").otherwise("unchanged")
    return both.select(F.coalesce("path", "_path").alias("path"), change.alias("change"))


def upsert_items(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace by path; the perceptual hash of the base row stays."""
    new = changes.select(*[F.col(c).alias(f"_new_{c}") for c in changes.columns])
    both = base.join(new, F.col("path") == F.col("_new_path"), "full_outer")
    replaced = F.col("_new_path").isNotNull()
    return both.select(*[(F.coalesce("phash", "_new_phash") if c == "phash" and "phash" in changes.columns else F.when(replaced, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in changes.columns else F.col(c)).alias(c) for c in base.columns])


def delete_items(base: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def deleted(base: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """One row ``n``: how many rows of ``base`` go with ``keys``."""
    return base.join(keys.select(key), key, "left_semi").agg(F.count("*").alias("n"))


def append_seen(seen: DataFrame, new: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``seen`` with the new keys, one row ``n`` with their number); ``by`` names the key columns, blank keys are skipped."""
    fresh = new.select(*by).filter(F.trim(F.col(by[-1]).cast("string")) != "").distinct().join(seen.select(*by), by, "left_anti")
    return seen.select(*by).distinct().unionByName(fresh), fresh.agg(F.count("*").alias("n"))


# How each source's key stands in the names of sorted and of queued files.
SORTED_KEYS = {"civitai": r"civitai_(\d+)", "reddit": r"_reddit_([A-Za-z0-9]+)_\d+_\d+_\d+\.", "twitter_x": r"_(x_[A-Za-z0-9]+_[A-Za-z0-9]+)_\d+_\d+\."}
QUEUED_KEYS = {"civitai": r"civitai_(\d+)", "reddit": r"^reddit_([A-Za-z0-9]+)_\d+\.", "twitter_x": r"^(x_[A-Za-z0-9]+_[A-Za-z0-9]+)\."}


def recovered_keys(files: DataFrame) -> DataFrame:
    """``source, key``: the keys that the names of files ``(status, source, file)`` still tell, to rebuild a lost seen set."""
    key = F.when(F.lit(False), "")
    for status, patterns in (("sorted", SORTED_KEYS), ("queue", QUEUED_KEYS)):
        for source, pattern in patterns.items():
            key = key.when((F.col("status") == status) & F.col("source").startswith(source), F.regexp_extract("file", pattern, 1))
    return files.select("source", key.alias("key")).filter("key != ''").distinct()


def set_hash(items: DataFrame, hashes: DataFrame) -> DataFrame:
    """``items`` with the hashes ``(path, phash)`` put in, null ones cleared; unknown paths change nothing, the greatest hash of a path counts."""
    new = hashes.groupBy(F.col("path").alias("_path")).agg(F.max("phash").alias("_phash"))
    out = items.join(new, F.col("path") == F.col("_path"), "left")
    return out.withColumn("phash", F.when(F.col("_path").isNotNull(), F.col("_phash")).otherwise(F.col("phash"))).drop("_path", "_phash")


def hashes(items: DataFrame, slug: str | None = None, status: str | None = None) -> DataFrame:
    """``path, phash`` of the items of a topic and a status, those without a hash included."""
    for column, value in (("topic_slug", slug), ("status", status)):
        if value is not None:
            items = items.filter(F.col(column) == value)
    return items.select("path", "phash")


def audit_of(items: DataFrame, path: str) -> DataFrame:
    """One row ``path, audit, error``: the audit record of an item, or why there is none."""
    asked = items.sparkSession.createDataFrame([(path,)], "path string")
    found = items.filter(F.col("path") == path).select("path", model_object(F.col("vision_json")).alias("audit"), F.lit(True).alias("_known"))
    error = F.when(F.col("_known").isNull(), "no such item").when(F.col("audit").isNull(), "no audit record")
    return asked.join(found, "path", "left").select("path", "audit", error.alias("error"))


def resolve_categories(requested: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The requested categories that a taxonomy ``(name)`` knows, without the terminal ones in any case of letters."""
    known = requested.select("category").distinct().join(taxonomy.select(F.col("name").alias("category")).distinct(), "category", "left_semi")
    return known.filter(~F.upper("category").isin(*TERMINAL))


def per_slug_gates(items: DataFrame, gates: DataFrame) -> DataFrame:
    """The items that reach their own topic's minima ``gates (topic_slug, ovr_min, rel_min)``; a minimum of 0 or null, or no row, is off."""
    out = items.join(gates.select("topic_slug", F.col("ovr_min").alias("_ovr"), F.col("rel_min").alias("_rel")), "topic_slug", "left")
    for score, least in (("ovr", "_ovr"), ("rel", "_rel")):
        off = F.coalesce(F.col(least), F.lit(0)) <= 0
        out = out.filter(off | F.coalesce(F.col(score) >= F.col(least), F.lit(False)))
    return out.drop("_ovr", "_rel")


def to_item(rows: DataFrame) -> DataFrame:
    """Index rows as items: a null prompt is empty, ``nsfw`` 0 or 1 a truth value, broken audit JSON null."""
    return rows.withColumns({"prompt": F.coalesce("prompt", F.lit("")), "nsfw": F.col("nsfw").cast("boolean"), "vision_json": F.when(F.try_parse_json("vision_json").isNotNull(), F.col("vision_json"))})


def recategorise(items: DataFrame, moves: DataFrame, taxonomy: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items after the valid moves, rejected moves); the last valid move of a path counts."""
    valid = moves.filter(F.col("target").isin(*taxonomy))
    rejected = moves.filter(~F.coalesce(F.col("target").isin(*taxonomy), F.lit(False)))
    out = items.join(latest(valid, ["path"], [F.desc("seq")]).select("path", "target"), "path", "left")
    return out.withColumn("category", F.coalesce("target", "category")).drop("target"), rejected


def audit_tree(files: DataFrame) -> DataFrame:
    """Per category and source, and in total: triples, images, texts and records without a partner.

    ``files (category, source, stem, kind)`` with kind image, txt or json; the first match wins."""
    flags = files.groupBy("category", "source", "stem").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("image", "txt", "json")])
    kind = F.when(F.col("image") & F.col("txt"), "triple").when(F.col("image"), "orphan_image").when(F.col("txt"), "orphan_txt").otherwise("orphan_json")
    rows = flags.select("category", "source", kind.alias("k"))
    counts = [F.count_if(F.col("k") == k).alias(k) for k in ("triple", "orphan_image", "orphan_txt", "orphan_json")]
    return rows.groupingSets([[F.col("category"), F.col("source")], []], F.col("category"), F.col("source")).agg(*counts)
