"""File trees as frames: media scans, layouts, sidecars, vector logs and training folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS

AUDIT = "description string, primary_subject string, is_screenshot boolean, is_composite_grid boolean, contains_text_overlay boolean, is_human_photograph boolean, art_medium string, photorealistic_style boolean, has_ai_flaws boolean, woman_present boolean, nsfw boolean, OVR_Quality_Score int, REL_Quality_Score int, quality_score int, category string, reason string, caption string, width int, height int"


def with_layout(files: DataFrame, root: str) -> DataFrame:
    """``rel, parts, folder, file, stem, ext`` of each path below ``root``; hidden and in-flight parts dropped."""
    rel = F.substring_index("path", root.removeprefix("file:").rstrip("/") + "/", -1)
    df = files.withColumn("rel", rel).withColumn("parts", F.split("rel", "/"))
    df = df.withColumns({"file": F.element_at("parts", -1), "folder": F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/")})
    df = df.withColumns({"ext": F.lower(F.regexp_extract("file", r"(\.[^.]+)$", 1)), "stem": F.regexp_replace("file", r"\.[^.]+$", "")})
    hidden = F.exists("parts", lambda p: p.startswith(".") | (p == "_archive"))
    return df.filter(~hidden & ~F.col("file").endswith(".processing"))


def read_media(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("image", "video")) -> DataFrame:
    """Media files below ``root``; the bytes are only read if ``content`` is used."""
    wanted = [*(IMAGE_EXTENSIONS if "image" in kinds else ()), *(VIDEO_EXTENSIONS if "video" in kinds else ())]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return with_layout(files, root).filter(F.col("ext").isin(*wanted))


def parse_layout(df: DataFrame, kind: str) -> DataFrame:
    """``topic_slug, category, source`` from the folders of a sorted or a queue tree."""
    n = F.size("parts")
    if kind == "sorted":
        return df.filter(n >= 4).withColumns({"topic_slug": F.col("parts")[0], "category": F.col("parts")[1], "source": F.col("parts")[2]})
    deep = n >= 3
    return df.filter(n >= 2).withColumns({"topic_slug": F.when(deep, F.col("parts")[0]), "source": F.when(deep, F.col("parts")[1]).otherwise(F.col("parts")[0])})


def read_texts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Whole text files with a suffix: ``folder, stem, text``."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    named = with_layout(text, root)
    return named.select("folder", F.expr(f"substring(file, 1, length(file) - {len(suffix)})").alias("stem"), F.col("value").alias("text"))


def attach_sidecars(media: DataFrame, texts: DataFrame, audits: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """Caption from ``<stem>.txt`` or ``<file>.txt``; scores from the audit record, broken JSON as empty; ``nsfw`` is false without a record.

    ``width`` and ``height`` are the audit's, else those of ``decoded (path, width, height)``, else 0, as for videos."""
    by_stem = texts.select("folder", "stem", F.col("text").alias("_by_stem"))
    by_file = texts.select("folder", F.col("stem").alias("file"), F.col("text").alias("_by_file"))
    audit = audits.select("folder", "stem", F.from_json("text", AUDIT, {"mode": "PERMISSIVE"}).alias("audit"))
    df = media.join(by_stem, ["folder", "stem"], "left").join(by_file, ["folder", "file"], "left").join(audit, ["folder", "stem"], "left")
    prompt = F.coalesce(F.trim("_by_stem"), F.trim("_by_file"), F.lit(""))
    scores = {"ovr": F.col("audit.OVR_Quality_Score"), "rel": F.col("audit.REL_Quality_Score"), "quality": F.col("audit.quality_score"), "nsfw": F.coalesce(F.col("audit.nsfw"), F.lit(False))}
    sides = {c: F.col(f"audit.{c}") for c in ("width", "height")}
    if decoded is not None:
        df = df.join(decoded.select(F.col("path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in sides]), F.col("path") == F.col("_path"), "left")
        sides = {c: F.coalesce(side, F.col(f"_{c}")) for c, side in sides.items()}
    sides = {c: F.coalesce(side, F.lit(0)) for c, side in sides.items()}
    return df.withColumns({"prompt": prompt, **scores, **sides}).drop("_by_stem", "_by_file", "_path", "_width", "_height")


def read_vectors(lines: DataFrame) -> DataFrame:
    """``key, vec`` of a vector log ``seq, value``: the last valid line of each key."""
    row = F.from_json("value", "key string, vec array<float>")
    good = lines.withColumn("r", row).filter("r.key IS NOT NULL AND r.vec IS NOT NULL")
    return good.groupBy(F.col("r.key").alias("key")).agg(F.max_by("r.vec", "seq").alias("vec"))


def kohya_folder(media: DataFrame, allow_flat: bool = False) -> DataFrame:
    """``repeats, concept`` from folders ``<n>_<concept>``; root-level files only if ``allow_flat``."""
    top = F.when(F.size("parts") > 1, F.col("parts")[0])
    repeats, concept = F.regexp_extract(top, r"^(\d+)_(.+)$", 1), F.regexp_extract(top, r"^(\d+)_(.+)$", 2)
    named = media.filter(repeats != "").withColumns({"repeats": repeats.cast("int"), "concept": concept})
    flat = media.filter((F.size("parts") == 1) & F.lit(allow_flat)).withColumns({"repeats": F.lit(0), "concept": F.lit("")})
    return named.unionByName(flat)


def local_folder(pairs: DataFrame, seen: DataFrame, queued: DataFrame, sorted_ids: DataFrame, min_bytes: int = 5000, min_prompt: int = 40, prompt_optional: bool = False) -> DataFrame:
    """Pairs of media and caption that are large enough and neither seen, queued nor sorted.

    Each of the three is ``(stem)``; sorted stems are ids recovered from file names and match as a whole.  ``prompt_optional`` lets
    short and missing captions pass."""
    captioned = F.coalesce(F.length(F.trim("prompt")) >= min_prompt, F.lit(False))
    df = pairs.filter((F.col("size") >= min_bytes) & (F.lit(prompt_optional) | captioned))
    for known in (seen, queued, sorted_ids):
        df = df.join(known.select("stem").distinct(), "stem", "left_anti")
    return df
