"""Row-wise helpers of export, ingest and accounting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.prompts import closed_references

# The least size of media, media types by file extension, and those that exports to a hub take.
LEAST_BYTES = 5000
HUB_IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tiff")
HUB_VIDEOS = (".mp4", ".mov", ".webm", ".mkv", ".avi")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v")


def norm_score(v: Column) -> Column:
    """Scores above 1 are percentages; missing ones are 0."""
    v = v.cast("double")
    return F.coalesce(F.when(v > 1, v / 100).otherwise(v), F.lit(0.0))


def split_bucket(stem: Column, fraction: float | None) -> Column:
    """``val`` for a stable share ``fraction`` of stems, else ``train``; null when there is no split."""
    if not fraction or fraction <= 0:
        return F.lit(None).cast("string")
    if fraction >= 1:
        raise ValueError("the validation share lies in [0, 1)")
    at = F.conv(F.substring(F.sha1(stem), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(at < fraction, "val").otherwise("train")


def trigger_word(caption: Column, word: str) -> Column:
    """Put ``word`` first unless the caption already starts with it."""
    if not word:
        return caption
    starts = (caption == word) | caption.startswith(word + ",") | caption.startswith(word + " ")
    return F.when(F.coalesce(caption, F.lit("")) == "", F.lit(word)).when(starts, caption).otherwise(F.concat(F.lit(word + ", "), caption))


def duration_label(seconds: Column) -> Column:
    label = F.when(seconds.isNull() | (seconds <= 0), "unknown")
    for low, high in ((0, 2), (2, 4), (4, 8), (8, 16)):
        label = label.when(seconds < high, f"dur_{low}-{high}s")
    return label.otherwise("dur_16s+")


def fps_label(fps: Column) -> Column:
    return F.when(fps.isNull() | (fps <= 0), "unknown").otherwise(F.concat(F.lit("fps_"), F.bround(fps, 0).cast("long").cast("string")))


def resolution_label(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.concat_ws("x", width, height)).otherwise("unknown")


def fps_fraction(text: Column) -> Column:
    """``24000/1001`` as a number; 0 for anything else."""
    parts = F.split(text, "/")
    top, bottom = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).try_cast("double")
    return F.coalesce(F.when((F.size(parts) <= 2) & (bottom != 0), top / bottom), F.lit(0.0))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def titleize(slug: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(slug, "_+", " ")))


def safe_component(name: Column, fallback: str) -> Column:
    last = F.trim(F.element_at(F.split(F.coalesce(name, F.lit("")), r"[/\\]"), -1))
    return F.when(last.isin("", ".", ".."), fallback).otherwise(last)


def frame_offsets(duration: Column, n: int) -> Column:
    """Evenly spread positions inside a clip; zeros for an unknown duration."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(duration > 0, duration / (n + 1) * i).otherwise(0.0))


def clean_html(text: Column) -> Column:
    """Character references that end in a semicolon decoded, tags removed, trimmed."""
    return F.trim(F.regexp_replace(closed_references(text), "<[^>]+>", ""))


def min_bytes(size: Column, least: int = LEAST_BYTES) -> Column:
    """Whether a file is large enough to be media; unknown sizes aren't."""
    return F.coalesce(size >= least, F.lit(False))


def caption_pick(source: Column, model: Column, enabled: bool = True, overwrite: bool = False) -> Column:
    """The model's caption where that is enabled, not blank, and there is no source caption or it may be overwritten."""
    source, model = F.coalesce(source, F.lit("")), F.trim(F.coalesce(model, F.lit("")))
    if not enabled:
        return source
    return F.when((model != "") & ((F.trim(source) == "") | F.lit(overwrite)), model).otherwise(source)


def prompt_of_page(text: Column) -> Column:
    """The longest brace block of 50 characters, else what follows ``prompt`` and colons or white space (which don't count among its 40 characters), else the text."""
    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(\{[^{}]{50,}\})")), lambda b: b != "")
    longest = F.element_at(F.sort_array(F.transform(blocks, lambda b: F.struct(F.length(b).alias("n"), b.alias("b"))), asc=False), 1)["b"]
    after = F.trim(F.substring(F.trim(F.regexp_extract(text, r"(?is)prompt[:\s]++(.{40,})", 1)), 1, 2000))
    return F.coalesce(F.when(F.size(blocks) > 0, longest), F.when(after != "", after), F.trim(text))


def recover_id(stem: Column) -> Column:
    found = F.regexp_extract(stem, r"^([a-z]+)_(.+)_(\d{9,11})_(\d{2,4})$", 2)
    return F.when(found != "", found).otherwise(stem)


def sorted_name(category: Column, key: Column, epoch: Column) -> Column:
    """Deterministic: the last three digits come from the key's hash."""
    return F.concat_ws("_", F.lower(category), key, epoch.cast("long").cast("string"), (F.pmod(F.crc32(key.cast("binary")), F.lit(900)) + 100).cast("string"))


def model_object(raw: Column) -> Column:
    """The JSON object in a model's answer as text: thinking and fences dropped; null without one."""
    text = F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")
    text = F.regexp_replace(text, r"(?is)<think>.*$", "")
    text = F.trim(F.regexp_replace(text, r"(?i)```(?:json)?", ""))
    whole = F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), text)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole, F.when((outer != "") & F.try_parse_json(outer).isNotNull(), outer))


def sniff_media(content: Column) -> Column:
    """``image`` or ``video`` by magic bytes."""
    head = F.hex(F.substring(content, 1, 12))
    riff = head.startswith("52494646")
    image = head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A") | head.startswith("474946383761") | head.startswith("474946383961") | (riff & head.endswith("57454250"))
    video = (F.substring(head, 9, 8) == "66747970") | head.startswith("1A45DFA3") | (riff & (F.substring(head, 17, 8) == "41564920"))
    return F.when(F.length(content) < 12, None).when(image, "image").when(video, "video")


def media_kind(path: Column, types: tuple[str, ...] = ("image",), extra_images: tuple[str, ...] = ()) -> Column:
    """The kind of a path if the policy admits it, else null."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    wanted = [t for t in types if t in ("image", "video")] or ["image"]
    kind = F.when(F.lit("image" in wanted) & extension.isin(*IMAGE_EXTENSIONS, *extra_images), "image")
    return kind.when(F.lit("video" in wanted) & extension.isin(*VIDEO_EXTENSIONS), "video")
