"""Landed feed dumps as (key, media, caption) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.prompts import unescaped
from millrace.functions.scalars import clean_html, prompt_of_page

URLS_PER_POST = 4
IMAGE_URL = r"(?i)\.(?:jpe?g|png|webp|gif)(?:[?#].*)?$"
GRID_SIDE = 2048
# Node fields that hold prompts, and extensions by media type.
COMFY_FIELDS = ("text", "text_g", "text_l", "populated_text", "body_text", "multiline_text", "wildcard_text")
MIME_EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "video/mp4": ".mp4", "video/webm": ".webm", "video/quicktime": ".mov"}
IMAGE_HOST = r"(?i)^https?://(?:i\.redd\.it|(?:i\.)?imgur\.com)/"

_MEDIA = "map<string, struct<s: struct<u: string, gif: string>>>"
REDDIT = f"data struct<children: array<struct<data: struct<id: string, subreddit: string, title: string, selftext: string, url: string, preview: struct<images: array<struct<source: struct<url: string>>>>, gallery_data: struct<items: array<struct<media_id: string>>>, media_metadata: {_MEDIA}, media: struct<reddit_video: struct<fallback_url: string>>>>>>"
DISCORD = "id string, content string, author struct<username: string>, attachments array<struct<url: string, content_type: string, filename: string, width: int, height: int>>, embeds array<struct<image: struct<url: string>, description: string, footer: struct<text: string>>>, components array<struct<components: array<struct<label: string>>>>"
HITS = "id string, url string, name string, mimeType string, prompt string, type string, nsfwLevel int, width int, height int, baseModel string, poi boolean, minor boolean, meta struct<prompt: string, comfy: struct<prompt: map<string, struct<inputs: map<string, variant>>>>>"


def _unescaped(url: Column) -> Column:
    """The references that urls and sidecar texts are written with."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        url = F.replace(url, F.lit(name), F.lit(char))
    return url


def reddit_listing(dump: DataFrame, subreddits: tuple[str, ...] = ()) -> DataFrame:
    """``key, url, prompt`` of a listing ``value``: at most four media of a post, in order of preference."""
    post = dump.select(F.explode(F.from_json("value", REDDIT)["data"]["children"]).alias("c")).select("c.data.*")
    if subreddits:
        post = post.filter(F.lower("subreddit").isin(*[s.lower() for s in subreddits]))
    direct = F.when(F.col("url").rlike(IMAGE_URL), F.col("url"))
    preview = F.transform(F.coalesce("preview.images", F.array().cast("array<struct<source:struct<url:string>>>")), lambda i: i["source"]["url"])
    ids = F.coalesce(F.col("gallery_data.items"), F.array().cast("array<struct<media_id:string>>"))
    gallery = F.transform(ids, lambda i: F.coalesce(F.col("media_metadata")[i["media_id"]]["s"]["u"], F.col("media_metadata")[i["media_id"]]["s"]["gif"]))
    hosted = F.when(F.col("url").rlike(IMAGE_HOST), F.col("url"))
    urls = F.array_distinct(F.transform(F.array_compact(F.concat(F.array(direct), preview, gallery, F.array(hosted), F.array("media.reddit_video.fallback_url"))), _unescaped))
    post = post.withColumn("_clean", clean_html(F.concat_ws("\n", "title", "selftext"))).withColumn("_text", prompt_of_page(F.col("_clean")))
    prompt = F.when(F.length("_text") < 30, F.col("title")).otherwise(F.col("_text"))
    rows = post.select("id", prompt.alias("prompt"), F.posexplode(F.slice(urls, 1, URLS_PER_POST)).alias("i", "url"))
    return rows.select(F.concat_ws("_", F.lit("reddit"), "id", F.col("i").cast("string")).alias("key"), "url", "prompt")


def _wanted(attachment: Column) -> Column:
    """Images by type or name that aren't grids, which are large on both sides."""
    image = F.coalesce(attachment["content_type"].startswith("image/"), F.lit(False)) | F.coalesce(attachment["filename"].rlike(IMAGE_URL), F.lit(False))
    large = [F.coalesce(attachment[side] >= GRID_SIDE, F.lit(False)) for side in ("width", "height")]
    return image & ~(large[0] & large[1])


def discord_messages(dump: DataFrame, file_prompts: DataFrame | None = None) -> DataFrame:
    """``key, url, prompt`` of messages ``value``; four-picture grids are dropped.

    ``file_prompts (url, prompt)`` are what ``yaml_prompt`` and ``png_text_prompt`` found in the landed files, one row for each url,
    the workflow's first; they come before what the message says."""
    m = dump.select(F.from_json("value", DISCORD).alias("m")).select("m.*")
    buttons = F.flatten(F.transform(F.coalesce("components", F.array().cast("array<struct<components:array<struct<label:string>>>>")), lambda c: F.transform(c["components"], lambda b: b["label"])))
    bot = (F.col("author.username") == "Midjourney Bot") & F.arrays_overlap(buttons, F.array(*[F.lit(f"U{i}") for i in range(1, 5)]))
    m = m.filter(~F.coalesce(bot, F.lit(False)))
    files = F.transform(F.filter(F.coalesce("attachments", F.array().cast("array<struct<url:string,content_type:string,filename:string,width:int,height:int>>")), _wanted), lambda a: a["url"])
    shown = F.transform(F.coalesce("embeds", F.array().cast("array<struct<image:struct<url:string>,description:string,footer:struct<text:string>>>")), lambda e: e["image"]["url"])
    urls = F.filter(F.array_distinct(F.array_compact(F.concat(files, shown))), lambda u: ~F.contains(u, F.lit("_grid_")))
    said = F.concat(F.array(F.nullif(F.trim("content"), F.lit(""))), F.flatten(F.transform(F.coalesce("embeds", F.array().cast("array<struct<image:struct<url:string>,description:string,footer:struct<text:string>>>")), lambda e: F.array(e["description"], e["footer"]["text"]))))
    rows = m.select("id", F.array_join(F.array_compact(said), " | ").alias("prompt"), F.explode(urls).alias("url"))
    if file_prompts is not None:
        rows = rows.join(file_prompts.select(F.col("url"), F.col("prompt").alias("_of_file")), "url", "left").withColumn("prompt", F.coalesce(F.nullif(F.trim("_of_file"), F.lit("")), "prompt"))
    return rows.select(F.concat_ws("_", "id", F.regexp_replace("url", r"\?.*$", "")).alias("key"), "url", "prompt")


def _comfy(prompt: Column) -> Column:
    """The longest text of over 20 characters in the prompt fields of a node graph; of equally long ones the greatest."""
    fields = F.flatten(F.transform(F.map_values(prompt), lambda node: F.array(*[F.when(F.schema_of_variant(node["inputs"][f]) == "STRING", F.try_variant_get(node["inputs"][f], "$", "string")) for f in COMFY_FIELDS])))
    long = F.transform(F.filter(fields, lambda t: F.length(t) > 20), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))
    return F.array_max(long)["t"]


def search_hits(dump: DataFrame, types: tuple[str, ...] = ("image",), base_models: tuple[str, ...] = (), levels: tuple[int, ...] = (1, 2, 4, 8, 16), prompt_optional: bool = False, portrait_only: bool = True) -> DataFrame:
    """``key, url, prompt, ext`` of hits and of generation items ``value`` that pass type, aspect, safety, model and prompt checks.

    An item's prompt is its own, its generation data's, or the longest text in its node graph."""
    h = dump.select(F.from_json("value", HITS).alias("h")).select("h.*")
    prompt = F.trim(F.regexp_replace(F.coalesce(F.nullif(F.trim("prompt"), F.lit("")), F.nullif(F.trim("meta.prompt"), F.lit("")), _comfy(F.col("meta.comfy.prompt")), F.lit("")), r"(?i)^\s*(?:positive|negative)\s+prompt\s*:\s*", ""))
    keep = F.col("type").isin(*types) & F.col("nsfwLevel").isin(*levels) & ~F.coalesce("poi", F.lit(False)) & ~F.coalesce("minor", F.lit(False))
    named = F.nullif(F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"(\.[A-Za-z0-9]+)$", 1)), F.lit(""))
    by_mime = F.element_at(F.create_map(*[F.lit(x) for pair in MIME_EXTENSIONS.items() for x in pair]), F.lower("mimeType"))
    ext = F.coalesce(by_mime, named, F.when(F.col("type") == "video", ".mp4").otherwise(".jpg"))
    if portrait_only:
        keep = keep & (F.col("height") > F.col("width"))
    if base_models and not prompt_optional:
        keep = keep & F.col("baseModel").isin(*base_models)
    h = h.filter(F.coalesce(keep, F.lit(False))).withColumn("prompt", prompt)
    return h.filter(F.lit(prompt_optional) | (F.length("prompt") >= 15)).select(F.concat(F.lit("civitai_"), "id").alias("key"), "url", "prompt", ext.alias("ext"))


def sidecar_records(df: DataFrame, kind: str = "gallery") -> DataFrame:
    """``key, prompt`` of downloader sidecars ``value``: the first caption field that isn't blank, else the tags."""
    v = F.try_parse_json("value")
    get = lambda name: F.nullif(F.trim(F.try_variant_get(v, f"$.{name}", "string")), F.lit(""))
    tags = F.coalesce(F.array_join(F.try_variant_get(v, "$.tags", "array<string>"), ", "), F.replace(get("tags"), F.lit(" "), F.lit(", ")) if kind == "gallery" else get("tags"))
    names = ("description", "caption", "selftext", "content", "title") if kind == "gallery" else ("description", "title")
    prompt = unescaped(F.coalesce(*[get(n) for n in names], tags, F.lit("")))
    if kind == "gallery":
        key = F.coalesce(get("url"), F.concat_ws("_", get("category"), get("id"), get("num")))
    else:
        key = F.concat_ws("_", F.lower(get("extractor")), get("id"))
    return df.select(key.alias("key"), prompt.alias("prompt"))


def x_posts(df: DataFrame) -> DataFrame:
    """``key, url`` of posts ``(id, img_src)``; the url asks for the original size."""
    key = F.concat_ws("_", F.lit("x"), F.col("id"), F.substring(F.md5("img_src"), 1, 8))
    bare = F.regexp_replace("img_src", r"[?&]name=\w+", "")
    return df.select(key.alias("key"), F.concat(bare, F.when(bare.contains("?"), "&name=orig").otherwise("?name=orig")).alias("url"))
