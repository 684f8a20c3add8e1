"""Registered queries of sources, routing, export and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import prompts, scalars
from millrace.operators import sets, similarity
from millrace.plans import export, routing
from millrace.registry import on_items, query, telemetry_events
from millrace.session import table
from millrace.sources import feeds, media
from millrace.streaming import jobs

# ---- text functions ----

_DECODED = "html"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&#169;", "©"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"
query("sc4_clean_html", f"SELECT page_id, trim(regexp_replace({_DECODED}, '<[^>]+>', '', 'g')) AS text FROM (SELECT page_id, html || ' caf&eacute; &#169;' AS html FROM pages)")(lambda spark, d: table(spark, d, "pages").select("page_id", scalars.clean_html(F.concat("html", F.lit(" caf&eacute; &#169;"))).alias("text")))
query("sc5_prompt_of_page", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '{' || text || repeat('x', 60) || '}' WHEN length(text) >= 40 AND turn % 3 = 1 THEN trim(substr(text, 1, 2000)) WHEN turn % 3 = 1 THEN trim('Prompt: ' || text) ELSE trim('{short} ' || text) END AS prompt FROM (SELECT conv_id, turn, trim(text) AS text FROM conversations)""")(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", F.trim("text").alias("text")).select("conv_id", "turn", scalars.prompt_of_page(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a {"), "text", F.lit("x" * 60 + "} b {"), F.lit("y" * 55), F.lit("} "))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Prompt: "), "text")).otherwise(F.concat(F.lit("{short} "), F.col("text")))).alias("prompt"))
)
query("sc12_model_object", """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE CAST(json_object('n', conv_id, 't', text) AS VARCHAR) END AS object FROM conversations""")(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", scalars.model_object(F.concat(F.when(F.col("turn") % 4 == 0, "<think>{no}</think>```json\n").when(F.col("turn") % 4 == 1, "Sure: ").otherwise(""), F.when(F.col("turn") % 4 == 3, F.col("text")).otherwise(F.to_json(F.struct(F.col("conv_id").alias("n"), F.col("text").alias("t")))), F.when(F.col("turn") % 4 == 0, "```").when(F.col("turn") % 4 == 1, " done").otherwise(""))).alias("object"))
)
query("sc14_usage_tokens", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0 ELSE event_id % 7 END AS tokens_in, CASE WHEN event_id % 5 = 4 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS tokens_out FROM events""")(
    lambda spark, d: table(spark, d, "events").select("event_id", prompts.usage_tokens(F.when(F.col("event_id") % 5 == 4, "{}").when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct((F.col("event_id") % 7).alias("prompt_tokens"), F.get_json_object("props", "$.k").cast("long").alias("completion_tokens")).alias("usage")))).otherwise(F.to_json(F.struct(F.struct((F.col("event_id") % 7).alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens")).alias("usage"))))).alias("t")).select("event_id", F.col("t.input").alias("tokens_in"), F.col("t.output").alias("tokens_out"))
)
query("sc18_fps_fraction", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_orderkey / l_linenumber::DOUBLE END AS fps FROM lineitem")(lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.fps_fraction(F.when(F.col("l_linenumber") == 3, "bad/0").otherwise(F.concat_ws("/", "l_orderkey", "l_linenumber"))).alias("fps")))
# First bytes of JPEG, PNG, GIF, WebP, MP4, Matroska and AVI files.
_HEADS = ("FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "474946383961", "524946460000000057454250", "0000001866747970", "1A45DFA3", "524946460000000041564920")
query("f7_sniff_media", "SELECT doc_id, CASE WHEN doc_id % 8 < 4 THEN 'image' WHEN doc_id % 8 < 7 THEN 'video' END AS kind FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", scalars.sniff_media(F.concat(F.element_at(F.array(*[F.unhex(F.lit(h)) for h in _HEADS], F.encode(F.lit("plain"), "UTF-8")), (F.col("doc_id") % 8 + 1).cast("int")), F.encode(F.concat(F.lit("x" * 12), "text"), "UTF-8"))).alias("kind"))
)
query("f10_caption_pick", "SELECT conv_id, turn, CASE WHEN trim(text) <> '' AND turn % 2 = 1 THEN trim(text) WHEN turn % 2 = 1 THEN '' ELSE 'own ' || turn END AS kept, CASE WHEN trim(text) <> '' THEN trim(text) WHEN turn % 2 = 1 THEN '' ELSE 'own ' || turn END AS overwritten FROM conversations")(
    lambda spark, d: table(spark, d, "conversations").withColumn("source", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("own "), "turn"))).select("conv_id", "turn", scalars.caption_pick(F.col("source"), F.col("text")).alias("kept"), scalars.caption_pick(F.col("source"), F.col("text"), overwrite=True).alias("overwritten"))
)

# ---- sets ----

on_items("u2_stale_paths", "SELECT path FROM items WHERE size % 7 = 0")(lambda df: sets.stale_paths(df, df.filter("size % 7 <> 0")))
on_items("u3_known_keys", "SELECT DISTINCT source FROM items WHERE ovr > 95 OR rel > 95")(
    lambda df: sets.known_keys([df.filter("ovr > 95"), df.filter("rel > 95")], ["source"])
)
on_items("u4_kept_and_requested", "SELECT source FROM items WHERE nsfw INTERSECT SELECT source FROM items WHERE ovr > 90")(
    lambda df: sets.in_both(df.filter("nsfw"), df.filter("ovr > 90"), ["source"])
)
on_items("u1_union_feeds", "SELECT path, status FROM items")(
    lambda df: sets.union_feeds([df.filter("status = 'queue'").select("path", "status"), df.filter("status = 'sorted'").select("path", "status", "category")], ["path", "status"])
)

# ---- judging ----


query(
    "q2_quality_gate",
    """WITH m AS (SELECT doc_id, CAST(200 + n_chars % 400 AS DOUBLE) AS w, CAST(200 + n_chars % 1700 AS DOUBLE) AS h, CAST((n_chars * 13) % 7000 AS DOUBLE) AS blur, CAST(n_chars % 90 AS DOUBLE) AS contrast, CAST((n_chars * 3) % 256 AS DOUBLE) AS light FROM documents),
    s AS (SELECT *, CAST(round_even(100 * (0.45::DOUBLE * least(greatest(blur / 6000, 0), 1) + 0.30::DOUBLE * least(greatest(contrast / 70, 0), 1) + 0.15::DOUBLE * sqrt(least(greatest(1 - abs(light - 130) / 118, 0), 1)) + 0.10::DOUBLE * least(greatest(least(w, h) / 256 - 1, 0), 1)), 0) AS INT) AS score FROM m)
    SELECT doc_id, score, list_filter([CASE WHEN w < 256 OR h < 256 THEN 'too small' END, CASE WHEN greatest(w, h) > 4 * least(w, h) THEN 'extreme aspect' END, CASE WHEN blur < 1500 THEN 'blurry' END, CASE WHEN light < 12 THEN 'too dark' END, CASE WHEN light > 248 THEN 'too bright' END, CASE WHEN contrast < 8 THEN 'flat' END, CASE WHEN score < 35 THEN 'low score' END], lambda x: x IS NOT NULL) AS reasons FROM s""",
)(lambda spark, d: routing.quality_gate(table(spark, d, "documents").selectExpr("doc_id", "CAST(200 + n_chars % 400 AS INT) AS width", "CAST(200 + n_chars % 1700 AS INT) AS height", "CAST((n_chars * 13) % 7000 AS DOUBLE) AS blur", "CAST(n_chars % 90 AS DOUBLE) AS contrast", "CAST((n_chars * 3) % 256 AS DOUBLE) AS brightness")).select("doc_id", "score", "reasons"))
query("r2_route", "SELECT doc_id, CASE WHEN n_chars % 11 = 0 THEN 'held' WHEN n_chars % 11 = 4 THEN 'unclassified_video' WHEN n_chars % 11 IN (5, 6) THEN 'dropped' WHEN n_chars % 11 = 1 THEN 'corrupt' WHEN n_chars % 11 = 2 THEN 'discarded_by_gate' WHEN n_chars % 11 = 3 THEN 'retry' ELSE 'judged' END AS outcome FROM documents")(
    lambda spark, d: routing.route(table(spark, d, "documents").selectExpr("doc_id", "IF(n_chars % 11 IN (5, 6), 0, n_chars + 1) AS size", "n_chars % 11 = 0 AS held_video", "n_chars % 11 IN (0, 4) AS undecodable_clip", "n_chars % 11 IN (1, 6) AS corrupt", "n_chars % 11 NOT IN (1, 2) AS gate_ok", "n_chars % 11 NOT IN (2, 3) AS answered")).select("doc_id", "outcome")
)

# ---- export ----


def export_rows(df: DataFrame) -> DataFrame:
    rows = export.samples(df, ("Keep", "Borderline"))
    return rows.withColumns({"stem": F.concat_ws("-", "source", F.col("size") % 3), "caption": F.col("prompt"), "width": (F.col("size") % 3 * 64).cast("int"), "height": F.lit(64)})


_EXPORT = "e AS (SELECT path, category, source, source || '-' || (size % 3) AS stem, prompt AS caption, CASE WHEN size % 3 > 0 THEN (size % 3 * 64) || 'x64' ELSE 'unknown' END AS bucket FROM items WHERE status = 'sorted' AND category IN ('Keep', 'Borderline')), s AS (SELECT *, CASE WHEN ('0x' || substr(sha1(stem), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.25 THEN 'val' ELSE 'train' END AS split FROM e)"
on_items("ex_kohya_plan", f", {_EXPORT} SELECT path, folder, stem || CASE WHEN k = 0 THEN '' ELSE '_' || k END AS name FROM (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY category, source, path) - 1 AS k FROM (SELECT *, split || '/10_cat/' || bucket AS folder FROM s))")(lambda df: export.plan(export_rows(df), "kohya", split=0.25, repeats=10, concept="cat", bucket="resolution").select("path", "folder", "name"))
on_items("ex_folders_plan", f", {_EXPORT} SELECT path, category AS folder, stem || CASE WHEN k = 0 THEN '' ELSE '_' || k END AS name FROM (SELECT *, row_number() OVER (PARTITION BY category, stem ORDER BY category, source, path) - 1 AS k FROM s)")(lambda df: export.plan(export_rows(df), "folders").select("path", "folder", "name"))
on_items("ex_webdataset_plan", f", {_EXPORT} SELECT path, split AS folder, 'shard-' || lpad(CAST((row_number() OVER (PARTITION BY split ORDER BY category, source, path) - 1) // 50 AS VARCHAR), 6, '0') || '.tar' AS shard FROM s")(lambda df: export.plan(export_rows(df), "webdataset", split=0.25, shard=50).select("path", "folder", "shard"))
on_items("a19_shard_summary", f", {_EXPORT} SELECT count(*) AS sample_count, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'train') AS n_train, count(DISTINCT folder || shard) AS shard_count, list_sort(list(DISTINCT category)) AS categories, (SELECT list_sort(list(bucket || '=' || n)) FROM (SELECT bucket, count(*) AS n FROM s GROUP BY bucket)) AS buckets FROM (SELECT *, split || '/' || bucket AS folder, (row_number() OVER (PARTITION BY split, bucket ORDER BY category, source, path) - 1) // 50 AS shard FROM s)")(lambda df: export.shard_summary(export.plan(export_rows(df), "webdataset", split=0.25, bucket="resolution", shard=50)))
_HUB = "SELECT category || '/' || file AS file_name, prompt AS caption, category, ovr AS score, nullif(source, '') AS source FROM (SELECT *, replace(parse_filename(path), '.txt', ['.PNG', '.mp4', '.m4v', '.tiff', '.svg'][size % 5 + 1]) AS file FROM items WHERE status = 'sorted' AND category IN ('Keep', 'Borderline')) WHERE "


def _hub_rows(df: DataFrame) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".PNG", ".mp4", ".m4v", ".tiff", ".svg"))), (F.col("size") % 5 + 1).cast("int"))
    return export_rows(df).withColumns({"file": F.replace(F.element_at(F.split("path", "/"), -1), F.lit(".txt"), ext), "score": F.col("ovr")})


on_items("snk5_hub_metadata", _HUB + "size % 5 IN (0, 3)")(lambda df: export.hub_metadata(_hub_rows(df)))
on_items("snk5_hub_metadata_video", _HUB + "size % 5 IN (0, 1, 3)")(lambda df: export.hub_metadata(_hub_rows(df), include_video=True))
on_items("snk4_clips_plan", f", {_EXPORT}, c AS (SELECT *, CASE WHEN d <= 0 THEN 'unknown' WHEN d < 2 THEN 'dur_0-2s' WHEN d < 4 THEN 'dur_2-4s' WHEN d < 8 THEN 'dur_4-8s' WHEN d < 16 THEN 'dur_8-16s' ELSE 'dur_16s+' END AS folder FROM (SELECT s.*, (i.size % 41) / 2.0::DOUBLE AS d FROM s JOIN items i ON i.path = s.path)) SELECT path, folder, stem || CASE WHEN k = 0 THEN '' ELSE '_' || k END AS name, caption FROM (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY category, source, path) - 1 AS k FROM c)")(
    lambda df: export.plan(export_rows(df).withColumn("duration", (F.col("size") % 41) / 2.0), "clips", bucket="duration").select("path", "folder", "name", "caption")
)

# ---- landed feeds, as dumps made from the tables ----

_POST = "p AS (SELECT doc_id, doc_id % 6 AS kind, CASE WHEN length(trim(source || chr(10) || text)) < 30 THEN source ELSE trim(source || chr(10) || text) END AS prompt FROM (SELECT * REPLACE (replace(text, '&', '+') AS text) FROM documents WHERE doc_id % 6 <> 5))"
query("src8_reddit_listing", f"""WITH {_POST} SELECT 'reddit_' || doc_id || '_' || i AS key, urls[i + 1] AS url, prompt FROM (SELECT *, unnest(range(len(urls))) AS i FROM (SELECT doc_id, prompt, CASE kind WHEN 0 THEN ['https://a/' || doc_id || '.jpg'] WHEN 1 THEN ['https://p/' || doc_id || '?a=1&b=2'] WHEN 2 THEN list_transform(range(1, 5), lambda n: CASE WHEN n = 2 THEN 'https://g/2.gif' ELSE 'https://g/' || doc_id || '-' || n || '.png' END) WHEN 3 THEN ['https://i.redd.it/' || doc_id] ELSE ['https://v/' || doc_id || '.mp4'] END AS urls FROM p))""")(
    lambda spark, d: feeds.reddit_listing(_posts(table(spark, d, "documents")), ("pics",))
)


def _posts(docs: DataFrame) -> DataFrame:
    """A listing with a post for each document: direct images, previews, galleries of five, hosted images and videos in turn."""
    kind, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    gallery = F.array(*[F.struct(F.lit(f"m{i}").alias("media_id")) for i in range(1, 6)])
    media = F.create_map(*[c for i in range(1, 6) for c in (F.lit(f"m{i}"), F.struct(F.struct(F.when(F.lit(i != 2), F.concat(F.lit("https://g/"), n, F.lit(f"-{i}.png"))).alias("u"), F.lit("https://g/2.gif").alias("gif")).alias("s")))])
    post = F.struct(
        n.alias("id"), F.when(kind == 5, "other").otherwise("Pics").alias("subreddit"), F.col("source").alias("title"), F.replace("text", F.lit("&"), F.lit("+")).alias("selftext"),
        F.when(kind == 0, F.concat(F.lit("https://a/"), n, F.lit(".jpg"))).when(kind == 3, F.concat(F.lit("https://i.redd.it/"), n)).alias("url"),
        F.when(kind == 1, F.struct(F.array(F.struct(F.struct(F.concat(F.lit("https://p/"), n, F.lit("?a=1&amp;b=2")).alias("url")).alias("source"))).alias("images"))).alias("preview"),
        F.when(kind == 2, F.struct(gallery.alias("items"))).alias("gallery_data"), F.when(kind == 2, media).alias("media_metadata"), F.when(kind == 4, F.struct(F.struct(F.concat(F.lit("https://v/"), n, F.lit(".mp4")).alias("fallback_url")).alias("reddit_video"))).alias("media"),
    )
    return docs.select(F.to_json(F.struct(F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data"))).alias("value"))


query("src9_discord_messages", "SELECT conv_id || '-' || turn || '_https://cdn/' || conv_id || '/' || turn || '.png' AS key, CASE WHEN turn % 4 = 2 THEN 'of file ' || turn ELSE trim(text) || ' | shown | foot' END AS prompt FROM conversations WHERE turn % 2 = 0 AND conv_id % 5 <> 0")(
    lambda spark, d: feeds.discord_messages(_messages(table(spark, d, "conversations")), table(spark, d, "conversations").filter("turn % 4 = 2").select(_image_url().alias("url"), F.concat(F.lit("of file "), "turn").alias("prompt"))).select("key", "prompt")
)


def _image_url():
    return F.concat(F.lit("https://cdn/"), "conv_id", F.lit("/"), "turn", F.lit(".png?x=1"))


def _messages(talk: DataFrame) -> DataFrame:
    """A message for each turn: known by type or by name only, wide ones, and grids by size or by buttons."""
    grid = F.col("conv_id") % 5 == 0
    file = F.struct(_image_url().alias("url"), F.when(F.col("conv_id") % 3 == 0, "image/png").alias("content_type"), F.lit("a.png").alias("filename"), F.when(grid, 2048).otherwise(4000).alias("width"), F.when(grid, 2048).otherwise(300).alias("height"))
    embed = F.struct(F.lit("shown").alias("description"), F.struct(F.lit("foot").alias("text")).alias("footer"))
    buttons = F.array(F.struct(F.array(F.struct(F.when(F.col("turn") % 2 == 1, "U1").otherwise("Vary").alias("label"))).alias("components")))
    return talk.select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.trim("text").alias("content"), F.struct(F.lit("Midjourney Bot").alias("username")).alias("author"), F.array(file).alias("attachments"), F.array(embed).alias("embeds"), buttons.alias("components"))).alias("value"))


query("src10_search_hits", "SELECT 'civitai_' || doc_id AS key, CASE WHEN doc_id % 3 = 2 THEN trim(text || ' and over twenty characters') ELSE trim(text) END AS prompt, CASE doc_id % 3 WHEN 0 THEN '.webp' WHEN 1 THEN '.png' ELSE '.jpg' END AS ext FROM documents WHERE n_chars % 3 = 0 AND (doc_id % 3 = 2 OR length(trim(text)) >= 15) AND doc_id % 7 > 3")(
    lambda spark, d: feeds.search_hits(_hits(table(spark, d, "documents")), base_models=("Flux",)).select("key", "prompt", "ext")
)


def _hits(docs: DataFrame) -> DataFrame:
    """A hit for each document: prompts of its own, of its generation data and in its node graph; some fail a check."""
    way, check = F.col("doc_id") % 3, F.col("doc_id") % 7
    node = F.struct(F.struct(F.concat("text", F.lit(" and over twenty characters")).alias("text"), F.lit("short").alias("text_g"), F.array(F.lit("9"), F.lit("0")).alias("clip")).alias("inputs"))
    meta = F.struct(F.when(way == 1, F.col("text")).alias("prompt"), F.when(way == 2, F.struct(F.create_map(F.lit("3"), node).alias("prompt"))).alias("comfy"))
    hit = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.lit("u").alias("url"), F.when(way == 1, "a.PNG").alias("name"), F.when(way == 0, "image/webp").alias("mimeType"), F.when(way == 0, F.concat(F.lit("Positive prompt: "), F.trim("text"))).alias("prompt"), F.lit("image").alias("type"),
        F.when(check == 0, 3).otherwise(2).alias("nsfwLevel"), (check == 1).alias("poi"), (check == 2).alias("minor"), F.when(check == 3, "SDXL").otherwise("Flux").alias("baseModel"), F.lit(64).alias("width"), (F.lit(64) + F.when(F.col("n_chars") % 3 == 0, 1).otherwise(0)).alias("height"), meta.alias("meta"),
    )
    return docs.select(F.to_json(hit).alias("value"))


query("src11_sidecar_records", "SELECT 'cat_' || doc_id || '_1' AS key, CASE WHEN doc_id % 2 = 0 THEN trim(source) ELSE 'a, b' END AS prompt FROM documents")(lambda spark, d: feeds.sidecar_records(table(spark, d, "documents").select(F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ").alias("caption"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.lit("cat").alias("category"), F.col("doc_id").cast("string").alias("id"), F.lit("1").alias("num"))).alias("value"))))
query("src11_sidecar_videos", "SELECT 'tube_' || doc_id AS key, CASE WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN trim(text) ELSE 'a b' END AS prompt FROM (SELECT * REPLACE (replace(text, '&', '+') AS text) FROM documents)")(lambda spark, d: feeds.sidecar_records(table(spark, d, "documents").select(F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("&"), F.lit("+"))).otherwise(" ").alias("description"), F.lit("a b").alias("tags"), F.lit("Tube").alias("extractor"), F.col("doc_id").cast("string").alias("id"))).alias("value")), "video"))
query("src12_x_posts", "SELECT 'x_' || page_id || '_' || substr(md5(src), 1, 8) AS key, CASE WHEN page_id % 2 = 0 THEN url || '?name=orig' ELSE url || '?format=png&name=orig' END AS url FROM (SELECT page_id, split_part(url, '?', 1) AS url, split_part(url, '?', 1) || CASE WHEN page_id % 2 = 0 THEN '?name=small' ELSE '?format=png&name=small' END AS src FROM pages)")(
    lambda spark, d: feeds.x_posts(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.substring_index("url", "?", 1), F.when(F.col("page_id") % 2 == 0, "?name=small").otherwise("?format=png&name=small")).alias("img_src")))
)
query("src5_read_vectors", "SELECT CAST(vec_id AS VARCHAR) AS key, embedding AS vec FROM embeddings")(lambda spark, d: media.read_vectors(table(spark, d, "embeddings").select(F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.to_json(F.struct(F.col("vec_id").cast("string").alias("key"), F.array(F.lit(1.0)).alias("vec"))).alias("value")), F.struct(F.lit(1).alias("seq"), F.to_json(F.struct(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vec"))).alias("value")), F.struct(F.lit(2).alias("seq"), F.lit("{broken").alias("value")))).alias("x")).select("x.*")))
query("snk9_put_vectors", "SELECT vec_id AS key, CASE WHEN vec_id % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS seq, CASE WHEN vec_id % 3 = 1 THEN list_reverse(embedding) ELSE embedding END AS vec FROM embeddings")(
    lambda spark, d: (lambda e: similarity.put_vectors(e.select(F.col("vec_id").alias("key"), F.lit(0).cast("bigint").alias("seq"), F.col("embedding").alias("vec")), e.filter("vec_id % 3 = 1").select(F.col("vec_id").alias("key"), F.lit(1).cast("bigint").alias("seq"), F.reverse("embedding").alias("vec"))))(table(spark, d, "embeddings"))
)

# ---- streaming forms, run over the whole table ----

query("st3_windowed_counts", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")(lambda spark, d: jobs.windowed_counts(telemetry_events(spark, d), "event_type").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total"))
query("st4_sliding_counts", "SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 20 MINUTE, ts), time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE, time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 40 MINUTE]) AS start FROM events) GROUP BY ALL")(lambda spark, d: jobs.windowed_counts(telemetry_events(spark, d), "event_type", "1 hour", "20 minutes").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n"))


def _walk(most: int, gap: float, slower: float) -> str:
    """SQL that admits row by row; times are divided by ``slower``."""
    budget = f"len(live) < {most}" if most > 0 else "true"
    return f"""WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) / 1e6::DOUBLE / {slower} AS s,
      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT event_id, event_type, k, true AS ok, [s] AS kept, s AS last FROM e WHERE k = 1
      UNION ALL SELECT event_id, event_type, k, ok, CASE WHEN ok THEN list_append(live, s) ELSE live END, CASE WHEN ok THEN s ELSE last END FROM (
        SELECT *, {budget} AND s - last >= {gap} AS ok FROM (
          SELECT e.event_id, e.event_type, e.k, e.s, w.last, list_filter(w.kept, lambda x: x > e.s - 60) AS live
          FROM w JOIN e ON e.event_type = w.event_type AND e.k = w.k + 1)))
    SELECT event_id, event_type FROM w WHERE ok"""


def _admitted(most: int, gap: float, slower: float):
    def run(spark, d):
        events = telemetry_events(spark, d).select("event_id", "event_type", "ts")
        return jobs.rolling_admission(events, "event_type", F.unix_micros("ts") / 1e6 / slower, most, gap, ["event_id"]).select("event_id", "event_type")

    return run


query("st6_rolling_admission", _walk(3, 1.0, 20))(_admitted(3, 1.0, 20))
query("st6_long_gap", _walk(2, 90.0, 20))(_admitted(2, 90.0, 20))
query("st6_gap_alone", _walk(0, 75.0, 5))(_admitted(0, 75.0, 5))
query("st2_first_seen", "SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id")(lambda spark, d: jobs.first_seen(telemetry_events(spark, d), "user_id").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")))
