"""Registered queries of prompts in files, key recovery, hashes, hooks and the smaller joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import prompts, scalars
from millrace.operators import catalogue, sets
from millrace.plans import hooks, jobs
from millrace.registry import on_items, query
from millrace.session import table
from millrace.sources import media

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

# ---- prompts of posts and files ----

query("sc6_prompt_of_post", f"""SELECT conv_id, turn, CASE WHEN length(text) < 20 THEN text WHEN turn % 4 = 0 THEN '{{"a": {{"b": "' || text || '"}}, "c": "' || repeat('x', 50) || '"}}' WHEN turn % 4 = 1 THEN '<role>' || text || '</role>' WHEN turn % 4 = 2 THEN {_TRIM.format("text")} WHEN length(text) > 40 THEN text ELSE '' END AS prompt FROM conversations""")(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", prompts.prompt_of_post(F.when(F.length("text") < 20, F.col("text")).when(F.col("turn") % 4 == 0, F.concat(F.lit('see {"a": {"b": "'), "text", F.lit('"}, "c": "' + "x" * 50 + '"} and more } {'))).when(F.col("turn") % 4 == 1, F.concat(F.lit("now <role>"), "text", F.lit("</role> then"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("My PROMPT - "), "text")).otherwise(F.col("text"))).alias("prompt"))
)


def _chunk(kind: str, body):
    """A PNG chunk; readers of texts don't look at its checksum."""
    return F.concat(F.unhex(F.lpad(F.hex(F.length(body)), 8, "0")), F.encode(F.lit(kind), "UTF-8"), body, F.unhex(F.lit("00000000")))


def _graph(text):
    node = lambda title, t: F.struct(F.lit("CLIPTextEncode").alias("class_type"), F.struct(t.alias("text")).alias("inputs"), F.struct(F.lit(title).alias("title")).alias("_meta"))
    return F.to_json(F.struct(F.struct(F.lit("KSampler").alias("class_type")).alias("1"), node("Negative", F.lit("ugly")).alias("2"), node("Positive", text).alias("3")))


def _png(text):
    zero = F.unhex(F.lit("00"))
    settings = F.concat(F.encode(F.lit("parameters"), "UTF-8"), F.unhex(F.lit("0000000000")), F.encode(F.concat(text, F.lit("\nNegative prompt: none\nSteps: 20")), "UTF-8"))
    workflow = F.concat(F.encode(F.lit("prompt"), "UTF-8"), F.unhex(F.lit("0000000000")), F.encode(_graph(text), "UTF-8"))
    note = F.concat(F.encode(F.lit("Author"), "UTF-8"), zero, F.encode(F.lit("someone"), "UTF-8"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), _chunk("IHDR", F.unhex(F.lit("00" * 13))), _chunk("tEXt", note))
    return F.when(F.col("doc_id") % 3 == 0, F.concat(head, _chunk("iTXt", settings), _chunk("IEND", F.encode(F.lit(""), "UTF-8")))).when(F.col("doc_id") % 3 == 1, F.concat(head, _chunk("iTXt", settings), _chunk("iTXt", workflow))).otherwise(F.encode(text, "UTF-8"))


query("sc7_png_text_prompt", f"SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN doc_id % 3 = 0 AND length(t) > 40 THEN t WHEN doc_id % 3 = 1 THEN t END AS prompt FROM (SELECT doc_id, {_TRIM.format('text')} AS t FROM documents)")(lambda spark, d: table(spark, d, "documents").select("doc_id", prompts.png_text_prompt(_png(F.col("text"))).alias("prompt")))
query("sc8_yaml_prompt", f"SELECT conv_id, turn, CASE WHEN turn % 3 < 2 AND t <> '' THEN t END AS prompt FROM (SELECT conv_id, turn, {_TRIM.format('text')} AS t FROM conversations)")(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", prompts.yaml_prompt(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("job:\n  \"prompt\": "), _graph(F.col("text")), F.lit("\n  seed: 1"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("{'prompt': "), _graph(F.col("text")), F.lit("}"))).otherwise(F.concat(F.lit('"prompt": none '), "text"))).alias("prompt"))
)
query("sc13_message_text", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE 'thought ' || text END AS said FROM conversations")(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", prompts.message_text(F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).when(F.col("turn") % 4 == 1, " \n").alias("content"), F.concat(F.lit("thought "), "text").alias("reasoning_content"))).alias("said"))
)
query("sc17_hub_score", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN n_chars % 101 WHEN 1 THEN n_chars / 8.0 WHEN 2 THEN 7 ELSE NULL END::DOUBLE AS score FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", prompts.hub_score(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"OVR_Quality_Score": '), F.col("n_chars") % 101, F.lit(', "REL_Quality_Score": 3}'))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"OVR_Quality_Score": true, "REL_Quality_Score": '), F.col("n_chars") / 8, F.lit("}"))).when(F.col("doc_id") % 5 == 2, '{"OVR_Quality_Score": "9", "quality_score": 7}').when(F.col("doc_id") % 5 == 3, '{"quality_score": null}').otherwise("{broken")).alias("score"))
)
query("sc19_vision_capable", "SELECT p_partkey, p_partkey % 3 = 0 OR regexp_matches(lower(p_type), 'vl|vision') AS sees FROM part")(lambda spark, d: table(spark, d, "part").select("p_partkey", prompts.vision_capable(F.concat("p_type", F.when(F.col("p_partkey") % 3 == 0, "-LLaVA-7b").otherwise(""))).alias("sees")))
query("sc19_pick_vision_model", "SELECT event_type, arg_min(event_id, CASE WHEN event_id % 10 = 7 THEN 0 ELSE 1000000000 END + event_id) || CASE WHEN count(*) FILTER (WHERE event_id % 10 = 7) > 0 THEN '-pixtral' ELSE '' END AS model FROM events GROUP BY event_type")(
    lambda spark, d: prompts.pick_vision_model(table(spark, d, "events").select("event_type", F.col("event_id").alias("position"), F.concat("event_id", F.when(F.col("event_id") % 10 == 7, "-pixtral").otherwise("")).alias("model")), "event_type")
)

# ---- seen sets, hashes, records ----

_SOURCE = ["civitai", "reddit", "twitter_x", "web"]
on_items("j3_recovered_keys", "SELECT DISTINCT CASE size % 4 WHEN 0 THEN 'civitai' WHEN 1 THEN 'reddit' ELSE 'twitter_x' END AS source, CASE size % 4 WHEN 2 THEN 'x_' || size || '_ab' ELSE CAST(size AS VARCHAR) END AS key FROM items WHERE size % 4 < 3")(
    lambda df: catalogue.recovered_keys(df.select("status", F.element_at(F.array(*map(F.lit, _SOURCE)), (F.col("size") % 4 + 1).cast("int")).alias("source"), F.concat(F.when(F.col("status") == "sorted", "keep_").otherwise(""), F.when(F.col("size") % 4 == 0, F.concat(F.lit("civitai_"), "size")).when(F.col("size") % 4 == 1, F.concat(F.lit("reddit_"), "size", F.lit("_0"))).when(F.col("size") % 4 == 2, F.concat(F.lit("x_"), "size", F.lit("_ab"))).otherwise("plain_1"), F.when(F.col("status") == "sorted", "_1700000000_123").otherwise(""), F.lit(".png")).alias("file")))
)
on_items("snk7_append_seen", "SELECT source, topic_slug AS slug, path AS key FROM items WHERE size % 3 = 0 OR size % 5 = 0")(lambda df: _seen(df)[0])
on_items("snk7_new_keys", "SELECT count(*) AS n FROM items WHERE size % 5 = 0 AND size % 3 <> 0")(lambda df: _seen(df)[1])


def _seen(df):
    keys = df.select("source", F.col("topic_slug").alias("slug"), F.col("path").alias("key"), "size")
    return catalogue.append_seen(keys.filter("size % 3 = 0"), keys.filter("size % 5 = 0").unionByName(keys.filter("size % 5 = 0")).unionByName(keys.limit(1).withColumn("key", F.lit(" "))), ["source", "slug", "key"])


on_items("snk8_deleted", "SELECT count(*) AS n FROM items WHERE nsfw")(lambda df: catalogue.deleted(df, df.filter("nsfw")))
on_items("d8_set_hash", "SELECT path, CASE WHEN size % 3 = 0 THEN 'new' || size WHEN size % 3 = 1 THEN NULL ELSE 'old' END AS phash FROM items WHERE topic_slug = 'en' AND status = 'sorted'")(
    lambda df: catalogue.hashes(catalogue.set_hash(df.withColumn("phash", F.lit("old")), df.filter("size % 3 < 2").select("path", F.when(F.col("size") % 3 == 0, F.concat(F.lit("new"), "size")).alias("phash")).unionByName(df.select(F.concat(F.lit("no"), "path").alias("path"), F.lit("x").alias("phash")))), "en", "sorted")
)
on_items("f13_audit_of", "SELECT 'doc/12.txt' AS path, CASE WHEN count(*) > 0 THEN '{\"size\":' || max(size) || '}' END AS audit, CASE WHEN count(*) = 0 THEN 'no such item' END AS error FROM items WHERE path = 'doc/12.txt' UNION ALL SELECT 'gone', NULL, 'no such item' FROM (SELECT count(*) FROM items)")(
    lambda df: (lambda rows: catalogue.audit_of(rows, "doc/12.txt").unionByName(catalogue.audit_of(rows, "gone")))(df.withColumn("vision_json", F.to_json(F.struct("size"))))
)

# ---- jobs ----

on_items("j11_requeue", "SELECT path, 'queue/' || topic_slug || '/' || source || '/i' || mtime::BIGINT || '.png' AS target, CASE WHEN size % 2 = 0 THEN '_archive/' || category || '/' || source || '/keep_i' || mtime::BIGINT || '_1700000000_123.vision.json' END AS archive FROM items WHERE status = 'sorted' AND category = 'Keep' AND size % 3 > 0 AND size % 7 > 0")(
    lambda df: jobs.requeue(_files(df), df.filter("size % 7 = 0").select(F.concat(F.lit("queue/"), "topic_slug", F.lit("/"), "source", F.lit("/i"), F.col("mtime").cast("long"), F.lit(".png")).alias("path")), categories=("Keep",))[0].select("path", "target", "archive")
)
on_items("r4_quarantine", "SELECT path, '.quarantine/' || category || '/' || source || '/keep_i' || mtime::BIGINT || '_1700000000_123.png' AS target FROM items WHERE status = 'sorted' AND size % 3 = 0")(lambda df: jobs.requeue(_files(df), df.select("path").limit(0))[1].select("path", "target"))


def _files(df):
    return df.withColumns({"stem": F.concat(F.lit("keep_i"), F.col("mtime").cast("long"), F.lit("_1700000000_123")), "ext": F.lit(".png"), "has_text": F.col("size") % 3 > 0, "has_audit": F.col("size") % 2 == 0})


query("j9_pick_healthy", "SELECT user_id AS id, n AS latency_ms FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE user_id % 3 <> 0")(
    lambda spark, d: jobs.pick_healthy(table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("position")), table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("latency_ms")).withColumn("ok", F.col("id") % 3 != 0)).select("id", "latency_ms")
)
query("j12_overlay_gates", "SELECT lang AS slug, CASE lang WHEN 'en' THEN 70 ELSE n % 50 END AS ovr_min, CASE lang WHEN 'fr' THEN ['z'] ELSE ['x', 'y'] END AS tags FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")(
    lambda spark, d: jobs.overlay_gates(table(spark, d, "documents").groupBy(F.col("lang").alias("slug")).agg((F.count("*") % 50).alias("ovr_min")).withColumn("tags", F.array(F.lit("x"), F.lit("y"))), spark.createDataFrame([("en", 70, None), ("fr", None, ["z"])], "slug string, ovr_min long, tags array<string>"), "slug")
)
query("u5_fleet_union", "SELECT event_type AS provider, CAST(user_id AS VARCHAR) AS model, min(event_id) AS position FROM events GROUP BY ALL")(
    lambda spark, d: jobs.fleet_union(table(spark, d, "events").select(F.col("event_type").alias("provider"), F.lit("http://m").alias("base_url"), F.col("user_id").cast("string").alias("model"), F.col("event_id").alias("position"), F.col("event_id").alias("id"))).select("provider", "model", "position")
)
on_items("u3_recovered_not_seen", "SELECT DISTINCT source FROM items WHERE ovr > 95 AND source NOT IN (SELECT source FROM items WHERE rel > 98)")(
    lambda df: sets.not_seen(df.filter("ovr > 95"), df.filter("rel > 98"), ["source"])
)
on_items("sc10_sorted_name", "SELECT path, lower(category) || '_i' || size || '_1700000000' AS name FROM items WHERE category IS NOT NULL")(lambda df: df.filter("category IS NOT NULL").select("path", F.substring_index(scalars.sorted_name(F.col("category"), F.concat(F.lit("i"), "size"), F.lit(1700000000)), "_", 3).alias("name")))
on_items("src6_local_folder", "SELECT path FROM items WHERE size >= 1000 AND length(trim(prompt)) >= 40 AND size % 3 > 0 AND size % 5 > 0 AND size % 7 > 0")(
    lambda df: (lambda rows: media.local_folder(rows, rows.filter("size % 3 = 0"), rows.filter("size % 5 = 0"), rows.filter("size % 7 = 0"), min_bytes=1000).select("path"))(df.withColumn("stem", F.col("path")))
)

# ---- hooks ----


def _letters(frames):
    """An embedder for the query: how often each of four letters stands in the prompt."""
    for f in frames:
        yield pd.DataFrame({"path": f["path"], "vec": [[float(t.count(c)) for c in "aeio"] if len(t) % 5 else [] for t in f["prompt"]]})


def _measures(frames):
    """A prober for the query; of every fourth clip it knows nothing."""
    for f in frames:
        n = f["path"].str.extract(r"(\d+)")[0].astype(int)
        yield pd.DataFrame({"path": f["path"], "width": n % 100, "height": 64, "fps": 24.0, "duration": n / 2})[n % 4 > 0]


_COUNT = "CAST(length(prompt) - length(replace(prompt, '{0}', '')) AS FLOAT)"
on_items("udf_embed_items", "SELECT path, [" + ", ".join(_COUNT.format(c) for c in "aeio") + "] AS vec FROM items WHERE length(prompt) % 5 > 0")(lambda df: hooks.embed_items(df.select("path", "prompt"), _letters))
on_items("udf_probe_videos", "SELECT path, CASE WHEN mtime::BIGINT % 4 = 0 THEN 0 ELSE mtime::BIGINT % 100 END::INT AS width, CASE WHEN mtime::BIGINT % 4 = 0 THEN 0.0::DOUBLE ELSE mtime / 2 END AS duration FROM items")(lambda df: hooks.probe_videos(df.select("path"), _measures).select("path", "width", "duration"))
