"""All registered queries of the curation operators with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import keywords, scalars
from millrace.items import ITEMS_CTE, items
from millrace.operators import accounting, catalogue, similarity, vector_index
from millrace.session import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
KEPT = ("Keep",)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def on_items(name: str, sql: str | None = None):
    """A query over the items view; ``sql`` may use the view ``items``."""
    return lambda fn: query(name, sql and f"WITH {ITEMS_CTE} {sql}")(lambda spark, sf_dir: fn(items(spark, sf_dir)))


LISTED = ["path", "source", "category", "ovr", "rel"]
TOP = "ORDER BY ovr DESC NULLS LAST, mtime DESC, path"

on_items("f8_list_items", f"SELECT path, source, category, ovr, rel FROM items WHERE status = 'sorted' AND category = 'Keep' AND ovr >= 60 {TOP} LIMIT 50")(lambda df: catalogue.page(catalogue.list_items(df, categories=["Keep"], min_ovr=60), "ovr").select(*LISTED))
on_items("f8_list_items_filters", "SELECT path, source, category, ovr, rel FROM items WHERE status = 'sorted' AND source IN ('src0', 'src1', 'src2') AND NOT coalesce(nsfw, false) AND rel >= 20")(lambda df: catalogue.list_items(df, sources=["src0", "src1", "src2"], nsfw=False, min_rel=20).select(*LISTED))
on_items("f8_total", "SELECT count(*) AS total FROM items WHERE status = 'sorted' AND category = 'Keep'")(lambda df: catalogue.list_items(df, categories=["Keep"]).agg(F.count("*").alias("total")))
for _key, _sql in {"newest": "mtime DESC, path", "oldest": "mtime, path", "ovr": "ovr DESC NULLS LAST, mtime DESC, path", "rel": "rel DESC NULLS LAST, mtime DESC, path", "quality": "quality DESC NULLS LAST, mtime DESC, path"}.items():
    on_items(f"s1_sort_{_key}", f"SELECT path, mtime, ovr FROM items WHERE status = 'sorted' ORDER BY {_sql} LIMIT 40 OFFSET 20")(lambda df, k=_key: catalogue.page(df.filter("status = 'sorted'"), k, 40, 20).select("path", "mtime", "ovr"))
on_items("s2_recent", "SELECT path, mtime FROM items WHERE status = 'queue' ORDER BY mtime DESC, path LIMIT 60")(lambda df: catalogue.page(df.filter("status = 'queue'"), "newest", 60).select("path", "mtime"))
on_items("s3_top_gallery", f"SELECT path, ovr, substr(prompt, 1, 800) AS prompt FROM items WHERE status = 'sorted' AND category = 'Keep' AND topic_slug = 'en' {TOP} LIMIT 12")(lambda df: catalogue.top_gallery(df, "en", "Keep", 12).select("path", "ovr", "prompt"))
on_items("s4_sample_items", "SELECT path FROM items WHERE category = 'Keep' ORDER BY md5(path || '|' || '7'), path LIMIT 25")(lambda df: catalogue.sample_items(df, "Keep", 25, "7").select("path"))

on_items("a1_total", "SELECT count(*) AS n FROM items WHERE status = 'sorted'")(lambda df: df.filter("status = 'sorted'").agg(F.count("*").alias("n")))
on_items("a2_count_by_source", "SELECT source, count(*) AS n FROM items WHERE status = 'sorted' GROUP BY source")(lambda df: catalogue.count_by_source(df, "sorted"))
on_items("a3_count_queue_by_topic_source", "SELECT coalesce(nullif(topic_slug, ''), 'default') || '/' || source AS key, count(*) AS n FROM items WHERE status = 'queue' GROUP BY 1")(catalogue.count_queue_by_topic_source)
on_items("a4_count_sorted_by_topic_category", "SELECT coalesce(nullif(topic_slug, ''), 'default') AS slug, category, count(*) AS n FROM items WHERE status = 'sorted' AND category IS NOT NULL GROUP BY 1, 2")(catalogue.count_sorted_by_topic_category)
on_items("a5_status_source_rollup", "SELECT status, source, count(*) AS n FROM items GROUP BY ROLLUP (status, source)")(catalogue.status_source_rollup)
on_items("a6_ovr_histogram", "SELECT CAST(ovr // 10 * 10 AS INT) AS bucket, count(*) AS n FROM items WHERE status = 'sorted' AND ovr IS NOT NULL GROUP BY 1")(catalogue.ovr_histogram)
_LABEL = "CASE WHEN {c} >= 100 THEN '100-100' ELSE ({c} // 10 * 10) || '-' || ({c} // 10 * 10 + 9) END"
on_items("a7_score_distribution", f"SELECT axis, label, count(*) AS n FROM (SELECT 'ovr' AS axis, {_LABEL.format(c='ovr')} AS label FROM items WHERE status = 'sorted' UNION ALL SELECT 'rel', {_LABEL.format(c='rel')} FROM items WHERE status = 'sorted') GROUP BY ALL")(catalogue.score_distribution)
on_items("a8_job_stats", "SELECT category, count(*) AS n, count(*) FILTER (WHERE nsfw) AS n_nsfw, count(*) FILTER (WHERE size % 6 = 0 AND size % 5 > 0) AS n_overlay, count(*) FILTER (WHERE length(trim(prompt)) > 0) AS n_prompt FROM items WHERE status = 'sorted' AND category IS NOT NULL GROUP BY category")(lambda df: catalogue.job_stats(df.withColumn("vision_json", F.when(F.col("size") % 5 == 0, "{broken").otherwise(F.to_json(F.struct((F.col("size") % 6 == 0).alias("contains_text_overlay")))))))
for _col in catalogue.GROUPABLE:
    on_items(f"a9_distinct_{_col}", f"SELECT DISTINCT {_col} AS value FROM items WHERE {_col} IS NOT NULL")(lambda df, c=_col: catalogue.distinct_values(df, c))
_NORM = "CASE WHEN {c} > 1 THEN {c} / 100.0::DOUBLE ELSE {c} END"
_KIND = "CASE WHEN category IS NULL OR category IN ('DISCARD', 'CORRUPT') THEN 'discarded' WHEN contains(lower(category), 'borderline') THEN 'borderline' WHEN contains(lower(category), 'off') AND contains(lower(category), 'topic') THEN 'off_topic' WHEN category = 'Keep' THEN 'kept' ELSE 'discarded' END"
on_items("a10_digest", f"SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("kept", "borderline", "off_topic", "discarded")) + ", " + ", ".join(f"coalesce(round(avg({_NORM.format(c=c)}) FILTER (WHERE ovr > 0 OR rel > 0), 4), 0) AS avg_{c}" for c in ("ovr", "rel")) + f", count(*) FILTER (WHERE ovr > 0 OR rel > 0) AS sample_count FROM (SELECT *, {_KIND} AS kind FROM items WHERE status = 'sorted' AND mtime >= 200)")(lambda df: catalogue.digest(df, 200, KEPT))
on_items("a10_digest_categories", "SELECT category, count(*) AS n FROM items WHERE status = 'sorted' AND mtime >= 200 AND category IS NOT NULL GROUP BY category")(lambda df: catalogue.digest_categories(df, 200))
on_items("a11_digest_top_keeps", f"SELECT path, {_NORM.format(c='ovr')} AS score FROM items WHERE status = 'sorted' AND category = 'Keep' ORDER BY score DESC, mtime DESC, path LIMIT 10")(lambda df: catalogue.digest_top_keeps(df, 0, KEPT, 10).select("path", "score"))
on_items("a11_digest_outliers", f"SELECT path FROM items WHERE status = 'sorted' AND (size % 7 = 0 AND length(prompt) > 200 OR ({_NORM.format(c='ovr')}) BETWEEN 0.4 AND 0.6 AND category IN ('Keep', 'Borderline')) ORDER BY mtime DESC, path LIMIT 3")(lambda df: catalogue.digest_outliers(df.withColumn("reason", F.when(F.col("size") % 7 == 0, F.col("prompt")).otherwise("")), 0, "reason", ("Keep", "Borderline")).select("path"))
on_items("a12_norm_score", f"SELECT path, coalesce({_NORM.format(c='ovr')}, 0) AS score FROM items")(lambda df: df.select("path", scalars.norm_score(F.col("ovr")).alias("score")))

_QUERY = '(the AND of) OR NOT "an" that'
on_items("f1_keyword_query", "SELECT path FROM items WHERE (contains(lower(prompt), 'the') AND contains(lower(prompt), 'of')) OR NOT contains(lower(prompt), 'an') OR contains(lower(prompt), 'that')")(lambda df: df.filter(keywords.keyword_query(F.col("prompt"), _QUERY)).select("path"))
on_items("f2_keyword_any", "SELECT path FROM items WHERE contains(lower(prompt), 'license') OR contains(lower(prompt), 'token =')")(lambda df: df.filter(keywords.keyword_any(F.col("prompt"), [" License ", "", None, "token ="])).select("path"))
on_items("f3_topic_filter", """SELECT path, CASE WHEN length(trim(prompt)) < 400 THEN 'short prompt: ' || length(trim(prompt)) || ' of 400 characters' WHEN contains(lower(source || chr(10) || trim(prompt)), 'license') THEN 'holds a banned term'
  WHEN NOT contains(lower(source || chr(10) || trim(prompt)), 'the') THEN 'lacks the required terms' WHEN NOT contains(lower(trim(prompt)), 'thth') THEN 'lacks any hint' ELSE 'ok' END AS reason FROM items""")(lambda df: keywords.topic_filter(df, "source", "prompt", required="the", banned=["license"], hints=["thth"], min_length=400).select("path", "reason"))
_STOP = ", ".join(f"'{w}'" for w in keywords.STOPWORDS)
query(
    "f4_auto_keywords",
    f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(topic), '[a-z][a-z-]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))) AS words FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'The Instagram man of ' ELSE '' END || text AS topic FROM conversations))
    SELECT conv_id, turn, list_sort(words || CASE WHEN list_has_any(words, {list(keywords.INFLUENCER)}) THEN {list(keywords.INFLUENCER_ADDS)} ELSE [] END || CASE WHEN list_has_any(words, {list(keywords.MAN)}) THEN {list(keywords.MAN_ADDS)} ELSE [] END) AS words FROM w""",
)(lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", F.sort_array(keywords.auto_keywords(F.concat(F.when(F.col("turn") % 3 == 0, "The Instagram man of ").otherwise(""), "text"))).alias("words")))
on_items("f5_media_policy", "SELECT path, CASE WHEN ends_with(path, '.txt') THEN NULL ELSE 'image' END AS kind FROM (SELECT CASE WHEN size % 2 = 0 THEN replace(path, '.txt', '.JPG') ELSE path END AS path FROM items)")(lambda df: df.select(F.when(F.col("size") % 2 == 0, F.replace("path", F.lit(".txt"), F.lit(".JPG"))).otherwise(F.col("path")).alias("path")).withColumn("kind", scalars.media_kind(F.col("path"))))
on_items("f6_min_bytes", "SELECT path, size FROM items WHERE size >= 5000")(lambda df: df.filter(scalars.min_bytes(F.col("size"))).select("path", "size"))
on_items("f9_resolve_categories", "SELECT DISTINCT category FROM items WHERE category IN ('Keep', 'Borderline')")(lambda df: catalogue.resolve_categories(df, df.sparkSession.createDataFrame([("Keep",), ("Borderline",), ("DISCARD",)], "name string")))
on_items("f12_safe_component", "SELECT path, parse_filename(path) AS name FROM items")(lambda df: df.select("path", scalars.safe_component(F.col("path"), "item").alias("name")))
on_items("p1_to_item", "SELECT path, CASE WHEN size % 3 = 0 THEN '' ELSE prompt END AS prompt, nsfw, CASE WHEN size % 4 = 0 THEN NULL ELSE concat('{\"n\":', size, '}') END AS vision_json FROM items")(
    lambda df: catalogue.to_item(df.select("path", F.when(F.col("size") % 3 != 0, F.col("prompt")).alias("prompt"), F.col("nsfw").cast("int").alias("nsfw"), F.when(F.col("size") % 4 == 0, "{bad").otherwise(F.to_json(F.struct(F.col("size").alias("n")))).alias("vision_json")))
)
on_items("f11_per_slug_gates", "SELECT path FROM items WHERE status = 'sorted' AND ovr >= CASE topic_slug WHEN 'en' THEN 65 WHEN 'fr' THEN 80 ELSE 0 END AND rel >= CASE topic_slug WHEN 'en' THEN 55 ELSE 0 END")(lambda df: catalogue.per_slug_gates(df.filter("status = 'sorted'"), df.sparkSession.createDataFrame([("en", 65, 55), ("fr", 80, 0), ("de", None, None)], "topic_slug string, ovr_min int, rel_min int")).select("path"))

on_items("w1_round_robin", "SELECT path, source, row_number() OVER (PARTITION BY source ORDER BY path) AS turn FROM items WHERE status = 'queue'")(lambda df: catalogue.round_robin(df.filter("status = 'queue'"), "path").select("path", "source", "turn"))
on_items("w2_weighted_round_robin", "SELECT path, slug, slot // CASE slug WHEN 'en' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END AS cycle, slot FROM (SELECT path, topic_slug AS slug, row_number() OVER (PARTITION BY topic_slug ORDER BY source, path) - 1 AS slot FROM items WHERE status = 'queue')")(
    lambda df: catalogue.weighted_round_robin(df.filter("status = 'queue'").withColumnRenamed("topic_slug", "slug"), df.sparkSession.createDataFrame([("en", 0, 3), ("fr", 1, 2), ("de", 2, 0), ("es", 3, 1)], "slug string, pos int, weight int"), ["source", "path"]).select("path", "slug", F.col("cycle").cast("long").alias("cycle"), F.col("slot").cast("long").alias("slot"))
)
on_items("w10_unique_stems", "SELECT path, source || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS name FROM (SELECT path, source, row_number() OVER (PARTITION BY topic_slug, source ORDER BY path) - 1 AS n FROM items)")(lambda df: catalogue.unique_stems(df, "topic_slug", "source", ["path"]).select("path", "name"))
on_items("j2_new_items", "SELECT path FROM items WHERE status = 'sorted' AND path NOT IN (SELECT path FROM items WHERE size % 3 = 0)")(lambda df: catalogue.new_items(df.filter("status = 'sorted'"), df.filter("size % 3 = 0"), "path", [F.asc("mtime")]).select("path"))
on_items("j4_diff_listing", "SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.mtime > b.mtime + 1e-6 THEN 'updated' ELSE 'unchanged' END AS change FROM (SELECT path, mtime + CASE WHEN size % 5 = 0 THEN 1 ELSE 0 END AS mtime FROM items WHERE size % 7 <> 0) a FULL JOIN (SELECT path, mtime FROM items WHERE size % 11 <> 0) b ON a.path = b.path")(
    lambda df: catalogue.diff_listing(df.filter("size % 7 <> 0").select("path", (F.col("mtime") + F.when(F.col("size") % 5 == 0, 1).otherwise(0)).alias("mtime")), df.filter("size % 11 <> 0"))
)
on_items("snk6_upsert_items", "SELECT path, CASE WHEN size % 3 = 0 THEN 'Moved' ELSE category END AS category, 'hash' || (size % 9) AS phash FROM items")(lambda df: catalogue.upsert_items(df.withColumn("phash", F.concat(F.lit("hash"), F.col("size") % 9)).select("path", "category", "phash"), df.filter("size % 3 = 0").select("path", F.lit("Moved").alias("category"))).select("path", "category", "phash"))
on_items("snk8_delete_items", "SELECT path FROM items WHERE nsfw IS DISTINCT FROM true")(lambda df: catalogue.delete_items(df, df.filter("nsfw")).select("path"))
on_items("r3_recategorise", "SELECT path, CASE WHEN size % 4 = 0 THEN 'Keep' ELSE category END AS category FROM items")(lambda df: catalogue.recategorise(df, df.select("path", "size").filter("size % 4 = 0 OR size % 4 = 1").select("path", F.when(F.col("size") % 4 == 0, "Keep").otherwise("Nowhere").alias("target"), F.lit(1).alias("seq")), ["Keep", "Borderline"])[0].select("path", "category"))
on_items("a18_audit_tree", "SELECT category, source, count(*) FILTER (WHERE i AND t) AS triple, count(*) FILTER (WHERE i AND NOT t) AS orphan_image, count(*) FILTER (WHERE NOT i AND t) AS orphan_txt, count(*) FILTER (WHERE NOT i AND NOT t) AS orphan_json FROM (SELECT category, source, size % 3 <> 0 AS i, size % 2 = 0 AS t FROM items WHERE category IS NOT NULL) GROUP BY GROUPING SETS ((category, source), ())")(
    lambda df: catalogue.audit_tree(df.filter("category IS NOT NULL").select("category", "source", F.col("path").alias("stem"), F.explode(F.expr("filter(array(if(size % 3 <> 0, 'image', null), if(size % 2 = 0, 'txt', null), 'json'), k -> k is not null)")).alias("kind")))
)
on_items("d1_exact_dedup", "SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY md5(prompt) ORDER BY mtime, path) AS n FROM items) WHERE n = 1")(lambda df: catalogue.latest(df.withColumn("_key", F.md5("prompt")), ["_key"], [F.asc("mtime"), F.asc("path")]).select("path"))
on_items("sc1_split_bucket", "SELECT path, CASE WHEN ('0x' || substr(sha1(path), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.2 THEN 'val' ELSE 'train' END AS split FROM items")(lambda df: df.select("path", scalars.split_bucket(F.col("path"), 0.2).alias("split")))
on_items("sc2_trigger_word", "SELECT path, CASE WHEN starts_with(prompt, 'The,') OR starts_with(prompt, 'The ') OR prompt = 'The' THEN prompt WHEN prompt = '' THEN 'The' ELSE 'The, ' || prompt END AS caption FROM items")(lambda df: df.select("path", scalars.trigger_word(F.col("prompt"), "The").alias("caption")))
on_items("sc3_duration_label", "SELECT path, CASE WHEN d <= 0 THEN 'unknown' WHEN d < 2 THEN 'dur_0-2s' WHEN d < 4 THEN 'dur_2-4s' WHEN d < 8 THEN 'dur_4-8s' WHEN d < 16 THEN 'dur_8-16s' ELSE 'dur_16s+' END AS label, CASE WHEN d <= 0 THEN 'unknown' ELSE 'fps_' || CAST(round_even(d, 0) AS BIGINT) END AS fps FROM (SELECT path, (size % 41) / 2.0::DOUBLE AS d FROM items)")(lambda df: df.withColumn("d", (F.col("size") % 41) / 2.0).select("path", scalars.duration_label(F.col("d")).alias("label"), scalars.fps_label(F.col("d")).alias("fps")))
on_items("sc9_recover_id", "SELECT path, 'i' || size AS id FROM items")(lambda df: df.select("path", scalars.recover_id(F.concat_ws("_", F.lit("keep"), F.concat(F.lit("i"), F.col("size")), F.lit("1700000000"), F.lit("123"))).alias("id")))
on_items("sc11_slugify", "SELECT path, trim(regexp_replace(lower(path), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM items")(lambda df: df.select("path", scalars.slugify(F.col("path")).alias("slug")))
on_items("sc16_frame_offsets", "SELECT path, [size / 4.0::DOUBLE * 1, size / 4.0::DOUBLE * 2, size / 4.0::DOUBLE * 3] AS offsets FROM items WHERE size > 0")(lambda df: df.filter("size > 0").select("path", scalars.frame_offsets(F.col("size").cast("double"), 3).alias("offsets")))

_CORR = "corr AS (SELECT d.lang AS slug, CAST(d.doc_id AS VARCHAR) AS image_key, CASE WHEN l.quality = 1 THEN 'Keep' ELSE 'DISCARD' END AS predicted, CASE WHEN l.toxic = 1 THEN 'DISCARD' WHEN d.n_chars % 3 = 0 THEN 'DISCARD' ELSE 'Keep' END AS corrected, CAST(d.n_chars % 101 AS DOUBLE) AS ovr, CAST((d.n_chars * 7) % 101 AS DOUBLE) AS rel, d.doc_id AS ts FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def corrections(spark, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(lab, "doc_id")
    corrected = F.when(F.col("toxic") == 1, "DISCARD").when(F.col("n_chars") % 3 == 0, "DISCARD").otherwise("Keep")
    return rows.select(F.col("lang").alias("slug"), F.col("doc_id").cast("string").alias("image_key"), F.when(F.col("quality") == 1, "Keep").otherwise("DISCARD").alias("predicted"), corrected.alias("corrected"), (F.col("n_chars") % 101).cast("double").alias("ovr"), ((F.col("n_chars") * 7) % 101).cast("double").alias("rel"), F.col("doc_id").alias("ts"), F.col("doc_id").alias("seq"), F.lit(None).cast("string").alias("note"))


_RING = "ring AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ts DESC, image_key) AS rn FROM corr) WHERE rn <= 500)"
query("a17_correction_stats", f"WITH {_CORR}, {_RING} SELECT slug, corrected, count(*) AS n FROM ring GROUP BY ALL")(lambda spark, d: accounting.correction_stats(corrections(spark, d)))
query("w4_exemplars", f"WITH {_CORR}, {_RING} SELECT slug, corrected, image_key, 'user moved ' || predicted || ' → ' || corrected AS note FROM (SELECT *, row_number() OVER (PARTITION BY slug, corrected ORDER BY ts DESC, image_key) AS k FROM ring) WHERE k <= 3")(lambda spark, d: accounting.exemplars(corrections(spark, d), 3).select("slug", "corrected", "image_key", "note"))
query(
    "w6_suggest_thresholds",
    f"""WITH RECURSIVE {_CORR}, {_RING}, long AS (SELECT slug, axis, CASE WHEN corrected = 'DISCARD' AND predicted = 'Keep' THEN 'up' WHEN corrected = 'Keep' AND predicted = 'DISCARD' THEN 'down' END AS side, score, row_number() OVER (PARTITION BY slug, axis, CASE WHEN corrected = 'DISCARD' THEN 'up' ELSE 'down' END ORDER BY ts, image_key) AS k
      FROM (SELECT *, 'ovr' AS axis, ovr AS score FROM ring WHERE predicted <> corrected UNION ALL SELECT *, 'rel', rel FROM ring WHERE predicted <> corrected)),
    fold AS (SELECT slug, axis, side, k, score AS acc FROM long WHERE k = 1 UNION ALL SELECT l.slug, l.axis, l.side, l.k, 0.3::DOUBLE * l.score + 0.7::DOUBLE * f.acc FROM fold f JOIN long l ON l.slug = f.slug AND l.axis = f.axis AND l.side = f.side AND l.k = f.k + 1),
    p AS (SELECT slug, axis, side, max(k) AS n, CASE WHEN max(k) < 3 THEN 0 ELSE (2 + (max(k) - 3)) * greatest(0.1::DOUBLE, arg_max(acc, k) / 100) END AS p FROM fold GROUP BY ALL)
    SELECT slug, axis, coalesce(max(n) FILTER (WHERE side = 'up'), 0) AS false_keeps, coalesce(max(n) FILTER (WHERE side = 'down'), 0) AS false_drops, CAST(least(greatest(round_even(coalesce(max(p) FILTER (WHERE side = 'up'), 0) - coalesce(max(p) FILTER (WHERE side = 'down'), 0), 0), -15), 15) AS INT) AS delta FROM p GROUP BY ALL""",
)(lambda spark, d: accounting.suggest_thresholds(corrections(spark, d)).select("slug", "axis", "false_keeps", "false_drops", "delta"))


def telemetry_events(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "ok": F.col("event_type") != "error", "latency_ms": F.col("value"), "tokens": F.col("event_id") % 100, "model": F.concat(F.col("event_type"), F.lit("-2024"))})


_TEL = "tel AS (SELECT *, event_type <> 'error' AS ok, value AS latency_ms, event_id % 100 AS tokens FROM events)"
query("a13_telemetry", f"WITH {_TEL} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_error, count(*) FILTER (WHERE NOT ok) / count(*)::DOUBLE AS error_rate, coalesce(CASE WHEN sum(latency_ms) FILTER (WHERE ok) > 0 THEN sum(tokens) FILTER (WHERE ok) / (sum(latency_ms) FILTER (WHERE ok) / 1000) ELSE 0 END, 0) AS tokens_per_s, coalesce(quantile_disc(latency_ms, 0.5) FILTER (WHERE ok), 0) AS p50_ms, coalesce(quantile_disc(latency_ms, 0.95) FILTER (WHERE ok), 0) AS p95_ms FROM tel GROUP BY event_type")(lambda spark, d: accounting.telemetry(telemetry_events(spark, d), ["event_type"]))
query("a14_drain_eta", "SELECT user_id, CASE WHEN count(*) <= 0 THEN 0 WHEN avg(value) <= 0 THEN 'inf'::DOUBLE ELSE count(*) / avg(value) END AS eta FROM events GROUP BY user_id")(lambda spark, d: table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("rate")).select("user_id", accounting.drain_eta(F.col("n"), F.col("rate")).alias("eta")))
_PRICES = [("p", 1.0, 2.0), ("purchase", 3.0, 6.0), ("purchase-2", 4.0, 8.0), ("click", 0.4, 0.2)]
_COST = "cost AS (SELECT event_id, user_id, event_type, ts, round((greatest(0, event_id - 50) * CASE WHEN event_type = 'purchase' THEN 4.0 WHEN event_type = 'click' THEN 0.4 WHEN starts_with(event_type, 'p') THEN 1.0 ELSE 0 END::DOUBLE + (event_id % 100) * CASE WHEN event_type = 'purchase' THEN 8.0 WHEN event_type = 'click' THEN 0.2 WHEN starts_with(event_type, 'p') THEN 2.0 ELSE 0 END::DOUBLE) / 1e6, 6) AS cost FROM events)"


def costed(spark, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame(_PRICES, "prefix string, price_in double, price_out double")
    rows = accounting.with_prices(telemetry_events(spark, sf_dir), prices)
    return rows.withColumn("cost", accounting.estimate_cost(F.col("event_id") - 50, F.col("tokens"), F.col("price_in"), F.col("price_out")))


query("a15_estimate_cost", f"WITH {_COST} SELECT event_id, cost FROM cost")(lambda spark, d: costed(spark, d).select("event_id", "cost"))
query("a16_cost_totals", f"WITH {_COST} SELECT CAST(user_id AS VARCHAR) AS slug, CAST(sum(event_id % 100) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost, count(*) AS calls, arg_max(event_type, ts) AS provider FROM cost GROUP BY 1")(lambda spark, d: accounting.cost_totals(costed(spark, d).withColumn("slug", F.col("user_id").cast("string")).withColumn("provider", F.col("event_type"))).drop("last_call"))
_HOUR = "hour AS (SELECT *, epoch_us(ts) AS us, round(sum(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 4) AS hourly FROM events)"


def hourly(spark, sf_dir: str) -> DataFrame:
    return accounting.hourly_spend(telemetry_events(spark, sf_dir), "event_type", F.unix_micros("ts"), "value")


query("w7_hourly_spend", f"WITH {_HOUR} SELECT event_id, hourly FROM hour")(lambda spark, d: hourly(spark, d).select("event_id", "hourly"))
query("w8_spend_alerts", f"WITH {_HOUR} SELECT event_id, hourly FROM (SELECT *, row_number() OVER (PARTITION BY event_type, us // 3600000000 ORDER BY us, event_id) AS n FROM hour WHERE hourly >= 200) WHERE n = 1")(lambda spark, d: accounting.spend_alerts(hourly(spark, d), "event_type", 200, "event_id").select("event_id", "hourly"))
query("w9_threshold_crossings", "SELECT event_type, day, n FROM (SELECT *, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY day), -1) AS before FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)) WHERE before < 70 AND n >= 70")(lambda spark, d: accounting.threshold_crossings(table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), ["event_type"], "day", 70).select("event_type", "day", "n"))
query("w11_minute_cap", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 60000000 ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2")(lambda spark, d: accounting.minute_cap(telemetry_events(spark, d), "event_type", F.unix_micros("ts") / 1e6, 2, ["ts", "event_id"]).select("event_id"))
query("w5_ewma", f"WITH RECURSIVE {_CORR}, {_RING}, s AS (SELECT slug, ovr, row_number() OVER (PARTITION BY slug ORDER BY ts, image_key) AS k FROM ring), f AS (SELECT slug, k, ovr AS acc FROM s WHERE k = 1 UNION ALL SELECT s.slug, s.k, 0.3::DOUBLE * s.ovr + 0.7::DOUBLE * f.acc FROM f JOIN s ON s.slug = f.slug AND s.k = f.k + 1) SELECT slug, round(arg_max(acc, k), 6) AS ewma FROM f GROUP BY slug")(
    lambda spark, d: accounting.recent_corrections(corrections(spark, d)).groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("ts", "image_key", "ovr"))).alias("v")).select("slug", F.round(accounting.ewma(F.transform("v", lambda x: x["ovr"])), 6).alias("ewma"))
)

_SIG = "sig AS (SELECT vec_id, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN 1::UBIGINT << (64 - i)::UBIGINT ELSE 0::UBIGINT END), lambda a, b: a | b) AS s FROM embeddings)"


def signatures(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", similarity.signature(F.col("embedding")).alias("s"))


query("d2_near_hash_pairs", f"WITH {_SIG} SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.s, b.s)) AS INT) AS distance FROM sig a JOIN sig b ON a.vec_id < b.vec_id AND bit_count(xor(a.s, b.s)) <= 15")(lambda spark, d: similarity.near_hash_pairs(signatures(spark, d), "vec_id", "s", 15))
query("d3_near_hash_groups", f"WITH RECURSIVE {_SIG}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sig a JOIN sig b ON a.vec_id <> b.vec_id AND bit_count(xor(a.s, b.s)) <= 15), c AS (SELECT vec_id AS a, vec_id AS b FROM sig UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b) SELECT a AS vec_id, min(b) AS component FROM c GROUP BY a")(lambda spark, d: similarity.near_hash_groups(signatures(spark, d), "vec_id", "s", 15))
_LINKS = "n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b, least(greatest(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), -1), 1) AS cosine FROM n a JOIN n b ON a.vec_id < b.vec_id AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.4)"
_COMP = "c AS (SELECT vec_id AS a, vec_id AS b FROM n UNION SELECT c.a, CASE WHEN l.a = c.b THEN l.b ELSE l.a END FROM c JOIN l ON l.a = c.b OR l.b = c.b), g AS (SELECT a AS vec_id, min(b) AS component FROM c GROUP BY a)"
query("d4_near_vector_pairs", f"WITH {_LINKS} SELECT a, b, cosine FROM l")(lambda spark, d: similarity.near_vector_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4))
query("d5_near_groups", f"WITH RECURSIVE {_LINKS}, {_COMP} SELECT vec_id, component FROM g")(lambda spark, d: similarity.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4))
query("w3_balance", f"WITH RECURSIVE {_LINKS}, {_COMP} SELECT vec_id, component FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY vec_id) AS k FROM g) WHERE k <= 1")(lambda spark, d: similarity.first_of_groups(similarity.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4), "vec_id", 1))
_PROBE = [0.5 if i % 3 else -0.25 for i in range(64)]
query("d6_semantic_search", f"SELECT 'q' AS query_id, vec_id, cosine FROM (SELECT vec_id, list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) AS cosine FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, {_PROBE}::DOUBLE[] AS q FROM embeddings)) ORDER BY cosine DESC, vec_id LIMIT 10")(lambda spark, d: similarity.semantic_search(table(spark, d, "embeddings"), [("q", _PROBE, 10)], "vec_id", "embedding").select("query_id", "vec_id", "cosine"))


def indexed_search(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, through the index; the vector itself is one of them."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(10).alias("top_k"))
    found, _ = vector_index.search(vector_index.build(vectors, "vec_id", "embedding", 100), queries)
    return found.select("query_id", F.col("k").alias("vec_id"), "cosine", "nth")


query(
    "d6_vector_index",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    c AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))), 12) AS cosine
      FROM e JOIN e AS q ON q.vec_id % 50 = 0)
    SELECT query_id, vec_id, cosine, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS nth FROM c) WHERE nth <= 10""",
)(indexed_search)

from millrace import registry_extra, registry_files, registry_judging, registry_more  # noqa: E402,F401  (add to QUERIES and SQL)
