"""Queries of the judging rules, with SQL that follows them step by step."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.items import ITEMS_CTE, items
from millrace.plans import routing
from millrace.registry import query
from millrace.session import table

_NEG = "|".join(n.replace("'", "''") if " " in n or "'" in n else rf"\b{n}\b" for n in routing.NEGATIONS)


def positive_terms_cte(rows: str, lists: dict[str, tuple[str, ...]]) -> str:
    """``first_terms (id, list, term)`` over ``rows (id, list, hay)``: the twin of first_positive_term for named lists of terms.

    Letters beyond ASCII become one of ASCII for word boundaries, which this SQL's patterns see in ASCII alone."""
    quoted = lambda t: t.replace("'", "''")
    kind = lambda t: "" if re.search(r"[ \-/.,]", t) else "w"
    values = ", ".join(f"('{name}', {i}, '{quoted(t)}', '{kind(t)}')" for name, terms in lists.items() for i, t in enumerate(terms))
    return rf"""terms(list, ord, term, kind) AS (VALUES {values}),
    cuts AS (SELECT r.id, r.list, r.hay, t.ord, t.term, CASE WHEN t.kind = 'w' THEN regexp_split_to_array(regexp_replace(r.hay, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}]', 'z', 'g'), '\b' || t.term || '\b') ELSE string_split(r.hay, t.term) END AS parts FROM {rows} r JOIN terms t ON t.list = r.list WHERE contains(r.hay, t.term)),
    spots AS (SELECT id, list, ord, term, right(left(hay, CAST(list_sum(list_transform(parts[1 : i], lambda p: length(p))) + (i - 1) * length(term) AS BIGINT)), {routing.NEGATION_REACH}) AS before FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM cuts)),
    first_terms AS (SELECT id, list, arg_min(term, ord) AS term FROM spots WHERE NOT regexp_matches(regexp_extract(before, '[^.;]*$'), '{_NEG}') GROUP BY ALL)"""


_WORDS = ("token =", "the", "and", "que", "der")
query("sc15_first_positive_term", f"WITH hay AS (SELECT doc_id AS id, 'w' AS list, lower(CASE doc_id % 3 WHEN 0 THEN 'There is no ' ELSE '' END || text) AS hay FROM documents), {positive_terms_cte('hay', {'w': _WORDS})} SELECT d.doc_id, f.term FROM documents d LEFT JOIN first_terms f ON f.id = d.doc_id")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", routing.first_positive_term(F.concat(F.when(F.col("doc_id") % 3 == 0, "There is no ").otherwise(""), "text"), _WORDS).alias("term"))
)

_TEXTS = ("a woman in a red dress, no watermark visible", "a statue of a woman", "side-by-side panels of a girl", "screenshot of a browser window", "a mountain landscape", "portrait of a woman with a watermark", "a man near a car")
_LISTS = {"screen": routing.SCREEN_TERMS, "grid": routing.GRID_TERMS, "overlay": routing.OVERLAY_TERMS, "fem": routing.FEMININE_TERMS, "fem_subject": routing.FEMININE_TERMS, "statue_subject": routing.OBJECT_TERMS, "statue": routing.OBJECT_TERMS, "thing": routing.SUBJECT_TERMS}
_TAXONOMY = ("InstagramInfluencer", "Professional", "Amateur", "NSFW", "Watermarked", "Unknown")
_CATEGORY = "CASE WHEN size % 17 = 0 THEN 'Landscape' WHEN size % 19 = 0 THEN 'DISCARD' WHEN size % 2 = 0 THEN '{}' ELSE '{}' END"


def audits(spark, sf_dir: str, even: str, odd: str) -> DataFrame:
    """Model answers made from the catalogue's rows."""
    n = F.col("size")
    pick = F.element_at(F.array(*map(F.lit, _TEXTS)), (n % len(_TEXTS) + 1).cast("int"))
    return items(spark, sf_dir).select(
        "path", pick.alias("description"), F.when(n % 3 == 0, "woman").when(n % 3 == 1, "a statue").otherwise("person").alias("primary_subject"), F.when(n % 5 == 0, "Illustration").otherwise("photograph").alias("art_medium"),
        (n % 2 == 0).alias("photorealistic_style"), (n % 13 == 0).alias("has_ai_flaws"), (n % 4 != 0).alias("woman_present"), F.lit(True).alias("is_human_photograph"), "nsfw", F.col("ovr").alias("OVR_Quality_Score"), F.col("rel").alias("REL_Quality_Score"), F.col("quality").alias("quality_score"),
        F.when(n % 17 == 0, "Landscape").when(n % 19 == 0, "DISCARD").when(n % 2 == 0, even).otherwise(odd).alias("category"),
    )


def judged_sql(taxonomy: tuple[str, ...], even: str, odd: str) -> str:
    """The rules of apply_scores over those answers, for a taxonomy, with minima 40 and 20."""
    portrait = bool(set(routing.PORTRAIT) & set(taxonomy))
    has = {name: name in taxonomy for name in ("NSFW", "Watermarked", "Unknown")}
    says = {k: v.replace("'", "''") for k, v in routing.SAYS.items()}
    named = lambda key, term: f"'{says[key]}''' || trim({term}) || ''''"
    names = ", ".join(f"'{t}'" for t in taxonomy)
    texts = "[" + ", ".join(f"'{t}'" for t in _TEXTS) + "]"
    hay = " UNION ALL ".join(f"SELECT path AS id, '{k}' AS list, lower({'subject' if k.endswith('_subject') else 'description || chr(10) || subject'}) AS hay FROM a" for k in _LISTS)
    found = ", ".join(f"max(f.term) FILTER (WHERE f.list = '{k}') AS {k}" for k in _LISTS)
    mediums = "|".join(re.escape(t) for t in routing.NON_PHOTO_MEDIUMS)
    reasons = [
        f"CASE WHEN drawn THEN '{says['medium']}' || medium END",
        f"CASE WHEN screen IS NOT NULL THEN {named('screen', 'screen')} END",
        f"CASE WHEN grid IS NOT NULL THEN {named('grid', 'grid')} END",
        f"CASE WHEN overlay IS NOT NULL THEN {named('overlay', 'overlay')} END",
        f"CASE WHEN is_statue THEN {named('object', 'coalesce(statue_subject, statue)')} END",
        f"CASE WHEN is_thing THEN {named('thing', 'thing')} END",
        f"CASE WHEN lied THEN '{says['lied']}' END",
        f"CASE WHEN NOT photo THEN '{says['drawn']}' END",
        f"CASE WHEN NOT present THEN '{says['nobody']}' END",
        f"CASE WHEN NOT human THEN '{says['no photo']}' END",
    ]
    return f"""WITH {ITEMS_CTE},
    a AS (SELECT path, {texts}[size % {len(_TEXTS)} + 1] AS description, CASE size % 3 WHEN 0 THEN 'woman' WHEN 1 THEN 'a statue' ELSE 'person' END AS subject, CASE WHEN size % 5 = 0 THEN 'illustration' ELSE 'photograph' END AS medium,
      size % 2 = 0 AS photoreal, size % 13 = 0 AS flaws, size % 4 <> 0 AS woman, nsfw, least(greatest(ovr, 0), 100) AS o, least(greatest(rel, 0), 100) AS r, quality, {_CATEGORY.format(even, odd)} AS category FROM items),
    hay AS ({hay}), {positive_terms_cte("hay", _LISTS)},
    t AS (SELECT a.*, {found} FROM a LEFT JOIN first_terms f ON f.id = a.path GROUP BY ALL),
    u AS (SELECT *, regexp_matches(medium, '{mediums}') AS drawn, screen IS NOT NULL OR grid IS NOT NULL AS framed, statue_subject IS NOT NULL OR statue IS NOT NULL AND fem_subject IS NULL AS is_statue, thing IS NOT NULL AND fem_subject IS NULL AS is_thing FROM t),
    v AS (SELECT *, CASE WHEN framed THEN false WHEN medium = 'photograph' THEN true ELSE photoreal AND NOT drawn END AS photo, NOT is_statue AS human, woman AND NOT framed AND NOT is_statue AND NOT is_thing AS w FROM u),
    x AS (SELECT *, w AND fem IS NULL AS lied, CASE WHEN w AND fem IS NULL THEN false ELSE w OR fem_subject IS NOT NULL END AND (human OR fem_subject IS NOT NULL) AS present FROM v),
    y AS (SELECT *, {portrait} AND NOT (photo AND present AND human) AS gate, flaws AND quality <= 4 AS flawed, list_filter([{", ".join(reasons)}], lambda s: s IS NOT NULL) AS why FROM x),
    z AS (SELECT *, CASE WHEN gate OR flawed THEN 'DISCARD' WHEN {has["NSFW"]} AND nsfw THEN 'NSFW' WHEN {has["Watermarked"]} AND overlay IS NOT NULL THEN 'Watermarked' WHEN category = 'DISCARD' AND {portrait} AND {has["Unknown"]} THEN 'Unknown' ELSE category END AS c,
      CASE WHEN gate THEN array_to_string(why, '; ') WHEN flawed THEN '{says["flawed"]}' WHEN {has["NSFW"]} AND nsfw THEN NULL WHEN {has["Watermarked"]} AND overlay IS NOT NULL THEN {named("marked", "overlay")} WHEN category = 'DISCARD' AND {portrait} AND {has["Unknown"]} THEN '{says["rescued"]}' END AS why_c FROM y),
    k AS (SELECT *, c IN ({names}, 'DISCARD') AS known FROM z),
    l AS (SELECT path, o, r, photo, present, human, CASE WHEN known THEN c ELSE 'DISCARD' END AS c, CASE WHEN known THEN why_c ELSE concat_ws('; ', nullif(why_c, ''), '{says["unlisted"]}' || coalesce(c, '')) END AS why_c FROM k)
    SELECT path, o AS "OVR_Quality_Score", r AS "REL_Quality_Score", photo AS photorealistic_style, present AS woman_present, human AS is_human_photograph, CASE WHEN c <> 'NSFW' AND (o < 40 OR r < 20) THEN 'DISCARD' ELSE c END AS category,
      CASE WHEN c <> 'NSFW' AND r < 20 THEN 'REL{says["low"]}20: ' || r WHEN c <> 'NSFW' AND o < 40 THEN 'OVR{says["low"]}40: ' || o ELSE why_c END AS score_reason FROM l"""


_JUDGED = ["path", "OVR_Quality_Score", "REL_Quality_Score", "photorealistic_style", "woman_present", "is_human_photograph", "category", "score_reason"]
for _name, _taxonomy, _even, _odd in (("r1_apply_scores", _TAXONOMY, "Professional", "Amateur"), ("r1_other_taxonomy", ("Top", "Mid"), "Top", "Mid")):
    query(_name, judged_sql(_taxonomy, _even, _odd))(lambda spark, d, t=_taxonomy, e=_even, o=_odd: routing.apply_scores(audits(spark, d, e, o), t, 40, 20).select(*_JUDGED))
