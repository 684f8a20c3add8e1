r"""Document fingerprints by I-Match with randomised lexicons (DataFrame operations only).

1. Terms are the lower-cased words of a text, known by 52 bits of their MD5.  Document frequencies are counted for each term
   over all documents.  The lexicon keeps terms whose inverse document frequency lies in a band: their
   documents are between LEAST_SHARE and MOST_SHARE of all (and two at least).  SUBSETS random subsets of them are
   chosen by digits of the terms' hashes, each with 1/64 of all terms.  The lexicon is exact: its terms fall into PLACES places by their first
   20 bits, each with room for one term, known there by its last 40 bits; terms whose place is taken go to MORE further places by other bits, with
   their whole hash, and the few that find none there are a list.
2. A document's terms in the lexicon are made distinct and sorted.  Each subset gives one
   hash over the document's terms in it; an empty one gives dashes.
3. The likeness of two fingerprints is the share of equal parts among the parts
   that aren't empty in both; 0 if all are.

The edited text of the contract needs the document that follows in doc_id: distinct doc_ids
get a global rank, and only the part of the next text that is needed is shuffled.

Defined cases: null text counts as empty; an empty text has a fingerprint of dashes; doc_ids that
repeat count once in the order (null first), and the least of their texts stands for them as
next document; equal texts have equal fingerprints; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranking import with_global_rank
from millrace.session import stored, table

PLACES = 1 << 17
MORE = 1 << 14
LEAST_SHARE, MOST_SHARE = 0.002, 0.2
SUBSETS = 32
SPACE = r"[\x20\x09-\x0D]+"
EMPTY = "-" * 8


def terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), SPACE, -1)), lambda w: w != "")


def code(term: Column) -> Column:
    """Thirteen hexadecimal digits: five for the place in the lexicon, eight that tell its term from others."""
    return F.substring(F.md5(term), 1, 13)


def _number(code_: Column) -> Column:
    return F.conv(F.substring(code_, 1, 5), 16, 10).cast("int")


def place(code_: Column) -> Column:
    """The place of a term of a subset."""
    n = _number(code_)
    return F.shiftright(n, 8) * SUBSETS + n % (2 * SUBSETS)


def subset(code_: Column) -> Column:
    """A term falls in one of 2 * SUBSETS classes by its hash; the first SUBSETS classes are the subsets."""
    return F.conv(F.substring(code_, 4, 2), 16, 10).cast("int") % (2 * SUBSETS)


class Lexicon(NamedTuple):
    """``first``: five bytes for each of PLACES, the last ones of its term's code or zeros; ``more``: seven bytes for each of MORE, a whole code or zeros; ``rest``: codes."""

    first: bytearray
    more: bytearray
    rest: list[str]

    def at_place(self, code_: Column) -> Column:
        return F.substring(F.lit(self.first), place(code_) * 5 + 1, F.lit(5))

    def holds(self, code_: Column, here: Column | None = None) -> Column:
        """``here``: the code's ``at_place`` where a column has it already, since plans show the lexicon wherever it is named."""
        here = self.at_place(code_) if here is None else here
        end = F.substring(code_, 4, 10)
        found = (here == F.unhex(end)) & (end != NONE)
        taken = (here != F.unhex(F.lit(NONE))) | (end == NONE)
        further = F.substring(F.lit(self.more), further_place(code_) * 7 + 1, F.lit(7)) == F.unhex(F.concat(F.lit("0"), code_))
        if any(self.more):
            found = found | (taken & further)
        return found | (taken & code_.isin(self.rest)) if self.rest else found


NONE = "0" * 10


def further_place(code_: Column) -> Column:
    return F.conv(F.substring(code_, 6, 4), 16, 10).cast("int") % MORE


def band(texts: DataFrame) -> DataFrame:
    """``code`` of the terms of all subsets whose document frequency lies in the band: at most as many as a text has terms on average, over LEAST_SHARE."""
    n = texts.count()
    codes = texts.select(F.explode(F.array_distinct(F.transform(terms(F.col("text")), code))).alias("code")).filter(subset(F.col("code")) < SUBSETS)
    counts = codes.groupBy("code").count()
    return counts.filter((F.col("count") >= max(2.0, LEAST_SHARE * n)) & (F.col("count") <= max(2.0, MOST_SHARE * n))).select("code")


def lexicon(codes: DataFrame) -> Lexicon:
    out = Lexicon(bytearray(5 * PLACES), bytearray(7 * MORE), [])
    numbered = codes.select("code", place(F.col("code")).alias("at"), further_place(F.col("code")).alias("then"))
    # See ``band``; one job, where the partitions of a sort would be a job each.
    for c, at, then in numbered.repartition(1).sortWithinPartitions("code").toLocalIterator():
        if c[3:] != NONE and not any(out.first[5 * at : 5 * at + 5]):
            out.first[5 * at : 5 * at + 5] = bytes.fromhex(c[3:])
        elif c != "0" * 13 and not any(out.more[7 * then : 7 * then + 7]):
            out.more[7 * then : 7 * then + 7] = bytes.fromhex("0" + c)
        else:
            out.rest.append(c)
    return out


def with_fingerprint(df: DataFrame, text: str, name: str, lex: Lexicon) -> DataFrame:
    """Add ``name``: SUBSETS parts of eight hexadecimal digits.

    The sorted terms are walked once: a mark before each subset gives the slice of terms that belongs to it."""
    placed = F.filter(F.transform(terms(F.col(text)), lambda w: F.struct(code(w).alias("c"), w.alias("t"))), lambda x: subset(x["c"]) < SUBSETS)
    looked = F.transform(placed, lambda x: F.struct(x["c"].alias("c"), x["t"].alias("t"), lex.at_place(x["c"]).alias("here")))
    inside = F.filter(looked, lambda x: lex.holds(x["c"], x["here"]))
    marks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit("").alias("t")) for k in range(SUBSETS + 1)])
    df = df.withColumn("_in", F.array_sort(F.concat(marks, F.transform(inside, lambda x: F.struct(subset(x["c"]).alias("k"), x["t"].alias("t"))))))
    df = df.withColumns({"_k": F.col("_in.k"), "_t": F.col("_in.t")})
    df = df.withColumn("_at", F.array(*[F.array_position("_k", k).cast("int") for k in range(SUBSETS + 1)]))
    parts = [F.slice("_t", F.col("_at")[k] + 1, F.col("_at")[k + 1] - F.col("_at")[k] - 1) for k in range(SUBSETS)]
    hashed = [F.when(F.size(p) == 0, EMPTY).otherwise(F.substring(F.md5(F.array_join(p, " ")), 1, 8)) for p in parts]
    return df.withColumn(name, F.concat(*hashed)).drop("_in", "_k", "_t", "_at")


def likeness(a: str, b: str) -> Column:
    parts = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: F.struct(F.substring(F.col(a), 8 * k + 1, F.lit(8)).alias("x"), F.substring(F.col(b), 8 * k + 1, F.lit(8)).alias("y")))
    equal = F.size(F.filter(parts, lambda p: (p["x"] == p["y"]) & (p["x"] != EMPTY)))
    either = F.size(F.filter(parts, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY)))
    return F.when(F.col(a).isNull() | F.col(b).isNull() | (either == 0), 0.0).otherwise(equal / either)


def followers(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``id, next_id, half`` (half the length of the longest text of ``id``), and whether ids repeat."""
    lengths = docs.groupBy("id").agg(F.max(F.floor(F.length("text") / 2)).alias("half"), F.count("*").alias("n"))
    ranked = stored(with_global_rank(lengths, [F.col("id").asc_nulls_first()]), "ids")
    total, most = ranked.agg(F.count("*"), F.max("n")).first()
    after = ranked.select(F.col("id").alias("next_id"), F.pmod(F.col("rank") - 1, F.lit(max(1, total))).alias("rank"))
    return stored(ranked.join(after, "rank").select("id", "next_id", "half"), "next"), (most or 0) > 1


def with_edited(docs: DataFrame) -> DataFrame:
    """``id, text, next_id, edited`` for a frame ``id, text`` without null texts."""
    links, repeated = followers(docs)
    after = links.select(F.col("next_id").alias("_at"), F.col("id").alias("_for"), "half")
    heads = docs.join(after, F.col("id").eqNullSafe(F.col("_at"))).select("_for", F.substring("text", F.lit(1), F.col("half").cast("int")).alias("head"))
    if repeated:
        heads = heads.groupBy("_for").agg(F.min("head").alias("head"))
    heads = heads.withColumnRenamed("_for", "_head_for")
    nexts = links.select(F.col("id").alias("_id"), "next_id")
    out = docs.join(heads, F.col("id").eqNullSafe(F.col("_head_for"))).join(nexts, F.col("id").eqNullSafe(F.col("_id")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("head", F.lit(1), half))
    return out.select("id", "text", "next_id", edited.alias("edited"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lex = lexicon(band(docs))
    rows = with_fingerprint(with_fingerprint(with_edited(docs), "text", "fingerprint", lex), "edited", "edited_fingerprint", lex)
    rows = rows.select("id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint")
    rows = stored(rows, "fingerprints")
    least = rows.groupBy("id").agg(F.min("fingerprint").alias("next_fingerprint")).withColumnRenamed("id", "_id")
    rows = rows.join(least, F.col("next_id").eqNullSafe(F.col("_id")), "left")
    return rows.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
             CAST(floor(length(coalesce(text, '')) / 2) AS BIGINT) AS half FROM documents),
x AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d
      WINDOW w AS (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, concat(left(t, n - half), left(nt, half)) AS edited FROM x),
w AS (SELECT DISTINCT doc_id, side, unnest(regexp_split_to_array(lower(s), '[\x20\x09-\x0D]+')) AS term
      FROM (SELECT doc_id, 0 AS side, t AS s FROM e UNION ALL SELECT doc_id, 1, edited FROM e)),
h AS (SELECT doc_id, side, term, substr(md5(term), 1, 13) AS c FROM w WHERE term <> ''),
g AS (SELECT *, n % 64 AS k FROM (SELECT *, ('0x' || substr(c, 1, 5))::INT AS n FROM h) WHERE n % 64 < 32),
lex AS (SELECT c FROM g WHERE side = 0 GROUP BY c
        HAVING count(DISTINCT doc_id) BETWEEN greatest(2.0, 0.002 * (SELECT count(*) FROM d)) AND greatest(2.0, 0.2 * (SELECT count(*) FROM d))),
m AS (SELECT doc_id, side, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS part FROM g JOIN lex USING (c) GROUP BY ALL),
f AS (SELECT doc_id, side, string_agg(coalesce(part, '--------'), '' ORDER BY k) AS fp
      FROM (SELECT doc_id, side, k FROM d, (VALUES (0), (1)) AS s(side), range(32) AS r(k)) LEFT JOIN m USING (doc_id, side, k) GROUP BY ALL),
p AS (SELECT e.doc_id, e.n, sha256(e.edited) AS edited_sha256, a.fp AS fa, b.fp AS fb, c.fp AS fc
      FROM e JOIN f a ON a.doc_id = e.doc_id AND a.side = 0 JOIN f b ON b.doc_id = e.doc_id AND b.side = 1 JOIN f c ON c.doc_id = e.next_id AND c.side = 0),
q AS (SELECT doc_id,
        sum((substr(fa, CAST(8 * k + 1 AS BIGINT), 8) = substr(fb, CAST(8 * k + 1 AS BIGINT), 8) AND substr(fa, CAST(8 * k + 1 AS BIGINT), 1) <> '-')::INT) AS eb,
        sum((substr(fa, CAST(8 * k + 1 AS BIGINT), 1) <> '-' OR substr(fb, CAST(8 * k + 1 AS BIGINT), 1) <> '-')::INT) AS ab,
        sum((substr(fa, CAST(8 * k + 1 AS BIGINT), 8) = substr(fc, CAST(8 * k + 1 AS BIGINT), 8) AND substr(fa, CAST(8 * k + 1 AS BIGINT), 1) <> '-')::INT) AS ec,
        sum((substr(fa, CAST(8 * k + 1 AS BIGINT), 1) <> '-' OR substr(fc, CAST(8 * k + 1 AS BIGINT), 1) <> '-')::INT) AS ac
      FROM p, range(32) AS r(k) GROUP BY doc_id)
SELECT p.doc_id, p.n AS n_chars, p.edited_sha256, p.fa AS fingerprint, p.fb AS edited_fingerprint,
  CASE WHEN ab = 0 THEN 0.0::DOUBLE ELSE eb::DOUBLE / ab END AS near_edited, CASE WHEN ac = 0 THEN 0.0::DOUBLE ELSE ec::DOUBLE / ac END AS near_next
FROM p JOIN q USING (doc_id)
"""
