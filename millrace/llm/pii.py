r"""Personal data: fixed kinds, then bootstrapped contextual extraction (DataFrame operations only).

The fixed kinds are e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers.
Spans come from splitting the text at the matches: the lengths of the parts and matches, in code
points, add up to the positions.  The expressions are written so that Java's matcher
neither recurses nor rescans a long run:
possessive repeats, and starts only where a run starts or the last match ended.

Contextual extraction then looks for identifiers the fixed kinds miss.  A mention is a fixed span or any
other word of LEAST_CHARS characters or more that has a digit.  Its patterns are what stands beside it: on the
left a label (a word and a separator such as ``:`` or ``=``) or else two words, and on the right two words.
The seeds are the fixed spans' texts and words in published credential formats (kind ``secret``);
words that are plainly dates, versions, ordinals, quantities or short numbers are known to be other things.
Over the graph of distinct (pattern, instance) edges, until a round finds nothing new:

* of a pattern's n instances ``pos`` are known as personal and ``neg`` as other things.  A label's field holds one sort of
  value, so unknown instances don't speak against it: its confidence is ``pos / (pos + neg + 1)``, and
  ``pos / n * log2(pos)`` must reach LEAST_GAIN.  Between words of running text every unknown instance counts
  against the pattern, and what remains is taken times RUNNING, so that one such pattern alone decides nothing.
  Patterns need LEAST_KNOWN known instances and LEAST_CONFIDENCE (before the factor);
* an instance's score is ``1 - product(1 - confidence)`` over its patterns; from LEAST_SCORE on it is known,
  of the kind that makes up LEAST_SHARE of the known instances of its surest pattern, else of kind ``id``.

Every mention of an instance that became known is a span of its kind.  A word in a credential format is one only
if its contexts say so too.

Defined cases: null text counts as empty; a match that fails its test is dropped and its
characters are not tried again; spans of different kinds may overlap; repeated rows give equal
results; of equally sure patterns the greatest by kind and text gives the kind; very long texts are
searched whole, in time that follows the text and, for n matches, n times the root of n; an empty table gives no rows; further columns pass through ``mask``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import stored, table

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "id")
SECRET, ID = 4, 5
UNKNOWN, OTHER = -1, -2
LEAST_CHARS = 4
LEAST_KNOWN = 5
LEAST_CONFIDENCE = 0.8
LEAST_GAIN = 0.8
LEAST_SHARE = 0.8
LEAST_SCORE = 0.8
RUNNING = 0.6

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
# Credential formats (digests in hexadecimal, keys of public services, JSON web tokens), and words that are other things.
CREDENTIAL = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)$"
ORDINARY = r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T.*)?|[vV]?[0-9]{1,4}(?:\.[0-9]{1,4}){0,3}|[0-9]{1,6}%?|[0-9]+(?:st|nd|rd|th)|[0-9.]+(?:[kmc]?m|k?g|[kKMGT]B|[kKMG]?Hz|px|ms|s|h))$"

_ID = r"\p{L}\p{N}_.%+@-"
IDENTIFIER = rf"(?<![{_ID}])(?=[\p{{L}}_.%+@-]*+[0-9])[{_ID}]{{{LEAST_CHARS - 1},}}[\p{{L}}\p{{N}}]"
_NAME = r"[\p{L}\p{N}_-]"
LEFT = rf"(?<!{_NAME})({_NAME}++[\x20\t]*+[:=#][\x20\t]*+[\x22'(]?+[\x20\t]*+|{_NAME}++[\x20\t]++{_NAME}++[\x20\t]++[\x22'(]?+)\z"
RIGHT = r"\A[\x22')]?+[,.;]?+[\x20\t]++(\p{L}++[\x20\t]++\p{L}++)"
LABEL = r"[:=#][\x20\t]*[\x22'(]?[\x20\t]*$"

SPANS = "array<struct<s:int,e:int,m:string%s>>"


def _literal(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prefixed(df: DataFrame, values: dict[str, str], merge: str, zero: int = 0) -> DataFrame:
    """Replace each array of numbers by its prefixes: what ``merge`` of ``a`` and ``x`` makes of all elements before each one, from ``zero``.

    An array that grows by one in a fold is copied each time, so the elements are dealt in blocks of about the square root of their number: the
    blocks' totals first, then the prefixes inside each."""
    block = lambda v: f"greatest(64, CAST(ceil(sqrt(size({v}))) AS INT))"
    step = f"named_struct('p', {merge}, 'o', concat(a.o, array(a.p)))"
    none = "CAST(array() AS array<int>)"
    part = lambda v: f"slice({v}, b * _b{v} + 1, _b{v})"
    df = df.withColumns({f"_b{v}": F.expr(block(v)) for v in values})
    heads = {}
    for v in values:
        total = f"aggregate({part(v)}, t.p, (a, x) -> {merge.replace('a.p', 'a')})"
        fold = f"aggregate(sequence(0, (size({v}) - 1) div _b{v}), named_struct('p', {zero}, 'o', {none}), (t, b) -> named_struct('p', {total}, 'o', concat(t.o, array(t.p))), t -> t.o)"
        heads[f"_h{v}"] = F.expr(f"CASE WHEN size({v}) > 0 THEN {fold} ELSE {none} END")
    df = df.withColumns(heads)
    inside = lambda v: f"flatten(transform(_h{v}, (h, b) -> aggregate({part(v)}, named_struct('p', h, 'o', {none}), (a, x) -> {step}, a -> a.o)))"
    return df.withColumns({out: F.expr(inside(v)) for v, out in values.items()}).drop(*[c for v in values for c in (f"_b{v}", f"_h{v}")])


SUM, MOST, LEAST = "a.p + x", "greatest(a.p, x)", "least(a.p, x)"
FAR = 2147483647


def _free(df: DataFrame) -> DataFrame:
    """Add ``_free``: the identifiers that no fixed span overlaps, by two walks over both in order of their starts.

    An identifier is overlapped if a span before it reaches into it, or the next one starts before its end."""
    event = lambda x, t: f"named_struct('s', {x}.s, 't', {t}, 'e', {x}.e, 'x', named_struct('s', {x}.s, 'e', {x}.e, 'm', {x}.m, 'left', {x}.left, 'right', {x}.right))"
    df = df.withColumn("_both", F.expr(f"array_sort(concat(transform(_spans, x -> {event('x', 0)}), transform(_s_id, y -> {event('y', 1)})))"))
    df = df.withColumn("_ends", F.expr("transform(_both, v -> IF(v.t = 0, v.e, 0))"))
    df = df.withColumn("_starts", F.expr(f"transform(reverse(_both), v -> IF(v.t = 0, v.s, {FAR}))"))
    df = _prefixed(_prefixed(df, {"_ends": "_reach"}, MOST), {"_starts": "_back"}, LEAST, FAR)
    df = df.withColumn("_next", F.reverse("_back"))
    # Arrays are zipped, not looked up by place: what a lambda refers to may be worked out anew for each element.
    before = "zip_with(_both, _reach, (v, r) -> named_struct('v', v, 'ok', v.t = 1 AND r <= v.s))"
    both = f"zip_with({before}, _next, (w, n) -> named_struct('x', w.v.x, 'ok', w.ok AND n >= w.v.e))"
    df = df.withColumn("_free", F.expr(f"transform(filter({both}, w -> w.ok), w -> w.x)"))
    return df.drop("_both", "_ends", "_starts", "_reach", "_back", "_next")


def _places(parts: str, found: str, at: str, contexts: bool) -> Column:
    """(start, end, match) from the parts between the matches, the matches and where each part starts; with ``contexts`` also what stands left and right."""
    start = f"p + length({parts}[i])"
    beside = f", 'left', regexp_extract({parts}[i], {_literal(LEFT)}, 1), 'right', regexp_extract({parts}[i + 1], {_literal(RIGHT)}, 1)" if contexts else ""
    return F.expr(f"transform({at}, (p, i) -> named_struct('s', {start}, 'e', {start} + length({found}[i]), 'm', {found}[i]{beside}))")


def _luhn(match: str) -> str:
    """Digits from the right, each second one doubled, 9 taken off where that exceeds 9."""
    digit = f"CAST(substring(reverse(regexp_replace({match}, '[^0-9]', '')), i, 1) AS INT)"
    return f"aggregate(transform(sequence(1, length(regexp_replace({match}, '[^0-9]', ''))), i -> CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END), 0, (a, d) -> a + d) % 10 = 0"


_TESTS = {
    "email": "true",
    "ip": "forall(split(x.m, '\\\\.'), p -> p rlike '^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
    "card": _luhn("x.m"),
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def _matches(df: DataFrame, text: str, names: dict[str, tuple[str, str]], contexts: bool = False) -> DataFrame:
    """Add an array of spans for each name: (expression, what a text needs to be looked at)."""
    look = {k: F.expr(f"{text} rlike {_literal(need)}") for k, (_, need) in names.items()}
    cols = {}
    for k, (regex, _) in names.items():
        cols[f"_p_{k}"] = F.when(look[k], F.split(F.col(text), regex, -1))
        cols[f"_f_{k}"] = F.coalesce(F.when(look[k], F.expr(f"regexp_extract_all({text}, {_literal(regex)}, 0)")), F.array().cast("array<string>"))
    df = df.withColumns(cols)
    df = df.withColumns({f"_n_{k}": F.expr(f"zip_with(slice(_p_{k}, 1, size(_f_{k})), _f_{k}, (p, m) -> length(p) + length(m))") for k in names})
    df = _prefixed(df, {f"_n_{k}": f"_a_{k}" for k in names}, SUM)
    df = df.withColumns({f"_s_{k}": _places(f"_p_{k}", f"_f_{k}", f"_a_{k}", contexts) for k in names})
    return df.drop(*cols, *[f"_{c}_{k}" for k in names for c in "na"])


def _fixed(extra: str = "") -> Column:
    """The spans of the fixed kinds that pass their tests, by start and kind; k numbers the kinds."""
    parts = [F.expr(f"transform(filter(_s_{k}, x -> {_TESTS[k]}), x -> named_struct('s', x.s, 'k', {n}, 'e', x.e, 'm', x.m{extra}))") for n, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: array of (s, k, e, m) of the fixed kinds, by start and kind; k numbers the kinds."""
    df = _matches(df, text, {k: (PATTERNS[k], NEEDED[k]) for k in KINDS})
    return df.withColumn("spans", _fixed()).drop(*[f"_s_{k}" for k in KINDS])


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in ALL_KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, text_hash, spans, mentions``; a mention is (s, e, m, k, left, right) with k a kind, UNKNOWN or OTHER."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = _matches(df, "text", {k: (PATTERNS[k], NEEDED[k]) for k in KINDS} | {"id": (IDENTIFIER, r"[0-9]")}, contexts=True)
    df = _free(df.withColumn("_spans", _fixed(", 'left', x.left, 'right', x.right")))
    plain = lambda c: f"lower(regexp_replace({c}, '[ \\\\t]+', ' '))"
    sides = f"'left', {plain('x.left')}, 'right', {plain('x.right')}"
    sort = f"CASE WHEN x.m rlike {_literal(CREDENTIAL)} THEN {SECRET} WHEN x.m rlike {_literal(ORDINARY)} THEN {OTHER} ELSE {UNKNOWN} END"
    fixed = F.expr(f"transform(_spans, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'k', x.k, {sides}))")
    other = F.expr(f"transform(_free, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'k', {sort}, {sides}))")
    bare = F.expr("transform(_spans, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'm', x.m))")
    return df.select("doc_id", F.xxhash64("text").alias("text_hash"), bare.alias("spans"), F.concat(fixed, other).alias("mentions"))


def graph(mentions: DataFrame) -> DataFrame:
    """``pattern, m, k``: the distinct edges of ``mentions (m, k, left, right)``; labels start with ``L``, words with ``W`` or ``R``."""
    left = F.when(F.col("left") != "", F.concat(F.when(F.col("left").rlike(LABEL), "L ").otherwise("W "), "left"))
    right = F.when(F.col("right") != "", F.concat(F.lit("R "), "right"))
    both = mentions.select("m", "k", F.explode(F.array_compact(F.array(left, right))).alias("pattern"))
    return both.groupBy("pattern", "m").agg(F.max("k").alias("k"))


def confident(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``pattern, confidence, kind`` of the patterns that may decide, for ``known (m, kind)``."""
    marked = edges.join(known, "m", "left")
    kinds = [F.count_if(F.col("kind") == k).alias(f"_k{k}") for k in range(len(ALL_KINDS))]
    scores = marked.groupBy("pattern").agg(F.count("kind").alias("pos"), F.count_if((F.col("k") == OTHER) & F.col("kind").isNull()).alias("neg"), F.count("*").alias("n"), *kinds)
    label = F.col("pattern").startswith("L")
    sure = F.col("pos") / (F.when(label, F.col("pos") + F.col("neg")).otherwise(F.col("n")) + 1)
    gain = ~label | (F.col("pos") / F.col("n") * F.log2("pos") >= LEAST_GAIN)
    most = F.greatest(*[F.struct(F.col(f"_k{k}").alias("c"), F.lit(k).alias("kind")) for k in range(len(ALL_KINDS))])
    kind = F.when(most["c"] >= LEAST_SHARE * F.col("pos"), most["kind"]).otherwise(ID)
    scores = scores.filter((F.col("pos") >= LEAST_KNOWN) & (sure >= LEAST_CONFIDENCE) & gain)
    return scores.select("pattern", (sure * F.when(label, 1.0).otherwise(RUNNING)).alias("confidence"), kind.alias("kind"))


def discovered(mentions: DataFrame) -> DataFrame:
    """``m, kind``: the instances that high-confidence patterns add to the fixed spans."""
    edges = stored(graph(mentions), "edges")
    seeds = edges.filter("k >= 0").groupBy("m").agg(F.max("k").alias("kind"))
    found, n = seeds.limit(0), 0
    while True:
        known = seeds.unionByName(found.join(seeds, "m", "left_anti"))
        by = edges.filter((F.col("k") < 0) | (F.col("k") == SECRET)).join(confident(edges, known), "pattern")
        doubt = F.sum(F.log1p(-F.col("confidence")))
        scores = by.groupBy("m").agg((1 - F.exp(doubt)).alias("score"), F.max(F.struct("confidence", "kind", "pattern")).alias("_by"))
        found = stored(scores.filter(F.col("score") >= LEAST_SCORE).select("m", F.col("_by.kind").alias("kind")), "found")
        now = found.count()
        if now <= n:  # known instances only raise confidences, so a round without new ones is the last
            return found
        n = now


def extra_spans(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, extra``: the spans that contextual extraction adds to scanned rows."""
    mentions = rows.select("doc_id", "text_hash", F.explode("mentions").alias("x")).select("doc_id", "text_hash", "x.*")
    new = mentions.filter(~F.col("k").between(0, SECRET - 1)).join(discovered(mentions), "m")
    span = F.struct("s", F.col("kind").alias("k"), "e", "m")
    return new.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(span)).alias("extra"))


def with_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_hash, spans`` (fixed) and ``all_spans``."""
    rows = stored(scanned(docs), "scanned")
    extra = extra_spans(rows).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    out = rows.join(extra, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    both = F.when(F.col("extra").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "extra")))
    return out.select("doc_id", "text_hash", "spans", both.alias("all_spans"))


CHUNK = 1000


def _cut(start: str, end: str) -> str:
    """The text from code point ``start`` to before ``end``, out of ``_chunks``."""
    first, last = f"({start}) div {CHUNK}", f"({end}) div {CHUNK}"
    head = f"coalesce(substring(get(_chunks, CAST({first} AS INT)), CAST(({start}) % {CHUNK} + 1 AS INT), CAST(least({CHUNK}, {end} - {start}) AS INT)), '')"
    whole = f"array_join(slice(_chunks, CAST({first} + 2 AS INT), CAST(greatest({last} - {first} - 1, 0) AS INT)), '')"
    rest = f"coalesce(substring(get(_chunks, CAST({last} AS INT)), 1, CAST(({end}) % {CHUNK} AS INT)), '')"
    return f"CASE WHEN {last} > {first} THEN concat({head}, {whole}, {rest}) ELSE {head} END"


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets and ``n_chars`` counted anew."""
    rows = stored(scanned(docs), "scanned")
    extra = extra_spans(rows).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    # The rows travel as one column, so that no name of theirs can clash.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = base_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), text.alias("_text")), "_text")
    df = df.join(extra, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("_text") == F.col("_hash")), "left")
    df = df.withColumn("spans", F.when(F.col("extra").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "extra"))))
    names = ", ".join(f"'[{k.upper()}]'" for k in ALL_KINDS)
    # A span that starts inside the one before is covered by it as far as that goes.  What stands between spans is put together from chunks of the text,
    # since finding a place in a string takes as long as the string is.
    df = df.withColumn("_chunks", F.when(F.size("spans") > 0, F.expr(f"regexp_extract_all(_text, '(?s).{{1,{CHUNK}}}', 0)")).otherwise(F.array().cast("array<string>")))
    df = _prefixed(df.withColumn("_e", F.expr("transform(spans, x -> x.e)")), {"_e": "_from"}, MOST)
    pieces = f"zip_with(spans, _from, (x, r) -> CASE WHEN x.s >= r THEN concat({_cut('r', 'x.s')}, array({names})[x.k]) ELSE '' END)"
    tail = _cut("array_max(_e)", "length(_text)")
    masked = F.expr(f"CASE WHEN size(spans) > 0 THEN concat(array_join({pieces}, ''), {tail}) ELSE row.text END")
    changed = {"text": "masked", "n_chars": "n_masked"}
    df = df.withColumn("masked", masked).withColumn("n_masked", F.coalesce(F.length("masked"), F.lit(0)).cast("long"))
    return df.select(*[(F.col(changed[c]) if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.k = {n})) AS BIGINT)").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(joined("spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))
