"""Exact repeated-substring removal by prefix-free parsing.

Texts are parsed where a rolling hash triggers.  The trigger is the least hash of SEED-byte
strings in a sliding window, so every string of LENGTH bytes has exactly one trigger of its own,
wherever it stands.  The strings that share a trigger position form one phrase (their hull,
at most 2 * LENGTH - SEED bytes), and phrases overlap so that each string of LENGTH bytes
lies in exactly one: a string can only recur in phrases with the same trigger text.

1. Parse: per trigger text, count the phrases and see whether they all are equal.  Trigger texts that occur
   once, most of an ordinary corpus, end here.
2. Phrases that occur more than once are repeated as a whole.
3. The dictionary holds each distinct phrase of a trigger text that has several, once.  A suffix array of it,
   by prefix doubling on its bytes and up to LENGTH of them, puts its suffixes in order; neighbours that are equal so far are the
   repeated strings, byte by byte.  Trigger texts with at most GROUP phrases are ordered inside a
   task, whole groups at a time; the strings of larger ones are dealt by two 64-bit hashes of their own, so that
   a passage common to a third of all documents is spread.
4. The parse says where the phrases stand: a string's order in the corpus is that of its trigger text and then that of its
   suffix of the dictionary.  Since every string lies inside one phrase, the phrases that follow it
   never break a tie, and so the parse needs no suffix array of its own.  A document's repeated strings, as runs
   of start positions, meet its text again.

Phrases are told apart by a 64-bit hash beside that of their trigger text.  Positions are bytes of UTF-8.

Defined cases: null text counts as empty; texts under LENGTH bytes keep all bytes; repeated rows
are documents of their own, so their strings are repeated; a null doc_id is a key
like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.llm.shingles import mix
from millrace.session import stored, table

LENGTH = 200
SEED = 64
GROUP = 1024

_BYTE = np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Another order of the bytes, for hashes that know nothing of the first.
_OTHER = np.random.Generator(np.random.PCG64(98)).permutation(256).astype(np.uint8)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash, and the inverse powers that make its parts comparable."""
    power, inverse = shingles._power(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])]), inverse


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    n, done, out = len(x) - width + 1, 1, x
    while 2 * done <= width:
        out = least(out[: len(out) - done], out[done:])
        done *= 2
    return least(out[:n], out[width - done : width - done + n])


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(row, trigger hash, phrase hash, first string's start in the row, number of strings) of each phrase."""
    sums, inverse = _sums(data)
    width = length - seed + 1
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    grams = mix((sums[seed:] - sums[:-seed]) * inverse[: len(data) - seed + 1]) if len(data) >= seed else sums[:0]
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        n = b - a - length + 1
        if n < 1:
            continue
        x = grams[a : b - seed + 1]
        least = _sliding(x, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == x)
        value = x[at]
        start = np.zeros(len(at), np.int64)
        # A lesser trigger takes over as soon as it enters the window, another when the last one leaves.
        start[1:] = np.minimum(np.where(value[1:] < value[:-1], at[1:] - width + 1, at[:-1] + 1), n)
        count = np.diff(start, append=n)
        own = count > 0
        start, count, value = start[own], count[own], value[own]
        s, e = a + start, a + start + count - 1 + length
        for o, v in zip(out, (np.full(len(s), row), value, mix((sums[e] - sums[s]) * inverse[s] + count.astype(np.uint64)), start, count), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def string_places(offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start in the data, index within its phrase) of the strings of each phrase."""
    index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(offsets[:-1], counts) + index, index


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.concatenate([np.zeros(1, np.uint64), (sorted_[1:] != sorted_[:-1]).astype(np.uint64)]))
    return out


def suffix_ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes that start ``at``, compared by their first ``length`` bytes: equal ranks are equal bytes.

    Prefix doubling: eight bytes are a number; from there on a rank by twice as many bytes follows from two ranks.  ``length`` is 8 or more
    and all those bytes lie in ``data``; what other suffixes find behind the end doesn't matter."""
    key = np.concatenate([data, np.zeros(length, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        key = (key[:-width] << np.uint64(8 * width)) | key[width:]
    width = 8
    rank = _ranks(key)
    while 2 * width <= length:
        rank = _ranks((rank[:-width] << np.uint64(32)) | rank[width:])
        width *= 2
    return _ranks((rank[at] << np.uint64(32)) | rank[at + length - width])


def string_hashes(data: np.ndarray, at: np.ndarray, salt: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings that start ``at``; salt keeps trigger texts apart."""
    sums, inverse = _sums(data)
    return mix(mix((sums[at + length] - sums[at]) * inverse[at]) + salt)


def runs_of(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs of true flags that no break (a true there starts anew) interrupts."""
    before = np.concatenate([[False], flags[:-1]]) & ~breaks
    first = np.flatnonzero(flags & ~before)
    after = np.concatenate([flags[1:] & ~breaks[1:], [False]])
    return first, np.flatnonzero(flags & ~after) - first + 1


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))


def _parsed(keyed: DataFrame, full: bool, length: int, seed: int) -> DataFrame:
    def parse(batches):
        for batch in batches:
            for row, data, offsets in shingles.slices(batch.column(2)):
                r, trigger, phrase, start, count = phrases(data, offsets, length, seed)
                if not len(r):
                    continue
                columns = [pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64))]
                names = ["trigger", "phrase"]
                if full:
                    at = pa.array(r + row)
                    columns += [batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))]
                    names += ["d", "h", "start", "n"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed.mapInArrow(parse, "trigger long, phrase long" + (", d long, h long, start int, n int" if full else ""))


DICTIONARY = "trigger long, times long, d long, h long, start int, n int, piece binary"
RUNS = "d long, h long, start int, n int"


def _with_pieces(keyed: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """The text of each phrase, cut from a document that has it."""
    wanted = dictionary.groupBy("d", "h").agg(F.collect_list(F.struct("trigger", "times", "start", "n")).alias("wanted"))

    def cut(batches):
        for batch in batches:
            for d, h, text, wanted_ in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw, w = text.as_buffer().to_pybytes(), wanted_.values
                cols = {k: w.field(i) for i, k in enumerate(("trigger", "times", "start", "n"))}
                pieces = [raw[s : s + n - 1 + length] for s, n in zip(cols["start"].to_pylist(), cols["n"].to_pylist(), strict=True)]
                k = len(pieces)
                yield pa.RecordBatch.from_arrays([cols["trigger"], cols["times"], pa.repeat(d, k), pa.repeat(h, k), cols["start"], cols["n"], pa.array(pieces, pa.binary())], names=["trigger", "times", "d", "h", "start", "n", "piece"])

    texts = keyed.join(wanted, ["d", "h"])
    return texts.select("d", "h", "text", "wanted").mapInArrow(cut, DICTIONARY)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def _ordered_matches(length: int):
    """Repeated strings inside whole trigger groups, which arrive one after the other."""

    def repeated(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        col = lambda c: t[c].chunk(0) if isinstance(t[c], pa.ChunkedArray) else t[c]
        data, offsets = _bytes_of(col("piece"))
        counts, times = col("n").to_numpy().astype(np.int64), col("times").to_numpy()
        at, index = string_places(offsets, counts)
        ranks = suffix_ranks(data, at, length)
        order = np.argsort(ranks)
        equal = ranks[order[1:]] == ranks[order[:-1]]
        flags = np.zeros(len(ranks), bool)
        flags[order[1:][equal]] = True
        flags[order[:-1][equal]] = True
        row = np.repeat(np.arange(len(counts)), counts)
        flags &= (times == 1)[row]  # the others are known to be repeated
        first, n = runs_of(flags, index == 0)
        at = pa.array(row[first])
        return pa.RecordBatch.from_arrays([col("d").take(at), col("h").take(at), pa.array((col("start").to_numpy()[row[first]] + index[first]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["d", "h", "start", "n"])

    def match(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            trigger = batch.column(0).to_numpy()
            last = int(np.flatnonzero(trigger != trigger[-1])[-1]) + 1 if len(trigger) and (trigger != trigger[-1]).any() else 0
            if held and len(trigger) and held[-1].column(0)[-1].as_py() != trigger[0]:
                yield repeated(pa.Table.from_batches(held))
                held, size = [], 0
            if last and size + last > 0:
                yield repeated(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held, size = [], 0
            if len(trigger) > last:
                held.append(batch.slice(last))
                size += len(trigger) - last
        if held:
            yield repeated(pa.Table.from_batches(held))

    return match


def _exploded(dictionary: DataFrame, length: int) -> DataFrame:
    def explode(batches):
        for batch in batches:
            data, offsets = _bytes_of(batch.column(6))
            counts = batch.column(5).to_numpy().astype(np.int64)
            at, index = string_places(offsets, counts)
            row = np.repeat(np.arange(len(counts)), counts)
            salt = mix(batch.column(0).to_numpy().view(np.uint64))[row]
            one, two = (string_hashes(d, at, salt, length) for d in (data, _OTHER[data]))
            beside = _beside(one, two)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column(1).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array((batch.column(4).to_numpy()[row] + index).astype(np.int32)), pa.array(beside)], names=["string", "string2", "times", "d", "h", "start", "beside"])

    return dictionary.mapInArrow(explode, "string long, string2 long, times long, d long, h long, start int, beside boolean")


def _beside(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which strings occur again in the same batch."""
    order = np.lexsort((two, one))
    equal = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    out = np.zeros(len(one), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def repeated_runs(keyed: DataFrame, length: int = LENGTH, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``d, h, start, n``: strings of ``length`` bytes that occur elsewhere too, as runs of starts."""
    triggers = _parsed(keyed, False, length, seed).groupBy("trigger").agg(F.count("*").alias("c"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi"))
    triggers = stored(triggers.filter("c > 1").select("trigger", (F.col("lo") != F.col("hi")).alias("mixed")), "triggers")
    found = stored(_parsed(keyed, True, length, seed).join(triggers, "trigger"), "parse")
    alike = found.filter("NOT mixed").select("d", "h", "start", "n")

    various = found.filter("mixed")
    distinct = various.groupBy("trigger", "phrase").agg(F.count("*").alias("times"), F.min(F.struct("d", "h", "start", "n")).alias("one"))
    distinct = stored(distinct.select("trigger", "phrase", "times", "one.*"), "dictionary")
    whole = various.join(distinct.filter("times > 1").select("trigger", "phrase"), ["trigger", "phrase"]).select("d", "h", "start", "n")

    sizes = distinct.groupBy("trigger").agg(F.count("*").alias("members"), F.min("times").alias("_least"))
    open_ = distinct.join(sizes.filter("_least = 1").select("trigger", "members"), "trigger")
    pieces = stored(_with_pieces(keyed, open_.select("trigger", "times", "d", "h", "start", "n"), length).join(sizes.select("trigger", "members"), "trigger"), "pieces")
    small, large = pieces.filter(F.col("members") <= group).drop("members"), pieces.filter(F.col("members") > group).drop("members")
    inside = small.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_ordered_matches(length), RUNS)
    # The phrases of a large group are dealt evenly before each gives its own strings.
    strings = _exploded(large.repartition("d", "h", "start"), length)
    again = strings.groupBy("string", "string2").agg(F.count("*").alias("c")).filter("c > 1").select("string", "string2")
    # Strings that recur inside a batch are known there; only the others ask whether another batch has them.
    known = strings.filter("times = 1 AND beside").select("d", "h", "start", F.lit(1).alias("n"))
    spread = strings.filter("times = 1 AND NOT beside").join(again, ["string", "string2"]).select("d", "h", "start", F.lit(1).alias("n"))
    return alike.unionByName(whole).unionByName(inside).unionByName(known).unionByName(spread)


def removed(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes)."""
    keyed = _keyed(docs)
    runs = repeated_runs(keyed, length, **how).groupBy("d", "h").agg(F.collect_set(F.struct("start", "n")).alias("runs")).withColumnsRenamed({"d": "_d", "h": "_h"})

    def take_out(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for d, text, runs_ in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone, spans, at, kept = 0, 0, 0, []
                if runs_.is_valid:
                    start = runs_.values.field(0).to_numpy().astype(np.int64)
                    end = start + runs_.values.field(1).to_numpy() - 1 + length
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    new = np.concatenate([[True], start[1:] > end[:-1]])
                    last = np.concatenate([new[1:], [True]])
                    for s, e in zip(start[new].tolist(), end[last].tolist(), strict=True):
                        kept.append(raw[at:s])
                        gone, spans, at = gone + e - s, spans + 1, e
                kept.append(raw[at:])
                rest = b"".join(kept)
                d = d.as_py()
                for o, v in zip(out, (None if d == -(1 << 63) else d, len(raw), gone, spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    o.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = keyed.join(runs, (F.col("d") == F.col("_d")) & (F.col("h") == F.col("_h")), "left").select("d", "text", "runs")
    return rows.mapInArrow(take_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).drop("kept")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, n, i, md5(b[i + 1 : i + 200]) AS h FROM (SELECT doc_id, n, b, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, n, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
m AS (SELECT doc_id, i, CASE WHEN i <= 200 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m) GROUP BY doc_id, g),
k AS (SELECT doc_id, z AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), NULL) AS z FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(hex(d.b[k.a + 1 : coalesce(k.z, d.n)]), '' ORDER BY k.a) AS x FROM k JOIN d ON d.doc_id = k.doc_id WHERE coalesce(k.z, d.n) > k.a GROUP BY k.doc_id),
c AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
  CASE WHEN c.doc_id IS NULL THEN sha256(d.b) ELSE sha256(unhex(coalesce(t.x, ''))) END AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
