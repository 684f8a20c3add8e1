"""MinHash near-duplicates with odd sketches.

1. One pass over the texts gives each document the set of its 5-word shingles as hashes, an
   identity of that set, 320 MinHash samples, the first 80 of them in 20 bands of 4, and an odd
   sketch of 1024 bits, in which each (sample number, sample) flips one bit.  The XOR of two sketches
   has about twice as many bits as the samples that differ, which is a precise estimate
   for similar sets.  Texts are not shuffled here.
2. Documents with equal sets form one node; copies, however many, go no further.
3. Nodes that share a band meet their bucket's most popular member: the one that
   meets most others in all its buckets, which in a family of edited copies is the original.
   A pair whose sketches differ in more than MOST_BITS bits is dropped; other pairs are
   confirmed on the full sets.
4. Components of the links follow.  Where a bucket still holds several
   components, members of different components are compared with each other as well; the members of a large
   bucket are dealt into blocks, and each two blocks meet under a key of their own.
   An exact bound goes first: shingles that no other member of these buckets has can't be
   shared, and a heavily edited copy has too many of them to be linked with anything.  So
   every two documents of a bucket are in one component, compared, or too different.

At similarity 0.85 a pair shares no band with probability 4e-7. Its sketches differ in 87
bits on average with a deviation of 12.5, and so in over MOST_BITS with probability 3e-7.  For another similarity ``most_bits`` lies as many
deviations above the mean; at 0.80 a pair shares no band with probability 3e-5.

Defined cases: null or wordless text has an empty set, is linked with nothing and kept; a text
of one to four words is one shingle; repeated rows are copies; a null doc_id counts as the
largest; an empty table gives no rows; other columns pass through ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.operators.components import connected_components
from millrace.session import stored, table

SHINGLE = 5
BANDS, ROWS = 20, 4
SAMPLES = 320
SKETCH_WORDS = 16
MOST_BITS = 150
PERCENT = 85
BLOCK = 1000


def most_bits(percent: int) -> int:
    """Bits in which sketches may differ at a similarity of ``percent``: MOST_BITS for PERCENT, in step with mean and deviation else."""

    def mean(p: int) -> float:
        return 32 * SKETCH_WORDS * (1 - math.exp(-4 * SAMPLES * (1 - p / 100) / (64 * SKETCH_WORDS)))

    return math.ceil(mean(percent) + (MOST_BITS - mean(PERCENT)) * math.sqrt(mean(percent) / mean(PERCENT)))


_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNATURE = "doc_id long, h long, n_shingles long, node binary, bands array<long>, sketch array<long>"


def samples(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, samples) minima of the nonempty sets."""
    out = np.empty((len(starts) - 1, SAMPLES), np.uint64)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat((values ^ _XOR[k]) * _ODD[k], starts[:-1])
    return out


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(rows, SKETCH_WORDS) parity bitmaps of the samples."""
    at = shingles.mix(mins + np.arange(mins.shape[1], dtype=np.uint64)) % np.uint64(64 * SKETCH_WORDS)
    out = np.zeros((len(mins), SKETCH_WORDS), np.uint64)
    for k in range(mins.shape[1]):
        word, bit = (at[:, k] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at[:, k] & np.uint64(63))
        out[np.arange(len(mins)), word] ^= bit
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    out = np.zeros((len(mins), BANDS), np.uint64)
    for r in range(ROWS):
        out = shingles.mix(out * np.uint64(0x9E3779B97F4A7C15) + mins[:, r::ROWS][:, :BANDS])
    return shingles.mix(out + np.arange(BANDS, dtype=np.uint64))


def _binary(ids: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def _lists(values: np.ndarray) -> pa.Array:
    n = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, n), pa.int32()), pa.array(values.ravel().view(np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    def sign(batches):
        for batch in batches:
            for row, data, offsets in shingles.slices(batch.column(2)):
                values, starts = shingles.shingle_sets(data, offsets, SHINGLE)
                full = np.diff(starts) > 0
                bands, sketch = np.zeros((len(full), BANDS), np.uint64), np.zeros((len(full), SKETCH_WORDS), np.uint64)
                if full.any():
                    mins = samples(values, np.concatenate([starts[:-1][full], starts[-1:]]))
                    bands[full], sketch[full] = band_keys(mins), odd_sketches(mins)
                columns = [batch.column(0).slice(row, len(full)), batch.column(1).slice(row, len(full)), pa.array(np.diff(starts)), _binary(shingles.identities(values, starts)), _lists(bands), _lists(sketch)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n_shingles", "node", "bands", "sketch"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text).mapInArrow(sign, SIGNATURE)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items) of the nodes in ``wanted (node, of)``, from the text of a document ``of (h, doc_id)`` that has the set."""

    def sets(batches):
        for batch in batches:
            for row, data, offsets in shingles.slices(batch.column(1)):
                values, starts = shingles.shingle_sets(data, offsets, SHINGLE)
                items = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))
                found = pa.RecordBatch.from_arrays([_binary(shingles.identities(values, starts)), items], names=["node", "items"])
                asked = batch.column(0).slice(row, len(found)).cast(pa.binary())
                yield found.filter(pa.compute.equal(asked, found.column(0)))

    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_h"), F.col("text").cast("string"))
    texts = texts.join(wanted, F.col("_doc").eqNullSafe(F.col("of.doc_id")) & (F.col("_h") == F.col("of.h"))).select("node", "text")
    return texts.mapInArrow(sets, "node binary, items array<long>").dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` with 100 * intersection >= percent * union, on the full ``sets (node, items)``."""
    one, other = sets.select(F.col("node").alias("a"), F.col("items").alias("_x")), sets.select(F.col("node").alias("b"), F.col("items").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    rows = pairs.join(one, "a").join(other, "b").withColumn("_both", both)
    return rows.filter(100 * F.col("_both") >= percent * (F.size("_x") + F.size("_y") - F.col("_both"))).select("a", "b")


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, items`` for the nodes in ``wanted (node)``, written once."""
    return stored(_full_sets(docs, nodes.select("node", "of").join(wanted.distinct(), "node", "left_semi")), "sets")


def own_shingles(sets: DataFrame) -> DataFrame:
    """``node, items_n, own``: the size of each set and how many of its shingles no other set has."""
    alone = sets.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    return sets.select("node", F.size("items").alias("items_n")).join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))


def _bits(x: str, y: str):
    return sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_WORDS))


def in_blocks(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join of ``rows (band, node, ...)`` inside bands, as ``a_...`` and ``b_...`` with the key ``_band, _i, _j``.

    Every two members of a band meet under one key, which brings together two blocks of about ``block`` rows."""
    large = rows.groupBy("band").agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * block).select("band", F.ceil(F.col("_n") / block).alias("_blocks"))
    dealt = rows.join(large, "band", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    keys = {"a": {"_part": "_i", "_other": "_j"}, "b": {"_part": "_j", "_other": "_i"}}
    return tuple(dealt.select(F.col("band").alias("_band"), *[F.col(c).alias(n) for c, n in keys[side].items()], *[F.col(c).alias(f"{side}_{c}") for c in rows.columns]) for side in "ab")


def groups(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, h, group, n_shingles, component_id, kept`` of each document.

    h is the hash of its text; the group is the component's own key, also where doc_ids repeat."""
    bits = most_bits(percent)
    signed = stored(signatures(docs), "signatures")
    nodes = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct("h", "doc_id")).alias("of"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes, "nodes")

    members = nodes.select("node", F.posexplode("bands").alias("at", "band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(members.join(sizes, "band"), "members")
    popular = members.groupBy("node").agg(F.sum("n").alias("popularity")).join(nodes.select("node", "sketch"), "node")
    members = stored(members.join(popular, "node"), "buckets")
    leaders = members.groupBy("band").agg(F.max(F.struct("popularity", "node", "sketch")).alias("_top"))
    leaders = leaders.select("band", F.col("_top.node").alias("leader"), F.col("_top.sketch").alias("leader_sketch"))
    led = members.join(leaders, "band")
    pairs = led.filter(F.col("node") != F.col("leader")).filter(_bits("sketch", "leader_sketch") <= bits)
    pairs = stored(pairs.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    links = stored(confirm(pairs, sets_of(docs, nodes, ends), percent), "links")

    found = stored(connected_components(links.toDF("src", "dst")), "components")
    labelled = led.filter("n > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled.select("at", "band", "node", "leader", "sketch", "component"), "labelled")
    mixed = labelled.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo != _hi").select("band")
    open_rows = stored(labelled.join(mixed, "band").filter("node != leader").select("at", "band", "node", "component", "sketch"), "open")
    sets = sets_of(docs, nodes, open_rows.select("node"))
    # What a set has alone bounds its similarity to any other: (n - own) / n, and less for what the other has alone.
    open_rows = open_rows.join(own_shingles(sets), "node").filter(100 * (F.col("items_n") - F.col("own")) >= percent * F.col("items_n"))
    open_rows = stored(open_rows.join(nodes.select("node", "bands"), "node"), "open")
    # A pair is looked at in the first band that it shares, not in each.
    first = F.array_position(F.zip_with("a_bands", "b_bands", lambda x, y: x == y), True) == F.col("a_at") + 1
    a, b = in_blocks(open_rows, block)
    shared = F.least(F.col("a_items_n") - F.col("a_own"), F.col("b_items_n") - F.col("b_own"))
    either = F.greatest(F.col("a_items_n") + F.col("b_own"), F.col("b_items_n") + F.col("a_own"))
    can = (100 * shared >= percent * either) & (_bits("a_sketch", "b_sketch") <= bits)
    rest = a.join(b, ["_band", "_i", "_j"]).filter((F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & can & first)
    rest = stored(rest.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "pairs")
    more = stored(confirm(rest, sets, percent), "links")
    labels = nodes.select("node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not more.isEmpty():
        # The later links join whole components: only those are walked again.
        of = stored(labels.select("node", "component"), "labels")
        bridges = more.join(of.withColumnsRenamed({"node": "a", "component": "src"}), "a").join(of.withColumnsRenamed({"node": "b", "component": "dst"}), "b")
        joined = connected_components(bridges.select("src", "dst")).withColumnsRenamed({"node": "_old", "component": "_new"})
        labels = labels.join(joined, F.col("component") == F.col("_old"), "left").withColumn("component", F.coalesce("_new", "component")).drop("_old", "_new")
    least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = labels.join(least, "component").select("node", "component_id", F.col("component").alias("group"))
    out = signed.select("doc_id", "h", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", "group", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one document of each group stays, as do texts without words."""
    found = stored(groups(docs, percent).filter("kept"), "kept")
    one = found.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("one")).select("one.*")
    empty = found.filter("n_shingles = 0").select("doc_id", "h").distinct()
    keepers = stored(one.select("doc_id", "h").unionByName(empty), "keepers").withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    # The rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    out = rows.join(keepers, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left_semi")
    if found.filter("n_shingles > 0").groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        return out.select("row.*")
    # A document that is there twice, text and all, would stay twice.
    words = F.coalesce(F.regexp_like(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    once = out.filter(words).groupBy("id", "h").agg(F.min("row").alias("row")).select("row.*")
    return once.unionByName(out.filter(~words).select("row.*"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("h", "group")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.both >= 85 * (x.k + y.k - i.both)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
