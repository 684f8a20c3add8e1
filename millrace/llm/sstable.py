"""Token ids in sorted-string-table shards, and reading them back.

Documents are range-partitioned by doc_id (so a partition is a run of the whole order),
tokenized where they land, and each partition writes its run as shards of bounded size.

A shard, all numbers little-endian:

    blocks   entries in ascending key order.  An entry is: bytes shared with the key before
             (u8), rest of the key (u8 length, bytes), number of ids (u32), ids (u16 or u32).
             The first key of a block shares nothing.
    index    for each block: key length u8, first key, offset u64, length u32, crc32 u32
    bloom    u64 number of bits, u32 number of probes, bit array
    footer   index offset u64, index length u64, bloom offset u64, bloom length u64,
             documents u64, ids u64, id width u32, blocks u32, magic 8 bytes

A key is one byte (0 for a null doc_id, else 1) and the doc_id, sign bit turned, big-endian;
so byte order is ascending order with null first.

A shard is written under a temporary name and then renamed; a task that runs again writes
the same shard under the same name.  The manifest lists the shards that count.

Defined cases: null or empty text is the end id alone; repeated doc_ids are kept, ordered
by their text's hash; an empty table gives a folder without shards and no rows; further
columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.tokenization import PieceTokenizer
from millrace.session import qualified, shared_dir, table

END_ID = 1
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 16 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7
MAGIC = b"MRSSTAB1"
FOOTER = struct.Struct("<6Q2I8s")
MANIFEST = "file string, part long, shard long, n_docs long, n_ids long, bytes long, first_id long, last_id long"
ENTRIES = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def to_key(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def from_key(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(keys: list[bytes], bits: int, probes: int) -> np.ndarray:
    a = np.array([zlib.crc32(k) for k in keys], np.uint64)
    b = np.array([zlib.crc32(k, 0x9E3779B9) for k in keys], np.uint64) | np.uint64(1)
    return ((a[:, None] * np.uint64(0x9E3779B97F4A7C15) + b[:, None] * np.arange(1, probes + 1, dtype=np.uint64)) >> np.uint64(8)) % np.uint64(bits)


class ShardWriter:
    """Builds one shard in memory; its size is bounded by the caller."""

    def __init__(self, width: int):
        self.width, self.blocks, self.keys, self.index = width, [], [], []
        self.block, self.block_size, self.size, self.n_ids, self.last = [], 0, 0, 0, b""

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = to_key(doc_id)
        if not self.block:
            self.index.append(key)
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        rest = key[shared:]
        self.block += [bytes((shared, len(rest))), rest, struct.pack("<I", len(ids)), ids.astype(f"<u{self.width}").tobytes()]
        self.block_size += 6 + len(rest) + len(ids) * self.width
        self.keys.append(key)
        self.last, self.n_ids = key, self.n_ids + len(ids)
        if self.block_size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.blocks.append(b"".join(self.block))
            self.size += self.block_size
            self.block, self.block_size = [], 0

    def finish(self) -> bytes:
        self._end_block()
        at, index = 0, []
        for key, block in zip(self.index, self.blocks, strict=True):
            index.append(bytes((len(key),)) + key + struct.pack("<QII", at, len(block), zlib.crc32(block)))
            at += len(block)
        index = b"".join(index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bitmap = np.zeros(-(-bits // 8) * 8, np.uint8)
        bitmap[_probes(self.keys, bits, BLOOM_PROBES).ravel()] = 1
        bloom = struct.pack("<QI", bits, BLOOM_PROBES) + np.packbits(bitmap, bitorder="little").tobytes()
        footer = FOOTER.pack(at, len(index), at + len(index), len(bloom), len(self.keys), self.n_ids, self.width, len(self.blocks), MAGIC)
        return b"".join([*self.blocks, index, bloom, footer])


class Shard:
    """A shard opened through ``read(offset, length)``; looks keys up without reading the rest."""

    def __init__(self, read, size: int):
        self.read = read
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.width, n_blocks, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, i, self.first, self.blocks = read(at, n), 0, [], []
        for _ in range(n_blocks):
            k = raw[i]
            self.first.append(raw[i + 1 : i + 1 + k])
            self.blocks.append(struct.unpack_from("<QII", raw, i + 1 + k))
            i += 17 + k
        self.bloom_at, self.bloom_n = bloom_at, bloom_n

    def entries(self, block: int):
        """(doc_id, ids) of one block, in order."""
        at, n, crc = self.blocks[block]
        raw = self.read(at, n)
        if zlib.crc32(raw) != crc:
            raise ValueError("damaged block")
        i, key = 0, b""
        while i < n:
            shared, rest = raw[i], raw[i + 1]
            key = key[:shared] + raw[i + 2 : i + 2 + rest]
            (count,) = struct.unpack_from("<I", raw, i + 2 + rest)
            i += 6 + rest
            yield from_key(key), np.frombuffer(raw, f"<u{self.width}", count, i)
            i += count * self.width

    def may_have(self, doc_id: int | None) -> bool:
        raw = self.read(self.bloom_at, self.bloom_n)
        bits, probes = struct.unpack_from("<QI", raw)
        return all(raw[12 + int(p) // 8] >> (int(p) % 8) & 1 for p in _probes([to_key(doc_id)], bits, probes)[0])

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each document with this doc_id, by binary search over the block index."""
        if not self.may_have(doc_id):
            return []
        key, found = to_key(doc_id), []
        block = max(0, bisect.bisect_left(self.first, key) - 1)
        while block < len(self.first) and self.first[block] <= key:
            found += [ids for k, ids in self.entries(block) if k == doc_id]
            block += 1
        return found


def lookup(spark: SparkSession, folder: str, doc_id: int | None) -> list[np.ndarray]:
    """Ids of one document in a written folder.

    The manifest's first and last doc_ids leave the shards that can have it; of those only footer, index and Bloom filter are read,
    and the blocks that the search leads to."""

    def search(batches):
        fs, root = pafs.FileSystem.from_uri(f"{folder}/shards")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    shard = Shard(lambda at, n, f=f: f.read_at(n, at), f.size())
                    found = [x.astype(np.int64).tolist() for x in shard.lookup(doc_id)]
                yield pa.RecordBatch.from_pydict({"ids": found}, schema=pa.schema([("ids", pa.list_(pa.int64()))]))

    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if doc_id is None:  # null comes first
        shards = shards.filter("first_id IS NULL")
    else:
        shards = shards.filter((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
    return [np.array(r[0]) for r in shards.select("file").mapInArrow(search, "ids array<long>").collect()]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` in ascending doc_id order; returns the manifest, one row per shard."""

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(f"{folder}/shards")
        tok = PieceTokenizer.of(tokenizer, specials=True)
        width = 2 if max(end_id, tok.library.get_vocab_size() - 1) < 1 << 16 else 4
        end = np.uint32(end_id).tobytes()
        shard, writer = 0, ShardWriter(width)

        def close():
            nonlocal shard, writer
            data, name = writer.finish(), f"part-{part:06d}-{shard:05d}.sst"
            temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, f"{root}/{name}")
            row = (name, part, shard, len(writer.keys), writer.n_ids, len(data), from_key(writer.keys[0]), from_key(writer.keys[-1]))
            shard, writer = shard + 1, ShardWriter(width)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string()] + [pa.int64()] * 7, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                writer.add(doc_id.as_py(), np.frombuffer(tok.encode_bytes(text.as_py() or "") + end, np.uint32))
                if writer.size >= shard_bytes:
                    yield close()
        if writer.keys:
            yield close()

    fs, root = pafs.FileSystem.from_uri(f"{folder}/shards")
    fs.create_dir(root)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Equal rows are told apart by a number, so that many of them don't meet in one task; their order among themselves doesn't show.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("_tie").asc()]
    ranged = slim.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a written folder: file, doc_id, start within the file, ids and their crc."""

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_buffer()
                shard, name, at = Shard(lambda a, n, raw=raw: raw[a : a + n].to_pybytes(), raw.size), path.as_py().rsplit("/", 1)[-1], 0
                for block in range(len(shard.blocks)):
                    rows = []
                    for doc_id, ids in shard.entries(block):
                        rows.append((name, doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(f"{folder}/shards")
    return files.select("path", "content").mapInArrow(decode, ENTRIES)


def with_starts(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """The ids before each document, from the shards' totals (one row per 16 MB of ids)."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_before"))
    return entries.join(starts, "file").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{qualified(spark, shared_dir(spark))}/sstable-{uuid.uuid4().hex}"
    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return with_starts(read_shards(spark, folder), manifest)
