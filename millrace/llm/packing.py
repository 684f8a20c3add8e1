"""Best-fit packing of documents into sequences by linear grouping.

1. Each document is tokenized where it is read, gets an end id and, if longer than a
   sequence, is cut into full pieces from its end; the first piece may be shorter.
   From here on only (doc_id, piece, start, length, crc) rows move.
2. The plan needs nothing but the counts of each length, at most ``capacity`` numbers,
   whatever the size of the corpus.  Lengths above ``capacity * SMALL`` are put in groups of
   equal cardinality and rounded up to the longest of the group; configurations of the
   few rounded sizes are chosen by bounded subset sums, each used as often as it fits;
   the true lengths take the places of the rounded ones; the short pieces then go by
   best fit, longest first, into what is free.
3. The plan is a bounded list of runs: the i-th piece of a length goes to a known sequence
   and offset.  A distributed rank inside each length applies it.

Defined cases: null or empty text is the end id alone; documents of equal length go by
doc_id and piece; repeated rows are packed separately; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.tokenization import PieceTokenizer
from millrace.operators.ranking import with_global_rank
from millrace.session import stored, table

CAPACITY = 2048
END_ID = 0
GROUPS = 256
SMALL = 1 / 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n - (max(1, -(-n // capacity)) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    def pieces(batches):
        tok, end = PieceTokenizer.of(tokenizer, specials=True), np.uint32(end_id).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tok.encode_bytes(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    row = (doc_id.as_py(), k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


# ---- the plan, on counts of lengths alone ----


def group_lengths(counts: np.ndarray, least: int, groups: int) -> list[list[tuple[int, int]]]:
    """Lengths above ``least`` in descending order, dealt into groups of equal cardinality.

    A group is a list of (length, count); its rounded size is its first length."""
    total = int(counts[least + 1 :].sum())
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in range(len(counts) - 1, least, -1):
        left = int(counts[length])
        while left:
            if not room:
                out.append([])
                room = size
            n = min(left, room)
            out[-1].append((length, n))
            left -= n
            room -= n
    return out


def best_filling(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size reach the largest sum within ``room``, larger sizes preferred."""
    order = [i for i in range(len(sizes) - 1, -1, -1) if counts[i] and sizes[i] <= room]
    reach, steps, mask = 1, [1], (1 << (room + 1)) - 1
    for i in order:
        for _ in range(min(counts[i], room // sizes[i])):
            more = (reach | reach << sizes[i]) & mask
            if more == reach:
                break
            reach = more
        steps.append(reach)
    target, used = reach.bit_length() - 1, [0] * len(sizes)
    for k in range(len(order) - 1, -1, -1):
        i = order[k]
        n = min(counts[i], target // sizes[i])
        while n and not steps[k] >> (target - n * sizes[i]) & 1:
            n -= 1
        used[i] = n
        target -= n * sizes[i]
    return used


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(group -> places, times): each takes the largest size left and fills up with the rest."""
    left, out, first = list(counts), [], 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        left[first] -= 1
        used = best_filling(sizes, left, capacity - sizes[first])
        left[first] += 1
        used[first] += 1
        times = min(left[i] // n for i, n in enumerate(used) if n)
        for i, n in enumerate(used):
            left[i] -= n * times
        out.append(({i: n for i, n in enumerate(used) if n}, times))
    return out


def substitute(groups: list[list[tuple[int, int]]], configs: list[tuple[dict[int, int], int]]) -> list[tuple[list[int], int]]:
    """The true lengths in the places: (lengths of one sequence, number of such sequences)."""
    queues = [list(reversed(g)) for g in groups]
    out = []
    for places, times in configs:
        slots: list[list[tuple[int, int]]] = []
        for g, n in places.items():
            for _ in range(n):
                slot, need = [], times
                while need:
                    length, there = queues[g].pop()
                    take = min(there, need)
                    slot.append((length, take))
                    if there > take:
                        queues[g].append((length, there - take))
                    need -= take
                slots.append(slot[::-1])
        while slots[0]:
            m = min(s[-1][1] for s in slots)
            out.append(([s[-1][0] for s in slots], m))
            for s in slots:
                length, n = s.pop()
                if n > m:
                    s.append((length, n - m))
    return out


def best_fit(bins: list[tuple[list[int], int]], counts: np.ndarray, most: int, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Put the lengths up to ``most``, longest first, where the least room is left over."""
    free: dict[int, list[tuple[dict[int, int], int]]] = {}
    there = 0

    def put(room: int, content: dict[int, int], n: int) -> None:
        nonlocal there
        free.setdefault(room, []).append((content, n))
        there |= 1 << room

    for lengths, n in bins:
        content: dict[int, int] = {}
        for x in lengths:
            content[x] = content.get(x, 0) + 1
        put(capacity - sum(lengths), content, n)
    for length in range(most, 0, -1):
        left = int(counts[length])
        while left:
            fitting = there >> length
            if fitting:
                room = (fitting & -fitting).bit_length() - 1 + length
                content, n = free[room].pop()
                if not free[room]:
                    there &= ~(1 << room)
            else:
                room, content, n = capacity, {}, left
            each = room // length
            each, use = (left, 1) if left < each else (each, min(n, left // each))
            if n > use and fitting:
                put(room, content, n - use)
            put(room - each * length, content | {length: content.get(length, 0) + each}, use)
            left -= each * use
    return [x for kept in free.values() for x in kept]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> np.ndarray:
    """Rows (length, first rank, places a sequence, first sequence, offset), by length and rank."""
    least = int(capacity * small)
    dealt = group_lengths(counts, least, groups)
    sizes, cards = [g[0][0] for g in dealt], [sum(n for _, n in g) for g in dealt]
    filled = best_fit(substitute(dealt, configurations(sizes, cards, capacity)), counts, least, capacity)
    rows, rank, sequence = [], {}, 0
    for content, n in filled:
        offset = 0
        for length in sorted(content, reverse=True):
            rows.append((length, rank.get(length, 0), content[length], sequence, offset))
            rank[length] = rank.get(length, 0) + content[length] * n
            offset += content[length] * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a materialised frame of ``token_pieces``."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row[0]] = row[1]
    runs = plan(counts, capacity, **how)
    before = np.concatenate([[0], np.cumsum(counts)])

    def place(batches):
        keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            rank = rank - before[length]
            run = runs[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            index = rank - run[:, 1]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(run[:, 3] + index // run[:, 2]), pa.array(run[:, 4] + index % run[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = with_global_rank(pieces, [F.col("length").asc(), F.col("doc_id").asc_nulls_first(), F.col("piece").asc()], "_rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(stored(token_pieces(docs, tokenizer), "pieces"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
