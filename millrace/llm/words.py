"""Runs of letters and digits of texts, with A-Z in lower case, as UTF-8 bytes.

A word is a maximal run of ``0-9``, ``A-Z``, ``a-z`` and characters outside ASCII.  Texts are split in pieces of PIECE_BYTES, so that a very long
one needs memory for a piece, not for all its words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
SLICE_BYTES = 1 << 20

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def folded(data: bytes) -> bytes:
    """``data`` with A-Z in lower case and a space for each byte that is in no word."""
    return data.translate(_FOLD)


def word_pieces(data: bytes, most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; at least one piece, and no word cut."""
    text = folded(data)
    if len(text) <= most:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def as_bytes(column: pa.Array) -> list[bytes]:
    """The rows of an Arrow text column as bytes; nulls are empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batches_of(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows of about SLICE_BYTES."""
    sizes = [0 if n is None else n for n in pc.binary_length(column.cast(pa.large_binary())).to_pylist()]
    row = 0
    while row < len(sizes):
        end, held = row, 0
        while end < len(sizes) and (end == row or held + sizes[end] <= SLICE_BYTES):
            held += sizes[end]
            end += 1
        yield row, as_bytes(column.slice(row, end - row))
        row = end
