"""Token ids of whole texts, equal to the tokenizers library's, computed word by word.

The library splits a text by a pattern and merges inside each piece only, and no piece of these
patterns reaches over a single space.  So the ids of a text are those of its words in turn.  A worker
remembers the ids of the words it has met; a new word is split by the pattern and its pieces are
merged by tiktoken, which is given the vocabulary file's own merges in their order.  The library
itself encodes whole texts where the pattern or the lower-casing of Python could differ from its own
(control characters, code points above U+00FF, special-token strings), and every piece
of a vocabulary whose merges can't be told by their results.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

# The letters, numbers and contraction suffixes of Latin-1 as byte-level
# pre-tokenizers class them, and the pattern of the byte-level pre-tokenizer.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_WORDS, LONGEST_WORD = 300_000, 64
END = b"\xff"  # a byte that UTF-8 doesn't use stands for the end of a word


class _Memo(dict):
    """Remembers up to twice MOST_WORDS words: the newer half and the one before it."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= MOST_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merger(model: dict):
    """``bytes of a piece -> ids`` by tiktoken, or None for a vocabulary it can't stand for."""
    suffix = model.get("end_of_word_suffix") or ""
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "fuse_unk")):
        return None
    letters = byte_letters()

    def raw(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        return bytes(letters[c] for c in (token[: -len(suffix)] if ends else token)) + (END if ends else b"")

    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    try:
        import tiktoken

        made = ["".join(m) for m in merges]
        # Single bytes take no part in merging order; the end of a word joins its last byte before anything else.
        single = [c for c in letters if c in vocab]
        ends = [c + suffix for c in single if suffix and c + suffix in vocab]
        if len(set(made)) < len(made) or len(single) < 256 or suffix and len(ends) < 256:
            return None
        order = [*single, *ends, *made]
        ranks = {raw(t): i for i, t in enumerate(order)}
        ids = [vocab[t] for t in order]
        if suffix and END not in ranks:
            ranks[END] = len(order)
        if len(ranks) < len(order):
            return None
        encode = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    except (ImportError, AttributeError, KeyError):
        return None
    tail = END if suffix else b""
    return lambda piece: [ids[r] for r in encode(piece + tail)]


class PieceTokenizer:
    """``encode(text) -> uint32 ids``; one object per Python worker and vocabulary file."""

    _made: dict[tuple[str, bool], PieceTokenizer] = {}

    @classmethod
    def of(cls, path: str, specials: bool = False) -> PieceTokenizer:
        """``specials``: strings of special tokens get those tokens' ids, as by the library's default; else they are text."""
        if (path, specials) not in cls._made:
            cls._made[path, specials] = cls(path, specials)
        return cls._made[path, specials]

    def __init__(self, path: str, specials: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        names = json.dumps(spec.get("normalizer"))
        self.lower = '"Lowercase"' in names
        pre = spec["pre_tokenizer"]
        self.spaced = pre["type"] == "ByteLevel"  # a space belongs to the word behind it; else white space is dropped
        pattern = BYTE_LEVEL if self.spaced else pre["pretokenizers"][0]["pattern"]["Regex"]
        # Inside a class the letters stand alone; elsewhere they need brackets.
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", LETTERS).replace(r"\p{N}", NUMBERS), pattern)
        pattern = pattern.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
        self.pieces = re.compile(pattern).findall
        # 1: white space, 2: characters that go to the library.
        self.kind = np.zeros(256, np.uint8)
        self.kind[[0x20, *range(0x09, 0x0E)]] = 1
        self.kind[[*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA1)]] = 2
        self.merged = merger(spec["model"])
        lead = " " if self.spaced else ""
        self.memo = _Memo(lambda word: self._by_pieces(lead + word))

    def _by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _by_pieces(self, text: str) -> bytes:
        out = array("I")
        for piece in self.pieces(text):
            out.extend(self.merged(piece.encode()) if self.merged else self._by_library(piece))
        return out.tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.uint32)

    def encode_bytes(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        try:
            kind = self.kind[np.frombuffer(text.encode("latin-1"), np.uint8)]
            plain = not (kind == 2).any()
        except UnicodeEncodeError:
            plain = False
        lowered = text.lower() if self.lower else text
        if not plain or any(s in text or s in lowered for s in self.special):
            return np.array(self._by_library(text), np.uint32).tobytes()
        if not self.spaced:
            return b"".join(map(self.memo.__getitem__, lowered.split()))
        white = kind == 1
        if (white[1:] & white[:-1]).any():  # a run of white space is split as a whole
            return self._by_pieces(lowered)
        first, *rest = lowered.split(" ")
        return self._by_pieces(first) + b"".join(map(self.memo.__getitem__, rest))
