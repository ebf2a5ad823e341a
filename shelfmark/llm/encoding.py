"""Whole-text encoding with a public tokenizer, with a cache of what stands between spaces.

BPE never merges across the pieces its pre-tokenizer makes, so a text's ids are those of its
space-separated chunks joined, as long as each cut is a single space between two other
characters, and that it holds none of the tokenizer's added tokens. Each worker keeps the ids of chunks and of pieces it has met and asks the tokenizers
library for the others only. A chunk that white space adjoins is no clean cut: such a text goes to
the library whole.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: Chunks and pieces that a worker's caches hold before they start anew, and the longest they keep
#: (about 200 bytes each, 400 at most).
CHUNKS, PIECES, LONGEST = 700_000, 400_000, 48

# The pieces of a byte-level BPE, and of a lower-cased BPE with word ends.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DROPPED = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""


@functools.cache
def byte_letters() -> dict[int, str]:
    """Printable stand-ins for all bytes, as byte-level vocabularies spell them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


#: Marks that stand alone after a word.
_MARKS = frozenset(",.;:!?")


class _Chunks(dict):
    """Chunk -> its ids as bytes; None where the cut beside the chunk isn't clean."""

    def __init__(self, owner: Encoder, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, chunk: str):
        if len(self) >= CHUNKS:
            self.clear()
        owner = self.owner
        word, mark = (chunk[:-1], chunk[-1]) if chunk[-1:] in _MARKS else (chunk, "")
        if word.isalpha() and (word.isascii() or max(word) < "\u0100"):  # the most frequent forms need no pattern
            word = self.lead + (word.lower() if owner.lower else word)
            out = owner.known.get(word) or owner.piece(word)
            if mark:
                out += owner.known.get(mark) or owner.piece(mark)
        elif owner.dropped or chunk and not (chunk[0].isspace() or chunk[-1].isspace()):
            out = owner.chunk(self.lead + chunk)
        else:
            out = None
        if len(chunk) <= LONGEST:
            self[chunk] = out
        return out


class Encoder:
    """Ids of whole texts as the bytes of unsigned integers of ``dtype``.

    ``spaces`` says what the tokenizer does with a space: "led" keeps it at the head of the next
    piece, "dropped" drops it.
    """

    def __init__(self, path: str, spaces: str, dtype: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(dtype)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.dropped = spaces == "dropped"
        self.normal = self.tokenizer.normalizer
        self.lower = self.normal is not None
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces = regex.compile(DROPPED if self.dropped else SPACED).findall
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.first, self.rest = _Chunks(self, ""), _Chunks(self, "" if self.dropped else " ")

    def chunk(self, text: str) -> bytes:
        if self.lower:
            text = text.lower() if text.isascii() else self.normal.normalize_str(text)
        return b"".join([self.known.get(x) or self.piece(x) for x in self.pieces(text)])

    def piece(self, text: str) -> bytes:
        if len(self.known) >= PIECES:
            self.known.clear()
        if text.isascii() and text.isprintable():  # only a space is spelled otherwise
            spelled = text.replace(" ", self.letters[32])
        else:
            spelled = text.encode().decode("latin-1").translate(self.letters)
        out = array(self.code, [t.id for t in self.tokenize(spelled)]).tobytes()
        if len(text) <= LONGEST:
            self.known[text] = out
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(mark in text for mark in self.added):  # found before anything else is cut
            return self.whole(text)
        head, *tail = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        except TypeError:  # None: white space beside a space
            return self.whole(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str, spaces: str, dtype: str) -> Encoder:
    """One encoder a worker, kept between tasks."""
    return Encoder(path, spaces, dtype)


def id_type(path: str, *more: int) -> str:
    """The narrowest unsigned type that holds every id."""
    top = max([*Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), *more])
    return "<u2" if top < 1 << 16 else "<u4"
