"""Token ids of whole texts by a word tokenizer, with a cache of words and chunks.

The tokenizer drops white space before its merges, so the ids of a text are the
ids of its chunks one after another. The library's model encodes each word once;
later it is looked up. A chunk with a code point that isn't printable here (a control, or
one that this Python's Unicode tables lack and the library may know), or with a mark that
either may lack, goes through the library as it stands in the text. Ids travel as bytes (little-endian unsigned 32-bit).
"""

from __future__ import annotations

import re
import sys
import unicodedata

import regex

#: Words and odd chunks kept in a Python worker; the cache starts anew beyond that.
CACHE_ENTRIES = 400_000
#: Splits a normalised chunk like the tokenizer file's own pre-tokenizer (a fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that may follow a word and then form a piece of their own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: str.split() takes these control characters for white space, the tokenizer doesn't.
_CONTROLS = re.compile("[\x1c-\x1f]")
_loaded: dict[str, "ChunkIds"] = {}
_patterns: dict = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _new_marks() -> str:
    """Marks that are reordered or composed, of later Unicode versions than 3.2: tables of other versions may lack them."""
    old, found = unicodedata.ucd_3_2_0, set()
    for i in range(0x300, sys.maxunicode + 1):
        c = chr(i)
        if old.category(c) == "Cn":
            parts = unicodedata.decomposition(c)
            if unicodedata.combining(c) or parts and parts[0] != "<":
                found |= {c, *(p for p in (chr(int(x, 16)) for x in parts.split() if parts[0] != "<") if old.category(p) == "Cn")}
    return "[" + "".join(sorted(found)) + "]"


def _odd(chunk: str) -> bool:
    if chunk.isascii():
        return not chunk.isprintable()
    if "marks" not in _patterns:
        _patterns["marks"] = re.compile(_new_marks()).search
    return not chunk.isprintable() or _patterns["marks"](chunk) is not None


class OddChunk(Exception):
    """A chunk that the library has to normalise itself."""


class ChunkIds(dict):
    """Normalised word or chunk -> bytes of its ids."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters, self.pieces = self.tokenizer.model, byte_letters(), regex.compile(WORD_PATTERN).findall
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _merged(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(letters)])

    def _library(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():  # letters that are known here, and no marks
            ids = self._merged(chunk)
        else:
            word = chunk.rstrip(_MARKS)
            if word.isalpha():
                return self[word] + self[chunk[len(word) :]]
            if _odd(chunk):
                raise OddChunk
            pieces = self.pieces(chunk)
            ids = self._merged(chunk) if pieces == [chunk] else b"".join(map(self.__getitem__, pieces))
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _CONTROLS.search(text):
            return self._library(text)
        try:
            return b"".join(map(self.__getitem__, self._normal(text).split()))
        except OddChunk:  # from here on each chunk by itself, as it stands in the text
            return b"".join([self._chunk(chunk) for chunk in text.split()])

    def _chunk(self, chunk: str) -> bytes:
        if _odd(chunk):
            return self._library(chunk)
        return b"".join(map(self.__getitem__, self._normal(chunk).split()))

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library has no final sigma
        return text.lower()


def chunk_ids(vocabulary: str) -> ChunkIds:
    """The tokenizer of a vocabulary file, loaded once in each Python worker."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = ChunkIds(vocabulary)
    return _loaded[vocabulary]
