"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled together; a longer text is handled alone.
SLAB = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slabs(texts: list[bytes]) -> Iterator[slice]:
    """Runs of consecutive texts of about SLAB bytes together."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLAB:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def portions(batches: Iterable[pa.RecordBatch], column: int, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most so many rows and about SLAB bytes in a column of texts."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            stop = max(begin + 1, min(begin + rows, int(np.searchsorted(total, before + SLAB, "right"))))
            yield batch.slice(begin, stop - begin)
            begin = stop


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    kept = _powers.get(name)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 2 * SLAB), base, np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if n <= 2 * SLAB:
            _powers[name] = kept
    return kept[:n]


class Words:
    """Words (runs of bytes other than ASCII white space) of several texts.

    data: the texts' bytes, each text followed by a space; hashes: one 64-bit
    hash a word; begin, end: its bytes in data; first: the first word of each
    text, and at the end the number of words; edges: where each text begins.
    """

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.edges[1:])
        if not len(data):
            data = self.data = np.full(1, 32, np.uint8)
        space = _SPACE[data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            change = np.concatenate([[0], change])
        self.begin, self.end = change[0::2], change[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("base", _BASE, len(data)), out=total[1:])
        self.hashes = mixed((total[self.end] - total[self.begin]) * _power("inverse", _BASE_INVERSE, len(data))[self.begin])
        self.first = np.searchsorted(self.begin, self.edges)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, hash) of each run of size words.

        A text of fewer words has one shingle, all of it; an empty text has none.
        """
        n, counts = len(self.hashes), self.counts
        text = np.repeat(np.arange(len(counts)), counts)
        left = np.repeat(self.first[1:], counts) - np.arange(n)  # words from here to the text's end
        value = np.zeros(n, np.uint64)
        for k in range(min(size, n)):
            factor = np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
            inside = left[: n - k] > k
            value[: n - k] += np.where(inside, self.hashes[k:] * factor, np.uint64(0))
        begins = np.zeros(n, bool)
        begins[self.first[:-1][counts > 0]] = True
        keep = (left >= size) | begins
        return text[keep], mixed(value[keep])
