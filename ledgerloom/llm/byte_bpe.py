"""Operator 4: byte-level BPE, with pre-tokens found by array scans instead of a regular expression.

Code points become classes (letter, number, space, other white space, apostrophe
that may open a contraction, anything else, with what follows looked up where it
matters). A class is a transition function over the kinds of pre-token that may
be open; such functions compose associatively, so a blocked prefix scan gives the
open kind at every code point of a batch, and with it every boundary. The slices
between boundaries are looked up all at once in a table of short slices, by all of their
bytes; others go through a cache to the merges, which new slices of a batch do together. encode() keeps the offset of every slice
and its number of tokens; decode() finds slices by them, and can so return any part of a text.

A null text counts as empty (no ids). Rows are handled one by one, so nulls,
repeated rows, ties and empty tables need no rule of their own; other columns are
left out.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mixed, portions
from .common import documents, whole_text

#: Slices kept by the merges of a Python worker, code points scanned together, ids decoded together.
CACHE_ENTRIES, SCANNED, DECODED = 300_000, 1 << 19, 1 << 19
#: Places of the table of short slices (a power of two), bytes of a short slice, ids that the table holds.
SLOTS, SHORT, POOLED = 1 << 18, 16, 1 << 21
#: Widths in bytes of slices that are merged together, and what stands for the rank of a pair that can't be joined.
WIDTHS, NONE = (8, 16, 32, 48), 1 << 30
#: The lowest bytes of a word, by their number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Code points of the White_Space property (fixed values).
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
LETTER, NUMBER, OTHER, MARK2, MARK3, GAP, LAST_SPACE, LAST_GAP = range(8)
#: Kinds of open pre-token; DONE: whatever comes next begins another.
WORD, DIGITS, SIGNS, PREFIX, BLANK, TAIL1, TAIL2, DONE = range(8)
_RAW_LETTER, _RAW_NUMBER, _RAW_OTHER, _RAW_SPACE, _RAW_GAP, _RAW_MARK = range(6)


def step(kind: int, symbol: int) -> tuple[int, bool]:
    """The open kind after a symbol, and whether a pre-token begins at it."""
    if symbol == LETTER:
        if kind in (TAIL1, TAIL2):
            return (DONE if kind == TAIL1 else TAIL1), False
        return WORD, kind not in (WORD, PREFIX)
    if symbol == NUMBER:
        return DIGITS, kind not in (DIGITS, PREFIX)
    if symbol == OTHER or kind in (SIGNS, PREFIX) and symbol in (MARK2, MARK3):
        return SIGNS, kind not in (SIGNS, PREFIX)
    if symbol in (MARK2, MARK3):
        return (TAIL1 if symbol == MARK2 else TAIL2), True
    if symbol == GAP:
        return BLANK, kind != BLANK
    return (PREFIX if symbol == LAST_SPACE else BLANK), True


class Scanner:
    """Tables of the classes and of all compositions of transition functions."""

    def __init__(self):
        raw = np.full(0x110000, _RAW_OTHER, np.uint8)
        kinds = {"L": _RAW_LETTER, "N": _RAW_NUMBER}
        raw[:] = [kinds.get(unicodedata.category(chr(c))[0], _RAW_OTHER) for c in range(0x110000)]
        raw[WHITE_SPACE] = _RAW_GAP
        raw[32], raw[39] = _RAW_SPACE, _RAW_MARK
        self.raw = raw
        # functions are vectors of the kind reached from each kind; at a text's first
        # code point the kind before it doesn't matter, hence the constant ones
        plain = [tuple(step(k, s)[0] for k in range(8)) for s in range(8)]
        first = [(step(DONE, s)[0],) * 8 for s in range(8)]
        found = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *plain, *first]))}
        queue = list(found)
        for f in queue:
            for g in [*plain, *first]:
                h = tuple(g[k] for k in f)
                if h not in found:
                    found[h] = len(found)
                    queue.append(h)
        self.number = len(found)
        self.reached = np.array(list(found), np.uint8)
        self.then = np.array([[found[tuple(g[k] for k in f)] for g in found] for f in found], np.uint16).ravel()
        self.function = np.array([found[f] for f in [*plain, *first]], np.uint16)
        self.begins = np.array([[step(k, s)[1] for s in range(8)] for k in range(8)])

    def prefix(self, functions: np.ndarray, width: int = 64) -> np.ndarray:
        """Inclusive scan: the composition of all functions up to each place."""
        n = len(functions)
        if n <= width:
            out = functions.copy()
            for i in range(1, n):
                out[i] = self.then[int(out[i - 1]) * self.number + int(out[i])]
            return out
        rows = -(-n // width)
        grid = np.zeros(rows * width, np.uint16)  # 0 is the identity
        grid[:n] = functions
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        for i in range(1, width):
            grid[i] = self.then[grid[i - 1].astype(np.int32) * self.number + grid[i]]
        before = np.zeros(rows, np.uint16)
        before[1:] = self.prefix(np.ascontiguousarray(grid[-1]))[:-1]
        grid = self.then[before.astype(np.int32) * self.number + grid]
        return grid.T.ravel()[:n]

    def boundaries(self, text: str, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in text, which holds several texts; edges: where each of them begins."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n, raw = len(points), self.raw[points]
        blank = (raw == _RAW_SPACE) | (raw == _RAW_GAP)
        is_first = np.zeros(n + 1, bool)
        is_first[edges[edges <= n]] = True
        is_first[n] = True
        following = np.zeros(n, bool)  # the next code point is of the same text and no white space
        following[:-1] = ~blank[1:] & ~is_first[1:n]
        symbol = np.array([LETTER, NUMBER, OTHER, GAP, GAP, OTHER], np.uint8)[raw]
        symbol[(raw == _RAW_SPACE) & following] = LAST_SPACE
        symbol[(raw == _RAW_GAP) & following] = LAST_GAP
        marks = np.flatnonzero((raw == _RAW_MARK) & following)
        if len(marks):
            one = points[marks + 1]
            two = points[np.minimum(marks + 2, n - 1)]
            inside = (marks + 2 < n) & ~is_first[np.minimum(marks + 2, n)]
            symbol[marks[np.isin(one, [ord(c) for c in "stmd"])]] = MARK2
            pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            symbol[marks[pairs & inside]] = MARK3
        functions = self.function[symbol + 8 * is_first[:n].astype(np.uint8)]
        kind = self.reached[self.prefix(functions), DONE]
        before = np.full(n, DONE, np.uint8)
        before[1:] = kind[:-1]
        before[is_first[:n]] = DONE
        return np.flatnonzero(self.begins[before, symbol])


class Merges(dict):
    """Bytes of a slice -> bytes of its ids, merged by rank when it is new."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.packed = ranks, [i.to_bytes(4, "little") for i in range(max(ranks.values()) + 1)]
        pairs = [(a << 32 | b, rank) for word, rank in ranks.items() for i in range(1, len(word)) if (a := ranks.get(word[:i])) is not None and (b := ranks.get(word[i:])) is not None]
        self.pairs, self.joint = np.array(sorted(pairs) or [(-1, NONE)], np.int64).T.copy()
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for one that no id spells."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.joint[at], NONE)

    def learn(self, slices: list[bytes]) -> None:
        """Merges the new ones of up to 48 bytes together: all rows join their own neighbours of least rank, step by step."""
        if len(self) + len(slices) > CACHE_ENTRIES:
            self.clear()
        new = [x for x in dict.fromkeys(slices) if len(x) <= WIDTHS[-1] and x not in self and x not in self.ranks]
        for below, width in zip((0, *WIDTHS), WIDTHS):
            own = [x for x in new if below < len(x) <= width]
            if own:
                parts, left = self._merged(own, width)
                data = parts.astype("<u4").tobytes()
                self.update((x, data[4 * width * i : 4 * (width * i + n)]) for i, (x, n) in enumerate(zip(own, left.tolist(), strict=True)))

    def _merged(self, slices: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, a row a slice, how many of them count)."""
        left = np.fromiter(map(len, slices), np.int64, len(slices))
        parts = self.bytes[np.frombuffer(b"".join([x.ljust(width, b"\0") for x in slices]), np.uint8)].reshape(-1, width)
        ranks = np.full(parts.shape, NONE)
        inside = np.arange(width - 1) < left[:, None] - 1
        ranks[:, :-1][inside] = self.joined(parts[:, :-1][inside], parts[:, 1:][inside])
        done, counts, rows, columns = parts.copy(), left.copy(), np.arange(len(slices)), np.arange(width - 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            more = least < NONE
            if not more.all():
                done[rows[~more]], counts[rows[~more]] = parts[~more], left[~more]
                parts, ranks, rows, left, at, least = parts[more], ranks[more], rows[more], left[more], at[more], least[more]
            every = np.arange(len(rows))
            # what is right of the pair moves one place to the left
            source = columns + (columns > at[:, None])
            parts[:, :-1], ranks[:, :-1] = np.take_along_axis(parts, source, 1), np.take_along_axis(ranks, source, 1)
            parts[every, at], ranks[:, -1] = least, NONE
            left = left - 1
            ranks[every, at] = NONE
            for side in (at, at - 1):
                fit = np.flatnonzero((side >= 0) & (side < left - 1))
                place = side[fit]
                ranks[fit, place] = self.joined(parts[fit, place], parts[fit, place + 1])
        return done, counts

    def __missing__(self, data: bytes) -> bytes:
        rank = self.ranks.get(data)
        ids = self.packed[rank] if rank is not None else b"".join([self.packed[i] for i in self.merge(data)])
        if len(data) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[data] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Joins the neighbours of least rank, the leftmost first, until none can be joined: a heap over linked parts, for any length."""
        get, n = self.ranks.get, len(data)
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is data[i:end[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i] if alive[i] else n
            if not alive[i] or middle >= n or end[middle] != stop:
                continue
            alive[middle], end[i] = False, stop
            if stop < n:
                back[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := back[i]) >= 0 and (r := get(data[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out


def _strung(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places at[0], at[0] + 1, ... of count[0] items, then those of the next run."""
    before = np.cumsum(count) - count
    return np.repeat(at - before, count) + np.arange(int(count.sum()))


class Slices:
    """Ids of all slices of a text: short ones from a table, others and new ones by the merges.

    A row of the table holds the two words of a slice's bytes, its size, and where its ids are and how
    many; a slice is found only if all of its bytes are equal. One that meets another in its place
    takes the place over.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.table, self.pool, self.used = np.zeros((SLOTS, 5), np.int64), np.zeros(1 << 16, np.uint32), 0

    def ids(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices in order, how many each has); slices are data[begin[i]:end[i]], none empty."""
        if self.used > POOLED:
            self.clear()
        size = end - begin
        padded = np.frombuffer(data + bytes(16), np.uint8)
        words = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
        low, high = words[begin] & _LOW[np.minimum(size, 8)], words[begin + 8] & _LOW[np.clip(size - 8, 0, 8)]
        place = (mixed(low ^ mixed(high + size.astype(np.uint64))) & np.uint64(SLOTS - 1)).astype(np.int64)
        own = (low.view(np.int64), high.view(np.int64), size)
        rows = self.table[place]
        at, count = rows[:, 3].copy(), rows[:, 4].copy()
        new = np.flatnonzero((rows[:, 0] != own[0]) | (rows[:, 1] != own[1]) | (rows[:, 2] != own[2]))
        if len(new):
            slices = [data[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)]
            self.merges.learn(slices)
            found = [self.merges[x] for x in slices]
            fresh = np.frombuffer(b"".join(found), "<u4")
            count[new] = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            at[new] = self.used + np.cumsum(count[new]) - count[new]
            if self.used + len(fresh) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(fresh), len(self.pool)), np.uint32)])
            self.pool[self.used : self.used + len(fresh)] = fresh
            self.used += len(fresh)
            short = new[size[new] <= SHORT]
            short = short[np.unique(place[short], return_index=True)[1]]
            self.table[place[short]] = np.column_stack([*(x[short] for x in own), at[short], count[short]])
        return self.pool[_strung(at, count)], count


_loaded: dict[tuple[str, str], object] = {}


def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _encoder(vocabulary: str) -> tuple[Scanner, Slices]:
    """Loaded once in each Python worker that encodes."""
    if ("encode", vocabulary) not in _loaded:
        _loaded["encode", vocabulary] = Scanner(), Slices(Merges(_ranks(vocabulary)))
    return _loaded["encode", vocabulary]


def _spelling(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all ids one after another, where each id's begin, how many it has), loaded once in each Python worker that decodes."""
    if ("decode", vocabulary) not in _loaded:
        ranks = _ranks(vocabulary)
        spelled = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            spelled[rank] = word
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        _loaded["decode", vocabulary] = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(size) - size, size
    return _loaded["decode", vocabulary]


def encode_texts(texts: list[str], vocabulary: str) -> Iterator[list[tuple[bytes, np.ndarray, np.ndarray]]]:
    """For each text: ids as bytes, begin of each slice in the text, tokens of each slice; some texts at a time."""
    scanner, slices = _encoder(vocabulary)
    begin = 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (not size or size + len(texts[stop]) <= SCANNED):
            size += len(texts[stop])
            stop += 1
        edges = np.zeros(stop - begin + 1, np.int64)
        np.cumsum([len(t) for t in texts[begin:stop]], out=edges[1:])
        text = "".join(texts[begin:stop])
        starts = scanner.boundaries(text, edges[:-1]) if text else np.zeros(0, np.int64)
        data = text.encode()
        first = np.searchsorted(starts, edges)
        # slices begin at code points, of which each has one byte that doesn't go on from another
        places = starts if len(data) == len(text) else np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts]
        ids, counts = slices.ids(data, places, np.append(places[1:], len(data))) if len(places) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        cuts = np.concatenate([[0], np.cumsum(counts)])[first]
        spans = zip(cuts[:-1], cuts[1:], first[:-1], first[1:], edges[:-1], strict=True)
        yield [(ids[i:j].tobytes(), starts[a:b] - edge, counts[a:b]) for i, j, a, b, edge in spans]
        begin = stop


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype())))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, starts (code point at which each slice begins) and counts (its tokens)."""

    def run(batches):
        for batch in portions(batches, 1, 2000):
            done = 0
            for found in encode_texts(batch.column(1).to_pylist(), vocabulary):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(done, len(found)),
                    "ids": _lists([np.frombuffer(x[0], "<u4") for x in found], pa.int32()),
                    "starts": _lists([x[1] for x in found], pa.int32()),
                    "counts": _lists([x[2] for x in found], pa.int32()),
                })
                done += len(found)

    schema = "doc_id long, ids array<int>, starts array<int>, counts array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)


def _binary(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    """The bytes of data between bounds, an item each."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def spelled(ids: np.ndarray, bounds: np.ndarray, vocabulary: str) -> pa.Array:
    """What the ids between bounds spell, an item each."""
    data, begin, size = _spelling(vocabulary)
    sizes = size[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return _binary(ends[bounds], data[_strung(begin[ids], sizes)])


def decode_slices(ids: np.ndarray, counts: np.ndarray, vocabulary: str) -> bytes:
    """What the ids of slices of counts[i] ids each spell."""
    return spelled(ids, np.array([0, int(np.sum(counts))]), vocabulary)[0].as_py()


def decode(encoded: DataFrame, vocabulary: str, begin: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id, ids, decoded (bytes that the slices spell), packed (the ids as little-endian 32-bit integers).

    Slices are found by the offsets that encode() kept: with begin and stop, ids and decoded are
    those of the slices that begin at these code points or between them, and nothing else is spelled.
    """

    def run(batches):
        for batch in batches:
            bounds, values = ([np.asarray(batch.column(c).offsets) for c in (1, 2, 3)], [np.asarray(batch.column(c).values) for c in (1, 2, 3)])
            bound, own = bounds[0] - bounds[0][0], values[0][bounds[0][0] : bounds[0][-1]]
            if begin or stop is not None:
                parts = []
                for row in range(batch.num_rows):
                    ids, starts, counts = (v[b[row] : b[row + 1]] for b, v in zip(bounds, values, strict=True))
                    first, last = np.searchsorted(starts, [begin, stop]) if stop is not None else (np.searchsorted(starts, begin), len(starts))
                    skipped = int(counts[:first].sum())
                    parts.append(ids[skipped : skipped + int(counts[first:last].sum())])
                bound, own = np.cumsum([0, *map(len, parts)]), np.concatenate([own[:0], *parts])
            own = np.ascontiguousarray(own, "<i4")
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(own)),
                "decoded": spelled(own, bound, vocabulary), "packed": _binary(4 * bound, own.view(np.uint8)),
            })

    def small(batches):
        return run(piece for batch in batches for piece in _by_ids(batch))

    return encoded.select("doc_id", "ids", "starts", "counts").mapInArrow(small, "doc_id long, ids array<int>, decoded binary, packed binary")


def _by_ids(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch with about DECODED ids each."""
    bounds, begin = np.asarray(batch.column(1).offsets), 0
    while begin < batch.num_rows:
        stop = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + DECODED, "right")) - 1)
        yield batch.slice(begin, stop - begin)
        begin = stop


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for every document."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return decode(encode(documents(spark, sf_dir), vocabulary), vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
