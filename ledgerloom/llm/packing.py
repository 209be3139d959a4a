"""Operator 3: best-fit packing of token pieces into sequences, certified by lower bounds.

cut() encodes documents and cuts the long ones. pack() deals pieces to groups,
runs best-fit decreasing in each, and compares the number of sequences with the
best of the bounds that dual feasible functions give for the group's lengths.
Groups that meet their bound are certified and done. The others give up the
sequences that are not full; those pieces are dealt anew among such groups and
packed again. A new deal is taken only if it needs fewer sequences.

Rounds stop after ROUNDS, or once a new deal saves nothing, although groups with a gap
may be left: certified tells which groups meet their bound.

A null text counts as empty (one piece: the end id); a very long text is cut whole, into
as many pieces as it takes. Repeated rows are packed one by one; pieces of equal length
are taken in the order of their numbers; a null doc_id stays null; an empty table gives
no pieces; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import portions
from .common import documents, whole_text, written
from .word_tokens import chunk_ids

#: Pieces that one task packs together, and how often groups with a gap exchange pieces.
GROUP, ROUNDS = 8192, 3
_PIECES = "deal long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, sequence_id long, offset long, filled long, bins long, bound long"


def _cutter(vocabulary: str, end_id: int, size: int):
    end, width = end_id.to_bytes(4, "little"), 4 * size

    def cut(batches):
        table, deal = chunk_ids(vocabulary), TaskContext.get().partitionId() << 40
        for batch in portions(batches, 1):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = table.encode(text) + end
                for k in range(0, len(data), width):
                    part = data[k : k + width]
                    rows.append((deal, doc_id, k // width, k >> 2, len(part) >> 2, zlib.crc32(part)))
                    deal += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            names = ["deal", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return cut


def cut(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of at most size ids of every document; deal numbers them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_cutter(vocabulary, end_id, size), _PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The most sequences that some dual feasible function shows to be needed."""
    n = np.bincount(lengths, minlength=size + 1)
    values = np.arange(size + 1)
    count, total = np.cumsum(n), np.cumsum(n * values)
    best = math.ceil(total[-1] / size)
    for k in range(0, size // 2 + 1):  # values over size-k count whole, those under k nothing
        large = count[-1] - count[size - k]
        middle = count[size - k] - count[max(size // 2, k - 1)]
        room = middle * size - (total[size - k] - total[max(size // 2, k - 1)])
        small = total[max(size // 2, k - 1)] - (total[k - 1] if k else 0)
        best = max(best, large + middle + max(0, math.ceil((small - room) / size)))
    for k in range(1, 21):  # x -> floor((k+1)x)/k, x itself where (k+1)x is whole
        scaled = (k + 1) * values
        steps = np.where(scaled % size == 0, values * k, scaled // size * size)
        best = max(best, math.ceil(int((n * steps).sum()) / (k * size)))
    return int(best)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the sequence and offset of each piece, and how full each sequence is."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    rooms = 0  # bit r: some sequence has room r
    where, offset, filled = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(filled)
            filled.append(0)
        where[i], offset[i] = b, size - room
        filled[b] += length
        room -= length
        if room:
            open_bins[room].append(b)
            rooms |= 1 << room
    return where, offset, np.array(filled, np.int64)


def _packer(size: int, number: int):
    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("deal", ignore_index=True)
        lengths = frame["length"].to_numpy()
        where, offset, filled = best_fit(lengths, size)
        base = (number << 56) + (int(key[0]) << 24)
        return frame.assign(
            sequence_id=base + where, offset=offset, filled=filled[where], bins=len(filled), bound=lower_bound(lengths, size)
        )[[c.split()[0] for c in _PACKED.split(", ")]]

    return pack


def _dealt(pieces: DataFrame, n: int, size: int, number: int) -> DataFrame:
    groups = max(1, math.ceil(n / GROUP))
    group = F.pmod(F.xxhash64("deal", F.lit(number)), F.lit(groups))
    rows = pieces.select(*(c.split()[0] for c in _PIECES.split(", ")), group.alias("group"))
    return rows.groupBy("group").applyInPandas(_packer(size, number), _PACKED)


def _need(packed: DataFrame, size: int):
    """Pieces and sequences of those groups that have a gap and sequences that are not full."""
    spare = packed.where((F.col("bins") > F.col("bound")) & (F.col("filled") < size))
    return spare, spare.agg(F.count("*"), F.sum((F.col("offset") == 0).cast("long"))).first()


def pack(pieces: DataFrame, size: int = 2048, rounds: int = ROUNDS) -> DataFrame:
    """Places every row of pieces (as cut() gives them) in a sequence of at most size ids.

    Adds sequence_id, offset, and certified: whether the sequence's group meets its bound.
    """
    pieces = written(pieces, "pieces")
    done = packed = written(_dealt(pieces, pieces.count(), size, 0), "packed")
    for number in range(1, rounds + 1):
        spare, (n, sequences) = _need(packed, size)
        if not n:
            break
        again = written(_dealt(spare, n, size, number), "packed")
        if again.where("offset = 0").count() >= sequences:
            break
        # what was given up is replaced by what was packed anew
        kept = done.where(~((F.col("bins") > F.col("bound")) & (F.col("filled") < size)))
        done, packed = kept.unionByName(again), again
        if n <= GROUP:
            break
    return done.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
        (F.col("bins") <= F.col("bound")).alias("certified"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(cut(docs, vocabulary, size, end_id), size)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence of at most 2048 ids."""
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
