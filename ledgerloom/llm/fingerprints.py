"""Operator 2: document fingerprints by one-permutation MinHash.

Each five-word shingle (white-space words, A-Z lower-cased; a shorter text is one
shingle) is hashed once; its high bits choose a bin, and a bin keeps its least
hash. An empty bin takes over a bin chosen by its own random order of all bins,
the first in that order that isn't empty (optimal densification: each filled bin
is as likely as any other, and equally for all documents). Of each bin a few
low-order bits are kept, packed. Likeness corrects for bins that agree by chance:
(agreement - 2^-bits) / (1 - 2^-bits), within 0 and 1.

A null text counts as empty. An empty text's fingerprint is "" (likeness 1 to
itself, 0 to others). next_document() orders by doc_id descending, null ids last,
rows of equal id by text, so repeated rows follow each other; a single row
follows itself; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import Words, mixed, slabs
from .common import documents, whole_text

BINS, BITS, SHINGLE = 256, 8, 5
#: Rows that are put in order together, and at most how many such ranges.
RANGE_ROWS, MOST_RANGES = 1024, 1 << 16
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_orders: dict[int, np.ndarray] = {}


def bin_orders(bins: int) -> np.ndarray:
    """Row i: the order in which bin i looks for a filled bin; the same everywhere."""
    if bins not in _orders:
        rng = np.random.default_rng(20240229)
        _orders[bins] = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
    return _orders[bins]


def minima(texts: list[bytes], bins: int = BINS, shingle: int = SHINGLE) -> np.ndarray:
    """The densified least hashes, one row a text; all _EMPTY for a text without words."""
    out = np.full((len(texts), bins), _EMPTY, np.uint64)
    shift = np.uint64(64 - int(math.log2(bins)))
    for part in slabs(texts):
        text, value = Words(texts[part]).shingles(shingle)
        table = out[part].reshape(-1)
        np.minimum.at(table, text * bins + (value >> shift).astype(np.int64), value)
    orders = bin_orders(bins)
    filled = out != _EMPTY
    row, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for attempt in range(bins):
        if not len(row):
            break
        source = orders[column, attempt]
        hit = filled[row, source]
        out[row[hit], column[hit]] = out[row[hit], source[hit]]
        row, column = row[~hit], column[~hit]
    return out


def packed(table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low-order bits of each bin, packed into bytes; one row a text."""
    low = (mixed(table) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits == 8:
        return low
    spread = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :]
    return np.packbits(spread.reshape(len(table), -1), axis=1)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard likeness of the rows of two arrays that minima() gave."""
    one, other = (mixed(x) & np.uint64((1 << bits) - 1) for x in (a, b))
    chance = 2.0**-bits
    same = np.clip(((one == other).mean(axis=1) - chance) / (1 - chance), 0, 1)
    nothing = (a[:, 0] == _EMPTY), (b[:, 0] == _EMPTY)
    return np.where(nothing[0] | nothing[1], (nothing[0] & nothing[1]).astype(float), same)


def written_out(table: np.ndarray, bits: int = BITS) -> list[str]:
    rows = packed(table, bits)
    return ["" if empty else base64.b64encode(r.tobytes()).decode() for empty, r in zip(table[:, 0] == _EMPTY, rows)]


def prepared(text: str) -> bytes:
    return text.encode().lower()


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the packed fingerprint of every text."""

    def run(batches):
        for batch in batches:
            table = minima([prepared(t) for t in batch.column(1).to_pylist()], bins, shingle)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": pa.array(written_out(table, bits), pa.string())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def _above(cuts: list[int], value):
    """How many of cuts, which descend, are above value: a binary search."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts).cast("array<long>")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def step(at, width):
        further = F.coalesce(F.get(table, at + width - 1) > value, F.lit(False))
        return at + F.when(further, width).otherwise(F.lit(0))

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def next_document(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: of the document that follows by descending doc_id (after the last: the first).

    Documents are dealt by ranges of doc_id; the first document of each range
    goes to the range before it too. So text is shuffled once, and no range grows
    with the table up to MOST_RANGES * RANGE_ROWS rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    shares = np.arange(1, ranges) / ranges
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares.tolist())), 20 * ranges)).first()[0] if ranges > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    bucket = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(_above(cuts, F.col("doc_id")))
    # one row a range: its largest id
    heads = {r["b"]: r["head"] for r in rows.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("head")).collect()}
    if not heads:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    filled = sorted(heads)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    # by bucket: its head, and the range before it, where the head goes too
    head = F.lit([heads.get(b) for b in range(len(cuts) + 1)]).cast("array<long>")
    to = F.lit([before.get(b, 0) for b in range(len(cuts) + 1)]).cast("array<int>")
    own = F.struct(F.col("b").alias("bucket"), F.lit(False).alias("visits"))
    also = F.struct(F.get(to, F.col("b")).alias("bucket"), F.lit(True).alias("visits"))
    places = F.when(F.get(head, F.col("b")).eqNullSafe(F.col("doc_id")), F.array(own, also)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", bucket.cast("int").alias("b")).select("doc_id", "text", F.explode(places).alias("at"))
    dealt = dealt.select("doc_id", "text", "at.bucket", "at.visits")
    order = Window.partitionBy("bucket").orderBy("visits", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("not visits").select("doc_id", "text", "next_text")


def edited(size: str = "n_chars"):
    """The text whose last half is replaced by the first as many code points of next_text."""
    half = F.floor(F.col(size) / 2).cast("int")
    return F.concat(F.substring("text", F.lit(1), (F.col(size) - half).cast("int")), F.substring("next_text", F.lit(1), half))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""

    def run(batches):
        for batch in batches:
            texts, edits, nexts = ([prepared(t) for t in batch.column(i).to_pylist()] for i in (2, 3, 4))
            own, changed = minima(texts), minima(edits)
            following = np.roll(own, -1, axis=0)  # rows mostly come in order
            other = [i for i, t in enumerate(nexts) if i + 1 == len(nexts) or texts[i + 1] != t]
            following[other] = minima([nexts[i] for i in other])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_chars": batch.column(1), "edited_sha256": batch.column(5),
                "fingerprint": pa.array(written_out(own), pa.string()),
                "edited_fingerprint": pa.array(written_out(changed), pa.string()),
                "near_edited": likeness(own, changed), "near_next": likeness(own, following),
            })

    rows = next_document(documents(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", edited())
    rows = rows.select("doc_id", "n_chars", "text", "edited", "next_text", F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
