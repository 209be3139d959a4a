"""Operator 6: a quality classifier, a factorisation machine over hashed words and structure.

Inputs are the words of a text, hashed to BUCKETS (each weighs 1/sqrt(words) times
the root of its count), structure statistics (shares of letter kinds, marks, repeats
and so on, cut into steps) and the text's size as metadata. Labels, lang, source
and doc_id are never inputs. The score is sigmoid(w0 + sum w x + pairs), where the
pairwise part <v_i, v_j> x_i x_j of all pairs is, for each factor, half of
(sum v x)^2 - sum (v x)^2: linear in the number of inputs.

train() fits on at most SAMPLE labelled rows, the least by a hash of doc_id among
those that aren't held out, and on no more of them than INPUTS hashed inputs hold;
everything else covers all rows. Texts become inputs on the executors, and one task fits
on them; only the machine, whose size is fixed, comes to the driver. Without any such
row every document is kept (score 1).

A null text counts as empty and is scored like any text. A null doc_id is never
trained on and isn't held out. Rows are scored one by one, so repeated rows score
alike; an empty table gives no rows. score() keeps the columns it is asked to keep,
whatever their names; above() keeps whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, portions, slabs
from .common import documents, whole_text

#: Labelled rows trained on at most; hash buckets of words; steps of a statistic; factors.
SAMPLE, BUCKETS, STEPS, FACTORS = 6000, 1 << 14, 16, 6
#: Hashed inputs trained on at most (8 bytes each).
INPUTS = 8_000_000
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.08, 1e-5
THRESHOLD = 0.7
_KINDS = np.zeros(256, np.uint8)  # 1 small letter, 2 capital, 3 digit, 4 mark, 5 line end, 6 byte of another letter
_KINDS[ord("a") : ord("z") + 1], _KINDS[ord("A") : ord("Z") + 1], _KINDS[ord("0") : ord("9") + 1] = 1, 2, 3
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_KINDS[10], _KINDS[128:] = 5, 6
STATISTICS = 14


def statistics(words: Words) -> np.ndarray:
    """Rows of STATISTICS shares, each within 0 and 1, one row a text."""
    n = len(words.edges) - 1
    size = np.maximum(np.diff(words.edges) - 1, 1).astype(float)
    text = np.repeat(np.arange(n), np.diff(words.edges))
    data = words.data[: len(text)]
    kinds = np.bincount(text * 8 + _KINDS[data], minlength=8 * n).reshape(n, 8)
    counts = words.counts
    some = np.maximum(counts, 1).astype(float)
    owner = np.repeat(np.arange(n), counts)
    lengths = words.end - words.begin
    total = lambda x: np.bincount(owner, x, minlength=n) / some
    order = np.lexsort((words.hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    again = np.zeros(len(lengths), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    last, first = words.data[words.end - 1], words.data[words.begin]
    capital = _KINDS[first] == 2
    alone = (lengths == 1) & (_KINDS[first] == 4)
    ends = np.isin(last, [ord(c) for c in ".!?"])
    out = [
        kinds[:, 2] / size, kinds[:, 3] / size, kinds[:, 4] / size, kinds[:, 5] / size * 20, kinds[:, 6] / size,
        total(lengths) / 16, total(fresh_share(order, fresh)), total(again), total(capital), total(alone), total(ends),
        total((_KINDS[last] == 4) & ~ends), np.log1p(size) / 14, np.log1p(counts) / 12,
    ]
    return np.clip(np.stack(out, axis=1), 0, 1)


def fresh_share(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order))
    out[order] = fresh
    return out


def inputs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, index, value): the inputs of text i are those from first[i] to first[i + 1].

    A word input is its hash bucket; statistic k is input BUCKETS + k * STEPS + step.
    """
    words = Words(texts)
    n, counts = len(texts), words.counts
    owner = np.repeat(np.arange(n), counts)
    key, times = np.unique(owner * BUCKETS + (words.hashes >> np.uint64(50)).astype(np.int64), return_counts=True)
    word_owner = key // BUCKETS
    value = np.sqrt(times / np.maximum(counts, 1)[word_owner]) * 0.5
    steps = np.minimum((statistics(words) * STEPS).astype(np.int64), STEPS - 1)
    index = np.concatenate([key % BUCKETS, (BUCKETS + np.arange(STATISTICS) * STEPS + steps).ravel()])
    value = np.concatenate([value, np.full(n * STATISTICS, 0.5)])
    owner = np.concatenate([word_owner, np.repeat(np.arange(n), STATISTICS)])
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(n + 1)), index[order], value[order]


class Machine:
    """A factorisation machine, trained by stochastic gradients with a rate for each weight."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = BUCKETS + STATISTICS * STEPS
        self.bias, self.weights = 0.0, np.zeros(n)
        self.factors = rng.normal(0, 0.03, (n, FACTORS))

    def raw(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the sigmoid, and the sum v x of each factor. Every text has inputs."""
        scaled = self.factors[index] * value[:, None]
        sums = np.add.reduceat(scaled, first[:-1], axis=0)
        squares = np.add.reduceat(scaled * scaled, first[:-1], axis=0)
        return self.bias + np.add.reduceat(self.weights[index] * value, first[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def fit(self, texts: list[bytes], labels: np.ndarray) -> "Machine":
        parts = [inputs(texts[part]) for part in slabs(texts)]
        sizes = np.concatenate([np.diff(p[0]) for p in parts])
        return self.fit_inputs(sizes, *(np.concatenate([p[i] for p in parts]) for i in (1, 2)), labels)

    def fit_inputs(self, sizes: np.ndarray, index: np.ndarray, value: np.ndarray, labels: np.ndarray) -> "Machine":
        """Fits on texts of sizes[i] inputs each, one after another."""
        rng = np.random.default_rng(11)
        first = np.concatenate([[0], np.cumsum(sizes)])
        seen_w, seen_v, seen_b = np.full(len(self.weights), 1e-6), np.full(self.factors.shape, 1e-6), 1e-6
        self.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                width = sizes[rows]
                own = np.concatenate([[0], np.cumsum(width)])
                at = np.repeat(first[rows] - own[:-1], width) + np.arange(own[-1])
                i, x = index[at], value[at]
                raw, sums = self.raw(own, i, x)
                error = np.repeat((1 / (1 + np.exp(-raw)) - labels[rows]) / len(rows), width) * x
                touched, place = np.unique(i, return_inverse=True)
                slope = np.zeros(len(touched))
                np.add.at(slope, place, error)
                bend = np.zeros((len(touched), FACTORS))
                np.add.at(bend, place, error[:, None] * (np.repeat(sums, width, axis=0) - self.factors[i] * x[:, None]))
                slope += DECAY * self.weights[touched]
                bend += DECAY * self.factors[touched]
                seen_w[touched] += slope**2
                seen_v[touched] += bend**2
                self.weights[touched] -= RATE * slope / np.sqrt(seen_w[touched])
                self.factors[touched] -= RATE * 0.3 * bend / np.sqrt(seen_v[touched])
                pull = float((1 / (1 + np.exp(-raw)) - labels[rows]).mean())
                seen_b += pull * pull
                self.bias -= RATE * pull / np.sqrt(seen_b)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        parts = [self.raw(*inputs(texts[part]))[0] for part in slabs(texts)]
        return 1 / (1 + np.exp(-np.concatenate(parts))) if parts else np.zeros(0)


class Always:
    """Stands for a machine where no labelled row is there to learn from."""

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.ones(len(texts))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _hashed(batches):
    """(doc_id, digest, quality, text) as (doc_id, digest, quality, index, value)."""
    for rows in portions(batches, 3):
        first, index, value = inputs([t.encode() for t in rows.column(3).to_pylist()])
        offsets = pa.array(first.astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (index.astype(np.int32), value.astype(np.float32))]
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], *lists], ["doc_id", "digest", "quality", "index", "value"])


def _fitter(most: int):
    def fit(batches):
        sizes, indexes, values, labels, room = [], [], [], [], most
        for batch in batches:
            lists = batch.column(3), batch.column(4)
            offsets = np.asarray(lists[0].offsets)
            n = int(np.searchsorted(offsets, offsets[0] + room, "right")) - 1
            room = room - int(offsets[n] - offsets[0]) if n == batch.num_rows else -1
            sizes.append(np.diff(offsets[: n + 1]))
            for kept, x in zip((indexes, values), lists, strict=True):
                kept.append(np.array(np.asarray(x.values)[offsets[0] : offsets[n]]))
            labels.append(batch.column(2).to_numpy(zero_copy_only=False)[:n].astype(float))
            if room < 0:
                break
        if labels and sum(map(len, labels)):
            machine = Machine().fit_inputs(*map(np.concatenate, (sizes, indexes, values, labels)))
            found = [np.float64(machine.bias).tobytes(), machine.weights.astype("<f4").tobytes(), machine.factors.astype("<f4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in found], ["bias", "weights", "factors"])

    return fit


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = INPUTS) -> Machine | Always:
    """Fits a machine in one task from at most sample labelled rows of at most so many inputs."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(doc_id).agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(doc_id, whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", F.xxhash64("text").alias("digest"), "quality", "text").mapInArrow(
        _hashed, "doc_id long, digest long, quality int, index array<int>, value array<float>")
    # rows of one id may have several texts: of all rows the first are taken
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(sample)
    found = rows.mapInArrow(_fitter(most), "bias binary, weights binary, factors binary").collect()
    if not found:
        return Always()
    machine = Machine()
    machine.bias = float(np.frombuffer(found[0]["bias"])[0])
    machine.weights = np.frombuffer(found[0]["weights"], "<f4")
    machine.factors = np.frombuffer(found[0]["factors"], "<f4").reshape(-1, FACTORS)
    return machine


def _scorer(machine: Machine | Always):
    @F.arrow_udf("double")
    def score_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            whole = pa.RecordBatch.from_arrays([batch], ["text"])
            parts = [machine.score([t.encode() for t in part.column(0).to_pylist()]) for part in portions([whole], 0)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return score_of


def score(docs: DataFrame, machine: Machine | Always, keep: list[str]) -> DataFrame:
    """The columns to keep and score, for every row of docs. Only text goes to Python.

    The machine travels with the function: its size is fixed by BUCKETS and FACTORS.
    """
    return docs.select(*keep, _scorer(machine)(whole_text()).alias("score"))


def above(docs: DataFrame, machine: Machine | Always, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose score is threshold or more."""
    scored = docs.select(F.struct(*docs.columns).alias("row"), _scorer(machine)(whole_text()).alias("score"))
    return scored.where(F.col("score") >= threshold).select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
