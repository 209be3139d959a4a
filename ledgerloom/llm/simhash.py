"""Operator 5: SimHash near-duplicates by a trie self-join.

Distinct fingerprints form a binary trie. The join walks pairs of nodes together
from the root, adds up the bits in which the two paths differ, and drops a pair
once that exceeds the budget. Two fingerprints within a budget of b bits agree on
one of b + 1 stretches of their bits, whole; so there is a trie for each stretch,
of the fingerprints turned until it comes first, and on its levels only nodes that
agree meet. Spark deals the nodes of the upper levels out: as many levels as keep
NODE fingerprints or fewer in a node. A node that holds more, as the data are
skewed, is dealt out below its stretch too, as pairs of nodes within the budget.
A task returns links that span its groups, not all pairs. Spark then joins the
groups across tasks, by rounds of star contraction over written tables.

A null text counts as empty: fingerprint zero, linked like any other. A null
doc_id is never a component's id, unless the component has only such rows (then
null). Repeated rows all return; an empty table gives none. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lasting, scratch, whole_text, written

WIDTH, SHINGLE, SEED, BUDGET = 64, 3, 42, 3
PREFIX, NODE = 6, 1 << 18
#: Bits below its stretch over which a larger node is dealt out, at least.
DEEPER = 4
#: Node pairs walked together, and leaves compared at once below a pair.
FRONTIER, LEAVES = 1 << 19, 32


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if over half of the shingles' hashes have it; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(r, SEED) for r in runs), np.uint64)
    set_bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint of every text, as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            found = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class Groups:
    """Groups of numbered items that links have joined, each named by its least item."""

    def __init__(self, n: int):
        self.name = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.name[a], self.name[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.name, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(upper := self.name[self.name], self.name):
                self.name = upper


def close_pairs(
    a: np.ndarray, b: np.ndarray | None, depth: int, spent: int, budget: int = BUDGET, alike: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted arrays a and b (None: a with itself) that differ in at most budget bits.

    All of a share their first depth bits, and so do all of b; these differ in spent bits. Of a
    with itself, pairs that differ in their first alike bits need not be found.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    zeros: dict[tuple[int, int], np.ndarray] = {}

    def split(side: int, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
        """Where the second child begins: after those of low..high whose next bit is 0."""
        if (kept := zeros.get((side, level))) is None:
            values = b if side else a
            kept = np.zeros(len(values) + 1, np.int32)
            np.cumsum((values >> np.uint64(WIDTH - 1 - level)) & np.uint64(1) == 0, out=kept[1:])
            zeros[side, level] = kept
        return low + kept[high] - kept[low]

    one = np.zeros(1, np.int32)
    stack = [(depth, one, one + len(a), one, one + len(b), one + spent)]
    while stack:
        level, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(level, *(x[half:] for x in (a0, a1, b0, b1, err))), (level, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        across = (a1 - a0) * (b1 - b0).astype(np.int64)
        small = (across <= LEAVES) | (level == WIDTH)
        if small.any():
            n, width = across[small], (b1 - b0)[small]
            base = np.repeat(np.arange(len(n)), n)
            rank = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a0[small][base] + rank // width[base], b0[small][base] + rank % width[base]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if small.all():
            continue
        a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        am, bm = split(0, a0, a1, level), split(not own, b0, b1, level)
        same = (a0 == b0) & own
        children = [(a0, am, b0, bm, err), (am, a1, bm, b1, err)]
        if level >= alike:
            children += [(a0, am, bm, b1, err + 1), tuple(x[~same] for x in (am, a1, b0, bm, err + 1))]
        merged = [np.concatenate(x) for x in zip(*children, strict=True)]
        keep = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= budget)
        stack.append((level + 1, *(x[keep] for x in merged)))


def _masks(bits: int, budget: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= budget]


def _turned(values: np.ndarray, by: int) -> np.ndarray:
    return values << np.uint64(by) | values >> np.uint64(WIDTH - by) if by else values


def _walker(budget: int, stretch: int):
    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, turn, depth, _, mask = map(int, key)
        values = np.sort(_turned(frame["fp"].to_numpy().view(np.uint64), turn * stretch))
        if mask:
            # nodes below the stretch that differ in the mask's bits
            own = values >> np.uint64(WIDTH - depth) & np.uint64((1 << depth - stretch) - 1)
            high = own > own ^ np.uint64(mask)
            a, b = values[~high], values[high]
        else:
            a, b = values, None
        items = a if b is None else np.concatenate([a, b])
        groups = Groups(len(items))
        for i, j in close_pairs(a, b, depth, mask.bit_count(), budget, stretch):
            groups.link(i, j if b is None else j + len(a))
        linked = np.flatnonzero(groups.name != np.arange(len(items)))
        back = _turned(items, (WIDTH - turn * stretch) % WIDTH).view(np.int64)
        return pd.DataFrame({"u": back[linked], "v": back[groups.name[linked]]})

    return walk


def node_pairs(distinct: DataFrame, budget: int, node_size: int = NODE) -> tuple[DataFrame, int]:
    """Each fingerprint under every node (pair) whose fingerprints it may link to, and the bits of a stretch.

    A row says: fp, big (the node's own number if it is dealt out deeper, else -1), turn (which stretch
    comes first), depth (bits that all of the node share), node, and mask (in which bits below
    the stretch the two nodes differ).
    """
    stretch = WIDTH // (budget + 1)
    bits = min(stretch, max(PREFIX, math.ceil(math.log2(max(1, distinct.count()) / node_size))))
    turned = F.lit(None).cast("long")
    for turn in range(budget + 1):
        by = turn * stretch
        value = F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", WIDTH - by)) if by else F.col("fp")
        turned = F.when(F.col("turn") == turn, value).otherwise(turned)
    rows = distinct.select("fp", F.explode(F.array(*map(F.lit, range(budget + 1)))).alias("turn"))
    rows = rows.select("fp", "turn", turned.alias("t"))
    # at most 2^STRETCH nodes a turn: their sizes show which are too large for a task
    node = F.shiftrightunsigned("t", WIDTH - bits)
    sizes = rows.groupBy("turn", node.alias("node")).count().where(F.col("count") > node_size)
    large = sizes.agg(F.max("count")).first()[0]
    plain = rows.select(
        "fp", F.lit(-1).cast("long").alias("big"), "turn", F.lit(bits).alias("depth"), node.alias("node"), F.lit(0).alias("mask")
    )
    if large is None:
        return plain, stretch
    deeper = max(DEEPER, math.ceil(math.log2(large / node_size)) + 1)
    marked = rows.withColumn("node", node).join(F.broadcast(sizes.select("turn", "node", F.lit(True).alias("is_big"))), ["turn", "node"], "left")
    plain = marked.where("is_big is null").select(*plain.columns[:1], F.lit(-1).cast("long").alias("big"), "turn", F.lit(bits).alias("depth"), "node", F.lit(0).alias("mask"))
    below = F.shiftrightunsigned("t", WIDTH - stretch - deeper).bitwiseAND((1 << deeper) - 1)
    split = marked.where("is_big").select(
        "fp", F.shiftrightunsigned("t", WIDTH - stretch).alias("big"), "turn", F.lit(stretch + deeper).alias("depth"),
        below.alias("p"), F.explode(F.array(*map(F.lit, _masks(deeper, budget)))).alias("mask"),
    )
    split = split.withColumn("node", F.least("p", F.col("p").bitwiseXOR(F.col("mask").cast("long"))))
    return plain.unionByName(split.select(plain.columns)), stretch


def links(distinct: DataFrame, budget: int = BUDGET, node_size: int = NODE) -> DataFrame:
    """(u, v): fingerprints joined by pairs within budget bits, as stars that span every group. distinct: fp, no repeats."""
    dealt, stretch = node_pairs(distinct, budget, node_size)
    return dealt.groupBy("big", "turn", "depth", "node", "mask").applyInPandas(_walker(budget, stretch), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(item, root): the least item that can be reached, for every item with a link, by rounds of star contraction."""
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    with scratch(spark):
        while True:
            # a forest of stars has one link above each item, and none above that
            ends = edges.select(F.col("u").alias("item"), F.col("v").alias("above"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            ends = ends.unionByName(edges.select(F.col("v").alias("item"), F.lit(None).cast(edges.schema["v"].dataType).alias("above"), F.lit(0).alias("up"), F.lit(1).alias("down")))
            ends = ends.groupBy("item").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
            if ends.where("ups > 1 or (ups > 0 and down > 0)").isEmpty():
                return lasting(edges.select(F.col("u").alias("item"), F.col("v").alias("root")), "components")
            # large star: every neighbour above an item is linked to the item's least neighbour
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            # small star: an item and the neighbours below it are linked to the least of them
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = written(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    with scratch(docs.sparkSession):
        joined = components(links(nodes.select("fp"), budget)).withColumnsRenamed({"item": "fp"})
    joined = nodes.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(joined.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, and component_id of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
