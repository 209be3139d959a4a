"""Operator 13: the trie of conversation prefixes, by truncation peeling.

A conversation is its chain: 16 bytes of digest and 4 bytes of word count for each turn,
one after another; a node is the first bytes of the chains of its members. Texts are
digested where they are read and never shuffled. Chains are dealt out by ranges and
sorted, so the members of a node lie together. A task takes packs of sorted chains and
peels each from its maximum depth: nodes that survive from below and conversations that
end at this depth are merged where their chains agree so far, all that is asked of the
nodes is added up, the last turn is stripped, and the rest goes up one turn.

The nodes on the way to the first and the last chain of a pack may have members outside
of it. They stay open: what is known of them is handed, as additions at some depths of
these two chains, to the next pack and, from the end of the task, to a last round over the open
chains of all tasks. That round is one task, whose input is two chains for each task
of the first round, however large the table is. A node whose parent stayed open gets the
parent's id by a join with the nodes that were handed on.

One conversation's turns are gathered in a row (some 80 bytes a turn). Equal conversations
stream through one task, one after another, as the digest of their ids is of their order.

Nulls and odd rows: rows without a conv_id are left out; a null turn comes first; equal
turns are ordered by the digest of role and text; a null role or text counts as empty;
repeated rows are turns of their own; an empty table has no nodes; other columns are left
out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lasting, scratch, written
from .spelling import CRC32_SQL

#: Bytes of a turn in a chain, and those of its digest.
STEP, DIGEST = 20, 16
#: Bytes of chains in a pack.
PACK = 4 << 20
#: A conversation follows one whose id is a multiple of GROUP for up to HEAD turns.
GROUP, HEAD = 20, 3
_WORD = r"[^\x20\x09-\x0D]+"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_SUMS = ("n", "children", "leaves", "saved")
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, key binary, parent_key binary"
)
_OPEN = (
    "chain binary, depths array<int>, n array<long>, children array<long>, leaves array<long>, saved array<long>, "
    "least array<long>, ends array<string>"
)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, base, pieces (hexadecimal, a turn each, in order); base is the multiple of GROUP at or before the id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    count = F.lpad(F.hex(F.regexp_count(text, F.lit(_WORD))), 2 * (STEP - DIGEST), "0")
    conv_id = F.col("conv_id").cast("long")
    rows = turns.where("conv_id IS NOT NULL").select(
        (conv_id - conv_id % GROUP).alias("base"), conv_id.alias("conv_id"), "turn", F.concat(digest, count).alias("piece")
    )
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"])
    return rows.repartition("base").groupBy("base", "conv_id").agg(pieces.alias("pieces"))


def rebuilt(found: DataFrame) -> DataFrame:
    """conv_id, chain: the first turns of the base's conversation, as many as the id's checksum says, then the own ones after as many."""
    heads = found.where("conv_id = base").select("base", F.slice("pieces", 1, HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    pieces = F.concat(head, F.slice("pieces", h + 1, F.size("pieces")))
    return found.join(heads, "base", "left").select("conv_id", F.unhex(F.array_join(pieces, "")).alias("chain"))


def chained(found: DataFrame) -> DataFrame:
    """conv_id, chain of conversations as they are."""
    return found.select("conv_id", F.unhex(F.array_join("pieces", "")).alias("chain"))


@dataclass
class Entry:
    """A chain and what is added to its nodes at some depths."""

    chain: bytes
    handed: bool  # by another pack: its nodes may have been a closed one's open parents there
    depths: list[int] = field(default_factory=list)
    sums: list[tuple[int, int, int, int]] = field(default_factory=list)  # in the order of _SUMS
    least: list[int] = field(default_factory=list)
    ends: list[str | None] = field(default_factory=list)

    def add(self, depth: int, sums: tuple[int, int, int, int], least: int, ends: str | None) -> None:
        self.depths.append(depth)
        self.sums.append(sums)
        self.least.append(least)
        self.ends.append(ends)


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two chains begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // STEP
    if a[:STEP] != b[:STEP]:
        return 0
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // STEP


def _key(chain: bytes, depth: int) -> bytes:
    return hashlib.sha256(chain[: depth * STEP]).digest()[:16]


def peel(entries: list[Entry], is_open: bool) -> tuple[list[dict], list[Entry]]:
    """Columns of the closed nodes, a dict for each depth, and the open chains: none unless is_open.

    entries: different chains in order. Nodes on the way to a handed one get keys of their own.
    """
    m, last = len(entries), len(entries) - 1
    lens = np.array([len(e.chain) // STEP for e in entries])
    shared = np.array([-1, *(_shared(a.chain, b.chain) for a, b in zip(entries, entries[1:]))])
    edges = np.concatenate([[0], np.cumsum(lens)[:-1]]) * STEP
    data = np.frombuffer(b"".join(e.chain for e in entries), np.uint8)
    at = np.repeat(np.arange(m), [len(e.depths) for e in entries])
    depths = np.array([d for e in entries for d in e.depths], np.int64)
    sums = np.array([s for e in entries for s in e.sums], np.int64).reshape(-1, 4)
    least = np.array([x for e in entries for x in e.least], np.int64)
    ends = np.array([x for e in entries for x in e.ends], object)
    by_depth, by_length = np.argsort(depths, kind="stable"), np.argsort(lens, kind="stable")
    top = int(lens.max())
    added, ended = (np.searchsorted(x, np.arange(top + 2)) for x in (depths[by_depth], lens[by_length]))
    closed, opened = [], [Entry(entries[0].chain, True), Entry(entries[last].chain, True)]
    handed = np.flatnonzero([e.handed for e in entries])
    heads, below = np.zeros(0, np.int64), None  # first chains of the nodes one turn deeper, and the closed ones among them
    for d in range(top, -1, -1):
        new = by_length[ended[d] : ended[d + 1]]
        place = np.concatenate([heads, new])
        order = np.argsort(place, kind="stable")
        place = place[order]
        group = np.empty(len(place), np.int64)
        begins = shared[place] < d
        group[order] = np.cumsum(begins) - 1
        first = place[begins]
        total, smallest = np.zeros((len(first), 4), np.int64), np.full(len(first), np.iinfo(np.int64).max)
        said: np.ndarray = np.full(len(first), None, object)
        if below:
            up = group[below["rank"]]
            np.add.at(total, up, below["up"])
            np.minimum.at(smallest, up, below["conv_id"])
        here = by_depth[added[d] : added[d + 1]]
        if len(here):
            g = np.searchsorted(first, at[here], "right") - 1
            np.add.at(total, g, sums[here])
            np.minimum.at(smallest, g, least[here])
            some = np.array([x is not None for x in ends[here]])
            said[g[some]] = ends[here][some]
        shut, keyed = np.ones(len(first), bool), np.zeros(len(first), bool)
        keyed[np.searchsorted(first, handed[lens[handed] >= d], "right") - 1] = True
        if is_open:
            for side, entry, g in ((0, 0, 0), (1, last, len(first) - 1)):
                if lens[entry] >= d and shut[g]:
                    shut[g] = False
                    if total[g, 0]:
                        opened[side].add(d, tuple(total[g].tolist()), int(smallest[g]), said[g])
        if below:  # children learn whose they are
            below["parent_conv_id"] = pa.array(smallest[up], mask=~shut[up])
            below["parent_key"] = [None if ok else _key(entries[e].chain, d) for ok, e in zip(shut[up], first[up], strict=True)]
        n, children, leaves, saved = total[shut].T
        words = np.zeros(len(n), np.int64)
        if d:
            spots = edges[first[shut]] + d * STEP - (STEP - DIGEST)
            for k in range(STEP - DIGEST):
                words = words * 256 + data[spots + k]
        leaves, saved = np.where(children == 0, 1, leaves), saved + (n - 1) * words
        below = {
            "conv_id": smallest[shut], "depth": np.full(len(n), d), "n_convs": n, "n_children": children, "n_leaves": leaves,
            "saved_tokens": saved, "ends_sha256": [x or _NO_ENDS for x in said[shut]],
            "key": [_key(entries[e].chain, d) if named else None for e, named in zip(first[shut], keyed[shut], strict=True)],
            "parent_conv_id": pa.nulls(len(n), pa.int64()), "parent_key": [None] * len(n),
            "rank": np.flatnonzero(shut), "up": np.stack([n, np.ones_like(n), leaves, saved], 1),
        }
        closed.append(below)
        heads = first
    return closed, [e for e in opened if e.depths] if is_open else []


_KINDS = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "key": pa.binary(), "parent_key": pa.binary(),
    "chain": pa.binary(), "depths": pa.list_(pa.int32()), "n": pa.list_(pa.int64()), "children": pa.list_(pa.int64()),
    "leaves": pa.list_(pa.int64()), "saved": pa.list_(pa.int64()), "least": pa.list_(pa.int64()), "ends": pa.list_(pa.string()),
}


def _rows(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        name: columns[name] if isinstance(columns.get(name), pa.Array) else pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind)
        for name, kind in _KINDS.items()
    })


def _open_rows(entries: list[Entry]) -> pa.RecordBatch:
    columns = {name: [[s[k] for s in e.sums] for e in entries] for k, name in enumerate(_SUMS)}
    columns |= {name: [getattr(e, name) for e in entries] for name in ("chain", "depths", "least", "ends")}
    return _rows(columns, len(entries))


def _ended(batches: Iterable[pa.RecordBatch]) -> Iterator[Entry]:
    """An entry for each distinct chain of rows (conv_id, chain) in order of both."""
    chain, digest, n, least = None, hashlib.sha256(), 0, 0
    for batch in batches:
        ids = iter(batch.column(0).to_pylist())
        for now, same in groupby(batch.column(1).to_pylist()):
            own = [next(ids) for _ in same]
            if now != chain:
                if n:
                    yield Entry(chain, False, [len(chain) // STEP], [(n, 0, 0, 0)], [least], [digest.hexdigest()])
                chain, digest, n, least = now, hashlib.sha256(), 0, own[0]
            digest.update((("," if n else "") + ",".join(map(str, own))).encode())
            n += len(own)
    if n:
        yield Entry(chain, False, [len(chain) // STEP], [(n, 0, 0, 0)], [least], [digest.hexdigest()])


def _handed(batches: Iterable[pa.RecordBatch]) -> Iterator[Entry]:
    """Open chains, those that are equal as one."""
    now = None
    for batch in batches:
        for chain, depths, n, children, leaves, saved, least, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.chain != chain:
                if now:
                    yield now
                now = Entry(chain, True)
            for at, *sums, lowest, end in zip(depths, n, children, leaves, saved, least, ends, strict=True):
                now.add(at, tuple(sums), lowest, end)
    if now:
        yield now


def _peeled(entries: Iterable[Entry], final: bool, pack_bytes: int) -> Iterator[pa.RecordBatch]:
    def closed(found: list[dict]) -> Iterator[pa.RecordBatch]:
        for level in found:
            if len(level["conv_id"]):
                yield _rows(level, len(level["conv_id"]))

    pack, size = [], 0
    for entry in entries:
        pack.append(entry)
        size += len(entry.chain) + 64
        if size >= pack_bytes and len(pack) > 2:
            found, pack = peel(pack, True)
            yield from closed(found)
            size = 0
    if pack:
        found, opened = peel(pack, not final)
        yield from closed(found)
        if opened:
            yield _open_rows(opened)


def trie(chains: DataFrame, pack_bytes: int = PACK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    chains: conv_id, chain, one row a conversation, in the form of rebuilt() or chained().
    """
    schema = f"{_NODE}, {_OPEN}"
    with scratch(chains.sparkSession):
        chains = written(chains.select("conv_id", "chain"), "chains")
        dealt = chains.repartitionByRange("chain").sortWithinPartitions("chain", "conv_id")
        first = written(dealt.mapInArrow(lambda rows: _peeled(_ended(rows), False, pack_bytes), schema), "peeled")
        names = [part.split()[0] for part in _OPEN.split(", ")]
        handed = first.where("chain IS NOT NULL").select(names).repartition(1).sortWithinPartitions("chain")
        rest = written(handed.mapInArrow(lambda rows: _peeled(_handed(rows), True, pack_bytes), schema), "peeled")
        nodes = first.where("chain IS NULL").unionByName(rest)
        parents = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
        orphans = nodes.where("parent_key IS NOT NULL").join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("found"))
        names = [part.split()[0] for part in _NODE.split(", ")][:-2]
        return lasting(nodes.where("parent_key IS NULL").select(names).unionByName(orphans.select(names)), "nodes")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each rebuilt upon the first of its group of twenty ids."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(conversations(turns)))


#: The decimal digits and sign of an id as bytes.
_ID_BYTES = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::UBIGINT)"
OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
    left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY turn NULLS FIRST, id) AS pieces,
    {CRC32_SQL.format(_ID_BYTES)} % 4 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.pieces, [])[1:o.h], o.pieces[o.h + 1:]) AS pieces
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, len(pieces) AS size, CASE WHEN d = 0 THEN 0 ELSE pieces[d].words END AS words,
    array_to_string(list_transform(pieces[1:d], lambda x: x.id), '') AS key
  FROM (SELECT *, unnest(range(0, len(pieces) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends
  FROM prefixes GROUP BY key, d
), children AS (
  SELECT left(key, 32 * (d - 1)) AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (key)),
above AS (
  SELECT left(key, 32 * a) AS key, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.n_children, a.n_leaves, a.saved_tokens,
  n.ends AS ends_sha256
FROM counted n JOIN above a USING (key) LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.key = left(n.key, 32 * (n.d - 1))
"""
