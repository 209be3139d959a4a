"""Near copies of texts: SimHash links of operator 5, then an exact join of shingle sets.

A text is its set of five-word shingles; two texts are near copies if their Jaccard
similarity is SIMILARITY or more. Equal texts are one text. Each text has a SimHash
of WORDS times 64 bits. Its first 64 bits go through the trie self-join of operator 5,
whose links are candidates. A budget of three bits finds only close copies, so the
rest are found exactly: texts of similarity t share a shingle among the first
n - ceil(t n) + 1 of each, in any order that holds for all texts, and meet under it.
The order puts shingles last that the texts hold often, counted over all of them, so common
lines bring few texts together. A shingle has a hub,
the one of its texts whose shingles are the most common, and the texts of all shingles
of a hub are its family. Each text is a candidate with its hubs, which joins a base and
its variants by links that grow with the texts. Texts that are then in another group
than their hub are compared with their family, block by block within tasks, where only
links are returned; this is quadratic in the number of such texts of one family.

A candidate's sizes must allow the similarity, and its whole SimHashes must lie within
farthest() bits, six and a half deviations beyond what the similarity makes likely: a
pair is lost with a probability under 1e-9. Those left are decided on the sets.

A null text counts as empty; texts without words are near copies of each other. Of
each group the row of least doc_id is kept, null ids last; of rows that repeat in id
and text one is kept, the first by its other columns (as JSON). An empty table stays
empty. All columns are kept, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Words, mixed, portions
from .common import lasting, scratch, whole_text, written
from .fingerprints import prepared
from .simhash import Groups, components, links

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a text's SimHash.
WORDS = 4
#: A shingle is common if COMMON texts hold it, and that many of each PER_TEXTS; how many of the most common are ordered by it.
COMMON, PER_TEXTS, MOST_COMMON = 3, 10_000, 1 << 16
#: Leading bits of a shingle's hash that are its place when shingles are counted; how many rows the places of a task are cut into.
PLACE_BITS, STRETCHES = 23, 64
#: Shingles on crowded places that a task counts together.
MOST_HELD = 1 << 22
#: The low bits of a text's key that name it under a shingle; above them its rank as a hub.
NAME_BITS, RANKS = 56, 127
#: Texts of a family in a block, and rows that one task gets at a time.
BLOCK, PACK = 512, 20_000
#: Bits of the bitmap that tells which rows are worth a shuffle.
MOST_BITS = 1 << 25
_SEEDS = [np.uint64(mixed(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]) for k in range(WORDS)]
_LANES = np.uint64(0x0101010101010101)
_HASHES = [f"s{k}" for k in range(WORDS)]


def key_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def farthest(similarity: float) -> int:
    """Bits in which the SimHashes of two texts of this similarity may differ.

    Equal sizes make a bit differ with the share of the angle between the sets; small
    sets of unequal sizes with up to a quarter more (5 and 4 shingles: 0.1875 for 0.1515).
    """
    bits = 64 * WORDS
    share = 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(bits, math.ceil(bits * share + 6.5 * math.sqrt(bits * share * (1 - share))))


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, shingle) of each distinct shingle, in this order."""
    text, value = Words([prepared(t) for t in texts]).shingles(SHINGLE)
    value = value.view(np.int64)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[fresh], value[fresh]


def simhashes(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of WORDS words for each text; value holds the n[i] shingles of text i one after another.

    A bit is set if over half of the shingles' hashes have it. Bits are summed in the
    bytes of 64-bit lanes, at most 255 shingles at a time.
    """
    out = np.zeros((len(n), WORDS), np.uint64)
    if not len(value):
        return out
    chunks = -(-n // 255)
    owner = np.repeat(np.arange(len(n)), chunks)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts = (np.cumsum(n) - n)[owner] + 255 * rank
    for k, seed in enumerate(_SEEDS):
        hashes = mixed(value.view(np.uint64) ^ seed)
        for bit in range(8):
            lanes = np.add.reduceat(hashes >> np.uint64(bit) & _LANES, starts)
            sums = np.zeros((len(n), 8), np.int64)
            np.add.at(sums, owner, lanes.view(np.uint8).reshape(-1, 8))
            held = (2 * sums > n[:, None]).astype(np.uint64)
            out[:, k] |= (held << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def _lists(text: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.array(value))


def _places(value: np.ndarray) -> np.ndarray:
    return (value.view(np.uint64) >> np.uint64(64 - PLACE_BITS)).view(np.int64)


def _placed(batches):
    """How many shingles fall on each place, over all texts of a task: a row a stretch of places, with the number of texts.

    Counts are as narrow unsigned integers as hold them.
    """
    held, texts = np.zeros(1 << PLACE_BITS, np.uint32), 0
    for part in portions(batches, 0):
        np.add.at(held, _places(_sets(part.column(0).to_pylist())[1]), np.uint32(1))
        texts += part.num_rows
    if texts:
        held = held.reshape(STRETCHES, -1)
        counts = [x.astype(np.min_scalar_type(x.max())).tobytes() for x in held]
        columns = [pa.array(np.arange(STRETCHES)), pa.array(np.full(STRETCHES, texts)), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["stretch", "texts", "counts"])


def _crowded(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a stretch the places, as bits, that as many shingles fall on as a common one has texts."""
    size = (1 << PLACE_BITS) // STRETCHES
    total = np.zeros(size, np.int64)
    for counts in frame["counts"]:
        total += np.frombuffer(counts, f"<u{len(counts) // size}")
    texts = int(frame["texts"].sum())
    return pd.DataFrame({"stretch": frame["stretch"].iloc[:1], "texts": texts, "bits": [np.packbits(total >= _least(texts)).tobytes()]})


def _least(texts: int) -> int:
    """How many of so many texts hold a common shingle."""
    return max(COMMON, -(-COMMON * texts // PER_TEXTS))


def _held_there(bits: np.ndarray):
    """(value, count): the shingles on the places of bits, counted over the texts of a task, MOST_HELD at a time."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], ["value", "count"])

    def run(batches):
        held, size = [], 0
        for part in portions(batches, 0):
            value = _sets(part.column(0).to_pylist())[1]
            at = _places(value)
            held.append(value[bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1])
            size += len(held[-1])
            if size >= MOST_HELD:
                yield told(held)
                held, size = [], 0
        if size:
            yield told(held)

    return run


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that the most of all rows hold, in order, and how many rows hold each; at most MOST_COMMON.

    A place counts the shingles of all texts whose hashes begin alike, so none of them is in more texts
    than that. Only shingles on places that reach the bound are then counted one by one, again in all texts.
    The counts of a task are one table of places, and there are two tasks a core, however the rows are cut up.
    """
    texts = rows.select("text").coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    places = texts.mapInArrow(_placed, "stretch long, texts long, counts binary")
    places = places.groupBy("stretch").applyInPandas(_crowded, "stretch long, texts long, bits binary").toPandas().sort_values("stretch")
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.frombuffer(b"".join(places["bits"]), np.uint8)
    held = texts.mapInArrow(_held_there(bits), "value long, count long").groupBy("value").agg(F.sum("count").alias("count"))
    held = held.where(F.col("count") >= _least(int(places["texts"].iloc[0])))
    top = written(held.orderBy(F.desc("count"), "value").limit(MOST_COMMON), "common").toArrow()
    value, count = top.column("value").to_numpy(), top.column("count").to_numpy()
    order = np.argsort(value)
    return value[order], count[order]


def _describe(common: tuple[np.ndarray, np.ndarray], similarity: float):
    known, counts = common
    # the rank of a text whose shingles are all the most common one; 16 binary orders fill the ranks, or what there is beyond
    step = RANKS / max(16.0, float(np.log2(1 + counts.max(initial=0))))

    def run(batches):
        for part in portions(batches, 2):
            rows = part.num_rows
            text, value = _sets(part.column(2).to_pylist())
            n = np.bincount(text, minlength=rows)
            often = np.zeros(len(value), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                often = np.where(known[at] == value, counts[at], 0)
            order = np.lexsort((value, often, text))
            # text is in order already; rank counts from 0 within each text
            rank = np.arange(len(text)) - (np.cumsum(n) - n)[text]
            first = rank < (n - np.ceil(similarity * n - 1e-9) + 1)[text]
            under, name = value[order][first], text[first]
            empty = np.flatnonzero(n == 0)
            name = np.concatenate([name, empty])
            by = np.argsort(name, kind="stable")
            under = np.concatenate([under, np.zeros(len(empty), np.int64)])[by]
            weight = np.bincount(text, np.log2(1 + often), rows) / np.maximum(n, 1)
            hub = np.minimum(RANKS, weight * step).astype(np.int64)
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u8").reshape(-1, 2)[:, 0]
            num = (keys & np.uint64((1 << NAME_BITS) - 1)).astype(np.int64)
            hashes = simhashes(value, n).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(n.astype(np.int64)), pa.array(hub << NAME_BITS | num),
                 *(pa.array(hashes[:, k].copy()) for k in range(WORDS)), _lists(name[by], under, rows)],
                ["doc_id", "key", "n", "code", *_HASHES, "under"],
            )

    return run


def _shingle_sets(batches):
    for part in portions(batches, 1):
        yield pa.RecordBatch.from_arrays([part.column(0), _lists(*_sets(part.column(1).to_pylist()), part.num_rows)], ["key", "shingles"])


def _side(texts: DataFrame, by: str, name: str) -> DataFrame:
    """The columns that decide on a candidate, for the side called name, by its number or key."""
    columns = [F.col(by).alias(f"{by}_{name}"), F.col("key").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", *_HASHES))]
    return texts.select(*(columns if by != "key" else columns[1:]))


def _fitting(found: DataFrame, similarity: float) -> DataFrame:
    """(u, v), once each, of the pairs whose sizes and SimHashes let them be as similar as asked."""
    apart = sum((F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))) for c in _HASHES), F.lit(0))
    sizes = F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v") - 1e-9
    fit = found.where((F.col("u") != F.col("v")) & sizes & (apart <= farthest(similarity)))
    return fit.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _marked(ids: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bits): a bitmap of the hashes of ids, at most MOST_BITS bits in all, and their number."""
    bits = 1 << max(15, min(MOST_BITS.bit_length() - 1, (8 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    maps = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
    return maps.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), bits


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ids, and few others, so that little text is shuffled to find out."""
    maps, bits = _marked(ids)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # the bitmap's size is bounded by MOST_BITS
    held = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("bucket"))
    return held.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).select(rows.columns)


def _sets_of(keys: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """key and shingles of the texts with these keys."""
    asked = written(keys.distinct().join(texts.select("key", "id"), "key"), "asked")
    # each text is read from the row of its least id, so copies meet in no task
    ids = asked.where("id is not null")
    named = ids.join(_likely(rows.where("doc_id is not null"), ids), F.col("doc_id") == F.col("id"))
    own = rows.where("doc_id is null").withColumn("own", key_of(F.col("text")))
    unnamed = asked.where("id is null").join(own, F.col("key") == F.col("own")).select("key", "text")
    whole = named.where(F.col("key") == key_of(F.col("text"))).select("key", "text").unionByName(unnamed)
    return written(whole.mapInArrow(_shingle_sets, "key binary, shingles array<long>").dropDuplicates(["key"]), "sets")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of pairs that are as similar as asked."""
    both = pairs.join(sets.withColumnsRenamed({"key": "u", "shingles": "a"}), "u").join(sets.withColumnsRenamed({"key": "v", "shingles": "b"}), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= similarity * (F.size("a") + F.size("b") - common) - 1e-9).select("u", "v")


def dealt_families(members: DataFrame, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """The rows of members (hub, low, key, ...) under each cell of their family in which they meet others.

    Low texts are in another group than the hub; each must meet all texts of the family. They
    and the rest are cut into blocks; a cell holds two blocks of which one is low. A family of up
    to block texts is one cell. pack numbers what a task gets at a time.
    """
    sizes = members.groupBy("hub").agg(F.sum(F.col("low").cast("long")).alias("lows"), F.count("*").alias("size"))
    sizes = sizes.where("lows > 0 and size > 1")
    few = F.col("size") <= block
    sizes = sizes.select(
        "hub", F.when(few, 1).otherwise(F.ceil(F.col("lows") / block)).cast("int").alias("lb"),
        F.when(few, 0).otherwise(F.ceil((F.col("size") - F.col("lows")) / block)).cast("int").alias("hb"), "lows", "size",
    )
    sizes = written(sizes, "families")
    dealt = sizes.agg(F.sum(F.col("lows") * (F.col("lb") + F.col("hb")) + (F.col("size") - F.col("lows")) * F.col("lb"))).first()[0] or 0
    packs = max(1, math.ceil(dealt / pack))
    lb, hb = F.col("lb"), F.col("hb")
    number = F.pmod(F.xxhash64("key"), F.when(F.col("low"), lb).otherwise(F.greatest(hb, F.lit(1)))).cast("int")
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    own = F.transform(F.sequence(F.lit(0), lb + hb - 1), lambda j: cell(F.least(number, j), F.greatest(number, j)))
    rest = F.transform(F.sequence(F.lit(0), lb - 1), lambda j: cell(j, F.when(hb == 0, 0).otherwise(lb + number)))
    rows = members.join(sizes.drop("lows", "size"), "hub").select(
        *members.columns, F.when(F.col("low"), number).otherwise(F.when(hb == 0, 0).otherwise(lb + number)).alias("block"),
        F.explode(F.when(F.col("low"), own).otherwise(rest)).alias("cell"),
    )
    rows = rows.select(*members.columns, "block", "cell.*")
    return rows.withColumn("pack", F.pmod(F.xxhash64("hub", "x", "y"), F.lit(packs)))


def _cells(frame: pd.DataFrame, similarity: float):
    """For each cell of a pack: its rows, and for each pair that fits the two places among them."""
    frame = frame.sort_values(["hub", "x", "y"], ignore_index=True)
    cell = frame[["hub", "x", "y"]].to_numpy()
    cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
    hashes = frame[_HASHES].to_numpy().view(np.uint64)
    n, low, block = frame["n"].to_numpy(float), frame["low"].to_numpy(bool), frame["block"].to_numpy()
    group = pd.factorize(frame["root"])[0]
    far = farthest(similarity)
    for begin, stop in zip(cuts[:-1], cuts[1:], strict=True):
        x, y = cell[begin, 1:]
        own = np.arange(begin, stop)
        left, right = own[block[own] == x], own[block[own] == y]
        if x == y:
            i, j = np.triu_indices(len(own), 1)
            i, j = own[i], own[j]
        else:
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        fit = (group[i] != group[j]) & (low[i] | low[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[fit], j[fit]
        near = np.bitwise_count(hashes[i] ^ hashes[j]).sum(axis=1, dtype=np.int64) <= far
        yield frame, i[near], j[near]


def _meeting(similarity: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        places = [np.zeros(0, np.int64)]
        for ordered, i, j in _cells(frame, similarity):
            places += [i, j]
            frame = ordered
        return frame.iloc[np.unique(np.concatenate(places))]

    return run


def _decided(similarity: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for ordered, i, j in _cells(frame, similarity):
            if not len(i):
                continue
            own = np.unique(np.concatenate([i, j]))
            sets = [ordered["shingles"].iat[k] for k in own]
            first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            number = np.unique(np.concatenate(sets), return_inverse=True)[1]
            held, groups = np.zeros(len(number) + 1, np.int64), Groups(len(own))
            i, j = np.searchsorted(own, i), np.searchsorted(own, j)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for begin, stop in zip(*(np.flatnonzero(np.diff(i, prepend=-1)), np.flatnonzero(np.diff(i, append=-1)) + 1), strict=True):
                one = i[begin]
                others = j[begin:stop]
                others = others[groups.name[others] != groups.name[one]]
                if not len(others):
                    continue
                mine = number[first[one] : first[one + 1]]
                held[mine] = 1
                common = np.array([held[number[first[o] : first[o + 1]]].sum() for o in others])
                held[mine] = 0
                size = np.diff(first)
                for other in others[common >= similarity * (size[one] + size[others] - common) - 1e-9]:
                    if groups.name[one] != groups.name[other]:
                        groups.link(np.array([one]), np.array([other]))
                        u.append(ordered["key"].iat[own[one]])
                        v.append(ordered["key"].iat[own[other]])
        return pd.DataFrame({"u": u, "v": v})

    return run


def _trie_candidates(texts: DataFrame) -> DataFrame:
    """(u, v): each text, and a text of the fingerprint that operator 5 joins its own to."""
    prints = written(texts.groupBy(F.col("s0").alias("fp")).agg(F.min("key").alias("key")), "prints")
    roots = links(prints.select("fp")).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    heads = roots.join(prints.withColumnsRenamed({"fp": "root", "key": "v"}), "root").select("fp", "v")
    own = texts.select(F.col("s0").alias("fp"), F.col("key").alias("u"))
    return own.join(heads.unionByName(prints.select("fp", F.col("key").alias("v"))), "fp").where("u <> v").select("u", "v")


def groups(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """key, id (least doc_id) and root (the group's name) of every distinct text of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    kinds = ", ".join(f"{c} long" for c in _HASHES)
    described = rows.select("doc_id", key_of(F.col("text")).alias("key"), "text").mapInArrow(
        _describe(common_shingles(rows), similarity), f"doc_id long, key binary, n long, code long, {kinds}, under array<long>")
    texts = described.groupBy("key").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n", "code", *_HASHES, "under")])
    num = F.col("code").bitwiseAND((1 << NAME_BITS) - 1)
    texts = written(texts.withColumn("num", num), "texts")
    posts = texts.select("code", "num", F.explode("under").alias("under"))
    hubs = posts.groupBy("under").agg(F.max("code").alias("code"), F.count("*").alias("c")).where("c > 1")
    met = posts.select("under", "num").join(hubs.select("under", num.alias("hub")), "under").where("num <> hub")
    met = written(met.select("num", "hub").distinct(), "met")
    # numbers may clash; each is then all of its texts, and the similarity decides
    to_hub = met.withColumnsRenamed({"num": "num_u", "hub": "num_v"})
    to_hub = to_hub.join(_side(texts, "num", "u"), "num_u").join(_side(texts, "num", "v"), "num_v")
    of_trie = _trie_candidates(texts).join(_side(texts, "key", "u"), "u").join(_side(texts, "key", "v"), "v")
    near = written(_fitting(to_hub.drop("num_u", "num_v").unionByName(of_trie), similarity), "pairs")
    sets = _sets_of(near.select(F.explode(F.array("u", "v")).alias("key")), texts, rows)
    alike = written(_alike(near, sets, similarity), "alike")
    joined = components(alike).withColumnsRenamed({"item": "key"})
    # texts in another group than their hub meet their family
    found = texts.select("num", "key", "n", *_HASHES).join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
    found = written(found, "found")
    of_hub = found.groupBy(F.col("num").alias("hub")).agg(F.min("root").alias("hub_root"))
    members = met.join(found, "num").join(of_hub, "hub").withColumn("low", F.col("root") != F.col("hub_root"))
    dealt = dealt_families(written(members.select("hub", "low", "key", "n", "root", *_HASHES), "members"), block)
    meeting = written(dealt.groupBy("pack").applyInPandas(_meeting(similarity), dealt.schema), "meeting")
    if not meeting.isEmpty():
        sets = _sets_of(meeting.select("key"), texts, rows)
        decided = meeting.join(sets, "key").groupBy("pack").applyInPandas(_decided(similarity), "u binary, v binary")
        joined = components(written(alike.unionByName(decided), "alike")).withColumnsRenamed({"item": "key"})
    return texts.select("key", "id").join(joined, "key", "left").select("key", "id", F.coalesce("root", "key").alias("root"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with all columns, that stand for their groups."""
    spark = docs.sparkSession
    with scratch(spark):
        chosen = groups(docs.select("doc_id", "text"), similarity, block).groupBy("root")
        chosen = chosen.agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("kept"))
        chosen = lasting(chosen.select(_row_key(F.col("kept.id"), F.col("kept.key")).alias("own")), "kept")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        _row_key(F.col("doc_id").cast("long"), key_of(whole_text())).alias("own"),
        F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]), {"ignoreNullFields": "false"}).alias("order") if others else F.lit("").alias("order"),
    )
    first = Window.partitionBy("own").orderBy("order")
    rows = rows.join(chosen, "own", "left_semi").withColumn("number", F.row_number().over(first))
    return rows.where("number = 1").select("row.*")


def _row_key(doc_id: Column, key: Column) -> Column:
    """One value for a doc_id and a text's key."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(key))
