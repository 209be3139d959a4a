"""Operator 9: exact top-k by inner product, pruning a block at a time.

Vectors are cut into blocks of consecutive vec_id: a block holds its ids, the
integer vectors (its forward index) and, for each dimension ("term"), the largest
and least value. For a query, the sum over dimensions of what a block can give at
most bounds every score in it. Blocks are visited in the order of these bounds and
scored through their forward index until no bound reaches the query's k-th score.

Blocks that follow each other form a shelf. A query is first searched for in its own
shelf; its k-th score there is the floor from which the other shelves start, so a block
whose bound lies below it is never scored. There, a task takes one shelf and one sheaf of
queries, both of bounded size, and returns what reaches the floor, k rows a query at
most; these are then merged.

Sums are exact: in floating point while they stay under 2**52, else in 64-bit integers,
else in Python's. A component or a score of more than 64 bits stops the search by name.

Vectors that are null, or hold null or non-finite components, take no part; only
vectors of equal dimension are compared. Repeated rows are candidates each, those
with the query's own vec_id are not; a repeated query answers once. Rows with a null
vec_id take no part. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

K, SCALE, EVERY = 10, 1024, 100
#: Rows of a block, blocks of a shelf, queries of a sheaf.
BLOCK, SHELF, SHEAF = 512, 32, 16384
_BLOCKS = "block long, dim int, n int, ids binary, vectors binary, most binary, least binary, queries binary"


def whole_vectors(vectors: DataFrame, *kept, scale: int = SCALE) -> DataFrame:
    """vec_id, v and the columns kept; v: floor(scale * x) of each component, of rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite)
    too_large = F.raise_error(F.lit("a component of more than 64 bits")).cast("long")
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale)).otherwise(too_large))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), *kept)


def _blocks(batches):
    base, number, last, seen = TaskContext.get().partitionId() << 32, 0, None, set()
    for batch in batches:
        ids, lists, asked = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
        sizes = np.diff(offsets)
        rows = []
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            for k in range(0, len(own), BLOCK):
                part = own[k : k + BLOCK]
                v = values[offsets[part][:, None] + np.arange(dim)].astype("<i8")
                queries = []
                for i in np.flatnonzero(asked[part]):
                    # a repeated query answers once; rows come in the order of their ids
                    if ids[part[i]] != last:
                        last, seen = ids[part[i]], set()
                    if v[i].tobytes() not in seen:
                        seen.add(v[i].tobytes())
                        queries.append(i)
                rows.append((base + number, int(dim), len(part), ids[part].astype("<i8").tobytes(), v.tobytes(),
                             v.max(axis=0).tobytes() if dim else b"", v.min(axis=0).tobytes() if dim else b"", np.array(queries, "<i8").tobytes()))
                number += 1
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _BLOCKS.split(", ")])


def blocks(rows: DataFrame) -> DataFrame:
    """The block index of (vec_id, v, asked), over ranges of vec_id; queries holds the places of the queries of a block."""
    ordered = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    return ordered.mapInArrow(_blocks, _BLOCKS)


def _exact(peak: float, dim: int) -> type:
    """The kind of number in which every sum of dim products of two numbers up to peak is exact."""
    most = dim * peak * peak
    return np.float64 if most < 2.0**52 else np.int64 if most < 2.0**62 else object


def search_blocks(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, shelf: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of each query over blocks of (ids, vectors, most, least), from its floor on."""
    n, none = len(queries), np.iinfo(np.int64).min
    peak = max(float(np.abs(x.astype(float)).max(initial=0)) for x in (queries, *(b[i] for b in shelf for i in (2, 3))))
    kind = _exact(peak, queries.shape[1])
    q = queries.astype(kind)
    most, least = (np.array([b[i] for b in shelf]).astype(kind) for i in (2, 3))
    bounds = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    scores, found = np.full((n, k), none), np.full((n, k), np.iinfo(np.int64).max)
    active = np.arange(n)
    for turn in range(len(shelf)):
        bound = bounds[active, order[active, turn]]
        active = active[bound >= np.maximum(scores[active, k - 1], floors[active])]  # an equal score may have a smaller id
        if not len(active):
            break
        visited = order[active, turn]
        for block in np.unique(visited):
            rows = active[visited == block]
            ids, vectors = shelf[block][0], shelf[block][1]
            new = q[rows] @ vectors.astype(kind).T
            if kind is object and any(abs(x) >= 2**63 for x in new.flat):
                raise OverflowError("a score of more than 64 bits")
            new = np.rint(new).astype(np.int64) if kind is np.float64 else new.astype(np.int64)
            new = np.where((ids[None, :] == query_ids[rows][:, None]) | (new < floors[rows][:, None]), none, new)
            both = np.concatenate([scores[rows], new], axis=1)
            names = np.concatenate([found[rows], np.broadcast_to(ids, new.shape)], axis=1)
            best = np.lexsort((names, ~both), axis=1)[:, :k]
            scores[rows], found[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
    row, column = np.nonzero(scores > none)
    return row, found[row, column], scores[row, column]


def _searcher(k: int):
    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(left) or not len(right):
            return out
        dim = int(key[0])
        whole = lambda data, *shape: np.frombuffer(data, "<i8").reshape(*shape)
        shelf = [(whole(r.ids, -1), whole(r.vectors, r.n, dim), whole(r.most, dim), whole(r.least, dim)) for r in left.itertuples()]
        vectors = np.concatenate([whole(x, 1, dim) for x in right["v"]])
        row, vec_id, score = search_blocks(vectors, right["query_id"].to_numpy(), right["floor"].to_numpy(), shelf, k)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[row], "query": right["query"].to_numpy()[row], "vec_id": vec_id, "score": score})

    return search


def _asked(batches):
    """One row a query of each block: where it stands, its id and its vector."""
    for batch in batches:
        rows = []
        for shelf, block, dim, n, ids, vectors, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, vectors = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(n, dim)
            rows += [(block << 10 | int(i), shelf, dim, int(ids[i]), vectors[i].tobytes()) for i in np.frombuffer(places, "<i8")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["query", "shelf", "dim", "query_id", "v"])


def search(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest score of each row that is_query holds for."""
    rows = whole_vectors(vectors, F.coalesce(is_query, F.lit(False)).alias("asked"), scale=scale)
    index = written(blocks(rows), "blocks")
    # blocks are numbered on over the written partitions, one row each, so the window and the broadcast are as small as their list
    part = F.shiftright("block", 32)
    parts = index.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("block").bitwiseAND((1 << 32) - 1)
    shelf = F.floor(number / SHELF).cast("long")
    index = index.join(F.broadcast(parts), part == F.col("part")).withColumn("shelf", shelf).drop("part", "before")
    shelves = -(-index.count() // SHELF) or 1
    asked = index.where("queries <> X''").select("shelf", "block", "dim", "n", "ids", "vectors", "queries")
    asked = written(asked.mapInArrow(_asked, "query long, shelf long, dim int, query_id long, v binary"), "queries")
    low = F.lit(-(1 << 63)).cast("long")
    schema, keys = "query_id long, query long, vec_id long, score long", ["dim", "shelf", "sheaf"]
    sheaves = -(-asked.count() // SHEAF) or 1
    sheaf = F.pmod(F.xxhash64("query"), F.lit(sheaves)).cast("int")
    left = index.select("dim", "shelf", "n", "ids", "vectors", "most", "least").withColumn("sheaf", F.lit(0))
    own = asked.select("dim", "shelf", F.lit(0).alias("sheaf"), "query", "query_id", "v", low.alias("floor"))
    best = left.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(_searcher(k), schema)
    best = written(best, "own")
    floors = best.groupBy("query").agg(F.count("*").alias("c"), F.min("score").alias("floor")).where(F.col("c") >= k)
    floors = asked.join(floors, "query", "left").select("dim", "query", "query_id", "v", F.coalesce("floor", low).alias("floor"), sheaf.alias("sheaf"), F.col("shelf").alias("home"))
    # each query goes to every other shelf
    others = floors.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shelves - 1).cast("long"))).alias("shelf")).where("shelf <> home").drop("home")
    left = left.withColumn("sheaf", F.explode(F.sequence(F.lit(0), F.lit(sheaves - 1))))
    rest = left.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(_searcher(k), schema)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    both = best.unionByName(rest).withColumn("rank", F.row_number().over(ranked))
    return both.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows of every query, the rows whose vec_id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % EVERY == 0)


OP9_SQL = f"""
WITH v AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % {EVERY} = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
