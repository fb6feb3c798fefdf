"""Nearest neighbours by inner product, through random-projection trees.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest length;
the largest inner product then is the least distance. A tree halves a sample of
the rows at a time: two random rows, moved to the middles of the rows nearest to
them, give the projection, and the median of the sample the threshold. All rows
are put into one leaf of each tree. A query searches the trees of the forest
through one shared priority queue: the node whose way down crosses thresholds
least is taken first, in whatever tree it is, until the budget of leaves is
spent. Queries and rows meet in their leaves, where all rows of a leaf are
compared with the query by exact inner products; the best of all its leaves are
the result.

The budget is not fixed: searched in the same way, the sample must find
``TARGET`` of its own exact neighbours. Evenly spread vectors of many dimensions
need a large share of the leaves for that, clustered ones few.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from prefscope.llm.shared import lookup, written

NEAREST, EVERY = 20, 20
TREES, LEAF_ROWS = 4, 1024
#: The forest is fitted on at most so many rows, and at most so many values.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000
#: Rows of the sample that a leaf has at least.
SAMPLE_PER_LEAF = 16
#: The share of its exact neighbours that the sample must find, and the queries
#: of the sample that are tried.
TARGET, TRIED = 0.95, 500
SEED = 11
#: Products that are held at a time in a leaf.
BLOCK = 4_000_000
#: Bytes of vectors in a batch on its way to the leaves, about.
BATCH_BYTES = 32_000_000


class Forest:
    """Trees of equal depth in heap order; a node's children are 2k+1, 2k+2."""

    def __init__(self, sample: np.ndarray, largest: float, depth: int, trees: int = TREES, seed: int = SEED):
        self.largest, self.depth, self.trees = largest, depth, trees
        rng, rows = np.random.default_rng(seed), self.lifted(sample)
        inner, size = 2 ** depth - 1, rows.shape[1]
        self.normals = np.zeros((trees, inner, size))
        self.bounds = np.zeros((trees, inner))
        for t in range(trees):
            parts = [np.arange(len(rows))]
            for k in range(inner):
                own = rows[parts[k]]
                normal = _projection(own, rng, size)
                along = own @ normal
                bound = float(np.median(along)) if len(own) else 0.0
                self.normals[t, k], self.bounds[t, k] = normal, bound
                parts += [parts[k][along <= bound], parts[k][along > bound]]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rest = self.largest ** 2 - np.einsum("ij,ij->i", rows, rows)
        return np.hstack([rows, np.sqrt(np.maximum(rest, 0))[:, None]])

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree, numbered over the forest."""
        out, lifted = np.zeros((len(rows), self.trees), np.int64), self.lifted(rows)
        for t in range(self.trees):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", lifted, self.normals[t, node])
                node = 2 * node + 1 + (along > self.bounds[t, node])
            out[:, t] = node - (2 ** self.depth - 1) + t * 2 ** self.depth
        return out

    def search(self, queries: np.ndarray, budget: int) -> np.ndarray:
        """The first ``budget`` leaves of each query, best first."""
        budget, inner = min(budget, self.trees * 2 ** self.depth), 2 ** self.depth - 1
        out = np.zeros((len(queries), budget), np.int64)
        for lo in range(0, len(queries), 256):
            part = queries[lo:lo + 256]  # a query's added coordinate is 0
            margins = np.einsum("ij,tkj->itk", part, self.normals[:, :, :-1], optimize=True) - self.bounds
            for i, margin in enumerate(margins.tolist()):
                queue, found = [(0.0, t, 0) for t in range(self.trees)], 0
                while found < budget:
                    crossed, t, k = heapq.heappop(queue)
                    if k >= inner:
                        out[lo + i, found] = k - inner + t * (inner + 1)
                        found += 1
                        continue
                    m = margin[t][k]
                    heapq.heappush(queue, (max(crossed, m), t, 2 * k + 1))
                    heapq.heappush(queue, (max(crossed, -m), t, 2 * k + 2))
        return out


def _projection(rows: np.ndarray, rng: np.random.Generator, size: int) -> np.ndarray:
    """The direction between the middles of two halves of some rows."""
    normal = rng.normal(size=size)
    if len(rows) > 1:
        a, b = rows[rng.choice(len(rows), 2, replace=False)]
        for _ in range(4):
            near = np.einsum("ij,ij->i", rows - a, rows - a) < np.einsum("ij,ij->i", rows - b, rows - b)
            if near.all() or not near.any():
                break
            a, b = rows[near].mean(0), rows[~near].mean(0)
        if (a != b).any():
            normal = b - a
    return normal / np.linalg.norm(normal)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first component on."""
    out = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        out += queries[:, j] * rows[:, j]
    return out


def fitted(sample: np.ndarray, n: int, largest: float, k: int, trees: int = TREES,
           leaf_rows: int = LEAF_ROWS) -> tuple[Forest, int]:
    """A forest whose leaves have about ``leaf_rows`` of n rows, and the leaves
    a query visits: as many as let the sample find its own neighbours."""
    sample = np.unique(sample, axis=0)
    depth = 0
    while n / 2 ** depth > leaf_rows and len(sample) / 2 ** (depth + 1) >= SAMPLE_PER_LEAF:
        depth += 1
    forest = Forest(sample, largest, depth, trees)
    k = min(k, len(sample) - 1)
    if depth == 0 or k < 1:
        return forest, trees * 2 ** depth
    tried = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)
    scores = sample[tried] @ sample.T
    scores[np.arange(len(tried)), tried] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order, place = forest.search(sample[tried], trees * 2 ** depth), np.empty((len(tried), trees * 2 ** depth), np.int64)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    own = forest.leaves(sample)[best].reshape(len(tried), -1)
    found = np.take_along_axis(place, own, axis=1).reshape(len(tried), k, trees).min(axis=2)
    return forest, int(np.quantile(found, TARGET, method="higher")) + 1


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0))


def _matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    # -0.0 and 0.0 are one value.
    return np.asarray(batch["v"].flatten(), np.float64).reshape(-1, dimension) + 0.0


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct vector, and the class of every row."""
    raw = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8)))[:, 0]
    _, first, of = np.unique(raw, return_index=True, return_inverse=True)
    return first, of.reshape(-1)


def _cut(batches: Iterator[pa.RecordBatch], copies: int, dimension: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of which so many copies fit into BATCH_BYTES."""
    step = max(1, BATCH_BYTES // (copies * dimension * 8))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def _indexed(forest: Forest, dimension: int, held: int, kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct vector of a batch once per tree, with the smallest
        ``held`` of its ids."""
        for batch in _cut(batches, forest.trees, dimension):
            v = _matrix(batch, dimension)
            ids = batch["vec_id"].to_numpy()
            first, of = _classes(v)
            offset, ids = _smallest(of, ids, len(first), held)
            leaves = forest.leaves(v[first])
            each = pa.array(np.repeat(np.arange(len(first)), forest.trees))
            lists = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves.reshape(-1)), _binary(v[first], kind).take(each), lists.take(each)],
                ["leaf", "vector", "ids"])
    return rows


def _smallest(of: np.ndarray, ids: np.ndarray, n: int, held: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each class the smallest ``held`` different ids, as offsets and values."""
    order = np.lexsort((ids, of))
    of, ids = of[order], ids[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
    of, ids = of[new], ids[new]
    start = np.searchsorted(of, np.arange(n))
    keep = np.arange(len(of)) - start[of] < held
    return np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=n))]), ids[keep]


def _binary(rows: np.ndarray, kind: str) -> pa.Array:
    rows = rows.astype(kind)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _keys(rows: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rows]


def _asked(forest: Forest, budget: int, dimension: int, kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct query vector of a batch in the leaves it visits, with
        the number of queries that have it."""
        for batch in _cut(batches, budget, dimension):
            v = _matrix(batch, dimension)
            first, of = _classes(v)
            leaves = forest.search(v[first], budget)
            each = pa.array(np.repeat(np.arange(len(first)), leaves.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves.reshape(-1)), _binary(v[first], kind).take(each),
                 pa.array(np.bincount(of)).take(each)], ["leaf", "vector", "n"])
    return rows


def _query_keys(dimension: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(_keys(_matrix(batch, dimension)), pa.binary())], ["query_id", "key"])
    return rows


FOUND = "key binary, n long, found array<struct<away: double, vec_id: long, same: boolean>>"
_FOUND = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("found", pa.list_(pa.struct(
    [("away", pa.float64()), ("vec_id", pa.int64()), ("same", pa.bool_())])))])


def _vectors(column: pa.ChunkedArray, dimension: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dimension).astype(np.float64)


def _in_leaf(dimension: int, k: int, kind: str):
    def rows(index: pa.Table, queries: pa.Table) -> pa.Table:
        """The k + 1 nearest of a leaf for each distinct query, by exact inner
        products, ties to smaller ids."""
        if not index.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        v, q = (_vectors(t["vector"], dimension, kind) for t in (index, queries))
        first, of = _classes(v)
        lists = index["ids"].combine_chunks()
        start, ids = _smallest(of[np.repeat(np.arange(len(v)), np.diff(np.asarray(lists.offsets)))],
                               np.asarray(lists.flatten()), len(first), k + 1)
        v = v[first]
        asked, of = _classes(q)
        n, q = np.bincount(of, weights=queries["n"].to_numpy()).astype(np.int64), q[asked]
        scale = np.linalg.norm(v, axis=1).max()
        out = []
        step = max(1, BLOCK // len(v))
        for lo in range(0, len(q), step):
            part = q[lo:lo + step]
            near = part @ v.T
            # What rounding could bring among the first is scored as well.
            last = np.partition(near, max(len(v) - k - 1, 0), axis=1)[:, max(len(v) - k - 1, 0)]
            slack = 1e-12 * dimension * scale * np.linalg.norm(part, axis=1)
            at, row = np.nonzero(near >= (last - slack)[:, None])
            score = products(part[at], v[row])
            same = (part[at] == v[row]).all(1)
            many = np.diff(start)[row]
            pick = np.repeat(start[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            at, score, same, got = np.repeat(at, many), np.repeat(score, many), np.repeat(same, many), ids[pick]
            order = np.lexsort((got, -score, at))
            at, score, same, got = at[order], score[order], same[order], got[order]
            begin = np.searchsorted(at, np.arange(len(part)))
            keep = np.arange(len(at)) - begin[at] <= k
            found = pa.StructArray.from_arrays(
                [pa.array(-score[keep]), pa.array(got[keep]), pa.array(same[keep])], ["away", "vec_id", "same"])
            offset = np.concatenate([[0], np.cumsum(np.bincount(at[keep], minlength=len(part)))])
            out.append(pa.table([pa.array(_keys(part), pa.binary()), pa.array(n[lo:lo + step]),
                                 pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), found)], schema=_FOUND))
        return pa.concat_tables(out)
    return rows


def _best(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per query vector, the k + 1 nearest of all its leaves; a
        vector's rows follow one another."""
        rest = _FOUND.empty_table()
        for batch in batches:
            if batch.num_rows:
                done = _merged(pa.concat_tables([rest, pa.Table.from_batches([batch]).cast(_FOUND)]), k)
                yield from done.slice(0, done.num_rows - 1).to_batches()
                rest = done.slice(done.num_rows - 1)
        yield from rest.to_batches()
    return rows


def _merged(found: pa.Table, k: int) -> pa.Table:
    found = found.combine_chunks()
    keys = found["key"].to_pylist()
    new = np.array([True, *(a != b for a, b in zip(keys, keys[1:]))])
    of, first = np.cumsum(new) - 1, np.flatnonzero(new)
    lists = found["found"].combine_chunks()
    of = np.repeat(of, lists.value_lengths().to_numpy())
    away, got, same = (np.asarray(x) for x in lists.flatten().flatten())
    order = np.lexsort((same, got, away, of))
    of, away, got, same = of[order], away[order], got[order], same[order]
    other = np.ones(len(of), bool)
    other[1:] = (of[1:] != of[:-1]) | (got[1:] != got[:-1]) | (away[1:] != away[:-1]) | (same[1:] != same[:-1])
    of, away, got, same = of[other], away[other], got[other], same[other]
    keep = np.arange(len(of)) - np.searchsorted(of, np.arange(len(first)))[of] <= k
    offset = np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(first)))])
    hits = pa.StructArray.from_arrays([pa.array(x[keep]) for x in (away, got, same)], ["away", "vec_id", "same"])
    return pa.table([found["key"].take(pa.array(first)), pa.array(np.maximum.reduceat(found["n"].to_numpy(), first)),
                     pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), hits)], schema=_FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, id_column: str = "vec_id",
            column: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows
    of ``vectors`` with the largest inner product that the forest finds, in
    doubles summed from the first component on; ties go to the smaller vec_id.
    A query's own row (its id and vector) is no candidate.

    Vectors that are null, zero, without an id or with null or non-finite
    components take no part, nor do those whose length isn't the commonest
    (the larger of two). Equal vectors are searched once, and a leaf keeps the
    smallest k + 1 of their ids, which no result can need more of. Rows that
    repeat another in full (0.0 and -0.0 alike) count once; rows of one id with different vectors
    are candidates and queries of their own. Fewer candidates give fewer rows;
    an empty table gives none; other columns are not read.

    The forest and the number of leaves that a query visits come from a sample
    of at most 20,000 rows and 4,000,000 values, picked by a hash of the id;
    every row is in a leaf of every tree. A task holds one leaf: 1,024 rows, or
    a share of the table of about 16 in 20,000 if that is more.
    """
    rows = usable(vectors, id_column, column)
    sizes = rows.groupBy(F.size("v").alias("dimension")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square"))
    common = sizes.orderBy(F.desc("n"), F.desc("dimension")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return vectors.sparkSession.createDataFrame([], schema)
    dimension, n, square = common[0]
    rows = rows.where(F.size("v") == dimension)
    asked = usable(queries, id_column, column).where(F.size("v") == dimension)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(
        max(2, min(SAMPLE_ROWS, SAMPLE_VALUES // dimension))).select("v").toArrow()
    sample = np.asarray(sample["v"].combine_chunks().flatten(), np.float64).reshape(-1, dimension)
    # Floats travel as they are; all arithmetic is in doubles.
    single = all(t.schema[column].dataType.elementType == FloatType() for t in (vectors, queries))
    kind = "<f4" if single else "<f8"
    forest, budget = fitted(sample, n, float(np.sqrt(square)), k, trees, leaf_rows)
    index = rows.mapInArrow(_indexed(forest, dimension, k + 1, kind), "leaf long, vector binary, ids array<long>")
    visits = asked.mapInArrow(_asked(forest, budget, dimension, kind), "leaf long, vector binary, n long")
    found = index.groupBy("leaf").cogroup(visits.groupBy("leaf")).applyInArrow(_in_leaf(dimension, k, kind), FOUND)
    # A query's leaves all know how many queries have its vector; of these lists
    # one entry at most is the query itself.
    best = written(found.repartition("key").sortWithinPartitions("key").mapInArrow(_best(k), FOUND), "nearest")
    ids = asked.select("vec_id", "v").mapInArrow(_query_keys(dimension), "query_id long, key binary").distinct()
    each = lookup(ids, best, ["key"], "n", ["query_id"], "inner")
    others = F.expr(f"slice(filter(found, x -> not (x.same and x.vec_id = query_id)), 1, {int(k)})")
    return each.select("query_id", F.posexplode(others).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.away")).alias("score"))
