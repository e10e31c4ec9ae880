"""Exact top-k by inner product with a KD-tree in every shard.

Vectors are dealt to shards of bounded size at random.  A shard's
tree splits at the median of the dimension of largest extent; every node has
its tight box and its smallest id.  A query goes through a tree best first by
the box bound sum(max(q_i lo_i, q_i hi_i)), and stops where neither the bound
nor, at an equal bound, the id can beat the kth result so far.  Queries visit
one shard first; the kth result found there is the start value in all others.

Vectors go to their shard once in each of the two passes and its tree is built
there; queries are sent after them and read in batches, so a task holds one
shard and one batch of queries.  What is moved is the vectors and, for each shard, the
queries.  Scores of components too large for exact double arithmetic are summed
as Python integers.

Defined cases: vectors that are null or hold null or non-finite components take
no part; only vectors of the query's length are candidates; rows without id take
no part; repeated ids are separate rows, as queries and as candidates, and a query's own
row alone is left out; equal scores go to the smaller id; fewer candidates than
k are all returned; a score that doesn't fit a long is given as the nearest long, and
counts as that.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.llm.common import materialise

K, SCALE, EVERY = 5, 256, 50
#: Components (of 8 bytes) in a shard; rows in a leaf.
SHARD_VALUES, LEAF = 1 << 22, 128
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Below every (score, -id).
_BELOW = (_LEAST - 1, 0)


class Tree:
    """KD-tree over rows of integers (as doubles, or as objects if those aren't exact); rows: their numbers."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.exact = vectors.dtype != object
        order = np.arange(len(ids))
        nodes: list[list] = []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            own = vectors[order[lo:hi]]
            low, high = own.min(axis=0), own.max(axis=0)
            at = len(nodes)
            nodes.append([low, high, int(ids[order[lo:hi]].min()), lo, hi, -1, -1])
            if parent >= 0:
                nodes[parent][5 + side] = at
            extent = high - low
            if hi - lo > leaf and len(extent) and extent.max() > 0:
                half = (hi - lo) // 2
                by = np.argpartition(own[:, int(np.argmax(extent))], half) if self.exact else np.argsort(own[:, int(np.argmax(extent))], kind="stable")
                order[lo:hi] = order[lo:hi][by]
                stack += [(lo, lo + half, at, 0), (lo + half, hi, at, 1)]
        self.low, self.high = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.least = [n[2] for n in nodes]
        self.places = [tuple(n[3:]) for n in nodes]
        self.vectors, self.ids, self.rows = vectors[order], ids[order], rows[order]

    def search(self, query: np.ndarray, own: int, k: int, kth: tuple[int, int]) -> list[tuple[int, int]]:
        """The at most k best (score, -id) above kth, unordered; the row numbered own is left out."""
        bounds = (np.maximum(query, 0) @ self.high.T) + (np.minimum(query, 0) @ self.low.T)
        if not self.exact:
            bounds = _in_long(bounds)
        best: list[tuple[int, int]] = []
        queue = [(-bounds[0], self.least[0], 0)]
        while queue:
            bound, least, node = heapq.heappop(queue)
            if (-bound, -least) <= kth:
                break
            lo, hi, left, right = self.places[node]
            if left >= 0:
                for child in (left, right):
                    if (bounds[child], -self.least[child]) > kth:
                        heapq.heappush(queue, (-bounds[child], self.least[child], child))
                continue
            ids = self.ids[lo:hi]
            scores = self.vectors[lo:hi] @ query
            if not self.exact:
                scores = _in_long(scores)
            at = np.flatnonzero((scores >= kth[0]) & (self.rows[lo:hi] != own))
            if len(at) > k:
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            for j in at.tolist():
                found = (int(scores[j]), -int(ids[j]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                kth = max(kth, best[0])
        return best


def _in_long(values: np.ndarray) -> np.ndarray:
    return np.array([min(max(x, _LEAST), _MOST) for x in values], dtype=object)


def _objects(m: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in m.reshape(-1)], dtype=object).reshape(m.shape)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(np.float64) * SCALE).reshape(batch.num_rows, dim)


class Shard:
    """The vectors of one shard and length; its tree is built when the first query comes."""

    def __init__(self, dim: int):
        self.dim, self.parts, self.tree, self.most = dim, [], None, 0.0

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append((_matrix(batch, self.dim), batch.column("id").to_numpy(), batch.column("row").to_numpy()))

    def answers(self, batch: pa.RecordBatch, k: int):
        """(row of the query, its id, id found, score) of a batch of queries."""
        if not self.parts and self.tree is None:
            return
        queries = _matrix(batch, self.dim)
        if self.tree is None:
            vectors, ids, rows = map(np.concatenate, zip(*self.parts, strict=True))
            self.parts, self.most = [], float(np.abs(vectors).max(initial=0.0))
            self.tree, self.vectors, self.numbers = Tree(vectors, ids, rows), vectors, (ids, rows)
        if self.tree.exact and self.most * float(np.abs(queries).max(initial=0.0)) * max(1, self.dim) >= 2.0**53:
            self.tree = Tree(_objects(self.vectors), *self.numbers)
        if not self.tree.exact:
            queries = _objects(queries)
        ids, rows, scores, known = (batch.column(c).to_pylist() for c in ("id", "row", "kth_score", "kth_id"))
        for i, query in enumerate(queries):
            for score, j in self.tree.search(query, rows[i], k, _BELOW if scores[i] is None else (scores[i], -known[i])):
                yield rows[i], ids[i], -j, score


def _search(k: int):
    """Batches sorted by (d, shard, vectors before queries)."""

    def run(batches):
        place, shard = None, None
        for batch in batches:
            d, number, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "shard", "asks"))
            cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(number) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if place != (d[lo], number[lo]):
                    place, shard = (d[lo], number[lo]), Shard(int(d[lo]))
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    shard.add(part)
                    continue
                out = list(shard.answers(part, k))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["row", "query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that asked holds for, the k largest integer inner products with all other rows.

    vectors: (id long, v array<double>).
    """
    values = F.col("v").cast("array<double>")
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(sound).select(F.col("id").cast("long").alias("id"), values.alias("v"), F.size("v").alias("d"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("u", F.rand(17)), "vectors")
    total = rows.agg(F.coalesce(F.sum(F.greatest("d", F.lit(1)).cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_VALUES))
    columns = ["d", "shard", "asks", "row", "id", "v", "kth_score", "kth_id"]
    nothing = F.lit(None).cast("long")
    put = rows.select("d", F.floor(F.col("u") * shards).cast("int").alias("shard"), F.lit(False).alias("asks"), "row", "id", "v", nothing.alias("kth_score"), nothing.alias("kth_id"))
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    queries = rows.where("asked").select("d", F.lit(True).alias("asks"), "row", "id", "v", home.alias("home"))

    def searched(asking: DataFrame) -> DataFrame:
        dealt = put.unionByName(asking.select(*columns)).repartition(shards, "d", "shard").sortWithinPartitions("d", "shard", "asks")
        return dealt.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")

    first = queries.withColumn("shard", F.col("home")).withColumns({"kth_score": nothing, "kth_id": nothing})
    one = materialise(_best(searched(first), k), "home-best")
    if shards == 1:
        return one.select("query_id", "rank", "vec_id", "score")
    kth = one.where(F.col("rank") == k).select("row", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    onward = queries.join(kth, "row", "left").withColumn("shard", F.explode(others))
    return _best(one.drop("rank").union(searched(onward)), k).select("query_id", "rank", "vec_id", "score")
