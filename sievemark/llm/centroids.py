"""Centroid clustering: Lloyd's rounds on integer vectors by kd-tree filtering.

Each partition lays its vectors into balanced kd-trees of bounded size, once.  A node holds the count of its vectors,
their integer sums and the box around them.  In a round every node starts with the centroids that its parent could not
exclude: of these the one nearest to the middle of the box is compared with the others, and those that it strictly
dominates (even the corner of the box most favourable to them is nearer to it) are pruned.  A node with one centroid
left is assigned whole, by its count and sums; the leaves that still have several are resolved vector by vector.  All
arithmetic is exact: in doubles while every term is an integer below 2**53, in Python integers beyond.

Only the centroids and their sums (``k`` rows) come to the driver; vectors never move.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import cut, release

#: Vectors of one tree and of one leaf at most.
TREE_VECTORS = 16384
LEAF_VECTORS = 32
#: Up to this magnitude squared distances of 64 components, and what filtering adds up, are exact in doubles.
_EXACT = 1 << 22
_LONG_MAX = (1 << 63) - 1


class Tree:
    """A balanced kd-tree over vectors that lie in its order; node ``j`` of level ``l`` holds ``bounds(l)[j : j + 2]``."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.depth = depth_of(len(x))
        edges = self.bounds(self.depth)[:-1]
        low, high, sums = (f.reduceat(x, edges, axis=0) for f in (np.minimum, np.maximum, np.add))
        self.levels = [(low, high, sums)]
        for _ in range(self.depth):
            low, high, sums = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]
            self.levels.insert(0, (low, high, sums))

    def bounds(self, level: int) -> np.ndarray:
        return bounds(len(self.x), level)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (of equally near ones the first), the counts and sums of all centroids,
        and how many vectors were assigned in whole nodes."""
        k = len(centroids)
        label = np.empty(len(self.x), np.int64)
        counts = np.zeros(k, np.int64)
        total = np.zeros((k, self.x.shape[1]), self.x.dtype)
        norm = (centroids * centroids).sum(axis=1)
        nodes, live, whole = np.zeros(1, np.int64), np.ones((1, k), bool), 0
        for level, (low, high, sums) in enumerate(self.levels):
            edges = self.bounds(level)
            live = live & ~dominated(low[nodes], high[nodes], centroids, norm, live)
            single = live.sum(axis=1) == 1
            for node, z in zip(nodes[single], live[single].argmax(axis=1)):
                label[edges[node] : edges[node + 1]] = z
                counts[z] += edges[node + 1] - edges[node]
                total[z] += sums[node]
            whole += int((edges[nodes[single] + 1] - edges[nodes[single]]).sum())
            nodes, live = nodes[~single], live[~single]
            if level < self.depth:
                nodes, live = np.stack((2 * nodes, 2 * nodes + 1), axis=1).ravel(), np.repeat(live, 2, axis=0)
        for node, mask in zip(nodes, live):
            a, b = edges[node], edges[node + 1]
            left = np.flatnonzero(mask)
            near = left[(norm[left] - 2 * (self.x[a:b] @ centroids[left].T)).argmin(axis=1)]
            label[a:b] = near
            for z in np.unique(near):
                mine = self.x[a:b][near == z]
                counts[z] += len(mine)
                total[z] += mine.sum(axis=0)
        return label, counts, total, whole


def dominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, norm: np.ndarray, live: np.ndarray) -> np.ndarray:
    """For each box the centroids that the live one nearest to its middle strictly dominates."""
    # Distances to twice the middle, without the part that all centroids share.
    middle = 4 * norm - 4 * ((low + high) @ centroids.T)
    top = middle.max(axis=1, keepdims=True) + 1 if len(middle) else middle
    best = np.where(live, middle, top).argmin(axis=1)
    out = np.zeros(live.shape, bool)
    for star in np.unique(best):
        at = best == star
        away = centroids - centroids[star]
        corner = high[at] @ np.where(away > 0, away, 0).T + low[at] @ np.where(away < 0, away, 0).T
        out[at] = norm - norm[star] - 2 * corner > 0
    return out


def depth_of(n: int) -> int:
    return max(0, (max(n, 1) - 1) // LEAF_VECTORS).bit_length()


def bounds(n: int, level: int) -> np.ndarray:
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def kd_order(x: np.ndarray) -> np.ndarray:
    """An order of the vectors in which every node of the tree is a range: halves by the widest component."""
    order = np.arange(len(x))
    for level in range(depth_of(len(x))):
        edges, middles = bounds(len(x), level), bounds(len(x), level + 1)[1::2]
        for a, m, b in zip(edges, middles, edges[1:]):
            part = x[order[a:b]]
            widest = (part.max(axis=0).astype(float) - part.min(axis=0)).argmax()
            order[a:b] = order[a:b][np.argpartition(part[:, widest], m - a)]
    return order


def _components(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


_TREE = "ids_ array<long>, width_ int, vectors_ binary"


def _trees(batches, dims: int):
    held, count = [], 0

    def tree(t: pa.Table):
        x = _components(t.column(1).combine_chunks(), dims)
        order = kd_order(x)
        x = x[order]
        kind = np.int16 if np.abs(x.astype(float)).max() < 1 << 15 else np.int64
        ids = t.column(0).combine_chunks().take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([kind().itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary())], names=["ids_", "width_", "vectors_"])

    for batch in batches:
        held.append(batch)
        count += len(batch)
        while count >= TREE_VECTORS:
            t = pa.Table.from_batches(held)
            yield tree(t.slice(0, TREE_VECTORS))
            rest = t.slice(TREE_VECTORS)
            held, count = rest.to_batches(), len(rest)
    if count:
        yield tree(pa.Table.from_batches(held))


def _held(batches, centroids: list[list[int]]):
    """``ids, Tree, centroids`` of each row, the numbers in a type that keeps them exact."""
    dims = len(centroids[0])
    largest = max(abs(v) for c in centroids for v in c)
    for batch in batches:
        for ids, width, raw in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x = np.frombuffer(raw, {2: np.int16, 8: np.int64}[width]).reshape(-1, dims)
            exact = largest <= _EXACT and (width == 2 or int(np.abs(x.astype(float)).max()) <= _EXACT)
            kind = np.float64 if exact else object
            yield ids.values, Tree(x.astype(kind)), np.array(centroids, kind)


def _round(batches, centroids: list[list[int]]):
    k, dims = len(centroids), len(centroids[0])
    counts, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
    for _, tree, c in _held(batches, centroids):
        _, n, s, _ = tree.assign(c)
        counts += n
        total += s.astype(np.int64).astype(object) if s.dtype != object else s
    used = np.flatnonzero(counts)
    sums = pa.array([[int(v) for v in total[z]] for z in used], pa.list_(pa.decimal128(38, 0)))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), sums], names=["cluster", "n", "sums"])


def _labels(batches, centroids: list[list[int]]):
    for ids, tree, c in _held(batches, centroids):
        label, *_ = tree.assign(c)
        away = tree.x - c[label]
        distance = (away * away).sum(axis=1)
        distance = distance.astype(np.int64) if distance.dtype != object else np.array([min(int(d), _LONG_MAX) for d in distance], np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(distance)], names=["id_", "cluster", "distance"])


def integer_vectors(df: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_, x_``: floor(scale * component) of the vectors with exactly ``dims`` components, none null or non-finite."""
    v = df[vector_col]
    sound = F.size(v) == dims
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    return df.where(v.isNotNull() & sound & F.forall(v, finite)).select(df[id_col].cast("long").alias("id_"), F.transform(v, whole).alias("x_"))


def _first(vectors: DataFrame, k: int, key: Column) -> list[list[int]]:
    rows = vectors.withColumn("key_", key).orderBy("key_", "x_").limit(k).select("x_").collect()
    return [list(r.x_) for r in rows]


def cluster(
    df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that is kept.

    Kept are vectors with exactly ``dims`` components, none null or non-finite.  Centroids start as the ``k`` vectors
    (all, if there are fewer) with the smallest SHA-256 of ``seed:id``; equal ids go by their components, a null id
    counts as the text ``null``.  Rows that repeat an id are clustered each on its own.  An empty table gives an empty
    result; other columns are ignored.  Components beyond the range of a long are the nearest long; a distance or an
    inertia beyond it is the largest long.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, dims, scale, id_col, vector_col)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id_").cast("string"), F.lit("null"))), 256)
    centroids = _first(vectors, k, key)
    none = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], none)
    trees = cut(vectors.mapInArrow(partial(_trees, dims=dims), _TREE))
    for _ in range(rounds):
        part = trees.mapInArrow(partial(_round, centroids=centroids), "cluster int, n long, sums array<decimal(38,0)>")
        # In two steps, so that no task meets the rows that all others have of a cluster.
        salted = part.groupBy("cluster", (F.spark_partition_id() % 64).alias("salt")).agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
        for row in salted.groupBy("cluster").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(dims)]).collect():
            centroids[row[0]] = [int(s) // row[1] for s in row[2:]]
    out = cut(trees.mapInArrow(partial(_labels, centroids=centroids), "id_ long, cluster int, distance long"))
    release(trees)
    held = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    every = min(sum(held.values()), _LONG_MAX)
    shown = [Row(c_=z, cluster_inertia=min(d, _LONG_MAX), inertia=every, centroid_sha256=hashlib.sha256(",".join(map(str, centroids[z])).encode()).hexdigest()) for z, d in held.items()]
    # At most k rows.
    table = F.broadcast(spark.createDataFrame(shown, "c_ int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return out.join(table, out["cluster"] == table["c_"]).select(F.col("id_").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
