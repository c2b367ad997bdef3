"""Centroid clustering by kd-tree filtering.

Each task builds kd-trees over blocks of its own vectors once; nodes hold their count, integer sums and bounding box. A round sends the
centroids down every tree: a centroid that is farther than another one from all of a node's box is pruned, a node that has one
centroid left goes to it as a whole, by its stored sums, and leaves with more are resolved by exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import stored, table
from snapledger.llm.vectors import EXACT, SUMS, blocks, integers, matrix, sums_batch, totals

SCALE, DIM, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, "3"
#: Vectors of a tree and of a leaf at most.
TREE, LEAF = 4096, 16


@dataclass
class KdTree:
    """points in tree order; node k holds points first[k] to last[k], with children left[k] and left[k] + 1, or none (-1)."""

    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @staticmethod
    def build(points: np.ndarray, leaf: int = LEAF) -> tuple[KdTree, np.ndarray]:
        """The tree over points, split at the median of the widest coordinate, and the order of the points in it."""
        order = np.arange(len(points))
        first, last, left, low, high = [0], [len(points)], [-1], [], []
        k = 0
        while k < len(first):
            a, b = first[k], last[k]
            held = points[order[a:b]]
            low.append(held.min(0))
            high.append(held.max(0))
            if b - a > leaf and (low[k] != high[k]).any():
                d = int((high[k].astype(np.int64) - low[k]).argmax())
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(held[:, d], middle, kind="introselect")]
                left[k] = len(first)
                first += [a, a + middle]
                last += [a + middle, b]
                left += [-1, -1]
            k += 1
        first, last, left = (np.array(x, np.int64) for x in (first, last, left))
        ordered = points[order].astype(np.int64)
        running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(ordered, 0)])
        return KdTree(ordered, first, last, left, np.array(low, np.int64), np.array(high, np.int64), running[last] - running[first]), order

    def pack(self) -> dict[str, bytes]:
        """Columns of a stored row; integers are at most 2**30 in size but for the sums."""
        small = np.int16 if max(-int(self.points.min()), int(self.points.max())) < 1 << 15 else np.int32
        narrow = {k: getattr(self, k).astype(small).tobytes() for k in ("points", "low", "high")}
        return narrow | {k: getattr(self, k).astype(np.int32).tobytes() for k in ("first", "last", "left")} | {"sums": self.sums.tobytes()}

    @staticmethod
    def unpack(row: dict[str, bytes], dim: int, count: int) -> KdTree:
        small = np.int16 if len(row["points"]) == 2 * dim * count else np.int32
        wide = {k: np.frombuffer(row[k], small).astype(np.int64).reshape(-1, dim) for k in ("points", "low", "high")}
        flat = {k: np.frombuffer(row[k], np.int32).astype(np.int64) for k in ("first", "last", "left")}
        return KdTree(**wide, **flat, sums=np.frombuffer(row["sums"], np.int64).reshape(-1, dim))


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (points x centroids); by doubles where their products and sums are exact."""
    if len(points) and max(abs(int(x)) for a in (points, centroids) for x in (a.min(), a.max())) <= EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


class Filter:
    """Centroids (m x dim integers) with what the test of a node against them needs."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        c = centroids.astype(np.float64)
        self.size = (c * c).sum(1)
        apart = c[None] - c[:, None]  # [s, k]: centroid k seen from s
        self.up, self.down = np.maximum(apart, 0), np.minimum(apart, 0)

    def survivors(self, low: np.ndarray, high: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Which of the centroids open_ (nodes x m) may be nearest to some point of each box.

        k is pruned if it is farther than s, the one nearest to the middle, from the corner of the box that favours k most. Equal
        distances prune nothing, and where doubles are not exact the test leaves their error room.
        """
        low, high = low.astype(np.float64), high.astype(np.float64)
        middle = (low + high) / 2
        to_middle = np.where(open_, self.size - 2 * (middle @ self.centroids.T.astype(np.float64)), np.inf)
        nearest = to_middle.argmin(1)
        largest = max(np.abs(low).max(), np.abs(high).max(), np.abs(self.centroids).max())
        slack = 0.0 if largest <= EXACT else low.shape[1] ** 2 * largest * largest * 2.0**-46
        left = open_.copy()
        for s in np.unique(nearest):
            at = nearest == s
            reach = high[at] @ self.up[s].T + low[at] @ self.down[s].T
            left[at] &= ~(self.size - self.size[s] - 2 * reach > slack)
        return left

    def assign(self, tree: KdTree) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """("nodes", nodes, cluster of each) and ("points", places, cluster of each), which cover every point once."""
        nodes = np.zeros(1, np.int64)
        open_ = np.ones((1, len(self.centroids)), bool)
        while len(nodes):
            open_ = self.survivors(tree.low[nodes], tree.high[nodes], open_)
            single = open_.sum(1) == 1
            if single.any():
                yield "nodes", nodes[single], open_[single].argmax(1)
            leaf = ~single & (tree.left[nodes] < 0)
            if leaf.any():
                count = tree.last[nodes[leaf]] - tree.first[nodes[leaf]]
                places = np.repeat(tree.first[nodes[leaf]] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                distance = squared_distances(tree.points[places], self.centroids)
                allowed = np.repeat(open_[leaf], count, axis=0)
                yield "points", places, np.where(allowed, distance, np.iinfo(np.int64).max).argmin(1)
            down = ~single & ~leaf
            nodes = (tree.left[nodes[down], None] + np.arange(2)).reshape(-1)
            open_ = np.repeat(open_[down], 2, axis=0)

    def sums(self, tree: KdTree) -> np.ndarray:
        """Per cluster the sums of its points' components, and their number."""
        out = np.zeros((len(self.centroids), tree.points.shape[1] + 1), np.int64)
        for kind, which, cluster in self.assign(tree):
            values, count = (tree.sums[which], tree.last[which] - tree.first[which]) if kind == "nodes" else (tree.points[which], np.ones(len(which), np.int64))
            for c in np.unique(cluster):
                mine = cluster == c
                out[c, :-1] += values[mine].sum(0)
                out[c, -1] += count[mine].sum()
        return out

    def clusters(self, tree: KdTree) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each point, in tree order."""
        out = np.empty(len(tree.points), np.int64)
        for kind, which, cluster in self.assign(tree):
            if kind == "points":
                out[which] = cluster
            else:
                for k, c in zip(which, cluster, strict=True):
                    out[tree.first[k] : tree.last[k]] = c
        distance = np.empty(len(out), np.int64)
        for c in np.unique(out):
            mine = out == c
            distance[mine] = squared_distances(tree.points[mine], self.centroids[c : c + 1])[:, 0]
        return out, distance


_TREE_COLUMNS = ("points", "low", "high", "first", "last", "left", "sums")


def _build_trees(dim: int, leaf: int, size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            tree, order = KdTree.build(matrix(rows.column(1), dim, np.int32), leaf)
            packed = tree.pack()
            ids = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), rows.column(0).take(pa.array(order)))
            return pa.RecordBatch.from_arrays([ids, *(pa.array([packed[c]], pa.binary()) for c in _TREE_COLUMNS)], ["ids", *_TREE_COLUMNS])

        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, size - sum(x.num_rows for x in held))
                held.append(b.slice(0, take))
                b = b.slice(take)
                if sum(x.num_rows for x in held) == size:
                    yield out()
                    held = []
        if held:
            yield out()

    return build


def kd_forest(ints: DataFrame, dim: int, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """One stored row per tree over the rows (id, v) of ints: the ids in tree order and the packed tree."""
    kind = ints.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{c} binary" for c in _TREE_COLUMNS)
    return stored(ints.mapInArrow(_build_trees(dim, leaf, tree), f"ids array<{kind}>, {columns}"), "kd-trees")


def _trees(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[KdTree, pa.Array]]:
    """The trees of a batch, one at a time."""
    for k in range(batch.num_rows):
        ids = batch.column(0)[k].values
        row = {c: batch.column(j)[k].as_py() for j, c in enumerate(_TREE_COLUMNS, 1)}
        yield KdTree.unpack(row, dim, len(ids)), ids


def refine(forest: DataFrame, seeds: list[list[int]], rounds: int) -> np.ndarray:
    """The centroids after `rounds` rounds over all trees; means are rounded down, a centroid without vectors stays."""
    centroids, dim = np.array(seeds, np.int64), len(seeds[0])

    def round_sums(centroids: np.ndarray):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filter_, total = Filter(centroids), np.zeros((len(centroids), dim + 1), np.int64)
            for b in batches:
                for tree, _ in _trees(b, dim):
                    total += filter_.sums(tree)
            yield sums_batch(total.reshape(-1))

        return sums

    for _ in range(rounds):
        found = totals(forest.mapInArrow(round_sums(centroids), SUMS), len(centroids) * (dim + 1))
        centroids = centroids.copy()
        for c in range(len(centroids)):
            *total, n = found[c * (dim + 1) : (c + 1) * (dim + 1)]
            if n:
                centroids[c] = [s // n for s in total]
    return centroids


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS,
    scale: int = SCALE, seed: str = SEED, tree: int = TREE, leaf: int = LEAF,
) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row with a whole vector of `dim` components.

    Components become floor(scale * x). The centroids start as the rows with the smallest sha256 of `seed:id`; each of `rounds` rounds
    assigns every row to the nearest one (of equally near the first) and rounds the means down; a centroid without rows stays.

    Left out: vectors that are null, of another length, hold null or a value that is not finite, or whose integers have a squared
    length over 2**60, as their distances are no longs. Rows that repeat count as often as they occur, also as starts, where equal
    hashes are taken in order of their vectors; null ids have no hash and come last there. Fewer rows than clusters give
    fewer centroids, none an empty result. Further columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale).alias("v")).where(F.size("v") == dim)
    kind = rows.schema["id"].dataType.simpleString()
    hashed = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    seeds = [r["v"] for r in hashed.orderBy(F.asc_nulls_last("_h"), "v").limit(clusters).select("v").collect()]
    schema = f"id {kind}, cluster int, distance bigint"
    if not seeds:
        empty = vectors.sparkSession.createDataFrame([], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return empty.withColumnRenamed("id", id_col)
    forest = kd_forest(rows, dim, tree, leaf)
    centroids = refine(forest, seeds, rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Filter(centroids)
        for b in batches:
            for held, ids in _trees(b, dim):
                cluster, distance = filter_.clusters(held)
                yield from blocks(pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"]), TREE)

    found = stored(forest.mapInArrow(assign, schema), "kd-clusters")
    # a row per centroid
    by_cluster = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    return found.select(
        F.col("id").alias(id_col), "cluster", "distance", of([by_cluster.get(c, 0) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(by_cluster.values())).cast("bigint").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )


def op12_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds as a chain of common table expressions, with plain distances to all centroids."""
    near = (
        "a{r} AS MATERIALIZED (SELECT vec_id, min({{'d': d, 'k': k}}) AS best FROM (SELECT vec_id, k,"
        " list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY vec_id)"
    )
    mean = (
        "m{r} AS (SELECT best.k AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN kept USING (vec_id), range(1, 65) t(i) GROUP BY ALL),"
        " c{n} AS MATERIALIZED (SELECT k, coalesce(f.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k,"
        " list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{r} GROUP BY k) f USING (k))"
    )
    rounds = ", ".join(f"{near.format(r=r)}, {mean.format(r=r, n=r + 1)}" for r in range(ROUNDS))
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM kept QUALIFY k < 8),
        {rounds}, {near.format(r=ROUNDS)}
        SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia,
               sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN c{ROUNDS} ON best.k = k"""


SQL = {"op12_kd_clusters": _sql()}
