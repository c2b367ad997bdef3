"""Vector codes and kd-tree clusters against plain Python in whole integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapledger.llm.kd_clusters import Filter, KdTree, clustered
from snapledger.llm.vector_codes import VaFile, compressed

COLUMNS = "vec_id long, embedding array<float>, label int, code string, cluster string, id string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", "c", "c", "c") for i, v, x in rows], COLUMNS)


def vectors(n, dim, seed=0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.2) for _ in range(dim)] for _ in range(5)]
    return [[float(np.float32(x + rnd.gauss(0, 0.05))) for x in rnd.choice(centres)] for _ in range(n)]


def awkward(dim):
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(vectors(300, dim))]
    rows += [(400 + i, rows[5][1], 1) for i in range(120)]  # one very common vector
    rows += [rows[0], rows[0], (2, rows[9][1], 2), (None, rows[11][1], 0), (None, rows[12][1], None)]
    rows += [(600, None, 1), (601, [0.5] * (dim - 1) + [None], 1), (602, [0.5] * (dim - 1) + [math.nan], 1), (603, [math.inf] + [0.0] * (dim - 1), 1)]
    rows += [(604, [1e30] + [0.0] * (dim - 1), 1), (605, [0.5] * (dim - 1), 1), (606, [], 1), (607, [0.0] * dim, None), (608, [7000.0] + [0.0] * (dim - 1), 3)]
    random.Random(3).shuffle(rows)
    return rows


def kept(rows, scale, dim):
    good = lambda v: v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ints = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if good(v)]
    return [r for r in ints if sum(x * x for x in r[1]) <= 1 << 60]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def means(groups, entries):
    return [[sum(c) // len(g) for c in zip(*g, strict=True)] if (g := groups[e]) else entries[e] for e in range(len(entries))]


def brute_codes(rows, parts, size, rounds, scale=4096, dim=16):
    rows = kept(rows, scale, dim)
    width = dim // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:size]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    near = lambda q, book: min((squared(q, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for _, v, _ in rows:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = means(groups, books[p])
    out = []
    for i, v, label in rows:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, bytes(e for _, e in found).hex(), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, sum(x[2] for x in out if x[3] == label), digest) for i, c, e, label in out]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("options", [{}, {"sent_labels": 1, "salt_rows": 50}])
def test_codes_equal_brute_force(spark, options):
    rows = awkward(16)
    got = compressed(table(spark, rows).repartition(5), parts=4, entries=6, rounds=3, **options)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(got.collect()) == ordered(brute_codes(rows, 4, 6, 3))


def test_codes_of_few_and_no_vectors(spark):
    rows = [(3, [0.25] * 16, None), (1, [0.5] * 16, 2)]
    assert ordered(compressed(table(spark, rows)).collect()) == ordered(brute_codes(rows, 8, 16, 6))
    nothing = compressed(table(spark, [(1, None, 1), (2, [0.5] * 3, 1), (3, [], 1)]))
    assert nothing.collect() == [] and nothing.dtypes == compressed(table(spark, rows)).dtypes
    assert compressed(table(spark, [])).collect() == []


def test_va_file_keeps_the_nearest_entry_and_drops_most(spark):
    rng = np.random.default_rng(1)
    entries, queries = rng.integers(-900, 900, (16, 8)), rng.integers(-900, 900, (500, 8))
    entries[5] = entries[11]
    book = VaFile(entries)
    true = ((queries[:, None] - entries) ** 2).sum(2)
    lower, upper = book.bounds(queries)
    assert (lower <= true).all() and (true <= upper).all()
    assert (lower <= upper.min(1, keepdims=True)).mean() < 0.6
    code, error = book.nearest(queries)
    assert (code == true.argmin(1)).all() and (error == true.min(1)).all()
    huge = VaFile(np.array([[1 << 29, 5], [1 << 29, 6], [-(1 << 29), 0]]))
    assert huge.nearest(np.array([[1 << 29, 6], [0, 0]]))[0].tolist() == [1, 2]


def brute_clusters(rows, clusters, rounds, scale=1024, dim=64):
    rows = kept(rows, scale, dim)
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    first = sorted(rows, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:clusters]
    centroids = [r[1] for r in first]
    points = np.array([r[1] for r in rows], object)
    for step in range(rounds + 1):
        distance = np.stack([((points - np.array(c, object)) ** 2).sum(1) for c in centroids], 1)
        near = [min((d, k) for k, d in enumerate(r)) for r in distance.tolist()]
        if step < rounds:
            groups = [[] for _ in centroids]
            for r, (_, k) in zip(rows, near, strict=True):
                groups[k].append(r[1])
            centroids = means(groups, centroids)
    inertia = [sum(d for d, k in near if k == c) for c in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(r[0], k, d, inertia[k], sum(inertia), shas[k]) for r, (d, k) in zip(rows, near, strict=True)]


def test_clusters_equal_brute_force(spark):
    rows = awkward(64)
    got = clustered(table(spark, rows).repartition(3), tree=70, leaf=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(got.collect()) == ordered(brute_clusters(rows, 8, 10))


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(3, [0.25] * 64, None), (1, [0.5] * 64, 2), (9, [0.5] * 64, 2)]
    assert ordered(clustered(table(spark, rows)).collect()) == ordered(brute_clusters(rows, 8, 10))
    nothing = clustered(table(spark, [(1, None, 1), (2, [0.5] * 3, 1)]))
    assert nothing.collect() == [] and nothing.dtypes == clustered(table(spark, rows)).dtypes
    assert clustered(table(spark, [])).collect() == []


def test_filtering_prunes_and_assigns_whole_nodes():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-500, 500, (8, 6))
    points = (centroids[rng.integers(0, 8, 2000)] + rng.integers(-30, 30, (2000, 6))).astype(np.int32)
    tree, order = KdTree.build(points)
    assert (tree.points == points[order]).all() and (tree.sums[0] == points.sum(0)).all()
    again = KdTree.unpack(tree.pack(), 6, len(points))
    assert all((getattr(again, k) == getattr(tree, k)).all() for k in vars(tree))
    f = Filter(centroids)
    whole = sum(int((again.last[which] - again.first[which]).sum()) for kind, which, _ in f.assign(again) if kind == "nodes")
    assert whole > 1500
    cluster, distance = f.clusters(again)
    true = ((points[order][:, None].astype(np.int64) - centroids) ** 2).sum(2)
    assert (cluster == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert f.sums(again)[:, -1].sum() == 2000


def test_ties_of_centroids_go_to_the_first():
    centroids = np.array([[10, 0], [-10, 0], [-10, 0], [0, 10], [0, -10]])
    points = np.array([[0, 0], [0, 0], [-9, 0], [1, 1], [-1, 1], [-1, -1]], np.int32)
    tree, order = KdTree.build(points, leaf=1)
    cluster, _ = Filter(centroids).clusters(tree)
    true = ((points[order][:, None].astype(np.int64) - centroids) ** 2).sum(2)
    assert (cluster == true.argmin(1)).all()


def test_queries_read_whole_tables(spark):
    from snapledger.llm.kd_clusters import op12_kd_clusters
    from snapledger.llm.vector_codes import op11_vector_codes

    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where(F.col("embedding").isNotNull()).count()
    assert op11_vector_codes(spark, "/root/testdata/sf0.001").count() == n == op12_kd_clusters(spark, "/root/testdata/sf0.001").count()
