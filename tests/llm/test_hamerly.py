"""Clusters against whole scans in every round."""

import hashlib
import math

import numpy as np

from corpusloom.llm.hamerly import LARGEST, assign, clusters, distances, near_halves, op13_hamerly_clusters


def plain(rows, k=16, rounds=3):
    """(number, distance) of each row (id, whole numbers), and the centroids."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in rows]
        for i in range(len(c)):
            own = [v for (_, v), j in zip(rows, of, strict=True) if j == i]
            if own:
                c[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [near(v)[::-1] for _, v in rows], c


def whole(v):
    return [math.floor(64 * float(np.float32(x))) for x in v]


def test_as_whole_scans(spark):
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(400, 64)).astype(np.float32)
    vec[100:200] = vec[:100] + rng.normal(size=(100, 64)).astype(np.float32) * 0.05
    vec[200:260] = vec[5]  # one group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(vec)] + [(7, vec[9].tolist()), (None, vec[11].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as id", "2 as vec", "3 as cluster")
    got = clusters(df).collect()
    want, c = plain([(i, whole(v)) for i, v in rows])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=lambda x: (str(x[0]), x[1:])) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=lambda x: (str(x[0]), x[1:]))
    total = sum(d for _, d in want)
    for r in got:
        assert list(r.centroid) == c[r.cluster] and r.inertia == total and r.cluster_inertia == sum(d for j, d in want if j == r.cluster)


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(5)
    centre = rng.integers(-60, 60, (16, 64))
    x = centre[rng.integers(0, 16, 3000)] + rng.integers(-9, 10, (3000, 64))
    c = centre + rng.integers(-3, 4, centre.shape)
    of, upper, lower, scanned = assign(x, c, near_halves(c), np.zeros(16), np.zeros(3000, np.int64), np.full(3000, np.inf), np.full(3000, -np.inf))
    assert scanned > 2500  # the others have their first centroid so near that none can be nearer
    moved = c + rng.integers(-1, 2, c.shape)
    drift = np.sqrt(((moved - c) ** 2).sum(1))
    of, upper, lower, scanned = assign(x, moved, near_halves(moved), drift, of, upper, lower)
    far = distances(x, moved)
    assert scanned < 300 and (of == far.argmin(1)).all()
    second = np.sort(far, 1)[:, 1]
    assert (upper * (1 + 1e-6) >= np.sqrt(far.min(1))).all() and (lower <= np.sqrt(second) * (1 + 1e-6)).all()


def test_ties_go_to_the_smaller_number():
    x = np.array([[0, 0], [5, 5]])
    c = np.array([[1, 0], [0, 1], [-1, 0], [5, 5], [5, 5]])
    of, *_ = assign(x, c, near_halves(c), np.zeros(5), np.zeros(2, np.int64), np.full(2, np.inf), np.full(2, -np.inf))
    assert of.tolist() == [0, 3]
    # a vector that is as near to a smaller number's centroid moves there, whatever its bounds
    of, *_ = assign(x[:1], c, near_halves(c), np.zeros(5), np.array([2]), np.array([1.0]), np.array([1.0]))
    assert of.tolist() == [0]


def test_large_numbers_are_exact():
    x = np.array([[LARGEST - 1] * 64, [-LARGEST] * 64])
    c = np.array([[-LARGEST] * 64, [LARGEST - 2] * 64])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    assert distances(x, c).tolist() == want


def test_cases(spark, tmp_path):
    ok = [0.5] * 64
    rows = [(1, None), (2, []), (3, [0.1] * 63), (4, [None] + [0.1] * 63), (5, [float("nan")] + [0.1] * 63), (6, [float("inf")] + [0.1] * 63), (7, [1e300] + [0.1] * 63), (8, ok), (8, ok), (9, [-0.001] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.distance, r.inertia) for r in clusters(df).collect())
    assert [g[0] for g in got] == [8, 8, 9] and all(g[1:] == (0, 0) for g in got)
    assert clusters(df.filter("vec_id < 8")).count() == 0 and clusters(df.limit(0)).count() == 0
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.vec_id, r.centroid_sha256) for r in op13_hamerly_clusters(spark, str(tmp_path)).collect()}
    digest = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    assert found == {(8, digest([32] * 64)), (9, digest([-1] * 64))}
