"""The metric index and hierarchical density clustering against plain versions."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import hierarchy, manifold, metric, vectors
from corpusloom.plans import operators as plans


@pytest.fixture
def small(monkeypatch):
    """Many cells, many blocks, and no group that one task works on whole."""
    monkeypatch.setattr(metric, "CELL", 16)
    monkeypatch.setattr(metric, "BLOCK", 20)
    monkeypatch.setattr(hierarchy, "WHOLE", 40)
    monkeypatch.setattr(hierarchy, "LISTED", 4)


def table(spark, x, groups=None):
    return spark.createDataFrame([(k, v.tolist(), int(groups[k]) if groups is not None else 0) for k, v in enumerate(x)], "id bigint, v array<double>, g int")


def blobs(rng, sizes, dims=4, spread=0.1):
    x = np.concatenate([rng.normal(rng.normal(size=dims) * 2, spread * (k + 1), (n, dims)) for k, n in enumerate(sizes)])
    return np.concatenate([x, rng.uniform(-4, 4, (sum(sizes) // 6, dims))])


def plain(x, least, samples, selection):
    """The same from the top down: at each distance at which something changes, components of points that reach each other."""
    n = len(x)
    if n < max(2, least):
        return [-1] * n
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min(samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))

    def parts(points, under):
        left, out = set(points), []
        while left:
            todo = [left.pop()]
            own = set(todo)
            while todo:
                k = todo.pop()
                near = {j for j in left if reach[k, j] < under}
                left -= near
                own |= near
                todo += near
            out.append(sorted(own))
        return out

    life = lambda w: 1 / max(w, 1e-12)
    clusters = []  # points, stability, clusters below, is the topmost

    def descend(points, birth, top):
        me = len(clusters)
        clusters.append([points, 0.0, [], top])
        now = points
        while True:
            inner = reach[np.ix_(now, now)].copy()
            np.fill_diagonal(inner, -1)
            w = max((inner[i, j] for i in range(len(now)) for j in range(i) if inner[i, j] >= 0), default=0)
            levels = sorted({v for v in inner[np.triu_indices(len(now), 1)]}, reverse=True)
            for w in levels:
                below = parts(now, w)
                if len(below) > 1 or len(now) == 1:
                    break
            big = [p for p in below if len(p) >= least]
            gone = len(now) - sum(map(len, big))
            clusters[me][1] += gone * (life(w) - birth)
            if len(big) == 1:
                now = big[0]
                continue
            clusters[me][1] += sum(len(p) * (life(w) - birth) for p in big)
            for p in big:
                clusters[me][2].append(descend(p, life(w), False))
            return me

    for points in parts(range(n), np.inf):
        if len(points) >= least:
            descend(points, 0.0, True)
    take = [False] * len(clusters)
    total = [0.0] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        points, own, below, top = clusters[c]
        inner = sum(total[b] for b in below)
        total[c] = max(own, inner)
        take[c] = not top and (not below if selection == "leaf" else not inner > own)
    out = [-1] * n
    for c in range(len(clusters) - 1, -1, -1):  # the topmost ones last
        if take[c]:
            for p in clusters[c][0]:
                out[p] = min(clusters[c][0])
    return out


def found(df, n):
    rows = df.collect()
    assert len(rows) == n
    return [-1 if g is None else g for _, g in sorted((r.id, r.grp) for r in rows)]


@pytest.mark.parametrize("selection", ["eom", "leaf"])
def test_labels_as_from_the_top_down(selection):
    rng = np.random.default_rng(8)
    several = 0
    for k in range(25):
        x = blobs(rng, rng.integers(6, 16, 4), dims=2)
        if k % 3 == 0:
            x = np.round(x * 2) / 2  # many equal points and ties
        least, samples = int(rng.integers(2, 6)), int(rng.integers(1, 6))
        got = hierarchy.labels(x, least, samples, selection)
        names = {c: int(np.flatnonzero(got == c).min()) for c in set(got.tolist()) - {-1}}
        want = plain(x, least, samples, selection)
        assert [names.get(c, -1) for c in got.tolist()] == want
        several += len(set(want)) > 2
    assert several > 15


@pytest.mark.parametrize("selection", ["eom", "leaf"])
def test_rounds_as_whole(spark, small, selection):
    """A group that is too large for one task, beside small ones, one of equal points and one that is too small."""
    rng = np.random.default_rng(9)
    x = np.concatenate([blobs(rng, [30, 25, 20]), blobs(rng, [12, 12]), np.zeros((6, 4)), np.ones((2, 4))])
    x[10:14] = x[9]
    group = np.repeat([0, 1, 2, 3], [87, 28, 6, 2])
    want, at = [], 0
    for n in (87, 28, 6, 2):
        part = x[at : at + n]
        want += [p + at if p >= 0 else -1 for p in plain(part, 5, 5 if n >= 50 else 1, selection)]
        at += n
    got = found(hierarchy.clusters(table(spark, x, group), "id", "v", F.lit(5), selection, within=F.col("g")), len(x))
    assert got == want and len({g for g in got[:87]} - {-1}) >= 2 and got[-2:] == [-1, -1]


@pytest.mark.parametrize("selection", ["eom", "leaf"])
def test_contraction_takes_few_rounds(spark, small, monkeypatch, selection):
    """Also where nearly no node is left to the driver; as many rounds as points of a cluster are too many."""
    monkeypatch.setattr(hierarchy, "FEW", 4)
    rng = np.random.default_rng(13)
    x = blobs(rng, [50, 40, 30])
    x[10:14] = x[9]
    frame = table(spark, x)
    rounds, settled = [], hierarchy.settled
    monkeypatch.setattr(hierarchy, "settled", lambda df, name: (rounds.append(name), settled(df, name))[1])
    got = found(hierarchy.clusters(frame, "id", "v", F.lit(12), selection), len(x))
    assert got == plain(x, 12, 12, selection) and len(set(got)) > 2
    assert 1 <= rounds.count("moved") <= 8


def test_neighbours_and_products_as_all_pairs(spark, small):
    rng = np.random.default_rng(10)
    x = np.concatenate([blobs(rng, [60, 60]), np.full((40, 4), 0.3), rng.normal(size=(3, 4)) * 50])
    n = len(x)
    frame = table(spark, x).select(F.col("id").alias("row"), F.lit("g").alias("grp"), "v")
    index = metric.index(frame)
    assert index.centres
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for r in metric.neighbours(index, 5).collect():
        assert np.allclose([e.d for e in r.best], np.sort(d[r.row])[:5]) and len({e.other for e in r.best}) == 5 and r.row not in {e.other for e in r.best}
    product = x @ x.T
    np.fill_diagonal(product, -np.inf)
    assert np.allclose([p for _, p in sorted((r.row, r.product) for r in metric.largest_products(index).collect())], product.max(1))
    assert sorted(metric.neighbours(metric.index(frame.limit(0)), 3).collect()) == [] and n == 183


def test_neighbours_of_equal_points_by_row_also_when_few_are_held(spark, small, monkeypatch):
    monkeypatch.setattr(metric, "HELD", 50)
    rng = np.random.default_rng(15)
    x = np.round(np.concatenate([blobs(rng, [40, 40], dims=3), np.zeros((70, 3))]) * 2) / 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    index = metric.index(table(spark, x).select(F.col("id").alias("row"), F.lit("g").alias("grp"), "v"))
    got = {r.row: [(round(e.d, 9), e.other) for e in r.best] for r in metric.neighbours(index, 6).collect()}
    assert index.centres and got == {k: sorted((round(d[k, j], 9), j) for j in range(len(x)) if j != k)[:6] for k in range(len(x))}


def test_deep_trees_take_no_row_for_each_cluster_above_a_node(spark, small, monkeypatch):
    """Pairs of points with growing gaps: each pair but the first joins one cluster that grows, so clusters lie as deep as there are pairs."""
    at = np.cumsum(np.repeat(1 + np.arange(60) / 10, 2) * np.tile([1, 0.05], 60))
    x = np.column_stack([at, np.zeros(120)])
    frame = table(spark, x)
    rows, made = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (rows.append(len(data)), made(self, data, *a, **k))[1])
    monkeypatch.setattr(hierarchy, "FEW", 40)
    assert found(hierarchy.clusters(frame, "id", "v", F.lit(2), "leaf", F.lit(1)), 120) == plain(x, 2, 1, "leaf")
    assert rows and max(rows) <= 240


def test_picked_edges_are_followed_in_few_steps(spark, small, monkeypatch):
    """Also long ways; rings, that edges of equal distance may close, are no places to end at."""
    monkeypatch.setattr(hierarchy, "FEW", 1)
    steps, settled = [], hierarchy.settled
    monkeypatch.setattr(hierarchy, "settled", lambda df, name: (steps.append(name), settled(df, name))[1])

    def roots(pick, n):
        edges = spark.createDataFrame(list(pick.items()), "comp bigint, other bigint")
        return {r.node: r.root for r in hierarchy._joined(spark.range(n).withColumnRenamed("id", "comp"), edges, n).collect()}

    way = roots({k: k + 1 for k in range(40)} | {40: 39, 42: 41}, 43)
    assert len({way[k] for k in range(41)}) == 1 and way[41] == way[42] != way[0] and len(steps) <= 8
    ring = roots({0: 1, 1: 2, 2: 3, 3: 0, 4: 0, 6: 5}, 7)
    assert len({ring[k] for k in range(5)}) == 1 and ring[5] == ring[6] != ring[0]


def test_few_neighbours_are_measured_exactly(spark, small, monkeypatch):
    """Where nothing is clustered, bounds from the own cell are weak; what they let through isn't all measured exactly."""
    monkeypatch.setattr(metric, "PARTS", 4)
    x = np.random.default_rng(16).normal(size=(1500, 16))
    index = metric.index(table(spark, x).select(F.col("id").alias("row"), F.lit("g").alias("grp"), "v"))
    met, meet = [], metric.meet
    monkeypatch.setattr(metric, "meet", lambda own, asking, run, schema: (met.append((own, asking, run)), meet(own, asking, run, schema))[1])
    metric.neighbours(index, 5)
    own, asking, run = met[1]
    asks = asking.filter("region = 0").toArrow()
    measured, apart = [], metric.apart
    monkeypatch.setattr(metric, "apart", lambda x, y: (measured.append(len(x)), apart(x, y))[1])
    run(own.filter("region = 0").toArrow(), asks)
    assert asks.num_rows and sum(measured) <= 5 * asks.num_rows


def test_a_point_visits_few_cells_where_points_cluster(spark, small):
    """Twice the clusters take about twice the rows that are dealt out, not four times."""
    rng = np.random.default_rng(11)

    def dealt(k):
        x = np.concatenate([rng.normal(rng.normal(size=8) * 9, 0.05, (40, 8)) for _ in range(k)])
        index = metric.index(table(spark, x).select(F.col("id").alias("row"), F.lit("g").alias("grp"), "v"))
        before = metric.meet
        counts = []
        try:
            metric.meet = lambda own, asking, run, schema: (counts.append(asking.count()), before(own, asking, run, schema))[1]
            metric.largest_products(index).count()
        finally:
            metric.meet = before
        return counts[1] / len(x)

    few, many = dealt(10), dealt(40)
    assert many < 1.8 * few + 1, (few, many)


def test_cases(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [1.0, 0.0])], "id bigint, v array<double>")
    assert found(hierarchy.clusters(rows, "id", "v", F.lit(2)), 3) == [-1, -1, -1]
    assert hierarchy.clusters(rows.limit(0), "id", "v", F.lit(2)).count() == 0
    same = spark.createDataFrame([(k % 3, [0.0, 0.0]) for k in range(6)] + [(10 + k % 2, [9.0, 0.0]) for k in range(4)], "id bigint, v array<double>")
    got = sorted((r.id, r.grp, r.size) for r in hierarchy.clusters(same, "id", "v", F.lit(3)).collect())
    assert got == [(k, 0, 6) for k in (0, 0, 1, 1, 2, 2)] + [(k, 10, 4) for k in (10, 10, 11, 11)]


def test_nearest_of_one_and_of_equal_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert {r.vec_id: r.nn_distance for r in vectors.nn_distance(rows).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}
    assert [r.nn_distance for r in vectors.nn_distance(rows.limit(1)).collect()] == [1.0]


@pytest.mark.parametrize("n", [30, 120])
def test_two_levels(spark, n):
    """Level one on the projected vectors, level two inside each of its clusters."""
    rng = np.random.default_rng(12)
    x = np.concatenate([blobs(rng, [n // 6] * 2, spread=0.02) + 5 * k for k in range(3)])[:n]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None)], "id bigint, v array<double>")
    told = {r.id: (r.l1, r.l2) for r in vectors.two_level(frame, "id", "v").collect()}
    places = {r.key: r.vector for r in manifold.project(frame, "id", "v", vectors.reduce).collect()}
    z = np.array([places[k] for k in range(n)])
    few = n + 1 < 50
    least = 2 if few else max(5, (n + 1) // 150)
    first = hierarchy.labels(z, least, 1 if few else least, "eom" if few else "leaf")
    name = lambda own, of: {c: own[of == c].min() for c in set(of.tolist()) - {-1}}
    want = dict.fromkeys([*range(n), 900], (None, None))
    ids = np.arange(n)
    for c, top in name(ids, first).items():
        own = ids[first == c]
        need = max(2, len(own) // 10)
        second = hierarchy.labels(z[own], need, 1 if len(own) < 50 else need, "eom") if len(own) >= 2 * need else np.full(len(own), -1)
        names = name(own, second)
        for k, s in zip(own, second, strict=True):
            want[int(k)] = (top, names.get(s) if len(names) > 1 else None)
    assert told == want and len({a for a, _ in told.values()} - {None}) >= 2


def test_queries_on_all_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    for selection in ("eom", "leaf"):
        got = {r.vec_id: r.grp for r in plans.QUERIES[f"hierarchical_{selection}"][0](spark, sf).collect()}
        label = hierarchy.labels(x, 4, 2, selection)
        names = {c: rows[int(np.flatnonzero(label == c)[0])].vec_id for c in set(label.tolist()) - {-1}}
        assert got == {r.vec_id: names.get(c, -1) for r, c in zip(rows, label.tolist(), strict=True)} and len(names) > 1


def curve(rng, n):
    t = rng.uniform(0, 12, n)
    x = np.concatenate([[np.cos(t * (k + 1) / 3), np.sin(t * (k + 1) / 3)] for k in range(8)]).T
    return x + rng.normal(0, 0.05, x.shape)


def test_projection_keeps_neighbours(spark, monkeypatch):
    """On a bent curve better than principal directions; the same again; with points of many blocks."""
    monkeypatch.setattr(metric, "CELL", 64)
    x = curve(np.random.default_rng(13), 300)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, v array<double>")
    at = lambda: np.array([r.vector for r in manifold.project(frame, "id", "v", vectors.reduce, dims=2).orderBy("key").collect()])
    flat = np.array([r.vector for r in vectors.reduce(frame, "id", "v", 2).orderBy("key").collect()])
    first = at()
    good = manifold.trustworthiness(unit, first)
    assert good >= 0.9 > manifold.trustworthiness(unit, flat)
    monkeypatch.setattr(manifold, "BLOCK", 100)
    monkeypatch.setattr(manifold, "EDGES", 8)
    again = at()
    assert np.array_equal(again, at()) and manifold.trustworthiness(unit, again) >= 0.9


def test_projection_of_few_and_of_odd_rows(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(curve(np.random.default_rng(14), 49))]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    assert {r.key: list(r.vector) for r in manifold.project(frame, "id", "v", vectors.reduce).collect()} == dict(rows)
    more = spark.createDataFrame([*rows, (90, None), (91, [0.0] * 16), *[(100 + k, rows[0][1]) for k in range(20)]], "id bigint, v array<double>")
    got = {r.key: r.vector for r in manifold.project(more, "id", "v", vectors.reduce, rounds=2).collect()}
    assert got[90] is None and got[91] is None and all(v is not None and np.isfinite(v).all() for k, v in got.items() if k not in (90, 91))
    assert manifold.project(frame.limit(0), "id", "v", vectors.reduce).count() == 0


def test_weights():
    w = manifold.weights(np.array([[0.0, 0.0, 0.3, 0.5], [0.2, 0.4, np.inf, np.inf], [0.1, 0.2, 0.3, 0.9]]))
    assert w[1, 0] == 1 and (w[1, 2:] == 0).all() and np.allclose(w[2].sum(), 2) and w[2, 0] == 1 and (np.diff(w[2]) < 0).all()


def test_projection_divides_a_vector_by_its_length_once(spark):
    """Each component's length of its own took a minute for these; here the rows are few, so all that is done is that."""
    rows = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: F.rand(3) + x).alias("v")).coalesce(1)
    began = time.monotonic()
    assert manifold.project(rows, "id", "v", vectors.reduce, few=100).count() == 60
    assert time.monotonic() - began < 20


def test_projection_sends_a_place_once_to_a_block():
    places = pa.RecordBatch.from_pydict({"row": [7, 8, 9], "blocks": pa.array([[0, 2], [2], []], pa.list_(pa.int32())), "at": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]})
    assert [b.to_pylist() for b in manifold._sent([places])] == [[{"block": 0, "rows": [7], "at": [1.0, 2.0]}, {"block": 2, "rows": [7, 8], "at": [1.0, 2.0, 3.0, 4.0]}]]


def test_precision_of_the_search():
    """Single where bounds are wide; double where points lie close to each other far from 0, are equal, or have no bound yet."""
    x = np.random.default_rng(17).normal(size=(300, 8))
    kind, off = metric._precision(x, x, np.full(300, 4.0))
    left, right = metric.sides(x, x, kind)
    square = (x**2).sum(1)
    assert kind is np.float32 and (np.abs(left @ right.T + square[:, None] - metric.far(x, x) ** 2) < off * (square[:, None] + square[None, :])).all()
    for y, most in ((x * 1e-3 + 100, 1e-6), (x, 0.0), (x, np.inf), (x * 1e20, 1e40), (x * 1e-12, 1e-24)):
        assert metric._precision(y, y, np.full(300, most))[0] is np.float64


def test_distances_of_large_ranks(spark, monkeypatch):
    """Exactly those of all pairs, by counts: of ranks that are a share of the points, of equal points and of groups of different lengths."""
    monkeypatch.setattr(metric, "CELL", 64)
    monkeypatch.setattr(metric, "BLOCK", 128)
    monkeypatch.setattr(metric, "FEW_LEFT", 8)
    rng = np.random.default_rng(18)
    groups = {"a": np.concatenate([rng.normal(size=(500, 5)), rng.normal(size=(200, 5)) * 1e-3 + 50, np.ones((90, 5))]), "b": rng.normal(size=(40, 3)), "c": np.zeros((150, 2))}
    rows, want, row = [], {}, 0
    for g, x in groups.items():
        d = np.sort(metric.apart(x[:, None, :], x[None, :, :]) + np.diag(np.full(len(x), -1.0)), 1)[:, 1:]  # itself goes first
        for own, v in zip(d, x, strict=True):
            k = int(rng.integers(1, len(x) + 5))
            rows.append((row, g, v.tolist(), k))
            want[row] = own[min(k, len(x) - 1) - 1]
            row += 1
    frame = spark.createDataFrame(rows, "row bigint, grp string, v array<double>, k int")
    got = {r.row: r.d for r in metric.ranked(metric.index(frame), frame.select("row", "k")).collect()}
    assert got == want


def test_core_distances_keep_no_long_lists(spark, monkeypatch):
    """Core distances to a rank beyond LONG come without lists of that length."""
    x = np.random.default_rng(19).normal(size=(300, 3))
    asked, before = [], metric.neighbours
    monkeypatch.setattr(metric, "CELL", 64)
    monkeypatch.setattr(metric, "neighbours", lambda found, k: (asked.append(k), before(found, k))[1])
    monkeypatch.setattr(hierarchy, "LONG", 32, raising=False)
    points = spark.createDataFrame([(k, "", v.tolist(), 90) for k, v in enumerate(x)], "row bigint, grp string, v array<double>, samples int")
    edges = hierarchy.spanning_edges(points, 90).collect()
    assert max(asked) == hierarchy.LISTED
    d = metric.apart(x[:, None, :], x[None, :, :])
    core = np.sort(d, 1)[:, 90]
    assert edges and all(e.w == max(d[e.a, e.b], core[e.a], core[e.b]) for e in edges)
