import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from corpusloom.llm import components as components_module
from corpusloom.llm import covertree, linededup, minhash
from corpusloom.llm.components import components


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def roots(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [None, "", " \n", "One two", "one  TWO", "one two three four five", "x"]
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.1]) else rng.choice(vocabulary) for w in base]
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return rows


def test_components_of_near_copies(documents):
    rows = corpus()
    sets = [shingles(t) for t in rows]
    for percent in (80, 85):
        root = roots(len(rows), lambda a, b, p=percent: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]))
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_components(documents(rows), percent).collect()}
        assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(rows))}


def test_large_groups_go_block_by_block(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(120)] = f"z{rng.randrange(999)}"
        rows.append(" ".join(copy))
    sets = [shingles(t) for t in rows]
    root = roots(len(rows), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in minhash.near_components(documents(rows), 85).collect()}
    assert got == dict(enumerate(root))


def test_near_rows_that_repeat_and_null_ids(documents):
    text = " ".join(f"w{i}" for i in range(50))
    got = minhash.near_components(documents([(5, text), (5, text), (None, text), (3, text + " end"), (9, "")]), 80).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("3", 3), ("5", 3), ("5", 3), ("9", 9), ("None", 3)]
    assert minhash.near_components(documents([]), 80).count() == 0


def test_one_row_of_each_group_stays(documents):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (None, text), (None, text + " end"), (3, text + " end"), (3, "other words that stand here alone"), (9, ""), (9, ""), (None, None), (7, "a b"), (7, "a b")]
    docs = documents(rows)
    got = minhash.drop_near(docs)
    assert got.columns == docs.columns
    stay = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert stay == sorted([(3, text + " end"), (3, "other words that stand here alone"), (9, ""), (9, ""), (None, None), (7, "a b")], key=str)
    nulls = minhash.drop_near(documents([(None, text), (None, text + " end"), (None, text + " ends")])).collect()
    assert len(nulls) == 1 and minhash.drop_near(documents([])).count() == 0


def test_words_that_differ_far_from_their_start():
    for n in (4095, 4096, 8191, 9000):
        a, b = ("x" + "a" * n).encode(), ("a" * 4096 + "x" + "a" * (n - 4096)).encode() if n >= 4096 else ("a" * n + "x").encode()
        x, y, z = minhash.shingle_sets([a, b, a])
        assert (x == z).all() and (x != y).all()


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (4000, 500, 500))
    x, y = (np.unique(np.concatenate([shared, s])) for s in (a, b))
    r = minhash.registers([x, y])
    used = ((r[0] | r[1]) != 0).sum()
    equal = ((r[0] == r[1]) & (r[0] != 0)).sum()
    assert abs(minhash.estimate(np.array([equal]), np.array([used]))[0] - 0.8) < 0.15


@pytest.mark.parametrize("split", [10_000, 0])
def test_connected_components(spark, monkeypatch, split):
    monkeypatch.setattr(components_module, "SPLIT", split)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    root = roots(481, lambda a, b, s=set(edges): (a, b) in s or (b, a) in s)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in touched}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def vectors(seed=3, n=80, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(n // 4, n):
        x[i] = x[rng.integers(0, n // 4)] + rng.choice([0, 0.05, 0.2]) * rng.normal(size=dims)
    return x.astype(np.float32)


def test_vectors_as_all_pairs(spark, monkeypatch):
    x = vectors()
    label = [int(v) for v in np.random.default_rng(1).integers(0, 3, len(x))]
    rows = [(i, x[i].tolist(), label[i]) for i in range(len(x))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (904, [], 1), (905, [1.0, None], 1), (906, [float("inf")] * 16, 1)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.93
    linked = lambda a, b: label[a] == label[b] and close[a, b]
    root = roots(len(x), linked)
    want = {i: (sum(linked(i, j) for j in range(len(x)) if j != i), root[i]) for i in range(len(x))} | {i: (0, i) for i, _, _ in odd}
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as dim", "3 as weight")
    for block in (2048, 8):
        monkeypatch.setattr(covertree, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(table).collect()}
        assert got == want
    assert covertree.near_vectors(table.limit(0)).count() == 0


def test_labels_and_doubles_as_they_are(spark):
    near = [1.0, 0.3951473]  # cosine with [1, 0] just around 0.93
    at = 1 / 0.93**2 - 1
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, float(np.sqrt(at)) - 1e-12], "a"), (3, [1.0, -float(np.sqrt(at)) - 1e-9], "a"), (4, [1.0, 0.0], "b"), (5, near, "")]
    got = {r.vec_id: r.n_links for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    rows = [(1, [1.0, 0.0], 1.2), (2, [1.0, 0.0], 1.9), (3, [1.0, 0.0], 0.0), (4, [1.0, 0.0], -0.0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label double")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3)}


def test_line_rows_that_share_an_id(documents):
    rows = [(1, "a b c\nx"), (1, "a b c\ny"), (1, "a b c\ny"), (None, "a b c\n\tA  b C\r"), (2, None)]
    docs = documents(rows)
    got = sorted(((str(r.id), r.n_lines, tuple(r.removed)) for r in linededup.removed_lines(docs).collect()))
    assert got == sorted([("1", 2, (1,)), ("1", 2, (1,)), ("1", 2, (1,)), ("None", 2, (2,)), ("2", 1, ())])
    clean = linededup.drop_lines(docs)
    assert clean.columns == docs.columns and sorted(str(r.text) for r in clean.collect()) == sorted(["x", "y", "y", "a b c", "None"])


def test_lines_as_all_pairs(documents):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    known = [rng.choices(vocabulary, k=rng.choice([1, 2, 9, 25])) for _ in range(30)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = [w if rng.random() > 0.06 else rng.choice(vocabulary) for w in rng.choice(known)]
            lines.append(" ".join(line).upper() if rng.random() < 0.1 else " ".join(line))
        texts.append("\n".join([*lines, rng.choice(["", "  "])]))
    rows = [(i, t) for i, t in enumerate([*texts, None, ""])]
    classes, want = [], {}
    for i, t in rows:
        want[i] = []
        for k, line in enumerate((t or "").split("\n"), 1):
            words = frozenset(line.lower().split())
            if words and any(100 * len(words & c) >= 80 * len(words | c) for c in classes):
                want[i].append(k)
            if words and words not in classes:
                classes.append(words)
    docs = documents(rows)
    got = {r.id: list(r.removed) for r in linededup.removed_lines(docs).collect()}
    assert got == want
    clean = linededup.drop_lines(docs)
    assert clean.columns == docs.columns
    by = dict(rows)
    assert {r.doc_id: r.text for r in clean.collect()} == {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n"), 1) if k not in want[i]) for i, t in by.items()}
    assert linededup.removed_lines(documents([])).count() == 0


def test_lines_are_hashed_from_lower_case_texts(spark):
    """A text is put in lower case once; its lines' words, and how many hashes are below 0, are as line by line."""
    text = "ΑΣ\nΑΣ Β\tİx\r\n\n  A  b A\nΣ\nnone"
    rows = spark.createDataFrame([(1, text)], "k0 int, text string")
    told = {r.kln: r for r in linededup._hashed(rows).collect()}
    plain = spark.createDataFrame([(k + 1, line) for k, line in enumerate(text.split("\n"))], "kln int, line string").select("kln", F.array_distinct(F.transform(linededup._split(F.col("line")), lambda w: F.xxhash64(w))).alias("w"))
    for r in plain.collect():
        assert [h & (1 << 31) - 1 for h in sorted(r.w)] == told[r.kln].h and told[r.kln].half == sum(h < 0 for h in r.w)
