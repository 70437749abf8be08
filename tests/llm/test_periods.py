"""Runs against all stretches of all periods."""

import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm.periods import collapsed, find_runs, longest, op11_periodic_runs, planted, stretch_runs, word_runs


def plain(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(s, e + q - p)) for p in range(1, q)):
                out.append((s, e - s + q, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_as_all_stretches(letters):
    rng, found = random.Random(letters), 0
    for _ in range(700):
        n = rng.choice([0, 1, 5, 6, 12, 40, 90])
        codes = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            codes = codes[:a] + [codes[a + k % p] for k in range(n - a)]
        want = plain(codes)
        found += len(want)
        assert word_runs([b"%d" % c for c in codes]) == want
        assert sorted(((a, m, q) for a, q, m in stretch_runs(np.array(codes, np.int64))), key=lambda r: (r[0], r[2])) == want
    assert found > 50


def test_hashes_that_always_agree_change_nothing(monkeypatch):
    """Where hashes call everything equal, words decide: lengths are cut to what is verified."""
    from corpusloom.llm import periods

    monkeypatch.setattr(periods.Common, "_alike", lambda self, i, j, length: True)
    codes = [0, 1, 2] * 9 + [3, 4] * 12 + [5] * 7 + list(range(6, 30)) + [0, 1] * 10
    assert word_runs([b"%d" % c for c in codes]) == plain(codes)


def test_long_texts_take_time_in_proportion():
    fib = [[b"a"], [b"a", b"b"]]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    assert word_runs(fib[-1]) == []
    assert word_runs([b"x"] * 200_000) == [(0, 200_000, 1)]
    assert word_runs([b"%d" % (k % 1000) for k in range(100_000)]) == [(0, 100_000, 1000)]


def test_longest_and_collapsed():
    words = b"x a b a b a b a b y c c c c c c".split()
    runs = word_runs(words)
    assert runs == [(1, 8, 2), (10, 6, 1)] and longest(runs) == (10, 6, 1)
    assert collapsed(words, runs) == b"x a b y c"
    assert longest([(0, 8, 2), (9, 4, 1)]) == (0, 8, 2) and longest([]) is None


def test_cases(spark, documents):
    hot = " ".join(["w"] * 30_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 5), (4, "a b " * 5), (4, "a b " * 5), (5, hot), (6, "é b é b " * 3)]
    got = find_runs(documents(rows)).collect()
    assert len(got) == len(rows)
    told = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in got}
    assert told[1] == told[2] == told[3] == (0, [], None, "")
    assert told[4] == told[None] == (10, [(0, 10, 2)], (0, 10, 2), "a b")
    assert told[5] == (30_000, [(0, 30_000, 1)], (0, 30_000, 1), "w")
    assert told[6] == (6, [(0, 6, 1)], (0, 6, 1), "é b")  # a no-break space is part of a word
    assert find_runs(documents([])).count() == 0


def test_query_as_plain_version(spark, tmp_path):
    rng = random.Random(4)
    docs = {i: " ".join(rng.choices("a b cc d e".split(), k=rng.choice([0, 3, 30, 70]))) if i % 17 else None for i in range(600)}
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got.keys() == docs.keys()
    digest = lambda x: hashlib.sha256(x).hexdigest()
    for i, text in docs.items():
        words = planted(i, (text or "").encode())
        runs = plain(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *top, top[1] and 1000 * top[1] // top[2])
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode())
        assert r.collapsed_sha256 == digest(b" ".join(w for k, w in enumerate(words) if k not in gone))
    assert sum(r.n_runs for r in got.values()) > 10
