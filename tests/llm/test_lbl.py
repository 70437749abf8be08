"""The log-bilinear model: counts and scores against plain loops, its objective against differences, and what it learns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import lbl
from corpusloom.llm.lbl import ALPHA, CLASSES, ENDINGS, ORDER, OWN, Net, Trainer, coded, ending, op12_log_bilinear, scored, tokens, train, vocabulary


def prose(rng, n):
    """Words of two kinds that don't mix, so that what stands before tells much; some only once."""
    kind = rng.choice(["a", "b"])
    return " ".join(f"{kind}{int(rng.paretovariate(0.7)) % 400}" if rng.random() < 0.9 else f"X{rng.random()}" for _ in range(n))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(6)
    docs = {i: prose(rng, rng.choice([1, 40, 200])) for i in range(300)} | {900: None, 901: "", 902: " \t", 903: "A1 a1\x0bB2", 904: "é É a1"}
    folder = str(tmp_path_factory.mktemp("lbl"))
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder, docs


def share(i):
    return zlib.crc32(str(i).encode()) % 10


def test_query_as_plain_version(spark, table, monkeypatch):
    """The same with the counts of few tokens at the workers, so that most are joined."""
    monkeypatch.setattr(lbl, "FREQUENT", 250)
    folder, docs = table
    got = {r.doc_id: r for r in op12_log_bilinear(spark, folder).collect()}
    assert got.keys() == docs.keys()
    counts = Counter(t for i, text in docs.items() if share(i) for t in tokens((text or "").encode()))
    total, distinct = sum(counts.values()), len(counts)
    for i, text in docs.items():
        own = tokens((text or "").encode())
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (share(i) == 0, len(own), sum(counts[t] > 0 for t in own), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_as_plain_sums(spark, table):
    folder, docs = table
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    known = vocabulary(frame)
    rows = coded(frame, known)
    net = Net.start(known.class_n)
    rng = np.random.default_rng(1)
    net.context += rng.normal(size=net.context.shape).astype(np.float32) / 2
    counts = Counter(t for text in docs.values() for t in tokens((text or "").encode()))
    top = {t: k for k, (t, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:OWN])}
    of = lambda t: top.get(t, ending(t))
    size, kinds = Counter(), Counter()
    for t, n in counts.items():
        size[of(t)] += n
        kinds[of(t)] += 1
    for r in scored(rows, known, net).collect():
        want, before = 0.0, [of(lbl.END)] * ORDER
        for t in tokens((docs[r.id] or "").encode()):
            h = sum(net.context[before[-k]].astype(float) @ net.places[k - 1].astype(float) for k in range(1, ORDER + 1))
            each = net.target.astype(float) @ h + net.bias
            want += (each[of(t)] - math.log(np.exp(each - each.max()).sum()) - each.max()) / math.log(10)
            if of(t) >= OWN:
                want += math.log10((counts[t] + ALPHA) / (size[of(t)] + ALPHA * (kinds[of(t)] + 1)))
            before.append(of(t))
        assert abs(r.score - want) < 1e-4 * max(1, -want)


def test_probabilities_add_up_to_one(spark, table):
    known = vocabulary(spark.read.parquet(f"{table[0]}/documents.parquet"))
    net = Net.start(known.class_n)
    net.context *= 9
    before = np.random.default_rng(2).integers(0, CLASSES, ORDER)
    each = [net.log_probabilities(np.array([*before, k], np.int16))[0] for k in range(CLASSES)]
    assert abs(sum(10**p for p in each) - 1) < 1e-5
    inside = np.zeros(CLASSES)
    for token, k in known.place.items():
        if known.of[k] >= OWN:
            assert known.of[k] == ending(token)
            inside[known.of[k]] += (known.n[k] + ALPHA) / 10 ** known.class_log[known.of[k]]
    inside[OWN:] += ALPHA / 10 ** known.class_log[OWN:]  # one unknown token
    assert np.allclose(inside[OWN:], 1)


def test_steps_follow_the_contrastive_objective(monkeypatch):
    """A step's gradient is the slope of the objective."""
    rng = np.random.default_rng(3)
    share = rng.random(CLASSES)
    share /= share.sum()
    net = Net.start(share * 1000)
    x = rng.integers(0, CLASSES, 40).astype(np.int16)
    counts = np.ones(len(x) - ORDER, np.float32)
    counts[4] = 0
    trainer = Trainer(net, share, 0.0, 5)
    found = {}
    monkeypatch.setattr(trainer, "_down", lambda k, at, g: found.__setitem__(k, (at, g)))
    noise = np.searchsorted(trainer.spread, np.random.default_rng(5).random(lbl.NOISE), side="right")
    trainer.learn(x, counts)

    def objective(parts):
        context, target, bias, places = (p.astype(np.float64) for p in parts)
        total = 0.0
        for t in range(ORDER, len(x)):
            h = sum(context[x[t - k]] @ places[k - 1] for k in range(1, ORDER + 1))
            delta = lambda w: target[w] @ h + bias[w, 0] - math.log(lbl.NOISE * share[w])
            total += float(counts[t - ORDER]) * (math.log1p(math.exp(-delta(x[t]))) + sum(math.log1p(math.exp(delta(w))) for w in noise))
        return total

    parts = [p.astype(np.float64) for p in net.parts()]
    for k, part in enumerate(parts):
        at, g = found[k]
        whole = np.zeros(part.shape)
        whole[at] = g
        for place in [tuple(rng.integers(0, n) for n in part.shape) for _ in range(6)] + [np.unravel_index(np.abs(whole).argmax(), part.shape)]:
            moved = [p.copy() for p in parts]
            moved[k][place] += 1e-5
            assert abs((objective(moved) - objective(parts)) / 1e-5 - whole[place]) < 1e-2 * max(1, abs(whole[place]))


def test_averages_by_what_was_seen():
    net = Net.start(np.ones(CLASSES))
    a, b = (Net(*(p.copy() for p in (net.context, net.target, net.places, net.bias))) for _ in range(2))
    a.context[:], b.context[:] = 1, 4
    seen = np.zeros(CLASSES)
    seen[0] = 2
    other = np.zeros(CLASSES)
    other[:2] = 1
    mean = lbl._averaged(np.frombuffer(lbl._packed(a, seen, 2.0)) + np.frombuffer(lbl._packed(b, other, 2.0)), net)
    assert np.allclose(mean.context[0], 2) and np.allclose(mean.context[1], 4) and np.allclose(mean.context[2], net.context[2])


def test_long_texts_go_in_pieces(monkeypatch):
    net = Net.start(np.arange(1, CLASSES + 1))
    x = np.random.default_rng(4).integers(0, CLASSES, 500).astype(np.int16)
    whole = net.log_probabilities(x)
    monkeypatch.setattr(lbl, "CHUNK", 37)
    assert np.allclose(net.log_probabilities(x), whole)
    batch = pa.record_batch({"classes": pa.array([x[:1].tobytes(), x.tobytes()], pa.binary())})
    stream, counts, starts = lbl._streams(batch, 7)
    assert counts.sum() == 501 and starts.tolist() == [0, ORDER + 1] and (stream[counts == 0] == 7).all()


def test_cases(spark, documents):
    rows = documents([(1, None), (1, None), (None, "a b"), (2, "w " * 20_000), (3, "x" * 50_000)])
    known = vocabulary(rows)
    out = scored(coded(rows, known), known, train(coded(rows, known), known)).collect()
    assert sorted((r.n_tokens, r.n_known) for r in out) == [(1, 1), (1, 1), (2, 2), (3, 3), (20_001, 20_001)]
    none = documents([])
    empty = vocabulary(none)
    assert (empty.total, empty.distinct) == (0, 0) and scored(coded(none, empty), empty, train(coded(none, empty), empty)).count() == 0
    untold = scored(coded(rows, empty), empty, train(coded(none, empty), empty)).collect()
    for r in untold:  # all classes are alike, and so are all tokens of a class
        assert r.n_known == 0 and r.base_score == pytest.approx(0) and r.score == pytest.approx(-r.n_tokens * math.log10(CLASSES), rel=0.1)

