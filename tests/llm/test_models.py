import os
import random

import numpy as np
import pytest

from corpusloom.llm import langid, licenses, toxicity

SYLLABLES = {"aa": "the and ing tion er of", "bb": "der und ung sch ein ich", "cc": "eau les ent oir que ais", "dd": "los ado mente ción que ez"}


def prose(lang, rng, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n and (abs(code.sum(0)) < n).all()
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= (1 if n < 4 else 3)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, prose(lang := rng.choice(list(SYLLABLES)), rng), lang) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(table.filter("doc_id < 300").select("text", "lang"))
    odd = [(900, None), (901, ""), (902, "12 %%% 🙂"), (903, prose("aa", rng, 30000)), (904, "½²"), (None, prose("bb", rng))]
    asked = spark.createDataFrame([(i, t) for i, t, _ in rows[300:]] + odd, "doc_id bigint, text string").selectExpr("*", "1 as id", "'q' as c0")
    got = {r.doc_id: r for r in langid.identify(asked, model, carry=("c0",)).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows[300:]) >= 98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 904))
    assert got[903].lang_pred == "aa" and got[None].lang_pred == "bb" and all(0 <= r.score <= 1 and r.carried_c0 == "q" for r in got.values())
    none = langid.fit(table.limit(0).select("text", "lang"))
    assert none is None and {r.lang_pred for r in langid.identify(asked, none).collect()} == {"und"}


def test_slices_count_as_whole(monkeypatch):
    text = (prose("cc", random.Random(3), 500)).encode()
    whole = langid.gram_counts([text, b"", text[:1]])
    monkeypatch.setattr(langid, "SLICE", 97)
    assert (langid.gram_counts([text, b"", text[:1]]) == whole).all()


def test_held_out_toxicity(spark):
    rng = random.Random(2)
    bad = ["scumlike", "idiotic", "wretchly", "moronish"]
    rows = []
    for i in range(500):
        toxic = int(rng.random() < 0.3)
        words = prose(rng.choice(["aa", "bb"]), rng, 80).split()
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "!!")], "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as score")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i < 350] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5, t) for i, _, t in rows[350:]]
    assert sum(said == bool(t) for said, t in held) >= 0.95 * len(held)
    assert got[900] == got[901] == got[902] == 0 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def _toxic(rng, n, parts, leak):
    """(text, toxic): prose, with one of the parts in toxic texts; in ordinary ones their words alone, the first ``leak`` with a part."""
    rows = []
    for i in range(n):
        words, bad = prose("aa", rng, 60).split(), i % 4 == 0
        for some in [rng.choice(parts)] if bad or i in leak else [[w] for part in parts for w in part if len(part) > 1]:
            k = rng.randrange(len(words))
            words[k:k] = some
        rows.append((" ".join(words), int(bad)))
    return rows


def _told_apart(model, rows):
    scorer = toxicity.Scorer(model)
    said = [scorer.score(scorer.document(model.windows(toxicity.words(t)))) >= 0.5 for t, _ in rows]
    return sum(s == bool(y) for s, (_, y) in zip(said, rows, strict=True)) / len(rows)


@pytest.mark.parametrize(("parts", "leak"), [([["vermin"], ["halfwit"], ["scoundrel"]], {1, 2, 3, 5, 6, 7}), ([["crawl", "home", "quietly"], ["nobody", "wants", "people"]], set())])
def test_toxicity_of_words_quoted_once_and_of_phrases(parts, leak):
    rng = random.Random(8)
    model = toxicity.train(iter(_toxic(rng, 1200, parts, leak)))
    assert model is not None and _told_apart(model, _toxic(rng, 200, parts, set())) >= 0.95


def test_toxicity_without_an_exclusive_word():
    assert toxicity.train(iter([(f"one two three {i % 7}", i % 2) for i in range(40)] + [(f"one two {w}", y) for w in ("a", "b", "c", "d", "e") for y in (0, 1)])) is not None


@pytest.fixture
def answers(documents):
    return lambda rows: {r.doc_id: r for r in licenses.scan(documents(rows)).collect()}


def test_licence_texts_and_notices(answers, spark):
    mit, bsd = licenses.TEXTS["MIT"][0], licenses.TEXTS["BSD-3-Clause"][0]
    changed = "  " + mit.replace("2020 Somebody", "(c) 1999-2003 Other Ltd").replace("License", "LICENCE").replace(", ", " ,\n ") + "\nAll rights reserved."
    source = "#!/bin/sh\n# Copyright (c) 1999 Other\n" + "\n".join("# " + line for line in mit.split("\n")[4:]) + "\n\nrun --now\n/* " + bsd.replace(". ", ".\n * ") + " */ end"
    rows = [mit, changed, "prose\nLicensed under the Apache Licence, version 2.0\nmore", "about a license", None, "", mit + " extra", "SPDX-License-Identifier: MIT\nReleased under the MIT License.", bsd.upper(), source, licenses.TEXTS["MIT"][2].rstrip(".") + "s"]
    got = answers(rows)
    assert [got[i].license_id for i in range(11)] == ["MIT", "MIT", None, None, None, None, None, None, "BSD-3-Clause", None, None]
    assert [got[i].embedded for i in range(11)] == ["MIT", "MIT", "", "", "", "", "MIT", "", "BSD-3-Clause", "BSD-3-Clause,MIT", ""]
    assert got[2].notices == "Apache-2.0" and got[7].notices == "MIT" and got[7].n_notices == 2 and got[3].n_notices == 0
    assert got[0].canonical_sha256 == got[1].canonical_sha256 and got[4].canonical_sha256 == got[5].canonical_sha256
    known = licenses.catalogue(spark)
    assert known.count() == known.select("digest").distinct().count()


def test_every_known_text_has_an_anchor():
    import re

    for text in [t for known in (licenses.NOTICES, licenses.TEXTS) for x in known.values() for t in x]:
        assert re.search(licenses.ANCHORS, text)


@pytest.mark.parametrize("block", [60, 700, 1 << 14])
def test_parts_at_block_borders(documents, monkeypatch, block):
    monkeypatch.setattr(licenses, "BLOCK", block)
    opening = next(first for name, first, *_ in licenses.LONG_TEXTS if name == "GPL-3.0")
    rows = [(k, "é " * shift + (opening + " ") * repeats + text + " " + "end " * shift) for k, (shift, repeats, text) in enumerate((s, n, t[-1]) for s in (0, 29, 61) for n in (0, 40) for t in licenses.TEXTS.values())]
    told = {r.doc_id: set(r.embedded.split(",")) for r in licenses.scan(documents(rows)).collect()}
    names = [name for _ in range(6) for name in licenses.TEXTS]
    assert all(name in told[k] for k, name in enumerate(names)) and len(told) == len(rows)


SHARED = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(SHARED), reason="no licence texts here")
def test_long_licences(answers):
    read = lambda name: open(f"{SHARED}/{name}", encoding="utf-8", errors="replace").read()  # noqa: E731, SIM115
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts = [read(name) for name in names]
    end = "END OF TERMS AND CONDITIONS"
    got = answers([*texts, *(t[: t.index(end) + len(end)] if end in t else t for t in texts), "x\n// " + "\n// ".join("\n\n".join(texts).split("\n"))])
    n = len(texts)
    assert [got[i].license_id for i in range(n)] == [got[i].license_id for i in range(n, 2 * n)] == list(names.values())
    assert set(got[2 * n].embedded.split(",")) == set(names.values())


def test_a_text_beyond_the_sample_is_passed_over(spark, monkeypatch):
    """Whatever its place by hash, a text larger than the bound doesn't end the sample."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 60_000)
    rng = random.Random(7)
    rows = [(i, prose("aa", rng, 30) + (" scumlike idiotic" if i % 2 else "")) for i in range(120)]
    rows += [(1000 + i, f"{i} " + "long " * 20_000) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 1000 and i % 2)) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model is not None
    told = {r.doc_id: r.score for r in toxicity.score(docs.filter("doc_id < 1000"), model).collect()}
    assert all((told[i] >= 0.5) == bool(i % 2) for i in range(120))


def test_languages_are_learned_from_every_row(spark):
    """Counts and the limit come from all rows, also where a language has thousands."""
    texts = [f"wort{k} und noch{k}" for k in range(2400)] + [f"word{k} and more{k}" for k in range(30)]
    rows = spark.createDataFrame([(t, "de" if k < 2400 else "en") for k, t in enumerate(texts)], "text string, lang string")
    model = langid.fit(rows)
    counts = np.stack([langid.gram_counts([t.encode() for t in part]).sum(0, dtype=np.float64) for part in (texts[:2400], texts[2400:])])
    assert np.array_equal(model.weights, langid.Codes(["de", "en"], counts).weights)
