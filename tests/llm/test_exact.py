import hashlib

from corpusloom.llm import exact_dedup


def rows(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def brute(docs, largest):
    out = []
    for i, t in docs:
        same = [j for j, u in docs if (u or "") == (t or "") and j is not None]
        keep = (max if largest else min)(same, default=None)
        out.append((i, keep, sum((u or "") == (t or "") for _, u in docs), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_groups_ties_and_nulls(documents):
    texts = [(k, t) for k, t in enumerate(["a", "b", "a", None, "", "b" * 5000, "ä\n", "a", "ab", "c"] * 7)] + [(None, "a"), (None, "z")]
    for keep in ("min", "max"):
        got = rows(exact_dedup.content_sort(documents(texts), keep=keep))
        assert sorted([(a, b, c, e) for a, b, c, _, e in got], key=str) == sorted(brute(texts, keep == "max"), key=str)
        assert sum(r[3] for r in got) == len({t or "" for _, t in texts})


def test_one_large_group(documents):
    texts = ["same"] * 900 + [f"other {i}" for i in range(900)]
    got = rows(exact_dedup.content_sort(documents(texts), keep="max"))
    assert {r[2] for r in got if r[1] == 899} == {900} and sum(r[3] for r in got) == 901


def test_repeated_rows_keep_one(documents):
    got = rows(exact_dedup.content_sort(documents([(1, "a"), (1, "a"), (2, "b")])))
    assert [r[3] for r in got].count(True) == 2


def test_empty_table_and_columns(documents, spark):
    assert rows(exact_dedup.content_sort(documents([]))) == []
    docs = documents([(1, "a"), (2, "a"), (3, None)])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert [r.text for r in kept.collect() if r.doc_id == 3] == [None]


def test_splitters_cut_a_hot_text_by_id():
    sample = [("hot", 5, i, "d") for i in range(50)] + [(f"t{i}", i, i, str(i)) for i in range(50)]
    cuts, hot = exact_dedup.splitters(sample, 10)
    assert hot[0] == "d" and len([c for c in cuts if c[2] is not None]) >= 3 and cuts == sorted(cuts, key=exact_dedup._order)


def test_long_texts_that_start_alike(documents):
    texts = ["x" * 500 + str(i % 40) for i in range(400)]
    got = rows(exact_dedup.content_sort(documents(texts)))
    assert {r[2] for r in got} == {10} and sum(r[3] for r in got) == 40
