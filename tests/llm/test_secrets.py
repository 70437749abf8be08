import re

from corpusloom.llm import secrets

TEXT = 'x "Password": "abcdefghijkl" é AKIAABCDEFGHIJKLMN token=short1 https://host.example/x deadbeefdeadbeef00 secret: a=b'


def spans(df):
    return {r.doc_id: [(s.kind, s.start, s.end, s.linked) for s in r.spans] for r in df.collect()}


def base(text):
    found = []
    assign = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found += [("assign", *m.span()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_findings_as_plain_regex(documents):
    texts = [TEXT, None, "", "nothing", "token: password: abcdefghijklmn", "é" * 300 + TEXT, "token=secret=abcdefghijklmnop", "AKIA" * 3 + "0123456789", "a" * 40, TEXT * 3, "password=" * 5 + "0123456789abcdef"]
    got = spans(secrets.scan(documents(texts)))
    for i, t in enumerate(texts):
        assert [s[:3] for s in got[i] if not s[3]] == base(t or ""), t


def test_weak_parts_need_company(documents):
    near = "token=abcdef12 and AKIAABCDEFGHIJKLMN"
    far = "token=abcdef12" + " x" * 400 + " AKIAABCDEFGHIJKLMN"
    cover = "https://h.example/?" + "q" * 900 + "&token=abcdef1"
    commit = "see https://h.example/x/y/commit/0123456789abcdef0123456789abcdef01234567"
    got = spans(secrets.scan(documents(["token=abcdef12", near, far, "see https://a.example/b", cover, commit, commit + " AKIAABCDEFGHIJKLMN password: abcdefghijkl"])))
    linked = {i: [s[0] for s in v if s[3]] for i, v in got.items()}
    assert linked == {0: [], 1: ["linked_secret"], 2: [], 3: [], 4: [], 5: [], 6: ["linked_endpoint"]}  # parts over each other don't count


def test_interval_join_as_all_pairs(documents):
    import random

    rng = random.Random(1)
    parts = ["token=abcdef1", "AKIAABCDEFGHIJKLMN", "https://e.example/p" + "q" * 300, "login: bob.smith", "password=abcdefghijkl", "https://e.example/0123456789abcdef01&token=abcdef1"]
    texts = ["".join(rng.choice(parts) + " " + "w " * rng.randint(0, 200) for _ in range(12)) for _ in range(20)]
    got = spans(secrets.scan(documents(texts)))
    for i, t in enumerate(texts):
        found = []
        for kind, (p, _, role, group, strong, weak) in secrets.KINDS.items():
            for m in re.finditer(p, t):
                n = len(m[group])
                if n >= min(strong or 1 << 30, weak or 1 << 30):
                    found.append((kind, role, m.start(), m.end(), strong is not None and n >= strong))
        want = [(secrets.WEAK_NAMES[k], s, e) for k, r, s, e, st in found if not st and any(r2 in secrets.COMPLEMENTS[r] and e2 >= s - secrets.SCOPE and s2 <= e + secrets.SCOPE and (e2 <= s or s2 >= e) for _, r2, s2, e2, _ in found)]
        assert sorted(x[:3] for x in got[i] if x[3]) == sorted(want)


def test_rows_and_redaction(documents):
    docs = documents([(1, TEXT), (1, TEXT), (None, TEXT), (3, None), (4, "clean")])
    assert secrets.scan(docs).count() == 5 and secrets.scan(documents([])).count() == 0
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    by = {r.doc_id: r.text for r in clean.collect()}
    assert by[3] is None and by[4] == "clean" and "abcdefghijkl" not in by[1] and "[assign]" in by[1] and "[access]" in by[None]
    assert all(not base(t or "") for t in by.values())
    others = [c for c in docs.columns if c != "text"]
    assert sorted(map(repr, clean.select(*[f"`{c}`" for c in others]).collect())) == sorted(map(repr, docs.select(*[f"`{c}`" for c in others]).collect()))
    odd = docs.selectExpr("doc_id", "text", "1 as found", "2 as k", "'q' as key", "3 as whole", "4 as __spans")
    assert {(r.found, r.k, r.key, r.whole, r["__spans"]) for r in secrets.redact(odd).collect()} == {(1, 2, "q", 3, 4)}
