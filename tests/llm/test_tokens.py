import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    signs = "ab 'strevldm19\n\t é߽１ǅ　\x85’!.-_😀́\x00"
    return [None, "", " ", "it's we'll  'tis ''s \n\n 'll\n's x'd", "<|endoftext|>", "word " * 3000, "x" * 5000] + ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(500)]


def test_ids_offsets_and_round_trip(documents, plain):
    rows = texts()
    docs = documents(rows)
    got = {r.doc_id: r for r in bpe.encode(docs, RANKS).collect()}
    for i, t in enumerate(rows):
        t = t or ""
        assert list(got[i].ids) == plain.encode_ordinary(t)
        at = 0
        for token, a, b in zip(got[i].ids, got[i].starts, got[i].ends, strict=True):
            raw = plain.decode_single_token_bytes(token)
            assert a == len(t.encode()[:at].decode(errors="ignore")) and raw in t[a:b].encode()
            at += len(raw)
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()}
    assert all(back[i].text == (t or "") for i, t in enumerate(rows))
    told = {r.doc_id: r for r in bpe.round_trip(docs, RANKS).collect()}
    for i, t in enumerate(rows):
        ids = plain.encode_ordinary(t or "")
        assert told[i].n_tokens == len(ids) and told[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert told[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(documents([]), RANKS).count() == 0


def test_split_characters(spark, plain):
    text = "x 🙂é"
    ids = plain.encode_ordinary(text)
    part = next(k for k in range(1, len(ids)) if "\ufffd" in plain.decode(ids[:k]))
    rows = [(1, ids), (2, ids[:part]), (3, ids[part:]), (4, None), (5, []), (6, [ids[0], None, -1, 10**9, ids[1]])]
    got = {r.doc_id: r for r in bpe.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<bigint>"), RANKS).collect()}
    assert got[1].text == text and bytes(got[2].bytes) + bytes(got[3].bytes) == text.encode() and "\ufffd" in got[2].text
    assert got[4].text == got[5].text == "" and got[6].n_unknown == 3 and bytes(got[6].bytes) == plain.decode_bytes(ids[:2])
    assert all(got[i].n_unknown == 0 for i in range(1, 6))


def test_special_strings_as_the_library_has_them(documents):
    rows = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x<|endoftext", "it's<|endoftext|>'s \n<|endoftext|>\n"]
    library = Tokenizer.from_file(JSON)
    got = {r.doc_id: list(r.ids) for r in bpe.encode(documents(rows), JSON).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(rows)} and got[0] == [64, 220, 50256, 275]
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(documents(rows), JSON), JSON).collect()} == dict(enumerate(rows))


def test_long_texts_come_in_pieces(plain, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    text = "".join(random.Random(2).choice(["word ", "it's ", "12 ", "\n\n", "é, "]) for _ in range(400))
    parts = list(bpe.segments(text))
    assert len(parts) > 3 and "".join(parts) == text
    own = bpe.encoder(RANKS)
    assert np.concatenate([ids for _, ids, _ in own.batches([text])]).tolist() == plain.encode_ordinary(text)
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choices("ab1,.:;'s \nst9é-", k=600))
        assert max(map(len, bpe.segments(text))) < 300
        assert np.concatenate([ids for _, ids, _ in own.batches([text])]).tolist() == plain.encode_ordinary(text)


def test_packing(documents):
    rng = random.Random(3)
    rows = [None, "", "a" * 9000, "one<|endoftext|>two"] + [" ".join(rng.choices(["the", "of", "zyx", "9"], k=rng.choice([3, 50, 50, 900, 1500]))) for _ in range(150)]
    docs = documents(rows)
    packed = packing.pack(packing.pieces(docs, JSON, 0)).collect()
    t = Tokenizer.from_file(JSON)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(rows)}
    seen, used = {}, {}
    for r in packed:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, whole in ids.items():
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == len(whole)
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids.values()))
    assert len(used) <= 1.05 * total / 1024 + 1 and packing.pack(packing.pieces(documents([]), JSON, 0)).count() == 0


def test_patterns_place_every_piece_once():
    rng = random.Random(5)
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, 1025), 300)}
    found = packing.patterns(histogram)
    count = {}
    for pattern, n in found:
        assert sum(pattern) <= 1024
        for x in pattern:
            count[x] = count.get(x, 0) + n
    assert count == histogram
