"""Byte-level BPE over Arrow batches.

A batch's texts are split into words by array operations on code points, each distinct word of a batch goes through the
tokenizers library once (and is remembered, within bounds, for later batches), and the ids are dealt back to the
texts. Two words count as the same only after a comparison of all their characters. Texts of any length are
worked on in pieces of some SEGMENT code points, cut where a word ends whatever stands around it. Strings that a tokenizer
file adds as special stand for their ids, as the library has it without further settings; files of ranks have none.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from .common import batched, read

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core

#: Code points that are worked on at once.
SEGMENT = 1 << 21
#: Words that a worker remembers: at most twice as many, and only those of at most LONG code points.
REMEMBERED = 300_000
LONG = 64

#: No letter, number or white space has a code point from here on; what is there is private, a tag or unassigned.
ASSIGNED = 0x34000

#: A word ends after the first character of these, whatever stands around them.
_SAFE_CUT = re.compile(r"[!-~](?=[ \n][!-~])|[A-Za-z0-9](?=[,;:.])|[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def char_classes() -> np.ndarray:
    """Class of each code point as the tokenizers library's own regex engine has it."""
    points = [c for c in range(ASSIGNED) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        matching = pre_tokenizers.Split(Regex(pattern), "removed")
        rest = np.ones(len(text), bool)
        for _, (a, b) in matching.pre_tokenize_str(text):
            rest[a:b] = False
        table[at[rest]] = kind
    return table


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


def tokenizer_of_ranks(path: str) -> Tokenizer:
    """A tokenizers model that merges as the ranks say: every way to join two tokens into a third is a merge, at
    the third's rank; a word that is a token itself stays whole."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shown = byte_chars()
    name = {t: "".join(shown[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        ways = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(ways, key=lambda w: (ranks[w[0]], ranks[w[1]]))]
    made = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    made.decoder = decoders.ByteLevel()
    return made


def tokenizer_of_json(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def word_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the words of public_tokenizers.PATTERN start in texts laid end to end; first: where texts start."""
    n = len(points)
    kind = classes[points]
    opens = np.zeros(n + 2, bool)
    opens[first] = True
    start = np.zeros(n + 2, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= opens
    start[n:] = False
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    of = kind[begin]
    follows = (end < n) & ~opens[end]

    # white space before a word: all but the last character, then that one, joined to the word if it is a blank
    gap = end[(of == _SPACE) & follows]
    start[gap - 1] = True
    start[gap[points[gap - 1] == 32]] = False

    # a lone apostrophe that no blank precedes, and the letters of a contraction
    lone = (of == _OTHER) & (end - begin == 1) & follows & (points[begin] == 39) & start[begin]
    lone[:-1] &= of[1:] == _LETTER
    lone[-1:] = False
    at = np.flatnonzero(lone)
    if len(at):
        letters, stop = begin[at + 1], end[at + 1]
        a = points[letters]
        b = np.where(stop - letters > 1, points[np.minimum(letters + 1, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        k = np.where(one, 1, np.where(two, 2, 0))
        joined = k > 0
        start[letters[joined]] = False
        after = (letters + k)[joined & (stop - letters > k)]
        start[after] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts, for one tokenizer; kept in a worker's process."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.classes = char_classes()
        vocab = json.loads(tokenizer.to_str())["model"]["vocab"]
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take blanks along aren't known here")
        #: Strings that stand for an id of their own in any text, as the library has it.
        self.special = {t.content: i for i, t in added.items()}
        self.whole = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        tokens = [b""] * (max([*vocab.values(), *added]) + 1)
        for shown, i in vocab.items():
            if all(c in byte_of for c in shown):
                tokens[i] = bytes(byte_of[c] for c in shown)
        for shown, i in self.special.items():
            tokens[i] = shown.encode()
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        rng = np.random.default_rng(5)
        self.weights = rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        found = list(map(young.get, words))
        new = []
        for i, x in enumerate(found):
            if x is None:
                found[i] = x = old.get(words[i])
                if x is None:
                    new.append(i)
                else:
                    young[words[i]] = x
        if new:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in new], add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
            at = 0
            for i, ids in zip(new, lists, strict=True):
                found[i] = flat[at : (at := at + 4 * len(ids))]
                if len(words[i]) <= LONG:
                    young[words[i]] = found[i]
        if len(young) >= REMEMBERED:
            self.young, self.old = {}, young
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (one more entry than texts)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start = word_starts(points, bounds[:-1][sizes > 0], self.classes)
        size = np.diff(np.append(start, len(points)))
        place = np.arange(len(points)) - np.repeat(start, size)
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= self.weights[place & 4095]
        key = np.add.reduceat(mixed, start)
        _, sample, which = np.unique(key, return_index=True, return_inverse=True)
        # an occurrence that isn't its sample, character for character, is a word of its own
        model = start[sample][which]
        odd = size != size[sample][which]
        same = points[np.minimum(place + np.repeat(model, size), len(points) - 1)] == points
        odd |= ~np.logical_and.reduceat(same, start)
        if odd.any():
            own = np.flatnonzero(odd)
            which[own] = len(sample) + np.arange(len(own))
            sample = np.append(sample, own)
        begin, stop = start[sample].tolist(), (start + size)[sample].tolist()
        found = self._ids_of_words([whole[a:b] for a, b in zip(begin, stop, strict=True)])
        counts = np.array([len(x) // 4 for x in found], np.int64)
        table = np.frombuffer(b"".join(found), "<u4")
        ids = table[_ragged(np.concatenate([[0], np.cumsum(counts)])[:-1][which], counts[which])]
        ends = np.concatenate([[0], np.cumsum(counts[which])])
        return ids, ends[np.searchsorted(start, bounds)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; a character that tokens split is whole again in them. Ids outside the vocabulary
        stand for none."""
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        return self.bytes[_ragged(self.offsets[ids], self.sizes[ids])].tobytes()

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point and end of what each id stands for; a token that holds a part of a character covers it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.sizes[ids])
        begin = end - self.sizes[ids]
        return char[begin] if len(ids) else begin, char[end - 1] + 1 if len(ids) else end

    def batches(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(indexes of texts, ids, starts) for pieces of some SEGMENT code points; a long text comes in several."""
        held, at, size = [], [], 0
        for i, text in enumerate(texts):
            for piece in self.pieces(text or ""):
                if piece in self.special:
                    if held:
                        yield at, *self.encode(held)
                    yield [i], np.array([self.special[piece]], np.uint32), np.array([0, 1])
                    held, at, size = [], [], 0
                    continue
                held.append(piece)
                at.append(i)
                size += len(piece)
                if size >= SEGMENT:
                    yield at, *self.encode(held)
                    held, at, size = [], [], 0
        if held:
            yield at, *self.encode(held)


    def pieces(self, text: str) -> Iterator[str]:
        """A text's segments and, each by itself, its special strings."""
        at = 0
        for m in self.whole.finditer(text):
            yield from segments(text[at : m.start()])
            yield m[0]
            at = m.end()
        yield from segments(text[at:])


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then first[1] and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def segments(text: str) -> Iterator[str]:
    """A text in pieces of SEGMENT code points or little more, cut where a word always ends; only a run without such a
    place (one word, or text without ASCII) is longer."""
    at = 0
    while len(text) - at > SEGMENT and (m := _SAFE_CUT.search(text, at + SEGMENT)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file of ranks (.tiktoken) or a tokenizer (.json)."""
    if path not in _KEPT:
        _KEPT[path] = Encoder((tokenizer_of_json if path.endswith(".json") else tokenizer_of_ranks)(path))
    return _KEPT[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids, and of each id the code points that it covers (starts, ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            parts: list[list] = [[] for _ in texts]
            for at, ids, ends in own.batches(texts):
                for k, i in enumerate(at):
                    parts[i].append(ids[ends[k] : ends[k + 1]])
            told = [np.concatenate(p).astype(np.int64) for p in parts]
            spans = [own.spans(t, x) for t, x in zip(texts, told, strict=True)]
            whole = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, whole), pa.array([s for s, _ in spans], whole), pa.array([e for _, e in spans], whole)], ["id", "ids", "starts", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(docs).select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<bigint>, starts array<bigint>, ends array<bigint>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes, text, n_unknown: what ids stand for; bytes that are no UTF-8 show as U+FFFD in text. A null list counts as
    empty; null ids and ids that the vocabulary doesn't have stand for no bytes and are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            lists = [np.array([-1 if i is None else i for i in x or []], np.int64) for x in batch.column(1).to_pylist()]
            raw = [own.decode(x) for x in lists]
            unknown = [int(((x < 0) | (x >= len(own.sizes))).sum()) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([b.decode(errors="replace") for b in raw], pa.string()), pa.array(unknown, pa.int64())], ["id", "bytes", "text", "n_unknown"])

    kind = rows.schema[id_col].dataType.simpleString()
    return batched(rows).select(id_col, ids_col).mapInArrow(run, f"id {kind}, bytes binary, text string, n_unknown bigint").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids, and keeps only digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n = batch.num_rows
            counts, of_ids, of_bytes = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for at, ids, ends in own.batches(batch.column(1).to_pylist()):
                raw, encoded = own.decode(ids), ids.astype("<u4").tobytes()
                cuts = np.concatenate([[0], np.cumsum(own.sizes[ids])])[ends].tolist()
                ends = ends.tolist()
                for k, i in enumerate(at):
                    counts[i] += ends[k + 1] - ends[k]
                    of_ids[i].update(encoded[4 * ends[k] : 4 * ends[k + 1]])
                    of_bytes[i].update(raw[cuts[k] : cuts[k + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([x.hexdigest() for x in of_ids]), pa.array([x.hexdigest() for x in of_bytes])], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(docs).select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op3_byte_bpe(spark, sf_dir):
    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
