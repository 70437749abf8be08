"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on the words of ordinary texts, one on toxic texts. Of the toxic texts go in
whole, or those passages of one to PHRASE words whose rate in toxic texts is so many times that in ordinary ones (counted by
different neighbours, so that copies of a passage don't count as evidence); held-back samples tell which of RATIOS is best, and
nothing is left out for one ordinary occurrence. Windows are all words and all runs of two to PHRASE words that overlap; a run
in which no pair of words stands in the toxic dictionary is worth what its words are. Each byte of a window is written STRETCH
times in different codes, so that the length in bytes tells small differences. A window's evidence is the length that the toxic
dictionary saves over the ordinary one, as a share of the most that could be saved; a document has that of its best window,
and held-back samples calibrate the threshold that becomes score 0.5.

Learned from at most TOXIC and ORDINARY labelled documents, drawn by a hash of the id over the whole table (whole texts, those
that still fit into SAMPLE_BYTES in all, in an order by hash). Distinct windows are compressed once for a batch and remembered within bounds.

Defined cases: null and empty texts have no window and score 0; so does every text if a label is missing among the
rows that may be learned from; a document with several labels counts as toxic if one says so; repeated rows get the same
score; null ids count as the empty text where the held-out share is chosen; a very long text is scored whole, window by window, in
one task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, read
from .langid import held_out_share

TOXIC, ORDINARY = 2000, 16000
SAMPLE_BYTES = 100_000_000
#: One sampled document of so many is held back to calibrate the threshold.
HELD_BACK = 4
WINDOW, STRETCH = 48, 6
ORDINARY_DICTIONARY, TOXIC_DICTIONARY = 64_000, 4_000
#: Ordinary documents that the ordinary dictionary is trained on.
TRAINED_ON = 3000
#: Words of a window at most; the rate ratios from which passages of toxic texts are learned (0: whole texts).
PHRASE, RATIOS = 3, (0, 16, 32, 64)
#: A false alarm counts as so many misses.
ALARM = 4
REMEMBERED = 300_000
#: Passages are counted in so many parts, to bound the driver's memory.
PARTS = 4

_BREAK = re.compile(rb"[^a-z\x80-\xff]+")
_CODES = [bytes((b * m + a) % 256 for b in range(256)) for m, a in ((1, 0), (5, 71), (13, 29), (29, 111), (7, 3), (11, 5))]


def words(text: str | None) -> list[bytes]:
    """The words of a text in order; longer ones are cut."""
    found = _BREAK.split((text or "").lower().encode())
    return [w[i : i + WINDOW] for w in found for i in range(0, len(w), WINDOW)]


def phrases(found: list[bytes], pairs: frozenset[tuple[bytes, bytes]]) -> set[bytes]:
    """The runs of two to PHRASE words that hold one of the pairs."""
    if not pairs or pairs.isdisjoint(zip(found, found[1:], strict=False)):
        return set()
    at = [i for i, pair in enumerate(zip(found, found[1:], strict=False)) if pair in pairs]
    return {b" ".join(found[a : a + n]) for i in at for n in range(2, PHRASE + 1) for a in range(max(0, i + 2 - n), i + 1) if a + n <= len(found)}


def stretch(word: bytes) -> bytes:
    word = b" " + word + b" "
    out = bytearray(STRETCH * len(word))
    for k, code in enumerate(_CODES):
        out[k::STRETCH] = word.translate(code)
    return bytes(out)


def _trained(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size * STRETCH, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: all of them
        return b"".join(samples)[-size * STRETCH :]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=6, window_log=20, chain_log=18, hash_log=18, search_log=6, target_length=64,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=own)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=own)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: Neighbouring words in the toxic dictionary.
    pairs: frozenset[tuple[bytes, bytes]] = frozenset()
    least: int = 0
    threshold: float = 0.75

    def windows(self, found: list[bytes]) -> set[bytes]:
        return {w for w in found if w} | phrases(found, self.pairs)


class Scorer:
    """Evidence of windows under a model, remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.ordinary + model.toxic)
        self.young: dict[bytes, float] = {}
        self.old: dict[bytes, float] = {}

    def lengths(self, word: bytes) -> tuple[int, int]:
        long = stretch(word)
        return len(self.ordinary.compress(long)), len(self.toxic.compress(long))

    def evidence(self, word: bytes) -> float:
        if (known := self.young.get(word)) is not None:
            return known
        if (known := self.old.get(word)) is None:
            a, b = self.lengths(word)
            known = min(1.0, max(0, a - b) / max(1, a - self.model.least))
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        self.young[word] = known
        return known

    def document(self, windows: set[bytes]) -> float:
        return max(map(self.evidence, windows), default=0.0)

    def score(self, evidence: float) -> float:
        t = self.model.threshold
        return 0.5 * evidence / t if evidence < t else 0.5 + 0.5 * (evidence - t) / max(1 - t, 1e-9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _passages(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 1 to PHRASE words: codes of all passages of that length, and codes of them with the word before and after."""
    x = ids.astype(np.uint64) + np.uint64(2)
    beside = np.concatenate([[np.uint64(1)], x, [np.uint64(1)]])
    out = []
    code = np.zeros(len(x) + 1, np.uint64)
    for n in range(1, min(PHRASE, len(x)) + 1):
        code = _mixed(code[:-1] * np.uint64(0x2545F4914F6CDD1D) + x[n - 1 :])
        before, after = beside[: len(code)], beside[n + 1 :]
        out.append((code, *(_mixed(code + w * np.uint64(0xD6E8FEB86659FD93)) for w in (before, after))))
    return out


def _contexts(texts: list[np.ndarray], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, numbers) of the passages in texts, or of those in ``only`` (sorted): the lesser one of their different
    neighbours before and after."""
    empty = np.zeros(0, np.uint64)
    parts = [(empty, empty, empty)]
    for a in range(0, len(texts), 256):
        ids = np.concatenate([x for text in texts[a : a + 256] for x in (text, [-1])])
        crosses = np.zeros(len(ids) + 1, bool)
        for n, found in enumerate(_passages(ids)):
            crosses = crosses[:-1] | (ids[n:] == -1)  # no passage goes beyond its text
            known = ~crosses if only is None else ~crosses & (only[np.minimum(np.searchsorted(only, found[0]), len(only) - 1)] == found[0])
            parts.append(tuple(x[known] for x in found))
    code, *sides = (np.concatenate(x) for x in zip(*parts, strict=True))
    counts = [np.unique(code[np.unique(side, return_index=True)[1]], return_counts=True) for side in sides]
    return counts[0][0], np.minimum(counts[0][1], counts[1][1])


def _rates(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ratios): of each passage of toxic texts, its rate there by that in ordinary texts, one more counted in these."""
    codes, there = _contexts(toxic)
    if not len(codes):
        return codes, np.zeros(0)
    elsewhere = np.zeros(len(codes))
    for k in range(min(PARTS, len(codes))):
        other, n = _contexts(ordinary, codes[k::PARTS])
        elsewhere[np.searchsorted(codes, other)] = n
    return codes, there / len(toxic) / ((elsewhere + 1) / len(ordinary))


def _told(ids: np.ndarray, codes: np.ndarray, ratios: np.ndarray, ratio: float) -> list[np.ndarray]:
    """The runs of words covered by passages of at least this ratio that tell more than every part of them; all for 0."""
    cover = np.full(len(ids), ratio == 0)
    part = np.zeros(len(ids) + 1)
    for n, (code, *_) in enumerate(_passages(ids), 1):
        own = ratios[np.searchsorted(codes, code)]
        part = np.maximum(part[:-1], part[1:])
        start = np.flatnonzero((own >= ratio) & (own > part))
        for k in range(n):
            cover[start + k] = True
        part = np.maximum(part, own)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    return [ids[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)]


def train(samples: Iterator[tuple[str | None, int]]) -> Model | None:
    """A model from (text, toxic); None if a label is missing."""
    place: dict[bytes, int] = {}
    ordinary: list[np.ndarray] = []
    toxic: list[np.ndarray] = []
    back: list[tuple[np.ndarray, int]] = []
    for text, label in samples:
        found = np.array([place.setdefault(w, len(place)) for w in words(text)], np.int32)
        if zlib.crc32((text or "").encode()) // 7 % HELD_BACK == 0:  # copies stay on one side
            back.append((found, label))
        else:
            (toxic if label else ordinary).append(found)
    if not toxic or not ordinary:
        return None
    vocabulary = list(place)
    base = _trained(ORDINARY_DICTIONARY, [b"".join(stretch(vocabulary[i]) for i in dict.fromkeys(ids.tolist())) for ids in ordinary[:TRAINED_ON]])
    codes, ratios = _rates(toxic, ordinary)
    y = np.array([label for _, label in back])
    tried: list[tuple[float, Model]] = []
    for ratio in sorted({min(r, ratios.max(initial=0.0)) for r in RATIOS}):
        runs = [[[vocabulary[i] for i in run.tolist()] for run in _told(ids, codes, ratios, ratio)] for ids in toxic]
        often = Counter(stretch(b" ".join(run)) for text in runs for run in text)
        content = b"".join(sorted(often, key=lambda x: (often[x], x)))  # the most frequent ones are the nearest
        if len(content) > TOXIC_DICTIONARY * STRETCH:
            content = _trained(TOXIC_DICTIONARY, [x for text in runs if (x := b"".join(stretch(b" ".join(run)) for run in text))])
        model = Model(base, content)
        pairs = {pair for text in runs for run in text for pair in zip(run, run[1:], strict=False)}
        model.pairs = frozenset(pair for pair in pairs if stretch(b" ".join(pair)) in model.toxic)
        scorer = Scorer(model)
        model.least = min((scorer.lengths(w)[1] for w in {w for text in runs for run in text for w in run} if stretch(w) in model.toxic), default=2) - 2
        s = np.array([scorer.document(model.windows([vocabulary[i] for i in ids.tolist()])) for ids, _ in back])
        del scorer, runs, often, pairs
        cost = [0.0 if ratio else 1.0]  # unmeasured: the least ratio above whole texts
        if 0 < y.sum() < len(y):
            steps = np.linspace(0.3, 0.99, 139)
            cost = [(s[y == 1] < t).mean() + ALARM * (s[y == 0] >= t).mean() for t in steps]
            best = steps[np.array(cost) <= min(cost) + 1e-12]
            model.threshold = float(best[len(best) // 2])
        tried.append((min(cost), model))
    return min(tried, key=lambda x: x[0])[1]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic, only rows that may be learned from."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {k: min(1.0, n / there[k]) for k, n in ((1, TOXIC), (0, ORDINARY)) if there.get(k)}
    if len(shares) < 2:
        return None
    place = F.abs(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5))) / F.lit(float(1 << 63))  # the same rows however they are dealt out
    drawn = labels.filter(F.when(F.col("toxic") == 1, place <= shares[1]).otherwise(place <= shares[0]))  # some TOXIC + ORDINARY rows
    rows = docs.join(F.broadcast(drawn), "doc_id").select("text", "toxic").orderBy(F.xxhash64("text"))

    def bounded() -> Iterator[tuple[str | None, int]]:
        size = 0
        for r in rows.toLocalIterator():
            if size + len(r.text or "") <= SAMPLE_BYTES:  # a text that is too long is passed over, not what comes after it
                size += len(r.text or "")
                yield r.text, r.toxic

    return train(bounded())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, window (the best one, as text; null without evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value) if shared.value else None
        for batch in batches:
            told = []
            for text in batch.column(1).to_pylist():
                windows = own.model.windows(words(text)) if own else set()
                best = max(windows, key=lambda w: (own.evidence(w), w), default=b"")
                evidence = own.evidence(best) if best else 0.0
                told.append((own.score(evidence) if evidence else 0.0, best.decode(errors="replace") if evidence else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in told], pa.float64()), pa.array([w for _, w in told], pa.string())], ["id", "score", "best"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = batched(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, best string")
    return out.select(F.col("id").alias(id_col), "score", F.col("best").alias("window"))


def op10_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(held_out_share("doc_id", 5) != 0)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (held_out_share("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
