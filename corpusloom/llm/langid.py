"""Language ID by error-correcting output codes.

Each language has a codeword. For each bit a binary n-gram classifier (log-odds of hashed n-grams of bytes, orders 1
to 3) tells the languages whose bit is 1 from the others. The logistic loss of all bits against each codeword, weighted
by how well the bit told training documents apart, is least for the predicted language; a small lead over the next one
flags the prediction as ambiguous. A text counts by the least of its loss and that of each PIECE of it, so one that changes
its language lies near. One whose loss is further from that of every document learned from than from that of a text that
tells nothing (log 2), or beyond both, is in no learned language: rejected. Texts of fewer than JUDGED n-grams of each order
never are rejected, nor is any text where only one language was learned.

The classifiers are fitted on all labelled documents (whole texts), and so is the loss that rejects; n-grams are counted on the
executors, and the driver gets COUNTS numbers for each language and task. Every language that occurs is learned; the tables of
driver and workers grow with their number, not with the rows.

Defined cases: a text that is null or has no letter is "und" with score 0; so is every text if no row may be learned
from; rows with a null language are never learned from; repeated rows get the same answer; an empty table gives no
rows; other columns are ignored. A null id counts as the empty text where the held-out share is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, read

COUNT_BITS = 13
COUNTS = 1 << COUNT_BITS
#: Bytes that are counted at once.
SLICE = 1 << 21
#: Texts that are counted at once.
TOGETHER = 32
#: Steepness of the loss in a bit's mean log-odds; at this lead (of the first language's share) a prediction is sure.
STEEPNESS, SURE = 8.0, 0.2
#: n-grams of an order that a text must have to be rejected.
JUDGED = 64
#: Bytes of a piece.
PIECE = 128
#: Losses are trusted up to this share.
SLACK = 1e-6

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, other ASCII as blanks, the rest as it is.
_FOLD = np.array([b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint32)


def _count(rows: list[int], parts: list[bytes], n: int) -> np.ndarray:
    """Counts [n, COUNTS] of hashed n-grams of orders 1 to 3 that start in a part, but for its last two bytes."""
    sizes = np.array([len(p) for p in parts], np.int64)
    b = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    base = np.repeat(np.array(rows, np.int64) * COUNTS, sizes)
    ends = np.cumsum(sizes)
    base[ends - 1] = base[ends - 2] = n * COUNTS  # these start no n-gram; their counts are dropped
    places = [base + b]
    value = b
    for order in (2, 3):
        value = value[:-1] * np.uint32(0x01000193) + b[order - 1 :]
        mixed = (value ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        places.append(base[: len(value)] + (mixed >> np.uint32(32 - COUNT_BITS)))
    return np.bincount(np.concatenate(places), minlength=(n + 1) * COUNTS)[: n * COUNTS].reshape(n, COUNTS)


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text, as if two blanks followed it; long texts are counted in slices."""
    out = np.zeros((len(texts), COUNTS), np.float32)
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        text += b"  "
        for a in range(0, len(text) - 2, SLICE):
            rows.append(i)
            parts.append(text[a : a + SLICE + 2])
            size += len(parts[-1])
            if size >= SLICE:
                out += _count(rows, parts, len(texts))
                rows, parts, size = [], [], 0
    if parts:
        out += _count(rows, parts, len(texts))
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1, far from each other: all distinct splits for up to 5 languages, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).T
    bits = min(63, 8 + 5 * int(np.ceil(np.log2(n))))
    rng = np.random.default_rng(11)
    tries = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(50)]
    tries = [c for c in tries if (np.abs(c.sum(0)) < n).all()] or tries
    return max(tries, key=lambda c: (bits - (c @ c.T - 2 * bits * np.eye(n))).min())


class Codes:
    """The fitted classifiers: weights [COUNTS, bits], each bit's say, and the codewords of languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # each language weighs the same
        smooth = 0.01 / COUNTS
        self.weights = np.zeros((COUNTS, self.code.shape[1]), np.float32)
        for k, bit in enumerate(self.code.T):
            if len(languages) > 1:
                one, other = share[bit > 0].mean(0), share[bit < 0].mean(0)
                self.weights[:, k] = np.log((one + smooth) / (other + smooth))
        margins = share @ self.weights * self.code  # a bit's say: its least mean margin over the languages
        self.say = np.maximum(margins.min(0), 0.01) if len(languages) > 1 else np.ones(1)
        self.say = self.say / self.say.sum()
        #: Loss from which a text is rejected.
        self.limit = float("inf")

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language's index, score, lead over the next one, least loss; 0 for short texts)."""
        odds = counts @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1)
        loss = np.stack([(np.logaddexp(0, -STEEPNESS * odds * word) * self.say).sum(1) for word in self.code], 1)
        likely = np.exp(-STEEPNESS * (loss - loss.min(1, keepdims=True)))
        likely /= likely.sum(1, keepdims=True)
        ranked = np.sort(likely, 1)
        lead = ranked[:, -1] - ranked[:, -2] if likely.shape[1] > 1 else np.ones(len(likely))
        return loss.argmin(1), ranked[:, -1], lead, np.where(counts.sum(1) >= 3 * JUDGED, loss.min(1), 0.0)


def fit(rows: DataFrame) -> Codes | None:
    """rows: text, lang (not null), only those that may be learned from."""
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())  # a row for each language
    if not languages:
        return None
    rows = batched(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), COUNTS), np.float64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            of = np.array([place[x] for x in batch.column(1).to_pylist()])
            for a in range(0, len(texts), TOGETHER):
                np.add.at(total, of[a : a + TOGETHER], gram_counts(texts[a : a + TOGETHER]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(languages)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["k", "counts"])

    counts = np.zeros((len(languages), COUNTS))
    for r in rows.select("text", "lang").mapInArrow(count, "k int, counts binary").toLocalIterator():
        counts[r.k] += np.frombuffer(r.counts)
    model = Codes(languages, counts)
    if len(languages) > 1:
        most = _greatest_loss(rows, model)
        model.limit = max((most + float(np.log(2))) / 2, most * (1 + SLACK))
    return model


def least_loss(model: Codes, text: bytes, whole: float) -> float:
    """The least loss of a text, whose own is ``whole``, and of its pieces."""
    pieces = [text[a : a + PIECE] for a in range(0, len(text), PIECE)]
    for a in range(0, len(pieces), 8 * TOGETHER):
        found = model.predict(gram_counts(pieces[a : a + 8 * TOGETHER]))[3]
        whole = min(whole, found[found > 0].min(initial=whole))  # short ones tell nothing
    return whole


def _greatest_loss(rows: DataFrame, model: Codes) -> float:
    """The greatest of the least losses of the documents learned from; a number for each task goes to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist() if t and _LETTER.search(t)]
            for a in range(0, len(texts), TOGETHER):
                some = texts[a : a + TOGETHER]
                for text, loss in zip(some, shared.value.predict(gram_counts(some))[3].tolist(), strict=True):
                    if loss > most:
                        most = max(most, least_loss(shared.value, text, loss))
        yield pa.RecordBatch.from_arrays([pa.array([most], pa.float64())], ["most"])

    return rows.select("text").mapInArrow(run, "most double").agg(F.max("most")).first()[0] or 0.0


def identify(docs: DataFrame, model: Codes | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, lang_pred, score, ambiguous, rejected; and the columns in carry."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # COUNTS numbers for each of 63 bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found: list[tuple[str, float, bool, bool]] = [("und", 0.0, False, bool(own))] * len(texts)
            told = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if own else []
            for a in range(0, len(told), TOGETHER):
                some = told[a : a + TOGETHER]
                told_of = own.predict(gram_counts([texts[i].encode() for i in some]))
                for i, k, s, gap, loss in zip(some, *(x.tolist() for x in told_of), strict=True):
                    found[i] = (own.languages[k], min(1.0, s), gap < SURE, loss >= own.limit and least_loss(own, texts[i].encode(), loss) >= own.limit)
            columns = zip(*found, strict=True) if found else ((),) * 4
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds), *batch.columns[2:]], ["id", "lang_pred", "score", "ambiguous", "rejected", *[f"c{i}" for i in range(len(carry))]])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    extra = "".join(f", c{i} {kind(c)}" for i, c in enumerate(carry))
    out = batched(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    out = out.mapInArrow(run, f"id {kind(id_col)}, lang_pred string, score double, ambiguous boolean, rejected boolean{extra}")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "ambiguous", "rejected", *[F.col(f"c{i}").alias(f"carried_{c}") for i, c in enumerate(carry)])


def held_out_share(id_col: str, parts: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def op5_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter((held_out_share("doc_id", 4) != 2) & F.col("lang").isNotNull()).select("text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", (held_out_share("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
