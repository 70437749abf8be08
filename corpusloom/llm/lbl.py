"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are the lower-case words of a text and an end. The model predicts classes: the OWN most frequent tokens are classes of their own,
all others belong to one of ENDINGS classes by their last bytes. The vectors of the ORDER tokens before, each times a matrix for its
distance, add up to a predicted vector; its product with a class's vector, and the class's bias, tell how likely the class is. In
training these products aren't normalised: each token is told apart from NOISE classes drawn by their frequency (noise-contrastive
estimation), in numpy, step by step with step sizes by the gradients seen (Adagrad). Scores are normalised: a product of matrices gives all classes
for a batch of tokens at once. Inside a class a token has its share (c + ALPHA) / (C + ALPHA * (n + 1)), so the probabilities of all known
tokens and of one unknown token in each class add up to one.

All rows that may be learned from are counted, and all are trained on. A first round over START_ROWS of them in one task gives vectors
that mean the same everywhere; then every task goes over all its own rows from there, and a row of sums for each task is added up, so
that each class's vectors are averaged by how often a task saw the class. What is gathered grows with the corpus; the model doesn't.

Each text is read twice: to count, and to be written as class numbers. Counts of the FREQUENT most frequent tokens (a fixed bound) go to
all workers; the other tokens' counts are joined by the token, and none of these can be common among the rows learned from.

Defined cases: null and empty texts are an end alone; without any row to learn from all classes are almost alike and no token is known; null ids
count as the empty text where the held-out share is chosen; repeated rows get the same score and each is counted; a very long text is coded
and scored whole, CHUNK tokens at a time; a token of any length is one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialise, read
from .langid import held_out_share

OWN, ENDINGS = 192, 64
CLASSES = OWN + ENDINGS
#: Last bytes of a token that tell its class, if it has none of its own.
ENDING = 3
ORDER, DIM, NOISE = 3, 16, 32
STEP, BATCH = 0.05, 1024
#: Rows that the common start is learned from, about so many, drawn by hash.
START_ROWS = 4096
ALPHA = 0.1
#: Tokens whose counts every worker has.
FREQUENT = 1 << 17
#: Different tokens that a task counts before it hands them on.
HELD = 1 << 19
#: Tokens scored at once.
CHUNK = 1024
#: Tasks that add up what the tasks of a round have learned.
ADDERS = 16
#: What ends a text; no word holds a line break.
END = b"\n"


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text in lower case, and its end."""
    return [*(text or b"").lower().split(), END]


def ending(token: bytes) -> int:
    return OWN + zlib.crc32(token[-ENDING:]) % ENDINGS


def _ending_of(token: str):
    return F.lit(OWN) + F.crc32(F.expr(f"substring({token}, greatest(length({token}) - {ENDING - 1}, 1), {ENDING})")) % ENDINGS


@dataclass
class Vocabulary:
    """What was counted: all tokens (token, n), their sum and number; of the OWN most frequent ones in order, then the other frequent ones, their place, class and count; of each class
    its count (all tokens in it), and of an ending's class log10 of what its tokens' shares are of."""

    counts: DataFrame
    total: int
    distinct: int
    place: dict[bytes, int]
    of: np.ndarray
    n: np.ndarray
    class_n: np.ndarray
    class_log: np.ndarray

    @property
    def end(self) -> int:
        """The class of a text's end."""
        k = self.place.get(END)
        return ending(END) if k is None else int(self.of[k])


def _least(counts: DataFrame) -> int:
    """The least count from which on there are FREQUENT tokens at most, by steps of a sixteenth of a power of two."""
    step = F.floor(F.log2("n") * 16 + 1e-9).cast("int")
    there = sorted(((r.step, r.k) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # a row for each step
    size, least = 0, 62 * 16
    for step, k in there:
        size += k
        if size > FREQUENT:
            break
        least = step
    return int(np.ceil(2 ** (least / 16) * (1 - 1e-9)))


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """Counts all tokens of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
            if len(held) >= HELD:
                yield told()
                held.clear()
        yield told()

    each = batched(docs).select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "token binary, n bigint")
    counts = materialise(each.groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    own = [bytes(r.token) for r in counts.orderBy(F.desc("n"), "token").limit(OWN).collect()]
    frequent = counts.filter(F.col("n") >= _least(counts)).toArrow()  # FREQUENT rows at most
    n_of = dict(zip(frequent.column("token").to_pylist(), frequent.column("n").to_pylist(), strict=True))
    n_of |= {bytes(r.token): r.n for r in counts.filter(F.col("token").isin(own)).collect()}
    place = {t: i for i, t in enumerate(dict.fromkeys([*own, *sorted(n_of)]))}
    n = np.array([n_of[t] for t in place], np.int64)
    of = np.array([i if i < OWN else ending(t) for i, t in enumerate(place)], np.int16)
    class_n, class_log = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[: min(OWN, len(n))] = n[:OWN]
    class_log[OWN:] = np.log10(ALPHA)
    for r in counts.filter(~F.col("token").isin(own)).groupBy(_ending_of("token").alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        class_n[r["class"]] = r.n
        class_log[r["class"]] = np.log10(r.n + ALPHA * (r.kinds + 1))
    return Vocabulary(counts, int(sums.total), int(sums.distinct), place, of, n, class_n, class_log)


def coded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: row (a number of its own), id, carried columns, n_tokens, classes (of the tokens in order, 16 bits each), and of
    the frequent tokens n_known, base (sum of log10(c + ALPHA)) and inside (of log10 of their shares in their classes; of other tokens what these are
    of); rare: the other tokens, each with its number."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.place, vocabulary.of, np.log10(vocabulary.n + ALPHA), vocabulary.class_log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, of, log_n, class_log = shared.value
        share = log_n - class_log[of]
        share[:OWN] = 0.0
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                own = tokens(text)
                at = np.fromiter(map(place.get, own, repeat(-1)), np.int32, len(own))
                known = at >= 0
                if known.all():
                    out.append((len(own), of[at].tobytes(), len(own), float(log_n[at].sum()), float(share[at].sum()), []))
                    continue
                seen = at[known]
                other = np.flatnonzero(~known).tolist()
                classes = np.empty(len(own), np.int16)
                classes[known] = of[seen]
                classes[other] = [ending(own[i]) for i in other]
                rare = Counter(own[i] for i in other)
                inside = float(share[seen].sum() - class_log[classes[other]].sum())
                out.append((len(own), classes.tobytes(), len(seen), float(log_n[seen].sum()), inside, [{"token": t, "n": k} for t, k in rare.items()]))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())])))
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "n_tokens", "classes", "n_known", "base", "inside", "rare"])

    rows = batched(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *[F.col(c) for c in carry], F.col(text_col).cast("binary").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kept}, n_tokens bigint, classes binary, n_known bigint, base double, inside double, rare array<struct<token: binary, n: bigint>>")


@dataclass
class Net:
    """Vectors of classes in contexts and as what is predicted, matrices of the places before, biases."""

    context: np.ndarray
    target: np.ndarray
    places: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, class_n: np.ndarray) -> Net:
        rng = np.random.default_rng(12)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        places = np.stack([np.eye(DIM, dtype=np.float32) / (k + 1) for k in range(ORDER)])
        share = (class_n + 0.5) / (class_n.sum() + 0.5 * len(class_n))
        return cls(small(len(class_n), DIM), small(len(class_n), DIM), places, np.log(share).astype(np.float32))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.target, self.bias[:, None], self.places

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """The vectors that the tokens before predict for x[ORDER:]."""
        seen, n = self.context[x], len(x) - ORDER
        return sum(seen[ORDER - k : ORDER - k + n] @ self.places[k - 1] for k in range(1, ORDER + 1))

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """log10 of the probability of each of x[ORDER:] after what stands before it."""
        told, ones = np.empty(len(x) - ORDER), np.ones(len(self.bias), np.float32)
        for a in range(0, len(told), CHUNK):
            part = x[a : a + CHUNK + ORDER]
            each = self.predicted(part) @ self.target.T
            each += self.bias
            own = each[np.arange(len(each)), part[ORDER:]].astype(np.float64)
            most = each.max(1)
            each -= most[:, None]
            np.exp(each, out=each)
            told[a : a + CHUNK] = own - most - np.log(each @ ones)
        return told / np.log(10)


class Trainer:
    """Steps of noise-contrastive estimation from a net on."""

    def __init__(self, net: Net, share: np.ndarray, step: float, seed: int):
        self.net = Net(*(p.copy() for p in (net.context, net.target, net.places, net.bias)))
        self.share, self.step = share, step
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.spread = np.cumsum(share)
        self.spread /= self.spread[-1]
        self.seen = [np.full(p.shape, 1e-2, np.float32) for p in self.net.parts()]

    def _down(self, k: int, at, gradient: np.ndarray) -> None:
        part = self.net.parts()[k]
        self.seen[k][at] += gradient * gradient
        part[at] -= self.step * gradient / np.sqrt(self.seen[k][at])

    def learn(self, x: np.ndarray, counts: np.ndarray) -> None:
        """One step on x[ORDER:]; counts: 1 where a token counts, 0 where it only fills up."""
        net, n = self.net, len(x) - ORDER
        seen, target = net.context[x], x[ORDER:]
        before = [seen[ORDER - k : ORDER - k + n] for k in range(1, ORDER + 1)]
        h = sum(b @ net.places[k] for k, b in enumerate(before))
        noise = np.searchsorted(self.spread, self.rng.random(NOISE), side="right").clip(0, len(self.share) - 1)
        own = net.target[target]
        real = np.einsum("ij,ij->i", h, own) + net.bias[target] - self.log_noise[target]
        other = h @ net.target[noise].T + (net.bias[noise] - self.log_noise[noise])
        g = -counts / (1 + np.exp(np.clip(real, -30, 30)))
        gn = counts[:, None] / (1 + np.exp(-np.clip(other, -30, 30)))
        dh = g[:, None] * own + gn @ net.target[noise]
        rows = np.zeros((len(x), 2 * DIM + 1), np.float32)  # by token: as context, as target, bias
        rows[ORDER:, DIM : 2 * DIM] = g[:, None] * h
        rows[ORDER:, 2 * DIM] = g
        matrices = np.empty_like(net.places)
        for k in range(1, ORDER + 1):
            matrices[k - 1] = before[k - 1].T @ dh
            rows[ORDER - k : ORDER - k + n, :DIM] += dh @ net.places[k - 1].T
        order = np.argsort(x, kind="stable")
        sorted_x = x[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_x[1:] != sorted_x[:-1]]))
        at, sums = sorted_x[first], np.add.reduceat(rows[order], first)
        whole = np.zeros((len(self.share), DIM + 1), np.float32)
        whole[at] = sums[:, DIM:]
        np.add.at(whole, noise, np.concatenate([gn.T @ h, gn.sum(0)[:, None]], 1))
        self._down(0, at, sums[:, :DIM])
        self._down(1, slice(None), whole[:, :DIM])
        self._down(2, slice(None), whole[:, DIM:])
        self._down(3, slice(None), matrices)


def _streams(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes of a batch's texts one after the other, each behind ORDER ends that only fill up; whether each counts; where each text
    begins (with its ends)."""
    filler, parts, starts, size = np.full(ORDER, end, np.int16), [], [], 0
    for x in batch.column("classes").to_pylist():
        parts += [filler, np.frombuffer(x, np.int16)]
        starts.append(size)
        size += ORDER + len(parts[-1])
    x = np.concatenate(parts)
    counts = np.ones(len(x), np.float32)
    for k in range(ORDER):
        counts[np.array(starts) + k] = 0
    return x, counts, np.array(starts)


def _packed(net: Net, weight: np.ndarray, total: float) -> bytes:
    """A task's sums: parts times weights, and the weights."""
    wide = [(p * weight[:, None]).astype(np.float64).ravel() for p in (net.context, net.target, net.bias[:, None])]
    return np.concatenate([*wide, net.places.astype(np.float64).ravel() * total, weight, [total]]).tobytes()


def _averaged(sums: np.ndarray, net: Net) -> Net:
    k, d = net.context.shape
    at = np.cumsum([k * d, k * d, k, ORDER * d * d, k])
    context, target, bias, places, weight, total = np.split(sums, at)
    by, some = np.maximum(weight, 1e-12)[:, None], (weight > 0)[:, None]
    mean = lambda part, was: np.where(some, part.reshape(k, -1) / by, was).astype(np.float32)
    return Net(mean(context, net.context), mean(target, net.target), (places / max(total[0], 1e-12)).reshape(net.places.shape).astype(np.float32) if total[0] else net.places, mean(bias, net.bias[:, None])[:, 0])


def _round(rows: DataFrame, net: Net, share: np.ndarray, end: int, step: float) -> Net:
    """rows: row, classes. Every task goes once over its rows from net; the driver gets ADDERS rows of sums."""
    shared = rows.sparkSession.sparkContext.broadcast((net, share, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, weight, name = None, np.zeros(CLASSES), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if trainer is None:
                name = batch.column("row")[0].as_py()
                trainer = Trainer(*shared.value, seed=name % (1 << 32))
            x, counts, _ = _streams(batch, end)
            weight += np.bincount(x, counts, CLASSES)
            for a in range(0, len(x) - ORDER, BATCH):
                trainer.learn(x[a : a + BATCH + ORDER], counts[a + ORDER : a + BATCH + ORDER])
        if trainer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([_packed(trainer.net, weight, weight.sum())], pa.binary())], ["task", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                total = np.frombuffer(x).copy() if total is None else total + np.frombuffer(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    learned = materialise(rows.mapInArrow(run, "task bigint, sums binary"), "learned", random=True)
    added = learned.repartition(ADDERS, "task").sortWithinPartitions("task").select("sums").mapInArrow(add, "sums binary").collect()
    return _averaged(np.sum([np.frombuffer(r.sums) for r in added], axis=0), net) if added else net


def train(rows: DataFrame, vocabulary: Vocabulary) -> Net:
    """rows: row, classes, as ``coded`` has them."""
    share = (vocabulary.class_n + 0.5) / (vocabulary.class_n.sum() + 0.5 * CLASSES)
    rows = rows.select("row", "classes")
    part = min(1.0, START_ROWS / max(1, rows.count()))
    drawn = rows.filter(F.abs(F.xxhash64("row", F.lit(12))) / F.lit(float(1 << 63)) <= part).repartition(1).sortWithinPartitions("row")
    net = _round(drawn, Net.start(vocabulary.class_n), share, vocabulary.end, STEP)
    return _round(rows, net, share, vocabulary.end, STEP / 2)


def scored(rows: DataFrame, vocabulary: Vocabulary, net: Net) -> DataFrame:
    """rows as ``coded`` has them, with n_known, base_score and score of each text."""
    shared, end = rows.sparkSession.sparkContext.broadcast(net), vocabulary.end
    others = [c for c in rows.columns if c not in ("classes", "rare")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.zeros(0)
            if batch.num_rows:
                x, counts, starts = _streams(batch, end)
                each = np.concatenate([np.zeros(ORDER), shared.value.log_probabilities(x)])
                told = np.add.reduceat(each * counts, starts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(told, pa.float64())], [*others, "told"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in others)
    each = rows.select(*others, "classes").mapInArrow(run, f"{kinds}, told double")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    log = F.log10(F.coalesce("n", F.lit(0)) + ALPHA) * F.col("times")
    rare = rare.join(vocabulary.counts, "token", "left").groupBy("row").agg(F.sum(log).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    joined = each.join(rare, "row", "left").withColumn("rare_log", F.coalesce("rare_log", F.lit(0.0)))
    whole = float(np.log10(vocabulary.total + ALPHA * (vocabulary.distinct + 1)))
    return joined.select(
        *[c for c in others if c not in ("row", "n_known", "base", "inside")], (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.col("rare_log") - F.col("n_tokens") * whole).alias("base_score"), (F.col("told") + F.col("inside") + F.col("rare_log")).alias("score"),
    )


def op12_log_bilinear(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (held_out_share("doc_id", 10) == 0).alias("held_out"))
    known = vocabulary(docs.filter("not held_out"))
    rows = materialise(coded(docs, known, carry=("held_out",)), "token-classes")
    net = train(rows.filter("not held_out"), known)
    found = scored(rows, known, net)
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")
