"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network with calibrated probabilities.

Random indexing: each token bucket has a fixed sparse index vector of a few +1
and -1, and its context vector adds up the index vectors of its neighbours in
all documents. A text's features are the mean of its tokens' vectors (context,
scaled to length one, plus the bucket's own index vector) and its log length.
The network (numpy, on the driver) learns from a bounded sample of labelled
texts; a temperature, chosen on labelled texts it did not learn from, calibrates
its probabilities.

Tokens are runs of letters and digits (A-Z lower-cased) and runs of other
characters; a word in capitals and a word that repeats the one before are
followed by a mark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..shipping import ship
from .common import crc_mod
from .wordvec import LOWER_TABLE, SPACES, as_bytes, batches, mix, span_hashes

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 2, 2
#: The most labelled texts that the network learns from (those of the least hash of doc_id).
SAMPLE = 8_000
HIDDEN, EPOCHS, RATE, DECAY = 16, 400, 0.02, 1e-4
_CAPS, _SAME = 0, 1

_KIND = np.where(SPACES, 0, 2).astype(np.int8)
_KIND[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = 1


def tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, doc) of the tokens of a batch, in order."""
    data = b"\n".join(raw) + b"\n"
    plain = np.frombuffer(data, np.uint8)
    lower = np.frombuffer(data.translate(LOWER_TABLE), np.uint8)
    kind = _KIND[plain]
    edge = np.flatnonzero(np.diff(kind)) + 1
    edge = np.r_[0, edge]
    starts = edge[kind[edge] > 0]
    ends = np.r_[edge[1:], len(plain)][kind[edge] > 0]
    h = span_hashes(lower, starts, ends)
    word = kind[starts] == 1
    upper = (plain[starts] != lower[starts]) & (plain[np.minimum(starts + 1, len(plain) - 1)] != lower[np.minimum(starts + 1, len(plain) - 1)]) & (ends - starts > 1)
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=begins[1:])
    doc = np.repeat(np.arange(len(raw)), np.diff(np.searchsorted(starts, begins)))
    words = np.flatnonzero(word)
    same = np.zeros(len(h), bool)
    same[words[1:]] = (h[words[1:]] == h[words[:-1]]) & (doc[words[1:]] == doc[words[:-1]])
    bucket = (h >> np.uint64(40)).astype(np.int64) % (BUCKETS - 2) + 2
    times = 1 + (upper & word) + same
    at = np.repeat(np.arange(len(h)), times)
    out = bucket[at]
    end = np.cumsum(times) - 1
    out[end[same]] = _SAME
    out[(end - same)[upper & word]] = _CAPS
    return out, doc[at]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero elements of each bucket's index vector."""
    r = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, NONZERO)
    return ((r >> np.uint64(8)) % np.uint64(DIM)).astype(np.int64), np.where(r & np.uint64(1), 1.0, -1.0)


def _context_rows(it):
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for batch in it:
        texts = batch.column(0).to_pylist()
        for part in batches(texts):
            bucket, doc = tokens(as_bytes(texts[part]))
            for far in range(1, REACH + 1):
                near = np.flatnonzero(doc[far:] == doc[:-far])
                for a, b in ((bucket[near], bucket[near + far]), (bucket[near + far], bucket[near])):
                    for z in range(NONZERO):
                        total += np.bincount(a * DIM + place[b, z], weights=sign[b, z], minlength=len(total))
    total = total.reshape(BUCKETS, DIM)
    rows = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(rows)] + [pa.array(total[rows, d].astype(np.int64)) for d in range(DIM)], names=["bucket", *[f"v{d}" for d in range(DIM)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) vectors from all texts. Sums of integers, so the same however the texts are partitioned."""
    columns = [f"v{d}" for d in range(DIM)]
    rows = docs.select("text").mapInArrow(_context_rows, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    summed = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    vectors = np.zeros((BUCKETS, DIM))
    at = summed.column("bucket").to_numpy()
    vectors[at] = np.stack([summed.column(c).to_numpy() for c in columns], axis=1) if len(at) else 0
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    place, sign = index_vectors()
    for z in range(NONZERO):
        np.add.at(vectors, (np.arange(BUCKETS), place[:, z]), sign[:, z])
    return vectors.astype(np.float32)


def features(raw: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """(n, DIM + 1): the mean vector of each text (zero without tokens) and the log of its number of tokens."""
    bucket, doc = tokens(raw)
    out = np.zeros((len(raw), DIM + 1))
    n = np.bincount(doc, minlength=len(raw))
    some = np.flatnonzero(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        out[some, :DIM] = np.add.reduceat(vectors[bucket], first, axis=0) / n[some, None]
    out[:, DIM] = np.log1p(n)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Train by Adam on the whole sample; with one class or none the network answers with the smoothed share of ones."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(DIM + 1), np.ones(DIM + 1))
    share = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(0)
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(DIM + 1), (DIM + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    z = (x - mean) / scale
    params = [net.w1, net.b1, rng.normal(0, 0.1, HIDDEN), np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
        g = (p - y) / len(y)
        back = np.outer(g, params[2]) * (1 - h * h)
        grads = [z.T @ back + DECAY * params[0], back.sum(axis=0), h.T @ g + DECAY * params[2], np.array([g.sum()])]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """Set the temperature that makes the held-back labels likeliest."""
    if len(np.unique(y)) < 2:
        return
    logits = net.logits(x)

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, logits / t) - y * logits / t))

    net.temperature = min(np.geomspace(0.5, 8, 41), key=loss)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, held_back: Column) -> tuple[np.ndarray, Network]:
    """Word vectors of all texts, and the network from labelled rows where may_learn holds; held_back picks those for the temperature.

    labels(doc_id, quality, ...): null labels are ignored, repeated ones averaged.
    """
    vectors = word_vectors(docs)
    label = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & may_learn).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    sample = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumn("held_back", held_back)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # of rows that share an id one is learned from, so the sample stays at SAMPLE rows
    joined = joined.groupBy("doc_id").agg(F.min_by("text", F.sha2(F.col("text").cast("binary"), 256)).alias("text"), F.any_value("y").alias("y"), F.any_value("held_back").alias("held_back"))
    bound = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(it):
        for batch in it:
            texts = batch.column(1).to_pylist()
            for part in batches(texts):
                x = features(as_bytes(texts[part]), bound.value)
                rest = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(2), rest.column(3), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "held_back", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = joined.select("doc_id", "text", "y", "held_back").mapInArrow(run, f"doc_id {kind}, y int, held_back boolean, x array<double>").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, DIM + 1)[order]
    y = rows.column("y").to_numpy().astype(float)[order]
    back = np.array(rows.column("held_back").to_pylist(), bool)[order]
    net = fit(x[~back], y[~back])
    calibrate(net, x[back], y[back])
    return vectors, net


def score(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, held_back: Column | None = None, out: str = "score") -> DataFrame:
    """All columns of docs and `out` (one of that name is replaced), the probability from 0 to 1 that `quality` is 1, by the text alone.

    By default a label is learned from unless crc32(doc_id as text) mod 4 is 2, and
    serves the temperature if that is 1. Null and empty texts get a score like any
    other (a zero mean vector), long ones are read whole; rows that share an id, or have
    none, are scored each, and at most one of them is learned from; ties do not matter,
    as rows are judged alone; an empty table gives no rows; without labels all scores are 0.5.
    """
    ship(docs.sparkSession)
    vectors, net = train(docs, labels, crc_mod("doc_id", 4) != 2 if may_learn is None else may_learn, crc_mod("doc_id", 4) == 1 if held_back is None else held_back)
    bound = docs.sparkSession.sparkContext.broadcast((vectors, net))
    docs = docs.drop(out)
    place, names = docs.columns.index("text"), docs.columns

    def run(it):
        vectors, net = bound.value
        for batch in it:
            texts = batch.column(place).to_pylist()
            for part in batches(texts):
                p = net.probability(features(as_bytes(texts[part]), vectors))
                rest = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(p)], names=[*names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, DoubleType()))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score `threshold` or more; odd rows as in score(), a column named __quality aside."""
    return score(docs, labels, out="__quality").filter(F.col("__quality") >= threshold).select(docs.columns)
