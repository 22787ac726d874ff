"""The weighted backoff automaton of a corpus of any size, dealt out by the hash of its n-grams.

Texts are cut into chunks of some megabytes, stored as word numbers. For each order
a chunk sends its different n-grams, with their training counts, to the buckets of
a hash; a bucket adds up what all chunks sent and answers each with the sums. An
n-gram is sent if both its parts occur twice, which the answers of the order before
told. In the same way buckets add up the arcs that leave each history and answer
with its backoff weight. A chunk then has all its own n-grams weigh and walks its
texts. A chunk and a bucket are bounded, whatever the corpus is.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .wordvec import LOWER_TABLE, as_bytes, batches, mix, words

DISCOUNT = 0.5
START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: Bytes of text of a chunk, and of all texts for each bucket.
CHUNK, BUCKET = 4 << 20, 12 << 20
#: Times that backoff weights are asked for, those of a part of the buckets each, and that texts are walked, a part of the chunks each, so that only that part of a shuffle is on the disk at once.
PARTS = 2
ANSWER = "level int, bucket int, chunk long, answer binary, tokens long, vocabulary long, once long"
SENT = "level int, bucket int, chunk long, keys binary, x binary, y binary"


def token_stream(raw: list[bytes]):
    """(tokens, doc): START, the words and END of each text, in order."""
    w = words(raw)
    n = len(raw)
    size = w.counts + 2
    first = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint64)
    out[first], out[first + size - 1] = START, END
    out[np.arange(len(w.hashes)) + 2 * w.doc + 1] = w.hashes
    return out, np.repeat(np.arange(n), size)


def _packed(x: np.ndarray) -> bytes:
    """The bytes of an array, first ones first, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return x.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, kind) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, by their differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64)


def _chunk_rows(limit: int, schema: pa.Schema):
    """A mapInArrow function: chunks of about `limit` bytes of texts(doc_id, training, text)."""

    def run(it):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def row():
            ids, training, streams, docs = zip(*held, strict=True)
            found, at = np.unique(np.concatenate(streams), return_inverse=True)
            sizes = np.concatenate([np.bincount(x) for x in docs]).astype(np.int32)
            values = [number, np.concatenate(training).tobytes(), _packed(sizes), _packed_keys(found), _packed(at.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, schema, strict=False)] + [pa.array([[x for part in ids for x in part]], schema[-1].type)], schema=schema)

        for batch in it:
            texts, training = batch.column(2).to_pylist(), np.asarray(batch.column(1).to_pylist(), bool)
            for part in batches(texts):
                raw = as_bytes(texts[part], LOWER_TABLE)
                held.append((batch.column(0)[part.start : part.stop].to_pylist(), training[part], *token_stream(raw)))
                size += sum(len(x) + 16 for x in raw)
                if size >= limit:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    return run


class _Chunk:
    """A chunk's tokens, and by level, for those n-grams of it that are asked for: sorted keys, which of them ends at each token (-1: none), counts and owned keys as answered."""

    def __init__(self, row: dict, answers: list[dict], order: int) -> None:
        self.id, self.ids = row["chunk"], row["ids"]
        sizes = _unpacked(row["sizes"], np.int32)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.training = np.frombuffer(row["training"], bool)[self.doc]
        found, t = _unpacked_keys(row["words"]), _unpacked(row["stream"], np.int32)
        self.tokens = found[t]
        self.same = np.r_[False, self.doc[1:] == self.doc[:-1]]
        self.keys, self.at, self.counts, self.owned = {1: found}, {1: t}, {}, {}
        key = self.tokens
        for k in range(1, order + 1):
            if k > 1:
                ok = self.held(k - 1)
                ok = ok & np.r_[False, ok[:-1]] & self.same
                key = np.where(ok, mix(np.r_[np.uint64(0), key[:-1]] * np.uint64(0x9E3779B97F4A7C15) + self.tokens), np.uint64(0))
                self.keys[k], inverse = np.unique(key[ok], return_inverse=True)
                self.at[k] = np.full(len(key), -1)
                self.at[k][ok] = inverse
            if got := self.answered(answers, k, np.int64):
                self.counts[k], self.owned[k] = got[0] >> 1, (got[0] & 1).astype(bool)

    @staticmethod
    def answered(answers: list[dict], level: int, kind) -> list[np.ndarray]:
        """The answers to what was sent at a level, joined in the order of the keys: none if there are none."""
        found = [_unpacked(x["answer"], kind) for x in sorted((x for x in answers if x["level"] == level), key=lambda x: x["bucket"])]
        return [np.concatenate(found)] if found else []

    def count(self, k: int) -> np.ndarray:
        """Of the n-gram of k words that ends at each token, its count; 0 where it is not asked for."""
        if k not in self.counts:  # it has no such n-gram
            return np.zeros(len(self.doc), np.int64)
        return np.where(self.at[k] >= 0, self.counts[k][self.at[k]], 0)

    def held(self, k: int) -> np.ndarray:
        return self.count(k) >= 2

    def states(self, k: int) -> np.ndarray:
        """Which of its n-grams of k words occur twice."""
        return self.counts[k] >= 2 if k in self.counts else np.zeros(len(self.keys[k]), bool)

    def before(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.same, np.r_[x[:1], x[:-1]], 0)

    def p(self, k: int) -> np.ndarray:
        """The probability of the arc of the n-gram of k > 1 words that ends at each token; only where it is held."""
        n = self.count(k)
        return (n - DISCOUNT) / np.maximum(np.maximum(self.before(self.count(k - 1)), n), 1)

    def sent(self, level: int, keys: np.ndarray, buckets: int, x: np.ndarray, y: np.ndarray | None = None, part: int | None = None) -> list[dict]:
        edge = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        return [
            {"level": level, "bucket": b, "chunk": self.id, "keys": _packed_keys(keys[i:j]), "x": _packed(x[i:j]), "y": None if y is None else _packed(y[i:j])}
            for b, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if j > i and part in (None, b % PARTS)
        ]


def _ask(k: int, buckets: int, schema: pa.Schema):
    """A function of a chunk and its answers: its n-grams of k words and their counts in its training texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _Chunk(left.to_pylist()[0], right.to_pylist(), k)
        n = np.bincount(c.at[k][(c.at[k] >= 0) & c.training], minlength=len(c.keys[k]))
        return pa.Table.from_pylist(c.sent(k, c.keys[k], buckets, n.astype(np.int64)), schema)

    return run


def _ask_backoff(order: int, buckets: int, part: int, rates: tuple, schema: pa.Schema):
    """The same for its histories of a part of the buckets: what their arcs take, and what the shorter history gives the same words. An n-gram counts in the chunk that owns it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _Chunk(left.to_pylist()[0], right.to_pylist(), order)
        rows, lower = [], 10.0 ** _roots(c, *rates)
        for k in range(2, order + 1):
            p, history = c.p(k), c.at[k - 1]
            if k in c.counts:
                mine = c.owned[k] & (c.counts[k] >= 2)
                place = np.full(len(mine), -1)
                place[c.at[k][c.at[k] >= 0]] = np.flatnonzero(c.at[k] >= 0)
                place = place[mine]
                sums = [np.bincount(history[place - 1], weights=x[place], minlength=len(c.keys[k - 1])) for x in (p, lower)]
            else:
                sums = [np.zeros(len(c.keys[k - 1]))] * 2
            some = c.states(k - 1)
            rows += c.sent(-(k - 1), c.keys[k - 1][some], buckets, *(x[some] for x in sums), part=part)
            lower = p
        return pa.Table.from_pylist(rows, schema)

    return run


def _roots(c: _Chunk, tokens: int, vocabulary: int, discount: float) -> np.ndarray:
    """log10 of the root arc of each token."""
    n = c.count(1)
    unknown = discount * vocabulary / tokens if tokens else 1.0
    return np.log10(np.maximum(np.where(n > 0, (n - discount) / max(tokens, 1), unknown), 1e-300))


def _summed(schema: pa.Schema):
    """A function of a bucket: counts (twice, and one more for the chunk that owns the n-gram), or of level -k the backoff weights of histories of k words, as 32-bit numbers."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        level, rows = table.column("level")[0].as_py(), table.to_pylist()
        keys = [_unpacked_keys(r["keys"]) for r in rows]
        _, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        once = tokens = vocabulary = 0
        if level > 0:
            n = np.bincount(inverse, weights=np.concatenate([_unpacked(r["x"], np.int64) for r in rows])).astype(np.int64)
            if level == 1:
                words_n = n[np.concatenate(keys)[first] != START]
                tokens, vocabulary, once = int(words_n.sum()), int((words_n > 0).sum()), int((words_n == 1).sum())
            out = 2 * n[inverse]
            out[first] += 1
        else:
            p, lower = (np.bincount(inverse, weights=np.concatenate([_unpacked(r[c], np.float64) for r in rows])) for c in "xy")
            left = np.log10(np.maximum(1 - p, 1e-9) / np.maximum(1 - lower, 1e-9))
            out = np.where(p == 0, 0.0, left).astype(np.float32)[inverse]
        ends = np.cumsum([len(k) for k in keys])
        rows = [{"level": level, "bucket": r["bucket"], "chunk": r["chunk"], "answer": _packed(x)} for r, x in zip(rows, np.split(out, ends[:-1]), strict=True)]
        rows = [r | {"tokens": 0, "vocabulary": 0, "once": 0} for r in rows]
        rows[0] |= {"tokens": tokens, "vocabulary": vocabulary, "once": once}
        return pa.Table.from_pylist(rows, schema)

    return run


def _walk(order: int, rates: tuple, schema: pa.Schema):
    """A function of a chunk and its answers: the scores of its texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.to_pylist()
        c = _Chunk(left.to_pylist()[0], answers, order)
        weight = _roots(c, *rates)
        for k in range(2, order + 1):
            fail = c.answered(answers, -(k - 1), np.float32)
            if fail:
                by_key = np.zeros(len(c.keys[k - 1]))
                by_key[c.states(k - 1)] = fail[0]
                weight += c.before(np.where(c.at[k - 1] >= 0, by_key[c.at[k - 1]], 0.0))
            held = c.held(k)
            weight[held] = np.log10(c.p(k)[held])
        real, n = c.tokens != START, c.count(1)
        base = np.log10((n + 1) / (rates[0] + rates[1] + 1))
        sums = [np.bincount(c.doc[real], weights=x[real], minlength=len(c.ids)) for x in (np.ones(len(n)), n > 0, base, weight)]
        return pa.Table.from_arrays([pa.array(c.ids, schema[0].type), *(pa.array(x.astype(np.int64)) for x in sums[:2]), *(pa.array(x) for x in sums[2:])], schema=schema)

    return run


def score(docs: DataFrame, schema: str, order: int, size: int) -> tuple[DataFrame, int]:
    """The scores of docs(doc_id, training, text), whose texts have `size` bytes, as `schema` names them, and the number of training tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    arrow = lambda ddl: to_arrow_schema(spark.createDataFrame([], ddl).schema)
    sent, answer = arrow(SENT), arrow(ANSWER)
    form = f"chunk long, training binary, sizes binary, words binary, stream binary, ids array<{docs.schema['doc_id'].dataType.simpleString()}>"
    chunks = store(docs.mapInArrow(_chunk_rows(CHUNK, arrow(form)), form), "chunks")
    buckets = max(1, -(-size // BUCKET))
    answers, rates = [spark.createDataFrame([], ANSWER)], ()

    def by_chunk(work, columns: str, of: Column | bool = True) -> DataFrame:
        told = reduce(DataFrame.unionByName, answers).select("chunk", "level", "bucket", "answer")
        here = F.lit(of) if isinstance(of, bool) else of
        return chunks.filter(here).groupBy("chunk").cogroup(told.filter(here).groupBy("chunk")).applyInArrow(work, columns)

    def ask(work) -> DataFrame:
        return store(by_chunk(work, SENT).groupBy("level", "bucket").applyInArrow(_summed(answer), ANSWER), "answers")

    for k in range(1, order + 1):
        answers.append(ask(_ask(k, buckets, sent)))
        if k == 1:
            tokens, vocabulary, once = answers[-1].select(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "vocabulary", "once"))).first()
            # the mass of words seen once goes to the unknown word, taken evenly from all known words
            rates = (tokens, vocabulary, (once + 1) / (vocabulary + 2))
    weights = [ask(_ask_backoff(order, buckets, part, rates, sent)) for part in range(PARTS)]
    answers += weights
    dealt = F.pmod(F.xxhash64("chunk"), F.lit(PARTS))
    walked = [store(by_chunk(_walk(order, rates, arrow(schema)), schema, dealt == part), "walked") for part in range(PARTS)]
    return reduce(DataFrame.unionByName, walked), tokens
