"""Language-model scoring with a weighted backoff automaton.

States are the empty history (the root) and every word and word pair that occurs
twice in the training texts. A state has an arc, with a discounted log10
probability, for each continuation that occurs twice after it, and one failure
arc that leads to the state of the next shorter history and carries the backoff
weight (Katz: what the arcs leave, over what the shorter history would give the
same words). The root has an arc for each known word and one for all unknown words.

The n-grams of one order are found by counting those whose two parts are held
(level by level). The automaton of a small corpus travels to the tasks. That of a
larger one stays dealt out (backoff_tables.py): texts are cut into chunks, each
asks the buckets of a hash for what its own n-grams weigh. No n-gram is left out at
any size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import backoff_tables
from .backoff_tables import DISCOUNT, END, START, token_stream
from .common import by_row, store
from .wordvec import LOWER_TABLE, as_bytes, batches

#: Bytes of all texts up to which the automaton is built whole and travels to the tasks.
SMALL_BYTES = 16 << 20


def find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The index in sorted keys of each value, -1 where it is absent."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


class Counter:
    """Adds up counts of keys and gives them out in tables of bounded size."""

    def __init__(self, limit: int = 1_000_000) -> None:
        self.parts, self.size, self.limit = [], 0, limit

    def add(self, keys: np.ndarray) -> bool:
        """Count the keys; True if there is enough to give out."""
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.size += len(found)
        if self.size > self.limit:
            self._merge()
            return self.size > self.limit // 2
        return False

    def _merge(self) -> None:
        found, inverse = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([n for _, n in self.parts]), minlength=len(found)).astype(np.int64)
        self.parts, self.size = [(found, n)], len(found)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        self._merge()
        out, self.parts, self.size = self.parts[0], [], 0
        return out


def _counted(keys_of):
    """A mapInArrow function: counts of keys_of(tokens, doc) over the partition's texts."""

    def run(it):
        counter = Counter()
        for batch in it:
            texts = batch.column(0).to_pylist()
            for part in batches(texts):
                if counter.add(keys_of(*token_stream(as_bytes(texts[part], LOWER_TABLE)))):
                    yield _key_rows(*counter.take())
        yield _key_rows(*counter.take())

    return run


def _key_rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


def _words_only(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return tokens[tokens != START]


@dataclass
class Automaton:
    """words and root: sorted hashes and log10 root arcs of the known words, numbered from 1; the next number is START.

    arcs[k]: sorted keys and log10 weights of the arcs that make n-grams of k+2 words; a key is the number of the
    state it leaves << 32 | the word's number, and arc i leads to state i+1 of its order. backoff[k]: failure
    weights of the states of k+1 words by their number (0: no state).
    """

    words: np.ndarray
    root: np.ndarray
    counts: np.ndarray
    arcs: list = field(default_factory=list)
    backoff: list = field(default_factory=list)

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """Word numbers of tokens, 0 for unknown words."""
        ids = find(self.words, tokens) + 1
        ids[tokens == START] = len(self.words) + 1
        return ids

    def states(self, ids: np.ndarray, doc: np.ndarray, order: int) -> np.ndarray:
        """The number of the state that the `order` words up to each token make, 0 if they make none."""
        return ids if order == 1 else find(self.arcs[order - 2][0], self.keys(ids, doc, order)) + 1

    def keys(self, ids: np.ndarray, doc: np.ndarray, order: int) -> np.ndarray:
        """The arc key of the n-gram that ends at each token; 0 where its first or its last order-1 words are no state."""
        lower = self.states(ids, doc, order - 1)
        before = _before(lower, doc)
        return np.where((before > 0) & (lower > 0), before << 32 | ids, 0)

    def walk(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """log10 weights of the arcs taken from left to right; for an unknown word, without its root arc.

        The states hold each state's suffixes, so the state that the walk carries
        before a token is its longest history that is a state, and the failure arcs
        and the arc it takes depend on that state and the token alone.
        """
        known = (ids > 0) & (ids <= len(self.words))
        weight = np.zeros(len(ids))
        weight[known] = self.root[ids[known] - 1]
        states = ids
        for order, ((keys, logp), fail) in enumerate(zip(self.arcs, self.backoff, strict=True), 2):
            before = _before(states, doc)
            arc = find(keys, np.where((before > 0) & (states > 0), before << 32 | ids, 0))
            weight += fail[before]
            weight[arc >= 0] = logp[arc[arc >= 0]]
            states = arc + 1
        return weight


def _before(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    out[1:] = np.where(doc[1:] == doc[:-1], x[:-1], 0)
    return out


@dataclass
class Trained:
    automaton: Automaton
    tokens: int
    vocabulary: int
    unknown: float
    discount: float


def train(docs: DataFrame, in_training: Column, order: int = 3) -> Trained:
    """Count the training texts and build the automaton, on the driver: for a small corpus. docs(text, ...); null texts count as empty (one end each)."""
    texts = docs.filter(in_training).select("text")
    counts = store(texts.mapInArrow(_counted(_words_only), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    tokens, vocabulary, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    # the mass of words seen once goes to the unknown word, taken evenly from all known words
    discount = (once + 1) / (vocabulary + 2)
    unknown = discount * vocabulary / tokens if tokens else 1.0
    often = counts.toArrow()
    keys, n = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
    by = np.argsort(keys)
    keys, n = keys[by], n[by]
    model = Automaton(keys, np.log10((n - discount) / max(tokens, 1)), n)
    starts = int(n[find(keys, np.array([END]))[0]]) if len(keys) else 0
    state_n = np.r_[0, n, starts].astype(np.float64)  # by state number
    for k in range(2, order + 1):
        key, n = _ngrams(texts, model, state_n >= 2 if k == 2 else None, k)
        prefix = key >> 32
        p = (n - DISCOUNT) / np.maximum(state_n[prefix], n)
        lower = 10.0 ** _lower(model, key, k)
        arcs_p, arcs_lower = (np.bincount(prefix, weights=x, minlength=len(state_n)) for x in (p, lower))
        left = np.log10(np.maximum(1 - arcs_p, 1e-9) / np.maximum(1 - arcs_lower, 1e-9))
        left[arcs_p == 0] = 0
        model.arcs.append((key, np.log10(p)))
        model.backoff.append(left)
        state_n = np.r_[0, n].astype(np.float64)
    return Trained(model, tokens, vocabulary, unknown, discount)


def _lower(model: Automaton, key: np.ndarray, k: int) -> np.ndarray:
    """log10 of the last word of each n-gram after its history without the first word, by the orders built so far."""
    n = len(key)
    grams = np.empty((n, k), np.int64)
    for j in range(k - 1, 0, -1):
        grams[:, j] = key & 0xFFFFFFFF
        key = key >> 32
        if j > 1:
            key = model.arcs[j - 2][0][key - 1]
    return model.walk(grams[:, 1:].ravel(), np.repeat(np.arange(n), k - 1)).reshape(n, k - 1)[:, -1] if n else np.empty(0)


def _ngrams(texts: DataFrame, model: Automaton, frequent: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted arc keys of the n-grams of order k with two or more places, and their counts."""

    def keys_of(tokens, doc):
        ids = model.numbers(tokens)
        if frequent is not None:  # rare words are in no frequent pair
            ids = np.where(frequent[ids] | (ids == len(model.words) + 1), ids, 0)
        key = model.keys(ids, doc, k)
        return key[key > 0].view(np.uint64)

    counted = texts.mapInArrow(_counted(keys_of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.filter("n >= 2").toArrow()
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    by = np.argsort(key)
    return key[by], n[by]


def _score_rows(model_of, tokens: int, vocabulary: int, unknown: float):
    def run(it):
        model = model_of.value
        base_of = np.log10((np.r_[0, model.counts] + 1) / (tokens + vocabulary + 1))
        for batch in it:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            for part in batches(texts):
                stream, doc = token_stream(as_bytes(texts[part], LOWER_TABLE))
                ids = model.numbers(stream)
                real = stream != START
                weight = model.walk(ids, doc) + np.where(ids == 0, np.log10(max(unknown, 1e-300)), 0.0)
                base = base_of[np.where(real, ids, 0)]
                sums = [np.bincount(doc[real], weights=x[real], minlength=part.stop - part.start) for x in (np.ones(len(ids)), ids > 0, base, weight)]
                rows = [docs[part.start : part.stop], *(pa.array(x.astype(np.int64)) for x in sums[:2]), *(pa.array(x) for x in sums[2:])]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, in_training: Column, order: int = 3) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs(doc_id, text, ...).

    Tokens are the words (runs without bytes 9-13 and 32, A-Z lower-cased) and one
    end; in_training picks the rows to learn from. base_score is the add-one
    unigram log10 probability, score that of the automaton; both share one event
    for all unknown words. Null and empty texts are the end alone; with no
    training rows every token is unknown. Null and repeated doc_ids are rows of their
    own; other columns are not read, but those that in_training names; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    return by_row(docs.select("doc_id", "text", in_training.alias("training")), lambda rows: _scored(rows, F.col("training"), order))


def _scored(docs: DataFrame, in_training: Column, order: int) -> DataFrame:
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > SMALL_BYTES:
        scored, tokens = backoff_tables.score(docs.select("doc_id", F.coalesce(in_training, F.lit(False)).alias("training"), "text"), schema, order, size)
    else:
        trained = train(docs, in_training, order)
        tokens, model = trained.tokens, docs.sparkSession.sparkContext.broadcast(trained.automaton)
        scored = docs.select("doc_id", "text").mapInArrow(_score_rows(model, tokens, trained.vocabulary, trained.unknown), schema)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
