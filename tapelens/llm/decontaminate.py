"""Benchmark decontamination: a prefix-filtered set join with exact containment over item-sized windows.

Every benchmark item becomes windows of `n_words` consecutive words (a shorter
item is one window). The words of the benchmark are counted in all documents and
each window is filed under its rarest word: for full containment one prefix
token is enough, as a document that holds the window holds this word. Document
words are looked up among the prefix words; the word's place in the window then
fixes where the window must start (positional bound) and end (length bound), and
the candidate is verified word by word.

The window index goes to the tasks in blocks of a fixed number of windows, so
its size is bounded; a benchmark with more windows takes one reading of the
documents for each block, and the findings of a row are put together by a number
that the row is given, so the result is the same with any number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import by_row, sized_broadcast, store
from .wordvec import WORD_TABLE, as_bytes, batches, span_hashes, words

#: Windows, or benchmark words, that one block sends to the tasks (about 25 MB of windows).
BLOCK = 200_000
#: Candidates, of a word that many windows are filed under, that a task verifies at once.
CANDIDATES = 2_000_000


def _window_rows(n_words: int):
    def run(it):
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            item, lists = [], []
            for part in batches(texts):
                w = words(as_bytes(texts[part], WORD_TABLE))
                for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                    for s in range(a, max(a + (b > a), b - n_words + 1)):
                        item.append(ids[part.start + i].as_py())
                        lists.append(w.hashes[s : min(b, s + n_words)].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(item, ids.type), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "window"])

    return run


def _count_rows(known: np.ndarray | None):
    def run(it):
        for batch in it:
            texts = batch.column(0).to_pylist()
            for part in batches(texts):
                found, n = np.unique(words(as_bytes(texts[part], WORD_TABLE)).hashes.view(np.int64), return_counts=True)
                if known is not None and len(known):
                    hit = known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found
                    found, n = found[hit], n[hit]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["word", "n"])

    return run


def window_index(docs: DataFrame, benchmark: DataFrame, n_words: int) -> DataFrame:
    """(item_id, window, place, word): the windows of all items with their rarest word and its place in the window."""
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    windows = benchmark.select("item_id", "text").mapInArrow(_window_rows(n_words), f"item_id {item_type}, window array<long>").distinct()
    windows = store(windows, "windows")
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    few = vocabulary.limit(BLOCK + 1).toArrow().column("word").to_numpy()
    known = np.sort(few) if len(few) <= BLOCK else None  # else all words are counted, and the join below picks
    counts = docs.select("text").mapInArrow(_count_rows(known), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rank = vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    placed = windows.select("item_id", "window", F.posexplode("window").alias("place", "word")).join(rank, "word")
    return placed.groupBy("item_id", "window").agg(F.min(F.struct("n", "word", "place")).alias("least")).select("item_id", "window", "least.place", "least.word")


class _Block:
    """One block of the index as arrays sorted by prefix word."""

    def __init__(self, rows: pa.Table) -> None:
        order = np.argsort(rows.column("word").to_numpy(), kind="stable")
        self.word = rows.column("word").to_numpy()[order]
        self.place = rows.column("place").to_numpy()[order]
        lists = rows.column("window").to_pylist()
        self.windows = [np.array(lists[i], np.int64).view(np.uint64) for i in order]
        self.size = np.array([len(x) for x in self.windows], np.int64)
        flat = np.concatenate(self.windows) if len(order) else np.empty(0, np.uint64)
        ends = np.cumsum(self.size)
        self.hash = span_hashes(flat, ends - self.size, ends)
        self.item = rows.column("item_id").to_numpy()[order]

    def matches(self, w) -> tuple[np.ndarray, np.ndarray]:
        """(index rows, first words) of all occurrences of the block's windows in a batch of words."""
        h = w.hashes.view(np.int64)
        low, high = np.searchsorted(self.word, h), np.searchsorted(self.word, h, "right")
        at = np.flatnonzero(high > low)
        n = (high - low)[at]
        found = [self._verified(w, at[part], low[at[part]], n[part]) for part in _parts(n)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2

    def _verified(self, w, at: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        start = np.repeat(at, n) - self.place[row]
        doc = np.repeat(w.doc[at], n)
        fits = (start >= w.first[doc]) & (start + self.size[row] <= w.first[doc + 1])
        row, start = row[fits], start[fits]
        same = span_hashes(w.hashes, start, start + self.size[row]) == self.hash[row]
        row, start = row[same], start[same]
        exact = np.fromiter((np.array_equal(w.hashes[s : s + self.size[r]], self.windows[r]) for r, s in zip(row, start, strict=True)), bool, len(row))
        return row[exact], start[exact]


def _parts(n: np.ndarray):
    """Slices of n whose sums are at most CANDIDATES, but for single places."""
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CANDIDATES, "right")))
        yield slice(start, stop)
        start = stop


def _hit_rows(rows: pa.Table, item_type: pa.DataType):
    def run(it):
        block = _Block(rows)
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in batches(texts):
                w = words(as_bytes(texts[part], WORD_TABLE))
                n = part.stop - part.start
                row, start = block.matches(w) if len(rows) else (np.empty(0, np.int64),) * 2
                edge = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + block.size[row], -1)
                covered = (np.cumsum(edge)[:-1] > 0).astype(np.int8)
                items, places = [[] for _ in range(n)], [[] for _ in range(n)]
                doc = w.doc[start]
                for d, item in {(int(d), x) for d, x in zip(doc, block.item[row].tolist(), strict=True)}:
                    items[d].append(item)
                for d in np.unique(doc):
                    places[d] = np.flatnonzero(covered[w.first[d] : w.first[d + 1]]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [ids[part.start : part.stop], pa.array(w.counts, pa.int64()), pa.array(items, pa.list_(item_type)), pa.array(places, pa.list_(pa.int32()))],
                    names=["doc_id", "n_words", "items", "hit_words"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, n_words: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, items (item_ids with an occurring window), hit_words (places of the words inside one).

    docs(doc_id, text, ...), benchmark(item_id, text, ...); other columns are not
    read. Words are ASCII letters and digits and all bytes from 0x80 on, A-Z
    lower-cased. Null and empty texts have no words, no items and no hits; an item
    without words has no window; an empty benchmark hits nothing; repeated items
    count by their item_id. A null or repeated doc_id is a row of its own and stays.
    """
    ship(docs.sparkSession)
    index = store(window_index(docs, benchmark, n_words), "index")
    blocks = max(1, -(-index.count() // BLOCK))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = f"n_words long, items array<{index.schema['item_id'].dataType.simpleString()}>, hit_words array<int>"

    def hits(rows: DataFrame, kind: str, k: int) -> DataFrame:
        part = index.filter(F.pmod(F.hash("word", "window", "item_id"), blocks) == k).toArrow()
        return rows.mapInArrow(_hit_rows(part, part.schema.field("item_id").type), f"doc_id {kind}, {found}")

    if blocks == 1:
        return hits(docs.select("doc_id", "text"), id_type, 0)
    # rows are told apart by a number of their own, as ids may repeat or be null
    numbered = store(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    parts = [hits(numbered.select(F.col("row").alias("doc_id"), "text"), "long", k) for k in range(blocks)]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    whole = both.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"),
    )
    return numbered.select("row", "doc_id").join(whole, "row").drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n_words: int = 10) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark window occurs. Each row is judged by itself, whatever its doc_id; see contamination for odd rows."""

    def clean(rows: DataFrame) -> DataFrame:
        hits = store(contamination(rows, benchmark, n_words).filter(F.size("items") > 0).select("doc_id"), "hits")
        return rows.join(sized_broadcast(hits, 16), "doc_id", "left_anti").select(docs.columns)

    return by_row(docs, clean)
