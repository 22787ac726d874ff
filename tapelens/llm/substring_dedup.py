"""Substring dedup by level-wise doubling of repeated word windows.

A passage that repeats at 20 words repeats at 10 and at 5. So short windows are
compared first, and only what repeats at one length is looked at again at twice
that length, until the wanted length is reached or no candidate is left. Below
the full length windows are thinned to anchors: each window of the full length
has as its anchor the least of the shorter windows inside it, so equal windows
have equal anchors, and a full window is a candidate of the next level only if
its anchor occurs twice. Windows are hashed with 96 bits.

Rows move as (hash, doc, place), one for each key and chunk of a task: within a
chunk the task itself knows which places repeat an earlier one, so the rows of a
key are at most as many as there are chunks, and no key is hot. A document whose
whole text occurred earlier is settled by the hash of its text. Texts stay where
they were read unless the findings are too many to broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import by_row, sized_broadcast, store
from .wordvec import as_bytes, batches, mix, span_hashes, words

_SALT = np.uint64(0x5851F42D4C957F2D)
#: Rows that a task compares by itself before it passes them on.
CHUNK = 600_000


#: Words of the first level, at least.
FIRST = 4


def levels(n_words: int) -> list[int]:
    """Window lengths from the shortest on, each at most twice the one before; the last is n_words."""
    out = [n_words]
    while -(-out[0] // 2) >= FIRST:
        out.insert(0, -(-out[0] // 2))
    return out


def anchors(w, size: int, full: int, starts: np.ndarray) -> np.ndarray:
    """For each start of a window of `full` words, the first word of the least window of `size` words inside it, by its hash."""
    if size == full or not len(starts):
        return starts
    at, h = w.windows(size)
    where = np.full(len(w.hashes), -1, np.int64)
    where[at] = np.arange(len(at))
    first = where[starts]  # the windows of `size` words inside are first .. first+full-size, all of one text
    view = np.lib.stride_tricks.sliding_window_view(h, full - size + 1)
    out = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), 200_000):
        part = first[i : i + 200_000]
        out[i : i + 200_000] = at[part + view[part].argmin(axis=1)]
    return out


class _Chunk:
    """Collects rows (h, h2, doc_id, pos) and gives them out with the mark `again` on places that repeat an earlier one of the chunk.

    Of such a key the first place alone stays a row of the key; the others get keys of their own.
    """

    def __init__(self, all_again: bool) -> None:
        self.rows, self.size, self.all_again = [], 0, all_again

    def add(self, h, h2, doc, pos):
        self.rows.append((h, h2, doc, pos))
        self.size += len(h)
        if self.size >= CHUNK:
            yield from self.take()

    def take(self):
        if not self.size:
            return
        h, h2, doc, pos = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows, self.size = [], 0
        order = np.lexsort((pos, doc, h2, h)) if self.all_again is False else np.argsort(h, kind="stable")
        h, h2, doc, pos = h[order], h2[order], doc[order], pos[order]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
        again = same.copy()
        if self.all_again:  # two places make each other repeated
            again[:-1] |= same[1:]
        own = np.where(same, mix(mix(doc.astype(np.uint64)) + pos.astype(np.uint64)), h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(again)],
            names=["h", "h2", "doc_id", "pos", "again"],
        )


def _level_rows(size: int, before: int | None, full: int):
    """The anchors of one level, of `size` words, of the full windows whose anchor at the level before is among the text's surviving ones."""

    def run(it):
        last = size == full
        chunk = _Chunk(not last)
        for batch in it:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for part in batches(texts):
                w = words(as_bytes(texts[part]))
                starts, _ = w.windows(full)
                if before is not None:
                    lists = batch.column(2)[part.start : part.stop]
                    sizes = np.array([len(x) for x in lists], np.int64)
                    marked = np.zeros(len(w.hashes) + 1, bool)
                    marked[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.first[:-1], sizes)] = True
                    starts = starts[marked[anchors(w, before, full, starts)]]
                at = np.unique(anchors(w, size, full, starts))
                h = span_hashes(w.hashes, at, at + size)
                h2 = span_hashes(mix(w.hashes + _SALT), at, at + size) >> np.uint64(32)
                yield from chunk.add(h, h2, ids[part][w.doc[at]], at - w.first[w.doc[at]])
        yield from chunk.take()

    return run


def _ranges(it):
    """Each text's sorted window starts as [first, last, first, last, ...] of runs of neighbours."""
    for batch in it:
        out = []
        for x in batch.column(1):
            at = np.sort(np.asarray(x.values, np.int64))
            cut = np.flatnonzero(np.diff(at) > 1)
            out.append(np.stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]], axis=1).ravel().astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "runs"])


def repeated_windows(docs: DataFrame, n_words: int = 20) -> DataFrame:
    """(doc_id, runs): first and last starts of the runs of windows of n_words words whose words also start earlier.

    Earlier: in a smaller doc_id, or before in the same text. Texts of fewer words,
    null and empty ones have no window.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = f"h long, h2 int, doc_id {id_type}, pos int, again boolean"
    around, before = docs.select("doc_id", "text"), None
    for size in levels(n_words)[:-1]:
        marks = around.mapInArrow(_level_rows(size, before, n_words), rows)
        twice = marks.withColumn("n", F.count("*").over(Window.partitionBy("h", "h2"))).filter("again or n > 1")
        alive = store(twice.groupBy("doc_id").agg(F.collect_list("pos").alias("alive")), "alive")
        around, before = docs.join(sized_broadcast(alive, F.size("alive") * 4 + 24), "doc_id").select("doc_id", "text", "alive"), size
        if not alive.head(1):
            break
    grown = around.mapInArrow(_level_rows(n_words, before, n_words), rows)
    first = F.min(F.struct("doc_id", "pos")).over(Window.partitionBy("h", "h2"))
    later = grown.withColumn("first", first).filter(F.col("again") | (F.struct("doc_id", "pos") > F.col("first")))
    return later.groupBy("doc_id").agg(F.collect_list("pos").alias("starts")).mapInArrow(_ranges, f"doc_id {id_type}, runs array<int>")


def _kept_rows(n_words: int, with_text: bool):
    def run(it):
        for batch in it:
            ids, texts, runs, copies = batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            for part in batches(texts):
                n, removed, digest, kept_text = [], [], [], []
                for raw, found, copy in zip(as_bytes(texts[part]), runs[part.start : part.stop], copies[part], strict=True):
                    parts = raw.split()
                    kept = parts
                    if copy and len(parts) >= n_words:
                        kept = []
                    elif found.is_valid:
                        cover = np.zeros(len(parts) + 1, np.int64)
                        at = np.asarray(found.values, np.int64)
                        np.add.at(cover, at[::2], 1)
                        np.add.at(cover, at[1::2] + n_words, -1)
                        kept = [parts[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
                    joined = b" ".join(kept)
                    n.append(len(parts))
                    removed.append(len(parts) - len(kept))
                    digest.append(hashlib.sha256(joined).hexdigest())
                    if with_text:
                        kept_text.append(joined.decode("utf-8", "replace"))
                columns = [ids[part.start : part.stop], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(kept_text, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def substring_dedup(docs: DataFrame, n_words: int = 20, with_text: bool = False) -> DataFrame:
    """Remove each word that a repeated window of n_words words covers, but for the window's first place.

    docs(doc_id, text, ...); other columns are not read, so their names may clash
    with anything. Null and repeated doc_ids are rows of their own, null ids first,
    repeated ones in the order of their texts. Words are runs without bytes
    9-13 and 32. Returns doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space) and, with_text, kept_text. Null and empty texts
    have no words; an empty table gives no rows; ties (equal windows) go to the
    least (doc_id, place). Windows are judged on the input, not on what is left.
    """
    ship(docs.sparkSession)
    return by_row(docs.select("doc_id", "text"), lambda rows: _deduped(rows, n_words, with_text))


def _deduped(docs: DataFrame, n_words: int, with_text: bool) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text")
    same = base.filter(F.length("text") > 0).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    least = same.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copies = store(same.join(least, "sha").filter("doc_id > least").select("doc_id", F.lit(True).alias("copy")), "copies")
    copies = sized_broadcast(copies, 24)
    runs = store(repeated_windows(base.join(copies, "doc_id", "left_anti"), n_words), "runs")
    joined = base.join(sized_broadcast(runs, F.size("runs") * 4 + 24), "doc_id", "left").join(copies, "doc_id", "left")
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("doc_id", "text", "runs", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(_kept_rows(n_words, with_text), schema)
