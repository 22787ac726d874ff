"""MinHash near-dedup by BagMinHash.

A text is a bag of word shingles. The weight (multiplicity) of a shingle is
discretised into unit levels, and the levels are held in dyadic blocks {0},
[1,2), [2,4), [4,8), ... Each (shingle, block) is one Poisson process whose rate
is its number of levels; a point carries a component and a level inside the
block, and counts only if the weight reaches above that level. A component keeps
the earliest point of all processes, so two bags agree in a component with
probability sum(min weights) / sum(max weights), the weighted Jaccard. Processes
are followed only up to a time by which nearly every component has a point;
texts with an empty component are run again with twice the time, so nothing is
approximated.

Signatures are banded; in each bucket of a band the members are compared with a
hub, verified links are joined into components, and only members that are still
in another component than others of their bucket are compared again. Texts meet
only in pairs that their parity sketches allow, which rule out no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import by_row, sized_broadcast, store
from .components import components
from .pairs import ODD, apart_pairs, near, parities
from .wordvec import WORD_TABLE, as_bytes, batches, mix, span_hashes, words

COMPONENTS = 128
BANDS, ROWS = 25, 5
#: Turns of further hubs for buckets with several components.
TURNS = 3
#: A pair is verified if its signatures agree in the threshold less this (four standard deviations) or more.
MARGIN = 0.14
_STEP = 0x9E3779B97F4A7C15


def bag_of_shingles(raw: list[bytes], k: int = 5):
    """(doc, shingle, weight) of a batch and its words; a text of fewer than k words is one shingle, one without words its bytes."""
    w = words([b.translate(WORD_TABLE) for b in raw])
    at, h = w.windows(k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    bare = np.flatnonzero((w.counts == 0) & (np.array([len(b) for b in raw]) > 0))
    doc = np.concatenate([w.doc[at], short, bare])
    bytes_of = np.array([hash_bytes(raw[i]) for i in bare], np.uint64)
    h = np.concatenate([h, span_hashes(w.hashes, w.first[short], w.first[short + 1]), bytes_of])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.r_[at, len(h)]), w


def hash_bytes(b: bytes) -> int:
    x = np.frombuffer(b, np.uint8)
    return int(span_hashes(x, np.array([0]), np.array([len(x)]))[0])


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, COMPONENTS) earliest times, as the bits of doubles; texts without shingles have all-infinite rows."""
    m = COMPONENTS
    best = np.full(n * m, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n)
    until = np.where(total > 0, (np.log(m) + 3) / np.maximum(total, 1), 0)
    levels = np.frexp(weight - 1)[1]  # the number of dyadic blocks above {0} that a weight reaches
    part = np.repeat(np.arange(len(doc)), levels + 1)
    block = np.arange(len(part)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    todo = total > 0
    while todo.any():
        live = part[todo[doc[part]]] if not todo.all() else part
        b = block[todo[doc[part]]] if not todo.all() else block
        seed = mix(shingle[live] + mix(b.astype(np.uint64) + np.uint64(1)))
        size = np.where(b > 0, 1 << np.maximum(b - 1, 0), 1)
        base = np.where(b > 0, size, 0)
        d, top, t, step = doc[live], weight[live], np.zeros(len(live)), 0
        end = until[d]
        while len(d):
            step = (step + _STEP) % (1 << 64)
            r = mix(seed + np.uint64(step))
            t = t - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (size * m)
            on = t <= end
            d, top, t, end, seed, size, base, r = d[on], top[on], t[on], end[on], seed[on], size[on], base[on], mix(r[on])
            level = base + ((r >> np.uint64(32)).astype(np.int64) & (size - 1))
            good = level < top
            np.minimum.at(best, d[good] * m + (r[good] & np.uint64(m - 1)).astype(np.int64), t[good])
        todo &= np.isinf(best.reshape(n, m)).any(axis=1)
        until[todo] *= 2
    return best.reshape(n, m).view(np.uint64)


def _signature_rows(k: int):
    def run(it):
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in batches(texts, 500_000):
                raw = as_bytes(texts[part])
                n = len(raw)
                doc, shingle, weight, w = bag_of_shingles(raw, k)
                sig = mix(signatures(doc, shingle, weight, n))
                first = span_hashes(w.hashes, w.first[:-1], w.first[1:])
                other = span_hashes(mix(w.hashes), w.first[:-1], w.first[1:])
                for i in np.flatnonzero(w.counts == 0):
                    first[i], other[i] = hash_bytes(raw[i]), len(raw[i])
                bands = sig[:, : BANDS * ROWS].reshape(n * BANDS, ROWS)
                key = span_hashes(bands.ravel(), np.arange(n * BANDS) * ROWS, (np.arange(n * BANDS) + 1) * ROWS)
                key = mix(key + np.tile(np.arange(BANDS, dtype=np.uint64), n)).view(np.int64)
                some = np.array([len(b) > 0 for b in raw])
                small = np.hstack([(sig >> np.uint64(48)).astype(np.uint16), parities(doc, shingle, weight, n)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[part.start : part.stop],
                        pa.array(first.view(np.int64)),
                        pa.array(other.view(np.int64)),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                        pa.array([row if s else [] for row, s in zip(key.reshape(n, BANDS), some, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "k1", "k2", "sig", "bands"],
                )

    return run


def _agree(threshold: float):
    def run(it):
        for batch in it:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, COMPONENTS + ODD) for c in (2, 3))
            share = (a[:, :COMPONENTS] == b[:, :COMPONENTS]).mean(axis=1) if len(a) else np.empty(0)
            good = pa.array((share >= threshold - MARGIN) & near(a[:, COMPONENTS:], b[:, COMPONENTS:], threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["a", "b", "est"]).filter(good)

    return run


def _verify(k: int, threshold: float):
    def run(it):
        for batch in it:
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for i in range(0, len(ta), 200):
                raw = as_bytes(ta[i : i + 200]) + as_bytes(tb[i : i + 200])
                n = len(raw) // 2
                doc, h, weight, _ = bag_of_shingles(raw, k)
                pair = doc % n if n else doc
                total = np.bincount(pair, weights=weight, minlength=n)
                order = np.lexsort((h, pair))
                p, h, weight = pair[order], h[order], weight[order]
                same = np.flatnonzero((p[1:] == p[:-1]) & (h[1:] == h[:-1]))
                shared = np.bincount(p[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=n)
                keep.append(shared >= threshold * (total - shared) - 1e-9)
            keep = pa.array(np.concatenate(keep) if keep else np.empty(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its near-duplicate class), exact_id (the least doc_id with the same words).

    docs(doc_id, text, ...); other columns are not read. Null and repeated doc_ids are
    rows of their own, null ids first, repeated ones in the order of their texts.
    Two texts are linked if the weighted Jaccard of their bags of k-word shingles
    is at least `threshold`, and classes are the components of the links. Texts
    with the same words are one class without being compared. A text of fewer
    than k words is one shingle; null and empty texts are one class; an empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    return by_row(docs.select("doc_id", "text"), lambda rows: _classes(rows, threshold, k), "class_id", "exact_id")


def _classes(docs: DataFrame, threshold: float, k: int) -> DataFrame:
    base = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sigs = store(base.mapInArrow(_signature_rows(k), f"doc_id {id_type}, k1 long, k2 long, sig binary, bands array<long>"), "sigs")
    least = sigs.groupBy("k1", "k2").agg(F.min("doc_id").alias("exact_id"))
    member = store(sigs.select("doc_id", "k1", "k2").join(least, ["k1", "k2"]).select("doc_id", "exact_id"), "member")
    reps = store(sigs.join(member.filter("doc_id = exact_id").select("doc_id"), "doc_id").select("doc_id", "sig", "bands"), "reps")
    banded = reps.select("doc_id", F.posexplode("bands").alias("place", "band"))
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("far")).filter("hub < far").select("band", "hub")
    bucket = store(banded.join(hubs, "band"), "bucket")
    sig = reps.select("doc_id", "sig")
    rated = store(_rated(bucket.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), sig, threshold), "rated")

    wanted = store(bucket.select("doc_id").distinct(), "wanted")
    texts = store(base.join(sized_broadcast(wanted, 16), "doc_id"), "texts")
    best = rated.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b")
    links = store(_verified(best, texts, k, threshold), "links")
    comp = components(links)
    tried = best
    # the other hubs of texts that are still apart, then what the hubs do not show
    more = _apart(rated.select("a", "b").join(tried, ["a", "b"], "left_anti"), comp)
    found = store(links.unionByName(_verified(more, texts, k, threshold)), "links")
    comp = store(components(found), "comp")
    # families that their hubs leave apart grow together in a few turns of further hubs, by pairs in proportion to the texts
    for turn in range(TURNS):
        likely = store(_rated(_hub_pairs(_placed(bucket, comp), turn), sig, threshold), "rated")
        new = store(_verified(likely.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b"), texts, k, threshold), "links")
        if not new.head(1):
            break
        found = found.unionByName(new)
        comp = store(components(found), "comp")
    full = _placed(bucket, comp)
    # what the hubs do not show: signatures alone travel to the groups, and texts to the pairs that pass
    left = apart_pairs(full.withColumnRenamed("doc_id", "id"), sig.withColumnRenamed("doc_id", "id"), COMPONENTS, ROWS, threshold - MARGIN, threshold)
    left = store(left.join(rated.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "left")
    links = store(_verified(left, texts, k, threshold), "rest")
    last = components(found.unionByName(links))
    joined = member.join(last.select(F.col("id").alias("exact_id"), "comp"), "exact_id", "left")
    return joined.select("doc_id", F.coalesce("comp", "exact_id").alias("class_id"), "exact_id")


def _placed(bucket: DataFrame, comp: DataFrame) -> DataFrame:
    """bucket's rows with the component of their text."""
    return bucket.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("place", "band", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))


def _hub_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): a text of one component of each bucket, another one each turn, with the texts of the bucket's other components."""
    hubs = placed.groupBy("band").agg(F.min(F.struct(F.xxhash64("comp", F.lit(turn)).alias("o"), "doc_id", "comp")).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    both = placed.join(hubs.filter("low < high").select("band", "hub"), "band").filter(F.col("comp") != F.col("hub.comp"))
    return both.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _rated(pairs: DataFrame, sig: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "sa", "sb").mapInArrow(_agree(threshold), f"a {kind}, b {kind}, est double")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(k, threshold), f"a {kind}, b {kind}")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those pairs whose ends are in different components."""
    ca, cb = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def dedup(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """The first row of each near-duplicate class of docs, all columns: that of the least doc_id. Odd rows: see near_duplicates; an empty table stays empty."""
    ship(docs.sparkSession)

    def firsts(rows: DataFrame) -> DataFrame:
        gone = store(_classes(rows, threshold, k).filter("doc_id <> class_id").select("doc_id"), "gone")
        return rows.join(sized_broadcast(gone, 16), "doc_id", "left_anti").select(docs.columns)

    return by_row(docs, firsts)
