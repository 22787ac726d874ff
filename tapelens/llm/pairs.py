"""Members of buckets that are still in different components, each pair compared once by its signature.

A bucket's members are dealt by hash to blocks, those of its largest component
to blocks of their own. Each pair of blocks is one job (two blocks of the
largest component make none), so a job holds two blocks, however large the
bucket is, and each pair of members is in one job. Jobs are dealt by hash to
groups of about GROUP rows, as small buckets are many.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .wordvec import mix

#: Members of a block.
BLOCK = 4_000
#: Rows of a group, besides those of one more pair of blocks.
GROUP = 20_000
#: 16-bit words of a parity sketch, and of it with the weight of its bag.
ODD_WORDS = 128
ODD = ODD_WORDS + 2


def parities(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, ODD) parity sketches of bags, and their weights: each unit of a shingle's weight turns one bit."""
    unit = np.repeat(np.arange(len(doc)), weight)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(weight) - weight, weight)
    bits = ODD_WORDS * 16
    at = (mix(shingle[unit] + mix(level.astype(np.uint64) + np.uint64(1))) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(doc[unit] * bits + at, minlength=n * bits).reshape(n, bits) & 1
    total = np.bincount(doc, weights=weight, minlength=n).astype(np.uint32)
    return np.hstack([np.packbits(odd.astype(bool), axis=1).view(np.uint16), total.reshape(n, 1).view(np.uint16)])


def near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows of two tables of parity sketches allow a weighted Jaccard of the threshold.

    Bits that differ are at most the units in one bag alone, which are (n + m)
    (1 - J) / (1 + J) for bags of n and m units; so no pair of the threshold is lost.
    """
    n, m = (np.ascontiguousarray(x[:, ODD_WORDS:]).view(np.uint32)[:, 0].astype(np.float64) for x in (a, b))
    differ = np.bitwise_count(a[:, :ODD_WORDS] ^ b[:, :ODD_WORDS]).sum(axis=1, dtype=np.int64)
    return (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (differ <= (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def _alike(places: int, rows: int, least: float, threshold: float | None):
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["band", "lo", "hi"])
        sig = np.frombuffer(b"".join(pdf.sig), np.uint16).reshape(len(pdf), -1)
        sig, odd = sig[:, :places], sig[:, places:]
        ids, comp, block, band, lo, hi = (pdf[c].to_numpy() for c in ("id", "comp", "block", "band", "lo", "hi"))
        new = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        found = []
        for start, end, place in zip(new.tolist(), [*new[1:].tolist(), len(pdf)], pdf.place.to_numpy()[new].tolist()):
            left, right = (start + np.flatnonzero(block[start:end] == x) for x in (lo[start], hi[start]))
            step = max(1, 10_000 // max(1, len(right)))
            for some in (left[i : i + step] for i in range(0, len(left), step)):
                i, j = np.nonzero(comp[some][:, None] != comp[right])
                i, j = some[i], right[j]
                if lo[start] == hi[start]:
                    up = ids[i] < ids[j]
                    i, j = i[up], j[up]
                same = sig[i] == sig[j]
                # a pair counts in the first band that it shares
                good = same.mean(axis=1) >= least if len(i) else np.empty(0, bool)
                good &= ~same[:, : place * rows].reshape(len(i), place, rows).all(axis=2).any(axis=1)
                if threshold is not None:
                    good = np.flatnonzero(good)
                    good = good[near(odd[i[good]], odd[j[good]], threshold)]
                found += [(min(a, b), max(a, b)) for a, b in zip(ids[i[good]], ids[j[good]])]
        return pd.DataFrame(found, columns=["a", "b"]).astype({"a": ids.dtype, "b": ids.dtype})

    return run


def dealt_to_blocks(bucket: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of bucket(band, id, comp, ...) whose band has several components, with block, lo and hi: one row for each pair of blocks that its block is in.

    A pair of rows of different components of a band meets in one pair of blocks,
    and a block has about `size` rows.
    """
    sizes = bucket.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(
        F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")
    ).filter("comps > 1")
    others, mains = (F.ceil(c / size).cast("int") for c in (F.col("n") - F.col("most"), F.col("most")))
    sizes = store(sizes.select("band", "largest", others.alias("others"), mains.alias("mains")), "sizes")
    rest = bucket.join(sizes, "band").withColumn("main", F.col("comp") == F.col("largest"))
    at = F.xxhash64("id", F.lit(1))
    dealt = rest.withColumn("block", F.when(F.col("main"), F.col("others") + F.pmod(at, "mains")).otherwise(F.pmod(at, "others")).cast("int"))
    last = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select(*bucket.columns, "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))


def apart_pairs(bucket: DataFrame, sig: DataFrame, places: int, rows: int, least: float, threshold: float | None = None) -> DataFrame:
    """(a, b), a < b: pairs of bucket(place, band, id, comp) that share a band, are in different components and agree in `least` of sig(id, sig) or more.

    sig holds `places` 16-bit values, of which band p has those from p * rows on. If a
    threshold is given, a row of `parities` follows, and pairs that it rules out are left out.
    """
    dealt = dealt_to_blocks(bucket).join(sig, "id")
    kind = bucket.schema["id"].dataType.simpleString()
    dealt = store(dealt, "dealt")
    group = F.pmod(F.xxhash64("band", "lo", "hi"), F.lit(max(1, dealt.count() // GROUP)))
    return dealt.groupBy(group.alias("group")).applyInPandas(_alike(places, rows, least, threshold), f"a {kind}, b {kind}").distinct()
