"""Best-fit packing into several permitted sequence lengths.

Documents are dealt to shards by a hash of their id; a shard packs its pieces
from the longest down. A piece goes to the open bin it fits best; if it fits
none, the bin size that costs least a token for what it can be expected to hold
(the piece and the shorter pieces still to come) is opened. At the end each bin
shrinks to the least permitted length that holds its contents. The sizes are
chosen jointly: the shard is packed by that rule and once for each size that all
bins may be opened with (longer pieces aside), and the packing that is cheapest
after shrinking is kept. A document longer than the largest length is cut into pieces of that
length and a rest.

Only (doc_id, length) is shuffled, and shards have a fixed number of documents,
so work and memory of a task do not grow with the corpus; each shard leaves a
few bins short at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

SIZES = (512, 1024, 2048, 4096)
#: Documents that one shard packs.
SHARD = 20_000
#: The cost of a sequence of n tokens is n + n * n / QUADRATIC + EACH (attention grows with the square; each sequence has a price).
#: A token costs least in a full sequence of sqrt(QUADRATIC * EACH) tokens, 2,048, so neither the smallest nor the largest size wins by itself.
QUADRATIC, EACH = 65_536, 64


def token_count(text: Column) -> Column:
    """Words (runs without bytes 9-13 and 32) and one end mark; null counts as empty."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(words == "", 1).otherwise(F.size(F.split(words, r"[\x20\x09-\x0D]+")) + 1).cast("long")


def cost(size: int) -> float:
    return size + size * size / QUADRATIC + EACH


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each piece, by the cheapest of the packings that choose each bin's size or open all with one; no length is over max(sizes)."""
    found = [_best_fit(lengths, tuple(sorted(sizes)), only) for only in (None, *sorted(sizes))]
    return min(found, key=lambda x: packing_cost(x[0], x[2]))


def packing_cost(bins: np.ndarray, capacity: np.ndarray) -> float:
    """The cost of the sequences of a packing."""
    if not len(bins):
        return 0.0
    first = np.unique(bins, return_index=True)[1]
    return float(sum(cost(int(c)) for c in capacity[first]))


def _best_fit(lengths: np.ndarray, sizes: tuple[int, ...], only: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit by falling length; a bin is opened with the size that costs least a token, or with `only`, or the least size that holds its first piece.

    Pieces are taken by falling length, ties by their order. `room` keeps the bins
    with r free tokens in stacks, and one integer's bits tell which r have any.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    used: list[int] = []
    opened: list[int] = []
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    some = 0
    still = int(lengths.sum())
    for i in order.tolist():
        n = int(lengths[i])
        still -= n
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            b = len(used)
            able = [only] if only and only >= n else [c for c in sizes if c >= n][: 1 if only else None]
            capacity = min(able, key=lambda c: (cost(c) / min(c, n + still), c))
            used.append(0)
            opened.append(capacity)
            r = capacity
        bins[i], offset[i] = b, used[b]
        used[b] += n
        if r > n:
            room[r - n].append(b)
            some |= 1 << (r - n)
    final = np.array([next(c for c in sizes if c >= u) for u in used], np.int64)
    return bins, offset, final[bins] if len(used) else np.empty(0, np.int64)


def _pack_rows(sizes: tuple[int, ...]):
    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        bins, offset, capacity = best_fit(pdf.n_tokens.to_numpy(), sizes)
        return pdf.assign(bin=bins, bin_offset=offset, capacity=capacity)[["shard", "bin", "capacity", "bin_offset", "doc_id", "piece", "first_token", "n_tokens"]]

    return run


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, length: Column | None = None) -> DataFrame:
    """One row per piece: bin_id, capacity, bin_offset, doc_id, piece, first_token, n_tokens.

    docs(doc_id, text, ...); `length` gives the tokens of a row (by default words
    and one end), and rows of 0 tokens are not packed. Pieces of one document are
    numbered from 0. A bin_id is shard:number. Null and empty texts are one token
    (the end); repeated rows are packed each; rows of a null doc_id are packed too, dealt by their length; other
    columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    largest = max(sizes)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", (token_count(F.col("text")) if length is None else length.cast("long")).alias("n"))
    shards = max(1, -(-docs.count() // SHARD))
    pieces = counted.filter("n > 0").select(
        F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(shards)).alias("shard"), "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))).alias("piece")
    )
    pieces = pieces.select("shard", "doc_id", "piece", (F.col("piece") * largest).alias("first_token"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest).cast("long")).alias("n_tokens"))
    packed = pieces.groupBy("shard").applyInPandas(
        _pack_rows(tuple(sizes)), f"shard long, bin long, capacity long, bin_offset long, doc_id {id_type}, piece long, first_token long, n_tokens long"
    )
    return packed.select(F.concat_ws(":", "shard", "bin").alias("bin_id"), "capacity", "bin_offset", "doc_id", "piece", "first_token", "n_tokens")


def bins(packed: DataFrame) -> DataFrame:
    """One row per bin: bin_id, capacity, n_tokens and its pieces in order."""
    return packed.groupBy("bin_id", "capacity").agg(
        F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "piece", "first_token", "n_tokens"))).alias("pieces")
    )
