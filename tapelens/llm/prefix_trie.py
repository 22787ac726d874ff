"""The prefix trie of conversations: who shares which first turns, and what that saves.

A conversation is a path of turns; each distinct sequence of first turns is a node.
A prefix is known by a digest that its turns add to: the exclusive or of hashes of
(depth, turn), 128 bits, so it is a running window and a long conversation can be
cut anywhere. What a node has of the turns below it is a sum over its members: each
node's own value counts with one member, its owner (the smallest id), and each
conversation brings to a node what it owns from there on.

These sums are made in shards. A shard holds segments, stretches of SEGMENT turns of
one conversation at most, and its part of the trie: the distinct prefix digests of
its rows get the slots of a minimal perfect hash, whose table keeps each digest, so
that every lookup is verified; values are scattered into flat arrays by slot and,
from the deepest level up, added to the parent's slot. The shards' parts are then
summed by digest. A conversation that goes on beyond a segment hands what follows to
the segment's last row. So neither a common first turn, nor copies of one
conversation, nor one very long conversation is ever in one task, and the number of
jobs does not depend on the depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import store

#: Turns of a segment, rows of a shard, and the ids that one row of an end list spans.
SEGMENT, SHARD, SPAN = 4_096, 200_000, 4_096
#: Conversations that share the turns of a head, and the longest head and one.
FAMILY, HEAD = 5, 9
DIGEST = [("x", np.int64), ("y", np.int64)]


class NodeTable:
    """Distinct keys and their slots by a minimal perfect hash: on each level the keys that hash to a place alone get it, the others go on to the next."""

    def __init__(self, keys: np.ndarray):
        self.levels, left, seed = [], keys, 0
        while len(left):
            size = len(left) + len(left) // 2 + 1
            at = self._place(left, seed, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((seed, size, alone))
            left, seed = left[~alone[at]], seed + 1
        # a slot is the rank of a place among all that are taken
        self.starts = np.cumsum([0, *(int(a.sum()) for *_, a in self.levels)])
        self.ranks = [np.cumsum(a) - 1 for *_, a in self.levels]
        self.keys = np.empty(len(keys), DIGEST)
        self.keys[self._slot(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, seed: int, size: int) -> np.ndarray:
        h = keys["x"].astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        h ^= keys["y"].astype(np.uint64) << np.uint64(1 + seed % 31)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return (h % np.uint64(size)).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for (seed, size, alone), start, rank in zip(self.levels, self.starts, self.ranks):
            at = self._place(keys[left], seed, size)
            here = alone[at]
            slots[left[here]] = start + rank[at[here]]
            left = left[~here]
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 for a key that the table does not have."""
        slots = self._slot(keys)
        slots[(slots >= 0) & (self.keys[slots] != keys)] = -1
        return slots


def _keys(x, y) -> np.ndarray:
    keys = np.empty(len(x), DIGEST)
    keys["x"], keys["y"] = x, y
    return keys


def accumulate(keys: np.ndarray, parents: np.ndarray, depth: np.ndarray, sums: dict[str, np.ndarray], least: np.ndarray, segment: int) -> tuple[NodeTable, dict[str, np.ndarray], np.ndarray]:
    """The node table of rows (key, parent key, depth), and by slot the sums and the least value over each node and all that is below it here."""
    table = NodeTable(np.unique(keys))
    slot = table.slots(keys)
    n = len(table.keys)
    parent, level = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    # the first row of a segment hands nothing up: what follows a segment is added to its last row beforehand
    parent[slot], level[slot] = np.where(depth % segment == 0, -1, table.slots(parents)), depth
    total = {k: np.zeros(n, np.int64) for k in sums}
    lowest = np.full(n, np.iinfo(np.int64).max)
    for k, v in sums.items():
        np.add.at(total[k], slot, v)
    np.minimum.at(lowest, slot, least)
    order = np.argsort(-level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[order])) + 1
    for nodes in np.split(order, cuts):
        nodes = nodes[parent[nodes] >= 0]
        for v in total.values():
            np.add.at(v, parent[nodes], v[nodes])
        np.minimum.at(lowest, parent[nodes], lowest[nodes])
    return table, total, lowest


def _summed(columns: list[str], segment: int):
    def run(pdf):
        import pandas as pd

        table, total, lowest = accumulate(_keys(pdf.x, pdf.y), _keys(pdf.px, pdf.py), pdf.depth.to_numpy(), {c: pdf[c].to_numpy() for c in columns}, pdf.conv.to_numpy(), segment)
        return pd.DataFrame({"x": table.keys["x"], "y": table.keys["y"], "least": lowest} | total)

    return run


def _below(rows: DataFrame, columns: list[str], shards: int) -> DataFrame:
    """(x, y, least, *columns): the least conv and the sums of the columns over a node's rows and those below it."""
    shard = F.pmod(F.xxhash64(F.expr(f"conv div {FAMILY}"), "seg"), F.lit(shards))
    parts = rows.select("conv", "depth", "x", "y", "px", "py", *columns, shard.alias("shard")).groupBy("shard").applyInPandas(_summed(columns, SEGMENT), "x long, y long, least long, " + ", ".join(f"{c} long" for c in columns))
    return parts.groupBy("x", "y").agg(F.min("least").alias("least"), *(F.sum(c).alias(c) for c in columns))


def ordered(turns: DataFrame) -> DataFrame:
    """(conv, pos, turn_key, n_bytes): each conversation's turns numbered from 1 by turn (null first), ties by role and then text.

    turns(conv_id, turn, role, text, ...). All rows are sorted together by range, so a
    conversation may span tasks; what it has in earlier ranges is added to its numbers.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"))
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    # the length of the role keeps ("ab", "c") and ("a", "bc") apart
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    rows = store(rows.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), key.alias("turn_key"), F.octet_length("text").cast("long").alias("n_bytes")), "turns")
    # conversations at the edges of ranges: two rows a partition at most
    edges = rows.groupBy("part").agg(F.array(F.min("conv"), F.max("conv")).alias("c")).select(F.explode("c").alias("conv")).distinct()
    ahead = rows.join(F.broadcast(edges), "conv", "left_semi").groupBy("conv", "part").agg(F.count("*").alias("n"))
    ahead = ahead.withColumn("ahead", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).filter("ahead > 0").drop("n")
    here = F.row_number().over(Window.partitionBy("conv", "part").orderBy("row"))
    rows = rows.withColumn("here", here).join(F.broadcast(ahead), ["conv", "part"], "left")
    return rows.select("conv", (F.col("here") + F.coalesce("ahead", F.lit(0))).alias("pos"), "turn_key", "n_bytes")


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEAD


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, depth, turn_key, n_bytes), (conv, length)): conversations with the head of their family's first in place of their own."""
    own = store(ordered(turns), "ordered")
    base = F.col("conv") - F.pmod("conv", F.lit(FAMILY))
    convs = own.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": head_length(F.col("conv")), "base": base})
    convs = convs.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = store(convs.select("conv", "n", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head")), "convs")
    heads = own.filter((F.col("pos") < HEAD) & (F.pmod("conv", F.lit(FAMILY)) == 0)).withColumnRenamed("conv", "base")
    heads = convs.select("conv", "base", "head").join(heads, "base").filter("pos <= head").select("conv", F.col("pos").alias("depth"), "turn_key", "n_bytes")
    tails = own.filter(F.col("pos") > head_length(F.col("conv"))).join(convs.select("conv", "h", "head"), "conv")
    tails = tails.select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "turn_key", "n_bytes")
    return heads.unionByName(tails), convs.select("conv", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))


def _running(of: str, within, ahead: str) -> Column:
    return F.expr(f"bit_xor({of})").over(within).bitwiseXOR(F.coalesce(F.col(ahead), F.lit(0).cast("long")))


def prefixes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, seg, x, y, px, py, turn_key, n_bytes, last, ends): rows with the digests of the prefix and of that without its last turn.

    last: the row is its segment's last; ends: and its conversation's. The root is the
    row of depth 0 of each conversation, with the digest (0, 0).
    """
    word = lambda i: F.conv(F.substring("of_turn", i, 16), 16, -10).cast("long")
    rows = rows.withColumn("of_turn", F.md5(F.concat_ws(" ", "depth", "turn_key").cast("binary"))).withColumns({"a": word(1), "b": word(17)}).drop("of_turn")
    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("turn_key"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = root.unionByName(rows.withColumn("depth", F.col("depth").cast("long"))).withColumn("seg", F.expr(f"depth div {SEGMENT}"))
    rows = store(rows, "rows")
    # of conversations longer than a segment alone
    longer = rows.join(lengths.filter(F.col("length") >= SEGMENT).select("conv"), "conv", "left_semi")
    sums = longer.groupBy("conv", "seg").agg(F.expr("bit_xor(a)").alias("a_sum"), F.expr("bit_xor(b)").alias("b_sum"))
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "seg", F.expr("bit_xor(a_sum)").over(before).alias("a_ahead"), F.expr("bit_xor(b_sum)").over(before).alias("b_ahead"))
    rows = rows.join(sums, ["conv", "seg"], "left").join(lengths, "conv")
    within = Window.partitionBy("conv", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"x": _running("a", within, "a_ahead"), "y": _running("b", within, "b_ahead")})
    rows = rows.withColumns({"px": F.col("x").bitwiseXOR(F.col("a")), "py": F.col("y").bitwiseXOR(F.col("b")), "ends": F.col("depth") == F.col("length")})
    return rows.select("conv", "depth", "seg", "x", "y", "px", "py", "turn_key", "n_bytes", (F.col("ends") | ((F.col("depth") + 1) % SEGMENT == 0)).alias("last"), "ends")


def _hash_streams(batches):
    """(x, y, ends_sha256) from rows (x, y, span, ids) sorted by node and span: one running hash, whatever the length of the list."""
    import pyarrow as pa

    node, running, out = None, None, []

    def done(found):
        xs, ys, hs = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(hs, pa.string())], ["x", "y", "ends_sha256"])

    for batch in batches:
        for x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ids"))):
            if node != (x, y):
                if node:
                    out.append((*node, running.hexdigest()))
                node, running = (x, y), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield done(out)
        out = []
    if node:
        yield done([(*node, running.hexdigest())])


def ends(rows: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of the nodes where conversations end: their ids in order, joined by commas, hashed as a stream.

    Ids are first joined by spans of SPAN numbers, so the copies of a common conversation
    reach the task that hashes their list as few long rows; it holds one of them at a time.
    """
    spans = rows.filter("ends").groupBy("x", "y", F.floor(F.col("conv") / SPAN).alias("span")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return spans.repartition("x", "y").sortWithinPartitions("x", "y", "span").mapInArrow(_hash_streams, "x long, y long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns(conv_id, turn, role, text, ...) are rebuilt as rebuilt() says. A null role or
    text is empty; a null turn comes first; repeated and tied rows are turns each, in the
    order of role and text; rows without a conv_id belong to no conversation and are left
    out; texts of any length are hashed whole; further columns are not read; an empty
    table gives no nodes. Two prefixes of one digest raise an error.
    """
    ship(turns.sparkSession)
    rows = store(prefixes(*rebuilt(turns)), "prefixes")
    shards = max(1, -(-rows.count() // SHARD))
    # members and owners: one for each conversation, at its last row, added up
    counted = _below(rows.withColumn("n_convs", F.col("last").cast("long")), ["n_convs"], shards)
    same = lambda *c: F.min(F.struct(*c)) == F.max(F.struct(*c))
    facts = rows.groupBy("x", "y").agg(
        F.sum(F.col("ends").cast("long")).alias("n_ends"), F.max("n_bytes").alias("n_bytes"), F.max("depth").alias("depth"), F.max("px").alias("px"), F.max("py").alias("py"),
        F.assert_true(same("depth", "px", "py", "turn_key"), F.lit("two prefixes have one digest")).alias("verified"),
    )
    nodes = store(counted.join(facts, ["x", "y"]).withColumnRenamed("least", "owner").filter("verified is null").drop("verified"), "nodes")
    # each node's own values stand with its owner's row
    owned = nodes.select(F.col("owner").alias("conv"), "depth", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    values = rows.join(owned, ["conv", "depth"], "left").fillna(0, ["leaf", "saved"])
    # what a long conversation owns in later segments is handed to the last row of each earlier one
    later = values.join(rows.filter("seg > 0").select("conv").distinct(), "conv", "left_semi").groupBy("conv", "seg").agg(F.sum("leaf").alias("leaf_sum"), F.sum("saved").alias("saved_sum"))
    after = Window.partitionBy("conv").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = later.select("conv", "seg", F.lit(True).alias("last"), F.sum("leaf_sum").over(after).alias("leaf_after"), F.sum("saved_sum").over(after).alias("saved_after"))
    values = values.join(later, ["conv", "seg", "last"], "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_after", F.lit(0)) for c in ("leaf", "saved")})
    below = _below(values, ["leaf", "saved"], shards).select("x", "y", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    children = nodes.filter("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("owner").alias("parent_conv_id"), F.col("depth") + 1).withColumnRenamed("(depth + 1)", "depth")
    out = nodes.join(below, ["x", "y"]).join(children, ["x", "y"], "left").join(ends(rows), ["x", "y"], "left").join(parents, ["px", "py", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
