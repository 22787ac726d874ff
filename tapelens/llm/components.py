"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import store


#: Edges up to which a round is one task without shuffles, whatever the number of shuffle partitions: some 4 MB.
FEW_EDGES = 1 << 17


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour; links may repeat."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # one partition has all rows of each node, so nothing needs to be dealt
    both = both.coalesce(1) if few else both
    sides = both if large else both.filter("b < a")
    least = sides.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("least", "a"))
    near = F.broadcast(least) if few else least
    if large:
        linked = both.filter("b > a").join(near, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        to = sides.join(near, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        linked = to.unionByName(least.select("a", F.col("least").alias("b")))
    linked = linked.filter("a <> b")
    return linked.coalesce(1) if few else linked


def _stored(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The stored edges, and their number and the sum of their hashes, taken while they are written."""
    seen = Observation()
    out = store(edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("sum")), name)
    return out, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp) for every node of links(a, b): comp is the least id of its component.

    Nodes without links are not in the result; self links and repeats are ignored;
    an empty table gives an empty result. Each round is stored in the shared
    folder; one of few links (FEW_EDGES) is one task. Beyond that joins are plain
    equi-joins on the node, so AQE can split a hub's rows.
    """
    edges, state = _stored(links.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        if before == state or not state[0]:
            break
        before = state
        few = state[0] <= FEW_EDGES
        large = _star(edges, True, few)
        edges, state = _stored(_star(large if few else large.distinct(), False, few).distinct().coalesce(max(1, state[0] // 100_000)), "stars")
    else:
        raise RuntimeError("components did not settle")
    edges = edges.coalesce(1) if state[0] <= FEW_EDGES else edges
    members = edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("id"), "comp")
    return members.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
