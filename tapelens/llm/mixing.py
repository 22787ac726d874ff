"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

Each source's documents are shuffled by a hash and laid end to end; that stream
of words is cut into blocks of BLOCK words, and repeated as often as the target
asks. A slot of the schedule takes the next block of one source. The slots of
all sources are numbered through, source after source, so a source holds the
range of numbers that its weight asks for; position k of the schedule takes the
number whose bits are those of k in reverse (the van der Corput point k / 2^m),
and positions whose number is beyond the last slot are left out. Each source thus
has exactly its slots, spread over the schedule within about log2(slots) of the
even share at every place. How many slots of the source came before (the slot's
rank) follows from the bits of the position, so neither a sort of the schedule
nor a count along it is needed.

Only sizes, hashes and ids are shuffled. Offsets in a source's stream are sums
within a bucket of some 50,000 documents plus the sums of the buckets before it,
so a source of any size is spread over tasks, and blocks meet slots by (source,
block). Sources are a dimension: their targets are windows over one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Words of a block.
BLOCK = 8_192
#: Documents of a bucket, and slots that one row opens into.
BUCKET, SPREAD = 4_000, 4_096
#: Times that a source may be repeated at most.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words (runs without bytes 9-13 and 32) of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, sid, weight, target) from sizes(source, source_size).

    Sources by code point, null last, are numbered 0, 1, 2 ... and weigh 1, 2, 3,
    1, 2, 3 ... The targets share the sum of all sizes by weight; none is above
    `repeats` times its source's size, the rest goes to the others by weight. With
    the sources by rising size per weight, those below the level of the remaining
    shares are full, and that level is the greatest that any place shows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", (F.row_number().over(order) - 1).cast("int")).withColumn("weight", (F.col("sid") % 3 + 1).cast("long"))
    s = s.withColumn("most", F.col("source_size") * repeats)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("share", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.max(F.col("left").cast("double") / F.col("share")).over(every))
    return s.select("source", "source_size", "sid", "weight", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _reversed_bits(x: Column, bits: Column) -> Column:
    """The lowest `bits` bits of x in reverse order."""
    for mask, n in ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16)):
        x = F.shiftleft(x.bitwiseAND(mask), n).bitwiseOR(F.shiftrightunsigned(x, n).bitwiseAND(mask))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.when(bits > 0, F.call_function("shiftrightunsigned", x, (F.lit(64) - bits).cast("int"))).otherwise(0).cast("long")


def _below(limit: Column, bits: Column) -> Column:
    """For the points before a position: which counts add up to those whose number is under `limit`.

    Numbers under limit fall into ranges that share their first j bits, one for each
    bit of limit that is set; their positions are those that leave the remainder r
    when divided by 2^j. Gives these (j, r).
    """
    def part(j):
        kept = F.call_function("shiftrightunsigned", limit, (bits - j).cast("int"))
        return F.struct(j.cast("int").alias("j"), _reversed_bits(kept - 1, j).alias("r"), (kept % 2 == 1).alias("set"))

    return F.filter(F.transform(F.sequence(F.lit(0), bits), part), lambda x: x["set"])


def _count_before(k: Column, parts: Column) -> Column:
    """How many positions before k the ranges hold."""
    one = lambda x: F.call_function("shiftright", k - x["r"] + F.call_function("shiftleft", F.lit(1).cast("long"), x["j"]) - 1, x["j"])
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + one(x))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(position, sid, slot_rank, epoch, block, n_words): the slots that take each source's target out of its repeated stream.

    sources(sid, source_size, target): targets are whole words; the last slot of a
    source ends at its target, the last block of its stream at the stream's end.
    """
    s = sources.filter("target >= 1 and source_size > 0").select("sid", "source_size", F.floor("target").alias("words"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block))
    s = s.withColumn("slots", F.expr(f"words div source_size * blocks + ceil((words % source_size) / {block})"))
    s = s.withColumn("end", F.sum("slots").over(Window.orderBy("sid"))).withColumn("begin", F.col("end") - F.col("slots"))
    s = s.withColumn("bits", F.length(F.bin(F.max("end").over(Window.partitionBy()))))
    s = s.withColumns({"under_begin": _below(F.col("begin"), F.col("bits")), "under_end": _below(F.col("end"), F.col("bits"))})
    # a large source opens in two steps, so that no task makes all its slots
    some = s.withColumn("from", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(SPREAD).cast("long")))).repartition("sid", "from")
    slots = some.withColumn("number", F.explode(F.sequence("from", F.least(F.col("from") + SPREAD, F.col("end")) - 1)))
    slots = slots.withColumn("position", _reversed_bits(F.col("number"), F.col("bits")))
    slots = slots.withColumn("slot_rank", _count_before(F.col("position"), F.col("under_end")) - _count_before(F.col("position"), F.col("under_begin")))
    slots = slots.withColumns({"epoch": F.expr("slot_rank div blocks"), "block": F.col("slot_rank") % F.col("blocks")})
    left = F.col("words") - F.col("epoch") * F.col("source_size") - F.col("block") * block
    return slots.select("position", "sid", "slot_rank", "epoch", "block", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, left).cast("long").alias("n_words"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, shuffle_key) of every row of docs(doc_id, text, source, ...)."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("shuffle_key"))


def lay_out(rows: DataFrame, sources: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """rows of sized() with sid and `begin`, the words of the source before the row in the order of the shuffle keys."""
    buckets = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("ahead", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    sums = sums.join(sources.select(F.col("source").alias("name"), "sid"), F.col("source").eqNullSafe(F.col("name"))).select(F.col("source").alias("of"), F.col("bucket").alias("at"), "ahead", "sid")
    within = Window.partitionBy("source", "bucket").orderBy("shuffle_key", "doc_id", "size")
    rows = rows.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    return rows.select("doc_id", "source", "sid", "size", (F.col("ahead") + F.col("upto") - F.col("size")).alias("begin"))


def mix(docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, laid, sources): the mixture, the documents it is made of, and the sources with their targets.

    pieces(position, sid, epoch, doc_id, begin, first_word, n_words): the words from
    first_word on that the slot at `position` takes of a document; sorted by position
    and begin they are the mixed stream. laid(doc_id, source, sid, size, begin): all rows.

    docs(doc_id, text, source, ...): a null text has no words, a null source is a source
    of its own, null and repeated doc_ids are rows like all others (their order follows
    doc_id and text, so that reruns agree; rows equal in both change places at will);
    a text of any length spans as many blocks as it needs; rows without words are in no
    piece; further columns are not read; an empty table gives no rows.
    """
    rows = store(sized(docs), "sized")
    sources = store(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), repeats), "sources")
    laid = store(lay_out(rows, sources), "laid")
    parts = laid.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))))
    met = parts.join(schedule(sources, block), ["sid", "block"])
    at = F.greatest(F.col("begin"), F.col("block") * block)
    n = F.least(F.col("begin") + F.col("size"), F.col("block") * block + F.col("n_words")) - at
    pieces = met.select("position", "sid", "epoch", "doc_id", "begin", (at - F.col("begin")).alias("first_word"), n.alias("n_words")).filter("n_words > 0")
    return pieces, laid, sources


def taken(docs: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs, as mix() takes them; see there for odd rows."""
    pieces, laid, sources = mix(docs, block, repeats)
    # a row is known by its place in its source's stream; rows without words stand aside, as they share places
    got = pieces.groupBy("sid", "begin").agg(F.sum("n_words").alias("taken"))
    with_words = laid.filter("size > 0").join(got, ["sid", "begin"], "left").select("doc_id", "sid", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    rows = with_words.unionByName(laid.filter("size = 0").select("doc_id", "sid", "size", F.lit(0).cast("long").alias("taken")))
    return rows.join(sources, "sid").select("doc_id", "size", "source_size", "target", "taken")
