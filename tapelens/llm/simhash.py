"""Document fingerprints by SimHash, with DataFrame functions alone.

Every word of a text votes on each of 64 bits by its 64-bit hash, for or against,
with a weight that grows with its length (short words are mostly common ones).
Two bits share a 64-bit sum, as two counters of 32 bits, so a text takes 32 sums
in one hash aggregation. Permuted block tables find all fingerprints within a
Hamming radius: 64 bits are cut into twice as many blocks as the radius, and two
fingerprints within it agree in half of the blocks or more.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_row, sized_broadcast, store

RADIUS = 3
_LANES = (1 << 32) | 1


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp, a long, of each row of texts(keys, text); the keys are unique. Null and empty texts get 0."""
    word = texts.select(*keys, F.explode_outer(F.split("text", r"[\x20\x09-\x0D]+")).alias("word"))
    length = F.coalesce(F.length("word"), F.lit(0))
    weight = F.when(length == 0, 0).otherwise(F.greatest(F.least(length, F.lit(12)) - 2, F.lit(1))).cast("long")
    hashed = word.select(*keys, weight.alias("w"), F.xxhash64("word").alias("h"))
    votes = hashed.groupBy(*keys).agg(
        F.sum("w").alias("w"), *[F.sum(F.col("w") * F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES))).alias(f"v{j}") for j in range(32)]
    )

    def bit(count: Column, place: int) -> Column:
        return F.shiftleft((count * 2 > F.col("w")).cast("long"), place)

    halves = [(F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{j}", 32)) for j in range(32)]
    bits = [bit(low, j) for j, (low, _) in enumerate(halves)] + [bit(high, j + 32) for j, (_, high) in enumerate(halves)]
    return votes.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def next_ids(docs: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """(doc_id, next_id): the next smaller doc_id, and after the least the greatest.

    Ids are dealt to ranges of about per_bucket by Spark's range partitioning, which
    samples them, so a few far ids do not widen the others' range. Neighbours are
    found inside each range, and the range ends among themselves.
    """
    ids = docs.select("doc_id").filter("doc_id is not null")
    n, most = ids.agg(F.count("*"), F.max("doc_id")).first()
    if not n:
        return ids.withColumn("next_id", F.col("doc_id"))
    # stored, as the sampled ranges of a second evaluation could differ
    cut = store(ids.repartitionByRange(max(1, n // per_bucket), "doc_id").withColumn("bucket", F.spark_partition_id()), "ranges")
    inside = cut.withColumn("near", F.lag("doc_id").over(Window.partitionBy("bucket").orderBy("doc_id")))
    ends = cut.groupBy("bucket").agg(F.max("doc_id").alias("end"))  # one row for each per_bucket ids
    order = Window.orderBy("bucket")
    ends = ends.select("bucket", F.coalesce(F.lag("end").over(order), F.lit(most)).alias("before"))
    return inside.join(ends, "bucket").select("doc_id", F.coalesce("near", "before").alias("next_id"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, text and edited: the text whose last third is replaced by the start of the next document's.

    doc_id is unique; null texts count as empty.
    """
    base = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chain = next_ids(docs)
    other = base.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    cut = F.floor(F.length("text") / 3).cast("int")
    # ids and lengths go to the next text, which gives its head; only that is moved to the text it edits
    size = store(base.select("doc_id", cut.alias("cut")).join(chain, "doc_id"), "cuts")
    heads = other.join(sized_broadcast(size, 28), "next_id").select("doc_id", "next_id", "cut", F.substring(F.col("next_text"), F.lit(1), F.col("cut")).alias("head"))
    joined = base.join(heads, "doc_id")
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("cut"))
    return joined.select("doc_id", "next_id", "text", F.concat(kept, "head").alias("edited"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next.

    The next document is that of the next smaller doc_id, after the least the greatest.
    Null and repeated doc_ids are rows of their own: null ids are the least, repeated
    ones follow the order of their texts. Null texts are empty, texts are read whole,
    other columns are not read; an empty table gives no rows.
    """
    return by_row(docs.select("doc_id", "text"), _fingerprinted)


def _fingerprinted(docs: DataFrame) -> DataFrame:
    pairs = edited_pairs(docs)
    facts = pairs.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited")
    sides = facts.select("doc_id", "next_id", "n_chars", "edited_sha256", F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("x"))
    fp = fingerprints(sides.select("doc_id", "next_id", "n_chars", "edited_sha256", "x.side", "x.text"), ["doc_id", "next_id", "n_chars", "edited_sha256", "side"])
    # a text's two fingerprints meet again where they were made
    both = fp.groupBy("doc_id", "next_id", "n_chars").agg(
        F.max(F.when(F.col("side") == 1, F.col("edited_sha256"))).alias("edited_sha256"),
        F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"),
    )
    both = store(both, "fingerprints")
    after = both.select(F.col("doc_id").alias("next_id"), F.col("fp").alias("next_fp"))
    return both.join(after, "next_id").select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next")
    )


def block_masks(radius: int = RADIUS) -> list[int]:
    """The bits that each permuted table compares: those of `radius` of 2 * radius blocks, as signed longs."""
    blocks, start = [], 0
    for i in range(2 * radius):
        size = 64 // (2 * radius) + (i < 64 % (2 * radius))
        blocks.append(((1 << size) - 1) << start)
        start += size
    masks = [sum(chosen) for chosen in combinations(blocks, radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def block_keys(fp: Column, masks: list[int]) -> Column:
    """One key for each permuted table: its bits, all others zero."""
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])


def within_radius(asked: DataFrame, held: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n_within): for each distinct fp of asked, the number of rows of held(fp) whose fingerprint is within the radius.

    Equal fingerprints are one entry with a count, so copies cost nothing more, and
    a pair is taken in the first table alone in which it agrees.
    """
    masks = block_masks(radius)
    entries = held.groupBy("fp").agg(F.count("*").alias("n"))
    keyed = entries.select(F.col("fp").alias("other"), "n", F.posexplode(block_keys(F.col("fp"), masks)).alias("t", "key")).select("other", "n", "key")
    questions = asked.select("fp").distinct().select("fp", F.posexplode(block_keys(F.col("fp"), masks)).alias("t", "key"))
    x = F.col("fp").bitwiseXOR(F.col("other"))
    first = reduce(lambda rest, i: F.when(x.bitwiseAND(F.lit(masks[i])) == 0, i).otherwise(rest), reversed(range(len(masks))), F.lit(-1))
    found = questions.join(keyed, "key").filter((F.bit_count(x) <= radius) & (first == F.col("t")))
    return found.groupBy("fp").agg(F.sum("n").alias("n_within"))
