"""Fuzzy line dedup, in DataFrame functions alone.

Equal lines are one node (a 64-bit hash). A line is the set of its character
5-shingles. Its MinHash signature is that set in the order of a hash, taken as
a ring: two lines of Jaccard J agree in a run of r values, from a value of
either, with a probability of about J^r. The runs that begin at values picked by
other bits of the hash are the bands, so a line that has few values still has as
many bands as it needs, and all lines pick alike. Long lines are signed by those
of their shingles that begin with one of a fixed set of characters, the longest by
those of a smaller set; lines near a border are signed both ways, so that no pair
falls between the two.

Bands give candidates; each is compared with the least line of its bucket by the
exact Jaccard similarity of all shingles and, for a few turns, with one more line
of it; every pair of lines of a bucket that are still apart is compared as well,
in pairs of bounded blocks, and distributed union-find joins the links. What rules
a pair out is small and loses none: sizes, then parity sketches, which differ in
no more bits than the sets do in values; then the texts are compared. Of each
component the first line (least doc_id, then place) stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_row, sized_broadcast, store, store_alone
from .components import components
from .pairs import dealt_to_blocks

#: White space, that lines are trimmed of: bytes 9-13 and 32.
SPACE = "\t\n\x0b\x0c\r "
ALL = r"(?s)(?=(.....))"
#: Shingles that begin with a Latin letter or digit of this set (code points 1 mod 4), or with any character from U+0100 on.
SOME = r"(?s)(?=([aeimquy159\x{100}-\x{10ffff}]....))"
#: The same with Latin letters that are half as frequent, for the longest lines.
RARE = r"(?s)(?=([clmquy159\x{100}-\x{10ffff}]....))"
#: A line is signed by RARE of its shingles if it has FEW of them or more, by SOME if it has fewer than MANY of those and FEW of these, and by ALL if it has fewer than MANY of both.
FEW, MANY = 24, 36
#: Values of a line that make its ring.
RING = 64
#: (length of a run, least and most values of a line): ranges overlap by a quarter, so both lines of a pair of 0.8 are in one.
RUNS = [(4, 0, 20), (5, 16, 64), (6, 48, None)]
#: The run of lines that are signed by SOME or RARE.
LONG_RUN = 6
#: A line begins a run at each of its values, or where it has 2 * STARTS or more, at a power of two fewer: STARTS at least.
STARTS = 12
#: Times that the lines of a bucket are compared with one more line of it before all that are still apart are.
TURNS = 3
#: Pairs that are apart for each row of the buckets, up to which no more turns come before them.
APART = 4
#: Lines of a block of a bucket whose lines are still apart.
BLOCK = 1_000
#: Times that the bands are dealt, a part of them each, so that only that part of their shuffle is on the disk at once.
PASSES = 2
#: Values from which a line's parity sketches are too full to tell it from others, so that its pairs are judged by values before their texts are compared.
FAR = 8_192
#: Least values of a line that it is judged by, and what their count may fall short by, times its square root, if there are more.
SKETCH, SLACK = 1_024, 1.2
#: Longs of a parity sketch; of the finer one that lines of more than FINE_FROM values have beside it; and of the coarser one that goes with the rows of a bucket.
LONGS, FINE, COARSE = 16, 64, 8
FINE_FROM = 1_024


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of all lines that are not blank; the line is trimmed for comparison."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.select("doc_id", "pos", F.btrim("line", F.lit(SPACE)).alias("line")).filter("line <> ''")


def shingles(line: Column) -> Column:
    """The set of 5-character shingles of a lower-cased line; a shorter line is one shingle."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(ALL), 1))
    return F.when(F.length(line) >= 5, found).otherwise(F.array(F.lower(line)))


def _values(pattern: str) -> Column:
    """The hashes of the shingles of `low` that a pattern finds, each once, in order."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("low", F.lit(pattern), 1), lambda x: F.xxhash64(x))))


def _all_values() -> Column:
    return F.when(F.length("low") < 5, F.array(F.xxhash64("low"))).otherwise(_values(ALL))


def _every(n: str) -> Column:
    """Of how many values of a ring of n one is a start, about: a power of two."""
    return F.expr(f"cast(pow(2, greatest(floor(log2({n} / {STARTS}.0)), 0)) as bigint)")


def _bands(length: int, kind: int, ring: str, n: str, every: str) -> Column:
    """The band keys of a line: hashes of `length` values on, from each value of its ring that is a start."""
    return F.expr(f"transform(filter(sequence(1, {n}), i -> element_at({ring}, i) & ({every} - 1) = 0), i -> xxhash64(slice({ring}, i, {length}), {kind}))")


def _rings(hashed: DataFrame) -> DataFrame:
    """(h, rare, some, all) of each line of hashed(h, line): the values it is signed by, of each kind or null."""
    low = hashed.select("h", F.lower("line").alias("low")).select("h", "low", _values(RARE).alias("rare"))
    # each kind is looked for only in lines that have too few of the one before
    low = low.select("h", "low", "rare", F.when(F.size("rare") < MANY, _values(SOME)).alias("some"))
    whole = F.when(F.col("some").isNotNull() & (F.size("some") < MANY), _all_values())
    return low.select("h", *(F.when(F.size(c) >= FEW, F.col(c)).alias(c) for c in ("rare", "some")), whole.alias("all"))


def banded(hashed: DataFrame) -> DataFrame:
    """(h, bands) of each line of hashed(h, line): the keys of its runs."""
    longest, kinds = max(length for length, _, _ in RUNS), ("rare", "some", "all")
    # each step is a projection of its own, as a lambda would make what it holds once a value
    cut = _rings(hashed).select("h", *(F.slice(c, 1, RING).alias(c) for c in kinds), F.size("all").alias("values"))
    rings = cut.select(
        "h", "values", *(F.size(c).alias(f"n_{c}") for c in kinds),
        *(F.expr(f"concat({c}, slice(flatten(array_repeat({c}, {longest})), 1, {longest - 1}))").alias(c) for c in kinds),
    ).select("*", *(_every(f"n_{c}").alias(f"every_{c}") for c in kinds))
    found = [F.when(F.col(c).isNotNull(), _bands(LONG_RUN, kind, c, f"n_{c}", f"every_{c}")) for kind, c in enumerate(("some", "rare"))]
    for length, least, most in RUNS:
        fits = (F.col("values") >= least) & (F.lit(True) if most is None else F.col("values") < most)
        found.append(F.when(F.col("all").isNotNull() & fits, _bands(length, length, "all", "n_all", "every_all")))
    none = F.array().cast("array<bigint>")
    return rings.select("h", F.array_distinct(F.concat(*(F.coalesce(x, none) for x in found))).alias("bands"))


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of line hashes whose shingle sets reach the threshold; lines travel, not their shingles."""
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b")
    # the sets and counts are bound by lambdas, so each is made once a pair
    sets = F.array(F.struct(shingles(F.col("la")).alias("a"), shingles(F.col("lb")).alias("b")))
    counts = F.transform(sets, lambda x: F.struct((F.size(x["a"]) + F.size(x["b"])).alias("n"), F.size(F.array_intersect(x["a"], x["b"])).alias("shared")))
    return both.filter(F.exists(counts, lambda c: c["shared"] >= (c["n"] - c["shared"]) * threshold - 1e-9)).select("a", "b")


def sketches(texts: DataFrame, most: int | None = SKETCH) -> DataFrame:
    """(id, sketch) of texts(h, line): the least of all the line's values as 31-bit numbers, `most` of them or all, and how many values there are."""
    low = texts.select(F.col("h").alias("id"), F.lower("line").alias("low")).select("id", _all_values().alias("all"))
    least = F.transform(F.slice("all", 1, most) if most else F.col("all"), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return low.select("id", F.struct(least.alias("least"), F.size("all").alias("n")).alias("sketch"))


def _fits(n: Column, m: Column, threshold: float) -> Column:
    """Whether sets of n and m values can reach the threshold."""
    return F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9


def _alike(a: str, b: str, threshold: float) -> Column:
    """Whether two sketches allow a Jaccard of the threshold.

    Sets of n and m values of that Jaccard J share (n + m) J / (1 + J). Of the k
    least values of the larger set the same part is shared, but for the noise of a
    sample; sets that are held whole have none, but values that fall together.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    larger = F.greatest(n, m)
    k = F.least(larger, F.lit(SKETCH))
    noise = F.when(larger > SKETCH, SLACK * F.sqrt(k)).otherwise(1.0)
    shared = F.size(F.array_intersect(f"{a}.least", f"{b}.least"))
    return _fits(n, m, threshold) & (shared >= k * (n + m) / larger * (threshold / (1 + threshold)) - noise - 1e-9)


def parities(sketch: DataFrame) -> DataFrame:
    """(id, odd) of each sketch that holds all values: their number, LONGS longs, in which each value has turned one bit, and if they are more than FINE_FROM, FINE such longs, else null."""
    value, zero = F.col("value"), F.lit(0).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), value.bitwiseAND(F.lit(63)))
    values = sketch.select("id", (F.col("sketch.n") > FINE_FROM).alias("long"), F.explode("sketch.least").alias("value"))
    turned = values.groupBy("id", "long", F.shiftright(value, 6).bitwiseAND(F.lit(FINE - 1)).alias("at")).agg(F.bit_xor(bit).alias("bits"), F.count("*").alias("n"))
    words = [F.bit_xor(F.when(F.col("at") % LONGS == i, F.col("bits")).otherwise(zero)).alias(f"w{i}") for i in range(LONGS)]
    found = turned.groupBy("id").agg(F.sum("n").cast("int").alias("n"), *words, F.collect_list(F.when(F.col("long"), F.struct("at", "bits"))).alias("all"))
    at = F.map_from_entries("all")
    fine = F.when(F.size("all") > 0, F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda i: F.coalesce(F.try_element_at(at, i), zero)))
    return found.select("id", F.struct("n", *(f"w{i}" for i in range(LONGS)), fine.alias("fine")).alias("odd"))


def _coarse(odd: DataFrame) -> DataFrame:
    """(id, odd) with COARSE longs, that the others are folded to, and the number of values."""
    folded = [F.expr(" ^ ".join(f"odd.w{i}" for i in range(k, LONGS, COARSE))).alias(f"w{k}") for k in range(COARSE)]
    return odd.select("id", F.struct(F.col("odd.n").alias("n"), *folded).alias("odd"))


def _bound(a: str, b: str, threshold: float) -> Column:
    """Values that sets of that many values and of a Jaccard of the threshold have in one of them alone, at most."""
    return (F.col(f"{a}.n") + F.col(f"{b}.n")) * ((1 - threshold) / (1 + threshold)) + 1e-9


def _near(a: str, b: str, threshold: float, longs: int = LONGS) -> Column:
    """Whether two parity sketches allow a Jaccard of the threshold.

    Bits that differ are at most the values in one set alone, which are (n + m)
    (1 - J) / (1 + J); so no pair of the threshold is lost.
    """
    differ = F.expr(" + ".join(f"bit_count({a}.w{i} ^ {b}.w{i})" for i in range(longs)))
    return _fits(F.col(f"{a}.n"), F.col(f"{b}.n"), threshold) & (differ <= _bound(a, b, threshold))


def _finely_near(a: str, b: str, threshold: float) -> Column:
    """The same by the finer sketches, where both lines have one: in a parity sketch of too few bits all sets of thousands of values look alike."""
    bits = F.aggregate(F.zip_with(f"{a}.fine", f"{b}.fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(bits <= _bound(a, b, threshold), F.lit(True))


def _likely(pairs: DataFrame, odd: DataFrame, threshold: float) -> DataFrame:
    """(a, b, far) of the pairs that their parity sketches allow: far if both lines have more than FAR values."""
    both = pairs.join(odd.select(F.col("id").alias("a"), F.col("odd").alias("oa")), "a").join(odd.select(F.col("id").alias("b"), F.col("odd").alias("ob")), "b")
    near = both.filter(_near("oa", "ob", threshold)).filter(_finely_near("oa", "ob", threshold))
    return near.select("a", "b", (F.least("oa.n", "ob.n") > FAR).alias("far"))


def _candidates(likely: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of likely(a, b, far), of those that are far the ones that their sketches allow."""
    far = likely.filter("far").join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    return likely.filter("not far").select("a", "b").unionByName(far.filter(_alike("sa", "sb", threshold)).select("a", "b"))


def _placed(bucket: DataFrame, comp: DataFrame) -> DataFrame:
    """(band, id, comp) of the lines of all buckets."""
    return bucket.withColumnRenamed("h", "id").join(comp, "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))


def _hub_pairs(bucket: DataFrame, comp: DataFrame, turn: int) -> DataFrame:
    """(a, b), a < b: each bucket's lines with one of their number, from a component that is picked by hash, if they are not in it."""
    full = _placed(bucket, comp)
    picked = full.groupBy("band").agg(F.min(F.struct(F.xxhash64("comp", F.lit(turn)).alias("o"), "id", "comp")).alias("hub"))
    both = full.join(picked, "band").filter(F.col("comp") != F.col("hub.comp"))
    return both.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _few_apart(bucket: DataFrame, comp: DataFrame) -> bool:
    """Whether the pairs of lines that share a bucket and are in different components are at most APART times the buckets' rows."""
    by_comp = _placed(bucket, comp).groupBy("band", "comp").agg(F.count("*").cast("double").alias("n"))
    by_band = by_comp.groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    rows, apart = by_band.select(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.lit(0.0))).first()
    return apart <= APART * rows


def _apart(bucket: DataFrame, comp: DataFrame, odd: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of lines that share a bucket and are in different components, but for those whose coarse parity sketches are too unlike."""
    dealt = store(dealt_to_blocks(_placed(bucket, comp), BLOCK), "dealt")
    known = dealt.join(_coarse(odd), "id")
    left = known.filter("block = lo").select("band", "lo", "hi", F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("odd").alias("oa"))
    right = known.filter("block = hi").select("band", "lo", "hi", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("odd").alias("ob"))
    apart = (F.col("ca") != F.col("cb")) & ((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b")))
    both = left.join(right, ["band", "lo", "hi"]).filter(apart & _near("oa", "ob", threshold, COARSE))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _buckets(hashed: DataFrame) -> DataFrame:
    """(h, band, hub) of all lines that share a band with another, the least of which is its hub."""
    # equal lines are one before they are dealt by band, so that a line that fills a third of all texts is no hot band
    once = store(banded(hashed).groupBy("h").agg(F.any_value("bands").alias("bands")), "bands")
    parts = []
    for part in range(PASSES):
        rows = once.select("h", F.explode("bands").alias("band")).filter(F.pmod("band", F.lit(PASSES)) == part).repartition("band")
        hubs = rows.groupBy("band").agg(F.min("h").alias("hub"), F.max("h").alias("far")).filter("hub < far").select("band", "hub")
        # few bands have several lines: they are looked up, and the lines' own rows need no sort
        parts.append(store(rows.join(hubs.hint("shuffle_hash"), "band"), "part"))
    return reduce(DataFrame.unionByName, parts)


def similar_lines(lines: DataFrame, threshold: float) -> DataFrame:
    """(id, comp): the component of each line hash that has a link to another."""
    spark = lines.sparkSession
    hashed = lines.select(F.xxhash64("line").alias("h"), "line")
    bucket = store_alone(spark, lambda: _buckets(hashed), "bucket")
    wanted = store(bucket.select("h").distinct(), "wanted")
    texts = store(hashed.join(sized_broadcast(wanted, 8), "h").groupBy("h").agg(F.any_value("line").alias("line")), "texts")
    # all of a line's values are in one task, so that only the texts are shuffled for them
    odd = store(parities(sketches(texts.repartition("h"), None)), "odd")
    sketch = store(sketches(texts.filter(F.length(F.lower("line")) > FAR)), "sketch")
    judged = lambda pairs: store(_linked(_candidates(store(_likely(pairs, odd, threshold), "judged"), sketch, threshold), texts, threshold), "links")
    comps = lambda links: store_alone(spark, lambda: components(links), "comp")
    # what is connected by links is so by each node's component, too, in fewer rounds
    joined = lambda comp, links: comps(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(links))
    pairs = store(bucket.filter("h <> hub").select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct(), "pairs")
    comp = comps(judged(pairs))
    # families that are apart by the first line alone grow together in a few turns, by pairs in proportion to their lines
    for turn in range(TURNS):
        if _few_apart(bucket, comp):
            break
        more = store(_hub_pairs(bucket, comp, turn).join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = judged(more)
        pairs = pairs.unionByName(more)
        if not found.head(1):
            break
        comp = joined(comp, found)
    found = judged(store(_apart(bucket, comp, odd, threshold).join(pairs, ["a", "b"], "left_anti"), "left"))
    return joined(comp, found) if found.head(1) else comp


def removed_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, removed): the places (from 0) of the lines of each text that repeat an earlier line, exactly or nearly."""
    lines = lines_of(docs)
    comp = similar_lines(lines, threshold)
    placed = lines.select("doc_id", "pos", F.xxhash64("line").alias("id")).join(sized_broadcast(comp, 16), "id", "left")
    placed = store(placed.select("doc_id", "pos", F.coalesce("comp", "id").alias("key")), "placed")
    # stored, so that the rows of a hot line can be split where they are joined
    first = store(placed.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"), "first")
    later = placed.join(first, "key").filter(F.struct("doc_id", "pos") > F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_list("pos").alias("removed"))


def without_repeats(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs, all columns, with each text's repeated lines removed; and __n_lines and __n_removed. Odd rows: see dedup_lines."""
    return by_row(docs, lambda rows: _without_repeats(rows, threshold))


def _without_repeats(docs: DataFrame, threshold: float) -> DataFrame:
    removed = store_alone(docs.sparkSession, lambda: removed_lines(docs, threshold).withColumnRenamed("removed", "__removed"), "removed")
    joined = docs.join(sized_broadcast(removed, F.size("__removed") * 4 + 24), "doc_id", "left")
    lines = F.split("text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("__lines"), i)), "\n")
    joined = joined.withColumn("__lines", lines)
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("__lines").isNull(), F.lit(0)).otherwise(F.size("__lines"))
    n_removed = F.when(F.col("__removed").isNull(), F.lit(0)).otherwise(F.size("__removed"))
    return joined.withColumn("text", text).select(*docs.columns, n_lines.alias("__n_lines"), n_removed.alias("__n_removed"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with each text's repeated lines removed, and n_lines and n_removed.

    docs(doc_id, text, ...); columns named n_lines or n_removed are replaced, all
    others are kept. Null and repeated doc_ids are rows of their own, null ids first,
    repeated ones in the order of their texts. A line ends at \\n; blank lines are never removed.
    Of a component of similar lines the first by (doc_id, place) stays, so ties have
    one winner. Null texts stay null and have no lines; an empty table gives no
    rows; a text may become empty.
    """
    out = without_repeats(docs.drop("n_lines", "n_removed"), threshold)
    return out.withColumnsRenamed({"__n_lines": "n_lines", "__n_removed": "n_removed"})
