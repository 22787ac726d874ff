"""Phrase collocation mining by best-first growth with admissible bounds.

A phrase of 2 to 5 words scores by its worst cut: floor(1000 * a * n / (l * r)). As a
is at most r, no phrase that begins with a word of count f scores more than
floor(1000 * n / f), so words are taken by falling bound, the rarest of those with
LEAST occurrences first. A round takes the next words of each language as frontier
and grows the phrases that begin with them, word by word, from prefixes that have
LEAST occurrences; then it counts the endings that its cuts need and scores. When
2,000 phrases of a language survive, the next round takes exactly the words whose
bound reaches the 2,000th score (ties included), and the language is settled.

A phrase is dropped if a longer candidate that contains it has as many occurrences.
Then one of a single word more has, so it is enough to see whether all occurrences
have the same word before or behind them; that is noted while they are counted.

Texts are encoded once, in chunks of some 250,000 words of a language with their own
vocabulary. Passes over the chunks work on whole arrays in the tasks and send counts.
What a pass looks for is given to it as a bit table of FILTER_BITS hashed places (4 MB
at any size of the corpus, sent compressed); places hit by chance cost work, but as the counts that
come back are of exact phrases and compared with LEAST, they change no result.
Tasks take and give batches of about BATCH bytes and hold one chunk at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import setting
from .common import store

LEAST, LONGEST, TOP = 100, 5, 2_000
#: Words of a chunk, rows that a task gathers before it sends counts, and bits of the table that a pass looks in.
CHUNK, FLUSH, FILTER_BITS = 1 << 18, 1 << 21, 25
#: Bytes of a batch that goes to a task's Python (one row at least), and rows of one that comes back.
BATCH, ROWS = 2 << 20, 1 << 15
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Counts of the first frontier go up to LEAST * STEP, those of the next to STEP times that while a language has too few survivors.
STEP = 64


def _chunks_of(batch):
    """(lang, hashes, codes) of each row of a batch of chunks, one at a time, the bytes as they lie in the batch."""
    lang, hashes, codes = (batch.column(c) for c in ("lang", "hashes", "codes"))
    for i in range(batch.num_rows):
        yield lang[i].as_py(), hashes[i].as_buffer(), codes[i].as_buffer()


class _Codes(dict):
    """Word -> its code in the chunk, from 1 on; what stands between pieces is 0."""

    def __init__(self):
        self.words, self.breaks = [], frozenset(b".,;:!?\n\x0b\x0c\r")

    def __missing__(self, word: bytes) -> int:
        if word[0] in self.breaks:
            code = 0
        else:
            self.words.append(word.decode())
            code = len(self.words)
        self[word] = code
        return code


def _encode(size: int):
    """(lang, words, counts, codes): chunks of whole texts of a language; codes are places in words, from 1 on, 0 ends a piece."""

    def run(batches):
        import re
        from array import array

        import pyarrow as pa

        find = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+|[^ \t.,;:!?\n\x0b\x0c\r]+").findall
        held: dict[str, tuple[_Codes, array]] = {}

        def chunk(lang):
            vocabulary, codes = held.pop(lang)
            codes = np.frombuffer(codes, np.uint32)
            counts = np.bincount(codes, minlength=len(vocabulary.words) + 1)[1:]
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vocabulary.words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([codes.tobytes()])], ["lang", "words", "counts", "codes"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), map(str, batch.column("text"))):
                if lang not in held:
                    held[lang] = _Codes(), array("I")
                vocabulary, codes = held[lang]
                data, at = text.encode().lower(), 0  # bytes.lower() changes A-Z alone
                while at < len(data):
                    end = data.find(b" ", at + (1 << 20))
                    end = len(data) if end < 0 else end
                    codes.extend(map(vocabulary.__getitem__, find(data[at:end])))
                    at = end
                codes.append(0)
                if len(codes) >= size:
                    yield chunk(lang)
                elif sum(len(c) for _, c in held.values()) >= 4 * size:
                    yield chunk(max(held, key=lambda x: len(held[x][1])))
        for lang in list(held):
            yield chunk(lang)

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _first_key(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(lang.astype(np.uint64) ^ (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _next_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(key * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64))


def _hash(text: str) -> int:
    """Spark's xxhash64 of a string."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def _marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(65 - (8 * len(table)).bit_length())
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _open(table: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.uint8)


def bit_table(keys: DataFrame) -> bytes | None:
    """The bit table of keys(key), compressed; None if there are no keys. Its words of 64 bits, at most 2^(FILTER_BITS - 6), are made in one aggregate."""
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    word = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(word).alias("bits")).toArrow()
    if not len(words):
        return None
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return zlib.compress(table.tobytes(), 1)


def keys_of(phrases: DataFrame) -> DataFrame:
    """(key, m) of phrases(lang, phrase), phrase being the hashes of its m words, 8 bytes each."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            langs = {x: _hash(x) for x in pdf.lang.unique()}
            m = pdf.phrase.map(len).to_numpy(np.int64) // 8
            lang, keys = pdf.lang.map(langs).to_numpy(np.int64), np.zeros(len(pdf), np.uint64)
            for n in np.unique(m):
                at = np.flatnonzero(m == n)
                words = np.frombuffer(b"".join(pdf.phrase.iloc[at]), ">i8").astype(np.int64).reshape(-1, n)
                k = _first_key(lang[at], words[:, 0])
                for c in range(1, n):
                    k = _next_key(k, words[:, c])
                keys[at] = k
            yield pd.DataFrame({"key": keys.astype(np.int64), "m": m.astype(np.int32)})

    return phrases.select("lang", "phrase").mapInPandas(run, "key long, m int")


class _Chunk:
    """A chunk's arrays, and the places where wanted phrases begin."""

    def __init__(self, lang: str, hashes, codes, frequent: np.ndarray):
        self.codes = np.r_[np.frombuffer(codes, np.uint32), np.zeros(LONGEST, np.uint32)]
        self.word = np.r_[np.int64(0), np.frombuffer(hashes, np.int64)]
        self.first = _first_key(np.full(len(self.word), _hash(lang)), self.word)
        self.ok = _marked(frequent, self.first)
        self.ok[0] = False

    def grow(self, first: np.ndarray | None, tables: dict[int, np.ndarray], longest: int):
        """Yields (m, places, keys) of the phrases of m words up to `longest`: all words frequent, the first in table `first`, prefixes of m words in tables[m] if there is one."""
        begins = self.ok if first is None else self.ok & _marked(first, self.first)
        at = np.flatnonzero(begins[self.codes])
        keys = self.first[self.codes[at]]
        for m in range(2, longest + 1):
            code = self.codes[at + m - 1]
            on = self.ok[code]
            at, keys = at[on], _next_key(keys[on], self.word[code[on]])
            yield m, at, keys
            if m in tables and first is not None:
                on = _marked(tables[m], keys)
                at, keys = at[on], keys[on]


def _key_counts(m: int, first: bytes, frequent: bytes, tables: dict[int, bytes], flush: int):
    """(key, n): how often each phrase of m words with a frequent prefix occurs, by its hashed key."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        begin, words, grown = _open(first), _open(frequent), {k: _open(t) for k, t in tables.items()}

        def send():
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            start = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
            for i in range(0, len(start) - 1, ROWS):
                at = start[i : i + ROWS + 1]
                one = keys[at[: min(ROWS, len(start) - 1 - i)]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.diff(at))], ["key", "n"])

        for batch in batches:
            for chunk in _chunks_of(batch):
                *_, (_, _, keys) = _Chunk(*chunk, words).grow(begin, grown, m)
                held.append(keys)
                n += len(keys)
                if n >= flush:
                    yield from send()
                    n = 0
        if n:
            yield from send()

    return run


def _phrase_counts(first: bytes | None, frequent: bytes, tables: dict[int, bytes]):
    """(lang, phrase, n, before_min, before_max, behind_min, behind_max): exact phrases whose key is in tables[m], with the range of the words around (0: none)."""

    def grouped(lang, chunk, m, at, keys):
        words = chunk.word[chunk.codes[at[:, None] + np.arange(m)]]
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order][1:] != keys[order][:-1]]
        # phrases that differ but share a key are told apart by their words
        if (~new & (words[order] != words[np.r_[order[:1], order[:-1]]]).any(axis=1)).any():
            order = np.lexsort(words.T[::-1])
            new = np.r_[True, (words[order][1:] != words[order][:-1]).any(axis=1)]
        start = np.flatnonzero(new)
        data = words[order[start]].astype(">i8").tobytes()
        before = chunk.word[np.where(at > 0, chunk.codes[at - 1], 0)][order]
        behind = chunk.word[chunk.codes[at + m]][order]
        numbers = np.diff(np.r_[start, len(at)]), *(f.reduceat(x, start) for x in (before, behind) for f in (np.minimum, np.maximum))
        for i in range(0, len(start), ROWS):
            some = slice(i, i + ROWS)
            phrases = [data[k : k + 8 * m] for k in range(8 * m * i, 8 * m * min(i + ROWS, len(start)), 8 * m)]
            yield [lang] * len(phrases), phrases, *(x[some] for x in numbers)

    def run(batches):
        import pyarrow as pa

        begin, often, sought = first and _open(first), _open(frequent), {k: _open(t) for k, t in tables.items()}
        for batch in batches:
            for name, hashes, codes in _chunks_of(batch):
                chunk = _Chunk(name, hashes, codes, often)
                for m, at, keys in chunk.grow(begin, sought, max(sought)):
                    on = _marked(sought[m], keys) if m in sought else np.zeros(len(keys), bool)
                    for lang, phrase, *numbers in grouped(name, chunk, m, at[on], keys[on]) if on.any() else ():
                        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), *(pa.array(x.astype(np.int64)) for x in numbers)], COUNTED)

    return run


RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
COUNTED = ["lang", "phrase", "n", "before_min", "before_max", "behind_min", "behind_max"]


def _exact(chunks: DataFrame, first, frequent, tables) -> DataFrame:
    """Phrases with LEAST occurrences or more: (lang, phrase, a, dropped)."""
    made = chunks.mapInArrow(_phrase_counts(first, frequent, tables), "lang string, phrase binary, " + ", ".join(f"{c} long" for c in COUNTED[2:]))
    made = made.groupBy("lang", "phrase").agg(F.sum("n").alias("a"), *(F.expr(f"{c[-3:]}({c})").alias(c) for c in COUNTED[3:])).filter(F.col("a") >= LEAST)
    same = lambda side: (F.col(f"{side}_min") == F.col(f"{side}_max")) & (F.col(f"{side}_min") != 0)
    return made.select("lang", "phrase", "a", ((F.octet_length("phrase") < 8 * LONGEST) & (same("before") | same("behind"))).alias("dropped"))


def _hashed(batches):
    """Chunks with the hashes of their words in place of words and counts."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            words = row.column("words")[0].values
            hashes = np.fromiter((_hash(str(w)) for w in words), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([row.column("lang"), pa.array([hashes.tobytes()]), row.column("codes")], ["lang", "hashes", "codes"])


def encode(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, hashes, codes), (lang, word, h, phrase, n)): the chunks, and all words of a language with their counts; phrase is a word's hash as bytes."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    made = store(rows.mapInArrow(_encode(CHUNK), "lang string, words array<string>, counts array<long>, codes binary"), "encoded")
    words = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    words = words.withColumn("h", F.xxhash64("word"))
    words = store(words.withColumn("phrase", F.unhex(F.lpad(F.hex("h"), 16, "0"))), "words")
    if words.groupBy("h").agg(F.min("word").alias("x"), F.max("word").alias("y")).filter("x <> y or h = 0").limit(1).count():
        raise ValueError("two words have one hash")
    return made.select("lang", "words", "codes").mapInArrow(_hashed, "lang string, hashes binary, codes binary"), words


def _scored(found: DataFrame, counts: DataFrame, langs: DataFrame) -> DataFrame:
    """found(lang, phrase, a, dropped) with f, the count of the first word, and the lowest score: score, l, r, n."""
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), (F.octet_length("phrase") / 8).cast("int") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring(phrase, 1, 8 * k)"), "right": F.expr("substring(phrase, 8 * k + 1)")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = cuts.join(F.broadcast(langs.select("lang", "n")), "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n"), whole("l") * whole("r"))
    least = F.min(F.struct(score.alias("score"), "k", "l", "r", "n")).alias("least")
    return cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("dropped").alias("dropped"), F.max(F.when(F.col("k") == 1, F.col("l"))).alias("f"), least).select("lang", "phrase", "a", "dropped", "f", "least.*")


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few rows of constants."""
    fields = [f.split() for f in schema.split(", ")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, (c, k) in zip(r, fields, strict=True)]) for r in rows])))


def _grown(chunks: DataFrame, frontier: DataFrame, frequent: bytes) -> DataFrame | None:
    """All candidates that begin with a word of the frontier, stored; None if there are none."""
    first = bit_table(keys_of(frontier).select("key"))
    tables: dict[int, bytes] = {}
    for m in range(2, LONGEST + 1) if first else ():
        counts = chunks.mapInArrow(_key_counts(m, first, frequent, dict(tables), FLUSH), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        table = bit_table(counts.filter(F.col("n") >= LEAST))
        if table is None:
            break
        tables[m] = table
    if not tables:
        return None
    found = _exact(chunks, first, frequent, tables).withColumn("first", F.substring("phrase", 1, 8))
    return store(found.join(frontier.select("lang", F.col("phrase").alias("first")), ["lang", "first"], "left_semi").drop("first"), "found")


def _endings(chunks: DataFrame, found: DataFrame, known: DataFrame, frequent: bytes) -> DataFrame | None:
    """(lang, phrase, n), stored: the endings of what was found, of two words or more, that no round has counted yet; None if there are none."""
    cut = found.filter(F.octet_length("phrase") > 16).withColumn("k", F.explode(F.sequence(F.lit(1), (F.octet_length("phrase") / 8).cast("int") - 2)))
    ends = store(cut.select("lang", F.expr("substring(phrase, 8 * k + 1)").alias("phrase")).distinct().join(known, ["lang", "phrase"], "left_anti"), "ends")
    wanted = store(keys_of(ends), "wanted")
    tables = {m: t for m in range(2, LONGEST) if (t := bit_table(wanted.filter(F.col("m") == m)))}
    if not tables:
        return None
    counted = _exact(chunks, None, frequent, tables).join(ends, ["lang", "phrase"], "left_semi")
    return store(counted.select("lang", "phrase", F.col("a").alias("n")), "endings")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score, by falling score, falling a and rising phrase.

    docs(text, lang, ...): a null text is empty, a null lang is `und`, A-Z are
    lower-cased; texts are split whole, however long, and all rows count, repeated ones
    each time. Ties in score and a follow the phrase's bytes. doc_id and further columns
    are not read; an empty table, or one without frequent phrases, gives no rows.
    Languages are a dimension: a few numbers of each are kept on the driver.
    """
    # all work in Python is done before this returns; what is left is a join
    with setting(docs.sparkSession, ARROW_BYTES, str(BATCH)):
        return _collocations(docs, top)


def _collocations(docs: DataFrame, top: int) -> DataFrame:
    spark: SparkSession = ship(docs.sparkSession)
    chunks, words = encode(docs)
    chunks = store(chunks, "chunks")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    n, most = {}, {}
    for r in sizes.collect():
        n[r.lang], most[r.lang] = r.n, r.most
    if not n:
        return spark.createDataFrame([], RESULT)
    often = words.filter(F.col("n") >= LEAST)
    frequent = bit_table(keys_of(often).select("key"))
    low, high = dict.fromkeys(n, LEAST - 1), dict.fromkeys(n, LEAST * STEP)
    level = dict.fromkeys(n, 0)
    known, survivors = [often.select("lang", "phrase", "n")], []
    langs = _rows(spark, "lang string, n long", list(n.items()))
    while open_ := [x for x in n if most[x] > low[x]]:
        limits = _rows(spark, "lang string, low long, high long", [(x, low[x], high[x]) for x in open_])
        frontier = often.join(F.broadcast(limits), "lang").filter("n > low and n <= high")
        found = _grown(chunks, frontier, frequent)
        if found is not None:
            known.append(found.select("lang", "phrase", F.col("a").alias("n")))
            endings = _endings(chunks, found, _union(known), frequent)
            if endings is not None:
                known.append(endings)
            survivors.append(store(_scored(found, _union(known), langs).filter("not dropped").drop("dropped"), "survivors"))
            placed = _union(survivors).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc())))
            level |= {r.lang: r.score for r in placed.filter(F.col("place") <= top).filter(F.col("place") == top).select("lang", "score").collect()}
        for x in open_:
            low[x] = high[x]
            # 1000 * n / f reaches the level up to this f; once there is a level, the next round is the last
            high[x] = max(low[x], 1000 * n[x] // level[x]) if level[x] else low[x] * STEP
            if level[x] and low[x] >= high[x]:
                most[x] = 0
    if not survivors:
        return spark.createDataFrame([], RESULT)
    best = _union(survivors).join(F.broadcast(_rows(spark, "lang string, level long", list(level.items()))), "lang").filter("score >= level")
    spelt = best.select("lang", "phrase", F.posexplode(F.sequence(F.lit(1), (F.octet_length("phrase") / 8).cast("int"))).alias("place", "k")).withColumn("one", F.expr("substring(phrase, 8 * k - 7, 8)"))
    spelt = spelt.join(often.select("lang", F.col("phrase").alias("one"), "word"), ["lang", "one"]).groupBy("lang", "phrase").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("ws"))
    out = best.join(spelt, ["lang", "phrase"]).withColumn("phrase", F.array_join("ws.word", " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
