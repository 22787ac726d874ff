"""Mixing, collocations and the prefix trie against plain Python, with every awkward case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelens.llm import collocations, mixing, prefix_trie

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("sid", "target", "size", "begin", "bucket", "n", "phrase", "score", "conv", "depth", "seg", "x", "y", "part", "row", "h")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in df.columns})


# mixing


def sizes_of(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]


def wanted_targets(size):
    """Shares of the whole by weight; what is above three times a source's size is dealt to the others, again and again."""
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, rest = {}, sum(size.values())
    while True:
        free = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            return {s: float(3 * size[s]) if s in full else level * weight[s] for s in names}
        for s in over:
            full[s] = 3 * size[s]
            rest -= full[s]


def check_mix(spark, rows, block):
    df = clashing(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS))
    got = mixing.taken(df, block).collect()
    size, total = sizes_of(rows), Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    targets = wanted_targets(total)
    source_of = {n: s for n, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.source_size) for r in got) == sorted((i is not None, i or 0, n, total[s]) for (i, _, s), n in zip(rows, size))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    pieces, laid, sources = mixing.mix(df, block)
    sources = {source_of[r.sid]: r for r in sources.collect()}
    by_source = Counter()
    for r in pieces.collect():
        by_source[source_of[r.sid]] += r.n_words
        assert r.n_words > 0
    for s, t in targets.items():
        assert sources[s].target == pytest.approx(t, rel=1e-12) and by_source[s] == int(sources[s].target)
    again = mixing.taken(df.orderBy(F.rand(3)), block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    return pieces, sources, source_of


AWKWARD = [None, "", " \t\n", "one", "one two three", "x" * 50_000, "w " * 9_000, "Ünï 汉字 \x0b cödé", "a b c d"]


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), f"s{rng.choice(7, p=[0.5, 0.2, 0.1, 0.1, 0.06, 0.03, 0.01])}") for i in range(300)]
    rows += [(1000 + i, t, None if i % 2 else "é") for i, t in enumerate(AWKWARD)] + [(None, "null id", "s1"), (None, "null id", "s1"), (5, "again five", "s0"), (5, "again five", "s0"), (6, "", "empty source")]
    for block in (64, 8_192):
        pieces, sources, source_of = check_mix(spark, rows, block)
    # the words of a source are whole texts in one order, each as often as the next, but for the last turn
    slots = pieces.sparkSession  # noqa: F841
    pieces, _, _ = mixing.mix(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS), 64)
    order = [r.sid for r in pieces.groupBy("position").agg(F.first("sid").alias("sid")).orderBy("position").collect()]
    for sid in set(order):
        hits = np.cumsum(np.array(order) == sid)
        assert np.abs(hits - np.arange(1, len(order) + 1) * hits[-1] / len(order)).max() <= np.log2(len(order)) + 1


def test_mixing_of_little(spark):
    assert mixing.taken(spark.createDataFrame([], DOCS)).count() == 0
    empty = mixing.taken(spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], DOCS)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in empty) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    check_mix(spark, [(1, "one two", "a")], 8)


def test_positions_are_a_permutation(spark):
    for ends in ([1], [3], [4, 9], [5, 6, 17, 64]):
        rows = spark.createDataFrame([(i, n * 10, float(n * 10)) for i, n in enumerate(np.diff([0, *ends]).tolist())], "sid int, source_size long, target double")
        got = mixing.schedule(rows, 10).orderBy("position").collect()
        assert len(got) == ends[-1] == len({r.position for r in got})
        for sid in range(len(ends)):
            assert [r.slot_rank for r in got if r.sid == sid] == list(range(int(np.diff([0, *ends])[sid])))


# collocations


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").encode().lower().decode()):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, cs in f.items():
        candidates = {p: a for p, a in cs.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, b in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * b >= 100 * candidates[p[i:j]]}
        found = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (cs[p[:k]] * cs[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), cs[p[:k]], cs[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def collocation_rows(seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(30)] + ["Éa", "BIG", "x-y", "don't", "汉字"]
    made = []
    for i in range(120):
        words = list(rng.choice(vocabulary, int(rng.integers(0, 80)), p=np.arange(len(vocabulary), 0, -1) / sum(range(len(vocabulary) + 1))))
        for _ in range(int(rng.integers(0, 4))):
            words.insert(int(rng.integers(0, len(words) + 1)), ["lorem ipsum dolor sit amet", "a a a a", "Red  herring", "one, two. three", "one two three\nfour"][int(rng.integers(0, 5))])
        made.append((" ".join(words), [None, "en", "en", "en", "fr", "und"][int(rng.integers(0, 6))]))
    return made + [(None, "en"), ("", None), ("...", "xx"), ("x" * 20_000, "en"), ("a " * 3_000, "fr")] + [("same row here. Same Row Here", "en")] * 12


@pytest.mark.parametrize("least, top, step, chunk", [(5, 2_000, 64, 1 << 18), (5, 12, 2, 300), (9, 3, 3, 50)])
def test_collocations(spark, monkeypatch, least, top, step, chunk):
    for name, value in (("LEAST", least), ("STEP", step), ("CHUNK", chunk), ("FLUSH", 500), ("FILTER_BITS", 12)):
        monkeypatch.setattr(collocations, name, value)
    # few bits, so that many places are hit by chance; the settings reach the tasks within the functions
    rows = collocation_rows()
    df = clashing(spark.createDataFrame([(i % 7, t, lang, None, 0) for i, (t, lang) in enumerate(rows)], DOCS))
    assert sorted(map(tuple, collocations.collocations(df, top).collect())) == brute_collocations(rows, least, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a rare pair", "en", None, 0), (2, None, None, None, 0)], DOCS)).count() == 0


# prefix trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    built = {c: (lambda h: turns.get(c - c % 5, [])[:h] + v[h:])(zlib.crc32(str(c).encode()) % 9) for c, v in turns.items()}
    members, below = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below[k]) if below[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in below[k])
    ends = lambda k, m: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(below[k]), leaves[k], saved[k], hashlib.sha256(ends(k, m).encode()).hexdigest()) for k, m in members.items())


def conversation_rows(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(60), 1_000_003, 5_000_000_000, 77, 2_004]:
        for t in range(int(rng.integers(0, 14))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3))], [f"t{t} {rng.integers(0, 2)}", "same", "", None, "é汉"][int(rng.integers(0, 5))]))
    rows += [(200, None, "user", "first"), (200, 3, "a", "b"), (200, 3, "ab", ""), (200, 3, "", "ab"), (201, 1, "u", "x"), (201, 1, "u", "x"), (None, 1, "u", "lost"), (205, 0, None, None)]
    rows += [(300, t, "user", f"turn {t}") for t in range(50)] + [(301, t, "user", f"turn {t}") for t in range(50)] + [(400 + i, t, "user", f"copy {t}") for i in range(40) for t in range(3)]
    return rows


def trie_of(spark, rows):
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.trie(df).collect())


@pytest.mark.parametrize("segment, shard, span", [(4_096, 200_000, 4_096), (4, 60, 3)])
def test_trie(spark, monkeypatch, segment, shard, span):
    for name, value in (("SEGMENT", segment), ("SHARD", shard), ("SPAN", span)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = conversation_rows()
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_little(spark):
    assert trie_of(spark, []) == []
    one = [(7, None, None, None)]
    assert trie_of(spark, one) == brute_trie(one)


def test_conversations_over_several_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = [(3, t, "u", str(t)) for t in range(300)] + [(c, t, "u", str(t)) for c in (1, 8) for t in range(4)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        got = prefix_trie.ordered(df).select("conv", "pos", "n_bytes").collect()
        assert sorted(map(tuple, got)) == sorted((c, t + 1, len(x)) for c, t, _, x in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_node_table():
    rng = np.random.default_rng(5)
    keys = np.unique(prefix_trie._keys(rng.integers(-9, 9, 5_000), rng.integers(-(1 << 62), 1 << 62, 5_000)))
    table = prefix_trie.NodeTable(keys)
    slots = table.slots(keys)
    assert sorted(slots) == list(range(len(keys))) and (table.keys[slots] == keys).all()
    other = prefix_trie._keys(rng.integers(20, 30, 100), rng.integers(0, 1 << 62, 100))
    assert (table.slots(other) == -1).all() and len(prefix_trie.NodeTable(keys[:0]).keys) == 0


def test_passes_over_chunks_hold_one_chunk(spark):
    import tracemalloc

    import pyarrow as pa

    n, rng = 1 << 16, np.random.default_rng(5)
    hashes, codes = pa.array([np.arange(1, 5_001).tobytes()] * 64), pa.array([rng.integers(1, 5_001, n).astype(np.uint32).tobytes() for _ in range(64)])
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 64), hashes, codes], ["lang", "hashes", "codes"])
    every = collocations.zlib.compress(b"\xff" * (1 << 10))
    got, most = Counter(), 0
    tracemalloc.start()
    for out in collocations._key_counts(2, every, every, {}, 1 << 21)(iter([batch])):
        most = max(most, out.num_rows)
        got["n"] += sum(out.column("n").to_numpy())
        got["rows"] += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["n"] == 64 * (n - 1) and got["rows"] > n
    assert most <= collocations.ROWS
    # two million keys take 16 MB as they come and 16 MB in order, and once more what tells their runs apart
    assert peak < 72e6, peak
