"""The pipeline's stages: each takes effect and keeps what it should."""

import re

import pytest
from pyspark.sql import functions as F

from tapelens.llm.minhash_dedup import near_duplicates

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.store(stage(spark, docs, SF), "stage")
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        after = out.count()
        assert after == before if name == "line dedup" else 0 < after < before, name
        docs, before = out, after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ids = {p.doc_id for r in packed for p in r.pieces}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.n_tokens == sum(p.n_tokens for p in r.pieces) <= r.capacity for r in packed)


AWKWARD = [None, "", " ", "one line\n\n\tone line\r\n", "x" * 20_000, "word " * 6_000, "Ünï cödé 汉字 " * 5]


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, repeated texts, very long and empty ones, and columns whose names the operators use inside."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(10_000_000 + i, t, None if i % 2 else "en", None, None) for i, t in enumerate(AWKWARD + AWKWARD[2:])]
    docs = base.limit(60).unionByName(spark.createDataFrame(rows, base.schema))
    docs = docs.withColumns({c: F.lit(1) for c in ("score", "h", "band", "comp", "removed", "n_lines", "items", "sig", "shard", "bin")})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.store(stage(spark, docs, SF), "stage")
        assert out.columns == columns, name
        assert out.select("doc_id").distinct().count() == out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, SF), "stage")
        assert docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_each_stage_does_what_its_operator_says(spark):
    """Each stage against plain Python over its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, line, near, bench, _ = (f for _, f in corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {" ".join(w[p : p + 10]) for w in items for p in range(max(1, len(w) - 9)) if w}
    sizes = {len(w.split(" ")) for w in windows}

    def leaks(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        return any(" ".join(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))

    assert {r.doc_id for r in bench(spark, docs, SF).collect()} == {i for i, t in texts.items() if not leaks(t)}
    kept = {r.doc_id: r.text for r in line(spark, docs, SF).collect()}
    seen = set()
    for i in sorted(texts):
        lines = [x.strip("\t\n\x0b\x0c\r ") for x in (kept[i] or "").split("\n")]
        own = [x for x in lines if x]
        assert len(own) == len(set(own)) and not seen & set(own)
        seen |= set(own)
    assert {r.doc_id for r in near(spark, docs, SF).collect()} == {r.doc_id for r in near_duplicates(docs).filter("doc_id = class_id").collect()}


def test_stages_on_null_and_repeated_ids(spark):
    """Each row stands for itself: a clean row is kept whatever row shares its id, and none comes twice."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 200").first().text
    rows = [(None, "a plain line of its own", "en", None, 0), (None, None, "en", None, 0), (None, leak, "en", "s", 0), (3, "one more text with the id three", "en", None, 0), (3, leak, "en", None, 0), (4, "the very same row", "en", None, 0), (4, "the very same row", "en", None, 0)]
    odd = spark.createDataFrame(rows, base.schema)
    docs = base.unionByName(odd)
    _, line, near, bench, _ = (f for _, f in corpus_pipeline.STAGES)
    count = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())
    kept = count(bench(spark, docs, SF))
    assert [r for r in kept if r[2] == leak] == [] and {(False, 0, "a plain line of its own"), (False, 0, ""), (True, 3, "one more text with the id three")} <= set(kept)
    assert sum(r == (True, 4, "the very same row") for r in kept) == 2
    lines = count(line(spark, docs, SF))
    assert len(lines) == docs.count() and sum(r[:2] == (True, 4) and r[2] == "the very same row" for r in lines) == 1 and sum(r[2] == leak for r in lines) == 1
    once = count(near(spark, docs, SF))
    assert sum(r[2] == leak for r in once) == 1 and sum(r[2] == "the very same row" for r in once) == 1 and len(set(once)) == len(once)
    for _, stage in corpus_pipeline.STAGES[:1]:
        assert corpus_pipeline.store(stage(spark, docs, SF), "odd").columns == docs.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect()
    assert sum(len(r.pieces) for r in packed) == len(rows)
