"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, html_extract, language_model, line_dedup, minhash_dedup, mixing, packing, prefix_trie, quality, simhash, substring_dedup, url_filter
from .common import crc_mod, store, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = store(simhash.fingerprint_edits(table(spark, sf_dir, "documents")), "simhash")
    # the search: every document whose id is divisible by 50, against all
    found = simhash.within_radius(made.filter("doc_id % 50 = 0"), made)
    asked = made.filter("doc_id % 50 = 0").select("doc_id", "fp").distinct().join(found, "fp")
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return made.join(asked, ["doc_id", "fp"], "left").select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_within"
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


#: crc32 of a decimal as SQL: one byte after the other, eight shifts each.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT))), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
)

#: As SQL: windows of op9 and op10 as texts, compared with each other; op11's mixture as a stretch of each source's repeated stream; op13's nodes as lists of turns.
ORACLE_SQL = {
    "op11_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, coalesce(sum(3 * source_size) OVER p, 0) AS full_before, coalesce(sum(w) OVER p, 0) AS w_before FROM s WINDOW p AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(CAST((SELECT sum(source_size) FROM s) - full_before AS DOUBLE) / CAST((SELECT sum(w) FROM s) - w_before AS DOUBLE)) AS level FROM r),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * w) AS target FROM s, l),
p AS (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS b FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((SELECT sum(greatest(0, least(CAST(floor(target) AS BIGINT), e * source_size + b + size) - e * source_size - b)) FROM range(3) q(e)) AS BIGINT) AS taken FROM p""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) q(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 100),
o AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = c.lang AND b.m > c.m AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * b.a >= 100 * c.a)),
k AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS ws FROM o),
s AS (SELECT k.lang, k.phrase, k.a, l.a AS l, r.a AS r, n, CAST(1000::HUGEINT * k.a * n // (l.a::HUGEINT * r.a) AS BIGINT) AS score, k FROM k JOIN n USING (lang)
JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM t QUALIFY rank <= 2000""",
    "op13_prefix_trie": rf"""
WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, CAST({_CRC32.format('c')} % 9 AS BIGINT) AS h FROM o),
b AS (SELECT h.c, list_concat(coalesce(o.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o ON o.c = h.c - h.c % 5),
m AS (SELECT c, d, ts[1:d] AS pre, len(ts) = d AS ends FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM b)),
n AS (SELECT d, pre, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS es FROM m GROUP BY d, pre),
k AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(pre[d].t)) ELSE 0 END AS saved FROM n LEFT JOIN k USING (d, pre)),
u AS (SELECT a.d, a.pre, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.saved) AS saved_tokens FROM v a JOIN v x ON x.d >= a.d AND x.pre[1:a.d] = a.pre GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(v.es) AS ends_sha256
FROM v JOIN u ON v.d = u.d AND v.pre = u.pre LEFT JOIN v p ON p.d = v.d - 1 AND p.pre = v.pre[1:v.d - 1]""",
    "op9_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, l, array_to_string(ws[p:p + l - 1], ' ') AS w FROM (SELECT item_id, ws, least(10, len(ws)) AS l, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, l, p, array_to_string(ws[p:p + l - 1], ' ') AS w FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM iw) WHERE len(ws) >= l)),
hit AS (SELECT doc_id, item_id, p, l FROM dw JOIN iw USING (l, w)),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM d WHERE len(ws) >= 20)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM later) GROUP BY doc_id),
kept AS (SELECT doc_id, array_to_string(list(word ORDER BY q), ' ') AS text, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM d) k WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(qs) AS q FROM gone) g WHERE g.doc_id = k.doc_id AND g.q = k.q) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_line_dedup": op5_line_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_simhash_fingerprints": op7_simhash_fingerprints,
    "op8_url_filter": op8_url_filter,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_mixing": op11_mixing,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}
