"""URL filters, with DataFrame functions alone: prefix rules first, else logistic regression on hashed character n-grams.

The regression learns from a small labelled table of host and path. It is
trained in its dual form: the weights are a combination of the labelled rows, so
gradient steps run on one number a row, over the Gram matrix of the rows, in one
`aggregate` expression; then each hashed n-gram gets its weight. All urls are
scored by one pass that looks the weights up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path prefix, verdict); a rule holds for its host and all subdomains, the longest one wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Names that unwanted and ordinary sites go by, and the rest of the urls they are labelled in.
_UNWANTED = (
    "cheap-pills spam-farm casino-win free-bets adult-x payday-loans replica-watch click-farm xxx-video lottery-win pills-online link-spam "
    "best-casino adult-chat free-pills poker-bets cheap-meds viagra-shop porn-tube hot-sex slots-bonus seo-farm win-cash cheap-loans"
).split()
_ORDINARY = (
    "example thering ththre tharen onther station anterest ingles tiond there reading eston alther hereat nation theory blethe ththan "
    "library news garden science river weather cooking history travel museum school forum wiki photo music health market "
    "city-hall day-book garden-notes train-times open-science river-school weather-maps history-museum daily-news bird-watch home-cooking data-tables old-maps north-coast"
).split()
_ORDINARY += [a + b for a in ("th", "ther", "thth", "tion", "on", "re") for b in ("er", "on", "es", "ing", "ed", "at")]
_SUBS, _ENDS = ("", "www.", "blog.", "m."), ("example.org", "example.com", "example.net", "org")
_PATHS = ("/en/12", "/fr/841.html", "/de/9255", "/es/77/", "/en/4033.html", "/en/8423", "/fr/7")
#: Labelled urls (host, path, 1 for block); the two classes share all but the names.
LABELLED = tuple(
    (f"{_SUBS[(i + j) % 4]}{name}.{_ENDS[(i // 2 + 3 * j) % 4]}", _PATHS[(i + 2 * j) % 7], label)
    for label, names in ((1, _UNWANTED), (0, _ORDINARY))
    for i, name in enumerate(names)
    for j in range(3)
)
DIM = 4096
#: Rows of a labelled table, at most: training holds their Gram matrix in one row.
MOST_LABELLED = 2_000
STEPS, RATE, DECAY = 250, 3.0, 0.0005


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngrams(host: Column, path: Column) -> Column:
    """Distinct hashed character n-grams (3 to 5 characters) of ^host$ and of the path, as places below DIM."""
    sides = ((F.concat(F.lit("^"), host, F.lit("$")), "h"), (F.concat(path, F.lit("$")), "p"))
    parts = []
    for text, side in sides:
        for n in (3, 4, 5):
            found = F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), 1)
            parts.append(F.transform(found, lambda x, side=side: F.pmod(F.xxhash64(F.lit(side), x), F.lit(DIM)).cast("int")))
    return F.array_distinct(F.concat(*parts))


def train(labelled: DataFrame, dim: int = DIM) -> list[float]:
    """The bias and the weights of `dim` n-gram places, learned from labelled(host, path, label); zeros if it is empty.

    The labelled table is small (MOST_LABELLED rows, else an error): it is grouped
    into one row. Its features are scaled to length one. Nulls count as empty strings; rows without a label are
    left out.
    """
    labelled = labelled.filter("label is not null")
    if labelled.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"the labelled table has more than {MOST_LABELLED} rows")
    rows = labelled.select(
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("label").cast("double").alias("y")
    )
    rows = rows.withColumn("f", ngrams(F.col("host"), F.col("path"))).withColumn("f", F.when(F.size("f") > 0, F.col("f")).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("scale", 1 / F.sqrt(F.size("f").cast("double")))
    table = rows.agg(F.array_sort(F.collect_list(F.struct("host", "path", "y", "f", "scale"))).alias("t")).filter(F.size("t") > 0)
    gram = F.transform("t", lambda a: F.transform("t", lambda b: F.size(F.array_intersect(a["f"], b["f"])) * a["scale"] * b["scale"] + 1.0))
    one = table.select("t", gram.alias("k"), F.transform("t", lambda r: r["y"]).alias("y"))
    ones = F.aggregate("y", F.lit(0.0), lambda s, v: s + v)
    one = one.withColumn("balance", F.when((ones > 0) & (ones < F.size("y")), (F.size("y") - ones) / ones).otherwise(1.0))  # both classes count alike

    def step(alpha: Column, _: Column) -> Column:
        def row(k: Column, y: Column) -> Column:
            z = F.aggregate(F.zip_with(k, alpha, lambda x, a: x * a), F.lit(0.0), lambda s, v: s + v)
            return (y - 1 / (1 + F.exp(-z))) * F.when(y > 0.5, F.col("balance")).otherwise(1.0)

        residual = F.zip_with("k", "y", row)
        return F.zip_with(alpha, residual, lambda a, r: a * (1 - RATE * DECAY) + RATE * r / F.size("y"))

    start = F.transform("y", lambda _: F.lit(0.0))
    solved = one.select("t", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("alpha"))
    each = solved.select(F.explode(F.arrays_zip("t", "alpha")).alias("x")).select("x.t.f", "x.t.scale", "x.alpha")
    weights = each.select(F.explode("f").alias("place"), (F.col("scale") * F.col("alpha")).alias("w")).groupBy("place").agg(F.sum("w").alias("w"))
    bias = each.agg(F.coalesce(F.sum("alpha"), F.lit(0.0)).alias("w")).select(F.lit(-1).alias("place"), "w")
    out = [0.0] * (dim + 1)
    for place, w in weights.unionByName(bias).collect():  # at most dim + 1 rows
        out[place + 1] = w
    return out


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = None
    for rule_host, prefix, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        value = F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Per row of pages(page_id, url, ...): page_id, host, path, rule, verdict and p_block, the regression's probability.

    Null urls and urls without :// have an empty host and path; they and ties
    between equal urls are judged alike. Other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    if labelled is None:
        rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(y).alias("label")) for h, p, y in LABELLED]
        labelled = spark.range(1).select(F.inline(F.array(*rows)))
    weights = train(labelled)
    held = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # at most DIM + 1 numbers
    cut = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    cut = cut.withColumn("f", ngrams(F.col("host"), F.col("path")))
    total = F.aggregate("f", F.lit(0.0), lambda s, i: s + F.get(held, i + 1)) / F.sqrt(F.greatest(F.size("f"), F.lit(1)).cast("double"))
    scored = cut.withColumn("p_block", 1 / (1 + F.exp(-(total + weights[0])))).withColumn("r", rule_of(F.col("host"), F.col("path")))
    verdict = F.coalesce("r.verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "p_block")
