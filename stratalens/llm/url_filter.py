"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what they leave open.

The trees learn from labelled URLs: those that a rule decides and that are not held out. Features are the
lengths, depth, digit ratio, character entropy and parameter counts of the URL, and the share of
blocked training URLs under its host's last two labels and, with equal weight for each two, under the last one. Shares are
shrunk towards that of all, and a training row's own fold has no part in its shares, so that they don't give its label
away: folds of rows for the two labels, folds of hosts for the last one. Training reads a bounded sample in
hash order; scoring is a projection and two joins with the sample's suffixes (at most a row for each
training row), all with DataFrame functions and Spark's own boosted trees.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule; it is judged by the
trees like any other. If the sample has one label only, that is the verdict of all open URLs; without any,
they are allowed. Equal rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, held_out, written

#: (verdict, rule): the rule's host, then its path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Labelled rows that training reads at most; the trees' number and depth.
TRAIN_ROWS, TREES, DEPTH = 8_000, 16, 3
#: Features that a node may ask: a third, drawn anew, so that suffixes' shares don't stand in for all others.
ASKED = "onethird"
#: Rows (or hosts) that the share of all counts for in a suffix's share, and folds of the training rows.
SHRINKAGE, FOLDS = 5.0, 5
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "secure", "last_share", "two_share",
]


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path."""
    url = F.col("url").cast("string")
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1))
    after = F.coalesce(F.substring_index(after, "?", 1), F.lit(""))
    host = F.substring_index(after, "/", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumn("host", lowered).withColumn("path", F.substring(after, F.length(host) + 1, F.length(after)))


def _fits(rule: str) -> Column:
    """Whether the rule's host is the URL's or above it, and its path begins the URL's."""
    host, _, path = rule.partition("/")
    on_host = (F.col("host") == host) | F.col("host").endswith("." + host)
    return on_host & F.col("path").startswith("/" + path)


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` with the longest fitting rule and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for how, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        rule = F.when(_fits(text), F.lit(text)).otherwise(rule)
        verdict = F.when(_fits(text), F.lit(how)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def _lexical(rows: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    count = lambda text, marks: (F.length(text) - F.length(F.translate(text, marks, ""))).cast("double")
    return rows.withColumns(
        {
            "url_length": size,
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/"),
            "labels": count(F.col("host"), "."),
            "digit_ratio": count(url, string.digits) / size,
            "entropy": entropy,
            "parameters": count(url, "&=;"),
            "hyphens": count(F.col("host"), "-"),
            "secure": url.startswith("https://").cast("double"),
            "last": F.substring_index("host", ".", -1),
            "two": F.substring_index("host", ".", -2),
        }
    )


def _with_shares(rows: DataFrame, sample: DataFrame, overall: float, fold: int | None = None) -> DataFrame:
    """``rows`` with two_share and last_share, of the sample without a fold; a suffix without a training row has the share of all."""
    others = sample if fold is None else sample.filter(F.col("row_fold") != fold)
    hosts = (sample if fold is None else sample.filter(F.col("host_fold") != fold)).groupBy("last", "two").agg(F.avg("label").alias("label"))
    for key, of in (("two", others), ("last", hosts)):
        share = (F.sum("label") + SHRINKAGE * overall) / (F.count("*") + SHRINKAGE)
        shares = of.groupBy(F.col(key).alias("suffix_")).agg(share.alias(f"{key}_share"))
        rows = rows.join(F.broadcast(shares), F.col(key) == F.col("suffix_"), "left").drop("suffix_")  # at most TRAIN_ROWS rows
    return rows.withColumns({c: F.coalesce(c, F.lit(overall)) for c in ("two_share", "last_share")})


def _training(sample: DataFrame, overall: float) -> DataFrame:
    """The sample with the shares of the other folds."""
    out = None
    for fold in range(FOLDS):
        two = _with_shares(sample.filter(F.col("row_fold") == fold), sample, overall, fold).drop("last_share")
        host = _with_shares(sample.filter(F.col("host_fold") == fold), sample, overall, fold).select("number", "last_share")
        out = (two, host) if out is None else (out[0].unionByName(two), out[1].union(host))
    return out[0].join(out[1], "number")


def verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    rows = _lexical(ruled(parsed(pages.select("page_id", "url")), rules))
    sample = rows.filter(F.col("ruled").isNotNull() & ~held_out("page_id")).withColumn("label", (F.col("ruled") == "block").cast("double"))
    sample = bounded_sample(sample.drop("rule", "ruled"), "page_id", TRAIN_ROWS, "page_id", "url").withColumn("number", F.monotonically_increasing_id())
    folds = {"row_fold": F.pmod(F.xxhash64("page_id", "url", "number"), F.lit(FOLDS)), "host_fold": F.pmod(F.xxhash64("two"), F.lit(FOLDS))}
    sample = written(sample.withColumns(folds), "labelled_urls")
    overall = sample.agg(F.avg("label")).first()[0]  # the share of all
    if overall in (None, 0.0, 1.0):
        by_method = F.lit("block" if overall else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    stored = written(_training(sample, overall).select(*FEATURES, "label", "page_id", "url"), "training_urls")
    training = assembler.transform(stored.coalesce(1).sortWithinPartitions("page_id", "url"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy=ASKED).fit(training.select("features", "label"))
    discard(stored)
    scored = model.transform(assembler.transform(_with_shares(rows, sample, overall)))
    by_method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"))
