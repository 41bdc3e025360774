"""Outcome scans: effect sizes, risk ratios, quantile buckets and slice stability.

Each scan is one plan: moments of numeric features are one aggregation with a slot for each (``wide``); levels are unpivoted
to (feature, level) rows and aggregated, with partial aggregation before the shuffle; nothing loops over features or levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import wide
from .quantiles import quantiles
from .wide import outcome_moments

MIN_N, MAX_LEVELS, QUANTILES = 25, 60, (0.0, 0.25, 0.5, 0.75, 1.0)


def unpivot_numeric(df: DataFrame, features: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """(keep.., feature, value) with values as doubles and without missing ones."""
    rows = df.select(*keep, *(E.plain(F.col(f"`{c}`")).alias(c) for c in features))
    if not features:
        return rows.select("*", F.lit("").alias("feature"), F.lit(0.0).alias("value")).limit(0)
    ids = [c for c in rows.columns if c not in features]
    return rows.unpivot(ids, list(features), "feature", "value").filter(F.col("value").isNotNull())


def unpivot_text(df: DataFrame, features: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """(keep.., feature, level) with levels as strings and without missing ones."""
    rows = df.select(*keep, *(F.col(f"`{c}`").cast("string").alias(c) for c in features))
    if not features:
        return rows.select("*", F.lit("").alias("feature"), F.lit("").alias("level")).limit(0)
    ids = [c for c in rows.columns if c not in features]
    return rows.unpivot(ids, list(features), "feature", "level").filter(F.col("level").isNotNull())


def _moments(y: str = "y", value: str = "value") -> list[Column]:
    one, zero = F.when(F.col(y) == 1, F.col(value)), F.when(F.col(y) == 0, F.col(value))
    return [
        F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("m1"), F.avg(zero).alias("m0"),
        F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"),
    ]


def effect_sizes(df: DataFrame, outcome: str, features: Sequence[str], min_n: int = MIN_N) -> DataFrame:
    """Cohen's d of each numeric feature between outcomes 1 and 0, by |d| * sqrt(n)."""
    m = outcome_moments(df, outcome, features)
    c = {k: F.col(k) for k in ("m1", "m0", "v1", "v0", "n1", "n0")}
    d = m.filter((c["n1"] >= min_n) & (c["n0"] >= min_n)).withColumn("cohens_d", E.pooled_d(**c)).filter("cohens_d is not null")
    d = d.withColumn("abs_d", F.abs("cohens_d")).withColumn("score", F.col("abs_d") * F.sqrt(c["n1"] + c["n0"]))
    out = d.select("feature", "cohens_d", "abs_d", F.col("m1").alias("mean_grad1"), F.col("m0").alias("mean_grad0"), "n1", "n0", "score")
    return out.orderBy(F.desc("score"), "feature")


def standardised_gaps(df: DataFrame, outcome: str, features: Sequence[str], min_n: int = 20, top: int = 12) -> DataFrame:
    """Mean gaps over the root mean of both variances, which group sizes don't weight."""
    m = outcome_moments(df, outcome, features).filter((F.col("n1") >= min_n) & (F.col("n0") >= min_n))
    gap = (F.col("m1") - F.col("m0")) / F.nullif(F.sqrt((F.col("v1") + F.col("v0")) / 2), F.lit(0.0))
    out = m.select("feature", gap.alias("std_gap"), F.col("m1").alias("mean_graduated"), F.col("m0").alias("mean_not"))
    return out.orderBy(F.abs("std_gap").desc_nulls_last(), "feature").limit(top)


def level_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, level, n), frequent levels first."""
    return unpivot_text(df, features).groupBy("feature", "level").agg(F.count("*").alias("n")).orderBy("feature", F.desc("n"), "level")


def level_rates(df: DataFrame, outcome: str, features: Sequence[str], k: int) -> DataFrame:
    """(feature, level, n, rate): the k most frequent levels of each feature (ties to the smaller one) and their mean outcome, in one plan."""
    t = unpivot_text(df, features, [F.col(outcome).alias("y")]).groupBy("feature", "level").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    nth = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("n"), "level"))  # a row for each level
    return t.withColumn("_nth", nth).filter(F.col("_nth") <= k).drop("_nth")


def screened_categories(df: DataFrame, features: Sequence[str], max_levels: int = MAX_LEVELS) -> list[str]:
    """Of the features, those that aren't identifiers and have at most ``max_levels`` levels; one pass that holds no more levels than that."""
    named = [c for c in features if "id" not in c.lower()]
    return [c for c, levels, rows in wide.level_numbers(df, named, max_levels) if levels is not None and levels <= max(200, 0.5 * rows)]


def level_numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, levels, rows): exact numbers of levels, computed at once (``wide.level_numbers``)."""
    return df.sparkSession.createDataFrame(wide.level_numbers(df, features), "feature string, levels long, rows long")


def risk_ratios(df: DataFrame, outcome: str, features: Sequence[str], min_level_n: int = MIN_N) -> DataFrame:
    """Smoothed risk ratio of each level against the feature's other levels, with a 95 % interval.

    Rows without an outcome count as not positive; rows without a value count nowhere.
    """
    rows = unpivot_text(df, features, [F.col(outcome).alias("y")])
    t = rows.groupBy("feature", "level").agg(F.count("*").alias("n_level"), F.sum(E.flag(F.col("y") == 1)).alias("pos"))
    whole = W.partitionBy("feature")  # a row for each level
    t = t.withColumn("n_rest", F.sum("n_level").over(whole) - F.col("n_level")).withColumn("pos_rest", F.sum("pos").over(whole) - F.col("pos"))
    t = t.filter(F.col("n_level") >= min_level_n)
    p1, p0 = E.risk(F.col("pos"), F.col("n_level")), E.risk(F.col("pos_rest"), F.col("n_rest"))
    t = t.withColumns({"grad_rate_level": p1, "grad_rate_rest": p0, "risk_ratio": p1 / p0, "_se": E.log_ratio_error(F.col("pos"), F.col("n_level"), F.col("pos_rest"), F.col("n_rest"))})
    log = F.ln("risk_ratio")
    t = t.withColumns({"rr_low": F.exp(log - 1.96 * F.col("_se")), "rr_high": F.exp(log + 1.96 * F.col("_se")), "abs_log_rr": F.abs(log)})
    t = t.withColumn("score", F.col("abs_log_rr") * F.sqrt(F.least("n_level", "n_rest")))
    return t.select("feature", "level", "n_level", "n_rest", "grad_rate_level", "grad_rate_rest", "risk_ratio", "rr_low", "rr_high", "abs_log_rr", "score").orderBy(F.desc("score"), "feature", "level")


def quantile_edges(df: DataFrame, features: Sequence[str], q: Sequence[float] = QUANTILES) -> DataFrame:
    """(feature, edges): distinct exact quantiles, computed at once; a constant feature gets one bucket around its value."""
    e = quantiles(df, features, q).select("feature", F.array_distinct("quantiles").alias("edges"))
    one = F.size("edges") < 2
    around = F.array(F.element_at("edges", 1) - 1e-6, F.element_at("edges", 1) + 1e-6)
    return e.select("feature", F.when(one, around).otherwise(F.col("edges")).alias("edges"))


def bucket_summary(df: DataFrame, outcome: str, features: Sequence[str], q: Sequence[float] = QUANTILES) -> DataFrame:
    """(feature, bucket_no, lo, hi, n, grad_rate, edges) over rows with a value and an outcome; empty buckets have no row.

    Computed at once, a row for each bucket; the table is read once and kept while it is.
    """
    rows = df.select(F.col(f"`{outcome}`").cast("double").alias("_y"), *(E.plain(F.col(f"`{c}`")).alias(c) for c in features)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        edges = {r["feature"]: list(r["edges"]) for r in quantile_edges(rows, features, q).collect()}
        counted = wide.bucket_counts(rows, "_y", edges)
    finally:
        rows.unpersist()
    out = [(c, k, edges[c][k - 1], edges[c][k], n, y / n, edges[c]) for c, k, n, y in sorted(counted)]
    return df.sparkSession.createDataFrame(out, "feature string, bucket_no int, lo double, hi double, n long, grad_rate double, edges array<double>")


def slice_stability(df: DataFrame, outcome: str, feature: str, confounders: Sequence[str], numeric: bool, min_n: int = 50, levels: int = 12) -> DataFrame:
    """A feature's association inside each frequent level of each confounder: (confounder, level, metric, value, n).

    Numeric: the mean difference, with 20 rows of both outcomes. Text: the smoothed risk ratio of the slice's
    most frequent level. Ties of frequency go to the smaller level.
    """
    value = (E.plain(F.col(feature)) if numeric else F.col(feature).cast("string")).alias("_value")
    rows = unpivot_text(df, confounders, [F.col(outcome).alias("_y"), value]).withColumnRenamed("feature", "confounder")
    sizes = rows.groupBy("confounder", "level").agg(F.count("*").alias("n"))
    ranked = sizes.withColumn("_r", F.row_number().over(W.partitionBy("confounder").orderBy(F.desc("n"), "level")))
    rows = rows.join(F.broadcast(ranked.filter((F.col("_r") <= levels) & (F.col("n") >= min_n)).drop("_r")), ["confounder", "level"])  # at most 12 for each
    if numeric:
        t = rows.groupBy("confounder", "level", "n").agg(*_moments("_y", "_value")).filter("n1 >= 20 and n0 >= 20")
        return t.select("confounder", "level", F.lit("mean_diff").alias("metric"), (F.col("m1") - F.col("m0")).alias("value"), "n")
    known = rows.filter("_value is not null").groupBy("confounder", "level", "_value").agg(F.count("*").alias("_n"), F.sum(E.flag(F.col("_y") == 1)).alias("_pos"))
    within = W.partitionBy("confounder", "level")
    known = known.withColumns({"_all": F.sum("_n").over(within), "_allpos": F.sum("_pos").over(within), "_r": F.row_number().over(within.orderBy(F.desc("_n"), "_value"))})
    top = known.filter("_r = 1").join(F.broadcast(ranked.select("confounder", "level", "n")), ["confounder", "level"])
    rr = E.risk(F.col("_pos"), F.col("_n")) / E.risk(F.col("_allpos") - F.col("_pos"), F.col("_all") - F.col("_n"))
    return top.select("confounder", "level", F.concat(F.lit("RR("), "_value", F.lit(")")).alias("metric"), rr.alias("value"), "n")


def bucket_spreads(buckets: DataFrame, top: int | None = 5) -> DataFrame:
    """(feature, n_total, buckets, min_rate, max_rate, spread), widest first."""
    t = buckets.groupBy("feature").agg(F.sum("n").alias("n_total"), F.count_distinct("bucket_no").alias("buckets"), F.min("grad_rate").alias("min_rate"), F.max("grad_rate").alias("max_rate"))
    t = t.withColumn("spread", F.col("max_rate") - F.col("min_rate")).orderBy(F.desc("spread"), F.desc("n_total"), "feature")
    return t if top is None else t.limit(top)
