"""Ranked summaries: the union of the scans' top rows, and their sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import bucket_spreads

NOTHING = "No feature passed the thresholds."
#: A line for each kind of row of a ``combined`` table: what it is about, the figure that ranks it, and its support.
TEMPLATES = {
    "numeric_effect": "`{feature}`: standardised difference {cohens_d:+.2f} (means {mean_grad1:.2f} with the outcome, {mean_grad0:.2f} without; {n1} and {n0} rows)",
    "categorical_rr": "`{feature}` is `{level}`: {risk_ratio:.2f} times the rate of the other levels (95 % interval {rr_low:.2f} to {rr_high:.2f}; {n_level} rows)",
    "bucket_spread": "`{feature}`: the rate ranges over {spread:.1%} between buckets, {min_rate:.1%} to {max_rate:.1%} ({buckets} buckets of {n_total} rows)",
}
STEP = "`{feature}` in {label}: rate {grad_rate:.1%} ({n} rows)"
SIGN = {0: "falling or level series: rate {grad_rate:.1%} ({count} entities)", 1: "rising series: rate {grad_rate:.1%} ({count} entities)"}


def bucket_label(lo: float, hi: float) -> str:
    """Formatted on the driver: the exact binary value is rounded, as Spark's format_string doesn't."""
    return f"[{lo:.2f}, {hi:.2f})"


def combined(effects: DataFrame, ratios: DataFrame, buckets: DataFrame, num_k: int = 12, cat_k: int = 12, bucket_k: int = 5) -> DataFrame:
    """The top rows of each scan under one schema, with their ``kind``."""
    parts = [
        effects.orderBy(F.desc("score"), "feature").limit(num_k).withColumn("kind", F.lit("numeric_effect")),
        ratios.orderBy(F.desc("score"), "feature", "level").limit(cat_k).withColumn("kind", F.lit("categorical_rr")),
        bucket_spreads(buckets, bucket_k).withColumn("kind", F.lit("bucket_spread")),
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def selected_features(effects: DataFrame, ratios: DataFrame, num_k: int = 10, cat_k: int = 10) -> DataFrame:
    """(kind, feature) worth a plot: the best of each scan, categories not among the numeric ones already chosen."""
    best = lambda t, k: t.groupBy("feature").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "feature").limit(k).select("feature")
    numeric = best(effects, num_k)
    return numeric.select(F.lit("numeric").alias("kind"), "feature").union(best(ratios, cat_k).join(numeric, "feature", "left_anti").select(F.lit("categorical").alias("kind"), "feature"))


def bullets(table: DataFrame, buckets: DataFrame | None = None, slopes: DataFrame | None = None, ladder: str | None = None, most: int = 100) -> list[str]:
    """Lines of a ``combined`` table (a few dozen rows) by kind and rank, of the buckets of ``ladder`` (the widest spread, unless
    given) in order, and of the signs of the slopes."""
    rows = [r.asDict() for r in table.collect()]
    kinds = list(TEMPLATES)
    strength = lambda r: r["spread"] if r["kind"] == "bucket_spread" else r["score"]
    ranked = sorted(rows, key=lambda r: (kinds.index(r["kind"]), -strength(r), r["feature"]))
    out = [TEMPLATES[r["kind"]].format(**r) for r in ranked]
    widest = ladder or next((r["feature"] for r in ranked if r["kind"] == "bucket_spread"), None)
    if buckets is not None and widest:
        for r in buckets.filter(F.col("feature") == widest).orderBy("bucket_no").collect():  # one for each bucket
            out.append(STEP.format(**r.asDict(), label=bucket_label(r["lo"], r["hi"])))
    if slopes is not None:
        out += [SIGN[r["slope_pos"]].format(**r.asDict()) for r in slopes.orderBy("slope_pos").collect()]  # two at most
    return out[:most]


def markdown(lines: list[str]) -> str:
    return "\n".join(f"- {x}" for x in lines) if lines else NOTHING
