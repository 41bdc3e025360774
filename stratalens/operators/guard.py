"""Guards against leakage and sparse columns, and canonical credit bins."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as E
from ..functions.names import LEAKY, SUSPECT, is_leaky, is_suspect

MAX_MISSING, EQUAL_SHARE, LEVEL_MIN_N, ENOUGH = 0.60, 0.985, 50, 100


def normalize_missing(df: DataFrame) -> DataFrame:
    """Text columns with spellings of "not available" as null."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: E.missing_category(F.col(f"`{c}`")) for c in texts}) if texts else df


def with_credit_bins(df: DataFrame) -> DataFrame:
    """``credit_window_canon`` from a numeric credits column, else from the middle of a text range."""
    kinds = dict(df.dtypes)
    for c in ("attempted_credits", "earned_credits", "credits_at_checkpoint", "credits_by_etm"):
        if kinds.get(c, "string") != "string":
            return df.withColumn("credit_window_canon", E.credit_bin(E.plain(F.col(c))))
    if "credit_window" in kinds:
        return df.withColumn("credit_window_canon", E.credit_bin(E.credit_midpoint(F.col("credit_window"))))
    return df


def missing_rates(df: DataFrame) -> DataFrame:
    """(column, missing_pct) of all columns in one pass."""
    return _by_column(df, {c: F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in df.columns}, "missing_pct")


def _by_column(df: DataFrame, aggregates: dict, name: str) -> DataFrame:
    wide = df.agg(*(a.alias(c) for c, a in aggregates.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(name)) for c in aggregates)))
    return wide.select(pairs.alias("_p")).select("_p.column", f"_p.{name}")


def equality_shares(df: DataFrame, outcome: str) -> DataFrame:
    """(column, equal_share) of rows on which a column equals the outcome or its opposite; null with too few rows."""
    y = F.col(outcome)
    shares = {}
    for c in df.columns:
        if c != outcome:
            x = E.number(F.col(f"`{c}`"))
            near = lambda to, x=x: F.avg(F.when(x.isNotNull() & y.isNotNull(), (F.abs(x - to) <= 1e-8 + 1e-5 * F.abs(to)).cast("double")))
            shares[c] = F.when((F.count(x) >= ENOUGH) & (F.count(y) >= ENOUGH), F.greatest(near(y), near(1 - y)))
    return _by_column(df, shares, "equal_share")


@dataclass
class Report:
    dropped_from_main: list[str]
    warn_columns: list[str]
    na_heavy_cols: list[str]
    name_denied_cols: list[str]
    equal_to_outcome_cols: list[str]
    config: dict

    def as_dict(self) -> dict:
        return asdict(self)


def sanitize(df: DataFrame, outcome: str) -> tuple[DataFrame, DataFrame, Report]:
    """(main, quarantine, report): leaky names, sparse columns and copies of the outcome go to quarantine."""
    if outcome not in df.columns:
        raise ValueError(f"no outcome column {outcome}")
    df = with_credit_bins(normalize_missing(df))
    denied = [c for c in df.columns if c != outcome and is_leaky(c)]
    rest = [c for c in df.columns if c != outcome and c not in denied]
    kept = df.select(outcome, *(f"`{c}`" for c in rest))
    sparse = {r["column"] for r in missing_rates(kept).filter(F.col("missing_pct") > MAX_MISSING).collect()} - {outcome}  # a row for each column
    left = kept.drop(*sparse)
    equal = {r["column"] for r in equality_shares(left, outcome).filter(F.col("equal_share") >= EQUAL_SHARE).collect()} if len(left.columns) > 1 else set()
    dropped = sorted({*denied, *sparse, *equal})
    config = {"MAX_MISSING_PCT": MAX_MISSING, "CORR_EQUIV_THR": EQUAL_SHARE, "LEVEL_MIN_N": LEVEL_MIN_N, "DENY_PATTERNS": list(LEAKY), "WARN_PATTERNS": list(SUSPECT)}
    report = Report(dropped, [c for c in rest if is_suspect(c)], sorted(sparse), denied, sorted(equal), config)
    return df.drop(*dropped), df.select(outcome, *(f"`{c}`" for c in dropped)), report
