"""Whole studies: the feature build from the two sheets, and the insight scan over a wide table."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.names import numeric_features, resolve_col, standardize_columns, std_col
from ..operators import features, guard, keys, scan, synth, trajectory, wide
from ..sources import results, tables, typed, xlsx
from ..sources.sorted import write_sorted

# Columns that a data report expects, and names under which the outcome may come.
RECOMMENDED = ("random_id", "graduated_me", "cgpa_gap", "warnings_per_term", "mean_term_gpa", "gpa_trend_slope", "first_two_regular_mean_gpa")
OUTCOME_ALIASES = ("ME_BS Degree Status", "me_bs_degree_status", "me_degree_awarded")
CONFOUNDERS = ("credit_window", "first_term_label", "1st_math_course", "sat_verb_grouping")
#: Name of the sanitized table beside a run's other results; it goes before the table it was made from.
SANITIZED = "sanitized.csv"


@dataclass
class Spec:
    outcome: str = "graduated_me"
    exclude: Sequence[str] = field(default_factory=tuple)
    num_k: int = 12
    cat_k: int = 12
    bucket_k: int = 5
    most: int = 100
    min_n: int = scan.MIN_N
    min_level_n: int = scan.MIN_N
    plots: int = 10
    pass_rule: str = "substring"


def with_outcome(df: DataFrame, outcome: str) -> DataFrame:
    """The outcome as 1.0, 0.0 or null, from its column or an alias of it."""
    name = resolve_col(df.columns, [outcome, *OUTCOME_ALIASES])
    if name is None:
        raise ValueError(f"no outcome column {outcome}")
    x = F.col(f"`{name}`")
    return df.withColumn(outcome, E.binary_text(x) if dict(df.dtypes)[name] == "string" else E.binary_number(x))


def build(info: DataFrame, grid: DataFrame | None, order: Sequence[str] = (), rule: str = "substring", missing_id: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(wide, long) from the information sheet and the term grid: names, keys, features, series and their aggregates.

    ``order`` names columns (an ingest ordinal) by which the first row of an identifier is kept. Rows without an identifier all stay, unless
    ``missing_id`` (such as "nan") stands for it and makes them one.
    """
    info = standardize_columns(info)
    info = info.withColumn("random_id", E.identifier(F.col("random_id"), missing_id)).withColumn("merge_id", E.merge_id(F.col("random_id")))
    info = keys.keep_first(info, "merge_id", [*order, "random_id"])
    wide = features.with_features(info, rule)
    if grid is None:
        return wide, None
    grid = standardize_columns(grid)
    grid = grid.withColumn("random_id", E.identifier(F.col("random_id"), missing_id)).withColumn("merge_id", E.merge_id(F.col("random_id")))
    long = trajectory.melt(grid, ["merge_id", "random_id"])
    summary = trajectory.summarise(long, "random_id").withColumn("merge_id", E.merge_id(F.col("random_id")))
    first = grid.select("merge_id", "random_id", *(c for c in ("1st_term", "summer_start") if c in grid.columns))
    out = keys.merge_nondup(keys.merge_nondup(wide, first.drop("random_id"), "merge_id"), summary.drop("random_id"), "merge_id")
    if "1st_term" in out.columns:
        out = out.withColumn("first_term_label", E.term_label(F.col("1st_term").cast("double").cast("long")))
    return out, long


def scans(df: DataFrame, spec: Spec, long: DataFrame | None = None, key: str = "random_id") -> dict[str, DataFrame]:
    """All insight tables of a wide table, by name."""
    df = with_outcome(df, spec.outcome)
    skip = {spec.outcome, *spec.exclude}
    numeric = numeric_features(df, skip)
    texts = scan.screened_categories(df, [c for c, kind in df.dtypes if kind == "string" and c not in skip])
    out = {
        "effect_sizes": scan.effect_sizes(df, spec.outcome, numeric, spec.min_n),
        "risk_ratios": scan.risk_ratios(df, spec.outcome, texts, spec.min_level_n),
        "buckets": scan.bucket_summary(df, spec.outcome, numeric),
    }
    out["trends"] = synth.combined(out["effect_sizes"], out["risk_ratios"], out["buckets"], spec.num_k, spec.cat_k, spec.bucket_k)
    out["selected_features"] = synth.selected_features(out["effect_sizes"], out["risk_ratios"], spec.plots, spec.plots)
    if long is not None:
        by_entity = trajectory.slopes(long, key).join(df.select(key, spec.outcome), key, "left")
        out |= {"slopes": by_entity, "slope_summary": trajectory.slope_summary(by_entity), "slope_by_outcome": trajectory.slope_by_outcome(by_entity, spec.outcome)}
    return out


def source(spark: SparkSession, out: str, clean: str | None, upload: str | None = None) -> str:
    """An uploaded table where there is one, else the sanitized table of the last complete scan, else the given table."""
    last = results.current(spark, f"{out}/scan")
    return tables.first_existing(spark, upload, f"{last}/{SANITIZED}" if last else None, clean)


def slices(df: DataFrame, spec: Spec, feature: str, confounders: Sequence[str] = CONFOUNDERS) -> DataFrame:
    """Whether a feature's association holds inside the levels of each confounder that is there."""
    df = with_outcome(df, spec.outcome)
    there = [c for c in confounders if c in df.columns and c != feature]
    return scan.slice_stability(df, spec.outcome, feature, there, feature in numeric_features(df, {spec.outcome}))


def plot_data(df: DataFrame, spec: Spec, selected: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Histograms by outcome of the selected numeric features, and rates of the levels of the others (at most ``2 * plots`` features)."""
    chosen = selected.collect()
    numeric, texts = ([r["feature"] for r in chosen if r["kind"] == kind] for kind in ("numeric", "categorical"))
    return wide.histograms(df, numeric, spec.outcome) if numeric else None, scan.level_rates(df, spec.outcome, texts, 25) if texts else None


def write_insights(spark: SparkSession, main: DataFrame, terms: DataFrame | None, out: str, spec: Spec) -> None:
    """The insight tables, the data of the plots and the ranked lines."""
    found = scans(main, spec, terms)
    for name, table in found.items():
        if name != "buckets":
            tables.write_csv(table, f"{out}/{name}", single=True)
    edges = F.array_join(F.transform("edges", lambda e: e.cast("string")), "|")
    tables.write_csv(found["buckets"].withColumn("edges", edges), f"{out}/buckets", single=True)
    for name, table in zip(("histograms", "level_rates"), plot_data(with_outcome(main, spec.outcome), spec, found["selected_features"])):
        if table is not None:
            tables.write_csv(table, f"{out}/{name}", single=True)
    lines = synth.bullets(found["trends"], found["buckets"], found.get("slope_by_outcome"), most=spec.most)
    tables.write_text(spark, synth.markdown(lines), f"{out}/top_trends.md")


def run_all(spark: SparkSession, wide: str, out: str, spec: Spec | None = None, long: str | None = None) -> None:
    """Sanitize, report, scan and summarise, as one run under ``out``/scan; a failing step fails the run and leaves the last one whole."""
    spec = spec or Spec()
    with results.run(spark, f"{out}/scan") as place:
        df, fit = tables.read_checked(spark, wide)
        terms = tables.read(spark, long) if long and tables.exists(spark, long) else None
        main = sanitize(spark, df, place, spec).cache()
        try:
            report(spark, main, terms, place, fit)
            write_insights(spark, main, terms, place, spec)
        finally:
            main.unpersist()


def sanitize(spark: SparkSession, df: DataFrame, place: str, spec: Spec) -> DataFrame:
    """Write the sanitized table, what went to quarantine, and why; returns the sanitized table."""
    main, quarantine, found = guard.sanitize(with_outcome(df, spec.outcome), spec.outcome)
    tables.write_csv(main, f"{place}/{SANITIZED}")
    tables.write_csv(quarantine, f"{place}/quarantine")
    tables.write_json(spark, found.as_dict(), f"{place}/sanitizer_report.json")
    return main


def report(spark: SparkSession, df: DataFrame, terms: DataFrame | None, place: str, fit: typed.Fit | None = None) -> None:
    """Write the data report."""
    tables.write_text(spark, tables.data_report(df, RECOMMENDED, terms, guard.missing_rates, fit=fit), f"{place}/data_report.md")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stratalens")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="features from a workbook")
    b.add_argument("--excel", required=True)
    b.add_argument("--out", required=True)
    scanning = argparse.ArgumentParser(add_help=False)
    scanning.add_argument("--clean")
    scanning.add_argument("--upload", help="a table that goes before all others")
    scanning.add_argument("--long")
    scanning.add_argument("--out", required=True)
    scanning.add_argument("--outcome", default=Spec.outcome)
    for name in ("num_k", "cat_k", "bucket_k", "min_n", "min_level_n", "plots", "most"):
        scanning.add_argument(f"--{name}", type=int, default=getattr(Spec, name))
    commands.add_parser("scan", parents=[scanning], help="sanitize a wide table, and all its insight tables")
    commands.add_parser("trends", parents=[scanning], help="insight tables of the sanitized table, if there is one, else of the given one")
    commands.add_parser("sanitize", parents=[scanning], help="the sanitized table and the quarantine only")
    commands.add_parser("report", parents=[scanning], help="the data report only")
    c = commands.add_parser("slices", parents=[scanning], help="one feature inside the levels of confounders")
    c.add_argument("--feature", required=True)
    c.add_argument("--confounders", nargs="+", default=list(CONFOUNDERS))
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command != "build":
        spec = Spec(outcome=args.outcome, **{k: getattr(args, k) for k in ("num_k", "cat_k", "bucket_k", "min_n", "min_level_n", "plots", "most")})
        if args.command == "scan":
            run_all(spark, args.upload or args.clean, args.out, spec, args.long)
            return
        raw = args.command in ("sanitize", "report")
        df, fit = tables.read_checked(spark, tables.first_existing(spark, args.upload, args.clean) if raw else source(spark, args.out, args.clean, args.upload))
        terms = tables.read(spark, args.long) if args.long and tables.exists(spark, args.long) else None
        with results.run(spark, f"{args.out}/{args.command}") as place:
            if args.command == "trends":
                write_insights(spark, df, terms, place, spec)
            elif args.command == "sanitize":
                sanitize(spark, df, place, spec)
            elif args.command == "report":
                report(spark, df, terms, place, fit)
            else:
                tables.write_csv(slices(df, spec, args.feature, args.confounders), f"{place}/slices", single=True)
        return
    named = {s: [std_col(c) for c in cols] for s, cols in xlsx.sheet_columns(spark, args.excel).items()}
    open_sheet = lambda s: tables.without_nan(xlsx.load(spark, args.excel, s, "row_in_sheet"))
    grid = tables.find_term_sheet(named)
    wide, long = build(open_sheet(tables.find_sheet(named, ["random_id"])), open_sheet(grid) if grid else None, ["row_in_sheet"])
    tables.write_parquet(wide, f"{args.out}/wide")
    if long is not None:
        write_sorted(long, f"{args.out}/terms_long", "random_id", ["term_index"])


if __name__ == "__main__":
    main()
