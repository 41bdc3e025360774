"""Readers with missing values normalised, source selection, and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import typed

# Texts that mean "missing" in a CSV file.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, through Spark's own file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column, and CSV's missing texts as null in every text column."""
    new = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            new[f.name] = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.StringType):
            new[f.name] = F.when(~c.isin(*NA_TOKENS), c)
    return df.withColumns(new) if new else df


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by its extension: .csv (typed by its first rows unless a schema is given), .xlsx, else Parquet."""
    kind = PurePosixPath(path).suffix
    if kind == ".csv" and schema is None:
        return without_nan(typed.read_csv(spark, path, NA_TOKENS, checked=False)[0])
    if kind == ".csv":
        return without_nan(spark.read.option("header", True).option("nullValue", "").schema(schema).csv(path))
    if kind == ".xlsx":
        from .xlsx import read_sheet

        return without_nan(read_sheet(spark, path))
    return without_nan(spark.read.parquet(path))


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, typed.Fit | None]:
    """The same, and for CSV what doesn't fit the inferred types, known once the table has been read."""
    if PurePosixPath(path).suffix != ".csv":
        return read(spark, path), None
    df, fit = typed.read_csv(spark, path, NA_TOKENS)
    return without_nan(df), fit


def load_frames(spark: SparkSession, wide: str, long: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The wide table, and the long one where it exists."""
    return read(spark, wide), read(spark, long) if long and exists(spark, long) else None


def first_existing(spark: SparkSession, *paths: str | None) -> str:
    """The first path that is there, else the last given: an upload before a default, a sanitized table before a raw one."""
    given = [p for p in paths if p]
    return next((p for p in given if exists(spark, p)), given[-1])


def find_sheet(sheets: dict[str, Sequence[str]], must_have: Sequence[str]) -> str | None:
    """The first sheet in which every wanted text is part of some column's name, else the first one."""
    return next((s for s, cols in sheets.items() if all(any(m in c for c in cols) for m in must_have)), next(iter(sheets), None))


def find_term_sheet(sheets: dict[str, Sequence[str]]) -> str | None:
    """The first sheet with an identifier, a first term and any slot of the first year."""
    fits = lambda cols: {"random_id", "1st_term"} <= {*cols} and {"1st_fall", "1st_spring", "1st_summer"} & {*cols}
    return next((s for s, cols in sheets.items() if fits(cols)), None)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text or JSON document, through Spark's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, json.dumps(value, indent=2), path)


def export(filtered: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    write_csv(filtered.select(*columns) if columns else filtered, path)


def data_report(df: DataFrame, recommended: Sequence[str], long: DataFrame | None, missing: Callable[[DataFrame], DataFrame], top: int = 20, fit: typed.Fit | None = None) -> str:
    """Rows, columns, the sparsest columns, the recommended ones present and what didn't fit its column's type, as Markdown."""
    rates = missing(df).orderBy(F.desc("missing_pct"), "column").limit(top).collect()
    lines = ["# Data report", "", f"**Rows**: {df.count()}  **Cols**: {len(df.columns)}", "", f"## Missingness (top {top})", ""]
    lines += [f"- {r['column']}: {r['missing_pct']:.1%}" for r in rates] + ["", "## Recommended columns present", ""]
    lines += [f"- {c}: {'present' if c in df.columns else 'missing'}" for c in recommended]
    if fit is not None:
        lines += ["", "## Values that did not fit", ""] + ([f"- {c}: {n} not {fit.kinds[c]}" for c, n in fit.misfits().items()] or ["None."])
    lines.append(f"\n**Long table**: {long.count()} rows, cols={long.columns}" if long is not None else "\n**Long table**: not found")
    return "\n".join(lines)
