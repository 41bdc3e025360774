"""Names of columns: normalisation, resolution and screening. Driver-side; no function here runs a job."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Name patterns that leak the outcome, and those that only deserve a warning.
LEAKY = (r"graduating", r"degree", r"me_bs", r"outcome", r"_is_missing$")
STANDARD_SYMBOLS = (("≥", "ge"), ("(", "_"), (")", ""), ("/", "_"), ("%", "pct"), ("-", " "))
SUSPECT = (r"cgpa$", r"gpa$", r"gpa_.*(final|last)", r"status", r"etm_window")


def std_col(name: str) -> str:
    """A lower-case identifier: ``>=`` signs, percent and separators spelled out, other symbols dropped."""
    text = " ".join(str(name).split())
    for symbol, word in STANDARD_SYMBOLS:
        text = text.replace(symbol, word)
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", text)).lower()


def standardize_columns(df: DataFrame) -> DataFrame:
    """All columns renamed by ``std_col``; later ones of the same name get a number."""
    seen: dict[str, int] = {}
    names = []
    for name in map(std_col, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def resolve_col(columns: Sequence[str], aliases: Iterable[str], contains_all: Sequence[str] = ()) -> str | None:
    """The first alias present, else the first column that contains every token."""
    for alias in aliases:
        if alias in columns:
            return alias
    return next((c for c in columns if contains_all and all(t in c for t in contains_all)), None)


def safe_name(name: str, most: int = 120) -> str:
    """A name fit for a file."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", str(name))[:most]


def is_leaky(name: str) -> bool:
    return any(re.search(p, name.lower()) for p in LEAKY)


def is_suspect(name: str) -> bool:
    return any(re.search(p, name.lower()) for p in SUSPECT)


def numeric_features(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric and boolean columns; the latter are cast to double where they are used."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in set(exclude)]


def header_diff(left: Sequence[str], right: Sequence[str]) -> dict:
    """Equality, set differences and the first differing place of two headers."""
    first = next((i for i, (a, b) in enumerate(zip(left, right)) if a != b), None)
    if first is None and len(left) != len(right):
        first = min(len(left), len(right))
    return {"equal": list(left) == list(right), "only_left": sorted({*left} - {*right}), "only_right": sorted({*right} - {*left}), "first_difference": first}


def presence(columns: Sequence[str], wanted: Iterable[str]) -> dict[str, bool]:
    return {c: c in columns for c in wanted}


def histogram_bins(n: int) -> int:
    """Bins for n values: the root, between 10 and 60."""
    return 10 if n <= 1 else max(10, min(60, int(n**0.5)))
