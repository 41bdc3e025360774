"""CSV with types from its first rows: one scan of the data, which also counts what doesn't fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows from which types are inferred.
SAMPLE = 10_000
# How each type is written.
WHOLE, TRUTH = r"^\s*[+-]?[0-9]{1,18}\s*$", r"^(?i)\s*(true|false)\s*$"


class Fit:
    """What a typed read met. Known when one action over the whole table has ended; ``misfits`` waits for it."""

    def __init__(self, kinds: dict[str, str], seen: Observation):
        self.kinds, self._seen = kinds, seen

    def misfits(self) -> dict[str, int]:
        """Values of each column, where there are any, that its type can't hold and that were read as null."""
        counts = self._seen.get
        return {c: counts[f"m{i}"] for i, c in enumerate(self.kinds) if counts[f"m{i}"]}


def _typed(text: Column, kind: str) -> Column:
    if kind == "bigint":
        return F.when(text.rlike(WHOLE), F.trim(text).try_cast("bigint"))
    if kind == "double":
        return F.when(~text.rlike(r"[dDfF]\s*$") | text.rlike(r"(?i)inf\s*$"), text.try_cast("double"))  # 1.5d is text
    return F.lower(F.trim(text)).try_cast("boolean") if kind == "boolean" else text


def infer(rows: DataFrame, sample: int = SAMPLE) -> dict[str, str]:
    """bigint, double, boolean or string for each text column, by its first rows; a column without values there is a double."""
    tests = {"bigint": lambda x: x.rlike(WHOLE), "double": lambda x: _typed(x, "double").isNotNull(), "boolean": lambda x: x.rlike(TRUTH)}
    x = {c: F.col(f"`{c}`") for c in rows.columns}
    asked = [F.coalesce(F.every(F.coalesce(test(x[c]), F.lit(False)) | x[c].isNull()), F.lit(True)).alias(f"{kind}{i}") for i, c in enumerate(rows.columns) for kind, test in tests.items()]
    empty = [(F.count(x[c]) == 0).alias(f"empty{i}") for i, c in enumerate(rows.columns)]
    found = rows.limit(sample).agg(*asked, *empty).first()
    return {c: "double" if found[f"empty{i}"] else next((k for k in tests if found[f"{k}{i}"]), "string") for i, c in enumerate(rows.columns)}


def read_csv(spark: SparkSession, path: str, missing: tuple[str, ...], sample: int = SAMPLE, checked: bool = True) -> tuple[DataFrame, Fit | None]:
    """A CSV file or folder with a header, ``missing`` texts as null, and (if ``checked``) how it fits the types of its first rows."""
    texts = spark.read.option("header", True).option("nullValue", "").csv(path)
    texts = texts.select(*(F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in texts.columns))
    kinds, seen = infer(texts, sample), Observation()
    typed = {c: _typed(F.col(f"`{c}`"), k) for c, k in kinds.items()}
    if not checked:
        return texts.select(*(x.alias(c) for c, x in typed.items())), None
    counts = [F.count_if(F.col(f"`{c}`").isNotNull() & x.isNull()).alias(f"m{i}") for i, (c, x) in enumerate(typed.items())]
    return texts.observe(seen, *counts).select(*(x.alias(c) for c, x in typed.items())), Fit(kinds, seen)
