"""Identifiers and joins that keep a table's shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which the small side of a lookup join is broadcast.
BROADCAST_ROWS = 200_000


def keep_first(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order (nulls first); rows without a key all stay.

    A partial aggregation: each task sends one row for each key, however often it occurs. ``order`` may be columns that aren't in ``df``, as ``sources.order.file_order()``.
    """
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())  # a number for each row without a key
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    ranked = df.select(F.col(key).alias("_key"), alone.alias("_alone"), F.struct(*order).alias("_order"), row.alias("_row"))
    return ranked.groupBy("_key", "_alone").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def first_rows(df: DataFrame, key: str, order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows of each key in the given order."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_nth") <= k).drop("_nth")


def merge_nondup(left: DataFrame, right: DataFrame | None, on: str) -> DataFrame:
    """Left join that leaves out right columns the left has already; ``left`` itself without a right."""
    if right is None:
        return left
    return left.join(right.select(on, *(c for c in right.columns if c not in left.columns)), on, "left")


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint behind a look at the size (which reads at most BROADCAST_ROWS rows)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_key(long: DataFrame, master: DataFrame, key: str, extra: str) -> DataFrame:
    """``long`` with ``extra`` from the distinct non-null pairs of ``master``; as it is where both have it."""
    if extra in long.columns or not {key, extra} <= {*master.columns} or key not in long.columns:
        return long
    return long.join(master.select(key, extra).dropna().distinct(), key, "left")


def with_cohort(long: DataFrame, master: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("merge_id", "random_id")) -> DataFrame | None:
    """``long`` with master's cohort columns, by the first key both have; None without one."""
    key = next((k for k in keys if k in long.columns and k in master.columns), None)
    if key is None:
        return None
    return long.join(master.select(key, *(c for c in columns if c in master.columns and c != key)).distinct(), key, "left")


def only_in(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left_anti")


def also_in(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left_semi")


def overlap(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(left_rows, matched, left_keys): how many rows of the left find their key on the right."""
    keys = right.select(F.col(on).alias("_k")).filter("_k is not null").distinct()
    rows = left.join(keys, F.col(on) == F.col("_k"), "left")
    return rows.agg(F.count("*").alias("left_rows"), F.count("_k").alias("matched"), F.count_distinct(on).alias("left_keys"))


def top_levels(df: DataFrame, feature: str, k: int) -> DataFrame:
    """Rows whose level is among the k most frequent ones (ties to the smaller level)."""
    top = df.filter(F.col(feature).isNotNull()).groupBy(feature).count().orderBy(F.desc("count"), feature).limit(k)
    return df.join(_small(top.select(feature)), feature, "left_semi")


def lookup(long: DataFrame, value: str, keys: Sequence[str] = ("merge_id", "random_id")) -> DataFrame:
    """The rows of one entity, by the first of the keys that holds the value as text.

    The value is compared in the key's own type as well, which reaches the scan; ``sources.sorted.find`` opens only the file that may hold it.
    """
    for key in keys:
        if key in long.columns:
            same = F.col(key) == F.lit(value).try_cast(long.schema[key].dataType)
            rows = long.filter(same & (F.col(key).cast("string") == value))
            if key == keys[-1] or rows.limit(1).count():
                return rows
    return long.limit(0)
