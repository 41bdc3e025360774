"""Statistics of many columns at once, without a row for each value: each task sums its rows up in arrays, a slot for each column
(or pair of columns), and only these sums move.

The sums are taken of deviations from a value of each column near the beginning of the table, so they stay exact where a
column's mean is large beside its spread.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.names import histogram_bins

#: Features up to which moments are one native aggregation; beyond it, arrays in tasks.
NATIVE = 40
#: Rows from which the values near the beginning are taken.
HEAD = 1000
#: Share of a column's squares under which what is left around its mean counts as rounding.
ROUNDING = 1e-12
#: Levels of all columns that a task holds before it gives them out.
HELD = 200_000
#: Bound of the first pass over levels: columns with no more are counted by it.
FEW = 1024
PARTS = ("all", "1", "0")


def _numbers(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """The columns as doubles without NaN, numbered, after ``more``."""
    return df.select(*more, *(E.plain(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)))


def _matrix(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """The batch's columns from ``first`` on, as a matrix with NaN for a missing value."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[first:]])


def _centre(numbers: DataFrame) -> np.ndarray:
    """Of each column the first value in the first rows, 0 if there is none."""
    first = numbers.limit(HEAD).agg(*(F.first(c, ignorenulls=True).alias(c) for c in numbers.columns)).first()
    found = np.array([np.nan if x is None else x for x in first], np.float64)
    return np.where(np.isfinite(found), found, 0.0)


def _named(index: str, names: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.col(index))


def outcome_moments(df: DataFrame, outcome: str, features: Sequence[str]) -> DataFrame:
    """(feature, n1, n0, m1, m0, v1, v0): counts, means and sample variances of each feature at outcome 1 and 0.

    Rows without the outcome, or with another one, count nowhere; a feature without values has no row.
    """
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, n1 long, n0 long, m1 double, m0 double, v1 double, v0 double")
    y = F.col(f"`{outcome}`").cast("double").alias("y")
    return (_native_moments if len(features) <= NATIVE else _array_moments)(df, y, features).filter("n1 + n0 > 0")


def _native_moments(df: DataFrame, y: Column, features: Sequence[str]) -> DataFrame:
    rows = _numbers(df, features, y)
    each = []
    for i, name in enumerate(features):
        one, zero = F.when(F.col("y") == 1, F.col(f"c{i}")), F.when(F.col("y") == 0, F.col(f"c{i}"))
        sums = {"n1": F.count(one), "n0": F.count(zero), "m1": F.avg(one), "m0": F.avg(zero), "v1": F.var_samp(one), "v0": F.var_samp(zero)}
        each.append(F.struct(F.lit(name).alias("feature"), *(x.alias(k) for k, x in sums.items())).alias(f"c{i}"))
    wide = rows.agg(*each)  # one row
    return wide.select(F.explode(F.array(*wide.columns)).alias("r")).select("r.*")


def _array_moments(df: DataFrame, y: Column, features: Sequence[str]) -> DataFrame:
    centre, k = _centre(_numbers(df, features)), len(features)
    names = ["n1", "n0", "s1", "s0", "q1", "q0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, k))
        for batch in batches:
            outcome, x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), _matrix(batch, 1) - centre
            for at, value in ((0, 1.0), (1, 0.0)):
                rows = x[outcome == value]
                sums[at] += (~np.isnan(rows)).sum(axis=0)
                sums[at + 2] += np.nansum(rows, axis=0)
                sums[at + 4] += np.nansum(rows**2, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), *map(pa.array, sums)], names=["feature", *names])

    found = _numbers(df, features, y).mapInArrow(run, "feature int, " + ", ".join(f"{n} double" for n in names))
    found = found.groupBy("feature").agg(*(F.sum(n).alias(n) for n in names))
    out = [_named("feature", features).alias("feature"), F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0")]
    middle = F.get(F.array(*map(F.lit, centre.tolist())), F.col("feature"))
    for v in "10":
        out.append((middle + F.col(f"s{v}") / F.nullif(F.col(f"n{v}"), F.lit(0.0))).alias(f"m{v}"))
    for v in "10":
        n, s, q = (F.col(f"{c}{v}") for c in "nsq")
        rest = q - s * s / F.nullif(n, F.lit(0.0))
        out.append((F.when(rest > ROUNDING * q, rest).otherwise(F.when(n > 0, 0.0)) / F.nullif(n - 1, F.lit(0.0))).alias(f"v{v}"))
    return found.select(*out)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col1, col2, corr) of all pairs of columns, each over the rows that have both; null where one of them is constant there.

    A task multiplies matrices of values and of what is there, batch by batch, and gives one row for each pair.
    """
    numbers = _numbers(df, columns)
    centre, k = _centre(numbers), len(columns)
    names = ["n", "s", "t", "q", "r", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p = np.zeros((4, k, k))
        for batch in batches:
            x = _matrix(batch) - centre
            there = ~np.isnan(x)
            x[~there] = 0.0
            there = there.astype(np.float64)
            n += there.T @ there
            s += x.T @ there
            q += (x * x).T @ there
            p += x.T @ x
        i, j = np.triu_indices(k)
        sums = n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, sums)], names=["i", "j", *names])

    pairs = numbers.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names)).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names))
    n, s, t, q, r, p = (F.col(c) for c in names)
    left = lambda square, total: F.when(square - total * total / n > ROUNDING * square, square - total * total / n)
    corr = F.when(F.col("i") == F.col("j"), F.when(left(q, s).isNotNull(), 1.0)).otherwise((p - s * t / n) / F.sqrt(left(q, s) * left(r, t)))
    both = F.explode(F.array_distinct(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("at")
    out = pairs.withColumn("corr", F.when(n > 0, corr)).select(both, "corr")
    return out.select(_named("at.i", columns).alias("col1"), _named("at.j", columns).alias("col2"), "corr")


def bucket_counts(df: DataFrame, outcome: str, edges: dict[str, list[float]]) -> list[tuple[str, int, int, float]]:
    """(feature, bucket, n, sum of the outcome) of the rows with a value and an outcome, by the feature's ascending edges; computed at once.

    Bucket k holds the values above edge k - 1 up to edge k (counted from 0), the first one also the lowest edge.
    """
    features, ends = list(edges), [np.array(e) for e in edges.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = ([np.zeros(len(e)) for e in ends] for _ in range(2))
        for batch in batches:
            y, x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), _matrix(batch, 1)
            for i, e in enumerate(ends):
                there = ~np.isnan(y) & ~np.isnan(x[:, i])
                bucket = np.maximum(np.searchsorted(e, x[there, i], side="left"), 1)
                n[i] += np.bincount(bucket, minlength=len(e))
                total[i] += np.bincount(bucket, y[there], minlength=len(e))
        i = np.repeat(np.arange(len(ends)), [len(e) for e in ends])
        k = np.concatenate([np.arange(len(e)) for e in ends])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(total))], names=["i", "bucket", "n", "y"])

    if not features:
        return []
    found = _numbers(df, features, F.col(f"`{outcome}`").cast("double").alias("y")).mapInArrow(run, "i int, bucket int, n long, y double")
    found = found.groupBy("i", "bucket").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).filter("n > 0")
    return [(features[r["i"]], r["bucket"], r["n"], r["y"]) for r in found.collect()]  # a row for each bucket


def _level_rows(df: DataFrame, columns: Sequence[str], bound: int | None) -> DataFrame:
    """(column, level, rows): distinct levels that each task met (with a ``bound``, one more than it at most), and its number of rows beside column -1."""
    kinds = dict(df.dtypes)

    def text(name: str, i: int) -> Column:
        x = F.col(f"`{name}`")
        return ((E.plain(x) + 0.0) if kinds[name] in ("double", "float") else x).cast("string").alias(f"c{i}")  # + 0.0: one zero

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = 0, [pa.array([], pa.string()) for _ in columns]
        given = lambda i: pa.RecordBatch.from_arrays([pa.array(np.full(len(held[i]), i, np.int32)), held[i], pa.array(np.zeros(len(held[i]), np.int64))], names=["column", "level", "rows"])
        for batch in batches:
            rows += len(batch)
            for i, new in enumerate(batch.columns):
                if bound is not None and len(held[i]) > bound:
                    continue
                held[i] = pc.unique(pa.concat_arrays([held[i], pc.unique(pc.drop_null(new.cast(pa.string())))]))
                if bound is not None:
                    held[i] = held[i][: bound + 1]
                elif len(held[i]) > HELD // len(columns):  # levels met again later are given again
                    yield given(i)
                    held[i] = held[i][:0]
        for i in range(len(columns)):
            yield given(i)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([rows], pa.int64())], names=["column", "level", "rows"])

    return df.select(*(text(c, i) for i, c in enumerate(columns))).mapInArrow(run, "column int, level string, rows long")


def level_numbers(df: DataFrame, columns: Sequence[str], bound: int | None = None) -> list[tuple[str, int | None, int]]:
    """(column, levels, rows) of each column; computed at once. Missing values are no level.

    Numbers are exact up to ``bound`` and None beyond it. Without a bound a second pass counts the columns with more than ``FEW`` levels.
    """
    if not columns:
        return []
    few = FEW if bound is None else bound
    found = _level_rows(df, columns, few).groupBy("column").agg(F.count_distinct("level").alias("levels"), F.sum("rows").alias("rows")).collect()  # a row for each column
    counts = {r["column"]: r["levels"] for r in found}
    total = sum(r["rows"] for r in found)
    levels = [counts.get(i, 0) if counts.get(i, 0) <= few else None for i in range(len(columns))]
    if bound is None and None in levels:
        rest = [c for c, n in zip(columns, levels) if n is None]
        more = {r["column"]: r["levels"] for r in _level_rows(df, rest, None).groupBy("column").agg(F.count_distinct("level").alias("levels")).collect()}
        exact = {c: more[i] for i, c in enumerate(rest)}
        levels = [exact[c] if n is None else n for c, n in zip(columns, levels)]
    return [(c, n, total) for c, n in zip(columns, levels)]


def histograms(df: DataFrame, features: Sequence[str], outcome: str, bins: int | None = None) -> DataFrame:
    """(feature, part, bin_no, lo, hi, mid, count): equal-width histograms of all rows and of each outcome, with edges of their own.

    Two scans in all: one for the ends, one that counts every feature's and part's bins. A missing outcome counts as 0; empty bins
    have a row, and the top value is in the last bin; a constant gets bins of a range of one around it; without values there are no bins.
    """
    spark = df.sparkSession
    rows = _numbers(df, features, F.coalesce(F.col(f"`{outcome}`").cast("double"), F.lit(0.0)).alias("y")).withColumnRenamed("y", "_y")
    of = {"all": lambda c: F.col(c), "1": lambda c: F.when(F.col("_y") == 1, F.col(c)), "0": lambda c: F.when(F.col("_y") == 0, F.col(c))}
    asked = [f(of[p](f"c{i}")).alias(f"{name}{i}_{p}") for i in range(len(features)) for p in PARTS for name, f in (("n", F.count), ("a", F.min), ("b", F.max))]
    ends = rows.agg(*asked).first()
    edges, every = {}, []
    for i, feature in enumerate(features):
        for p, part in enumerate(PARTS):
            n, a, b = (ends[f"{x}{i}_{part}"] for x in "nab")
            if not n:
                continue
            a, b, k = (a - 0.5, b + 0.5, bins) if a == b else (a, b, bins)
            k = k or histogram_bins(n)
            width = (b - a) / k
            edges[i, p] = a, width, k
            every += [(i, p, j, feature, part, a + (j - 1) * width, a + j * width) for j in range(1, k + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {at: np.zeros(k, np.int64) for at, (_, _, k) in edges.items()}
        for batch in batches:
            y, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch, 1)
            for (i, p), (a, width, k) in edges.items():
                value = x[:, i] if p == 0 else x[y == (1.0, 0.0)[p - 1], i]
                value = value[~np.isnan(value)]
                counts[i, p] += np.bincount(np.minimum(np.floor((value - a) / width).astype(np.int64), k - 1), minlength=k)
        found = [(i, p, j, int(c)) for (i, p), all_ in counts.items() for j, c in enumerate(all_, 1) if c]
        columns = list(zip(*found)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["i", "p", "bin_no", "count"])

    counted = rows.mapInArrow(run, "i int, p int, bin_no int, count long").groupBy("i", "p", "bin_no").agg(F.sum("count").alias("count"))
    every = spark.createDataFrame(every, "i int, p int, bin_no int, feature string, part string, lo double, hi double")  # 60 rows for each feature and part at most
    out = F.broadcast(every).join(counted, ["i", "p", "bin_no"], "left")
    return out.select("feature", "part", "bin_no", "lo", "hi", ((F.col("lo") + F.col("hi")) / 2).alias("mid"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def scatter(df: DataFrame, x: str, y: str, key: str, k: int, by: str | None = None) -> DataFrame:
    """(key, x, y[, by]): at most ``k`` rows (of each level of ``by``) that have both values, those whose key's digest comes first.

    The same rows whatever the order and the partitions: each task keeps its first ``k`` of a level, and only these are compared.
    """
    rows = df.select(F.col(key), E.plain(F.col(x)).alias(x), E.plain(F.col(y)).alias(y), *([F.col(by)] if by else [])).dropna(subset=[x, y])
    place = F.md5(F.col(key).cast("string").cast("binary"))
    if by is None:
        return rows.withColumn("_place", place).orderBy("_place", x, y).limit(k).drop("_place")
    first = F.row_number().over(W.partitionBy(by).orderBy("_place", x, y))  # with the filter below, Spark limits each task's rows first
    return rows.withColumn("_place", place).withColumn("_nth", first).filter(F.col("_nth") <= k).drop("_place", "_nth")
