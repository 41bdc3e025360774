"""Statistics of many columns: against numpy, and the plans that keep a row one row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import keys, scan, wide
from stratalens.operators.explore import Explorer
from stratalens.sources.order import file_order, with_row_numbers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def matrix(rng, rows, columns):
    """Values with gaps, large means, a constant and an empty column."""
    x = rng.normal(size=(rows, columns)) + rng.normal(size=(rows, 1)) + np.where(np.arange(columns) % 5 == 0, 1e6, 0)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 3], x[:, 4] = 1e9 + 0.1, np.nan
    return x


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = matrix(rng, 600, 60)
    y = rng.integers(0, 3, 600)
    rows = [(None if v == 2 else float(v), *(None if np.isnan(c) else float(c) for c in r)) for v, r in zip(y, x)]
    names = [f"f{i}" for i in range(60)]
    return spark.createDataFrame(rows, "y double, " + ", ".join(f"{n} double" for n in names)).repartition(3).cache(), names, x, y


@pytest.mark.parametrize("native", [0, 100])
def test_moments(spark, table, monkeypatch, native):
    df, names, x, y = table
    monkeypatch.setattr(wide, "NATIVE", native)
    got = {r["feature"]: r for r in wide.outcome_moments(df, "y", names).collect()}
    assert set(got) == {n for i, n in enumerate(names) if i != 4}
    for i, n in enumerate(names):
        for v in (1, 0) if i != 4 else ():
            some = x[y == v, i][~np.isnan(x[y == v, i])]
            assert got[n][f"n{v}"] == len(some) and np.isclose(got[n][f"m{v}"], some.mean()) and np.isclose(got[n][f"v{v}"], some.var(ddof=1), rtol=1e-6, atol=1e-9)
    assert wide.outcome_moments(df.limit(0), "y", names).collect() == [] and wide.outcome_moments(df, "y", []).collect() == []


def test_rows_are_not_multiplied(table, monkeypatch):
    df, names, *_ = table
    for native in (0, 100):
        monkeypatch.setattr(wide, "NATIVE", native)
        for of in (scan.effect_sizes(df, "y", names), scan.standardised_gaps(df, "y", names)):
            text = plan(of)
            assert "Expand" not in text and text.count("Generate") == (1 if native else 0)
            if native:  # the one row of all aggregates is turned, above them
                assert text.index("Generate") < text.index("HashAggregate")


def test_500_correlations(spark):
    rng = np.random.default_rng(1)
    x = matrix(rng, 250, 500)
    frame = spark.createDataFrame([tuple(None if np.isnan(c) else float(c) for c in r) for r in x], ", ".join(f"f{i} double" for i in range(500))).repartition(2)
    got = np.full((500, 500), np.nan)
    pairs = wide.correlations(frame, frame.columns)
    for i, j, c in pairs.select(F.substring("col1", 2, 9).cast("int"), F.substring("col2", 2, 9).cast("int"), "corr").collect():
        got[i, j] = np.nan if c is None else c
    assert np.isnan(got[3]).all() and np.isnan(got[4]).all() and np.isnan(got[:, 3:5]).all()
    for i, j in rng.integers(0, 500, (400, 2)).tolist():
        if not {i, j} & {3, 4}:
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert np.isclose(got[i, j], np.corrcoef(x[both, i], x[both, j])[0, 1], atol=1e-6)
    assert pairs.count() == 250_000 and plan(pairs).count("Scan ") == 1


def test_level_numbers(spark, monkeypatch):
    rows = [(i % 7, str(i % 500) if i % 3 else None, [0.0, -0.0, float("nan"), None, 2.5][i % 5], i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "a int, b string, c double, d long")
    want = [("a", 7, 3000), ("b", 500, 3000), ("c", 2, 3000), ("d", 3000, 3000)]
    assert wide.level_numbers(frame, frame.columns) == want
    monkeypatch.setattr(wide, "FEW", 6)
    monkeypatch.setattr(wide, "HELD", 100)
    assert wide.level_numbers(frame, frame.columns) == want
    assert wide.level_numbers(frame, frame.columns, 7) == [("a", 7, 3000), ("b", None, 3000), ("c", 2, 3000), ("d", None, 3000)]
    assert wide.level_numbers(frame.limit(0), ["a"]) == [("a", 0, 0)] and wide.level_numbers(frame, []) == []
    assert "Expand" not in plan(wide._level_rows(frame, frame.columns, 60).groupBy("column").agg(F.count_distinct("level"), F.sum("rows")))


def test_histograms_take_two_scans(spark, table):
    df, names, x, y = table
    got = wide.histograms(df, names[:6], "y", 10)
    counts = {(r["feature"], r["part"], r["bin_no"]): r["count"] for r in got.collect()}
    for i in (0, 1, 3):
        for part, rows in (("all", y >= 0), ("1", y == 1), ("0", y != 1)):
            some = x[rows, i][~np.isnan(x[rows, i])]
            if i == 3:
                assert sum(counts[names[i], part, k] for k in range(1, 11)) == len(some)
            else:
                assert [counts[names[i], part, k] for k in range(1, 11)] == np.histogram(some, 10)[0].tolist()
    assert not any(f == "f4" for f, *_ in counts)
    assert plan(got).count("InMemoryTableScan") == 1 and "Generate" not in plan(got)
    assert wide.histograms(df.limit(0), names[:2], "y").count() == 0


def test_scatter_is_bounded_and_repeatable(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 5 > 0, 1.0).alias("y"))
    one, two = (Explorer(frame.repartition(n)).scatter("x", "y", "id", 10, "g") for n in (1, 7))
    assert sorted(one.collect()) == sorted(two.collect()) and one.groupBy("g").count().collect() == one.groupBy("g").count().filter("count = 10").collect()
    assert "WindowGroupLimit" in plan(two)
    assert sorted(Explorer(frame.repartition(3)).scatter("x", "y", "id", 10).collect()) == sorted(Explorer(frame).scatter("x", "y", "id", 10).collect())


def test_first_rows_in_file_order(spark, tmp_path):
    """Over several CSV files in many blocks: the order of paths, and of lines in each."""
    for name in "bac":
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{i * 7 % 97 if i % 11 else ''},{name}{i}\n" for i in range(3000)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = spark.read.option("header", True).csv(str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        lines = [(str(i * 7 % 97) if i % 11 else None, f"{name}{i}") for name in "abc" for i in range(3000)]
        assert [r["v"] for r in sorted(with_row_numbers(df, "n").collect(), key=lambda r: r["n"])] == [v for _, v in lines]
        first = {}
        for k, v in lines:
            first.setdefault(k, v)
        kept = keys.keep_first(df, "k", [file_order()])
        assert "Window" not in plan(kept)
        rows = kept.collect()
        assert {r["k"]: r["v"] for r in rows if r["k"] is not None} == {k: v for k, v in first.items() if k is not None}
        assert sorted(r["v"] for r in rows if r["k"] is None) == sorted(v for k, v in lines if k is None)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
