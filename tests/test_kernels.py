"""Scalar kernels on hand-derived cases, edge cases of operators, and properties."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.functions import expressions as E
from stratalens.functions import names as N
from stratalens.operators import features, guard, keys, scan, trajectory
from stratalens.operators.explore import Explorer


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("name, wanted", [
    ("Random ID", "random_id"), ("# Warning", "_warning"), ("Academic Suspenion (iTwo)", "academic_suspenion__itwo"), ("# Courses Taken ≥3rd Time", "_courses_taken_ge3rd_time"),
    ("# Term GPA<2.5", "_term_gpa25"), ("CHEM 110 (Grade Code) (1st FA or SP)", "chem_110__grade_code__1st_fa_or_sp"), ("a/b", "a_b"), ("50%", "50pct"), ("A-B", "a_b"),
])
def test_std_col(name, wanted):
    assert N.std_col(name) == wanted


def test_names(spark):
    df = spark.createDataFrame([(1, 2, True)], "`A b` int, `a-b` int, ok boolean")
    assert N.standardize_columns(df).columns == ["a_b", "a_b_2", "ok"]
    assert N.resolve_col(["x_gpa_2_5", "y"], ["z"], ("gpa", "5")) == "x_gpa_2_5" and N.resolve_col(["y"], ["z"]) is None
    assert N.header_diff(["a", "b"], ["a", "c"])["first_difference"] == 1
    assert N.numeric_features(df) == ["A b", "a-b", "ok"]
    assert (N.histogram_bins(1), N.histogram_bins(900), N.histogram_bins(10**6)) == (10, 30, 60)
    assert N.safe_name("a b/c") == "a_b_c" and N.is_leaky("x_outcome") and N.is_suspect("cgpa")


def test_merge_id(spark):
    assert apply(spark, ["S-00998", " b-00998 ", "B–00998", "S-998", "A123456B7890123", "12345.0", None], E.merge_id) == ["00998", "00998", "00998", "S998", "123456", "123450", None]


def test_terms(spark):
    codes = [2168, 2171, 2175, 2179, 1998, None]
    assert apply(spark, codes, E.term_label, "int") == ["Fall 2016", "Spring 2017", "Summer 2017", "Term9 2017", "Fall 1999", None]
    assert apply(spark, codes, E.term_date, "int")[:4] == [datetime.date(2016, 8, 1), datetime.date(2017, 1, 1), datetime.date(2017, 6, 1), datetime.date(2017, 1, 1)]


PERIODS = [
    ("1st Attempt=ABC", (1, True, 1)), ("1 attempt = abc", (1, True, 1)), ("Only 1 Attempt=DFW", (1, False, None)), ("2 Attempts (1st=DFW, 2nd=ABC)", (2, True, 2)), ("2 Attempts (Both=DFW)", (2, False, None)),
    ("Never Enrolled", (0, False, None)), ("", (0, False, None)), (None, (0, False, None)), ("3 Attempts (1st=DFW, 2nd=DFW, 3rd=ABC)", (3, True, 3)), ("4 Attempts, all DFW", (4, False, None)), ("1st Attempt=DFW", (0, False, None)),
]


def test_period(spark):
    assert [tuple(x) for x in apply(spark, [p for p, _ in PERIODS], E.period)] == [w for _, w in PERIODS]


ATTEMPTS = [
    ("1st Attempt=ABC", None, None, 1.0, "Pass on 1st attempt", 1), ("Only 1 Attempt=DFW", "2 Attempts (1st=DFW, 2nd=ABC)", None, 2.0, "Pass on 2nd attempt", 2),
    ("Only 1 Attempt=DFW", "Never Enrolled", None, None, "No pass after 1 attempt", 1), ("2 Attempts (Both=DFW)", None, "PASS", 3.0, "Pass on 3rd attempt", 3), ("2 Attempts (Both=DFW)", None, None, None, "No pass after 2 attempts", 2),
    (None, "4 Attempts (4th=ABC)", None, 4.0, "Requires more than three attempts", 4), (None, None, "Never Enrolled", None, "Never enrolled", 0), (None, None, "C-", None, "Never enrolled", 0), (None, None, "D", None, "Never enrolled", 0),
    (None, None, "FAIL", 1.0, "Pass on 1st attempt", 1), ("Only 1 Attempt=DFW", None, "Only 1 Attempt=DFW", 2.0, "Pass on 2nd attempt", 2), ("1st Attempt=ABC", "Only 1 Attempt=DFW", None, None, "No pass after 1 attempt", 1),
]


def test_attempts(spark):
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(ATTEMPTS)], "i int, one string, two string, final string, a double, label string, n long")
    sheet = df.toDF("i", "x_outcome_after_1st_ay", "x_outcome_after_2nd_ay", "x_outcome", "a", "label", "n")
    got = features.course_features(sheet, ["a", "label", "n"], ["x"]).collect()
    assert len(got) == len(ATTEMPTS) and all((r.x_attempts_to_abc, r.x_outcome_label, r.x_total_attempts) == (r.a, r.label, r.n) for r in got)
    strict = features.course_features(sheet.filter("x_outcome = 'FAIL'"), [], ["x"], "token").first()
    assert strict.x_attempts_to_abc is None


def test_graduated(spark):
    yes = ["Graduated", "Degree Awarded", "Graduated, Enrolled MS", "Planned Degree"]
    no = ["Not Graduated", "No Degree", "Seeking Degree", "Degree Pending", "In Progress - Degree", "Undergraduate", "Degrees", "", None]
    assert apply(spark, yes + no, E.graduated) == [1] * len(yes) + [0] * len(no)


def test_outcomes_and_numbers(spark):
    assert apply(spark, [2.0, 0.0, -1.0, None, float("nan")], E.binary_number, "double") == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert apply(spark, [" Yes ", "DEGREE AWARDED", "no", "missing", "maybe", None], E.binary_text) == [1.0, 1.0, 0.0, 0.0, None, None]
    assert apply(spark, [" 3.5 ", "1e3", "3.5d", "nan", "x", None], E.number) == [3.5, 1000.0, None, None, None, None]
    assert apply(spark, ["N/A (101)", "na", " Not available ", "Nation", None], E.missing_category) == [None, None, None, "Nation", None]


def test_credit_windows(spark):
    texts = ["29-55", "40 - 59", "20-20", "20-59", "100-120", "29–55", "n/a", "9000-13000"]
    assert apply(spark, texts, E.credit_midpoint) == [42.0, 49.5, 20.0, 39.5, 110.0, None, None, 11000.0]
    assert apply(spark, texts, lambda c: E.credit_bin(E.credit_midpoint(c))) == ["40-59", "40-59", "0-19", "20-39", "100+", None, None, None]


def test_buckets(spark):
    df = spark.createDataFrame([(float(x), 5.0, None, 1.0) for x in (1, 2, 3, 10)], "x double, same double, gone double, y double")
    edges = {r["feature"]: r["edges"] for r in scan.quantile_edges(df, ["x", "same", "gone"]).collect()}
    assert edges["x"] == [1, 1.75, 2.5, 4.75, 10] and len(edges["same"]) == 2 and "gone" not in edges
    got = {(r["feature"], r["bucket_no"]): r["n"] for r in scan.bucket_summary(df, "y", ["x", "same"]).collect()}
    assert got == {("x", 1): 1, ("x", 2): 1, ("x", 3): 1, ("x", 4): 1, ("same", 1): 4}
    inner = spark.createDataFrame([(1.75,), (10.5,)], "x double").select(E.bucket_number(F.col("x"), F.array(*map(F.lit, edges["x"])))).collect()
    assert [r[0] for r in inner] == [1, None]


def test_trajectory(spark):
    grid = spark.createDataFrame([("a", 3.0, None, 2.0, 4.0), ("b", 1.0, None, None, None), ("c", None, None, None, None)], "id string, `1st_fall` double, `1st_spring` double, `1st_summer` double, `2nd_fall` double")
    long = trajectory.melt(grid, ["id"])
    rows = {r["id"]: r for r in trajectory.summarise(long, "id").collect()}
    a = rows["a"]
    assert (a.terms_with_gpa, a.mean_term_gpa, a.median_term_gpa, a.std_term_gpa, a.min_term_gpa, a.max_term_gpa, a.first_term_gpa, a.last_term_gpa) == (3, 3.0, 3.0, 1.0, 2.0, 4.0, 3.0, 4.0)
    assert (a.n_summer_terms, a.n_regular_terms, a.low_gpa_terms_2_5, a.low_gpa_terms_3_0, a.first_two_regular_mean_gpa) == (1, 2, 1, 1, 3.5)
    assert abs(a.summer_term_ratio - 1 / 3) < 1e-12 and abs(a.gpa_trend_slope - 3 / 14) < 1e-12
    assert rows["b"].gpa_trend_slope is None and rows["b"].std_term_gpa is None and "c" not in rows


def test_effect_size_and_ratio(spark):
    rows = [(x, 1.0, "a") for x in [1.0] * 13 + [3.0] * 12] + [(x + 1, 0.0, "b") for x in [1.0] * 13 + [3.0] * 12]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    r = scan.effect_sizes(df, "y", ["x"]).first()
    assert abs(r.cohens_d + 0.9805807) < 1e-6 and abs(r.score - 6.9337525) < 1e-6
    assert scan.effect_sizes(df.limit(49), "y", ["x"]).count() == 0
    levels = [("L", 1.0)] * 30 + [("L", 0.0)] * 20 + [("M", 1.0)] * 10 + [("M", 0.0)] * 40
    r = scan.risk_ratios(spark.createDataFrame(levels, "g string, y double"), "y", ["g"]).filter("level = 'L'").first()
    assert abs(r.risk_ratio - 2.9047619) < 1e-6 and abs(r.grad_rate_level - 0.5980392) < 1e-6
    one = scan.risk_ratios(spark.createDataFrame([("L", 1.0)] * 30, "g string, y double"), "y", ["g"]).first()
    assert one.n_rest == 0 and one.grad_rate_rest == 0.5 and one.score == 0


def test_guard(spark):
    rows = [(float(i % 2), float(i % 2), float(i % 2 == 0), None if i % 4 else 1.0, "x", i) for i in range(200)]
    df = spark.createDataFrame(rows, "y double, copy double, opposite double, sparse double, graduating_note string, value long")
    main, quarantine, report = guard.sanitize(df, "y")
    assert main.columns == ["y", "value"] and report.equal_to_outcome_cols == ["copy", "opposite"] and report.na_heavy_cols == ["sparse"]
    assert quarantine.columns == ["y", "copy", "graduating_note", "opposite", "sparse"]
    with pytest.raises(ValueError):
        guard.sanitize(df, "nope")


def test_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, o int")
    assert sorted(r["o"] for r in keys.keep_first(df, "k", ["o"]).collect()) == [1, 3, 4]
    right = spark.createDataFrame([("a", 9, 5)], "k string, o int, z int")
    assert keys.merge_nondup(df, right, "k").columns == ["k", "o", "z"] and keys.merge_nondup(df, None, "k") is df
    assert keys.with_cohort(df, right, ["z"], ["nope"]) is None


def test_explorer(spark):
    df = spark.createDataFrame([(1.0, "a", 1.0), (2.0, None, 0.0), (None, "b", 1.0), (2.0, "b", None)], "x double, g string, y double")
    e = Explorer(df)
    assert e.among("g", ["<NA>"]).df.count() == 1 and e.among("g", []).df.count() == 4 and e.between("x", 1, 2).df.count() == 3
    corr = {(r.col1, r.col2): r["corr"] for r in Explorer(df.withColumn("c", F.lit(1.0))).correlations(["x", "c"]).collect()}
    assert abs(corr["x", "x"] - 1) < 1e-12 and corr["x", "c"] is None
    assert [r["count"] for r in e.histogram("x", 2).orderBy("bin_no").collect()] == [1, 2]
    assert [r["count"] for r in Explorer(spark.createDataFrame([(5.0,)] * 3, "x double")).histogram("x", 10).orderBy("bin_no").collect()].count(0) == 9
    bins = e.binned("x", "y").orderBy("bin_no").collect()
    assert [r["count"] for r in bins] == [2, 0, 0, 0, 0, 0, 0] and bins[1]["mean"] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-100, 100).map(lambda x: round(x, 3)), st.booleans()), min_size=80, max_size=120))
def test_properties(spark, values):
    df = spark.createDataFrame([(x, float(y), float(not y)) for x, y in values], "x double, y double, z double")
    one, other = (scan.effect_sizes(df, c, ["x"], min_n=2).collect() for c in ("y", "z"))
    assert len(one) == len(other) and all(abs(a.cohens_d + b.cohens_d) < 1e-9 for a, b in zip(one, other))
    assert sum(r.n for r in scan.bucket_summary(df, "y", ["x"]).collect()) == len(values)


@pytest.mark.parametrize(("cells", "fetched"), [(256, 4096), (2, 1), (16, 5)])
def test_quantiles_are_those_of_numpy(spark, monkeypatch, cells, fetched):
    """Ties, single values, constants, nulls, extremes and infinities; several partitions, one pass and many."""
    import random

    import numpy as np

    from stratalens.operators import quantiles

    monkeypatch.setattr(quantiles, "CELLS", cells)
    monkeypatch.setattr(quantiles, "FETCHED", fetched)
    monkeypatch.setattr(quantiles, "COLUMNS", 4)
    rng = random.Random(1)
    values = {
        "a": [rng.random() for _ in range(101)], "b": [float(rng.randrange(4)) for _ in range(60)], "c": [2.5], "d": [7.0] * 9, "e": [1.0, 2.0],
        "f": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(90)], "g": [5e-324, 0.0, -0.0, -5e-324, 1e-310], "none": [],
        "h": [float("-inf"), 1.0, 2.0, 3.0, float("inf")] * 3,
    }
    rows = [tuple(v[i] if i < len(v) else None for v in values.values()) for i in range(101)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in values)).repartition(3)
    q = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0] if cells > 2 else [0.25, 0.5]
    got = {r["feature"]: r["quantiles"] for r in quantiles.quantiles(frame, list(values), q).collect()}
    assert set(got) == set(values) - {"none"}
    assert all(np.allclose(got[f], np.quantile(v, q), rtol=1e-12, atol=0) for f, v in values.items() if f not in ("none", "h", "g"))
    assert np.allclose(got["g"], np.quantile(values["g"], q), rtol=0, atol=1e-323) and (cells == 2 or (got["h"][0], got["h"][3], got["h"][5]) == (float("-inf"), 2.0, float("inf")))
    assert quantiles.quantiles(frame.limit(0), ["a"], q).collect() == []
