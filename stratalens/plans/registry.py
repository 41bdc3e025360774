"""Every operator bound to the test tables, with the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as E
from ..operators import features, guard, keys, scan, synth, trajectory, wide
from ..operators.explore import GRADE_ENDS, Explorer
from ..sources.order import file_order, with_row_numbers
from . import bindings as B
from . import study

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
COURSES = ("chem_110", "math_140")


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


# -- scans over orders -----------------------------------------------------------------------------------------

_MOMENTS = """g AS (SELECT feature, count(value) FILTER (y = 1) AS n1, count(value) FILTER (y = 0) AS n0, avg(value) FILTER (y = 1) AS m1, avg(value) FILTER (y = 0) AS m0,
  var_samp(value) FILTER (y = 1) AS v1, var_samp(value) FILTER (y = 0) AS v0 FROM long GROUP BY feature)"""
_EFFECTS = f"""WITH {B.ORDERS}, {B.VALUES}, {_MOMENTS}, d AS (SELECT *, (m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0) AS d FROM g WHERE n1 >= 25 AND n0 >= 25)
SELECT feature, round(d, 6) AS cohens_d, round(abs(d), 6) AS abs_d, round(m1, 6) AS mean_grad1, round(m0, 6) AS mean_grad0, n1, n0, round(abs(d) * sqrt(n1 + n0), 6) AS score FROM d WHERE d IS NOT NULL"""


@query("a5_effect_sizes", _EFFECTS)
def effect_sizes(spark, sf_dir):
    return rounded(scan.effect_sizes(B.orders(spark, sf_dir), "y", B.NUMERIC))


@query("a18_standardised_gaps", f"""WITH {B.ORDERS}, {B.VALUES}, {_MOMENTS} SELECT feature, round((m1 - m0) / nullif(sqrt((v1 + v0) / 2), 0), 6) AS std_gap, round(m1, 6) AS mean_graduated, round(m0, 6) AS mean_not
FROM g WHERE n1 >= 20 AND n0 >= 20 ORDER BY abs((m1 - m0) / nullif(sqrt((v1 + v0) / 2), 0)) DESC NULLS LAST, feature LIMIT 12""")  # fmt: skip
def gaps(spark, sf_dir):
    return rounded(scan.standardised_gaps(B.orders(spark, sf_dir), "y", B.NUMERIC))


_RATIOS = f"""WITH {B.ORDERS}, {B.LEVELS}, g AS (SELECT feature, level, count(*) AS n, count(*) FILTER (y = 1) AS a FROM lev GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY feature) - n AS m, sum(a) OVER (PARTITION BY feature) - a AS c FROM g),
p AS (SELECT *, (a + 0.5) / (n + 1.0) AS p1, (c + 0.5) / (m + 1.0) AS p0, sqrt(1 / (a + 0.5) - 1 / (n + 1.0) + 1 / (c + 0.5) - 1 / (m + 1.0)) AS se FROM r WHERE n >= 25)
SELECT feature, level, n AS n_level, CAST(m AS BIGINT) AS n_rest, round(p1, 6) AS grad_rate_level, round(p0, 6) AS grad_rate_rest, round(p1 / p0, 6) AS risk_ratio, round(exp(ln(p1 / p0) - 1.96 * se), 6) AS rr_low,
  round(exp(ln(p1 / p0) + 1.96 * se), 6) AS rr_high, round(abs(ln(p1 / p0)), 6) AS abs_log_rr, round(abs(ln(p1 / p0)) * sqrt(least(n, m)), 6) AS score FROM p"""


@query("a6_risk_ratios", _RATIOS)
def risk_ratios(spark, sf_dir):
    return rounded(scan.risk_ratios(B.orders(spark, sf_dir), "y", B.TEXT))


_EDGES = """q AS (SELECT feature, quantile_cont(value, 0.0) AS q0, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
  quantile_cont(value, 0.75) AS q3, quantile_cont(value, 1.0) AS q4 FROM long GROUP BY feature),
ed AS (SELECT feature, CASE WHEN q0 = q4 THEN [q0 - 1e-6, q0 + 1e-6] ELSE list_sort(list_distinct([q0, q1, q2, q3, q4])) END AS edges FROM q)"""
_BUCKETS = f"""{B.ORDERS}, {B.VALUES}, {_EDGES}, k AS (SELECT feature, edges, y, greatest(len(list_filter(edges, lambda e: e < value)), 1) AS bucket_no FROM long JOIN ed USING (feature) WHERE y IS NOT NULL),
bk AS (SELECT feature, CAST(bucket_no AS INTEGER) AS bucket_no, edges[bucket_no] AS lo, edges[bucket_no + 1] AS hi, count(*) AS n, avg(y) AS grad_rate FROM k GROUP BY feature, edges, bucket_no)"""


@query("a7_bucket_summary", f"WITH {_BUCKETS} SELECT feature, bucket_no, round(lo, 6) AS lo, round(hi, 6) AS hi, n, round(grad_rate, 6) AS grad_rate FROM bk")
def buckets(spark, sf_dir):
    return rounded(scan.bucket_summary(B.orders(spark, sf_dir), "y", B.NUMERIC).drop("edges"))


@query("a8_quantile_edges", f"WITH {B.ORDERS}, {B.VALUES}, {_EDGES} SELECT feature, CAST(i AS INTEGER) AS edge_no, round(edges[i], 6) AS edge FROM ed, unnest(range(1, len(edges) + 1)) r(i)")
def edges(spark, sf_dir):
    e = scan.quantile_edges(B.orders(spark, sf_dir), B.NUMERIC)
    return rounded(e.select("feature", F.posexplode("edges").alias("p", "edge")).select("feature", (F.col("p") + 1).alias("edge_no"), "edge"))


@query("a9_level_counts", f"WITH {B.ORDERS}, {B.LEVELS} SELECT feature, level, count(*) AS n FROM lev GROUP BY 1, 2")
def level_counts(spark, sf_dir):
    return scan.level_counts(B.orders(spark, sf_dir), B.TEXT)


@query("a14_bucket_spreads", f"WITH {_BUCKETS} SELECT feature, CAST(sum(n) AS BIGINT) AS n_total, count(DISTINCT bucket_no) AS buckets, round(min(grad_rate), 6) AS min_rate, round(max(grad_rate), 6) AS max_rate, round(max(grad_rate) - min(grad_rate), 6) AS spread FROM bk GROUP BY feature")
def spreads(spark, sf_dir):
    return rounded(scan.bucket_spreads(scan.bucket_summary(B.orders(spark, sf_dir), "y", B.NUMERIC)))


_SLICES = """cf AS (SELECT confounder, level, y, v FROM (SELECT y, {v} AS v, o_orderpriority, c_mktsegment FROM b) UNPIVOT (level FOR confounder IN (o_orderpriority, c_mktsegment))),
sz AS (SELECT confounder, level, n FROM (SELECT confounder, level, count(*) AS n, row_number() OVER (PARTITION BY confounder ORDER BY count(*) DESC, level) AS r FROM cf GROUP BY 1, 2) WHERE r <= 12 AND n >= 50)"""


@query("a15_slices_numeric", f"""WITH {B.ORDERS}, {_SLICES.format(v="sum_qty")}
SELECT confounder, level, 'mean_diff' AS metric, round(avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0), 6) AS value, n FROM cf JOIN sz USING (confounder, level)
GROUP BY confounder, level, n HAVING count(v) FILTER (y = 1) >= 20 AND count(v) FILTER (y = 0) >= 20""")  # fmt: skip
def slices_numeric(spark, sf_dir):
    return rounded(scan.slice_stability(B.orders(spark, sf_dir), "y", "sum_qty", ["o_orderpriority", "c_mktsegment"], True))


@query("a15_slices_categorical", f"""WITH {B.ORDERS}, {_SLICES.format(v="r_name")}, kn AS (SELECT confounder, level, v, count(*) AS k, count(*) FILTER (y = 1) AS a FROM cf WHERE v IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT *, sum(k) OVER p AS ks, sum(a) OVER p AS aa, row_number() OVER (PARTITION BY confounder, level ORDER BY k DESC, v) AS r FROM kn WINDOW p AS (PARTITION BY confounder, level))
SELECT confounder, level, 'RR(' || v || ')' AS metric, round(((a + 0.5) / (k + 1.0)) / ((aa - a + 0.5) / (ks - k + 1.0)), 6) AS value, n FROM w JOIN sz USING (confounder, level) WHERE r = 1""")  # fmt: skip
def slices_categorical(spark, sf_dir):
    return rounded(scan.slice_stability(B.orders(spark, sf_dir), "y", "r_name", ["o_orderpriority", "c_mktsegment"], False))


@query("u1_combined_trends", f"""WITH e AS ({_EFFECTS}), r AS ({_RATIOS}), s AS (WITH {_BUCKETS} SELECT feature, CAST(sum(n) AS BIGINT) AS n_total, count(DISTINCT bucket_no) AS buckets, round(min(grad_rate), 6) AS min_rate, round(max(grad_rate), 6) AS max_rate, round(max(grad_rate) - min(grad_rate), 6) AS spread FROM bk GROUP BY feature)
(SELECT *, 'numeric_effect' AS kind FROM e ORDER BY score DESC, feature LIMIT 12) UNION ALL BY NAME (SELECT *, 'categorical_rr' AS kind FROM r ORDER BY score DESC, feature, level LIMIT 12)
UNION ALL BY NAME (SELECT *, 'bucket_spread' AS kind FROM s ORDER BY spread DESC, n_total DESC, feature LIMIT 5)""")  # fmt: skip
def combined(spark, sf_dir):
    o = B.orders(spark, sf_dir).persist()  # three scans read it
    try:
        out = rounded(synth.combined(scan.effect_sizes(o, "y", B.NUMERIC), scan.risk_ratios(o, "y", B.TEXT), scan.bucket_summary(o, "y", B.NUMERIC)))
        return spark.createDataFrame(out.collect(), out.schema)  # 29 rows
    finally:
        o.unpersist()


@query("v6_selected_features", f"""WITH e AS ({_EFFECTS}), r AS ({_RATIOS}), n AS (SELECT feature FROM e ORDER BY score DESC, feature LIMIT 10)
SELECT 'numeric' AS kind, feature FROM n UNION ALL SELECT 'categorical', feature FROM (SELECT feature FROM r GROUP BY feature ORDER BY max(score) DESC, feature LIMIT 10) WHERE feature NOT IN (SELECT feature FROM n)""")  # fmt: skip
def selected(spark, sf_dir):
    o = B.orders(spark, sf_dir)
    return synth.selected_features(scan.effect_sizes(o, "y", B.NUMERIC), scan.risk_ratios(o, "y", B.TEXT))


# -- series over customers -------------------------------------------------------------------------------------


@query("r1_melt", f"WITH {B.TERMS} SELECT * REPLACE (round(term_gpa, 6) AS term_gpa) FROM t")
def melt(spark, sf_dir):
    return rounded(B.terms(spark, sf_dir))


@query("r4_term_grid", f"WITH {B.TERMS} SELECT c_custkey, " + ", ".join(f"round(max(term_gpa) FILTER (term_slot = '{s}'), 6) AS \"{s}\"" for s in B.TERM_SLOTS) + " FROM t GROUP BY c_custkey")
def grid(spark, sf_dir):
    return rounded(B.term_grid(spark, sf_dir))


_EARLY = "er AS (SELECT c_custkey, avg(term_gpa) AS early FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY term_index) AS r FROM t WHERE is_regular = 1) WHERE r <= 2 GROUP BY 1)"
_SLOPE = "CASE WHEN isnan(regr_slope(term_gpa, term_index)) THEN NULL ELSE regr_slope(term_gpa, term_index) END"


@query("a1_trajectory", f"""WITH {B.TERMS}, {_EARLY} SELECT c_custkey, count(*) AS terms_with_gpa, round(avg(term_gpa), 6) AS mean_term_gpa, round(median(term_gpa), 6) AS median_term_gpa, round(stddev_samp(term_gpa), 6) AS std_term_gpa,
  round(min(term_gpa), 6) AS min_term_gpa, round(max(term_gpa), 6) AS max_term_gpa, round(arg_min(term_gpa, term_index), 6) AS first_term_gpa, round(arg_max(term_gpa, term_index), 6) AS last_term_gpa, CAST(sum(is_summer) AS BIGINT) AS n_summer_terms,
  CAST(sum(is_regular) AS BIGINT) AS n_regular_terms, count(*) FILTER (term_gpa < 2.5) AS low_gpa_terms_2_5, count(*) FILTER (term_gpa < 3.0) AS low_gpa_terms_3_0, round({_SLOPE}, 6) AS gpa_trend_slope,
  round(any_value(early), 6) AS first_two_regular_mean_gpa, round(sum(is_summer) / count(*), 6) AS summer_term_ratio FROM t LEFT JOIN er USING (c_custkey) GROUP BY c_custkey""")  # fmt: skip
def trajectory_summary(spark, sf_dir):
    return rounded(trajectory.summarise(B.terms(spark, sf_dir), "c_custkey"))


_SLOPES = f"{B.TERMS}, sl AS (SELECT c_custkey, {_SLOPE} AS gpa_slope FROM t GROUP BY 1)"


@query("a2_slopes", f"WITH {_SLOPES} SELECT c_custkey, round(gpa_slope, 6) AS gpa_slope FROM sl")
def slopes(spark, sf_dir):
    return rounded(trajectory.slopes(B.terms(spark, sf_dir), "c_custkey"))


@query("a3_early_mean", f"WITH {B.TERMS}, {_EARLY} SELECT c_custkey, round(early, 6) AS first_two_regular_mean_gpa FROM (SELECT DISTINCT c_custkey FROM t) LEFT JOIN er USING (c_custkey)")
def early(spark, sf_dir):
    return rounded(trajectory.summarise(B.terms(spark, sf_dir), "c_custkey").select("c_custkey", "first_two_regular_mean_gpa"))


@query("a12_slope_summary", f"WITH {_SLOPES} SELECT count(gpa_slope) AS n_students, round(median(gpa_slope), 6) AS median_slope, round(avg(CASE WHEN gpa_slope > 0 THEN 1 ELSE 0 END), 6) AS pct_positive_slope FROM sl")
def slope_summary(spark, sf_dir):
    return rounded(trajectory.slope_summary(trajectory.slopes(B.terms(spark, sf_dir), "c_custkey")))


_SLOPE_Y = f"{_SLOPES}, y AS (SELECT c_custkey, gpa_slope, CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM sl LEFT JOIN customer USING (c_custkey))"


@query("a13_slope_by_outcome", f"WITH {_SLOPE_Y} SELECT CAST(gpa_slope > 0 AS INTEGER) AS slope_pos, count(*) AS count, round(avg(y), 6) AS grad_rate FROM y WHERE gpa_slope IS NOT NULL GROUP BY 1")
def slope_outcome(spark, sf_dir):
    by = trajectory.slopes(B.terms(spark, sf_dir), "c_custkey").join(B.customers(spark, sf_dir).select("c_custkey", "y"), "c_custkey", "left")
    return rounded(trajectory.slope_by_outcome(by, "y"))


_BAND = "count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(stddev_samp({v}) / sqrt(greatest(count({v}), 1)), 6) AS se, round(avg({v}) - 1.96 * stddev_samp({v}) / sqrt(greatest(count({v}), 1)), 6) AS lo, round(avg({v}) + 1.96 * stddev_samp({v}) / sqrt(greatest(count({v}), 1)), 6) AS hi"


@query("a19_cohort_trajectory", f"WITH {B.TERMS} SELECT term_index, c_mktsegment, {_BAND.format(v='term_gpa')} FROM t LEFT JOIN customer USING (c_custkey) GROUP BY 1, 2")
def cohort(spark, sf_dir):
    long = keys.with_cohort(B.terms(spark, sf_dir), B.customers(spark, sf_dir), ["c_mktsegment"], ["c_custkey"])
    return rounded(trajectory.cohort_trajectory(long, "c_mktsegment"))


@query("w3_first_two_orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 2")
def first_two(spark, sf_dir):
    return keys.first_rows(B.read(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")


# -- course texts ----------------------------------------------------------------------------------------------


@query("f10_course_features", f"""WITH {B.MEANING} SELECT o_orderkey, CAST(chem_a AS DOUBLE) AS chem_110_attempts_to_abc, CAST(coalesce(chem_a = 1, false) AS INTEGER) AS chem_110_pass_by_first_attempt, CAST(chem_a IS NOT NULL AS INTEGER) AS chem_110_ever_passed,
  chem_dfw AS chem_110_first_grade_dfw, CAST(chem_n AS BIGINT) AS chem_110_total_attempts, chem_label AS chem_110_outcome_label, CAST(math_a AS DOUBLE) AS math_140_attempts_to_abc, CAST(coalesce(math_a = 1, false) AS INTEGER) AS math_140_pass_by_first_attempt,
  CAST(math_a IS NOT NULL AS INTEGER) AS math_140_ever_passed, math_dfw AS math_140_first_grade_dfw, CAST(math_n AS BIGINT) AS math_140_total_attempts, math_label AS math_140_outcome_label FROM c""")  # fmt: skip
def course_features(spark, sf_dir):
    t = features.course_features(B.courses(spark, sf_dir), ["o_orderkey"], COURSES)
    return t.select([c for c in t.columns if not c.startswith("etm_")])


@query("a25_rollups", f"""WITH {B.MEANING} SELECT o_orderkey, CAST(coalesce(chem_a, 0) + coalesce(math_a, 0) AS DOUBLE) AS etm_total_attempts_to_abc, CAST(coalesce(chem_a = 1, false) AS BIGINT) + CAST(coalesce(math_a = 1, false) AS BIGINT) AS etm_first_attempt_pass_count,
  CAST(chem_a IS NULL AS BIGINT) + CAST(math_a IS NULL AS BIGINT) AS etm_never_passed_count, CAST(chem_dfw + math_dfw AS BIGINT) AS etm_first_grade_dfw_count FROM c""")  # fmt: skip
def rollup(spark, sf_dir):
    t = features.course_features(B.courses(spark, sf_dir), ["o_orderkey"], COURSES)
    return t.select("o_orderkey", *(c for c in t.columns if c.startswith("etm_")))


@query("f7_period_parser", """WITH m(k, attempts, passed, pass_index) AS (VALUES (0, 1, true, 1), (1, 1, false, NULL), (2, 1, false, NULL), (3, 2, false, NULL), (4, 2, false, NULL), (5, 0, false, NULL), (6, 0, false, NULL), (7, 0, false, NULL), (8, 3, true, 3), (9, 1, true, 1))
SELECT o_orderkey, attempts, passed, pass_index FROM orders JOIN m ON k = o_orderkey % 10""")  # fmt: skip
def period(spark, sf_dir):
    return B.courses(spark, sf_dir).select("o_orderkey", E.period(F.col("chem_110_outcome_after_1st_ay")).alias("p")).select("o_orderkey", "p.*")


@query("a22_mastery", f"""WITH {B.MEANING} SELECT 'CHEM_110' AS course, round(avg(CASE WHEN chem_a = 1 THEN 1 ELSE 0 END), 6) AS pass_1st, round(avg(CASE WHEN chem_a IS NULL THEN 0 ELSE 1 END), 6) AS ever_pass, round(avg(chem_n), 6) AS mean_attempts FROM c
UNION ALL SELECT 'MATH_140', round(avg(CASE WHEN math_a = 1 THEN 1 ELSE 0 END), 6), round(avg(CASE WHEN math_a IS NULL THEN 0 ELSE 1 END), 6), round(avg(math_n), 6) FROM c""")  # fmt: skip
def mastery(spark, sf_dir):
    return rounded(Explorer(features.course_features(B.courses(spark, sf_dir), ["o_orderkey"], COURSES)).mastery(["chem_110", "edsgn_100", "math_140"]))


# -- scalar expressions ----------------------------------------------------------------------------------------


@query("f3_merge_id", "SELECT c_custkey, coalesce(nullif(regexp_extract(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), '([0-9]{5,})', 1), ''), regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g')) AS merge_id FROM customer")
def merge_ids(spark, sf_dir):
    return B.customers(spark, sf_dir).select("c_custkey", E.merge_id(F.col("c_name")).alias("merge_id"))


@query("f5_term_decode", """WITH o AS (SELECT o_orderkey, 2100 + o_orderkey % 90 AS code FROM orders) SELECT o_orderkey, CASE code % 10 WHEN 1 THEN 'Spring' WHEN 5 THEN 'Summer' WHEN 8 THEN 'Fall' ELSE 'Term' || (code % 10) END || ' ' || (2000 + code // 10 - 200) AS label,
  make_date(CAST(2000 + code // 10 - 200 AS INTEGER), CASE code % 10 WHEN 5 THEN 6 WHEN 8 THEN 8 ELSE 1 END, 1) AS begins FROM o""")  # fmt: skip
def term_decode(spark, sf_dir):
    code = F.lit(2100) + F.col("o_orderkey") % 90
    return B.read(spark, sf_dir, "orders").select("o_orderkey", E.term_label(code).alias("label"), E.term_date(code).alias("begins"))


_STATUS = ["Graduated", "Degree Awarded", "Not Graduated", "Seeking Degree", "Planned Degree", "Undergraduate", None, "In Progress - Degree"]


@query("f11_graduated", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 4) THEN 1 ELSE 0 END AS graduated_me FROM orders")
def graduated(spark, sf_dir):
    text = F.get(F.array(*(F.lit(s).cast("string") for s in _STATUS)), (F.col("o_orderkey") % 8).cast("int"))
    return B.read(spark, sf_dir, "orders").select("o_orderkey", E.graduated(text).alias("graduated_me"))


@query("f13_rates", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, round(l_discount / nullif(l_tax, 0), 6) AS rate, round(l_quantity - l_linenumber, 6) AS difference, CASE WHEN nullif(l_tax, 0) IS NULL THEN 1 ELSE 0 END AS is_missing, CASE WHEN nullif(l_discount, 0) > 0.05 THEN 1 ELSE 0 END AS flag FROM lineitem")
def rates(spark, sf_dir):
    c = F.col
    tax, discount = F.nullif(c("l_tax"), F.lit(0.0)), F.nullif(c("l_discount"), F.lit(0.0))
    return rounded(B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", E.rate(c("l_discount"), c("l_tax")).alias("rate"), (c("l_quantity") - c("l_linenumber")).alias("difference"), tax.isNull().cast("int").alias("is_missing"), E.flag(discount > 0.05).alias("flag")))


@query("f17_binary_outcome", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS by_number, CASE c_custkey % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN NULL ELSE NULL END AS by_text FROM customer")
def binary(spark, sf_dir):
    text = F.get(F.array(*(F.lit(x).cast("string") for x in [" Yes ", "DEGREE AWARDED", "no", "maybe", None])), (F.col("c_custkey") % 5).cast("int"))
    return B.customers(spark, sf_dir).select("c_custkey", E.binary_number(F.col("c_acctbal")).alias("by_number"), E.binary_text(text).alias("by_text"))


_BIN = "CASE WHEN {x} < 0 OR {x} > 10000 THEN NULL WHEN {x} <= 20 THEN '0-19' WHEN {x} <= 40 THEN '20-39' WHEN {x} <= 60 THEN '40-59' WHEN {x} <= 80 THEN '60-79' WHEN {x} <= 100 THEN '80-99' WHEN {x} <= 10000 THEN '100+' END"


@query("f20_credit_window", f"WITH p AS (SELECT p_partkey, (p_size + (p_size * 2 + p_partkey % 7)) / 2.0 AS midpoint FROM part) SELECT p_partkey, midpoint::DOUBLE AS midpoint, {_BIN.format(x='midpoint')} AS bin FROM p")
def credit(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_size") * 2 + F.col("p_partkey") % 7).cast("string"), F.lit(" credits"))
    p = B.read(spark, sf_dir, "part").select("p_partkey", E.credit_midpoint(text).alias("midpoint"))
    return p.withColumn("bin", E.credit_bin(F.col("midpoint")))


@query("f19_missing_categories", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN NULL ELSE o_orderpriority END AS level FROM orders")
def missing_categories(spark, sf_dir):
    text = F.get(F.array(F.lit("N/A (101)"), F.lit(" na "), F.lit("Not  Available"), F.col("o_orderpriority")), (F.col("o_orderkey") % 4).cast("int"))
    return B.read(spark, sf_dir, "orders").select("o_orderkey", E.missing_category(text).alias("level"))


@query("p6_numeric_coercion", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 3.5::DOUBLE WHEN 1 THEN 1000.0 WHEN 4 THEN -2.0 ELSE NULL END AS x FROM orders")
def coercion(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, [" 3.5 ", "1e3", "3.5d", "nan", "-2"])), (F.col("o_orderkey") % 5).cast("int"))
    return B.read(spark, sf_dir, "orders").select("o_orderkey", E.number(text).alias("x"))


@query("f4_clean_grades", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'A-' WHEN 1 THEN NULL WHEN 2 THEN 'WF' ELSE NULL END AS grade, CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE 0 END AS dfw FROM orders")
def grades(spark, sf_dir):
    g = E.clean_grade(F.get(F.array(*map(F.lit, [" a- ", "n/a", "wf", ""])), (F.col("o_orderkey") % 4).cast("int")))
    return B.read(spark, sf_dir, "orders").select("o_orderkey", g.alias("grade"), E.flag(g.isin(*E.DFW_GRADES)).alias("dfw"))


# -- filters and exploration -----------------------------------------------------------------------------------


@query("q1_regex_filter", f"WITH {B.EVENTS} SELECT event_id FROM e WHERE regexp_matches(CAST(user_id AS VARCHAR), '1[02]')")
def regex_filter(spark, sf_dir):
    return Explorer(B.events(spark, sf_dir)).matching("user_id", "1[02]").df.select("event_id")


@query("q2_exact_filter", f"WITH {B.EVENTS} SELECT event_id, value FROM e WHERE user_id = 3")
def exact_filter(spark, sf_dir):
    return Explorer(B.events(spark, sf_dir)).equal("user_id", "3").df.select("event_id", "value")


@query("q3_range_filter", f"WITH {B.EVENTS} SELECT event_id FROM e WHERE value BETWEEN 10 AND 60 AND k BETWEEN 5 AND 80")
def range_filter(spark, sf_dir):
    return Explorer(B.events(spark, sf_dir)).between("value", 10, 60).between("k", 5, 80).df.select("event_id")


@query("q4_level_filter", f"WITH {B.DOCUMENTS} SELECT doc_id FROM d WHERE coalesce(CAST(CAST(quality AS INTEGER) AS VARCHAR), '<NA>') IN ('<NA>', '0') AND lang IN ('en', 'fr')")
def level_filter(spark, sf_dir):
    d = B.documents(spark, sf_dir).withColumn("quality", F.col("quality").cast("int"))
    return Explorer(d).among("quality", ["<NA>", "0"]).among("lang", ["en", "fr"]).among("source", []).df.select("doc_id")


@query("q10_equal_to_outcome", f"""WITH {B.ORDERS} SELECT 'copy' AS "column", 1.0::DOUBLE AS equal_share UNION ALL SELECT 'opposite', 1.0 UNION ALL
SELECT 'n_lines', CASE WHEN count(n_lines) >= 100 THEN round(greatest(avg(CASE WHEN n_lines IS NOT NULL THEN CASE WHEN abs(n_lines - y) <= 1e-8 + 1e-5 * y THEN 1 ELSE 0 END END), avg(CASE WHEN n_lines IS NOT NULL THEN CASE WHEN abs(n_lines - (1 - y)) <= 1e-8 + 1e-5 * (1 - y) THEN 1 ELSE 0 END END)), 6) END FROM b""")  # fmt: skip
def near_equal(spark, sf_dir):
    o = B.orders(spark, sf_dir).select("y", F.col("y").alias("copy"), (1 - F.col("y")).alias("opposite"), "n_lines")
    return rounded(guard.equality_shares(o, "y"))


@query("q13_row_checks", "SELECT o_orderkey, coalesce(nullif(o_totalprice, 0) < 100000, false) AS graduating_lt_etm, o_orderkey % 3 <= 0 AS enrolled_terms_zero_or_neg FROM orders")
def row_checks(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("graduating_cgpa"), F.lit(100000.0).alias("cgpa_at_etm_to_any_campus"), (F.col("o_orderkey") % 3).alias("enrolled_terms"))
    return features.row_checks(o).select("o_orderkey", "graduating_lt_etm", "enrolled_terms_zero_or_neg")


@query("q14_top_levels", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 5)")
def top_levels(spark, sf_dir):
    return keys.top_levels(B.read(spark, sf_dir, "customer"), "c_nationkey", 5).select("c_custkey")


@query("q15_lookup", f"WITH {B.TERMS} SELECT term_index, round(term_gpa, 6) AS term_gpa FROM t WHERE c_custkey = 7")
def lookup(spark, sf_dir):
    return rounded(keys.lookup(B.terms(spark, sf_dir), "7", ["c_custkey"]).select("term_index", "term_gpa"))


@query("q16_overlap", "SELECT count(*) AS left_rows, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS matched, count(DISTINCT c_custkey) AS left_keys FROM customer")
def overlap(spark, sf_dir):
    return keys.overlap(B.read(spark, sf_dir, "customer"), B.read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("w1_keep_first", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def keep_first(spark, sf_dir):
    return keys.keep_first(B.read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("j1_left_without_duplicates", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def nondup(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", F.lit(0).alias("o_orderkey"))
    return keys.merge_nondup(o, c, "o_custkey")


@query("j7_key_map", f"WITH {B.TERMS} SELECT c_custkey, term_index, c_name FROM t LEFT JOIN customer USING (c_custkey)")
def key_map(spark, sf_dir):
    return keys.with_key(B.terms(spark, sf_dir), B.customers(spark, sf_dir), "c_custkey", "c_name").select("c_custkey", "term_index", "c_name")


@query("j8_semi_join", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi(spark, sf_dir):
    return keys.also_in(B.read(spark, sf_dir, "documents"), B.read(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("j9_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(spark, sf_dir):
    return keys.only_in(B.read(spark, sf_dir, "documents"), B.read(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("a10_distinct_counts", f"WITH {B.EVENTS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", count(*) AS \"rows\" FROM e" for c in ("user_id", "event_type", "k")))
def distinct_counts(spark, sf_dir):
    return Explorer(B.events(spark, sf_dir)).distinct_counts(["user_id", "event_type", "k"])


@query("a11_missing_rates", f"WITH {B.DOCUMENTS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS missing_pct FROM d" for c in ("doc_id", "lang", "source", "n_chars", "quality")))
def missing(spark, sf_dir):
    return rounded(guard.missing_rates(B.documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", "quality")))


@query("a16_kpis", f"WITH {B.ORDERS} SELECT round(100 * avg(y), 6) AS outcome_pct, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in B.NUMERIC[:3]) + " FROM b")
def kpis(spark, sf_dir):
    return rounded(Explorer(B.orders(spark, sf_dir)).kpis("y", B.NUMERIC[:3]))


@query("a17_kpis_by_outcome", f"WITH {B.ORDERS} SELECT 'count' AS metric, count(*) FILTER (y = 1)::DOUBLE AS outcome_1, count(*) FILTER (y = 0)::DOUBLE AS outcome_0 FROM b" + "".join(f" UNION ALL SELECT '{c}', round(avg({c}) FILTER (y = 1), 6), round(avg({c}) FILTER (y = 0), 6) FROM b" for c in B.NUMERIC[:3]))
def kpis_by_outcome(spark, sf_dir):
    return rounded(Explorer(B.orders(spark, sf_dir)).kpis_by_outcome("y", B.NUMERIC[:3]))


def _corr(a: str, b: str) -> str:
    return f"SELECT '{a}' AS col1, '{b}' AS col2, round(CASE WHEN isnan(corr({b}, {a})) THEN NULL ELSE corr({b}, {a}) END, 6) AS corr FROM b"


_CORR = ["o_totalprice", "sum_qty", "n_lines"]


@query("a20_correlations", f"WITH {B.ORDERS} " + " UNION ALL ".join(_corr(a, b) for a in _CORR for b in _CORR))
def correlations(spark, sf_dir):
    return rounded(Explorer(B.orders(spark, sf_dir)).correlations(_CORR))


_ENDS = (0.0, *GRADE_ENDS)


@query("a21_fixed_bins", f"""WITH {B.TERMS}, z AS (SELECT i AS bin_no, '(' || lo || ', ' || hi || ']' AS bin, lo, hi FROM (VALUES {', '.join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(_ENDS, _ENDS[1:]), 1))}) v(i, lo, hi))
SELECT CAST(bin_no AS INTEGER) AS bin_no, bin, {_BAND.format(v="CAST(t.term_index AS DOUBLE)")} FROM z LEFT JOIN t ON term_gpa > lo AND term_gpa <= hi GROUP BY bin_no, bin""")  # fmt: skip
def fixed_bins(spark, sf_dir):
    return rounded(Explorer(B.terms(spark, sf_dir)).binned("term_gpa", "term_index"))


@query("a23_level_rates", f"WITH {B.ORDERS} SELECT n_name AS level, count(*) AS n, round(avg(y), 6) AS rate FROM b WHERE n_name IS NOT NULL GROUP BY 1")
def level_rates(spark, sf_dir):
    return rounded(Explorer(B.orders(spark, sf_dir)).level_rates("n_name", "y"))


@query("a24_bounds", f"WITH {B.EVENTS} SELECT min(value) AS lo, max(value) AS hi FROM e WHERE k BETWEEN 5 AND 80")
def bounds(spark, sf_dir):
    return Explorer(B.events(spark, sf_dir)).between("k", 5, 80).bounds("value")


def _hist(source: str, x: str, bins: str) -> str:
    return f"""ends AS (SELECT CASE WHEN min({x}) = max({x}) THEN min({x}) - 0.5 ELSE min({x}) END AS a, CASE WHEN min({x}) = max({x}) THEN max({x}) + 0.5 ELSE max({x}) END AS z, {bins} AS nb FROM {source}),
h AS (SELECT least(CAST(floor(({x} - a) / ((z - a) / nb)) AS INTEGER) + 1, CAST(nb AS INTEGER)) AS bin_no, count(*) AS c FROM {source}, ends WHERE {x} IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin_no, round(a + (i - 1) * ((z - a) / nb), 6) AS lo, round(a + i * ((z - a) / nb), 6) AS hi, round(((a + (i - 1) * ((z - a) / nb)) + (a + i * ((z - a) / nb))) / 2, 6) AS mid, coalesce(c, 0) AS count
FROM ends, unnest(range(1, CAST(nb AS BIGINT) + 1)) r(i) LEFT JOIN h ON h.bin_no = i"""


@query("v2_histogram", f"WITH {B.EVENTS}, {_hist('e', 'value', 'greatest(10, least(60, floor(sqrt(count(value)))))')}")
def histogram(spark, sf_dir):
    return rounded(Explorer(B.events(spark, sf_dir)).histogram("value"))


@query("v2_histogram_by_outcome", "WITH " + B.EVENTS + " " + " UNION ALL ".join(f"SELECT *, '{p}' AS part FROM (WITH f AS (SELECT value FROM e WHERE {w}), {_hist('f', 'value', '12')})" for p, w in (("all", "true"), ("1", "y = 1"), ("0", "y = 0"))))
def histogram_by_outcome(spark, sf_dir):
    return rounded(Explorer(B.events(spark, sf_dir)).histogram_by_outcome("value", "y", 12))


@query("v3_histogram_30", f"WITH {B.ORDERS}, {_hist('b', 'o_totalprice', '30')}")
def histogram_30(spark, sf_dir):
    return rounded(Explorer(B.orders(spark, sf_dir)).histogram("o_totalprice", 30))


@query("v4_top_level_rates", f"WITH {B.ORDERS} SELECT n_name AS level, count(*) AS n, round(avg(y), 6) AS rate FROM b WHERE n_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, level LIMIT 10")
def top_level_rates(spark, sf_dir):
    return rounded(Explorer(B.orders(spark, sf_dir)).level_rates("n_name", "y", 10))


@query("v5_top_levels", f"WITH {B.DOCUMENTS} SELECT coalesce(CAST(CAST(quality AS INTEGER) AS VARCHAR), '<NA>') AS level, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, level LIMIT 30")
def top_30(spark, sf_dir):
    return Explorer(B.documents(spark, sf_dir).withColumn("quality", F.col("quality").cast("int"))).levels("quality", 30)


_KINDS = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "double"}


@query("v8_types", f"WITH {B.DOCUMENTS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 3) AS missing_pct FROM d" for c, kind in _KINDS.items()))
def types(spark, sf_dir):
    return Explorer(B.documents(spark, sf_dir)).types()


@query("a26_non_null_counts", f"WITH {B.ORDERS}, n AS (SELECT *, CAST(NULL AS VARCHAR) AS nothing FROM b) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) AS \"rows\", count({c}) = 0 AS all_null FROM n" for c in (*B.NUMERIC, "nothing")))
def non_null(spark, sf_dir):
    rows = B.orders(spark, sf_dir).withColumn("nothing", F.lit(None).cast("string"))
    return Explorer(rows).non_null_counts([*B.NUMERIC, "nothing"])


_SCREENED = ("o_orderpriority", "c_mktsegment", "n_name", "r_name", "c_name", "part_id", "clerk")


def _screening(spark, sf_dir):
    """Orders with levels below and above the bound of 60, and a name with "id" in it."""
    o = B.orders(spark, sf_dir)
    key = F.col("o_orderkey")
    return o.withColumns({"c_name": (key % 61).cast("string"), "part_id": (key % 3).cast("string"), "clerk": (key % 60).cast("string")})


@query("p9_screened_categories", f"""WITH {B.ORDERS}, w AS (SELECT o_orderpriority, c_mktsegment, n_name, r_name, CAST(o_orderkey % 61 AS VARCHAR) AS c_name, CAST(o_orderkey % 3 AS VARCHAR) AS part_id, CAST(o_orderkey % 60 AS VARCHAR) AS clerk FROM b),
n AS (SELECT count(*) AS n FROM w), u AS (SELECT feature, count(DISTINCT level) AS levels FROM w UNPIVOT (level FOR feature IN (o_orderpriority, c_mktsegment, n_name, r_name, c_name, part_id, clerk)) GROUP BY feature)
SELECT feature, levels, n AS \"rows\" FROM u, n WHERE feature NOT LIKE '%id%' AND levels <= 60 AND levels <= greatest(200, 0.5 * n)""".replace('\\"', '"'))
def screened(spark, sf_dir):
    rows = _screening(spark, sf_dir)
    found = scan.screened_categories(rows, _SCREENED)
    return scan.level_numbers(rows, found)


_STATUS = ["Graduated", "Degree Awarded", "Not Graduated", "Undergraduate", "Planned Degree", None]


@query("f12_information_features", """WITH s AS (SELECT o_orderkey, round(o_totalprice / 100000, 2) AS g, (o_orderkey % 7) / 2.0::DOUBLE AS c, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 11) / 3.0::DOUBLE END AS h,
  CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderkey % 6 END AS t, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey % 4 END AS w, o_orderkey % 3 AS l, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 9 - 3 END AS f, o_orderkey % 6 AS st FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS random_id, round(g - c, 6) AS cgpa_gap, CASE WHEN st IN (0, 1, 4) THEN 1 ELSE 0 END AS graduated_me, round(coalesce(w, 0) / nullif(t, 0), 6) AS warnings_per_term, round(l / nullif(t, 0), 6) AS low_gpa_term_rate_2_5,
  round((l + 1) / nullif(t, 0), 6) AS low_gpa_term_rate_3_0, round(h - c, 6) AS peak_minus_etm, CASE WHEN f > 0 THEN 1 ELSE 0 END AS grade_forgiveness_used, CASE WHEN w > 0 THEN 1 ELSE 0 END AS multi_repeat_flag,
  0 AS cgpa_at_etm_to_any_campus_is_missing, 0 AS graduating_cgpa_is_missing, CASE WHEN t IS NULL THEN 1 ELSE 0 END AS enrolled_terms_su_included_is_missing FROM s""")
def information(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n, gap: F.when(k % n != gap, k % n)
    sheet = B.read(spark, sf_dir, "orders").select(
        k.cast("string").alias("random_id"), F.round(F.col("o_totalprice") / 100000, 2).alias("graduating_cgpa"), ((k % 7) / 2).alias("cgpa_at_etm_to_any_campus"),
        F.when(k % 5 != 0, (k % 11) / 3).alias("highest_cgpa_during_credit_window"), some(6, 5).alias("enrolled_terms_su_included"), some(4, 3).alias("no_of_warning"),
        (k % 3).alias("term_gpa25"), (k % 3 + 1).alias("term_gpa3"), F.when(k % 9 != 0, k % 9 - 3).alias("total_grade_forgiveness_credits_approved_before_etm_to_any_campus"),
        some(4, 3).alias("courses_taken_3rd_time"), F.get(F.array(*(F.lit(x).cast("string") for x in _STATUS)), (k % 6).cast("int")).alias("me_bs_degree_status"),
    )
    new = ["cgpa_gap", "graduated_me", "warnings_per_term", "low_gpa_term_rate_2_5", "low_gpa_term_rate_3_0", "peak_minus_etm", "grade_forgiveness_used", "multi_repeat_flag"]
    missing = [f"{c}_is_missing" for c in ("cgpa_at_etm_to_any_campus", "graduating_cgpa", "enrolled_terms_su_included")]
    return rounded(features.info_features(sheet).select("random_id", *new, *missing))


@query("p11_sanitize", f"WITH {B.ORDERS} SELECT y, o_totalprice, sum_qty, o_orderpriority FROM b")
def sanitized(spark, sf_dir):
    o = B.orders(spark, sf_dir).select("y", "o_totalprice", "sum_qty", "o_orderpriority", F.col("y").alias("copy"), F.when(F.col("o_orderkey") % 3 == 0, F.col("n_lines")).alias("sparse"), F.col("n_lines").alias("degree_lines"))
    return guard.sanitize(o, "y")[0]


# -- many columns at once --------------------------------------------------------------------------------------

#: More features than one native aggregation takes: remainders of the orders' numbers.
_MANY = {f"{c}_mod_{k}": (c, k) for c in B.NUMERIC for k in range(2, 12)}
_MANY_SQL = "long AS (" + " UNION ALL ".join(f"SELECT '{name}' AS feature, floor({c} * 100) % {k} AS value, y FROM b WHERE {c} IS NOT NULL" for name, (c, k) in _MANY.items()) + ")"


def _many(spark, sf_dir):
    return B.orders(spark, sf_dir).select("y", *((F.floor(F.col(c) * 100) % k).alias(name) for name, (c, k) in _MANY.items()))


@query("a5_effect_sizes_of_many", f"WITH {B.ORDERS}, {_MANY_SQL}, {_MOMENTS}, d AS (SELECT *, (m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0) AS d FROM g WHERE n1 >= 25 AND n0 >= 25) SELECT feature, round(d, 6) AS cohens_d, n1, n0 FROM d WHERE d IS NOT NULL")
def effect_sizes_of_many(spark, sf_dir):
    return rounded(scan.effect_sizes(_many(spark, sf_dir), "y", list(_MANY)).select("feature", "cohens_d", "n1", "n0"))


_PAIRS = ["o_totalprice", "sum_qty", "avg_discount", "avg_tax", "n_lines", "odd_lines", "nothing", "same"]


@query("a20_correlations_pairwise", f"WITH {B.ORDERS}, w AS (SELECT *, CASE WHEN n_lines % 2 = 1 THEN n_lines END AS odd_lines, CAST(NULL AS DOUBLE) AS nothing, 5.0 AS same FROM b) " + " UNION ALL ".join(f"SELECT '{a}' AS col1, '{c}' AS col2, round(CASE WHEN isnan(corr({a}, {c})) THEN NULL ELSE corr({a}, {c}) END, 6) AS corr FROM w" for a in _PAIRS for c in _PAIRS))
def correlations_pairwise(spark, sf_dir):
    odd = F.when(F.col("n_lines") % 2 == 1, F.col("n_lines"))
    rows = B.orders(spark, sf_dir).withColumns({"odd_lines": odd, "nothing": F.lit(None).cast("double"), "same": F.lit(5.0)})
    return rounded(Explorer(rows).correlations(_PAIRS))


_SHOWN = ["o_totalprice", "sum_qty", "avg_discount"]


@query("v2_histograms_of_features", f"WITH {B.ORDERS} " + " UNION ALL ".join(f"SELECT *, '{c}' AS feature, '{p}' AS part FROM (WITH f AS (SELECT {c} FROM b WHERE {w}), {_hist('f', c, f'greatest(10, least(60, floor(sqrt(count({c})))))')})" for c in _SHOWN for p, w in (("all", "true"), ("1", "y = 1"), ("0", "y = 0"))))
def histograms_of_features(spark, sf_dir):
    return rounded(wide.histograms(B.orders(spark, sf_dir), _SHOWN, "y"))


@query("v4_level_rates_of_features", f"WITH {B.ORDERS}, {B.LEVELS} SELECT feature, level, n, rate FROM (SELECT feature, level, count(*) AS n, round(avg(y), 6) AS rate, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, level) AS r FROM lev GROUP BY 1, 2) WHERE r <= 10")
def level_rates_of_features(spark, sf_dir):
    return rounded(scan.level_rates(B.orders(spark, sf_dir), "y", B.TEXT, 10))


@query("v7_scatter", f"WITH {B.ORDERS} SELECT o_orderkey, sum_qty, o_totalprice, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), sum_qty, o_totalprice) AS r FROM b WHERE sum_qty IS NOT NULL AND o_totalprice IS NOT NULL) WHERE r <= 25")
def scatter(spark, sf_dir):
    return Explorer(B.orders(spark, sf_dir)).scatter("sum_qty", "o_totalprice", "o_orderkey", 25, "o_orderpriority")


# -- whole builds and file order -------------------------------------------------------------------------------


@query("w1_file_order", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY place) AS r FROM (SELECT *, row_number() OVER () AS place FROM lineitem)) WHERE r = 1")
def first_in_files(spark, sf_dir):
    return keys.keep_first(B.read(spark, sf_dir, "lineitem"), "l_suppkey", [file_order()]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("w1_row_numbers", "SELECT event_id, row_number() OVER () - 1 AS place FROM events")
def numbers_in_files(spark, sf_dir):
    return with_row_numbers(B.read(spark, sf_dir, "events"), "place").select("event_id", "place")


@query("j2_build_features", f"""WITH {B.MEANING}, s AS (SELECT o_orderkey, round(o_totalprice / 100000, 2) AS g, (o_orderkey % 7) / 2.0::DOUBLE AS c, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderkey % 6 END AS t, o_orderkey % 6 AS st FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'S' || (10000000 + o_orderkey) END AS random_id, CASE WHEN o_orderkey % 3 > 0 THEN CAST(10000000 + o_orderkey AS VARCHAR) END AS merge_id, round(g - c, 6) AS cgpa_gap, CASE WHEN st IN (0, 1, 4) THEN 1 ELSE 0 END AS graduated_me,
  CASE WHEN t IS NULL THEN 1 ELSE 0 END AS enrolled_terms_su_included_is_missing, CAST(chem_a AS DOUBLE) AS chem_110_attempts_to_abc, chem_label AS chem_110_outcome_label, CAST(math_n AS BIGINT) AS math_140_total_attempts,
  CAST(coalesce(chem_a, 0) + coalesce(math_a, 0) AS DOUBLE) AS etm_total_attempts_to_abc FROM s JOIN c USING (o_orderkey)""")  # fmt: skip
def build_features(spark, sf_dir):
    """The whole build over a sheet in which a third of the rows have no identifier."""
    k = F.col("o_orderkey")
    sheet = B.read(spark, sf_dir, "orders").select(
        k, F.when(k % 3 > 0, F.concat(F.lit("S"), (k + 10000000).cast("string"))).alias("Random ID"), F.round(F.col("o_totalprice") / 100000, 2).alias("Graduating CGPA"),
        ((k % 7) / 2).alias("CGPA at ETM to any campus"), F.when(k % 6 != 5, k % 6).alias("Enrolled Terms SU included"), F.get(F.array(*(F.lit(x).cast("string") for x in _STATUS)), (k % 6).cast("int")).alias("ME_BS Degree Status"),
    )
    out = study.build(sheet.join(B.courses(spark, sf_dir), "o_orderkey"), None)[0]
    return rounded(out.select("o_orderkey", "random_id", "merge_id", "cgpa_gap", "graduated_me", "enrolled_terms_su_included_is_missing", "chem_110_attempts_to_abc", "chem_110_outcome_label", "math_140_total_attempts", "etm_total_attempts_to_abc"))


# -- names, identifiers, labels and lines ----------------------------------------------------------------------

_ODD = "p_type || CASE p_partkey % 5 WHEN 0 THEN ' (1st FA or SP)' WHEN 1 THEN ' GPA≥2.5/3' WHEN 2 THEN '  50% - A,B ' WHEN 3 THEN '-é_!' ELSE '' END"


def _odd() -> Column:
    ends = F.array(*map(F.lit, [" (1st FA or SP)", " GPA≥2.5/3", "  50% - A,B ", "-é_!", ""]))
    return F.concat("p_type", F.get(ends, (F.col("p_partkey") % 5).cast("int")))


@query("f1_std_col", f"""SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(trim(regexp_replace({_ODD}, '\\s+', ' ', 'g')), '≥', 'ge'), '(', '_'), ')', ''), '/', '_'), '%', 'pct'), '-', ' '), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', '_', 'g')) AS name FROM part""".replace("\\\\", "\\"))
def std_names(spark, sf_dir):
    return B.read(spark, sf_dir, "part").select("p_partkey", E.std_name(_odd()).alias("name"))


@query("f28_safe_name", f"SELECT p_partkey, substr(regexp_replace({_ODD}, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 12) AS name FROM part")
def safe_names(spark, sf_dir):
    return B.read(spark, sf_dir, "part").select("p_partkey", E.file_name(_odd(), 12).alias("name"))


@query("f2_identifier", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE 'nan' END AS id_or_text FROM customer")
def identifiers(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit(" \u00a0"), F.col("c_name"), F.lit("\t")))
    return B.customers(spark, sf_dir).select("c_custkey", E.identifier(text).alias("id"), E.identifier(text, "nan").alias("id_or_text"))


@query("f18_outcome_by_alias", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS graduated_me FROM orders")
def outcome_by_alias(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "NO ").otherwise("pending")
    o = B.read(spark, sf_dir, "orders").select("o_orderkey", status.alias("me_bs_degree_status"))
    return study.with_outcome(o, "graduated_me").select("o_orderkey", "graduated_me")


@query("f22_bucket_labels", f"WITH {_BUCKETS} SELECT feature, bucket_no, printf('[%.2f, %.2f)', lo, hi) AS label FROM bk")
def bucket_labels(spark, sf_dir):
    found = scan.bucket_summary(B.orders(spark, sf_dir), "y", B.NUMERIC).select("feature", "bucket_no", "lo", "hi").collect()  # a row for each bucket
    return spark.createDataFrame([(r["feature"], r["bucket_no"], synth.bucket_label(r["lo"], r["hi"])) for r in found], "feature string, bucket_no int, label string")


@query("f30_bullets", f"""WITH e AS ({_EFFECTS}), r AS ({_RATIOS}), a AS (SELECT 1 AS kind, row_number() OVER (ORDER BY score DESC, feature) AS r, printf('`%s`: standardised difference %+.2f (means %.2f with the outcome, %.2f without; %d and %d rows)', feature, cohens_d, mean_grad1, mean_grad0, n1, n0) AS line FROM e
UNION ALL SELECT 2, row_number() OVER (ORDER BY score DESC, feature), printf('`%s` is `%s`: %.2f times the rate of the other levels (95 %% interval %.2f to %.2f; %d rows)', feature, level, risk_ratio, rr_low, rr_high, n_level) FROM r)
SELECT CAST(row_number() OVER (ORDER BY kind, r) AS INTEGER) AS nth, line FROM a WHERE r <= 3""")  # fmt: skip
def lines(spark, sf_dir):
    o = B.orders(spark, sf_dir)
    effects, ratios = (rounded(x) for x in (scan.effect_sizes(o, "y", B.NUMERIC), scan.risk_ratios(o, "y", B.TEXT)))
    none = spark.createDataFrame([], "feature string, bucket_no int, n long, grad_rate double")
    found = synth.bullets(synth.combined(effects, ratios, none, 3, 3, 0))
    return spark.createDataFrame([*enumerate(found, 1)], "nth int, line string")
