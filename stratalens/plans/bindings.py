"""Concrete tables in the roles that the operators ask for, each with the same relation as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trajectory import grid, melt

NUMERIC = ["o_totalprice", "sum_qty", "avg_discount", "avg_tax", "n_lines"]
TEXT = ["o_orderpriority", "c_mktsegment", "n_name", "r_name"]
#: Terms of the customers' series: spring to April, summer to July, fall.
TERM_SLOTS = [f"{y}_{t}" for y in range(1995, 2002) for t in ("spring", "summer", "fall")]
#: Outcome texts of a synthetic course, by order key modulo 10: first year, second year, final.
COURSE_TEXTS = [
    ("1st Attempt=ABC", None, None), ("Only 1 Attempt=DFW", "2 Attempts (1st=DFW, 2nd=ABC)", None), ("Only 1 Attempt=DFW", "Never Enrolled", None),
    ("2 Attempts (Both=DFW)", None, "PASS"), ("2 Attempts (Both=DFW)", None, None), (None, "4 Attempts (4th=ABC)", None), (None, None, "Never Enrolled"),
    (None, None, "C-"), ("3 Attempts (1st=DFW, 2nd=DFW, 3rd=ABC)", None, None), ("1st Attempt=ABC", "Only 1 Attempt=DFW", None),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: outcome y, aggregates of its lines (null without one), and its customer's categories."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.round(F.avg("l_tax"), 6).alias("avg_tax"), F.count("*").cast("double").alias("n_lines"))
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    buyers = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    o = read(spark, sf_dir, "orders").join(li, "o_orderkey", "left").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("y"), *NUMERIC, *TEXT)


ORDERS = """li AS (SELECT l_orderkey, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_discount, round(avg(l_tax), 6) AS avg_tax, CAST(count(*) AS DOUBLE) AS n_lines FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, o_totalprice, sum_qty, avg_discount, avg_tax, n_lines, o_orderpriority, c_mktsegment, n_name, r_name
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""
VALUES = "long AS (SELECT feature, value, y FROM (SELECT y, o_totalprice, sum_qty, avg_discount, avg_tax, n_lines FROM b) UNPIVOT (value FOR feature IN (o_totalprice, sum_qty, avg_discount, avg_tax, n_lines)))"
LEVELS = "lev AS (SELECT feature, level, y FROM (SELECT y, o_orderpriority, c_mktsegment, n_name, r_name FROM b) UNPIVOT (level FOR feature IN (o_orderpriority, c_mktsegment, n_name, r_name)))"


def _slot() -> Column:
    month, year = F.month("o_orderdate"), F.year("o_orderdate").cast("string")
    return F.concat(year, F.when(month <= 4, "_spring").when(month <= 7, "_summer").otherwise("_fall"))


def term_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by term: the mean order price over 123,457, on about a 0 to 4 scale."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), _slot().alias("term_slot"), F.col("o_totalprice").alias("term_gpa"))
    means = grid(o, ["c_custkey"], TERM_SLOTS)
    return means.select("c_custkey", *((F.col(f"`{s}`") / 123457).alias(s) for s in TERM_SLOTS))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The melted grid."""
    return melt(term_grid(spark, sf_dir), ["c_custkey"], TERM_SLOTS)


TERMS = """s AS (SELECT o_custkey AS c_custkey, year(o_orderdate) AS yr, CASE WHEN month(o_orderdate) <= 4 THEN 'spring' WHEN month(o_orderdate) <= 7 THEN 'summer' ELSE 'fall' END AS season, o_totalprice FROM orders),
t AS (SELECT c_custkey, CAST((yr - 1995) * 3 + CASE season WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 ELSE 3 END AS INTEGER) AS term_index, yr || '_' || season AS term_slot,
  avg(o_totalprice) / 123457 AS term_gpa, CASE WHEN season = 'summer' THEN 1 ELSE 0 END AS is_summer, CASE WHEN season = 'summer' THEN 0 ELSE 1 END AS is_regular FROM s GROUP BY c_custkey, yr, season)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an outcome (a positive balance) and a segment."""
    return read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).cast("double").alias("y"), "c_mktsegment", "c_acctbal", "c_name")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their quality label, which most lack."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


DOCUMENTS = "d AS (SELECT doc_id, lang, source, n_chars, CAST(quality AS DOUBLE) AS quality FROM documents LEFT JOIN labels USING (doc_id))"


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with outcome texts of two courses: that of the key modulo 10, and of the key + 3."""

    def text(shift: int, k: int) -> Column:
        texts = F.array(*(F.lit(t[k]).cast("string") for t in COURSE_TEXTS))
        return F.get(texts, ((F.col("o_orderkey") + shift) % 10).cast("int"))

    grade = lambda shift: F.get(F.array(*map(F.lit, ["A", "D", " w ", "F", "B", "N/A", "WF", "C", "LD", "C-"])), ((F.col("o_orderkey") + shift) % 10).cast("int"))
    out = [F.col("o_orderkey")]
    for name, shift in (("chem_110", 0), ("math_140", 3)):
        out += [text(shift, 0).alias(f"{name}_outcome_after_1st_ay"), text(shift, 1).alias(f"{name}_outcome_after_2nd_ay"), text(shift, 2).alias(f"{name}_outcome"), grade(shift).alias(f"{name}__grade_code__1st_fa_or_sp")]
    return read(spark, sf_dir, "orders").select(*out)


#: What the texts above mean: attempts to a pass, all attempts, label; and whether the first grade is D, F or W.
MEANING = """m(k, a, n, label, dfw) AS (VALUES (0, 1.0, 1, 'Pass on 1st attempt', 0), (1, 2.0, 2, 'Pass on 2nd attempt', 1), (2, NULL, 1, 'No pass after 1 attempt', 1),
  (3, 3.0, 3, 'Pass on 3rd attempt', 1), (4, NULL, 2, 'No pass after 2 attempts', 0), (5, 4.0, 4, 'Requires more than three attempts', 0), (6, NULL, 0, 'Never enrolled', 1),
  (7, NULL, 0, 'Never enrolled', 0), (8, 3.0, 3, 'Pass on 3rd attempt', 1), (9, NULL, 1, 'No pass after 1 attempt', 0)),
c AS (SELECT o_orderkey, x.a AS chem_a, x.n AS chem_n, x.label AS chem_label, x.dfw AS chem_dfw, z.a AS math_a, z.n AS math_n, z.label AS math_label, z.dfw AS math_dfw
  FROM orders JOIN m x ON x.k = o_orderkey % 10 JOIN m z ON z.k = (o_orderkey + 3) % 10)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", (F.col("event_type") == "purchase").cast("double").alias("y"), F.get_json_object("props", "$.k").cast("double").alias("k"))


EVENTS = "e AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, CAST(props->>'$.k' AS DOUBLE) AS k FROM events)"
