"""Interactive exploration: filters, KPIs, correlations, histograms, levels, mastery and panels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.names import histogram_bins
from . import wide
from .keys import with_cohort
from .trajectory import band, cohort_trajectory

MISSING = "<NA>"
# Edges and labels of the fixed grade bins.
GRADE_ENDS = (2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.1)


class Explorer:
    """A table behind a chain of filters. Every method returns a DataFrame or a new Explorer.

    Filters narrow the view; what describes the cohort as such (correlations, trajectories, mastery) is of the whole table unless
    ``scope`` is "view".
    """

    def __init__(self, df: DataFrame, whole: DataFrame | None = None):
        self.df, self.whole = df, df if whole is None else whole

    def _where(self, condition: Column) -> Explorer:
        return Explorer(self.df.filter(condition), self.whole)

    def _of(self, scope: str) -> DataFrame:
        return {"whole": self.whole, "view": self.df}[scope]

    def matching(self, column: str, pattern: str) -> Explorer:
        return self._where(F.col(column).cast("string").rlike(pattern))

    def equal(self, column: str, value: str) -> Explorer:
        return self._where(F.col(column).cast("string") == value)

    def between(self, column: str, lo: float, hi: float) -> Explorer:
        """Inclusive; rows without a value go."""
        return self._where(E.plain(F.col(column)).between(lo, hi))

    def among(self, column: str, levels: Sequence[str]) -> Explorer:
        """Levels as text, ``<NA>`` for a missing one; no levels, no filter."""
        return self._where(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).isin(*levels)) if levels else self

    def bounds(self, column: str) -> DataFrame:
        x = E.plain(F.col(column))
        return self.df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))

    def kpis(self, outcome: str, means: Sequence[str]) -> DataFrame:
        return self.df.agg((100 * F.avg(E.plain(F.col(outcome)))).alias("outcome_pct"), *(F.avg(E.plain(F.col(c))).alias(f"mean_{c}") for c in means))

    def kpis_by_outcome(self, outcome: str, means: Sequence[str]) -> DataFrame:
        """(metric, outcome_1, outcome_0) with the count and the means as rows."""
        y = F.col(outcome)
        of = lambda k: [F.count_if(y == k).cast("double").alias(f"count_{k}"), *(F.avg(F.when(y == k, E.plain(F.col(c)))).alias(f"{c}_{k}") for c in means)]
        one = self.df.agg(*of(1), *of(0))
        rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_1").alias("outcome_1"), F.col(f"{m}_0").alias("outcome_0")) for m in ("count", *means))))
        return one.select(rows.alias("r")).select("r.*")

    def correlations(self, columns: Sequence[str], scope: str = "whole") -> DataFrame:
        """(col1, col2, corr), pairwise complete; null where a column is constant."""
        return wide.correlations(self._of(scope), columns)

    def trajectories(self, long: DataFrame, cohort: str, key: str, scope: str = "whole") -> DataFrame:
        """Bands of the long table's terms by cohort, of the entities in scope."""
        of = self._of(scope)
        rows = long if scope == "whole" else long.join(of.select(key).distinct(), key, "left_semi")
        return cohort_trajectory(with_cohort(rows, of, [cohort], [key]), cohort)

    def scatter(self, x: str, y: str, key: str, k: int, by: str | None = None) -> DataFrame:
        """At most ``k`` points (for each level of ``by``), the same ones on every run."""
        return wide.scatter(self.df, x, y, key, k, by)

    def levels(self, column: str, k: int) -> DataFrame:
        """(level, n) of the k most frequent levels, a missing one among them."""
        level = F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("level")
        return self.df.groupBy(level).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(k)

    def level_rates(self, column: str, outcome: str, k: int | None = None) -> DataFrame:
        """(level, n, rate) with the mean outcome of each (or the k most frequent) level."""
        t = self.df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"), F.avg(outcome).alias("rate"))
        return t.orderBy(F.desc("n"), "level").limit(k) if k else t.orderBy(F.desc_nulls_last("rate"), "level")

    def histogram(self, column: str, bins: int | None = None) -> DataFrame:
        """(bin_no, lo, hi, mid, count) of equal-width bins, empty ones too; the top value is in the last bin."""
        x = E.plain(F.col(column))
        if bins is None:
            bins = histogram_bins(self.df.select(F.count(x)).first()[0])
        ends = self.df.agg(F.min(x).alias("a"), F.max(x).alias("b"))
        same = F.col("a") == F.col("b")  # a constant gets a bin of width one around it
        ends = ends.select(F.when(same, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(same, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
        numbered = self.df.select(x.alias("x")).filter("x is not null").crossJoin(F.broadcast(ends))  # one row
        numbered = numbered.select(F.least(F.floor((F.col("x") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)).cast("int") + 1, F.lit(bins)).alias("bin_no"))
        counts = numbered.groupBy("bin_no").agg(F.count("*").alias("count"))
        every = ends.filter("a is not null").withColumn("bin_no", F.explode(F.sequence(F.lit(1), F.lit(bins))))
        width = (F.col("b") - F.col("a")) / bins
        lo, hi = F.col("a") + (F.col("bin_no") - 1) * width, F.col("a") + F.col("bin_no") * width
        return every.join(counts, "bin_no", "left").select("bin_no", lo.alias("lo"), hi.alias("hi"), ((lo + hi) / 2).alias("mid"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))

    def histogram_by_outcome(self, column: str, outcome: str, bins: int | None = None) -> DataFrame:
        """Histograms of all rows and of each outcome, with edges of their own; a missing outcome counts as 0."""
        return wide.histograms(self.df, [column], outcome, bins).drop("feature")

    def binned(self, x: str, y: str, ends: Sequence[float] = GRADE_ENDS, low: float = 0.0) -> DataFrame:
        """Band of y in fixed bins ``(low, ends[0]], ..`` of x; empty bins count 0."""
        labels = [f"({a}, {b}]" for a, b in zip((low, *ends[:-1]), ends)]
        rows = self.df.select(E.right_closed(E.plain(F.col(x)), ends, labels, low, False).alias("bin"), E.plain(F.col(y)).alias("y")).filter("bin is not null and y is not null")
        every = self.df.sparkSession.createDataFrame(list(enumerate(labels, 1)), "bin_no int, bin string")
        t = every.join(rows.groupBy("bin").agg(*band(F.col("y"))), "bin", "left")
        return t.withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))

    def mastery(self, courses: Sequence[str], scope: str = "whole") -> DataFrame:
        """(course, pass_1st, ever_pass, mean_attempts) of each course with a column here; from labels where flags are absent."""
        df, out = self._of(scope), []
        have = {*df.columns}
        none = F.lit(None).cast("double")
        for c in (c for c in courses if any(x.startswith(c) for x in have)):
            label = F.col(f"{c}_outcome_label") if f"{c}_outcome_label" in have else None
            mean = lambda name: F.avg(E.plain(F.col(name)))
            first = mean(f"{c}_pass_by_first_attempt") if f"{c}_pass_by_first_attempt" in have else none if label is None else F.avg(E.flag(label == "Pass on 1st attempt"))
            ever = mean(f"{c}_ever_passed") if f"{c}_ever_passed" in have else none if label is None else F.avg(E.flag(label.contains("Pass")))
            tries = mean(f"{c}_total_attempts") if f"{c}_total_attempts" in have else none
            out.append((c, first, ever, tries))
        one = df.agg(*(F.struct(F.lit(c.upper()).alias("course"), F.first(F.lit(1)).alias("_"), a.alias("pass_1st"), b.alias("ever_pass"), d.alias("mean_attempts")).alias(c) for c, a, b, d in out))
        return one.select(F.explode(F.array(*(F.col(c) for c, *_ in out))).alias("r")).select("r.course", "r.pass_1st", "r.ever_pass", "r.mean_attempts")

    def distinct_counts(self, columns: Sequence[str]) -> DataFrame:
        """(column, distinct, rows): exact numbers of values, without missing ones; computed at once."""
        return self.df.sparkSession.createDataFrame(wide.level_numbers(self.df, columns), "column string, distinct long, rows long")

    def non_null_counts(self, columns: Sequence[str]) -> DataFrame:
        """(column, non_null, rows, all_null) of each column."""
        return self._by_column(columns, lambda c: F.count(c), "non_null").withColumn("all_null", F.col("non_null") == 0)

    def _by_column(self, columns: Sequence[str], of: Callable[[Column], Column], name: str) -> DataFrame:
        """One aggregation of all columns, turned into a row for each."""
        one = self.df.agg(F.count("*").alias("rows"), *(of(E.plain(F.col(f"`{c}`")) if dict(self.df.dtypes)[c] == "double" else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)))
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias(name)) for i, c in enumerate(columns))))
        return one.select(each.alias("r"), "rows").select("r.column", f"r.{name}", "rows")

    def types(self) -> DataFrame:
        """(column, dtype, missing_pct) by name."""
        kinds = self.df.sparkSession.createDataFrame(self.df.dtypes, "column string, dtype string")
        from .guard import missing_rates

        rates = missing_rates(self.df).withColumn("missing_pct", F.round("missing_pct", 3))
        return kinds.join(rates, "column").orderBy("column")
