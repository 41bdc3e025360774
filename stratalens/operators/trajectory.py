"""Short irregular series of terms: grid to long rows, per-entity aggregates, slopes and cohort bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from .quantiles import quantiles

#: Slots of the term grid: eight years of three terms, and a ninth fall.
YEARS = ("1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th")
SLOTS = [f"{y}_{t}" for y in YEARS for t in ("fall", "spring", "summer")] + ["9th_fall"]


def melt(grid: DataFrame, ids: Sequence[str], slots: Sequence[str] = SLOTS) -> DataFrame:
    """(ids.., term_index, term_slot, term_gpa, is_summer, is_regular) of filled slots; the index counts the slots present."""
    present = [s for s in slots if s in grid.columns]
    wide = grid.select(*ids, *(E.number(F.col(f"`{s}`")).alias(s) for s in present))
    rows = wide.unpivot(list(ids), present, "term_slot", "term_gpa").filter("term_gpa is not null")
    index = F.array_position(F.array(*map(F.lit, present)), F.col("term_slot")).cast("int")
    summer = F.col("term_slot").contains("summer").cast("int")
    return rows.select(*ids, index.alias("term_index"), "term_slot", "term_gpa", summer.alias("is_summer"), (1 - summer).alias("is_regular"))


def grid(long: DataFrame, ids: Sequence[str], slots: Sequence[str] = SLOTS) -> DataFrame:
    """The inverse of ``melt``: one row of the ids with a column for each slot, the mean where a slot occurs again, null where it doesn't.

    One aggregation; the slots are given, so no job looks for them, and other slots are left out.
    """
    return long.groupBy(*ids).pivot("term_slot", list(slots)).agg(F.avg("term_gpa"))


def summarise(long: DataFrame, key: str, low: tuple[float, float] = (2.5, 3.0)) -> DataFrame:
    """One row per entity with a term: counts, moments, first and last, slope, early mean and summer share, in one aggregation."""
    v, i = F.col("term_gpa"), F.col("term_index")
    regular = F.filter(F.array_sort(F.collect_list(F.when(F.col("is_regular") == 1, F.struct(i.alias("i"), v.alias("v"))))), lambda x: x.isNotNull())  # at most a grid's slots
    early = F.transform(F.slice(regular, 1, 2), lambda x: x["v"])
    t = long.groupBy(key).agg(
        F.count(v).alias("terms_with_gpa"),
        F.avg(v).alias("mean_term_gpa"),
        F.median(v).alias("median_term_gpa"),
        F.stddev_samp(v).alias("std_term_gpa"),
        F.min(v).alias("min_term_gpa"),
        F.max(v).alias("max_term_gpa"),
        F.min_by(v, i).alias("first_term_gpa"),
        F.max_by(v, i).alias("last_term_gpa"),
        F.sum("is_summer").alias("n_summer_terms"),
        F.sum("is_regular").alias("n_regular_terms"),
        F.count_if(v < low[0]).alias("low_gpa_terms_2_5"),
        F.count_if(v < low[1]).alias("low_gpa_terms_3_0"),
        F.regr_slope(v, i.cast("double")).alias("gpa_trend_slope"),
        early.alias("_early"),
    )
    mean = F.aggregate("_early", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_early"), F.lit(0))
    t = t.withColumn("first_two_regular_mean_gpa", mean).drop("_early")
    return t.withColumn("summer_term_ratio", E.rate(F.col("n_summer_terms"), F.col("terms_with_gpa")))


def slopes(long: DataFrame, key: str) -> DataFrame:
    """(key, gpa_slope); null for one term or a constant index."""
    return long.groupBy(key).agg(F.regr_slope("term_gpa", F.col("term_index").cast("double")).alias("gpa_slope"))


def slope_summary(by_entity: DataFrame) -> DataFrame:
    """n_students with a slope, its median (computed at once), and the share of positive ones among all entities."""
    middle = quantiles(by_entity, ["gpa_slope"], [0.5]).first()
    median = F.lit(middle["quantiles"][0] if middle else None).cast("double")
    return by_entity.agg(F.count("gpa_slope").alias("n_students"), median.alias("median_slope"), F.avg(E.flag(F.col("gpa_slope") > 0)).alias("pct_positive_slope"))


def slope_by_outcome(by_entity: DataFrame, outcome: str) -> DataFrame:
    """(slope_pos, count, grad_rate) over entities with a slope and an outcome."""
    rows = by_entity.filter(F.col("gpa_slope").isNotNull() & F.col(outcome).isNotNull())
    return rows.groupBy((F.col("gpa_slope") > 0).cast("int").alias("slope_pos")).agg(F.count(outcome).alias("count"), F.avg(outcome).alias("grad_rate"))


def band(value: Column, z: float = 1.96) -> list[Column]:
    """count, mean, std, se and a normal band of a value, as aggregates."""
    n, mean, std = F.count(value), F.avg(value), F.stddev_samp(value)
    se = std / F.sqrt(F.greatest(n, F.lit(1)))
    return [n.alias("count"), mean.alias("mean"), std.alias("std"), se.alias("se"), (mean - z * se).alias("lo"), (mean + z * se).alias("hi")]


def cohort_trajectory(long: DataFrame, cohort: str) -> DataFrame:
    """Band of the term value by term and cohort; entities without a cohort form one of their own."""
    return long.groupBy("term_index", cohort).agg(*band(F.col("term_gpa")))
