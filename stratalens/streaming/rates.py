"""The decomposable cohort aggregates over a stream: counts, outcome rates and moments by event-time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_band(stream: DataFrame, time: str, value: Column, by: Sequence[str], width: str, late: str) -> DataFrame:
    """count, mean, std and a normal band of a value by window and cohort; rows later than ``late`` are dropped."""
    from ..operators.trajectory import band

    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, width), *by).agg(*band(value)).select(F.col("window.start").alias("begins"), *by, "count", "mean", "std", "se", "lo", "hi")
