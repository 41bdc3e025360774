"""Exact quantiles of many columns at once by zooming in: no sort, no shuffle of values, no buffer of a column's values.

Each rank lies in an interval of a column's values, at first all of them. A pass over the table counts every interval's values in
``CELLS`` cells, with the smallest and the largest value in each, and the cell that holds the rank is the next interval. Where few values are
left, they are fetched with their counts. The driver holds some numbers for each rank; a thousand times more rows are a pass or two more, and eight are the most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E

#: Cells of an interval, and values of one from which it is fetched.
CELLS, FETCHED = 256, 4096
#: Columns in one pass; more take turns, so that the driver's counts stay bounded.
COLUMNS = 64


def quantiles(df: DataFrame, features: Sequence[str], q: Sequence[float]) -> DataFrame:
    """(feature, quantiles) of the columns: interpolated linearly between the two nearest ranks; missing values don't count.

    Computed at once; a column without values has no row.
    """
    found = []
    for at in range(0, len(features), COLUMNS):
        some = list(features[at : at + COLUMNS])
        numbers = df.select(*(E.plain(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(some))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found += [(some[i], values) for i, values in _selected(numbers, len(some), q)]
        finally:
            numbers.unpersist()
    return df.sparkSession.createDataFrame(found, "feature string, quantiles array<double>")


def _selected(numbers: DataFrame, columns: int, q: Sequence[float]) -> Iterator[tuple[int, list[float]]]:
    ends = numbers.agg(*(f(f"c{i}").alias(f"{n}{i}") for i in range(columns) for n, f in (("n", F.count), ("a", F.min), ("b", F.max)))).first()
    sizes = {i: ends[f"n{i}"] for i in range(columns) if ends[f"n{i}"]}
    ranks = {(i, int(r)) for i, n in sizes.items() for p in q for r in (np.floor(p * (n - 1)), np.ceil(p * (n - 1)))}
    # (column, rank) to the interval it is in (column, smallest, largest), how many values that has, and how many are smaller
    where = {(i, r): ((i, ends[f"a{i}"], ends[f"b{i}"]), sizes[i], 0) for i, r in ranks}
    values: dict[tuple[int, int], float] = {}
    while where:
        for key, ((_, a, b), *_) in list(where.items()):
            if a == b:
                values[key] = a
                del where[key]
        for fetched in (False, True):
            asked = sorted({at for at, n, _ in where.values() if (n <= FETCHED) == fetched})
            if not asked:
                continue
            cells: dict[tuple, list] = {at: [] for at in asked}
            for k, a, b, n in _counted(numbers, asked, fetched):
                cells[asked[k]].append((a, b, n))
            for key, (at, n, before) in list(where.items()):
                if (n <= FETCHED) != fetched:
                    continue
                for a, b, n in sorted(cells[at]):  # cells don't overlap
                    if key[1] < before + n:
                        where[key] = (key[0], a, b), n, before
                        break
                    before += n
    for i, n in sizes.items():
        out = []
        for p in q:
            x = p * (n - 1)
            low, high = values[i, int(np.floor(x))], values[i, int(np.ceil(x))]
            out.append(low if low == high else (np.ceil(x) - x) * low + (x - np.floor(x)) * high)
        yield i, [float(x) for x in out]


def places(x: np.ndarray) -> np.ndarray:
    """The place of each double in the order of all doubles: cells of equal ranges of places get smaller at any scale, infinite values too."""
    bits = (x + 0.0).view(np.int64)  # + 0.0: one zero
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def _counted(numbers: DataFrame, asked: list[tuple[int, float, float]], fetched: bool) -> list[tuple[int, float, float, int]]:
    """(number of the interval, smallest, largest, count) of each cell of the intervals that has values; fetched: a cell for each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, counts = np.full((len(asked), CELLS), np.inf), np.full((len(asked), CELLS), -np.inf), np.zeros((len(asked), CELLS), np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in asked]
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
            for k, (i, a, b) in enumerate(asked):
                x = columns[i]
                x = x[(x >= a) & (x <= b)]
                if fetched:
                    parts[k].append(x)
                    continue
                first, last = places(np.array([a, b]))
                cell = ((places(x) - first) // ((last - first) // np.uint64(CELLS) + np.uint64(1))).astype(np.int64)
                counts[k] += np.bincount(cell, minlength=CELLS)
                np.minimum.at(low[k], cell, x)
                np.maximum.at(high[k], cell, x)
        if fetched:
            each = [np.unique(np.concatenate([*p, np.zeros(0)]), return_counts=True) for p in parts]  # at most FETCHED values over all tasks
            k = np.repeat(np.arange(len(asked)), [len(v) for v, _ in each])
            value, n = (np.concatenate([np.zeros(0), *x]) for x in zip(*each))
            columns = k, value, value, n.astype(np.int64)
        else:
            k, cell = np.nonzero(counts)
            columns = k, low[k, cell], high[k, cell], counts[k, cell]
        cell = columns[1] if fetched else cell.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), pa.array(cell), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3])], names=["k", "cell", "a", "b", "n"])

    found = numbers.mapInArrow(run, "k int, cell double, a double, b double, n long")
    found = found.groupBy("k", "cell").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    return [(r["k"], r["a"], r["b"], r["n"]) for r in found.collect()]  # some hundred rows for each rank
