"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files for each core of the cluster in a table between steps.
FILES_A_CORE = 2
#: Characters that separate words: space, and tab to carriage return.
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine may go without, with a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalens-"))
    return jsc.getCheckpointDir().get()


def written(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and outlives a lost executor.

    Tables that aren't ``large`` (some bytes for each document) get a few files for each core, not one for each
    partition of a shuffle.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalens/{name}-{uuid.uuid4().hex}"
    (df if large else df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _scopes:
        _scopes[-1].append(out)
    _collect(spark, large)
    return out


#: Seconds between two collections of the driver's garbage after small tables, at least, and when the last one was.
GC_S = 5
_collected = [0.0]


def _collect(spark: SparkSession, now: bool) -> None:
    """Spark removes a finished job's shuffle files as the driver collects its garbage, which a driver of little garbage seldom does.

    It removes only what no object of the driver refers to any more, so nothing that a later job could still read.
    """
    if now or time.monotonic() - _collected[0] > GC_S:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


#: Of each open ``scratch``, the tables written in it.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables written inside as it ends, but for those put on its list: what a result still reads."""
    _scopes.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        made = _scopes.pop()
        at = {df.written_at for df in kept}
        discard(*(df for df in made if df.written_at not in at))
        if _scopes:  # what is kept goes with the scope around
            _scopes[-1].extend(df for df in made if df.written_at in at)


def discard(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int, *order: str) -> DataFrame:
    """About ``rows`` rows, never more, spread by the hash of a key and of ``order``: the same rows for the same table.

    Rows whose hash is out of reach go before the sort, so each task sends few to the driver at any size, also where keys are null.
    """
    total = df.count()
    place = _place(key, *order)
    reach = min(1.0, 2 * (rows + 50) / max(1, total))
    near = df.filter(F.pmod(place, F.lit(1 << 20)) <= int(reach * (1 << 20))) if reach < 1 else df
    return near.orderBy(place, *order).limit(rows)


def stratified_sample(df: DataFrame, by: str, key: str, rows: int, *order: str) -> DataFrame:
    """At most ``rows`` rows, as many of each value of ``by`` as there are or as is its even share, in hash order of a key and of ``order``.

    Rows that are equal in these count once, so that a window holds a few times a share. If ``by`` has more than ``rows`` values, those whose
    first row comes first have one row each. The sample reads a written table: collect it inside a ``scratch``.
    """
    placed = df.withColumn("place_", _place(key, *order))
    counts = written(placed.select(by, "place_").distinct().groupBy(by).agg(F.count("*").alias("rows_")), "strata")
    strata = counts.count()
    share = max(1, rows // max(1, strata))
    counts = counts.withColumn("reach_", F.least(F.lit(1.0), F.lit(2.0 * (share + 50)) / F.col("rows_")))
    near = placed.join(F.broadcast(counts) if strata <= 100_000 else counts, by).filter(F.pmod("place_", F.lit(1 << 20)) <= F.col("reach_") * (1 << 20)).dropDuplicates([by, "place_"])
    rank = F.row_number().over(W.partitionBy(by).orderBy("place_", *order))
    return near.withColumn("rank_", rank).filter(F.col("rank_") <= share).orderBy("place_", *order).limit(rows).select(*df.columns)


def _place(*columns: str) -> Column:
    return F.xxhash64(*(F.col(c).cast("string") for c in columns))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or with underscores before it, so that no column of ``taken`` is called so (names ignore case)."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name as SQL wants it."""
    return "`" + name.replace("`", "``") + "`"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names, which it can't name itself: inside they are numbered."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])

    kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(numbered, kinds).toDF(*schema.names)


def trim() -> None:
    """Give a Python worker's freed memory back, as the worker goes on to the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass
