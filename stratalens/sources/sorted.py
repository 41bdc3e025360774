"""Term tables in the order of their entities: lookups that read one file, and aggregations that move no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, key: str, order: Sequence[str] = (), files: int | None = None) -> None:
    """Parquet with each key in one file, files in ranges of keys, rows by key and ``order``, and Bloom filters of the keys.

    Beside it ``<path>_index`` has each file's smallest and largest key: a row for each file. Rows without a key are in the first file.
    """
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key, *order).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    index = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("rows"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}_index")


def files_of(spark: SparkSession, path: str, value: object) -> list[str]:
    """Files whose range of keys holds the value: one, or none, as a key is in one file."""
    index = spark.read.parquet(f"{path}_index")
    return [r["file"] for r in index.filter(F.lit(value).cast(index.schema["lo"].dataType).between(F.col("lo"), F.col("hi"))).collect()]


def find(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """The rows of one entity of a sorted table; within its file, statistics and Bloom filters skip what can't hold it."""
    whole = spark.read.parquet(path)
    files = files_of(spark, path, value)
    if not files:
        return whole.limit(0)
    return spark.read.schema(whole.schema).parquet(*files).filter(F.col(key) == F.lit(value).cast(whole.schema[key].dataType))


def write_bucketed(df: DataFrame, table: str, path: str, key: str, order: Sequence[str] = (), buckets: int = 64) -> None:
    """A table of ``buckets`` files, each sorted by key and ``order``: grouping and joining by the key need no exchange."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
