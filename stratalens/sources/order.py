"""The order of rows in files: what a file system keeps, and a distributed read loses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def file_order() -> Column:
    """A value that sorts as rows do in their files, these by path: for a DataFrame straight from files.

    A task reads a block of a file from its beginning to its end, so path, block and the place in the task tell the order.
    """
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def with_row_numbers(df: DataFrame, name: str) -> DataFrame:
    """``df`` (straight from files) with the number of each row over all files, from 0, as column ``name``.

    Blocks are counted first (a row for each), and what stands before a block is added to the places in it: one row moves for each block.
    """
    placed = df.select("*", file_order().alias("_at"))
    blocks = placed.groupBy("_at.path", "_at.block").agg(F.count("*").alias("rows"), F.min("_at.place").alias("first"))
    before = F.sum("rows").over(W.orderBy("path", "block")) - F.col("rows")  # as many rows as blocks
    starts = blocks.select("path", "block", (before - F.col("first")).alias("_shift"))
    joined = placed.join(F.broadcast(starts), (F.col("_at.path") == F.col("path")) & (F.col("_at.block") == F.col("block")))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_at.place") + F.col("_shift")).alias(name))
