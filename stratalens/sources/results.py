"""Results that appear as a whole: a run writes to a staging folder, and one rename makes it the current one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .tables import exists, write_text

#: Runs that stay: the current one, and those before it that readers may still be in.
KEPT = 2
POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _read(spark: SparkSession, path: str) -> dict:
    fs, place = _fs(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename over what is there: readers see the old file or the new one."""
    jvm = spark.sparkContext._jvm
    path, rename = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(source).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(path(source), path(target), how)


def current(spark: SparkSession, out: str) -> str | None:
    """The folder of the last complete run, or None."""
    return f"{out}/{_read(spark, f'{out}/{POINTER}')['runs'][0]}" if exists(spark, f"{out}/{POINTER}") else None


def manifest(spark: SparkSession, out: str) -> dict:
    """What the last complete run wrote: ``tables`` (names of folders and files) and ``runs``."""
    place = current(spark, out)
    return _read(spark, f"{place}/_manifest.json") if place else {"tables": [], "runs": []}


@contextmanager
def run(spark: SparkSession, out: str) -> Iterator[str]:
    """A folder to write a run's tables to. It becomes the current run if all goes well; else it goes, and the last run stays whole.

    Runs of the same ``out`` at the same time don't mix: the one that ends last is the current one.
    """
    name = f"run-{uuid.uuid4().hex}"
    stage = f"{out}/_staging/{name}"
    fs, place = _fs(spark, stage)
    fs.mkdirs(place)
    try:
        yield stage
        tables = sorted(s.getPath().getName() for s in fs.listStatus(place))
        write_text(spark, json.dumps({"run": name, "tables": tables}, indent=2), f"{stage}/_manifest.json")
        fs.rename(place, _fs(spark, f"{out}/{name}")[1])
    except BaseException:
        fs.delete(place, True)
        raise
    before = _read(spark, f"{out}/{POINTER}")["runs"] if exists(spark, f"{out}/{POINTER}") else []
    write_text(spark, json.dumps({"runs": [name, *before[: KEPT - 1]]}), f"{out}/_staging/{name}.json")
    _replace(spark, f"{out}/_staging/{name}.json", f"{out}/{POINTER}")
    for old in before[KEPT - 1 :]:
        fs.delete(_fs(spark, f"{out}/{old}")[1], True)
