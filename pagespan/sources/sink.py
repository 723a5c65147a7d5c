"""Atomic sink: several tables that appear together or not at all.

Each run writes below a folder of its own by Spark's committer, so a task that is tried again leaves no doubles. The run becomes
visible by one rename of a small file on the driver, after all of its tables are complete; a run that fails before is deleted,
and readers go on seeing the run before it.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

CURRENT = "_current.json"


def _path(spark: SparkSession, at: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, at: str, text: str) -> None:
    """Writes a file beside `at` and renames it over that in one step."""
    jvm = spark._jvm
    side, fs = _path(spark, f"{at}.{uuid.uuid4().hex}")
    out = fs.create(side, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(side).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(side), fs.makeQualified(_path(spark, at)[0]), over)


def current(spark: SparkSession, path: str) -> dict | None:
    """What the last complete run wrote: its folder and tables. None before the first."""
    at, fs = _path(spark, f"{path}/{CURRENT}")
    if not fs.exists(at):
        return None
    source = fs.open(at)
    try:
        return json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()


def publish(tables: Mapping[str, DataFrame], path: str) -> str:
    """Writes the tables as one run and makes it the current one. Returns the run's folder; on failure nothing of it stays."""
    spark = next(iter(tables.values())).sparkSession
    run = f"{path.rstrip('/')}/runs/{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{run}/{name}")
        _put(spark, f"{path.rstrip('/')}/{CURRENT}", json.dumps({"run": run, "tables": {n: df.schema.jsonValue() for n, df in tables.items()}}))
    except BaseException:
        with contextlib.suppress(Exception):
            at, fs = _path(spark, run)
            fs.delete(at, True)
        raise
    return run


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current run; none before the first."""
    from pyspark.sql.types import StructType

    now = current(spark, path)
    return {} if now is None else {n: spark.read.schema(StructType.fromJson(s)).parquet(f"{now['run']}/{n}") for n, s in now["tables"].items()}


def sweep(spark: SparkSession, path: str) -> int:
    """Deletes runs that aren't the current one, left by drivers that died or replaced since; returns their number. Not while
    another driver publishes or reads an older run."""
    now = current(spark, path)
    top, fs = _path(spark, f"{path.rstrip('/')}/runs")
    if not fs.exists(top):
        return 0
    old = [s.getPath() for s in fs.listStatus(top) if now is None or s.getPath().getName() != now["run"].rsplit("/", 1)[1]]
    for at in old:
        fs.delete(at, True)
    return len(old)
