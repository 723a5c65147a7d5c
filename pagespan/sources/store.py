"""Intermediate tables in the folder that all executors share.

Decisions are read by several later joins; as written tables they are computed
once, and losing an executor costs only the tasks that ran on it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, SparkSession] = {}
_temporary: dict[str, str] = {}
_record: ContextVar[list[dict] | None] = ContextVar("record", default=None)


@contextlib.contextmanager
def recorded() -> Iterator[list[dict]]:
    """What written() does inside goes into the list: phase, seconds, rows, and the other counts that a phase is given. They are
    observed while the tables are written, so nothing is read again for them."""
    log: list[dict] = []
    outer, token = _record.get(), _record.set(log)
    try:
        yield log
    finally:
        _record.reset(token)
        if outer is not None:
            outer.extend(log)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the master is local (tests), a temporary folder of this session. On a cluster
    a machine's own folder would lose rows, so there it must be set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _temporary:
            _temporary[app] = "file://" + tempfile.mkdtemp(prefix="pagespan-")
        at = _temporary[app]
    return at.rstrip("/")


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _sweep() -> None:
    for at, spark in _folders.items():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            delete(spark, at)


def noted(phase: str, *parts: tuple[str, str], log: list[dict] | None = None) -> None:
    """A phase that tables written last did between them: its rows are the named counts of theirs (phase, count), its seconds those
    of all of them. Goes into log, if given; else nothing outside of recorded()."""
    log = _record.get() if log is None else log
    if log is not None:
        of = [next(x for x in reversed(log) if x["phase"] == name) for name, _ in parts]
        log.append({"phase": phase, "seconds": round(sum(x["seconds"] for x in of), 3), "rows": sum(x[count] for x, (_, count) in zip(of, parts, strict=True))})


#: Spark removes the shuffles of a query when it ends.
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: else those of all steps stay together until the driver collects its garbage."""
    own = spark.conf.get(_FREES, None)
    spark.conf.set(_FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREES) if own is None else spark.conf.set(_FREES, own)


def written(df: DataFrame, name: str, compression: str = "snappy", **counts: Column) -> DataFrame:
    """df as a table in the shared folder, read back. The tables of an application go when its driver ends. counts: conditions
    whose rows recorded() counts, too."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/pagespan/{spark.sparkContext.applicationId}"
    if not _folders:
        atexit.register(_sweep)
    _folders.setdefault(top, spark)
    at = f"{top}/{uuid.uuid4().hex}/{name}"
    log, seen, began = _record.get(), Observation(), time.monotonic()
    source = df if log is None else df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()])
    with _freed(spark):
        source.write.option("compression", compression).parquet(at)
    if log is not None:
        log.append({"phase": name, "seconds": round(time.monotonic() - began, 3)} | {k: int(v) for k, v in seen.get.items()})
    out = spark.read.schema(df.schema).parquet(at)
    out._pagespan_at = at
    return out


def document_id(spark: SparkSession, file: Column, path: str) -> Column:
    """The part of a file's path that lies below the fixed part of `path` (a file, a folder or a pattern): the same whatever else
    is read with it, and different for files of one name in different folders. Of a single file its name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath()
    fixed = min([at.find(c) for c in "*?[{" if c in at], default=None)
    depth = at.rstrip("/").count("/") + 1 if fixed is None else at[:fixed].count("/")
    parts = F.split(F.regexp_replace(file, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    below = F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0))), "/")
    return F.when(below == "", F.element_at(parts, -1)).otherwise(below)
