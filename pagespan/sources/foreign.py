"""Other parsers: a function from one document's bytes to raw table rows, run by partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.schema import RAW_TABLES
from pagespan.sources.snapshot import counted
from pagespan.sources.store import document_id, written

_PARSED = RAW_TABLES + ", error string"


def from_parser(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterable[dict]]) -> tuple[DataFrame, DataFrame]:
    """(RAW_TABLES, errors) of the files at `path`, each named by its path below the fixed part of it. parse(name, content) yields dicts with idx, grid, prov, heights,
    content_before.

    A table for which it yields {"idx": i, "error": text} is missing and its number stays free, so nothing is merged across it.
    A document whose parse raises keeps the tables it gave before that. Both are rows of errors: doc_id, idx (null for the
    document itself), error. Parsing runs once, into a table.
    """

    def run(batches):
        import pandas as pd

        names = ["doc_id", "idx", "grid", "prov", "heights", "content_before", "error"]
        for pdf in batches:
            rows = []
            for doc, data in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    for r in parse(doc, bytes(data)):
                        rows.append({"doc_id": doc, **r})
                except Exception as why:  # any parser's own
                    rows.append({"doc_id": doc, "error": f"{type(why).__name__}: {why}"})
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    files = spark.read.format("binaryFile").load(path).select(document_id(spark, F.col("path"), path).alias("doc_id"), "content")
    got = written(files.mapInPandas(run, _PARSED), "parsed", extracted=F.col("error").isNull(), skipped=F.col("error").isNotNull())
    return got.where("error is null").drop("error"), got.where("error is not null").select("doc_id", "idx", "error")


def coverage(raw: DataFrame, errors: DataFrame) -> DataFrame:
    """doc_id, extracted, found, skipped, message of what from_parser() gave; a document whose parse raised before its first table
    has none."""
    every = raw.select("doc_id", "idx").unionByName(errors.select("doc_id", "idx"))
    return counted(every.groupBy("doc_id").agg(F.count("idx").cast("int").alias("found")), errors)
