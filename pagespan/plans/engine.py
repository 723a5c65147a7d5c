"""The whole dataflow: raw tables or fragments in, logical tables with their audit out."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.config import StitchConfig
from pagespan.operators import classify, rebuild, spans
from pagespan.operators import decide as d
from pagespan.operators import inject as write_back
from pagespan.sources.store import noted, recorded, written

logger = logging.getLogger("pagespan")


class StitchError(RuntimeError):
    """A document set that could not be stitched."""


@dataclass
class Stitched:
    """pairs: every decision. groups: fragment to logical table. tables, rows: the result. Tables know how many rows they have
    without those in which nothing folds; such rows are made when `rows` is first read, and kept."""

    fragments: DataFrame
    fragment_rows: DataFrame
    pairs: DataFrame
    groups: DataFrame
    tables: DataFrame
    plain: DataFrame
    folded: DataFrame
    log: list[dict] = field(default_factory=list)
    kept: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        if self.kept is None:
            with recorded() as log:
                self.kept = written(self.plain, "plain").unionByName(self.folded)
            self.log.extend(log)
            noted("placed", ("plain", "rows"), ("aligned", "rows"), log=self.log)
            noted("rows", ("plain", "rows"), ("folded", "rows"), log=self.log)
        return self.kept

    def rows_once(self) -> DataFrame:
        """rows, for who reads them once: not kept unless they are already."""
        return self.plain.unionByName(self.folded) if self.kept is None else self.kept

    def phases(self) -> DataFrame:
        """step, phase, seconds, rows, extracted, skipped: what each stage wrote, observed while it was written; extracted and
        skipped where a stage reads tables. The rows are a stage, so they are made here if they weren't yet."""
        return phase_table(self.rows.sparkSession, self.log)

    def metrics(self) -> DataFrame:
        """Per document: fragments, logical tables, merged ones, rows."""
        n = F.size("members")
        return self.tables.groupBy("doc_id").agg(F.sum(n).alias("fragments"), F.count(F.lit(1)).alias("logical_tables"), F.count(F.when(n > 1, 1)).alias("merged_tables"), F.sum("n_rows").alias("rows"))


def phase_table(spark: SparkSession, log: list[dict]) -> DataFrame:
    """The entries of sources.store.recorded() as a table."""
    rows = [(i, x["phase"], x["seconds"], x["rows"], x.get("extracted"), x.get("skipped")) for i, x in enumerate(log)]
    return spark.createDataFrame(rows, "step int, phase string, seconds double, rows long, extracted long, skipped long")


def extract_fragments(raw_tables: DataFrame, config: StitchConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(fragments, fragment rows) of raw tables; the configuration isn't validated. raw_tables may have the column span_cells
    (schema.SPAN_CELLS), which tells the table where there is no grid."""
    cfg = config or StitchConfig()
    if "span_cells" in raw_tables.columns:
        gridless = F.col("grid").isNull() & F.col("span_cells").isNotNull()
        read = classify.read_grids(raw_tables.where(~gridless).drop("span_cells")).unionByName(spans.read_spans(raw_tables))
    else:
        read = classify.read_grids(raw_tables)
    return classify.fragments_of(read, cfg), classify.rows_of(read)


@dataclass
class Decisions:
    """of: a row per fragment with its decision and warnings. pairs: those of both passes. repaired, second: repairs looked at, taken."""

    of: DataFrame
    pairs: DataFrame
    repaired: DataFrame
    second: DataFrame

    def groups(self, rows: DataFrame | None = None) -> DataFrame:
        return d.groups(self.of, self.repaired, self.second, None if rows is None else rebuild.sizes(rows), rebuild.beside_rank)


def decisions(fragments: DataFrame, cfg: StitchConfig) -> Decisions:
    made = written(d.decisions(fragments, cfg), "islands", pairs=F.col("left_idx").isNotNull())
    noted("pairs", ("islands", "pairs"))
    told = d.told(made, d.missing_between(made))
    edges = written(d.orphan_edges_of(made, cfg), "edges")
    repaired = written(d.repair(edges), "repaired")
    taken = repaired.where("taken").select("doc_id", "seq", "left_idx", "right_idx")
    second = edges.join(taken, ["doc_id", "left_idx", "right_idx"]).select("doc_id", F.lit(2).alias("pass_no"), "seq", "left_idx", "right_idx", F.lit(True).alias("merged"), "reason", "signals", F.array().cast("array<string>").alias("warnings"))
    second = written(second, "second")
    return Decisions(told, d.pairs_of(told).unionByName(second), repaired, second)


def decide(fragments: DataFrame, cfg: StitchConfig) -> tuple[DataFrame, DataFrame]:
    """(pairs of both passes, groups)."""
    made = decisions(fragments, cfg)
    return made.pairs, d.numbered(made.groups()).select("doc_id", "idx", "logical_index", "rank")


def merge_fragments(fragments: DataFrame, rows: DataFrame, config: StitchConfig | None = None) -> Stitched:
    """Groups fragments and rebuilds their tables. Only the overflow policy is validated."""
    cfg = config or StitchConfig()
    if found := cfg.policy_problems():
        raise ValueError("; ".join(found))
    with recorded() as log:
        out = _merged(fragments, rows, cfg)
    out.log = log
    log_line = ", ".join(f"{x['phase']} {x['rows']} rows in {x['seconds']} s" for x in log)
    logger.info("merged: %s", log_line)
    return out


def _merged(fragments: DataFrame, rows: DataFrame, cfg: StitchConfig) -> Stitched:
    rows = written(rows, "fragment rows")
    made = decisions(fragments, cfg)  # reads the fragments once and keeps all that is needed of them
    noted("fragments", ("islands", "rows"))
    member = written(d.numbered(rebuild.plan(made.groups(rows), cfg)), "groups")
    if cfg.width_overflow_policy == "fail":
        wide = rebuild.overflowing(member).select("doc_id", "idx", "start_page", "width", "base_width", "columns").head(1)
        if wide:
            w = wide[0]
            raise ValueError(f"{w.doc_id}: table {w.idx} (page {w.start_page}) has {w.width} columns where {w.base_width} fit; too many: {', '.join(w.columns[w.base_width :])}")
    tables, plain, folded = rebuild.rebuild(member, rows, cfg)
    return Stitched(fragments, rows, made.pairs, member.select("doc_id", "idx", "logical_index", "rank"), tables, plain, folded)


@runtime_checkable
class Adapter(Protocol):
    """What a parser's plug-in has; isinstance() tells whether an object has both methods."""

    def extract(self, documents: Any, config: StitchConfig) -> DataFrame | tuple[DataFrame, DataFrame]:
        """The documents' tables as RAW_TABLES, or as (fragments, rows)."""
        ...

    def inject(self, documents: Any, stitched: Stitched) -> Any:
        """The documents with the stitched tables; tables of one member are in it too."""
        ...


class Stitcher:
    """adapter: an Adapter. Or by functions: extract, from the caller's documents to RAW_TABLES (or to (fragments, rows)), and
    inject, from (documents, Stitched) to the caller's result, either of which may be left out."""

    def __init__(self, config: StitchConfig | None = None, extract: Callable | None = None, inject: Callable | None = None, adapter: Adapter | None = None):
        self.config = (config or StitchConfig()).validate()
        if adapter is not None:
            if not isinstance(adapter, Adapter):
                raise TypeError(f"{type(adapter).__name__} is no adapter: it needs the methods extract and inject")
            if extract or inject:
                raise TypeError("give an adapter or functions, not both")
            extract, inject = (lambda documents: adapter.extract(documents, self.config)), adapter.inject
        self.extract, self.inject = extract, inject

    def stitch(self, documents, raise_on_error: bool = False):
        """The injected documents, or the Stitched without `inject`. On failure, or if no logical table spans two pages, the
        documents come back as they were; with raise_on_error a failure raises StitchError."""
        if documents is None:
            if raise_on_error:
                raise StitchError("no documents")
            return documents
        try:
            got = self.extract(documents) if self.extract else documents
            fragments, rows = got if isinstance(got, tuple) else extract_fragments(got, self.config)
            out = merge_fragments(fragments, rows, self.config)
            if self.inject is None:
                out.rows  # noqa: B018  a failure of theirs is one of the stitching
                return out
            if not out.tables.where("size(pages) > 1").head(1):
                logger.info("no logical table spans more than one page")
                return documents
            return self.inject(documents, out)
        except Exception as e:
            if raise_on_error:
                raise StitchError(str(e)) from e
            logger.warning("stitching failed, documents are left as they were: %s", e)
            return documents


def stitch_documents(raw_tables: DataFrame, config: StitchConfig | None = None, raise_on_error: bool = False):
    """RAW_TABLES in, Stitched out; with an invalid configuration or a failure the input comes back unless raise_on_error."""
    try:
        stitcher = Stitcher(config)
    except ValueError:
        if raise_on_error:
            raise
        logger.warning("invalid configuration, documents are left as they were")
        return raw_tables
    return stitcher.stitch(raw_tables, raise_on_error)


def stitch_snapshots(docs: DataFrame, config: StitchConfig | None = None) -> dict[str, DataFrame]:
    """Snapshots in (sources.snapshot); out the documents after stitching, their cells, provenance and reading order, errors
    (tables and documents that couldn't be read), coverage (how many of a document's tables were) and phases (rows and seconds of
    each stage, observed while they were written)."""
    from pagespan.operators import document
    from pagespan.sources import snapshot

    with recorded() as log:
        docs = written(docs, "documents", extracted=F.col("readable"), skipped=~F.col("readable"))
        read = written(snapshot.described(docs).select("doc_id", "idx", "error"), "tables read", extracted=F.col("error").isNull(), skipped=F.col("error").isNotNull())
    fragments, rows = extract_fragments(snapshot.raw_tables(docs), (config or StitchConfig()).validate())
    out = merge_fragments(fragments, rows, config)
    back = write_back.inject(snapshot.cells(docs), snapshot.provenance(docs), snapshot.body_order(docs), out.tables, out.rows)
    whole = {"documents": document.stitched_documents(docs, out.tables, out.rows)}
    bad = snapshot.extract_errors(docs, read)
    return whole | back | {"errors": bad, "coverage": snapshot.coverage(docs, bad), "phases": phase_table(docs.sparkSession, log + out.log)}
