"""Documents that arrive page by page: a session of event time holds a document's pages until it closes, then it is stitched.

The state is Spark's own session aggregation: a session of a document stays open while its pages come within `gap` of each other,
in whatever order, and closes, leaves the state and is emitted once the watermark is past it. So state is bounded by the documents
that are open, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagespan.config import StitchConfig
from pagespan.plans.engine import extract_fragments, merge_fragments
from pagespan.schema import PROV
from pagespan.sources.store import written

#: A page's tables: RAW_TABLES, with the page, how many the document has (null: unknown) and when the page was read. A page without
#: tables is one row whose idx is null.
PAGES = f"doc_id string, page int, n_pages int, at timestamp, idx int, grid array<array<string>>, prov {PROV}, heights map<int,double>, content_before boolean"
_RAW = ["doc_id", "idx", "grid", "prov", "heights", "content_before"]


def closed_documents(pages: DataFrame, gap: str, delay: str) -> DataFrame:
    """A stream of PAGES -> doc_id, opened, n_pages, parts: the rows of each session that has closed."""
    part = F.struct("page", *_RAW[1:])
    return pages.withWatermark("at", delay).groupBy("doc_id", F.session_window("at", gap).alias("session")).agg(F.max("n_pages").alias("n_pages"), F.collect_list(part).alias("parts")).select("doc_id", F.col("session.start").alias("opened"), "n_pages", "parts")


def missing_pages(closed: DataFrame) -> DataFrame:
    """doc_id, opened, error: documents that closed without some of their pages. They are stitched all the same, as page numbers keep
    what isn't neighbouring apart."""
    had = F.array_distinct(F.transform("parts", lambda p: p["page"]))
    lack = F.when(F.col("n_pages") > 0, F.array_except(F.sequence(F.lit(1), F.col("n_pages")), had))
    said = F.concat(F.lit("closed without page "), F.array_join(lack.cast("array<string>"), ", "))
    return closed.where(F.size(lack) > 0).select("doc_id", "opened", said.alias("error"))


def stitch_pages(pages: DataFrame, out_dir: str, checkpoint: str, config: StitchConfig | None = None, gap: str = "10 minutes", delay: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Writes tables, rows and errors of documents as they close below out_dir, a folder per batch, so a batch that runs again
    replaces itself. A page that comes twice counts once. One that comes when its document has closed opens it anew: its results
    are a document of the same doc_id with a later `opened`, and its other pages are among the errors."""
    cfg = (config or StitchConfig()).validate()

    def one(batch: DataFrame, number: int) -> None:
        # a document may close twice in one batch, so its session is part of its name until it is written
        name = F.concat("doc_id", F.lit("\x00"), F.col("opened").cast("string"))
        closed = written(batch.withColumn("doc_id", name), "closed")
        raw = closed.select("doc_id", F.inline("parts")).where("idx is not null").dropDuplicates(["doc_id", "idx"]).select(*_RAW)
        done = merge_fragments(*extract_fragments(raw, cfg), cfg)

        def shown(df: DataFrame) -> DataFrame:
            own = F.split("doc_id", "\x00")
            return df.withColumns({"doc_id": own[0], "opened": own[1].cast("timestamp")})

        for what, df in (("tables", done.tables), ("rows", done.rows), ("errors", missing_pages(closed).drop("opened"))):
            shown(df).write.mode("overwrite").parquet(f"{out_dir}/{what}/batch={number}")

    return closed_documents(pages, gap, delay).writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
