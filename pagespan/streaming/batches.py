"""Documents as a stream: each micro-batch holds complete documents and is stitched on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagespan.config import StitchConfig
from pagespan.plans.engine import extract_fragments, merge_fragments


def stitch_stream(raw_tables: DataFrame, out_dir: str, checkpoint: str, config: StitchConfig | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Writes tables and rows below out_dir, a folder per batch, so a batch that runs again replaces itself."""
    cfg = (config or StitchConfig()).validate()

    def one(batch: DataFrame, number: int) -> None:
        done = merge_fragments(*extract_fragments(batch, cfg), cfg)
        done.tables.write.mode("overwrite").parquet(f"{out_dir}/tables/batch={number}")
        done.rows.write.mode("overwrite").parquet(f"{out_dir}/rows/batch={number}")

    return raw_tables.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
