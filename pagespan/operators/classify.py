"""Raw tables to classified fragments and their rows: one projection, no exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespan.config import StitchConfig
from pagespan.functions import shapes, text

PAGE_HEIGHT = 842.0


def page_height(prov: Column, heights: Column) -> Column:
    """The height of the first page of the provenance that has one; A4 without any."""
    known = F.filter(F.transform(prov, lambda p: F.get(F.map_values(F.map_filter(heights, lambda k, v: k == p["page_no"])), F.lit(0))), lambda h: F.coalesce(h != 0, F.lit(False)))
    return F.coalesce(F.get(known, F.lit(0)), F.lit(PAGE_HEIGHT))


def vertical_bounds(prov: Column, heights: Column) -> Column:
    """struct(center, top, bottom), 0 at the page's top and 1 at its end; null without a box."""
    box = F.get(F.filter(F.transform(prov, lambda p: p["bbox"]), lambda b: b["t"].isNotNull() & b["b"].isNotNull()), F.lit(0))
    known = page_height(prov, heights)
    upwards = F.coalesce(F.upper(box["coord_origin"]).contains("BOTTOMLEFT"), F.lit(True))
    h = F.when(upwards & (box["t"] > known), F.greatest(box["t"] * 1.1, known)).otherwise(known)
    at = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(upwards, 1 - y / h).otherwise(y / h)))
    return F.when(box.isNotNull(), F.struct(((at(box["t"]) + at(box["b"])) / 2).alias("center"), at(box["t"]).alias("top"), at(box["b"]).alias("bottom")))


def grid_rows(grid: Column) -> Column:
    """The rows of a grid that aren't blank; null cells are empty."""
    cells = F.transform(grid, lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))
    return F.filter(cells, lambda r: F.size(shapes.filled(r)) > 0)


def read_grids(tables: DataFrame) -> DataFrame:
    """Adds columns, is_headerless, data (array of rows, cut or padded to the columns) and continuation_content."""
    t = tables.withColumn("real", grid_rows(F.coalesce("grid", F.array().cast("array<array<string>>"))))
    some = F.size("real") > 0
    width = F.when(some, F.size(F.get("real", F.lit(0)))).otherwise(F.coalesce(F.size(F.get("grid", F.lit(0))), F.lit(0)))
    width = F.greatest(width, F.lit(0))
    t = t.withColumn("n_cols", width).withColumn("is_headerless", some & shapes.is_data_row(F.col("real")))
    t = t.withColumn("spill_row", F.col("is_headerless") & shapes.is_sparse(F.col("real")) & (F.size("real") > 1))
    auto = F.when(F.col("n_cols") > 0, F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.concat(F.lit("Column_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.get("real", F.lit(0)), lambda h, i: text.clean_grid_header(h, i))
    t = t.withColumn("columns", F.when(some & ~F.col("is_headerless"), named).otherwise(auto))
    rest = F.slice("real", 2, F.greatest(F.size("real") - 1, F.lit(0)))
    data = F.when(F.col("is_headerless") & ~F.col("spill_row"), F.col("real")).otherwise(rest)
    fit = F.transform(data, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.col("n_cols") - F.size(r), F.lit(0)))), 1, F.col("n_cols")))
    t = t.withColumn("data", F.when(some, fit).otherwise(F.array().cast("array<array<string>>")))
    items = F.filter(F.transform(F.get("real", F.lit(0)), lambda c, i: F.struct(i.cast("int").alias("col_idx"), c.alias("value"))), lambda x: ~text.is_empty(x["value"]))
    none = F.array().cast("array<struct<col_idx:int,value:string>>")
    return t.withColumn("continuation_content", F.when(F.col("spill_row"), items).otherwise(none)).drop("real", "n_cols", "spill_row")


def fragments_of(read: DataFrame, cfg: StitchConfig) -> DataFrame:
    """The fragment record of every table that read_grids() gave."""
    first = F.concat_ws(" ", F.get("data", F.lit(0)))
    has_rows = F.size("data") > 0
    prov = F.coalesce("prov", F.array().cast("array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>"))
    heights = F.coalesce("heights", F.create_map().cast("map<int,double>"))
    t = read.withColumn("pages", F.array_sort(F.array_distinct(F.filter(F.transform(prov, lambda p: p["page_no"]), lambda x: x.isNotNull()))))
    t = t.withColumn("v", vertical_bounds(prov, heights) if cfg.use_layout_hint else F.lit(None).cast("struct<center:double,top:double,bottom:double>"))
    return t.select(
        "doc_id", "idx", F.col("idx").alias("pos"), F.get("pages", F.lit(0)).alias("start_page"), "pages", F.size("columns").alias("width"), "columns",
        text.tokens(F.concat_ws(" ", "columns")).alias("header_tokens"), F.when(has_rows, text.tokens(first)).otherwise(F.array().cast("array<string>")).alias("first_row_tokens"),
        F.col("v.center").alias("vert_center"), F.col("v.top").alias("vert_top"), F.col("v.bottom").alias("vert_bottom"), "is_headerless",
        shapes.is_header_orphan(F.col("columns"), F.col("is_headerless"), F.col("data"), cfg.max_orphan_rows).alias("is_header_orphan"),
        (has_rows & (F.size("data") <= cfg.max_data_orphan_rows) & text.has_digit(first)).alias("is_data_orphan"),
        text.numeric_like_names(F.col("columns")).alias("numeric_like_cols"), F.size("data").alias("row_count"), "continuation_content", "content_before",
        F.get(F.get("data", F.lit(0)), F.lit(0)).alias("first_cell"),
    )


def rows_of(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "idx", F.posexplode("data").alias("row_pos", "cells"))
