"""Write-back: the documents' tables after stitching, as new tables. Inputs stay as they are, so nothing has to be undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagespan.operators.rebuild import KEY
from pagespan.sources.store import written


def touched(tables: DataFrame) -> DataFrame:
    """doc_id, idx, logical_index, place, anchor: fragments of logical tables with more than one member."""
    t = tables.where("size(members) > 1")
    return t.select("doc_id", "logical_index", F.col("members")[0].alias("anchor"), F.posexplode("members").alias("place", "idx"))


def passthrough(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """cells (doc_id, idx, ...) of tables that nothing was merged into: unchanged."""
    return cells.join(touched(tables).select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")


def anchor_cells(cells: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, idx, row_pos, col_pos, text, row_span, col_span, column_header, row_header of every rebuilt anchor table.

    cells: the original grid in the same columns. Leading rows with a column_header cell are used again as they are, unless
    the table has no rows; without any, the column names make one header row. Data cells are 1 x 1; column 0 is a row header if it was one before.

    The grid moves once: windows of one order tell its header rows, and those are kept. All sides meet sorted: cells are many times
    what Spark guesses of the arrays that they come of, and a side that it broadcast by that guess was more than the driver holds.
    """
    t = tables.where("size(members) > 1").select("doc_id", F.col("members")[0].alias("idx"), "logical_index", (F.col("n_rows") > 0).alias("some"))
    own = cells.join(t.where("some").select("doc_id", "idx").hint("merge"), ["doc_id", "idx"])
    by = Window.partitionBy("doc_id", "idx").orderBy("row_pos")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumns({"is_head": F.max(F.coalesce("column_header", F.lit(False))).over(by.rangeBetween(0, 0)), "nth": F.dense_rank().over(by), "first": F.row_number().over(by) == 1})
    own = own.withColumn("lead", F.min("is_head").over(by))
    own = own.withColumns({"depth": F.max(F.when(F.col("lead"), F.col("nth"))).over(whole), "last_side": F.max(F.when((F.col("col_pos") == 0) & F.col("row_header"), F.col("row_pos"))).over(whole)})
    own = written(own.where("lead or first").drop("is_head", "nth"), "old heads")
    heads = own.where("lead").select("doc_id", "idx", "row_pos", "col_pos", "text", "row_span", "col_span", F.lit(True).alias("column_header"), "row_header")
    side = F.coalesce(F.col("last_side") >= F.coalesce("depth", F.lit(1)), F.lit(False))
    t = t.drop("some").join(own.where("first").select("doc_id", "idx", "depth", side.alias("side")).hint("merge"), ["doc_id", "idx"], "left")
    names = tables.select(*KEY, F.when(F.size("columns") > 0, F.col("columns")).otherwise(F.array(F.lit("Column_0"))).alias("columns"))
    flat = t.where("depth is null").join(names.hint("merge"), KEY).select("doc_id", "idx", F.lit(0).alias("row_pos"), F.posexplode("columns").alias("col_pos", "text"))
    flat = flat.select("*", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(True).alias("column_header"), F.lit(False).alias("row_header"))
    data = t.hint("merge").join(rows, KEY).select("doc_id", "idx", (F.coalesce("depth", F.lit(1)) + F.col("row_pos")).alias("row_pos"), F.coalesce("side", F.lit(False)).alias("side"), F.posexplode("cells").alias("col_pos", "text"))
    data = data.select("doc_id", "idx", "row_pos", "col_pos", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(False).alias("column_header"), ((F.col("col_pos") == 0) & F.col("side")).alias("row_header"))
    return heads.unionByName(flat).unionByName(data)


def merged_provenance(prov: DataFrame, tables: DataFrame) -> DataFrame:
    """prov (doc_id, idx, prov array): satellites' entries follow the anchor's, in member order; satellites have none."""
    t = touched(tables)
    got = prov.join(t, ["doc_id", "idx"]).groupBy("doc_id", F.col("anchor").alias("idx")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "prov"))), lambda x: x["prov"])).alias("all"))
    mark = t.select("doc_id", "idx", (F.col("place") > 0).alias("satellite"))
    out = prov.join(mark, ["doc_id", "idx"], "left").join(got, ["doc_id", "idx"], "left")
    return out.select("doc_id", "idx", F.when(F.coalesce("satellite", F.lit(False)), F.slice("prov", 1, 0)).otherwise(F.coalesce("all", "prov")).alias("prov"), F.coalesce("satellite", F.lit(False)).alias("cleared"))


def cleared_tables(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """cells of satellites are gone: what stays of the original grids."""
    return cells.join(touched(tables).where("place > 0").select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")


def pruned_order(order: DataFrame, tables: DataFrame) -> DataFrame:
    """The reading order without references to satellites."""
    gone = touched(tables).where("place > 0").select("doc_id", F.lit("tables").alias("kind"), F.col("idx").alias("item"))
    return order.join(gone, ["doc_id", "kind", "item"], "left_anti")


def inject(cells: DataFrame, prov: DataFrame, order: DataFrame, tables: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """cells, prov and order of all documents after stitching."""
    kept = passthrough(cells, tables)
    return {"cells": kept.unionByName(anchor_cells(cells, tables, rows)), "prov": merged_provenance(prov, tables), "order": pruned_order(order, tables)}
