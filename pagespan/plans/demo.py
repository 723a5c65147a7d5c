"""Fragments derived from the relational test tables, so that every rule has cases: a customer is a document, four of its
orders are a page. The same SELECTs run in Spark and DuckDB; the list constructor is the only difference."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.functions import text

#: c: customer, p: page from 0, i: row on the page, k: order, w: width, v: header variant
ROWS_SQL = """
SELECT c, k, s, pr, y, p, i,
  CASE WHEN c % 10 = 3 AND p = 1 THEN 1 WHEN c % 10 = 6 AND p >= 1 THEN 5 WHEN c % 10 = 9 AND p = 2 THEN 10 ELSE 4 END AS w
FROM (SELECT *, CAST(floor(rn / 4.0) AS INT) AS p, CAST(rn % 4 AS INT) AS i FROM (
  SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS pr, CAST(year(o_orderdate) AS INT) AS y,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS rn FROM orders) a) b
"""

FRAGMENTS_SQL = f"""
SELECT c, p, w, CAST(count(*) AS INT) AS n_rows,
  CAST(p + CASE WHEN c % 11 = 0 AND p >= 2 THEN 1 ELSE 0 END AS INT) AS idx,
  CAST(CASE WHEN c % 13 = 0 AND p = 1 THEN NULL WHEN c % 17 = 0 AND p >= 1 THEN p WHEN c % 7 = 0 AND p >= 2 THEN p + 3 ELSE p + 1 END AS INT) AS page,
  (p >= 1 AND c % 3 = 0) AS headerless,
  CAST(CASE WHEN p = 0 THEN 0 ELSE (c + p) % 5 END AS INT) AS v,
  CAST(CASE WHEN c % 19 = 0 THEN NULL WHEN (c + p) % 4 = 0 THEN 0.5 ELSE 0.1 END AS DOUBLE) AS top,
  CAST(CASE WHEN c % 19 = 1 THEN NULL WHEN (c + p) % 5 = 1 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS bottom,
  CASE WHEN c % 29 = 0 THEN NULL WHEN c % 23 = 0 AND p = 1 THEN true ELSE false END AS content_before,
  (c % 31 IN (0, 5) AND p = 0) OR (c % 37 = 0 AND p = 1 AND c % 3 <> 0) AS header_orphan,
  (c % 31 = 0 AND p >= 1) OR (c % 37 = 0 AND p = 2) AS data_orphan,
  (c % 8 = 0 AND p >= 1) AS has_cont
FROM ({ROWS_SQL}) r GROUP BY c, p, w
"""

#: Column names by variant; the later positions are extras.
NAMES = {
    0: ("order key", "order status", "order priority", "order year"),
    1: ("order key", "ship mode", "carrier name", "year"),
    2: ("alpha", "beta", "gamma", "delta.Delta"),
    3: ("order key", "order status", "order priority", "order total"),
    4: ("order key", "order status", "order priority", "order year"),
}


def cell_sql(j: int) -> str:
    """The text at position j of a row; some rows hold one overflowing cell only."""
    if j == 0:
        own = "CAST(k AS VARCHAR(20))"
    elif j < 4:
        own = ("s", "pr", "CAST(y AS VARCHAR(8))")[j - 1]
    else:
        own = f"'x{j}'"
    if j == 1:
        tail = "CASE WHEN c % 25 = 0 THEN concat('http://a/', CAST(k AS VARCHAR(20))) ELSE ' tail ' END"
    else:
        tail = "''"
    return f"CASE WHEN c % 5 = 0 AND i = 3 AND w > 1 THEN {tail} ELSE {own} END"


def name_sql(j: int) -> str:
    if j >= 4:
        return f"CASE WHEN headerless THEN 'Column_{j}' ELSE 'extra {j}' END"
    by = " ".join(f"WHEN v = {v} THEN '{n[j]}'" for v, n in NAMES.items())
    return f"CASE WHEN headerless THEN 'Column_{j}' {by} END"


def _orders(spark: SparkSession, sf_dir: str) -> None:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")


def _cells_sql() -> str:
    cells = ", ".join(cell_sql(j).replace("VARCHAR(20)", "STRING").replace("VARCHAR(8)", "STRING") for j in range(10))
    return f"slice(array({cells}), 1, w)"


def demo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _orders(spark, sf_dir)
    return spark.sql(f"SELECT concat('c', c) AS doc_id, p, i AS row_pos, {_cells_sql()} AS cells, CAST(p + CASE WHEN c % 11 = 0 AND p >= 2 THEN 1 ELSE 0 END AS INT) AS idx FROM ({ROWS_SQL}) r").select("doc_id", "idx", "row_pos", "cells")


def _fragments(spark: SparkSession, sf_dir: str, more: str) -> DataFrame:
    """FRAGMENTS_SQL with column names and `more` of the fragment's first row: one pass over the orders, which are dealt by customer
    and sorted once. A page's rows follow each other, so its first row stands for the group and windows tell the rest. The windows
    are over the document: Spark deals anew by another name for it, and what follows by document needn't be dealt again."""
    _orders(spark, sf_dir)
    count = "count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n_orders"
    after = [f"lead(named_struct('k', k, 's', o_orderstatus, 'pr', o_orderpriority, 'y', CAST(year(o_orderdate) AS INT)), {n}) OVER (PARTITION BY doc_id ORDER BY k) AS next{n}" for n in (1, 2, 3)]
    rows = ROWS_SQL.replace("PARTITION BY o_custkey ORDER BY o_orderkey", "PARTITION BY doc_id ORDER BY k").replace("SELECT o_custkey AS c, o_orderkey AS k,", "SELECT doc_id, c, k,")
    rows = rows.replace("FROM orders", f", {', '.join([count, *after])} FROM (SELECT *, concat('c', o_custkey) AS doc_id, o_custkey AS c, o_orderkey AS k FROM orders) orders").replace("  CASE WHEN c % 10 = 3", "  doc_id, n_orders, next1, next2, next3, CASE WHEN c % 10 = 3")
    names = ", ".join(name_sql(j) for j in range(10))
    first = f"FROM (SELECT *, CAST(least(4, n_orders - 4 * p) AS INT) AS n_rows, {more} FROM ({rows}) r) r WHERE i = 0"
    kept = more.rsplit(" ", 1)[1]
    own = FRAGMENTS_SQL.replace(f"FROM ({ROWS_SQL}) r GROUP BY c, p, w", first, 1).replace("CAST(count(*) AS INT) AS n_rows,", f"doc_id, n_rows, {kept},", 1)
    return spark.sql(f"SELECT f.*, slice(array({names}), 1, w) AS columns FROM ({own}) f")


def demo_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fragments(spark, sf_dir, f"{_cells_sql()} AS cells")
    item = lambda i, v: F.struct(F.lit(i).alias("col_idx"), F.lit(v).alias("value"))
    return f.select(
        "doc_id", "idx", F.col("p").alias("pos"), F.col("page").alias("start_page"), F.when(F.col("page").isNull(), F.array().cast("array<int>")).otherwise(F.array("page")).alias("pages"), F.col("w").alias("width"), "columns",
        text.tokens(F.concat_ws(" ", "columns")).alias("header_tokens"), text.tokens(F.concat_ws(" ", "cells")).alias("first_row_tokens"), ((F.col("top") + F.col("bottom")) / 2).alias("vert_center"),
        F.col("top").alias("vert_top"), F.col("bottom").alias("vert_bottom"), F.col("headerless").alias("is_headerless"), F.col("header_orphan").alias("is_header_orphan"), F.col("data_orphan").alias("is_data_orphan"),
        text.numeric_like_names(F.col("columns")).alias("numeric_like_cols"), F.col("n_rows").alias("row_count"),
        F.when(F.col("has_cont"), F.array(item(0, "cont"), item(2, "more"))).otherwise(F.array().cast("array<struct<col_idx:int,value:string>>")).alias("continuation_content"), "content_before", F.get("cells", F.lit(0)).alias("first_cell"),
    )


def demo_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables: the header row (if any) and the rows, with blank rows and boxes from the fragments."""
    after = [re.sub(r"\bi\b", str(n), re.sub(r"\b(k|s|pr|y)\b", rf"next{n}.\1", _cells_sql())) for n in (1, 2, 3)]
    f = _fragments(spark, sf_dir, f"array({', '.join([_cells_sql(), *after])}) AS data").withColumn("data", F.slice("data", 1, F.col("n_rows")))
    head = F.when(F.col("headerless"), F.array().cast("array<array<string>>")).otherwise(F.array("columns"))
    box = F.struct(F.lit(0.0).alias("l"), ((1 - F.col("top")) * 800).alias("t"), F.lit(1.0).alias("r"), ((1 - F.col("bottom")) * 800).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
    prov = F.when(F.col("page").isNull(), F.array().cast("array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>")).otherwise(F.array(F.struct(F.col("page").alias("page_no"), box.alias("bbox"))))
    blank = F.array(F.array(F.lit(" "), F.lit("")))
    return f.select("doc_id", "idx", F.concat(blank, head, "data").alias("grid"), prov.alias("prov"), F.create_map(F.lit(1), F.lit(800.0), F.lit(2), F.lit(800.0), F.lit(3), F.lit(0.0)).alias("heights"), "content_before")


def demo_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, value: the demo tables as parser snapshots, with fields that the engine doesn't know. Table numbers that aren't there
    hold a malformed table; odd tables stand in a group."""
    g = demo_grids(spark, sf_dir)
    cell = lambda text, i, j: F.struct(
        text.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), i.alias("start_row_offset_idx"), j.alias("start_col_offset_idx"), (i <= 1).alias("column_header"), (j == 0).alias("row_header"), F.concat(F.lit("f"), j.cast("string")).alias("font")
    )
    g = g.withColumn("cells", F.transform("grid", lambda r, i: F.transform(r, lambda c, j: cell(c, i, j))))
    place = lambda p: F.struct(p["page_no"].alias("page_no"), p["bbox"].alias("bbox"), F.array(F.lit(0), F.lit(7)).alias("charspan"))
    data = F.struct(F.size("grid").alias("num_rows"), F.array_max(F.transform("grid", F.size)).alias("num_cols"), F.flatten("cells").alias("table_cells"), F.col("cells").alias("grid"))
    pointer = lambda i: F.concat(F.lit("#/tables/"), i.cast("string"))
    table = F.to_json(F.struct(pointer(F.col("idx")).alias("self_ref"), F.concat(F.lit("table "), F.col("idx").cast("string")).alias("label"), F.transform("prov", place).alias("prov"), data.alias("data")))
    d = g.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", table))).alias("t"), F.max("idx").alias("last"))
    numbers = F.sequence(F.lit(0), F.col("last"))
    gap = F.lit('{"label": "gap", "data": {"grid": 7}}')
    all_ = F.array_join(F.transform(numbers, lambda i: F.coalesce(F.try_element_at("t", i), gap)), ",")
    refs = lambda odd: F.array_join(F.transform(F.filter(numbers, lambda i: i % 2 == odd), lambda i: F.concat(F.lit('{"cref":"'), pointer(i), F.lit('"}'))), ",")
    text = F.concat(
        F.lit('{"schema_name":"own","origin":{"n":1.5,"list":[1,null,"x"]},"pages":{"1":{"page_no":1,"size":{"height":800}},"2":{"page_no":2,"size":{"height":800}}},"texts":[],"tables":['), all_,
        F.lit('],"groups":[{"self_ref":"#/groups/0","name":"odd","children":['), refs(1), F.lit(']}],"body":{"label":"body","children":[{"cref":"#/groups/0"}'), F.when(F.col("last") >= 0, F.concat(F.lit(","), refs(0))), F.lit("]}}"),
    )
    return d.select("doc_id", text.alias("value"))


def demo_span_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW_TABLES with span_cells and no grid: two header rows with spanning names, a status that spans two rows (the last one beyond
    the table), years that are missing, and a late cell over two columns that stand in its place already."""
    _orders(spark, sf_dir)
    r = spark.sql(f"SELECT concat('c', c) AS doc_id, c, p AS idx, i, CAST(k AS STRING) AS k, s, pr, CAST(y AS STRING) AS y, k % 3 = 0 AS no_year FROM ({ROWS_SQL}) r")
    one = lambda t, row, col, down=1, right=1, head=False: F.struct(t.alias("text"), row.cast("int").alias("row"), F.lit(col).alias("col"), (row + down).cast("int").alias("end_row"), F.lit(col + right).alias("end_col"), F.lit(head).alias("header"))
    at = F.col("i") + 2
    row = F.filter(F.array(one(F.col("k"), at, 0), F.when(F.col("i") % 2 == 0, one(F.col("s"), at, 1, down=2)), one(F.col("pr"), at, 2), F.when(~F.col("no_year"), one(F.col("y"), at, 3))), lambda c: c.isNotNull())
    t = r.groupBy("doc_id", "c", "idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"])).alias("cells"), F.count(F.lit(1)).cast("int").alias("n"))
    zero, first = F.lit(0), F.lit(1)
    head = F.array(one(F.lit("order"), zero, 0, right=2, head=True), one(F.lit("priority"), zero, 2, down=2, head=True), one(F.lit("key"), first, 0, head=True), one(F.lit("status"), first, 1, head=True), one(F.lit("year"), first, 3, head=True))
    late = F.when(F.col("c") % 4 == 0, F.array(one(F.lit("over"), F.lit(2), 2, right=2))).otherwise(F.slice(head, 1, 0))
    prov = F.array(F.struct((F.col("idx") + 1).alias("page_no"), F.lit(None).cast("struct<l:double,t:double,r:double,b:double,coord_origin:string>").alias("bbox")))
    return t.select(
        "doc_id", "idx", F.lit(None).cast("array<array<string>>").alias("grid"), prov.alias("prov"), F.lit(None).cast("map<int,double>").alias("heights"), F.lit(None).cast("boolean").alias("content_before"),
        F.struct((F.col("n") + 2).alias("n_rows"), F.lit(4).alias("n_cols"), F.concat(head, "cells", late).alias("cells")).alias("span_cells"),
    )
