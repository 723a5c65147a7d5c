"""One query per operator of the engine, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.config import StitchConfig
from pagespan.functions import shapes, text
from pagespan.operators import decide, document, inject, order, rebuild, spans
from pagespan.plans import demo
from pagespan.plans.engine import decide as decide_all
from pagespan.plans.engine import decisions, extract_fragments, merge_fragments
from pagespan.sources import export, snapshot
from pagespan.sources.store import written

CFG = StitchConfig()
#: No separator character differs between engines in this one.
SPACE = StitchConfig(stitch_separator=" ")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _merged(spark, sf_dir, cfg=SPACE):
    return merge_fragments(demo.demo_fragments(spark, sf_dir), demo.demo_rows(spark, sf_dir), cfg)


def _list(c, sep=","):
    return F.array_join(F.col(c).cast("array<string>"), sep)


def tokens_documents(spark, sf_dir):
    t = _read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


def tokens_headers(spark, sf_dir):
    return demo.demo_fragments(spark, sf_dir).select("doc_id", "idx", F.array_join(F.array_sort("header_tokens"), " ").alias("tokens"))


def _pairs(spark, sf_dir, cfg=CFG):
    return decide.decide_pairs(demo.demo_fragments(spark, sf_dir), cfg)


def jaccard_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", "right_idx", F.round("signals.header_similarity", 9).alias("header_similarity"), F.round("signals.row_similarity", 9).alias("row_similarity"))


def pair_signals(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", "left_idx", "right_idx", "signals.left_page", "signals.right_page", "signals.page_gap", "signals.width_diff", "signals.left_headerless", "signals.right_headerless", "signals.layout_continuation")


def pair_decisions(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", "left_idx", "right_idx", "merged", "reason")


def pair_decisions_same_width(spark, sf_dir):
    return _pairs(spark, sf_dir, StitchConfig(require_same_width=True, max_page_gap=3)).select("doc_id", "left_idx", "right_idx", "merged", "reason")


def decision_counts(spark, sf_dir):
    pairs, _ = decide_all(written(demo.demo_fragments(spark, sf_dir), "fragments"), CFG)
    return pairs.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def missing_index_guard(spark, sf_dir):
    return _pairs(spark, sf_dir).where("reason = 'unextracted_table_between'").select("doc_id", "left_idx", "right_idx", F.get("warnings", F.lit(0)).alias("warning"))


def spillover_pairs(spark, sf_dir):
    n = decide.neighbours(demo.demo_fragments(spark, sf_dir)).where("a is not null")
    return n.where(decide.is_spillover(F.col("a"), F.col("b"), CFG)).select("doc_id", F.col("a.idx").alias("left_idx"), F.col("b.idx").alias("right_idx"))


def spillover_pairs_by_content(spark, sf_dir):
    cfg = StitchConfig(spillover_require_content_check=True)
    f = demo.demo_fragments(spark, sf_dir)
    # some first cells speak of tickets and links, most are numbers; single columns of up to two rows pass by their size
    said = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("see AB-"), "first_cell")).when(F.col("row_count") % 2 == 0, F.concat(F.lit("HTTP "), "first_cell")).otherwise(F.concat(F.lit("ab-"), "first_cell"))
    n = decide.neighbours(f.withColumn("first_cell", F.when(F.substring("first_cell", -1, 1) < "6", said).otherwise(F.col("first_cell")))).where("a is not null")
    return n.where(decide.is_spillover(F.col("a"), F.col("b"), cfg)).select("doc_id", F.col("a.idx").alias("left_idx"), F.col("b.idx").alias("right_idx"))


def layout_pairs(spark, sf_dir):
    n = decide.neighbours(demo.demo_fragments(spark, sf_dir)).where("a is not null")
    return n.where(decide.layout_continues(F.col("a"), F.col("b"), CFG)).select("doc_id", F.col("a.idx").alias("left_idx"), F.col("b.idx").alias("right_idx"))


def unique_token_pairs(spark, sf_dir):
    n = decide.neighbours(demo.demo_fragments(spark, sf_dir)).where("a is not null")
    return n.where(text.both_have_own(F.col("a.header_tokens"), F.col("b.header_tokens"))).select("doc_id", F.col("a.idx").alias("left_idx"), F.col("b.idx").alias("right_idx"))


def orphan_edges(spark, sf_dir):
    e = decide.orphan_edges_of(written(decide.decisions(demo.demo_fragments(spark, sf_dir), CFG), "islands"), CFG)
    return e.select("doc_id", "left_idx", "right_idx", "reason")


def components(spark, sf_dir):
    _, g = decide_all(written(demo.demo_fragments(spark, sf_dir), "fragments"), CFG)
    return g.select("doc_id", "idx", "logical_index", "rank")


def logical_tables(spark, sf_dir):
    """Flagship: which fragments form one table, on which pages, and why."""
    t = _merged(spark, sf_dir).tables
    return t.select("doc_id", "logical_index", _list("members").alias("members"), _list("pages").alias("pages"), "merge_reason", "n_rows", F.size("columns").alias("n_columns"))


def logical_columns(spark, sf_dir):
    return _merged(spark, sf_dir).tables.select("doc_id", "logical_index", F.array_join("columns", "|").alias("columns"))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "logical_index", "row_pos", F.posexplode("cells").alias("col_pos", "cell"))


def merged_rows_preserve(spark, sf_dir):
    return _cells(_merged(spark, sf_dir).rows_once())


def merged_rows_warn_drop(spark, sf_dir):
    return _cells(_merged(spark, sf_dir, StitchConfig(width_overflow_policy="warn_drop", stitch_separator=" ")).rows_once())


def merged_rows_merge_tail(spark, sf_dir):
    return _cells(_merged(spark, sf_dir, StitchConfig(width_overflow_policy="merge_tail", stitch_separator=" ")).rows_once())


def overflow_warnings(spark, sf_dir):
    t = _merged(spark, sf_dir, StitchConfig(width_overflow_policy="warn_drop")).tables
    return t.select("doc_id", "logical_index", F.explode("warnings").alias("warning"))


def trace_attachment(spark, sf_dir):
    t = _merged(spark, sf_dir).tables
    return t.select("doc_id", "logical_index", F.explode("traces").alias("t")).select("doc_id", "logical_index", "t.pass_no", "t.left_idx", "t.right_idx", "t.merged", "t.reason")


def overflow_fail_check(spark, sf_dir):
    made = decisions(written(demo.demo_fragments(spark, sf_dir), "fragments"), CFG)
    return rebuild.overflowing(rebuild.plan(made.groups(), StitchConfig(width_overflow_policy="fail"))).select("doc_id", "idx", "width", "base_width")


def orphan_tables(spark, sf_dir):
    t = _merged(spark, sf_dir).tables.where("build = 'orphan'")
    return t.select("doc_id", "logical_index", "n_rows", F.array_join("columns", "|").alias("columns"))


#: Strings of every shape, made of orders.
_SHAPES = """
SELECT o_orderkey AS id, n AS kind, CASE n
  WHEN 0 THEN CAST(o_orderkey AS VARCHAR(20)) WHEN 1 THEN concat(CAST(o_orderkey AS VARCHAR(20)), '.5') WHEN 2 THEN concat('1/', CAST(o_orderkey % 28 AS VARCHAR(20)), '/99')
  WHEN 3 THEN concat('https://x/', CAST(o_orderkey AS VARCHAR(20))) WHEN 4 THEN concat('Ab-', CAST(o_orderkey AS VARCHAR(20))) WHEN 5 THEN concat('$', CAST(o_orderkey AS VARCHAR(20)), ',000')
  WHEN 6 THEN concat(CAST(o_orderkey % 100 AS VARCHAR(20)), ' %') WHEN 7 THEN concat('row ', CAST(o_orderkey AS VARCHAR(20))) WHEN 8 THEN o_orderpriority WHEN 9 THEN concat('1,', CAST(100 + o_orderkey % 900 AS VARCHAR(20)))
  WHEN 10 THEN concat(' ', CAST(o_orderkey AS VARCHAR(20)), '.0 (1, 2)') WHEN 11 THEN concat('7.0 x 10-', CAST(o_orderkey AS VARCHAR(20))) WHEN 12 THEN concat('column_', CAST(o_orderkey AS VARCHAR(20))) WHEN 13 THEN '   '
  WHEN 14 THEN concat('a long label that says far too much: ', o_orderstatus) ELSE concat('Status ', o_orderstatus) END AS cell
FROM (SELECT *, o_orderkey % 16 AS n FROM orders) x
"""


def _shape_cells(spark, sf_dir):
    _read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_SHAPES.replace("VARCHAR(20)", "STRING"))


def cell_shapes(spark, sf_dir):
    c = F.col("cell")
    return _shape_cells(spark, sf_dir).select("id", shapes.looks_like_data(c).alias("is_data"), F.coalesce(shapes.sub_shape(c), F.lit("none")).alias("shape"), shapes.header_shaped(c).alias("is_header"), text.is_empty(c).alias("is_blank"))


def clean_headers(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_brand", F.lit("."), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_type")), F.lit(" ")).alias("h"))
    return p.select("p_partkey", text.clean_header(F.col("h")).alias("name"), text.clean_grid_header(F.col("h"), F.lit(3)).alias("grid_name"))


def numeric_colnames(spark, sf_dir):
    c = F.col("o_custkey")
    names = F.array(F.when(c % 2 == 0, c.cast("string")).otherwise("a"), F.when(c % 3 == 0, F.concat(F.lit(" Unnamed: "), c.cast("string"))).otherwise("b"), F.when(c % 5 == 0, F.lit("7")).otherwise("c"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.numeric_like_names(names).alias("numeric_like"), text.has_digit(F.col("o_orderpriority")).alias("has_digit"))


def _extracted(spark, sf_dir):
    return extract_fragments(demo.demo_grids(spark, sf_dir), CFG)


def headerless_flags(spark, sf_dir):
    f, _ = _extracted(spark, sf_dir)
    return f.select("doc_id", "idx", "is_headerless", "width", "row_count", F.size("continuation_content").alias("n_continuation"))


def fragment_pages(spark, sf_dir):
    f, _ = _extracted(spark, sf_dir)
    return f.select("doc_id", "idx", "start_page", _list("pages").alias("pages"), F.round("vert_top", 6).alias("vert_top"), F.round("vert_bottom", 6).alias("vert_bottom"))


def header_orphans(spark, sf_dir):
    f, _ = _extracted(spark, sf_dir)
    return f.select("doc_id", "idx", "is_header_orphan", "is_data_orphan")


def header_contrast(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("y"), "o_orderpriority", F.col("o_orderkey").cast("string").alias("k"))
    rows = F.array(F.array("y", "y"), F.array(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("k")), F.col("o_orderpriority")))
    return o.select("o_orderkey", shapes.header_by_contrast(rows).alias("is_header"))


def _body(spark, sf_dir):
    """Reading order from conversations: a conversation is a document; each fourth turn is a table, others are texts."""
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    label = F.when(F.col("turn") % 3 == 1, "section_header").otherwise("text")
    said = F.when((F.col("turn") % 3 == 1) & (F.col("doc_id").cast("int") % 5 == 0), F.lit("Summary (continued)")).otherwise(F.concat("text", F.lit(" "), F.col("turn").cast("string")))
    kind = F.when(F.col("turn") % 4 == 0, "tables").otherwise("texts")
    c = c.select("doc_id", "turn", kind.alias("kind"), label.alias("label"), said.alias("text"), (F.col("turn") + 1).alias("page"))
    return c.select("doc_id", F.col("turn").alias("ord"), "kind", F.col("turn").alias("item")), c.where("kind = 'texts'").select("doc_id", F.col("turn").alias("item"), "label", "text", "page")


def content_before(spark, sf_dir):
    o, t = _body(spark, sf_dir)
    return order.content_before(o, order.blocking_headings(t))


def running_furniture(spark, sf_dir):
    """Documents of a language as the pages of one: a whole text is a heading, and furniture where another page repeats it."""
    d = _read(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("doc_id").cast("int").alias("item"), F.lit("Title").alias("label"), "text", (F.col("doc_id") % 50).cast("int").alias("page"))
    return order.running_furniture(d)


def reading_order(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("turn"))
    top = c.where("turn % 2 = 0").select("doc_id", F.lit("body").alias("parent"), F.col("turn").alias("place"), F.when(F.col("turn") % 4 == 0, "groups").otherwise("texts").alias("kind"), F.col("turn").alias("item"))
    kids = c.where("turn % 2 = 1").select("doc_id", F.concat(F.lit("groups/"), F.expr("cast(cast(floor(turn / 4.0) as int) * 4 as string)")).alias("parent"), F.col("turn").alias("place"), F.lit("texts").alias("kind"), F.col("turn").alias("item"))
    return order.flatten_body(top.unionByName(kids))


def _grid_cells(spark, sf_dir):
    g = demo.demo_grids(spark, sf_dir).select("doc_id", "idx", F.posexplode("grid").alias("row_pos", "r")).select("doc_id", "idx", "row_pos", F.posexplode("r").alias("col_pos", "text"))
    one = F.lit(1)
    return g.select("*", one.alias("row_span"), one.alias("col_span"), (F.col("row_pos") <= 1).alias("column_header"), (F.col("col_pos") == 0).alias("row_header"))


def passthrough_cells(spark, sf_dir):
    return inject.passthrough(_grid_cells(spark, sf_dir), _merged(spark, sf_dir).tables).groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias("cells"))


def anchor_grid(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return inject.anchor_cells(_grid_cells(spark, sf_dir), m.tables, m.rows_once()).select("doc_id", "idx", "row_pos", "col_pos", "text", "column_header", "row_header")


def prov_merge(spark, sf_dir):
    prov = demo.demo_grids(spark, sf_dir).select("doc_id", "idx", "prov")
    return inject.merged_provenance(prov, _merged(spark, sf_dir).tables).select("doc_id", "idx", F.array_join(F.transform("prov", lambda p: p["page_no"].cast("string")), ",").alias("pages"), "cleared")


def satellite_clear(spark, sf_dir):
    t = inject.touched(_merged(spark, sf_dir).tables).where("place > 0")
    return t.select("doc_id", "idx", "anchor")


def pruned_refs(spark, sf_dir):
    o = demo.demo_fragments(spark, sf_dir).select("doc_id", F.col("pos").alias("ord"), F.lit("tables").alias("kind"), F.col("idx").alias("item"))
    return inject.pruned_order(o, _merged(spark, sf_dir).tables)


def _documents(spark, sf_dir):
    """The demo documents, and the same after stitching, read back from their JSON."""
    docs = snapshot.from_json_text(written(demo.demo_documents(spark, sf_dir), "documents"))
    m = _merged(spark, sf_dir)
    back = document.stitched_documents(docs, m.tables, m.rows).select("doc_id", F.to_json("doc").alias("value"))
    return docs, snapshot.from_json_text(written(back, "stitched"))


def stitched_documents(spark, sf_dir):
    """Every cell of every table of the documents that come back."""
    _, back = _documents(spark, sf_dir)
    return snapshot.cells(back).select("doc_id", "idx", "row_pos", "col_pos", "text", "column_header", "row_header")


def document_tables(spark, sf_dir):
    """The tables of the documents that come back: size, provenance, references to them, and a field that the engine doesn't know."""
    _, back = _documents(spark, sf_dir)
    t, v = snapshot.described(back).where("error is null"), F.col("t")
    refs = snapshot.body_nodes(back).where("kind = 'tables'").groupBy("doc_id", F.col("item").alias("idx")).agg(F.count(F.lit(1)).cast("int").alias("refs"))
    number = lambda n: snapshot.field(v, f"$.data.{n}", "int").alias(n)
    t = t.join(refs, ["doc_id", "idx"], "left")
    return t.select("doc_id", "idx", number("num_rows"), number("num_cols"), F.size(snapshot.field(v, "$.data.table_cells", "array<variant>")).alias("n_cells"), F.array_join(F.transform("prov", lambda p: p["page_no"].cast("string")), ",").alias("pages"), F.coalesce("refs", F.lit(0)).alias("refs"), snapshot.field(v, "$.label", "string").alias("label"))


def _shells(docs: DataFrame, back: DataFrame) -> DataFrame:
    """Documents meet by digests of their JSON, never whole, and sorted: what Spark guesses of a column made of variants is far too
    small, and a side that it broadcast by that guess went through the driver."""
    digest = F.sha2(F.to_json("doc"), 256)
    new = back.select("doc_id", digest.alias("new"), F.size(snapshot.field(F.col("doc"), "$.tables", "array<variant>")).alias("n_tables"), F.to_json(snapshot.field(F.col("doc"), "$.origin")).alias("origin"))
    b = new.join(docs.select("doc_id", digest.alias("old")).hint("merge"), "doc_id")
    return b.select("doc_id", (F.col("old") == F.col("new")).alias("unchanged"), "n_tables", "origin")


def document_shells(spark, sf_dir):
    """Per document: whether it came back as it was, how many tables its list has, and what the engine doesn't know of it."""
    docs, back = _documents(spark, sf_dir)
    return _shells(docs, back)


def document_html(spark, sf_dir):
    """The documents that come back, whole, as HTML."""
    return export.documents_html(_documents(spark, sf_dir)[1])


def snapshot_errors(spark, sf_dir):
    """The malformed tables of the demo documents, with their cause; the others of the same documents are read."""
    docs = snapshot.from_json_text(written(demo.demo_documents(spark, sf_dir), "documents"))
    seen = written(snapshot.described(docs).select("doc_id", "idx", "error"), "tables read")
    read = seen.groupBy("doc_id").agg(F.count(F.when(F.col("error").isNull(), 1)).cast("int").alias("extracted"))
    return snapshot.extract_errors(docs, seen).join(read, "doc_id").select("doc_id", "idx", "error", "extracted")


def span_grids(spark, sf_dir):
    """Tables given by spanning cells, as the dense grid."""
    r = spans.dense_rows(demo.demo_span_tables(spark, sf_dir))
    return r.select("doc_id", "idx", "row_pos", F.posexplode("cells").alias("col_pos", "c")).select("doc_id", "idx", "row_pos", "col_pos", "c.text", "c.header")


def span_tables(spark, sf_dir):
    """Tables given by spanning cells, as fragments: dotted column names, all rows below the header."""
    f, rows = extract_fragments(demo.demo_span_tables(spark, sf_dir), CFG)
    said = rows.groupBy("doc_id", "idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_pos", F.array_join("cells", "|").alias("t")))), lambda x: x["t"]), "/").alias("cells"))
    return f.join(said, ["doc_id", "idx"], "left").select("doc_id", "idx", F.array_join("columns", "|").alias("columns"), "is_headerless", "row_count", "start_page", "cells")


def run_metrics(spark, sf_dir):
    return _merged(spark, sf_dir).metrics()


def phase_rows(spark, sf_dir):
    """What the phases of a run wrote, as observed while they wrote it (their seconds differ from run to run)."""
    p = _merged(spark, sf_dir).phases()
    return p.where(F.col("phase").isin("fragments", "fragment rows", "pairs", "islands", "edges", "groups", "tables", "rows")).select("phase", "rows")


def queries() -> dict:
    own = (
        logical_tables, tokens_documents, tokens_headers, jaccard_pairs, pair_signals, pair_decisions, pair_decisions_same_width, decision_counts, missing_index_guard, spillover_pairs, spillover_pairs_by_content, layout_pairs, unique_token_pairs, orphan_edges,
        components, logical_columns, merged_rows_preserve, merged_rows_warn_drop, merged_rows_merge_tail, overflow_warnings, trace_attachment, overflow_fail_check, orphan_tables, cell_shapes, clean_headers, numeric_colnames,
        headerless_flags, fragment_pages, header_orphans, header_contrast, content_before, running_furniture, reading_order, passthrough_cells, anchor_grid, prov_merge, satellite_clear, pruned_refs, run_metrics,
        stitched_documents, document_tables, document_shells, document_html, snapshot_errors, span_grids, span_tables, phase_rows,
    )
    return {f.__name__: f for f in own}
