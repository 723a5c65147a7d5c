"""Logical tables and their rows from grouped fragments.

Fragments carry the decisions: where a fragment's rows begin in its table, what is
appended to its last row, whether rows may fold. The rows join them once, by
(doc_id, idx), and are numbered from there, so no window runs over the rows of a
whole logical table, only over those of one fragment, and over those only where a
row can fold: a table whose rows all begin with a filled cell is numbered by sizes
alone. Cells stay positional arrays; row_pos counts a fragment's rows from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan.config import StitchConfig
from pagespan.functions import text
from pagespan.sources.store import written

KEY = ["doc_id", "logical_index"]
# Words of column names that take links; EXTRA and PLAIN begin the names of columns that a header lacks.
LINK_WORDS = ("content", "ref", "desc", "link", "url")
EXTRA = "_extra_"
PLAIN = "col_"
_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def pad(cells: Column, width: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))


def _fresh(name: Column, used: Column) -> Column:
    """The name, or the first of name_1, name_2, ... that isn't used."""
    more = F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda i: F.concat(name, F.lit("_"), i.cast("string")))
    return F.when(~F.array_contains(used, name), name).otherwise(F.get(F.filter(more, lambda m: ~F.array_contains(used, m)), F.lit(0)))


def widened(columns: Column) -> Column:
    """The header after all members' columns (an array of arrays, in order): extra columns get names of their own."""

    def grow(acc, cols):
        extra = F.slice(cols, F.size(acc) + 1, F.greatest(F.size(cols) - F.size(acc), F.lit(0)))
        base = F.transform(extra, lambda c, i: F.concat(F.lit(EXTRA), i.cast("string"), F.lit("_"), F.when(text.is_empty(c), "column").otherwise(text.strip(c))))
        return F.aggregate(base, acc, lambda used, n: F.concat(used, F.array(_fresh(n, used))))

    return F.aggregate(F.slice(columns, 2, F.greatest(F.size(columns) - 1, F.lit(0))), F.get(columns, F.lit(0)), grow)


def sizes(rows: DataFrame) -> DataFrame:
    """Per fragment: n_rows, last_pos, and whether a row begins with an empty cell (only such rows can fold)."""
    blank = text.is_empty(F.get("cells", F.lit(0)))
    return rows.groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias("n_rows"), F.max("row_pos").alias("last_pos"), F.max(blank).alias("blank"))


def _normal() -> Column:
    return ~F.col("is_spill")


def _frames(order) -> tuple:
    """(all of a table, up to a member, before it): frames of one order, so that Spark makes one pass for them."""
    return order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)


def beside_rank(order) -> dict[str, Column]:
    """What plan() needs of a table's members, for decide.groups() to find with their ranks."""
    whole, upto, before = _frames(order)
    head = _normal() & F.col("is_header_orphan")
    width = F.when(_normal(), F.col("width"))
    return {"has_header": F.max(head).over(whole), "after_header": F.max(head).over(before), "base_width": F.first(width, ignorenulls=True).over(upto), "width_before": F.max(width).over(before)}


def plan(grouped: DataFrame, cfg: StitchConfig) -> DataFrame:
    """decide.groups() with what rows need per member: build ('orphan' or 'generic'), role ('header' or 'data'; spilling members have
    none), base_width, items (overflow of cells that stood before its rows, for the last row of the member target_rank) and labels
    (the same for the header of an orphan table). Of groups with sizes() also base (where a member's rows begin), and per table total
    (rows), last_rank (last member with rows), blank (whether a row can fold) and odd (whether the rows of a member aren't numbered
    0, 1, ...). All windows have the order of the groups, so nothing is sorted again."""
    whole, _, before = _frames(Window.partitionBy("doc_id", "comp").orderBy("page0", "idx"))
    header = _normal() & F.col("is_header_orphan") & ~F.coalesce("after_header", F.lit(False))
    m = grouped.withColumn("build", F.when(F.coalesce("has_header", F.lit(False)), "orphan").otherwise("generic"))
    m = m.withColumn("role", F.when(_normal(), F.when(F.coalesce(header, F.lit(False)), "header").otherwise("data")))
    data = F.coalesce(F.col("role") == "data", F.lit(False))
    # width before the member itself was added
    w = F.coalesce("width_before", "base_width") if cfg.width_overflow_policy == "preserve_extra" else F.col("base_width")
    over = {"target_rank": F.last(F.when(data & (F.col("row_count") > 0), F.col("rank")), ignorenulls=True).over(before), "prev": F.last(F.when(data, F.struct("pages", "is_header_orphan")), ignorenulls=True).over(before)}
    if "n_rows" in grouped.columns:
        here = data & F.col("n_rows").isNotNull()
        over |= {"base": F.coalesce(F.sum(F.when(here, F.col("last_pos") + 1)).over(before), F.lit(0)), "total": F.sum(F.when(here, F.col("n_rows"))).over(whole), "last_rank": F.max(F.when(here, F.col("rank"))).over(whole)}
        over |= {"odd": F.max(F.when(here, F.col("last_pos") + 1 != F.col("n_rows"))).over(whole), "blank": F.max(F.when(here, F.col("blank"))).over(whole)}
    m = m.withColumns(over)
    lo, hi = F.coalesce(F.array_min("pages"), F.lit(0)), F.coalesce(F.array_max("prev.pages"), F.lit(0))
    has, orphan = data & (F.size("continuation_content") > 0), F.col("build") == "orphan"
    near = orphan | (F.col("prev").isNotNull() & (lo - hi <= cfg.max_page_gap))
    items = F.when(orphan, F.col("continuation_content")).otherwise(F.filter("continuation_content", lambda x: x["col_idx"] < w))
    from_header = F.when(F.col("prev").isNull(), F.lit(True)).otherwise(F.col("prev.is_header_orphan"))
    m = m.withColumns({
        "items": F.when(has & near & F.col("target_rank").isNotNull(), items),
        "labels": F.when(has & orphan & F.col("target_rank").isNull() & from_header, F.col("continuation_content")),
    })
    return m.drop("prev", "width_before", "has_header", "after_header", "continuation_content")


def overflowing(planned: DataFrame) -> DataFrame:
    """Members that policy 'fail' refuses: wider than their table."""
    return planned.where("role is not null and build = 'generic' and width > base_width")


def headers(member: DataFrame, lead: DataFrame, spill: DataFrame, cfg: StitchConfig) -> DataFrame:
    """A row per logical table, all of its members met once: members, pages, columns (before cleaning), traces, build_warnings, and
    what its rows need: w (its width), url_col, spills, may_fold, plain (no row folds, and sizes number the rows)."""
    normal = _normal()
    g = member.groupBy(*KEY).agg(
        F.first("build").alias("build"), F.sort_array(F.collect_list(F.when(normal, F.struct("rank", "idx", "start_page", "width", "columns")))).alias("m"), F.sort_array(F.collect_list(F.struct("rank", "idx"))).alias("who"),
        F.flatten(F.collect_list(F.when(normal, F.col("pages")))).alias("pages"), F.max(F.when(F.col("role") == "header", F.col("columns"))).alias("label"),
        F.sort_array(F.collect_list(F.when(F.col("labels").isNotNull(), F.struct("rank", F.col("labels").alias("items"))))).alias("labels"), F.sort_array(F.concat(F.collect_list("trace"), F.flatten(F.collect_list("more")))).alias("traces"),
        F.first("total").alias("total"), F.max("blank").alias("blank"), F.max("odd").alias("odd"),
    ).join(lead, KEY, "left").join(spill, KEY, "left")
    g = g.withColumn("label", F.coalesce("first_row", "label"))
    cols = F.transform("m", lambda x: x["columns"])
    label, alone = F.col("label"), F.size("m") == 1
    full = F.greatest(F.size(label), F.array_max(F.transform("m", lambda x: x["width"])))
    orphan = F.concat(F.transform(label, lambda c: F.coalesce(c, F.lit(""))), F.when(full > F.size(label), F.transform(F.sequence(F.size(label), full - 1), lambda k: F.concat(F.lit(PLAIN), k.cast("string")))).otherwise(_none()))
    own = F.get("m", F.lit(0))["columns"]
    generic = F.when(alone, own).otherwise(widened(cols)) if cfg.width_overflow_policy == "preserve_extra" else own
    warned = _none()
    if cfg.width_overflow_policy == "warn_drop":
        w = F.size(own)
        wide = F.filter("m", lambda x: x["width"] > w)
        warned = F.transform(wide, lambda x: F.concat(
            F.lit("table "), x["idx"].cast("string"), F.lit(" (page "), F.coalesce(x["start_page"].cast("string"), F.lit("unknown")), F.lit(") has "), x["width"].cast("string"), F.lit(" columns where "), w.cast("string"),
            F.lit(" fit; cut: "), F.array_join(F.slice(x["columns"], w + 1, x["width"] - w), ", ")))
        warned = F.when(F.col("build") == "generic", warned).otherwise(_none())
    g = g.withColumn("columns", F.when(F.col("build") == "orphan", orphan).otherwise(generic))
    named = _fold(F.col("columns"), F.flatten(F.transform("labels", lambda c: c["items"])), lambda acc, v: F.concat(acc, F.lit(" "), v))
    g = g.withColumn("columns", F.when(F.size("labels") > 0, named).otherwise(F.col("columns")))
    on_pages = F.size(F.array_distinct(F.concat("pages", F.coalesce("spill_pages", F.array().cast("array<int>"))))) > 1
    folds = F.coalesce(on_pages & (F.col("total") > 1), F.lit(False))
    plain = ~(folds & F.coalesce("blank", F.lit(False))) & ~F.coalesce("odd", F.lit(False))
    traces = F.when(F.size("traces") > 0, F.col("traces"))
    g = g.select(*KEY, F.transform("who", lambda x: x["idx"]).alias("members"), "pages", "spill_pages", "build", "columns", "total", traces.alias("traces"), warned.alias("build_warnings"), "spills", folds.alias("may_fold"), plain.alias("plain"))
    return g.withColumn("w", F.size("columns")).withColumn("url_col", F.when(~F.col("plain"), url_column(F.col("columns"))))


def _fold(cells: Column, items: Column, join) -> Column:
    """Appends each item to the cell at its col_idx, in order."""
    return F.transform(cells, lambda c, i: F.aggregate(F.filter(items, lambda x: x["col_idx"] == i), c, lambda acc, x: join(acc, x["value"])))


def aligned(cfg: StitchConfig) -> Column:
    """The cells of a row (cells, w, build) under its table's w columns."""
    sep = F.lit(cfg.stitch_separator)
    clean = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    cut = F.slice(pad(clean, F.col("w")), 1, F.col("w"))
    if cfg.width_overflow_policy != "merge_tail":
        return cut
    tail = F.transform(F.filter(F.slice(clean, F.col("w") + 1, F.greatest(F.size("cells") - F.col("w"), F.lit(0))), lambda c: ~text.is_empty(c)), text.strip)
    all_ = F.array_join(tail, cfg.stitch_separator)
    last = F.get(cut, F.col("w") - 1)
    merged = F.when(text.is_empty(last), all_).otherwise(F.concat(text.rstrip(last), sep, all_))
    return F.when((F.col("build") == "generic") & (F.size(tail) > 0) & (F.col("w") > 0), F.transform(cut, lambda c, i: F.when(i == F.col("w") - 1, merged).otherwise(c))).otherwise(cut)


def spill_text(edge: DataFrame, cfg: StitchConfig) -> DataFrame:
    """key, spills (texts in member order), spill_pages: first-column cells of spillover members that hold something."""
    s = edge.where("is_spill").withColumn("cell", F.coalesce(F.get("cells", F.lit(0)), F.lit(""))).where(~text.is_empty(F.col("cell")))
    per = s.groupBy(*KEY, "rank").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_pos", "cell"))), lambda x: x["cell"]), cfg.stitch_separator).alias("t"), F.first("pages").alias("p"))
    return per.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("spills"), F.flatten(F.collect_list("p")).alias("spill_pages"))


def url_column(columns: Column) -> Column:
    """The last column whose name speaks of content or links; else the last."""
    hits = F.filter(F.transform(columns, lambda c, i: F.when(F.lower(c).rlike("|".join(LINK_WORDS)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.element_at(F.when(F.size(hits) > 0, hits), -1), F.size(columns) - 1)


def fold_split_cells(rows: DataFrame, cfg: StitchConfig) -> DataFrame:
    """rows (key, doc_id, idx, rank, n, cells, url_col, may_fold) -> key, row_pos, cells: a row whose only filled cell isn't the
    first joins the row above.

    Whether a row continues depends on that row alone, so the others cut the table into islands. They are counted within
    fragments, and the counts are summed over the fragments of a table.
    """
    cells = F.col("cells")
    full = F.filter(F.transform(cells, lambda c, i: F.when(~text.is_empty(c), i)), lambda i: i.isNotNull())
    at = F.get(full, F.lit(0))
    goes = F.coalesce(F.col("may_fold") & (F.col("n") > 0) & (F.size(full) == 1) & (at > 0), F.lit(False))
    value = text.strip(F.get(cells, at))
    url = value.contains("://") | F.lower(value).startswith("http")
    item = F.struct("n", F.when(url, F.col("url_col")).otherwise(at).cast("int").alias("col_idx"), value.alias("value"))
    r = rows.withColumn("item", F.when(goes, item))
    start = F.col("item").isNull().cast("int")
    r = r.withColumn("local", F.sum(start).over(Window.partitionBy("doc_id", "idx").orderBy("n")))
    r = written(r.select(*KEY, "idx", "rank", "n", "cells", "item", "local"), "aligned")
    before = Window.partitionBy(*KEY).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    heads = r.groupBy(*KEY, "idx", "rank").agg(F.sum(start).alias("heads")).select("doc_id", "idx", F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("above"))
    r = r.join(heads, ["doc_id", "idx"]).withColumn("row_pos", (F.col("above") + F.col("local") - 1).cast("int"))
    items = r.where("item is not null").groupBy(*KEY, "row_pos").agg(F.sort_array(F.collect_list("item")).alias("items"))
    sep = F.lit(cfg.stitch_separator)
    folded = _fold(cells, F.col("items"), lambda acc, v: F.when(text.is_empty(acc), v).otherwise(F.concat(text.rstrip(acc), sep, v)))
    return r.where("item is null").join(items, [*KEY, "row_pos"], "left").select(*KEY, "row_pos", F.when(F.col("items").isNotNull(), folded).otherwise(cells).alias("cells"))


def placed(member: DataFrame, head: DataFrame, rows: DataFrame, cfg: StitchConfig) -> DataFrame:
    """The rows of the tables of head: key, idx, rank, n (place in the table before any row folds), cells, url_col, may_fold."""
    sep = F.lit(cfg.stitch_separator)
    # fragments: where their rows begin, and what is appended to their last row
    m = member.where("role = 'data' and n_rows is not null").select(*KEY, "idx", "rank", "build", "last_pos", "last_rank", "base").repartition(*KEY)
    conts = member.where("items is not null").select(*KEY, "target_rank", F.struct("rank", "items").alias("c")).repartition(*KEY)
    conts = conts.groupBy(*KEY, F.col("target_rank").alias("rank")).agg(F.flatten(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["items"])).alias("items"))
    frag = m.join(head.select(*KEY, "w", "url_col", "spills", "may_fold").repartition(*KEY), KEY).join(conts, [*KEY, "rank"], "left")
    frag = frag.withColumn("spills", F.when(F.col("rank") == F.col("last_rank"), F.col("spills"))).drop("last_rank")

    r = rows.join(frag, ["doc_id", "idx"]).withColumn("cells", aligned(cfg))
    is_last = F.col("row_pos") == F.col("last_pos")
    generic = _fold(F.col("cells"), F.col("items"), lambda acc, v: F.when(text.is_empty(acc), acc).otherwise(F.concat(acc, sep, v)))
    orphan = _fold(F.col("cells"), F.col("items"), lambda acc, v: F.concat(acc, F.lit("\n"), v))
    r = r.withColumn("cells", F.when(~is_last | F.col("items").isNull(), F.col("cells")).when(F.col("build") == "orphan", orphan).otherwise(generic))
    joined = lambda c: F.aggregate("spills", c, lambda acc, t: F.when(text.strip(acc) != "", F.concat(text.strip(acc), sep, t)).otherwise(t))
    spilled = F.transform("cells", lambda c, i: F.when(i == F.size("cells") - 1, joined(c)).otherwise(c))
    r = r.withColumn("cells", F.when(is_last & F.col("spills").isNotNull(), spilled).otherwise(F.col("cells"))).withColumn("n", F.col("base") + F.col("row_pos"))
    return r.select(*KEY, "idx", "rank", "n", "cells", "url_col", "may_fold")


def rebuild(member: DataFrame, rows: DataFrame, cfg: StitchConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, plain rows, folded rows) of plan() of groups with sizes: tables has key, members, pages, build, columns, n_rows, traces
    (decisions whose ends both lie in the table, first pass first), merge_reason, warnings, is_single. Only the rows of tables in
    which rows can fold are made for their tables; those of the others, numbered by sizes, when they are read."""
    # only spilling and header members need their rows before the table is known
    some = written(member.where("is_spill or role = 'header'").select(*KEY, "idx", "rank", "pages", "is_spill"), "leading")
    edge = written(some.join(rows, ["doc_id", "idx"]).where("is_spill or row_pos = 0"), "leading rows")
    spill = written(spill_text(edge, cfg), "spills")
    head = written(headers(member, edge.where("not is_spill").select(*KEY, F.col("cells").alias("first_row")), spill, cfg), "named")

    folded = written(fold_split_cells(placed(member, head.where("not plain"), rows, cfg), cfg), "folded")
    plain = placed(member, head.where("plain"), rows, cfg).select(*KEY, F.col("n").cast("int").alias("row_pos"), "cells")

    counts = folded.groupBy(*KEY).agg(F.count(F.lit(1)).alias("counted"))
    t = head.join(counts, KEY, "left").withColumn("n_rows", F.coalesce(F.when(F.col("plain"), F.col("total")).otherwise(F.col("counted")), F.lit(0)).cast("int"))
    spilled_pages = F.when(F.col("n_rows") > 0, F.col("spill_pages"))
    all_pages = F.array_sort(F.array_distinct(F.concat("pages", F.coalesce(spilled_pages, F.array().cast("array<int>")))))
    reasons = F.transform(F.filter("traces", lambda x: x["merged"]), lambda x: x["reason"])
    said = F.flatten(F.transform("traces", lambda x: x["warnings"]))
    return written(t.select(
        *KEY, "members", all_pages.alias("pages"), "build", F.transform("columns", text.clean_header).alias("columns"), "n_rows", "traces", F.coalesce(F.array_join(reasons, "+"), F.lit("")).alias("merge_reason"),
        F.concat("build_warnings", F.coalesce(said, _none())).alias("warnings"), (F.size("members") == 1).alias("is_single")), "tables"), plain, folded
