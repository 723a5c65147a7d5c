"""Decisions about pairs of fragments: one window over a document's fragments and one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan.config import StitchConfig
from pagespan.functions import text
from pagespan.sources.store import written

# The reason codes, which are part of the results.
MERGING = (
    "spillover", "header_orphan_to_headerless", "headerless_width_match", "headerless_width_drift_layout", "row_similarity", "header_similarity_strict",
    "header_similarity_loose_layout",
)
REFUSING = (
    "unextracted_table_between", "missing_page", "page_gap_out_of_range", "content_between_tables", "right_header_orphan_starts_next_table", "require_same_width",
    "width_difference_too_large", "headerless_no_signal", "header_similarity_strict_disjoint_tokens", "header_similarity_too_low",
)
REPAIRS = ("orphans", "orphans+layout")


# What decisions read of a fragment.
_COMPARED = (
    "idx", "place", "start_page", "width", "row_count", "is_headerless", "is_header_orphan", "is_data_orphan", "header_tokens", "first_row_tokens", "vert_top", "vert_bottom",
    "content_before", "first_cell",
)


def layout_continues(a: Column, b: Column, cfg: StitchConfig) -> Column:
    """The left fragment ends low on its page and the right one begins high; unknown positions: no."""
    if not cfg.use_layout_hint:
        return F.lit(False)
    return F.coalesce((a["vert_bottom"] >= cfg.bottom_band_min) & (b["vert_top"] <= cfg.top_band_max), F.lit(False))


def is_spillover(a: Column, b: Column, cfg: StitchConfig) -> Column:
    """A single column without header on the very next page, after a wider table."""
    shape = b["is_headerless"] & (b["width"] == 1) & (a["width"] > 1) & (b["start_page"] - a["start_page"] == 1)
    if cfg.spillover_require_content_check:
        cell = F.coalesce(b["first_cell"], F.lit(""))
        low = F.lower(cell)
        shape = shape & (b["row_count"] > 0) & (low.contains("http") | low.contains("://") | cell.rlike(r"[A-Z]+-(?U:\d)+") | (b["row_count"] <= 2))
    return F.coalesce(shape, F.lit(False))


def placed(fragments: DataFrame) -> DataFrame:
    """fragments with `place`, the number of the document's extracted tables with a smaller idx."""
    return fragments.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1)


def any_missing(a: Column, b: Column) -> Column:
    """Whether a table number strictly between those of two placed fragments wasn't extracted. No list of a document's numbers
    is attached to its fragments: fewer places than numbers lie between."""
    return F.abs(b["idx"] - a["idx"]) > F.abs(b["place"] - a["place"])


def missing_numbers(fragments: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, seq, left_idx, right_idx; left below right) -> doc_id, seq, missing: the numbers between that weren't
    extracted, ascending. A document's gaps are numbered in order; those between two fragments are a run of these numbers, so a
    pair meets its own gaps only."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    fragments = fragments.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    f = fragments.select("doc_id", "idx", F.lag("idx").over(order).alias("lo"))
    f = f.withColumn("gap", F.sum(F.coalesce((F.col("idx") - F.col("lo") > 1).cast("int"), F.lit(0))).over(order))
    end = lambda side: f.select("doc_id", F.col("idx").alias(f"{side}_idx"), F.col("gap").alias(f"{side}_gap"))
    p = pairs.join(end("left"), ["doc_id", "left_idx"]).join(end("right"), ["doc_id", "right_idx"]).where("right_gap > left_gap")
    p = p.select("doc_id", "seq", F.explode(F.sequence(F.col("left_gap") + 1, F.col("right_gap"))).alias("gap"))
    hit = p.join(f.where("idx - lo > 1"), ["doc_id", "gap"])
    return hit.groupBy("doc_id", "seq").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lo", "idx"))), lambda g: F.sequence(g["lo"] + 1, g["idx"] - 1))).alias("missing"))


def signals(a: Column, b: Column, cfg: StitchConfig) -> Column:
    both = [("page", "start_page"), ("width", "width"), ("headerless", "is_headerless"), ("header_orphan", "is_header_orphan"), ("data_orphan", "is_data_orphan")]
    cols = {f"{side}_{n}": f[c] for n, c in both for side, f in (("left", a), ("right", b))}
    cols["page_gap"] = b["start_page"] - a["start_page"]
    cols["width_diff"] = F.abs(a["width"] - b["width"])
    cols["header_similarity"] = text.jaccard(a["header_tokens"], b["header_tokens"])
    cols["row_similarity"] = text.jaccard(a["first_row_tokens"], b["first_row_tokens"])
    cols["layout_continuation"] = layout_continues(a, b, cfg)
    names = ("left_page", "right_page", "page_gap", "left_width", "right_width", "width_diff", "left_headerless", "right_headerless", "left_header_orphan", "right_header_orphan", "left_data_orphan", "right_data_orphan", "header_similarity", "row_similarity", "layout_continuation")
    return F.struct(*[cols[n].alias(n) for n in names])


def reason(a: Column, b: Column, said: Column, cfg: StitchConfig) -> Column:
    """The first rule that applies, from the fragments and their signals."""
    gap, wd, layout, header, rows = (said[c] for c in ("page_gap", "width_diff", "layout_continuation", "header_similarity", "row_similarity"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    headerless, strict = yes(b["is_headerless"]), header >= F.lit(float(cfg.header_sim_strict))
    case = F.when((b["idx"] > a["idx"]) & any_missing(a, b), "unextracted_table_between").when(gap.isNull(), "missing_page")
    case = case.when((gap < 1) | (gap > cfg.max_page_gap), "page_gap_out_of_range")
    if cfg.block_on_intervening_content:
        case = case.when(yes(b["content_before"]), "content_between_tables")
    case = case.when(is_spillover(a, b, cfg), "spillover").when(yes(b["is_header_orphan"]), "right_header_orphan_starts_next_table")
    if cfg.require_same_width:
        case = case.when(wd > 0, "require_same_width")
    return (
        case.when(wd > cfg.max_width_difference, "width_difference_too_large")
        .when(yes(a["is_header_orphan"]) & headerless, "header_orphan_to_headerless")
        .when(headerless & (wd == 0) & (~yes(a["is_headerless"]) | layout), "headerless_width_match")
        .when(headerless & (wd <= cfg.headerless_width_tolerance) & layout, "headerless_width_drift_layout")
        .when(headerless & (rows >= F.lit(float(cfg.row_sim_threshold))), "row_similarity")
        .when(headerless, "headerless_no_signal")
        .when(strict & text.both_have_own(a["header_tokens"], b["header_tokens"]) & ~layout, "header_similarity_strict_disjoint_tokens")
        .when(strict, "header_similarity_strict")
        .when((header >= F.lit(float(cfg.header_sim_loose))) & layout, "header_similarity_loose_layout")
        .otherwise("header_similarity_too_low")
    )


def _neighbours(fragments: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, page0, idx, keep, seq, a, b: each fragment (b) with its predecessor in document order (a), both placed. Only what
    decisions read is in a and b. page0 and idx are the order, so later windows over it need no sort."""
    order = Window.partitionBy("doc_id").orderBy("page0", "idx")
    f = placed(fragments).withColumn("page0", F.coalesce("start_page", F.lit(0)))
    f = f.select("doc_id", "page0", "idx", *keep, F.struct(*[c for c in f.columns if c in _COMPARED]).alias("b"))
    return f.withColumns({"a": F.lag("b").over(order), "seq": F.row_number().over(order) - 1})


def neighbours(fragments: DataFrame) -> DataFrame:
    """Each fragment (b) with its predecessor in document order (a), both placed."""
    return _neighbours(fragments, []).select("doc_id", "seq", "a", "b")


def _decided(fragments: DataFrame, cfg: StitchConfig, keep: list[str]) -> DataFrame:
    """_neighbours() with left_idx, signals, reason, merged, near (the numbers missing between two that are next to each other by
    place) and far (whether numbers are missing between others); a document's first fragment has no left_idx and no reason."""
    a, b = F.col("a"), F.col("b")
    missing, next_to = (b["idx"] > a["idx"]) & any_missing(a, b), b["place"] - a["place"] == 1
    d = _neighbours(fragments, keep).withColumn("signals", F.when(a.isNotNull(), signals(a, b, cfg)))
    d = d.withColumn("left_idx", a["idx"]).withColumn("reason", F.when(a.isNotNull(), reason(a, b, F.col("signals"), cfg)))
    d = d.withColumn("merged", F.coalesce(F.col("reason").isin(*MERGING), F.lit(False)))
    return d.withColumn("near", F.when(missing & next_to, F.sequence(a["idx"] + 1, b["idx"] - 1))).withColumn("far", F.coalesce(missing & ~next_to, F.lit(False)))


def decisions(fragments: DataFrame, cfg: StitchConfig) -> DataFrame:
    """A row per fragment: the decision on it and its predecessor, its island (runs of fragments that first-pass decisions join) and
    what later steps need of the fragment, so that they don't meet the fragments again. Tokens stay with orphans only."""
    orphan = F.col("is_header_orphan") | F.col("is_data_orphan")
    d = _decided(fragments, cfg, ["pos", "start_page", "pages", "width", "columns", "row_count", "is_header_orphan", "is_data_orphan", "continuation_content"])
    d = d.withColumn("island", F.sum(F.when(F.col("merged"), 0).otherwise(1)).over(Window.partitionBy("doc_id").orderBy("page0", "idx")).cast("int"))
    own = [F.col(f"b.{c}").alias(c) for c in ("place", "is_headerless", "vert_top", "vert_bottom", "content_before")]
    return d.select("*", *own, *[F.when(orphan, F.col(f"b.{c}")).alias(c) for c in ("header_tokens", "first_row_tokens")]).drop("a", "b")


def missing_between(decided: DataFrame) -> DataFrame | None:
    """doc_id, seq, missing of the pairs whose missing numbers stand elsewhere in the document; None where there are none."""
    far = decided.where("far").select("doc_id", "seq", "left_idx", F.col("idx").alias("right_idx"))
    return written(missing_numbers(decided.select("doc_id", "idx"), far), "gaps") if far.head(1) else None


def told(decided: DataFrame, gaps: DataFrame | None) -> DataFrame:
    """decided with its warnings."""
    if gaps is not None:
        decided = decided.join(gaps, ["doc_id", "seq"], "left").withColumn("near", F.coalesce("near", "missing")).drop("missing")
    said = F.concat(F.lit("tables "), F.array_join(F.col("near").cast("array<string>"), ", "), F.lit(" lie between the two and were not read"))
    return decided.withColumn("warnings", F.when(F.col("near").isNotNull(), F.array(said)).otherwise(F.array().cast("array<string>"))).drop("near")


def pairs_of(told_: DataFrame) -> DataFrame:
    p = told_.where("left_idx is not null")
    return p.select("doc_id", F.lit(1).alias("pass_no"), "seq", "left_idx", F.col("idx").alias("right_idx"), "merged", "reason", "signals", "warnings")


def decide_pairs(fragments: DataFrame, cfg: StitchConfig) -> DataFrame:
    """doc_id, pass_no 1, seq, left_idx, right_idx, merged, reason, signals, warnings: a row per neighbouring pair. All numbers
    between two that are next to each other by place are missing; only other pairs with gaps, found by numbers and pages alone,
    meet the document's, so pairs are decided once and don't move for their warnings."""
    a, b = F.col("a"), F.col("b")
    far = (b["idx"] > a["idx"]) & any_missing(a, b) & (b["place"] - a["place"] != 1)
    bare = neighbours(fragments.select("doc_id", "idx", "start_page")).where("a is not null")
    bare = written(bare.select("doc_id", "seq", a["idx"].alias("left_idx"), b["idx"].alias("idx"), far.alias("far")).where("far"), "far")
    gaps = written(missing_numbers(fragments, bare.withColumnRenamed("idx", "right_idx")), "gaps") if bare.head(1) else None
    return pairs_of(told(_decided(fragments, cfg, []), gaps))


_ORPHAN = ["doc_id", "idx", "place", "pos", "start_page", "width", "vert_bottom", "vert_top", "is_headerless", "is_header_orphan", "is_data_orphan", "header_tokens", "first_row_tokens", "content_before", "island"]


def orphan_edges(fragments: DataFrame, member: DataFrame, cfg: StitchConfig) -> DataFrame:
    """Candidate repairs: a header orphan and a data orphan up to max_page_gap pages later, in different islands. Both sides are
    filtered to orphans, and meet by page: a header orphan is sent to each page that it reaches."""
    orphan = "(is_header_orphan or is_data_orphan) and start_page is not null"
    f = fragments.where(orphan).join(placed(fragments.select("doc_id", "idx")), ["doc_id", "idx"]).join(member, ["doc_id", "idx"])
    return orphan_pairs(fragments, written(f.select(_ORPHAN), "orphans"), cfg)


def orphan_edges_of(decided: DataFrame, cfg: StitchConfig) -> DataFrame:
    """orphan_edges() of decisions()."""
    return orphan_pairs(decided, decided.where("(is_header_orphan or is_data_orphan) and start_page is not null").select(_ORPHAN), cfg)


def orphan_pairs(fragments: DataFrame, f: DataFrame, cfg: StitchConfig) -> DataFrame:
    """The candidates among the orphans f, which are placed and know their island."""
    pages = fragments.where("start_page is not null").groupBy("doc_id", F.col("start_page").alias("page")).agg(F.min("pos").alias("page_pos"))
    side = lambda name, flag: f.where(flag).select("doc_id", F.struct(*_ORPHAN[1:]).alias(name))
    a, b = F.col("a"), F.col("b")
    reached = side("a", "is_header_orphan").where(F.lit(cfg.max_page_gap >= 1)).withColumn("at", F.explode(F.sequence(a["start_page"] + 1, a["start_page"] + cfg.max_page_gap)))
    e = reached.join(side("b", "is_data_orphan").withColumn("at", b["start_page"]), ["doc_id", "at"]).drop("at")
    e = e.where((F.abs(a["width"] - b["width"]) <= cfg.max_width_difference) & (a["island"] != b["island"]))
    if cfg.block_on_intervening_content:
        e = e.where(~F.coalesce(b["content_before"], F.lit(False)))
    e = e.where(~any_missing(a, b))
    e = e.withColumn("page", a["start_page"]).join(pages, ["doc_id", "page"])
    why = F.when(layout_continues(a, b, cfg), "orphans+layout").otherwise("orphans")
    return e.select("doc_id", "page_pos", (b["start_page"] - a["start_page"]).alias("off"), a["pos"].alias("left_pos"), b["pos"].alias("right_pos"), a["idx"].alias("left_idx"), b["idx"].alias("right_idx"), a["island"].alias("left_island"), b["island"].alias("right_island"), why.alias("reason"), signals(a, b, cfg).alias("signals"))


def _contracted(picks: DataFrame) -> DataFrame:
    """picks (doc_id, node, seq, other: a node's least edge and its end) -> doc_id, node, root. Edges have distinct numbers, so the
    picks form trees but for pairs that picked the same edge, whose smaller node is the root; paths are halved until all end there."""
    back = picks.select("doc_id", F.col("node").alias("other"), F.col("seq").alias("seq_back"))
    same = F.coalesce(F.col("seq") == F.col("seq_back"), F.lit(False)) & (F.col("node") < F.col("other"))
    up = written(picks.join(back, ["doc_id", "other"], "left").select("doc_id", "node", F.when(same, F.col("node")).otherwise(F.col("other")).alias("root")), "parents")
    while True:
        above = up.select("doc_id", F.col("node").alias("root"), F.col("root").alias("top"))
        moved = up.join(above, ["doc_id", "root"])
        if not moved.where("root <> top").head(1):
            return up
        up = written(moved.select("doc_id", "node", F.col("top").alias("root")), "parents")


def repair(edges: DataFrame) -> DataFrame:
    """Takes candidate edges in scan order, each only if its ends aren't joined yet. doc_id, seq, left_idx, right_idx, taken,
    and the final root of both ends' islands, the least of those joined.

    The edges taken are the one spanning forest of least edges by scan order, so it is found in rounds over all documents at once:
    each component takes its least edge to another, and what these join becomes one. Every round at least halves the components
    that have an edge left.
    """
    scan = Window.partitionBy("doc_id").orderBy("page_pos", "off", "left_pos", "right_pos")
    e = written(edges.select("doc_id", (F.row_number().over(scan) - 1).alias("seq"), "left_idx", "right_idx", "left_island", "right_island"), "scan")
    names = e.select("doc_id", F.explode(F.array("left_island", "right_island")).alias("island")).distinct().withColumn("comp", F.col("island"))
    open_ = e.select("doc_id", "seq", F.col("left_island").alias("a"), F.col("right_island").alias("b")).where("a <> b")
    taken = None
    while open_.head(1):
        ends = open_.select("doc_id", F.col("a").alias("node"), "seq", F.col("b").alias("other")).unionByName(open_.select("doc_id", F.col("b").alias("node"), "seq", F.col("a").alias("other")))
        picks = written(ends.groupBy("doc_id", "node").agg(F.min(F.struct("seq", "other")).alias("p")).select("doc_id", "node", "p.*"), "picks")
        new = picks.select("doc_id", "seq").distinct()
        taken = new if taken is None else taken.unionByName(new)
        root = _contracted(picks)
        renamed = lambda df, c, root=root: df.join(root.select("doc_id", F.col("node").alias(c), "root"), ["doc_id", c], "left").withColumn(c, F.coalesce("root", c)).drop("root")
        names = written(renamed(names, "comp"), "names")
        open_ = written(renamed(renamed(open_, "a"), "b").where("a <> b").select("doc_id", "seq", "a", "b"), "open")
    least = names.select("doc_id", F.col("island").alias("left_island"), F.min("island").over(Window.partitionBy("doc_id", "comp")).alias("root"))
    marked = e.withColumn("taken", F.lit(False)) if taken is None else e.join(taken.withColumn("hit", F.lit(True)), ["doc_id", "seq"], "left").withColumn("taken", F.coalesce("hit", F.lit(False)))
    return marked.join(least, ["doc_id", "left_island"]).select("doc_id", "seq", "left_idx", "right_idx", "left_island", "right_island", "taken", "root")


def groups(told_: DataFrame, repaired: DataFrame, second: DataFrame, sizes: DataFrame | None = None, more_windows=None) -> DataFrame:
    """told() with comp (the fragments of one comp are one table), rank (place among its members, 0-based), logical_index, trace (the
    decision on the fragment and its predecessor, if both lie in one table) and more (second-pass decisions that attach it).

    Fragments move once, dealt by document, and all windows are over documents or tables of theirs. What repairs say of few islands
    and fragments joins before that; sizes (doc_id, idx, n_rows, last_pos, blank) are dealt with the fragments and meet them in a
    window, as a join on both keys would deal all fragments anew. more_windows gives columns over the order within a table, which
    share its pass."""
    ends = repaired.select("doc_id", F.col("left_island").alias("island"), "root").unionByName(repaired.select("doc_id", F.col("right_island").alias("island"), "root"))
    moved = ends.groupBy("doc_id", "island").agg(F.min("root").alias("root"))
    # whether an island's first fragment is in one table with the fragment before it, which ends the island before
    order = Window.partitionBy("doc_id").orderBy("island")
    before = F.when(F.lag("island").over(order) == F.col("island") - 1, F.lag("root").over(order)).otherwise(F.col("island") - 1)
    moved = moved.withColumn("rejoined", F.col("root") == before)
    one = F.struct("pass_no", "seq", "left_idx", "right_idx", "merged", "reason", "signals", "warnings")
    more = second.groupBy("doc_id", F.col("right_idx").alias("idx")).agg(F.collect_list(one).alias("more"))
    f = told_.join(moved, ["doc_id", "island"], "left").join(more, ["doc_id", "idx"], "left")
    f = f.withColumn("comp", F.coalesce("root", "island")).withColumn("pass_no", F.lit(1)).withColumn("right_idx", F.col("idx"))
    f = f.withColumn("trace", F.when(F.col("merged") | F.coalesce("rejoined", F.lit(False)), one))
    f = f.withColumn("is_spill", F.coalesce(F.col("reason") == "spillover", F.lit(False)))
    f = f.drop("root", "rejoined", "pass_no", "right_idx", "signals", "warnings", "left_idx", "seq", "merged", "reason", "far", "island")
    if sizes is None:
        f = f.repartition("doc_id")
    else:
        own = Window.partitionBy("doc_id", "idx")
        f = f.unionByName(sizes.where("doc_id is not null and idx is not null"), allowMissingColumns=True).repartition("doc_id")
        f = f.withColumns({c: F.max(c).over(own) for c in sizes.columns if c not in ("doc_id", "idx")}).where("place is not null")
    order = Window.partitionBy("doc_id", "comp").orderBy("page0", "idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return f.withColumns({"rank": (F.row_number().over(order) - 1).cast("int"), "first": F.min("pos").over(whole)} | (more_windows(order) if more_windows else {}))


def numbered(grouped: DataFrame) -> DataFrame:
    """groups() with logical_index: tables by the place of their first member. Last, as it needs another order."""
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")) - 1
    return grouped.withColumn("logical_index", number.cast("int")).drop("first")
