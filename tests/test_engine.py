"""Decisions and rebuilding on hand-made fragments, through the public functions."""

import pytest
from pyspark.sql import functions as F

from pagespan import StitchConfig, StitchError, Stitcher, extract_fragments, merge_fragments, stitch_documents
from pagespan.functions import text
from pagespan.schema import FRAGMENT_ROWS, RAW_TABLES


def fragment(idx, columns, rows, page=1, **k):
    return {"idx": idx, "columns": columns, "rows": rows, "page": page} | k


def frames(spark, docs):
    """docs: {doc_id: [fragment, ...]} -> (fragments, rows), tokens derived as extraction does."""
    meta, rows = [], []
    for doc, fs in docs.items():
        for pos, f in enumerate(fs):
            meta.append((doc, f["idx"], pos, f["page"], [] if f["page"] is None else [f["page"]], len(f["columns"]), f["columns"], " ".join(f["columns"]), " ".join(f["rows"][0]) if f["rows"] else "", f.get("top"), f.get("bottom"),
                         f.get("headerless", False), f.get("header_orphan", False), f.get("data_orphan", False), len(f["rows"]), f.get("cont", []), f.get("before"), f["rows"][0][0] if f["rows"] else None))
            rows += [(doc, f["idx"], i, r) for i, r in enumerate(f["rows"])]
    schema = "doc_id string, idx int, pos int, start_page int, pages array<int>, width int, columns array<string>, h string, r string, vert_top double, vert_bottom double, is_headerless boolean, is_header_orphan boolean, is_data_orphan boolean, row_count int, continuation_content array<struct<col_idx:int,value:string>>, content_before boolean, first_cell string"
    m = spark.createDataFrame(meta, schema).withColumns({"header_tokens": text.tokens(F.col("h")), "first_row_tokens": text.tokens(F.col("r")), "vert_center": F.lit(None).cast("double"), "numeric_like_cols": F.lit(False)}).drop("h", "r")
    return m, spark.createDataFrame(rows, FRAGMENT_ROWS)


def run(spark, docs, **cfg):
    out = merge_fragments(*frames(spark, docs), StitchConfig(**cfg))
    tables = {}
    for t in out.tables.collect():
        tables.setdefault(t.doc_id, {})[t.logical_index] = t
    rows = {}
    for r in out.rows.orderBy("doc_id", "logical_index", "row_pos").collect():
        rows.setdefault((r.doc_id, r.logical_index), []).append(r.cells)
    return tables, rows, out


A = ["name", "dose", "unit"]


def test_decisions_and_reasons(spark):
    hl = {"headerless": True}
    docs = {
        "same": [fragment(0, A, [["a", "1", "x"]]), fragment(1, A, [["b", "2", "y"]], 2)],
        "gap_idx": [fragment(0, A, [["a", "1", "x"]]), fragment(5, ["c0", "c1", "c2"], [["b", "2", "y"]], 2, **hl)],
        "pages": [fragment(0, A, [["a", "1", "x"]]), fragment(1, A, [["b", "2", "y"]], 4)],
        "nopage": [fragment(0, A, [["a", "1", "x"]]), fragment(1, A, [["b", "2", "y"]], None)],
        "before": [fragment(0, A, [["a", "1", "x"]]), fragment(1, A, [["b", "2", "y"]], 2, before=True)],
        "headerless": [fragment(0, A, [["a", "1", "x"]]), fragment(1, ["c0", "c1", "c2"], [["b", "2", "y"]], 2, **hl)],
        "drift": [fragment(0, A, [["a", "1", "x"]], 1, bottom=0.9), fragment(1, ["c0", "c1", "c2", "c3"], [["b", "2", "y", "z"]], 2, top=0.1, **hl)],
        "spill": [fragment(0, A, [["a", "1", "x "]]), fragment(1, ["c0"], [["more"], [" "], ["text"]], 2, **hl)],
        "strict": [fragment(0, ["drug name", "patient age sex", "dose"], [["a", "1", "x"]]), fragment(1, ["drug name", "patient age sex", "time"], [["b", "2", "y"]], 2)],
        "loose": [fragment(0, ["a", "b", "c", "d"], [["1", "1", "1", "1"]], 1, bottom=0.9), fragment(1, ["a", "b", "e", "f"], [["1", "1", "1", "1"]], 2, top=0.2)],
        "wide": [fragment(0, A, [["a", "1", "x"]]), fragment(1, [f"x{i}" for i in range(9)], [list("123456789")], 2)],
        "chain": [fragment(i, A if i == 0 else ["c0", "c1", "c2"], [[str(i), "1", "x"]], i + 1, headerless=i > 0, top=0.1, bottom=0.9) for i in range(3)],
        "repair": [fragment(0, A, [], 1, header_orphan=True), fragment(1, ["q"], [["zzz"]], 1), fragment(2, ["u", "v", "w"], [["b", "2", "y"]], 2, data_orphan=True)],
    }
    tables, rows, out = run(spark, docs)
    reason = {}
    for p in out.pairs.orderBy("doc_id", "pass_no", "seq").collect():
        reason.setdefault(p.doc_id, []).append(p.reason)
    assert reason["same"] == ["header_similarity_strict"] and reason["gap_idx"] == ["unextracted_table_between"] and reason["pages"] == ["page_gap_out_of_range"]
    assert reason["nopage"] == ["missing_page"] and reason["before"] == ["content_between_tables"] and reason["headerless"] == ["headerless_width_match"]
    assert reason["drift"] == ["headerless_width_drift_layout"] and reason["spill"] == ["spillover"] and reason["strict"] == ["header_similarity_strict_disjoint_tokens"]
    assert reason["loose"] == ["header_similarity_loose_layout"] and reason["wide"] == ["width_difference_too_large"] and reason["chain"] == ["headerless_width_match"] * 2
    assert reason["repair"][-1] == "orphans" and tables["repair"][0].members == [0, 2] and tables["repair"][0].columns == A
    assert tables["same"][0].members == [0, 1] and tables["same"][0].pages == [1, 2] and rows["same", 0] == [["a", "1", "x"], ["b", "2", "y"]]
    assert len(tables["gap_idx"]) == 2 and tables["gap_idx"][0].is_single
    assert tables["drift"][0].columns[-1] == "_extra_0_c3" and rows["drift", 0] == [["a", "1", "x", ""], ["b", "2", "y", "z"]]
    assert rows["spill", 0] == [["a", "1", "x\nmore\ntext"]] and tables["spill"][0].pages == [1, 2]
    assert tables["chain"][0].merge_reason == "headerless_width_match+headerless_width_match" and len(tables["chain"][0].traces) == 2
    assert {r.doc_id: r.merged_tables for r in out.metrics().collect()}["same"] == 1


def test_missing_numbers_when_pages_and_numbers_disagree(spark):
    docs = {"d": [fragment(i, A, [["a", "1", "x"]], page) for page, i in enumerate((0, 7, 3, 10, 11), 1)]}
    _, _, out = run(spark, docs)
    got = [(p.left_idx, p.right_idx, p.reason, p.warnings) for p in out.pairs.orderBy("seq").collect()]
    say = lambda *n: [f"tables {', '.join(map(str, n))} lie between the two and were not read"]
    assert got == [
        (0, 7, "unextracted_table_between", say(1, 2, 4, 5, 6)), (7, 3, "header_similarity_strict", []), (3, 10, "unextracted_table_between", say(4, 5, 6, 8, 9)), (10, 11, "header_similarity_strict", []),
    ]


def test_rows_fold_across_fragments_as_a_plain_loop_does(spark):
    import random

    rnd = random.Random(4)
    docs, want = {}, {}
    for d in range(25):
        rows = [[[rnd.choice(["", "", " x ", "http://u", "word"]) for _ in range(3)] for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(2, 5))]
        docs[f"d{d:02}"] = [fragment(p, A, r, p + 1) for p, r in enumerate(rows)]
        out = []
        for r in [r for page in rows for r in page]:
            full = [i for i, c in enumerate(r) if c.strip()]
            if out and len(full) == 1 and full[0] > 0:
                v = r[full[0]].strip()
                at = 2 if v.startswith("http") else full[0]
                out[-1][at] = out[-1][at].rstrip() + "\n" + v if out[-1][at].strip() else v
            else:
                out.append(list(r))
        want[f"d{d:02}", 0] = out
    tables, rows, _ = run(spark, docs)
    assert rows == want and all(len(t) == 1 for t in tables.values())


def test_overflow_policies(spark):
    docs = {"d": [fragment(0, ["a", "b"], [["1", "x"]], 1, bottom=0.9), fragment(1, ["c0", "c1", "c2"], [["2", "y ", " z "], ["3", "", "w"]], 2, headerless=True, top=0.1)]}
    tables, rows, _ = run(spark, docs, width_overflow_policy="warn_drop")
    assert rows["d", 0] == [["1", "x"], ["2", "y "], ["3", ""]] and tables["d"][0].warnings == ["table 1 (page 2) has 3 columns where 2 fit; cut: c2"]
    assert run(spark, docs, width_overflow_policy="merge_tail")[1]["d", 0] == [["1", "x"], ["2", "y\nz"], ["3", "w"]]
    with pytest.raises(ValueError, match="has 3 columns where 2 fit; too many: c2"):
        run(spark, docs, width_overflow_policy="fail")
    with pytest.raises(ValueError, match="width_overflow_policy"):
        run(spark, docs, width_overflow_policy="no")


def test_continuation_split_cells_and_orphans(spark):
    hl = {"headerless": True}
    docs = {
        "cont": [fragment(0, ["a", "b"], [["1", "x"], ["2", ""]]), fragment(1, ["c0", "c1"], [["3", "y"]], 2, cont=[(0, "more"), (1, "lost")], **hl)],
        "split": [fragment(0, ["id", "content", "z"], [["1", "x ", "p"]]), fragment(1, ["c0", "c1", "c2"], [["", " tail", ""], ["", "", "http://u"], ["cat", "", ""]], 2, **hl)],
        "orphan": [fragment(0, ["k", "l"], [["Name", "Unit"]], 1, header_orphan=True), fragment(1, ["c0", "c1", "c2"], [["1", "x", "e"]], 2, cont=[(1, "of it")], **hl)],
        "single": [fragment(0, ["Q.q", "b"], [["", "x"], ["", "y"]])],
    }
    tables, rows, _ = run(spark, docs)
    assert rows["cont", 0] == [["1", "x"], ["2\nmore", ""], ["3", "y"]]
    assert rows["split", 0] == [["1", "x\ntail\nhttp://u", "p"], ["cat", "", ""]]
    assert tables["orphan"][0].columns == ["Name", "Unit of it", "col_2"] and rows["orphan", 0] == [["1", "x", "e"]]
    assert tables["single"][0].columns == ["Q", "b"] and rows["single", 0] == [["", "x"], ["", "y"]]


def test_extraction(spark):
    box = lambda p, t, b: (p, (0.0, t, 1.0, b, "BOTTOMLEFT"))
    raw = [
        ("d", 0, [["Name", "Value.Value", ""], [" ", "", ""], ["a", "1", "x"], ["b", "2"]], [box(1, 700.0, 100.0)], {1: 1000.0}, None),
        ("d", 1, [["", "over", "flow", "", ""], ["1", "2", "3", "4", "5"]], [box(2, 900.0, 500.0)], {1: 1000.0}, True),
        ("d", 2, [["2020", "2021"], ["some text", "other text"]], [], None, None),
        ("d", 3, [["", " "]], [box(3, 10.0, 5.0)], {}, None),
        ("d", 4, None, None, None, None),
        ("d", 5, [["DATA", "N/A", "word"], ["x", "y", "z"]], [], None, None),
    ]
    f, rows = extract_fragments(spark.createDataFrame(raw, RAW_TABLES))
    got = {r.idx: r for r in f.collect()}
    r = {}
    for x in rows.orderBy("idx", "row_pos").collect():
        r.setdefault(x.idx, []).append(x.cells)
    assert got[0].columns == ["Name", "Value", "Column_2"] and r[0] == [["a", "1", "x"], ["b", "2", ""]] and not got[0].is_headerless
    assert round(got[0].vert_top, 3) == 0.3 and round(got[0].vert_bottom, 3) == 0.9
    assert got[1].is_headerless and [tuple(c) for c in got[1].continuation_content] == [(1, "over"), (2, "flow")] and r[1] == [["1", "2", "3", "4", "5"]] and got[1].content_before
    assert not got[2].is_headerless and got[2].columns == ["2020", "2021"] and got[2].start_page is None
    assert got[3].row_count == 0 and got[3].columns == ["Column_0", "Column_1"] and not got[3].is_headerless
    assert got[4].width == 0 and got[4].row_count == 0
    assert got[5].is_headerless and got[5].row_count == 2


def test_tokens(spark):
    cases = {"Hello World-2": {"hello", "world"}, "漢字 ab": {"漢", "字", "ab"}, "カナ": {"カ", "ナ"}, "한국": {"한", "국"}, "⼀": {"⼀"}, "กข๑": {"ก", "ข", "๑"}, "مرحبا": {"مرحبا"}, "": set()}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.tokens(F.col("s")).alias("t"))
    assert {r.s: set(r.t) for r in df.collect()} == cases


def test_failures_and_configuration(spark):
    bad = StitchConfig(max_page_gap=0, header_sim_strict=2.0, width_overflow_policy="x")
    assert len(bad.problems()) == 3
    raw = spark.createDataFrame([], RAW_TABLES)
    assert stitch_documents(raw, bad) is raw
    with pytest.raises(ValueError):
        stitch_documents(raw, bad, raise_on_error=True)
    assert stitch_documents(raw).tables.count() == 0

    def broken(_):
        raise RuntimeError("no")

    assert Stitcher(extract=broken).stitch(raw) is raw
    with pytest.raises(StitchError):
        Stitcher(extract=broken).stitch(raw, raise_on_error=True)


def test_stream_equals_batch(spark, tmp_path):
    from pagespan.streaming.batches import stitch_stream

    raw = spark.createDataFrame([("d", 0, [["n", "v"], ["a", "1"]], [(1, None)], None, None), ("d", 1, [["n", "v"], ["b", "2"]], [(2, None)], None, None)], RAW_TABLES)
    raw.write.parquet(f"{tmp_path}/in")
    stitch_stream(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert [r.members for r in spark.read.parquet(f"{tmp_path}/out/tables").collect()] == [[0, 1]]


def test_queries_match_their_sql(spark, monkeypatch):
    from functools import cache

    import duckdb
    import pandas as pd

    from pagespan.plans import oracles, queries

    for name in ("_merged", "decide_all", "_documents"):  # a merge of one configuration serves all queries here
        monkeypatch.setattr(queries, name, cache(getattr(queries, name)))
    fragments = cache(queries.demo.demo_fragments)
    monkeypatch.setattr(queries.demo, "demo_fragments", fragments)
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "part", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in oracles.oracle_sql().items():
        own = queries.queries()[name](spark, d).toPandas()
        their = con.execute(sql).fetchdf()
        cols = sorted(their.columns)
        assert sorted(own.columns) == cols, name
        key = lambda df: sorted(tuple("None" if pd.isna(v) else str(int(v) if isinstance(v, float) and v == int(v) else v) for v in row) for row in df[cols].astype(object).values.tolist())
        assert key(own) == key(their), name


def plain_forest(edges):
    """Edges (left, right) in scan order, each taken if its ends aren't joined yet; the least island of each group."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    taken = []
    for a, b in edges:
        a, b = find(a), find(b)
        taken.append(a != b)
        root[max(a, b)] = min(a, b)
    return taken, {x: find(x) for x in list(root)}


def test_forest_equals_a_plain_loop(spark):
    import random

    from pagespan.operators import decide

    rnd = random.Random(5)
    docs = {f"r{d}": [tuple(rnd.sample(range(n), 2)) for _ in range(m)] for d, (n, m) in enumerate([(2, 1), (3, 5), (12, 9), (40, 30), (40, 60), (300, 280), (60, 400)])}
    docs["chain"] = [(i, i + 1) for i in range(200)]
    docs["back"] = [(i, i + 1) for i in reversed(range(150))]
    docs["star"] = [(0, i) for i in range(1, 400)]
    docs["itself"] = [(4, 4), (4, 5), (5, 4)]
    rows = [(d, 0, i, 0, 0, i, i, a, b) for d, es in docs.items() for i, (a, b) in enumerate(es)]
    rnd.shuffle(rows)
    edges = spark.createDataFrame(rows, "doc_id string, page_pos int, off int, left_pos int, right_pos int, left_idx int, right_idx int, left_island int, right_island int")
    edges = edges.withColumn("page_pos", F.col("left_idx"))
    out = decide.repair(edges)
    got = {}
    for r in out.orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.left_island, r.right_island, r.taken, r.root))
    for d, es in docs.items():
        taken, root = plain_forest(es)
        assert got[d] == [(a, b, t, root[a]) for (a, b), t in zip(es, taken, strict=True)], d
    assert "Python" not in out._jdf.queryExecution().toString() and "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert decide.repair(edges.limit(0)).count() == 0


def test_many_orphans_in_one_document(spark):
    """A header orphan and a data orphan on every page: as many candidates as pages, whatever their square."""
    import time

    from pagespan.operators import decide

    n = 20_000
    f = spark.range(2 * n).select(
        F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("idx"), F.col("id").cast("int").alias("pos"), (F.floor(F.col("id") / 2) + 1).cast("int").alias("start_page"), F.lit(2).alias("width"),
        F.lit(None).cast("double").alias("vert_top"), F.lit(None).cast("double").alias("vert_bottom"), F.lit(False).alias("is_headerless"), (F.col("id") % 2 == 1).alias("is_header_orphan"), (F.col("id") % 2 == 0).alias("is_data_orphan"),
        F.array(F.lit("x")).alias("header_tokens"), F.array(F.lit("y")).alias("first_row_tokens"), F.lit(None).cast("boolean").alias("content_before"),
    )
    began = time.time()
    e = decide.orphan_edges(f, f.select("doc_id", "idx", F.col("idx").alias("island")), StitchConfig())
    assert e.count() == n - 1 and time.time() - began < 60
    gaps = f.where("idx % 3 <> 1")
    pairs = gaps.select("doc_id", F.col("idx").alias("seq"), F.col("idx").alias("left_idx"), (F.col("idx") + 2).alias("right_idx")).where("idx % 3 = 0 and idx + 2 < 40000")
    assert decide.missing_numbers(gaps, pairs).where("missing = array(seq + 1)").count() == pairs.count() and time.time() - began < 90
