"""Documents that come back: pass-through, write-back, malformed tables, spanning cells, names by folder, and the atomic sink."""

import json
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagespan import Stitcher, extract_fragments, merge_fragments
from pagespan.operators import document, spans
from pagespan.plans.engine import stitch_snapshots
from pagespan.sources import export, foreign, sink, snapshot
from pagespan.sources.snapshot import SnapshotAdapter


def cell(text, head=False, side=False, **more):
    return {"text": text, "row_span": 1, "col_span": 1, "column_header": head, "row_header": side} | more


def table(i, rows, page, heads=1, **more):
    grid = [[cell(c, r < heads, j == 0 and r >= heads, font="f") for j, c in enumerate(row)] for r, row in enumerate(rows)]
    prov = [{"page_no": page, "bbox": {"l": 0, "t": 700, "r": 1, "b": 50, "coord_origin": "BOTTOMLEFT"}, "charspan": [0, i]}]
    return {"self_ref": f"#/tables/{i}", "label": "table", "captions": [{"cref": "#/texts/0"}], "prov": prov, "data": {"num_rows": len(rows), "num_cols": len(rows[0]), "orientation": "r", "grid": grid, "table_cells": [c for r in grid for c in r]}} | more


def doc(tables, **more):
    n = len(tables)
    refs = [{"cref": f"#/tables/{i}"} for i in range(n)]
    return {
        "schema_name": "x", "version": 1.5, "origin": {"hash": 12345678901234567890, "list": [None, True, {"a": []}]}, "pages": {"1": {"page_no": 1, "size": {"width": 600.5, "height": 800}}}, "texts": [], "tables": tables,
        "groups": [{"self_ref": "#/groups/0", "name": "g", "children": [*refs[1::2], {"cref": "#/texts/9"}, "odd"]}], "body": {"self_ref": "#/body", "children": [{"cref": "#/groups/0"}, *refs[::2], {"x": 1}]},
    } | more


H = ["Name", "Dose"]
ONE = doc([table(0, [H, ["a", "1"]], 1), table(1, [H, ["b", "2"]], 2), table(2, [["Other", "Names", "Here"], ["c", "d", "e"]], 3)])
NONE = doc([table(0, [H, ["a", "1"]], 1), table(1, [["Some", "Thing", "Else"], ["b", "2", "x"]], 2)], extra=None)
BAD = doc([table(0, [H, ["a", "1"]], 1), table(1, [H, ["q", "9"]], 2) | {"data": {"grid": {"no": "rows"}}}, table(2, [H, ["b", "2"]], 2)])


def read(spark, tmp_path, docs):
    for name, d in docs.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(d if isinstance(d, str) else json.dumps(d))
    return snapshot.read_snapshots(spark, f"file://{tmp_path}/*/*.json")


def back(docs):
    return {r.doc_id: json.loads(r.j) for r in docs.select("doc_id", F.to_json("doc").alias("j")).collect() if r.j}


def test_documents_come_back(spark, tmp_path):
    docs = read(spark, tmp_path, {"a/one.json": ONE, "b/one.json": NONE, "a/bad.json": BAD, "b/no.json": "{"})
    out = stitch_snapshots(docs)
    got = back(out["documents"])
    # nothing merged: equal; equal names in two folders are two documents
    assert got["b/one.json"] == NONE and got["a/bad.json"] == BAD and set(got) == {"a/one.json", "b/one.json", "a/bad.json"}
    one = got["a/one.json"]
    anchor, satellite, other = one["tables"]
    assert other == ONE["tables"][2] and {k: v for k, v in one.items() if k not in ("tables", "body", "groups")} == {k: v for k, v in ONE.items() if k not in ("tables", "body", "groups")}
    assert satellite == ONE["tables"][1] | {"prov": [], "data": {"orientation": "r", "num_rows": 0, "num_cols": 0, "grid": [], "table_cells": []}}
    assert anchor["prov"] == ONE["tables"][0]["prov"] + ONE["tables"][1]["prov"] and anchor["captions"] == ONE["tables"][0]["captions"]
    d = anchor["data"]
    assert (d["num_rows"], d["num_cols"], d["orientation"], len(d["table_cells"])) == (3, 2, "r", 6) and d["grid"][0] == ONE["tables"][0]["data"]["grid"][0] and d["table_cells"] == [c for r in d["grid"] for c in r]
    assert d["grid"][2][0] == {"text": "b", "row_span": 1, "col_span": 1, "start_row_offset_idx": 2, "end_row_offset_idx": 3, "start_col_offset_idx": 0, "end_col_offset_idx": 1, "column_header": False, "row_header": True}
    assert one["body"] == ONE["body"] and one["groups"] == [ONE["groups"][0] | {"children": [{"cref": "#/texts/9"}, "odd"]}]
    # a malformed table costs itself: the others are read, nothing is merged across it, the cause is said
    assert [tuple(r) for r in out["errors"].where("idx is not null").collect()] == [("a/bad.json", 1, "data.grid holds no rows but is of type object")]
    phases = {r.phase: (r.rows, r.extracted, r.skipped) for r in out["phases"].collect()}
    assert phases["documents"] == (4, 3, 1) and phases["tables read"] == (8, 7, 1) and phases["fragments"] == (7, None, None) and phases["tables"] == (6, None, None)
    assert {(r.doc_id, r.extracted, r.found) for r in out["coverage"].collect()} == {("a/one.json", 3, 3), ("b/one.json", 2, 2), ("a/bad.json", 2, 3), ("b/no.json", 0, 0)}


def test_adapter_gives_documents_for_documents(spark, tmp_path):
    docs = read(spark, tmp_path, {"a/one.json": ONE, "a/none.json": NONE})
    got = back(Stitcher(adapter=SnapshotAdapter()).stitch(docs, raise_on_error=True))
    assert got["a/none.json"] == NONE and [len(t["data"]["grid"]) for t in got["a/one.json"]["tables"]] == [3, 0, 2]
    alone = read(spark, tmp_path / "x", {"a/none.json": NONE})
    assert Stitcher(adapter=SnapshotAdapter()).stitch(alone) is alone


def test_headers_of_anchors(spark):
    """Old header rows stay; without any the names make one; a table without rows has its names only; row 0 says nothing of sides."""
    plain = [[cell("a", side=True), cell("1")], [cell("b"), cell("2")]]
    deep = [[cell("H", True), cell("H", True)], [cell("x", True), None], [cell("a", side=True), cell("1")]]
    d = {"tables": [{"data": {"grid": g}} for g in (plain, deep, deep, deep)] + [7], "groups": 5}
    docs = snapshot.from_json_text(spark.createDataFrame([("d", json.dumps(d))], "doc_id string, value string"))
    t = spark.createDataFrame([("d", 0, [0, 3], ["p", "q"], 1), ("d", 1, [1, 2], [], 0)], "doc_id string, logical_index int, members array<int>, columns array<string>, n_rows int")
    rows = spark.createDataFrame([("d", 0, 0, ["z", None])], "doc_id string, logical_index int, row_pos int, cells array<string>")
    got = back(document.stitched_documents(docs, t, rows))["d"]
    shape = lambda t: [[(c["text"], c["column_header"], c["row_header"]) if c else None for c in r] for r in t["data"]["grid"]]
    assert shape(got["tables"][0]) == [[("p", True, False), ("q", True, False)], [("z", False, False), ("", False, False)]]
    assert shape(got["tables"][1]) == [[("Column_0", True, False)]] and got["tables"][4] == 7 and got["groups"] == 5 and "prov" not in got["tables"][0] and "body" not in got
    t2 = t.where("logical_index = 1").withColumns({"columns": F.array(F.lit("p"), F.lit("q")), "n_rows": F.lit(1)})
    (again,) = back(document.stitched_documents(docs, t2, rows.withColumn("logical_index", F.lit(1)))).values()
    assert shape(again["tables"][1]) == [[("H", True, False), ("H", True, False)], [("x", True, False), None], [("z", False, True), ("", False, False)]]
    assert (again["tables"][1]["data"]["num_rows"], len(again["tables"][1]["data"]["table_cells"])) == (3, 5)


@pytest.mark.parametrize(
    ("bad", "why"),
    [(None, "the table is null"), (7, "the table is no object but of type bigint"), ({"a": 1}, "the table has no data"), ({"data": "x"}, "data is no object but of type string"), ({"data": {"grid": "x"}}, "data.grid holds no rows but is of type string"),
     ({"data": {"grid": [[], 5]}}, "data.grid: no list of cells in row 1"), ({"data": {"grid": [[{"text": "a"}], [None, "b"]]}}, "data.grid: a cell that is no object in row 1"), ({"data": {"table_cells": [1]}}, "data.table_cells is no list of cells"),
     ({"data": {"table_cells": [], "num_rows": 10**6, "num_cols": 10**6}}, "data.table_cells claims too many places"), ({"data": {"grid": []}, "prov": 5}, "prov holds no places but is of type bigint")],
)
def test_causes(spark, bad, why):
    docs = snapshot.from_json_text(spark.createDataFrame([("d", json.dumps({"tables": [{"data": {}}, bad, {"data": {"grid": None}, "prov": {"page_no": 3}}]}))], "doc_id string, value string"))
    assert [(r.idx, r.error) for r in snapshot.extract_errors(docs).collect()] == [(1, why)]


def test_tables_without_grid(spark):
    c = lambda text, row, col, down=1, right=1, **more: {"text": text, "start_row_offset_idx": row, "start_col_offset_idx": col, "end_row_offset_idx": row + down, "end_col_offset_idx": col + right} | more
    cells = [c("A", 0, 0, 1, 2, column_header=True), c("B", 0, 2, 2, 1, column_header=True), c("x", 1, 0, column_header=True), c("1", 2, 0), c("2", 2, 1, 9, 9), c("over", 3, 1), c("out", 9, 9), c("neg", -1, 0), {"text": "short", "start_row_offset_idx": 4, "start_col_offset_idx": 0, "col_span": 3}]
    tables = [{"data": {"num_rows": 5, "num_cols": 3, "table_cells": cells}, "prov": [{"page_no": 1}]}, {"data": {"table_cells": [c("p", 0, 0), c("q", 1, 1)]}}, {"data": {"table_cells": []}}, {"data": {"num_rows": 2, "num_cols": 0, "table_cells": []}}]
    docs = snapshot.from_json_text(spark.createDataFrame([("d", json.dumps({"tables": tables}))], "doc_id string, value string"))
    raw = snapshot.raw_tables(docs)
    f, rows = extract_fragments(raw)
    got = {r.idx: (r.columns, r.is_headerless, r.row_count, r.width) for r in f.collect()}
    assert got == {0: (["A.x", "A.", "B.B"], False, 3, 3), 1: (["0", "1"], False, 2, 2), 2: ([], False, 0, 0), 3: ([], False, 2, 0)}
    cells = {}
    for r in rows.orderBy("idx", "row_pos").collect():
        cells.setdefault(r.idx, []).append(r.cells)
    assert cells == {0: [["1", "2", "2"], ["", "over", "2"], ["short", "short", "short"]], 1: [["p", ""], ["", "q"]], 3: [[], []]}
    assert merge_fragments(f, rows).tables.count() == 4
    huge = raw.withColumn("span_cells", F.col("span_cells").withField("n_rows", F.lit(10**9)))
    assert {r.idx for r in spans.refused(huge).collect()} == {0, 1} and extract_fragments(huge)[0].count() == 2


def test_foreign_documents_are_named_by_their_path(spark, tmp_path):
    for d in ("a", "b/c"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "x.txt").write_text(d)

    def parse(name, data):
        yield {"idx": 0, "grid": [[name, data.decode()]]}

    ids = lambda at: {r.doc_id for r in foreign.from_parser(spark, at, parse)[0].collect()}
    assert ids(f"file://{tmp_path}/*/x.txt") == {"a/x.txt"} and ids(f"{tmp_path}/b/c") == {"x.txt"} and ids(f"file:{tmp_path}/a/x.txt") == {"x.txt"}
    assert ids(f"file://{tmp_path}/{{a,b/c}}/*") == {"a/x.txt", "b/c/x.txt"}


def test_sink_shows_all_or_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    one, two = spark.range(100).repartition(4), spark.range(5).select(F.lit("x").alias("t"))
    assert sink.published(spark, at) == {}

    def fails(batches):
        for b in batches:
            if 77 in b.column("id").to_pylist():
                raise RuntimeError("half-way")
            yield b

    broken = {"one": one, "two": one.mapInArrow(fails, "id long")}
    with pytest.raises(Exception, match="half-way"):
        sink.publish(broken, at)
    assert sink.published(spark, at) == {} and not list((tmp_path / "out" / "runs").iterdir())
    sink.publish({"one": one, "two": two}, at)
    with pytest.raises(Exception, match="half-way"):
        sink.publish(broken, at)
    now = sink.published(spark, at)
    assert {n: df.count() for n, df in now.items()} == {"one": 100, "two": 5} and now["one"].schema.names == one.schema.names
    sink.publish({"one": one.limit(0)}, at)
    assert {n: df.count() for n, df in sink.published(spark, at).items()} == {"one": 0}
    assert sink.sweep(spark, at) == 1 and sink.published(spark, at)["one"].count() == 0


def test_sink_has_no_doubles_of_retried_tasks(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from pagespan.sources import sink
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
        def once(batches):
            for b in batches:
                yield b
            if TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("after its rows")
        sink.publish({{"t": spark.range(0, 1000, 1, 4).mapInArrow(once, "id long")}}, "file://{tmp_path}/out")
        t = sink.published(spark, "file://{tmp_path}/out")["t"]
        print("ROWS", t.count(), t.distinct().count())
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert "ROWS 1000 1000" in out.stdout, out.stderr[-2000:]


def test_html_of_whole_documents(spark):
    grid = [[cell("A & B", True, col_span=2, start_row_offset_idx=0, start_col_offset_idx=0), cell("A & B", True, col_span=2, start_row_offset_idx=0, start_col_offset_idx=0)], [cell("<x>", side=True), None]]
    d = {"tables": [{"data": {"grid": grid}}, {"data": {"grid": []}}, 5], "texts": [{"label": "Title", "text": "T"}, {"label": "section_header", "text": 'q "r"'}, {"label": "text"}], "groups": [{"children": [{"cref": "#/tables/0"}]}], "body": {"children": [{"cref": f"#/{x}"} for x in ("texts/0", "groups/0", "texts/2", "tables/2", "texts/1")]}}
    docs = snapshot.from_json_text(spark.createDataFrame([("d", json.dumps(d)), ("e", "{"), ("f", None)], "doc_id string, value string"))
    table = '<table><tr><th colspan="2">A &amp; B</th></tr><tr><th>&lt;x&gt;</th><td></td></tr></table>'
    assert dict(map(tuple, export.documents_html(docs).collect())) == {"d": f"<html><body><h1>T</h1>{table}<p></p><h2>q &quot;r&quot;</h2></body></html>", "e": "<html><body></body></html>", "f": "<html><body></body></html>"}
    assert json.loads(dict(map(tuple, export.documents_json(docs).collect()))["d"]) == d


def test_sink_of_whole_documents(spark, tmp_path):
    docs = read(spark, tmp_path, {"a/none.json": NONE})
    sink.publish({"documents": docs, "errors": snapshot.extract_errors(docs)}, f"file://{tmp_path}/out")
    got = sink.published(spark, f"file://{tmp_path}/out")
    assert back(got["documents"]) == {"a/none.json": NONE} and got["errors"].count() == 0
