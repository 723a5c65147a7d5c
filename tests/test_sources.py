"""Snapshots in, documents after stitching out; other parsers; export."""

import json

import pytest

from pagespan import Adapter, StitchConfig, StitchError, Stitcher, extract_fragments, merge_fragments, stitch_documents
from pagespan.operators import order
from pagespan.plans.engine import stitch_snapshots
from pagespan.schema import RAW_TABLES
from pagespan.sources import export, foreign, snapshot, store


def cell(text, head=False, side=False):
    return {"text": text, "row_span": 1, "col_span": 1, "start_row_offset_idx": 0, "start_col_offset_idx": 0, "column_header": head, "row_header": side}


def table(rows, page, t, b, heads=1):
    grid = [[cell(c, i < heads, j == 0 and i >= heads) for j, c in enumerate(r)] for i, r in enumerate(rows)]
    return {"self_ref": "#/tables/0", "prov": [{"page_no": page, "bbox": {"l": 0, "t": t, "r": 1, "b": b, "coord_origin": "BOTTOMLEFT"}}], "data": {"num_rows": len(rows), "num_cols": 2, "grid": grid}}


@pytest.fixture()
def docs(spark, tmp_path):
    pages = {str(i): {"page_no": i, "size": {"width": 600, "height": 800}} for i in (1, 2, 3)}
    text = lambda label, t, page: {"self_ref": "#", "label": label, "text": t, "prov": [{"page_no": page}]}
    doc = {
        "name": "d", "pages": pages,
        "tables": [table([["Name", "Dose"], ["a", "1"]], 1, 300, 50), table([["Name", "Dose"], ["b", "2"]], 2, 780, 500), table([["Name", "Dose"], ["c", "3"]], 3, 780, 500), {"self_ref": "x"}],
        "texts": [text("section_header", "Running Title Here", 1), text("page_header", "Running Title Here", 2), text("section_header", "A new chapter", 3), text("text", "prose", 1)],
        "groups": [{"self_ref": "#/groups/0", "children": [{"cref": "#/tables/1"}, {"cref": "#/groups/0"}, {"cref": "#/groups/9"}]}],
        "body": {"children": [{"cref": "#/tables/0"}, {"$ref": "#/texts/0"}, {"cref": "#/groups/0"}, {"cref": "#/texts/2"}, {"cref": "#/tables/2"}, {"cref": "bad"}]},
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    return snapshot.read_snapshots(spark, f"file://{tmp_path}/*.json")


def test_snapshot_to_documents(docs):
    got = [(r.kind, r.item) for r in snapshot.body_order(docs).orderBy("ord").collect()]
    assert got == [("tables", 0), ("texts", 0), ("tables", 1), ("texts", 2), ("tables", 2)]
    assert [(r.item) for r in order.blocking_headings(snapshot.texts(docs)).collect()] == [2]
    assert {r.idx: r.content_before for r in snapshot.raw_tables(docs).collect()} == {0: False, 1: False, 2: True}
    assert [(r.idx, r.error) for r in snapshot.extract_errors(docs).collect()] == [(3, "the table has no data")]
    out = stitch_snapshots(docs)
    cells = {}
    for r in out["cells"].orderBy("idx", "row_pos", "col_pos").collect():
        cells.setdefault(r.idx, {}).setdefault(r.row_pos, []).append((r.text, r.column_header, r.row_header))
    assert sorted(cells) == [0, 2] and [[c[0] for c in row] for row in cells[0].values()] == [["Name", "Dose"], ["a", "1"], ["b", "2"]]
    assert cells[0][0][0][1] and cells[0][2][0] == ("b", False, True) and cells[0][2][1] == ("2", False, False)
    prov = {r.idx: ([p.page_no for p in r.prov], r.cleared) for r in out["prov"].collect()}
    assert prov == {0: ([1, 2], False), 1: ([], True), 2: ([3], False), 3: ([], False)}
    assert [(r.kind, r.item) for r in out["order"].orderBy("ord").collect()] == [("tables", 0), ("texts", 0), ("texts", 2), ("tables", 2)]


def test_export(spark, docs, tmp_path):
    r = stitch_documents(snapshot.raw_tables(docs), raise_on_error=True)
    md = {x.logical_index: x.markdown for x in export.markdown(r.tables, r.rows).collect()}
    assert md[0] == "| Name | Dose |\n| --- | --- |\n| a | 1 |\n| b | 2 |"
    export.write_json(r.tables, r.rows, f"file://{tmp_path}/out")
    assert {tuple(map(tuple, x.rows)) for x in spark.read.json(f"file://{tmp_path}/out").collect()} == {(("a", "1"), ("b", "2")), (("c", "3"),)}


def test_unreadable_documents_and_coverage(spark, docs, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "other.json").write_text('{"a": 1}')
    (tmp_path / "empty.json").write_text('{"name": "e", "tables": [], "texts": [], "body": {"children": []}}')
    read = snapshot.read_snapshots(spark, f"file://{tmp_path}/*.json")
    assert {(r.doc_id, r.idx) for r in snapshot.extract_errors(read).collect()} == {("d.json", 3), ("bad.json", None), ("other.json", None)}
    got = {r.doc_id: (r.extracted, r.found, r.skipped, r.message.split(" (")[0]) for r in snapshot.coverage(read).collect()}
    assert got == {"d.json": (3, 4, 1, "extracted 3 of 4 tables"), "bad.json": (0, 0, 0, "extracted 0 of 0 tables"), "other.json": (0, 0, 0, "extracted 0 of 0 tables"), "empty.json": (0, 0, 0, "extracted 0 of 0 tables")}
    out = stitch_snapshots(read)
    assert out["errors"].count() == 3 and {r.doc_id for r in out["cells"].collect()} == {"d.json"}


def test_adapters(spark):
    raw = spark.createDataFrame([("d", 0, [["n", "v"], ["a", "1"]], [(1, None)], None, None), ("d", 1, [["n", "v"], ["b", "2"]], [(2, None)], None, None)], RAW_TABLES)

    class Both:
        def extract(self, documents, config):
            return documents

        def inject(self, documents, stitched):
            return [r.members for r in stitched.tables.collect()]

    class Half:
        def extract(self, documents, config):
            return documents

    assert isinstance(Both(), Adapter) and not isinstance(Half(), Adapter)
    assert Stitcher(adapter=Both()).stitch(raw, raise_on_error=True) == [[0, 1]]
    with pytest.raises(TypeError, match="Half is no adapter"):
        Stitcher(adapter=Half())
    with pytest.raises(TypeError):
        Stitcher(adapter=Both(), extract=lambda d: d)
    assert Stitcher(adapter=Both()).stitch(raw.where("idx = 0")).count() == 1  # no table on two pages: the documents as they were

    class Broken(Both):
        def inject(self, documents, stitched):
            raise RuntimeError("half written")

    before = raw.collect()
    assert Stitcher(adapter=Broken()).stitch(raw).collect() == before  # a failing write-back leaves the documents alone
    with pytest.raises(StitchError, match="half written"):
        Stitcher(adapter=Broken()).stitch(raw, raise_on_error=True)


def test_public_names():
    import pagespan

    assert pagespan.__all__ == ["Adapter", "StitchConfig", "StitchError", "Stitched", "Stitcher", "extract_fragments", "merge_fragments", "stitch_documents"]
    assert all(hasattr(pagespan, n) for n in pagespan.__all__)


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Cluster())


def test_foreign_parser(spark, tmp_path):
    (tmp_path / "x.txt").write_text("n,v\na,1\n\nn,v\nb,2")
    (tmp_path / "y.txt").write_text("broken")
    (tmp_path / "z.txt").write_text("n,v\na,1\n\n?\n\nn,v\nb,2")
    (tmp_path / "w.txt").write_text("n,v\na,1\n\nbroken")

    def parse(name, data):
        for i, part in enumerate(data.decode().split("\n\n")):
            if part == "broken":
                raise ValueError(name)
            if part == "?":
                yield {"idx": i, "error": "no grid"}
                continue
            yield {"idx": i, "grid": [line.split(",") for line in part.split("\n")], "prov": [{"page_no": i + 1, "bbox": None}], "heights": None, "content_before": None}

    with store.recorded() as log:
        raw, errors = foreign.from_parser(spark, f"file://{tmp_path}/*.txt", parse)
    assert [(x["phase"], x["rows"], x["extracted"], x["skipped"]) for x in log] == [("parsed", 8, 5, 3)]
    assert {(r.doc_id, r.extracted, r.found, r.skipped) for r in foreign.coverage(raw, errors).collect()} == {("x.txt", 2, 2, 0), ("y.txt", 0, 0, 0), ("z.txt", 2, 3, 1), ("w.txt", 1, 1, 0)}
    assert sorted(((r.doc_id, r.idx, r.error) for r in errors.collect()), key=str) == [("w.txt", None, "ValueError: w.txt"), ("y.txt", None, "ValueError: y.txt"), ("z.txt", 1, "no grid")]
    out = merge_fragments(*extract_fragments(raw), StitchConfig(max_page_gap=3))
    # nothing is merged across the table that is missing
    assert sorted((t.doc_id, t.members) for t in out.tables.collect()) == [("w.txt", [0]), ("x.txt", [0, 1]), ("z.txt", [0]), ("z.txt", [2])]
    assert [(p.reason, p.warnings) for p in out.pairs.where("doc_id = 'z.txt'").collect()] == [("unextracted_table_between", ["tables 1 lie between the two and were not read"])]
