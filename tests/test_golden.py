"""Recorded cases replayed: fragments with the logical tables that they must give, documents with a reading order, and pages that
arrive one by one."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_engine import fragment, run

from pagespan import StitchConfig, extract_fragments, merge_fragments
from pagespan.plans.engine import stitch_snapshots
from pagespan.schema import RAW_TABLES
from pagespan.sources import snapshot
from pagespan.streaming import pages

HL = {"headerless": True}
ABC = ["ID", "Name", "Notes"]
AUTO = ["Column_0", "Column_1", "Column_2", "Column_3"]
ROW = ["1", "x", "y"]


def test_recorded_fragments(spark):
    """A headerless continuation with one column more, as recorded: members, pages, shape, reason, columns and last row."""
    last = ["A-2", "Beta", "continues on page two", "preserved extra value"]
    docs = {"drift": [fragment(0, ABC, [["A-1", "Alpha", "starts on page one"]], 1, bottom=0.9), fragment(1, AUTO, [last], 2, top=0.1, **HL)]}
    tables, rows, _ = run(spark, docs, max_page_gap=1, width_overflow_policy="preserve_extra")
    t = tables["drift"][0]
    assert (t.members, t.pages, t.n_rows, len(t.columns), t.merge_reason) == ([0, 1], [1, 2], 2, 4, "headerless_width_drift_layout")
    assert t.columns == [*ABC, "_extra_0_Column_3"] and rows["drift", 0][-1] == last


def test_how_many_tables(spark):
    same = lambda **k: [fragment(0, ABC, [ROW], 1), fragment(1, ABC, [ROW], 2, **k)]
    drug, dose = ["drug name", "patient age"], ["drug name", "patient dose"]
    both = lambda low: [fragment(0, ABC, [ROW], 1, top=0.1, bottom=low), fragment(1, AUTO[:3], [ROW], 2, top=0.1, bottom=low, **HL), fragment(2, AUTO[:3], [["2", "p", "q"]], 3, top=0.1, bottom=low, **HL)]
    docs = {
        "index gap": ([fragment(0, ABC, [ROW]), fragment(5, AUTO[:3], [ROW], 2, **HL)], 2), "orphan gap": ([fragment(0, ABC, [], 1, header_orphan=True), fragment(4, ["u", "v", "w"], [ROW], 2, data_orphan=True)], 2),
        "subset header": ([fragment(0, ["order key", "status", "priority", "year"], [ROW]), fragment(1, ["order key", "status", "priority"], [ROW], 2)], 1),
        "disjoint, no layout": ([fragment(0, ["drug name patient age group", drug[0]], [ROW[:2]]), fragment(1, ["drug name patient age dose", dose[0]], [ROW[:2]], 2)], 2),
        "disjoint, layout": ([fragment(0, ["drug name patient age group", drug[0]], [ROW[:2]], bottom=0.9), fragment(1, ["drug name patient age dose", dose[0]], [ROW[:2]], 2, top=0.1)], 1),
        "high ends": (both(0.46), 2), "low ends": (both(0.91), 1), "same page": ([fragment(0, ABC, [ROW], 1), fragment(1, ABC, [ROW], 1)], 2), "four pages on": ([fragment(0, ABC, [ROW], 1), fragment(1, ABC, [ROW], 5)], 2),
        "chain": ([fragment(0, ABC, [ROW]), *(fragment(i, AUTO[:3], [[str(i), "1", "x"]], i + 1, top=0.1, bottom=0.9, **HL) for i in (1, 2))], 1), "spill": ([fragment(0, ABC, [ROW]), fragment(1, ["c"], [["more"]], 2, **HL)], 1),
        "nothing said": (same(), 1), "content": (same(before=True), 2), "no content": (same(before=False), 1),
    }
    docs["low ends"][0][0]["bottom"] = 0.91
    tables, _, _ = run(spark, {k: f for k, (f, _) in docs.items()})
    assert {k: len(t) for k, t in tables.items()} == {k: n for k, (_, n) in docs.items()}
    off, _, _ = run(spark, {"content": same(before=True), "spill on page 3": [fragment(0, ABC, [ROW]), fragment(1, ["c"], [["more"]], 3, **HL)]}, block_on_intervening_content=False, max_page_gap=3)
    assert {k: len(t) for k, t in off.items()} == {"content": 1, "spill on page 3": 2}


def guarded(heading_texts):
    """Two equal tables on two pages; between them in reading order a heading, which other pages may repeat."""
    place = lambda page, top: [{"page_no": page, "bbox": {"l": 50, "t": top, "r": 550, "b": top + 18, "coord_origin": "TOPLEFT"}, "charspan": [0, 0]}]
    grid = lambda rows: [[{"text": c, "column_header": i == 0} for c in r] for i, r in enumerate(rows)]
    t = [{"self_ref": f"#/tables/{i}", "prov": place(i + 1, top), "data": {"grid": grid([["Item", "Amount"], [f"row {i}", str(i)]])}} for i, top in enumerate((700, 80))]
    x = [{"self_ref": f"#/texts/{i}", "label": "section_header", "text": s, "prov": place(page, 40)} for i, (s, page) in enumerate(heading_texts)]
    order = ["#/texts/0", "#/tables/0", "#/texts/1", "#/tables/1"] if len(x) > 1 else ["#/tables/0", "#/texts/0", "#/tables/1"]
    return {"pages": {str(p): {"page_no": p, "size": {"width": 600, "height": 800}} for p in (1, 2)}, "tables": t, "texts": x, "groups": [], "body": {"children": [{"cref": r} for r in order]}}


def test_recorded_documents_with_reading_order(spark):
    unique, repeated = guarded([("A different topic begins", 2)]), guarded([("Quarterly Report of the Office", 1), ("Quarterly Report of the Office", 2)])
    raw = spark.createDataFrame([("unique", json.dumps(unique)), ("repeated", json.dumps(repeated))], "doc_id string, value string")
    members = lambda cfg: {r.doc_id: (r.r, r.n) for r in stitch_snapshots(snapshot.from_json_text(raw), cfg)["prov"].groupBy("doc_id").agg(F.count(F.when(F.col("cleared"), 1)).alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    assert members(None) == {"unique": (0, 2), "repeated": (1, 2)}
    assert members(StitchConfig(block_on_intervening_content=False)) == {"unique": (1, 2), "repeated": (1, 2)}


@pytest.mark.parametrize("restart", [False, True])
def test_pages_one_by_one_give_what_the_batch_gives(spark, tmp_path, restart):
    rnd = random.Random(restart)
    began, rows, raw = datetime(2024, 1, 1), [], []
    for d in range(6):
        for p in range(1, 6):
            at = began + timedelta(minutes=20 * d, seconds=rnd.randint(0, 200))
            if d == 4 and p == 3:
                continue  # never comes
            if d == 5 and p == 2:
                rows.append((f"d{d}", p, 5, at, None, None, None, None, None))  # a page without tables
                continue
            own = (f"d{d}", p - 1, [["n", "v"], [f"{d}{p}", "1"]], [(p, None)], None, None)
            raw.append(own)
            rows += [(own[0], p, 5, at, *own[1:])] * (2 if p == 4 else 1)
    rnd.shuffle(rows)
    rows.sort(key=lambda r: int(r[0][1]) // 2)  # within an hour in any order
    rows += [("late", 1, 1, began + timedelta(days=1), None, None, None, None, None)] * 2
    parts = [rows[i : i + 9] for i in range(0, len(rows), 9)]

    def feed(some):
        for i in some:
            spark.createDataFrame(parts[i], pages.PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        stream = spark.readStream.schema(spark.createDataFrame([], pages.PAGES).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        pages.stitch_pages(stream, f"{tmp_path}/out", f"{tmp_path}/cp", delay="2 hours").awaitTermination(300)

    half = len(parts) // 2 if restart else 0
    if restart:
        feed(range(half))
        go()
    feed(range(half, len(parts)))
    go()
    want = merge_fragments(*extract_fragments(spark.createDataFrame(raw, RAW_TABLES)))
    key = lambda df: sorted((r.doc_id, r.logical_index, r.members, r.pages, r.merge_reason, r.n_rows) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out/tables")) == key(want.tables) and len(key(want.tables)) == 8
    cells = lambda df: sorted((r.doc_id, r.logical_index, r.row_pos, r.cells) for r in df.select("doc_id", "logical_index", "row_pos", "cells").collect())
    assert cells(spark.read.parquet(f"{tmp_path}/out/rows")) == cells(want.rows)
    assert [(r.doc_id, r.error) for r in spark.read.parquet(f"{tmp_path}/out/errors").collect()] == [("d4", "closed without page 3")]
