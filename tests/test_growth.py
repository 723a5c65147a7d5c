"""What keeps work in proportion to the input: plans and counts that would show it growing faster."""

from pyspark.sql import functions as F

from pagespan.operators import order
from pagespan.plans import demo, queries
from pagespan.sources import snapshot


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _docs(spark, *texts):
    return snapshot.from_json_text(spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(texts)], "doc_id string, value string"))


def test_shells_are_not_broadcast(spark, monkeypatch):
    """no side of the comparison of documents goes through the driver."""
    old = _docs(spark, '{"tables":[{}],"origin":1}', '{"tables":[]}')
    new = _docs(spark, '{"tables":[{}],"origin":1}', '{"tables":[{}, {}]}')
    monkeypatch.setattr(queries, "_documents", lambda spark, sf_dir: (old, new))
    got = queries.document_shells(spark, "")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == [("d0", True, 1, "1"), ("d1", False, 2, None)]


def test_a_table_is_described_once(spark):
    """a condition on the error isn't worked out anew from the table."""
    d = snapshot.described(_docs(spark, '{"tables":[{"data":{"grid":[[{"text":"a"}]]}},7]}'))
    filters = [line for line in _plan(d.where("error is null").select("doc_id", "idx")).splitlines() if "Filter" in line]
    assert filters and not any("variant_get" in line for line in filters)
    assert [r.error for r in d.orderBy("idx").collect()] == [None, "the table is no object but of type bigint"]


def test_sets_move_once_a_class(spark, monkeypatch):
    """near copies on many pages are compared as often as there are of them, not pair by pair."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [("d", i, "Title", " ".join(words + [f"own{chr(97 + i)}"]), i) for i in range(15)] + [("d", 99, "Title", "nothing of the kind", 3)]
    compared, alike = [], order._alike
    monkeypatch.setattr(order, "_alike", lambda pairs, sets: compared.append(pairs.count()) or alike(pairs, sets))
    got = order.running_furniture(spark.createDataFrame(rows, "doc_id string, item int, label string, text string, page int"))
    assert sorted(r.item for r in got.collect()) == list(range(15))
    assert sum(compared) <= 15


def test_orders_are_dealt_once(spark):
    """F7 to F21: fragments and grids come of one pass over the orders."""
    for made in (demo.demo_fragments, demo.demo_grids):
        plan = _plan(made(spark, "/root/testdata/sf0.001"))
        assert plan.count("Window [") == 1 and "Join" not in plan


def test_decisions_read_written_fragments(spark):
    """the fragments are computed once, not for each step of the decisions."""
    from pagespan.sources.store import recorded

    with recorded() as log:
        queries.decision_counts(spark, "/root/testdata/sf0.001")
    assert log[0]["phase"] == "fragments"


def test_pairs_do_not_move_for_their_warnings(spark):
    """F8 to F18, F20: where the numbers between two neighbours are missing, the pair tells them without a join; numbers between
    others (here 0 and 4, as 2 stands before both by its page) come of the document's gaps."""
    from pagespan.config import StitchConfig
    from pagespan.operators import decide

    row = "doc_id string, idx int, start_page int"
    none = {c: F.lit(None).cast(t) for c, t in (("vert_top", "double"), ("vert_bottom", "double"), ("content_before", "boolean"), ("first_cell", "string"))}
    more = {"width": F.lit(2), "row_count": F.lit(1), "header_tokens": F.array(F.lit("x")), "first_row_tokens": F.array(F.lit("y"))} | {c: F.lit(False) for c in ("is_headerless", "is_header_orphan", "is_data_orphan")}
    make = lambda rows: spark.createDataFrame(rows, row).withColumns(none | more)
    near = decide.decide_pairs(make([("n", 0, 1), ("n", 3, 2)]), StitchConfig())
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    both = decide.decide_pairs(make([("n", 0, 1), ("n", 3, 2), ("f", 0, 2), ("f", 2, 1), ("f", 4, 3)]), StitchConfig())
    got = {(r.doc_id, r.left_idx, r.right_idx): r.warnings for r in both.collect()}
    say = lambda x: [f"tables {x} lie between the two and were not read"]
    assert got == {("n", 0, 3): say("1, 2"), ("f", 2, 0): [], ("f", 0, 4): say("1, 3")}


def test_orders_are_shuffled_once(spark):
    """F9 to F17: the windows of a customer are under one name, so its orders move once."""
    for made in (demo.demo_fragments, demo.demo_grids):
        assert made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1


def test_only_rows_that_can_fold_are_counted(spark):
    """F9 to F17: a table whose rows begin with filled cells, or that lies on one page, is numbered by the sizes of its fragments;
    the rows of others are counted, also where a fragment's aren't numbered from 0 on."""
    from test_engine import A, fragment, frames

    from pagespan import StitchConfig, merge_fragments

    row = lambda *c: [[x, "1", "x"] for x in c]
    docs = {
        "filled": [fragment(0, A, row("a", "b")), fragment(1, A, row("c"), 2), fragment(2, A, row("d", "e"), 3)],
        "page": [fragment(0, A, [["a", "1", "x"], ["", "more", ""]])],
        "folds": [fragment(0, A, row("a")), fragment(1, A, [["", "", "tail"], ["b", "2", "y"]], 2)],
        "odd": [fragment(0, A, row("a", "b", "c")), fragment(1, A, row("d"), 2)],
    }
    f, rows = frames(spark, docs)
    out = merge_fragments(f, rows.where("not (doc_id = 'odd' and row_pos = 1)"), StitchConfig())
    got = {}
    for r in out.rows.orderBy("doc_id", "row_pos").collect():
        got.setdefault(r.doc_id, []).append((r.row_pos, *r.cells))
    assert got == {
        "filled": [(i, c, "1", "x") for i, c in enumerate("abcde")], "page": [(0, "a", "1", "x"), (1, "", "more", "")], "folds": [(0, "a", "1", "x\ntail"), (1, "b", "2", "y")],
        "odd": [(0, "a", "1", "x"), (1, "c", "1", "x"), (2, "d", "1", "x")],
    }
    wrote = {x["phase"]: x["rows"] for x in out.log}
    assert (wrote["placed"], wrote["aligned"], wrote["rows"]) == (13, 6, 12)
    assert {t.doc_id: t.n_rows for t in out.tables.collect()} == {"filled": 5, "page": 2, "folds": 2, "odd": 3}


def test_fragments_move_once_a_step(spark):
    """F10 to F16: decisions need no shuffle but that of the orders, and groups one of the fragments, which sizes share."""
    from pagespan import StitchConfig
    from pagespan.operators import decide, rebuild
    from pagespan.plans import engine

    d = "/root/testdata/sf0.001"
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
    assert moves(decide.decisions(demo.demo_fragments(spark, d), StitchConfig())) == 1
    made = engine.decisions(demo.demo_fragments(spark, d), StitchConfig())
    rows = demo.demo_rows(spark, d)
    few = moves(rebuild.plan(made.groups(), StitchConfig()))
    assert moves(rebuild.plan(made.groups(rows), StitchConfig())) - few == moves(rebuild.sizes(rows))


def test_rows_are_made_when_they_are_read(spark):
    """F10 to F16: tables know their number of rows without the rows in which nothing folds; fragments aren't written to be decided
    on. Phases and rows make the rest, once."""
    from test_engine import A, fragment, frames

    from pagespan import StitchConfig, merge_fragments

    row = lambda *c: [[x, "1", "x"] for x in c]
    docs = {"filled": [fragment(0, A, row("a", "b")), fragment(1, A, row("c"), 2)], "folds": [fragment(0, A, row("a")), fragment(1, A, [["", "", "tail"], ["b", "2", "y"]], 2)]}
    out = merge_fragments(*frames(spark, docs), StitchConfig())
    assert {t.doc_id: t.n_rows for t in out.tables.collect()} == {"filled": 3, "folds": 2}
    wrote = [x["phase"] for x in out.log]
    assert "aligned" in wrote and not {"placed", "plain", "rows"} & set(wrote) and wrote.index("islands") < wrote.index("fragments")
    once = sorted(map(tuple, out.rows_once().collect()))
    assert not {"placed", "plain", "rows"} & {x["phase"] for x in out.log}
    phases = {r.phase: r.rows for r in out.phases().collect()}
    assert (phases["fragments"], phases["placed"], phases["rows"]) == (4, 6, 5)
    assert sorted(map(tuple, out.rows.collect())) == once == sorted(map(tuple, out.rows_once().collect())) and len(once) == 5
    assert [x["phase"] for x in out.log].count("rows") == 1
    assert {(m.doc_id, m.fragments, m.logical_tables, m.merged_tables, m.rows) for m in out.metrics().collect()} == {("filled", 2, 1, 1, 3), ("folds", 2, 1, 1, 2)}


def test_traces_of_islands_that_repair_joins(spark):
    """F10 to F16: a refused decision is a trace where repair joins both its islands; told without looking at the fragments again."""
    from pagespan.operators import decide

    told = [("d", i, i, 0, i, i + 1, None if i == 0 else i - 1, False, "header_similarity_too_low") for i in range(5)]
    told = spark.createDataFrame(told, "doc_id string, idx int, place int, page0 int, pos int, island int, left_idx int, merged boolean, reason string")
    none = {"signals": F.lit(0), "warnings": F.lit(0), "seq": F.lit(0), "far": F.lit(False)}
    # islands 1 and 3, and 4 and 5 are joined
    repaired = spark.createDataFrame([("d", 0, 0, 2, 1, 3, True, 1), ("d", 1, 3, 4, 4, 5, True, 4)], "doc_id string, seq int, left_idx int, right_idx int, left_island int, right_island int, taken boolean, root int")
    second = spark.createDataFrame([], "doc_id string, pass_no int, seq int, left_idx int, right_idx int, merged boolean, reason string, signals int, warnings int")
    got = decide.groups(told.withColumns(none), repaired, second)
    assert {r.idx: (r.comp, r.trace is not None) for r in got.collect()} == {0: (1, False), 1: (2, False), 2: (1, False), 3: (4, False), 4: (4, True)}


def test_anchor_cells_are_not_broadcast(spark):
    """F1 of round 4: cells meet the anchors sorted, and the grid is read once; nothing of them goes through the driver."""
    from pagespan.operators import inject
    from pagespan.sources.store import written

    cell = "doc_id string, idx int, row_pos int, col_pos int, text string, row_span int, col_span int, column_header boolean, row_header boolean"
    one = lambda d, t, i, j, head, side: (d, t, i, j, f"{d}{t}{i}{j}", 1, 1, head, side)
    cells = [one("a", 0, 0, 0, True, None), one("a", 0, 0, 1, None, None), one("a", 0, 1, 0, True, True), one("a", 0, 2, 0, None, False), one("a", 0, 3, 0, True, True), one("b", 1, 0, 0, None, True), one("b", 1, 1, 0, None, False), one("c", 0, 0, 0, True, True), one("e", 5, 0, 0, True, True)]
    tables = spark.createDataFrame([("a", 0, [0, 1], ["x"], 1), ("b", 0, [1, 2], ["y", "z"], 1), ("c", 0, [0, 1], [], 0), ("d", 0, [4, 5], ["w"], 1), ("e", 0, [5], ["q"], 1)], "doc_id string, logical_index int, members array<int>, columns array<string>, n_rows int")
    rows = spark.createDataFrame([(d, 0, 0, [f"new {d}", None]) for d in "abde"], "doc_id string, logical_index int, row_pos int, cells array<string>")
    got = inject.anchor_cells(*[written(x, "side") for x in (spark.createDataFrame(cells, cell), tables, rows)])  # of known size
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.idx, r.row_pos, r.col_pos, r.text, r.column_header, r.row_header) for r in got.collect() if r.column_header or r.col_pos == 0) == [
        ("a", 0, 0, 0, "a000", True, None), ("a", 0, 0, 1, "a001", True, None), ("a", 0, 1, 0, "a010", True, True), ("a", 0, 2, 0, "new a", False, True), ("b", 1, 0, 0, "y", True, False), ("b", 1, 0, 1, "z", True, False), ("b", 1, 1, 0, "new b", False, False),
        ("c", 0, 0, 0, "Column_0", True, False), ("d", 4, 0, 0, "w", True, False), ("d", 4, 1, 0, "new d", False, False),
    ]


def test_large_sets_do_not_move_pair_by_pair(spark, monkeypatch):
    """F2 of round 4: large texts of one vocabulary meet each other all, and 512 bits don't tell them apart; their sets stay where they are."""
    word = lambda *n: "w" + "q".join("".join(chr(97 + int(c)) for c in str(x)) for x in n)
    texts = [" ".join([word(k) for k in range(1000)] + [word(min(i, j), max(i, j), k) for j in range(10) if j != i for k in range(60)]) for i in range(10)]
    compared, alike = [], order._alike
    monkeypatch.setattr(order, "_alike", lambda pairs, sets: compared.append(pairs.count()) or alike(pairs, sets))
    got = order.running_furniture(spark.createDataFrame([("d", i, "Title", t, i) for i, t in enumerate(texts)], "doc_id string, item int, label string, text string, page int"))
    assert got.collect() == [] and 0 < sum(compared) <= 10


def test_wide_signatures_of_two_lengths(spark):
    """F2 of round 4: a set of 1000 tokens has half as many words as one of 1100 that holds it, and both are near."""
    sets = spark.sql("SELECT 'd' AS doc_id, CAST(n AS INT) AS one, transform(sequence(lo, lo + n - 1), x -> xxhash64(x)) AS tok FROM VALUES (1000, 0), (1100, 0), (1050, 5000) v(n, lo)")
    assert {r.one: len(r.wide) for r in order._wide(sets).collect()} == {1000: 32, 1100: 64, 1050: 64}
    pairs = spark.createDataFrame([("d", 1000, 1100), ("d", 1100, 1000), ("d", 1000, 1050), ("d", 1050, 1100)], "doc_id string, one int, other int")
    assert sorted((r.one, r.other) for r in order._near(pairs, sets).collect()) == [(1000, 1100), (1100, 1000)]


def test_shuffles_go_with_what_they_wrote(spark):
    """F2 of round 4: the shuffle files of a step don't stay until the last step; the session's own setting comes back."""
    from pagespan.sources import store

    seen, own = [], spark.conf.get(store._FREES, None)
    df = spark.range(3).withColumn("x", F.udf(lambda i: i, "long")("id"))
    with store._freed(spark):
        seen.append(spark.conf.get(store._FREES))
    assert store.written(df, "freed").count() == 3 and seen == ["true"] and spark.conf.get(store._FREES, None) == own


def test_documents_are_read_and_moved_once(spark):
    """F3 and F4 of round 4: a document moves once, to meet what its tables become; it isn't taken apart and collected again."""
    from pagespan.operators import document
    from pagespan.sources.store import written

    docs = snapshot.from_json_text(written(spark.createDataFrame([("d", '{"tables":[{},{}]}')], "doc_id string, value string"), "texts"))
    t = spark.createDataFrame([("d", 0, [0, 1], ["p"], 1)], "doc_id string, logical_index int, members array<int>, columns array<string>, n_rows int")
    rows = spark.createDataFrame([("d", 0, 0, ["z"])], "doc_id string, logical_index int, row_pos int, cells array<string>")
    got = document.stitched_documents(docs, t, rows)
    assert _plan(got).count("Relation [") == 1 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
