"""DuckDB SQL for the engine's queries, derived from the rules and not from the engine's expressions: long tables of cells,
names and tokens, self-joins instead of windows, one predicate per reason."""

from __future__ import annotations

from pagespan.plans import demo
from pagespan.plans.queries import _SHAPES

_LONG_NAMES = " UNION ALL ".join(f"SELECT c, p, {j} AS j, {demo.name_sql(j)} AS name FROM f WHERE w > {j}" for j in range(10))
_LONG_CELLS = " UNION ALL ".join(f"SELECT c, p, i, {j} AS j, {demo.cell_sql(j)} AS cell FROM r WHERE w > {j}" for j in range(10))

BASE = f"""
WITH RECURSIVE r AS ({demo.ROWS_SQL}), f AS ({demo.FRAGMENTS_SQL}),
names AS ({_LONG_NAMES}), cells AS ({_LONG_CELLS}),
htok AS (SELECT DISTINCT c, p, unnest(regexp_extract_all(lower(name), '[a-z]+')) AS t FROM names),
rtok AS (SELECT DISTINCT c, p, unnest(regexp_extract_all(lower(cell), '[a-z]+')) AS t FROM cells WHERE i = 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY coalesce(page, 0), idx) AS rn FROM f),
pr AS (SELECT a.c, a.p AS pa, b.p AS pb, a.idx AS ia, b.idx AS ib, a.page AS ga, b.page AS gb, a.w AS wa, b.w AS wb, a.headerless AS ha, b.headerless AS hb, a.header_orphan AS oa, b.header_orphan AS ob,
         a.data_orphan AS da, b.data_orphan AS db, b.content_before AS cb, coalesce(a.bottom >= 0.6 AND b.top <= 0.4, false) AS layout
       FROM ord a JOIN ord b ON a.c = b.c AND b.rn = a.rn + 1),
hn AS (SELECT c, p, count(*) AS n FROM htok GROUP BY c, p), rn AS (SELECT c, p, count(*) AS n FROM rtok GROUP BY c, p),
hb AS (SELECT pr.c, pr.pb, count(*) AS n FROM pr JOIN htok x ON x.c = pr.c AND x.p = pr.pa JOIN htok y ON y.c = pr.c AND y.p = pr.pb AND y.t = x.t GROUP BY 1, 2),
rb AS (SELECT pr.c, pr.pb, count(*) AS n FROM pr JOIN rtok x ON x.c = pr.c AND x.p = pr.pa JOIN rtok y ON y.c = pr.c AND y.p = pr.pb AND y.t = x.t GROUP BY 1, 2),
sim AS (SELECT pr.*, coalesce(h1.n, 0) AS n1, coalesce(h2.n, 0) AS n2, coalesce(hb.n, 0) AS nb, coalesce(r1.n, 0) AS m1, coalesce(r2.n, 0) AS m2, coalesce(rb.n, 0) AS mb
        FROM pr LEFT JOIN hn h1 ON h1.c = pr.c AND h1.p = pr.pa LEFT JOIN hn h2 ON h2.c = pr.c AND h2.p = pr.pb LEFT JOIN hb ON hb.c = pr.c AND hb.pb = pr.pb
        LEFT JOIN rn r1 ON r1.c = pr.c AND r1.p = pr.pa LEFT JOIN rn r2 ON r2.c = pr.c AND r2.p = pr.pb LEFT JOIN rb ON rb.c = pr.c AND rb.pb = pr.pb),
js AS (SELECT *, CASE WHEN n1 + n2 = 0 THEN 0.0 ELSE CAST(nb AS DOUBLE) / (n1 + n2 - nb) END AS hs, CASE WHEN m1 + m2 = 0 THEN 0.0 ELSE CAST(mb AS DOUBLE) / (m1 + m2 - mb) END AS rs, n1 > nb AND n2 > nb AS both_own,
         (SELECT count(*) FROM f x WHERE x.c = js0.c AND x.idx > ia AND x.idx < ib) AS between_known FROM sim js0)
"""


def _reasons(gap: int, same_width: bool) -> str:
    """One predicate after another; each later one excludes the earlier by its place in the list."""
    rules = [
        ("unextracted_table_between", "ib - ia > 1 AND between_known < ib - ia - 1"), ("missing_page", "ga IS NULL OR gb IS NULL"), ("page_gap_out_of_range", f"gb - ga < 1 OR gb - ga > {gap}"),
        ("content_between_tables", "cb IS TRUE"), ("spillover", "hb AND wb = 1 AND wa > 1 AND gb - ga = 1"), ("right_header_orphan_starts_next_table", "ob"),
        *([("require_same_width", "wa <> wb")] if same_width else []), ("width_difference_too_large", "abs(wa - wb) > 4"), ("header_orphan_to_headerless", "oa AND hb"),
        ("headerless_width_match", "hb AND wa = wb AND (NOT ha OR layout)"), ("headerless_width_drift_layout", "hb AND abs(wa - wb) <= 2 AND layout"), ("row_similarity", "hb AND rs >= 0.3"),
        ("headerless_no_signal", "hb"), ("header_similarity_strict_disjoint_tokens", "hs >= 0.6 AND both_own AND NOT layout"), ("header_similarity_strict", "hs >= 0.6"),
        ("header_similarity_loose_layout", "hs >= 0.3 AND layout"),
    ]
    return "CASE " + " ".join(f"WHEN {p} THEN '{n}'" for n, p in rules) + " ELSE 'header_similarity_too_low' END"


_MERGE = "('spillover', 'header_orphan_to_headerless', 'headerless_width_match', 'headerless_width_drift_layout', 'row_similarity', 'header_similarity_strict', 'header_similarity_loose_layout')"

DECIDED = BASE + f""",
dec AS (SELECT *, {_reasons(1, False)} AS reason FROM js),
isl AS (SELECT c, p, idx, rn, page, (SELECT max(o2.rn) FROM ord o2 LEFT JOIN dec d ON d.c = o2.c AND d.pb = o2.p
          WHERE o2.c = o.c AND o2.rn <= o.rn AND (d.reason IS NULL OR d.reason NOT IN {_MERGE})) AS island FROM ord o),
edge AS (SELECT a.c, a.p AS pa, b.p AS pb, a.idx AS ia, b.idx AS ib, xa.island AS la, xb.island AS lb, CASE WHEN coalesce(a.bottom >= 0.6 AND b.top <= 0.4, false) THEN 'orphans+layout' ELSE 'orphans' END AS reason
         FROM f a JOIN f b ON a.c = b.c AND b.page - a.page = 1 AND a.header_orphan AND b.data_orphan AND abs(a.w - b.w) <= 4 AND b.content_before IS NOT TRUE
         JOIN isl xa ON xa.c = a.c AND xa.p = a.p JOIN isl xb ON xb.c = b.c AND xb.p = b.p
         WHERE xa.island <> xb.island AND (SELECT count(*) FROM f x WHERE x.c = a.c AND x.idx > least(a.idx, b.idx) AND x.idx < greatest(a.idx, b.idx)) = abs(a.idx - b.idx) - 1 + CASE WHEN a.idx = b.idx THEN 1 ELSE 0 END),
link AS (SELECT c, la AS x, lb AS y FROM edge UNION SELECT c, lb, la FROM edge),
walk AS (SELECT DISTINCT c, island AS x, island AS y FROM isl UNION SELECT w.c, w.x, l.y FROM walk w JOIN link l ON l.c = w.c AND l.x = w.y),
root AS (SELECT c, x, min(y) AS root FROM walk GROUP BY c, x),
grp AS (SELECT i.c, i.p, i.idx, i.page, r.root, min(i.p) OVER (PARTITION BY i.c, r.root) AS first FROM isl i JOIN root r ON r.c = i.c AND r.x = i.island),
tab AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY c ORDER BY first) - 1 AS INT) AS li, CAST(row_number() OVER (PARTITION BY c, root ORDER BY coalesce(page, 0), idx) - 1 AS INT) AS rank FROM grp)
"""


#: Members of the logical tables, with what the rebuild needs: spilled, orphan-built, header member, pages, widths.
BUILT = DECIDED + """,
mem AS (SELECT t.c, t.p, t.idx, t.page, t.li, t.rank, f.w, f.n_rows, f.header_orphan, f.has_cont, f.headerless, coalesce((SELECT d.reason = 'spillover' FROM dec d WHERE d.c = t.c AND d.pb = t.p), false) AS spilled FROM tab t JOIN f ON f.c = t.c AND f.p = t.p),
hdr AS (SELECT c, li, min(rank) FILTER (WHERE header_orphan AND NOT spilled) AS hr, count(*) AS n_members FROM mem GROUP BY c, li),
dat AS (SELECT m.*, h.hr, h.n_members FROM mem m JOIN hdr h USING (c, li) WHERE NOT m.spilled AND m.rank IS DISTINCT FROM h.hr),
tot AS (SELECT c, li, sum(n_rows) AS total, max(rank) AS last_rank FROM dat GROUP BY c, li),
pgs AS (SELECT DISTINCT m.c, m.li, m.page FROM mem m LEFT JOIN tot USING (c, li) WHERE m.page IS NOT NULL AND (NOT m.spilled OR tot.total > 0)),
pgn AS (SELECT c, li, count(*) AS n_pages, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM pgs GROUP BY c, li),
fold AS (SELECT d.c, d.li, count(*) AS folds FROM dat d JOIN tot USING (c, li) JOIN pgn USING (c, li)
  WHERE d.c % 5 = 0 AND d.n_rows = 4 AND d.w > 1 AND n_pages > 1 AND total > 1
    AND NOT (d.rank = last_rank AND EXISTS (SELECT 1 FROM mem s WHERE s.c = d.c AND s.li = d.li AND s.spilled))
    AND NOT (d.hr IS NOT NULL AND EXISTS (SELECT 1 FROM dat n WHERE n.c = d.c AND n.li = d.li AND n.has_cont AND n.rank = (SELECT min(z.rank) FROM dat z WHERE z.c = d.c AND z.li = d.li AND z.rank > d.rank)))
  GROUP BY d.c, d.li),
why AS (SELECT c, li, string_agg(reason, '+' ORDER BY pass_no, o1, o2) AS merge_reason FROM (
    SELECT d.c, x.li, 1 AS pass_no, o.rn AS o1, 0 AS o2, reason FROM dec d JOIN tab x ON x.c = d.c AND x.p = d.pa JOIN tab y ON y.c = d.c AND y.p = d.pb AND y.li = x.li JOIN ord o ON o.c = d.c AND o.p = d.pb WHERE reason IN {merge}
    UNION ALL SELECT e.c, x.li, 2, e.pa, e.pb, reason FROM edge e JOIN tab x ON x.c = e.c AND x.p = e.pa) z GROUP BY c, li)
""".format(merge=_MERGE)

_N_ROWS = "CAST(coalesce(total, 0) - coalesce(folds, 0) AS INT)"
_TABLES = "(SELECT c, li, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY rank) AS members, CAST(max(w) FILTER (WHERE NOT spilled) AS INT) AS n_columns, count(*) AS n FROM mem GROUP BY c, li) g LEFT JOIN tot USING (c, li) LEFT JOIN pgn USING (c, li) LEFT JOIN fold USING (c, li) LEFT JOIN why USING (c, li)"


#: The rebuilt tables cell by cell: (c, li, pos, j, v) in `out`, column names in `named`. Long tables of cells throughout.
_CELLS = BUILT + """,
nrm AS (SELECT *, min(rank) OVER (PARTITION BY c, li) AS lead_rank FROM mem WHERE NOT spilled),
wid AS (SELECT n.c, n.li, any_value(h.hr) AS hr, max(n.w) AS widest, max(n.w) FILTER (WHERE n.rank = n.lead_rank) AS base FROM nrm n JOIN hdr h USING (c, li) GROUP BY n.c, n.li),
wd AS (SELECT *, CASE WHEN hr IS NOT NULL OR {widens} THEN widest ELSE base END AS w FROM wid),
cell1 AS (SELECT d.c, d.li, d.rank, x.i, x.j, x.cell, d.w AS own_w, wd.w, wd.hr FROM dat d JOIN wd USING (c, li) JOIN cells x ON x.c = d.c AND x.p = d.p),
tail AS (SELECT c, li, rank, i, string_agg(trim(cell), ' ' ORDER BY j) AS t FROM cell1 WHERE {tails} AND hr IS NULL AND j >= w AND trim(cell) <> '' GROUP BY c, li, rank, i),
slot AS (SELECT d.c, d.li, d.rank, r.i, g.j, wd.w, wd.hr FROM dat d JOIN wd USING (c, li) JOIN r ON r.c = d.c AND r.p = d.p JOIN (SELECT unnest(range(0, 10)) AS j) g ON g.j < wd.w),
cell2 AS (SELECT s.*, CASE WHEN t.t IS NULL OR s.j <> s.w - 1 THEN coalesce(x.cell, '') WHEN trim(coalesce(x.cell, '')) = '' THEN t.t ELSE rtrim(x.cell) || ' ' || t.t END AS v
          FROM slot s LEFT JOIN cell1 x ON x.c = s.c AND x.li = s.li AND x.rank = s.rank AND x.i = s.i AND x.j = s.j LEFT JOIN tail t ON t.c = s.c AND t.li = s.li AND t.rank = s.rank AND t.i = s.i),
nums AS (SELECT c, li, rank, i, row_number() OVER (PARTITION BY c, li ORDER BY rank, i) - 1 AS n FROM (SELECT DISTINCT c, li, rank, i FROM slot) z),
size AS (SELECT c, li, max(n) + 1 AS total FROM nums GROUP BY c, li),
cont AS (SELECT d.c, d.li, q.rank AS to_rank, q.n_rows - 1 AS to_i, g.j, g.t, d.hr,
           (SELECT {grown} FROM nrm z WHERE z.c = d.c AND z.li = d.li AND z.rank < d.rank) AS w_then, coalesce(d.page, 0) - coalesce(q.page, 0) AS gap
         FROM dat d JOIN dat q ON q.c = d.c AND q.li = d.li AND q.rank = (SELECT max(z.rank) FROM dat z WHERE z.c = d.c AND z.li = d.li AND z.rank < d.rank) JOIN (SELECT 0 AS j, 'cont' AS t UNION ALL SELECT 2, 'more') g ON true WHERE d.has_cont),
cell3 AS (SELECT x.c, x.li, x.rank, x.i, x.j, x.w, CASE WHEN k.t IS NULL THEN v WHEN x.hr IS NOT NULL THEN v || chr(10) || k.t WHEN trim(v) <> '' AND k.gap <= 1 AND k.j < k.w_then THEN v || ' ' || k.t ELSE v END AS v
          FROM cell2 x LEFT JOIN cont k ON k.c = x.c AND k.li = x.li AND k.to_rank = x.rank AND k.to_i = x.i AND k.j = x.j),
spl AS (SELECT m.c, m.li, string_agg(x.cell, ' ' ORDER BY m.rank, x.i) AS t FROM mem m JOIN cells x ON x.c = m.c AND x.p = m.p AND x.j = 0 WHERE m.spilled AND trim(x.cell) <> '' GROUP BY m.c, m.li),
cell4 AS (SELECT c, li, n, j, w, CASE WHEN s.t IS NULL OR j <> w - 1 OR n <> total - 1 THEN v WHEN trim(v) <> '' THEN trim(v) || ' ' || s.t ELSE s.t END AS v
          FROM cell3 JOIN nums USING (c, li, rank, i) JOIN size USING (c, li) LEFT JOIN spl s USING (c, li)),
lbl AS (SELECT wd.c, wd.li, wd.w, g.j, x.name AS own FROM wd JOIN (SELECT unnest(range(0, 10)) AS j) g ON g.j < wd.w JOIN nrm n ON n.c = wd.c AND n.li = wd.li AND n.rank = n.lead_rank LEFT JOIN names x ON x.c = n.c AND x.p = n.p AND x.j = g.j WHERE wd.hr IS NULL),
ext AS (SELECT n.c, n.li, n.rank, x.j, x.name, (SELECT max(z.w) FROM nrm z WHERE z.c = n.c AND z.li = n.li AND z.rank < n.rank) AS w_then FROM nrm n JOIN names x ON x.c = n.c AND x.p = n.p),
raw AS (
  SELECT l.c, l.li, l.j, coalesce(l.own, (SELECT concat('_extra_', CAST(e.j - e.w_then AS VARCHAR), '_', trim(e.name)) FROM ext e WHERE e.c = l.c AND e.li = l.li AND e.j = l.j AND e.j >= e.w_then ORDER BY e.rank LIMIT 1)) AS name FROM lbl l
  UNION ALL
  SELECT wd.c, wd.li, g.j, CASE WHEN g.j >= h.w THEN concat('col_', CAST(g.j AS VARCHAR))
      WHEN EXISTS (SELECT 1 FROM dat d WHERE d.c = wd.c AND d.li = wd.li AND d.has_cont AND d.rank = (SELECT min(z.rank) FROM dat z WHERE z.c = wd.c AND z.li = wd.li)) AND g.j IN (0, 2) THEN x.cell || CASE WHEN g.j = 0 THEN ' cont' ELSE ' more' END ELSE x.cell END
  FROM wd JOIN mem h ON h.c = wd.c AND h.li = wd.li AND h.rank = wd.hr JOIN (SELECT unnest(range(0, 10)) AS j) g ON g.j < wd.w LEFT JOIN cells x ON x.c = h.c AND x.p = h.p AND x.i = 0 AND x.j = g.j),
named AS (SELECT c, li, j, name, CASE WHEN len(string_split(trim(name), '.')) = 2 AND lower(trim(string_split(trim(name), '.')[1])) = lower(trim(string_split(trim(name), '.')[2])) THEN trim(string_split(trim(name), '.')[1]) ELSE trim(name) END AS shown FROM raw),
lnk AS (SELECT c, li, coalesce(max(j) FILTER (WHERE regexp_matches(lower(name), 'content|ref|desc|link|url')), max(j)) AS j FROM raw GROUP BY c, li),
kind AS (SELECT c, li, n, count(*) FILTER (WHERE trim(v) <> '') AS filled, max(j) FILTER (WHERE trim(v) <> '') AS spot, max(trim(v)) AS said FROM cell4 GROUP BY c, li, n),
goes AS (SELECT k.c, k.li, k.n, n > 0 AND n_pages > 1 AND total > 1 AND filled = 1 AND spot > 0 AS g, CASE WHEN contains(said, '://') OR lower(said) LIKE 'http%' THEN lnk.j ELSE spot END AS j, said FROM kind k JOIN size USING (c, li) JOIN lnk USING (c, li) LEFT JOIN pgn USING (c, li)),
head AS (SELECT c, li, n, row_number() OVER (PARTITION BY c, li ORDER BY n) - 1 AS pos, lead(n, 1, 1000000) OVER (PARTITION BY c, li ORDER BY n) AS nxt FROM goes WHERE g IS NOT TRUE),
add AS (SELECT h.c, h.li, h.n, x.j, string_agg(x.said, ' ' ORDER BY x.n) AS t FROM head h JOIN goes x ON x.c = h.c AND x.li = h.li AND x.n > h.n AND x.n < h.nxt GROUP BY h.c, h.li, h.n, x.j),
out AS (SELECT h.c, h.li, h.pos, x.j, CASE WHEN a.t IS NULL THEN x.v WHEN trim(x.v) = '' THEN a.t ELSE rtrim(x.v) || ' ' || a.t END AS v
        FROM head h JOIN cell4 x ON x.c = h.c AND x.li = h.li AND x.n = h.n LEFT JOIN add a ON a.c = h.c AND a.li = h.li AND a.n = h.n AND a.j = x.j)
"""


def _cells(policy: str) -> str:
    keeps = policy == "preserve_extra"
    return _CELLS.format(widens="true" if keeps else "false", tails="true" if policy == "merge_tail" else "false", grown="max(z.w)" if keeps else "max(z.w) FILTER (WHERE z.rank = z.lead_rank)")


_ROWS = "SELECT concat('c', c) AS doc_id, li AS logical_index, CAST(pos AS INT) AS row_pos, CAST(j AS INT) AS col_pos, v AS cell FROM out"

_DOC = "concat('c', c) AS doc_id"

#: What the tables of the documents hold after stitching: anchors (rows of `out` under their old header rows) and tables of one member.
_BACK = _cells("preserve_extra") + """, every AS (SELECT m.c, m.li, m.p, m.idx, m.page, m.w, m.headerless, m.n_rows, n_members FROM mem m JOIN hdr USING (c, li) WHERE m.rank = 0),
one AS (SELECT * FROM every WHERE n_members = 1 OR (c, li) IN (SELECT c, li FROM out)),
bare AS (SELECT a.c, a.idx, 0 AS row_pos, j, shown AS t, false AS side FROM every a JOIN named USING (c, li) WHERE n_members > 1 AND (c, li) NOT IN (SELECT c, li FROM out)),
lead AS (SELECT c, idx, 0 AS row_pos, j, t FROM one, (SELECT 0 AS j, ' ' AS t UNION ALL SELECT 1, '') b
  UNION ALL SELECT a.c, a.idx, 1, x.j, x.name FROM one a JOIN names x ON x.c = a.c AND x.p = a.p WHERE NOT a.headerless
  UNION ALL SELECT a.c, a.idx, 1, x.j, x.cell FROM one a JOIN cells x ON x.c = a.c AND x.p = a.p AND x.i = 0 WHERE a.headerless),
kept AS (SELECT a.c, a.idx, x.i + CASE WHEN headerless THEN 1 ELSE 2 END AS row_pos, x.j, x.cell AS t, true AS side FROM one a JOIN cells x ON x.c = a.c AND x.p = a.p WHERE n_members = 1 AND (x.i > 0 OR NOT headerless)),
grown AS (SELECT a.c, a.idx, o.pos + 2 AS row_pos, o.j, o.v AS t, NOT a.headerless OR a.n_rows > 1 AS side FROM one a JOIN out o ON o.c = a.c AND o.li = a.li WHERE n_members > 1),
page AS (SELECT c, idx, 0 AS row_pos, j, t, true AS side FROM lead WHERE row_pos = 0 UNION ALL SELECT c, idx, 1, j, t, true FROM lead WHERE row_pos = 1 UNION ALL SELECT * FROM kept UNION ALL SELECT * FROM grown UNION ALL SELECT * FROM bare)
"""

_TRIM = "regexp_replace(regexp_replace(cell, '^\\s+', ''), '\\s+$', '')"
_PATTERNS = ("\\d+$", "\\d+\\.\\d+$", "\\d{1,2}/\\d{1,2}", "\\d{1,2}-\\d{1,2}", "https?://", "[A-Z]+-\\d+$", "\\$[\\d,]+", "[\\d,]+\\s*%$", "Row\\s*\\d+", "\\d+\\.\\d+\\.\\d+", "[\\d,]+\\.\\d+$", "[\\d,]+$", "\\d+\\.?\\d*\\s*\\([\\d,\\s.]+\\)", "\\d+\\.?\\d*\\s*[xX×]\\s*10")
_DATA = " OR ".join(f"regexp_matches(s, '(?i)^{p}')" for p in _PATTERNS)


def oracle_sql() -> dict[str, str]:
    pair = f"SELECT {_DOC}, CAST(ia AS INT) AS left_idx, CAST(ib AS INT) AS right_idx"
    decisions = lambda gap, same: BASE + f", dec AS (SELECT *, {_reasons(gap, same)} AS reason FROM js) {pair}, reason IN {_MERGE} AS merged, reason FROM dec"
    height = "CASE WHEN page IN (1, 2) THEN 800.0 ELSE 842.0 END"
    at = lambda x: f"CASE WHEN page IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL THEN round(1 - (1 - {x}) * 800 / {height}, 6) END"
    whole = "2 + CASE WHEN headerless THEN 0 ELSE w END + n_rows * w"
    first_cell = "(SELECT cell FROM cells x WHERE x.c = js.c AND x.p = js.pb AND x.i = 0 AND x.j = 0)"
    said = f"""(SELECT CASE WHEN one NOT SIMILAR TO '.*[0-5]' THEN one WHEN js.pb % 2 = 0 THEN 'see AB-' || one WHEN f.n_rows % 2 = 0 THEN 'HTTP ' || one ELSE 'ab-' || one END FROM (SELECT {first_cell} AS one) z, f WHERE f.c = js.c AND f.p = js.pb)"""
    return {
        "merged_rows_preserve": _cells("preserve_extra") + _ROWS,
        "merged_rows_warn_drop": _cells("warn_drop") + _ROWS,
        "merged_rows_merge_tail": _cells("merge_tail") + _ROWS,
        "logical_columns": _cells("preserve_extra") + f"SELECT {_DOC}, li AS logical_index, string_agg(shown, '|' ORDER BY j) AS columns FROM named GROUP BY c, li",
        "orphan_tables": _cells("preserve_extra") + f"""SELECT {_DOC}, li AS logical_index, CAST((SELECT count(*) FROM head h WHERE h.c = n.c AND h.li = n.li) AS INT) AS n_rows, string_agg(shown, '|' ORDER BY j) AS columns
            FROM named n JOIN hdr USING (c, li) WHERE hr IS NOT NULL GROUP BY c, li""",
        "anchor_grid": _BACK + f"SELECT {_DOC}, idx, CAST(row_pos AS INT) AS row_pos, CAST(j AS INT) AS col_pos, t AS text, row_pos <= 1 AS column_header, j = 0 AND side AS row_header FROM page WHERE (c, idx) IN (SELECT c, idx FROM every WHERE n_members > 1)",
        "stitched_documents": _BACK + f"SELECT {_DOC}, idx, CAST(row_pos AS INT) AS row_pos, CAST(j AS INT) AS col_pos, t AS text, row_pos <= 1 AS column_header, j = 0 AND side AS row_header FROM page",
        "document_tables": _BACK + f"""SELECT {_DOC}, m.idx, CAST(CASE WHEN rank > 0 THEN 0 ELSE g.height END AS INT) AS num_rows, CAST(CASE WHEN rank > 0 THEN 0 WHEN n_members > 1 THEN wd.w ELSE greatest(m.w, 2) END AS INT) AS num_cols,
            CAST(CASE WHEN rank > 0 THEN 0 ELSE g.n END AS INT) AS n_cells, CASE WHEN rank > 0 THEN '' ELSE coalesce((SELECT string_agg(CAST(x.page AS VARCHAR), ',' ORDER BY x.rank) FROM mem x WHERE x.c = m.c AND x.li = m.li), '') END AS pages,
            CASE WHEN rank > 0 THEN 0 ELSE 1 END AS refs, 'table ' || m.idx AS label
            FROM mem m JOIN hdr USING (c, li) JOIN wd USING (c, li) LEFT JOIN (SELECT c, idx, max(row_pos) + 1 AS height, count(*) AS n FROM page GROUP BY c, idx) g ON g.c = m.c AND g.idx = m.idx""",
        "document_shells": BUILT + f"""SELECT {_DOC}, max(n_members) = 1 AS unchanged, CAST(max(idx) + 1 AS INT) AS n_tables, '{{"list":[1,null,"x"],"n":1.5}}' AS origin FROM mem JOIN hdr USING (c, li) GROUP BY c""",
        "document_html": _BACK + f""", tr AS (SELECT c, idx, row_pos, string_agg(CASE WHEN row_pos <= 1 OR (j = 0 AND side) THEN '<th>' || t || '</th>' ELSE '<td>' || t || '</td>' END, '' ORDER BY j) AS h FROM page GROUP BY c, idx, row_pos),
            tb AS (SELECT c, idx, '<table>' || string_agg('<tr>' || h || '</tr>', '' ORDER BY row_pos) || '</table>' AS h FROM tr GROUP BY c, idx)
            SELECT {_DOC}, '<html><body>' || string_agg(h, '' ORDER BY idx % 2 DESC, idx) || '</body></html>' AS html FROM tb GROUP BY c""",
        "snapshot_errors": BASE + f"""SELECT {_DOC}, CAST(g AS INT) AS idx, 'data.grid holds no rows but is of type bigint' AS error, CAST(n AS INT) AS extracted
            FROM (SELECT c, unnest(range(0, max(idx))) AS g, count(*) AS n FROM f GROUP BY c) z WHERE g NOT IN (SELECT idx FROM f x WHERE x.c = z.c)""",
        "span_grids": BASE + f""", rw AS (SELECT r.*, i + 2 AS row_pos FROM r)
            SELECT {_DOC}, p AS idx, CAST(row_pos AS INT) AS row_pos, CAST(j AS INT) AS col_pos, t AS text, h AS header FROM (
              SELECT c, p, row_pos, 0 AS j, CAST(k AS VARCHAR) AS t, false AS h FROM rw
              UNION ALL SELECT a.c, a.p, a.row_pos, 1, b.s, false FROM rw a JOIN rw b ON b.c = a.c AND b.p = a.p AND b.i = a.i - a.i % 2
              UNION ALL SELECT c, p, row_pos, 2, CASE WHEN c % 4 = 0 AND i = 0 THEN 'over' ELSE pr END, false FROM rw
              UNION ALL SELECT c, p, row_pos, 3, CASE WHEN c % 4 = 0 AND i = 0 THEN 'over' WHEN k % 3 = 0 THEN '' ELSE CAST(y AS VARCHAR) END, false FROM rw
              UNION ALL SELECT c, p, n.row_pos, j, t, h FROM (SELECT DISTINCT c, p FROM r) z,
                (VALUES (0, 0, 'order', true), (0, 1, 'order', true), (0, 2, 'priority', true), (0, 3, '', false), (1, 0, 'key', true), (1, 1, 'status', true), (1, 2, 'priority', true), (1, 3, 'year', true)) n(row_pos, j, t, h)) q""",
        "span_tables": BASE + f"""SELECT {_DOC}, p AS idx, 'order.key|order.status|priority.priority|year' AS columns, false AS is_headerless, CAST(count(*) AS INT) AS row_count, CAST(p + 1 AS INT) AS start_page,
              string_agg(concat(k, '|', b, '|', CASE WHEN c % 4 = 0 AND i = 0 THEN 'over|over' ELSE concat(pr, '|', CASE WHEN k % 3 = 0 THEN '' ELSE CAST(y AS VARCHAR) END) END), '/' ORDER BY i) AS cells
            FROM (SELECT *, first_value(s) OVER (PARTITION BY c, p, i - i % 2 ORDER BY i) AS b FROM r) z GROUP BY c, p""",
        "spillover_pairs_by_content": BASE + f"""{pair} FROM js WHERE hb AND wb = 1 AND wa > 1 AND gb - ga = 1 AND (contains(lower({said}), 'http') OR regexp_matches({said}, '[A-Z]+-[0-9]+') OR (SELECT n_rows FROM f y WHERE y.c = js.c AND y.p = js.pb) <= 2)""",
        "logical_tables": BUILT + f"SELECT {_DOC}, li AS logical_index, members, coalesce(pages, '') AS pages, coalesce(merge_reason, '') AS merge_reason, {_N_ROWS} AS n_rows, n_columns FROM {_TABLES}",
        "run_metrics": BUILT + f"SELECT {_DOC}, CAST(sum(n) AS BIGINT) AS fragments, count(*) AS logical_tables, count(*) FILTER (WHERE n > 1) AS merged_tables, CAST(sum({_N_ROWS}) AS BIGINT) AS rows FROM {_TABLES} GROUP BY c",
        "phase_rows": BUILT + f"""SELECT phase, CAST(n AS BIGINT) AS rows FROM (
            SELECT 'fragments' AS phase, count(*) AS n FROM f UNION ALL SELECT 'fragment rows', count(*) FROM r UNION ALL SELECT 'pairs', count(*) FROM dec UNION ALL SELECT 'islands', count(*) FROM isl
            UNION ALL SELECT 'edges', count(*) FROM edge UNION ALL SELECT 'groups', count(*) FROM tab UNION ALL SELECT 'tables', count(*) FROM hdr UNION ALL SELECT 'rows', sum({_N_ROWS}) FROM {_TABLES}) z""",
        "passthrough_cells": BUILT + f"SELECT {_DOC}, idx, CAST({whole} AS BIGINT) AS cells FROM mem JOIN hdr USING (c, li) WHERE n_members = 1",
        "prov_merge": BUILT + f"""SELECT {_DOC}, idx, CASE WHEN rank > 0 THEN '' ELSE coalesce((SELECT string_agg(CAST(x.page AS VARCHAR), ',' ORDER BY x.rank) FROM mem x WHERE x.c = mem.c AND x.li = mem.li), '') END AS pages, rank > 0 AS cleared FROM mem""",
        "overflow_warnings": BUILT + f"""SELECT {_DOC}, li AS logical_index, concat('table ', idx, ' (page ', coalesce(CAST(page AS VARCHAR), 'unknown'), ') has ', w, ' columns where ', b, ' fit; cut: ',
            (SELECT string_agg(name, ', ' ORDER BY j) FROM names n WHERE n.c = x.c AND n.p = x.p AND j >= b)) AS warning
            FROM (SELECT dat.*, first_value(w) OVER (PARTITION BY c, li ORDER BY rank) AS b FROM dat WHERE hr IS NULL) x WHERE w > b
            UNION ALL SELECT concat('c', d.c), x.li, concat('tables ', (SELECT string_agg(CAST(g AS VARCHAR), ', ' ORDER BY g) FROM (SELECT unnest(range(ia + 1, ib)) AS g) z WHERE g NOT IN (SELECT idx FROM f WHERE f.c = d.c)), ' lie between the two and were not read')
            FROM dec d JOIN tab x ON x.c = d.c AND x.p = d.pa JOIN tab y ON y.c = d.c AND y.p = d.pb AND y.li = x.li WHERE reason = 'unextracted_table_between'""",
        "fragment_pages": BASE + f"SELECT {_DOC}, idx, page AS start_page, coalesce(CAST(page AS VARCHAR), '') AS pages, {at('top')} AS vert_top, {at('bottom')} AS vert_bottom FROM f",
        "headerless_flags": BASE + f"SELECT {_DOC}, idx, headerless AS is_headerless, CAST(w AS INT) AS width, n_rows AS row_count, 0 AS n_continuation FROM f",
        "header_orphans": BASE + f"SELECT {_DOC}, idx, false AS is_header_orphan, true AS is_data_orphan FROM f",
        "tokens_documents": """SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest
            FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '\\p{L}+'), lambda x: lower(x))) AS t FROM documents)""",
        "tokens_headers": BASE + f"SELECT {_DOC}, idx, coalesce((SELECT string_agg(t, ' ' ORDER BY t) FROM htok h WHERE h.c = f.c AND h.p = f.p), '') AS tokens FROM f",
        "jaccard_pairs": BASE + f"SELECT {_DOC}, CAST(ib AS INT) AS right_idx, round(hs, 9) AS header_similarity, round(rs, 9) AS row_similarity FROM js",
        "pair_signals": BASE + f"{pair}, ga AS left_page, gb AS right_page, CAST(gb - ga AS INT) AS page_gap, CAST(abs(wa - wb) AS INT) AS width_diff, ha AS left_headerless, hb AS right_headerless, layout AS layout_continuation FROM js",
        "pair_decisions": decisions(1, False),
        "pair_decisions_same_width": decisions(3, True),
        "decision_counts": DECIDED + "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT reason FROM dec UNION ALL SELECT reason FROM edge) x GROUP BY reason",
        "missing_index_guard": DECIDED + f"{pair}, concat('tables ', (SELECT string_agg(CAST(g AS VARCHAR), ', ' ORDER BY g) FROM (SELECT unnest(range(ia + 1, ib)) AS g) z WHERE g NOT IN (SELECT idx FROM f WHERE f.c = dec.c)), ' lie between the two and were not read') AS warning FROM dec WHERE reason = 'unextracted_table_between'",
        "spillover_pairs": BASE + f"{pair} FROM js WHERE hb AND wb = 1 AND wa > 1 AND gb - ga = 1",
        "layout_pairs": BASE + f"{pair} FROM js WHERE layout",
        "unique_token_pairs": BASE + f"{pair} FROM js WHERE both_own",
        "orphan_edges": DECIDED + f"{pair}, reason FROM edge",
        "components": DECIDED + f"SELECT {_DOC}, idx, li AS logical_index, rank FROM tab",
        "trace_attachment": DECIDED + f"""SELECT {_DOC}, x.li AS logical_index, pass_no, left_idx, right_idx, merged, reason FROM (
            SELECT c, 1 AS pass_no, ia AS left_idx, ib AS right_idx, reason IN {_MERGE} AS merged, reason FROM dec UNION ALL SELECT c, 2, ia, ib, true, reason FROM edge) d
            JOIN (SELECT c, idx, li FROM tab) x USING (c) JOIN (SELECT c, idx, li FROM tab) y USING (c) WHERE x.idx = left_idx AND y.idx = right_idx AND x.li = y.li""",
        "satellite_clear": DECIDED + f"SELECT {_DOC}, t.idx, CAST((SELECT idx FROM tab z WHERE z.c = t.c AND z.li = t.li AND z.rank = 0) AS INT) AS anchor FROM tab t WHERE rank > 0",
        "pruned_refs": DECIDED + f"SELECT {_DOC}, p AS ord, 'tables' AS kind, idx AS item FROM tab WHERE rank = 0",
        "overflow_fail_check": DECIDED + f"""SELECT {_DOC}, idx, w AS width, base_width FROM (
            SELECT t.*, f.w, first_value(f.w) OVER (PARTITION BY t.c, t.li ORDER BY rank) AS base_width, max(CASE WHEN f.header_orphan AND NOT s THEN 1 ELSE 0 END) OVER (PARTITION BY t.c, t.li) AS orphan
            FROM (SELECT tab.*, coalesce((SELECT d.reason = 'spillover' FROM dec d WHERE d.c = tab.c AND d.pb = tab.p), false) AS s FROM tab) t JOIN f ON f.c = t.c AND f.p = t.p WHERE NOT s) x WHERE orphan = 0 AND w > base_width""",
        "cell_shapes": "WITH x AS (SELECT id, cell, " + _TRIM + f" AS s FROM ({_SHAPES}) q), y AS (SELECT *, s <> '' AND ({_DATA}) AS d FROM x)" + """
            SELECT id, d AS is_data, CASE WHEN NOT d THEN 'none' WHEN regexp_matches(s, '(?i)^https?://') THEN 'url' WHEN s LIKE '$%' THEN 'currency' WHEN s LIKE '%\\%' ESCAPE '\\' THEN 'percent'
              WHEN regexp_matches(s, '^\\d{1,2}[/-]\\d{1,2}') THEN 'date_like' WHEN regexp_full_match(s, '\\d+') THEN 'bare_int' WHEN regexp_full_match(s, '[\\d,]+') THEN 'grouped_int'
              WHEN regexp_full_match(s, '[\\d,]+\\.\\d+') THEN 'float' ELSE 'other_data' END AS shape,
              s = '' OR (length(s) <= 30 AND NOT d AND NOT regexp_matches(s, '(?i)^(column|unnamed)[_:]?\\s*\\d+$')) AS is_header, s = '' AS is_blank FROM y""",
        "clean_headers": """SELECT p_partkey, CASE WHEN lower(a) = lower(b) THEN a ELSE whole END AS name, CASE WHEN a = b THEN a ELSE whole END AS grid_name
            FROM (SELECT p_partkey, p_brand AS a, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_type END AS b, p_brand || '.' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_type END AS whole FROM part)""",
        "numeric_colnames": """SELECT o_orderkey, (CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END) / 3.0 >= 0.7 AS numeric_like,
            regexp_matches(o_orderpriority, '[0-9]') AS has_digit FROM orders""",
        "header_contrast": "SELECT o_orderkey, o_orderkey % 2 = 0 AS is_header FROM orders",
        "content_before": """WITH o AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INT) AS turn, turn % 4 = 0 AS t, turn % 4 <> 0 AND turn % 3 = 1 AND conv_id % 5 <> 0 AS blocks FROM conversations)
            SELECT doc_id, turn AS idx, turn > 0 AND EXISTS (SELECT 1 FROM o p WHERE p.doc_id = o.doc_id AND p.t AND p.turn < o.turn) AND EXISTS (SELECT 1 FROM o b WHERE b.doc_id = o.doc_id AND b.blocks AND b.turn < o.turn AND b.turn > o.turn - 4) AS content_before FROM o WHERE t""",
        "reading_order": """WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INT) AS turn FROM conversations)
            SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn // 4, CASE WHEN turn % 4 = 2 THEN 1 ELSE 0 END, turn) - 1 AS INT) AS ord, 'texts' AS kind, turn AS item FROM n WHERE turn % 4 <> 0""",
        "running_furniture": """WITH t AS (SELECT lang, doc_id, doc_id % 50 AS page, list_distinct(list_transform(regexp_extract_all(text, '\\p{L}+'), lambda x: lower(x))) AS k FROM documents),
            w AS (SELECT lang, doc_id, page, len(k) AS n, unnest(k) AS t FROM t),
            m AS (SELECT a.lang, a.doc_id, a.n AS na, b.n AS nb, b.doc_id AS other, count(*) AS s FROM w a JOIN w b ON a.lang = b.lang AND a.t = b.t AND a.page <> b.page GROUP BY ALL)
            SELECT DISTINCT lang AS doc_id, CAST(doc_id AS INT) AS item FROM m WHERE CAST(s AS DOUBLE) / (na + nb - s) >= 0.8""",
    }
