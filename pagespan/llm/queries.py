"""The queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.llm import chat_format, conversation_repair, decontam, filter_audit, imatch, kn_quality, line_dedup, mixing, ngram_join, secret_scan, span_dedup, stream_dedup, warc_revisits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.dedup_spans(_table(spark, sf_dir, "documents"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_chain(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.chat_digests(rows.unionByName(probe))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisits.resolve_revisits(warc_revisits.captures_of_pages(_table(spark, sf_dir, "pages")))
    return out.select("record_id", "canonical", "response_id", "outcome", F.coalesce(warc_revisits.header_text(F.col("headers")), F.lit("")).alias("headers"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.dedup_exact(spark, f"{sf_dir}/documents.parquet")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(_table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    own = (
        op1_span_dedup, op2_imatch, op3_chat_format, op4_quality, op5_warc_revisits, op6_secret_scan, op7_decontaminate, op8_mixing, op9_line_dedup, op10_ngram_join,
        op11_exact_dedup, op12_conversation_repair, op13_filter_audit,
    )
    return {f.__name__: f for f in own}


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP9 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], {_SPACES}), {_ABC}) AS k
         FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)),
lost AS (SELECT k, max(doc_id) AS last FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT line.*, lost.k IS NOT NULL AND line.doc_id <> lost.last AS gone FROM line LEFT JOIN lost USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = """
WITH p AS (
  SELECT page_id, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, substr(md5(coalesce(html, '')), 1, 1) AS d,
         CAST(length(coalesce(html, '')) AS VARCHAR) AS size, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS site,
         CAST(page_id // 100 AS VARCHAR) AS day, '"r' || CAST(page_id // 500 AS VARCHAR) || '"' AS robots FROM pages),
plain AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM p),
part AS (SELECT page_id, CASE WHEN lower(u) LIKE 'http://%' THEN regexp_replace(h, ':80$', '') WHEN lower(u) LIKE 'https://%' THEN regexp_replace(h, ':443$', '') ELSE h END AS host,
                regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
                list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS q FROM (SELECT *, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)) AS h FROM plain) z),
canon AS (SELECT page_id, host, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS c FROM part),
resp AS (
  SELECT page_id * 4 AS id, c AS k, page_id * 60 AS ts, etag, day AS lm, size, page_id FROM p JOIN canon USING (page_id)
  UNION ALL SELECT page_id * 4 + 2, host || '/robots.txt', page_id * 60, robots, NULL, NULL, page_id FROM p JOIN canon USING (page_id) WHERE d = '0'),
rev AS (
  SELECT page_id * 4 + 1 AS id, c AS k, page_id * 60 + 86400 AS ts, CASE WHEN d < '4' THEN NULL WHEN d < '6' THEN '"other"' ELSE etag END AS etag,
         CASE WHEN d < '4' THEN day END AS lm, CASE WHEN d < '4' OR d < '6' THEN 'plain' ELSE 'weak' END AS form, page_id FROM p JOIN canon USING (page_id)
  UNION ALL SELECT page_id * 4 + 2, host || '/robots.txt', page_id * 60, robots, NULL, 'robots', page_id FROM p JOIN canon USING (page_id) WHERE d <> '0'),
pair AS (
  SELECT rev.id, rev.k, rev.form, rev.etag AS e2, rev.lm AS l2, rev.page_id AS p2, (SELECT max_by(r.id, (r.ts, r.id)) FROM resp r WHERE r.k = rev.k AND r.ts < rev.ts) AS rid FROM rev),
done AS (
  SELECT pair.*, resp.etag AS e1, resp.lm AS l1, resp.size, resp.page_id AS p1,
    CASE WHEN rid IS NULL THEN 'no-response' WHEN resp.etag IS NOT NULL AND e2 IS NOT NULL THEN CASE WHEN resp.etag = e2 THEN 'resolved' ELSE 'etag-mismatch' END
         WHEN resp.lm IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN resp.lm = l2 THEN 'resolved' ELSE 'modified-since' END ELSE 'unvalidated' END AS outcome
  FROM pair LEFT JOIN resp ON resp.id = pair.rid)
SELECT id AS record_id, k AS canonical, rid AS response_id, outcome,
  CASE WHEN outcome <> 'resolved' THEN ''
       WHEN form = 'robots' THEN 'etag: ' || e2 || chr(10) || 'server: s' || CAST(p2 // 100 AS VARCHAR)
       ELSE 'cache-control: max-age=90' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
            || 'etag: ' || CASE WHEN form = 'weak' THEN 'W/' || e2 ELSE e1 END || chr(10) || 'last-modified: ' || l1 || chr(10) || 'server: a' END AS headers
FROM done
"""


OP11 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: A step for each row of all conversations at once: the cheapest audit for each grammar state.
OP12 = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN how = 3 THEN [1, 2] ELSE [1] END) AS copy FROM named WHERE how <> 0),
put AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
said AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM put),
keeps(s, r, s2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
nexts(s, s2) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
adds(s, k, s2) AS (SELECT s, 0, s FROM nexts UNION ALL SELECT s, 1, s2 FROM nexts UNION ALL SELECT a.s, 2, b.s2 FROM nexts a JOIN nexts b ON b.s = a.s2),
walk AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS i, adds.s2 AS s, min({'cost': CAST(5 * k AS BIGINT), 'audit': repeat('I', k)}) AS best FROM (SELECT DISTINCT conv_id FROM said) c, adds WHERE adds.s = 0 GROUP BY ALL
  UNION ALL
  SELECT conv_id, i, s, min({'cost': cost, 'audit': audit}) AS best FROM (
    SELECT e.conv_id, e.i, adds.s2 AS s, e.cost + 5 * k AS cost, e.audit || repeat('I', k) AS audit FROM (
      SELECT w.conv_id, x.i, w.s, w.best.cost + 2 AS cost, w.best.audit || 'D' AS audit FROM walk w JOIN said x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1
      UNION ALL SELECT w.conv_id, x.i, n.s2, w.best.cost + 1 + CASE WHEN fault = 't' THEN 5 ELSE 0 END, w.best.audit || 'R' FROM walk w JOIN said x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 AND fault IN ('', 't') JOIN nexts n ON n.s = w.s
      UNION ALL SELECT w.conv_id, x.i, n.s2, w.best.cost + CASE WHEN fault = 't' THEN 5 ELSE 0 END, w.best.audit || 'K' FROM walk w JOIN said x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 AND fault IN ('', 't') JOIN keeps n ON n.s = w.s AND n.r = x.r
    ) e JOIN adds ON adds.s = e.s) z GROUP BY conv_id, i, s),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal FROM said GROUP BY conv_id),
done AS (SELECT n.*, (SELECT min(best) FROM walk w WHERE w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n AND w.s IN (0, 3)) AS best FROM n),
letter AS (SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS j, best.audit AS a FROM done),
edit AS (SELECT conv_id, j, a[j] AS e, length(replace(a[:j], 'I', '')) AS i, length(replace(a[:j], 'D', '')) - 1 AS k, length(replace(a, 'D', '')) % 2 AS odd FROM letter),
turn AS (SELECT e.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k + odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
    FROM edit e LEFT JOIN said x ON x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.i = e.i WHERE e <> 'D' GROUP BY e.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN turn ON turn.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13 = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS bad FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, bad, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(c) AS (SELECT unnest(string_split('ABCDE', ''))),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM x a, x b, x d, x e, x g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT o, CAST(i AS INT) AS step, o[i] AS c, list_transform(string_split(o[:i - 1], ''), lambda q: CAST(ascii(q) - 64 AS INT)) AS before FROM o, range(1, 6) r(i)),
m AS (SELECT part, o AS filter_order, step, c, n, good, toxic, bad[ascii(c) - 64] AS fails, coalesce(list_bool_or(list_transform(list_filter(before, lambda q: q > 0), lambda q: bad[q])), false) AS gone, len(list_filter(bad, lambda b: b)) AS fails_in FROM cell, s),
g AS (SELECT part, filter_order, step, c, CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails AND fails_in = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_revisits": OP5, "op9_line_dedup": OP9, "op11_exact_dedup": OP11, "op12_conversation_repair": OP12, "op13_filter_audit": OP13}
