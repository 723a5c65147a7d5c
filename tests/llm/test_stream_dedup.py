"""Exact dedup as a stream: against a plain loop, over several batches and restarts, with digests that clash."""

import hashlib

import pytest

from pagespan.llm import stream_dedup
from pagespan.llm.stream_dedup import StreamDedup, dedup_exact

SCHEMA = "doc_id long, text string, digest string, path string"


def brute(rows):
    """{(doc_id, sha): [(keep_id, size, kept), ...]} of (doc_id, text)."""
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        left = 1
        for d in sorted(ids, key=lambda d: d != best):
            out.append((d, best, len(ids), bool(left), hashlib.sha256(t.encode()).hexdigest()))
            left = 0
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


ROWS = [(i, f"text {i % 7}") for i in range(40)] + [(100, None), (101, ""), (102, "é" * 3), (None, "text 1"), (None, "alone"), (None, "alone"), (5, "text 5"), (39, "text 4"), (7, "x " * 50_000), (8, "x " * 50_000), (-(2**63), "low"), (2**63 - 1, "low")]


def write(spark, rows, path, parts=4, mode="append"):
    spark.createDataFrame([(d, t, "k", "p") for d, t in rows], SCHEMA).repartition(parts).write.mode(mode).parquet(path)


def test_equals_a_plain_loop(spark, tmp_path):
    at = f"file://{tmp_path}/docs"
    write(spark, ROWS, at)
    assert got(dedup_exact(spark, at)) == brute(ROWS)
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/none")
    assert dedup_exact(spark, f"file://{tmp_path}/none").count() == 0


def test_batches_and_restarts(spark, tmp_path):
    at, home = f"file://{tmp_path}/docs", f"file://{tmp_path}/home"
    write(spark, ROWS[:20], at, 3)
    first = StreamDedup(spark, at, home, per_batch=1).ingest()
    assert got(first.results()) == brute(ROWS[:20])
    write(spark, ROWS[20:], at, 3)
    again = StreamDedup(spark, at, home, per_batch=2).ingest()  # another object: state and offsets are in its folder
    assert got(again.results()) == brute(ROWS)
    assert again.contents().select("batch").distinct().count() >= 4
    assert got(StreamDedup(spark, at, home).ingest().results()) == brute(ROWS)  # nothing new


@pytest.mark.parametrize("bits", [0, 2])
def test_clashing_digests_are_split_by_full_bytes(spark, tmp_path, bits):
    at = f"file://{tmp_path}/docs"
    write(spark, ROWS, at, 5)
    weak = lambda raw: bytes([hashlib.md5(raw).digest()[0] & ((1 << bits) - 1)])
    d = StreamDedup(spark, at, f"file://{tmp_path}/home", digest=weak, per_batch=2).ingest()
    clash = [k for k in range(1 << bits) if sum(weak(t.encode())[0] == k for t in {t or "" for _, t in ROWS}) > 1]
    assert clash and sorted(r.digest[0] for r in d.refuted().collect()) == clash
    assert got(d.results()) == brute(ROWS)


def test_a_task_that_forgets_texts_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_dedup, "KEEP_BYTES", 700)
    at = f"file://{tmp_path}/docs"
    write(spark, ROWS, at, 2)
    assert got(dedup_exact(spark, at)) == brute(ROWS)


def test_copies_make_one_row_a_task(spark, tmp_path):
    at = f"file://{tmp_path}/docs"
    write(spark, [(i, "one and the same") for i in range(3000)], at, 4)
    d = StreamDedup(spark, at).ingest()
    assert d.contents().count() <= 4 and {r.group_size for r in d.results().collect()} == {3000}
