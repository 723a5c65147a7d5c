"""Substring dedup over sliding sentence spans.

A sentence ends with a word that ends in . ! or ? (closing quotes and brackets
may follow), at a line end, or after `max_words` words, so long sentences are cut
at the same places wherever they occur. From every sentence on, and back from
every sentence, the shortest run of at least `run` sentences and `min_words` words
within the text is hashed, so short sentences make longer runs; hashes are joined
over the corpus; all sentences covered by an occurrence that isn't the first
(smallest doc_id, then position) are removed.

Defined results: null or empty text has no sentences; rows without doc_id are
left out; of rows that share a doc_id only the one with the smallest text (null is
empty) is a document; an empty table gives no rows;
other columns are ignored. Repeats inside one document count too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespan.llm._store import one_text, pieces, release, texts_of, written
from pagespan.llm._text import U64, Words, blocks, distinct, mix, slices, words_of

_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]}")] = True


def sentences(w: Words, max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first word, words, hash and text number of every sentence of a block."""
    m = len(w.start)
    if not m:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), z
    last = w.data[w.end - 1]
    closing = _CLOSE[last] & (w.end - w.start > 1)
    stop = _END[last] | closing & _END[w.data[np.maximum(w.end - 2, 0)]]
    breaks = np.flatnonzero(w.data == 10)
    stop[:-1] |= np.searchsorted(breaks, w.start[1:]) > np.searchsorted(breaks, w.end[:-1])
    ends = w.first[1:][np.diff(w.first) > 0] - 1
    stop[ends] = True
    head = np.ones(m, bool)
    head[1:] = stop[:-1]
    at = np.flatnonzero(head)
    for a, n in _long(at, m, max_words):
        head[a : a + n : max_words] = True
    at = np.flatnonzero(head)
    words = np.diff(np.append(at, m))
    h = np.empty(len(at), U64)
    for part in slices(len(at), 1 << 17):
        own, n = at[part], words[part]
        lo, hi = own[0], own[-1] + n[-1]
        place = np.arange(lo, hi) - np.repeat(own, n)
        with np.errstate(over="ignore"):
            h[part] = np.add.reduceat(mix(w.hash[lo:hi] + mix(place.astype(U64), 41), 43), own - lo)
    return at, words, mix(h ^ words.astype(U64)), np.searchsorted(w.first, at, "right") - 1


def _long(at: np.ndarray, m: int, max_words: int):
    """(first word, words) of the sentences that have to be cut."""
    n = np.diff(np.append(at, m))
    over = np.flatnonzero(n > max_words)
    return zip(at[over].tolist(), n[over].tolist(), strict=True)


def spans(w: Words, run: int, min_words: int, max_words: int):
    """text number, number of the first sentence within the text, sentences and hash of every run."""
    _, words, h, text = sentences(w, max_words)
    m = len(h)
    if m < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    total = np.concatenate([[0], np.cumsum(words)])
    no = np.arange(m)
    # ahead from the first sentence, and back from the last one, so that no sentence at either end of a repeat is left out
    ahead = np.maximum(np.searchsorted(total, total[:-1] + min_words), no + run)
    back = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, no + 1 - run)
    ends = distinct(np.concatenate([no * (m + 1) + np.minimum(ahead, m), np.maximum(back, 0) * (m + 1) + no + 1]))
    at, end = ends // (m + 1), ends % (m + 1)
    ok = (text[at] == text[end - 1]) & (end - at >= run) & (total[end] - total[at] >= min_words)
    at, n = at[ok], (end - at)[ok]
    s = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for j in range(int(n.max(initial=0))):
            on = np.flatnonzero(n > j) if j >= run else slice(None)
            s[on] = mix(s[on] + h[at[on] + j], 47 + j)
    return text[at], at - np.searchsorted(text, text[at], "left"), n, s


def _spans(run, min_words, max_words):
    def go(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, _, w in blocks(b.column("text")):
                t, no, n, h = spans(w, run, min_words, max_words)
                if len(t):
                    cols = [pa.array(h.view(np.int64)), pa.array(ids[lo + t]), pa.array(no.astype(np.int32)), pa.array(n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["h", "doc_id", "pos", "n"])

    return go


def cut_sentences(text: str, runs: list[tuple[int, int]], max_words: int) -> tuple[int, int, str]:
    """(sentences, removed, text without the sentences that one of the runs (first sentence, sentences) covers)."""
    raw = text.encode("utf-8", "surrogatepass")
    w = words_of([raw])
    at, _, h, _ = sentences(w, max_words)
    gone = np.zeros(len(h), bool)
    for s, n in runs:
        gone[s : s + n] = True
    edge = np.append(w.start[at], len(raw))
    out = [raw[: edge[0]]] if len(at) else [raw]
    out += [raw[edge[i] : edge[i + 1]] for i in range(len(at)) if not gone[i]]
    return len(h), int(gone.sum()), b"".join(out).decode("utf-8", "surrogatepass")


_OUT = "doc_id long, first_doc_ids array<long>, n_sentences long, n_removed long, kept_sha256 string, text string"


def dedup_spans(documents: DataFrame, run: int = 3, min_words: int = 12, max_words: int = 12) -> DataFrame:
    """One row per document that loses sentences: doc_id, first_doc_ids (where its repeated spans stand first, itself included
    for repeats inside it), n_sentences, n_removed, kept_sha256, text (what is left)."""
    docs = one_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null"))
    all_ = written(docs.mapInArrow(_spans(run, min_words, max_words), "h long, doc_id long, pos int, n int"), "spans")
    # written, so that both sides of the join below are plain exchanges and a hash that stands everywhere is split among tasks
    first = written(all_.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("h", "first"), "repeated")
    again = all_.join(first, "h").where("doc_id <> first.doc_id or pos <> first.pos")
    per = written(again.groupBy("doc_id").agg(F.collect_set(F.col("first.doc_id")).alias("first_doc_ids"), F.collect_set(F.struct("pos", "n")).alias("runs")), "covered")
    release(all_, first)

    def cut(batches):
        for b in pieces(batches):
            rows = []
            for doc, firsts, runs, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "first_doc_ids", "runs", "text")), strict=True):
                n, gone, kept = cut_sentences(text, [(r["pos"], r["n"]) for r in runs], max_words)
                rows.append((doc, sorted(firsts), n, gone, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept))
            types = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "first_doc_ids", "n_sentences", "n_removed", "kept_sha256", "text"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    text = texts_of(docs, per.select("doc_id"))
    return per.join(text, "doc_id").select("doc_id", "first_doc_ids", "runs", "text").mapInArrow(cut, _OUT)
