"""I-Match document fingerprints over randomised lexicons.

Terms are lower-cased words, known by their 64-bit hashes. Their document
frequencies are counted exactly over all documents; a term is kept when its inverse
document frequency, log(documents / frequency), lies in [min_idf, max_idf]. The
lexicon so bounded is broadcast: a kept term stands in at least exp(-max_idf) of the
documents, so there are at most exp(max_idf) times as many as a document has
distinct terms on average, whatever the number of documents (8 bytes each; at
max_idf 8 and 1,000 terms a text, 24 MB). A text's kept terms, distinct and
sorted, are intersected with each of the randomised lexicon subsets, and each
intersection is hashed; the fingerprint is the hashes side by side. Subsets take
1/8, 1/32, 1/128 and 1/512 of the lexicon, so that short and long texts have
subsets that an edit leaves alone. A text without kept terms, or with none in any
subset, is hashed from the full hashes of all its terms, to other bits for every
subset, so it agrees with texts of the same terms only. Likeness of two fingerprints: the share of the
subsets in which they agree, among those where either has a term.

Defined results: null is the empty text; equal texts get equal fingerprints; two
texts without any term are alike (1). In the chained form (edited texts), rows
follow doc_id, then a hash of the text; null doc_id comes first; one row is its own next; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespan.llm._store import pieces, release, written
from pagespan.llm._text import U64, Words, blocks, distinct, mix, words_of

RATES = (3,) * 16 + (5,) * 16 + (7,) * 16 + (9,) * 16
_SEEDS = mix(np.arange(1, len(RATES) + 1, dtype=U64), 211)[:, None]
_SHIFT = (64 - np.array(RATES)).astype(U64)[:, None]
NONE = "." * 4


def _distinct(w: Words) -> list[np.ndarray]:
    return [distinct(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


class Lexicon:
    """The terms of the band, as a task uses them: a bit set over their top bits, and the sorted terms for what passes it."""

    BITS = 22

    def __init__(self, terms: bytes):
        self.terms = np.frombuffer(terms, U64)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(self.terms >> U64(64 - self.BITS)).astype(np.int64)] = True

    def kept(self, words: np.ndarray) -> np.ndarray:
        words = words[self.seen[(words >> U64(64 - self.BITS)).astype(np.int64)]]
        if not len(words):
            return words
        return words[self.terms[np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)] == words]

    def fingerprint(self, words: np.ndarray) -> str:
        """Of a text's distinct word hashes, sorted."""
        if not len(words):
            return NONE * len(RATES)
        kept = self.kept(words)
        subset, at = np.nonzero(mix(kept[None, :] ^ _SEEDS) >> _SHIFT == 0)
        if not len(subset):
            return hashlib.shake_128(words.tobytes()).hexdigest(2 * len(RATES))
        out = [NONE] * len(RATES)
        head = np.flatnonzero(np.append(True, subset[1:] != subset[:-1]))
        place = np.arange(len(subset)) - np.repeat(head, np.diff(np.append(head, len(subset))))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(kept[at] + mix(place.astype(U64), 5), 7), head)
        for i, h in zip(subset[head].tolist(), (mix(sums) >> U64(48)).tolist(), strict=True):
            out[i] = f"{h:04x}"
        return "".join(out)


def likeness(a: str, b: str) -> float:
    x = np.frombuffer(a.encode(), np.dtype("S4"))
    y = np.frombuffer(b.encode(), np.dtype("S4"))
    none = NONE.encode()
    either = (x != none) | (y != none)
    return float((x == y)[either].mean()) if either.any() else 1.0


_KEPT_COUNTS = 1 << 20
LEXICON_BYTES = 1 << 30


def _counts(batches):
    """(term, df) of the documents of a task; sums are handed on before they outgrow _KEPT_COUNTS."""

    def rows(t, n):
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["term", "df"])

    def merged(parts):
        t, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        head = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        return t[head], np.add.reduceat(n, head) if len(t) else n

    parts, size = [], 0
    for b in batches:
        for _, _, w in blocks(b.column("text")):
            t, n = np.unique(np.concatenate([np.zeros(0, U64), *_distinct(w)]), return_counts=True)
            parts.append((t, n))
            size += len(t)
            if size > 2 * _KEPT_COUNTS:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > _KEPT_COUNTS:
                    yield rows(*parts[0])
                    parts, size = [], 0
    if parts:
        yield rows(*merged(parts))


def lexicon(documents: DataFrame, min_idf: float = 2.0, max_idf: float = 8.0) -> bytes:
    """The sorted hashes of the terms whose idf lies in the band, counted over all documents (null text has none)."""
    n = documents.count()
    counts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    band = written(counts.where(idf.between(min_idf, max_idf)).select("term"), "lexicon")
    if 8 * band.count() > LEXICON_BYTES:
        raise ValueError("the lexicon outgrows its bound: lower max_idf, or cut texts that hold whole libraries")
    terms = np.sort(band.toArrow().column("term").to_numpy().view(U64)).tobytes()
    release(band)
    return terms


def edited(text: str, after: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of `after`."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PART = _ROW + ", place int, kind int, text string"
_NAMES = [x.split()[0] for x in _PART.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]


def _finished(lex: Lexicon, pairs: list[tuple[int, str, str]], prints: list[tuple[str, str]]) -> list[tuple]:
    """pairs: doc_id, text, next text; prints: of both texts."""
    new = [edited(t, u) for _, t, u in pairs]
    of_new = [lex.fingerprint(t) for t in _distinct(words_of(new))] if new else []
    return [
        (d, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f, g, likeness(f, g), likeness(f, h))
        for (d, t, _), e, g, (f, h) in zip(pairs, new, of_new, prints, strict=True)
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def fingerprint_chain(documents: DataFrame, min_idf: float = 2.0, max_idf: float = 8.0) -> DataFrame:
    """Fingerprints every text, its edited text (end replaced by the next document's start) and compares neighbours.

    Rows are range-partitioned by doc_id and hash once, so that rows without or with the same doc_id are split too, and
    streamed in order, one row held back. A partition's first and last texts come out as extra rows; at most one
    text per partition is then joined to the next partition's first.
    """
    spark = documents.sparkSession
    band = spark.sparkContext.broadcast(lexicon(documents, min_idf, max_idf))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    def run(batches):
        lex = Lexicon(band.value)
        place = TaskContext.get().partitionId()
        held: tuple[int, str, str] | None = None  # doc_id, text, fingerprint
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, hi, w in blocks(b.column("text")):
                texts = b.column("text").slice(lo, hi - lo).to_pylist()
                prints = [lex.fingerprint(t) for t in _distinct(w)]
                out = []
                if held is None:
                    out.append((None,) * 7 + (place, 1, texts[0]))
                chain = ([held] if held else []) + list(zip(ids[lo:hi], texts, prints, strict=True))
                pairs = [(x[0], x[1], y[1]) for x, y in zip(chain, chain[1:], strict=False)]
                both = [(x[2], y[2]) for x, y in zip(chain, chain[1:], strict=False)]
                out += [r + (None, 0, None) for r in _finished(lex, pairs, both)]
                held = chain[-1]
                if out:
                    yield _batch(out)
        if held is not None:
            yield _batch([(held[0],) + (None,) * 6 + (place, 2, held[1])])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = written(docs.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").mapInArrow(run, _PART), "chain")
    done = got.where("kind = 0").select(*_NAMES[:7])
    places = sorted(r.place for r in got.where("kind = 1").select("place").collect())  # a number per partition
    if not places:
        return done
    after = spark.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "place int, next int")
    tails = got.where("kind = 2").select("place", "doc_id", "text").join(after, "place").join(got.where("kind = 1").select(F.col("place").alias("next"), F.col("text").alias("after")), "next")

    def finish(batches):
        lex = Lexicon(band.value)
        for b in pieces(batches):
            for doc, text, nxt in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True):
                f, h = (lex.fingerprint(t) for t in _distinct(words_of([text, nxt])))
                yield _batch([_finished(lex, [(doc, text, nxt)], [(f, h)])[0] + (None, 0, None)]).select(_NAMES[:7])

    return done.unionByName(tails.select("doc_id", "text", "after").mapInArrow(finish, _ROW))


def fingerprints(documents: DataFrame, min_idf: float = 2.0, max_idf: float = 8.0) -> DataFrame:
    """doc_id, fingerprint: the plain form, without any exchange of texts."""
    band = documents.sparkSession.sparkContext.broadcast(lexicon(documents, min_idf, max_idf))

    def run(batches):
        lex = Lexicon(band.value)
        for b in batches:
            for lo, hi, w in blocks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([lex.fingerprint(t) for t in _distinct(w)], pa.string())], ["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")
