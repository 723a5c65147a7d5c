"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Texts and benchmark items are lower-cased and cut into tokens at runs of
characters other than letters and digits; tokens are compared by their 64-bit
hashes. A mask is a window of token offsets, some of them left out; a window is
hashed over the offsets that stay, so it survives substitutions at the others.
Hashes of the text and of the items are joined. A hit fixes a diagonal (place in
the text less place in the item); the whole diagonal is then compared, position
by position, from end to end of item or text: +1 for an equal and -3 for an
unequal token, and the stretch with the largest sum (the first of equal ones) is
the overlap. It counts when at least `min_tokens` of its tokens are equal, or all
of an item that has fewer.

What the masks lose: nothing. A counted overlap of an item of `min_tokens` or
more has a stretch that one of the two masks hits (all patterns of up to 24
tokens and 6 substitutions were enumerated; longer ones hold such stretches), an
item of 7 to 12 tokens stands whole and holds a window of the second mask, and
items of up to 6 tokens, which no mask fits, are joined by their whole sequence.

The seeds and the items are broadcast while their bytes, computed first, are at
most `broadcast_bytes` each; beyond that the same joins run shuffled.

Defined results: null or empty texts have no tokens, nor hits; an item without
tokens is never found; rows without doc_id or item_id are left out; items that
share an item_id and documents that share a doc_id give one row, the best of any
of them; empty tables give no rows; other columns are ignored. Ties: more equal
tokens, then the shorter, then the earlier overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespan.llm._store import fresh

#: Offsets that count, of windows of nine and seven tokens.
MASKS = ((0, 1, 3, 6, 7, 8), (0, 1, 2, 3, 5, 6))
#: Items with fewer tokens are sought whole.
LEAST = min(m[-1] + 1 for m in MASKS)
_SEED_BYTES, _ITEM_BYTES = 40, 32


def tokens(text: Column) -> Column:
    """Hashes of the tokens, in order."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.xxhash64(x))


def _seeds(words: str, at: str, lengths: list[int]) -> Column:
    """An array of (mask, h) for the windows that begin at `at`; windows that don't fit, or for whole items of other lengths, give null."""
    w, p = F.col(words), F.col(at)
    fits = lambda span: p + span <= F.size(w)
    masks = [F.when(fits(m[-1] + 1), F.struct(F.lit(i).alias("mask"), F.xxhash64(*[F.get(w, p + o) for o in m]).alias("h"))) for i, m in enumerate(MASKS)]
    whole = [F.when(fits(n), F.struct(F.lit(-n).alias("mask"), F.xxhash64(*[F.get(w, p + o) for o in range(n)]).alias("h"))) for n in lengths]
    return F.array(*masks, *whole)


def _windows(rows: DataFrame, words: str, at: str, lengths: list[int]) -> DataFrame:
    """rows with one row per place and seed: at, mask, h."""
    own = rows.withColumn(at, F.explode(F.sequence(F.lit(0), F.size(words) - 1))).select("*", F.explode(_seeds(words, at, lengths)).alias("seed"))
    return own.where("seed is not null").select(*rows.columns, at, "seed.mask", "seed.h")


def _best(q0: Column, end: Column, diagonal: Column) -> Column:
    """(best, best_m, from, upto) of the item's places q0 to end - 1 compared with the text's on the diagonal."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("s", "m", "start", "best", "best_m", "lo", "hi")])

    def step(acc, q):
        same = F.get(F.col("doc"), q + diagonal) == F.get(F.col("item"), q)
        new = acc["s"] <= 0
        s = F.when(new, 0).otherwise(acc["s"]) + F.when(same, 1).otherwise(-3)
        m = F.when(new, 0).otherwise(acc["m"]) + F.when(same, 1).otherwise(0)
        start = F.when(new, q).otherwise(acc["start"])
        up = s > acc["best"]
        keep = lambda c, v: F.when(up, v).otherwise(acc[c]).alias(c)
        return F.struct(s.alias("s"), m.alias("m"), start.alias("start"), keep("best", s), keep("best_m", m), keep("lo", start), keep("hi", q + 1))

    return F.aggregate(F.sequence(q0, end - 1), zero, step)


def overlaps(documents: DataFrame, benchmark: DataFrame, min_tokens: int = 13, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_tokens, n_equal: the best overlap of each document and item, in tokens."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).where("item_id is not null and size(item) > 0").distinct()
    items = items.withColumn("item_key", F.xxhash64("item_id", "item"))
    short = F.size("item") < LEAST
    lengths = sorted(r[0] for r in items.where(short).select(F.size("item")).distinct().collect())  # LEAST - 1 numbers at most
    seeds = _windows(items.where(~short), "item", "q", [])
    whole = items.where(short).select("item_id", "item", "item_key", F.lit(0).alias("q"), (-F.size("item")).alias("mask"), F.xxhash64(*[F.get("item", F.lit(o)) for o in range(LEAST - 1)]).alias("h"))
    seeds = seeds.unionByName(whole).select("mask", "h", "q", "item_key")
    items = items.select("item_key", "item_id", "item")
    size = items.agg(F.sum(F.size("item")).alias("n"), F.count(F.lit(1)).alias("items")).first()
    few = (size.n or 0) * len(MASKS) * _SEED_BYTES <= broadcast_bytes  # the items' arrays are smaller
    small = lambda df: F.broadcast(df) if few else df

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("doc")).where("doc_id is not null and size(doc) > 0")
    if few:
        hits = _windows(docs, "doc", "p", lengths).join(small(seeds), ["mask", "h"])
    else:
        # the texts stay where they are: only places move, and equal rows count once
        docs = docs.withColumn("doc_key", F.xxhash64("doc_id", "doc"))
        found = _windows(docs, "doc", "p", lengths).select("doc_key", "p", "mask", "h").join(seeds, ["mask", "h"]).select("doc_key", "item_key", "mask", "p", "q").distinct()
        hits = docs.join(found, "doc_key")
    hits = hits.join(small(items), "item_key")
    p, q = F.col("p"), F.col("q")
    same = [F.array(*[F.get(F.col("doc"), p - 1 + o) for o in m]) == F.array(*[F.get(F.col("item"), q - 1 + o) for o in m]) for m in MASKS]
    again = F.coalesce(F.when((p > 0) & (q > 0) & (F.col("mask") >= 0), F.get(F.array(*same), F.col("mask"))), F.lit(False))
    hits = hits.where(~again)  # the place before on this diagonal hits as well

    diagonal = p - q
    best = _best(F.greatest(F.lit(0), -diagonal), F.least(F.size("item"), F.size("doc") - diagonal), diagonal)
    hits = hits.select("doc_id", "item_id", F.size("item").alias("n_item"), diagonal.alias("diagonal"), best.alias("b"))
    need = F.least(F.lit(min_tokens), F.col("n_item"))
    one = F.struct(F.col("b.best_m").alias("n_equal"), (F.col("b.lo") - F.col("b.hi")).alias("shorter"), (-F.col("b.lo") - F.col("diagonal")).alias("doc_place"), (-F.col("b.lo")).alias("item_place"))
    # the threshold is part of the aggregate: as a filter below it, the optimiser would move the comparison into the join
    got = hits.groupBy("doc_id", "item_id").agg(F.max(F.when(F.col("b.best_m") >= need, one)).alias("o")).where("o is not null")
    return got.select("doc_id", "item_id", (-F.col("o.doc_place")).alias("doc_start"), (-F.col("o.item_place")).alias("item_start"), (-F.col("o.shorter")).alias("n_tokens"), F.col("o.n_equal").alias("n_equal"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, min_tokens: int = 13, broadcast_rows: int = 2_000_000) -> DataFrame:
    """documents without those that overlap a benchmark item; rows that share a doc_id go together, rows without one stay.

    The ids that go (8 bytes each) are broadcast up to broadcast_rows of them; beyond that the join is shuffled.
    """
    from pagespan.llm._store import written

    bad = written(overlaps(documents, benchmark, min_tokens).select("doc_id").distinct(), "contaminated")
    gone = fresh("gone", documents.columns)
    bad = (F.broadcast(bad) if bad.count() <= broadcast_rows else bad).withColumnRenamed("doc_id", gone)
    return documents.join(bad, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
