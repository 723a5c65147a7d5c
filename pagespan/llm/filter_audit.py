"""Filter interaction audit: what every order of a set of document filters would keep, remove and waste.

A document's failed filters are the bits of a mask. Documents are counted by part,
mask and labels; these cells are all that the audit needs, and there are at most
4 * 2**filters of them per part, whatever the corpus. Each cell is unpivoted
against the steps of every order (long form); a running bit-or over an order's
earlier steps tells whether the cell was already gone, conditional sums over the
cells give a step's metrics, and a window over part and filter totals what the
filter removes in all orders.

The five filters of `text_failures`: A, under 100 words; B, fewer than 80% of the
words distinct; C, more than 10% of the code points A-Z; D, a character of
`#$%&*|`; E, identical to the text of a smaller doc_id anywhere in the table. Words
are maximal runs outside [\\x20\\x09-\\x0D], case-sensitive. Texts are identical when
their SHA-256 is. Smallest ids are aggregated before they move, and only digests
that two rows share are joined, so a text that a third of all rows hold is
neither a group nor a partition of its own.

Defined results: null text is empty (it fails A alone, and E if a smaller doc_id is
empty too); a null doc_id is neither smaller than another nor preceded by one; rows
that share doc_id and text don't fail E for each other, and count each; null lang
is the part '', as an empty one is; a document without labels, or with null ones,
counts as neither good nor toxic, with several labels as what any of them says;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan.llm._store import written

FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on a text that isn't null: whether it fails."""
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {"A": n < 100, "B": 100 * distinct.cast("long") < 80 * n.cast("long"), "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.char_length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def failures(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit i: fails FILTERS[i]), a row for each row. The texts are read once."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_failures(F.col("text")).values())]
    own = written(docs.select("doc_id", "part", sum(bits[1:], bits[0]).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "own_failures")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return own.join(first, "digest", "left").select("doc_id", "part", F.col("own").bitwiseOR(F.when(later, F.lit(1 << 4)).otherwise(F.lit(0))).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents counted by what they fail and what their labels say."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = masks.join(said, F.col("doc_id") == F.col("of"), "left")
    return marked.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def audit_orders(cell: DataFrame, filters: str = FILTERS, orders: Sequence[str] | None = None) -> DataFrame:
    """cells(), or any counted masks, -> part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley; a row for every part, order and step. orders: those to audit, all permutations of `filters` by default."""
    orders = ["".join(p) for p in itertools.permutations(filters)] if orders is None else list(orders)
    bit = F.element_at(F.create_map(*[x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i))]), F.col("filter"))
    steps = F.transform(F.split(F.col("filter_order"), ""), lambda f, i: F.struct((i + 1).cast("int").alias("step"), f.alias("filter")))
    long = cell.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders])))
    long = long.select("part", "mask", "good", "toxic", "n", "filter_order", F.inline(steps)).withColumn("bit", bit)
    # the steps before this one, as bits, in the cell's own run through the order
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.bit_or("bit").over(before), F.lit(0))
    long = long.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")) != 0).withColumn("gone", F.col("mask").bitwiseAND(earlier) != 0)
    removed = F.col("fails") & ~F.col("gone")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(~F.col("fails") & ~F.col("gone")).alias("kept"), count(removed).alias("removed"), count(F.col("fails") & F.col("gone")).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"), count(removed & F.col("good")).alias("good_lost"), count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", total)


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all their orders."""
    return audit_orders(written(cells(failures(documents), labels), "cells"))
