"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source_size copies. Documents are
ordered within their source by size, those of one size by a hash; the expected
copies are prefix-summed, one random offset in [0, 1) is drawn for the source, and a
document is taken once per integer boundary that its interval crosses. So every
document's mean number of copies over the offsets is what it expects, and as
neighbours have like sizes, the words taken miss the target by little more than
the source's largest document. The prefix sum is two-level: counts per (size,
part), a part being at most about CHUNK_ROWS documents of one size, then rows
within a part, so a source of any size is spread over its parts.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share
100% of all sizes; a target stops at `most` times its source's size and the
excess is shared anew by weight until none is above. The table of sources (one
row each) is broadcast up to BROADCAST_ROWS of them.

Defined results: null text has size 0; null doc_id is kept and takes part; rows
that repeat are separate documents (of rows that are equal in doc_id, source and
size any may be taken); a source of size 0 has target 0; an empty table gives no
rows; other columns are ignored, or pass through `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespan.llm._store import fresh, written

CHUNK_ROWS = 20_000
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes (source, n) -> source, source_size, target. One row per source, so its windows hold the sources only."""
    per = sizes.groupBy("source").agg(F.sum("n").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("w"), F.col("source").isNull(), F.col("source"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum(F.col("source_size").cast("double")).over(every) - before) / rest
    per = per.withColumn("level", level).withColumn("at", F.row_number().over(up))
    # capped while the common level stands above cap / w; from the first open source on, all get level * w
    final = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))).over(every)
    return per.select(
        "source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(final["level"] * F.col("w"), F.col("cap")))).alias("target")
    )


def mix_sources(documents: DataFrame, seed: int = 17, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source, source_size, target, copies for every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    return _copies(rows, ["doc_id"], seed, most, weights)


def _source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _each(grouped: DataFrame) -> DataFrame:
    """grouped (..., times) -> a row for each of the `times` equal rows, numbered by `nth` from 0. However many there are, no
    array holds more than CHUNK_ROWS numbers: many are first dealt to chunks, and the chunks to tasks."""
    few = grouped.where(F.col("times") <= CHUNK_ROWS).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    many = grouped.where(F.col("times") > CHUNK_ROWS).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(CHUNK_ROWS).cast("long"))))
    many = many.repartition("from", *[c for c in grouped.columns if c != "times"])
    return few.unionByName(many.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK_ROWS, F.col("times")) - 1))).drop("from"))


def _copies(rows: DataFrame, id_columns: list[str], seed: int, most: int, weights: tuple[int, ...], each: bool = True) -> DataFrame:
    """rows (id columns, source, size) -> id columns, source, size, source_size, target, copies, a row for each row; without
    `each` a row for each distinct one, with the copies of all of them and their number `times`."""
    rows = written(rows.withColumn("source_key", _source_key()), "sizes")  # some 30 bytes a document; the texts are read once
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    per_size = written(rows.groupBy("source_key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "per_size")
    targets = written(source_targets(per_size.select("source", (F.col("size") * F.col("n")).alias("n")), most, weights).withColumn("of", _source_key()).drop("source"), "targets")
    # sizes of many documents are dealt to parts; there are at most (documents / CHUNK_ROWS) such sizes
    parts = written(per_size.where(F.col("n") > CHUNK_ROWS).select(F.col("source_key").alias("of"), F.col("size").alias("of_size"), F.ceil(F.col("n") / CHUNK_ROWS).alias("parts")), "parts")

    # rows that nothing tells apart are one row with a number: a doc_id that repeats without end stays small
    own = rows.groupBy("source_key", "source", "size", *id_columns).agg(F.count(F.lit(1)).alias("times"))
    own = own.withColumn("draw", F.xxhash64(F.lit(seed), "size", *id_columns, *[F.col(c).isNull() for c in id_columns]))
    own = own.join(small(parts), (F.col("source_key") == F.col("of")) & (F.col("size") == F.col("of_size")), "left").withColumn("part", F.pmod("draw", F.coalesce("parts", F.lit(1)))).drop("of", "of_size", "parts")
    own = written(own, "dealt")
    counts = own.groupBy("source_key", "size", "part").agg(F.sum("times").alias("in_part"))
    before = Window.partitionBy("source_key").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("source_key", "size", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_key", "size", "part").orderBy("draw", *id_columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = own.withColumn("k", F.coalesce(F.sum("times").over(within), F.lit(0))).join(base, ["source_key", "size", "part"])

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source_key"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    ranked = ranked.join(small(targets), F.col("source_key") == F.col("of")).withColumn("rate", rate).withColumn("offset", offset)
    crossed = lambda i: F.floor(F.col("rate") * i + F.col("offset"))
    # rounding of products can't take a document past `most`
    if each:
        at = F.col("base") + F.col("k") + F.col("nth")
        copies = F.least(crossed(at + 1) - crossed(at), F.ceil(F.col("rate"))).cast("long")
        return _each(ranked).select(*id_columns, "source", "size", "source_size", "target", copies.alias("copies"))
    at = F.col("base") + F.col("k")
    copies = F.least(crossed(at + F.col("times")) - crossed(at), F.col("times") * F.ceil(F.col("rate"))).cast("long")
    return ranked.select(*id_columns, "source", "size", "source_size", "target", copies.alias("copies"), "times")


def mixed_documents(documents: DataFrame, seed: int = 17, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: documents' columns, each taken row as often as it is taken, with `copy` from 1 (under a name with
    underscores if documents has such a column). Rows are told apart by 128 bits over doc_id, source and text, nulls included;
    rows equal in these are one row, any of them, that is taken as often as all of them."""
    cols = documents.columns
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("source").isNull(), F.col("source"), F.col("text").isNull(), F.col("text")]
    k1, k2, times, whole = (fresh(c, cols) for c in ("mix_a", "mix_b", "mix_copies", "mix_rows"))
    docs = documents.withColumns({k1: F.xxhash64(F.lit(1), *parts), k2: F.xxhash64(F.lit(2), *reversed(parts))})
    rows = docs.select(F.col(k1).alias("a"), F.col(k2).alias("b"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    taken = _copies(rows, ["a", "b"], seed, most, weights, each=False).select("a", "b", F.col("copies").alias("times"), F.col("times").alias("rows"))
    taken = written(taken.where("times > 0"), "copies")
    one = docs.join(taken.toDF(k1, k2, times, whole), [k1, k2])
    if taken.where("rows > 1").head(1):
        one = one.dropDuplicates([k1, k2])
    nth = fresh("copy", cols)
    few = one.where(F.col(times) <= CHUNK_ROWS).select(*cols, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(nth))
    # a row that is taken very often: its numbers are cut likewise
    start = fresh("mix_from", [*cols, nth])
    many = one.where(F.col(times) > CHUNK_ROWS).select(*cols, times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times), F.lit(CHUNK_ROWS).cast("long"))).alias(start))
    numbers = F.sequence(F.col(start), F.least(F.col(start) + CHUNK_ROWS - 1, F.col(times)))
    return few.unionByName(many.select(*cols, F.explode(F.transform(numbers, lambda k: k.cast("int"))).alias(nth)))
