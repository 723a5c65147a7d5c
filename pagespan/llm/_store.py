"""Shared-folder tables, dense counters and row pruning for the operators of this subpackage.

What outlives a stage is written below spark.checkpoint.dir, which every
executor and the driver can read, so a lost executor costs no more than the
tasks it was running.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespan.sources import store
from pagespan.sources.store import shared_dir as shared_dir

COUNTERS = 22
BLOCKS = 64
PIECE_BYTES = 8 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage. The tables of an application go when its driver ends,
    or with release()."""
    return store.written(df, name, compression="zstd")


def release(*tables: DataFrame | None) -> None:
    """Deletes written() tables that nothing will read again."""
    for t in tables:
        if t is not None and (at := getattr(t, "_pagespan_at", None)):
            store.delete(t.sparkSession, at)


def fresh(name: str, columns) -> str:
    """The name, or one with underscores behind it that no column has (names are compared without case)."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def pieces(batches, column: str = "text", most: int = PIECE_BYTES):
    """Cuts Arrow batches so that the column's text in a piece is about `most` bytes, or one row. Spark itself bounds a batch by
    spark.sql.execution.arrow.maxBytesPerBatch (64 MB), so no setting of the caller's session is touched."""
    for b in batches:
        if not b.num_rows:
            continue
        text = b.column(column)
        size = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


COUNTER_SCHEMA = "block int, counts binary"


class Counter:
    """2**COUNTERS counters, addressed by the top bits of a hash. Its size is fixed, whatever the input."""

    def __init__(self, bits: int = COUNTERS):
        self.bits = bits
        self.counts = np.zeros(1 << bits, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        for at in range(0, len(hashes), PIECE_BYTES):
            np.add.at(self.counts, (hashes[at : at + PIECE_BYTES] >> np.uint64(64 - self.bits)).astype(np.int64), 1)

    def rows(self) -> list[tuple[int, bytes]]:
        parts = np.split(self.counts, BLOCKS)
        return [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(parts) if x.any()]


def _sum_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(raw), np.uint32)
            total[b] = total[b] + x if b in total else x.astype(np.uint64)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.astype(np.uint64).tobytes(), 1) for x in total.values()], pa.binary())],
            ["block", "counts"],
        )


def summed(parts: DataFrame, bits: int = COUNTERS) -> np.ndarray:
    """Adds the tasks' counters block by block, streaming; the driver gets 2**bits numbers (32 MB at most), whatever the input."""
    rows = parts.repartition(BLOCKS, "block").mapInArrow(_sum_blocks, COUNTER_SCHEMA).collect()
    out = np.zeros(1 << bits, np.uint64)
    size = (1 << bits) // BLOCKS
    for r in rows:
        out[r.block * size : (r.block + 1) * size] += np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint64)
    return out


#: Sizes of a Bloom filter in bits, by the number of ids that it may hold: one hit in a thousand or so is false. Beyond the last
#: (32 MB) more pass, which costs time and loses nothing.
FILTER_SIZES = ((1 << 17, 23), (1 << 20, 26), (None, 28))


def _id_hash(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    from pagespan.llm._text import mix

    x = ids.astype(np.int64).view(np.uint64)
    shift = np.uint64(64 - bits)
    return (mix(x, 3) >> shift).astype(np.int64), (mix(x, 5) >> shift).astype(np.int64)


def _filter(ids: DataFrame):
    """A Bloom filter over the ids (bigint column doc_id), broadcast. They are counted first; read a table, not a plan."""
    n = ids.count()
    bits = next(b for most, b in FILTER_SIZES if most is None or n <= most)
    size = (1 << bits) // 8 // BLOCKS

    def fill(batches):
        t = np.zeros(1 << bits >> 3, np.uint8)
        for b in batches:
            x = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for at in _id_hash(x, bits) if len(x) else ():
                np.bitwise_or.at(t, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        full = [i for i, x in enumerate(np.split(t, BLOCKS)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(t[i * size : (i + 1) * size].tobytes(), 1) for i in full], pa.binary())], ["block", "counts"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(raw), np.uint8)
                total[b] = total[b] | x if b in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["block", "counts"])

    got = ids.select("doc_id").mapInArrow(fill, COUNTER_SCHEMA).repartition(BLOCKS, "block").mapInArrow(merge, COUNTER_SCHEMA).collect()
    table = np.zeros(1 << bits >> 3, np.uint8)
    for r in got:
        table[r.block * size : (r.block + 1) * size] |= np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint8)
    return ids.sparkSession.sparkContext.broadcast((bits, table.tobytes()))


class Sieve:
    """A filter over ids, as tasks use it: the rows of a batch whose doc_id it has (or hasn't); null isn't in it."""

    def __init__(self, ids: DataFrame):
        self.shared = _filter(written(ids.select("doc_id"), "ids"))

    def rows(self, b: pa.RecordBatch, hits: bool) -> pa.RecordBatch:
        bits, raw = self.shared.value
        t = np.frombuffer(raw, np.uint8)
        ids = b.column("doc_id").cast(pa.int64())
        i, j = _id_hash(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
        hit = ((t[i >> 3] >> (7 - (i & 7)) & 1) & (t[j >> 3] >> (7 - (j & 7)) & 1)).astype(bool)
        hit &= ids.is_valid().to_numpy(zero_copy_only=False)
        return b.filter(pa.array(hit == hits))

    def of(self, documents: DataFrame, hits: bool, then=None, schema=None) -> DataFrame:
        """The rows of documents that pass (or don't). then, with its schema: what the same worker makes of them."""
        rows = self.rows

        def run(batches):
            own = (x for b in batches if (x := rows(b, hits)).num_rows)
            yield from then(own) if then else own

        return documents.mapInArrow(run, schema or documents.schema)


def passing(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of documents (bigint doc_id) whose doc_id is among the ids (one bigint column doc_id), and a few others. No row is
    shuffled."""
    return Sieve(ids).of(documents, True)


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids (one bigint column doc_id, distinct), one row each; of rows that share a doc_id the smallest text.

    A Bloom filter drops most other documents before the exact join shuffles any
    text. If the ids fill the filter, more rows are shuffled, none is lost.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    ids = written(ids.select("doc_id"), "ids")
    return passing(docs, ids).join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def one_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; doc_id not null) with one row per doc_id: of rows that share one the smallest text, null being empty.
    Only rows of repeated ids are moved."""
    repeated = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated_ids")
    if not repeated.head(1):
        return docs
    return without(docs, repeated).unionByName(texts_of(docs, repeated))


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """documents without the rows of the ids (one bigint column doc_id). Rows that the Bloom filter lacks pass as they are;
    the others meet the ids in an exact join. Columns of any name pass through."""
    gone = fresh("gone", documents.columns)
    ids = written(ids.select(F.col("doc_id").alias(gone)).distinct(), "gone")
    sieve = Sieve(ids.withColumnRenamed(gone, "doc_id"))
    maybe = sieve.of(documents, True)
    return sieve.of(documents, False).unionByName(maybe.join(ids, F.col("doc_id").cast("long") == F.col(gone), "left_anti"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in edges (a, b): root is the smallest id reachable.

    Alternating large-star and small-star rounds on the edge table; each round is
    one shuffle by node with partial minima, and its edges never outnumber the
    first round's. Every round is a table in the shared folder.
    """
    e = written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        # large star: every larger neighbour of u points to u's smallest neighbour (u itself counts)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of u and u itself point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, e = e, written(small.where("u <> v").distinct(), "edges")
        release(before)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("u", "v") % 1000003).alias("x")).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
