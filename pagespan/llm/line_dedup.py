"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased.
Keys of at least `min_chars` code points held by at least `min_docs` documents
lose all their lines except in the largest doc_id that holds them.

The exact state is a table of postings (key, doc_id, row), from which the reference
counts (key -> documents, largest doc_id) are aggregated. Keys that reached
`min_docs` go to cuckoo filters, one per key shard; postings probe the filters
first, and only those that pass meet the exact table. A filter's false positives
are refuted there; it has no false negatives. Filters are broadcast while all of
them take FILTER_MB at most; beyond that each stays with its shard and the
postings go there, salted, so that a line that stands everywhere has several tasks. Inserting or deleting documents
adds to or takes from both, so a deleted document leaves no trace.

Defined results: null or empty text is one empty line; rows without doc_id pass
unchanged and hold nothing; rows that share a doc_id are one document that is
counted once, each has its own result, and all keep the line if their doc_id is
the largest; an empty table gives no rows; columns of any other name are ignored,
or pass through `dedup_documents`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.llm._store import Sieve, fresh, pieces, release, written
from pagespan.llm._text import U64, mix

SHARD_KEYS = 200_000
FILTER_MB = 64
_SPACE = b" \t\n\x0b\x0c\r"
_POSTINGS = "k1 long, k2 long, doc_id long, row long"
SALTS = 8


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _postings(min_chars: int):
    def run(batches):
        for b in pieces(batches):
            keys, n = [], []
            for text in b.column("text").to_pylist():
                own = {key_hash(k) for x in text.encode("utf-8", "surrogatepass").split(b"\n") if _long_enough(k := line_key(x), min_chars)} if text else ()
                keys.extend(own)
                n.append(len(own))
            if keys:
                k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                ids, rows = (np.repeat(b.column(c).to_numpy(), n) for c in ("doc_id", "row"))
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(ids), pa.array(rows)], ["k1", "k2", "doc_id", "row"])

    return run


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket. Equal keys may be inserted several times and are deleted one by one."""

    SLOTS = 4

    def __init__(self, n: int = 0, raw: bytes | None = None):
        if raw is not None:
            self.table = np.frombuffer(raw, np.uint16).reshape(-1, self.SLOTS).copy()
        else:
            buckets = 1
            while buckets * self.SLOTS * 0.85 < max(n, 1):
                buckets *= 2
            self.table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.mask = U64(len(self.table) - 1)

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.view(np.uint64), 29)
        fp = ((h >> U64(48)) | U64(1)).astype(np.uint16)
        i = h & self.mask
        return fp, i.astype(np.int64), self._other(i, fp)

    def _other(self, i: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return ((i.astype(U64) ^ mix(fp.astype(U64), 31)) & self.mask).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """False if no room is left; the caller then builds a larger filter."""
        if not len(keys):
            return True
        fp, i, j = self._place(keys)
        left = np.arange(len(keys))
        for at in (i, j):
            for slot in range(self.SLOTS):
                free = left[self.table[at[left], slot] == 0]
                _, first = np.unique(at[free], return_index=True)
                put = free[first]
                self.table[at[put], slot] = fp[put]
                left = np.setdiff1d(left, put, assume_unique=True)
        rng = np.random.default_rng(7)
        for x in left:
            f, b = fp[x], int(i[x])
            for _ in range(500):
                row = self.table[b]
                empty = np.flatnonzero(row == 0)
                if len(empty):
                    row[empty[0]] = f
                    break
                s = int(rng.integers(self.SLOTS))
                f, row[s] = row[s], f
                b = int(self._other(np.array([b]), np.array([f]))[0])
            else:
                return False
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        fp, i, j = self._place(keys)
        f = fp[:, None]
        return (self.table[i] == f).any(1) | (self.table[j] == f).any(1)

    def delete(self, keys: np.ndarray) -> None:
        for f, i, j in zip(*self._place(keys), strict=True):
            for b in (i, j):
                at = np.flatnonzero(self.table[b] == f)
                if len(at):
                    self.table[b, at[0]] = 0
                    break

    def bytes(self) -> bytes:
        return self.table.tobytes()


def build_filter(keys: np.ndarray) -> Cuckoo:
    n = len(keys)
    while not (c := Cuckoo(n)).insert(keys):
        n = int(n * 1.5) + 8
    return c


def _filters(batches):
    """Rows (shard, k1) of whole shards -> one filter per shard. A shard holds about SHARD_KEYS keys."""
    keys: dict[int, list[np.ndarray]] = {}
    for b in batches:
        s, k = b.column("shard").to_numpy(), b.column("k1").to_numpy()
        for x in np.unique(s):
            keys.setdefault(int(x), []).append(k[s == x])
    for s, parts in keys.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([build_filter(np.concatenate(parts)).bytes()], pa.binary())], ["shard", "filter"])


def _shard(k1, shards: int):
    return F.pmod(F.shiftrightunsigned(k1, 7), F.lit(shards)).cast("int")


def _row(text):
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))


def _probe_streamed(batches):
    """Rows sorted by shard, salt and kind: a shard's filter (kind 0), then its postings, of which those that it has go out."""
    shard, c = None, None
    for b in batches:
        s, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
        place = s.astype(np.int64) * SALTS + b.column("salt").to_numpy()
        edges = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1]))).tolist()
        for lo, hi in zip(edges, [*edges[1:], b.num_rows], strict=True):
            if kind[lo] == 0:
                shard, c = place[lo], Cuckoo(raw=b.column("filter")[lo].as_py())
            elif shard == place[lo]:  # else no key of the shard is repeated
                own = b.slice(lo, hi - lo)
                hit = c.contains(own.column("k1").to_numpy())
                if hit.any():
                    yield own.select(["k1", "k2", "doc_id", "row"]).filter(pa.array(hit))


def _change(old, new):
    """One shard's filter (old: shard, filter) after its changed keys (new: shard, k1, gone)."""
    import pandas as pd

    shard = int((old if len(old) else new)["shard"].iloc[0])
    c = Cuckoo(raw=bytes(old["filter"].iloc[0])) if len(old) else None
    keys, gone = new["k1"].to_numpy(np.int64), new["gone"].to_numpy(bool)
    if c is not None:
        c.delete(keys[gone])
    if c is None:
        c = build_filter(keys[~gone])
    elif not c.insert(keys[~gone]):
        return pd.DataFrame({"shard": [shard], "filter": [None]})  # full: the caller builds it anew from the table
    return pd.DataFrame({"shard": [shard], "filter": [c.bytes()]})


class LineIndex:
    """The dedup state of a corpus: tables in the shared folder. insert() and delete() return the next state; this one stays valid.

    postings: (key, doc_id), the exact record. counts: documents and largest doc_id per key. filters: a cuckoo filter per shard
    of the keys that at least min_docs documents hold. An insertion merges its own counts into the table; a deletion counts
    the keys it touches anew; both change the filters by the keys that crossed min_docs.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 20, min_docs: int = 3):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.postings = self.counts = self.repeated = self.filters = None
        self.shards = 1

    def _next(self, postings: DataFrame, counts: DataFrame) -> LineIndex:
        new = LineIndex(self.spark, self.min_chars, self.min_docs)
        new.postings, new.counts = postings, counts
        new.repeated = written(counts.where(F.col("docs") >= self.min_docs), "repeated")
        new.shards = 1 << max(0, (new.repeated.count() // SHARD_KEYS).bit_length())
        if self.filters is None or new.shards != self.shards:
            new.filters = new._built(new.repeated)
            return new
        keys = lambda x: x.select("k1", "k2")
        changed = keys(new.repeated).exceptAll(keys(self.repeated)).withColumn("gone", F.lit(False)).unionByName(keys(self.repeated).exceptAll(keys(new.repeated)).withColumn("gone", F.lit(True)))
        changed = changed.select(_shard(F.col("k1"), new.shards).alias("shard"), "k1", "gone")
        filters = written(self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(_change, "shard int, filter binary"), "filters")
        full = filters.where("filter is null").select("shard")
        if full.head(1):
            again = new.repeated.withColumn("shard", _shard(F.col("k1"), new.shards)).join(full, "shard", "left_semi").select(*new.repeated.columns)
            filters = written(filters.where("filter is not null").unionByName(new._built(again)), "filters")
        new.filters = filters
        return new

    def _built(self, keys: DataFrame) -> DataFrame:
        by_shard = keys.select(_shard(F.col("k1"), self.shards).alias("shard"), "k1")
        return written(by_shard.repartition(self.shards, "shard").mapInArrow(_filters, "shard int, filter binary"), "filters")

    def insert(self, documents: DataFrame) -> LineIndex:
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _row(F.col("text")).alias("row"), F.col("text").cast("string").alias("text"))
        new = written(docs.where("doc_id is not null").mapInArrow(_postings(self.min_chars), _POSTINGS), "postings")
        if self.postings is None:
            return self._next(new, written(_counted(new), "counts"))
        both = self.postings.unionByName(new)
        if new.join(self.postings, "doc_id", "left_semi").head(1):  # more rows of documents that are there: their keys are counted anew
            touched = written(new.select("k1", "k2").distinct(), "touched")
            counts = self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(_counted(both.join(touched, ["k1", "k2"], "left_semi")))
        else:
            counts = self.counts.unionByName(_counted(new)).groupBy("k1", "k2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
        return self._next(both, written(counts, "counts"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes back every document with one of the doc_ids."""
        if self.postings is None:
            return self
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        rest = written(self.postings.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id", "row"), "postings")
        touched = written(self.postings.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct(), "touched")
        counts = self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(_counted(rest.join(touched, ["k1", "k2"], "left_semi")))
        return self._next(rest, written(counts, "counts"))

    def _probed(self, filter_mb: int) -> DataFrame:
        """The postings whose key a filter has."""
        size = self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
        shards = self.shards
        if size > filter_mb << 20:
            own = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), "filter", *[F.lit(None).cast("long").alias(c) for c in ("k1", "k2", "doc_id", "row")])
            asked = self.postings.select(_shard(F.col("k1"), shards).alias("shard"), F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("filter"), "k1", "k2", "doc_id", "row")
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            return own.unionByName(asked).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_probe_streamed, _POSTINGS)
        tables = self.spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in self.filters.collect()})

        def probe(batches):
            own = {s: Cuckoo(raw=raw) for s, raw in tables.value.items()}
            for b in batches:
                k = b.column("k1").to_numpy()
                s = ((k.view(np.uint64) >> U64(7)) % U64(shards)).astype(np.int64)
                hit = np.zeros(len(k), bool)
                for x in np.unique(s):
                    if x in own:
                        at = s == x
                        hit[at] = own[x].contains(k[at])
                if hit.any():
                    yield b.filter(pa.array(hit))

        return self.postings.mapInArrow(probe, _POSTINGS)

    def drops(self, filter_mb: int = FILTER_MB) -> DataFrame:
        """(doc_id, row, keys): the keys that a row loses, row being the hash of its text."""
        if self.repeated is None:
            return self.spark.createDataFrame([], "doc_id long, row long, keys array<struct<k1:bigint,k2:bigint>>")
        lost = self._probed(filter_mb).join(self.repeated, ["k1", "k2"]).where("doc_id <> last")
        return lost.groupBy("doc_id", "row").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def _cut(texts: bool):
    def run(batches):
        for b in pieces(batches):
            ids = b.column("doc_id").to_pylist()
            n_lines, n_dropped, sha, kept_text = [], [], [], []
            keyed = b.column("keys").to_pylist() if "keys" in b.schema.names else [None] * b.num_rows
            for text, keys in zip(b.column("text").to_pylist(), keyed, strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                lines = raw.split(b"\n")
                kept = lines
                if keys:
                    lost = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys}
                    kept = [x for x in lines if key_hash(line_key(x)) not in lost]
                    raw = b"\n".join(kept)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                sha.append(hashlib.sha256(raw).hexdigest())
                kept_text.append(raw.decode("utf-8", "surrogatepass") if texts else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"],
            )

    return run


_OUT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string"


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, texts: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, kept (the remaining text; null without `texts`)."""
    spark = documents.sparkSession
    lost = written(LineIndex(spark, min_chars, min_docs).insert(documents).drops(), "lost")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # texts that lose nothing aren't shuffled
    sieve = Sieve(lost.select("doc_id").distinct())
    some = sieve.of(docs, True).withColumn("row", _row(F.col("text"))).join(lost, ["doc_id", "row"], "left").select("doc_id", "text", "keys")
    return some.mapInArrow(_cut(texts), _OUT).unionByName(sieve.of(docs, False, _cut(texts), _OUT))


def dedup_documents(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """documents with the repeated lines cut out of text, and n_chars set anew; the columns stay."""
    lost = written(LineIndex(documents.sparkSession, min_chars, min_docs).insert(documents).drops(), "lost")
    cols = documents.columns
    own_id, own_row, own_keys = (fresh(c, cols) for c in ("drop_id", "drop_row", "drop_keys"))

    def run(batches):
        for b in pieces(batches):
            text, n = [], []
            keyed = b.column(own_keys).to_pylist() if own_keys in b.schema.names else [None] * b.num_rows
            for t, keys in zip(b.column("text").to_pylist(), keyed, strict=True):
                if keys:
                    bad = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys}
                    t = b"\n".join(x for x in t.encode("utf-8", "surrogatepass").split(b"\n") if key_hash(line_key(x)) not in bad).decode("utf-8", "surrogatepass")
                text.append(t)
                n.append(len(t) if t is not None else 0)
            out = b.select(cols)
            out = out.set_column(cols.index("text"), "text", pa.array(text, pa.string()))
            if "n_chars" in cols:
                out = out.set_column(cols.index("n_chars"), "n_chars", pa.array(n, b.column("n_chars").type))
            yield out

    sieve = Sieve(lost.select("doc_id").distinct())
    lost = lost.toDF(own_id, own_row, own_keys)
    same = (F.col("doc_id").cast("long") == F.col(own_id)) & (_row(F.col("text")) == F.col(own_row))
    some = sieve.of(documents, True).join(lost, same, "left").select(*cols, own_keys)
    return some.mapInArrow(run, documents.schema).unionByName(sieve.of(documents, False, run, documents.schema))
