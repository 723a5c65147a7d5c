"""Exact dedup as a stateful stream.

Documents arrive as a stream of Parquet files. Each task first combines what it
reads: texts of one digest are compared by their full bytes with the first of them,
and go on as one row, a content, with their number and the row that stays; contents
are written with the locator of their bytes (file and row). A second stream reads
them and keeps, keyed by digest, disk-backed state (RocksDB) without expiry: the
locator of the first content, the number of documents and the one that stays so far,
the stable identifier. A content whose digest has another's locator is a hit: the
full texts at both locators are read again, by Spark, from the files that they name,
and compared by bytes. Digests that unlike texts turn out to share are split by
their full texts, exactly. Unique texts are never moved.

Of equal texts the row with the largest doc_id stays; of several such rows the one
at the least locator. A group of copies makes one row a task before anything is
shuffled, and partial sums of these, so a third of all rows with one text is no
skewed key; the state holds some 200 bytes per distinct text, on disk. A lost
executor costs its tasks: state and offsets are in the checkpoint folder, and a
batch that runs again replaces what it wrote.

Defined results: null text counts as empty; a null doc_id is less than any other,
and its row stays only where none has one; rows that repeat are separate documents
of which one stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.llm._store import passing, pieces, shared_dir, written

#: Bytes of texts that a task keeps to compare with; older ones go, and their next copy goes on as a row of its own.
KEEP_BYTES = 64 << 20
#: Settings of the stream's own session: state on disk, whose changes are what a batch saves, and no disk claimed in advance.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_AT = "path string, row long"
#: none, neg: whether the doc_id that stays is null, and its bits turned over, so that the least rank stays; nothing else is ever null.
_RANK = "none boolean, neg long, keep_path string, keep_row long"
_CONTENT = f"digest binary, {_AT}, {_RANK}, n long"
_GROUP = f"digest binary, home struct<batch:int,path:string,row:bigint>, best struct<{_RANK.replace(' ', ':').replace(',:', ',')}>, n long"
_names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _rank(doc_id: int | None, path: str, row: int) -> tuple:
    """The least of a group stays: largest doc_id, then least locator."""
    return (doc_id is None, 0 if doc_id is None else ~doc_id, path, row)


def _ranked() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("neg"), F.col("path").alias("keep_path"), F.col("row").alias("keep_row"))


def _kept_id(rank: str) -> Column:
    return F.when(~F.col(f"{rank}.none"), F.bitwise_not(f"{rank}.neg"))


def _combine(digest: Callable[[bytes], bytes]):
    """doc_id, text, path, row -> _CONTENT: a row per distinct text that the task remembers."""

    def run(batches):
        held: OrderedDict[tuple[bytes, int], list] = OrderedDict()  # digest and number among the texts that share it -> [text, rank, n, locator]
        size = 0

        def pack(items):
            cols = zip(*((d, *at, *rank, n) for (d, _), (_, rank, n, at) in items), strict=True)
            types = [pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _names(_CONTENT))

        for b in batches:
            for p in pieces([b]):
                out = []
                text = p.column("text").cast(pa.large_binary())
                for doc_id, raw, path, row in zip(p.column("doc_id").to_pylist(), text.to_pylist(), p.column("path").to_pylist(), p.column("row").to_pylist(), strict=True):
                    raw = raw or b""
                    d, k, rank = digest(raw), 0, _rank(doc_id, path, row)
                    while (own := held.get((d, k))) is not None and own[0] != raw:
                        k += 1
                    if own is not None:
                        own[1], own[2] = min(own[1], rank), own[2] + 1
                        held.move_to_end((d, k))
                        continue
                    held[d, k] = [raw, rank, 1, (path, row)]
                    size += len(raw) + 300
                while size > KEEP_BYTES:
                    old = held.popitem(last=False)
                    size -= len(old[1][0]) + 300
                    out.append(old)
                if out:
                    yield pack(out)
        while held:
            yield pack([held.popitem(last=False) for _ in range(min(len(held), 10_000))])

    return run


def _located(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))


def _place(path: str, row: str) -> Column:
    return F.xxhash64(path, row)


class StreamDedup:
    """The dedup state of a corpus that arrives as Parquet files at `source`. ingest() reads what is new, and returns when all of it
    is in and its hits are checked; results() has every document so far. All that outlives a batch is below `home` in the shared
    folder (by default one that goes when the driver ends); a new object with the same home goes on where the last one stopped.

    digest: bytes of a text to its digest; any function gives right results, a weak one more work.
    """

    def __init__(self, spark: SparkSession, source: str, home: str | None = None, digest: Callable[[bytes], bytes] = sha256, per_batch: int | None = None):
        self.spark, self.source, self.digest, self.per_batch = spark, source, digest, per_batch
        self.home = home or f"{shared_dir(spark)}/pagespan/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/dedup"
        self.schema = spark.read.parquet(source).select("doc_id", "text").schema

    def _session(self) -> SparkSession:
        """The state's provider is a setting of the session: the streams get one of their own, with the caller's other settings."""
        own = self.spark.newSession()
        for key, value in self.spark.conf.getAll.items():
            if key.startswith("spark.sql.") and self.spark.conf.isModifiable(key):
                own.conf.set(key, value)
        for key, value in STATE.items():
            own.conf.set(key, value)
        return own

    def _run(self, stream: DataFrame, name: str, mode: str) -> None:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.home}/{name}/batch={number}")

        query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{self.home}/checkpoints/{name}").trigger(availableNow=True).start()
        query.awaitTermination()

    def _table(self, name: str, schema: str, by: str = "batch") -> DataFrame:
        fields = self.spark.createDataFrame([], f"{schema}, {by} int").schema
        return self.spark.read.schema(fields).option("basePath", f"{self.home}/{name}").parquet(f"{self.home}/{name}/{by}=*")

    def ingest(self) -> StreamDedup:
        session = self._session()
        reader = session.readStream.schema(self.schema)
        if self.per_batch:
            reader = reader.option("maxFilesPerTrigger", self.per_batch)
        # a stream takes a folder or a pattern: a name whose last character is a class of one matches a single file, too
        at = self.source.rstrip("/")
        at = at if set(at) & set("*?[{") else f"{at[:-1]}[{at[-1]}]"
        self._run(_located(reader.parquet(at)).mapInArrow(_combine(self.digest), _CONTENT), "contents", "append")
        contents = self._table("contents", _CONTENT)
        arriving = session.readStream.schema(contents.schema).parquet(f"{self.home}/contents")
        best = F.min(F.struct(*_names(_RANK))).alias("best")
        self._run(arriving.groupBy("digest").agg(F.min(F.struct("batch", "path", "row")).alias("home"), best, F.sum("n").alias("n")), "groups", "update")
        self._check(contents)
        return self

    def contents(self) -> DataFrame:
        return self._table("contents", _CONTENT)

    def groups(self) -> DataFrame:
        """digest, home, best, n: what the state says of each digest, as of its last batch."""
        last = F.max_by(F.struct("home", "best", "n"), "n").alias("g")
        return self._table("groups", _GROUP).groupBy("digest").agg(last).select("digest", "g.*")

    def refuted(self) -> DataFrame:
        """digest: those that unlike texts share."""
        return self._table("refuted", "digest binary", "upto").select("digest").distinct()

    def _check(self, contents: DataFrame) -> None:
        """Compares the hits of batches that weren't checked before; what is found is kept up to the last of them."""
        last = contents.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        try:
            done = self._table("refuted", "digest binary", "upto")
            before = max(int(f.rsplit("upto=", 1)[1].split("/")[0]) for f in done.inputFiles())
        except (AnalysisException, ValueError):  # nothing has been checked
            before = -2
        if last > before:
            self._unlike(contents.where(F.col("batch") > before)).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/refuted/upto={last}")

    def _documents(self) -> DataFrame:
        return _located(self.spark.read.schema(self.schema).parquet(self.source))

    def _unlike(self, contents: DataFrame) -> DataFrame:
        """digest: those of hits whose texts at the two locators differ in a byte."""
        many = self.groups().select(F.col("digest").alias("of"), F.col("home.path").alias("home_path"), F.col("home.row").alias("home_row"))
        hits = contents.join(many, F.col("digest") == F.col("of")).where("path <> home_path or row <> home_row").select("digest", "path", "row", "home_path", "home_row")
        hits = written(hits, "hits")
        both = hits.unionByName(hits.select("digest", F.col("home_path").alias("path"), F.col("home_row").alias("row"), "home_path", "home_row").distinct())
        both = both.select("digest", F.col("path").alias("at_path"), F.col("row").alias("at_row"), _place("home_path", "home_row").alias("home"))
        if not hits.head(1):
            return hits.select("digest")
        # rows at no such place are dropped before any text is moved
        docs = self._documents().withColumn("doc_id", _place("path", "row"))
        near = passing(docs, both.select(_place("at_path", "at_row").alias("doc_id")).distinct())
        met = both.join(near, (F.col("at_path") == F.col("path")) & (F.col("at_row") == F.col("row")))
        text = F.coalesce("text", F.lit(""))
        return met.groupBy("digest", "home").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high").select("digest").distinct()

    def results(self) -> DataFrame:
        """doc_id, path, row (its locator), keep_id, group_size, kept, text_sha256 for every document that has been read."""
        bad = written(self.refuted(), "refuted")
        group = self.groups().where("n > 1").join(bad, "digest", "left_anti")
        group = group.select(F.col("digest").alias("of"), "n", _kept_id("best").alias("keep"), F.col("best.keep_path").alias("keep_path"), F.col("best.keep_row").alias("keep_row"))
        docs = self._documents()
        text = F.coalesce("text", F.lit(""))
        sha = F.sha2(text, 256)
        if self.digest is sha256:
            narrow = docs.select("doc_id", "path", "row", F.unhex(sha).alias("digest"))
        else:
            digest = self.digest
            keyed = F.udf(lambda t: digest((t or "").encode("utf-8", "surrogatepass")), "binary")
            narrow = docs.select("doc_id", "path", "row", keyed("text").alias("digest"), sha.alias("sha"))
        shown = F.lower(F.hex("digest")) if self.digest is sha256 else F.col("sha")
        fine = narrow.join(group, F.col("digest") == F.col("of"), "left") if not bad.head(1) else narrow.join(bad, "digest", "left_anti").join(group, F.col("digest") == F.col("of"), "left")
        out = fine.select(
            "doc_id", "path", "row", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
            (F.col("of").isNull() | ((F.col("path") == F.col("keep_path")) & (F.col("row") == F.col("keep_row")))).alias("kept"), shown.alias("text_sha256"),
        )
        if not bad.head(1):
            return out
        # digests that unlike texts share: their rows are grouped by the texts themselves
        split = docs.join(narrow.join(bad, "digest", "left_semi").select(F.col("path").alias("p"), F.col("row").alias("r")), (F.col("path") == F.col("p")) & (F.col("row") == F.col("r"))).select("doc_id", "path", "row", text.alias("text"))
        split = written(split, "split")
        own = split.groupBy(F.col("text").alias("same")).agg(F.count(F.lit(1)).alias("n"), F.min(_ranked()).alias("best"))
        split = split.join(own, F.col("text") == F.col("same"))
        kept = (F.col("path") == F.col("best.keep_path")) & (F.col("row") == F.col("best.keep_row"))
        return out.unionByName(split.select("doc_id", "path", "row", _kept_id("best").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), sha.alias("text_sha256")))


def dedup_exact(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document in the Parquet files at `source`."""
    return StreamDedup(spark, source).ingest().results().drop("path", "row")
