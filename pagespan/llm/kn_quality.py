"""Quality classifier: an interpolated modified Kneser-Ney character model of trusted text.

Training text: the documents labelled quality 1 and toxic 0 of one half (by a hash
of doc_id); `max_docs` bounds them if it is given. Five-gram counts are summed in tables keyed
by a packed n-gram; every lower order counts distinct left extensions; each
order's counts are joined with their context's totals and with the next lower
order's probabilities, all joins hash-sharded by the packed key. The three
discounts of an order come from its counts of counts.

Scoring: a text's perplexity per character, all of the text, from sharded joins.
Texts are packed into blocks of about BLOCK_BYTES. A block's distinct five-grams go out
once each, whatever their number in it; the distinct ones of all blocks meet the
model's tables, order by order, in joins by key, and come back to the blocks that
asked, where each document's log probabilities are summed. No table of the model
is collected, and no worker holds more than a block and its own n-grams.

Short texts scatter
more than long ones, so log perplexities are measured from the median of the
language's trusted documents outside the sample, in units of the spread at the
text's length (variance a + b / characters, fitted to those documents). A
language's limit is a quantile of these (a mergeable sketch, exact to one rank in ACCURACY); a language with fewer than
`min_held_out` such documents uses median and quantile over all. `threshold` is
the limit as a perplexity at the document's length. Documents above it are
rejected, and those without a word. Perplexity can't catch a few bad words in
otherwise ordinary text.

Symbols have 12 bits. Code points up to DIRECT are symbols of their own; a later one is
two, a lead and a trail, so that every text has n-grams of its own; its probability
is the product of both, and perplexity stays per code point. Defined results: null or empty text has
no perplexity and is rejected; null lang is a language of its own; rows without
doc_id are scored and can't be labelled; rows that share a doc_id are scored each,
and train each; of several labels of a document, one
that isn't trusted wins; without trusted documents nothing but wordless text is
rejected; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespan.llm._store import pieces, release, without, written
from pagespan.llm._text import distinct

ORDER = 5
BITS = 12
TOP = (1 << BITS) - 1
#: Later code points take a lead from DIRECT on (272 of them reach the last code point) and a trail of 12 bits.
DIRECT = 3823
BLOCK_BYTES = 32 << 20
ACCURACY = 20_000
#: Model tables and lists of labelled ids are broadcast up to so many rows of at most 24 bytes; beyond that their joins are shuffled.
BROADCAST_ROWS = 200_000
_BLOCK_CHARS = 1 << 18


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each led by ORDER - 1 pads (symbol 0), and where each text's symbols begin and end."""
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size + ORDER - 1)
    pad = "\0" * (ORDER - 1)
    x = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    bounds = np.stack([end - size, end])
    far = x >= DIRECT
    if not far.any():
        return x, bounds
    at = np.concatenate([[0], np.cumsum(far)])  # symbols more than code points, before each place
    out = np.empty(len(x) + at[-1], np.int64)
    place = np.arange(len(x)) + at[:-1]
    over = x - DIRECT
    out[place] = np.where(far, DIRECT + (over >> BITS), x)
    out[place[far] + 1] = over[far] & TOP
    return out, bounds + at[bounds]


def _keys(x: np.ndarray) -> np.ndarray:
    """For position i the packed n-gram that ends there (positions before ORDER - 1 are filled with pads)."""
    k = x.copy()
    for j in range(1, ORDER):
        k[j:] |= x[:-j] << (BITS * j)
    return k


def _text_blocks(texts: list[str | None]):
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n < _BLOCK_CHARS):
            n += len(texts[hi] or "")
            hi += 1
        yield lo, hi, [t or "" for t in texts[lo:hi]]
        lo = hi


def _grams(texts: list[str]) -> np.ndarray:
    """The packed n-gram that ends at each character of the texts."""
    x, (start, end) = _symbols(texts)
    own = np.zeros(len(x) + 1, np.int64)
    np.add.at(own, start, 1)
    np.add.at(own, end, -1)
    return _keys(x)[np.cumsum(own[:-1]) > 0]


def _count(batches):
    for b in pieces(batches):
        for _, _, texts in _text_blocks(b.column("text").to_pylist()):
            k, c = np.unique(_grams(texts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "c"])


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    r = counts.agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(r[i]) for i in range(4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return tuple(min(max(v, 0.05), i + 0.95) for i, v in enumerate(d))


def train(texts: DataFrame) -> dict[str, list[DataFrame]]:
    """texts (text) -> for n = 1 to ORDER, in this order, 'p': (key, value), log probability of the n-gram, and 'g': (key, value),
    log back-off weight of the context of n - 1 symbols. All are tables in the shared folder."""
    order = {ORDER: written(texts.select("text").mapInArrow(_count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "counts")}
    for n in range(ORDER - 1, 0, -1):
        rest = order[n + 1].select(F.col("key").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("key"))
        order[n] = written(rest.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "counts")
    out: dict[str, list[DataFrame]] = {"p": [], "g": []}
    lower = None
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(order[n])
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        c = order[n].withColumn("ctx", F.shiftright("key", BITS)).withColumn("d", d)
        ctx = c.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        ctx = written(ctx.select("ctx", "total", "gamma", F.log("gamma").alias("value")), "contexts")
        p = c.join(ctx.drop("value"), "ctx")
        if lower is None:
            p = p.withColumn("low", F.lit(1.0 / (TOP + 1)))
        else:
            p = p.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(lower.select(F.col("key").alias("suffix"), F.exp("value").alias("low")), "suffix")
        value = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("low")
        lower = written(p.select("key", F.log(value).alias("value")), "order")
        out["p"].append(lower)
        out["g"].append(ctx.withColumnRenamed("ctx", "key"))
    release(*order.values())
    return out


def log_probabilities(grams: DataFrame, model: dict[str, list[DataFrame]]) -> DataFrame:
    """grams (key: distinct packed n-grams of ORDER symbols) with value: the log probability of the last symbol. One join per
    table; a gram falls back to the next lower order, with the context's weight, as far as it must."""
    columns = grams.columns
    grams = grams.withColumn("value", F.lit(-float(np.log(TOP + 1))))
    for n in range(1, ORDER + 1):
        own = F.col("key").bitwiseAND(F.lit((1 << BITS * n) - 1))
        for kind, at in (("p", own), ("g", F.shiftright(own, BITS))):
            t = model[kind][n - 1].select(F.col("key").alias("k"), F.col("value").alias(kind))
            if t.count() <= BROADCAST_ROWS:
                t = F.broadcast(t)
            grams = grams.withColumn("at", at).join(t, F.col("at") == F.col("k"), "left").drop("at", "k")
        grams = grams.select(*columns, F.coalesce("p", F.coalesce("g", F.lit(0.0)) + F.col("value")).alias("value"))
    return grams


class Table:
    """Open addressing over packed keys, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.keys[slots] = keys[put]
            self.values[slots] = values[put]
            stay = self.keys[at] != keys[left]
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key is there, and its value or 0."""
        at = self._slot(keys)
        seen = self.keys[at]
        hit = seen == keys
        value = np.where(hit, self.values[at], np.float32(0))
        left = np.flatnonzero(~hit & (seen != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            seen = self.keys[at]
            ok = seen == keys[left]
            hit[left[ok]] = True
            value[left[ok]] = self.values[at[ok]]
            go = ~ok & (seen != -1)
            left, at = left[go], at[go]
        return hit, value


#: Squared deviations of texts of length n weigh 1 / (_SPREAD + 1 / n) ** 2 in the fit of their spread.
_SPREAD = 0.05


def has_text(text):
    return F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)).alias("has_text")


_BLOCK = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("has_text", pa.bool_()), ("text", pa.string())])


def _pack(batches):
    """Rows -> blocks of about BLOCK_BYTES of text (one text at least), compressed, named by their content and place."""
    made = itertools.count(TaskContext.get().partitionId() << 32)

    def packed(parts):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _BLOCK, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            for x in parts:
                out.write_batch(x)
        raw = sink.getvalue().to_pybytes()
        return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(raw, next(made)) - (1 << 63)], pa.int64()), pa.array([raw], pa.binary())], ["block", "payload"])

    held, size = [], 0
    for b in pieces(batches, most=BLOCK_BYTES >> 3):
        b = pa.RecordBatch.from_arrays([b.column(c).cast(_BLOCK.field(c).type) for c in _BLOCK.names], schema=_BLOCK)
        n = pa.compute.sum(pa.compute.binary_length(b.column("text"))).as_py() or 0
        if held and size + n > BLOCK_BYTES:
            yield packed(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield packed(held)


def _unpack(raw: bytes):
    with pa.ipc.open_stream(raw) as rows:
        yield from rows


def _distinct(batches):
    """Blocks -> (block, key): each block's distinct n-grams."""
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("payload"), strict=True):
            seen, new, n = np.zeros(0, np.int64), [], 0
            for rows in _unpack(raw.as_buffer()):
                for _, _, texts in _text_blocks(rows.column("text").to_pylist()):
                    new.append(distinct(_grams(texts)))
                    n += len(new[-1])
                    if n > 2_000_000:
                        seen, new, n = distinct(np.concatenate([seen, *new])), [], 0
            seen = distinct(np.concatenate([seen, *new]))
            for at in range(0, len(seen), 1 << 18):
                k = seen[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int64)), pa.array(k)], ["block", "key"])


_SCORES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("perplexity", pa.float64()), ("has_text", pa.bool_()), ("size", pa.int64())])


def _score(grams: pa.Table, blocks: pa.Table) -> pa.Table:
    """One block's n-grams with their log probabilities, and the block (equal blocks are separate rows)."""
    table = Table(grams.column("key").to_numpy(), grams.column("value").to_numpy())
    out = []
    for raw in blocks.column("payload").combine_chunks() if blocks.num_rows else ():
        for rows in _unpack(raw.as_buffer()):
            value, size = [], []
            for _, _, texts in _text_blocks(rows.column("text").to_pylist()):
                x, (start, end) = _symbols(texts)
                hit, v = table.find(_keys(x))
                s = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
                missed = np.concatenate([[0], np.cumsum(~hit)])
                if (missed[end] != missed[start]).any():
                    raise ValueError("an n-gram of a block has no probability: the rows changed between two reads")
                chars = np.array([len(t) for t in texts], np.int64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    value += [float(p) if n else None for p, n in zip(np.exp((s[start] - s[end]) / chars), chars, strict=True)]
                size += chars.tolist()
            out.append(pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array(value, pa.float64()), rows.column("has_text"), pa.array(size, pa.int64())], schema=_SCORES))
    return pa.Table.from_batches(out, _SCORES)


def perplexities(documents: DataFrame, model: dict[str, list[DataFrame]]) -> DataFrame:
    """doc_id, lang, perplexity (null for empty text), has_text (a word at least), size (code points)."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), has_text(F.col("text")), F.col("text").cast("string").alias("text"))
    if not model["p"][-1].head(1):
        return docs.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), "has_text", F.lit(None).cast("long").alias("size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # both exchanges are read twice and written once
    blocks = docs.mapInArrow(_pack, "block long, payload binary").repartition(parts, "block")
    asked = blocks.mapInArrow(_distinct, "block long, key long").where("block is not null and key is not null").repartition(parts, "key")
    # the least block of a key is carried along, and used, so that both reads of `asked` have the same columns and filters and share one exchange
    known = log_probabilities(asked.groupBy("key").agg(F.min("block").alias("least")), model)
    answered = asked.join(known, "key").where("block >= least").select("block", "key", F.col("value").cast("float").alias("value"))
    schema = "doc_id long, lang string, perplexity double, has_text boolean, size long"
    return answered.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_score, schema)


def _variance(held: DataFrame) -> tuple[float, float]:
    """a and b of the variance a + b / size of log perplexities (`log`) about `own`, by weighted least squares."""
    x, y = 1 / F.col("size"), (F.col("log") - F.col("own")) ** 2
    w = (_SPREAD + x) ** -2
    r = held.agg(*[F.coalesce(F.sum(w * v), F.lit(0.0)).alias(c) for c, v in (("w", F.lit(1.0)), ("x", x), ("xx", x * x), ("y", y), ("xy", x * y))]).first()
    a, b = np.linalg.lstsq(np.array([[r.w, r.x], [r.x, r.xx]]), np.array([r.y, r.xy]), rcond=None)[0].tolist()
    if b < 0:
        a, b = r.y / r.w, 0.0
    elif a < 0:
        a, b = 0.0, r.xy / r.xx
    return max(a, 1e-9), b


def classify(documents: DataFrame, labels: DataFrame, quantile: float = 0.99, max_docs: int | None = None, min_held_out: int = 50) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep."""
    score = score_parts(documents, labels, max_docs)
    key = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")).alias("lang_key")
    log = F.log("perplexity")
    held = written(score["scores"].join(score["held_out"], "doc_id").where("perplexity is not null").select(key, log.alias("log"), "size"), "held_out")
    mid = held.agg(F.percentile_approx("log", F.lit(0.5), F.lit(ACCURACY))).first()[0]
    langs = held.groupBy("lang_key").agg(F.percentile_approx("log", F.lit(0.5), F.lit(ACCURACY)).alias("mid"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_held_out)
    held = held.join(langs, "lang_key", "left").withColumn("own", F.coalesce("mid", F.lit(mid).cast("double")))
    a, b = _variance(held)
    unit = F.sqrt(F.lit(a) + F.lit(b) / F.greatest("size", F.lit(1)))
    by = held.groupBy("lang_key").agg(F.first("own").alias("mid"), F.percentile_approx((F.col("log") - F.col("own")) / unit, F.lit(quantile), F.lit(ACCURACY)).alias("z"), F.count(F.lit(1)).alias("n"))
    by = by.where(F.col("n") >= min_held_out).select("lang_key", "mid", "z")
    pooled = held.agg(F.percentile_approx((F.col("log") - F.lit(mid)) / unit, F.lit(quantile), F.lit(ACCURACY))).first()[0]
    out = score["scores"].withColumn("lang_key", key).join(F.broadcast(by), "lang_key", "left")
    limit = F.exp(F.coalesce("mid", F.lit(mid).cast("double")) + F.coalesce("z", F.lit(pooled).cast("double")) * unit)
    keep = F.col("has_text") & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.withColumn("threshold", limit).select("doc_id", "lang", "perplexity", "threshold", keep.alias("keep"))


def filter_documents(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """documents without the rejected ones. Rows without doc_id stay; rows that share a doc_id go if one of them is rejected."""
    return without(documents, classify(documents, labels, **how).where("not keep and doc_id is not null"))


def score_parts(documents: DataFrame, labels: DataFrame, max_docs: int | None) -> dict[str, DataFrame]:
    trusted = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("ok")).where("ok").select("doc_id")
    sample = trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    if max_docs is not None:
        sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = written(sample, "sample")
    ids = F.broadcast(sample) if sample.count() <= BROADCAST_ROWS else sample
    model = train(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi"))
    scores = written(perplexities(documents, model), "scores")
    release(*model["p"], *model["g"])
    return {"scores": scores, "held_out": trusted.join(sample, "doc_id", "left_anti")}
