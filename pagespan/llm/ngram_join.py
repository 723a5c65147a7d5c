"""N-gram Jaccard join with several global token orders.

Two texts link when 100 * |A & B| >= 80 * |A | B| over their distinct 5-word
shingles. Linked texts share a token within the first n - ceil(0.8 n) + 1 tokens
of each text, whatever the order of the tokens, as long as it is the same for
all texts. Three unlike orders are used: rare tokens first, and two by unrelated
hashes. Candidates come from the collisions of prefix tokens in the first order; a
candidate must also share a prefix token in every further order, and these
filters are intersected on the prefixes alone, before any text of a pair is
moved for verification. "Rare" is judged by fixed-size counters over all texts:
any function of the token gives a valid order, so a counter collision costs time
at most.

Texts with the same set form one class, and only classes are compared. Groups of
near copies are not expanded into pairs: a first round compares each class with a
few of its candidates, those with the fewest tokens of their own, which joins
groups; then every
candidate pair whose classes still lie in different components is compared. A
candidate's shared token must also stand early enough in both texts for enough
tokens to follow it (positional filter): in the text with the smaller set it
must leave room for a set as large as its own, so a token that stands late
everywhere (a passage that many documents close with) makes no pair at all, and
sets meet only within their size bands. Each class also carries 512 bits, each the
parity of how many of its tokens fall on it. Every bit in which two classes
differ is a token that only one of them has, so pairs that differ in too many
bits can't link and are never made: members of a large group of texts that are
alike, but not enough, part here, inside the join. A class with very many candidates is
compared by several tasks, its set being sent once to each.

Defined results: null or empty text, or text of white space: no shingles, linked
with nothing, its own component. Null doc_id: the row is left out. A doc_id that
repeats: the row with the smallest text counts. Other columns are ignored.
Hashes have 64 bits; two different shingles of one comparison meet with a chance
under 2**-40.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagespan.llm._store import COUNTER_SCHEMA, COUNTERS, Counter, components, passing, pieces, release, summed, texts_of, without, written
from pagespan.llm._text import U64, blocks, mix, shingles, slices

ORDERS = 3
#: 1: groups are joined through a few partners of each class first; 0 (tests): all candidates are compared at once.
ROUNDS = 1
PARTNERS = 3
#: Candidates of a class that one task compares.
HUB_PAIRS = 200
#: Columns of 64 parity bits each.
BITS = [f"bits{i}" for i in range(8)]
_SUMMARY = "doc_id long, n int, cid long, " + ", ".join(f"{c} long" for c in BITS) + ", " + COUNTER_SCHEMA


def _class_id(s: np.ndarray) -> int:
    """64 bits from the sorted set and its size."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        a, b = (sum((mix(s[part], seed).sum(dtype=U64) for part in slices(len(s))), start=U64(0)) for seed in (11, 13))
        x = a ^ b * U64(0x9E3779B97F4A7C15)
    return int(mix(np.array([x ^ U64(len(s))], U64), 17).view(np.int64)[0])


def parities(s: np.ndarray) -> np.ndarray:
    """One bit per place: whether an odd number of the set's tokens falls there."""
    m = 64 * len(BITS)
    count = np.zeros(m, np.int64)
    for part in slices(len(s)):
        count += np.bincount((s[part] & U64(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def _may_link(a: str, b: str, percent: int):
    """Whether the parities leave room for a link: sets of n and m tokens that link differ in (100 - percent) / (100 + percent)
    * (n + m) tokens at most, and parities in no more places than sets."""
    apart = sum((F.bit_count(F.col(c + a).bitwiseXOR(F.col(c + b))) for c in BITS[1:]), start=F.bit_count(F.col(BITS[0] + a).bitwiseXOR(F.col(BITS[0] + b))))
    return apart * (100 + percent) <= (F.col("n" + a) + F.col("n" + b)) * (100 - percent)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def prefix(s: np.ndarray, rank: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set in one global order: order 0 by the rank of their counter, then by a hash; the others by hashes
    of their own."""
    p = prefix_length(len(s), percent)
    key = np.empty(len(s), U64)
    for part in slices(len(s)):
        x = s[part]
        own = mix(x, 101 + order)
        key[part] = own if order else (rank[(x >> U64(64 - COUNTERS)).astype(np.int64)].astype(U64) << U64(58)) | (own >> U64(6))
    if p < len(s):
        at = np.flatnonzero(key <= np.partition(key, p - 1)[p - 1])
        return s[at[np.argsort(key[at])]]
    return s[np.argsort(key)]


def reach(n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """The largest partner that a token at place `pos` of n may be the first shared token with: then at most n - pos tokens
    are shared, and a partner of m tokens needs percent / (100 + percent) * (n + m) of them."""
    return (n - pos) * (100 + percent) // percent - n


def _summaries(k: int):
    names = [x.split()[0] for x in _SUMMARY.split(", ")]

    def run(batches):
        counter = Counter()
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, w in blocks(b.column("text")):
                sets = shingles(w, k)
                del w
                for s in sets:
                    counter.add(s)
                bits = np.stack([parities(s) for s in sets], axis=1)
                m = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo:hi], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([_class_id(s) for s in sets], pa.int64()),
                        *(pa.array(x) for x in bits),
                        pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.binary()),
                    ],
                    names,
                )
        rows = counter.rows()
        m = len(rows)
        none = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), *(pa.nulls(m, pa.int64()) for _ in ["cid", *BITS])]
        yield pa.RecordBatch.from_arrays([*none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

    return run


def _postings(k: int, percent: int, ranks):
    def run(batches):
        rank = np.frombuffer(ranks.value, np.uint8)
        seen: set[int] = set()  # bounded by the texts of this task
        for b in batches:
            for _, _, w in blocks(b.column("text")):
                tok, cid, size, far = [], [], [], []
                sets = shingles(w, k)
                del w
                for s in sets:
                    if len(s) and (c := _class_id(s)) not in seen:
                        seen.add(c)
                        p = prefix(s, rank, 0, percent)
                        tok.append(p)
                        cid.append(np.full(len(p), c, np.int64))
                        size.append(np.full(len(p), len(s), np.int32))
                        far.append(reach(len(s), np.arange(len(p)), percent).astype(np.int32))
                if tok:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (cid, size, far))], ["token", "cid", "n", "reach"])

    return run


_COLL = "token long, cid long, n int, reach int, first_cid long, first_n int, first_reach int"


def _collisions():
    """Rows sorted by token, lateness and cid: keeps one per token and class, of tokens that two classes share, and tells each
    the first row of its token (the class in which the token comes earliest). A token that leaves no class room for a set of
    its own size (reach < n throughout, so in the first row) can't be the first shared token of a linked pair, and goes."""

    def run(batches):
        last = None  # the last row, whether its token's rows are going out, and the token's first row
        for b in batches:
            t, c, n, far = (b.column(x).to_numpy() for x in ("token", "cid", "n", "reach"))
            if not len(t):
                continue
            if last is not None:
                t, c, n, far = (np.concatenate([[v], x]).astype(x.dtype) for v, x in zip(last[0], (t, c, n, far), strict=True))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c, n, far = t[new], c[new], n[new], far[new]
            head = np.ones(len(t), bool)
            head[1:] = t[1:] != t[:-1]
            run_of = np.cumsum(head) - 1
            first = np.stack([x[head].astype(np.int64) for x in (c, n, far)])
            many = np.bincount(run_of)[run_of] > 1
            if last is not None:
                first[:, 0] = last[2]
                if last[1]:
                    many |= run_of == 0
            many &= (first[2] >= first[1])[run_of]
            going = bool(many[-1])
            out = many.copy()
            if last is not None and last[1]:
                out[0] = False  # it has gone out already
            last = ((t[-1], c[-1], n[-1], far[-1]), going, first[:, -1].copy())
            if out.any():
                fc, fn, fr = first[:, run_of[out]]
                cols = [pa.array(x[out]) for x in (t, c, n, far)] + [pa.array(fc), pa.array(fn.astype(np.int32)), pa.array(fr.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _COLL.split(", ")])

    return run


def _signatures(k: int, percent: int):
    """doc_id, text -> doc_id and, for the second and later orders, the prefix tokens cut to 32 bits (a clash passes a pair on)."""

    def run(batches):
        for b in pieces(batches):
            ids = b.column("doc_id").to_numpy()
            for lo, hi, w in blocks(b.column("text")):
                sets = shingles(w, k)
                lists = []
                for o in range(1, ORDERS):
                    cut = [(prefix(s, None, o, percent) >> U64(32)).astype(np.uint32).view(np.int32) for s in sets]
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cut))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), *lists], ["doc_id", *[f"p{o}" for o in range(1, ORDERS)]])

    return run


def _verify(k: int, percent: int):
    """Rows sorted by hub, salt and kind: the hub's text (other is null), then its partners' -> the linked (a, b)."""

    def run(batches):
        hub, x = None, None
        for b in pieces(batches):
            hubs, others = b.column("hub").to_pylist(), b.column("other").to_pylist()
            keep_a, keep_b = [], []
            for lo, hi, w in blocks(b.column("text")):
                for i, y in zip(range(lo, hi), shingles(w, k), strict=True):
                    if others[i] is None:
                        hub, x = hubs[i], y
                        continue
                    if hub != hubs[i]:
                        raise ValueError("a partner came without its hub")
                    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep_a.append(hub)
                        keep_b.append(others[i])
            if keep_a:
                yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], ["a", "b"])

    return run


def _neighbours(coll: DataFrame) -> DataFrame:
    """At most PARTNERS pairs (a, b) per class: a row pairs with the row of its token that comes earliest in its own text (a copy
    with few tokens of its own). A class keeps those partners that it met most often."""
    t = coll.where("first_cid <> cid and first_n <= reach and n <= first_reach").groupBy(F.col("cid").alias("a"), F.col("first_cid").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.col("c").desc(), F.xxhash64("b")))
    return t.withColumn("r", best).where(F.col("r") <= PARTNERS).select("a", "b")


def _band(n):
    """Sets that can link differ by a quarter of the smaller at most, so by one band at most."""
    return F.floor(F.log(n) / F.log(F.lit(1.25))).cast("int")


def _meeting(tagged: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs (a, b) of classes of different components. The smaller set's token must leave room for a set of its
    own size (n <= reach), which few tokens of a hot group do; the larger one's is then sought in the bands up to its reach."""
    wide = F.floor(F.log(F.lit(100.0 / percent)) / F.log(F.lit(1.25))).cast("int") + 2
    side = lambda e: [F.col(c).alias(c + e) for c in ("comp", "cid", "n", "reach", *BITS)]
    small = tagged.where("n <= reach").select("token", *side("a"), F.explode(F.sequence(_band(F.col("n")), _band(F.col("n")) + wide)).alias("band"))
    large = tagged.select("token", *side("b"), _band(F.col("n")).alias("band"))
    small = small.where(F.col("band") <= _band(F.col("reacha")))
    met = small.join(large, ["token", "band"]).where("compa <> compb and na <= nb and nb <= reacha and na <= reachb").where(_may_link("a", "b", percent))
    return met.select(F.least("cida", "cidb").alias("a"), F.greatest("cida", "cidb").alias("b")).distinct()


def ngram_jaccard_join(documents: DataFrame, k: int = 5, percent: int = 80) -> dict[str, DataFrame]:
    """members (doc_id, n_shingles, class_id), links (a, b: class ids that were found linked) and groups (class_id, component_id).

    class_id is the smallest doc_id with that set. Links hold every pair that the
    components need: pairs inside a component that earlier links already join are
    not compared.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    first = written(docs.mapInArrow(_summaries(k), _SUMMARY), "summaries")
    counts = summed(first.where("block is not null").select("block", "counts"))
    rank = np.minimum(np.ceil(np.log2(counts + 1)), 63).astype(np.uint8)
    ranks = spark.sparkContext.broadcast(rank.tobytes())  # 4 MB, fixed

    rows = first.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "cid", *BITS)).alias("m"), F.count(F.lit(1)).alias("c"))
    repeated = rows.where("c > 1").select("doc_id")
    if repeated.head(1):
        # the smallest text of a repeated doc_id counts, as in texts_of
        again = texts_of(docs, repeated).mapInArrow(_summaries(k), _SUMMARY).where("doc_id is not null").select("doc_id", F.struct("n", "cid", *BITS).alias("m2"))
        rows = rows.join(again, "doc_id", "left").select("doc_id", F.coalesce("m2", "m").alias("m"))
        docs = texts_of(docs, rows.select("doc_id"))
    member = written(rows.select("doc_id", F.col("m.n").alias("n"), F.col("m.cid").alias("cid"), *[F.col(f"m.{c}").alias(c) for c in BITS]), "members")
    reps = written(member.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("class_id"), *[F.min(c).alias(c) for c in ["n", *BITS]]), "classes")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = docs.mapInArrow(_postings(k, percent, ranks), "token long, cid long, n int, reach int").repartition(parts, "token").sortWithinPartitions("token", (-F.col("reach") / F.col("n")), "cid")
    coll = written(sorted_.mapInArrow(_collisions(), _COLL), "collisions")

    def check(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) of classes -> (a, b) of class ids that link."""
        end = lambda e: reps.select(F.col("cid").alias(e), F.col("class_id").alias(f"d{e}"), *[F.col(c).alias(c + e) for c in ("n", *BITS)])
        named = written(pairs.join(end("a"), "a").join(end("b"), "b").where(_may_link("a", "b", percent)).select("da", "db"), "pairs")
        # docs has one row per doc_id; the few that only the filter lets through meet no pair below
        text = written(passing(docs, named.select(F.col("da").alias("doc_id")).union(named.select("db")).distinct()).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "texts")
        orders = [f"p{o}" for o in range(1, ORDERS)]
        sign = written(text.mapInArrow(_signatures(k, percent), "doc_id long, " + ", ".join(f"{c} array<int>" for c in orders)), "prefixes")
        side = lambda e: sign.select(F.col("doc_id").alias(f"d{e}"), *[F.col(c).alias(f"{c}{e}") for c in orders])
        kept = named.join(side("a"), "da").join(side("b"), "db")
        for c in orders:
            kept = kept.where(F.arrays_overlap(f"{c}a", f"{c}b"))
        kept = written(kept.select("da", "db"), "candidates")

        # of a pair the class with more pairs is the hub: its text is sent once to each of its tasks, its partners' to one
        degree = kept.select(F.col("da").alias("id")).union(kept.select("db")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        deg = lambda e: degree.select(F.col("id").alias(f"d{e}"), F.col("n").alias(f"n{e}"))
        turned = kept.join(deg("a"), "da").join(deg("b"), "db").select(
            F.when(F.col("na") >= F.col("nb"), F.col("da")).otherwise(F.col("db")).alias("hub"), F.when(F.col("na") >= F.col("nb"), F.col("db")).otherwise(F.col("da")).alias("other"), F.ceil(F.greatest("na", "nb") / HUB_PAIRS).alias("salts")
        )
        turned = written(turned.withColumn("salt", F.pmod(F.xxhash64("other"), "salts")), "turned")
        own = turned.select("hub", "salt").distinct().select("hub", "salt", F.lit(None).cast("long").alias("other"), F.col("hub").alias("doc_id"))
        rows = own.unionByName(turned.select("hub", "salt", "other", F.col("other").alias("doc_id"))).join(text, "doc_id").drop("doc_id")
        return rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("other").asc_nulls_first()).mapInArrow(_verify(k, percent), "a long, b long")

    links = checked = None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = _neighbours(coll).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            cls = reps.select("cid", F.col("class_id").alias("comp"), *BITS)
            if links is not None:
                found = written(components(links), "groups")
                cls = reps.join(found, reps.class_id == found.id, "left").select("cid", F.coalesce("root", "class_id").alias("comp"), *BITS)
            tagged = coll.select("token", "cid", "n", "reach").join(cls, "cid")
            mixed = tagged.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
            tagged = written(tagged.join(mixed, "token", "left_semi"), "tagged")
            pairs = _meeting(tagged, percent)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")  # compared before, and not linked
        pairs = written(pairs, "pairs")
        if not pairs.head(1):
            continue
        checked = pairs if checked is None else checked.unionByName(pairs)
        new = written(check(pairs), "links")
        links = new if links is None else links.unionByName(new)
    release(coll)
    groups = components(links if links is not None else spark.createDataFrame([], "a long, b long"))
    members = member.join(reps.select("cid", "class_id"), "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    links = links if links is not None else spark.createDataFrame([], "a long, b long")
    return {"members": members, "links": links, "groups": groups.select(F.col("id").alias("class_id"), F.col("root").alias("component_id"))}


def near_duplicate_components(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class_id."""
    out = ngram_jaccard_join(documents, k, percent)
    return (
        out["members"].join(out["groups"], "class_id", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component_id", "class_id").alias("component_id"), "class_id")
    )


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """documents without those that another of their group, with a smaller doc_id, stands for. Documents without words stay.
    Rows without doc_id stay; rows that share a doc_id stay or go together."""
    groups = near_duplicate_components(documents, k, percent)
    return without(documents, groups.where("component_id <> doc_id"))
