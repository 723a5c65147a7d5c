"""Conversation structure repair: the cheapest edits that give a conversation a legal turn structure.

Legal role initials are `(s?(ua)+)?`. Edits of a row: Keep (0), Rerole to user or
assistant (1), Delete (2), and between rows Insert an empty user or assistant turn
(5). Blank and duplicate rows must go; a truncated row that stays costs 5 more. Of
the cheapest edits those with the ASCII-least initials (D, I, K, R) are taken.

Method: Dijkstra on the implicit lattice of (rows done, grammar state) with priority
(cost, audit), stopping at the first popped accepting end node. Two audits of one
cost that reach one node are never prefixes of each other (the longer one would
have inserts, which cost, on top), so the lesser of them stays the lesser whatever
follows, and a node is settled when it is first popped.

Rows are sorted by range (conversation, turn, role, text), so a conversation of any
length is spread. A conversation that lies inside a partition is solved where it
is. Others, those at partition ends and those of over PIECE_ROWS rows, are cut
into pieces: for each state that a piece may begin with, the same search gives the
cheapest edits to each state that it may end with, and these are chained in order,
one piece at a time. The chained audits, and the digest of one conversation, are
sequential: they stream through one task.

A row's first fault counts: blank (no character outside [\\x20\\x09-\\x0D]), duplicate
(role and text seen earlier), truncated (its last such character isn't one of
`.!?`). First places of repeated (role, text) are aggregated, so a hot conversation
or turn is no group.

Defined results: null role or text is one space; null turns come first; rows of one
turn are ordered by role and text, so rows that repeat stand next to each other; a
null conv_id is a conversation of its own; a role without characters fits nowhere;
an empty table gives no rows; other columns are ignored. Gaps are what is missing
between the least and the largest turn, nulls aside.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespan.llm._store import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PIECE_ROWS = 512
PIECE_CHARS = 4 << 20
BROADCAST_ROWS = 200_000
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Where a user or assistant turn, whichever is legal, leads.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")
FINE, CUT_OFF, GONE = 0, 1, 2


def cheapest(rows: list[tuple[str, int]], start: int = 0, every_end: bool = False) -> dict[int, tuple[int, str]]:
    """rows (role initial, fault) -> {end state: (cost, audit)}: the first accepting one popped, or with every_end all of them."""
    n, done, ends = len(rows), set(), {}
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (every_end or state in ACCEPTING):
            ends[state] = (cost, audit)
            if not every_end:
                break
        if (i, NEXT[state]) not in done:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state]))
        if i < n:
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault != GONE:
                more = cost + TRUNCATED * (fault == CUT_OFF)
                heapq.heappush(heap, (more + REROLE, audit + "R", i + 1, NEXT[state]))
                if (to := STEP.get((state, initial))) is not None:
                    heapq.heappush(heap, (more + KEEP, audit + "K", i + 1, to))
    return ends


def edited(roles: list[str], texts: list[str], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """The (role, text) turns that an audit makes of rows, from a grammar state on."""
    out, i = [], 0
    for edit in audit:
        if edit == "K":
            out.append((roles[i], texts[i]))
            state = STEP[state, roles[i][:1]]
        elif edit in "RI":
            state = NEXT[state]
            out.append((ROLE[state], texts[i] if edit == "R" else ""))
        i += edit != "I"
    return out


_TEXTS = pa.list_(pa.string())
_PIECE = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("ord", pa.int32()), ("whole", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
     ("cost", pa.int64()), ("audit", pa.string()), ("digest", pa.string()), ("paths", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("roles", _TEXTS), ("texts", _TEXTS)]
)
_PIECES = (
    "conv_id long, part int, ord int, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, digest string, "
    "paths array<struct<a:int,b:int,cost:bigint,audit:string>>, roles array<string>, texts array<string>"
)
_SPACE = " \t\n\x0b\x0c\r"


class _Pieces:
    """Sorted rows of a partition -> _PIECE records."""

    def __init__(self, part: int, texts: bool):
        self.part, self.keep_texts, self.ord, self.seen, self.out, self.size = part, texts, 0, 0, [], 0
        self.rows: list[tuple[str, str, int]] = []
        self.chars, self.cut = 0, False
        self.counts = [0, 0, 0]

    def add(self, role: str, text: str, repeated: bool) -> None:
        own = text.rstrip(_SPACE)
        fault = 0 if not own else 1 if repeated else 2 if own[-1] not in ".!?" else None
        if fault is not None:
            self.counts[fault] += 1
        self.rows.append((role, text, FINE if fault is None else CUT_OFF if fault == 2 else GONE))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def close(self, conv: int | None, ends: bool, last: bool = False) -> None:
        """The rows so far are a piece. ends: and the last one of their conversation here; last: and of the partition."""
        roles, texts = [r for r, _, _ in self.rows], [t for _, t, _ in self.rows]
        initials = [r[:1] for r in roles]
        lattice = [(x, fault) for x, (_, _, fault) in zip(initials, self.rows, strict=True)]
        whole = ends and not last and not self.cut and self.seen > 0
        record = dict.fromkeys(_PIECE.names) | {
            "conv_id": conv, "part": self.part, "ord": self.ord, "whole": whole, "blank": self.counts[0], "duplicate": self.counts[1], "truncated": self.counts[2],
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "first": initials[0], "last": initials[-1],
        }
        if whole:
            ((cost, audit),) = cheapest(lattice).values()
            turns = edited(roles, texts, audit)
            record |= {"cost": cost, "audit": audit, "digest": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()}
            roles, texts = ([r for r, _ in turns], [t for _, t in turns]) if self.keep_texts else (None, None)
        else:
            record["paths"] = [{"a": a, "b": b, "cost": c, "audit": x} for a in range(4) for b, (c, x) in cheapest(lattice, a, True).items()]
        self.out.append(record | {"roles": roles, "texts": texts})
        self.size += self.chars
        self.ord += 1
        self.cut = not ends
        self.seen += ends
        self.rows, self.chars, self.counts = [], 0, [0, 0, 0]

    def batch(self) -> pa.RecordBatch:
        out, self.out, self.size = self.out, [], 0
        return pa.RecordBatch.from_pylist(out, schema=_PIECE)


def _cut(texts: bool):
    def run(batches):
        p, before = _Pieces(TaskContext.get().partitionId(), texts), None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "again")), strict=True):
                if before is not None and row[0] != before[0]:
                    p.close(before[0], True)
                elif p.full():
                    p.close(before[0], False)
                if len(p.out) >= 4096 or p.size > PIECE_CHARS:
                    yield p.batch()
                p.add(row[2], row[3], row[4] or row[:4] == before)
                before = row[:4]
        if before is not None:
            p.close(before[0], True, True)
            yield p.batch()

    return run


class _Node:
    """The audit of a piece after those of the pieces before it."""

    __slots__ = ("audit", "before", "state")

    def __init__(self, before, state, audit):
        self.before, self.state, self.audit = before, state, audit


def _less(x: _Node | None, y: _Node | None) -> bool:
    """Whether x's whole audit comes first; both have as many pieces, and only those that they don't share are compared."""
    left, right = [], []
    while x is not y:
        left.append(x.audit)
        right.append(y.audit)
        x, y = x.before, y.before
    return "".join(reversed(left)) < "".join(reversed(right))


_CHOSEN = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("ord", pa.int32()), ("state", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("between", pa.int64())])


def _chain(batches):
    """Pieces sorted by conversation and place -> for each the state it begins with and its audit; the total cost, and the
    illegal pairs between pieces, stand at the first."""

    def chosen(conv, ids, best, between):
        cost, node = None, None
        for state in ACCEPTING:
            if state in best and (cost is None or best[state][0] < cost or best[state][0] == cost and _less(best[state][1], node)):
                cost, node = best[state]
        path = []
        while node is not None:
            path.append(node)
            node = node.before
        return [(conv, *at, x.state, x.audit, cost if k == 0 else 0, between if k == 0 else 0) for k, (at, x) in enumerate(zip(ids, reversed(path), strict=True))]

    conv, ids, best, between, last, out = None, [], {0: (0, None)}, 0, None, []
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHOSEN, strict=True)], schema=_CHOSEN)
    for b in batches:
        for own, part, ord_, first, end, paths in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "ord", "first", "last", "paths")), strict=True):
            if ids and own != conv:
                out += chosen(conv, ids, best, between)
                ids, best, between, last = [], {0: (0, None)}, 0, None
            conv = own
            new: dict[int, tuple[int, _Node]] = {}
            for p in paths:
                if p["a"] in best:
                    cost, node = best[p["a"]][0] + p["cost"], _Node(best[p["a"]][1], p["a"], p["audit"])
                    was = new.get(p["b"])
                    if was is None or cost < was[0] or cost == was[0] and _less(node, was[1]):
                        new[p["b"]] = (cost, node)
            between += last is not None and last + first not in LEGAL
            best, last = new, end
            ids.append((part, ord_))
        if len(out) > 4096:
            yield pack(out)
            out = []
    if ids:
        out += chosen(conv, ids, best, between)
    if out:
        yield pack(out)


def _edit(batches):
    """Pieces with their chosen state and audit -> their turns."""
    for b in batches:
        turns = [edited(r, t, a, s) for r, t, a, s in zip(*(b.column(c).to_pylist() for c in ("roles", "texts", "audit", "state")), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("part"), b.column("ord"), pa.array([[r for r, _ in x] for x in turns], _TEXTS), pa.array([[t for _, t in x] for x in turns], _TEXTS)], ["conv_id", "part", "ord", "roles", "texts"]
        )


def _digests(batches):
    """Turns by piece, sorted by conversation and place -> a digest per conversation, read on from batch to batch."""
    conv, h, any_yet, out = None, None, False, []
    for b in batches:
        for own, roles, texts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "roles", "texts")), strict=True):
            if h is None or own != conv:
                if h is not None:
                    out.append((conv, h.hexdigest()))
                conv, h, any_yet = own, hashlib.sha256(), False
            for r, t in zip(roles, texts, strict=True):
                h.update((("\n" if any_yet else "") + f"{r}:{t}").encode("utf-8", "surrogatepass"))
                any_yet = True
    if h is not None:
        out.append((conv, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["conv_id", "digest"])


def _named(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def _same_conv(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repair_conversations(rows: DataFrame, texts: bool = True) -> dict[str, DataFrame]:
    """rows (conv_id, turn, role, text) -> report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of the repaired `role:text`, newline-joined); turns (with `texts`): conv_id, part, ord, place, role, text,
    the repaired turns, in the order of (part, ord, place)."""
    spark = rows.sparkSession
    own = named = _named(rows)
    # first turns of what is said more than once, by digest; equal rows of one turn are told by their neighbour when sorted
    seen = own.groupBy("conv_id", "role", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.max(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("late"))
    seen = written(seen.where("first <> late").select(F.col("conv_id").alias("of"), F.col("role").alias("by"), "digest", "first"), "repeats")
    few = F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen
    later = F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first")
    own = own.join(few, _same_conv("conv_id", "of") & (F.col("role") == F.col("by")) & (F.unhex(F.sha2("text", 256)) == F.col("digest")), "left")
    own = own.select("conv_id", "turn", "role", "text", F.coalesce(later, F.lit(False)).alias("again"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = written(own.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_cut(texts), _PIECES), "pieces")

    whole = pieces.where("whole").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest")
    open_ = pieces.where("not whole")
    place = ["conv_id", "part", "ord"]
    together = lambda df: df.repartition(parts, "conv_id").sortWithinPartitions(*place)
    chosen = written(together(open_.select(*place, "first", "last", "paths")).mapInArrow(_chain, "conv_id long, part int, ord int, state int, audit string, cost long, between long"), "chosen")
    turns = written(open_.select("part", "ord", "roles", "texts").join(chosen.select(*place, "state", "audit"), ["part", "ord"]).mapInArrow(_edit, "conv_id long, part int, ord int, roles array<string>, texts array<string>"), "turns")
    digest = together(turns).mapInArrow(_digests, "conv_id long, digest string").withColumnRenamed("conv_id", "of_digest")
    counted = open_.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ord", "audit"))), lambda x: x["audit"]), "").alias("audit")
    total = chosen.groupBy(F.col("conv_id").alias("of")).agg(F.sum("cost").alias("cost"), F.sum("between").alias("between"), said)
    cut = counted.join(total, _same_conv("conv_id", "of")).join(digest, _same_conv("conv_id", "of_digest"))
    cut = cut.select("conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("between")).alias("illegal"), "cost", "audit", "digest")

    span = named.groupBy(F.col("conv_id").alias("of")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    report = whole.unionByName(cut).join(span, _same_conv("conv_id", "of"))
    report = report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))
    flat = lambda df: df.select(*place, F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "x")).select(*place, "place", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))
    return {"report": report} | ({"turns": flat(pieces.where("whole")).unionByName(flat(turns))} if texts else {})


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with known faults, by crc32 of `conv_id:turn` (nulls: one space) modulo 20: 0 drops a row, 1 empties its text,
    2 takes `.!?` out of it, 3 repeats it, 4 makes its role user. conv_id, turn, role, text."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = _named(conversations).withColumn("how", F.pmod(F.crc32(key), F.lit(20))).where("how <> 0")
    text = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))))
    return rows.select("conv_id", "turn", "role", "text")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The report on damaged() conversations, one row for every conv_id of the originals."""
    report = repair_conversations(damaged(conversations), texts=False)["report"]
    ids = conversations.select(F.col("conv_id").cast("long").alias("of")).distinct()
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = ids.join(report, _same_conv("conv_id", "of"), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("of").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
