"""Chat formatting by columnar byte assembly.

Each turn becomes header + escaped text + footer. A batch is assembled at once:
segment lengths, cumulative offsets and scatter indices are numpy arrays, and all
headers, texts and footers are copied into one buffer that becomes the Arrow
column. Inside texts (and role names) `\\`, `<`, `[` and `]` get a `\\` before
them, so no text can hold a control string, and unescaping is exact.

Template: user `[INST] text [/INST]`, assistant ` text </s>`, system
`<<SYS>>\\ntext\\n<</SYS>>\\n`, any other role `[ROLE name] text [/ROLE]`, no role
`[ROLE] text [/ROLE]`.

A conversation is cut into segments of turns, so a conversation of any length is
formatted by many tasks; its text is its segments in order. Loss spans are byte
ranges of the segment that hold assistant text, escaped, and nothing else.

Defined results: null text and null role are empty; rows follow turn (null
first), then role and text; rows that repeat are turns of their own; conv_id null
is a conversation; an empty table gives no rows; other columns are ignored. A text
whose escaped form passes 2 GiB (the limit of a string column) fails.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespan.llm._store import pieces, written

SEGMENT_TURNS = 128
PARTS = {"user": (b"[INST] ", b" [/INST]"), "assistant": (b" ", b" </s>"), "system": (b"<<SYS>>\n", b"\n<</SYS>>\n")}
_C = r"((?:[^\\<\[\]]+|\\.)*)"
_TURN = re.compile(rf"\[INST\] {_C} \[/INST\]|<<SYS>>\n{_C}\n<</SYS>>\n|\[ROLE(?: {_C})?\] {_C} \[/ROLE\]| {_C} </s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def parts_of(role: str | None) -> tuple[bytes, bytes]:
    if role in PARTS:
        return PARTS[role]
    return b"[ROLE" + (b" " + escape(role).encode() if role is not None else b"") + b"] ", b" [/ROLE]"


def escape(text: str) -> str:
    return re.sub(r"([\\<\[\]])", r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_LONG = 1 << 16
_SLICE = 1 << 20


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """out[to[i] : to[i] + size[i]] = data[start[i] : start[i] + size[i]] for all i: indexed copies of about _SLICE bytes each, so
    the index arrays stay small; long segments are copied as they are."""
    for i in np.flatnonzero(size > _LONG).tolist():
        out[to[i] : to[i] + size[i]] = data[start[i] : start[i] + size[i]]
    short = np.flatnonzero((size > 0) & (size <= _LONG))
    part = np.cumsum(size[short]) // _SLICE
    for own in np.split(short, np.flatnonzero(np.diff(part)) + 1):
        n = size[own]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[within + np.repeat(to[own], n)] = data[within + np.repeat(start[own], n)]


def assemble(roles: list[str | None], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, each turn's offset in them (one more at the end), and each text's start and end."""
    safe = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"([\\<\[\]])", r"\\\1")
    bufs = safe.buffers()
    off = np.frombuffer(bufs[1], np.int64)[safe.offset : safe.offset + len(safe) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    kinds = list(dict.fromkeys(roles))
    kind = np.array([kinds.index(r) for r in roles], np.int64)
    marks = [x for r in kinds for x in parts_of(r)]
    mark_size = np.array([len(x) for x in marks], np.int64)
    mark_at = np.cumsum(mark_size) - mark_size
    mark_data = np.frombuffer(b"".join(marks), np.uint8)
    head, text, foot = mark_size[2 * kind], np.diff(off), mark_size[2 * kind + 1]
    turn = np.zeros(len(roles) + 1, np.int64)
    np.cumsum(head + text + foot, out=turn[1:])
    out = np.empty(turn[-1], np.uint8)
    _scatter(out, turn[:-1], mark_data, mark_at[2 * kind], head)
    _scatter(out, turn[:-1] + head, data, off[:-1], text)
    _scatter(out, turn[1:] - foot, mark_data, mark_at[2 * kind + 1], foot)
    return out, turn, turn[:-1] + head, turn[:-1] + head + text


_SEGMENTS = "conv_id long, block long, part int, formatted string, loss array<struct<start:int,end:int>>"


def _format(batches):
    seen: tuple = ()
    part = 0
    for b in pieces(batches):
        n = b.num_rows
        conv, block, roles = b.column("conv_id").to_pylist(), b.column("block").to_pylist(), b.column("role").to_pylist()
        out, turn, start, end = assemble(roles, b.column("text"))
        first = [i for i in range(n) if i == 0 or conv[i] != conv[i - 1] or block[i] != block[i - 1]]
        bounds = np.array([*first, n])
        no = []
        for i in first:
            part = part + 1 if (conv[i], block[i]) == seen else 0
            seen = (conv[i], block[i])
            no.append(part)
        is_loss = np.array([r == "assistant" for r in roles])
        at = np.flatnonzero(is_loss & (end > start))
        seg = np.searchsorted(bounds, at, "right") - 1
        base = turn[bounds[:-1]][seg]
        spans = pa.StructArray.from_arrays([pa.array((start[at] - base).astype(np.int32)), pa.array((end[at] - base).astype(np.int32))], ["start", "end"])
        offsets = np.searchsorted(seg, np.arange(len(first) + 1)).astype(np.int32)
        if len(out) >= 1 << 31:
            raise ValueError("a formatted text of 2 GiB or more is no string column's value")
        # the buffer itself becomes the column: nothing is copied again
        text = pa.StringArray.from_buffers(len(first), pa.py_buffer(turn[bounds].astype(np.int32)), pa.py_buffer(out))
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv[i] for i in first], pa.int64()), pa.array([block[i] for i in first], pa.int64()), pa.array(no, pa.int32()), text, pa.ListArray.from_arrays(pa.array(offsets), spans)],
            ["conv_id", "block", "part", "formatted", "loss"],
        )


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, block, part, formatted, loss: the segments, to be read in the order of block and part."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    ).withColumn("block", F.expr(f"coalesce(floor(turn / {SEGMENT_TURNS}), -9223372036854775807)").cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text").mapInArrow(_format, _SEGMENTS)


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """(role, text) of every turn; raises if anything is left over."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}: {formatted[at : at + 40]!r}")
        user, system, name, other, assistant = m.groups()
        if user is not None:
            out.append(("user", unescape(user)))
        elif system is not None:
            out.append(("system", unescape(system)))
        elif other is not None:
            out.append((None if name is None else unescape(name), unescape(other)))
        else:
            out.append(("assistant", unescape(assistant)))
        at = m.end()
    return out


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    state = None
    for b in pieces(batches, "formatted"):
        done = []
        for conv, formatted, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[1] += 1
                state[2].update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
            raw = formatted.encode("utf-8", "surrogatepass")
            for s in loss:
                x = unescape(raw[s["start"] : s["end"]].decode("utf-8", "surrogatepass"))
                state[3] += len(x)
                state[4].update(x.encode("utf-8", "surrogatepass"))
            state[5] += len(formatted)
        if done:
            yield _digests(done)
    if state is not None:
        yield _digests([state])


def _digests(rows):
    cols = list(zip(*[(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in rows], strict=True))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _DIGEST.split(", ")])


def chat_digests(conversations: DataFrame) -> DataFrame:
    """What the formatted segments say, read back. A digest over a conversation is sequential: its segments stream through
    one task in order, one batch in memory at a time."""
    seg = written(format_chat(conversations), "segments")
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seg.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(_read_back, _DIGEST)
