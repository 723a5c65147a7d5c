"""Secret scan with structural confirmation.

Base kinds, leftmost non-overlapping each: `assign` (a named assignment of 12 or
more characters), `access` (AKIA and more, 18 or more in all), `hex` (16 or more
lower-case hex digits). Structural kinds are reported only when their bytes parse:

- `der`: base64 or hex whose bytes are one ASN.1 SEQUENCE that holds nested
  elements whose lengths fit exactly, and starts like a private key (an INTEGER
  version, or an algorithm SEQUENCE with an OBJECT IDENTIFIER and encrypted bytes);
- `der_public`: likewise, but a public key (an algorithm and a BIT STRING, or two INTEGERs);
- `ssh`: base64 of an openssh-key-v1 header, its fields and one key, whose lengths
  consume the bytes;
- `ssh_public`: base64 of length-prefixed fields whose first names a known key type
  and whose lengths consume the bytes;
- `token`: three base64url parts joined by dots whose first is a JSON object
  with a string `alg`, the second a JSON object, the third not shorter than the
  signature length that `alg` names.

Public keys are no secrets; their kinds tell them apart. No key has fewer than 30
bytes or more than MOST_PARTS elements. Base64 of keys may stand in lines (as in
PEM): its characters are read on over single line ends, written-out ones (\\n) and
spaces, as many as the lengths inside it claim. Hex is read within one line only.

Every pass is linear in the text, whatever it claims: a run of base64 is joined
once and decoded at most four times (once for each place in a group of four), all
keys that may begin inside it share these bytes, and a claimed structure is
followed from length to length, at most MOST_PARTS of them, without reading what
lies between.

Spans are code points, end exclusive. Structural spans are added and never
replace base ones.

Defined results: null or empty text has no spans; null doc_id is kept; rows that
repeat are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespan.llm._store import pieces

KINDS = ("assign", "access", "hex", "der", "ssh", "token", "der_public", "ssh_public")
_RANK = {k: i for i, k in enumerate(KINDS)}
_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ANYHEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{48,}|[0-9A-F]{48,})(?![0-9A-Za-z])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/_=-])")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{40}")
#: Where base64 of a SEQUENCE, an SSH public key or an openssh-key-v1 header can begin, its characters, and what may stand between and behind them.
_START = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=-----))(?:M[A-I]|AAAA[BCE]|b3BlbnNzaC1rZXktdjE)")
_CHARS = re.compile(r"[A-Za-z0-9+/_-]+")
_GAP = re.compile(r"[ \t]*(?:\r\n|\n|\r|(?:\\r)?\\n)[ \t]*|[ \t]")
_STOP = re.compile(r"={0,2}(?:(?=----)|(?![A-Za-z0-9+/_=-]))")
_DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")
_HEAD = re.compile(r"eyJ[A-Za-z0-9_-]{6,}")

# Names and sizes of the public key and token formats.
_MAGIC = b"openssh-key-v1\0"
_SSH = {b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521"}
_SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}
#: RSAPrivateKey has the most elements: nine, and one for further primes.
MOST_PARTS = 10
_SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "RS256": 128, "RS384": 128, "RS512": 128, "PS256": 128, "PS384": 128, "PS512": 128, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}


def _b64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the DER element at `at`, in definite shortest form and inside `end`."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        at += k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def der_kind(data: bytes, at: int = 0, end: int | None = None) -> str | None:
    """der, der_public, or None for bytes (those of data from at to end) that are no key."""
    end = len(data) if end is None else end
    top = _element(data, at, end)
    if top is None or top[0] != 0x30 or top[2] != end:
        return None
    kids, at = [], top[1]
    while at < end:
        if len(kids) == MOST_PARTS or (e := _element(data, at, end)) is None:
            return None
        kids.append(e)
        at = e[2]
    if len(kids) < 2:
        return None

    def algorithm(e):
        inner = _element(data, e[1], e[2]) if e[0] == 0x30 else None
        return inner is not None and inner[0] == 0x06 and inner[2] > inner[1]

    if kids[0][0] == 0x02:
        version = kids[0][2] - kids[0][1] == 1 and data[kids[0][1]] <= 1
        if not version:
            return "der_public" if len(kids) == 2 and kids[1][0] == 0x02 else None  # modulus and exponent
        return "der" if algorithm(kids[1]) or all(k[0] == 0x02 for k in kids) and len(kids) >= 6 or kids[1][0] == 0x04 else None
    if algorithm(kids[0]):
        return {0x03: "der_public", 0x04: "der"}.get(kids[1][0])
    return None


def _field(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Where the length-prefixed field at `at` begins and ends, inside `end`."""
    if at + 4 > end:
        return None
    stop = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (at + 4, stop) if stop <= end else None


def _name(data: bytes, at: tuple[int, int]) -> bytes:
    """A field that is a name; the formats' names are short."""
    return data[at[0] : min(at[1], at[0] + 64)]


def _openssh_end(data: bytes, at: int, end: int) -> int | None:
    """Where an openssh-key-v1 structure ends: cipher, key derivation and its options, one key, the public key (itself
    length-prefixed fields, the first a known type), the private part, and the tag of ciphers that have one."""
    at, fields = at + len(_MAGIC), []
    for i in range(6):
        if i == 3:  # the number of keys, not a length
            if data[at : at + 4] != b"\0\0\0\1" or at + 4 > end:
                return None
            at += 4
            continue
        if (f := _field(data, at, end)) is None:
            return None
        fields.append(f)
        at = f[1]
    cipher, public, private = _name(data, fields[0]), fields[3], fields[4]
    at += 16 * (b"gcm" in cipher or b"poly1305" in cipher)
    known = cipher and private[1] > private[0] and ssh_kind(data, *public) == "ssh_public"
    return at if known and at <= end else None


def ssh_kind(data: bytes, at: int = 0, end: int | None = None) -> str | None:
    """ssh, ssh_public, or None for bytes (those of data from at to end) that are no key."""
    end = len(data) if end is None else end
    if data.startswith(_MAGIC, at, end):
        return "ssh" if _openssh_end(data, at, end) == end else None
    fields: list[tuple[int, int]] = []
    while at + 4 <= end:
        if len(fields) == MOST_PARTS or (f := _field(data, at, end)) is None:
            return None
        fields.append(f)
        at = f[1]
    return "ssh_public" if at == end and len(fields) >= 2 and _name(data, fields[0]) in _SSH else None


class _Run:
    """Base64 from one character of a text on, as far as it goes over gaps. Keys that may begin anywhere inside share it."""

    def __init__(self, text: str, at: int):
        parts: list[str] = []
        self.clean, self.where, self.n, self.end = [], [], 0, at
        while True:
            at = self.end
            if parts and (gap := _GAP.match(text, at)):
                at = gap.end()
            if (m := _CHARS.match(text, at)) is None:
                break
            parts.append(m[0])
            self.clean.append(self.n)
            self.where.append(at)
            self.n += len(m[0])
            self.end = m.end()
        self.chars = "".join(parts).replace("-", "+").replace("_", "/")
        self.decoded: dict[int, bytes] = {}

    def bytes_from(self, at: int) -> tuple[bytes, int, int]:
        """For a character of the text: the run's bytes in its phase, its place in them, and its number in the run."""
        i = bisect.bisect_right(self.where, at) - 1
        c = self.clean[i] + at - self.where[i]
        if (data := self.decoded.get(c % 4)) is None:
            own = self.chars[c % 4 :]
            own = own[: len(own) - (len(own) % 4 == 1)]
            data = self.decoded[c % 4] = base64.b64decode(own + "=" * (-len(own) % 4))
        return data, c // 4 * 3, c

    def behind(self, c: int) -> int:
        """The place in the text behind the run's first c characters."""
        i = bisect.bisect_left(self.clean, c) - 1
        return self.where[i] + c - self.clean[i]


def _der_end(data: bytes, at: int) -> int | None:
    """Where the SEQUENCE claims to end, when what it holds first is an INTEGER or a SEQUENCE."""
    head = data[at : at + 8]
    if len(head) < 8 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 4 or head[2 + k] not in (0x02, 0x30):
        return None
    return at + 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])


def _ssh_end(data: bytes, at: int) -> int | None:
    """Where the fields that the key type or the openssh-key-v1 header calls for end."""
    if data.startswith(_MAGIC, at):
        return _openssh_end(data, at, len(data))
    left = None
    while left != 0:
        if (f := _field(data, at, len(data))) is None:
            return None
        left = _SSH_FIELDS.get(_name(data, f), 1) - 1 if left is None else left - 1
        at = f[1]
    return at


def wrapped_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64 whose characters may be broken into lines; none begins inside another."""
    out, behind, run = [], 0, None
    for m in _START.finditer(text):
        if m.start() < behind:
            continue
        if run is None or m.start() >= run.end:
            run = _Run(text, m.start())
        data, at, c = run.bytes_from(m.start())
        ends, kind_of = (_der_end, der_kind) if m[0][0] == "M" else (_ssh_end, ssh_kind)
        end = ends(data, at)
        if end is None or end - at < 30 or end > len(data):
            continue
        if kind := kind_of(data, at, end):
            at_end = run.behind(c - (-(end - at) * 4 // 3))
            if stop := _STOP.match(text, at_end):
                behind = stop.end()
                out.append((m.start(), behind, kind))
    return out


def is_signed_token(s: str) -> bool:
    head, body, sign = (_b64(x) for x in s.split("."))
    if head is None or body is None or sign is None:
        return False
    try:
        h, b = json.loads(head), json.loads(body)
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(b, dict) and isinstance(h.get("alg"), str) and len(sign) >= _SIGNATURE_BYTES.get(h["alg"], 1 << 30)


def token_spans(text: str) -> list[tuple[int, int, str]]:
    """Three parts joined by dots, from the leftmost place of a part where a JSON object can begin; none begins inside another."""
    out = []
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") < 2:
            continue
        parts, at, i = chain[0].split("."), chain.start(), 0
        while i + 2 < len(parts):
            used = 1
            if m := _HEAD.search(parts[i]):
                used, token = 3, f"{parts[i][m.start() :]}.{parts[i + 1]}.{parts[i + 2]}"
                if is_signed_token(token):
                    out.append((at + m.start(), at + m.start() + len(token), "token"))
            at += sum(len(x) + 1 for x in parts[i : i + used])
            i += used
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _WORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = wrapped_spans(text)
    inside, k = list(out), 0  # in the text's order, none inside another
    if _LONG.search(text):
        for m in _ANYHEX.finditer(text):
            if len(m[0]) % 2 == 0 and (kind := der_kind(bytes.fromhex(m[0]))):
                out.append((m.start(), m.end(), kind))
        for m in _BASE64.finditer(text):
            while k < len(inside) and inside[k][1] <= m.start():
                k += 1
            if k < len(inside) and inside[k][0] < m.end():
                continue
            if (data := _b64(m[0])) is not None and (kind := der_kind(data) or ssh_kind(data)):
                out.append((m.start(), m.end(), kind))
    if "eyJ" in text:
        out += token_spans(text)
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], _RANK[x[2]], x[1])))


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def _scan(batches):
    for b in pieces(batches):
        cols = [[] for _ in range(7)]
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            text = text or ""
            base, more = base_spans(text), confirmed_spans(text)
            kinds = [k for _, _, k in base]
            row = (doc, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed. One pass, no exchange."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _OUT)
