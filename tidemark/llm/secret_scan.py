"""Secret scans with structural confirmation (operator 11).

Base patterns find assignments of secrets, access key ids and long hex strings. Beyond them, what looks like base64
(either alphabet) or hex is decoded and only reported if the bytes are what a secret would be:

- `key`: a private key, armoured or bare. DER is parsed by nested tags and lengths, each of which must end where
  its parent does: RSA (PKCS #1), EC (SEC 1), DSA, PKCS #8 with the algorithm's own key inside, and
  encrypted PKCS #8; the OpenSSH form by its nested length-prefixed strings. Public keys and certificates
  are no secrets.
- `signed`: a signed token of three base64url parts: a JSON header that names an algorithm, a JSON object of
  claims, and a signature (empty only for the algorithm "none").

Runs of candidate characters are found by byte class over a piece of texts at once; only runs long enough are
decoded. A candidate inside an armoured key, or of a signed token, is not reported again.

Defined results: a null text is empty; a null doc_id stays null; rows are judged one by one, so rows that
repeat a doc_id or a text get results of their own; spans that start together are ordered by kind as in
`KINDS`, then by end; spans of different kinds may overlap; an empty table gives no rows; other columns are ignored. A
text is handled whole in one task, whatever its length. There is no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import textkit as tk

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "signed")

#: Over text whose A-Z are lower-cased, which keeps all places.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

BEGIN = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
TOKEN = re.compile(rb"([A-Za-z0-9_-]{16,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
FILLER = re.compile(rb"\\[nr]|[\s\"',+]+(?=[\r\n])|\s+")
RUN_LEAST, KEY_LEAST = 16, 40  # characters of a token's header and of a bare key


def _class(text: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text)] = True
    return out


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
B64, LOWER_HEX, ANY_HEX = _class(_LETTERS + b"+/_-"), _class(b"0123456789abcdef"), _class(b"0123456789abcdefABCDEF")

SEQUENCE, INTEGER, OCTETS, BITS, OID = 0x30, 0x02, 0x04, 0x03, 0x06


def elements(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, stop) of the DER elements that fill data[at:end] exactly, else None."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > end:
                return None
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _inside(data: bytes, element: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    return elements(data, element[1], element[2]) or []


def _small(data: bytes, element: tuple[int, int, int]) -> int:
    """A whole number of one byte, else -1."""
    return data[element[1]] if element[0] == INTEGER and element[2] - element[1] == 1 else -1


def private_key(data: bytes) -> str | None:
    """The kind of private key that DER bytes are, whole and nothing else."""
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return None
    parts = _inside(data, outer[0])
    tags = [t for t, _, _ in parts]
    if len(parts) < 2:
        return None
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS #8: a scheme with parameters, and the sealed key
        scheme = [t for t, _, _ in _inside(data, parts[0])]
        return "encrypted" if scheme == [OID, SEQUENCE] and parts[1][2] - parts[1][1] >= 16 else None
    version = _small(data, parts[0])
    if tags[:9] == [INTEGER] * 9 and version in (0, 1) and tags[9:] in ([], [SEQUENCE]):
        modulus, primes = parts[1][2] - parts[1][1], parts[4][2] - parts[4][1] + parts[5][2] - parts[5][1]
        return "rsa" if modulus >= 32 and (version == 1 or abs(primes - modulus) <= 2) else None
    if tags == [INTEGER] * 6 and version == 0:
        return "dsa" if parts[1][2] - parts[1][1] >= 32 else None
    if version == 1 and tags[1] == OCTETS and set(tags[2:]) <= {0xA0, 0xA1} and 16 <= parts[1][2] - parts[1][1] <= 66:
        named = all([t for t, _, _ in _inside(data, x)] in ([OID], [SEQUENCE]) if x[0] == 0xA0 else [t for t, _, _ in _inside(data, x)] == [BITS] for x in parts[2:])
        return "ec" if named else None
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        algorithm = _inside(data, parts[1])
        if not algorithm or algorithm[0][0] != OID:
            return None
        inner = data[parts[2][1] : parts[2][2]]
        held = elements(inner)
        own = private_key(inner) or ("raw" if held and len(held) == 1 and held[0][0] in (OCTETS, INTEGER) and len(inner) >= 18 else None)
        return f"pkcs8-{own}" if own else None
    return None


OPENSSH = b"openssh-key-v1\0"


def openssh_key(data: bytes) -> bool:
    """Whether bytes are a private key of the OpenSSH form: nested strings, each after its length."""
    at = len(OPENSSH)
    if not data.startswith(OPENSSH):
        return False

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = string(), string(), string()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return False
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= n <= 16 or any(not string() for _ in range(n)):
        return False
    sealed = string()
    return bool(sealed) and len(sealed) % 8 == 0 and at == len(data)


def decoded(text: bytes) -> bytes | None:
    """The bytes of base64 of either alphabet, with or without padding; None if it is none."""
    text = text.rstrip(b"=")
    if len(text) % 4 == 1 or (b"-" in text or b"_" in text) and (b"+" in text or b"/" in text):
        return None
    try:
        return base64.b64decode(text.translate(bytes.maketrans(b"-_", b"+/")) + b"=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(data: bytes | None) -> bool:
    return bool(data) and (private_key(data) is not None or openssh_key(data))


def armoured(body: bytes) -> bool:
    """Whether what stands between the armour lines of a private key is one."""
    sealed = b"DEK-Info:" in body
    if sealed:
        body = body[body.index(b"DEK-Info:") :].partition(b"\n")[2]
    data = decoded(FILLER.sub(b"", body))
    return is_key(data) or sealed and bool(data) and len(data) % 8 == 0


def _json(text: bytes) -> dict | None:
    data = decoded(text)
    if not data or data.lstrip()[:1] != b"{":
        return None
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(header: bytes, claims: bytes, signature: bytes) -> bool:
    head = _json(header)
    if head is None or not isinstance(head.get("alg"), str) or not head["alg"] or _json(claims) is None:
        return False
    return bool(decoded(signature)) if head["alg"].lower() != "none" else decoded(signature) is not None


def _stretches(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of longest stretches of a byte class, at least so long; none crosses texts."""
    held = kind[data]
    edge = np.zeros(len(data) + 1, bool)  # before a byte outside, or between texts
    edge[1:-1] = ~(held[1:] & held[:-1])
    edge[offs] = True
    begin, end = np.flatnonzero(held & edge[:-1]), np.flatnonzero(held & edge[1:]) + 1
    ok = end - begin >= least
    return begin[ok], end[ok]


def found_in(p: tk.Piece) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, kind, end) in bytes, of all kinds, in order."""
    raw, offs = p.data.tobytes(), p.offs.tolist()
    low = tk.LOWER[p.data].tobytes()
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(p))]

    def text_of(at) -> list[int]:
        return (np.searchsorted(p.offs, at, side="right") - 1).tolist()

    a, b = _stretches(p.data, p.offs, LOWER_HEX, HEX_LEAST)
    for d, x, y in zip(text_of(a), a.tolist(), b.tolist()):
        out[d].append((x, 2, y))
    a, b = _stretches(p.data, p.offs, B64, RUN_LEAST)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(len(p))]
    for d, x, y in zip(text_of(a), a.tolist(), b.tolist()):
        runs[d].append((x, y))
    for d, (lo, hi) in enumerate(zip(offs[:-1], offs[1:])):
        out[d] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low, lo, hi) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
        out[d] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw, lo, hi) if m.end() - m.start() >= ACCESS_LEAST]
        if runs[d]:
            out[d] += confirmed(raw, lo, hi, runs[d])
        out[d].sort()
    return out


def confirmed(raw: bytes, lo: int, hi: int, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Keys and signed tokens of the text raw[lo:hi], from its stretches of base64 characters."""
    out, done = [], lo
    at = lo
    while (m := BEGIN.search(raw, at, hi)) is not None:  # armour first: what is in it is no candidate
        at = m.end()
        last = b"-----END " + m.group(1) + b"PRIVATE KEY-----"
        end = raw.find(last, m.end(), hi)
        if end >= 0 and armoured(raw[m.end() : end]):
            at = end + len(last)
            out.append((m.start(), 3, at))
    fenced, k = out[:], 0
    for a, b in runs:
        while k < len(fenced) and fenced[k][2] <= a:
            k += 1
        if a < done or k < len(fenced) and fenced[k][0] <= a:
            continue
        begin = max(raw.rfind(b"/", a, b), raw.rfind(b"+", a, b), a - 1) + 1  # a path may lead to a token
        if b < hi and raw[b] == 46 and (t := TOKEN.match(raw, begin, hi)) and signed_token(*t.groups()):
            out.append((begin, 4, t.end()))
            done = t.end()
        elif b - a >= KEY_LEAST:
            hexed = (b - a) % 2 == 0 and ANY_HEX[np.frombuffer(raw, np.uint8, b - a, a)].all()
            if (raw[a] == 77 or raw[a : a + 4] == b"b3Bl") and is_key(decoded(raw[a:b])):
                stop = b + len(raw[b : min(b + 2, hi)]) - len(raw[b : min(b + 2, hi)].lstrip(b"="))
                out.append((a, 3, stop))
            elif hexed and raw[a : a + 2] in (b"30", b"6f", b"6F") and is_key(bytes.fromhex(raw[a:b].decode())):
                out.append((a, 3, b))
    return out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_key long, n_signed long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def measure(p: tk.Piece) -> list[tuple]:
    """Rows of `SCHEMA` for the texts of a piece whose first column is doc_id."""
    points = np.zeros(len(p.data) + 1, np.int64)
    np.cumsum((p.data & 0xC0) != 0x80, out=points[1:])
    rows = []
    empty = hashlib.sha256(b"").hexdigest()
    for key, begin, spans in zip(p.rows.column(0).to_pylist(), p.offs[:-1].tolist(), found_in(p)):
        if not spans:
            rows.append((key, 0, 0, 0, empty, "", 0, 0))
            continue
        first = points[begin]
        said = [f"{KINDS[k]}:{points[a] - first}:{points[b] - first}" for a, k, b in spans]
        n = [sum(k == x for _, k, _ in spans) for x in range(len(KINDS))]
        base = ",".join(s for s, (_, k, _) in zip(said, spans) if k < len(BASE))
        rows.append((key, *n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), *n[3:]))
    return rows


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row of `SCHEMA` for each row of `docs` (doc_id, text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
        for batch in batches:
            for p in tk.pieces(batch):
                rows = measure(p)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], NAMES)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
