"""Secret scans whose candidates are confirmed by their structure.

Three plain patterns report every match (assign, access, hex). Beyond them, base64 (of either alphabet) and hex runs are
decoded and reported only if what they hold parses as a secret: private keys in DER, plain or encrypted, whose nested
lengths fit exactly, OpenSSH's private container, PEM blocks around either, and signed tokens whose header is JSON that
names an algorithm. Public keys parse too, but are no secret. Runs begin as such keys must, and no such key is shorter
than 28 characters of base64 or 42 of hex; a run broken into lines is read inside PEM only.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Span kinds in the order that breaks ties on the start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEY_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{40,}(?![0-9A-Fa-f])")
_RUNS = (re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{26,}={0,2}"), re.compile(r"(?<![A-Za-z0-9_-])(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9_-]{26,}={0,2}"))
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
_HEADED = re.compile(r"\s*Proc-Type: 4,ENCRYPTED\s+DEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]+)\s+([A-Za-z0-9+/=\s]+)")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_OPENSSH = b"openssh-key-v1\0"


#: Levels of nested lengths that are read; keys have half as many at most.
DEPTH = 32


def _elements(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill data exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        body = data[at : at + length]
        if tag & 0x20 and (depth >= DEPTH or _elements(body, depth + 1) is None):
            return None
        out.append((tag, body))
        at += length
    return out


def _names_algorithm(body: bytes) -> bool:
    first = _elements(body)
    return bool(first) and first[0][0] == 0x06


def is_der_key(data: bytes) -> bool:
    """A private key: one SEQUENCE with nested lengths that fit, as PKCS#1, DSA, SEC1 or PKCS#8 have it, the latter
    encrypted or not, or a PKCS#12 store."""
    outer = _elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = _elements(outer[0][1]) or []
    tags, first = [t for t, _ in inner], inner[0][1] if inner else b""
    if tags[:9] == [0x02] * 9 and first in (b"\0", b"\1") or tags == [0x02] * 6 and first == b"\0":
        return True
    if tags[:2] == [0x02, 0x04] and first == b"\1":
        return True
    if tags[:3] == [0x02, 0x30, 0x04] and first in (b"\0", b"\1") or tags[:2] == [0x02, 0x30] and first == b"\3":
        return _names_algorithm(inner[1][1])
    return tags == [0x30, 0x04] and len(inner[1][1]) >= 8 and _names_algorithm(first)


def _fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that fill data exactly, or None."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's private container: cipher, key derivation, as many public keys as it says, each of fields that fill it,
    and a private part of whole cipher blocks, which opens with a number twice where it is not encrypted."""
    if not data.startswith(_OPENSSH):
        return False
    at, head = len(_OPENSSH), []

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    for _ in range(3):
        head.append(field())
    if None in head or not re.fullmatch(rb"[a-z0-9@.-]+", head[0]) or not re.fullmatch(rb"[a-z0-9]+", head[1]):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= len(data):
        return False
    for _ in range(keys):
        public = field()
        fields = _fields(public) if public else None
        if not fields or len(fields) < 2 or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]):
            return False
    private = field()
    if not private or len(private) % 8 or len(data) - at not in (0, 16):  # some ciphers add a tag of 16 bytes
        return False
    return head[0] != b"none" or private[:4] == private[4:8]


def is_headed_key(body: str) -> bool:
    """An encrypted key of the old form: headers that name a cipher and its start value, and whole cipher blocks."""
    m = _HEADED.fullmatch(body)
    data = _decoded("".join(m[3].split())) if m else None
    if not data:
        return False
    block = 8 if m[1].startswith("DES") else 16
    return len(m[2]) == 2 * block and len(data) % block == 0


_ALPHABET = str.maketrans("-_", "+/")


def _decoded(text: str) -> bytes | None:
    text = text.rstrip("=").translate(_ALPHABET)
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_token(header: str) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as KINDS lists them."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for m in _KEY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append(("der", *m.span()))
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            data = _decoded("".join(m[2].split()))
            if is_headed_key(m[2]) or data and (is_der_key(data) or is_ssh_key(data)):
                found.append(("pem", *m.span()))
    seen = set()
    for runs in _RUNS:
        for m in runs.finditer(text):
            data = None if m.span() in seen else _decoded(m[0])
            if data and (is_der_key(data) or is_ssh_key(data)):
                seen.add(m.span())
                found.append(("der" if data[0] == 0x30 else "ssh", *m.span()))
    if "." in text and "ey" in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if _is_token(m[1])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every row.

    Null and empty texts have no span; repeated rows come back each; a null id stays null; an empty table gives none.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(stream):
        for batch in stream:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span replaced by mark, overlapping spans by one."""
    out, at = [], 0
    for _, start, end in spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets of text_col replaced; null texts stay null, other columns and rows as they are."""
    schema, place = docs.schema, docs.columns.index(text_col)

    def run(stream):
        for batch in stream:
            texts = pa.array([None if t is None else redacted(t, mark) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, schema)
