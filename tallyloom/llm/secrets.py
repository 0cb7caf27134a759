"""Secret scan with structural confirmation.

Base patterns find assignments, access keys and hexadecimal runs.  Candidates
that look like base64, hexadecimal or signed tokens are decoded, and reported
only if their structure holds: a signed token's header and payload are JSON
objects and the header names an algorithm; a key's nested DER lengths fill the
value exactly and it starts as a private key does; an OpenSSH key's length
fields fit; or the decoded text holds a base match itself.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import kind_of

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "encoded")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]*)-----END \1-----")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{24,}|[A-Za-z0-9_-]{24,})={0,2}")
_ANYHEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")

_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def unbase64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding."""
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill data exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n]), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8, SEC 1 or encrypted PKCS#8 in DER, or an OpenSSH key."""
    magic = b"openssh-key-v1\x00"
    if data.startswith(magic):
        at = len(magic)
        for _ in range(3):  # cipher, key derivation, its options
            size = int.from_bytes(data[at : at + 4])
            at += 4 + size
            if at > len(data):
                return False
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4]) <= 16
    whole = der_items(data)
    if not whole or len(whole) != 1 or whole[0][0] != 0x30:
        return False
    parts = der_items(whole[0][1])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _ in parts]
    if tags[:2] == [0x30, 0x04] and len(parts) == 2:  # encrypted
        inner = der_items(parts[0][1])
        return bool(inner) and inner[0][0] == 0x06
    if tags[0] != 0x02 or parts[0][1] not in (b"\x00", b"\x01"):
        return False
    if all(t == 0x02 for t in tags):
        return len(parts) >= 6 and all(c for _, c in parts)
    if tags[1] == 0x04:
        return 16 <= len(parts[1][1]) <= 66
    if tags[1:3] != [0x30, 0x04] or not (kind := der_items(parts[1][1])) or kind[0][0] != 0x06:
        return False
    # PKCS#8: the octets hold a key of their own, or its bare octets
    inner = der_items(parts[2][1])
    if not inner or len(inner) != 1:
        return False
    return inner[0][0] in (0x02, 0x04) and len(inner[0][1]) >= 16 or is_private_key(parts[2][1])


def is_signed_token(text: str) -> bool:
    head, body, *_ = text.split(".")
    for part, key in ((head, "alg"), (body, None)):
        raw = unbase64(part)
        try:
            value = json.loads(raw) if raw is not None else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or key and not isinstance(value.get(key), str):
            return False
    return True


def _holds_base(data: bytes) -> bool:
    try:
        text = data.decode("ascii")
    except UnicodeDecodeError:
        return False
    return text.isprintable() and any(kind != "hex" for kind, _, _ in base_spans(text))


def confirmed_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _JWT.finditer(text):
        if is_signed_token(m[0]):
            yield "jwt", m.start(), m.end()
    for m in _PEM.finditer(text):
        data = unbase64(re.sub(r"\\[nr]|[\s\\]", "", m[2]))
        if data and is_private_key(data):
            yield "pem", m.start(), m.end()
    for pattern, decode in ((_B64, unbase64), (_ANYHEX, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            data = decode(m[0])
            if data and is_private_key(data):
                yield "der", m.start(), m.end()
            elif data and _holds_base(data):
                yield "encoded", m.start(), m.end()


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed; positions in code points."""
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted({*base_spans(text), *confirmed_spans(text)}, key=lambda s: (s[1], rank[s[0]], s[2]))


def _worth(texts: list[bytes]) -> np.ndarray:
    """Which texts may hold a span: a name of an assignment, 20 bytes of one
    word, the start of a signed token or a PEM header.  Every span has one."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    inside = _RUN[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(first, start[end - start >= 20], "right") - 1] = True
    for i in np.flatnonzero(~out):
        low = texts[i].lower()
        out[i] = any(n in low for n in _NAMES) or b"eyJ" in texts[i] or b"-----BEGIN" in texts[i]
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
    found = [spans(t.decode("utf-8", "replace")) if go else [] for t, go in zip(texts, _worth(texts), strict=True)]
    return {"doc_id": batch.column("doc_id"), "spans": pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found], pa.list_(_SPAN))}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans: array of kind, start, end) for each row of docs.

    Null or empty text: no spans.  Rows with a null doc_id and repeated rows
    give a row each; an empty table gives none.  An id may be of any type.  Spans
    of several kinds that start together are listed by kind.  Other columns are
    not read.  Texts are read whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(kernel.over_texts(_scan, schema), f"doc_id {kind_of(rows, 'doc_id')}, spans array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame, base: tuple[str, ...] = BASE_KINDS, spans: str = "spans") -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and all spans as text."""
    listed = ", ".join(f"'{k}'" for k in base)
    shown = lambda x: f"array_join(transform({x}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    own = f"filter({spans}, s -> s.kind IN ({listed}))"
    return found.select("doc_id", *[F.expr(f"CAST(size(filter({spans}, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}") for k in base], F.expr(f"sha2({shown(own)}, 256) AS base_sha256"), F.expr(f"{shown(spans)} AS spans"))
