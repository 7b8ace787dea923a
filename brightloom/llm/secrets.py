"""Secret scan with structural confirmation.

Three base patterns report as they match. Beyond them, long runs of base64 or
hex characters are candidates: each is decoded and its structure parsed before
anything is reported.

``pem``  a private-key block whose body decodes to a key encoding below
``der``  ASN.1 whose nested lengths fill the value exactly and whose outline is
         a private key: PKCS#1, PKCS#8 or SEC 1
``ssh``  an OpenSSH key container or key blob made of length-prefixed strings
         that end where the value ends
``jwt``  a signed token: header JSON that names an algorithm, JSON claims

Offsets are code points, the end exclusive. Spans of one kind do not overlap.

Defined cases: a null text counts as empty and has no spans; candidates that
do not decode, or decode to no such structure, are not reported; repeated rows
report alike; a very long text is searched whole; an empty table gives an empty
result; columns other than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of the class; shorter runs fail
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]*)-----END \1PRIVATE KEY-----")
_BODY = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_HEX_BODY = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at ``at``; None if the length is malformed or runs over."""
    if at + 2 > end:
        return None
    tag, size, at = raw[at], raw[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or at + more > end:
            return None
        size, at = int.from_bytes(raw[at : at + more], "big"), at + more
    return (tag, at, at + size) if at + size <= end else None


def _children(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    found = []
    while at < end:
        one = _tlv(raw, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def is_der_key(raw: bytes) -> bool:
    """Whether the bytes are one ASN.1 SEQUENCE laid out as a private key."""
    top = _tlv(raw, 0, len(raw))
    if top is None or top[0] != 0x30 or top[2] != len(raw):
        return False
    parts = _children(raw, top[1], top[2])
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    tags = [p[0] for p in parts]
    if tags[1:3] == [0x30, 0x04]:  # PKCS#8: version, algorithm, key
        inside = _children(raw, parts[1][1], parts[1][2])
        return bool(inside) and inside[0][0] == 0x06
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # PKCS#1: version and eight numbers
        return True
    return len(tags) >= 2 and tags[1] == 0x04 and raw[parts[0][1]] == 1  # SEC 1


#: How many fields a public key of a kind has, its name included.
PUBLIC_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2": 3, b"sk-ssh": 3, b"sk-ecdsa": 4}


def is_ssh_key(raw: bytes) -> bool:
    """Whether the bytes are an OpenSSH container or a private key's fields; a public key has fewer."""
    magic = b"openssh-key-v1\0"
    container = raw.startswith(magic)
    at, fields = len(magic) if container else 0, []
    while at < len(raw):
        if container and len(fields) == 3:
            at += 4  # after cipher, kdf and its options: the number of keys
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return False
        fields.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    if container:
        return len(fields) >= 5
    kind = re.fullmatch(rb"(ssh-rsa|ssh-dss|ssh-ed25519|ecdsa-sha2|sk-ssh|sk-ecdsa)(-[a-z0-9@.-]+)?", fields[0]) if fields else None
    return kind is not None and len(fields) > PUBLIC_FIELDS[kind[1]]


def is_signed_token(text: str) -> bool:
    """Whether the text is header, claims and signature, each in URL-safe base64."""
    parts = text.split(".")
    if len(parts) != 3 or not parts[0] or not parts[1]:
        return False
    try:
        header, claims = (json.loads(decode64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict) and (header["alg"] == "none" or decode64(parts[2]) not in (None, b""))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded structure is a key or a signed token."""
    found = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            raw = decode64("".join(m[2].split()))
            if raw and (is_der_key(raw) or is_ssh_key(raw)):
                found.append(("pem", *m.span()))
    for run in _RUN.finditer(text):
        body = run[0]
        parts, at, last = body.split("."), 0, -1
        for i, part in enumerate(parts):
            # What a "=" separates from the header is not part of it; a later dot ends the signature.
            start = at + part.rfind("=") + 1
            stop = at + sum(map(len, parts[i : i + 3])) + 2
            if start > last and body.startswith("ey", start) and len(parts) >= i + 3 and is_signed_token(body[start:stop]):
                found.append(("jwt", run.start() + start, run.start() + stop))
                last = stop
            at += len(part) + 1
        for m in _BODY.finditer(body):
            raw = decode64(m[0])
            kind = "der" if raw and raw[0] == 0x30 and is_der_key(raw) else "ssh" if raw and is_ssh_key(raw) else ""
            if kind:
                found.append((kind, run.start() + m.start(), run.start() + m.end()))
        for m in _HEX_BODY.finditer(body):
            raw = bytes.fromhex(m[0])
            kind = "der" if is_der_key(raw) else "ssh" if is_ssh_key(raw) else ""
            if kind:
                found.append((kind, run.start() + m.start(), run.start() + m.end()))
    return found


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed."""
    return sorted(set(base_spans(text)) | set(confirmed_spans(text)), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end"), s)) for s in secret_spans(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row, spans as an array of kind, start and end."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("spans", SPANS)]))


def span_list(spans) -> F.Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets in every document."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_number_of(k).alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(F.encode(span_list(base), "UTF-8"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


QUERIES = {"op3_secrets": op3_secrets}
ORACLE_SQL: dict[str, str] = {}
