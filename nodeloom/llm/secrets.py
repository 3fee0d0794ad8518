"""Operator 7, secret scans: an Aho-Corasick keyword prefilter, anchored expressions at its hits, embedded checksums.

Keywords are found in one automaton pass over the ASCII-lower-cased bytes. An
expression is tried at a keyword's place only. Kinds with a checksum inside
the token are validated by it. Long hexadecimal runs have no keyword; they are
found by an anchor-free run search.

Offsets are code points of the text, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nodeloom.llm.frames import free, with_kernel

#: Fixed order of the kinds: those of the base contract, then the method's own.
KINDS = ("assign", "access", "hex", "github", "jwt", "npm", "pem")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
#: From a BEGIN mark to the first fitting END mark, with no other BEGIN mark between.
PEM = re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:[^-]|-(?!----BEGIN ))*?)-----END \1-----")
#: What quotes a line of a key in code or mail.
PEM_QUOTES = re.compile(rb"""["'][\s"',;.)+\\]*$|^[\s"'>#*|]+|[\s\\]+$""")
#: A header of a key (RFC 1421 and its like) with what follows it up to an empty line, or else the one line.
PEM_HEADER = re.compile(rb"[A-Za-z][A-Za-z0-9-]*:(?:.*?\n\n|[^\n]*(?:\n|\Z))", re.DOTALL)
#: Keywords (lower case) and the kind that each leads to.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin": "pem"}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> bytes:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out.rjust(width, "0").encode()


def _crc_fits(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of those before them, in base 62."""
    return base62(zlib.crc32(m[1]), 6) == m[2]


def _jwt_fits(m: re.Match) -> bool:
    """Header and claims decode to JSON objects, the header names an algorithm."""
    try:
        parts = [json.loads(base64.urlsafe_b64decode(m[i] + b"=" * (-len(m[i]) % 4))) for i in (1, 2)]
    except (ValueError, binascii.Error):
        return False
    return all(isinstance(p, dict) for p in parts) and "alg" in parts[0]


def _pem_fits(m: re.Match) -> bool:
    """The body, after any headers, decodes to the bytes that its kind begins with: a DER sequence of just this length,
    or OpenSSH's mark; ciphertext of a whole key (DEK-Info) only has to be whole base64. Lines may be quoted."""
    lines = m[2].replace(b"\\r", b"").replace(b"\\n", b"\n").splitlines()
    body, headers = b"\n".join(PEM_QUOTES.sub(b"", x) for x in lines).lstrip(), b""
    while h := PEM_HEADER.match(body):
        headers += h[0]
        body = body[h.end() :]
    try:
        key = base64.b64decode(b"".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if not key or b"dek-info:" in headers.lower():
        return bool(key)
    if m[1].startswith(b"OPENSSH"):
        return key.startswith(b"openssh-key-v1\0")
    if len(key) < 2 or key[0] != 0x30:
        return False
    if key[1] < 0x80:
        return len(key) == 2 + key[1]
    n = key[1] & 0x7F
    return 0 < n <= 4 and len(key) == 2 + n + int.from_bytes(key[2 : 2 + n], "big")


#: Of a kind: its expression, and whether a match counts.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, _crc_fits),
    "npm": (NPM, _crc_fits),
    "jwt": (JWT, _jwt_fits),
    "pem": (PEM, _pem_fits),
}

_AUTOMATON = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then kind; of a kind leftmost, not overlapping."""
    hits: dict[str, list[int]] = {}
    for end, (n, kind) in automaton().iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end - n + 1)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(data)]
    for kind, starts in hits.items():
        pattern, fits = RULES[kind]
        taken = -1
        for at in sorted(set(starts)):
            if at < taken or not (m := pattern.match(data, at)):
                continue
            taken = m.end()  # a match that does not fit still uses up its text
            if fits(m):
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _points(data: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same spans in code points."""
    if not found or data.isascii():
        return found
    ahead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    count = lambda i: int(ahead[i - 1]) if i else 0
    return [(count(s), count(e), k) for s, e, k in found]


FIELDS = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("redacted", T.StringType())])
DIGEST = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def redact(data: bytes, found: list[tuple[int, int, str]]) -> bytes:
    """Spans, merged where they overlap, give way to the mark of their first kind."""
    out, at, i = [], 0, 0
    while i < len(found):
        start, end, kind = found[i]
        while i + 1 < len(found) and found[i + 1][0] < end:
            i += 1
            end = max(end, found[i][1])
        out += [data[at:start], f"[{kind} removed]".encode()]
        at, i = end, i + 1
    return b"".join([*out, data[at:]])


def _scan(texts: pa.Array) -> list[pa.Array]:
    all_spans, clean = [], []
    for t in texts.cast(pa.large_binary()).to_pylist():
        found = spans(t) if t else []
        all_spans.append([{"kind": k, "start": s, "end": e} for s, e, k in _points(t, found)] if found else [])
        clean.append(redact(t, found) if found else t)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array(all_spans, kind), pa.array(clean, pa.binary()).cast(pa.string())]


def _digest(texts: pa.Array) -> list[pa.Array]:
    out: list[list] = [[] for _ in DIGEST.fields]
    write = lambda s: ",".join(f"{k}:{a}:{b}" for a, b, k in s)
    for t in texts.cast(pa.large_binary()).to_pylist():
        found = _points(t, spans(t)) if t else []
        base = [s for s in found if s[2] in KINDS[:3]]
        for o, x in zip(out, [*[sum(s[2] == k for s in base) for k in KINDS[:3]], hashlib.sha256(write(base).encode()).hexdigest(), write(found)], strict=True):
            o.append(x)
    return [pa.array(o, pa.int64() if i < 3 else pa.string()) for i, o in enumerate(out)]


def scan(docs: DataFrame, into: str = "secrets", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds a struct (spans, redacted) to every row. Null text: no spans, redacted null; empty text: no spans.

    Repeated rows are scanned alike; extra columns pass through, and a column
    called like `into` makes the struct take trailing underscores.
    """
    return with_kernel(docs, _scan, FIELDS, free(docs, into), text, keep)


def digest(docs: DataFrame, into: str = "digest", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds a struct (n_assign, n_access, n_hex, base_sha256, spans) of the same spans as text."""
    return with_kernel(docs, _digest, DIGEST, free(docs, into), text, keep)
