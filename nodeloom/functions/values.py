"""JSON values in Python: kinds, exact comparison, canonical keys of numbers and of whole values."""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

KINDS = ("object", "array", "string", "number", "boolean", "null")


class _Nothing:
    def __repr__(self) -> str:
        return "Nothing"

    def __reduce__(self):
        return "NOTHING"


#: The absent value of a function or query; not JSON null.
NOTHING = _Nothing()


class DepthError(ValueError):
    pass


def kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (int, float, Decimal)):
        return "number"
    if isinstance(v, dict):
        return "object"
    if isinstance(v, (list, tuple)):
        return "array"
    raise TypeError(f"{type(v).__name__} is no JSON value")


def exact(v) -> Decimal | int | None:
    """A number's exact value, doubles by their shortest text; None where it has none (NaN, infinities)."""
    if isinstance(v, float):
        return Decimal(repr(v)) if math.isfinite(v) else None
    if isinstance(v, Decimal) and not v.is_finite():
        return None
    return v


def num_key(v) -> str | None:
    """A text whose byte order is the order of numbers and whose equality is theirs, at any precision."""
    if isinstance(v, int) and 0 < v < 1 << 62:
        text = str(v)
        return f"2{len(text) + 5_000_000_000:010d}{text.rstrip('0')}"
    x = exact(v)
    if x is None:
        return None
    x = Decimal(x)
    sign, digits, power = x.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    if not text:
        return "1"
    exponent = power + len(text)
    text = text.rstrip("0")
    body = f"{exponent + 5_000_000_000:010d}{text}"
    if not sign:
        return "2" + body
    # complemented digits, ended by a mark above them, so that longer means nearer to zero
    return "0" + body.translate(str.maketrans("0123456789", "9876543210")) + "~"


def equal(a, b, depth: int = 1000) -> bool:
    """Deep equality; member order does not matter, numbers by value. NOTHING equals only itself."""
    todo = [(a, b, 0)]
    while todo:
        x, y, d = todo.pop()
        if x is NOTHING or y is NOTHING:
            if x is not y:
                return False
            continue
        k = kind(x)
        if k != kind(y):
            return False
        if k == "number":
            p, q = exact(x), exact(y)
            if p is None or q is None or p != q:
                return False
        elif k == "object":
            if d >= depth:
                raise DepthError(f"nested deeper than {depth}")
            if len(x) != len(y):
                return False
            for n, v in x.items():
                if n not in y:
                    return False
                todo.append((v, y[n], d + 1))
        elif k == "array":
            if d >= depth:
                raise DepthError(f"nested deeper than {depth}")
            if len(x) != len(y):
                return False
            todo += [(v, w, d + 1) for v, w in zip(x, y, strict=True)]
        elif x != y:
            return False
    return True


def less(a, b) -> bool:
    """Numbers with numbers by value, strings with strings by code point; anything else is not less."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    if a is NOTHING or b is NOTHING or kind(a) != "number" or kind(b) != "number":
        return False
    p, q = exact(a), exact(b)
    return p is not None and q is not None and p < q


def compare(op: str, a, b, depth: int = 1000) -> bool:
    if op == "==":
        return equal(a, b, depth)
    if op == "!=":
        return not equal(a, b, depth)
    if op in (">", ">="):
        a, b = b, a
    return less(a, b) or op in ("<=", ">=") and equal(a, b, depth)


def scalar_hash(k: str, text: str) -> str:
    return hashlib.sha256(f"{k}\x00{text}".encode()).hexdigest()


def joined_hash(k: str, parts: list[str]) -> str:
    return hashlib.sha256(f"{k}\x00{'|'.join(parts)}".encode()).hexdigest()
