"""Strict JSON text: reading into Python values, writing back."""

from __future__ import annotations

import json
import re
import sys
from decimal import Decimal, InvalidOperation

MAX_DEPTH = 1000
_SURROGATE = re.compile("[\ud800-\udfff]")
_ESCAPED_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


class InvalidJsonError(ValueError):
    def __init__(self, reason: str, position: int):
        self.reason, self.position = reason, position
        super().__init__(f"{reason} at position {position}")


def _members(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        seen: set[str] = set()
        for name, _ in pairs:
            if name in seen:
                raise _Duplicate(name)
            seen.add(name)
    return out


class _Duplicate(ValueError):
    pass


def _integer(text: str) -> int | Decimal:
    return int(text) if len(text) < 4000 else int(Decimal(text))


def _decimal(text: str) -> Decimal:
    try:
        return Decimal(text)
    except InvalidOperation:
        raise ValueError("number out of range") from None


def _no(text: str):
    raise ValueError(f"{text} is no JSON value")


def _depth(text: str) -> int:
    deep = most = 0
    for c in _STRINGS.sub("", text):
        if c in "[{":
            deep += 1
            most = max(most, deep)
        elif c in "]}":
            deep -= 1
    return most


_DECODER = json.JSONDecoder(object_pairs_hook=_members, parse_int=_integer, parse_float=_decimal, parse_constant=_no)


def parse(text: str, max_depth: int = MAX_DEPTH):
    """The value of a JSON text: objects as dicts in order, integers as int, other numbers as Decimal.

    Duplicate names, unpaired surrogates, trailing text and deeper nesting than
    max_depth are errors.
    """
    if text.count("[") + text.count("{") > max_depth // 2 and _depth(text) > max_depth:
        raise InvalidJsonError(f"nested deeper than {max_depth}", 0)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20 * MAX_DEPTH))
    try:
        value = _DECODER.decode(text)
    except json.JSONDecodeError as e:
        raise InvalidJsonError(e.msg, e.pos) from None
    except _Duplicate as e:
        raise InvalidJsonError(f"duplicate member name {e.args[0]!r}", max(0, text.find(json.dumps(e.args[0])))) from None
    except ValueError as e:
        raise InvalidJsonError(str(e), 0) from None
    finally:
        sys.setrecursionlimit(limit)
    if _SURROGATE.search(text) or _ESCAPED_SURROGATE.search(text) and _has_surrogate(value):
        raise InvalidJsonError("unpaired surrogate", 0)
    return value


def _has_surrogate(value) -> bool:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            if _SURROGATE.search(v):
                return True
        elif isinstance(v, dict):
            todo += [*v, *v.values()]
        elif isinstance(v, list):
            todo += v
    return False


def number_text(v) -> str:
    """A number without an exponent, digits kept."""
    if isinstance(v, bool):
        raise TypeError("no number")
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        v = Decimal(repr(v))
    return format(v, "f")


def write(value, indent: int | None = None) -> str:
    """JSON text of a value; members in order, decimals plain. indent: spaces of each level."""
    out: list[str] = []
    nl = (lambda d: "\n" + " " * (indent * d)) if indent else (lambda d: "")
    colon = ": " if indent else ":"
    todo: list = [(value, 0)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        v, d = item
        if v is None or v is True or v is False:
            out.append({None: "null", True: "true", False: "false"}[v])
        elif isinstance(v, str):
            out.append(json.dumps(v, ensure_ascii=False))
        elif isinstance(v, dict):
            if not v:
                out.append("{}")
                continue
            parts: list = ["{"]
            for i, (n, x) in enumerate(v.items()):
                parts += ["," * (i > 0) + nl(d + 1) + json.dumps(n, ensure_ascii=False) + colon, (x, d + 1)]
            todo += reversed([*parts, nl(d) + "}"])
        elif isinstance(v, (list, tuple)):
            if not v:
                out.append("[]")
                continue
            parts = ["["]
            for i, x in enumerate(v):
                parts += ["," * (i > 0) + nl(d + 1), (x, d + 1)]
            todo += reversed([*parts, nl(d) + "]"])
        else:
            out.append(number_text(v))
    return "".join(out)
