"""Filter functions: those of RFC 9535, the number aggregates, and functions of one's own."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Context, Decimal, ROUND_HALF_EVEN

from nodeloom.functions import iregexp
from nodeloom.functions.values import NOTHING, exact, kind
from nodeloom.plans import ast as A
from nodeloom.plans.parser import BUILT_IN

_D64, _D128 = Context(prec=16, rounding=ROUND_HALF_EVEN), Context(prec=34, rounding=ROUND_HALF_EVEN)
_EXACT = Context(prec=100_000)


@dataclass(frozen=True)
class Function:
    """A function of filters. body gets a value or NOTHING, a bool, or a list of values for each parameter."""

    name: str
    params: tuple[str, ...]
    result: str
    body: Callable

    def __post_init__(self) -> None:
        if not re.fullmatch("[a-z][a-z0-9_]*", self.name):
            raise ValueError(f"{self.name!r} is no function name")
        if self.result not in (A.VALUE, A.LOGICAL, A.NODES) or any(p not in (A.VALUE, A.LOGICAL, A.NODES) for p in self.params):
            raise ValueError("types are value, logical and nodes")


def length(v):
    if v is NOTHING:
        return NOTHING
    return len(v) if kind(v) in ("string", "array", "object") else NOTHING


def _regex(whole: bool):
    def body(text, pattern) -> bool:
        if not isinstance(text, str) or not isinstance(pattern, str):
            return False
        r = iregexp.compiled(pattern)
        return r is not None and (r.match(text) if whole else r.search(text))

    return body


def _numbers(nodes: list) -> list[Decimal]:
    found = (exact(v) for v in nodes if not isinstance(v, bool) and v is not None and kind(v) == "number")
    return [Decimal(x) for x in found if x is not None]


def _of_numbers(of: Callable):
    def body(nodes: list):
        xs = _numbers(nodes)
        return of(xs) if xs else NOTHING

    return body


def total(xs: list[Decimal]) -> Decimal:
    out = Decimal(0)
    for x in xs:
        out = _EXACT.add(out, x)
    return out


def stddev(xs: list[Decimal]) -> Decimal:
    """Of the whole population."""
    mean = _D128.divide(total(xs), Decimal(len(xs)))
    squares = Decimal(0)
    for x in xs:
        d = _D128.subtract(x, mean)
        squares = _D128.add(squares, _D128.multiply(d, d))
    return _D64.sqrt(_D128.divide(squares, Decimal(len(xs))))


BODIES = {
    "length": length,
    "count": len,
    "value": lambda nodes: nodes[0] if len(nodes) == 1 else NOTHING,
    "match": _regex(True),
    "search": _regex(False),
}
AGGREGATES = tuple(
    Function(n, (A.NODES,), A.VALUE, _of_numbers(f))
    for n, f in (("min", min), ("max", max), ("sum", total), ("avg", lambda xs: _D64.divide(total(xs), Decimal(len(xs)))), ("stddev", stddev))
)


class Registry:
    """The functions that a compiler knows; there is no global one."""

    def __init__(self, functions: tuple[Function, ...] = ()):
        self.own = {}
        for f in functions:
            if f.name in BUILT_IN or f.name in self.own:
                raise ValueError(f"function {f.name!r} is defined already")
            self.own[f.name] = f

    def types(self) -> dict[str, tuple[tuple[str, ...], str]]:
        return {n: (f.params, f.result) for n, f in self.own.items()}

    def body(self, name: str) -> Callable:
        return BODIES[name] if name in BODIES else self.own[name].body

    def __eq__(self, other) -> bool:
        return isinstance(other, Registry) and self.own == other.own

    def __hash__(self) -> int:
        return hash(tuple(self.own))
