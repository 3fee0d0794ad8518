"""The parts of a JSONPath query (RFC 9535)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

VALUE, LOGICAL, NODES = "value", "logical", "nodes"


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class Index:
    index: int


@dataclass(frozen=True)
class Slice:
    start: int | None
    end: int | None
    step: int


@dataclass(frozen=True)
class Filter:
    test: Any


@dataclass(frozen=True)
class Segment:
    selectors: tuple
    descendant: bool = False
    #: One name or index, without blanks at the edges of its brackets.
    single: bool = False


@dataclass(frozen=True)
class Query:
    absolute: bool
    segments: tuple[Segment, ...]

    @property
    def singular(self) -> bool:
        return all(s.single for s in self.segments)


@dataclass(frozen=True)
class Literal:
    value: Any  # str, Decimal, bool or None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    params: tuple[str, ...]
    result: str
    #: Whatever the compiler made of literal arguments, such as a compiled expression.
    ready: Any = field(default=None, compare=False)


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Exists:
    query: Query
