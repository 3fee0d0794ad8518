"""Compiled queries over Python values; Spark operators compile the same syntax trees to columns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from nodeloom.functions.evaluate import Evaluation, Limits, path_of
from nodeloom.functions.registry import AGGREGATES, Function, Registry
from nodeloom.functions.values import equal
from nodeloom.plans import ast as A
from nodeloom.plans.parser import parse
from nodeloom.plans.paths import NormalizedPath
from nodeloom.sources import json_text


@dataclass(frozen=True)
class Node:
    value: object
    path: NormalizedPath

    def __eq__(self, other) -> bool:
        return isinstance(other, Node) and self.path == other.path and equal(self.value, other.value)

    def __hash__(self) -> int:
        return hash(self.path)


class NodeList(list):
    """The nodes that a query selected, in order, duplicates included."""

    def values(self) -> list:
        return [n.value for n in self]

    def paths(self) -> list[str]:
        return [str(n.path) for n in self]

    def distinct_paths(self) -> list[NormalizedPath]:
        """Each place once, by first occurrence."""
        return list(dict.fromkeys(n.path for n in self))

    def first(self) -> Node | None:
        return self[0] if self else None

    def single(self) -> Node | None:
        if len(self) > 1:
            raise ValueError(f"{len(self)} nodes where one at most was expected")
        return self.first()


@dataclass(frozen=True)
class JsonPath:
    expression: str
    registry: Registry = Registry()
    limits: Limits = Limits()

    def __post_init__(self) -> None:
        self.ast  # noqa: B018  bad expressions fail here

    @cached_property
    def ast(self) -> A.Query:
        return parse(self.expression, self.registry.types())

    def __getstate__(self):
        return {"expression": self.expression, "registry": self.registry, "limits": self.limits}

    @property
    def singular(self) -> bool:
        return self.ast.singular

    def with_limits(self, **changes) -> JsonPath:
        return replace(self, limits=replace(self.limits, **changes))

    def query(self, document) -> NodeList:
        return NodeList(Node(v, path_of(at)) for v, at, _ in Evaluation(self.ast, self.registry, self.limits).run(document))

    def query_json(self, text: str) -> NodeList:
        return self.query(json_text.parse(text))

    def values(self, document) -> list:
        return [v for v, _, _ in Evaluation(self.ast, self.registry, self.limits).run(document)]

    def exists(self, document) -> bool:
        return bool(Evaluation(self.ast, self.registry, self.limits).run(document, stop=1))

    def first(self, document) -> Node | None:
        return NodeList(Node(v, path_of(at)) for v, at, _ in Evaluation(self.ast, self.registry, self.limits).run(document, stop=1)).first()


class Compiler:
    """Compiles expressions with functions of one's own."""

    def __init__(self, *functions: Function, limits: Limits = Limits()):
        self.registry, self.limits = Registry(functions), limits

    def compile(self, expression: str) -> JsonPath:
        return JsonPath(expression, self.registry, self.limits)


def compile(expression: str) -> JsonPath:  # noqa: A001  the name of the operation
    return JsonPath(expression)


def with_aggregates() -> Compiler:
    """min, max, sum, avg and stddev beside the functions of the standard."""
    return Compiler(*AGGREGATES)
