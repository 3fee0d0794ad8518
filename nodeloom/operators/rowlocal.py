"""Queries over row-local trees as Spark columns: projections of higher-order functions, no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.functions import iregexp
from nodeloom.functions.evaluate import Limits
from nodeloom.plans import ast as A
from nodeloom.plans.query import JsonPath
from nodeloom.sources.shredder import scalar_key


class NotNative(ValueError):
    """The query needs the kernel (operators.kernel): no column expresses it exactly."""


_NO_REFS = "array<int>"


def refuse_limits(path: JsonPath) -> None:
    """Visited nodes and depth are counted by the kernel only: a path that bounds them is refused here, not run without them."""
    own, usual = path.limits, Limits()
    if own.visits not in (usual.visits, None) or own.depth not in (usual.depth, None):
        raise NotNative("bounds on visited nodes and depth need the kernel")


def bounded(found: Column, path: JsonPath, kind: str) -> Column:
    """An array of results; one of more than the path's bound is an error."""
    limit = path.limits.results
    if limit is None:
        return found
    return F.when(F.size(found) > limit, F.raise_error(F.lit(f"more than {limit} results")).cast(kind)).otherwise(found)


def _none() -> Column:
    return F.array().cast(_NO_REFS)


def int_key(n: Column) -> Column:
    """The node key of a column of non-negative integers."""
    s = n.cast("string")
    body = F.concat(F.lpad((F.length(s) + F.lit(5_000_000_000)).cast("string"), 10, "0"), F.regexp_replace(s, "0+$", ""))
    return F.when(n == 0, F.lit("n1")).when(n.isNotNull(), F.concat(F.lit("n2"), body))


class RowLocal:
    """One query compiled against a tree column."""

    def __init__(self, path: JsonPath, doc: Column | str):
        refuse_limits(path)
        self.path = path
        self.doc = F.col(doc) if isinstance(doc, str) else doc
        self.nodes = self.doc["nodes"]

    # results

    def refs(self) -> Column:
        """Numbers of the selected nodes, in order, duplicates included; null for a null tree."""
        out = bounded(self._follow(self.path.ast, F.lit(0)), self.path, _NO_REFS)
        return F.when(self.nodes.isNotNull(), out)

    def _text(self, r: Column) -> Column:
        n = self._node(r)
        return F.substring(self.doc["text"], n["pos"] + 1, n["len"])

    def _path(self, r: Column) -> Column:
        up = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.lit(1), self._node(r)["depth"])),
            F.struct(r.cast("int").alias("at"), F.lit("").alias("text")),
            lambda a, _: F.struct(self._node(a["at"])["parent"].alias("at"), F.concat(self._node(a["at"])["step"], a["text"]).alias("text")),
        )
        return F.when(self._node(r)["depth"] == 0, F.lit("$")).otherwise(F.concat(F.lit("$"), up["text"]))

    def values(self) -> Column:
        """JSON texts of the selected values."""
        return F.transform(self.refs(), self._text)

    def paths(self) -> Column:
        """Normalized paths of the selected nodes."""
        return F.transform(self.refs(), self._path)

    def distinct_paths(self) -> Column:
        return F.transform(F.array_distinct(self.refs()), self._path)

    def query(self) -> Column:
        """array<struct<value, path>>."""
        return F.transform(self.refs(), lambda r: F.struct(self._text(r).alias("value"), self._path(r).alias("path")))

    def count(self) -> Column:
        return F.size(self.refs())

    def exists(self) -> Column:
        return F.size(self.refs()) > 0

    def first(self) -> Column:
        return self._text(F.get(self.refs(), F.lit(0)))

    def single(self) -> Column:
        refs = self.refs()
        return F.when(F.size(refs) > 1, F.raise_error(F.lit("more than one node")).cast("string")).otherwise(self._text(F.get(refs, F.lit(0))))

    def keys(self) -> Column:
        """Comparison keys of the selected values: equal keys are equal values."""
        return F.transform(self.refs(), lambda r: self._node(r)["key"])

    def numbers(self) -> Column:
        """The numbers among the selected values, as doubles."""
        return F.filter(F.transform(self.refs(), lambda r: self._node(r)["num"]), lambda x: x.isNotNull())

    def strings(self) -> Column:
        """The strings among the selected values."""
        return F.transform(F.filter(self.keys(), lambda k: k.startswith("s")), lambda k: F.substring(k, 2, 1 << 30))

    # navigation

    def _node(self, r: Column) -> Column:
        return F.get(self.nodes, r)

    def _kids(self, r: Column) -> Column:
        return F.coalesce(self._node(r)["ch"], _none())

    def _follow(self, query: A.Query, start: Column) -> Column:
        refs = F.array(start.cast("int"))
        for i, segment in enumerate(query.segments):
            one = lambda r, s=segment: self._segment(s, r)
            each = self._each(one)
            refs = one(start) if i == 0 else F.flatten(F.transform(refs, each))
        return refs

    @staticmethod
    def _each(f):
        return lambda r: f(r)

    def _segment(self, s: A.Segment, r: Column) -> Column:
        def at(n: Column) -> Column:
            parts = [self._select(x, n) for x in s.selectors]
            return parts[0] if len(parts) == 1 else F.concat(*parts)

        if not s.descendant:
            return at(r)
        return F.flatten(F.transform(F.sequence(r.cast("int"), self._node(r)["last"]), lambda n: at(n)))

    def _select(self, x, r: Column) -> Column:
        kids = self._kids(r)
        if isinstance(x, A.Wildcard):
            return kids
        if isinstance(x, A.Name):
            return F.filter(kids, lambda c: F.coalesce(self._node(c)["name"] == F.lit(x.name), F.lit(False)))
        is_array = F.substring(self._node(r)["key"], 1, 1) == "a"
        if isinstance(x, A.Index):
            n = F.lit(x.index) if x.index >= 0 else F.size(kids) + F.lit(x.index)
            if abs(x.index) >= 1 << 31:
                return _none()
            found = F.get(kids, n.cast("int"))
            return F.when(is_array & (n >= 0) & found.isNotNull(), F.array(found)).otherwise(_none())
        if isinstance(x, A.Slice):
            return F.when(is_array, self._slice(x, kids)).otherwise(_none())
        return F.filter(kids, lambda c: self._test(x.test, c))

    def _slice(self, s: A.Slice, kids: Column) -> Column:
        if s.step == 0:
            return _none()
        n = F.size(kids).cast("long")
        fit = lambda i, low, high: F.least(F.greatest(F.lit(i) + n if i < 0 else F.lit(i).cast("long"), low), high)
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        step = max(-(1 << 40), min(1 << 40, s.step))
        if s.step > 0:
            low = zero if s.start is None else fit(s.start, zero, n)
            high = (n if s.end is None else fit(s.end, zero, n)) - one
            some = low <= high
        else:
            low = n - one if s.start is None else fit(s.start, -one, n - one)
            high = (-one if s.end is None else fit(s.end, -one, n - one)) + one
            some = low >= high
        # the bounds of an empty range are not evaluated as they are: sequence() raises on them
        walk = F.sequence(F.when(some, low).otherwise(zero), F.when(some, high).otherwise(zero), F.lit(step).cast("long"))
        return F.when(some, F.transform(walk, lambda i: F.get(kids, i.cast("int")))).otherwise(_none())

    # filters

    def _test(self, t, c: Column) -> Column:
        if isinstance(t, (A.Or, A.And)):
            out = self._test(t.parts[0], c)
            for p in t.parts[1:]:
                out = out | self._test(p, c) if isinstance(t, A.Or) else out & self._test(p, c)
            return out
        if isinstance(t, A.Not):
            return ~self._test(t.part, c)
        if isinstance(t, A.Exists):
            return F.coalesce(F.size(self._refs_of(t.query, c)) > 0, F.lit(False))
        if isinstance(t, A.Compare):
            return self._compare(t.op, self._key(t.left, c), self._key(t.right, c))
        return self._regex(t, c)

    def _refs_of(self, q: A.Query, c: Column) -> Column:
        return self._follow(q, F.lit(0) if q.absolute else c)

    def _key(self, x, c: Column) -> Column:
        """The comparison key of an operand, null for Nothing."""
        if isinstance(x, A.Literal):
            return F.lit(scalar_key(x.value))
        if isinstance(x, A.Query):
            return self._node(F.get(self._refs_of(x, c), F.lit(0)))["key"]
        if x.name == "count":
            return int_key(F.size(self._nodes(x.args[0], c)))
        if x.name == "value":
            refs = self._nodes(x.args[0], c)
            return F.when(F.size(refs) == 1, self._node(F.get(refs, F.lit(0)))["key"])
        if x.name == "length":
            if isinstance(x.args[0], A.Literal):
                v = x.args[0].value
                return F.lit(scalar_key(len(v))) if isinstance(v, str) else F.lit(None).cast("string")
            if isinstance(x.args[0], A.Query):
                n = self._node(F.get(self._refs_of(x.args[0], c), F.lit(0)))
                kind = F.substring(n["key"], 1, 1)
                return int_key(F.when(kind == "s", F.length(n["key"]) - 1).when(kind.isin("o", "a"), F.size(n["ch"])))
        if x.name in ("min", "max"):
            keys = F.filter(F.transform(self._nodes(x.args[0], c), lambda r: self._node(r)["key"]), lambda k: k.startswith("n"))
            return (F.array_min if x.name == "min" else F.array_max)(keys)
        raise NotNative(f"{x.name} has no exact column expression")

    def _nodes(self, x, c: Column) -> Column:
        if isinstance(x, A.Query):
            return self._refs_of(x, c)
        raise NotNative(f"{x.name} has no column expression")

    @staticmethod
    def _compare(op: str, a: Column, b: Column) -> Column:
        if op in (">", ">="):
            a, b, op = b, a, {">": "<", ">=": "<="}[op]
        same = a.eqNullSafe(b)
        if op == "==":
            return same
        if op == "!=":
            return ~same
        kind = F.substring(a, 1, 1)
        less = F.coalesce(kind.isin("n", "s") & (kind == F.substring(b, 1, 1)) & (a < b), F.lit(False))
        return less if op == "<" else less | same

    def _regex(self, t: A.Call, c: Column) -> Column:
        if t.name not in ("match", "search"):
            raise NotNative(f"{t.name} has no column expression")
        text, pattern = t.args
        if not isinstance(pattern, A.Literal):
            raise NotNative("patterns from documents need the linear-time automaton")
        if not isinstance(pattern.value, str) or iregexp.compiled(pattern.value) is None:
            return F.lit(False)
        java = iregexp.for_jvm(pattern.value, t.name == "match")
        if java is None:
            raise NotNative("the pattern could backtrack")
        key = self._key(text, c)
        return F.coalesce(key.startswith("s") & F.substring(key, 2, 1 << 30).rlike(java), F.lit(False))
