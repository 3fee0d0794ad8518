"""Queries over typed columns: paths are resolved against the schema, so Catalyst prunes and pushes down.

Structs are objects with their fields in order, arrays are arrays, maps with
string keys are objects. null_as: what a null means, "missing" (the default)
or "null", a JSON null. Selected values of one type keep it; of several types
they become JSON texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.functions import iregexp
from nodeloom.operators.rowlocal import NotNative, bounded, refuse_limits
from nodeloom.plans import ast as A
from nodeloom.plans.query import JsonPath

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def kind(t: T.DataType) -> str:
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, NUMBERS):
        return "number"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "null" if isinstance(t, T.NullType) else "string"


def json_of(c: Column, t: T.DataType) -> Column:
    """JSON text of a typed value."""
    if kind(t) in ("object", "array"):
        text = F.to_json(c)
    elif kind(t) == "string":
        text = F.regexp_extract(F.to_json(F.array(c.cast("string"))), r"(?s)^\[(.*)\]$", 1)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


class Typed:
    def __init__(self, path: JsonPath, df: DataFrame, column: str | None = None, null_as: str = "missing"):
        """column: the root of the documents; without one, a row is a document."""
        if null_as not in ("missing", "null"):
            raise ValueError(f"unknown null_as {null_as!r}")
        refuse_limits(path)
        self.path, self.null_as = path, null_as
        if column is None:
            self.type: T.DataType = df.schema
            self.root = F.struct(*[F.col(f"`{c}`") for c in df.columns])
            self.fields = {c: F.col(f"`{c}`") for c in df.columns}
        else:
            self.type, self.root, self.fields = df.schema[column].dataType, F.col(f"`{column}`"), {}

    # which types a query selects

    def _kids(self, t: T.DataType) -> list[T.DataType]:
        if isinstance(t, T.StructType):
            return [f.dataType for f in t.fields]
        if isinstance(t, T.ArrayType):
            return [t.elementType]
        return [t.valueType] if isinstance(t, T.MapType) else []

    def _of(self, s, t: T.DataType) -> list[T.DataType]:
        if isinstance(s, A.Name):
            if isinstance(t, T.StructType):
                return [f.dataType for f in t.fields if f.name == s.name]
            return [t.valueType] if isinstance(t, T.MapType) else []
        if isinstance(s, (A.Index, A.Slice)):
            return [t.elementType] if isinstance(t, T.ArrayType) else []
        return self._kids(t)

    def types(self, segments, t: T.DataType) -> list[T.DataType]:
        if not segments:
            return [t]
        first, rest = segments[0], segments[1:]
        out, todo = [], [t]
        while todo:
            now = todo.pop(0)
            out += [x for s in first.selectors for k in self._of(s, now) for x in self.types(rest, k)]
            if first.descendant:
                todo += self._kids(now)
        return list({x.simpleString(): x for x in out}.values())

    # results

    def values(self) -> Column:
        """The selected values as an array: of their type, of JSON texts where types differ."""
        found = self.types(self.path.ast.segments, self.type)
        if not found:
            return F.array().cast("array<string>")
        one = len(found) == 1
        leaf = (lambda c, t: c) if one else json_of
        of = found[0] if one else T.StringType()
        return bounded(self._walk(self.root, self.type, self.path.ast.segments, leaf, of, self.fields), self.path, T.ArrayType(of).simpleString())

    def exists(self) -> Column:
        return F.size(self.values()) > 0

    def count(self) -> Column:
        return F.size(self.values())

    def first(self) -> Column:
        return F.get(self.values(), F.lit(0))

    # navigation

    def _there(self, c: Column) -> Column:
        return c.isNotNull() if self.null_as == "missing" else F.lit(True)

    def _walk(self, c: Column, t: T.DataType, segments, leaf: Callable, out: T.DataType, fields: dict | None = None) -> Column:
        """The values under one node, as array<out>."""
        empty = F.array().cast(T.ArrayType(out))
        if not segments:
            return F.array(leaf(c, t)).cast(T.ArrayType(out))
        first, rest = segments[0], segments[1:]
        go = lambda x, k, f=None: self._walk(x, k, rest, leaf, out, f)
        parts = [p for s in first.selectors for p in self._select(s, c, t, go, fields)]
        if first.descendant:
            deeper = lambda x, k, f=None: self._walk(x, k, segments, leaf, out, f)
            parts += [p for p in self._select(A.Wildcard(), c, t, deeper, fields) if self._hits(segments, t)]
        return parts[0] if len(parts) == 1 else F.concat(*parts) if parts else empty

    def _hits(self, segments, t: T.DataType) -> bool:
        return any(self.types(segments, k) for k in self._kids(t))

    def _each(self, elements: Column, t: T.DataType, go: Callable) -> Column:
        kept = elements if self.null_as == "null" else F.filter(elements, lambda e: e.isNotNull())
        kept = F.coalesce(kept, F.array().cast(T.ArrayType(t)))
        return F.flatten(F.transform(kept, lambda e: go(e, t)))

    def _one(self, x: Column, t: T.DataType, go: Callable) -> Column:
        made = go(x, t)
        return made if self.null_as == "null" else F.when(x.isNotNull(), made).otherwise(F.slice(made, 1, 0))

    def _select(self, s, c: Column, t: T.DataType, go: Callable, fields: dict | None) -> list[Column]:
        field = lambda n: fields[n] if fields and n in fields else c.getField(n)
        if isinstance(s, A.Name):
            if isinstance(t, T.StructType):
                return [self._one(field(f.name), f.dataType, go) for f in t.fields if f.name == s.name]
            if isinstance(t, T.MapType):
                held = F.filter(F.map_values(F.map_filter(c, lambda k, v: k == F.lit(s.name))), self._there)
                return [self._each(held, t.valueType, go)]
            return []
        if isinstance(s, A.Wildcard):
            if isinstance(t, T.StructType):
                return [self._one(field(f.name), f.dataType, go) for f in t.fields]
            return [self._each(c if isinstance(t, T.ArrayType) else F.map_values(c), self._kids(t)[0], go)] if self._kids(t) else []
        if isinstance(s, A.Index):
            if not isinstance(t, T.ArrayType):
                return []
            i = F.lit(s.index) if s.index >= 0 else F.size(c) + F.lit(s.index)
            held = F.when((i >= 0) & (i < F.size(c)), F.slice(c, (i + 1).cast("int"), 1)).otherwise(F.slice(c, 1, 0))
            return [self._each(held, t.elementType, go)]
        if isinstance(s, A.Slice):
            return [self._each(self._slice(s, c), t.elementType, go)] if isinstance(t, T.ArrayType) else []
        if isinstance(t, T.StructType):
            out = []
            for f in t.fields:
                x = field(f.name)
                made = self._one(x, f.dataType, go)
                out.append(F.when(self._test(s.test, x, f.dataType), made).otherwise(F.slice(made, 1, 0)))
            return out
        if not self._kids(t):
            return []
        elements, k = (c if isinstance(t, T.ArrayType) else F.map_values(c)), self._kids(t)[0]
        return [self._each(F.filter(elements, lambda e: self._there(e) & self._test(s.test, e, k)), k, go)]

    def _slice(self, s: A.Slice, c: Column) -> Column:
        if s.step == 0:
            return F.slice(c, 1, 0)
        n = F.size(c).cast("long")
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        fit = lambda i, low, high: F.least(F.greatest(F.lit(i) + n if i < 0 else F.lit(i).cast("long"), low), high)
        if s.step > 0:
            low = zero if s.start is None else fit(s.start, zero, n)
            high = (n if s.end is None else fit(s.end, zero, n)) - one
            some = low <= high
        else:
            low = n - one if s.start is None else fit(s.start, -one, n - one)
            high = (-one if s.end is None else fit(s.end, -one, n - one)) + one
            some = low >= high
        walk = F.sequence(F.when(some, low).otherwise(zero), F.when(some, high).otherwise(zero), F.lit(max(-(1 << 40), min(1 << 40, s.step))).cast("long"))
        return F.when(some, F.transform(walk, lambda i: F.get(c, i.cast("int")))).otherwise(F.slice(c, 1, 0))

    # filters: an operand is (column, type), None where it is always Nothing

    def _test(self, x, c: Column, t: T.DataType) -> Column:
        if isinstance(x, (A.Or, A.And)):
            out = self._test(x.parts[0], c, t)
            for p in x.parts[1:]:
                out = out | self._test(p, c, t) if isinstance(x, A.Or) else out & self._test(p, c, t)
            return out
        if isinstance(x, A.Not):
            return ~self._test(x.part, c, t)
        if isinstance(x, A.Exists):
            return F.coalesce(F.size(self._marks(x.query, c, t)) > 0, F.lit(False))
        if isinstance(x, A.Compare):
            return self._compare(x.op, self._operand(x.left, c, t), self._operand(x.right, c, t))
        if x.name in ("match", "search"):
            return self._regex(x, c, t)
        raise NotNative(f"{x.name} has no typed column expression")

    def _from(self, q: A.Query, c: Column, t: T.DataType) -> tuple[Column, T.DataType]:
        return (self.root, self.type) if q.absolute else (c, t)

    def _marks(self, q: A.Query, c: Column, t: T.DataType) -> Column:
        """One element for each node."""
        x, k = self._from(q, c, t)
        return self._walk(x, k, q.segments, lambda *_: F.lit(1), T.IntegerType(), self.fields if q.absolute else None)

    def _values(self, q: A.Query, c: Column, t: T.DataType) -> tuple[Column, T.DataType] | None:
        x, k = self._from(q, c, t)
        found = self.types(q.segments, k)
        if not found:
            return None
        if len(found) > 1:
            if {kind(f) for f in found} != {"number"}:
                raise NotNative("values of several types")
            found = [T.DoubleType()]
            return self._walk(x, k, q.segments, lambda v, _: v.cast("double"), found[0], self.fields if q.absolute else None), found[0]
        return self._walk(x, k, q.segments, lambda v, _: v, found[0], self.fields if q.absolute else None), found[0]

    def _operand(self, x, c: Column, t: T.DataType):
        if isinstance(x, A.Literal):
            v = x.value
            if isinstance(v, bool):
                return F.lit(v), T.BooleanType()
            if v is None:
                return F.lit(None), T.NullType()
            if isinstance(v, str):
                return F.lit(v), T.StringType()
            text = format(v, "f")
            digits, scale = len(v.as_tuple().digits), max(0, -v.as_tuple().exponent)
            if max(digits, len(text.lstrip("-").split(".")[0]) + scale) <= 38:
                p = T.DecimalType(max(digits, scale + len(text.lstrip("-").split(".")[0]), 1), scale)
                return F.lit(text).cast(p), p
            return F.lit(float(v)), T.DoubleType()
        if isinstance(x, A.Query):
            found = self._values(x, c, t)
            return None if found is None else (F.get(found[0], F.lit(0)), found[1])
        if x.name == "count":
            return F.size(self._marks(x.args[0], c, t)), T.IntegerType()
        if x.name == "length":
            one = self._operand(x.args[0], c, t)
            if one is None or kind(one[1]) not in ("string", "array", "object"):
                return None
            n = F.length(one[0].cast("string")) if kind(one[1]) == "string" else F.lit(len(one[1].fields)) if isinstance(one[1], T.StructType) else F.size(one[0])
            return F.when(one[0].isNotNull(), n), T.IntegerType()
        if isinstance(x.args[0], A.Query):
            found = self._values(x.args[0], c, t)
            if x.name == "value":
                return None if found is None else (F.when(F.size(found[0]) == 1, F.get(found[0], F.lit(0))), found[1])
            if x.name in ("min", "max", "sum", "avg", "stddev"):
                if found is None or kind(found[1]) != "number":
                    return None
                return self._aggregate(x.name, F.filter(found[0], lambda v: v.isNotNull()), found[1])
        raise NotNative(f"{x.name} has no typed column expression")

    @staticmethod
    def _aggregate(name: str, xs: Column, t: T.DataType):
        """Decimals and integers add exactly; doubles, averages and deviations in double precision."""
        if name in ("min", "max"):
            return (F.array_min if name == "min" else F.array_max)(xs), t
        exact = not isinstance(t, (T.FloatType, T.DoubleType)) and name == "sum"
        to = T.DecimalType(38, t.scale if isinstance(t, T.DecimalType) else 0) if exact else T.DoubleType()
        total = F.aggregate(xs, F.lit(0).cast(to), lambda a, v: (a + v.cast(to)).cast(to))
        some = F.size(xs) > 0
        if name == "sum":
            return F.when(some, total), to
        mean = F.try_divide(total, F.size(xs))
        if name == "avg":
            return F.when(some, mean), to
        spread = F.aggregate(xs, F.lit(0.0), lambda a, v: a + (v.cast("double") - mean) * (v.cast("double") - mean))
        return F.when(some, F.sqrt(F.try_divide(spread, F.size(xs)))), to

    def _compare(self, op: str, a, b) -> Column:
        if op in (">", ">="):
            a, b, op = b, a, {">": "<", ">=": "<="}[op]
        gone = lambda x: F.lit(True) if x is None else F.lit(False) if isinstance(x[1], T.NullType) else x[0].isNull() if self.null_as == "missing" else F.lit(False)
        null = lambda x: F.lit(False) if x is None else F.lit(True) if isinstance(x[1], T.NullType) else x[0].isNull() if self.null_as == "null" else F.lit(False)
        same = gone(a) & gone(b) | null(a) & null(b)
        less = F.lit(False)
        if a is not None and b is not None and kind(a[1]) == kind(b[1]) and kind(a[1]) != "null":
            k = kind(a[1])
            x, y = (a[0], b[0]) if k != "string" else (a[0].cast("string"), b[0].cast("string"))
            if k == "object" or k == "array":
                if a[1].simpleString() != b[1].simpleString() or isinstance(a[1], T.MapType):
                    raise NotNative("deep equality of different types")
            nan = F.lit(False)
            for v, t in ((x, a[1]), (y, b[1])):
                if isinstance(t, (T.FloatType, T.DoubleType)):
                    nan = nan | F.isnan(v) | (F.abs(v) == float("inf"))
            if k == "number" and any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (a[1], b[1])):
                x, y = x.cast("double"), y.cast("double")
            same = same | F.coalesce((x == y) & ~nan, F.lit(False))
            if k in ("number", "string"):
                less = F.coalesce((x < y) & ~nan, F.lit(False))
        if op == "==":
            return same
        if op == "!=":
            return ~same
        return less if op == "<" else less | same

    def _regex(self, x: A.Call, c: Column, t: T.DataType) -> Column:
        one, pattern = self._operand(x.args[0], c, t), x.args[1]
        if not isinstance(pattern, A.Literal):
            raise NotNative("patterns from documents need the linear-time automaton")
        if one is None or kind(one[1]) != "string" or not isinstance(pattern.value, str) or iregexp.compiled(pattern.value) is None:
            return F.lit(False)
        java = iregexp.for_jvm(pattern.value, x.name == "match")
        if java is None:
            raise NotNative("the pattern could backtrack")
        return F.coalesce(one[0].cast("string").rlike(java), F.lit(False))
