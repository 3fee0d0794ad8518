"""JSON text columns as row-local trees: one struct a document, its nodes in pre-order.

A node: key (kind letter and comparable text), name or idx and its path step,
parent, last descendant, depth, num (as double), place of its text in the
document's compact text, and its children's numbers. Queries over such a column
are projections; no node leaves its row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from nodeloom.functions.values import num_key
from nodeloom.plans.paths import step_text
from nodeloom.sources import json_text

NODE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("step", T.StringType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("len", T.IntegerType()),
        T.StructField("ch", T.ArrayType(T.IntegerType())),
    ]
)
DOC = T.StructType([T.StructField("text", T.StringType()), T.StructField("nodes", T.ArrayType(NODE))])
ERROR = T.StructType([T.StructField("reason", T.StringType()), T.StructField("position", T.IntegerType())])

#: Documents whose trees a worker holds at once.
ROWS = 1000

#: Kind letters of node keys.
LETTERS = {"object": "o", "array": "a", "string": "s", "number": "n", "boolean": "b", "null": "z"}


def scalar_key(v) -> str:
    """The key of a scalar; equal values have equal keys, and keys of one kind are ordered like the values."""
    if v is None:
        return "z"
    if v is True or v is False:
        return "bt" if v else "bf"
    if isinstance(v, str):
        return "s" + v
    return "n" + num_key(v)


def _digest(letter: str, parts: list[str]) -> str:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        b = p.encode()
        h.update(len(b).to_bytes(8, "big") + b)
    return letter + h.hexdigest()


_step = lru_cache(maxsize=10_000)(step_text)
_quoted = lru_cache(maxsize=10_000)(lambda s: json.dumps(s, ensure_ascii=False))


class Trees:
    """The trees of a batch of values, column by column."""

    def __init__(self):
        self.texts: list[str | None] = []
        self.ends = [0]
        self.key, self.name, self.idx, self.step, self.parent, self.last, self.depth, self.num, self.pos, self.len, self.ch = ([] for _ in range(11))

    def skip(self) -> None:
        """A row without a tree."""
        self.texts.append(None)
        self.ends.append(self.ends[-1])

    def add(self, value) -> None:
        """The tree of one value; iterative, so depth is no problem. A value that fails leaves nothing."""
        first = len(self.key)
        try:
            self.texts.append(self._walk(value, first))
        except (TypeError, ValueError, OverflowError):
            for column in (self.key, self.name, self.idx, self.step, self.parent, self.last, self.depth, self.num, self.pos, self.len, self.ch):
                del column[first:]
            raise
        self.ends.append(len(self.key))

    def _walk(self, value, first: int) -> str:
        key, name, idx, step, parent, last, depth, num, pos, length, ch = self.key, self.name, self.idx, self.step, self.parent, self.last, self.depth, self.num, self.pos, self.len, self.ch
        text: list[str] = []
        size = 0
        # (text before, value, name, index, parent, depth) of a node to open, (mark, number) of one to close
        todo: list[tuple] = [("", value, None, None, -1, 0)]
        while todo:
            item = todo.pop()
            if len(item) == 2:
                mark, at = item
                text.append(mark)
                size += 1
                i = first + at
                last[i], length[i] = len(key) - first - 1, size - pos[i]
                kids = [first + c for c in ch[i]]
                key[i] = _digest("a", [key[c] for c in kids]) if mark == "]" else _digest("o", [x for c in sorted(kids, key=name.__getitem__) for x in (name[c], key[c])])
                continue
            before, v, own, index, up, deep = item
            if before:
                text.append(before)
                size += len(before)
            i = len(key)
            at = i - first
            name.append(own)
            idx.append(index)
            step.append("" if up < 0 else _step(own if index is None else index))
            parent.append(up)
            last.append(at)
            depth.append(deep)
            pos.append(size)
            if up >= 0:
                ch[first + up].append(at)
            if isinstance(v, dict) or isinstance(v, (list, tuple)):
                key.append(None)
                num.append(None)
                length.append(0)
                ch.append([])
                size += 1
                if isinstance(v, dict):
                    text.append("{")
                    todo.append(("}", at))
                    kids = [(("," if j else "") + _quoted(n) + ":", x, n, None, at, deep + 1) for j, (n, x) in enumerate(v.items())]
                else:
                    text.append("[")
                    todo.append(("]", at))
                    kids = [("," if j else "", x, None, j, at, deep + 1) for j, x in enumerate(v)]
                kids.reverse()
                todo += kids
                continue
            k = scalar_key(v)
            key.append(k)
            num.append(float(v) if k[0] == "n" else None)
            shown = _quoted(v) if k[0] == "s" and len(v) < 100 else json_text.write(v)
            text.append(shown)
            length.append(len(shown))
            size += len(shown)
            ch.append([])
        return "".join(text)

    def array(self) -> pa.StructArray:
        """The batch as DOC."""
        lengths = [0, *accumulate(map(len, self.ch))]
        children = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(list(chain.from_iterable(self.ch)), pa.int32()))
        columns = [self.key, self.name, self.idx, self.step, self.parent, self.last, self.depth, self.num, self.pos, self.len]
        kinds = list(to_arrow_type(NODE))
        nodes = pa.StructArray.from_arrays([*[pa.array(c, k.type) for c, k in zip(columns, kinds, strict=False)], children.cast(kinds[-1].type)], fields=kinds)
        doc = to_arrow_type(DOC)
        missing = pa.array([t is None for t in self.texts], pa.bool_())
        lists = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), nodes).cast(doc.field("nodes").type)
        return pa.StructArray.from_arrays([pa.array(self.texts, pa.string()), lists], fields=list(doc), mask=missing)


def value_key(value) -> str:
    """The comparison key of any value."""
    trees = Trees()
    trees.add(value)
    return trees.key[0]


def _shred(kept: list[str], mode: str):
    error_type = to_arrow_type(ERROR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch, trees, errors = whole.slice(start, ROWS), Trees(), []
                for t in batch.column("json").to_pylist():
                    error = None
                    if t is None:
                        trees.skip()
                    else:
                        try:
                            trees.add(json_text.parse(t))
                        except (json_text.InvalidJsonError, OverflowError) as e:
                            if mode == "fail":
                                raise
                            trees.skip()
                            error = {"reason": getattr(e, "reason", str(e)), "position": getattr(e, "position", 0)}
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], trees.array(), pa.array(errors, error_type)], names=[*kept, "doc", "error"])

    return run


def shred(df: DataFrame, json: str, into: str = "doc", keep: list[str] | None = None, mode: str = "fail") -> DataFrame:
    """Adds the tree of a JSON text column; null text has a null tree.

    mode: what a bad text does: "fail" raises, "null" leaves a null tree,
    "error" also adds a column <into>_error (reason, position). keep: the
    columns that stay, else all.
    """
    if mode not in ("fail", "null", "error"):
        raise ValueError(f"unknown mode {mode!r}")
    keep = df.columns if keep is None else keep
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(json).alias("json"))
    names = [f"c{i}" for i in range(len(keep))]
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("doc", DOC), T.StructField("error", ERROR)])
    out = src.mapInArrow(_shred(names, mode), schema)
    extra = [F.col("error").alias(f"{into}_error")] if mode == "error" else []
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("doc").alias(into), *extra)
