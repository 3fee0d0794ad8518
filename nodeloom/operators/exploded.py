"""Queries over a node table: one row a node, for very large documents and questions across documents.

Children are equi-joins on (document, parent), descendants interval joins on
pre-order numbers; steps from the root take no join. Rows carry an order key of (parent, child, selector) per segment, so results sort as the
query lists them. Store the table bucketed by document to join without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.rowlocal import NotNative, RowLocal, refuse_limits
from nodeloom.plans import ast as A
from nodeloom.plans.query import JsonPath
from nodeloom.sources.shredder import scalar_key
from nodeloom.sources.store import Scratch


def node_table(df: DataFrame, doc_id: str, doc: str = "doc") -> DataFrame:
    """(doc_id, pre, key, name, idx, step, parent, last, depth, num, n_children, value) of every node of a tree column."""
    nodes = df.select(F.col(doc_id).alias("doc_id"), F.col(f"{doc}.text").alias("text"), F.posexplode(f"{doc}.nodes").alias("pre", "n"))
    value = F.substring(F.col("text"), F.col("n.pos") + 1, F.col("n.len"))
    return nodes.select("doc_id", "pre", *[F.col(f"n.{c}").alias(c) for c in ("key", "name", "idx", "step", "parent", "last", "depth", "num")], F.size("n.ch").alias("n_children"), value.alias("value"))


class Exploded:
    """One query over a node table; filters may test existence of relative queries and compare them with literals.

    scratch: the table is written there once, with the columns that the query
    reads, so what makes it (shredding, say) runs once and not for each step.
    Joins shuffle and sort: Spark takes a node table for far smaller than it is,
    and a side that it broadcasts goes through the driver. Rows without a
    document number belong to no document.
    """

    def __init__(self, path: JsonPath, nodes: DataFrame, scratch: Scratch | None = None):
        refuse_limits(path)
        self.path, self.table = path, nodes.where("doc_id is not null")
        if scratch is not None:
            self.table = scratch.keep(self._read(self.table), "nodes")

    def _read(self, nodes: DataFrame) -> DataFrame:
        """What the query reads: texts of the nodes that it may select only, and of other objects and arrays the kind instead of the key."""
        last = self.path.ast.segments[-1].selectors if self.path.ast.segments else ()
        named = last and all(isinstance(x, A.Name) for x in last)
        final = F.coalesce(F.col("name").isin([x.name for x in last]), F.lit(False)) if named else F.lit(True)
        kind = F.substring("key", 1, 1)
        key = F.when(final | ~kind.isin("o", "a"), F.col("key")).otherwise(kind)
        return nodes.select("doc_id", "pre", key.alias("key"), "name", "idx", "parent", "last", "n_children", F.when(final, F.col("value")).alias("value"))

    def _selected(self) -> DataFrame:
        """(doc_id, at, ord, last, key, value) of the selected nodes."""
        segments = self.path.ast.segments
        now = None if segments else self._starts(self.table.where("pre = 0"), F.array())
        for s in segments:
            now = self._segment(s, now)
        limit = self.path.limits.results
        if limit is not None:
            found = now.groupBy("doc_id").agg(F.count("*").alias("results"))
            late = F.when(F.col("results") > limit, F.raise_error(F.lit(f"more than {limit} results")).cast("boolean")).otherwise(F.lit(True))
            now = now.join(found.hint("merge"), "doc_id").where(late).drop("results")
        return now

    def nodes(self) -> DataFrame:
        """(doc_id, pre, ord) of the selected nodes, duplicates included; ord sorts a document's."""
        return self._selected().select("doc_id", F.col("at").alias("pre"), "ord")

    def values(self) -> DataFrame:
        """(doc_id, pre, ord, key, value)."""
        return self._selected().select("doc_id", F.col("at").alias("pre"), "ord", "key", "value")

    def exists(self) -> DataFrame:
        """(doc_id) of the documents in which the query selects something."""
        return self.nodes().select("doc_id").distinct()

    @staticmethod
    def _starts(rows: DataFrame, order: Column) -> DataFrame:
        return rows.select("doc_id", F.col("pre").alias("at"), order.cast("array<bigint>").alias("ord"), "last", "key", "value")

    def _segment(self, s: A.Segment, now: DataFrame | None, each: bool = False) -> DataFrame:
        """What the segment selects from now; None stands for the roots or, with each, for every node (it takes no join)."""
        parts = [self._select(x, i, now, s.descendant, each) for i, x in enumerate(s.selectors)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def _select(self, x, ordinal: int, now: DataFrame | None, descendant: bool, each: bool) -> DataFrame:
        kids = self.table
        if isinstance(x, A.Name):
            kids = kids.where(F.col("name") == x.name)
        elif isinstance(x, (A.Index, A.Slice)):
            kids = kids.where("idx is not null")
        elif isinstance(x, A.Filter):
            kids = self._filtered(x.test, kids)
        order, parent = F.col("pre").cast("long"), F.col("parent").cast("long")
        if now is None:
            found = kids.where("parent >= 0" if descendant or each else "parent = 0")
            before = F.array(parent) if descendant or each else F.array().cast("array<bigint>")
        else:
            up = now.select(F.col("doc_id").alias("d"), F.col("at").alias("up"), F.col("last").alias("up_last"), F.col("ord").alias("before"))
            inside = F.col("parent").between(F.col("up"), F.col("up_last")) if descendant else F.col("parent") == F.col("up")
            found = up.hint("merge").join(kids, (F.col("d") == F.col("doc_id")) & inside)
            before = F.concat("before", F.array(parent)) if descendant else F.col("before")
        if isinstance(x, A.Index) and x.index >= 0:
            found = found.where(F.col("idx") == x.index)
        elif isinstance(x, (A.Index, A.Slice)):
            sizes = self.table.where("n_children > 0").select(F.col("doc_id").alias("of"), F.col("pre").alias("p"), F.col("n_children").cast("long").alias("size"))
            found = found.join(sizes.hint("merge"), (F.col("doc_id") == F.col("of")) & (F.col("parent") == F.col("p")))
            i, n = F.col("idx").cast("long"), F.col("size")
            hit, down = (i == n + x.index, False) if isinstance(x, A.Index) else self._in_slice(x, i, n)
            found = found.where(hit)
            order = -order if down else order
        return self._starts(found, F.concat(before, F.array(F.lit(ordinal).cast("long"), order)))

    @staticmethod
    def _in_slice(s: A.Slice, i: Column, n: Column) -> tuple[Column, bool]:
        if s.step == 0:
            return F.lit(False), False
        fit = lambda v, low, high: F.least(F.greatest(F.lit(v) + n if v < 0 else F.lit(v).cast("long"), low), high)
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        if s.step > 0:
            low = zero if s.start is None else fit(s.start, zero, n)
            high = n if s.end is None else fit(s.end, zero, n)
            return (i >= low) & (i < high) & ((i - low) % s.step == 0), False
        high = n - one if s.start is None else fit(s.start, -one, n - one)
        low = -one if s.end is None else fit(s.end, -one, n - one)
        return (i <= high) & (i > low) & ((high - i) % (-s.step) == 0), True

    def _filtered(self, test, kids: DataFrame) -> DataFrame:
        """The nodes for which the test is true."""
        if isinstance(test, A.And):
            for p in test.parts:
                kids = self._filtered(p, kids)
            return kids
        if isinstance(test, A.Or):
            parts = [self._filtered(p, kids) for p in test.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            return out.dropDuplicates(["doc_id", "pre"])
        if isinstance(test, A.Not):
            return kids.join(self._filtered(test.part, kids).select("doc_id", "pre").hint("merge"), ["doc_id", "pre"], "left_anti").select(*kids.columns)
        if isinstance(test, A.Exists):
            return self._with(kids, test.query, self._found(test.query, kids))
        if isinstance(test, A.Compare) and isinstance(test.left, A.Query) and isinstance(test.right, A.Literal):
            return self._compared(test.op, test.left, test.right, kids)
        if isinstance(test, A.Compare) and isinstance(test.right, A.Query) and isinstance(test.left, A.Literal):
            flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
            return self._compared(flip.get(test.op, test.op), test.right, test.left, kids)
        raise NotNative("this filter needs the row-local or kernel operator")

    def _found(self, q: A.Query, kids: DataFrame) -> DataFrame:
        """(doc_id, pre, found): the keys of the nodes that a relative query selects from each of these, maybe from others too."""
        if q.absolute:
            raise NotNative("absolute queries in filters need the row-local or kernel operator")
        now = None if q.segments and not q.segments[0].descendant else self._starts(kids, F.array("pre"))
        for i, s in enumerate(q.segments):
            now = self._segment(s, now, each=i == 0)
        return now.select("doc_id", F.get("ord", F.lit(0)).cast("int").alias("pre"), F.col("key").alias("found"))

    @staticmethod
    def _with(kids: DataFrame, q: A.Query, found: DataFrame) -> DataFrame:
        """The nodes among kids that found has."""
        kids = kids.where("n_children > 0") if q.segments else kids
        return kids.join(found.hint("merge"), ["doc_id", "pre"], "left_semi").select(*kids.columns)

    def _compared(self, op: str, q: A.Query, literal: A.Literal, kids: DataFrame) -> DataFrame:
        """Nothing equals no literal and is neither less nor greater, so nodes without a result only count for !=."""
        hits = self._found(q, kids).where(RowLocal._compare("==" if op == "!=" else op, F.col("found"), F.lit(scalar_key(literal.value))))
        if op != "!=":
            return self._with(kids, q, hits)
        return kids.join(hits.hint("merge"), ["doc_id", "pre"], "left_anti").select(*kids.columns)
