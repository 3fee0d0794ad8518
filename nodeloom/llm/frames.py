"""Small helpers for DataFrames: Arrow kernels beside other columns, free names, running sums over hot groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Parts that one group is split into for running sums and ranks; each part is sorted in a task of its own.
PARTS = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of a few numbers that may be broadcast (about 16 MB); more are joined by shuffling.
SMALL_ROWS = 500_000


def small(table: DataFrame, lists: str | None = None) -> DataFrame:
    """A stored table of a few numeric columns, to be broadcast if its counted rows allow it; lists: a column whose elements count as rows too."""
    rows = F.count("*") if lists is None else F.count("*") + F.coalesce(F.sum(F.size(lists)), F.lit(0))
    return F.broadcast(table) if table.agg(rows).first()[0] <= SMALL_ROWS else table


def free(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_kernel(df: DataFrame, kernel: Callable[[pa.Array], list[pa.Array]], fields: T.StructType, into: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds a struct column of what an Arrow kernel makes of the text column; keep: the columns that stay."""
    keep = df.columns if keep is None else keep
    src = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(keep)], *([] if text in keep else [col(text).alias("t")]))
    at = f"c{keep.index(text)}" if text in keep else "t"
    kept = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(src.schema.fields[: len(keep)])])
    schema = T.StructType([*kept.fields, T.StructField("r", fields)])
    kind, names = to_arrow_type(fields), kept.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.StructArray.from_arrays([a.cast(f.type) for a, f in zip(kernel(batch.column(at)), kind, strict=True)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made], names=[*names, "r"])

    return src.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("r").alias(into))


def running(df: DataFrame, group: list[str], value: str, order: list[str], into: str, part: Column | None = None) -> DataFrame:
    """Adds the sum of value over the rows before this one in its group, by a hash of the order columns.

    No task sees a whole group: a group falls into PARTS parts by hash, whose
    sums are added up per group first. With part, a whole number that rises with
    the order columns, rows go by these themselves. Rows alike in all order
    columns and value are interchangeable. Group columns must not be null.
    """
    h, at, before = free(df, "h"), free(df, "part"), free(df, "before")
    hashed = df.withColumn(h, F.xxhash64(*[col(c) for c in order])) if part is None else df.withColumn(h, F.lit(0))
    hashed = hashed.withColumn(at, F.pmod(F.col(h), F.lit(PARTS)).cast("int") if part is None else part)
    keys = [*group, at]
    sums = hashed.groupBy(*keys).agg(F.sum(col(value)).alias(before))
    by = Window.partitionBy(*group).orderBy(at)
    offsets = sums.withColumn(before, F.sum(before).over(by) - F.col(before))
    inside = Window.partitionBy(*keys).orderBy(h, *[col(c) for c in order], col(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(col(value)).over(inside) - col(value)
    return hashed.join(offsets, keys).withColumn(into, own + F.col(before)).drop(h, at, before)


#: Links (16 bytes each) that a task joins.
LINKS_AT_ONCE = 1 << 20


def _join_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's links with the least one that it reaches over them."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = least_reached(len(nodes), at[: len(a)], at[len(a) :])
    apart = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[root[apart]])], names=["a", "b"])


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n numbers that each reaches over the pairs (a, b): minima spread and paths halve until nothing changes."""
    root = np.arange(n)
    while True:
        new, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_components(spark: SparkSession, edges: DataFrame, scratch) -> DataFrame:
    """(node, root): the least node reachable over edges (a, b), for every node that has one.

    Tasks of about LINKS_AT_ONCE links join what they hold; where that takes
    several tasks, large-star and small-star rounds alternate with it until
    every link leads to a node that is the least of its neighbours and of
    theirs. Every round is written to the shared folder. Hot nodes only meet in
    minima (combined before the shuffle) and in joins that adaptive execution
    can split.
    """

    def tidy(pairs: DataFrame) -> DataFrame:
        return scratch.keep(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    now = tidy(edges.select("a", "b"))
    while True:
        tasks = -(-now.count() // LINKS_AT_ONCE) or 1
        now = scratch.keep(now.coalesce(tasks).mapInArrow(_join_links, "a long, b long"), "joined")
        if tasks == 1:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        if not now.join(least.withColumnRenamed("a", "b"), "b").where("m <> b").take(1) and not now.join(least, "a").where("m <> b").take(1):
            break
        mid = tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = scratch.keep(mid.groupBy("a").agg(F.min("b").alias("m")), "low")
        star = tidy(mid.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b"))
        scratch.drop(now, least, mid, low)
        now = star
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
