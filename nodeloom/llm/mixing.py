"""Operator 1, mixing sources to target weights with a time-varying curriculum.

Shares: each source's weight schedule is integrated over training; the
integrals share all words. A source is taken EPOCHS times at most, the excess
goes to the others by weight (water filling over the source totals).

Positions: a source's documents follow each other in hash order, epoch after
epoch. The cumulative demand of its schedule is inverted at each copy's place,
which gives the copy's training position in 0..1. The mix is its copies sorted
by range of position.

A source may hold any share of the rows: places come from running sums over
hash parts (frames.running), never from one task for a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
import numpy as np
import pyarrow as pa

from nodeloom.llm import words as W
from nodeloom.llm.frames import col, free, running, with_kernel

Schedule = Sequence[tuple[float, float]]

#: Weight over training as straight lines between (time, weight); the integrals are 5, 2 and 1.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
EPOCHS = 3


def area(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def invert(schedule: Schedule, share: Column) -> Column:
    """The time at which the schedule's integral reaches this share of its whole."""
    whole, before, out = area(schedule), 0.0, F.lit(float(schedule[-1][0]))
    cases = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        here = (t1 - t0) * (w0 + w1) / 2
        rest, slope = share * whole - F.lit(before), (w1 - w0) / (t1 - t0)
        root = F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * rest))
        cases.append((share * whole <= F.lit(before + here), F.lit(t0) + F.when(root > 0, F.least(2 * rest / root, F.lit(t1 - t0))).otherwise(0.0)))
        before += here
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def _size_kernel(texts: pa.Array) -> list[pa.Array]:
    return [pa.array(np.concatenate([c.counts for c in W.chunks(texts)]) if len(texts) else [], pa.int64())]


def with_size(docs: DataFrame, into: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the number of words; null text has none. Where a column is called like `into`, it gets trailing underscores."""
    s, into = free(docs, "s"), free(docs if keep is None else docs.select(*map(col, keep)), into)
    made = with_kernel(docs, _size_kernel, T.StructType([T.StructField("n", T.LongType())]), s, text, keep)
    return made.withColumn(into, F.col(s)["n"]).drop(s)


def targets(docs: DataFrame, size: str, source: Column, schedules: Sequence[Schedule] = SCHEDULES, epochs: int = EPOCHS) -> DataFrame:
    """(src, rank, source_size, target): one row a source, null last; src is the source with a mark, never null.

    Sources are ranked by code point and take the schedules in turn. The sources
    whose cap is smallest for their weight are filled first; each is compared
    with its share of what the ones before it leave.
    """
    weights = [float(area(s)) for s in schedules]
    src = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    sums = docs.groupBy(src.alias("src")).agg(F.sum(col(size)).cast("long").alias("source_size"))
    # one row a source from here on
    rank = F.row_number().over(Window.orderBy(F.col("src") == "", "src")) - 1
    ranked = sums.withColumn("rank", rank).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    ranked = ranked.withColumn("left", left).withColumn("weight_left", weight_left)
    full = F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("w")
    open_ = Window.partitionBy("full").orderBy(F.col("cap") / F.col("w"), "rank")
    ranked = ranked.withColumn("full", full)
    first = lambda c: F.first(c).over(open_)  # noqa: E731  what is left for all sources that are not full
    target = F.when(F.col("full"), F.col("cap")).otherwise(first("left") * F.col("w") / first("weight_left"))
    return ranked.select("src", "rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: str, order: list[str], source: str = "source", schedules: Sequence[Schedule] = SCHEDULES, epochs: int = EPOCHS, whole: bool = False, into: str = "mix") -> DataFrame:
    """Adds a struct (source_size, target, taken, copies) to every row; copies: array of (epoch, words, position).

    whole: a source's last copy is taken wholly or not, whichever comes nearer
    its target; else as many of its words as the target asks for. Null sources
    are one source, the last. Rows without words take no part (no copies). The
    order columns tell rows apart; rows alike in them and in size are
    interchangeable, so reruns agree. Empty docs give an empty result, other
    columns pass through, and one called like `into` makes the struct take
    trailing underscores.
    """
    into = free(docs, into)
    src, at, place = free(docs, "src"), free(docs, "at"), free(docs, "place")
    found = targets(docs, size, col(source), schedules, epochs).withColumnRenamed("src", src).select(src, F.struct("source_size", "target", "rank").alias(at))
    marked = docs.withColumn(src, F.coalesce(F.concat(F.lit("="), col(source)), F.lit("")))
    placed = running(marked, [src], size, order, place).join(found, src)
    n, t = col(size), F.col(at)["target"]

    def copy(e: int) -> Column:
        left = t - (F.col(at)["source_size"] * e + F.col(place))
        if whole:
            words = F.when(left * 2 >= n, n).otherwise(F.lit(0))
        else:
            words = F.greatest(F.lit(0), F.least(n, F.floor(left)))
        middle = F.least(F.lit(1.0), F.try_divide(F.col(at)["source_size"] * e + F.col(place) + words / 2, t))
        time = F.lit(None).cast("double")
        for i, s in enumerate(schedules):
            time = F.when(F.col(at)["rank"] % len(schedules) == i, invert(s, middle)).otherwise(time)
        return F.struct(F.lit(e).alias("epoch"), words.cast("long").alias("words"), time.alias("position"))

    copies = F.filter(F.array(*[copy(e) for e in range(epochs)]), lambda c: c["words"] > 0)
    taken = F.aggregate(copies, F.lit(0).cast("long"), lambda a, c: a + c["words"])
    struct = F.struct(F.col(at)["source_size"].alias("source_size"), t.alias("target"), taken.alias("taken"), copies.alias("copies"))
    return placed.withColumn(into, struct).drop(src, at, place)


def in_order(mixed: DataFrame, order: list[str], into: str = "mix") -> DataFrame:
    """The mix itself: a row for each copy of a document, into its struct (epoch, words, position), sorted by range of position.

    Copies at one position go by the order columns, then by epoch; documents that the mix leaves out have no row.
    """
    c = free(mixed, "copy")
    copies = mixed.withColumn(c, F.explode(F.col(into)["copies"]))
    return copies.sort(F.col(c)["position"], *map(col, order), F.col(c)["epoch"]).withColumn(into, F.col(c)).drop(c)
