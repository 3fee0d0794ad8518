"""Operator 2, embedding near-dedup by collision-counting projections.

Vectors of one label and length are sorted along many random one-dimensional
projections. A pair at the similarity limit lies within a window around either
vector in almost every projection; others do so rarely. Pairs that collide in
a recall-calibrated number of COUNTED projections are verified by their cosine.

To compare near ones only, a group is first cut along other sorted projections,
a level at a time: each node of more than LEAF vectors is cut at the place that
few vectors lie near, and vectors within WIDTH of it go to both sides, so a
query's window is whole on one of them. A node is left whole where every cut
would send more than SPILL of its vectors both ways or part off less than
BALANCE of them. So a level makes SPILL of copies at most, however dense a group
is; a dense group, whose pairs all link, stays one leaf. A leaf of more than
TILE vectors is compared in tiles, in several tasks.

Equal vectors are one class, so copies are not compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.frames import col, least_reached, link_components, small
from nodeloom.llm.store import Scratch

LIMIT = 0.98
LEAF = 1024
TILE = 4096
#: Half widths in standard deviations of a projected pair at the limit: of cuts, of counted windows.
WIDTH, WINDOW = 1.0, 2.5
#: Shares of a node's vectors: that a cut may send both ways, that it must part off.
SPILL, BALANCE = 0.25, 0.2
COUNTED = 16
#: Share of pairs at the limit that the collision count may miss.
MISSED = 1e-3
#: Cuts at most, each along a projection of its own, and how many in a row may part nothing.
DEPTH, IDLE = 24, 3


def directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit directions of the cuts and of the counted projections."""
    d = np.random.default_rng(1000 + dim).normal(size=(DEPTH + COUNTED, max(dim, 1)))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    return d[:DEPTH], d[DEPTH:]


def spread(dim: int, limit: float = LIMIT) -> float:
    """Standard deviation of the projected difference of unit vectors whose cosine is the limit."""
    return math.sqrt(2 * (1 - limit) / max(dim, 1))


def needed() -> int:
    """The collisions that all but MISSED of the pairs at the limit have."""
    p = math.erf(WINDOW / math.sqrt(2))
    tail = 0.0
    for k in range(COUNTED + 1):
        tail += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
        if tail > MISSED:
            return k
    return COUNTED


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_COLUMNS = "vec_id long, label long, dim int, cls long, cuts array<double>, vector array<double>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as unit vectors with their places along the cuts; cls tells different vectors apart."""
    import xxhash

    for batch in batches:
        by_dim: dict[int, list[tuple]] = {}
        for i, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
            if label is None or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            if not np.isfinite(x).all() or not top > 0:
                continue
            x = x / top + 0.0  # no overflow in squares; -0 becomes 0
            by_dim.setdefault(len(x), []).append((i, label, x))
        for dim, rows in by_dim.items():
            ids, labels, xs = zip(*rows, strict=True)
            u = _unit(np.stack(xs))
            cls = [xxhash.xxh64_intdigest(r.tobytes(), seed=hash((dim, int(y))) & 0xFFFFFFFF) - (1 << 63) for r, y in zip(u, labels, strict=True)]
            cuts = u @ directions(dim)[0].T
            one = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(np.full(len(ids), dim, np.int32)), pa.array(cls, pa.int64()), one(cuts), one(u)], names=["vec_id", "label", "dim", "cls", "cuts", "vector"])


def collisions(p: np.ndarray, q: np.ndarray, w: float) -> np.ndarray:
    """In how many projections (columns) each row of q lies within w of each row of p."""
    count = np.zeros((len(p), len(q)), np.uint8)
    edge = np.zeros((len(p), len(q) + 1), np.int8)
    rows = np.arange(len(p))
    for k in range(p.shape[1]):
        order = np.argsort(q[:, k], kind="stable")
        line = q[order, k]
        edge[:] = 0
        np.add.at(edge, (rows, np.searchsorted(line, p[:, k] - w, "left")), 1)  # the window opens
        np.add.at(edge, (rows, np.searchsorted(line, p[:, k] + w, "right")), -1)
        count[:, order] += np.cumsum(edge, 1, dtype=np.int8)[:, :-1].view(np.uint8)
    return count


def _tile(limit: float, least: int):
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        cls, copies, both = (table.column(c).to_numpy() for c in ("cls", "copies", "both"))
        block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        p, w = x @ directions(x.shape[1])[1].T, WINDOW * spread(x.shape[1], limit)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
        for s in range(0, len(left), 256):
            rows = left[s : s + 256]
            passed = collisions(p[rows], p[right], w) >= least
            if i == j:
                passed &= rows[:, None] < right[None, :]
            # of the leaves that a pair is in together only the one without a common right copy answers for it
            passed &= (both[rows][:, None] & both[right][None, :]) == 0
            some = np.flatnonzero(passed.any(0))
            if not len(some):
                continue
            if passed.sum() * 16 > len(rows) * len(some):
                a, b = np.nonzero(passed[:, some] & (x[rows] @ x[right[some]].T >= limit))
                a, b = rows[a], right[some[b]]
            else:
                a, b = np.nonzero(passed)
                a, b = rows[a], right[b]
                ok = np.concatenate([np.einsum("ij,ij->i", x[a[r : r + (1 << 15)]], x[b[r : r + (1 << 15)]]) >= limit for r in range(0, len(a), 1 << 15)])
                a, b = a[ok], b[ok]
            links += np.bincount(a, weights=copies[b], minlength=len(cls)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(cls)).astype(np.int64)
            root = least_reached(len(cls), *np.unique(np.stack([root[a], root[b]]), axis=1))[root]
        on = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(cls[on]), pa.array(links[on]), pa.array(cls[root[on]])], schema=schema)

    return run


def leaves(one: DataFrame, limit: float, scratch: Scratch) -> DataFrame:
    """(node, dim, cls, both): the leaves that each class is in; both: bits of the cuts where it is a right copy."""
    rows = scratch.keep(one.select(F.xxhash64("label", "dim").alias("node"), "dim", "cls", F.lit(0).cast("long").alias("both"), "cuts"), "root")
    width = F.lit(WIDTH) * F.sqrt(F.lit(2 * (1 - limit)) / F.col("dim"))
    idle = 0
    for b in range(DEPTH):
        x = F.col("cuts")[b]
        bins = rows.groupBy("node", "dim", F.floor(x / (width / 2)).alias("bin")).agg(F.count("*").alias("n"))
        # the line of a node is two thousand bins or so; a cut at the end of a bin has two bins of its width on each side
        along = Window.partitionBy("node").orderBy("bin")
        sums = bins.select("*", F.sum("n").over(Window.partitionBy("node")).alias("all"), F.sum("n").over(along).alias("left"), F.sum("n").over(along.rangeBetween(-1, 2)).alias("near"))
        part = F.least(F.col("left"), F.col("all") - F.col("left"))
        fine = (F.col("all") > LEAF) & (F.col("near") <= F.col("all") * SPILL) & (part >= F.col("all") * BALANCE)
        cuts = scratch.keep(sums.where(fine).groupBy("node", "dim").agg(F.max_by("bin", F.struct(part - F.col("near"), "bin")).alias("bin")).select("node", ((F.col("bin") + 1) * width / 2).alias("cut")), "cuts")
        if not cuts.take(1):
            idle += 1
            if idle == IDLE or not rows.groupBy("node").count().where(F.col("count") > LEAF).take(1):
                break
            continue
        idle = 0
        low, high = x < F.col("cut") + width, x >= F.col("cut") - width
        side = lambda goes, mark, both: F.when(goes, F.struct(F.xxhash64("node", F.lit(mark)).alias("node"), both.alias("both")))
        stay = F.when(F.col("cut").isNull(), F.struct("node", "both"))
        places = F.array_compact(F.array(stay, side(low, 2 * b, F.col("both")), side(high, 2 * b + 1, F.when(low, F.col("both").bitwiseOR(F.lit(1 << b))).otherwise(F.col("both")))))
        after = rows.join(small(cuts), "node", "left").select(F.explode(places).alias("at"), "dim", "cls", "cuts").select("at.node", "dim", "cls", "at.both", "cuts")
        after = scratch.keep(after, "level")
        scratch.drop(rows, cuts)
        rows = after
    return rows.drop("cuts")


def near_links(spark: SparkSession, vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Vectors that are null, empty, zero or hold null or non-finite components,
    and those without a label, link with nothing. Vectors of different lengths
    are not compared. Repeated rows are equal vectors, linked with each other;
    vectors at a cut go to both sides, so ties part nothing. Rows without a
    vec_id can link but never name a component. Extra columns are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(spark, "neighbours")
    source = vectors.select(col("vec_id").cast("long").alias("vec_id"), col("label").cast("long").alias("label"), col("embedding").cast("array<double>").alias("embedding"))
    read = scratch.keep(source.mapInArrow(_read, _COLUMNS), "unit")
    classes = scratch.keep(read.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    one = read.dropDuplicates(["cls"]).join(classes, "cls").select("label", "dim", "cls", "copies", "cuts", "vector")
    one = scratch.keep(one, "one")
    placed = leaves(one, limit, scratch)
    sizes = scratch.keep(placed.groupBy("node").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")), "sizes")
    tiled = placed.join(small(sizes), "node").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).join(one.select("cls", "copies", "vector"), "cls")
    found = tiled.select("node", "i", "j", "block", "cls", "copies", "both", "vector").groupBy("node", "i", "j").applyInArrow(_tile(limit, needed()), "cls long, links long, root long")
    found = scratch.keep(found, "links")

    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = link_components(spark, found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "cls")
    named = classes.join(counts, "cls", "left").join(roots, "cls", "left").select("cls", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    named = scratch.keep(named, "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    full = read.select("vec_id", "cls").join(named.join(least, "root").select("cls", "n_links", "component_id"), "cls").select("vec_id", "n_links", "component_id")
    bad = source.select("vec_id", "label", "embedding").where(~_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _valid():
    """The rows that _read takes."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & some, F.lit(False))
