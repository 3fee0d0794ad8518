"""Operator 10, n-gram Jaccard join by multiple global orders.

A document's set holds its distinct K-word shingles (fewer words: the whole
sequence as one). Sets of n and m shingles with Jaccard >= t share c tokens
among the first n - ceil(t n) + c of either under *every* total order of all
tokens, for any c up to their overlap. The first order puts frequent tokens last
(a fixed-size table of counts over the whole corpus) and breaks ties by a hash,
the others are hashes. A pair must pass the filter of every order before a whole
set is read.

1. Equal sets become one class, so copies cost one row.
2. Tokens of the first order's prefixes are posted and dealt by token; a token
   that only one class has is dropped there. Tokens that the table calls frequent
   are known to be shared and skip that step.
3. Stars: within a token and a size band, each class is compared with one pivot
   only, which differs between a few kinds of tokens.
   The classes' prefixes under the other orders are read; pairs that pass all
   are verified by their sets. Pairs that those prefixes, being samples, show as
   alike (LOOSE) gather classes into clusters, which only decides whether 4 or 5
   compares a pair. Tokens within one cluster drop out.
4. Tiles: in a cluster that links do not connect yet, every class outside the
   largest component is compared with every class, in tiles of TILE tokens a side. A tile
   counts the common prefix tokens under every order, then the intersections of
   the sets whose pairs pass, and returns a spanning set of links.
5. Exhaustive: for tokens whose classes lie in several clusters still, all pairs
   of different clusters with a possible size ratio that meet in c tokens, at
   places in the order that leave room for the overlap, go through the other
   orders' filters, then are verified.

Links between different texts are all looked for, yet a group of g near copies
lists about g pairs. Verified links feed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from nodeloom.llm import words as W
from nodeloom.llm.frames import col, least_reached, link_components, small, with_kernel
from nodeloom.llm.store import Scratch

K = 5
#: Similarity in hundredths.
LEAST = 80
#: Seeds of the orders; the first puts rare tokens first.
ORDERS = (0, 0x51ED27, 0x7F4A91)
#: Prefix tokens that a pair must share (c); fewer where a set is smaller.
SHARED = 4
#: One in so many tokens must be shared under the other orders, if that is more.
PART = 10
#: Pivots that a class meets in each of its tokens' bands.
PIVOTS = 4
#: Share of the other orders' prefixes, in hundredths, that gathers classes into clusters; tokens a side of a tile.
LOOSE, TILE = 65, 1 << 19
#: Tokens and outer sets that a tile counts at once.
STRIPE, STRIP = 4096, 256
#: Cells of the table of token counts; its size does not follow the input.
COUNT_CELLS = 1 << 20
#: Tokens gathered before their repeats are counted, and the repeats that are: rarer ones only sort as if they were unique.
GATHER, REPEATS = 4_000_000, 2
#: Tokens counted so often (a power of two) are taken as shared without a look.
HOT = 10
#: Bits of the table that says which rows a reading wants (2 MB, whatever the input).
WANTED_BITS = 24


def shingle_sets(c: W.Chunk, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, ascending in each, and where each document's begin."""
    h, doc = c.hashes(), c.doc
    at = c.windows(k)
    x, d = (W.ngrams(h, k)[at], doc[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    short = np.flatnonzero((c.counts > 0) & (c.counts < k))
    if len(short):
        whole = []
        for i in short:  # fewer than k words each
            part = h[c.edge[i] : c.edge[i + 1]]
            whole.append(W.ngrams(part, len(part))[0])
        x, d = np.concatenate([x, np.array(whole, np.uint64)]), np.concatenate([d, short])
    return W.unique_per_doc(d, x, c.n)


def rarity(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The power of two of the repeats counted of each token."""
    return counts[(x >> np.uint64(40)).astype(np.int64) & (COUNT_CELLS - 1)]


def _ranks(x: np.ndarray, counts: np.ndarray | None, seed: int) -> np.ndarray:
    """Sort keys of a global order: a hash, or where counts are given rarer tokens first, then a hash."""
    h = W.mix(x ^ np.uint64(seed))
    return h if counts is None else (rarity(x, counts).astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))


def overlap(n: int, least: int) -> int:
    """The least overlap of a set of n tokens with a similar one."""
    return -(-least * n // 100)


def further(n: int, least: int) -> int:
    """The tokens (c) that a set of n must share under the other orders, with sets that ask for no fewer."""
    return min(overlap(n, least), max(SHARED, n // PART))


def prefix(x: np.ndarray, least: int, c: int, seed: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The first tokens under an order, unordered where it is a mere hash."""
    p, keys = len(x) - overlap(len(x), least) + c, _ranks(x, counts, seed)
    some = np.argpartition(keys, p - 1)[:p] if 0 < p < len(x) else np.arange(len(x))
    return x[some] if counts is None else x[some[np.argsort(keys[some])]]


def _count_tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_CELLS, np.int64)

        def take(parts: list[np.ndarray]) -> None:
            tokens = np.sort(np.concatenate(parts))
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            n = np.diff(np.append(first, len(tokens)))
            many = n >= REPEATS
            cells = (tokens[first[many]] >> np.uint64(40)).astype(np.int64) & (COUNT_CELLS - 1)
            np.add.at(total, cells, n[many])

        parts: list[np.ndarray] = []
        seen: set[int] = set()
        have = 0
        for batch in batches:
            for c in W.chunks(batch.column("t"), lower=True):
                x, edge = shingle_sets(c, k)
                prints = W.fingerprint(x, edge)[0]
                for i in range(c.n):
                    if int(prints[i]) not in seen:
                        seen.add(int(prints[i]))
                        parts.append(x[edge[i] : edge[i + 1]])
                        have += int(edge[i + 1] - edge[i])
                if have >= GATHER:
                    take(parts)
                    parts, have, seen = [], 0, set()
        if have:
            take(parts)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["cell", "n"])

    return run


def token_counts(texts: DataFrame, k: int) -> np.ndarray:
    """Rarity classes (log2 of the repeats counted) by cell, over all documents; COUNT_CELLS entries."""
    rows = texts.select("t").mapInArrow(_count_tokens(k), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").selectExpr("cell", "cast(log2(n) as tinyint) n")
    out = np.zeros(COUNT_CELLS, np.uint8)
    found = rows.toArrow()  # COUNT_CELLS rows at most
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


_LONGS, _INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
_CLASS = [T.StructField("n", T.LongType()), T.StructField("fp", T.LongType())]
POSTED = T.StructType([*_CLASS, T.StructField("tokens", _LONGS), T.StructField("rare", _INTS)])
MARKS = T.StructType([*_CLASS, T.StructField("p1", _INTS), T.StructField("p2", _INTS)])
SETS = T.StructType([*_CLASS, T.StructField("tokens", _LONGS)])


def _join(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _kernel(k: int, columns):
    """n, fp and what columns makes of each text's set: (list of arrays, Arrow type) by text."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        n, fp, made = [], [], []
        for c in W.chunks(texts, lower=True):
            x, edge = shingle_sets(c, k)
            n.append(np.diff(edge))
            fp.append(W.fingerprint(x, edge)[0])
            made += [columns(x[edge[i] : edge[i + 1]], int(fp[-1][i])) for i in range(c.n)]
        out = [pa.array(_join(n, np.int64)), pa.array(W.signed(_join(fp, np.uint64)))]
        for parts in zip(*made, strict=True) if made else ():
            edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            out.append(W.lists(_join(parts, parts[0].dtype), edge, pa.from_numpy_dtype(parts[0].dtype)))
        return out

    return kernel


def _whole(k: int):
    return _kernel(k, lambda x, fp: (W.signed(x),))


def _marks(k: int, least: int):
    """The prefixes under the further orders, tokens cut to 32 bits (see passes)."""

    def cut(x: np.ndarray, seed: int) -> np.ndarray:
        return np.unique(prefix(x, least, further(len(x), least), seed).astype(np.uint32)).view(np.int32)

    return _kernel(k, lambda x, fp: (cut(x, ORDERS[1]), cut(x, ORDERS[2])))


def _posted(k: int, counts: np.ndarray, least: int):
    """The set's prefix under the first order and how many of its tokens, the first ones, are rare (in a list of one); a set that the task has had already comes without it."""
    seen: set[int] = set()

    def columns(x: np.ndarray, fp: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(x) or fp in seen:
            return np.zeros(0, np.int64), np.zeros(1, np.int32)
        seen.add(fp)
        found = prefix(x, least, min(SHARED, overlap(len(x), least)), ORDERS[0], counts)
        return W.signed(found), np.array([np.count_nonzero(rarity(found, counts) < HOT)], np.int32)

    return _kernel(k, columns)


def _stripes(x: np.ndarray, xi: np.ndarray, rows: int, y: np.ndarray, yi: np.ndarray, columns: int) -> np.ndarray:
    """How many tokens each of some sets has in common with each of others; x, y: their tokens, xi, yi: whose they are."""
    both = np.intersect1d(x, y)
    common = np.zeros((rows, columns), np.float32)
    for s in range(0, len(both), STRIPE):
        stripe, dense = both[s : s + STRIPE], []
        for v, i, n in ((x, xi, rows), (y, yi, columns)):
            at = np.minimum(np.searchsorted(stripe, v), len(stripe) - 1)
            hit = stripe[at] == v
            m = np.zeros((n, len(stripe)), np.float32)
            m[i[hit], at[hit]] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    return common


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    sides = []
    for parts in (left, right):
        sides += [_join(parts, np.uint64), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), len(parts)]
    return _stripes(*sides)


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of sets that are similar: the orders' filters are intersected, then what passes is counted."""
    n, m = (np.array([len(p) for p in parts], np.int32) for parts in (left, right))
    passed = (100 * n[:, None] >= least * m[None, :]) & (100 * m[None, :] >= least * n[:, None])
    need = [np.array([further(int(x), least) for x in sizes], np.float32) for sizes in (n, m)]
    for seed in ORDERS:
        if not passed.any():
            break
        common = _common(*([prefix(x, least, further(len(x), least), seed) for x in parts] for parts in (left, right)))
        passed &= common >= np.minimum(need[0][:, None], need[1][None, :])
    rows, columns = np.flatnonzero(passed.any(1)), np.flatnonzero(passed.any(0))
    if not len(rows):
        return rows, columns
    common = _common([left[i] for i in rows], [right[j] for j in columns])
    i, j = np.nonzero(passed[np.ix_(rows, columns)] & ((100 + least) * common >= least * (n[rows][:, None] + m[columns][None, :]).astype(np.float32)))
    return rows[i], columns[j]


def _tile(least: int):
    """Links between the outer and the other sets of a tile, as (a, b); each set with the least one it reaches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        outer = table.column("outer").to_numpy(zero_copy_only=False)
        fp, sets = table.column("fp").to_numpy(), table.column("tokens").combine_chunks()
        values, edge = sets.values.to_numpy(zero_copy_only=False).view(np.uint64), sets.offsets.to_numpy()
        left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
        if not len(left) or not len(right):
            return schema.empty_table()
        parts = [values[edge[i] : edge[i + 1]] for i in range(len(fp))]
        names, at = np.unique(fp, return_inverse=True)
        root = np.arange(len(names))
        for s in range(0, len(left), STRIP):
            some = left[s : s + STRIP]
            i, j = similar_pairs([parts[x] for x in some], [parts[x] for x in right], least)
            a, b = np.unique(np.stack([root[at[some[i]]], root[at[right[j]]]]), axis=1)
            root = least_reached(len(names), a, b)[root]
        apart = root != np.arange(len(names))
        return pa.Table.from_arrays([pa.array(names[apart]), pa.array(names[root[apart]])], schema=schema)

    return run


class _Links:
    """From candidate pairs to verified links."""

    def __init__(self, texts: DataFrame, classes: DataFrame, scratch: Scratch, k: int, least: int):
        self.texts, self.classes, self.scratch, self.k, self.least = texts, classes, scratch, k, least

    def read(self, names: DataFrame, kernel, fields: T.StructType, what: str) -> DataFrame:
        """What the kernel makes of one row of each named class, and of a few rows more.

        A table of bits, of one size for any input, says which rows are wanted, so the texts are not shuffled. Repeated
        rows come as often as they are there.
        """
        bit = F.pmod("key", F.lit(1 << WANTED_BITS))
        wanted = self.classes.join(small(names), "fp", "left_semi").select(F.shiftright(bit, 15).alias("part"), bit.bitwiseAND(F.lit(32767)).alias("at"))
        bits = self.scratch.keep(wanted.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")), f"{what}-bits")
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).bitwiseAND(F.lit(4095)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        chosen = self.texts.withColumn("part", F.shiftright(bit, 15)).join(F.broadcast(bits), "part").where(F.expr("0") != byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(key, 8) as int))")))
        found = self.scratch.keep(with_kernel(chosen.select("t"), kernel, fields, "s", "t", []).select("s.*"), what)
        self.scratch.drop(bits)
        return found

    def near(self, pairs: DataFrame, what: str) -> DataFrame:
        """(a, b, loose, passes) of pairs; passes: so many tokens are shared under every further order."""
        pairs = self.scratch.keep(pairs, f"{what}-pairs")
        names = self.scratch.keep(_names(pairs), f"{what}-names")
        marks = self.read(names, _marks(self.k, self.least), MARKS, f"{what}-marks")
        one, two = (marks.select(F.col("fp").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("n", "p1", "p2")]) for s in ("a", "b"))
        n = {s: F.ceil(F.lit(self.least) * F.col(f"n{s}") / 100) for s in ("a", "b")}
        further_ = {s: F.least(n[s], F.greatest(F.lit(SHARED), F.floor(F.col(f"n{s}") / PART))) for s in ("a", "b")}
        long = {s: F.least(F.col(f"n{s}"), F.col(f"n{s}") - n[s] + further_[s]) for s in ("a", "b")}
        passes, common, sizes = F.lit(True), F.lit(0), F.lit(0)
        for p in ("p1", "p2"):
            both, held = F.size(F.array_intersect(f"{p}a", f"{p}b")), {s: F.size(f"{p}{s}") for s in ("a", "b")}
            # tokens of one set that are alike in 32 bits may hide as many
            passes &= both >= F.least(further_["a"], further_["b"]) - (long["a"] - held["a"]) - (long["b"] - held["b"])
            common, sizes = common + both, sizes + F.least(held["a"], held["b"])
        passes &= (F.col("na") * 100 >= F.col("nb") * self.least) & (F.col("nb") * 100 >= F.col("na") * self.least)
        judged = self.scratch.keep(pairs.join(one, "a").join(two, "b").select("a", "b", (common * 100 >= sizes * LOOSE).alias("loose"), passes.alias("passes")), f"{what}-judged")
        self.scratch.drop(pairs, names, marks)
        return judged

    def verified(self, pairs: DataFrame, what: str) -> DataFrame:
        """(a, b) of the pairs whose whole sets are similar."""
        names = self.scratch.keep(_names(pairs), f"{what}-named")
        sets = self.read(names, _whole(self.k), SETS, f"{what}-sets")
        x, y = sets.select(F.col("fp").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("fp").alias("b"), F.col("tokens").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        links = self.scratch.keep(pairs.select("a", "b").join(x, "a").join(y, "b").where(common * 100 >= (F.size("x") + F.size("y") - common) * self.least).select("a", "b"), what)
        self.scratch.drop(names, sets)
        return links

    def tiles(self, placed: DataFrame) -> DataFrame:
        """(a, b) of a spanning set of the links that clusters have between their components; placed: fp, cluster, root."""
        sizes = placed.groupBy("cluster", "root").agg(F.count("*").alias("n"))
        main = self.scratch.keep(sizes.groupBy("cluster").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1"), "main")
        open_ = self.scratch.keep(placed.join(main, "cluster").select("fp", "cluster", (F.col("root") != F.col("main")).alias("outer")), "open")
        sets = self.read(open_.select("fp"), _whole(self.k), SETS, "tile-sets")
        side = lambda tokens: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(tokens), F.lit(0)) / TILE)).cast("int")
        sides = open_.join(sets.select("fp", "n"), "fp").groupBy("cluster").agg(side("n").alias("n_all"), side(F.when(F.col("outer"), F.col("n"))).alias("n_out"))
        sides = self.scratch.keep(sides, "sides")
        h = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = open_.join(sides, "cluster")
        rows = dealt.where("outer").select("fp", "cluster", "outer", h("n_out").alias("i"), every("n_all").alias("j"))
        columns = dealt.select("fp", "cluster", F.lit(False).alias("outer"), every("n_out").alias("i"), h("n_all").alias("j"))
        found = self.scratch.keep(rows.union(columns).join(sets.select("fp", "tokens"), "fp").groupBy("cluster", "i", "j").applyInArrow(_tile(self.least), "a long, b long"), "tiles")
        self.scratch.drop(main, open_, sets, sides)
        return found


def _names(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()


def jaccard_groups(spark: SparkSession, docs: DataFrame, k: int = K, least: int = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Null and empty texts have an empty set and their own doc_id as component.
    Repeated rows are one class. Rows of one doc_id with several texts are one
    document: what is linked with one text is linked with all. A null doc_id never names a component: a class without
    any other doc_id gets a null component unless it is linked. Extra columns
    are ignored. Sets are equal when size and 64-bit fingerprint are.
    """
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(col("doc_id").alias("doc_id"), col(text).alias("t")).withColumn("key", F.xxhash64("doc_id", "t"))
    counts = token_counts(texts, k)
    made = scratch.keep(with_kernel(texts, _posted(k, counts, least), POSTED, "s", "t", ["doc_id", "key"]).select("doc_id", "key", "s.*"), "prefixes")
    rows = made.select("doc_id", "n", "fp")
    classes = scratch.keep(made.where("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key")), "classes")
    links_of = _Links(texts, classes, scratch, k, least)

    # postings: one row for a class, token and task; rare tokens that only one class has go
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / least))).cast("int").alias("band")
    of_token = Window.partitionBy("token")
    posted = made.select("fp", "n", F.posexplode("tokens").alias("at", "token"), F.col("rare")[0].alias("rare"))
    rare = posted.where("at < rare").drop("rare").withColumn("lo", F.min("fp").over(of_token)).withColumn("hi", F.max("fp").over(of_token)).where("lo <> hi")
    columns = ["token", "fp", "n", "at", band]
    shared = scratch.keep(rare.select(columns).distinct().union(posted.where("at >= rare").select(columns).distinct()), "shared")
    need = lambda n: F.least(F.lit(SHARED), F.ceil(n * least / 100))

    pivots = shared.groupBy("token", "band").agg(F.min(F.struct(F.xxhash64("fp", F.pmod("token", F.lit(PIVOTS))).alias("h"), "fp"))["fp"].alias("a"))
    pivots = scratch.keep(pivots, "pivots")
    stars = shared.join(pivots, ["token", "band"]).where("fp <> a").groupBy("a", F.col("fp").alias("b"), "n").count()
    judged = links_of.near(stars.where(F.col("count") >= F.least(F.lit(2), need(F.col("n")))).select("a", "b"), "stars")
    strong = links_of.verified(judged.where("passes"), "stars")
    clusters = link_components(spark, judged.where("loose").select("a", "b").union(strong), scratch).select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    roots = link_components(spark, strong, scratch).select(F.col("node").alias("fp"), "root")
    tiled = links_of.tiles(clusters.join(roots, "fp", "left").select("fp", "cluster", F.coalesce("root", "fp").alias("root")))

    # postings with their clusters, of tokens that several clusters have
    placed = scratch.keep(shared.join(small(clusters), "fp", "left").select("token", "fp", "n", "at", "band", F.coalesce("cluster", "fp").alias("cluster")), "placed")
    several = placed.groupBy("token").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo <> hi").select("token")
    mixed = scratch.keep(placed.join(scratch.keep(several, "several"), "token", "left_semi"), "mixed")
    scratch.drop(shared, pivots, placed)
    one, two = mixed.alias("one"), mixed.select("token", "fp", "n", "at", "cluster", F.col("band").alias("own"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")).alias("two")
    near = (F.col("one.cluster") != F.col("two.cluster")) & (F.col("one.n") * 100 >= F.col("two.n") * least) & (F.col("two.n") * 100 >= F.col("one.n") * least)
    # no more tokens can be common than stand before a common one in both, and behind it
    most = 1 + F.least("one.at", "two.at") + F.least(F.col("one.n") - F.col("one.at"), F.col("two.n") - F.col("two.at")) - 1
    near &= most * (100 + least) >= (F.col("one.n") + F.col("two.n")) * least
    near &= (F.col("two.own") != F.col("two.band")) | (F.col("one.fp") < F.col("two.fp"))  # within a band each pair once
    rest = one.join(two, (F.col("one.token") == F.col("two.token")) & (F.col("one.band") == F.col("two.band")) & near).groupBy(F.col("one.fp").alias("a"), F.col("two.fp").alias("b"), F.least("one.n", "two.n").alias("n")).count()
    judged = links_of.near(rest.where(F.col("count") >= need(F.col("n"))).select("a", "b"), "rest")
    rest = links_of.verified(judged.where("passes"), "rest")
    owned = rows.where("n > 0 and doc_id is not null")
    several = owned.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    same = owned.join(several, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    roots = link_components(spark, strong.union(tiled).union(rest).union(same), scratch).withColumnRenamed("node", "fp")

    # rep ids of classes name the components
    named = classes.join(roots, "fp", "left").select("fp", "n", "rep", F.coalesce("root", "fp").alias("root"))
    least_id = named.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least_id"))
    named = scratch.keep(named.join(least_id, "root", "left").select("fp", "n", F.coalesce("least_id", "rep").alias("component_id")), "named")
    full = rows.where("n > 0").join(named, ["fp", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
