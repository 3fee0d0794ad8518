"""Operator 8, substring dedup by de Bruijn compaction.

Edges are token k-mers: windows of WINDOW words. Every window has an anchor,
the least-hashed SEED-word gram inside it (leftmost of equals), so equal
windows have equal anchors. The windows that one anchor occurrence owns are
consecutive; together they are one compacted path of the graph, hashed whole.

1. Paths are dealt by anchor. A path that a smaller doc_id also holds is
   repeated as a whole. An anchor that smaller documents hold with another path
   is a branching node; the paths that meet there, one holder of each, go on.
2. Branching paths are opened into their windows at their source coordinates,
   and windows are compared one by one. Both steps compare two independent
   64-bit hashes, of the anchor and of the whole content.
3. The repeated spans of a document, in source coordinates, mark its words, there
   and where the document has the same windows again: a path or window that a
   document holds many times is dealt once.

Nonbranching repeats (most of all repeats) thus cost one row for several
windows, and windows are only made where documents part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm import words as W
from nodeloom.llm.frames import col, with_kernel
from nodeloom.llm.store import Scratch

WINDOW = 13
SEED = 5


def _tags(c: W.Chunk, h: np.ndarray) -> np.ndarray:
    """20 bits of each document's whole sequence: they tell apart texts under one doc_id."""
    return (W.fingerprint(h, c.edge)[0] >> np.uint64(44)).astype(np.int64)


def _paths(c: W.Chunk, h: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor word, first window, number of windows, anchor hash) of every path of a chunk, in order."""
    at = c.windows(window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    g = W.ngrams(h, seed)
    best, where = g[at], at.copy()
    for j in range(1, window - seed + 1):
        x = g[at + j]
        less = x < best
        best = np.where(less, x, best)
        where[less] = at[less] + j
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)]))
    return where[new], at[new], np.diff(np.append(new, len(at))), best[new]


def _path_hashes(h: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = h[first].copy()
    q = np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(1, int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > j)
        out[on] = out[on] * q + h[first[on] + j]
    return W.mix(out + lengths.astype(np.uint64))


def _place(word: np.ndarray, tag: np.ndarray, ahead: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A path's coordinates in one number: anchor word, text tag, windows before the anchor word, windows - 1."""
    return (word << 28) | (tag << 8) | (ahead << 4) | (windows - 1)


def _emit_paths(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for c in W.chunks(batch.column("t")):
                h = c.hashes()
                anchor, first, n, mark = _paths(c, h, window, seed)
                doc = np.searchsorted(c.edge, anchor, "right") - 1
                place = _place(anchor - c.edge[doc], _tags(c, h)[doc], anchor - first, n)
                key = W.mix(_path_hashes(h, first, n + window - 1) + ((anchor - first) * 64 + n).astype(np.uint64))
                once = np.unique(W.mix(W.mix(mark + doc.astype(np.uint64)) ^ key), return_index=True)[1]
                mark, key, doc, place = mark[once], key[once], doc[once], place[once]
                out = pa.RecordBatch.from_arrays([pa.array(W.signed(mark)), pa.array(W.signed(key)), pa.array(ids[c.first + doc]), pa.array(place)], names=["anchor", "path", "doc_id", "place"])
                yield out.filter(pa.array(known[c.first + doc]))

    return run


def _emit_windows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            places = batch.column("places")
            for c in W.chunks(batch.column("t")):
                h = c.hashes()
                tags = _tags(c, h)
                g = W.ngrams(h, seed)
                for i in range(c.n):
                    p = np.unique(places[c.first + i].values.to_numpy(zero_copy_only=False))
                    p = p[((p >> 8) & 0xFFFFF) == tags[i]]
                    if not len(p):
                        continue
                    word, ahead, n = p >> 28, (p >> 4) & 15, (p & 15) + 1
                    starts = np.repeat(word - ahead, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found = W.ngrams(h[c.edge[i] : c.edge[i + 1]], window)[starts]
                    once = np.unique(found, return_index=True)[1]
                    anchors, found, starts = np.repeat(g[c.edge[i] + word], n)[once], found[once], starts[once]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(W.signed(anchors)), pa.array(W.signed(found)), pa.array(np.full(len(starts), ids[c.first + i])), pa.array(_place(starts, np.full(len(starts), tags[i]), np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)))],
                        names=["anchor", "path", "doc_id", "place"],
                    )

    return run


def _smaller(rows: DataFrame) -> DataFrame:
    """Adds whether a smaller doc_id has the same path, and the same anchor."""
    same, meet = Window.partitionBy("anchor", "path"), Window.partitionBy("anchor")
    return rows.withColumn("holder", F.min("doc_id").over(same)).withColumn("least", F.min("doc_id").over(meet)).withColumn("repeated", F.col("holder") < F.col("doc_id")).withColumn("parts", F.max(~F.col("repeated") & (F.col("least") < F.col("doc_id"))).over(meet))


def repeated_spans(spark: SparkSession, texts: DataFrame, scratch: Scratch, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, places): the paths and windows of each document that a smaller doc_id holds too; texts: doc_id, t."""
    paths = texts.mapInArrow(_emit_paths(window, seed), "anchor long, path long, doc_id long, place long")
    found = _smaller(paths).where("repeated or parts").select("doc_id", "place", "repeated")
    found = scratch.keep(found, "paths")
    branching = found.where("not repeated").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    opened = texts.join(branching, "doc_id").mapInArrow(_emit_windows(window, seed), "anchor long, path long, doc_id long, place long")
    same = Window.partitionBy("anchor", "path")
    single = opened.withColumn("holder", F.min("doc_id").over(same)).where("holder < doc_id").select("doc_id", "place")
    spans = found.where("repeated").select("doc_id", "place").union(single)
    return scratch.keep(spans.groupBy("doc_id").agg(F.collect_list("place").alias("places")), "spans")


FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _strip(window: int, as_hash: bool):
    """n_words, n_removed and the kept words joined by spaces, or their SHA-256."""

    def kernel(rows: pa.Array) -> list[pa.Array]:
        rows = rows if isinstance(rows, pa.StructArray) else rows.combine_chunks()
        total, gone, kept = [], [], []
        texts, places = rows.field("t").cast(pa.large_binary()), rows.field("places")
        for at, (t, has) in enumerate(zip(texts, places.is_valid().to_pylist(), strict=True)):
            found = (t.as_py() or b"").split()
            total.append(len(found))
            keep = found
            if has and len(found) >= window:
                c = next(W.chunks(pa.array([t.as_py()], pa.large_binary())))
                p = places[at].values.to_numpy(zero_copy_only=False)
                h = c.hashes()
                p = p[((p >> 8) & 0xFFFFF) == _tags(c, h)[0]]
                windows = W.ngrams(h, window)
                repeated = np.concatenate([windows[((p >> 28) - ((p >> 4) & 15))[(p & 15) >= j] + j] for j in range(16)])
                covered = W.flags_cover(len(found), np.flatnonzero(np.isin(windows, repeated)), window)
                keep = list(compress(found, ~covered))
            gone.append(len(found) - len(keep))
            joined = b" ".join(keep)
            kept.append(hashlib.sha256(joined).hexdigest() if as_hash else joined)
        return [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string() if as_hash else pa.binary()).cast(pa.string())]

    return kernel


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED, text: str = "text", as_hash: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: words covered by a window that a smaller doc_id holds too go.

    Windows are judged on the input. Null and empty texts have no words. Rows
    of one doc_id do not remove each other's words, so repeated rows stay alike.
    A row without a doc_id loses no words and takes none from others. Extra
    columns are ignored; empty docs give an empty result.
    """
    scratch = Scratch(spark, "substrings")
    texts = docs.select(col("doc_id").cast("long").alias("doc_id"), col(text).alias("t"))
    spans = repeated_spans(spark, texts, scratch, window, seed)
    joined = texts.join(spans, "doc_id", "left").select("doc_id", F.struct("t", "places").alias("row"))
    return with_kernel(joined, _strip(window, as_hash), FIELDS, "made", "row", ["doc_id"]).select("doc_id", "made.*")
