"""Operator 5, toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of character n-grams (bytes of the lower-cased word with
boundary marks); its vector is the mean of their hashed embeddings. A document's
vector is the mean over its distinct words and NEUTRAL words of vector zero, so
that no single word of a short text outweighs the rest; a softmax layer over it
gives the score. Embeddings and softmax learn together. Misspellings and
inflections that training never saw share n-grams with words that it saw.

The classifier is fitted on a bounded sample of labelled rows: FIT_ROWS of each
label by a hash of doc_id, whatever the length of their texts, one row of each
doc_id. Spark sends the driver each sampled text's distinct words; driver memory
goes with these, not with the texts. Every whole text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm import words as W
from nodeloom.llm.frames import col, free, with_kernel

FIT_ROWS = {1: 2_000, 0: 4_000}
#: Words whose n-grams are made or summed at a time while training.
BLOCK_WORDS = 1 << 15
SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIM = 8
EPOCHS = 100
#: Words of vector zero that every document has beside its own.
NEUTRAL = 50
#: The embedding of an n-gram learns by its frequency to the power of this (less than 0: rare ones learn faster).
EVEN = -0.5
#: Step of the softmax layer.
LAYER_RATE = 0.1


def vocabulary(c: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First occurrence of each distinct word of a chunk, and each word's number among them."""
    _, first, number = np.unique(c.hashes(), return_index=True, return_inverse=True)
    return c.starts[first], c.ends[first], number


def subwords(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram bucket, word number) of the words at these spans, by word; every word has one at least."""
    n = ends - starts + 2
    edge = np.concatenate([[0], np.cumsum(n)])
    marked = np.full(edge[-1], 1, np.uint64)  # 1 marks both ends
    inner = np.ones(edge[-1], bool)
    inner[edge[:-1]] = inner[edge[1:] - 1] = False
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)])[:-1], ends - starts) + np.arange(int((ends - starts).sum()))
    marked[inner] = b[at].astype(np.uint64) + np.uint64(2)
    word = np.repeat(np.arange(len(n), dtype=np.int32), n)
    buckets, owner = [], []
    for size in SIZES:
        if len(marked) < size:
            continue
        h = W.ngrams(marked, size, seed=size)
        ok = word[: len(h)] == word[size - 1 :]
        buckets.append((h[ok] & np.uint64(BUCKETS - 1)).astype(np.int32))
        owner.append(word[: len(h)][ok])
    bucket, owner = np.concatenate([*buckets, np.zeros(0, np.int32)]), np.concatenate([*owner, np.zeros(0, np.int32)])
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


BAG = T.StructType([T.StructField("words", T.BinaryType())])


def bags(texts: pa.Array) -> list[pa.Array]:
    """The distinct lower-cased words of each text, with spaces between."""
    out = []
    for c in W.chunks(texts, W.NON_ALNUM, lower=True):
        first, data = first_places(c), c.b.tobytes()
        edge = np.searchsorted(first, c.edge)
        for i in range(c.n):
            own = first[edge[i] : edge[i + 1]]
            out.append(b" ".join([data[a:z] for a, z in zip(c.starts[own].tolist(), c.ends[own].tolist(), strict=True)]))
    return [pa.array(out, pa.binary())]


def first_places(c: W.Chunk) -> np.ndarray:
    """One place of each distinct word of each document, ascending."""
    h, doc = c.hashes(), c.doc
    order = np.lexsort((h, doc))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return np.sort(order[new])


def constant(y: np.ndarray) -> tuple[np.ndarray, float]:
    """What is known without both labels."""
    return np.zeros(BUCKETS, np.float32), float(20 * (y.mean() - 0.5)) if len(y) else -10.0


def train(words: pa.Array | pa.ChunkedArray, y: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Scores by bucket (embedding times the difference of the softmax rows) and the bias, from bags of words.

    Gradient descent with Nesterov's momentum over all documents, which weigh as
    much by label. The step follows from the largest eigenvalue of the problem's
    curvature, so it needs no tuning to the data.
    """
    if not len(y) or y.min() == y.max():
        return constant(y)
    c = next(W.chunks(words, W.NON_ALNUM, lower=True, limit=1 << 40))
    starts, ends, word = vocabulary(c)
    blocks = [slice(i, min(i + BLOCK_WORDS, len(starts))) for i in range(0, len(starts), BLOCK_WORDS)]
    bucket, width = [], []
    for at in blocks:
        some, owner = subwords(c.b, starts[at], ends[at])
        bucket.append(some)
        width.append(np.bincount(owner, minlength=at.stop - at.start))
    doc, n, full = c.doc.astype(np.int32), c.n, c.counts > 0
    share, word = 1 / (c.counts + NEUTRAL), word.astype(np.int32)
    del c
    if not full.any() or y[full].min() == y[full].max():
        return constant(y[full])
    y, weight = y.astype(np.float64), full * np.where(y == 1, 0.5 / y[full].mean(), 0.5 / (1 - y[full].mean()))
    weight /= weight.sum()

    def forward(s: np.ndarray) -> np.ndarray:
        """The mean of s over the words of each document."""
        own = np.concatenate([_means(s, some, n_) for some, n_ in zip(bucket, width, strict=True)])
        return np.bincount(doc, weights=own[word], minlength=n) * share

    def backward(e: np.ndarray) -> np.ndarray:
        """What an error of each document asks of each bucket."""
        own, out = np.bincount(word, weights=(e * share)[doc], minlength=len(starts)), np.zeros(BUCKETS)
        for at, some, n_ in zip(blocks, bucket, width, strict=True):
            out += np.bincount(some, weights=np.repeat(own[at] / n_, n_), minlength=BUCKETS)
        return out

    rng = np.random.default_rng(seed)
    often = backward(np.full(n, 1 / n))
    even = np.where(often > 0, np.maximum(often, 1e-12), 1) ** EVEN
    x = rng.normal(size=BUCKETS) * (often > 0)
    for _ in range(8):  # the largest eigenvalue, by powers
        z = forward(np.sqrt(even) * x / np.linalg.norm(x))
        x = np.sqrt(even) * backward(weight * (z - (weight * z).sum()))
    step = (even * 4 / np.linalg.norm(x))[:, None]
    E, V = np.zeros((BUCKETS, DIM)), rng.normal(size=(2, DIM))
    V = np.stack([-V[0], V[0]]) / 2 / np.linalg.norm(V[0])
    bias, E_before, bias_before = 0.0, E, 0.0
    for k in range(EPOCHS):
        v = V[1] - V[0]
        z = forward(E @ v)
        z -= (weight * z).sum()  # so that the bias learns apart from the rest
        err = weight * (_logistic(z + bias) - y)
        pull = backward(err - weight * err.sum())
        dv = pull @ E
        E_now, bias_now = E - step * pull[:, None] * (v / (v @ v))[None, :], bias - 4 * err.sum()
        V = V - LAYER_RATE / max(1.0, (weight * z * z).sum()) * np.stack([-dv, dv])
        rush = k / (k + 3)
        E, bias = E_now + rush * (E_now - E_before), bias_now + rush * (bias_now - bias_before)
        E_before, bias_before = E_now, bias_now
    s = E @ (V[1] - V[0])
    return s.astype(np.float32), float(bias - (weight * forward(s)).sum())


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _means(s: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The mean of s over the n-grams of each of some words, which have n of them."""
    return np.add.reduceat(s[bucket], np.cumsum(n) - n) / n if len(n) else np.zeros(0)


FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def kernel(scores: np.ndarray, bias: float):
    def run(texts: pa.Array) -> list[pa.Array]:
        out = []
        for c in W.chunks(texts, W.NON_ALNUM, lower=True):
            mean = np.zeros(c.n)
            if len(c.starts):
                starts, ends, number = vocabulary(c)
                bucket, owner = subwords(c.b, starts, ends)
                logits = _means(scores, bucket, np.bincount(owner, minlength=len(starts)))
                one = first_places(c)
                doc = c.doc[one]
                mean = np.bincount(doc, weights=logits[number[one]], minlength=c.n) / (np.bincount(doc, minlength=c.n) + NEUTRAL)
            out.append(_logistic(mean + np.where(c.counts > 0, bias, min(bias, 0.0))))
        p = np.concatenate(out) if out else np.zeros(0)
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", rows: dict[int, int] | None = None) -> tuple[np.ndarray, float]:
    """The model from a bounded sample of the labelled rows of docs; labels: doc_id, toxic."""
    rows = rows or FIT_ROWS
    spark = docs.sparkSession
    ids = []
    for y, n in rows.items():
        some = labels.where((F.col("toxic") == y) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids += [(r[0], y) for r in some.collect()]  # at most FIT_ROWS
    if not ids:
        return constant(np.zeros(0, np.int64))
    wanted = spark.createDataFrame(ids, "doc_id long, toxic int")
    texts = docs.select(col("doc_id").alias("doc_id"), col(text).alias("t")).where("t is not null")
    found = with_kernel(texts.join(F.broadcast(wanted), "doc_id"), bags, BAG, "bag", "t", ["doc_id", "toxic"])
    one = found.groupBy("doc_id", "toxic").agg(F.min_by("bag", F.xxhash64("bag.words")).alias("bag"))  # of repeated rows one
    got = one.orderBy("doc_id", "toxic").select("bag.*", "toxic").toArrow()  # distinct words of FIT_ROWS texts
    return train(got.column("words"), got.column("toxic").to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, into: str = "toxicity", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds a struct (score, predicted) to every row.

    Null and empty texts, and texts without words, score as the bias says, 0.5 at
    most. Long texts are scored whole, by the mean of all their words. Labels that
    name no row, null labels and repeated rows are harmless; of a doc_id with two
    labels both count. Without labels of both kinds the score is a constant. Empty
    docs give an empty result, other columns pass through, and one called like
    `into` makes the struct take trailing underscores.
    """
    scores, bias = fit(docs, labels, text)
    return with_kernel(docs, kernel(scores, bias), FIELDS, free(docs, into), text, keep)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
