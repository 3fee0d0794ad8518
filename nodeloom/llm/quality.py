"""Operator 3, quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over N_BUCKETS hashed word 1- and 2-grams are counted: one
over the trusted documents (label quality = 1), one over every document. A
document's score is the mean log ratio of its n-grams. The threshold is a low
quantile of the scores of trusted documents that the target counts have not
seen, so the same rule holds for every document and every rerun.

Nothing is sampled: corpus counts cover all documents, and every trusted
document counts, by its place in the order of a hash of doc_id: those at even
places in the target counts, those at odd places in the threshold, which is an
exact order statistic of all their scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm import words as W
from nodeloom.llm.frames import col, free, running, small, with_kernel
from nodeloom.llm.store import Scratch

N_BUCKETS = 1 << 16
#: The threshold: this quantile of unseen trusted scores, less MARGIN times its distance from their median.
MISSED = 0.001
MARGIN = 0.25
#: Added to every bucket of both multinomials.
PRIOR = 0.5
#: Scores that the driver sorts; of more, ranks are found by counting BINS bins again and again.
SORTED_ROWS = 100_000
BINS = 4096

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
FIELDS = T.StructType([*BASE.fields, T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def base_counts(c: W.Chunk, h: np.ndarray) -> list[np.ndarray]:
    """The five base columns of a chunk's documents; h: its word hashes."""
    letters = c.sum_bytes(~W.SPACE[c.b] & ((c.b & 0xC0) != 0x80))
    symbols = c.sum_bytes(SYMBOLS[c.b])
    # lines
    breaks = np.flatnonzero(c.b == 10)
    line_starts = np.unique(np.concatenate([c.off[:-1], breaks + 1])) if c.n else np.zeros(0, np.int64)
    line_starts = line_starts[line_starts < len(c.b)]
    line_ends = np.append(line_starts[1:], len(c.b))
    line_ends = line_ends - ((line_ends > line_starts) & (c.b[line_ends - 1] == 10) if len(line_ends) else 0)
    full = np.searchsorted(c.starts, line_ends) > np.searchsorted(c.starts, line_starts)
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_doc = np.searchsorted(c.off, line_starts, "right") - 1
    _, edge = W.unique_per_doc(line_doc, W.hash_spans(c.b, line_starts, line_ends), c.n)
    dup_lines = np.bincount(line_doc, minlength=c.n) - np.diff(edge)
    # words in repeated windows of three
    at = c.windows(3)
    repeat = np.zeros(c.n, np.int64)
    if len(at):
        doc = c.doc
        key = W.mix(W.ngrams(h, 3)[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        covered = W.flags_cover(len(h), at[again], 3)
        repeat = np.bincount(doc[covered], minlength=c.n)
    return [c.counts, letters, symbols, dup_lines, repeat]


def features(c: W.Chunk, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word and every pair of neighbouring words."""
    doc, mask = c.doc, np.uint64(N_BUCKETS - 1)
    at = c.windows(2)
    two = W.ngrams(h, 2)[at] if len(at) else np.zeros(0, np.uint64)
    return np.concatenate([W.mix(h) & mask, two & mask]).astype(np.int64), np.concatenate([doc, doc[at]])


def _count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N_BUCKETS, np.int64)
    for batch in batches:
        for c in W.chunks(batch.column("text")):
            total += np.bincount(features(c, c.hashes())[0], minlength=N_BUCKETS)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])


def _multinomial(texts: DataFrame) -> np.ndarray:
    """N-grams of the texts by bucket, with the prior."""
    out = np.full(N_BUCKETS, PRIOR)
    counts = texts.mapInArrow(_count_kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    for b, n in counts.collect():  # N_BUCKETS rows at most
        out[b] += n
    return out


def order_statistics(values: DataFrame, ranks: list[int], at_once: int = SORTED_ROWS) -> list[float]:
    """The values (one column of finite doubles, stored) at these ranks, from 0, exactly.

    More than at_once of them are counted by bins between their least and
    largest, and the bin that holds a rank is searched in the same way.
    """
    v = col(values.columns[0])
    n, low, high = values.agg(F.count(v), F.min(v), F.max(v)).first()
    if n <= at_once or low == high:
        found = np.full(n, low) if low == high else np.sort([r[0] for r in values.collect()])
        return [float(found[r]) for r in ranks]
    where = F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(BINS)))
    counts = dict(sorted((b, k) for b, k in values.groupBy(where.alias("bin")).agg(F.count("*")).collect()))  # BINS + 1 rows at most
    ends = np.cumsum(list(counts.values()))
    inside: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        inside.setdefault(int(np.searchsorted(ends, r, "right")), []).append(i)
    out = [0.0] * len(ranks)
    for k, those in inside.items():
        before = int(ends[k - 1]) if k else 0
        for i, x in zip(those, order_statistics(values.where(where == list(counts)[k]), [ranks[i] - before for i in those], at_once), strict=True):
            out[i] = x
    return out


def scores(c: W.Chunk, h: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    bucket, doc = features(c, h)
    n = np.bincount(doc, minlength=c.n)
    return np.bincount(doc, weights=ratio[bucket], minlength=c.n) / np.maximum(n, 1)


def kernel(ratio: np.ndarray, least: float):
    def run(texts: pa.Array) -> list[pa.Array]:
        out: list[list[np.ndarray]] = [[] for _ in FIELDS.fields]
        for c in W.chunks(texts):
            h = c.hashes()
            base = base_counts(c, h)
            failed = (base[0] < 50) | (100 * base[4] > 50 * base[0])
            score = scores(c, h, ratio)
            for o, x in zip(out, [*base, failed, score, ~failed & (score >= least)], strict=True):
                o.append(x)
        return [pa.array(np.concatenate(o) if o else []) for o in out]

    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[np.ndarray, float]:
    """Log ratios by bucket and the threshold. Without trusted documents: all ratios 0, no threshold."""
    scratch = Scratch(docs.sparkSession, "quality")
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("one", F.lit(1))
    placed = running(ids, [], "one", ["h", "doc_id"], "place", part=F.shiftright("h", 52))
    halves = scratch.keep(placed.select("doc_id", (F.col("place") % 2 == 0).alias("fit")), "halves")
    if not halves.take(1):
        scratch.drop(halves)
        return np.zeros(N_BUCKETS), -np.inf
    texts = docs.select(col("doc_id").alias("doc_id"), col(text).alias("text"))
    trusted = scratch.keep(texts.join(small(halves), "doc_id").select("fit", "text"), "trusted")
    raw, target = _multinomial(texts.select("text")), _multinomial(trusted.where("fit").select("text"))
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    scored = with_kernel(trusted.where("not fit"), kernel(ratio, -np.inf), FIELDS, "q", keep=[])
    found = scratch.keep(scored.where("not q.base_failed").select("q.score"), "scores")
    n, least = found.count(), -np.inf
    if n:
        low, a, b = order_statistics(found, [int(MISSED * n), (n - 1) // 2, n // 2])
        least = low - MARGIN * ((a + b) / 2 - low)
    scratch.drop(halves, trusted, found)
    return ratio, least


def quality(docs: DataFrame, labels: DataFrame, into: str = "quality", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds a struct of the base counts, the score and the verdict to every row of docs.

    Null or empty text: no words, so base_failed. Repeated rows are judged
    alike. Other columns pass through; where one is called like `into`, the
    struct gets trailing underscores. Empty docs give an empty result, and
    labels without quality = 1 leave only the base rules.
    """
    ratio, least = fit(docs, labels, text)
    return with_kernel(docs, kernel(ratio, least), FIELDS, free(docs, into), text, keep)
