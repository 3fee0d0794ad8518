"""Operator 4, packing: optimal length buckets and token-budget batches.

The global histogram of document lengths feeds a dynamic programme that chooses
the bucket boundaries with the least padding. Its driver needs memory for the
distinct lengths only: d of them need d * (d - 1) / 2 tokens, so a corpus of N
tokens has at most sqrt(2 N) + 1 (a hundred thousand for 5e9 tokens).

Inside a bucket, documents in the given order (a hash of the order columns where
there is none) fill batches whose padded size stays within the token budget.
Batch numbers come from running counts over parts of a bucket, so a bucket may
hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.frames import col, free, running

BUCKETS = 16
#: Tokens of a batch, padding included; a longer document is a batch of its own.
BUDGET = 65_536
#: Places in the given order that make a part of a bucket.
PLACES = 1 << 16


def boundaries(lengths: Iterable[int], counts: Iterable[int], buckets: int = BUCKETS) -> list[int]:
    """The upper ends of at most this many buckets that minimise the padding up to them, in whole numbers.

    With one bucket more, length j costs size[j] * n[j + 1] and the least over i < j of best[i] - size[j] * n[i + 1]: of
    lines whose slopes fall, asked at rising places, so their lower hull serves all j in one pass.
    """
    both = sorted(zip(map(int, lengths), map(int, counts), strict=True))
    if not both:
        return []
    size, n = [x for x, _ in both], [0, *accumulate(c for _, c in both)]
    m, k = len(size), min(buckets, len(size))
    best, cuts = [n[j + 1] * size[j] for j in range(m)], []
    for _ in range(1, k):
        now, cut, hull, at = best.copy(), [0] * m, [], 0
        for j in range(1, m):
            slope, base = -n[j], best[j - 1]
            while len(hull) - at >= 2:  # the last line goes if the new one passes below where it meets the one before
                (s1, b1, _), (s2, b2, _) = hull[-2], hull[-1]
                if (base - b1) * (s1 - s2) > (b2 - b1) * (s1 - slope):
                    break
                hull.pop()
            hull.append((slope, base, j))
            x = size[j]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            found = x * n[j + 1] + hull[at][0] * x + hull[at][1]
            if found < now[j]:
                now[j], cut[j] = found, hull[at][2]
        best = now
        cuts.append(cut)
    ends, j = [], m - 1
    for cut in reversed([[0] * m, *cuts]):
        if cut[j]:
            ends.append(size[j])
            j = cut[j] - 1
    return [*sorted([*ends, size[j]])]


def pack(docs: DataFrame, size: str, order: list[str], buckets: int = BUCKETS, budget: int = BUDGET, into: str = "pack", place: str | None = None) -> DataFrame:
    """Adds a struct (bucket, bucket_len, batch, slot, padding) to every row.

    place: a column of whole numbers from 0 whose order the batches of a bucket
    follow; else it is that of a hash of the order columns. Rows with a null or
    zero size are in bucket 0 with the shortest ones; a row longer than the
    budget is a batch of its own. Empty docs give an empty result. Rows alike
    in the order columns and size are interchangeable, so reruns agree. Other
    columns pass through; one called like `into` makes the struct take trailing
    underscores.
    """
    into = free(docs, into)
    n = F.coalesce(col(size), F.lit(0)).cast("long")
    histogram = docs.groupBy(n.alias("length")).agg(F.count("*").alias("rows")).toArrow()  # sqrt(2 * tokens) + 1 rows at most
    ends = boundaries(histogram.column("length").to_pylist(), histogram.column("rows").to_pylist(), buckets) or [0]
    bucket, one, rank, wide = (free(docs, x) for x in ("bucket", "one", "rank", "wide"))
    number = F.lit(len(ends) - 1)
    for i in reversed(range(len(ends) - 1)):
        number = F.when(n <= ends[i], F.lit(i)).otherwise(number)
    length = F.element_at(F.array(*map(F.lit, ends)), F.col(bucket) + 1).cast("long")
    numbered = docs.withColumn(bucket, number).withColumn(one, F.lit(1).cast("long"))
    ranked = running(numbered, [bucket], one, order, rank) if place is None else running(numbered, [bucket], one, [place, *order], rank, F.floor(col(place) / PLACES))
    ranked = ranked.withColumn(wide, F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(length, F.lit(1)))).cast("long"))
    struct = F.struct(F.col(bucket).alias("bucket"), length.alias("bucket_len"), F.floor(F.col(rank) / F.col(wide)).cast("long").alias("batch"), (F.col(rank) % F.col(wide)).cast("long").alias("slot"), (length - n).alias("padding"))
    return ranked.withColumn(into, struct).drop(bucket, one, rank, wide)
