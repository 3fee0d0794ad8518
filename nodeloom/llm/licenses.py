"""Operator 9, licence scans by diagonal voting.

All rolling K-word gram hashes of all texts are joined with the positions of
the same grams in the licence templates. Matches are counted by diagonal (place
in the text less place in the template); neighbouring diagonals, where words
were added or left out, merge. A merged span is verified by the share of
template words that its matched grams cover in order: of all chains of grams that
rise in the text and in the template, the one that covers most counts.

Phrases of the base contract are searched for word by word beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.llm import words as W
from nodeloom.llm.frames import col
from nodeloom.llm.store import Scratch

K = 4
#: Diagonals this far apart merge.
GAP = 6
#: Share of a template's words that verifies a span.
COVER = 0.6

#: Fixed values of the base contract: phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Public licence statements by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _chunk(texts: list[str]) -> W.Chunk:
    return next(W.chunks(pa.array(texts), W.NON_ALNUM, lower=True, limit=1 << 30))


def template_rows(templates=TEMPLATES, k: int = K) -> list[tuple[int, int, int]]:
    """(gram, template, place) of every gram of every template."""
    c = _chunk([t for _, t in templates])
    at = c.windows(k)
    doc = c.doc[at]
    return list(zip(W.signed(W.ngrams(c.hashes(), k)[at]).tolist(), doc.tolist(), (at - c.edge[doc]).tolist(), strict=True))


BASE = "doc_id long, fp long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>"


def _base(phrases):
    c = _chunk([p for p, _ in phrases])
    hashes = c.hashes()
    wanted = [(hashes[c.edge[i] : c.edge[i + 1]], label) for i, (_, label) in enumerate(phrases)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch.column("t"), W.NON_ALNUM, lower=True):
                h = c.hashes()
                doc, places, marks = c.doc, [], []
                for i, (phrase, _) in enumerate(wanted):
                    at = c.windows(len(phrase))
                    for j, x in enumerate(phrase):
                        at = at[h[at + j] == x]
                    places.append(at)
                    marks.append(np.full(len(at), i))
                at, mark = np.concatenate(places), np.concatenate(marks)
                d = doc[at] if len(at) else np.zeros(0, np.int64)
                own = at - c.edge[d]
                n = np.bincount(d, minlength=c.n)
                first, last = np.full(c.n, np.iinfo(np.int64).max), np.full(c.n, -1)
                np.minimum.at(first, d, own)
                np.maximum.at(last, d, own)
                labels: list[list[str]] = [[] for _ in range(c.n)]
                for i, m in set(zip(d.tolist(), mark.tolist(), strict=True)):
                    labels[i].append(wanted[m][1])
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(c.first, c.n), pa.array(W.signed(W.fingerprint(h, c.edge)[0])), pa.array(c.counts), pa.array(n), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(set(x)) for x in labels], pa.list_(pa.string()))],
                    names=["doc_id", "fp", "n_words", "n_base", "first_word", "last_word", "base_labels"],
                )

    return run


def _grams(k: int):
    """All gram hashes of each document, a missing one for each place where no window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch.column("t"), W.NON_ALNUM, lower=True):
                h = c.hashes()
                at = c.windows(k)
                g = W.ngrams(h, k)[at] if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first, c.n), pa.array(W.signed(W.fingerprint(h, c.edge)[0])), W.lists(W.signed(g), np.searchsorted(at, c.edge), pa.int64())], names=["doc_id", "fp", "grams"])

    return run


def in_order(pairs: list[tuple[int, int]], words: int, k: int) -> int:
    """The most template words that a chain of grams covers whose places rise in text and template; pairs: (at, place)."""
    best = [0] * words  # of chains that end with the gram of a place
    for at, group in groupby(sorted(pairs), key=lambda p: p[0]):
        found = [(p, max([k, *(best[q] + min(k, p - q) for q in range(p) if best[q])])) for _, p in group]
        for p, n in found:
            best[p] = max(best[p], n)
    return max(best)


def _covers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers = [in_order([(x["at"], x["place"]) for x in pairs], words, k) / words for pairs, words in zip(batch.column("pairs").to_pylist(), batch.column("words").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), batch.column("label"), pa.array(covers, pa.float64())], names=["doc_id", "fp", "label", "cover"])

    return run


def votes(spark: SparkSession, texts: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(doc_id, fp, label, cover): the best verified span of each label; fp tells texts under one doc_id apart."""
    rows = spark.createDataFrame(template_rows(templates, k), "gram long, template int, place int")
    names = spark.createDataFrame([(i, x, len(_chunk([t]).starts)) for i, (x, t) in enumerate(templates)], "template int, label string, words int")
    grams = texts.mapInArrow(_grams(k), "doc_id long, fp long, grams array<long>").select("doc_id", "fp", F.posexplode("grams").alias("at", "gram"))
    hits = grams.join(F.broadcast(rows), "gram")  # as many rows as the templates have words
    diagonal = F.col("at") - F.col("place")
    lines = hits.groupBy("doc_id", "fp", "template", diagonal.alias("diagonal")).agg(F.collect_set("place").alias("places"))
    by = Window.partitionBy("doc_id", "fp", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > GAP).cast("int"), F.lit(0))
    here = F.transform("places", lambda p: F.struct((F.col("diagonal") + p).alias("at"), p.alias("place")))
    spans = lines.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by)).groupBy("doc_id", "fp", "template", "span").agg(F.flatten(F.collect_list(here)).alias("pairs"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.sequence(p["place"], p["place"] + (k - 1))))))  # in any order, so no less
    likely = spans.join(F.broadcast(names), "template").where(covered >= F.col("words") * COVER).select("doc_id", "fp", "label", "words", "pairs")
    judged = likely.mapInArrow(_covers(k), "doc_id long, fp long, label string, cover double")
    return judged.where(F.col("cover") >= COVER).groupBy("doc_id", "fp", "label").agg(F.max("cover").alias("cover"))


def scan(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    score: 1 with a base phrase, else the best verified share of a template, 0
    without one. Null and empty texts have no words and no labels (empty
    strings), long ones are scanned whole. Diagonals just GAP apart merge; of
    spans of one label the best counts. Repeated rows are scanned alike; extra
    columns are ignored; empty docs give an empty result.
    """
    texts = docs.select(col("doc_id").cast("long").alias("doc_id"), col(text).alias("t"))
    base = Scratch(spark, "licenses").keep(texts.mapInArrow(_base(PHRASES), BASE), "base")
    best = votes(spark, texts).groupBy("doc_id", "fp").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    best = best.select(F.col("doc_id").alias("id"), F.col("fp").alias("print"), "more", "cover")
    joined = base.join(best, base["doc_id"].eqNullSafe(best["id"]) & (base["fp"] == best["print"]), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score"))
