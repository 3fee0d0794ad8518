"""The queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import jaccard, licenses, mixing, neighbours, oracles, packing, pages, quality, secrets, substrings, toxicity
from nodeloom.llm.frames import read
from nodeloom.llm.store import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = Scratch(spark, "mixing").keep(mixing.with_size(docs, "size", keep=["doc_id", "source"]), "sizes")
    mixed = mixing.mix(sized, "size", ["doc_id"])
    rows = mixed.select("doc_id", "size", "mix.source_size", "mix.target", "mix.taken", F.get("mix.copies", F.lit(0))["position"].alias("first_position"))
    return rows.sort(F.col("first_position").asc_nulls_last(), "doc_id")  # range-sorted, what the mix leaves out comes last


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_links(spark, read(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("doc_id", "quality.*")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    sized = Scratch(spark, "packing").keep(mixing.with_size(docs, "n_tokens", keep=["doc_id"]), "sizes")
    return packing.pack(sized, "n_tokens", ["doc_id"]).select("doc_id", "n_tokens", "pack.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels whose rows are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.toxicity(docs, labels.where(~toxicity.held_out()), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "toxicity.*")


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark, read(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "digest.*")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark, read(spark, sf_dir, "documents"), as_hash=True).withColumnRenamed("kept", "kept_sha256")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, read(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(spark, read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op2_neighbours, op3_quality, op4_packing, op5_toxicity, op6_pages, op7_secrets, op8_substrings, op9_licenses, op10_jaccard, pipeline, *oracles.QUERIES)}
SQL: dict[str, str] = dict(oracles.SQL)
