"""A corpus from raw documents to packed batches; every stage takes (spark, docs, sf_dir).

quality     rows that the quality rules reject go
near_copies one row of each group of linked documents stays, that of the smallest doc_id
secrets     secret spans in texts give way to marks, n_chars follows
mixing      sources come to their target weights: documents are repeated or left out, sorted by training position
packing     the sorted copies, with their texts, go to length buckets and token-budget batches in that order
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from nodeloom.llm import jaccard, mixing, packing, quality, secrets
from nodeloom.llm.frames import col, free, read
from nodeloom.llm.store import Scratch

#: No SQL: hashed likelihood ratios, secret checksums and the packing programme have none.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.quality(docs, read(spark, sf_dir, "labels"), into=(q := free(docs, "quality")))
    return judged.where(F.col(q)["kept"]).select(*map(col, docs.columns))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one doc_id the first by content stays; rows without a doc_id stay unless they repeat."""
    groups = jaccard.jaccard_groups(spark, docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    mark, h = free(docs, "mark"), free(docs, "h")
    own = docs.where("doc_id is not null").withColumn(h, F.xxhash64(*[col(c) for c in docs.columns])).join(first, "doc_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(h))
    one = own.withColumn(mark, rank).where(F.col(mark) == 1).select(*map(col, docs.columns))
    return one.union(docs.where("doc_id is null").distinct())


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    s = free(docs, "secrets")
    scanned = secrets.scan(docs, into=s)
    changed = F.size(F.col(s)["spans"]) > 0
    new = {"text": F.when(changed, F.col(s)["redacted"]).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(F.col(s)["redacted"])).otherwise(F.col("n_chars"))}
    return scanned.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else col(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order of the rows is that of training; it lasts in the files that they are written to."""
    size, m = free(docs, "size"), free(docs, "mix")
    mixed = mixing.mix(mixing.with_size(docs, size), size, ["doc_id"], whole=True, into=m)
    return mixing.in_order(mixed, ["doc_id"], m).select(*map(col, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, copy, place, text, n_tokens, bucket, bucket_len, batch, slot, padding): every copy with its text.

    place numbers the rows of docs in the order of their files, copy those of one
    doc_id; the batches of a bucket follow it. Docs that are read from no files
    are written first.
    """
    scratch = Scratch(spark, "packing")
    docs = docs.select("doc_id", "text")
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = scratch.keep(docs, "docs")
    read = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    sized = scratch.keep(mixing.with_size(read, "n_tokens", keep=["doc_id", "file", "row"]), "sizes")
    files = sized.groupBy("file").agg(F.count("*").alias("rows"))
    files = files.withColumn("before", F.sum("rows").over(Window.orderBy("file")) - F.col("rows")).drop("rows")  # one row a file
    placed = sized.join(files, "file").withColumn("place", F.col("before") + F.col("row")).drop("before")
    copy = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("place"))).orderBy("place"))
    packed = packing.pack(scratch.keep(placed.withColumn("copy", copy), "placed"), "n_tokens", [], place="place")
    return packed.join(read.select("file", "row", "text"), ["file", "row"]).select("doc_id", "copy", "place", "text", "n_tokens", "pack.*")


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet in the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
