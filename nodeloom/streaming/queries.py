"""Queries over streams of JSON documents: projections without state, and windowed counts of what they select."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.rowlocal import RowLocal
from nodeloom.plans.query import JsonPath
from nodeloom.sources.shredder import shred


def select_stream(stream: DataFrame, json: str, path: JsonPath, into: str = "nodes") -> DataFrame:
    """The stream with the selected nodes (value, path); bad texts select null. Stateless, append mode."""
    tree = shred(stream, json, into="__doc", mode="null")
    return tree.withColumn(into, RowLocal(path, "__doc").query()).drop("__doc")


def windowed_counts(stream: DataFrame, json: str, path: JsonPath, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, documents, nodes): how many documents came and nodes were selected, by event time with a watermark."""
    found = select_stream(stream.withWatermark(time, late), json, path)
    return found.groupBy(F.window(time, window)).agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.size("nodes"), F.lit(0)).cast("long")).alias("nodes"))
