"""Queries over JSON text with the Python kernel: everything of the language, in Arrow batches.

For what rowlocal cannot express exactly: own functions, exact sums, averages
and deviations, patterns from documents or with nested repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.plans.query import JsonPath
from nodeloom.sources import json_text

NODES = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("path", T.StringType())]))


def select(df: DataFrame, json: str, path: JsonPath, into: str = "nodes", mode: str = "fail") -> DataFrame:
    """Adds the selected nodes as array<struct<value, path>>, values as JSON text; null text gives null.

    mode: what a bad text or a failing evaluation does: "fail" raises, "null"
    gives null, "error" also adds <into>_error (reason).
    """
    if mode not in ("fail", "null", "error"):
        raise ValueError(f"unknown mode {mode!r}")
    kind = pa.list_(pa.struct([("value", pa.string()), ("path", pa.string())]))
    names = [f"c{i}" for i in range(len(df.columns))]
    src = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)], F.col(json).alias("json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for t in batch.column("json").to_pylist():
                found = error = None
                if t is not None:
                    try:
                        found = [{"value": json_text.write(n.value), "path": str(n.path)} for n in path.query_json(t)]
                    except ValueError as e:
                        if mode == "fail":
                            raise
                        error = str(e)
                out.append(found)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, kind), pa.array(errors, pa.string())], names=[*names, "nodes", "error"])

    schema = T.StructType([*src.schema.fields[:-1], T.StructField("nodes", NODES), T.StructField("error", T.StringType())])
    made = src.mapInArrow(run, schema)
    extra = [F.col("error").alias(f"{into}_error")] if mode == "error" else []
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)], F.col("nodes").alias(into), *extra)
