"""Comparison of two engines' results, checks on results, and assessment of expressions of the older dialect."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.rowlocal import RowLocal
from nodeloom.plans.parser import JsonPathSyntaxError, parse
from nodeloom.plans.query import JsonPath

OUTCOMES = ("SAME", "SAME_VALUES_DIFFERENT_ORDER", "DIFFERENT_VALUES", "ONLY_LEFT", "ONLY_RIGHT", "LEFT_FAILS", "RIGHT_FAILS", "BOTH_REJECT")


def outcome(left: Column, right: Column, left_error: Column | None = None, right_error: Column | None = None) -> Column:
    """How two arrays of comparison keys differ. ONLY_*: the other side is empty; *_FAILS: it has an error."""
    bad = lambda e: F.lit(False) if e is None else e.isNotNull()
    a, b = F.coalesce(left, F.array().cast("array<string>")), F.coalesce(right, F.array().cast("array<string>"))
    return (
        F.when(bad(left_error) & bad(right_error), "BOTH_REJECT")
        .when(bad(left_error), "LEFT_FAILS")
        .when(bad(right_error), "RIGHT_FAILS")
        .when(a == b, "SAME")
        .when((F.size(a) > 0) & (F.size(b) == 0), "ONLY_LEFT")
        .when((F.size(b) > 0) & (F.size(a) == 0), "ONLY_RIGHT")
        .when(F.sort_array(a) == F.sort_array(b), "SAME_VALUES_DIFFERENT_ORDER")
        .otherwise("DIFFERENT_VALUES")
    )


def report(df: DataFrame, outcome_column: str) -> DataFrame:
    """(outcome, comparisons) of all rows, the most frequent first."""
    return df.groupBy(F.col(outcome_column).alias("outcome")).agg(F.count("*").alias("comparisons")).orderBy(F.desc("comparisons"), "outcome")


#: Signs of the older dialect, and what the standard offers instead.
HINTS = (
    (r"=~", "use match() or search() with an I-Regexp"),
    (r"\.(?:min|max|avg|stddev|sum)\(\)", "use the aggregate functions inside a filter"),
    (r"\.length\(\)|\.size\(\)", "use length() or count() inside a filter"),
    (r"\.(?:keys|concat|append|first|last|index)\(", "path functions do not exist; change the value in the program"),
    (r"\b(?:in|nin|subsetof|anyof|noneof)\b", "spell set operators out with == and ||"),
    (r"\bsize\b|\bempty\b", "compare count() or length() with a number"),
    (r"\[\?\(@\.[^)]*\)\s*\]", "parentheses around a filter are optional"),
    (r"-[0-9]*:|\[\(", "use negative indexes or slices instead of script expressions"),
)


#: What to do with an expression that no sign explains, and with valid ones.
OTHER_HINT = "rewrite it by the grammar of the standard; the error names the place"
VALID_HINTS = {"VALID": "the result is a list of nodes: read it with values()", "VALID_SINGLE_VALUE": "at most one node: read it with first() or single()", "WRITE_API": "queries do not write: use an overlay", "NOT_A_LITERAL": "the expression is computed: check what the program builds"}


def hint(expression: str) -> str:
    return next((text for pattern, text in HINTS if re.search(pattern, expression)), OTHER_HINT)


def hints(expression: Column) -> Column:
    """The first hint of each expression, a general one where none fits."""
    out = F.lit(OTHER_HINT)
    for pattern, text in reversed(HINTS):
        out = F.when(expression.rlike(pattern), text).otherwise(out)
    return out


#: Methods that write to documents in the older dialect's interface.
WRITE_CALLS = ("set", "put", "add", "delete", "renameKey", "map")


def assess(expression: str | None, call: str = "read") -> str:
    """VALID, VALID_SINGLE_VALUE, NOT_RFC_9535, WRITE_API or NOT_A_LITERAL; the last whatever the call."""
    if expression is None:
        return "NOT_A_LITERAL"
    if call in WRITE_CALLS:
        return "WRITE_API"
    try:
        return "VALID_SINGLE_VALUE" if parse(expression).singular else "VALID"
    except JsonPathSyntaxError:
        return "NOT_RFC_9535"


def assess_table(df: DataFrame, expression: str, call: str | None = None) -> DataFrame:
    """Adds assessment and hint columns to a table of expressions; the parser runs in Arrow batches."""
    @F.pandas_udf("string")
    def judge(e: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([assess(x, y) for x, y in zip(e, c, strict=True)])

    judged = judge(F.col(expression), F.col(call) if call else F.lit("read"))
    advice = hints(F.col(expression))
    for kind, text in VALID_HINTS.items():
        advice = F.when(F.col("assessment") == kind, text).otherwise(advice)
    return df.withColumn("assessment", judged).withColumn("hint", advice)


class Checks:
    """Predicates on the result of a query over a tree column."""

    def __init__(self, path: JsonPath, doc: str | Column = "doc"):
        self.rows = RowLocal(path, doc)

    def exists(self) -> Column:
        return F.coalesce(self.rows.exists(), F.lit(False))

    def does_not_exist(self) -> Column:
        return ~self.exists()

    def has_size(self, n: int) -> Column:
        return F.coalesce(self.rows.count() == n, F.lit(False))

    def value(self, expected) -> Column:
        """Exactly one node, equal to this value."""
        from nodeloom.sources.shredder import value_key

        key = value_key(expected)
        return F.coalesce(self.rows.keys() == F.array(F.lit(key)), F.lit(False))

    def values(self, *expected) -> Column:
        from nodeloom.sources.shredder import value_key

        keys = [F.lit(value_key(v)) for v in expected]
        return F.coalesce(self.rows.keys() == F.array(*keys).cast("array<string>"), F.lit(False))

    def paths(self, *expected: str) -> Column:
        return F.coalesce(self.rows.paths() == F.array(*map(F.lit, expected)).cast("array<string>"), F.lit(False))
