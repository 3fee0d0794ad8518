"""More queries of the engine, one for each rule that the headline queries do not touch, with equal DuckDB SQL.

Rules on texts (grammar, strict parsing, patterns, paths, overlays) are asked of
texts made from the tables; the SQL states by row what the rule must answer.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.access import ABSENT, Value, function
from nodeloom.functions.registry import Function
from nodeloom.functions.values import NOTHING, equal
from nodeloom.operators import compare, kernel, overlay
from nodeloom.operators.exploded import Exploded, node_table
from nodeloom.operators.rowlocal import RowLocal
from nodeloom.operators.typed import Typed
from nodeloom.plans import ast as A
from nodeloom.plans.parser import JsonPathSyntaxError, parse
from nodeloom.plans.paths import NormalizedPath
from nodeloom.plans.query import Compiler
from nodeloom.plans.query import compile as path
from nodeloom.plans.query import with_aggregates
from nodeloom.queries import as_text, customers, orders, query, table, typed
from nodeloom.sources import documents, json_text
from nodeloom.sources.shredder import shred


def regions(spark, sf_dir) -> DataFrame:
    """A document a region: r_regionkey, r_name, nations (by key)."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return table(spark, sf_dir, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "nations")


def trees(docs: DataFrame, key: str) -> DataFrame:
    return shred(as_text(docs, key), "json", keep=[key])


def judged(df: DataFrame, text: str, f, into: str, kind: str = "string") -> DataFrame:
    """Adds what a function of Python makes of each text, in Arrow batches."""

    @F.pandas_udf(kind)
    def each(s: pd.Series) -> pd.Series:
        return pd.Series([f(t) for t in s], dtype=object)

    return df.withColumn(into, each(F.col(text)))


def cases(rows: list[tuple[str, object]]) -> tuple[list[tuple[str, object]], str]:
    """Templates with a # for a name, and as SQL VALUES beside what each must give."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    lit = lambda x: quote(x) if isinstance(x, str) else str(x).upper()
    return rows, ", ".join(f"({i}, {lit(want)})" for i, (_, want) in enumerate(rows))


def over_nations(spark, sf_dir, rows: list[tuple[str, object]]) -> DataFrame:
    """(n_nationkey, number, text): every template with every nation's name in lower case."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.lit(t).alias("template")) for i, (t, _) in enumerate(rows)])).alias("c")
    named = table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")).alias("name"), parts)
    return named.select("n_nationkey", "c.number", F.expr("replace(c.template, '#', name)").alias("text"))


def over_nations_sql(values: str, column: str) -> str:
    return f"SELECT n_nationkey, number, {column} FROM nation, (VALUES {values}) t(number, {column})"


# filters


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE (o_orderstatus = 'P' OR o_totalprice > 300000) AND o_orderkey > 10")
def or_and_parentheses(spark, sf_dir):
    return typed(customers(spark, sf_dir), "c_custkey", "$.orders[?(@.o_orderstatus == 'P' || @.o_totalprice > 300000) && @.o_orderkey > 10].o_orderkey", "o_orderkey")


@query("SELECT l_orderkey AS o_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey FROM lineitem WHERE l_returnflag <> 'N'")
def not_equal(spark, sf_dir):
    docs = trees(orders(spark, sf_dir), "o_orderkey")
    return docs.select("o_orderkey", F.explode(RowLocal(path("$.lines[?@.l_returnflag != 'N'].l_partkey"), "doc").values()).alias("l_partkey"))


@query("SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 3")
def less_or_equal(spark, sf_dir):
    return typed(orders(spark, sf_dir), "o_orderkey", "$.lines[?@.l_quantity <= 3].l_linenumber", "l_linenumber")


@query("SELECT n_regionkey AS r_regionkey, n_name FROM nation WHERE n_name >= 'M' AND 'V' > n_name")
def string_order(spark, sf_dir):
    return typed(regions(spark, sf_dir), "r_regionkey", "$.nations[?@.n_name >= 'M' && 'V' > @.n_name].n_name", "n_name")


@query("SELECT n_nationkey, 7 AS n FROM nation")
def order_between_kinds(spark, sf_dir):
    """Of different kinds nothing is less; the same and the missing are at most themselves."""
    tests = ["1 < 'a'", "'a' < 1", "true < false", "null <= null", "true <= true", "@.x <= @.y", "null == @.x", "@.x != null", "'B' < 'a'", "1 <= 1.0", "true >= false", "'' < 'a'"]
    text = '{"v": [' + ",".join('{"z": %d}' % i for i in range(len(tests))) + "]}"
    docs = shred(table(spark, sf_dir, "nation").select("n_nationkey", F.lit(text).alias("json")), "json", keep=["n_nationkey"])
    one = " || ".join(f"(@.z == {i} && {t})" for i, t in enumerate(tests))
    return docs.select("n_nationkey", RowLocal(path(f"$.v[?{one}]"), "doc").count().alias("n"))


@query("SELECT o_orderkey, n FROM (SELECT l_orderkey AS o_orderkey, CAST(count(*) FILTER (WHERE l_quantity > 10) AS INTEGER) AS n FROM lineitem GROUP BY 1) WHERE n > 0")
def nested_filter_and_size(spark, sf_dir):
    docs = trees(orders(spark, sf_dir), "o_orderkey")
    hit = docs.where(RowLocal(path("$[?@[?@.l_quantity > 10]]"), "doc").exists())
    return hit.select("o_orderkey", RowLocal(path("$.lines[?@.l_quantity > 10]"), "doc").count().alias("n"))


@query("SELECT l_orderkey AS o_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) < 20")
def max_aggregate(spark, sf_dir):
    docs = orders(spark, sf_dir)
    return docs.where(Typed(with_aggregates().compile("$[?max(@[*].l_quantity) < 20]"), docs.select("lines")).exists()).select("o_orderkey")


@query("SELECT n_nationkey, 5 AS equal FROM nation")
def numbers_by_value(spark, sf_dir):
    n = F.col("n_nationkey") + 1
    ways = F.concat_ws(",", n, F.concat(n, F.lit(".0")), F.concat(n, F.lit("e0")), F.concat(n, F.lit("0E-1")), F.concat(n, F.lit(".00")), F.concat(F.lit('"'), n, F.lit('"')), F.concat(n, F.lit(".000000000000000000000000000001")))
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('{"k":'), n, F.lit(',"v":['), ways, F.lit("]}")).alias("json"))
    return shred(docs, "json", keep=["n_nationkey"]).select("n_nationkey", RowLocal(path("$.v[?@ == $.k]"), "doc").count().alias("equal"))


@query("SELECT n_nationkey, n_nationkey < 10 AS alike FROM nation")
def deep_equality_of_values(spark, sf_dir):
    """Members in any order, elements in theirs, numbers by value; two texts that differ from key 10 on."""
    other = F.when(F.col("n_nationkey") < 10, "[1,2]").otherwise("[2,1]")
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.array(F.lit('{"a":[1,2],"b":{"c":null}}'), F.concat(F.lit('{"b":{"c":null},"a":'), other, F.lit("}")))).alias("both"))
    alike = lambda t: (lambda a, b: equal(json_text.parse(a), json_text.parse(b)))(*json.loads(t))
    return judged(docs, "both", alike, "alike", "boolean").drop("both")


# results


@query("""SELECT c_custkey, '"' || c_name || '"' AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def single_value(spark, sf_dir):
    return trees(customers(spark, sf_dir), "c_custkey").select("c_custkey", RowLocal(path("$.c_name"), "doc").single().alias("name"))


@query("SELECT l_orderkey AS o_orderkey, '$[''lines''][' || (r - 1) || ']' AS path, CAST(l_linenumber AS VARCHAR) AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE l_quantity > 45")
def nodes_with_paths(spark, sf_dir):
    docs = trees(orders(spark, sf_dir), "o_orderkey")
    row = lambda q: RowLocal(path(q), "doc")
    both = F.arrays_zip(row("$.lines[?@.l_quantity > 45]").paths().alias("path"), row("$.lines[?@.l_quantity > 45].l_linenumber").values().alias("line"))
    return docs.select("o_orderkey", F.explode(both).alias("b")).select("o_orderkey", F.col("b.path").alias("path"), F.col("b.line").alias("line"))


@query("""SELECT n_regionkey AS r_regionkey, '/nations/' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) || '/n_name' AS pointer, n_name AS name,
'$[''nations''][' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) || ']' AS parent FROM nation""")
def path_pointers(spark, sf_dir):
    """Normalized paths are read back, turned into pointers and parents, and resolved in their document."""
    docs = shred(as_text(regions(spark, sf_dir), "r_regionkey"), "json")
    found = docs.select("r_regionkey", "json", F.explode(RowLocal(path("$..n_name"), "doc").paths()).alias("path"))

    @F.pandas_udf("pointer string, parent string, name string")
    def read(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p in zip(texts, paths, strict=True):
            at = NormalizedPath.parse(p)
            rows.append((at.pointer(), str(at.parent()), at.resolve(json_text.parse(t))[1]))
        return pd.DataFrame(rows, columns=["pointer", "parent", "name"])

    return found.select("r_regionkey", read("json", "path").alias("r")).select("r_regionkey", "r.pointer", "r.parent", "r.name")


@query("SELECT n_nationkey, CAST(n_nationkey % 4 AS INTEGER) AS kept FROM nation WHERE n_nationkey % 4 <= 2")
def result_limit(spark, sf_dir):
    """Documents with more results than the bound fail, the others answer."""
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.array_repeat(F.lit(1), (F.col("n_nationkey") % 4).cast("int"))).alias("json"))
    found = kernel.select(docs, "json", path("$[*]").with_limits(results=2), mode="error")
    return found.where("nodes_error is null").select("n_nationkey", F.size("nodes").alias("kept"))


@query("SELECT n_nationkey, 'more than 6 visited nodes' AS reason FROM nation WHERE n_nationkey % 8 * 2 > 6")
def visit_limit(spark, sf_dir):
    """Every element is visited as a descendant and as a child."""
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.array_repeat(F.lit(1), (F.col("n_nationkey") % 8).cast("int"))).alias("json"))
    found = kernel.select(docs, "json", path("$..*").with_limits(visits=6), mode="error")
    return found.where("nodes_error is not null").select("n_nationkey", F.regexp_extract("nodes_error", "^(.*) at ", 1).alias("reason"))


@query("SELECT n_nationkey, n_nationkey % 8 > 4 AS failed FROM nation")
def depth_limit(spark, sf_dir):
    n = (F.col("n_nationkey") % 8).cast("int")
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.repeat(F.lit("["), n), F.lit("1"), F.repeat(F.lit("]"), n)).alias("json"))
    return kernel.select(docs, "json", path("$..*").with_limits(depth=4), mode="error").select("n_nationkey", F.col("nodes_error").isNotNull().alias("failed"))


@query("SELECT n_regionkey AS r_regionkey, '\"' || n_name || '\"' AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def exploded_wildcard(spark, sf_dir):
    nodes = node_table(trees(regions(spark, sf_dir), "r_regionkey"), "r_regionkey")
    return Exploded(path("$.nations[*].n_name"), nodes).values().select(F.col("doc_id").alias("r_regionkey"), F.col("value").alias("name"))


@query("SELECT n_regionkey AS r_regionkey, list(n_nationkey ORDER BY n_nationkey)[-2]::VARCHAR AS key FROM nation GROUP BY n_regionkey HAVING count(*) >= 2")
def exploded_negative_index(spark, sf_dir):
    nodes = node_table(trees(regions(spark, sf_dir), "r_regionkey"), "r_regionkey")
    return Exploded(path("$.nations[-2].n_nationkey"), nodes).values().select(F.col("doc_id").alias("r_regionkey"), F.col("value").alias("key"))


@query("SELECT n_regionkey AS r_regionkey, n_name AS typed, '\"' || n_name || '\"' AS rowlocal, '\"' || n_name || '\"' AS kernel FROM nation WHERE n_nationkey > 5")
def models_agree(spark, sf_dir):
    """The same query on columns, trees and parsed values."""
    docs, q = regions(spark, sf_dir), path("$.nations[?@.n_nationkey > 5].n_name")
    texts = kernel.select(shred(as_text(docs, "r_regionkey"), "json"), "json", q)
    other = texts.select("r_regionkey", F.arrays_zip(RowLocal(q, "doc").values().alias("rowlocal"), F.col("nodes.value").alias("kernel")).alias("z"))
    both = docs.select("r_regionkey", Typed(q, docs).values().alias("typed")).join(other, "r_regionkey")
    each = both.select("r_regionkey", F.posexplode("typed").alias("i", "typed"), "z")
    return each.select("r_regionkey", "typed", F.col("z")[F.col("i")]["rowlocal"].alias("rowlocal"), F.col("z")[F.col("i")]["kernel"].alias("kernel"))


# the language: valid and not, singular and not

GRAMMAR, _GRAMMAR_SQL = cases([
    ("$.#", "VALID_SINGLE_VALUE"), ("$['#']", "VALID_SINGLE_VALUE"), ('$["#"][0]', "VALID_SINGLE_VALUE"), ("$ .# [0]", "VALID_SINGLE_VALUE"), ("$ .# [ * ]", "VALID"), ("$.#é_1", "VALID_SINGLE_VALUE"), ("$['\\u00e9\\ud83d\\ude00#']", "VALID_SINGLE_VALUE"),
    ("$.#[*]", "VALID"), ("$..#", "VALID"), ("$['#','#']", "VALID"), ("$.#[1:5:2]", "VALID"), ("$.#[?@.a]", "VALID"), ("$[?!@.# || (@.a && @.b)]", "VALID"), ("$[?@.# == -1.5e+3]", "VALID"), ("$[?length(@.#) > 2]", "VALID"), ("$[?count(@..#) > 2]", "VALID"),
    ("$[?value(@..#) == 'x']", "VALID"), ("$[?match(@.a, '#.*')]", "VALID"), ("$[?search(@.#, @.p)]", "VALID"), ("$[?@.a == null && @.b == true || @.# != false]", "VALID"), ("$[?@.# == $.x['y'][0]]", "VALID"), ("$[?@[?@.#]]", "VALID"),
    ("#", "NOT_RFC_9535"), (" $.#", "NOT_RFC_9535"), ("$.# ", "NOT_RFC_9535"), ("$.", "NOT_RFC_9535"), ("$.1#", "NOT_RFC_9535"), ("$.#-x", "NOT_RFC_9535"), ("$[#]", "NOT_RFC_9535"), ("$['#',]", "NOT_RFC_9535"), ("$[01]", "NOT_RFC_9535"), ("$[-0]", "NOT_RFC_9535"), ("$[9007199254740992]", "NOT_RFC_9535"), ("$['#\\x']", "NOT_RFC_9535"),
    ("$['\\ud800#']", "NOT_RFC_9535"), ("$[?@.# = 1]", "NOT_RFC_9535"), ("$[?@.#[*] == 1]", "NOT_RFC_9535"), ("$[?@.# == 01]", "NOT_RFC_9535"), ("$[?@.# == 1.]", "NOT_RFC_9535"), ("$[?'#']", "NOT_RFC_9535"), ("$[?length(@.#)]", "NOT_RFC_9535"), ("$[?length(@.*) > 1]", "NOT_RFC_9535"), ("$[?count('#') > 1]", "NOT_RFC_9535"),
    ("$[?match(@.#)]", "NOT_RFC_9535"), ("$[?match(@.#, 'a') == true]", "NOT_RFC_9535"), ("$[?#(@.a)]", "NOT_RFC_9535"), ("$[?!!@.#]", "NOT_RFC_9535"), ("$[?!@.# == 1]", "NOT_RFC_9535"), ("$[?@.a == @.b == @.#]", "NOT_RFC_9535"), ("$...#", "NOT_RFC_9535"), ("$..", "NOT_RFC_9535"), ("$.#[0 1]", "NOT_RFC_9535"), ("$[? (@.#)", "NOT_RFC_9535"),
])


@query(over_nations_sql(_GRAMMAR_SQL, "assessment"))
def grammar(spark, sf_dir):
    return compare.assess_table(over_nations(spark, sf_dir, GRAMMAR), "text").select("n_nationkey", "number", "assessment")


def _place(text: str) -> int:
    try:
        parse(text)
    except JsonPathSyntaxError as e:
        return e.position
    return -1


@query("SELECT n_nationkey, CAST(n_nationkey + 3 AS INTEGER) AS place FROM nation")
def error_place(spark, sf_dir):
    """An expression that breaks off names the place."""
    texts = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("$."), F.repeat(F.lit("a"), F.col("n_nationkey").cast("int") + 1), F.lit("]")).alias("text"))
    return judged(texts, "text", _place, "place", "int").drop("text")


@query("SELECT n_nationkey, n_nationkey * 4 < 64 AS valid FROM nation")
def nesting(spark, sf_dir):
    n = F.col("n_nationkey").cast("int") * 4
    texts = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("$[?"), F.repeat(F.lit("("), n), F.lit("@.a"), F.repeat(F.lit(")"), n), F.lit("]")).alias("text"))
    return judged(texts, "text", lambda t: compare.assess(t) == "VALID", "valid", "boolean").drop("text")


# functions of one's own

OWN = Compiler(
    Function("twice", (A.VALUE,), A.VALUE, lambda v: NOTHING if v is NOTHING or isinstance(v, (str, bool)) or v is None else v * 2),
    Function("even", (A.VALUE,), A.LOGICAL, lambda v: isinstance(v, int) and v % 2 == 0),
    Function("largest", (A.NODES,), A.VALUE, lambda vs: max(vs) if vs else NOTHING),
    Function("tail", (A.NODES,), A.NODES, lambda vs: vs[1:]),
    Function("neither", (A.LOGICAL, A.LOGICAL), A.LOGICAL, lambda a, b: not (a or b)),
    function("last_digit", (A.VALUE,), A.VALUE, lambda v: Value.of(int(v.text()[-1])) if v.text() else ABSENT),
    Function("fails", (A.VALUE,), A.LOGICAL, lambda v: 1 // (int(v) % 5 - 4) < 9),
)


def _own(spark, sf_dir, q: str) -> DataFrame:
    found = kernel.select(as_text(regions(spark, sf_dir), "r_regionkey"), "json", OWN.compile(q))
    return found.select("r_regionkey", F.explode("nodes.value").alias("key"))


@query("SELECT n_regionkey AS r_regionkey, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey * 2 > 30")
def own_value_function(spark, sf_dir):
    return _own(spark, sf_dir, "$.nations[?twice(@.n_nationkey) > 30].n_nationkey")


@query("SELECT n_regionkey AS r_regionkey, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey % 2 = 0")
def own_logical_function(spark, sf_dir):
    return _own(spark, sf_dir, "$.nations[?even(@.n_nationkey)].n_nationkey")


@query("SELECT n_regionkey AS r_regionkey, CAST(max(n_nationkey) AS VARCHAR) AS key FROM nation GROUP BY n_regionkey")
def own_nodes_function(spark, sf_dir):
    return _own(spark, sf_dir, "$.nations[?@.n_nationkey == largest($.nations[*].n_nationkey)].n_nationkey")


@query("SELECT n_regionkey AS r_regionkey, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey % 2 = 1 AND n_name NOT LIKE '%3%'")
def own_function_of_tests(spark, sf_dir):
    return _own(spark, sf_dir, "$.nations[?neither(even(@.n_nationkey), search(@.n_name, '3'))].n_nationkey")


@query("SELECT n_regionkey AS r_regionkey, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_name LIKE '%7'")
def own_function_with_accessors(spark, sf_dir):
    """Numbers have no text, so the function is absent for them, and equal to nothing that is there."""
    return _own(spark, sf_dir, "$.nations[?last_digit(@.n_name) == 7 && last_digit(@.n_nationkey) != 7 && last_digit(@.n_nationkey) == @.none].n_nationkey")


@query("SELECT n_nationkey, n_nationkey % 5 = 4 AS failed FROM nation")
def failing_function(spark, sf_dir):
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.array("n_nationkey")).alias("json"))
    return kernel.select(docs, "json", OWN.compile("$[?fails(@)]"), mode="error").select("n_nationkey", F.col("nodes_error").isNotNull().alias("failed"))


# patterns

PATTERNS = ("[A-Z]+", "[A-Z_]*1.", "(N|M).*[02468]", ".{8}", ".{4,8}", "[^3-5]+", "\\p{Lu}+_\\p{Nd}{2}", "\\P{Nd}+\\P{Lu}", "N.*(_1|_2)[0-9]?", ".*", "[A-N][A-Z]{3,}_[7-9]", "(NA|TI).*(A|1)", "\\u", "[a", "a{3,2}", "(")
_VALID = PATTERNS[:12]


@query("SELECT n_nationkey, p, CASE WHEN p < 12 THEN CASE p " + " ".join(f"WHEN {i} THEN regexp_full_match(n_name, '{x}')" for i, x in enumerate(_VALID)) + " END ELSE FALSE END AS hit FROM nation, range(16) r(p)")
def patterns_from_documents(spark, sf_dir):
    """Whole matches by patterns that stand in the documents; what is no pattern matches nothing."""
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("p"), F.lit(x).alias("x")) for i, x in enumerate(PATTERNS)])).alias("c")
    docs = table(spark, sf_dir, "nation").select("n_nationkey", each, "n_name").select("n_nationkey", "c.p", F.to_json(F.array(F.struct(F.col("n_name").alias("s"), F.col("c.x").alias("p")))).alias("json"))
    return kernel.select(docs, "json", path("$[?match(@.s, @.p)]")).select("n_nationkey", "p", (F.size("nodes") > 0).alias("hit"))


@query("SELECT n_nationkey, p, CASE p " + " ".join(f"WHEN {i} THEN regexp_matches(n_name, '{x}')" for i, x in enumerate(_VALID)) + " END AS hit FROM nation, range(12) r(p)")
def searches_from_documents(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("p"), F.lit(x).alias("x")) for i, x in enumerate(_VALID)])).alias("c")
    docs = table(spark, sf_dir, "nation").select("n_nationkey", each, "n_name").select("n_nationkey", "c.p", F.to_json(F.array(F.struct(F.col("n_name").alias("s"), F.col("c.x").alias("p")))).alias("json"))
    return kernel.select(docs, "json", path("$[?search(@.s, @.p)]")).select("n_nationkey", "p", (F.size("nodes") > 0).alias("hit"))


@query("SELECT n_nationkey, TRUE AS optional, FALSE AS nested, FALSE AS late FROM nation")
def hostile_match(spark, sf_dir):
    """Patterns that backtracking engines take exponential time for, on some thousand letters."""
    letters = F.repeat(F.lit("a"), 20 + F.col("n_nationkey").cast("int") * 50)
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.array(F.repeat(F.lit("a"), 40), letters)).alias("json"))
    row = kernel.select(docs, "json", path("$[0][?match(@, 'x')]"), into="none").drop("none")
    for name, q in (("optional", f"$[?match(@, '{'a?' * 40}{'a' * 40}')]"), ("nested", "$[?match(@, '((a+)+)+b')]"), ("late", "$[?match(@, '(a*)*(a|aa)*c')]")):
        row = kernel.select(row, "json", path(q), into=name)
    return row.select("n_nationkey", *[(F.size(c) > 0).alias(c) for c in ("optional", "nested", "late")])


@query("SELECT n_nationkey, n_nationkey > 20 AS ends, n_nationkey > 20 AS found FROM nation")
def hostile_search(spark, sf_dir):
    """Searches that start anew at every letter; the first also as a column."""
    letters = F.concat(F.repeat(F.lit("a"), 20_000), F.when(F.col("n_nationkey") > 20, "b").otherwise("c"))
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.array(letters).alias("t"))
    docs = docs.select("n_nationkey", Typed(path("$.t[?search(@, 'a*b')]"), docs.select("t")).exists().alias("ends"), F.to_json("t").alias("json"))
    return kernel.select(docs, "json", path("$[?search(@, '(a|aa)*b')]")).select("n_nationkey", "ends", (F.size("nodes") > 0).alias("found"))


# strict texts

STRICT, _STRICT_SQL = cases([
    ('{"#":1}', False), ('[1,"#",null,true,{"a":[]}]', False), ('"#"', False), ('{"#":1,"#":2}', True), ('{"#":1,"\\u0061#":2}', False), ("{'#':1}", True), ('{"#":1,}', True), ("[1,]", True), ("[01]", True), ("[1.]", True), ("[.5]", True), ("[+1]", True), ("[-]", True), ("[1e]", True), ("[-0, 1E+2, 0.5e-3]", False),
    ("[NaN]", True), ("[tru]", True), ('["#\\x"]', True), ('["#\\ud83d\\ude00"]', False), ('["#\\ud83d"]', True), ('["#\t"]', True), ('["#]', True), ("[1 2]", True), ("[1] 2", True), ("", True), (" [1]\n", False), ("/* # */ 1", True), ("﻿[1]", True), ("123456789012345678901234567890.12345", False),
])


@query(over_nations_sql(_STRICT_SQL, "bad"))
def strict_texts(spark, sf_dir):
    docs = shred(over_nations(spark, sf_dir, STRICT), "text", mode="error")
    return docs.select("n_nationkey", "number", F.col("text_error" if "text_error" in docs.columns else "doc_error").isNotNull().alias("bad"))


@query("SELECT n_nationkey, n_nationkey > 12 AS bad FROM nation")
def strict_depth(spark, sf_dir):
    n = F.col("n_nationkey").cast("int") + 988
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.repeat(F.lit("["), n), F.repeat(F.lit("]"), n)).alias("json"))
    return shred(docs, "json", mode="error").select("n_nationkey", F.col("doc_error").isNotNull().alias("bad"))


@query("SELECT n_nationkey, CAST(length(n_name) + 3 AS INTEGER) AS points FROM nation")
def length_in_code_points(spark, sf_dir):
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.length("n_name").alias("n"), F.concat(F.lit('["\\ud83d\\ude00é\\u0000'), "n_name", F.lit('"]')).alias("json"))
    lengths = [RowLocal(path(f"$[?length(@) == {k}]"), "doc").exists() for k in range(40)]
    tree = shred(docs, "json", keep=["n_nationkey"])
    return tree.select("n_nationkey", F.coalesce(*[F.when(c, k) for k, c in enumerate(lengths)]).alias("points"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","key":' || n_nationkey || ',"on":"yes","tags":["a",null,1.5],"day":"2024-01-01"}' AS json FROM nation""")
def yaml_texts(spark, sf_dir):
    """YAML by its JSON rules: yes and dates are strings."""
    text = F.concat(F.lit("name: "), F.to_json(F.array("n_name")).substr(F.lit(2), F.length("n_name") + 2), F.lit("\nkey: "), "n_nationkey", F.lit("\non: yes\ntags:\n- a\n- null\n- 1.5\nday: 2024-01-01\n"))
    return judged(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "text", lambda t: json_text.write(documents.parse(t)), "json").drop("text")


@query("SELECT n_nationkey, TRUE AS json, TRUE AS yaml FROM nation")
def written_texts(spark, sf_dir):
    """What is written in either format reads back as the same value."""
    text = F.to_json(F.struct("n_name", "n_nationkey", F.array(F.lit("1"), F.lit("true"), F.lit("a: b\n#"), F.lit("")).alias("odd"), F.lit(0.1).alias("x")))

    def back(kind: str):
        return lambda t: equal(documents.parse_as(documents.write(json_text.parse(t), kind), kind), json_text.parse(t))

    docs = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))
    return judged(judged(docs, "text", back(documents.JSON), "json", "boolean"), "text", back(documents.YAML), "yaml", "boolean").drop("text")


# overlays


def _overlaid(spark, sf_dir, actions: list[dict], version: str = "1.1.0", options: overlay.Options = overlay.Options(), **more) -> DataFrame:
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.struct("n_name", "n_regionkey").alias("info"), F.array("n_nationkey").alias("keys"), F.lit("old").alias("state"))).alias("json"))
    patch = overlay.Overlay.of({"overlay": version, "info": {"title": "t", "version": "1"}, **more, "actions": actions})
    return overlay.apply(docs, "json", patch, options, mode="error")


def _written(keys: str, state: str = '"old"', info: str = "") -> str:
    return f"""SELECT n_nationkey, '{{"info":{{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '{info}}},"keys":{keys},"state":{state}}}' AS document FROM nation"""


@query(_written("[' || n_nationkey || ',7,8,9]"))
def overlay_of_arrays(spark, sf_dir):
    """An array is extended by an array and gets anything else as an element."""
    return _overlaid(spark, sf_dir, [{"target": "$.keys", "update": [7, 8]}, {"target": "$.keys", "update": 9}]).select("n_nationkey", "overlaid.document")


@query(_written("[' || n_nationkey || ']", '"new"', ',"more":{"a":1,"b":2}'))
def overlay_of_values(spark, sf_dir):
    """Objects merge deeply, primitives are replaced."""
    return _overlaid(spark, sf_dir, [{"target": "$.state", "update": "new"}, {"target": "$.info", "update": {"more": {"a": 1}}}, {"target": "$.info", "update": {"more": {"b": 2}}}]).select("n_nationkey", "overlaid.document")


@query("SELECT n_nationkey, TRUE AS strict, FALSE AS lenient FROM nation")
def overlay_of_other_kinds(spark, sf_dir):
    """A primitive does not become an object unless merging is lenient."""
    action = [{"target": "$.state", "update": {"a": 1}}]
    strict = _overlaid(spark, sf_dir, action).select("n_nationkey", F.col("overlaid.error").isNotNull().alias("strict"))
    lenient = _overlaid(spark, sf_dir, action, options=overlay.Options(lenient_merge=True)).select("n_nationkey", (F.get_json_object("overlaid.document", "$.state.a") != "1").alias("lenient"))
    return strict.join(lenient, "n_nationkey")


@query("SELECT n_nationkey, CAST(1 AS INTEGER) AS warnings, TRUE AS failed FROM nation")
def overlay_without_targets(spark, sf_dir):
    action = [{"target": "$.nope", "remove": True}]
    one = _overlaid(spark, sf_dir, action).select("n_nationkey", F.size("overlaid.warnings").alias("warnings"))
    return one.join(_overlaid(spark, sf_dir, action, options=overlay.Options(fail_on_no_match=True)).select("n_nationkey", F.col("overlaid.error").isNotNull().alias("failed")), "n_nationkey")


@query("SELECT n_nationkey, CAST(1 AS INTEGER) AS changes, CAST(n_nationkey AS VARCHAR) || ',1' AS keys FROM nation")
def overlay_of_one_place_twice(spark, sf_dir):
    out = _overlaid(spark, sf_dir, [{"target": "$['keys','keys']", "update": 1}])
    return out.select("n_nationkey", F.size("overlaid.changes").alias("changes"), F.regexp_replace(F.get_json_object("overlaid.document", "$.keys"), "[\\[\\]]", "").alias("keys"))


@query(_written("[' || n_nationkey || ']").replace(',"state":"old"', ""))
def overlay_removes_before_it_updates(spark, sf_dir):
    return _overlaid(spark, sf_dir, [{"target": "$.state", "remove": True, "update": "new"}], version="1.0.0").select("n_nationkey", "overlaid.document")


OVERLAYS, _OVERLAYS_SQL = cases([
    ('{"overlay":"1.0.0","info":{"title":"#","version":"1"},"actions":[{"target":"$","update":{}}]}', True), ('{"overlay":"1.1.0","info":{"title":"#","version":"1"},"actions":[{"target":"$.a","copy":"$.b"}]}', True),
    ('{"overlay":"1.0.0","info":{"title":"#","version":"1"},"actions":[]}', False), ('{"overlay":"9.0.0","info":{"title":"#","version":"1"},"actions":[{"target":"$","update":{}}]}', False), ('{"info":{"title":"#","version":"1"},"actions":[{"target":"$","update":{}}]}', False),
    ('{"overlay":"1.0.0","info":{"title":"#"},"actions":[{"target":"$","update":{}}]}', False), ('{"overlay":"1.0.0","info":{"title":"#","version":"1"},"actions":[{"update":{}}]}', False), ('{"overlay":"1.0.0","info":{"title":"#","version":"1"},"actions":[{"target":"$[","update":{}}]}', False),
    ('{"overlay":"1.0.0","info":{"title":"#","version":"1"},"actions":[{"target":"$","update":{}}],"x-#":1}', True), ('{"overlay":"1.0.0","info":{"title":"#","version":"1"},"actions":[{"target":"$","update":{}}],"#":1}', False),
])


@query(over_nations_sql(_OVERLAYS_SQL, "valid"))
def overlay_rules(spark, sf_dir):
    return judged(over_nations(spark, sf_dir, OVERLAYS), "text", lambda t: not overlay.Overlay.validate(json_text.parse(t)), "valid", "boolean").drop("text")


# comparison


def _keys(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@query("SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN 'SAME' WHEN 1 THEN 'SAME_VALUES_DIFFERENT_ORDER' WHEN 2 THEN 'DIFFERENT_VALUES' WHEN 3 THEN 'ONLY_LEFT' WHEN 4 THEN 'ONLY_RIGHT' WHEN 5 THEN 'LEFT_FAILS' WHEN 6 THEN 'RIGHT_FAILS' ELSE 'BOTH_REJECT' END AS outcome FROM nation")
def comparison_outcomes(spark, sf_dir):
    k = F.col("n_nationkey") % 8
    left = F.when(k == 4, _keys()).otherwise(_keys("n1", "n2"))
    right = F.when(k == 1, _keys("n2", "n1")).when(k == 2, _keys("n1", "n1")).when(k == 3, _keys()).otherwise(_keys("n1", "n2"))
    return table(spark, sf_dir, "nation").select("n_nationkey", compare.outcome(left, right, F.when(k.isin(5, 7), "x"), F.when(k > 5, "y")).alias("outcome"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'NOT_A_LITERAL' WHEN 1 THEN 'WRITE_API' WHEN 2 THEN 'VALID' ELSE 'NOT_RFC_9535' END AS assessment, TRUE AS has_hint FROM nation")
def assessment_of_calls(spark, sf_dir):
    """A computed expression is no literal whatever the call; every finding says what to do."""
    k = F.col("n_nationkey") % 4
    text = F.when(k == 1, "$.a").when(k == 2, "$..a").when(k == 3, "$.a[")
    calls = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("e"), F.when(F.col("n_nationkey") % 4 < 2, "set").otherwise("read").alias("call"))
    return compare.assess_table(calls, "e", "call").select("n_nationkey", "assessment", F.col("hint").isNotNull().alias("has_hint"))


@query("SELECT r_regionkey, TRUE AS size, r_regionkey = 0 AS value, TRUE AS paths, TRUE AS missing FROM region")
def assertions(spark, sf_dir):
    check = lambda q: compare.Checks(path(q))
    docs = trees(regions(spark, sf_dir), "r_regionkey")
    return docs.select("r_regionkey", check("$.nations[0:2]").has_size(2).alias("size"), check("$.r_regionkey").value(0).alias("value"), check("$.nations[::3][?@.n_name == 'no']").paths().alias("paths"), check("$.none").does_not_exist().alias("missing"))
