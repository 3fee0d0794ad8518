"""Queries of the engine over the driver's tables, each with equal DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators import compare, kernel, overlay
from nodeloom.operators.exploded import Exploded, node_table
from nodeloom.operators.rowlocal import RowLocal
from nodeloom.operators.typed import Typed
from nodeloom.plans.query import compile as path, with_aggregates
from nodeloom.sources.shredder import shred
from nodeloom.sources.store import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a customer: c_custkey, c_name, c_mktsegment, top, orders (by key)."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"))).alias("orders"), F.max("o_totalprice").alias("top")
    )
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "c_mktsegment", "top", "orders")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document an order: o_orderkey and its lines by number."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))


def as_text(docs: DataFrame, key: str) -> DataFrame:
    """The same documents as JSON text."""
    return docs.select(key, F.to_json(F.struct(*docs.columns)).alias("json"))


def typed(docs: DataFrame, key: str, expression: str, into: str, compiler=path) -> DataFrame:
    return docs.select(key, F.explode(Typed(compiler(expression), docs).values()).alias(into))


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_totalprice > 100000 AND o_orderstatus = 'F'""")
def customer_orders_filter(spark, sf_dir):
    return typed(customers(spark, sf_dir), "c_custkey", "$.orders[?@.o_totalprice > 100000 && @.o_orderstatus == 'F'].o_orderkey", "o_orderkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_name(spark, sf_dir):
    docs = shred(table(spark, sf_dir, "events"), "props", keep=["event_id"])
    return docs.select("event_id", RowLocal(path("$.k"), "doc").first().cast("long").alias("k"))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 GROUP BY event_type")
def props_filter_count(spark, sf_dir):
    docs = shred(table(spark, sf_dir, "events"), "props", keep=["event_type"])
    return docs.where(RowLocal(path("$[?@ >= 50]"), "doc").exists()).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def text_wildcard(spark, sf_dir):
    docs = shred(as_text(customers(spark, sf_dir), "c_custkey"), "json", keep=["c_custkey"])
    found = docs.select("c_custkey", F.explode(RowLocal(path("$.orders[*].o_orderkey"), "doc").values()).alias("o_orderkey"))
    return found.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT l_orderkey AS o_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE r = 1")
def line_index(spark, sf_dir):
    return typed(orders(spark, sf_dir), "o_orderkey", "$.lines[0].l_partkey", "l_partkey")


@query("SELECT l_orderkey AS o_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS r FROM lineitem) WHERE r = 1")
def line_negative_index(spark, sf_dir):
    return typed(orders(spark, sf_dir), "o_orderkey", "$.lines[-1].l_linenumber", "l_linenumber")


@query("SELECT l_orderkey AS o_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r IN (2, 3)")
def line_slice(spark, sf_dir):
    return typed(orders(spark, sf_dir), "o_orderkey", "$.lines[1:3].l_linenumber", "l_linenumber")


@query("""SELECT l_orderkey AS o_orderkey, to_json(list(l_linenumber ORDER BY l_linenumber DESC) FILTER (WHERE (n - r) % 2 = 0))::VARCHAR AS reversed FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey""")
def line_slice_reversed(spark, sf_dir):
    docs = orders(spark, sf_dir)
    return docs.select("o_orderkey", F.to_json(Typed(path("$.lines[::-2].l_linenumber"), docs).values()).alias("reversed"))


@query("SELECT o_custkey AS c_custkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def descendant(spark, sf_dir):
    lines = orders(spark, sf_dir)
    docs = table(spark, sf_dir, "orders").join(lines, "o_orderkey").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "lines")).alias("orders"))
    found = Typed(path("$..l_quantity"), docs).values()
    return docs.select(F.col("o_custkey").alias("c_custkey"), F.size(found).cast("long").alias("n"), F.aggregate(found, F.lit(0.0), lambda a, x: a + x).cast("long").alias("quantity"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists(spark, sf_dir):
    docs = customers(spark, sf_dir)
    return docs.where(Typed(path("$.orders[?@.o_orderstatus == 'P']"), docs).exists()).select("c_custkey")


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def not_exists(spark, sf_dir):
    docs = shred(as_text(customers(spark, sf_dir), "c_custkey"), "json", keep=["c_custkey"])
    return docs.where(compare.Checks(path("$[?!@[?@.o_totalprice > 200000] && @[0]]")).exists()).select("c_custkey")


@query("SELECT o_custkey AS c_custkey, o_orderkey FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders) WHERE o_totalprice = top AND o_custkey IN (SELECT c_custkey FROM customer)")
def absolute_query(spark, sf_dir):
    docs = shred(as_text(customers(spark, sf_dir), "c_custkey"), "json", keep=["c_custkey"])
    found = docs.select("c_custkey", F.explode(RowLocal(path("$.orders[?@.o_totalprice == $.top].o_orderkey"), "doc").values()).alias("o_orderkey"))
    return found.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT conv_id, turn FROM conversations WHERE length(text) > 200 AND role = 'user'")
def length_function(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return typed(docs, "conv_id", "$.turns[?length(@.text) > 200 && @.role == 'user'].turn", "turn")


@query("SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4")
def count_function(spark, sf_dir):
    docs = shred(as_text(orders(spark, sf_dir), "o_orderkey"), "json", keep=["o_orderkey"])
    hit = docs.where(RowLocal(path("$[?count(@[*]) >= 4]"), "doc").exists())
    return hit.select("o_orderkey", RowLocal(path("$.lines[*]"), "doc").count().cast("long").alias("n"))


@query("SELECT o_custkey AS c_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey HAVING count(*) = 1")
def value_function(spark, sf_dir):
    docs = customers(spark, sf_dir)
    return typed(docs, "c_custkey", "$[?value(@[*].o_orderkey) > 0][0].o_orderkey", "o_orderkey")


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3][0-9]*')")
def match_function(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    docs = parts.groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.collect_list(F.struct("p_partkey", "p_brand")).alias("parts"))
    return docs.select(F.explode(Typed(path("$.parts[?match(@.p_brand, 'Brand#[1-3][0-9]*')].p_partkey"), docs).values()).alias("p_partkey"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(the|of) [a-e]')")
def search_function(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.array("text").alias("texts")).alias("d"))
    return docs.where(Typed(path("$.texts[?search(@, '(the|of) [a-e]')]"), docs, "d").exists()).select("doc_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events")
def search_by_automaton(spark, sf_dir):
    """A pattern with nested repeats, matched by the linear-time automaton."""
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.array(F.get_json_object("props", "$.k")).alias("k"))).alias("json"))
    found = kernel.select(events, "json", path("$.k[?match(@, '(([0-9]*)*)*[02468]')]"))
    return found.select("event_id", (F.size("nodes") > 0).alias("even"))


@query("SELECT l_orderkey AS o_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 100 AND min(l_quantity) >= 5")
def aggregates_in_filter(spark, sf_dir):
    docs = orders(spark, sf_dir)
    test = Typed(with_aggregates().compile("$[?sum(@[*].l_quantity) > 100 && min(@[*].l_quantity) >= 5]"), docs.select("lines"))
    return docs.where(test.exists()).select("o_orderkey")


@query("SELECT l_orderkey AS o_orderkey FROM lineitem GROUP BY l_orderkey HAVING avg(l_quantity) > 30 AND stddev_pop(l_quantity) < 10")
def exact_aggregates(spark, sf_dir):
    found = kernel.select(as_text(orders(spark, sf_dir), "o_orderkey"), "json", with_aggregates().compile("$[?avg(@[*].l_quantity) > 30 && stddev(@[*].l_quantity) < 10]"))
    return found.where(F.size("nodes") > 0).select("o_orderkey")


@query("""SELECT r_regionkey, s, v FROM region, (VALUES (0), (1), (2)) t(s), LATERAL (SELECT CASE WHEN s = 1 THEN CAST(r_regionkey AS VARCHAR) ELSE '"' || r_name || '"' END AS v)""")
def multiple_selectors(spark, sf_dir):
    docs = shred(table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("json")), "json", keep=["r_regionkey"])
    return docs.select("r_regionkey", F.posexplode(RowLocal(path("$['r_name','r_regionkey','r_name']"), "doc").values()).alias("s", "v"))


@query("""SELECT n_regionkey AS r_regionkey, '$[''nations''][' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) || '][''n_name'']' AS path FROM nation""")
def distinct_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    trees = shred(as_text(docs, "r_regionkey"), "json", keep=["r_regionkey"])
    return trees.select("r_regionkey", F.explode(RowLocal(path("$..['n_name','n_name']"), "doc").distinct_paths()).alias("path"))


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['o', 'a', 's', 'n', 'n']) AS kind FROM region UNION ALL SELECT unnest(['o', 's', 'n']) FROM nation) GROUP BY kind")
def node_kinds(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    docs = table(spark, sf_dir, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", F.lit(1).alias("one"), "nations")
    nodes = node_table(shred(as_text(docs, "r_regionkey"), "json", keep=["r_regionkey"]), "r_regionkey")
    return nodes.groupBy(F.substring("key", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS o_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10")
def exploded_filter(spark, sf_dir):
    nodes = node_table(shred(as_text(orders(spark, sf_dir), "o_orderkey"), "json", keep=["o_orderkey"]), "o_orderkey")
    found = Exploded(path("$.lines[?@.l_returnflag == 'R' && @.l_quantity < 10].l_partkey"), nodes, Scratch(spark, "exploded")).values()
    return found.select(F.col("doc_id").alias("o_orderkey"), F.col("value").alias("l_partkey"))


@query("SELECT o_orderkey, CAST(l_linenumber AS VARCHAR) AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def exploded_descendant(spark, sf_dir):
    nodes = node_table(shred(as_text(orders(spark, sf_dir), "o_orderkey"), "json", keep=["o_orderkey"]), "o_orderkey")
    return Exploded(path("$..l_linenumber"), nodes).values().select(F.col("doc_id").alias("o_orderkey"), F.col("value").alias("line"))


@query("SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def deep_equality(spark, sf_dir):
    """Arrays compared as wholes: member order does not matter, numbers go by value."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("left_key"), "n_regionkey"), n.select(F.col("n_nationkey").alias("right_key"), F.col("n_regionkey").alias("other"))
    pairs = a.join(b, (F.col("n_regionkey") % 2 == F.col("other") % 2) & (F.col("left_key") < F.col("right_key")))
    one, two = F.concat(F.lit('{"x":1.0,"r":['), "n_regionkey", F.lit("]}")), F.concat(F.lit('{"r":['), "other", F.lit('.00],"x":1}'))
    docs = shred(pairs.select("left_key", "right_key", F.concat(F.lit('{"l":'), one, F.lit(',"m":[{"r":'), two, F.lit("}]}")).alias("json")), "json", keep=["left_key", "right_key"])
    return docs.where(RowLocal(path("$.m[?@.r == $.l]"), "doc").exists()).select("left_key", "right_key")


@query("SELECT c_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS left_over, count(*) FILTER (WHERE o_orderstatus = 'F') AS removed FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def overlay_remove(spark, sf_dir):
    patch = overlay.Overlay.of({"overlay": "1.0.0", "info": {"title": "t", "version": "1"}, "actions": [{"target": "$.orders[?@.o_orderstatus == 'F']", "remove": True}]})
    out = overlay.apply(as_text(customers(spark, sf_dir), "c_custkey"), "json", patch)
    left = F.size(F.from_json("overlaid.document", "orders array<struct<o_orderkey:bigint>>")["orders"])
    return out.select("c_custkey", left.cast("long").alias("left_over"), F.size("overlaid.changes").cast("long").alias("removed"))


@query("SELECT r_regionkey, r_name || '!' AS name, CAST(r_regionkey AS BIGINT) AS copied, CAST(2 AS BIGINT) AS changes FROM region")
def overlay_update_copy(spark, sf_dir):
    docs = table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.struct(F.col("r_regionkey").alias("id")).alias("a"), F.struct(F.concat("r_name", F.lit("!")).alias("name")).alias("b"))).alias("json"))
    actions = [{"target": "$.b", "copy": "$.a"}, {"target": "$.b", "update": {"tags": ["x"]}}]
    out = overlay.apply(docs, "json", overlay.Overlay.of({"overlay": "1.1.0", "info": {"title": "t", "version": "1"}, "actions": actions}))
    b = F.from_json("overlaid.document", "b struct<name:string,id:bigint>")["b"]
    return out.select("r_regionkey", b["name"].alias("name"), b["id"].alias("copied"), F.size("overlaid.changes").cast("long").alias("changes"))


@query("SELECT CASE WHEN n = 1 THEN 'SAME' ELSE 'SAME_VALUES_DIFFERENT_ORDER' END AS outcome, count(*) AS comparisons FROM (SELECT count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def compare_engines(spark, sf_dir):
    docs = shred(as_text(orders(spark, sf_dir), "o_orderkey"), "json", keep=["o_orderkey"])
    both = docs.select(compare.outcome(RowLocal(path("$.lines[*].l_linenumber"), "doc").keys(), RowLocal(path("$.lines[::-1].l_linenumber"), "doc").keys()).alias("outcome"))
    return compare.report(both, "outcome")


@query("SELECT p_type AS expression, 'NOT_RFC_9535' AS assessment FROM part GROUP BY p_type UNION ALL SELECT '$.' || lower(r_name[1:2]), 'VALID_SINGLE_VALUE' FROM region GROUP BY r_name")
def assess_expressions(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select(F.col("p_type").alias("expression")).union(table(spark, sf_dir, "region").select(F.concat(F.lit("$."), F.lower(F.substring("r_name", 1, 2))))).distinct()
    return compare.assess_table(texts, "expression").select("expression", "assessment")


import nodeloom.cases  # noqa: E402,F401  they add their queries to QUERIES and SQL
import nodeloom.compliance  # noqa: E402,F401
