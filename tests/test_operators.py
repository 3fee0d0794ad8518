"""Spark operators against the evaluator, and the queries against DuckDB."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import compare, kernel, overlay
from nodeloom.operators.exploded import Exploded, node_table
from nodeloom.operators.rowlocal import NotNative, RowLocal
from nodeloom.operators.typed import Typed
from nodeloom.plans.query import compile, with_aggregates
from nodeloom.sources import documents
from nodeloom.sources.json_text import write
from nodeloom.sources.shredder import shred

DOCS = [
    '{"a":{"price":1},"price":2,"b":[1,2,{"x":null,"y":"é","z":[1,[2]]},3.0,10,-5,"3"],"lim":2}',
    '[1,[2,[3]],{"a":[{"b":1},{"b":"x"}]}]',
    "null",
    '{"":{"\'":1,"a b":[true,false,null,"",{}]},"s":"\\u0001","n":[0,-0.0,1e2,100,12345678901234567890.5]}',
]
NATIVE = ["$", "$..price", "$.b[-1]", "$.b[::-1]", "$.b[1:9:2]", "$.b[5:1:-2]", "$.b[?@==3]", "$.b[?@.x==null].y", "$..[?@.price]", "$..*", "$[*][*]", "$.b[0,0]", "$..[0]", "$[?@.a[0].b == 1 || @.b]", "$.n[?@==100]", "$..['a b'][?@==true]"]
MORE = ["$[?count(@.*)>1]", "$.b[?@>$.lim]", "$.b[?match(@.y,'.')]", "$.b[?@<=@]", "$.b[?@.q==@.r]", "$.b[?value(@.z[*])==1]", "$..[?length(@)==0]", "$.n[?@ < 100 && @ >= $.n[1]]", "$..[?search(@,'[0-9]')]", "$[?max(@[*]) == 10]"]


@pytest.fixture(scope="module")
def trees(spark):
    return shred(spark.createDataFrame(list(enumerate(DOCS)), "id int, j string"), "j").cache()


def expected(query: str) -> list:
    return [[(write(n.value), str(n.path)) for n in with_aggregates().compile(query).query_json(d)] for d in DOCS]


def test_rowlocal(trees):
    queries = NATIVE + MORE
    c = with_aggregates().compile
    rows = trees.orderBy("id").select(*[RowLocal(c(q), "doc").query().alias(f"q{i}") for i, q in enumerate(queries)]).collect()
    for i, q in enumerate(queries):
        assert [[(n.value, n.path) for n in r[f"q{i}"]] for r in rows] == expected(q), q


def test_exploded(trees):
    nodes = node_table(trees, "id").cache()
    for q in NATIVE:
        got: dict[int, list[str]] = {}
        for r in Exploded(compile(q), nodes).values().orderBy("doc_id", "ord").collect():
            got.setdefault(r.doc_id, []).append(r.value)
        assert [got.get(i, []) for i in range(len(DOCS))] == [[v for v, _ in e] for e in expected(q)], q


def test_kernel(spark):
    df = spark.createDataFrame([*enumerate(DOCS), (9, None), (10, "{")], "id int, j string")
    for q in (NATIVE + MORE)[::4] + ["$.b[?match(@.y, @.y)]", "$[?sum(@[*]) > 1]"]:
        rows = kernel.select(df, "j", with_aggregates().compile(q), mode="error").orderBy("id").collect()
        assert [[(n.value, n.path) for n in r.nodes] for r in rows[: len(DOCS)]] == expected(q), q
        assert rows[-2].nodes is None and rows[-2].nodes_error is None and rows[-1].nodes is None and rows[-1].nodes_error
    with pytest.raises(NotNative):
        RowLocal(compile("$[?match(@, '((a+)+)+b')]"), "doc").refs()


def test_shred_modes(spark):
    df = spark.createDataFrame([(1, "{}"), (2, '{"a":1,"a":2}'), (3, None)], "id int, j string")
    rows = shred(df, "j", mode="error").orderBy("id").collect()
    assert rows[0].doc is not None and rows[1].doc is None and "duplicate" in rows[1].doc_error.reason and rows[2].doc is None and rows[2].doc_error is None
    with pytest.raises(Exception, match="duplicate"):
        shred(df, "j").collect()
    with pytest.raises(Exception, match="more than 1 results"):
        shred(spark.createDataFrame([("[1,2]",)], "j string"), "j").select(RowLocal(compile("$[*]").with_limits(results=1), "doc").refs()).collect()


def test_random_documents(spark):
    """Row-local columns agree with the evaluator on documents that nobody chose."""
    rng = random.Random(9535)

    def value(depth: int):
        k = rng.randrange(8 if depth else 6)
        if k < 6:
            return [None, True, rng.randrange(-3, 4), rng.choice([0.5, 2.25, -1.0]), rng.choice(["", "a", "é", "😀"]), False][k]
        n = rng.randrange(4)
        return [value(depth - 1) for _ in range(n)] if k == 6 else {rng.choice(["a", "b", "'", "", "a.b", "é"]): value(depth - 1) for _ in range(n)}

    docs = [json.dumps(value(4)) for _ in range(60)]
    queries = ["$..*", "$..a", "$[*]..b", "$..[?@.a == @.b]", "$..[?@ < 2]", "$..[0,-1]", "$..[?@.a || @[0] != null]", "$..[?count(@.*) >= 2]", "$..[::2]"]
    trees = shred(spark.createDataFrame(list(enumerate(docs)), "id int, j string"), "j")
    rows = trees.orderBy("id").select(*[RowLocal(compile(q), "doc").query().alias(f"q{i}") for i, q in enumerate(queries)]).collect()
    for i, q in enumerate(queries):
        for r, d in zip(rows, docs, strict=True):
            assert [(n.value, n.path) for n in r[f"q{i}"]] == [(write(n.value), str(n.path)) for n in compile(q).query_json(d)], (q, d)


STORES = [
    {"store": {"book": [{"title": "A", "price": 8.95, "isbn": "1", "tags": ["x"]}, {"title": "B", "price": 12.0, "tags": []}, {"title": "C", "price": 10.0, "tags": ["x", "y"]}], "bike": {"color": "red", "price": 399.0}}, "lim": 10},
    {"store": {"book": [], "bike": {"color": "blue", "price": 1.0}}, "lim": 1},
]
TYPED = ["$.store.book[*].title", "$..price", "$.store.book[-1].title", "$.store.book[::-1].price", "$.store.book[?@.price<=$.lim].title", "$.store.book[?!@.isbn].title", "$.store.book[?@.tags[1]=='y'].price", "$.store.book[?match(@.title,'[AB]')].title", "$.store.book[0:2].tags[*]", "$.store.book[?length(@.title)==1 && count(@.tags[*])>0].title", "$..color", "$..tags[0]", "$.store.book[?@.price==12].title", "$.nope", "$.store.book[?avg($.store.book[*].price) > @.price].title"]


def test_typed(spark):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(d) for d in STORES]))
    c = with_aggregates().compile
    ordered = lambda o: {k: ordered(o[k]) for k in sorted(o)} if isinstance(o, dict) else [ordered(x) for x in o] if isinstance(o, list) else o
    rows = df.orderBy(F.desc("lim")).select(*[Typed(c(q), df).values().alias(f"q{i}") for i, q in enumerate(TYPED)]).collect()
    for i, q in enumerate(TYPED):
        for r, d in zip(rows, STORES, strict=True):
            assert r[f"q{i}"] == [float(v) if not isinstance(v, (str, bool)) else v for v in c(q).values(ordered(d))], q
    null = spark.createDataFrame([(None,)], "a int")
    assert null.select(Typed(compile("$.a"), null).count()).first()[0] == 0 and null.select(Typed(compile("$.a"), null, null_as="null").count()).first()[0] == 1


def test_typed_reads_only_what_it_needs(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = df.select(Typed(compile("$.o_totalprice"), df).values())._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double>" in plan


def test_overlay(spark):
    text = "info: {title: old, list: [1]}\npaths: {/a: {get: {}}, /b: {post: {}}}\ntags: []\n"
    o = overlay.Overlay.parse("overlay: 1.1.0\ninfo: {title: t, version: '1'}\nactions:\n- {target: $.info, update: {x: 1.50, title: new, list: [2]}}\n- {target: '$.paths[?@.get]', remove: true}\n- {target: $.tags, update: {name: z}}\n- {target: $.info, copy: '$.tags[0]'}\n- {target: $.nope, remove: true}\n")
    rows = overlay.apply(spark.createDataFrame([(1, text), (2, None), (3, "a: [")], "id int, t string"), "t", o, mode="error").orderBy("id").collect()
    r = rows[0].overlaid
    assert json.loads(r.document) == {"info": {"title": "new", "list": [1, 2], "x": 1.5, "name": "z"}, "paths": {"/b": {"post": {}}}, "tags": [{"name": "z"}]} and "1.50" in r.document
    assert [c.change for c in r.changes] == ["MERGED", "REMOVED", "APPENDED", "MERGED"] and len(r.warnings) == 1
    assert rows[1].overlaid is None and rows[2].overlaid.error
    doc = documents.parse(text)
    with pytest.raises(overlay.OverlayError):
        o.apply_to(doc, overlay.Options(fail_on_no_match=True))
    assert doc == documents.parse(text)
    bad = lambda *a: overlay.Overlay.of({"overlay": "1.1.0", "info": {"title": "", "version": ""}, "actions": list(a)})
    for action in ({"target": "$", "remove": True}, {"target": "$.tags", "copy": "$.*"}, {"target": "$['info','tags']", "update": {}}, {"target": "$.info.title", "update": {}}):
        with pytest.raises(overlay.OverlayError):
            bad(action).apply_to(doc)
    lenient = bad({"target": "$.info.title", "update": {"a": 1}}).apply_to(doc, overlay.Options(lenient_merge=True))
    assert lenient.document["info"]["title"] == {"a": 1}


@pytest.mark.parametrize("bad", [[], {}, {"overlay": "2.0.0", "info": {"title": "", "version": ""}, "actions": [{"target": "$"}]}, {"overlay": "1.0.0", "info": {"title": "", "version": ""}, "actions": []}, {"overlay": "1.0.0", "info": {"title": "", "version": ""}, "actions": [{"target": "$", "copy": "$"}]}, {"overlay": "1.2.0", "info": {"title": "", "version": ""}, "actions": [{"$ref": "#/components/actions/x"}]}, {"overlay": "1.0.0", "info": {"title": "", "version": ""}, "actions": [{"target": "$"}, {"target": "$"}]}, {"overlay": "1.0.0", "info": {"title": "", "version": ""}, "actions": [{"target": "nope"}]}])
def test_overlay_problems(bad):
    assert overlay.Overlay.validate(bad)


def test_reusable_actions():
    doc = {"overlay": "1.2.0", "info": {"title": "", "version": ""}, "components": {"actions": {"a.b": {"fields": {"update": {"x": 1}}}}}, "actions": [{"$ref": "#/components/actions/a.b", "target": "$"}]}
    assert overlay.Overlay.validate(doc) == [] and overlay.Overlay.of(doc).apply_to({}).document == {"x": 1}


def test_documents():
    v = documents.parse("a: yes\nb: 0.10\nc: '010'\nd: [1, null]\n")
    assert v["a"] == "yes" and str(v["b"]) == "0.10" and documents.parse(documents.write(v, "yaml")) == v and documents.parse(documents.write(v, "json")) == v
    for bad in ("", "a: 1\na: 2", "{", "﻿ "):
        with pytest.raises(ValueError):
            documents.parse(bad)


def test_command(tmp_path):
    (tmp_path / "o.yaml").write_text("overlay: 1.0.0\ninfo: {title: t, version: '1'}\nactions: [{target: $, update: {b: 2}}]\n")
    (tmp_path / "in.json").write_text('{"a":1}')
    args = ["--overlay", str(tmp_path / "o.yaml"), "--output", str(tmp_path / "out.json"), str(tmp_path / "in.json")]
    assert overlay.main(args) == 0 and json.loads((tmp_path / "out.json").read_text()) == {"a": 1, "b": 2}
    assert overlay.main(["--overlay", "missing.yaml", *args[2:]]) == 1 and overlay.main([]) == 2


def test_compare(spark):
    df = spark.createDataFrame([(["a"], ["a"]), (["a", "b"], ["b", "a"]), (["a"], []), ([], ["a"]), (["a"], ["b"])], "l array<string>, r array<string>")
    got = [r[0] for r in df.select(compare.outcome(F.col("l"), F.col("r"))).collect()]
    assert got == ["SAME", "SAME_VALUES_DIFFERENT_ORDER", "ONLY_LEFT", "ONLY_RIGHT", "DIFFERENT_VALUES"]
    assert compare.assess("$.a") == "VALID_SINGLE_VALUE" and compare.assess("$..a") == "VALID" and compare.assess("$.a.length()") == "NOT_RFC_9535" and compare.assess(None) == "NOT_A_LITERAL" and compare.assess("$", "put") == "WRITE_API"
    assert compare.hint("$.a[?(@.b =~ /x/)]").startswith("use match")


def test_checks(trees):
    c = lambda q: compare.Checks(compile(q))
    row = trees.where("id = 0").select(c("$.lim").value(2), c("$.b[0,1]").values(1, 2), c("$.a").paths("$['a']"), c("$.zz").does_not_exist(), c("$.b[*]").has_size(7), c("$.b[2].z").value([1, [2]])).first()
    assert all(row)


def test_streaming(spark, tmp_path):
    from nodeloom.streaming.queries import select_stream, windowed_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{i}:00", "j": json.dumps({"k": [i, i + 1]})}) for i in range(3)))
    stream = spark.readStream.schema("ts timestamp, j string").json(str(tmp_path / "in"))
    for out, name, mode in ((select_stream(stream, "j", compile("$.k[?@ > 1]")), "picked", "append"), (windowed_counts(stream, "j", compile("$.k[*]"), "ts"), "counted", "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(n.value for r in spark.table("picked").collect() for n in r.nodes) == ["2", "2", "3"]
    assert [(r.documents, r.nodes) for r in spark.table("counted").collect()] == [(3, 6)]


def test_queries_match_sql(spark, sf_dir):
    import duckdb

    from nodeloom import queries

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        rows = lambda p: sorted(map(str, p[columns].itertuples(index=False, name=None)))  # noqa: E731,B023
        assert rows(got) == rows(want), name


def test_patterns_of_the_jvm_are_those_of_the_automaton(spark):
    """Random patterns: what goes to rlike answers as the automaton does."""
    from nodeloom.functions.iregexp import compiled, for_jvm

    rng = random.Random(9485)

    def pattern(depth: int) -> str:
        k = rng.randrange(7 if depth else 4)
        if k < 3:
            return rng.choice("abc")
        if k == 3:
            return rng.choice(("[ab]", "[^a]", ".", "[a-c]"))
        if k == 4:
            return pattern(0) + rng.choice(("*", "+", "?", "{2}", "{1,}"))
        if k == 5:
            return pattern(depth - 1) + pattern(depth - 1)
        return f"({pattern(depth - 1)}|{pattern(depth - 1)})" + rng.choice(("", "?"))

    texts = ["", *("".join(rng.choice("abc\n") for _ in range(rng.randint(1, 7))) for _ in range(60))]
    df, columns, want = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), [], []
    while len(columns) < 60:
        p, whole = pattern(3), len(columns) % 2 == 0
        if java := for_jvm(p, whole):
            columns.append(F.col("t").rlike(java).alias(f"c{len(columns)}"))
            want.append((p, [(compiled(p).match if whole else compiled(p).search)(t) for t in texts]))
    rows = df.select("i", *columns).orderBy("i").collect()
    for k, (p, hits) in enumerate(want):
        assert [r[f"c{k}"] for r in rows] == hits, p


@pytest.mark.parametrize("q", ["$[?search(@,'a*b')]", "$[?search(@,'[a-c]+x')]", "$[?match(@,'a*b')]", "$[?match(@,'b?a{3}[a-c]*')]"])
def test_time_of_native_patterns_grows_with_the_text(spark, q):
    """Four times the text takes nowhere near sixteen times the time; patterns that could are refused."""
    import time

    def seconds(n: int) -> float:
        docs = spark.createDataFrame([(["a" * n],)], "t array<string>")
        best = 1e9
        for column in (docs.select(Typed(compile(q), docs, "t").exists()), shred(docs.select(F.to_json("t").alias("j")), "j").select(RowLocal(compile(q), "doc").exists())):
            start = time.time()
            column.collect()
            best = min(best, time.time() - start)
        return best

    seconds(1000)
    assert seconds(400_000) < 3 + 8 * seconds(100_000)


def test_limits_hold_or_are_refused(spark):
    docs = spark.createDataFrame([(1, [1, 2, 3])], "id int, a array<int>")
    tree = shred(docs.select("id", F.to_json(F.struct("a")).alias("j")), "j", keep=["id"])
    few, enough = compile("$.a[*]").with_limits(results=2), compile("$.a[*]").with_limits(results=3)
    runs = [lambda p: docs.select(Typed(p, docs).values()), lambda p: tree.select(RowLocal(p, "doc").values()), lambda p: Exploded(p, node_table(tree, "id")).values()]
    for run in runs:
        assert run(enough).count() in (1, 3)
        with pytest.raises(Exception, match="more than 2 results"):
            run(few).collect()
        for bound in ({"visits": 10}, {"depth": 2}):
            with pytest.raises(NotNative, match="kernel"):
                run(compile("$.a[*]").with_limits(**bound))


def test_findings():
    assert compare.assess(None, "set") == "NOT_A_LITERAL" and compare.assess("$.a", "set") == "WRITE_API"
    assert compare.hint("$.a[") == compare.OTHER_HINT and set(compare.VALID_HINTS) | {"NOT_RFC_9535"} == {"VALID", "VALID_SINGLE_VALUE", "WRITE_API", "NOT_A_LITERAL", "NOT_RFC_9535"}


def test_compliance_cases(spark):
    from nodeloom import compliance as c

    suite = {"tests": [
        {"name": "right", "selector": "$.a", "document": {"a": 1.0}, "result": [1], "result_paths": ["$['a']"]},
        {"name": "either order", "selector": "$.*", "document": {"a": 1, "b": 2}, "results": [[2, 1], [1, 2]], "results_paths": [["$['b']", "$['a']"], ["$['a']", "$['b']"]], "tags": ["x"]},
        {"name": "wrong value", "selector": "$.a", "document": {"a": 1}, "result": [2]},
        {"name": "wrong path", "selector": "$.a", "document": {"a": 1}, "result": [1], "result_paths": ["$['b']"]},
        {"name": "refused", "selector": "$.", "invalid_selector": True},
        {"name": "taken", "selector": "$", "invalid_selector": True},
        {"name": "not taken", "selector": "$[", "document": 1, "result": []},
    ]}
    cases = c.read_cases(json.dumps(suite))
    for operator in ("kernel", "rowlocal"):
        bad = {r.name: r.reason for r in c.run(spark, cases, operator).where("reason is not null").collect()}
        assert set(bad) == {"wrong value", "wrong path", "taken", "not taken"} and bad["taken"] == "an invalid selector is taken", operator
    for broken in ("[]", '{"tests":[{"name":"x"}]}', '{"tests":[{"name":"x","selector":"$"}]}', '{"tests":[{"name":"x","selector":"$","document":1,"invalid_selector":true}]}'):
        with pytest.raises(c.BadCase):
            c.read_cases(broken)


def operators_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_descendant_takes_no_join(spark, sf_dir):
    from nodeloom.queries import QUERIES

    plan = operators_of(QUERIES["exploded_descendant"](spark, sf_dir))
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_exploded_broadcasts_nothing(spark, sf_dir):
    from nodeloom.queries import as_text, orders

    nodes = node_table(shred(as_text(orders(spark, sf_dir), "o_orderkey"), "json", keep=["o_orderkey"]), "o_orderkey")
    for q in ("$..a..b", "$.a[-1]", "$[?@.a.b == 1 || !@..c]..x", "$[?@.a != 1][::-1]"):
        assert "Broadcast" not in operators_of(Exploded(compile(q), nodes).values()), q


def test_exploded_filter_shreds_once(spark, sf_dir):
    from nodeloom.queries import QUERIES

    plan = operators_of(QUERIES["exploded_filter"](spark, sf_dir))
    assert "Broadcast" not in plan and "MapInArrow" not in plan and "Scan parquet" in plan


def test_exploded_from_a_written_table(spark, trees):
    from nodeloom.sources.store import Scratch

    nodes, scratch = node_table(trees, "id").cache(), Scratch(spark, "test")
    for q in ("$", "$.*", "$.b[?@.x == 1].y", "$..[?@.x != 1]", "$[?@ == 1]"):
        plain, written = ([tuple(r) for r in Exploded(compile(q), nodes, s).values().orderBy("doc_id", "ord").collect()] for s in (None, scratch))
        assert plain == written, q
        assert [[r[4] for r in written if r[0] == i] for i in range(len(DOCS))] == [[v for v, _ in e] for e in expected(q)], q
