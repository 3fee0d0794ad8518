"""Parser, evaluator, values, paths and regular expressions, without Spark."""

from __future__ import annotations

import time
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nodeloom.functions.evaluate import EvaluationError, LimitExceeded, Limits
from nodeloom.functions.iregexp import compiled, for_jvm
from nodeloom.functions.registry import Function
from nodeloom.functions.values import NOTHING, compare, equal, num_key
from nodeloom.plans import ast as A
from nodeloom.plans.parser import JsonPathSyntaxError, parse
from nodeloom.plans.paths import NormalizedPath
from nodeloom.plans.query import Compiler, compile, with_aggregates
from nodeloom.sources import json_text

STORE = '{"store":{"book":[{"title":"A","price":8.95,"isbn":"1"},{"title":"B","price":12,"tags":["x","y"]},{"title":"C","price":1e1}],"bicycle":{"color":"red","price":399}},"limit":10}'

CASES = [
    ("$", None, 1), ("$.store.book[*].title", ["A", "B", "C"], None), ("$..price", [8.95, 12, 10, 399], None), ("$.store.book[-1].title", ["C"], None),
    ("$.store.book[5]", [], None), ("$.store.book[0:2].title", ["A", "B"], None), ("$.store.book[::-1].title", ["C", "B", "A"], None), ("$.store.book[::0]", [], None),
    ("$.store.book[?@.price < 10].title", ["A"], None), ("$.store.book[?@.price <= $.limit].title", ["A", "C"], None), ("$.store.book[?@.isbn].title", ["A"], None),
    ("$.store.book[?!@.isbn].title", ["B", "C"], None), ("$.store.book[?@.price == 10.0].title", ["C"], None), ("$.store.book[0,0].title", ["A", "A"], None),
    ("$.store.book[?length(@.title) == 1 && count(@.*) > 2].title", ["A", "B"], None), ("$.store.book[?value(@.tags[*]) == 'x']", [], None),
    ("$.store.book[?match(@.title, '[AB]')].title", ["A", "B"], None), ("$.store.book[?search(@.title, '')].title", ["A", "B", "C"], None),
    ("$.store.book[?@.nope == @.neither].title", ["A", "B", "C"], None), ("$.store.book[?@.title <= @.title].title", ["A", "B", "C"], None),
    ("$.store.book[?@.tags == $.store.book[1].tags].title", ["B"], None), ("$..book[?(@.price > 9 || @.isbn) && !(@.title == 'B')]['title']", ["A", "C"], None),
]


@pytest.mark.parametrize(("query", "values", "size"), CASES)
def test_cases(query, values, size):
    found = compile(query).query_json(STORE)
    if size is not None:
        assert len(found) == size
    else:
        assert [float(v) if isinstance(v, (int, Decimal)) else v for v in found.values()] == [float(v) if isinstance(v, (int, float)) else v for v in values]
    assert compile(query).values(json_text.parse(STORE)) == found.values()
    assert compile(query).exists(json_text.parse(STORE)) == bool(found)
    for node in found:
        there, value = node.path.resolve(json_text.parse(STORE))
        assert there and equal(value, node.value)
        assert compile(str(node.path)).query_json(STORE).values() == [node.value]


@pytest.mark.parametrize("bad", ["", "a", " $", "$ ", "$.", "$.a-b", "$. a", "$[]", "$[,]", "$['a',]", "$[01]", "$[-0]", "$[9007199254740992]", "$['a]", "$[\"\\'\"]", "$['\\ud800']", "$[?1]", "$[?'a']", "$[?true]", "$[?@.a == 1 == 2]", "$[?!@.a == 1]", "$[?@..a == 1]", "$[?length(@)]", "$[?count(1) == 1]", "$[?length(@.*) == 1]", "$[?nope(@)]", "$[?match(@.a)]", "$[?match(@.a,'b') == true]", "$[?length (@.a) == 1]", "$[?@.a == 01]", "$[?@.a == .5]", "$.a[?" + "(" * 65 + "@" + ")" * 65 + "]"])
def test_rejected(bad):
    with pytest.raises(JsonPathSyntaxError) as e:
        parse(bad)
    assert 0 <= e.value.position <= len(bad) and len(e.value.excerpt) <= 60


def test_order_of_descendants_and_duplicates():
    assert compile("$..price").query_json('{"a":{"price":1},"price":2}').paths() == ["$['price']", "$['a']['price']"]
    found = compile("$['a','a']").query_json('{"a":1}')
    assert len(found) == 2 and len(found.distinct_paths()) == 1
    assert compile("$.a").query_json('{"a":null}').values() == [None]
    with pytest.raises(ValueError, match="2 nodes"):
        found.single()


def test_singular():
    assert compile("$.a['b'][0]").singular and not compile("$[ 'a' ]").singular and not compile("$..a").singular and not compile("$[0,1]").singular


def test_comparisons():
    assert compare("<=", None, None) and compare("<=", True, True) and compare("==", NOTHING, NOTHING) and not compare("==", NOTHING, None)
    assert not compare("<", "a", 1) and compare("<", "a", "b") and not compare("<", True, False) and compare("!=", 1, "1")
    assert compare("==", 1, Decimal("1.00")) and not compare("==", float("nan"), float("nan")) and compare("!=", float("nan"), float("nan"))
    assert equal({"a": [1], "b": 2}, {"b": Decimal("2.0"), "a": [Decimal("1e0")]})


NUMBERS = st.one_of(st.integers(), st.decimals(allow_nan=False, allow_infinity=False), st.floats(allow_nan=False, allow_infinity=False))


@settings(max_examples=300, deadline=None)
@given(NUMBERS, NUMBERS)
def test_number_keys_order_like_numbers(a, b):
    from nodeloom.functions.values import exact

    x, y = exact(a), exact(b)
    assert (num_key(a) < num_key(b)) == (x < y) and (num_key(a) == num_key(b)) == (x == y)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=5).filter(lambda s: not any("\ud800" <= c <= "\udfff" for c in s)), st.integers(0, 1000)), max_size=5))
def test_paths_round_trip(steps):
    p = NormalizedPath(steps)
    assert NormalizedPath.parse(str(p)) == p
    assert p.parent() is None or p.starts_with(p.parent()) and p.parent().child(p.last_step()) == p


def test_paths():
    assert str(NormalizedPath(["a'b", "\u0001\n", 3])) == "$['a\\'b']['\\u0001\\n'][3]"
    assert NormalizedPath(["a/b~", 0]).pointer() == "/a~1b~0/0"
    assert NormalizedPath([0]) < NormalizedPath(["0"]) and NormalizedPath(["a"]) < NormalizedPath(["a", 0]) and NormalizedPath([2]) < NormalizedPath([10])
    for bad in ("", "$.a", "$[01]", "$[\"a\"]", "$['\\u000a']", "$[-1]", "$['a'"):
        with pytest.raises(ValueError):
            NormalizedPath.parse(bad)


@pytest.mark.parametrize(("pattern", "text", "whole", "part"), [("a*b", "aab", True, True), ("a.c", "a\nc", False, False), ("^a$", "ba", False, False), ("[^a-c]+", "xyz", True, True), ("\\p{Lu}\\P{L}", "É1", True, True), ("a{2,3}", "aaaa", False, True), ("(ab|c)*", "abcab", True, True), ("x|", "", True, True), ("[-a]", "-", True, True), ("a$", "xa\n", False, False)])
def test_regular_expressions(pattern, text, whole, part):
    r = compiled(pattern)
    assert r.match(text) == whole and r.search(text) == part


@pytest.mark.parametrize("bad", ["\\d", "(", ")", "[a", "a**", "a{2,1}", "[]", "x{", "(?:a)", "[[]", "[b-a]", "\\p{Xx}", "(" * 101 + "a" + ")" * 101, "(a{1000}){1000}"])
def test_bad_patterns(bad):
    assert compiled(bad) is None
    assert compile(f"$[?match(@, '{bad}')]".replace("\\", "\\\\")).query_json('["a"]') == []


def test_hostile_pattern_is_linear():
    start = time.time()
    assert not compiled("((a+)+)+b").match("a" * 20_000)
    assert time.time() - start < 5
    assert for_jvm("((a+)+)+b", True) is None and for_jvm("ab+", True)
    for slow in ("a?a?aa", "(a|ab)c", "a*a", "x.*y", "(a?){9}", "a{1,3}a", "\\p{L}"):
        assert for_jvm(slow, True) is None, slow
    for whole, inside in (("a+b+", True), ("xa*b", False), ("a*b", True), ("(the|of) [a-e]", True), ("[a-z]*[0-9]", True)):
        assert (for_jvm(whole, False) is not None) == inside and (for_jvm(whole, True) is not None), whole


def test_functions():
    double = Function("double", (A.VALUE,), A.VALUE, lambda v: NOTHING if v is NOTHING else v * 2)
    odd = Function("odd", (A.VALUE,), A.LOGICAL, lambda v: v % 2 == 1)
    firsts = Function("firsts", (A.NODES,), A.NODES, lambda nodes: nodes[:1])
    c = Compiler(double, odd, firsts)
    assert c.compile("$[?double(@) > 4]").query_json("[1,2,3]").values() == [3]
    assert c.compile("$[?odd(@)]").query_json("[1,2,3]").values() == [1, 3]
    assert c.compile("$[?count(firsts(@.*)) == 1]").query_json("[[1,2],[]]").values() == [[1, 2]]
    with pytest.raises(EvaluationError) as e:
        c.compile("$[?odd(@)]").query_json('[1,"a"]')
    assert str(e.value.path) == "$[1]"
    with pytest.raises(ValueError):
        Compiler(double, double)
    with pytest.raises(ValueError):
        Function("Bad", (), A.VALUE, len)
    with pytest.raises(JsonPathSyntaxError):
        compile("$[?double(@) > 4]")


def test_aggregates():
    q = lambda e, d: with_aggregates().compile(e).query_json(d).values()
    assert q("$[?sum(@[*]) == 0.3]", "[[0.1,0.2]]") and q("$[?min(@[*]) == 1 && max(@[*]) == 3]", '[[1,"x",3,null]]') and not q("$[?min(@[*]) >= 0]", '[["a"]]')
    assert q("$[?avg(@[*]) == 2.5]", "[[1,2,3,4]]") and q("$[?stddev(@[*]) == 2]", "[[2,4,4,4,5,5,7,9]]")


def test_limits():
    with pytest.raises(LimitExceeded):
        compile("$..*").with_limits(visits=3).query_json("[[1],[2]]")
    with pytest.raises(LimitExceeded):
        compile("$[*]").with_limits(results=1).query_json("[1,2]")
    deep = "[" * 900 + "]" * 900
    assert len(compile("$..*").query_json(deep)) == 899
    with pytest.raises(LimitExceeded):
        compile("$..*").with_limits(depth=10).query_json(deep)
    assert compile("$..*").with_limits(depth=10).limits == Limits(depth=10)


@pytest.mark.parametrize("bad", ["", "01", "1 2", "{'a':1}", '{"a":1,"a":2}', "[1,]", '"\\ud800"', '"\n"', "NaN", "-Infinity", "tru", "[" * 1001 + "]" * 1001])
def test_bad_json(bad):
    with pytest.raises(json_text.InvalidJsonError):
        json_text.parse(bad)


def test_json_values():
    v = json_text.parse('{"b":1,"a":[1.50,1e400,12345678901234567890123,"\\ud83d\\ude00",null,true]}')
    assert list(v) == ["b", "a"] and v["a"][0] == Decimal("1.50") and v["a"][2] == 12345678901234567890123 and v["a"][3] == "😀"
    assert json_text.parse(json_text.write(v)) == v and json_text.write({"a": []}, 2) == '{\n  "a": []\n}'


def test_values_of_own_functions():
    from decimal import Decimal

    from nodeloom.functions.access import ABSENT, Value, function
    from nodeloom.plans import ast as A
    from nodeloom.plans.query import Compiler

    assert Value("a").text() == "a" and Value("a").number() is None and Value(1.5).number() == Decimal("1.5") and Value(float("nan")).number() is None and Value(True).truth() is True and Value(1).truth() is None
    assert Value(None).is_null and Value(None).present and not ABSENT.present and ABSENT.kind is None and Value(None) != ABSENT and Value(1) == Value(1.0) and Value([1]).elements() == [Value(1)] and Value({"a": 1}).members() == {"a": Value(1)}
    c = Compiler(
        function("second", (A.NODES,), A.VALUE, lambda vs: vs[1] if len(vs) > 1 else ABSENT), function("texts", (A.NODES,), A.NODES, lambda vs: [v for v in vs if v.text() is not None]),
        function("odd", (A.VALUE, A.LOGICAL), A.LOGICAL, lambda v, t: t and v.number() is not None and v.number() % 2 == 1), function("bad", (A.VALUE,), A.VALUE, lambda v: 1), function("set", (A.VALUE,), A.VALUE, lambda v: Value.of({1})),
    )
    values = lambda q, d: c.compile(q).values(d)
    assert values("$[?second(@.*) == 2]", [[1, 2], [2]]) == [[1, 2]] and values("$[?second(@.*) == @.none]", [[1, 2], [2]]) == [[2]]
    assert values("$[?count(texts(@.*)) == 1]", [["a", 1], [1]]) == [["a", 1]] and values("$[?odd(@, @ > 1)]", [1, 2, 3, "3"]) == [3]
    for q in ("$[?bad(@) == 1]", "$[?set(@) == 1]"):
        with pytest.raises(ValueError, match="TypeError"):
            values(q, [1])


def test_patterns_are_kept_within_bounds(monkeypatch):
    from nodeloom.functions import iregexp

    monkeypatch.setattr(iregexp, "MAX_ENTRIES", 500)
    monkeypatch.setattr(iregexp, "MAX_PLACES", 100)
    for i in range(300):
        r = iregexp.compiled(f"(a|b)*a(a|b){{{i % 30}}}{i}")
        assert r.search("ab" * 20 + "a" + "b" * (i % 30) + str(i)) and not r.match("ab" * 20)
        assert len(iregexp._KEPT) <= iregexp.MAX_PATTERNS and (len(iregexp._KEPT) == 1 or sum(len(x.program) for x in iregexp._KEPT.values() if x) <= 500)
        assert r._places <= 100 + 2 * len(r.program) ** 2
    assert iregexp.compiled("[") is None and iregexp.compiled("[") is None
