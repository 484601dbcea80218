"""Golden cases of filters, projection and validation, on both kinds of collection."""

import json
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkdoc.errors import ArgumentError, FilterError
from sparkdoc.functions.filters import COMPARE, MAX_DEPTH, MAX_IN, MAX_NODES, OPERATORS, parse
from sparkdoc.functions.paths import json_equal
from sparkdoc.functions.project import project_json
from sparkdoc.plans.query import Query

BOOK = {"title": "Tides", "pages": 341, "price": 18.5, "author": {"born": 1951, "home": "Cork"}, "prints": [{"year": 1999}, {"year": 2007, "cover": "hard"}], "shelf": ["sea", "maps"], "sequel": None, "lent": False, "3": {"z": [0]}}
#: By operator: filters that hold for the book, then filters that don't.
CASES = {
    "$eq": ([{"title": "Tides"}, {"pages": 341.0}, {"pages": {"$eq": 341}}, {"author.home": "Cork"}, {"prints.1.year": 2007}, {"prints.001.cover": "hard"}, {"3.z.0": 0}, {"sequel": None}, {"shelf": ["sea", "maps"]}, {"author": {"home": "Cork", "born": 1951}}, {"lent": False}, {}],
            [{"title": "tides"}, {"pages": "341"}, {"lent": 0}, {"prints.2.year": 2007}, {"isbn": None}, {"shelf": ["maps", "sea"]}, {"author": {"home": "Cork"}}, {"author": {}}]),
    "$ne": ([{"isbn": {"$ne": 7}}, {"lent": {"$ne": True}}, {"price": {"$ne": 18}}], [{"pages": {"$ne": 341}}, {"sequel": {"$ne": None}}]),
    "order": ([{"price": {"$gt": 18}}, {"pages": {"$gte": 341, "$lte": 341}}, {"title": {"$lt": "U"}}, {"author.born": {"$lt": 1951.5}}], [{"pages": {"$gt": 341}}, {"title": {"$gt": 5}}, {"pages": {"$lt": "9"}}, {"isbn": {"$lte": 1}}, {"lent": {"$gte": 0}}]),
    "$in": ([{"title": {"$in": [4, "Tides"]}}, {"price": {"$in": [18.5]}}, {"sequel": {"$in": [None]}}], [{"title": {"$in": []}}, {"isbn": {"$in": [None, 1]}}]),
    "$nin": ([{"isbn": {"$nin": ["x"]}}, {"pages": {"$nin": []}}], [{"pages": {"$nin": [1, 341]}}]),
    "$exists": ([{"sequel": {"$exists": True}}, {"isbn": {"$exists": False}}, {"author.died": {"$exists": False}}], [{"isbn": {"$exists": True}}, {"lent": {"$exists": False}}]),
    "$prefix": ([{"title": {"$prefix": "Ti"}}, {"title": {"$prefix": ""}}], [{"title": {"$prefix": "de"}}, {"pages": {"$prefix": "3"}}, {"isbn": {"$prefix": ""}}]),
    "$contains": ([{"shelf": {"$contains": "maps"}}, {"title": {"$contains": "ide"}}, {"prints": {"$contains": {"year": 1999}}}, {"3.z": {"$contains": 0}}], [{"shelf": {"$contains": "map"}}, {"prints": {"$contains": {"year": 2007}}}, {"pages": {"$contains": 4}}, {"author": {"$contains": "Cork"}}]),
    "groups": ([{"$or": [{"pages": 2}, {"$not": {"price": {"$lt": 10}}}]}, {"$and": [{"lent": False}, {"pages": {"$gt": 1}}]}, {"$not": {"isbn": {"$gt": 0}}}, {"$not": {"$or": [{"title": "x"}, {"pages": 0}]}}], [{"$or": [{"pages": 2}, {"price": {"$lt": 10}}]}, {"$not": {}}, {"title": "Tides", "$and": [{"lent": True}]}]),
}


def schemaless(spark, docs):
    rows = [(f"k{i:03}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "key string, json string").select("key", F.try_parse_json("json").alias("value"))


def test_operators_on_one_document(spark):
    one = schemaless(spark, [BOOK])
    cases = [(w, holds) for yes, no in CASES.values() for holds, ws in ((True, yes), (False, no)) for w in ws]
    out = reduce(lambda a, b: a.unionByName(b), [Query(one, {"where": w}).all().select(F.lit(i).alias("i")) for i, (w, _) in enumerate(cases)])
    found = {r.i for r in out.collect()}
    assert [w for i, (w, holds) in enumerate(cases) if (i in found) != holds] == []


def test_every_operator_checks_its_operand():
    wrong = {"$in": ["ab", {"q": 1}, [0] * (MAX_IN + 1)], "$nin": [None, 3], "$exists": [0, None, "true"], "$prefix": [9, None, ["t"]], **{op: [None, True, ["t"], {"u": 2}] for op in COMPARE}}
    for op, operands in wrong.items():
        for x in operands:
            with pytest.raises(FilterError, match=op.replace("$", "[$]")):
                parse({"pages": {op: x}})
    assert {x.op for x in parse({"pages": {op: {"$in": [1], "$nin": [1], "$exists": True}.get(op, "t") for op in OPERATORS}}).items} == set(OPERATORS)


@pytest.mark.parametrize("where", ["title", None, 3, {"$nor": [{"pages": 1}]}, {"pages": {"$regex": "t"}}, {"pages": {"$lt": 4, "least": 1}}, {"author..home": 1}, {".": 1}, {"": 2}, {"$and": {}}, {"$and": []}, {"$or": "x"}, {"$not": [{"pages": 1}]}, {"$or": [{"pages": 1}, 5]}])
def test_what_is_no_filter(where):
    with pytest.raises(FilterError):
        parse(where)


def test_limits():
    def under(n):
        return {"pages": 1} if n == 0 else {"$or": [under(n - 1)]}

    parse(under(MAX_DEPTH - 1))
    parse({f"p{i}": i for i in range(MAX_NODES)})
    for much in (under(MAX_DEPTH), under(5 * MAX_DEPTH), {f"p{i}": i for i in range(MAX_NODES + 1)}, {"$and": [{f"p{i}": {"$gt": 0, "$lt": 9}} for i in range(MAX_NODES // 3 + 1)]}):
        with pytest.raises(FilterError):
            parse(much)


def test_invalid_json_and_other_documents(spark):
    rows = schemaless(spark, ["{", "12", '"x"', "[1]", "null", '{"t": 12}', '{"t": "12"}', '{"t": true}', '{"t": 9007199254740993}', '{"t": 1e300}', '{"t": 18446744073709551615}'])
    keys = lambda w: [r.key for r in Query(rows, {"where": w}).all().orderBy("key").collect()]
    assert keys({"t": {"$gt": 0}}) == ["k005", "k008", "k009", "k010"]
    assert keys({"$not": {"t": {"$gt": 0}}}) == ["k001", "k002", "k003", "k004", "k006", "k007"]
    assert keys({"t": {"$gt": 9007199254740992}}) == ["k008", "k009", "k010"] and keys({"t": 9007199254740993}) == ["k008"] and keys({"t": 9007199254740992}) == []
    assert keys({"t": {"$exists": False}}) == ["k001", "k002", "k003", "k004"]


def test_typed_and_schemaless_agree(spark):
    rows = [(i, ["sent", "new", None][i % 3], float(i * 10), i % 4 == 0, list(range(i % 5)), (["north", "south"][i % 2],)) for i in range(40)]
    typed = spark.createDataFrame(rows, "n long, status string, total double, ok boolean, parts array<long>, buyer struct<area: string>")
    typed = typed.select(F.format_string("k%03d", "n").alias("key"), F.struct("n", "status", "total", "ok", "parts", "buyer").alias("value"))
    plain = typed.select("key", F.try_parse_json(F.to_json("value")).alias("value"))
    for where in [{"status": "sent"}, {"status": {"$ne": "sent"}}, {"total": {"$gte": 100, "$lt": 200.5}}, {"n": {"$gt": 7.5}}, {"n": 8.0}, {"ok": True}, {"ok": {"$ne": False}}, {"parts": {"$contains": 3}}, {"parts.1": 1}, {"buyer.area": "north"}, {"status": {"$exists": False}}, {"status": {"$in": ["new", 1]}}, {"total": "x"}, {"zz": {"$nin": [1]}}, {"parts": [0, 1]}, {"buyer": {"area": "south"}}, {"$not": {"$or": [{"status": "sent"}, {"total": {"$lt": 100}}]}}]:
        got = [{r.key for r in Query(x, {"where": where}).all().collect()} for x in (typed, plain)]
        assert got[0] == got[1], where


def test_typed_predicates_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.format_string("k%03d", "id").alias("key"), F.struct(F.col("id").alias("n"), F.lit("x").alias("s")).alias("value")).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = Query(spark.read.parquet(str(tmp_path / "t")), {"prefix": "k0", "where": {"n": {"$gte": 5}, "s": "x"}, "fields": ["n"]}).all()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value.n,5)" in plan and "EqualTo(value.s,x)" in plan and "StringStartsWith(key,k0)" in plan


def test_projection(spark):
    assert project_json(BOOK, [("author", "home"), ("shelf", "1"), ("isbn",), ("price",)]) == {"author": {"home": "Cork"}, "shelf": ["sea", "maps"], "price": 18.5}
    assert project_json({"author": {"born": 4}}, [("author", "home")]) == {"author": {}} and project_json("text", [("pages",)]) == {}
    got = Query(schemaless(spark, [BOOK, {"author": {"born": 4}}, "[7]"]), {"fields": ["author.home", "shelf.1", "isbn"]}).all().select(F.to_json("value").alias("v")).collect()
    assert [json.loads(r.v) for r in got] == [{"author": {"home": "Cork"}, "shelf": ["sea", "maps"]}, {"author": {}}, {}]


def test_request_validation():
    from sparkdoc.plans.query import QuerySpec

    for bad in ({"limit": 0}, {"limit": 1001}, {"nope": 1}, {"sort": {"field": "a", "order": "up"}}, {"aggregate": {"avg": "x"}}, {"aggregate": {"count": False}}, {"fields": []}, {"prefix": "a", "start": "b"}, {"max_scanned": 100_001}, {"sort": {"field": "a"}, "aggregate": {"count": True}}):
        with pytest.raises(ArgumentError):
            QuerySpec.of(bad)


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from([0.0, 1.0, 1.5, "a", "b"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("ab"), x, max_size=2), max_leaves=6)


@settings(max_examples=200, deadline=None)
@given(JSON, JSON)
def test_json_equality_is_an_equivalence(a, b):
    assert json_equal(a, a) and json_equal(a, b) == json_equal(b, a) and json_equal(a, json.loads(json.dumps(a)))
