import json

import pytest
from pyspark.sql import functions as F

from starling.errors import InvalidFilter
from starling.functions import filters
from starling.functions.filters import And, Eq, Gt, In, Or, metadata_filter, parse_filter

ROWS = {
    "a": '{"cat":"sci","n":1,"x":null}', "b": '{"cat":"art","n":1.0}', "c": '{"cat":"sci","n":30,"a.b":true,"l":[1,2]}',
    "d": None, "e": '[1]', "f": '{"n":"12"}', "g": "no json", "h": '{"n":true}', "i": "{}",
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(ROWS.items()), "id string, metadata string").cache()


@pytest.mark.parametrize(
    "given, want",
    [
        ({"cat": "sci"}, "ac"), ({"cat": {"$ne": "sci"}}, "bfhi"), ({"cat": {"$in": ["art", "music"]}}, "b"), ({"cat": {"$in": []}}, ""),
        ({"n": 1}, "a"), ({"n": 1.0}, "b"), ({"n": True}, "h"), ({"n": "12"}, "f"), ({"x": None}, "a"), ({"x": {"$ne": None}}, "bcfhi"),
        ({"n": {"$gt": 0}}, "abc"), ({"n": {"$gte": 1}}, "abc"), ({"n": {"$lt": 30}}, "ab"), ({"n": {"$lte": 30}}, "abc"), ({"n": {"$gt": 0, "$lt": 10}}, "ab"),
        ({"a.b": True}, "c"), ({"l": [1, 2]}, "c"), ({}, ""), ({"cat": "sci", "n": {"$gt": 5}}, "c"), ({"$or": [1]}, ""),
        (Or((Eq("cat", "art"), Gt("n", 20))), "bc"), (And((In("cat", ("sci",)), Gt("n", 20))), "c"), (Or(()), ""),
    ],
)
def test_truth_table(rows, given, want):
    got = rows.where(metadata_filter(given)).select("id").collect()
    assert sorted(r[0] for r in got) == list(want)


def test_never_null(rows):
    assert rows.select(F.count(F.when(metadata_filter({"n": {"$ne": 3}}).isNull(), 1))).first()[0] == 0


@pytest.mark.parametrize("bad", ["x", 3, {"a": {"$foo": 1}}, {"a": {"$in": 3}}, {"a": {"$gt": "x"}}, {"a": {"$gt": True}}])
def test_invalid(bad):
    with pytest.raises(InvalidFilter):
        parse_filter(bad)


def test_quotes_in_keys(spark):
    df = spark.createDataFrame([(json.dumps({'a"b': 1}),)], "metadata string")
    assert df.where(metadata_filter({'a"b': 1})).count() == 1


def test_typed_conditions_reach_the_scan(spark, tmp_path):
    rows = [(1, "de", 5), (2, "en", 7), (3, None, 9), (4, "de", None), (5, "fr", 3)]
    spark.createDataFrame(rows, "id long, lang string, n long").write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    fields = filters.TypedFields({"lang": F.col("lang"), "n": F.col("n")})
    pushed = {"eq": {"lang": "de"}, "in": {"lang": {"$in": ["de", "fr"]}}, "gt": {"n": {"$gt": 4}}, "both": {"lang": "de", "n": {"$lte": 5}}}
    others = {"ne": {"lang": {"$ne": "de"}}, "half": {"n": {"$gt": 4.5}}, "absent": {"x": 1}, "none": {}}
    for name, given in (pushed | others).items():
        kept = df.where(filters.typed_condition(given, fields))
        assert sorted(r["id"] for r in kept.collect()) == sorted(r["id"] for r in df.where(filters.compile_filter(given, fields)).collect()), name
        if name in pushed:
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan, plan
    either = Or((Eq("lang", "fr"), Gt("n", 6)))
    assert sorted(r["id"] for r in df.where(filters.typed_condition(either, fields)).collect()) == [2, 3, 5]


CASES = [{"cat": "sci"}, {"cat": {"$in": ["art", "music"]}}, {"cat": {"$in": []}}, {"cat": {"$ne": "sci"}}, {"n": 1}, {"n": 1.0}, {"n": "12"}, {"n": True}, {"n": {"$in": [1, 1.0]}}, {"n": {"$in": [1, "12"]}},
         {"n": {"$gt": 0, "$lt": 10}}, {"cat": "sci", "n": {"$gte": 30}}, {"x": None}, {}, {"a.b": True}, Or((Eq("cat", "art"), Gt("n", 20))), Or((Eq("cat", "art"), Eq("a.b", True)))]


def test_implied_conditions_lose_nothing(rows):
    keys = ["cat", "n"]
    wide = rows.withColumns(filters.promoted("metadata", keys))
    for given in CASES:
        want, condition = rows.where(metadata_filter(given)), filters.implied(given, keys)
        got = wide.where(metadata_filter(given)) if condition is None else wide.where(condition).where(metadata_filter(given))
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()), given
    assert filters.implied({"n": True}, keys) is None and filters.implied({"other": 1}, keys) is None and filters.implied({"cat": {"$ne": "a"}}, keys) is None
    assert filters.implied(Or((Eq("cat", "art"), Eq("a.b", True))), keys) is None
