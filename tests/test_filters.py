import pytest
from pyspark.sql import functions as F

from vecloom.functions.filters import ColumnFields, JsonFields, all_of, any_of, compile_filter, lookup, none_of

ROWS = [
    (1, '{"type": "article", "n": 5, "ok": true, "a": {"b": "x"}}'),
    (2, '{"type": "book", "n": "5", "ok": false}'),
    (3, '{"type": null, "n": 7.5}'),
    (4, None),
    (5, ""),
    (6, "[1, 2]"),
    (7, '{"n": "abc", "we\\"ird.key": 1}'),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, metadata string").cache()


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({}, [1, 2, 3, 4, 5, 6, 7]),
        ({"n": 5}, [1]),
        ({"n": "5"}, [2]),
        ({"ok": True}, [1]),
        ({"a.b": "x"}, [1]),
        ([{"field": "type", "operator": "$ne", "value": "book"}], [1, 3, 6, 7]),
        ([{"field": "n", "operator": "$gt", "value": 4}], [1, 2, 3]),
        ([{"field": "n", "operator": "$gte", "value": "5"}], [1, 2, 3, 7]),
        ([{"field": "n", "operator": "$lt", "value": 6}], [1, 2]),
        ([{"field": "n", "operator": "$lte", "value": 7.5}], [1, 2, 3]),
        ([{"field": "type", "operator": "$in", "value": ["book", "article"]}], [1, 2]),
        ([{"field": "type", "operator": "$nin", "value": ["book"]}], [1, 3, 6, 7]),
        ([{"field": "type", "operator": "$exists", "value": True}], [1, 2]),
        ([{"field": "type", "operator": "$exists", "value": False}], [3, 6, 7]),
        ([{"field": "type", "operator": "$regex", "value": "oo"}], [2]),
        ({"type": None}, []),
        (any_of({"n": 5}, {"n": "abc"}), [1, 7]),
        (all_of({"n": 5}, {"ok": False}), []),
        (none_of({"n": 5}, {"n": "5"}), [3, 6, 7]),
        ({"not": {"n": 5}}, [2, 3, 6, 7]),
    ],
)
def test_filters(rows, filters, expected):
    got = rows.where(compile_filter(filters, JsonFields("metadata"))).select("id").orderBy("id").collect()
    assert [r.id for r in got] == expected


def test_unknown_operator(rows):
    with pytest.raises(ValueError):
        compile_filter([{"field": "n", "operator": "$between", "value": 1}], JsonFields("metadata"))


def test_columns_and_structs(spark):
    df = spark.createDataFrame([(1, "x", 2.0, (True,)), (2, None, float("nan"), None)], "id int, s string, d double, m struct<ok:boolean>")
    f = ColumnFields(df)
    assert [r.id for r in df.where(compile_filter({"s": "x", "m.ok": True}, f)).collect()] == [1]
    assert [r.id for r in df.where(compile_filter([{"field": "d", "operator": "$gt", "value": 1}], f)).collect()] == [1]
    assert [r.id for r in df.where(compile_filter({"ok": True}, ColumnFields(df, "m"))).collect()] == [1]
    assert df.where(compile_filter({"none": 1}, f)).isEmpty()


def test_lookup(spark):
    rows = [("p1", "v1", '{"type": "article", "title": "a", "published": true}'), ("p2", "v2", '{"type": "book", "title": "b", "published": false}'), ("p1", "v3", '{"type": "article", "author": null, "published": true}')]
    df = spark.createDataFrame(rows, "partition_id string, id string, metadata string")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(lookup(df, "title")) == ["v1", "v2"]
    assert ids(lookup(df, "author")) == ["v3"]  # a null value still has its key
    assert ids(lookup(df, ["type", "published"], ["article", True])) == ["v1", "v3"]
    assert ids(lookup(df, {"type": "article", "title": "a"})) == ["v1"]
    assert ids(lookup(df, {"type": "article"}, limit=1, order="id")) == ["v1"]
    assert F is not None
