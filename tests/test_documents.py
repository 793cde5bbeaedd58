"""Nested values: types are kept, paths are set, JSON is cut out of scripts whatever its depth."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import documents


def value(spark, make, text):
    return spark.createDataFrame([(text,)], "j string").select(make(F.col("j"))).first()[0]


@pytest.mark.parametrize("text", ['{"n":1,"o":{"a":[1]}}', '{"a":{"b":null,"c":[1,2.5,"x",true,{"d":[]}]},"big":12345678901234567890,"s":"q\\"u\\\\ \\u4e2d"}', "{}"])
def test_merging_keeps_types(spark, text):
    assert json.loads(value(spark, lambda c: documents.json_merged(c, zz=F.lit(1)), text)) == json.loads(text) | {"zz": 1}
    assert json.loads(value(spark, lambda c: documents.json_joined(c, F.lit('{"o":{"b":2},"y":[]}')), text)) == json.loads(text) | {"o": {"b": 2}, "y": []}


@pytest.mark.parametrize(("text", "merged", "joined"), [(None, '{"k":[1,null]}', "{}"), ("", None, None), ("not json", None, None), ("[1]", None, None), ("5", None, None), ("null", None, None), ('{"k":1', None, None)])
def test_merging_what_is_no_object(spark, text, merged, joined):
    assert value(spark, lambda c: documents.json_merged(c, k=F.array(F.lit(1), F.lit(None))), text) == merged
    assert value(spark, lambda c: documents.json_joined(c, F.lit(None).cast("string")), text) == joined


@pytest.mark.parametrize(("text", "path", "wanted"), [
    ('{"a":1}', ("b",), '{"a":1,"b":"v"}'), ('{"a":1}', ("a",), '{"a":"v"}'), (None, ("a", "b", "c"), '{"a":{"b":{"c":"v"}}}'), ('{"a":{"b":{"x":1},"y":2}}', ("a", "b", "c"), '{"a":{"b":{"c":"v","x":1},"y":2}}'), ('{"a":null}', ("a", "b"), '{"a":{"b":"v"}}'),
    ('{"a":3}', ("a", "b"), '{"a":3}'), ('{"a":[1]}', ("a", "b"), '{"a":[1]}'), ('{"a":{"b":1}}', ("a", 0), '{"a":{"b":1}}'), ('{"a":[1,2,3]}', ("a", 1), '{"a":[1,"v",3]}'), ('{"a":[1,2,3]}', ("a", -1), '{"a":[1,2,"v"]}'),
    ('{"a":[1]}', ("a", 9), '{"a":[1,"v"]}'), ('{"a":[1]}', ("a", -9), '{"a":["v",1]}'), ('{"a":[{"x":1}]}', ("a", 0, "y"), '{"a":[{"x":1,"y":"v"}]}'), ("[[1],2]", (0, 0), '[["v"],2]'), ("{}", ("a", 0, "b"), '{"a":[{"b":"v"}]}'), ("no", ("a",), None), ("7", ("a",), "7"),
])
def test_paths(spark, text, path, wanted):
    assert value(spark, lambda c: documents.json_set(c, path, F.lit("v")), text) == wanted


def test_set_values_keep_their_type(spark):
    for made, wanted in ((F.lit(1), 1), (F.lit(1.5), 1.5), (F.lit(True), True), (F.lit(None), None), (F.struct(F.lit(1).alias("a"), F.lit(None).alias("b")), {"a": 1, "b": None}), (F.array(F.lit("x")), ["x"])):
        assert json.loads(value(spark, lambda c, made=made: documents.json_set(c, ("k", "l"), made), '{"k":{"m":0}}')) == {"k": {"m": 0, "l": wanted}}


@pytest.mark.parametrize(("page", "wanted"), [
    ('<script>window.S = {"a":[1,{"b":"}]\\"{"}],"c":"\\\\"};var q="}";</script>', {"a": [1, {"b": '}]"{'}], "c": "\\"}), ("window.S=[]", []), ("window.S = [1,2", None), ("S={}", None), ("xwindow.S={}", None), ("window.S = {bad};", None), ("window.S = 5;", None), (None, None), ("", None),
    ('window.S\n=\n{"x":"\U0001f600\n"}', None), ('window.S={"x":"\U0001f600"}]', {"x": "\U0001f600"}), ("window.S=" + "[" * 300 + "]" * 300 + ";", "deep"), ('window.S={"t":"' + '\\"' * 20_000 + '"};', {"t": '"' * 20_000}),
])
def test_page_state(spark, page, wanted):
    got = value(spark, lambda c: F.to_json(documents.page_state(c, "window.S")), page)
    if wanted == "deep":
        assert got == "[" * 300 + "]" * 300
    else:
        assert (None if got is None else json.loads(got)) == wanted


def test_pages_are_searched_once(spark, sf):
    from lodestrata.plans.catalogue import QUERIES

    df = QUERIES["q74_page_state"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_cut_equals_exploding(spark):
    made = {"a": {"x": [1, 2], "n": 3}, "b": {"x": [], "n": None}, "c": {"x": None, "n": 5}}
    df = spark.createDataFrame([(1, made), (2, {}), (3, None), (4, {"z": {"x": [9], "n": 1}})], "id int, d map<string,struct<x:array<int>,n:int>>")
    measures = {"items": lambda s: F.size(F.coalesce(s["x"], F.array().cast("array<int>"))), "n": lambda s: s["n"]}
    got = {r.id: tuple(r.s) for r in df.select("id", documents.section_counts(documents.cut(F.col("d"), ("a", "c")), measures).alias("s")).collect()}
    assert got == {1: (2, 2, 8), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}
    assert {r.id: tuple(r.s) for r in df.select("id", documents.section_counts(F.col("d"), measures).alias("s")).collect()}[1] == (3, 2, 8)
