"""Expressions and classifications on the examples of the fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import classify, geo, text
from lodestrata.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "wanted"), [
    ("虹桥/娄山/天山初中(派位)", "虹桥/娄山/天山初中"), ("田林三中（部分对口）/中国中学（部分对口）", "田林三中/中国中学"), ("市光学校(初中部)", "市光学校"), (None, None),
])
def test_notes_are_dropped(spark, value, wanted):
    assert one(spark, text.without_notes, value) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("虹桥/娄山/天山初中", ["虹桥", "娄山", "天山初中"]), ("市西初级、七一中学", ["市西初级", "七一中学"]), ("", [])])
def test_lists_are_split(spark, value, wanted):
    assert one(spark, text.listed, value) == wanted


@pytest.mark.parametrize(("value", "wanted"), [
    ("本校直升", "direct"), ("虹桥/娄山/天山初中(派位)", "placement"), ("零陵/南洋(派位+对口)", "placement"), ("田林三中(部分对口)/中国中学(部分对口)", "partial"),
    ("徐教院附中(对口)", "assign"), ("风华初级中学", "unknown"),
])
def test_admission_mode(spark, value, wanted):
    assert one(spark, classify.admission_mode, value) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("浦东新区", "浦东"), ("浦东区", "浦东"), ("静安区", "静安"), (" 宝山区 ", None), (None, None)])
def test_district_scope(spark, value, wanted):
    assert one(spark, text.district_in_scope, value) == wanted


def test_district_label_keeps_what_is_out_of_scope(spark):
    assert [one(spark, text.district_label, v) for v in ("浦东", "静安区", "宝山区")] == ["浦东新区", "静安区", "宝山区"]


@pytest.mark.parametrize("value", ["上海市浦东新区园西小学（南桥校区）", "上海市浦东新区园西小学(南桥校区)"])
def test_school_key(spark, value):
    assert one(spark, text.school_key, value) == "浦东新区园西小学南桥校区"


@pytest.mark.parametrize("name", ["宝山一村", "泗塘一村", "海滨新村"])
def test_residential(spark, name):
    assert one(spark, classify.is_residential, name)


@pytest.mark.parametrize("name", [
    "果园村", "三营房居委", "海滨二村一居委", "金溪居委会金商新村", "宝山实验学校", "某某培训机构", "清河路", "清河路38弄", "中山西路中华新村", "人民西路西北新村", "道路片区",
])
def test_not_residential(spark, name):
    assert not one(spark, classify.is_residential, name)


@pytest.mark.parametrize(("name", "wanted"), [
    ("新成路街道迎园社区", True), ("东陆村民小组", True), ("二村居委", True), ("嘉萱苑", True), ("马陆镇", False), ("安亭镇片区", False), ("宝安公路3636弄", False), ("38弄", False), ("道路片区", False),
])
def test_official_area(spark, name, wanted):
    assert one(spark, classify.is_official_area, name) is wanted


def test_numbers_in_text(spark):
    assert [one(spark, text.count_text, v) for v in ("1.2万", "3w", "25", "none")] == [12000.0, 30000.0, 25.0, None]
    assert one(spark, lambda c: text.year_in(c, F.lit(2025)), "plan of 2024") == 2024
    assert one(spark, lambda c: text.year_in(c, F.lit(2025)), "plan") == 2025


def test_percent_rounds_halves_up_and_is_zero_of_nothing(spark):
    row = spark.createDataFrame([(2, 18), (0, 0), (1, 800)], "a long, b long").select(text.percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r["p"] for r in row] == [11.1, 0.0, 0.1]


def test_similarity(spark):
    rows = spark.createDataFrame([("ab", "ab"), ("", "x"), ("abc", "ab"), ("abcd", "cdef")], "a string, b string")
    assert [r[0] for r in rows.select(text.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 2 / 3, 0.5]


def test_presence_vocabulary(spark):
    values = ["x", "", "  ", None, "待补充", "—"]
    assert [one(spark, text.meaningful, v) for v in values] == [True, False, False, False, False, False]


def test_unicode_helpers(spark):
    assert one(spark, text.nfkc, "（Ａ１）") == "(A1)"
    assert one(spark, text.decode_references, "&#20013;&amp;&#x6587;") == "中&文"
    assert one(spark, text.trim_all, "　x  ") == "x"


def test_hosts(spark):
    urls = ["https://www.edu.gov.cn/a", "https://gov.cn/", "bad", None]
    assert [one(spark, lambda c: text.host_below(c, "gov.cn"), u) for u in urls] == [True, False, False, False]


def test_table_grid_fills_spans(spark):
    page = '<table><tr><th rowspan="2">a</th><th colspan=2>b</th></tr><tr><td>c</td><td>d</td></tr></table>'
    assert one(spark, text.table_grid, page) == [["a", "b", "b"], ["a", "c", "d"]]
    assert one(spark, text.table_grid, "no table") == []


def test_polylines_become_closed_rings(spark):
    rings = one(spark, geo.polyline_rings, "1,1;2,1;2,2|0,0;1,1")
    assert rings == [[[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]]


def test_embedded_document(spark):
    page = '<script>var ALL_DATA = {"静安": {"区": "静安", "小学": [{"名称": "一小", "街道": "a", "对口居委": ["甲", "乙"]}, {"名称": "二小", "对口居委": "丙"}], "初中": [{"名称": "一中"}]}};\nvar TLB=1</script>'
    pages = spark.createDataFrame([(page,), ("nothing",), (None,)], "html string")
    schools = files.document_schools(pages)
    assert sorted((r["stage"], r["place"], r["school"]["名称"]) for r in schools.collect()) == [("middle", 0, "一中"), ("primary", 0, "一小"), ("primary", 1, "二小")]
    found = {r["source_key"] for r in files.committee_relations(schools).collect()}
    assert found == {"静安:primary:一小:0:甲", "静安:primary:一小:1:乙", "静安:primary:二小:0:丙"}


def test_mercator_bands_and_signs(spark):
    """The six bands by the reference's formula, on either side of the equator and of the meridian."""
    points = [(sign * 13_500_000.0, way * (bound + 1000.0)) for bound in geo.MERCATOR_BANDS for sign in (1, -1) for way in (1, -1)]

    def wanted(x, y):
        f = next(f for bound, f in zip(geo.MERCATOR_BANDS, geo.MERCATOR_FACTORS, strict=True) if abs(y) >= bound)
        lng, lat = f[0] + f[1] * abs(x), sum(f[k + 2] * (abs(y) / f[9]) ** k for k in range(7))
        return -lng if x < 0 else lng, -lat if y < 0 else lat

    got = spark.createDataFrame(points, "x double, y double").select(*geo.mercator_to_degrees(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [pytest.approx(wanted(x, y), abs=1e-9) for x, y in points]
