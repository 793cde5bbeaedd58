"""Labels, names, links and JSON values of the product operators on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import classify, labels, text
from lodestrata.operators import browse, match, product


def one(spark, column, *values, kind="string"):
    names = [f"v{n}" for n in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} {kind}" for n in names)).select(column(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "value", "wanted"), [
    (text.source_key, "园西・小学（南桥校区） ", "园西小学南桥"), (text.source_key, "Ａ－B_小学", "AB小学"), (text.poi_key, "上海市徐汇区 实验小学（总部）", "徐汇"), (text.address_key, "上海市徐汇区漕东支路（近地铁）1号", "漕东支路1号"),
    (text.feeder_key, "上海市徐汇区汇师小学（部分）", "汇师"), (text.campus_key, "总校", ""), (text.campus_key, " 东 校区", "东"), (text.campus_key, "—", ""), (text.bare_district, "崇明县", "崇明"), (text.bare_district, "", None),
    (text.district_in_label, "某某小区 上海静安区房价", "静安"), (text.district_in_label, "北京", None), (text.price_number, "81,234", 81234.0), (text.price_number, "0", None), (text.price_number, "x", None),
    (text.lines_of, "a<br/>b</p>c&#20013;<i>d</i>", "a\nb\nc中d"), (text.article_title, "<meta name='ArticleTitle' content='标题'>", "标题"), (text.article_title, "<title>名单_上海市人民政府</title>", "名单"), (text.article_title, "", ""),
    (text.summary, '{"a": "一", "b": ["二", "三"], "c": 4}', "一；二；三"), (text.summary, "x  y\n" + "z" * 200, "x y " + "z" * 146 + "..."), (text.content_hash, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
    (text.display_value, '"x"', "x"), (text.display_value, "3.5", "3.5"), (text.display_value, "true", "true"), (text.display_value, '{"label": "l", "text": "t"}', "l"), (text.display_value, "[1]", None), (text.display_value, "null", None),
    (labels.is_residential_poi, "商务住宅;住宅区;住宅小区", True), (labels.is_residential_poi, "商务住宅:楼宇", False), (labels.is_residential_poi, None, False), (labels.stage_in, "一年级 中学", "primary"), (labels.stage_in, "六年级", "middle"),
    (labels.looks_like_address, "漕东路1号", True), (labels.looks_like_address, "学校地址号", False), (labels.entity_kind, "某某镇幸福苑", "official_area"), (labels.entity_kind, "幸福苑", "community"), (labels.entity_kind, "马陆", "official_area"),
])
def test_values(spark, f, value, wanted):
    assert one(spark, f, value) == wanted


@pytest.mark.parametrize(("link", "wanted"), [
    ("/b", "https://a.cn/b"), ("//c.cn/d", "https://c.cn/d"), ("http://e", "http://e"), ("f", "https://a.cn/x/y/f"), ("../b", "https://a.cn/x/b"), ("../../../b", "https://a.cn/b"), ("./", "https://a.cn/x/y/"), (".", "https://a.cn/x/y/"),
    ("..", "https://a.cn/x/"), ("?q=1", "https://a.cn/x/y/z?q=1"), ("#t", "https://a.cn/x/y/z?p=2#t"), ("", "https://a.cn/x/y/z?p=2"), ("a/../b/./c?d=../e#f", "https://a.cn/x/y/b/c?d=../e#f"), ("/a/b/../../..", "https://a.cn/"),
    ("mailto:x@y.cn", "mailto:x@y.cn"), ("g//h", "https://a.cn/x/y/g//h"), (None, None),
])
def test_links_are_resolved(spark, link, wanted):
    assert one(spark, lambda c: text.absolute_link(c, "https://a.cn/x/y/z?p=2#q"), link) == wanted
    if link == "../b":
        assert one(spark, lambda c: text.absolute_link(F.lit("k"), c), "http://a.cn") == "http://a.cn/k"


def test_links(spark):
    assert [one(spark, lambda c: text.absolute_link(c, "https://a.cn/x"), v) for v in ("/b", "//c.cn/d", "http://e", "f")] == ["https://a.cn/b", "https://c.cn/d", "http://e", "https://a.cn/f"]
    assert one(spark, lambda c: text.listing_link(c, "m.x.cn", "www.x.cn", "sh"), "http://www.x.cn/community/1?flag=2&a=b&city=bj") == "https://m.x.cn/community/1?a=b&city=sh"


def test_lists_and_json(spark):
    rows = spark.createDataFrame([("a", ["b", "a", "", None, "b"], ["c"], [])], "name string, x array<string>, y array<string>, z array<string>")
    got = rows.select(text.aliases_of(F.col("name"), F.col("x"), F.col("y")).alias("a"), text.size_or(F.col("z"), F.col("x")).alias("n"), text.size_or(F.col("z"), F.lit(None).cast("array<string>")).alias("none")).first()
    assert tuple(got) == (["b", "c"], 5, 0)
    assert text.storage_names(("浦东", "静安")) == ["浦东", "浦东区", "浦东新区", "静安", "静安区"] and text.quoted_name("a`b") == "`a``b`"


def test_tiers_and_relations(spark):
    rows = spark.createDataFrame([(None, "middle"), (0, "primary"), (1, "primary"), (3, "middle"), (7, "middle")], "tier int, kind string")
    assert [r[0] for r in rows.select(labels.tier_label(F.col("tier"), F.col("kind"))).collect()] == ["未分级", "待补", "一梯队", "三梯队", "四梯队"]
    rows = spark.createDataFrame([("administrative_or_enrollment_area", True, True), (None, True, True), (None, False, False), (None, None, True)], "level string, a boolean, b boolean")
    assert [tuple(r) for r in rows.select(labels.relation_kind(F.col("level"), F.col("a")), labels.relation_status(F.col("level"), F.col("a"), F.col("b"))).collect()] == [
        ("官方招生区域", "待核验"), ("住宅小区关系", "已审核"), ("来源收录关系", "来源收录"), ("来源收录关系", "部分匹配")]
    assert one(spark, labels.run_name, "20260101", "amap", "x/community-location-backfill/20260711-120000/r.json") == "20260101-amap-20260711-120000"
    assert one(spark, labels.metric_text, 1, 9, 11, kind="int") == "1/9 (11%)"


def test_eligibility_gives_the_first_reason(spark):
    rows = [(True, "official_pudong_junior_2025", "https://a.gov.cn/x", "幸福苑", "含 幸福 苑 等"), (False, "x", None, "a", "a"), (True, "other", "https://a.gov.cn/x", "幸福苑", "幸福苑"), (True, "official_school_community_candidates:1", "https://a.gov.cn", "马陆镇", "马陆镇"), (True, "official_pudong_junior_2025", "https://a.gov.cn/x", "幸福苑", "没有")]
    df = spark.createDataFrame(rows, "same boolean, source string, url string, name string, quote string")
    got = [r[0] for r in df.select(labels.eligibility(F.col("same"), labels.is_official_source(F.col("source"), F.col("url")), F.col("name"), F.col("quote"))).collect()]
    assert got == [labels.REASONS[n] for n in (4, 0, 1, 2, 3)]


def test_points_of_interest_are_scored(spark):
    rows = [("汇师小学", "", "", True, None, None), ("汇师小学", "汇师幼儿园", "", True, None, None), ("汇师小学", "汇师大学", "", True, None, None), ("汇师小学", "汇师培训", "", True, None, None), ("汇师小学", "汇师小学停车场", "", True, None, None), ("汇师小学", "汇师小学", "学校", True, "漕东路1号", "漕东路1号"), ("汇师小学", "别的小学", "学校", False, "漕东路1号", "天钥桥路2号")]
    df = spark.createDataFrame(rows, "name string, poi string, kind string, same boolean, address string, poi_address string")
    got = [r[0] for r in df.select(match.poi_score(*[F.col(c) for c in ("name", "poi", "kind", "same", "address", "poi_address")], F.lit(False))).collect()]
    assert got == [-100, -40, -40, -40, -60, 25 + 20 + 110 + 80 + 70 + 80 + 4, -80]
    ranked = spark.createDataFrame([(1, 10, 90, 2), (1, 11, 90, 1), (2, 12, 60, 1)], "k int, poi int, score int, n int")
    assert [(r["k"], r["poi"]) for r in match.accepted(ranked, "k", "score", "n").collect()] == [(1, 11)]


def test_inherited_links_leave_out_what_is_there(spark):
    members = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "member_id int, key string")
    feeders = spark.createDataFrame([(3, "a"), (3, "b"), (3, "none")], "member_id int, key string")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 11)], "member_id int, target_id int")
    assert [tuple(r) for r in product.inherited_links(members, feeders, links).collect()] == [(3, 10)]


def test_curated_links_are_judged(spark):
    candidates = spark.createDataFrame([(1, "x"), (2, "y")], "candidate_id int, district string")
    targets = spark.createDataFrame([(7, "x")], "target_id int, district string")
    mapping = spark.createDataFrame([(1, 7), (2, 7), (1, 8), (9, 7)], "candidate_id int, target_id int")
    assert {(r[0], r[1]): r[2] for r in product.curated(candidates, mapping, targets).collect()} == {(1, 7): "ok", (2, 7): "other district", (1, 8): "no target", (9, 7): "no candidate"}


def test_shapes(spark):
    rows = spark.createDataFrame([("a", 1, 0.0, 1.0, 0.0, 1.0), ("a", 2, 0.0, 2.0, 0.0, 2.0), ("a", 3, 0.0, 2.0, 0.0, 2.0), ("b", 4, None, 1.0, 0.0, 1.0)], "name string, id int, s double, n double, w double, e double")
    assert {tuple(r) for r in product.largest_box(rows, "name", "id", "s", "n", "w", "e").collect()} == {("a", 2), ("b", 4)}
    polygon, many = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]],[[5,5]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,1]]],[[[2,2]],[[3,3]]]]}'
    assert [one(spark, product.outer_rings, g) for g in (polygon, many)] == [[[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]], [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0]]]]
    assert one(spark, product.located, 1.0, None, kind="double") is False and one(spark, product.located, 1.0, 2.0, kind="double") is True


def test_small_reports(spark):
    assert product.latest_year(spark.createDataFrame([(2024,), (2026,)], "y int"), "y").first()["year"] == 2026
    assert product.latest_year(spark.createDataFrame([], "y int"), "y").first()["year"] >= 2026
    page = browse.clamped_page(spark.range(7).withColumnRenamed("id", "id"), 99, 3)
    assert [r["id"] for r in page.collect()] == [0]
    assert [one(spark, classify.title_category, t) for t in ("公办初中入学方式", "招生方案（学校层面）九年一贯制", "登记点", None)] == ["middle-scope", "middle-scope", "school-list", "other"]


def test_only_our_own_names_are_peeled(spark):
    found = spark.createDataFrame([(1, "静安", "东方花园三期"), (2, None, "东方花园"), (3, "浦东", "东方花园"), (4, None, " 东方花园一期 ")], "found_id int, district string, name string")
    known = spark.createDataFrame([(10, "静安", "东方花园一期"), (11, "静安", "东方花园三期"), (12, None, "东方花园")], "community_id int, district string, name string")
    assert sorted(map(tuple, product.same_place(found, known).collect())) == [(1, 11), (2, 10), (2, 11), (2, 12), (3, 12), (4, 10)]


def test_aliases_are_peeled_step_by_step(spark):
    names = ("东方花园一期（东区）", "东方花园一期（东区）二期三期", " 一期", "园一期", "东方（南区）", "东方(3期) ", "", None)
    want = [["东方花园一期（东区）", "东方花园"], ["东方花园一期（东区）二期三期", "东方花园一期（东区）二期", "东方花园一期（东区）", "东方花园"], ["一期"], ["园一期"], ["东方（南区）", "东方"], ["东方(3期)", "东方"], [""], [None]]
    assert [one(spark, text.community_aliases, n) for n in names] == want
    plan = spark.createDataFrame([("x",)], "n string").select(text.community_aliases(F.col("n")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 4


def test_conservation_with_a_null_kind(spark):
    before = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    after = spark.createDataFrame([("a",), (None,), (None,)], "k string")
    got = sorted(map(tuple, product.conserved(before, after, "k").collect()), key=repr)
    assert got == sorted([("a", False, 2, 1, True), (None, False, 1, 2, True), ("b", False, 1, 0, True), (None, True, 4, 3, False)], key=repr)


@pytest.mark.parametrize(("key", "n"), [("6", 1), (6, 1), ("06", 1), ("1_0", 0), (" 6 ", 0), ("+6", 0), (1 << 70, 0), ((1 << 63) - 1, 0), ("9" * 19, 0), ("٦", 0), (6.0, 0), (True, 0), (None, 0), ("", 0), (-6, 0), (0, 0)])
def test_detail_takes_digits_alone(spark, key, n):
    rows, child = spark.range(10).withColumnRenamed("id", "k"), spark.range(3).selectExpr("6 as own")
    assert [tuple(r) for r in product.detail(rows, "k", key, F.lit(True), {"n": (child, "own")}).collect()] == [(6, 3)] * n
