"""Queries of the naming, labelling and value rules, and of guarded row edits, on names made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata import registry
from lodestrata.functions import labels, text
from lodestrata.operators import ingest


def _t(spark, sf, *names):
    return [registry.read(spark, sf, n) for n in names]


def _text(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def q91_district_names(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    raw = _pick(("浦东新区", "浦东区", "静安区", "静安", " 宝山区　", "宝山", "徐汇区", "外地", None), F.col("c_custkey"))
    return customer.select(
        "c_custkey", text.district_key(raw).alias("key"), text.district_in_scope(raw).alias("in_scope"), text.district_label(raw).alias("label"), text.bare_district(raw).alias("bare"), text.district_in_label(_text("某苑 上海", raw, "房价")).alias("in_label"),
        raw.isin(*text.storage_names(("浦东", "静安"))).alias("stored"),
    )


def q92_name_keys(spark, sf):
    (part,) = _t(spark, sf, "part")
    n = F.col("p_partkey")
    return part.select(
        "p_partkey", text.poi_key(_text("上海市徐汇区 实验", n, "小学（总部）")).alias("poi"), text.source_key(_text("园西・Ａ", n, "小学（南桥校区） ")).alias("source"), text.feeder_key(_text("上海市徐汇区", n, "小学（部分）")).alias("feeder"),
        text.campus_key(F.when(n % 4 == 0, "总校").when(n % 4 == 1, "——").when(n % 4 == 2, _text(" 东 ", n, "校区")).otherwise(_text(n, "校区部"))).alias("campus"), text.address_key(_text("上海市徐汇区漕东支路（近", n, "）", n, "号")).alias("address"),
        text.school_key(_text("上海市 <b>", n, "</b>小学（东：区）")).alias("school"), F.array_join(text.school_variants(_text(n, "学校小学部")), "|").alias("variants"), text.content_hash(F.col("p_name")).alias("hash"), text.bracket_cut(_text(" 东", n, "(注）x")).alias("cut"),
        F.array_join(text.hashtags(_text("#标签", n, " x #b#标签", n)), "|").alias("tags"),
    )


def q93_label_rules(spark, sf):
    (part,) = _t(spark, sf, "part")
    k = F.col("p_partkey")
    level, kinds = F.when(k % 3 == 0, "administrative_or_enrollment_area"), _pick(("商务住宅;住宅区;小区", "商务住宅;楼宇", "房产小区:住宅小区", "学校", None), k)
    url, quote = F.when(k % 2 == 0, "https://www.edu.gov.cn/x").otherwise("https://gov.cn/x"), F.when(k % 5 > 0, _text("范围：幸福 苑、", k)).otherwise("没有")
    official = labels.is_official_source(_pick(("official_pudong_junior_2025", "official_school_community_candidates:7", "other"), k), url)
    return part.select(
        "p_partkey", labels.tier_label(F.when(k % 9 > 0, k % 9 - 1), F.when(k % 2 == 0, "middle").otherwise("primary")).alias("tier"), labels.relation_kind(level, k % 2 == 0).alias("kind"), labels.relation_status(level, k % 2 == 0, k % 5 == 0).alias("status"),
        labels.is_residential_poi(kinds).alias("residential"), labels.stage_in(_text(k, _pick(("年级 初中", "一年级中学", "六年级", "园"), k))).alias("stage"), labels.looks_like_address(_text(_pick(("漕东路", "学校地址路", "村", "幢"), k), k)).alias("address"),
        labels.run_name(k.cast("string"), F.lit("amap"), F.when(k % 2 == 0, _text("x/community-location-backfill/20260711-12000", k % 10, "/r.json")).otherwise("y")).alias("run"), labels.metric_text(k, F.lit(1000), k / 2).alias("metric"),
        labels.eligibility(k % 7 > 0, official, F.when(k % 4 == 0, "马陆镇").otherwise("幸福苑"), quote).alias("reason"), official.alias("official"),
    )


def q94_row_edits(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    rows = ingest.insert_row(customer, "customer", {"c_name": "New one", "c_acctbal": "", "c_nationkey": "3", "unknown": "x", "created_at": "y"})
    rows = ingest.update_row(rows, "customer", {"c_custkey": 5}, {"c_name": "Renamed", "c_custkey": 99, "c_acctbal": "12.5"})
    rows = ingest.delete_row(rows, "customer", {"c_custkey": 7})
    return ingest.delete_rows(rows, "customer", [{"c_custkey": k} for k in (1, 2, 2)]).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def q95_value_rules(spark, sf):
    (events,) = _t(spark, sf, "events")
    k = F.col("event_id")
    shown = F.when(k % 6 == 0, _text('"t', k, '"')).when(k % 6 == 1, k.cast("string")).when(k % 6 == 2, _text('{"label":"l', k, '","text":"x"}')).when(k % 6 == 3, "[1]").when(k % 6 == 4, "true").otherwise("null")
    prose = F.when(k % 2 == 0, _text('{"a":"一', k, '","b":["二",3,"三"],"c":4}')).otherwise(_text("  many\n words ", k))
    names = F.array(_text("a", k % 3), F.lit("a1"), F.lit(""), F.lit(None), F.lit("b"), F.lit("b"))
    return events.select(
        "event_id", text.display_value(shown).alias("shown"), text.summary(prose).alias("summary"), F.array_join(text.aliases_of(F.lit("a1"), names), "|").alias("aliases"), text.size_or(F.when(k % 2 == 0, F.array(k.cast("string"))), names).cast("long").alias("size"),
        text.count_text(F.when(k % 3 == 0, _text(k % 90, ".5万")).when(k % 3 == 1, _text("赞", k, "w")).otherwise(_text(k, "+"))).alias("likes"), text.price_number(F.when(k % 4 == 0, "0").when(k % 4 == 1, "x").otherwise(_text(k + 1, ",000"))).alias("price"),
    )


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
