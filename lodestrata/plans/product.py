"""Queries of the product operators on the star schema, in the roles of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata import registry
from lodestrata.functions import classify, documents, labels, text
from lodestrata.operators import browse, product

TITLES = (
    "2025年公办小学对口地段范围", "2024年小学划片", "幼升小对口说明", "公办初中入学方式", "小升初对口一览", "招生方案（学校层面）某某中学", "招生方案（学校层面）某某小学", "校区范围", "2023年招生入学工作实施意见",
    "学校一览", "考试中心", "别的通知",
)
PLACES = ("宝山一村", "果园村", "海滨新村", "二村居委", "嘉萱苑", "马陆镇", "清河路38弄", "东方花园三期", "东方花园（一期）", "某某镇幸福苑", "城南路小区", "金桥湾清水苑北区二期")
TIERS = ("一梯队", "二梯队", "三梯队")


def _t(spark, sf, *names):
    return [registry.read(spark, sf, n) for n in names]


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def q51_entity_detail(spark, sf):
    customer, orders, events = _t(spark, sf, "customer", "orders", "events")
    found = [product.detail(customer, "c_custkey", key, F.col("c_nationkey") < 9, {"n_orders": (orders, "o_custkey"), "n_events": (events, "user_id")}) for key in ("6", 8, 7, "x", -1, None, "1_0", " 5 ", "+3", 1 << 70, "9" * 30, "٣", "4.0")]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.select("c_custkey", "c_name", "c_mktsegment", "n_orders", "n_events")


def q52_map_list(spark, sf):
    customer, nation, orders = _t(spark, sf, "customer", "nation", "orders")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("tier", labels.known_tier(_pick((*TIERS, "x", None), F.col("c_custkey")), TIERS, "待补充"))
    rows = rows.filter(F.col("tier").isin("一梯队", "待补充") & text.search_in("MA", F.col("n_name"), F.col("c_mktsegment")))
    rows = rows.join(orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    place = F.row_number().over(Window.partitionBy("n_name").orderBy(classify.rank_of(F.col("tier"), TIERS), F.collate("c_name", "zh"), "c_custkey")).cast("long")
    rows = rows.withColumn("place", place)  # within a district
    return rows.orderBy(classify.rank_of(F.col("tier"), TIERS), F.collate("n_name", "zh"), F.collate("c_name", "zh"), "c_custkey").select("c_custkey", "tier", "n_name", "c_mktsegment", "place")


def q53_links_with_latest(spark, sf):
    orders, events = _t(spark, sf, "orders", "events")
    links = orders.filter(F.year("o_orderdate") == 1997).select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderpriority")
    return product.with_latest(links, events, "user_id", "ts", "event_id", ["value"]).select("o_orderkey", "user_id", "o_orderpriority", "event_id", "value")


def q54_provenance(spark, sf):
    return product.provenance(q53_links_with_latest(spark, sf), "o_orderpriority", F.col("event_id").isNotNull(), {"via_urgent": "1-URGENT", "via_low": "5-LOW"})


def q55_candidate_summary(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    rows = orders.withColumn("year", F.year("o_orderdate").cast("long")).withColumn("matched", F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey")))
    return product.candidate_summary(rows.filter("year in (1996, 1997)"), ["year", "o_orderstatus"], "o_orderpriority", "1-", "matched")


def q56_price_coverage(spark, sf):
    customer, events, orders = _t(spark, sf, "customer", "events", "orders")
    return product.reached(customer, "c_mktsegment", "c_custkey", {"mapped": (events.filter("event_type = 'purchase'"), "user_id"), "priced": (orders.filter("o_totalprice > 300000"), "o_custkey")})


def q57_worklist(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    address = F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name"))
    missing = product.no_location(address, F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")), F.lit(1.0))
    return product.worklist(customer, "c_custkey", missing, orders.filter(F.year("o_orderdate") == 1998), "o_custkey", skip=(3, 5, 6), limit=200).select("c_custkey", "c_name")


def q58_area_rollup(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    street, area = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("area "), F.col("c_nationkey").cast("string")))
    entities = customer.withColumns({"street": street, "area": area})
    relations = orders.join(entities, F.col("o_custkey") == F.col("c_custkey")).withColumn("verified", F.col("o_orderstatus") == "F")
    return product.areas(entities, relations, "street", "area", "verified", "none")


def q59_picker(spark, sf):
    values = product.picker(_t(spark, sf, "customer")[0], "c_mktsegment")
    return values.withColumn("place", F.row_number().over(Window.orderBy(F.collate("c_mktsegment", "zh"), "c_mktsegment")).cast("long"))  # a few values


def q60_inherited_links(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    members = customer.select(F.col("c_custkey").alias("member_id"), text.feeder_key(F.col("c_name")).alias("key"))
    fed = customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("member_id"), F.explode(F.array(F.col("c_custkey") + 1, F.col("c_custkey") + 2)).alias("n"))
    feeders = fed.join(members.select(F.col("member_id").alias("n"), "key"), "n").select("member_id", "key")
    return product.inherited_links(members, feeders, orders.select(F.col("o_custkey").alias("member_id"), (F.col("o_orderkey") % 50).alias("target_id")).distinct())


def q61_votes(spark, sf):
    (lineitem,) = _t(spark, sf, "lineitem")
    return product.votes(lineitem, ["l_suppkey", "l_returnflag"], "l_linenumber", (1, 2, 3, 4)).select("l_suppkey", "l_returnflag", *[f"tier_{n}" for n in (1, 2, 3, 4)], "n_votes", F.col("tier").cast("long").alias("tier"))


def q62_match_statistics(spark, sf):
    orders, customer = _t(spark, sf, "orders", "customer")
    return product.match_statistics(orders.join(customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left"), "c_custkey")


def q63_json_merge(spark, sf):
    (events,) = _t(spark, sf, "events")
    typed = F.to_json(F.struct(F.col("event_id").alias("n"), (F.col("event_id") % 2 == 0).alias("even"), F.array("event_id", F.lit(None)).alias("list"), F.struct(F.col("event_type").alias("t")).alias("o")), {"ignoreNullFields": "false"})
    props = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 7 == 1, "no json").when(F.col("event_id") % 7 == 2, "[1]").otherwise(typed)
    made = documents.json_merged(props, reviewedAt=F.col("event_type"), n=F.when(F.col("event_id") % 3 > 0, F.col("event_id") * 10))
    return events.select("event_id", made.alias("made"))


def q64_literal_search(spark, sf):
    (documents,) = _t(spark, sf, "documents")
    return browse.counter(documents.filter(F.col("text").like(f"%{text.like_literal('%%%')}%")), "lang", "source")


def q65_verified_note(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    rows = customer.select("c_custkey", (F.col("c_custkey") % 7 == 0).alias("verified"), F.when(F.col("c_custkey") % 2 == 0, "old").otherwise("").alias("note"), "c_acctbal")
    return product.verified_with_note(rows, F.col("c_acctbal") > 5000, "verified", "note", "seen").select("c_custkey", "verified", "note")


def q66_conservation(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    before = customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 > 0, F.col("c_mktsegment")))
    return product.conserved(before, before.withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "NEGATIVE").when(F.col("c_acctbal") < 9000, F.col("c_mktsegment"))), "c_mktsegment")


def q67_reverse_index(spark, sf):
    (part,) = _t(spark, sf, "part")
    return product.element_counts(product.reverse_index(part.withColumn("words", F.split("p_type", " ")), "p_partkey", "words"))


def q68_robust_box(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    points = customer.select((31 + F.col("c_custkey") % 97 / 1000.0).alias("lat"), (121 + F.col("c_custkey") % 89 / 100.0).alias("lng"))
    return product.robust_box(points, "lat", "lng").select(*[F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_e6") for c in ("south", "north", "west", "east")])


def q69_same_place(spark, sf):
    nation, part = _t(spark, sf, "nation", "part")
    found = nation.select(F.col("n_nationkey").alias("found_id"), F.lit(None).cast("string").alias("district"), F.concat(F.lit("花园"), F.col("n_nationkey").cast("string"), F.lit("号"), _pick(("", "一期", "三期", "（东区）"), F.col("n_nationkey"))).alias("name"))
    known = part.select(F.col("p_partkey").alias("community_id"), F.lit("静安").alias("district"), F.concat(F.lit("花园"), F.col("p_size").cast("string"), F.lit("号"), _pick(("", "三期", "（东区）", "北区二期", "村"), F.col("p_partkey"))).alias("name"))
    return product.same_place(found, known)


def q70_titles_and_places(spark, sf):
    (part,) = _t(spark, sf, "part")
    rows = part.select("p_partkey", _pick(TITLES, F.col("p_partkey")).alias("title"), _pick(PLACES, F.col("p_size")).alias("place"))
    return rows.select(
        "p_partkey", classify.title_category(F.col("title")).alias("category"), classify.is_residential(F.col("place")).alias("residential"), classify.is_official_area(F.col("place")).alias("area"),
        labels.entity_kind(F.col("place")).alias("kind"), F.array_join(text.community_aliases(F.col("place")), "|").alias("aliases"),
    )


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
