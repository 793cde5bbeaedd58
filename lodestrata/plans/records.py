"""Queries of records made from pages and nested values, of snapshots, changes and cascades, on the star schema.

The tables hold no school pages, so each customer, with all orders, and each part is written as such a page first, and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata import registry
from lodestrata.functions import documents, text
from lodestrata.operators import browse, changes, coverage, facets, ingest, ladder, snapshots
from lodestrata.shared import shared_path
from lodestrata.sources import articles, files, footers

KINDS = {"BUILDING": "house", "AUTOMOBILE": "garage", "MACHINERY": "plant", "HOUSEHOLD": "home", "FURNITURE": None}


def _t(spark, sf, *names):
    return [registry.read(spark, sf, n) for n in names]


def _text(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _entries(spark, sf):
    """The orders of each customer, under the names of an order's lines: the entries of a page."""
    (orders,) = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    return orders.select(F.col("o_custkey").alias("l_orderkey"), (k % 7 + 1).cast("int").alias("l_linenumber"), k.alias("l_partkey"), (k % 101).alias("l_suppkey"), F.floor("o_totalprice").alias("l_quantity"))


def _lines(spark, sf, cell):
    """Per customer the entries, each as one value, in the order of their numbers."""
    rows = _entries(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("cell")))).alias("cells"))
    return rows.select("l_orderkey", F.col("cells.cell").alias("cells"))


def q71_article_records(spark, sf):
    k, shape = F.col("l_orderkey"), F.col("l_orderkey") % 3
    name = _text("第", F.col("l_partkey"), F.when(F.col("l_linenumber") % 6 == 5, "小学东").otherwise("小学"))
    campus = F.element_at(F.array(F.lit("东校区"), F.lit("本部"), F.lit("——"), F.lit("")), F.col("l_linenumber") % 4 + 1)
    address = F.when(F.col("l_linenumber") % 5 == 0, "无").otherwise(_text(F.col("l_suppkey"), "路<br>", F.col("l_linenumber"), "号"))
    row = (
        F.when(shape == 0, _text("<tr><td>", F.col("l_linenumber"), "</td><td><b>", name, "</b></td><td>", campus, "</td><td>", address, "</td><td>公办</td></tr>"))
        .when(shape == 1, _text("<tr><td>", name, "</td><td>", address, "</td></tr>"))
        .otherwise(_text("<TR class=x><td>", name, "</td><td> ", campus, " </td><td>", address, "</td><td>民&#21150;</td></TR>"))
    )
    head = (
        F.when(shape == 0, '<tr><th rowspan="3">序号</th><th colspan="2">学校</th><th rowspan=3>学校<span>地址</span></th><th rowspan=3>办学性质</th></tr><tr><th rowspan=2>学校名称</th><th rowspan="2">校区</th></tr><tr></tr>')
        .when(shape == 1, "<tr><td>名称</td><td>学校地址</td></tr>").otherwise("<tr><td colspan=4>一览</td></tr><tr><td> - </td></tr><tr><td>学校名称</td><td>校区</td><td>学校地址</td><td>性质</td></tr>")
    )
    rows = _lines(spark, sf, row)
    meta = F.when(k % 2 == 0, _text("<meta name='ArticleTitle' content='", F.when(k % 4 == 0, "公办小学基本情况").otherwise("初中基本情况"), "'>")).otherwise("")
    html = _text(meta, "<p>x</p><table><tr><td>别的</td></tr></table><table border=1>", head, F.array_join("cells", ""), "<tr><td>合计</td><td>1路</td><td>1路</td><td>1路</td></tr></table>")
    pages = rows.select(_text("区", k % 16).alias("district"), _text("/a/", k).alias("url"), F.lit("办学情况").alias("title"), html.alias("html"))
    return articles.article_records(pages)


def q72_committee_inventory(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    name = _text("居委", F.col("l_suppkey") % 7, F.when(F.col("l_linenumber") % 2 == 0, "（部分）").otherwise(" "))
    rows = _t(spark, sf, "lineitem")[0].groupBy("l_orderkey").agg(F.collect_list(name).alias("cells"))
    schools = orders.join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(_text("学校", F.col("o_custkey")).alias("school"), F.when(F.col("o_orderstatus") != "P", F.col("cells")).alias("committees"))
    return articles.committee_inventory(schools, "school", "committees")


def q73_faceted_search(spark, sf):
    (docs,) = _t(spark, sf, "documents")
    langs = ("en", "de", "fr", "es")
    hit = F.col("lang").isin("en", "de") & facets.any_contains(" License ", F.col("text"), F.col("source"))
    found = facets.faceted(docs.select("doc_id", "lang", "source", "text"), {x: F.col("lang") == x for x in langs}, hit, [F.desc("lang"), F.desc("doc_id")], number=2, size=20)
    counts = [F.lit(v).cast("long").alias(n) for n, v in (("n_all", found.n_all), ("n_visible", found.n_visible), ("page", found.number), ("pages", found.n_pages), *((f"n_{x}", found.counts[x]) for x in langs))]
    return found.page.select("doc_id", "lang", "position", text.excerpt(F.col("text")).alias("excerpt"), *counts)


def q74_page_state(spark, sf):
    card = F.struct(F.col("l_partkey").alias("id"), _text('}{"\\', F.col("l_suppkey"), "]").alias("label"), F.struct(F.struct((F.col("l_quantity") * 100).cast("long").alias("cents")).alias("price")).alias("deep"), F.array(F.array("l_linenumber")).alias("tags"))
    rows = _lines(spark, sf, card)
    state = F.to_json(F.struct(F.struct(F.col("cells").alias("cards")).alias("list"), F.col("l_orderkey").alias("order")))
    html = _text('<html><script>var other={"a":1};window.STATE = ', F.when(F.col("l_orderkey") % 5 == 0, F.substring(state, F.lit(1), F.length(state) - 3)).otherwise(state), ";var x=1;</script><p>}</p></html>")
    found = rows.select(documents.page_state(html, "window.STATE").alias("s"))
    # posexplode_outer: for posexplode Spark would infer a filter that parses the page once more
    cards = found.select(F.try_variant_get("s", "$.order", "long").alias("l_orderkey"), F.posexplode_outer(F.try_variant_get("s", "$.list.cards", "array<variant>")).alias("place", "c")).filter("place is not null")
    return cards.select(
        "l_orderkey", F.col("place").cast("long").alias("place"), F.try_variant_get("c", "$.id", "long").alias("id"), F.try_variant_get("c", "$.label", "string").alias("label"), F.try_variant_get("c", "$.deep.price.cents", "long").alias("cents"),
        F.try_variant_get("c", "$.tags[0][0]", "long").alias("tag"),
    )


def q75_price_pages(spark, sf):
    (part,) = _t(spark, sf, "part")
    k = F.col("p_partkey")
    head = F.when(k % 11 > 0, _text('<h1 class="a situationHead b"> ', F.col("p_name"), " <i>房价 （住宅）</i></h1>")).otherwise("<h1>none</h1>")
    amount = F.when(k % 7 == 0, "0").when(k % 7 == 1, _text(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise((k + 1).cast("string"))
    block = F.when(k % 5 > 0, _text("<p> 平均房价 <span class='s'>（2026年", k % 12 + 1, "月）</span></p> <div class=\"fl\"><span>", amount, "</span> 元/㎡</div>")).otherwise("<p>平均房价</p>")
    html = _text("<title>", F.col("p_brand"), " 上海徐汇区房价</title>", head, F.when(k % 3 == 0, '<a href="/district/x?city=sh">静安区</a>').otherwise(""), F.when(k % 2 == 0, _text("<li>地址：", F.col("p_type"), "&amp;1号</li>")).otherwise(""), block)
    return part.select("p_partkey", articles.price_page(html).alias("x")).select("p_partkey", "x.*")


def q76_search_results(spark, sf):
    (part,) = _t(spark, sf, "part")
    k = F.col("p_partkey")
    link = '<a class="x" href="'
    html = _text(link, "/community/", k, '?city=sh&flag=3"><b>', F.col("p_brand"), "</b> 上海静安区 1号</a><a href=\"/other?city=sh\">no</a>", F.when(k % 2 == 0, _text(link, "http://old.example/community/", k, 'b?a=1&city=sh">x</a>')).otherwise(""))
    found = part.select("p_partkey", F.posexplode(articles.search_candidates(html, "m.example", "old.example")).alias("place", "c"))
    return found.select("p_partkey", F.col("place").cast("long").alias("place"), "c.url", "c.label", "c.district")


def q77_json_set(spark, sf):
    (events,) = _t(spark, sf, "events")
    k = F.col("event_id")
    attrs = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "broken {").when(k % 5 == 2, _text('{"match":7,"n":', k, "}")).when(k % 5 == 3, _text('{"match":{"old":[', k, ',2.5],"score":0},"z":null}')).otherwise(F.col("props"))
    return events.select("event_id", documents.json_set(attrs, ("match", "score"), k * 2).alias("scored"), documents.json_set(attrs, ("match", "names", 0), F.col("event_type")).alias("named"))


def q78_nested_cut(spark, sf):
    (lineitem,) = _t(spark, sf, "lineitem")
    sections = lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct("l_partkey", "l_quantity", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("lat"))).alias("items"), F.collect_set("l_linestatus").alias("streets"))
    document = sections.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct("items", "streets")))).alias("d"))
    measures = {
        "n_items": lambda s: F.size(s["items"]), "n_streets": lambda s: F.size(s["streets"]), "n_located": lambda s: F.size(F.filter(s["items"], lambda x: x["lat"].isNotNull())),
        "quantity": lambda s: F.aggregate(s["items"], F.lit(0.0), lambda a, x: a + x["l_quantity"]).cast("long"),
    }
    return document.select("l_orderkey", documents.section_counts(documents.cut(F.col("d"), ("A", "R")), measures).alias("s")).select("l_orderkey", "s.*")


def q79_snapshot(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    root = shared_path(spark, "snapshots")
    snapshots.publish(customer.filter("c_custkey % 2 = 0"), root)
    made = snapshots.publish(customer, root, {"balance": F.sum(F.col("c_acctbal").cast("decimal(18,2)")), "segments": F.count_if(F.col("c_mktsegment").isNotNull())}, scope="all", parserVersion=1)
    seen = snapshots.manifest(spark, root)
    assert seen["contentHash"] == made["contentHash"]
    rows = snapshots.latest(spark, root).groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return rows.select("c_mktsegment", "n", F.lit(seen["rows"]).cast("long").alias("n_rows"), F.lit(str(seen["stats"]["balance"])).alias("balance"), F.lit(seen["stats"]["segments"]).cast("long").alias("n_segments"))


def q80_undo_log(spark, sf):
    (orders,) = _t(spark, sf, "orders")
    before = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderstatus")).alias("status")).unionByName(orders.filter("o_orderkey % 10 = 0").select("o_orderkey", "o_custkey", F.lit("X").alias("status")))
    after = before.filter("o_orderkey % 7 > 0").withColumn("status", F.when(F.col("o_orderkey") % 5 == 0, "U").otherwise(F.col("status"))).unionByName(orders.filter("o_orderkey % 3 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("N").alias("status")))
    path = shared_path(spark, "undo")
    changes.difference(before, after).write.parquet(path)
    log = spark.read.parquet(path)
    restored = changes.applied(changes.applied(before, log), log, undo=True)
    left = changes.difference(before, restored).agg(F.count("*").alias("n_left"))
    return changes.operations(log, ["o_orderkey"]).groupBy("op").agg(F.count("*").alias("n"), F.sum("came").alias("came"), F.sum("went").alias("went")).crossJoin(left)  # one row


def q81_mapped_rows(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    kind = F.when(F.col("c_custkey") % 6 > 0, F.col("c_mktsegment"))
    mapping = {**KINDS, None: "unknown"}
    made = ladder.note(("from", F.col("c_name")), ("kind", kind), ("balance", F.when(F.col("c_acctbal") < 0, "negative")), ("blank", F.lit(" ")))
    return customer.select("c_custkey", ladder.mapped(kind, mapping, "segment").alias("kind"), made.alias("note"))


def q82_decision_ladder(spark, sf):
    customer, orders, events = _t(spark, sf, "customer", "orders", "events")

    def reached(child, column, value):
        return lambda rest: rest.join(child, F.col("c_custkey") == F.col(column)).select("c_custkey", F.col(value).alias("target"))

    steps = [
        ("direct", reached(orders.filter("o_orderstatus = 'P'"), "o_custkey", "o_orderkey")), ("search", reached(events.filter("event_type = 'purchase'"), "user_id", "event_id")),
        ("large", reached(orders.filter("o_totalprice > 350000"), "o_custkey", "o_orderkey")),
    ]
    return ladder.decided(customer.select("c_custkey"), "c_custkey", steps, "none")


def q83_footer_statistics(spark, sf):
    found = [footers.column_statistics(spark, f"{sf}/{name}.parquet").select(F.lit(name).alias("table"), "column", "n_rows", "n_nulls") for name in ("orders", "documents", "labels")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def q84_visible_links(spark, sf):
    lineitem, orders = _t(spark, sf, "lineitem", "orders")
    shown = orders.filter("o_totalprice > 300000 and o_orderstatus = 'F'")
    return ladder.visible(lineitem, shown, "l_orderkey", "o_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def q85_audit_view(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    entities = customer.select(F.col("c_custkey").alias("entity_id"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("grp"), (F.col("c_acctbal") > 9500).alias("boundary"))
    links = orders.filter("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("year"))
    grid = coverage.grid(spark, entities, links, (1996, 1997))
    found = orders.filter("o_orderstatus = 'P'").join(entities, F.col("o_custkey") == F.col("entity_id")).groupBy(F.year("o_orderdate").alias("year"), "grp", "o_orderpriority").agg(F.count("*").alias("n"))
    return coverage.audit_view(grid, found, F.col("n_links")).select("year", "grp", "total", "n_linked", "status", "pct_linked", "n_candidates", "place")


def q86_alias_search(spark, sf):
    (part,) = _t(spark, sf, "part")
    rows = part.withColumn("aliases", F.when(F.col("p_partkey") % 4 > 0, F.split("p_name", " "))).withColumn("tags", F.array(F.when(F.col("p_size") > 25, "large"), F.lit("any")))
    area = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
    hit = browse.any_element_contains(F.col("aliases"), "ING") | browse.first_present_contains("#3", area, F.col("p_type"))
    return browse.top(rows.filter(hit & browse.has_tag(F.col("tags"), "large")), 300, F.size(F.coalesce("aliases", F.array())).desc(), F.col("p_partkey").asc()).select("p_partkey", "p_name", text.cell_text(F.col("p_name"), size=10).alias("shown"))


def q87_group_checks(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    rows = customer.join(orders.filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    cleaned = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), "o_orderpriority", F.lit("  "))).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise(" ")
    grouped = rows.groupBy("c_custkey", "c_mktsegment").agg(coverage.distinct_present(cleaned).alias("n_values"), coverage.guarded_all(F.col("o_orderstatus") == "F").alias("all_final"), F.count("o_orderkey").alias("n_rows"))
    ranked = browse.top(grouped, 400, F.col("n_rows").desc(), F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), F.col("n_values").asc_nulls_first(), F.col("c_custkey").asc())
    size = F.col("n_rows") * F.col("c_custkey") * 1000
    return ranked.select("c_custkey", "c_mktsegment", "n_values", "all_final", "n_rows", text.bytes_text(size).alias("size"), text.count_label(size).alias("label"))


def q88_boundary_collection(spark, sf):
    customer, nation = _t(spark, sf, "customer", "nation")
    k = F.col("n_nationkey")
    ring = F.concat(F.lit("[[["), k.cast("string"), F.lit(",0],["), (k + 1).cast("string"), F.lit(",0],["), k.cast("string"), F.lit(",1],["), k.cast("string"), F.lit(",0]]]"))
    shapes = nation.select("n_nationkey", "n_name", F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}")).alias("shape")).filter("n_nationkey % 2 = 0")
    features = files.feature_collection(shapes, "shape", "n_nationkey", "n_name")
    held = customer.select("c_custkey", "c_nationkey").join(features.select(F.get_json_object("feature", "$.properties.n_nationkey").cast("int").alias("c_nationkey"), "feature"), "c_nationkey")
    return held.groupBy("feature").agg(F.count("*").alias("n_entities"))


def q89_index_sources(spark, sf):
    n, title = F.col("l_linenumber"), _text("《", F.col("l_partkey") % 3 + 2024, "年公办小学", F.when(F.col("l_suppkey") % 2 == 0, "划片").otherwise("学校一览"), "》")
    district = F.when(n % 3 == 0, "<td>静安区</td>").when(n % 3 == 1, "<td>浦东新区 </td>").otherwise("")
    row = _text("<tr>", district, "<td><a href='", F.when(n % 2 == 0, "../d/").otherwise("?id="), F.col("l_suppkey") % 4, "'>", title, "</a> <a onclick=\"window.open('/w')\" href='#'>别的 </a></td></tr>")
    pages = _lines(spark, sf, row).select("l_orderkey", F.lit("https://h.example/a/b/c.html").alias("url"), _text("<table><tr><td><a href='/x'>before</a></td></tr>", F.array_join("cells", ""), "</table>").alias("html"))
    found = articles.index_sources(pages, "l_orderkey", "html", "url", 2026)
    return found.select(F.col("key").alias("l_orderkey"), "year", "district", "title", "url", "category", "confidence")


def q90_payloads(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    record = _text('{"recordType":"link","sourceKey":"s', n, '","schoolId":', F.when(k % 11 == 0, "-1").when(n % 2 == 0, _text('"', F.col("l_partkey") + 1, '"')).otherwise((F.col("l_partkey") + 1).cast("string")), ',"communityId":', F.col("l_suppkey") + 1, ',"year":', n + 1998, ',"raw":{"q":', n, "}}")
    rows = _lines(spark, sf, record)
    body = _text('{"sourceKey":"', F.when(k % 13 == 0, "Bad Key").otherwise("src.a"), '"', F.when(k % 17 == 0, "").otherwise(',"sourceName":"Name"'), ',"records":[', F.array_join("cells", ","), "]", F.when(k % 19 == 0, "").otherwise("}"))
    records, errors = ingest.payloads(rows.withColumn("body", body), "l_orderkey", "body")
    good = records.groupBy(F.lit("ok").alias("outcome"), "year").agg(F.count("*").alias("n"), F.sum("school_id").alias("schools"), F.count_if(F.col("quote") == F.concat(F.lit('{"q":'), F.substring("record_key", 2, 9), F.lit("}"))).alias("quoted"))
    none = F.lit(None).cast("long")
    return good.filter("year < 2010").unionByName(errors.groupBy(F.col("error").alias("outcome")).agg(F.count("*").alias("n")).select("outcome", none.cast("int").alias("year"), "n", none.alias("schools"), none.alias("quoted")))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
