"""Records from articles and price pages, facets, snapshots, undo logs, cascades, mappings and footers, on hand-made rows."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import changes, facets, ladder, snapshots
from lodestrata.plans import records
from lodestrata.sources import articles, footers

STACKED = """<table><tr><th rowspan="3">序号</th><th colspan="2">学校</th><th rowspan="3">学校地址</th><th rowspan="3">性质</th></tr><tr><th rowspan="2">学校名称</th><th rowspan="2">校区</th></tr><tr></tr>
<tr><td>1</td><td rowspan=2>实验小学</td><td>东校区</td><td>1路<br>2号</td><td>公办</td></tr><tr><td>2</td><td>总校</td><td>3路4号</td><td>-</td></tr><tr><td>3</td><td>第三小学东</td><td>东 校区</td><td>5路6号</td><td>民办</td></tr>
<tr><td>4</td><td>没有地址</td><td></td><td>待定</td><td></td></tr><tr><td></td><td>合计</td><td></td><td>9路</td><td></td></tr></table>"""


def pages(spark, *html):
    return spark.createDataFrame([(h, "链接标题", "黄浦", "/u") for h in html], "html string, title string, district string, url string")


def rows_of(spark, *html):
    return [(r.stage, r.name, r.campus, r.nature, r.address, r.source_title) for r in articles.article_records(pages(spark, *html)).collect()]


def test_three_stacked_header_rows(spark):
    assert rows_of(spark, f"<meta name='ArticleTitle' content='小学一览'>{STACKED}") == [
        ("primary", "实验小学（东校区）", "东", "公办", "1路 2号", "小学一览"), ("primary", "实验小学", "", "", "3路4号", "小学一览"), ("primary", "第三小学东", "东", "民办", "5路6号", "小学一览")]


@pytest.mark.parametrize(("html", "wanted"), [
    ("<table><tr><td>名称</td><td>学校地址</td></tr><tr><td>某中学</td><td>一路1号</td></tr></table>", [("middle", "某中学", "", "", "一路1号", "链接标题")]),
    ("<table><tr><td>学校</td><td>学校地址</td></tr><tr><td>某中学</td><td>一路1号</td></tr></table>", []), ("<table><tr><td>名称</td><td>地址</td></tr><tr><td>某校</td><td>一路1号</td></tr></table>", []),
    ("<table></table><table><tr></tr></table>", []), ("", []), (None, []), ("<table><tr><td>学校名称</td><td>学校地址</td></tr>", []),
    ("<table><tr><td colspan=2>公示</td></tr><tr><td>&nbsp;</td></tr><tr><td><span>学校</span>名称</td><td>学校地址</td></tr><tr><td>甲校</td><td>一路1号</td><td>多</td></tr><tr><td>乙校</td></tr></table>", [("unknown", "甲校", "", "", "一路1号", "链接标题")]),
])
def test_header_shapes(spark, html, wanted):
    assert rows_of(spark, html) == wanted


def test_two_tables_and_repeated_pages(spark):
    assert Counter(rows_of(spark, STACKED + STACKED, STACKED)) == Counter(rows_of(spark, STACKED) * 3)
    assert articles.article_records(pages(spark, "x").limit(0)).count() == 0


def test_committees_are_counted_with_and_without_notes(spark):
    rows = [("a", ["一居委（部分）", "一居委", "二居委"]), ("b", ["二居委 "]), ("c", None), ("d", []), (None, ["九居委"])]
    got = {(r.school, r.is_total): (r.n, r.n_unique) for r in articles.committee_inventory(spark.createDataFrame(rows, "s string, c array<string>"), "s", "c").collect()}
    assert got == {("a", False): (3, 2), ("b", False): (1, 1), ("c", False): (0, 0), ("d", False): (0, 0), (None, False): (1, 1), (None, True): (5, 3)}


PRICE = '<title>某苑 上海静安区房价</title><h1 class="x situationHead"> 某苑 <b>房价（住宅）</b></h1><li>地址：一路&amp;2号 </li><p>平均房价 <span>（2026年9月）</span></p><div class="fl"><span a>81,234</span> 元/㎡</div>'


@pytest.mark.parametrize(("page", "wanted"), [
    (PRICE, ("某苑", "一路&2号", "静安", "2026年9月", 81234, None)), (PRICE.replace("situationHead", "other"), (None, "一路&2号", "静安", "2026年9月", 81234, "missing community name")),
    (PRICE.replace("81,234", "0"), ("某苑", "一路&2号", "静安", "2026年9月", None, "invalid unit price 0")), (PRICE.replace("㎡", ""), ("某苑", "一路&2号", "静安", None, None, "missing average price block")),
    ('<a href="/district/x?city=sh">浦东新区</a>' + PRICE.replace("某苑 <b>", "某苑房价<b>"), ("某苑房价", "一路&2号", "浦东新", "2026年9月", 81234, None)), ("", (None, None, None, None, None, "missing community name")), (None, (None, None, None, None, None, "missing community name")),
])
def test_price_pages(spark, page, wanted):
    assert tuple(spark.createDataFrame([(page,)], "p string").select(articles.price_page(F.col("p")).alias("x")).first()["x"]) == wanted


def test_search_candidates(spark):
    page = '<a href="/community/1.html?city=sh&flag=2">甲苑<i>上海静安区</i></a><a class=x href="/community/2?city=bj">no</a><a href="/community/3?x=1&amp;city=sh"></a>'
    got = spark.createDataFrame([(page,), (None,), ("",)], "p string").select(articles.search_candidates(F.col("p"), "m.x.cn", "www.x.cn").alias("c")).collect()
    assert [tuple(c) for c in got[0]["c"]][0] == ("https://m.x.cn/community/1.html?city=sh", "甲苑 上海静安区", "静安") and len(got[0]["c"]) == 2
    assert not got[1]["c"] and got[2]["c"] == []


def test_facets_count_and_page(spark):
    rows = [(n, "ab"[n % 2], None if n % 5 == 0 else f"Name {n}") for n in range(1, 24)] + [(0, None, "name")]
    df = spark.createDataFrame(rows, "id int, kind string, title string").repartition(3)
    choices = {"a": F.col("kind") == "a", "b": F.col("kind") == "b"}
    found = facets.faceted(df, choices, facets.any_contains(" NAME ", F.col("title")), [F.desc("id")], number=3, size=8)
    assert (found.n_all, found.n_visible, found.counts, found.number, found.n_pages) == (24, 20, {"a": 11, "b": 12}, 3, 3)
    assert [(r.id, r.position) for r in found.page.orderBy("position").collect()] == [(3, 17), (2, 18), (1, 19), (0, 20)]
    late = facets.faceted(df, choices, facets.any_contains("", F.col("title")), [F.desc("id")], number=99, size=10)
    assert (late.n_visible, late.number, late.page.count()) == (24, 3, 4)
    none = facets.faceted(df, choices, facets.any_contains("zzz", F.col("title")), [F.desc("id")], number=5)
    assert (none.n_visible, none.number, none.n_pages, none.page.count()) == (0, 1, 1, 0)


def test_facets_scan_once(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 3 as kind").write.parquet(f"{tmp_path}/t")
    before = {r[0] for r in _executions(spark)}
    facets.faceted(spark.read.parquet(f"{tmp_path}/t"), {"x": F.col("kind") == 1}, F.col("id") > 5, [F.asc("id")], size=10)
    plans = [plan for at, plan in _executions(spark) if at not in before]
    scans = [plan for plan in plans if "struct<id:bigint,kind:bigint>" in plan]
    assert len(scans) == 1 and "TakeOrderedAndProject" in scans[0] and "CollectMetrics" in scans[0]


def _executions(spark):
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [(store.apply(n).executionId(), store.apply(n).physicalPlanDescription()) for n in range(store.size())]


def test_a_killed_run_leaves_the_old_snapshot(spark, tmp_path):
    root, rows = str(tmp_path), spark.range(5)
    first = snapshots.publish(rows, root, {"total": F.sum("id")}, scope="nine", parserVersion=1)
    assert first["rows"] == 5 and first["stats"] == {"total": 10} and snapshots.manifest(spark, root)["scope"] == "nine"
    broken = spark.range(9).withColumn("id", F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("long")))
    with pytest.raises(Exception, match="killed"):
        snapshots.publish(broken, root)
    assert snapshots.latest(spark, root).count() == 5 and snapshots.manifest(spark, root) == json.loads(json.dumps(first))
    spark.range(3).write.parquet(f"{root}/half/data")  # data without a pointer, as a run killed later leaves them
    assert snapshots.latest(spark, root).count() == 5
    second = snapshots.publish(spark.range(4, -1, -1).repartition(3), root)
    assert second["contentHash"] == first["contentHash"] == snapshots.content_hash(rows) and second["snapshot"] != first["snapshot"]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("latest")] == ["latest.json"]
    with pytest.raises(FileNotFoundError):
        snapshots.latest(spark, f"{root}/none")


def test_content_hashes_tell_changes(spark):
    make = lambda rows: snapshots.content_hash(spark.createDataFrame(rows, "a int, b string, c array<int>, m map<string,int>"))
    base = [(1, "x", [1], {"k": 1}), (2, None, None, None)]
    assert make(base) == make(base[::-1])
    assert len({make(r) for r in (base, base[:1], base + base[:1], base + base[:1] * 2, [(1, "x", [1], {"k": 2}), base[1]], [(1, "x", [], {"k": 1}), base[1]], [(2, "x", [1], {"k": 1}), (1, None, None, None)], [])}) == 8


def test_apply_then_undo_restores(spark):
    rnd = random.Random(4)
    for _ in range(4):
        made = [[(rnd.randrange(8), rnd.choice(["x", None, "y"])) for _ in range(rnd.randrange(30))] for _ in range(2)]
        before, after = (spark.createDataFrame(rows, "k int, v string") for rows in made)
        log = changes.difference(before, after.select("v", "k"))
        assert Counter(map(tuple, changes.applied(before, log).collect())) == Counter(made[1])
        assert Counter(map(tuple, changes.applied(after, log, undo=True).collect())) == Counter(made[0])
    log = changes.difference(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "b"), (1, "a"), (3, "c")], "k int, v string"))
    assert {(r.k, r.op, r.came, r.went) for r in changes.operations(log, ["k"]).collect()} == {(1, "update", 1, 1), (2, "delete", 0, 1), (3, "insert", 1, 0)}
    with pytest.raises(Exception, match="does not have"):
        changes.applied(spark.createDataFrame([(9, "z")], "k int, v string"), log).collect()
    report, again = changes.dry_run(spark.range(3), spark.range(1, 4), ["id"])
    assert {tuple(r) for r in report.collect()} == {("delete", 1), ("insert", 1)} and again.count() == 2


def test_each_row_is_decided_once(spark):
    seen = []

    def step(keys, target):
        def take(rest):
            seen.append(sorted((r.k for r in rest.collect()), key=str))
            return rest.filter(F.col("k").isin(*keys)).select("k", F.explode(F.array(F.lit(target), F.lit(target + 1))).alias("target"))

        return take

    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "k int")
    got = {r.k: (r.reason, r.target) for r in ladder.decided(df.filter("k is not null"), "k", [("one", step([1, 2], 10)), ("two", step([2, 3], 20)), ("three", step([9], 30))], "none").collect()}
    assert got == {1: ("one", 10), 2: ("one", 10), 3: ("two", 20), 4: ("none", None)} and seen == [[1, 2, 3, 4], [3, 4], [4]]
    assert {(r.k, r.reason) for r in ladder.decided(df, "k", [("one", step([1], 10))], "none").collect()} >= {(None, "none")}


def test_mappings_are_exhaustive(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    full = {"a": "A", "b": None, None: "?"}
    assert [r[0] for r in df.select(ladder.mapped(F.col("s"), full, "kind")).collect()] == ["A", None, "?"] and ladder.unmapped(df, "s", full).count() == 0
    for short, value in (({"a": "A", None: "?"}, "b"), ({"a": "A", "b": "B"}, "null")):
        assert [tuple(r) for r in ladder.unmapped(df, "s", short).collect()] == [(None if value == "null" else value, 1)]
        with pytest.raises(Exception, match=f"kind is not mapped: {value}"):
            df.select(ladder.mapped(F.col("s"), short, "kind")).collect()
    rows = spark.createDataFrame([("x", None), (" ", None), ("y", 2)], "a string, b int")
    assert [r[0] for r in rows.select(ladder.note(("a", F.col("a")), ("b", F.col("b")))).collect()] == ["a: x", None, "a: y; b: 2"]


def test_footers_answer_without_reading_pages(spark, sf, tmp_path):
    spark.createDataFrame([(1, None, [1]), (2, "x", None), (3, None, [])], "a int, b string, c array<int>").repartition(2).write.parquet(f"{tmp_path}/t")
    found = footers.column_statistics(spark, f"{tmp_path}/t")
    assert sorted(map(tuple, found.collect())) == [("a", 3, 0), ("b", 3, 2)]
    assert "PushedAggregation: [COUNT(*), COUNT(a), COUNT(b)]" in found._jdf.queryExecution().executedPlan().toString()
    assert footers.files_of(spark, f"{tmp_path}/t").first()["n_files"] >= 1
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_visible_links_are_cut_by_a_runtime_filter(spark, tmp_path):
    other = spark.newSession()
    for key, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100MB"}.items():
        other.conf.set(key, value)
    other.range(100_000).selectExpr("id % 1000 as k", "id").write.parquet(f"{tmp_path}/links")
    other.range(1000).selectExpr("id as k", "id % 50 as kind").write.parquet(f"{tmp_path}/entities")
    shown = ladder.visible(other.read.parquet(f"{tmp_path}/links"), other.read.parquet(f"{tmp_path}/entities").filter("kind = 7"), "k", "k")
    assert "might_contain" in shown._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count() == 2000



def test_cells_join_inline_tags_and_part_blocks(spark):
    page = "<table><tr><td><span>学校</span>名称</td><td>a<br>b</td><td><p>c</p><p>d</p></td></tr></table>"
    assert spark.createDataFrame([(page,)], "p string").select(text.table_grid("p").alias("g")).first()["g"] == [["学校名称", "a b", "c d"]]


def test_payloads_are_taken_whole_or_not_at_all(spark):
    from lodestrata.operators import ingest

    one = {"recordType": "t", "sourceKey": "k", "schoolId": 1, "communityId": "2"}
    body = lambda records=(one,), **other: json.dumps({"sourceKey": "a.b", "sourceName": "n", "records": list(records)} | other)
    said = {
        "x": "body must be a JSON object", "[]": "body must be a JSON object", None: "body must be a JSON object", body(sourceKey="A"): "sourceKey must match ^[a-z0-9._-]{1,64}$", body(sourceKey=5): "sourceKey must match ^[a-z0-9._-]{1,64}$",
        body(sourceName=""): "sourceName is required", body(()): "records must be a non-empty array", body(records={}): "records must be a non-empty array", body([one] * 2001): "records exceeds 2000 per request", body([one, 5]): "records[1] must be an object",
        body([one | {"recordType": None}]): "records[0].recordType is required", body([one, one | {"sourceKey": 3}]): "records[1].sourceKey is required", body([one | {"schoolId": 1.5}]): "records[0].schoolId must be a positive integer",
        body([one | {"communityId": True}]): "records[0].communityId must be a positive integer", body([one | {"communityId": 10**25}]): "records[0].communityId must be a positive integer",
    }
    good = [body([one] * 2000), body([one | {"year": 1999, "raw": {"a": [1]}}, one | {"year": "2020", "sourceQuote": "q", "schoolId": 3.0, "extra": 1}])]
    df = spark.createDataFrame(list(enumerate([*said, *good])), "id int, b string")
    records, errors = ingest.payloads(df, "id", "b")
    assert dict(map(tuple, errors.collect())) == dict(enumerate(said.values()))
    rows = [r for r in records.collect() if r.key == len(said) + 1]
    assert [(r.ordinal, r.school_id, r.community_id, r.year >= 2024, r.quote) for r in rows] == [(0, 1, 2, True, '{"a":[1]}'), (1, 3, 2, False, "q")] and rows[1].year == 2020
    assert records.filter(F.col("key") == len(said)).count() == 2000


def test_percentiles_over_ranges_equal_counting_off(spark):
    from lodestrata.operators import quality

    rnd = random.Random(8)
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    for n in (1, 2, 20, 3000):
        values = [rnd.choice([rnd.random(), 0.25, None]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(1.0,)], "x double").withColumn("g", F.lit(1))
        assert tuple(quality.spread_percentiles(df, "x", shares).first()) == tuple(quality.index_percentiles(df, "g", "x", shares).first())[1:]
    assert tuple(quality.spread_percentiles(df.limit(0), "x", {"a": 0.5}).first()) == (None,)


def test_document_statistics_count_what_is_there(spark):
    from lodestrata.operators import product
    from lodestrata.sources import files

    schools = [{"名称": "甲", "街道": "一街", "对口居委": ["a", "b"], "lng": 1.0, "lat": 2.0, "标签": ["x"]}, {"名称": "乙", "街道": "", "对口居委": "c"}]
    page = "<script>var ALL_DATA = " + json.dumps({"静安区": {"区": "静安区", "街道": ["一街"], "小学": schools, "初中": [{"名称": "丙"}]}}, ensure_ascii=False) + ";\nvar TLB=1</script>"
    found = files.document_schools(spark.createDataFrame([(page,)], "html string"))
    assert product.document_statistics(found).first().asDict() == {"districts": 1, "streets": 1, "primary": 2, "middle": 1, "committees": 3, "coordinates": 1, "tags": 1}


def test_sizes_and_cells_as_shown(spark):
    sizes = [None, 0, 1023, 1024, 10_239, 10_240, 1_048_576, 5 * 1024**4, 2000 * 1024**4]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(text.bytes_text(F.col("s"))).collect()]
    assert got == ["—", "0 B", "1023 B", "1.0 KB", "10.0 KB", "10 KB", "1.0 MB", "5.0 TB", "2000 TB"]
    row = spark.createDataFrame([("x" * 61, None, "7", "名")], "a string, n string, k string, l string").select(text.cell_text(F.col("a")), text.cell_text(F.col("n")), text.cell_text(F.col("k"), F.col("l")), text.cell_text(F.col("k"), F.col("n"))).first()
    assert tuple(row) == ("x" * 60 + "…", "—", "7（名）", "7")
