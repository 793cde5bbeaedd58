"""Operators on the small domain fixture: hand-made results, idempotence, guards."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

from lodestrata import registry
from lodestrata.functions.text import percent
from lodestrata.operators import browse, coverage, dedupe, ingest, match, steps
from lodestrata.plans import gateway
from lodestrata.sources import files
from lodestrata.streaming.ingest import file_stream, ingest_stream

DISTRICTS = ("黄浦", "静安", "长宁", "虹口", "杨浦", "徐汇", "闵行", "浦东", "普陀")


@pytest.fixture(scope="module")
def schools(spark):
    rows = [(n * 2 + k + 1, f"{d}{kind}", d, kind_id, []) for n, d in enumerate(DISTRICTS) for k, (kind, kind_id) in enumerate((("小学", "primary"), ("中学", "middle")))]
    return spark.createDataFrame(rows, "id int, name string, district string, type string, aliases array<string>")


def test_golden_set(spark, schools):
    links = spark.createDataFrame([(1, 1, 2026), (3, 2, 2026)], "school_id int, community_id int, year int")
    pathways = schools.alias("p").join(schools.alias("m"), F.expr("p.district = m.district and p.type = 'primary' and m.type = 'middle'"))
    assert schools.count() == 18 and pathways.count() == 9
    linked = links.filter("year = 2026").select("school_id").distinct().count()
    assert spark.range(1).select(percent(F.lit(linked), F.lit(18))).first()[0] == 11.1


def test_unique_name_match(spark):
    known = spark.createDataFrame(
        [(1, "园西小学南桥校区", "primary", None), (2, "园西小学北校区", "primary", None), (3, "观澜小学新川校区", "primary", None), (4, "观澜小学新溪校区", "primary", None), (5, "明珠学校", "nine_year", ["明珠中学"])],
        "id int, name string, type string, aliases array<string>",
    )
    asked = spark.createDataFrame(
        [(1, "上海市园西小学（南桥校区）", "primary"), (2, "上海市观澜小学", "primary"), (3, "统筹安排", "unknown"), (4, "明珠中学", "middle"), (5, None, "primary"), (6, "", "primary")],
        "candidate_id int, name string, stage string",
    )
    assert {tuple(r) for r in match.match_schools(asked, known).collect()} == {(1, 1, "exact"), (4, 5, "alias")}


def test_feeder_edges(spark, schools):
    feeders = spark.createDataFrame([(1, "黄浦(派位)"), (3, "静安中学/没有")], "id int, feeder string")
    got = {tuple(r) for r in match.pathway_edges(feeders, schools).collect()}
    assert got == {(1, 2, "placement", "黄浦(派位)"), (3, 4, "unknown", "静安中学/没有"), (3, None, "unknown", "没有")}


def test_priority_dedupe_prefers_sources_then_years(spark):
    rows = spark.createDataFrame([(1, 1, "map", 2026, 1), (1, 1, "official_x", 2025, 2), (1, 2, "map", None, 3), (1, 2, "map", 2024, 4), (1, 2, None, 2024, 5)], "s int, c int, source string, year int, id int")
    once = dedupe.by_source_priority(rows, ["s", "c"], "source", "year", "id")
    assert sorted(r["id"] for r in once.collect()) == [2, 4]
    assert once.count() == dedupe.by_source_priority(once, ["s", "c"], "source", "year", "id").count()


def test_merge_conserves_pairs(spark):
    links = spark.createDataFrame([(1, 10, 100), (2, 10, 200), (3, 11, 100), (4, 12, 300)], "id int, owner int, target int")
    merge = spark.createDataFrame([(100, 200)], "pseudo int, real int")
    got = {tuple(r) for r in dedupe.merge_duplicates(links, merge, "owner", "target").collect()}
    assert got == {(2, 10, 200), (3, 11, 200), (4, 12, 300)}


def test_ingest_is_idempotent(spark):
    received = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 3)], "a int, b int, n int")
    there = spark.createDataFrame([(3, 1, 0)], "a int, b int, n int")
    fresh, counters = ingest.insert_or_ignore(received, there, ["a", "b"], "n")
    assert tuple(counters.first()) == (4, 2, 1, 1)
    again, counters = ingest.insert_or_ignore(received, there.unionByName(fresh), ["a", "b"], "n")
    assert again.count() == 0 and tuple(counters.first()) == (4, 0, 3, 1)


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k int, at int, v string")
    assert {(r.k, r.v) for r in ingest.upsert(old, new, ["k"], F.col("at").desc()).collect()} == {(1, "c"), (2, "b"), (3, "e")}
    assert sorted(r.v for r in ingest.replace_source(old, new.filter("k = 3"), "v", "a").collect()) == ["b", "e"]


def test_row_edits_are_guarded(spark):
    customers = spark.createDataFrame([(1, "x", 1, 0.0, None), (2, "y", 1, 1.0, None)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    orders = spark.createDataFrame([(1, 2)], "o_orderkey long, o_custkey long")
    more = ingest.insert_row(customers, "customer", {"c_name": "z", "c_acctbal": "2.5", "unknown": 1})
    assert more.filter("c_custkey = 3 and c_acctbal = 2.5 and c_name = 'z'").count() == 1
    changed = ingest.update_row(customers, "customer", {"c_custkey": 1}, {"c_name": "w", "c_custkey": 9})
    assert {(r.c_custkey, r.c_name) for r in changed.collect()} == {(1, "w"), (2, "y")}
    assert ingest.delete_row(customers, "customer", {"c_custkey": 1}, {"orders": orders}).count() == 1
    with pytest.raises(PermissionError, match="orders"):
        ingest.delete_row(customers, "customer", {"c_custkey": 2}, {"orders": orders})
    with pytest.raises(LookupError):
        ingest.update_row(customers, "customer", {"c_custkey": 7}, {"c_name": "w"})
    with pytest.raises(LookupError):
        ingest.delete_rows(customers, "customer", [{"c_custkey": 1}, {"c_custkey": 7}])
    assert ingest.delete_rows(customers, "customer", [{"c_custkey": 1}, {"c_custkey": 2}]).count() == 0
    with pytest.raises(ValueError, match="read-only"):
        ingest.delete_row(customers, "nation", {"n_nationkey": 1})


def test_versions_are_kept(spark, tmp_path):
    df = spark.range(2)
    paths = [ingest.save_version(df, spark, str(tmp_path), "t") for _ in range(2)]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["v000001", "v000002"] and spark.read.parquet(paths[0]).count() == 2


def test_pages_together_are_the_whole_sort(spark, schools):
    pages = [[r["id"] for r in browse.page(schools, n, 7, "type", key=("id",)).collect()] for n in (1, 2, 3, 4)]
    whole = [r["id"] for r in schools.orderBy(F.desc("type"), F.desc("id")).collect()]
    assert sum(pages, []) == whole and pages[3] == []
    assert tuple(browse.page_totals(schools, 7).first()) == (18, 3) and tuple(browse.page_totals(schools.limit(0), 7).first()) == (0, 0)
    with pytest.raises(ValueError, match="unknown column"):
        browse.page(schools, 1, 7, "nothing")


def test_search_and_filters(spark, schools):
    assert schools.filter(browse.any_column_contains(schools, "静安")).count() == 2
    assert schools.filter(browse.each_column_contains(schools, {"name": "小学", "id": "1", "none": "x"})).count() == 5  # 1, 11, 13, 15, 17
    assert schools.filter(browse.among(F.col("district"), [])).count() == 0 and schools.filter(browse.among(F.col("district"), None)).count() == 18
    assert [browse.clamp(v, 500, 2500) for v in ("x", "0", "9999", 7)] == [500, 1, 2500, 7]


def test_city_wide_sources_fan_out_once(spark):
    part = spark.createDataFrame([(1, 2025, "全市", "t", None, "primary-scope"), (2, 2025, "全市", "t", "", "primary-scope")], "ordinal int, year int, grp string, title string, url string, category string")
    rows = coverage.merge_sources([part, part], "全市", ["a", "b"]).collect()
    assert sorted(r["grp"] for r in rows) == ["a", "b"] and all(r["has_scope"] for r in rows)


def test_checks_find_what_is_wrong(spark):
    links = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, None, 9)], "id int, school_id int, community_id int")
    found = dict(tuple(r) for r in registry.violations("school_communities", links, {"communities": spark.createDataFrame([(1,)], "id int")}).collect())
    assert found == {"key(id)": 1, "unique(school_id,community_id)": 1, "ref(community_id)": 1}


def test_steps_stop_at_a_broken_precondition(spark):
    plan = [steps.Step("a", lambda t: {"x": t["x"].filter("id > 0")}, {"x": 3}), steps.Step("b", lambda t: {"x": t["x"].limit(0)}, {"x": 3})]
    tables, done = steps.run(plan, {"x": spark.range(3)}, last="a")
    assert done == ["a"] and tables["x"].count() == 2
    with pytest.raises(AssertionError, match="b: x has 2 rows"):
        steps.run(plan, {"x": spark.range(3)})


@pytest.mark.parametrize("sql", ["SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "VALUES (1)", "EXPLAIN SELECT 1", "SHOW TABLES", "SELECT 1;", "SELECT updated_at FROM VALUES (1) t(updated_at)", "SELECT * FROM known WHERE id IN (SELECT id FROM known) AND EXISTS (SELECT 1 FROM range(2))", "TABLE known", "EXPLAIN FORMATTED SELECT * FROM known", "SELECT (SELECT max(id) FROM known) AS m, posexplode(array(1))", "SHOW COLUMNS IN known", "SELECT k, count(*) FROM (SELECT id % 2 AS k FROM known) GROUP BY k HAVING count(*) > (SELECT 0)",
    "SELECT a.id, count(*) OVER (PARTITION BY a.id ORDER BY b.id) FROM known a JOIN known b ON a.id = b.id LEFT JOIN LATERAL (SELECT a.id + 1 AS x) z ON true ORDER BY 1 LIMIT 2 OFFSET 1", "SELECT id FROM known UNION SELECT 1 INTERSECT SELECT 2 EXCEPT SELECT 3",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT * FROM r", "SELECT * FROM known PIVOT (count(*) FOR id IN (1, 2))", "SELECT v FROM known UNPIVOT (v FOR n IN (id))", "FROM known |> WHERE id > 1".replace("FROM", "TABLE", 1),
    "SELECT transform(array(1), x -> x + 1)[0], named_struct('x', 1).x, CASE WHEN id = 1 THEN 2 END, CAST(id AS STRING), id IS NULL, try_cast('x' AS INT), interval 1 day, current_date FROM known LATERAL VIEW explode(array(1)) e AS q",
    "SELECT * EXCEPT (id) FROM (SELECT id, 1 AS b FROM known)", "SELECT id, grouping(id) FROM known GROUP BY CUBE (id)", "SELECT * FROM known TABLESAMPLE (2 ROWS)", "SELECT sum(id) OVER w FROM known WINDOW w AS (ORDER BY id)", "SELECT * FROM kept_table", "SELECT * FROM file_view"])
def test_gateway_accepts(spark, sql, tmp_path):
    spark.range(3).createOrReplaceTempView("known")
    spark.range(3).write.parquet(f"{tmp_path}/v")
    spark.read.parquet(f"{tmp_path}/v").createOrReplaceTempView("file_view")
    spark.sql("CREATE TABLE IF NOT EXISTS kept_table (id INT) USING parquet")
    gateway.execute(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT 1; SELECT 2", "/* x */ DELETE FROM t", "WITH d AS (DELETE FROM t RETURNING *) SELECT * FROM d", "SELECT 'update'", "SELECT ';'", "", "-- only", "SET x = 1",
    "select reflect('java.lang.System', 'getProperty', 'user.home')", "select java_method('java.lang.System', 'exit', 1)", "select `try_reflect`('java.lang.System', 'getProperty', 'user.home')", "explain select reflect('a', 'b')",
    "select * from text.`/etc/hostname`", "select * from parquet.`/root`", "with a as (select * from csv.`/etc/passwd`) select * from a", "select (select max(value) from text.`/etc/hostname`)", "select 1 where exists (select * from text.`/etc/hostname`)",
    "select 1 where 'a' in (select value from text.`/etc/hostname`)", "select * from unknown_table", "table text.`/etc/hostname`", "explain select * from text.`/etc/hostname`", "show columns in text.`/etc/hostname`", "show create table x", "select * from (select * from (select * from json.`/x`))",
    "select count(*) from range(3) having count(*) > (select count(*) from text.`/etc/hostname`)", "select case when (select count(*) from text.`/etc/hostname`) > 0 then 1 end", "select * from range(1) order by (select max(value) from text.`/etc/hostname`)", "select * from range(2) a join text.`/etc/hostname` b on true", "selec",
    "select * from identifier('text.`/etc/hostname`')", "select identifier('refl' || 'ect')('java.lang.System','getProperty','user.home')", "select identifier('id') from range(3)", "table identifier('text.`/etc/hostname`')", "select * from range(2) where id in (select value from identifier('te' || 'xt.`/etc/hostname`'))",
    "with a as (select * from identifier('text.`/etc/hostname`')) select * from a", "select :x", "select system.builtin.`reflect`('java.lang.System','getProperty','user.home')", "explain select * from identifier('text.`/etc/hostname`')", "select * from read_files('/etc/hostname')", "show columns in identifier('text.`/etc/hostname`')"])
def test_gateway_rejects(spark, sql):
    with pytest.raises(gateway.Rejected):
        gateway.execute(spark, sql)


def test_gateway_says_when_it_cut(spark):
    answer = gateway.execute(spark, "SELECT id FROM range(10)", 4)
    assert answer.row_count == 4 and answer.truncated and answer.columns == ["id"]
    assert not gateway.execute(spark, "SELECT id FROM range(4)", 4).truncated


def test_stream_ingest_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 2)], "k int, n int")
    rows.write.parquet(f"{tmp_path}/in")
    for state in ("s1", "s2"):
        ingest_stream(file_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out-{state}", f"{tmp_path}/{state}", ["k"], "n").awaitTermination()
        ingest_stream(file_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out-{state}", f"{tmp_path}/{state}", ["k"], "n").awaitTermination()
        assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out-{state}").collect()) == [1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\n a \nb\n")
    assert [r["query"] for r in files.query_list(spark, str(tmp_path / "q.txt")).collect()] == ["a", "b"]
    (tmp_path / "r.json").write_text('{"query": "a", "rank": 1}\nbroken\n{"query": "b", "error": "e"}\n')
    done = files.json_lines(spark, str(tmp_path / "r.json"), files.RESULT_SCHEMA).filter("query is not null")
    assert [r["query"] for r in files.still_to_do(files.query_list(spark, str(tmp_path / "q.txt")), done, "query").collect()] == ["b"]
    files.write_csv(spark.createDataFrame([(1, 'a"b', None, [1])], "i int, s string, n string, l array<int>").coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert part.read_text() == 'i,s,n,l\n1,"a""b",,[1]\n'


def test_entry_module_and_guard(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_training_data_package():
    """The other queries import when the package for training data and the pipeline are gone."""
    import shutil
    import subprocess
    import tempfile

    here, there = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tempfile.mkdtemp(prefix="lodestrata-guard-")
    shutil.copytree(f"{here}/lodestrata", f"{there}/lodestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", there)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_overview' in q and not [k for k in q if k[:2] == 'op' or k == 'pipeline']; assert set(q) == set(e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=there, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_passages_of_any_length_are_found(spark):
    texts = [(1, "say hello world now"), (2, "hello  world"), (3, "xhello worldx yz"), (4, None), (5, "a quite long passage stands here whole"), (6, "")]
    passages = [(1, "hello world"), (2, "quite long passage stands"), (3, "lo"), (4, ""), (5, "z"), (6, None), (7, "now"), (8, "here  whole")]
    got = match.quoted_passages(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(passages, "passage_id int, text string"))
    want = {(i, k) for i, t in texts for k, p in passages if t is not None and p is not None and p in t}
    assert sorted((r["text_id"], r["passage_id"]) for r in got.collect()) == sorted(want)


def test_similar_names_equal_all_pairs(spark):
    import random

    from lodestrata.operators import match

    rng = random.Random(5)
    made = lambda: "".join(rng.choice("aaabcdefghij学校") for _ in range(rng.randrange(0, 9)))
    left = [(i, rng.randrange(3), made()) for i in range(120)] + [(200, 0, None), (201, None, "abc"), (202, 1, "aaaa"), (203, 1, "a"), (204, 1, "xyzw"), (204, 1, "xyzw")]
    right = [(i, rng.randrange(3), made()) for i in range(120)] + [(200, 0, None), (201, None, "abc"), (202, 1, "aaaabcdefg"), (203, 1, "ab"), (204, 1, "xyzw")]

    def score(a, b):
        if a == b:
            return 1.0
        if a in b or b in a:
            return min(len(a), len(b)) / max(len(a), len(b))
        return len(set(a) & set(b)) / max(len(set(a)), len(set(b)))

    want = sorted((i, j, round(score(a, b), 6)) for i, x, a in left for j, y, b in right if x is not None and x == y and a and b and score(a, b) >= 0.35)
    frames = [spark.createDataFrame(rows, "id long, block long, name string") for rows in (left, right)]
    got = sorted((r["left_id"], r["right_id"], round(r["score"], 6)) for r in match.similar_names(*frames, 0.35).collect())
    assert got == want
    assert match.similar_names(frames[0].limit(0), frames[1], 0.35).count() == 0


def test_rows_of_two_names_are_dealt_out(spark):
    left = spark.range(3000).selectExpr("id", "1 as block", "'abc' as name")
    right = spark.range(1500).selectExpr("id", "1 as block", "if(id < 1490, 'abcd', 'xyz') as name")
    found = match.similar_names(left, right, 0.35)
    tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 3000 * 1490 and max(r["n"] for r in tasks) < 3_000_000
    got = found.agg(F.count_distinct(F.struct("left_id", "right_id")).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.max("right_id").alias("last")).first()
    assert tuple(got) == (3000 * 1490, 0.75, 0.75, 1489)


def test_similar_names_shuffle_no_pairs(spark):
    def written(rows):
        left = spark.range(rows).selectExpr("id", "1L as block", "concat('name ', id) as name")
        right = spark.range(rows).selectExpr("id", "1 as block", "concat('name', id % 4) as name")
        bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
        bus.waitUntilEmpty()
        before = store.executorList(False).apply(0).totalShuffleWrite()
        assert match.similar_names(left, right, 0.35).agg(F.count_distinct("left_id").alias("l"), F.count("*").alias("n")).first()["l"] == rows
        bus.waitUntilEmpty()
        return store.executorList(False).apply(0).totalShuffleWrite() - before

    small, large = written(500), written(4000)  # 64 times as many pairs
    assert large < 16 * small


@pytest.mark.parametrize("least", [0.35, 0.8])
def test_similar_names_of_many_characters(spark, least, monkeypatch):
    import random

    rng = random.Random(7)
    letters = [chr(0x4E00 + k) for k in range(300)] + ["😀", "😁", "é", "<", ">", "="]
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    names += [x[:-1] or x for x in names[:40]] + [x + y for x, y in zip(names[:30], names[5:])] + [x + x for x in names[:20]] + ["😀<", "<😀=", "aaaa", "aaaab"]
    sides = [[(i, i % 2, x) for i, x in enumerate(rng.sample(names, 200) + names[-4:])] for _ in range(2)]

    def score(a, b):
        if a in b or b in a:
            return min(len(a), len(b)) / max(len(a), len(b))
        return len(set(a) & set(b)) / max(len(set(a)), len(set(b)))

    want = sorted((i, j, round(score(a, b), 6)) for i, x, a in sides[0] for j, y, b in sides[1] if x == y and score(a, b) >= least)
    keyed, on_characters = [], match._on_characters
    monkeypatch.setattr(match, "_on_characters", lambda df, *rest: keyed.append(df.columns) or on_characters(df, *rest))
    for at_once in (match.PAIRS_AT_ONCE, 256):  # one cell a key, and many
        monkeypatch.setattr(match, "PAIRS_AT_ONCE", at_once)
        found = match.similar_names(*[spark.createDataFrame(x, "id long, block int, name string") for x in sides], least)
        assert sorted((r["left_id"], r["right_id"], round(r["score"], 6)) for r in found.collect()) == want
    assert want and sum("ids" in x for x in keyed) == 4  # names met on their characters


def test_similar_names_keep_rows_without_ids(spark):
    left = spark.createDataFrame([(None, 1, "abc"), (None, 1, "abc"), (7, 1, "abc")], "id long, block int, name string")
    found = match.similar_names(left, left.filter("id is null or name is null").limit(1), 0.35).collect()
    assert sorted((tuple(r) for r in found), key=repr) == [(7, None, 1.0), (None, None, 1.0), (None, None, 1.0)]


def test_suffix_lookup_forms_no_pairs_of_equal_names(spark):
    candidates = spark.range(3000).select(F.col("id").alias("candidate_id"), F.lit("red").alias("name"))
    targets = spark.range(3000).select((F.col("id") + 7).alias("target_id"), F.when(F.col("id") % 2 == 0, "red b").otherwise("red a").alias("name"))
    found = match.suffix_lookup(candidates, targets, (" none", " a", " b"))
    assert [tuple(r) for r in found.select("target_id").distinct().collect()] == [(8,)] and found.count() == 3000
    left, right = (spark.createDataFrame(rows, f"{c}_id long, name string") for c, rows in (("candidate", [(1, "x"), (1, "y"), (2, "x"), (3, None), (4, "z")]), ("target", [(5, "x2"), (6, "y1"), (4, "x2"), (9, None)])))
    assert sorted(map(tuple, match.suffix_lookup(left, right, ("1", "2")).collect())) == [(1, 6), (2, 4)]
    assert most_rows(found) <= 3000


def most_rows(df):
    """The most rows that any operator of the executed plan puts out."""
    def nodes(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return nodes(plan.executedPlan())
        if hasattr(plan, "plan") and plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return nodes(plan.plan())
        children = plan.children()
        return [plan] + [n for i in range(children.size()) for n in nodes(children.apply(i))]

    df.collect()
    counts = [n.metrics().get("numOutputRows") for n in nodes(df._jdf.queryExecution().executedPlan())]
    return max(c.get().value() for c in counts if c.isDefined())
