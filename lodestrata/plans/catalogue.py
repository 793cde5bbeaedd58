"""The query catalogue on the star schema: every operator of the engine applied to whole tables.

Roles: customers are the entities (segment as type, nation as district), orders their yearly links,
lineitem the many-to-many links to parts, events the price log, documents and labels the sources.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import registry
from lodestrata.functions import classify, geo, text
from lodestrata.operators import browse, coverage, dedupe, ingest, match, quality, steps
from lodestrata.plans import gateway, product, records, rules
from lodestrata.sources import files

YEARS = (1996, 1997, 1998, 1999)
SCOPE = 9  # nations 0 to 8 are in scope


def _t(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [registry.read(spark, sf, n) for n in names]


def q01_overview(spark, sf):
    customer, orders, part, labels = _t(spark, sf, "customer", "orders", "part", "labels")
    scoped = customer.filter(F.col("c_nationkey") < SCOPE)
    counts = [
        scoped.agg(F.count("*").alias("entities")), part.agg(F.count("*").alias("communities")),
        orders.join(scoped, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("links")),
        labels.agg(F.count_if(F.col("quality") == 1).alias("policies")),
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.crossJoin(one)
    return out


def q02_entity_list(spark, sf):
    customer, orders, nation = _t(spark, sf, "customer", "orders", "nation")
    n_orders = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))
    rows = customer.filter(F.col("c_nationkey") < SCOPE).join(n_orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    tier = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 2500).cast("long") + 1)
    out = rows.select("c_custkey", "c_name", "c_mktsegment", "n_name", tier.alias("tier"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_final", F.lit(0)).alias("n_final"))
    return browse.top(out, browse.clamp("500", 500, 2500), F.col("c_mktsegment").asc(), F.col("tier").asc_nulls_last(), F.col("c_name").asc(), F.col("c_custkey").asc())


def q03_entity_search(spark, sf):
    (part,) = _t(spark, sf, "part")
    return part.filter(browse.any_column_contains(part, "RING")).select("p_partkey", "p_name", "p_brand", "p_type")


def q04_column_filters(spark, sf):
    (part,) = _t(spark, sf, "part")
    return part.filter(browse.each_column_contains(part, {"p_brand": "#1", "p_size": "2", "nothing": "x"})).select("p_partkey", "p_brand", "p_size")


def q05_fk_page(spark, sf):
    orders, customer, nation = _t(spark, sf, "orders", "customer", "nation")
    page = browse.page(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), 2, 30, key=("o_orderkey",))
    named = browse.with_labels(page, registry.spec("orders"), {"customer": customer})
    keyed = named.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return browse.with_labels(keyed, registry.spec("customer"), {"nation": nation}).select("o_orderkey", "o_custkey", "o_orderstatus", F.col("__fk_o_custkey").alias("customer_label"), F.col("__fk_c_nationkey").alias("nation_label"))


def q06_district_summary(spark, sf):
    customer, orders, nation = _t(spark, sf, "customer", "orders", "nation")
    per = customer.groupBy("c_nationkey").agg(
        F.count("*").alias("n_entities"), F.count_if(F.col("c_acctbal") > 0).alias("n_positive"),
        F.min_by(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("first_segment"),
    )
    links = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_orders"))
    rows = per.join(links, F.col("c_nationkey") == F.col("k"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("n_name", "n_entities", "n_positive", "first_segment", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


def q07_role_join(spark, sf):
    lineitem, orders, customer, supplier, nation = _t(spark, sf, "lineitem", "orders", "customer", "supplier", "nation")
    from_n, to_n = nation.select(F.col("n_nationkey").alias("fk"), F.col("n_name").alias("from_name")), nation.select(F.col("n_nationkey").alias("tk"), F.col("n_name").alias("to_name"))
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    counted = rows.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    return counted.join(from_n, F.col("c_nationkey") == F.col("fk")).join(to_n, F.col("s_nationkey") == F.col("tk"), "left").select("from_name", "to_name", "n")


def q08_bidirectional(spark, sf):
    (lineitem,) = _t(spark, sf, "lineitem")
    edges = lineitem.filter((F.col("l_suppkey") == 1) | (F.col("l_partkey") == 1))
    return edges.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.when(F.col("l_suppkey") == 1, "out").otherwise("in").alias("direction"))


def q09_policy_list(spark, sf):
    documents, labels = _t(spark, sf, "documents", "labels")
    names = F.create_map(*map(F.lit, ("en", "English", "fr", "French", "de", "German")))
    rows = documents.select("doc_id", "lang", "source").join(labels, "doc_id", "left").filter(F.coalesce("quality", F.lit(1)) == 1)
    kind = F.when(F.col("quality").isNull(), "unrated").when(F.col("toxic") == 1, "flagged").otherwise("rated")
    return rows.select("doc_id", F.coalesce(names[F.col("lang")], F.col("lang")).alias("lang_label"), kind.alias("kind"), "source")


def q10_latest_per_group(spark, sf):
    customer, events = _t(spark, sf, "customer", "events")
    last = dedupe.latest(events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], "ts", "event_id")
    return customer.join(last, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "event_id", "event_type", "value")


def q11_price_history(spark, sf):
    (events,) = _t(spark, sf, "events")
    return events.filter("user_id = 7").orderBy(F.col("ts").desc(), F.col("event_id").desc()).select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def q12_reverse_search(spark, sf):
    part, lineitem, supplier = _t(spark, sf, "part", "lineitem", "supplier")
    found = part.filter(F.col("p_name").like("%ring%")).orderBy("p_partkey").limit(50).select("p_partkey", "p_name")
    pairs = lineitem.select("l_partkey", "l_suppkey").distinct().join(found, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    children = pairs.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(F.count("*").alias("n_children"), F.concat_ws(",", F.array_sort(F.collect_list("s_name"))).alias("children"))
    return found.join(children, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("children", F.lit("")).alias("children"))


def q13_source_counts(spark, sf):
    (events,) = _t(spark, sf, "events")
    return browse.counter(browse.top(events, 300, F.col("ts").desc(), F.col("event_id").desc()), "event_type")


def _checks():
    return {
        "name": text.present(F.col("c_name")), "balance": F.col("c_acctbal") > 0, "large": F.col("c_acctbal") >= 5000,
        "scoped": F.col("c_nationkey") < SCOPE, "segment": text.meaningful(F.col("c_mktsegment")) & (F.col("c_mktsegment") != "FURNITURE"),
    }


def q14_completeness(spark, sf):
    return quality.completeness(_t(spark, sf, "customer")[0], "c_mktsegment", _checks())


def q15_completeness_total(spark, sf):
    out = quality.completeness(_t(spark, sf, "customer")[0], "c_mktsegment", _checks(), total=True)
    return out.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "total", "n_balance", "pct_balance", "pct_overall")


def q16_row_quality(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    pct, tags = quality.row_quality(customer, _checks())
    return customer.select("c_custkey", pct.alias("pct"), tags.alias("missing"))


def _coverage(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    entities = customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("grp"), (F.col("c_acctbal") > 5000).alias("boundary"))
    return coverage.grid(spark, entities, orders.select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("year")), YEARS)


def q17_coverage_grid(spark, sf):
    return _coverage(spark, sf)


def _sources(spark, sf):
    documents, events, orders = _t(spark, sf, "documents", "events", "orders")
    a = documents.select(F.concat(F.lit("doc:"), F.col("source")).alias("title"), F.col("lang").alias("grp")).distinct().withColumn("kind", F.lit("document"))
    b = events.select(F.concat(F.lit("event:"), F.col("event_type"), F.lit(" "), F.year("ts").cast("string")).alias("title"), F.lit("*").alias("grp")).distinct().withColumn("kind", F.lit("event"))
    c = orders.select(F.concat(F.lit("order:"), F.col("o_orderpriority"), F.lit(" "), F.year("o_orderdate").cast("string")).alias("title"), F.lit("en").alias("grp")).distinct().withColumn("kind", F.lit("order"))
    return a.unionByName(b).unionByName(c)


_RANKED = ((r"URGENT|HIGH", "primary-scope"), (r"purchase|signup", "middle-scope"), (r"doc:", "district-policy"))


def q18_source_union(spark, sf):
    rows = _sources(spark, sf)
    return rows.select("title", "grp", "kind", text.year_in(F.col("title"), F.lit(2025)).cast("long").alias("year"), classify.first_of(F.col("title"), _RANKED, "other").alias("category"))


def q19_source_rank(spark, sf):
    from pyspark.sql import Window

    rows = q18_source_union(spark, sf).withColumns({"url": F.lit(None).cast("string"), "ordinal": F.col("title")})
    spread = coverage.merge_sources([rows, rows], "*", ["en", "fr", "de", "es"])
    place = F.row_number().over(Window.partitionBy("year", "grp").orderBy(F.col("has_scope").desc(), F.col("title").asc(), F.col("kind").asc()))
    return spread.select("year", "grp", "title", "category", "has_scope", place.cast("long").alias("place"))


def q20_weighted_score(spark, sf):
    rows = quality.completeness(_t(spark, sf, "customer")[0], "c_mktsegment", _checks())
    shares = {n: F.col(f"pct_{n}") for n in _checks()}
    return rows.select("c_mktsegment", quality.weighted_score(shares, {"name": 10, "balance": 25, "large": 15, "scoped": 30, "segment": 20}).alias("score"))


def q21_gap_list(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("n_links"))
    rows = customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", "c_acctbal", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return quality.gaps(rows, F.col("c_acctbal") <= 0, F.col("c_mktsegment").asc(), F.col("c_custkey").asc())


def q22_priority_dedupe(spark, sf):
    lineitem, orders = _t(spark, sf, "lineitem", "orders")
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "l_partkey", F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return dedupe.by_source_priority(rows, ["l_suppkey", "l_partkey"], "o_orderpriority", "year", "row_id", ("1-", "2-"))


def _names(spark, sf):
    part, supplier = _t(spark, sf, "part", "supplier")
    left = supplier.select("s_suppkey", F.regexp_extract("s_name", r"#0*(\d+)$", 1).alias("key"))
    right = part.select("p_partkey", (F.col("p_size") * 7 + F.length("p_name")).cast("string").alias("key"))
    return dedupe.key_hits(left, right, "s_suppkey", "p_partkey")


def q23_unique_match(spark, sf):
    return _names(spark, sf).filter("n_hits = 1").select("s_suppkey", "p_partkey")


def q24_ambiguous(spark, sf):
    return _names(spark, sf).filter("n_hits > 1").select("s_suppkey", "n_hits")


def q25_anti_join(spark, sf):
    customer, orders = _t(spark, sf, "customer", "orders")
    return customer.join(orders.filter(F.year("o_orderdate") == 1998), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def q26_semi_join(spark, sf):
    part, lineitem = _t(spark, sf, "part", "lineitem")
    return part.join(lineitem.filter((F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R")), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


def q27_merge_repoint(spark, sf):
    part, lineitem = _t(spark, sf, "part", "lineitem")
    key = F.concat_ws("|", "p_name", "p_brand")
    pseudo, real = part.filter("p_partkey % 3 = 0"), part.filter("p_partkey % 3 <> 0")
    hits = dedupe.key_hits(pseudo.select(F.col("p_partkey").alias("pseudo"), key.alias("key")), real.select(F.col("p_partkey").alias("real"), key.alias("key")), "pseudo", "real")
    links = lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey", "l_partkey").distinct()
    return dedupe.merge_duplicates(links, hits.filter("n_hits = 1").select("pseudo", "real"), "l_suppkey", "l_partkey")


def _received(spark, sf):
    orders, lineitem = _t(spark, sf, "orders", "lineitem")
    existing = lineitem.filter("l_linenumber = 1").select("l_suppkey", "l_partkey").distinct()
    received = lineitem.filter("l_linenumber <= 2").select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("ordinal")).join(orders.filter("o_orderstatus = 'F'"), F.col("ordinal") == F.col("o_orderkey"), "left_semi")
    received = received.groupBy("l_suppkey", "l_partkey", "ordinal").agg(F.count("*").alias("n")).drop("n")
    return received, existing


def q28_ingest_new(spark, sf):
    return ingest.insert_or_ignore(*_received(spark, sf), ["l_suppkey", "l_partkey"], "ordinal")[1]


def q29_upsert_latest(spark, sf):
    (events,) = _t(spark, sf, "events")
    rows = events.select("user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_id")
    old, new = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")
    return ingest.upsert(old, new, ["user_id", "event_type"], F.col("at").desc(), F.col("event_id").desc()).select("user_id", "event_type", "value", "event_id")


def q30_replace_source(spark, sf):
    (events,) = _t(spark, sf, "events")
    rows = events.select("event_id", "event_type", "value")
    return ingest.replace_source(rows, rows.filter("event_type = 'error' and value > 10").withColumn("value", F.lit(0.0)), "event_type", "error")


def q31_feeder_split(spark, sf):
    (part,) = _t(spark, sf, "part")
    modes = F.element_at(F.array(*map(F.lit, ("直升", "派位", "部分对口", "对口", "无"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = part.select("p_partkey", F.concat(F.col("p_type"), F.lit("（"), modes, F.lit("）/ "), F.col("p_brand"), F.lit("、"), F.col("p_name"), F.lit("(x)")).alias("feeder"))
    found = match.feeder_candidates(rows, "p_partkey", "feeder")
    return found.select("p_partkey", "mode", F.col("step").cast("long").alias("step"), "candidate")


def q32_suffix_lookup(spark, sf):
    part, supplier = _t(spark, sf, "part", "supplier")
    asked = supplier.select(F.col("s_suppkey").alias("candidate_id"), F.element_at(F.array(*map(F.lit, ("red", "blue", "small", "green", "none"))), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("name"))
    return match.suffix_lookup(asked, part.select(F.col("p_partkey").alias("target_id"), F.col("p_name").alias("name")), (" nothing", " ring", " bolt", " widget"))


def q33_name_similarity(spark, sf):
    part, supplier = _t(spark, sf, "part", "supplier")
    left = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("block"), F.lower("s_name").alias("name"))
    right = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 25).alias("block"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name"))
    score = F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score")
    found = match.similar_names(left, right, 0.35).select(F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("p_partkey"), score)
    return found.filter("score > 350")


def q34_contains_unique(spark, sf):
    part, nation = _t(spark, sf, "part", "nation")
    known = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("id")).select("id", F.concat("p_brand", F.lit("-"), "p_type").alias("name"), F.lit("primary").alias("type"), F.array().cast("array<string>").alias("aliases"))
    kinds = F.element_at(F.array(*map(F.lit, ("ECONOMY", "SMALL", "MEDIUM"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    asked = nation.select(F.col("n_nationkey").alias("candidate_id"), F.concat(F.lit("#"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("-"), kinds)).otherwise("")).alias("name"), F.lit("primary").alias("stage"))
    return match.match_schools(asked, known)


def q35_classify_text(spark, sf):
    (documents,) = _t(spark, sf, "documents")
    kinds = ((r"(?i)license", "license"), (r"\|", "table"), (r"[!]{2}", "shouting"), (r"[*#$%]{3}", "noise"))
    return browse.counter(documents.withColumn("category", classify.first_of(F.col("text"), kinds, "prose")), "lang", "category")


def q36_html_text(spark, sf):
    (pages,) = _t(spark, sf, "pages")
    return pages.select("page_id", text.title_of(F.col("html")).alias("title"), F.length(text.html_text(F.col("html"))).cast("long").alias("n_chars"))


def q37_html_links(spark, sf):
    (pages,) = _t(spark, sf, "pages")
    return pages.select("page_id", F.posexplode(files.links(F.col("html"))).alias("place", "a")).select("page_id", F.col("place").cast("long").alias("place"), "a.url", "a.title")


def q38_carry_forward(spark, sf):
    (turns,) = _t(spark, sf, "conversations")
    rows = turns.withColumn("asked", F.when(F.col("role") == "user", F.length("text")).cast("long"))
    return rows.select("conv_id", "turn", "role", dedupe.carry_forward(rows, ["conv_id"], "turn", "asked").alias("last_asked"))


def q39_json_props(spark, sf):
    (events,) = _t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    has = F.array_contains(F.json_object_keys("props"), "k")
    return events.groupBy("event_type").agg(F.count_if(has).alias("n_has"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"), F.count_if(F.get_json_object("props", "$.none").isNull()).alias("n_none"))


def q40_quote_verify(spark, sf):
    documents, benchmark = _t(spark, sf, "documents", "benchmark")
    hits = match.quoted_passages(documents.select(F.col("doc_id").alias("text_id"), "text"), benchmark.select(F.col("item_id").alias("passage_id"), "text"))
    return hits.select(F.col("text_id").alias("doc_id"), F.col("passage_id").alias("item_id"))


def q41_host_filter(spark, sf):
    (pages,) = _t(spark, sf, "pages")
    host = text.url_host(F.col("url"))
    return pages.filter(text.host_below(F.col("url"), "example.org")).select("page_id", host.alias("host"), F.regexp_replace("url", "[?#].*$", "").alias("plain_url"))


def q42_index_percentile(spark, sf):
    (lineitem,) = _t(spark, sf, "lineitem")
    return quality.index_percentiles(lineitem, "l_returnflag", "l_quantity", {f"p{p:02d}": p / 100 for p in (5, 50, 95)})


def q43_fk_orphans(spark, sf):
    lineitem, orders, part = _t(spark, sf, "lineitem", "orders", "part")
    broken = lineitem.withColumn("l_partkey", F.when(F.col("l_linenumber") == 7, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")))
    return registry.violations("lineitem", broken, {"orders": orders, "part": part}).filter("rule like 'ref%'")


def q44_reconcile(spark, sf):
    names = ("region", "nation", "benchmark", "part")
    return steps.reconcile(registry.counts(dict(zip(names, _t(spark, sf, *names), strict=True))), {"region": 5, "nation": 25, "benchmark": 41, "missing": 1})


def q45_pagination(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    rows = customer.select("c_custkey", "c_name", "c_mktsegment")
    paged = browse.page(rows, 3, 50, "c_mktsegment", descending=False, key=("c_custkey",), most=500)
    return paged.crossJoin(browse.page_totals(rows, 50))


def q46_point_in_polygon(spark, sf):
    customer, nation = _t(spark, sf, "customer", "nation")
    points = customer.select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 97 / 970.0).alias("lng"), (F.col("c_custkey") % 89 / 890.0).alias("lat"))
    k = F.col("n_nationkey")
    x, y, size = k % 5 * 0.02, F.floor(k / 5) * 0.02, 0.013 + k % 3 * 0.006
    square = F.array(F.array(x, y), F.array(x + size, y), F.array(x + size, y + size), F.array(x, y + size), F.array(x, y))
    return geo.smallest_containing(points, nation.select(k.alias("polygon_id"), square.alias("ring")))


def q47_coord_transform(spark, sf):
    (customer,) = _t(spark, sf, "customer")
    lng, lat = geo.mercator_to_degrees(13_500_000 + F.col("c_custkey") * 10.0, 3_600_000 - F.col("c_custkey") * 20.0)
    flat = customer.select("c_custkey", lng.alias("x"), lat.alias("y"))
    plain = geo.unshift(F.col("x"), F.col("y"))
    return flat.select("c_custkey", *[F.floor(v * 1e5 + 0.5).cast("long").alias(n) for n, v in (("lng_e5", plain[0]), ("lat_e5", plain[1]))])


def q48_table_grid(spark, sf):
    (pages,) = _t(spark, sf, "pages")
    cell = F.concat(F.lit("<table><tr><th rowspan=2>"), F.col("page_id").cast("string"), F.lit("</th><th colspan=2>a&amp;b</th></tr><tr><td>"), F.length("url").cast("string"), F.lit("</td><td>x</td></tr></table>"))
    return pages.select("page_id", F.posexplode(text.table_grid(cell)).alias("row", "cells")).select("page_id", F.col("row").cast("long").alias("row"), F.concat_ws("|", "cells").alias("cells"))


def q49_gateway(spark, sf):
    registry.read(spark, sf, "nation").createOrReplaceTempView("gateway_nation")
    return gateway.plan(spark, "/* counts */ SELECT n_regionkey, count(*) AS n FROM gateway_nation GROUP BY n_regionkey;")


def q50_stream_ingest(spark, sf):
    from lodestrata.streaming.ingest import file_stream, ingest_stream

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodestrata-stream-")
    root = f"{root}/stream-{uuid.uuid4().hex}"
    received, _ = _received(spark, sf)
    received.write.parquet(f"{root}/in")
    ingest_stream(file_stream(spark, f"{root}/in", received.schema), f"{root}/out", f"{root}/state", ["l_suppkey", "l_partkey"], "ordinal").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("l_suppkey", "l_partkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()} | product.QUERIES | records.QUERIES | rules.QUERIES
