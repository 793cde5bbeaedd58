"""The queries that users call: details, lists, provenance, coverage, worklists, roll-ups, derived links."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import community_aliases, trim_all
from lodestrata.operators.dedupe import latest


def detail(df: DataFrame, key: str, value: object, scope: Column, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """The row of a positive whole-number key with a count per child table; no row for any other key or out of scope.

    A key is digits alone, up to the largest long; spaces, signs and separators make it none.
    """
    number = int(str(value)) if re.fullmatch("[0-9]{1,19}", str(value)) else 0
    number = number if number < 1 << 63 else 0
    row = df.filter((F.col(key) == F.lit(number)) & F.lit(number > 0) & scope)
    for name, (child, column) in children.items():
        n = child.filter(F.col(column) == F.lit(number)).agg(F.count("*").alias(name))
        row = row.crossJoin(n)  # one row each
    return row


def with_latest(links: DataFrame, prices: DataFrame, key: str, time: str, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Links with the newest price of their target, null where there is none."""
    newest = latest(prices.select(key, time, row_id, *columns), [key], time, row_id)
    return links.join(newest, key, "left")


def provenance(links: DataFrame, source: str, priced: Column, kinds: Mapping[str, str]) -> DataFrame:
    """One row: the links in all, those of each named source, and those with a price."""
    counts = [F.count_if(F.col(source) == value).alias(name) for name, value in kinds.items()]
    return links.agg(F.count("*").alias("total"), *counts, F.count_if(priced).alias("priced"))


def reached(df: DataFrame, group: str, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per group the entities, and how many of them each child table reaches; children are reduced before they are joined."""
    rows = df.select(group, F.col(key).alias("__k")).distinct()
    for name, (child, column) in children.items():
        rows = rows.join(child.select(F.col(column).alias("__k")).distinct().withColumn(f"__{name}", F.lit(1)), "__k", "left")
    return rows.groupBy(group).agg(F.count("*").alias("total"), *[F.count(f"__{name}").alias(name) for name in children])


def worklist(df: DataFrame, key: str, missing: Column, done: DataFrame | None = None, done_key: str | None = None, skip: Sequence[object] = (), limit: int | None = None) -> DataFrame:
    """Rows that lack something, without those done and those skipped, by key; all of them if there is no limit."""
    rows = df.filter(missing)
    if skip:
        rows = rows.filter(~F.col(key).isin(*skip))
    if done is not None:
        rows = rows.join(done.select(F.col(done_key or key).alias("__done")).distinct(), F.col(key) == F.col("__done"), "left_anti")
    return rows if limit is None else rows.orderBy(key).limit(limit)


def no_location(address: Column, lat: Column, lng: Column) -> Column:
    return address.isNull() | (F.btrim(address) == "") | lat.isNull() | lng.isNull()


def areas(entities: DataFrame, relations: DataFrame, street: str, area: str, verified: str, blank: str) -> DataFrame:
    """Per street (or area, or ``blank``) its entities, relations and verified relations."""
    def name(df: DataFrame) -> Column:
        return F.coalesce(F.nullif(F.col(street), F.lit("")), F.nullif(F.col(area), F.lit("")), F.lit(blank)).alias("name")

    one = entities.groupBy(name(entities)).agg(F.count("*").alias("n_entities"), F.lit(0).cast("long").alias("n_relations"), F.lit(0).cast("long").alias("n_verified"))
    two = relations.groupBy(name(relations)).agg(F.lit(0).cast("long").alias("n_entities"), F.count("*").alias("n_relations"), F.count_if(F.col(verified)).alias("n_verified"))
    return one.unionByName(two).groupBy("name").agg(*[F.sum(c).alias(c) for c in ("n_entities", "n_relations", "n_verified")])


def picker(df: DataFrame, column: str, collation: str = "zh") -> DataFrame:
    """The distinct non-null values in the order of a language."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(F.collate(column, collation), column)


def inherited_links(members: DataFrame, feeders: DataFrame, links: DataFrame) -> DataFrame:
    """(member_id, target_id) that members take over from those that feed them and do not have yet.

    ``members`` (member_id, key), ``feeders`` (member_id, key) names the feeders, ``links`` (member_id, target_id).
    """
    known = feeders.select("member_id", "key").distinct().join(members.groupBy("key").agg(F.max("member_id").alias("feeder_id")), "key")
    taken = known.join(links.select(F.col("member_id").alias("feeder_id"), "target_id"), "feeder_id").select("member_id", "target_id").distinct()
    return taken.join(links, ["member_id", "target_id"], "left_anti")


def votes(df: DataFrame, keys: Sequence[str], tier: str, tiers: Sequence[int]) -> DataFrame:
    """Per key the votes of each tier, their number, and the tier of most votes (of equal ones the better)."""
    counted = df.groupBy(*keys).agg(*[F.count_if(F.col(tier) == t).alias(f"tier_{t}") for t in tiers], F.count(tier).alias("n_votes"))
    most = F.greatest(*[F.col(f"tier_{t}") for t in tiers])
    return counted.withColumn("tier", F.coalesce(*[F.when((F.col(f"tier_{t}") == most) & (most > 0), t) for t in tiers]))


def match_statistics(df: DataFrame, matched: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count(matched).alias("matched"), F.count_if(F.col(matched).isNull()).alias("unmatched"))


def candidate_summary(links: DataFrame, by: Sequence[str], source: str, prefix: str, entity: str) -> DataFrame:
    """Counts and distinct matched entities of the links whose source starts with a prefix."""
    rows = links.filter(F.col(source).startswith(prefix))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("n_matched"))


def verified_with_note(df: DataFrame, proven: Column, verified: str, note: str, text: str) -> DataFrame:
    """Marks proven rows as verified and appends a line to their note; rows verified before stay as they are."""
    fresh = proven & ~F.coalesce(F.col(verified), F.lit(False))
    return df.withColumns({verified: F.when(fresh, True).otherwise(F.col(verified)), note: F.when(fresh, F.concat_ws("\n", F.nullif(F.col(note), F.lit("")), F.lit(text))).otherwise(F.col(note))})


def curated(candidates: DataFrame, mapping: DataFrame, targets: DataFrame) -> DataFrame:
    """Curated links (candidate_id, target_id) judged: the target exists and is of the candidate's district."""
    rows = mapping.join(candidates.select("candidate_id", F.col("district").alias("own")), "candidate_id", "left").join(targets.select("target_id", F.col("district").alias("other")), "target_id", "left")
    verdict = F.when(F.col("own").isNull(), "no candidate").when(F.col("other").isNull(), "no target").when(F.col("own") != F.col("other"), "other district").otherwise("ok")
    return rows.select("candidate_id", "target_id", verdict.alias("verdict"))


def same_place(found: DataFrame, communities: DataFrame) -> DataFrame:
    """(found_id, community_id): the found name is the community's, or the community's without phase and zone.

    Only our own names are peeled: another phase of the same estate is another place. Districts agree where both are known.
    """
    one = found.select("found_id", "district", trim_all(F.col("name")).alias("alias"))
    two = communities.select("community_id", F.col("district").alias("other"), F.explode(community_aliases(F.col("name"))).alias("alias"))
    rows = one.join(two, "alias").filter(F.col("district").isNull() | F.col("other").isNull() | (F.col("district") == F.col("other")))
    return rows.select("found_id", "community_id").distinct()


def reverse_index(df: DataFrame, key: str, elements: str) -> DataFrame:
    """(element, id): which rows hold each element of their lists, one row a holder, so that a frequent element is many rows and not one long list."""
    return df.select(F.explode(elements).alias("element"), F.col(key).alias("id")).filter("element <> ''").distinct()


def element_counts(index: DataFrame) -> DataFrame:
    """(element, n, first_id): how many rows hold an element, and the least of them, from ``reverse_index``."""
    return index.groupBy("element").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def conserved(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """(kind, is_total, n_before, n_after, ok): whether tagging moved rows between kinds and lost none.

    A null kind is a kind of its own; the total is told by ``is_total``.
    """
    total = F.grouping(kind).cast("boolean").alias("is_total")
    sides = [df.rollup(kind).agg(F.count("*").alias(n), total) for df, n in ((before, "n_before"), (after, "n_after"))]
    left, right = (df.select(F.col(kind).alias(k), F.col("is_total").alias(t), n) for df, k, t, n in ((sides[0], "__k", "__t", "n_before"), (sides[1], "__k2", "__t2", "n_after")))
    rows = left.join(right, F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__t") == F.col("__t2")), "full")
    none = F.lit(0).cast("long")
    rows = rows.select(F.coalesce("__k", "__k2").alias("kind"), F.coalesce("__t", "__t2").alias("is_total"), F.coalesce("n_before", none).alias("n_before"), F.coalesce("n_after", none).alias("n_after"))
    return rows.withColumn("ok", ~F.col("is_total") | (F.col("n_before") == F.col("n_after")))


def robust_box(df: DataFrame, lat: str, lng: str, pad: float = 0.005, span: float = 0.135) -> DataFrame:
    """One row of south, north, west, east: the 5 to 95 per cent places, padded; around the median where that is too wide.

    Places are counted off by values over ranges of them, so neither a list of all points is built nor all values sorted by one task.
    """
    from lodestrata.operators.quality import spread_percentiles

    def side(column: str) -> DataFrame:
        return spread_percentiles(df, column, {"p05": 0.05, "p50": 0.5, "p95": 0.95})

    def bounds(low: str, high: str) -> list[Column]:
        lo, hi = F.col("p05") - pad, F.col("p95") + pad
        wide = hi - lo > span
        return [F.when(wide, F.col("p50") - span / 2).otherwise(lo).alias(low), F.when(wide, F.col("p50") + span / 2).otherwise(hi).alias(high)]

    return side(lat).select(*bounds("south", "north")).crossJoin(side(lng).select(*bounds("west", "east")))  # one row each


def largest_box(shapes: DataFrame, name: str, shape_id: str, south: str, north: str, west: str, east: str) -> DataFrame:
    """Of the shapes of a name the one of the largest bounds; of equal ones the least id."""
    size = F.coalesce((F.col(north) - F.col(south)) * (F.col(east) - F.col(west)), F.lit(0.0))
    return shapes.groupBy(name).agg(F.max_by(shape_id, F.struct(size, -F.col(shape_id))).alias(shape_id))


def outer_rings(geometry: Column) -> Column:
    """The outer rings of a GeoJSON polygon or multipolygon."""
    polygon = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<double>>>")
    many = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<array<double>>>>")
    return F.when(F.get_json_object(geometry, "$.type") == "Polygon", F.array(polygon[0])).otherwise(F.transform(many, lambda p: p[0]))


def located(lat: Column, lng: Column) -> Column:
    return lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)


def latest_year(df: DataFrame, year: str) -> DataFrame:
    """One row: the last year, this year where there is none."""
    return df.agg(F.coalesce(F.max(year).cast("int"), F.year(F.current_date())).alias("year"))


def document_statistics(schools: DataFrame) -> DataFrame:
    """One row of sizes of a nested document's schools: districts, streets, schools by stage, committees, coordinates, tags."""
    names = F.col("school.对口居委")
    committees = F.size(F.when(names.startswith("["), F.from_json(names, "array<string>")).when(F.coalesce(names, F.lit("")) != "", F.array(names)).otherwise(F.array().cast("array<string>")))
    return schools.agg(
        F.count_distinct("district").alias("districts"), F.count_distinct("district", F.nullif(F.col("school.街道"), F.lit(""))).alias("streets"),
        F.count_if(F.col("stage") == "primary").alias("primary"), F.count_if(F.col("stage") == "middle").alias("middle"), F.coalesce(F.sum(committees), F.lit(0)).alias("committees"),
        F.count_if(located(F.col("school.lat"), F.col("school.lng"))).alias("coordinates"), F.coalesce(F.sum(F.size(F.coalesce("school.标签", F.array().cast("array<string>")))), F.lit(0)).alias("tags"),
    )
