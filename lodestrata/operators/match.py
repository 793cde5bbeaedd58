"""Entity matching: unique name matches, ordered suffix look-ups, weighted scores, quoted evidence."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.classify import admission_mode, is_placeholder
from lodestrata.functions.text import listed, school_key, school_variants, similarity, without_notes

SIDES = ("left", "right")
#: Pairs that one task makes at least, the most tasks, the most ids that travel together, and as how many ids a name's comparison counts.
PAIRS_AT_ONCE, MOST_TASKS, MOST_IDS, NAME_WEIGHT = 1 << 21, 1 << 11, 1 << 12, 8


def stage_fits(wanted: Column, kind: Column) -> Column:
    return (wanted == "unknown") | (wanted == kind) | (kind == "nine_year")


def match_schools(candidates: DataFrame, schools: DataFrame) -> DataFrame:
    """(candidate_id, school_id, match_kind) of candidates (candidate_id, name, stage) that name exactly one school (id, name, type, aliases).

    Exact variants decide if there are any, also when they are ambiguous; else containment either
    way has to be unique. A name that lies in another shares its two-character pieces with it, so
    candidates without an exact hit meet schools on pieces, never on all pairs; names of one
    character only match exactly.
    """
    wanted = candidates.select("candidate_id", "stage", school_key(F.col("name")).alias("key"), school_variants(F.col("name")).alias("variants"))
    wanted = wanted.filter((F.col("key") != "") & ~is_placeholder(F.col("key")))
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = schools.select(F.col("id").alias("school_id"), "type", school_key(F.col("name")).alias("school_key"), F.explode(names).alias("one"))
    known = known.select("school_id", "type", "school_key", F.explode(school_variants(F.col("one"))).alias("variant"))
    asked = wanted.select("candidate_id", "stage", "key", F.explode("variants").alias("variant"))
    exact = asked.join(known, "variant").filter(stage_fits(F.col("stage"), F.col("type")))
    kind = F.when(F.bool_or(F.col("key") == F.col("school_key")), "exact").otherwise("alias")
    exact = exact.groupBy("candidate_id").agg(F.count_distinct("school_id").alias("n"), F.min("school_id").alias("school_id"), kind.alias("match_kind"))
    rest = asked.join(exact, "candidate_id", "left_anti")
    pieces = [x.withColumn("piece", F.explode(_pieces(F.col("variant")))) for x in (rest, known)]
    near = pieces[0].withColumnRenamed("variant", "v").join(pieces[1], "piece")
    near = near.filter(stage_fits(F.col("stage"), F.col("type")) & (F.col("v").contains(F.col("variant")) | F.col("variant").contains(F.col("v"))))
    near = near.groupBy("candidate_id").agg(F.count_distinct("school_id").alias("n"), F.min("school_id").alias("school_id"), F.lit("alias").alias("match_kind"))
    return exact.unionByName(near).filter("n = 1").drop("n")


def _pieces(c: Column, size: int = 2) -> Column:
    """Every run of ``size`` characters; a shorter text is its own piece."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))
    return F.array_distinct(runs)


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, score) of names (id, block, name) of one block whose ``similarity`` is at least ``least`` (above 0).

    Names of that many shared characters share one of their ``_prefix`` characters, so they meet on
    those; a pair is formed at the first one only. A name that lies in another meets it on its first
    two characters. Where names would so form more than half of their blocks' pairs, as for a low
    ``least``, they meet on the block alone. Null or empty names and null blocks are similar to nothing.

    There are as many pairs as the rows of both names multiply to, so pairs are neither shuffled nor
    written: ids travel in packs with their names, what meets on a key is dealt to a grid of cells,
    and one task compares and makes all pairs of a cell.
    """
    block = left.select("block").union(right.select("block")).schema["block"].dataType
    rows = [x.filter("block is not null and name <> ''").select("id", F.col("block").cast(block).alias("block"), "name") for x in (left, right)]
    names = [x.groupBy("block", "name").agg(F.count("*").alias("n")) for x in rows]
    seen = names[0].unionByName(names[1]).select(F.explode(_characters()).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    rank = F.broadcast(seen.agg(F.map_from_entries(F.collect_list(F.struct("ch", "n"))).alias("rank")))  # a row of all characters
    met, on_chars = _meetings(*map(_on_block, names)), _meetings(*[_on_characters(x, rank, least, side) for x, side in zip(names, SIDES)])
    (pairs, work), (few, less) = _volume(met), _volume(on_chars)
    by_chars = 2 * few < pairs
    if by_chars:
        met, work = on_chars, less
    reach, tasks = math.sqrt(max(PAIRS_AT_ONCE, work / MOST_TASKS)), int(min(work // PAIRS_AT_ONCE + 1, MOST_TASKS))
    grid = met.select("block", "key", *[F.ceil(F.col(f"{x}_weight") / reach).alias(f"{x}_parts") for x in SIDES])
    dealt = []
    for x, n, side in zip(rows, names, SIDES):
        packs = _packs(x, n, min(reach / 4, MOST_IDS))
        packs = _on_characters(packs, rank, least, side) if by_chars else _on_block(packs)
        packs = _dealt(packs.join(grid, ["block", "key"]), side).repartition(tasks, "cell")
        chars = F.split("ranked", "") if by_chars else _characters()
        columns = {"name": F.col("name"), "key": F.col("key"), "ids": F.col("ids"), "chars": F.transform(chars, lambda c: F.ascii(c)), "prefix": _prefix(chars, least)}
        dealt.append(packs.select("cell", *[c.alias(f"{side}_{k}") for k, c in columns.items()]))
    found = dealt[0].hint("merge").join(dealt[1], "cell")
    a, b = F.col("left_name"), F.col("right_name")
    if by_chars:
        first, key = F.get(F.array_intersect("left_prefix", "right_prefix"), F.lit(0)), F.col("left_key")
        whole = first.isNull() & F.when(key.startswith("<"), a.contains(b)).otherwise(b.contains(a))
        found = found.filter(F.when(key.startswith("="), F.coalesce(F.concat(F.lit("="), first) == key, F.lit(False))).otherwise(whole))
    found = found.select("left_ids", "right_ids", similarity(a, b, F.col("left_chars"), F.col("right_chars")).alias("score")).filter(F.col("score") >= least)
    return found.select(F.explode("left_ids").alias("left_id"), "right_ids", "score").select("left_id", F.explode("right_ids").alias("right_id"), "score")


def _characters() -> Column:
    return F.array_distinct(F.split("name", ""))


def _on_block(df: DataFrame) -> DataFrame:
    return df.withColumn("ranked", F.lit("")).withColumn("key", F.lit(""))


def _on_characters(df: DataFrame, rank: DataFrame, least: float, side: str) -> DataFrame:
    """A row for each ``key`` that a name meets others on; ``ranked`` holds its characters, the rarest first.

    Keys are = and a prefix character, < and what a right name within a left one may begin with, > and the like for a left one.
    """

    def tagged(keys: Column, tag: str) -> Column:
        return F.transform(keys, lambda c: F.concat(F.lit(tag), c))

    outer, inner = "<>" if side == "left" else "><"
    ordered = F.sort_array(F.transform(_characters(), lambda c: F.named_struct(F.lit("n"), F.col("rank")[c], F.lit("ch"), c)))
    df = df.crossJoin(rank).withColumn("ranked", F.array_join(F.transform(ordered, lambda x: x["ch"]), "")).drop("rank")
    pieces = F.array_distinct(F.concat(_pieces(F.col("name")), _characters()))
    keys = F.concat(tagged(_prefix(F.split("ranked", ""), least), "="), tagged(pieces, outer), F.array(F.concat(F.lit(inner), F.substring("name", 1, 2))))
    # explode_outer: for explode Spark would infer a filter that makes the keys once more
    return df.withColumn("key", F.explode_outer(keys))


def _meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(block, key) that names (block, key, n) of both sides have, with the numbers and the weights of either side's."""
    sides = [x.groupBy("block", "key").agg(F.count("*").alias(f"{side}_names"), F.sum(F.col("n") + NAME_WEIGHT).alias(f"{side}_weight")) for x, side in zip((left, right), SIDES)]
    return sides[0].join(sides[1], ["block", "key"])


def _volume(met: DataFrame) -> tuple[float, float]:
    """Pairs of names that meet, and the work of making all pairs of rows."""
    totals = [F.sum(F.col(f"left_{c}").cast("double") * F.col(f"right_{c}")) for c in ("names", "weight")]
    return tuple(x or 0.0 for x in met.agg(*totals).first())


def _packs(rows: DataFrame, names: DataFrame, most: float) -> DataFrame:
    """(block, name, pack, ids): the ids of a name in packs of about ``most``, null ones included."""
    pack = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / most)).alias("pack")
    nulls = F.array_repeat(F.lit(None).cast(rows.schema["id"].dataType), F.count_if(F.col("id").isNull()).cast("int"))
    return rows.join(names, ["block", "name"]).select("id", "block", "name", pack).groupBy("block", "name", "pack").agg(F.concat(F.collect_list("id"), nulls).alias("ids"))


def _dealt(packs: DataFrame, side: str) -> DataFrame:
    """Each pack in one part of its own side of the grid of its key, once for each part of the other side, by ``cell``."""
    own = F.pmod(F.pmod(F.xxhash64("name"), F.col(f"{side}_parts")) + F.col("pack"), F.col(f"{side}_parts")).alias(f"{side}_part")
    (other,) = (x for x in SIDES if x != side)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1)).alias(f"{other}_part")
    # one column, as Spark would leave out constant ones on one side and deal the rows once more
    cell = F.concat("left_part", F.lit("."), "right_part", F.lit("."), F.length("key"), F.lit("."), "key", F.col("block").cast("string"))
    return packs.select("*", own, parts).select(cell.alias("cell"), "key", "name", "ids", "ranked")


def _prefix(ranked: Column, least: float) -> Column:
    """The rarest characters, as many as leave fewer than ``least`` of all behind."""
    n = F.size(ranked)
    return F.slice(ranked, F.lit(1), n - F.greatest(F.ceil(n * F.lit(least) - 1e-9).cast("int"), F.lit(1)) + 1)


def suffix_lookup(candidates: DataFrame, targets: DataFrame, suffixes: Sequence[str] = ("", "中学", "初级中学", "学校")) -> DataFrame:
    """(candidate_id, target_id): the first of name + suffix, in order, that is a target's name; of several the least id.

    Distinct names are looked up once each and targets are one row a name, so equal names of either side form no pairs.
    """
    tried = F.posexplode(F.array(*[F.concat("name", F.lit(s)) for s in suffixes])).alias("step", "tried")
    least = targets.groupBy(F.col("name").alias("tried")).agg(F.min("target_id").alias("target_id"))
    hits = candidates.select("name").distinct().select("name", tried).join(least, "tried")
    first = hits.groupBy("name").agg(F.min(F.struct("step", "target_id")).alias("hit"))
    met = candidates.select("candidate_id", "name").join(first, "name")
    return met.groupBy("candidate_id").agg(F.min("hit")["target_id"].alias("target_id"))


def feeder_candidates(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row id, mode, step, candidate): the names in a feeder text; the mode is the whole text's."""
    return df.select(row_id, admission_mode(F.col(text)).alias("mode"), F.posexplode(listed(without_notes(F.col(text)))).alias("step", "candidate"))


def pathway_edges(df: DataFrame, schools: DataFrame) -> DataFrame:
    """Edges (primary_school_id, middle_school_id, admission_mode, raw_text) from (id, feeder text); an unmatched candidate keeps its own text."""
    found = feeder_candidates(df, "id", "feeder").withColumn("candidate_id", F.concat_ws(":", "id", "step"))
    targets = schools.filter("type = 'middle'").select(F.col("id").alias("target_id"), "name")
    hits = suffix_lookup(found.select("candidate_id", F.col("candidate").alias("name")), targets)
    rows = found.join(hits, "candidate_id", "left").join(df.select("id", "feeder"), "id")
    edge = rows.select(F.col("id").alias("primary_school_id"), F.col("target_id").alias("middle_school_id"), F.col("mode").alias("admission_mode"), F.when(F.col("target_id").isNotNull(), F.col("feeder")).otherwise(F.col("candidate")).alias("raw_text"))
    return edge.dropDuplicates()


def poi_score(name: Column, poi: Column, kind: Column, same_district: Column, address: Column, poi_address: Column, stage_word: Column) -> Column:
    """Score of a point of interest for a school: hard rejects in order, else a sum of weights."""
    # Fixed values of the data: the words that tell schools and other places apart, and all weights below.
    school_word, other_school = r"学校|小学|中学", r"附属|附中|附小|小学|中学|高中|初中"
    strong = (poi == name) | poi.contains(name) | name.contains(poi) | poi.contains(school_key(name))
    shared = F.size(F.array_intersect(F.array_distinct(F.split(name, "")), F.array_distinct(F.split(poi, ""))))
    by_address = F.when(poi_address.contains(address) | address.contains(poi_address), 80).when(address.isNull() | poi_address.isNull() | (address == "") | (poi_address == ""), 0)
    total = (
        F.when(same_district, 25).otherwise(-45) + F.when((poi.rlike(school_word)) | kind.rlike(school_word), 20).otherwise(-20)
        + F.when(poi == name, 110).otherwise(0) + F.when(poi.contains(name) | name.contains(poi), 80).otherwise(0)
        + F.when(school_key(poi).contains(school_key(name)) | school_key(name).contains(school_key(poi)), 70).otherwise(0)
        + F.when(poi.rlike("门$"), -35).otherwise(0) + F.coalesce(by_address.otherwise(-20), F.lit(0)) + shared + F.when(stage_word, 10).otherwise(0)
    )
    return (
        F.when(F.coalesce(poi, F.lit("")) == "", -100).when(poi.rlike("幼儿园|驾校"), -40).when(poi.rlike("大学|学院") & ~poi.rlike(other_school), -40)
        .when(poi.rlike("培训") & ~poi.rlike(school_word), -40).when(poi.rlike("停车场|公交站|地铁站"), -60).when(poi.rlike("门$") & ~strong, -60)
        .when(~strong & (by_address.otherwise(-20) == -20), -80).otherwise(total)
    )


def accepted(df: DataFrame, key: str, score: str, order: str, least: int = 70) -> DataFrame:
    """The best-scored row of each key, if its score is high enough; of equal ones the first."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(F.col(score), -F.col(order))).alias("r"))
    return best.select(key, "r.*").filter(F.col(score) >= least)


def quoted_passages(texts: DataFrame, passages: DataFrame, words: int = 3) -> DataFrame:
    """(text_id, passage_id) of texts (text_id, text) that hold a passage (passage_id, text) character for character.

    A passage's inner words stand whole in any text that holds it, so texts and passages meet on
    the hash of its second word and the ones after it, and no pair is formed that does not share
    them; containment then decides. Passages of one or two words have no inner one: they meet texts on
    their first three characters (``_short_passages``). An empty passage is in every text.
    """
    parts = passages.select("passage_id", F.col("text").alias("passage"), F.split(F.trim("text"), r"\s+").alias("w")).filter(F.size("w") >= 3)
    sizes = list(range(1, words + 1))
    n = F.least(F.size("w") - 2, F.lit(words))
    key = F.coalesce(*[F.when(n == k, F.xxhash64(F.lit(k), *[F.get("w", F.lit(i)) for i in range(1, k + 1)])) for k in sizes])
    parts = parts.select("passage_id", "passage", key.alias("h"))
    split_texts = texts.filter(F.col("text").isNotNull()).select("text_id", F.split(F.trim("text"), r"\s+").alias("w"))
    # plain numbers, as Spark finds the distinct ones of an array of structs by comparing all pairs
    runs = [f"xxhash64({k}, " + ", ".join(["x", *(f"get(w, i + {j})" for j in range(1, k))]) + ")" for k in sizes]
    found = F.expr(f"transform(w, (x, i) -> array({', '.join(runs)}))")
    # explode_outer: for explode Spark would infer a filter that computes the windows once more, words and all
    spots = split_texts.select("text_id", F.explode_outer(F.array_distinct(F.flatten(found))).alias("h"))
    pairs = spots.join(parts, "h").select("text_id", "passage_id", "passage").distinct()
    found = pairs.join(texts, "text_id").filter(F.col("text").contains(F.col("passage"))).select("text_id", "passage_id").distinct()
    short = passages.select("passage_id", F.col("text").alias("passage")).filter(F.size(F.split(F.trim("passage"), r"\s+")) < 3)
    return found if short.isEmpty() else found.unionByName(_short_passages(texts, short))


def _short_passages(texts: DataFrame, short: DataFrame, size: int = 3) -> DataFrame:
    """(text_id, passage_id) by containment, among texts and passages that share the passage's first characters."""
    start = F.substring("passage", 1, size)
    sizes = [r["k"] for r in short.select(F.length(start).alias("k")).distinct().collect()]  # at most size + 1 numbers
    spots = [F.array(F.lit(""))] if 0 in sizes else []
    spots += [_pieces(F.col("text"), k) for k in sizes if k]
    met = texts.filter(F.col("text").isNotNull()).select("text_id", "text", F.explode(F.array_distinct(F.concat(*spots))).alias("start"))
    keyed = short.select("passage_id", "passage", start.alias("start"))
    return met.join(keyed, "start").filter(F.col("text").contains(F.col("passage"))).select("text_id", "passage_id").distinct()
