"""DuckDB SQL for the product queries: the same rows and columns by other means."""

from lodestrata.functions import classify, labels
from lodestrata.plans.product import PLACES, TIERS, TITLES


def _pick(values, number: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][CAST({number} % {len(values)} AS INT) + 1]"


_ZONE = "东区|西区|南区|北区|中区|一区|二区|三区|四区|五区|六区|七区|八区|九区|十区|[一二三四五六七八九十0-9]+期"


def _peeled(name: str) -> str:
    bare = f"regexp_replace(regexp_replace({name}, '[（(](?:{_ZONE})[）)]$', ''), '(?:{_ZONE})$', '')"
    return f"CASE WHEN length({bare}) >= 2 THEN {bare} ELSE {name} END"


_LINKS = """SELECT o_orderkey, o_custkey AS user_id, o_orderpriority, event_id, value FROM orders LEFT JOIN
  (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON o_custkey = user_id WHERE year(o_orderdate) = 1997"""
_AREAS = """(SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'area ' || c_nationkey ELSE 'none' END AS name FROM customer)"""
_ROLLUP = "SELECT c_mktsegment AS kind, grouping(c_mktsegment) = 1 AS is_total, count(*) AS n FROM ({}) GROUP BY GROUPING SETS ((c_mktsegment), ())"
_BEFORE = "SELECT c_acctbal, CASE WHEN c_custkey % 10 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer"
_AFTER = f"SELECT CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' WHEN c_acctbal < 9000 THEN c_mktsegment END AS c_mktsegment FROM ({_BEFORE})"


def _at(column: str, share: float) -> str:
    return f"list_sort(list({column}))[CAST(floor(count(*) * {share}) AS BIGINT) + 1]"


def _edge(column: str, low: bool) -> str:
    lo, hi, sign = f"{column}05 - 0.005", f"{column}95 + 0.005", "-" if low else "+"
    return f"CAST(floor(CASE WHEN ({hi}) - ({lo}) > 0.135 THEN {column}50 {sign} 0.135 / 2 ELSE {lo if low else hi} END * 1e6 + 0.5) AS BIGINT)"


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{label}'" for p, label in classify.TITLE_PATTERNS) + " ELSE 'other' END"
_RESIDENTIAL = (
    f"length(place) >= 4 AND NOT (regexp_matches(place, '{classify.NOT_RESIDENTIAL}') OR regexp_matches(place, '[一二三四五六七八九十百]+居$') OR regexp_matches(place, '{classify.ROAD_PREFIX}') OR regexp_matches(place, '[路街公号弄]'))"
    f" AND (regexp_matches(place, '{classify.RESIDENTIAL_END}') OR regexp_matches(place, '{classify.VILLAGE_END}'))"
)
_AREA = (
    f"length(place) >= 3 AND NOT (regexp_matches(place, '{classify.NOT_AREA}') OR regexp_matches(place, '(路|街|公路)\\d+弄') OR regexp_matches(place, '{classify.ROAD_PREFIX}') OR regexp_matches(place, '[路街公]\\d*(号|弄)$|^\\d+(号|弄)$'))"
    f" AND (regexp_matches(place, '{classify.AREA_END}') OR regexp_matches(place, '{classify.RESIDENTIAL_END}'))"
)
_KIND = f"CASE WHEN regexp_matches(place, '{labels.PLACE_IN_AREA}') OR regexp_matches(place, '{labels.COMMITTEE_END}') OR NOT regexp_matches(place, '{labels.RESIDENTIAL_WORD}') THEN 'official_area' ELSE 'community' END"

ORACLES = {
    "q51_entity_detail": """SELECT c_custkey, c_name, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events
      FROM customer WHERE c_custkey IN (6, 7, 8) AND c_nationkey < 9""",
    "q52_map_list": f"""WITH r AS (SELECT *, coalesce(CASE WHEN t IN ('一梯队', '二梯队', '三梯队') THEN t END, '待补充') AS tier FROM (SELECT *, {_pick((*TIERS, "x", None), "c_custkey")} AS t FROM customer JOIN nation ON c_nationkey = n_nationkey))
      SELECT c_custkey, tier, n_name, c_mktsegment, row_number() OVER (PARTITION BY n_name ORDER BY CASE tier WHEN '一梯队' THEN 1 ELSE 9 END, c_name, c_custkey) AS place FROM r WHERE tier IN ('一梯队', '待补充') AND contains(lower(n_name || ' ' || c_mktsegment), 'ma') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
    "q53_links_with_latest": _LINKS,
    "q54_provenance": f"SELECT count(*) AS total, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS via_urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS via_low, count(event_id) AS priced FROM ({_LINKS})",
    "q55_candidate_summary": """SELECT year(o_orderdate) AS year, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) FILTER (WHERE o_custkey % 4 > 0) AS n_matched FROM orders
      WHERE year(o_orderdate) IN (1996, 1997) AND o_orderpriority LIKE '1-%' GROUP BY 1, 2""",
    "q56_price_coverage": """SELECT c_mktsegment, count(DISTINCT c_custkey) AS total, count(DISTINCT user_id) AS mapped, count(DISTINCT o_custkey) AS priced FROM customer
      LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') e ON user_id = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) o ON o_custkey = c_custkey GROUP BY 1""",
    "q57_worklist": """SELECT c_custkey, c_name FROM customer c WHERE (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AND c_custkey NOT IN (3, 5, 6)
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1998) ORDER BY c_custkey LIMIT 200""",
    "q58_area_rollup": f"""SELECT name, count(*) AS n_entities, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_relations, CAST(coalesce(sum(v), 0) AS BIGINT) AS n_verified FROM {_AREAS}
      LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""",
    "q59_picker": "SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS place FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)",
    "q60_inherited_links": """WITH l AS (SELECT DISTINCT o_custkey AS member_id, o_orderkey % 50 AS target_id FROM orders),
      f AS (SELECT c_custkey AS member_id, c_custkey + d AS feeder FROM customer CROSS JOIN (VALUES (1), (2)) v(d) WHERE c_custkey % 5 = 0)
      SELECT f.member_id, l.target_id FROM f JOIN l ON l.member_id = feeder EXCEPT SELECT member_id, target_id FROM l""",
    "q61_votes": """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (WHERE l_linenumber = 1) AS tier_1, count(*) FILTER (WHERE l_linenumber = 2) AS tier_2, count(*) FILTER (WHERE l_linenumber = 3) AS tier_3,
      count(*) FILTER (WHERE l_linenumber = 4) AS tier_4, count(*) AS n_votes FROM lineitem GROUP BY 1, 2)
      SELECT *, CASE WHEN greatest(tier_1, tier_2, tier_3, tier_4) = 0 THEN NULL WHEN tier_1 >= greatest(tier_2, tier_3, tier_4) THEN 1 WHEN tier_2 >= greatest(tier_3, tier_4) THEN 2 WHEN tier_3 >= tier_4 THEN 3 ELSE 4 END::BIGINT AS tier FROM c""",
    "q62_match_statistics": "SELECT count(*) AS total, count(c_custkey) AS matched, count(*) - count(c_custkey) AS unmatched FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
    "q63_json_merge": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{' || CASE WHEN event_id % 3 > 0 THEN '"n":' || event_id * 10 ELSE '"n":null' END || ',"reviewedAt":"' || event_type || '"}'
      WHEN event_id % 7 > 2 THEN '{"even":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"list":[' || event_id || ',null],"n":' || CASE WHEN event_id % 3 > 0 THEN CAST(event_id * 10 AS VARCHAR) ELSE 'null' END
        || ',"o":{"t":"' || event_type || '"},"reviewedAt":"' || event_type || '"}' END AS made FROM events""",
    "q64_literal_search": "SELECT lang, source, count(*) AS n FROM documents WHERE contains(text, '%%%') GROUP BY 1, 2",
    "q65_verified_note": """SELECT c_custkey, c_custkey % 7 = 0 OR c_acctbal > 5000 AS verified, CASE WHEN c_acctbal > 5000 AND c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'old' || chr(10) || 'seen' ELSE 'seen' END
      WHEN c_custkey % 2 = 0 THEN 'old' ELSE '' END AS note FROM customer""",
    "q66_conservation": f"""WITH b AS ({_ROLLUP.format(_BEFORE)}), a AS ({_ROLLUP.format(_AFTER)})
      SELECT coalesce(b.kind, a.kind) AS kind, coalesce(b.is_total, a.is_total) AS is_total, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, NOT coalesce(b.is_total, a.is_total) OR b.n = a.n AS ok
      FROM b FULL JOIN a ON b.kind IS NOT DISTINCT FROM a.kind AND b.is_total = a.is_total""",
    "q67_reverse_index": "SELECT element, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first_id FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS element FROM part) WHERE element <> '' GROUP BY 1",
    "q68_robust_box": f"""WITH p AS (SELECT 31 + c_custkey % 97 / 1000.0::DOUBLE AS lat, 121 + c_custkey % 89 / 100.0::DOUBLE AS lng FROM customer),
      q AS (SELECT {", ".join(f"{_at(c, s)} AS {n}{int(s * 100):02d}" for c, n in (("lat", "y"), ("lng", "x")) for s in (0.05, 0.5, 0.95))} FROM p)
      SELECT {_edge("y", True)} AS south_e6, {_edge("y", False)} AS north_e6, {_edge("x", True)} AS west_e6, {_edge("x", False)} AS east_e6 FROM q""",
    "q69_same_place": """SELECT n_nationkey AS found_id, p_partkey AS community_id FROM nation JOIN part ON p_size = n_nationkey
      WHERE CASE n_nationkey % 4 WHEN 0 THEN p_partkey % 5 <> 4 WHEN 2 THEN p_partkey % 5 = 1 WHEN 3 THEN p_partkey % 5 = 2 ELSE false END""",
    "q70_titles_and_places": f"""WITH r AS (SELECT p_partkey, {_pick(TITLES, "p_partkey")} AS title, {_pick(PLACES, "p_size")} AS place FROM part),
      a AS (SELECT *, {_peeled("place")} AS one FROM r), b AS (SELECT *, {_peeled("one")} AS two FROM a), c AS (SELECT *, {_peeled("two")} AS three FROM b)
      SELECT p_partkey, {_CATEGORY} AS category, {_RESIDENTIAL} AS residential, {_AREA} AS area, {_KIND} AS kind,
      place || CASE WHEN one <> place THEN '|' || one ELSE '' END || CASE WHEN two <> one THEN '|' || two ELSE '' END || CASE WHEN three <> two THEN '|' || three ELSE '' END AS aliases FROM c""",
}
