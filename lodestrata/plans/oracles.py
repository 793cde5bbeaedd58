"""DuckDB SQL for the catalogue: the same rows and columns by other means."""

from lodestrata.plans.product_oracles import ORACLES as PRODUCT_ORACLES
from lodestrata.plans.record_oracles import ORACLES as RECORD_ORACLES
from lodestrata.plans.rule_oracles import ORACLES as RULE_ORACLES

_PCT = "CASE WHEN {n} > 0 THEN floor(CAST({c} AS DOUBLE) / {n} * 1000 + 0.5) / 10 ELSE 0.0 END"


def _pct(c: str, n: str = "total") -> str:
    return _PCT.format(c=c, n=n)


_CHECKS = {
    "name": "trim(coalesce(c_name, '')) <> ''", "balance": "c_acctbal > 0", "large": "c_acctbal >= 5000", "scoped": "c_nationkey < 9",
    "segment": "trim(coalesce(c_mktsegment, '')) <> '' AND c_mktsegment <> 'FURNITURE'",
}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{n}" for n, c in _CHECKS.items())
_SHARES = ", ".join(f"{_pct(f'n_{n}')} AS pct_{n}" for n in _CHECKS)
_MEAN = "floor((" + " + ".join(f"pct_{n}" for n in _CHECKS) + ") / 5 * 10 + 0.5) / 10"
_COMPLETE = f"SELECT *, {_MEAN} AS pct_overall FROM (SELECT *, {_SHARES} FROM (SELECT c_mktsegment, count(*) AS total, {_COUNTS} FROM customer GROUP BY GROUPING SETS ({{sets}})))"

_SOURCES = """
  SELECT DISTINCT 'doc:' || source AS title, lang AS grp, 'document' AS kind FROM documents
  UNION ALL SELECT DISTINCT 'event:' || event_type || ' ' || CAST(year(ts) AS VARCHAR), '*', 'event' FROM events
  UNION ALL SELECT DISTINCT 'order:' || o_orderpriority || ' ' || CAST(year(o_orderdate) AS VARCHAR), 'en', 'order' FROM orders"""
_TITLED = f"""SELECT title, grp, kind, CAST(coalesce(nullif(regexp_extract(title, '(20[0-9][0-9])', 1), ''), '2025') AS BIGINT) AS year,
  CASE WHEN regexp_matches(title, 'URGENT|HIGH') THEN 'primary-scope' WHEN regexp_matches(title, 'purchase|signup') THEN 'middle-scope'
       WHEN regexp_matches(title, 'doc:') THEN 'district-policy' ELSE 'other' END AS category FROM ({_SOURCES})"""

_HITS = """
WITH l AS (SELECT s_suppkey, regexp_extract(s_name, '#0*([0-9]+)$', 1) AS key FROM supplier),
     r AS (SELECT p_partkey, CAST(p_size * 7 + length(p_name) AS VARCHAR) AS key FROM part),
     h AS (SELECT s_suppkey, count(*) AS n_hits, min(p_partkey) AS p_partkey FROM l JOIN r USING (key) GROUP BY s_suppkey)"""

_RECEIVED = """
WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1),
     r AS (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 AND o_orderstatus = 'F'),
     u AS (SELECT DISTINCT l_suppkey, l_partkey FROM r),
     f AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.l_suppkey = u.l_suppkey AND e.l_partkey = u.l_partkey))"""

# Fixed values of the public map projection, for the band of the test's coordinates.
_BAND = (-1.981981304930552e-8, 0.000008983055099779535, 0.03278182852591, 40.31678527705744, 0.65659298677277, -4.44255534477492, 0.85341911805263, 0.12923347998204, -0.04625736007561, 4482777.06)
_LOWER = (3.09191371068437e-9, 0.000008983055096812155, 0.00006995724062, 23.10934304144901, -0.00023663490511, -0.6321817810242, -0.00663494467273, 0.03430082397953, -0.00466043876332, 2555164.4)


def _lat(f: tuple, y: str) -> str:
    out = f"CAST({f[8]!r} AS DOUBLE)"
    for k in range(7, 1, -1):
        out = f"({out} * (abs({y}) / CAST({f[9]!r} AS DOUBLE)) + CAST({f[k]!r} AS DOUBLE))"
    return out


def _lng(f: tuple, x: str) -> str:
    return f"CAST({f[0]!r} AS DOUBLE) + CAST({f[1]!r} AS DOUBLE) * abs({x})"


ORACLES = {
    "q01_overview": """SELECT (SELECT count(*) FROM customer WHERE c_nationkey < 9) AS entities, (SELECT count(*) FROM part) AS communities,
      (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 9)) AS links,
      (SELECT count(*) FROM labels WHERE quality = 1) AS policies""",
    "q02_entity_list": """SELECT c_custkey, c_name, c_mktsegment, n_name, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 2500) AS BIGINT) + 1 END AS tier,
      (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_final
      FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey < 9 ORDER BY c_mktsegment, tier NULLS LAST, c_name, c_custkey LIMIT 500""",
    "q03_entity_search": "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%RING%' OR p_type ILIKE '%RING%'",
    "q04_column_filters": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand ILIKE '%#1%' AND CAST(p_size AS VARCHAR) ILIKE '%2%'",
    "q05_fk_page": """SELECT o_orderkey, o_custkey, o_orderstatus, c_name AS customer_label, n_name AS nation_label FROM
      (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 30 OFFSET 30) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "q06_district_summary": """SELECT n_name, count(*) AS n_entities, count(*) FILTER (WHERE c_acctbal > 0) AS n_positive,
      (array_agg(c_mktsegment ORDER BY c_custkey) FILTER (WHERE c_acctbal > 0))[1] AS first_segment,
      (SELECT count(*) FROM orders JOIN customer c2 ON o_custkey = c2.c_custkey WHERE c2.c_nationkey = n_nationkey) AS n_orders
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
    "q07_role_join": """SELECT f.n_name AS from_name, t.n_name AS to_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation f ON c_nationkey = f.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation t ON s_nationkey = t.n_nationkey GROUP BY 1, 2""",
    "q08_bidirectional": "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_suppkey = 1 THEN 'out' ELSE 'in' END AS direction FROM lineitem WHERE l_suppkey = 1 OR l_partkey = 1",
    "q09_policy_list": """SELECT d.doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END AS lang_label,
      CASE WHEN quality IS NULL THEN 'unrated' WHEN toxic = 1 THEN 'flagged' ELSE 'rated' END AS kind, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(quality, 1) = 1""",
    "q10_latest_per_group": """SELECT c_custkey, event_id, event_type, value FROM customer LEFT JOIN
      (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON c_custkey = user_id""",
    "q11_price_history": "SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC",
    "q12_reverse_search": """WITH f AS (SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' ORDER BY p_partkey LIMIT 50)
      SELECT p_partkey, p_name, count(s_name) AS n_children, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS children
      FROM f LEFT JOIN (SELECT DISTINCT l_partkey, s_name, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) ON p_partkey = l_partkey GROUP BY 1, 2""",
    "q13_source_counts": "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 300) GROUP BY 1",
    "q14_completeness": _COMPLETE.format(sets="(c_mktsegment)"),
    "q15_completeness_total": f"SELECT coalesce(c_mktsegment, 'all') AS segment, total, n_balance, pct_balance, pct_overall FROM ({_COMPLETE.format(sets='(c_mktsegment), ()')})",
    "q16_row_quality": "SELECT c_custkey, CAST(floor(CAST(" + " + ".join(f"CAST(({c}) AS INT)" for c in _CHECKS.values()) + " AS DOUBLE) / 5 * 100 + 0.5) AS BIGINT) AS pct, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _CHECKS.items()) + ") AS missing FROM customer",
    "q17_coverage_grid": f"""WITH y(year) AS (VALUES (1996), (1997), (1998), (1999)),
      g AS (SELECT y.year, c.*, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y.year) AS n FROM y CROSS JOIN customer c),
      s AS (SELECT year, c_mktsegment AS grp, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 5000) AS n_boundary, count(*) FILTER (WHERE n > 0) AS n_linked, CAST(sum(n) AS BIGINT) AS n_links FROM g GROUP BY 1, 2)
      SELECT CAST(year AS INT) AS year, grp, total, n_boundary, n_linked, n_links, {_pct("n_linked")} AS pct_linked,
      CASE WHEN n_linked >= total THEN 'linked' WHEN n_linked > 0 THEN 'partially-linked' WHEN n_boundary > 0 THEN 'boundary-text' ELSE 'missing' END AS status FROM s""",
    "q18_source_union": _TITLED,
    "q19_source_rank": f"""WITH t AS (SELECT DISTINCT * FROM ({_TITLED})),
      s AS (SELECT year, CASE WHEN grp = '*' THEN unnest(['en', 'fr', 'de', 'es']) ELSE grp END AS grp, title, kind, category FROM t),
      d AS (SELECT DISTINCT * FROM s), h AS (SELECT *, category IN ('primary-scope', 'middle-scope') AS has_scope FROM d)
      SELECT year, grp, title, category, has_scope, row_number() OVER (PARTITION BY year, grp ORDER BY has_scope DESC, title, kind) AS place FROM h""",
    "q20_weighted_score": f"SELECT c_mktsegment, floor((pct_name * 10 + pct_balance * 25 + pct_large * 15 + pct_scoped * 30 + pct_segment * 20) / 100 * 10 + 0.5) / 10 AS score FROM ({_COMPLETE.format(sets='(c_mktsegment)')})",
    "q21_gap_list": "SELECT c_custkey, c_mktsegment, c_acctbal, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_links FROM customer WHERE c_acctbal <= 0",
    "q22_priority_dedupe": """SELECT l_suppkey, l_partkey, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY CASE WHEN o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' THEN 0 ELSE 1 END, year(o_orderdate) DESC NULLS LAST, l_orderkey * 10 + l_linenumber) = 1""",
    "q23_unique_match": _HITS + " SELECT s_suppkey, p_partkey FROM h WHERE n_hits = 1",
    "q24_ambiguous": _HITS + " SELECT s_suppkey, n_hits FROM h WHERE n_hits > 1",
    "q25_anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1998)",
    "q26_semi_join": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')",
    "q27_merge_repoint": """WITH k AS (SELECT p_partkey, p_name || '|' || p_brand AS key FROM part),
      m AS (SELECT a.p_partkey AS pseudo, min(b.p_partkey) AS real FROM k a JOIN k b USING (key) WHERE a.p_partkey % 3 = 0 AND b.p_partkey % 3 <> 0 GROUP BY 1 HAVING count(*) = 1),
      l AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_suppkey, l_partkey FROM lineitem),
      r AS (SELECT id, l_suppkey, coalesce(real, l_partkey) AS l_partkey, real IS NOT NULL AS moved FROM l LEFT JOIN m ON l_partkey = pseudo)
      SELECT id, l_suppkey, l_partkey FROM r QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY moved, id) = 1""",
    "q28_ingest_new": _RECEIVED + """ SELECT (SELECT count(*) FROM r) AS received, (SELECT count(*) FROM f) AS added,
      (SELECT count(*) FROM u) - (SELECT count(*) FROM f) AS unchanged, (SELECT count(*) FROM r) - (SELECT count(*) FROM u) AS skipped""",
    "q29_upsert_latest": "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "q30_replace_source": """SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'
      UNION ALL SELECT event_id, event_type, 0.0 FROM events WHERE event_type = 'error' AND value > 10""",
    "q31_feeder_split": """SELECT p_partkey, ['direct', 'placement', 'partial', 'assign', 'unknown'][CAST(p_partkey % 5 AS INT) + 1] AS mode, CAST(n AS BIGINT) AS step, [p_type, p_brand, p_name][n + 1] AS candidate
      FROM part CROSS JOIN (VALUES (0), (1), (2)) v(n)""",
    "q32_suffix_lookup": """WITH c AS (SELECT s_suppkey AS candidate_id, ['red', 'blue', 'small', 'green', 'none'][CAST(s_suppkey % 5 AS INT) + 1] AS name FROM supplier),
      v(step, suffix) AS (VALUES (0, ' nothing'), (1, ' ring'), (2, ' bolt'), (3, ' widget')), n AS (SELECT p_name, min(p_partkey) AS target_id FROM part GROUP BY 1)
      SELECT candidate_id, target_id FROM c CROSS JOIN v JOIN n ON p_name = name || suffix QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY step) = 1""",
    "q33_name_similarity": """WITH l AS (SELECT s_suppkey, s_nationkey AS block, lower(s_name) AS a FROM supplier), r AS (SELECT p_partkey, p_size % 25 AS block, p_name || ' ' || lower(p_type) AS b FROM part),
      j AS (SELECT *, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM l JOIN r USING (block))
      SELECT s_suppkey, p_partkey, CAST(floor(CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b))
        ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / greatest(len(x), len(y)) END * 1000 + 0.5) AS BIGINT) AS score FROM j WHERE score > 350""",
    "q34_contains_unique": """WITH s AS (SELECT min(p_partkey) AS school_id, p_brand || '-' || p_type AS key FROM part GROUP BY p_brand, p_type),
      c AS (SELECT n_nationkey AS candidate_id, '#' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '-' || ['ECONOMY', 'SMALL', 'MEDIUM'][n_nationkey % 3 + 1] ELSE '' END AS key FROM nation),
      h AS (SELECT candidate_id, count(*) AS n, min(school_id) AS school_id, 'alias' AS match_kind FROM c JOIN s ON contains(s.key, c.key) OR contains(c.key, s.key) GROUP BY 1)
      SELECT candidate_id, school_id, match_kind FROM h WHERE n = 1""",
    "q35_classify_text": r"""SELECT lang, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '!!') THEN 'shouting'
      WHEN regexp_matches(text, '[*#$%]{3}') THEN 'noise' ELSE 'prose' END AS category, count(*) AS n FROM documents GROUP BY 1, 2""",
    "q36_html_text": r"""SELECT page_id, nullif(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1), '') AS title, length(trim(regexp_replace(
      replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS n_chars FROM pages""",
    "q37_html_links": r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>') AS anchors FROM pages),
      p AS (SELECT page_id, unnest(anchors) AS a, generate_subscripts(anchors, 1) - 1 AS n FROM a)
      SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS place, regexp_extract(a, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1) AS url, trim(regexp_replace(a, '<[^>]+>', '', 'g')) AS title
      FROM p WHERE regexp_extract(a, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1) <> ''""",
    "q38_carry_forward": """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER
      (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_asked FROM conversations""",
    "q39_json_props": """SELECT event_type, count(*) FILTER (WHERE json_exists(props, '$.k')) AS n_has, CAST(sum(TRY_CAST((props->>'$.k') AS BIGINT)) AS BIGINT) AS sum_k, max(TRY_CAST((props->>'$.k') AS BIGINT)) AS max_k,
      count(*) FILTER (WHERE (props->>'$.none') IS NULL) AS n_none FROM events GROUP BY 1""",
    "q40_quote_verify": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "q41_host_filter": r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, regexp_replace(url, '[?#].*$', '') AS plain_url FROM pages
      WHERE lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) LIKE '%.example.org'""",
    "q42_index_percentile": "WITH v AS (SELECT l_returnflag, list(l_quantity ORDER BY l_quantity) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, "
    + ", ".join(f"v[CAST(least(floor(len(v) * {p / 100!r}), len(v) - 1) AS BIGINT) + 1] AS p{p:02d}" for p in (5, 50, 95)) + " FROM v",
    "q43_fk_orphans": """SELECT 'ref(l_orderkey)' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
      UNION ALL SELECT 'ref(l_partkey)', count(*) FROM lineitem WHERE CASE WHEN l_linenumber = 7 THEN -l_partkey - 1 ELSE l_partkey END NOT IN (SELECT p_partkey FROM part)""",
    "q44_reconcile": """WITH e(table_name, expected) AS (VALUES ('region', 5), ('nation', 25), ('benchmark', 41), ('missing', 1)),
      a AS (SELECT 'region' AS table_name, count(*) AS actual FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'part', count(*) FROM part)
      SELECT table_name, CAST(expected AS BIGINT) AS expected, actual, coalesce(expected = actual, false) AS ok FROM e FULL JOIN a USING (table_name)""",
    "q45_pagination": """SELECT *, (SELECT count(*) FROM customer) AS total, CAST(ceil((SELECT count(*) FROM customer) / 50) AS BIGINT) AS total_pages FROM
      (SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 50 OFFSET 100)""",
    "q47_coord_transform": f"""WITH b AS (SELECT c_custkey, 13500000 + c_custkey * 10.0::DOUBLE AS x, 3600000 - c_custkey * 20.0::DOUBLE AS y FROM customer),
      d AS (SELECT c_custkey, CASE WHEN y >= 3481989.83 THEN {_lng(_BAND, "x")} ELSE {_lng(_LOWER, "x")} END - 0.0065::DOUBLE AS x, CASE WHEN y >= 3481989.83 THEN {_lat(_BAND, "y")} ELSE {_lat(_LOWER, "y")} END - 0.006::DOUBLE AS y FROM b),
      z AS (SELECT c_custkey, sqrt(x * x + y * y) - 0.00002::DOUBLE * sin(y * pi()) AS r, atan2(y, x) - 0.000003::DOUBLE * cos(x * pi()) AS a FROM d)
      SELECT c_custkey, CAST(floor(r * cos(a) * 1e5 + 0.5) AS BIGINT) AS lng_e5, CAST(floor(r * sin(a) * 1e5 + 0.5) AS BIGINT) AS lat_e5 FROM z""",
    "q46_point_in_polygon": """WITH p AS (SELECT c_custkey AS point_id, c_custkey % 97 / 970.0::DOUBLE AS lng, c_custkey % 89 / 890.0::DOUBLE AS lat FROM customer),
      s AS (SELECT n_nationkey AS polygon_id, n_nationkey % 5 * 0.02::DOUBLE AS x, floor(n_nationkey / 5) * 0.02::DOUBLE AS y, 0.013::DOUBLE + n_nationkey % 3 * 0.006::DOUBLE AS size FROM nation)
      SELECT point_id, polygon_id FROM p JOIN s ON lng >= x AND lng < x + size AND lat >= y AND lat < y + size
      QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY size, y DESC, polygon_id) = 1""",
    "q48_table_grid": """SELECT page_id, CAST(n AS BIGINT) AS row, CASE n WHEN 0 THEN page_id || '|a&b|a&b' ELSE page_id || '|' || length(url) || '|x' END AS cells FROM pages CROSS JOIN (VALUES (0), (1)) v(n)""",
    "q49_gateway": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1",
    "q50_stream_ingest": _RECEIVED.rsplit(",\n     f AS", 1)[0] + " SELECT l_suppkey, l_partkey FROM u",
} | PRODUCT_ORACLES | RECORD_ORACLES | RULE_ORACLES
