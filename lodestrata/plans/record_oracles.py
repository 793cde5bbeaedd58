"""DuckDB SQL for the queries of records: straight from the tables that the pages and documents were made of."""

_SIDES = """b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END AS status FROM orders UNION ALL SELECT o_orderkey, o_custkey, 'X' FROM orders WHERE o_orderkey % 10 = 0),
      a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'U' ELSE status END AS status FROM b WHERE o_orderkey % 7 > 0 UNION ALL SELECT -o_orderkey, o_custkey, 'N' FROM orders WHERE o_orderkey % 3 = 0)"""

_ENTRIES = "(SELECT o_custkey AS l_orderkey, CAST(o_orderkey % 7 + 1 AS INT) AS l_linenumber, o_orderkey AS l_partkey, o_orderkey % 101 AS l_suppkey, CAST(floor(o_totalprice) AS BIGINT) AS l_quantity FROM orders)"

ORACLES = {
    "q71_article_records": """WITH l AS (SELECT *, l_orderkey % 3 AS shape, '第' || l_partkey || CASE WHEN l_linenumber % 6 = 5 THEN '小学东' ELSE '小学' END AS base, CASE WHEN l_orderkey % 3 <> 1 AND l_linenumber % 4 = 0 THEN '东' ELSE '' END AS campus FROM _ENTRIES_)
      SELECT '区' || l_orderkey % 16 AS district, 'primary' AS stage, CASE WHEN campus <> '' AND NOT contains(base, campus) THEN base || '（东校区）' ELSE base END AS name, campus,
        CASE shape WHEN 0 THEN '公办' WHEN 1 THEN '' ELSE '民办' END AS nature, l_suppkey || '路 ' || l_linenumber || '号' AS address,
        CASE WHEN l_orderkey % 2 = 1 THEN '办学情况' WHEN l_orderkey % 4 = 0 THEN '公办小学基本情况' ELSE '初中基本情况' END AS source_title, '/a/' || l_orderkey AS source_url FROM l WHERE l_linenumber % 5 <> 0""",
    "q72_committee_inventory": """WITH l AS (SELECT '学校' || o_custkey AS school, CASE WHEN o_orderstatus <> 'P' THEN l_suppkey % 7 END AS c, CASE WHEN o_orderstatus <> 'P' AND l_orderkey IS NOT NULL THEN 1 END AS one FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)
      SELECT school, false AS is_total, count(one) AS n, count(DISTINCT c) AS n_unique FROM l GROUP BY school UNION ALL SELECT NULL, true, count(one), count(DISTINCT c) FROM l""",
    "q73_faceted_search": """WITH h AS (SELECT *, row_number() OVER (ORDER BY lang DESC, doc_id DESC) AS position FROM documents WHERE lang IN ('en', 'de') AND (contains(lower(text), 'license') OR contains(lower(source), 'license'))),
      c AS (SELECT count(*) AS n_all, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'de') AS n_de, count(*) FILTER (lang = 'fr') AS n_fr, count(*) FILTER (lang = 'es') AS n_es FROM documents),
      v AS (SELECT count(*) AS n_visible, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM h), f AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM h)
      SELECT doc_id, lang, position, CASE WHEN length(flat) > 150 THEN substr(flat, 1, 150) || '...' ELSE flat END AS excerpt, n_all, n_visible, least(2, pages) AS page, pages, n_en, n_de, n_fr, n_es
      FROM f, c, v WHERE position > (least(2, pages) - 1) * 20 AND position <= least(2, pages) * 20""",
    "q74_page_state": r"""SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, '}{"\' || l_suppkey || ']', l_quantity) - 1 AS place, l_partkey AS id, '}{"\' || l_suppkey || ']' AS label, CAST(l_quantity * 100 AS BIGINT) AS cents,
      CAST(l_linenumber AS BIGINT) AS tag FROM _ENTRIES_ WHERE l_orderkey % 5 <> 0""",
    "q75_price_pages": """WITH r AS (SELECT *, p_partkey % 5 > 0 AS has, CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1000 + p_partkey % 1000 ELSE p_partkey + 1 END AS amount FROM part)
      SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type || '&1号' END AS address, CASE WHEN p_partkey % 3 = 0 THEN '静安' ELSE '徐汇' END AS district,
        CASE WHEN has THEN '2026年' || (p_partkey % 12 + 1) || '月' END AS period, CASE WHEN has AND amount > 0 THEN CAST(amount AS BIGINT) END AS price,
        CASE WHEN p_partkey % 11 = 0 THEN 'missing community name' WHEN NOT has THEN 'missing average price block' WHEN amount = 0 THEN 'invalid unit price 0' END AS problem FROM r""",
    "q76_search_results": """SELECT p_partkey, CAST(0 AS BIGINT) AS place, 'https://m.example/community/' || p_partkey || '?city=sh' AS url, p_brand || ' 上海静安区 1号' AS label, '静安' AS district FROM part
      UNION ALL SELECT p_partkey, 1, 'https://m.example/community/' || p_partkey || 'b?a=1&city=sh', 'x', NULL FROM part WHERE p_partkey % 2 = 0""",
    "q77_json_set": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"match":{"score":' || event_id * 2 || '}}' WHEN 2 THEN '{"match":7,"n":' || event_id || '}' WHEN 3 THEN '{"match":{"old":[' || event_id || ',2.5],"score":' || event_id * 2 || '},"z":null}'
      WHEN 4 THEN '{"k":' || (props->>'$.k') || ',"match":{"score":' || event_id * 2 || '}}' END AS scored,
      CASE event_id % 5 WHEN 0 THEN '{"match":{"names":["' || event_type || '"]}}' WHEN 2 THEN '{"match":7,"n":' || event_id || '}' WHEN 3 THEN '{"match":{"names":["' || event_type || '"],"old":[' || event_id || ',2.5],"score":0},"z":null}'
      WHEN 4 THEN '{"k":' || (props->>'$.k') || ',"match":{"names":["' || event_type || '"]}}' END AS named FROM events""",
    "q78_nested_cut": """WITH s AS (SELECT l_orderkey, l_returnflag, count(*) AS n, count(DISTINCT l_linestatus) AS streets, count(*) FILTER (l_linenumber % 2 = 0) AS located, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
      SELECT l_orderkey, count(*) FILTER (k) AS sections, CAST(coalesce(sum(n) FILTER (k), 0) AS BIGINT) AS n_items, CAST(coalesce(sum(streets) FILTER (k), 0) AS BIGINT) AS n_streets, CAST(coalesce(sum(located) FILTER (k), 0) AS BIGINT) AS n_located,
        CAST(coalesce(sum(q) FILTER (k), 0) AS BIGINT) AS quantity FROM (SELECT *, l_returnflag IN ('A', 'R') AS k FROM s) GROUP BY 1""",
    "q79_snapshot": """SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM customer) AS n_rows, (SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS VARCHAR) FROM customer) AS balance, (SELECT count(c_mktsegment) FROM customer) AS n_segments FROM customer GROUP BY 1""",
    "q80_undo_log": f"""WITH {_SIDES}, d AS (SELECT o_orderkey, o_custkey, status, sum(x) AS x FROM (SELECT *, -1 AS x FROM b UNION ALL SELECT *, 1 FROM a) GROUP BY 1, 2, 3 HAVING sum(x) <> 0),
      k AS (SELECT o_orderkey, sum(greatest(x, 0)) AS came, sum(greatest(-x, 0)) AS went FROM d GROUP BY 1)
      SELECT CASE WHEN went = 0 THEN 'insert' WHEN came = 0 THEN 'delete' ELSE 'update' END AS op, count(*) AS n, CAST(sum(came) AS BIGINT) AS came, CAST(sum(went) AS BIGINT) AS went, CAST(0 AS BIGINT) AS n_left FROM k GROUP BY 1""",
    "q81_mapped_rows": """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'unknown' ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'house' WHEN 'AUTOMOBILE' THEN 'garage' WHEN 'MACHINERY' THEN 'plant' WHEN 'HOUSEHOLD' THEN 'home' END END AS kind,
      'from: ' || c_name || CASE WHEN c_custkey % 6 > 0 THEN '; kind: ' || c_mktsegment ELSE '' END || CASE WHEN c_acctbal < 0 THEN '; balance: negative' ELSE '' END AS note FROM customer""",
    "q82_decision_ladder": """WITH x AS (SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS a, (SELECT min(event_id) FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS b,
      (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) AS c FROM customer)
      SELECT c_custkey, CASE WHEN a IS NOT NULL THEN 'direct' WHEN b IS NOT NULL THEN 'search' WHEN c IS NOT NULL THEN 'large' ELSE 'none' END AS reason, coalesce(a, b, c) AS target FROM x""",
    "q83_footer_statistics": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}"
        for t, columns in (("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"), ("documents", "doc_id text lang source n_chars"), ("labels", "doc_id quality toxic"))
        for c in columns.split()
    ),
    "q84_visible_links": """SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F') GROUP BY 1""",
    "q85_audit_view": """WITH e AS (SELECT c_custkey, concat_ws(' ', c_mktsegment, c_nationkey) AS grp, c_acctbal > 9500 AS boundary FROM customer), y AS (SELECT unnest([1996, 1997]) AS year),
      t AS (SELECT grp, count(*) AS total, count(*) FILTER (boundary) AS nb FROM e GROUP BY 1), l AS (SELECT year(o_orderdate) AS year, grp, count(DISTINCT o_custkey) AS n_linked, count(*) AS n_links FROM orders JOIN e ON o_custkey = c_custkey WHERE o_orderkey % 40 = 0 GROUP BY 1, 2),
      c AS (SELECT year(o_orderdate) AS year, grp, count(*) AS n FROM orders JOIN e ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1, 2),
      g AS (SELECT CAST(y.year AS INT) AS year, t.grp, total, nb, coalesce(n_linked, 0) AS n_linked, coalesce(n_links, 0) AS n_links, coalesce(c.n, 0) AS n_candidates FROM t CROSS JOIN y LEFT JOIN l ON l.year = y.year AND l.grp = t.grp LEFT JOIN c ON c.year = y.year AND c.grp = t.grp),
      s AS (SELECT *, CASE WHEN n_linked >= total THEN 'linked' WHEN n_linked > 0 THEN 'partially-linked' WHEN nb > 0 THEN 'boundary-text' ELSE 'missing' END AS status, floor(CAST(n_linked AS DOUBLE) / total * 1000 + 0.5) / 10 AS pct_linked FROM g)
      SELECT year, grp, total, n_linked, status, pct_linked, n_candidates, row_number() OVER (PARTITION BY year ORDER BY list_position(['missing', 'source-found', 'boundary-text', 'partially-linked', 'linked'], status), pct_linked, n_links DESC, grp) AS place FROM s""",
    "q86_alias_search": """SELECT p_partkey, p_name, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 10) || '…' ELSE p_name END AS shown FROM part WHERE p_size > 25
      AND ((p_partkey % 4 > 0 AND len(list_filter(string_split(p_name, ' '), lambda x: x ILIKE '%ING%')) > 0) OR CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END ILIKE '%#3%')
      ORDER BY CASE WHEN p_partkey % 4 > 0 THEN len(string_split(p_name, ' ')) ELSE 0 END DESC, p_partkey LIMIT 300""",
    "q87_group_checks": """WITH g AS (SELECT c_custkey, c_mktsegment, count(DISTINCT CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END) AS n_values, coalesce(bool_and(coalesce(o_orderstatus = 'F', false)), false) AS all_final, count(o_orderkey) AS n_rows
      FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey GROUP BY 1, 2), t AS (SELECT *, n_rows * c_custkey * 1000 AS s FROM g ORDER BY n_rows DESC, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, n_values, c_custkey LIMIT 400),
      u AS (SELECT *, CASE WHEN s >= 1099511627776 THEN 4 WHEN s >= 1073741824 THEN 3 WHEN s >= 1048576 THEN 2 WHEN s >= 1024 THEN 1 ELSE 0 END AS p FROM t), v AS (SELECT *, s / pow(1024, p) AS x FROM u)
      SELECT c_custkey, c_mktsegment, n_values, all_final, n_rows, CASE WHEN p = 0 THEN s || ' B' WHEN x >= 10 THEN printf('%.0f', floor(x + 0.5)) || ' ' || ['KB', 'MB', 'GB', 'TB'][p] ELSE printf('%.1f', floor(x * 10 + 0.5) / 10) || ' ' || ['KB', 'MB', 'GB', 'TB'][p] END AS size,
        format('{:,}', s) AS label FROM v""",
    "q88_boundary_collection": """SELECT '{"type":"Feature","properties":{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"},"geometry":{"type":"Polygon","coordinates":[[[' || n_nationkey || ',0],[' || n_nationkey + 1 || ',0],[' || n_nationkey || ',1],[' || n_nationkey || ',0]]]}}' AS feature,
      count(*) AS n_entities FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY 1""",
    "q89_index_sources": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE l_linenumber % 3 WHEN 2 THEN 1 ELSE 0 END) AS p, CASE l_linenumber % 3 WHEN 0 THEN '静安' WHEN 1 THEN '浦东' END AS own FROM _ENTRIES_),
      c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS district, (l_partkey % 3 + 2024) AS y, l_suppkey % 2 = 0 AS scope FROM l)
      SELECT DISTINCT l_orderkey, CAST(y AS INT) AS year, district, y || '年公办小学' || CASE WHEN scope THEN '划片' ELSE '学校一览' END AS title,
        CASE WHEN l_linenumber % 2 = 0 THEN 'https://h.example/a/d/' || l_suppkey % 4 ELSE 'https://h.example/a/b/c.html?id=' || l_suppkey % 4 END AS url, CASE WHEN scope THEN 'primary-scope' ELSE 'school-list' END AS category, 'high' AS confidence FROM c WHERE district IS NOT NULL
      UNION SELECT DISTINCT l_orderkey, 2026, district, '别的', 'https://h.example/w', 'other', 'high' FROM c WHERE district IS NOT NULL""",
    "q90_payloads": """WITH l AS (SELECT *, CASE WHEN l_orderkey % 19 = 0 THEN 'body must be a JSON object' WHEN l_orderkey % 13 = 0 THEN 'sourceKey must match ^[a-z0-9._-]{1,64}$' WHEN l_orderkey % 17 = 0 THEN 'sourceName is required'
      WHEN l_orderkey % 11 = 0 THEN 'records[0].schoolId must be a positive integer' END AS error FROM _ENTRIES_)
      SELECT 'ok' AS outcome, CAST(1998 + l_linenumber AS INT) AS year, count(*) AS n, CAST(sum(l_partkey + 1) AS BIGINT) AS schools, count(*) AS quoted FROM l WHERE error IS NULL AND l_linenumber > 2 GROUP BY 2
      UNION ALL SELECT error, NULL, count(DISTINCT l_orderkey), NULL, NULL FROM l WHERE error IS NOT NULL GROUP BY 1""",
}

ORACLES = {name: sql.replace("_ENTRIES_", _ENTRIES) for name, sql in ORACLES.items()}
