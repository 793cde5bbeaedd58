"""DuckDB SQL for the queries of rules: what each made name, label or value has to give, written out."""


def _pick(number: str, *values: str | None) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][CAST({number} % {len(values)} AS INT) + 1]"


ORACLES = {
    "q91_district_names": f"""SELECT c_custkey, {_pick("c_custkey", "浦东", "浦东", "静安", "静安", "宝山", "宝山", "徐汇", "外地", None)} AS key, {_pick("c_custkey", "浦东", "浦东", "静安", "静安", None, None, "徐汇", None, None)} AS in_scope,
      {_pick("c_custkey", "浦东新区", "浦东新区", "静安区", "静安区", " 宝山区　", "宝山", "徐汇区", "外地", None)} AS label, {_pick("c_custkey", "浦东新", "浦东", "静安", "静安", "宝山区", "宝山", "徐汇", "外地", None)} AS bare,
      {_pick("c_custkey", "浦东新", "浦东", "静安", None, "宝山", None, "徐汇", None, None)} AS in_label, CASE WHEN c_custkey % 9 < 8 THEN c_custkey % 9 < 4 END AS stored FROM customer""",
    "q92_name_keys": """SELECT p_partkey, '徐汇' || p_partkey AS poi, '园西A' || p_partkey || '小学南桥' AS source, CAST(p_partkey AS VARCHAR) AS feeder, CASE p_partkey % 4 WHEN 2 THEN '东' || p_partkey WHEN 3 THEN p_partkey || '校区部' ELSE '' END AS campus,
      '漕东支路' || p_partkey || '号' AS address, p_partkey || '小学东区' AS school, p_partkey || '学校小学部|' || p_partkey || '学校' AS variants, sha256(p_name) AS hash, '东' || p_partkey AS cut, '标签' || p_partkey || '|b' AS tags FROM part""",
    "q93_label_rules": f"""WITH r AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS even, p_partkey % 3 <> 2 AND p_partkey % 2 = 0 AS official FROM part)
      SELECT k AS p_partkey, CASE WHEN k % 9 < 2 THEN CASE WHEN even THEN '未分级' ELSE '待补' END ELSE ['一', '二', '三', '四'][CAST(least(k % 9 - 1, 4) AS INT)] || '梯队' END AS tier,
        CASE WHEN k % 3 = 0 THEN '官方招生区域' WHEN even THEN '住宅小区关系' ELSE '来源收录关系' END AS kind, CASE WHEN k % 3 = 0 THEN '待核验' WHEN even THEN '已审核' WHEN k % 5 = 0 THEN '部分匹配' ELSE '来源收录' END AS status,
        k % 5 IN (0, 2) AS residential, CASE WHEN k % 4 = 1 THEN 'primary' WHEN k % 4 = 3 THEN 'unknown' ELSE 'middle' END AS stage,
        CASE k % 4 WHEN 0 THEN length('漕东路' || k) >= 3 WHEN 2 THEN length('村' || k) >= 3 ELSE false END AS address,
        k || '-amap-' || CASE WHEN even THEN '20260711-12000' || k % 10 ELSE 'unknown-source' END AS run, k || '/1000 (' || CASE WHEN even THEN CAST(k // 2 AS VARCHAR) ELSE (k // 2) || '.5' END || '%)' AS metric,
        CASE WHEN k % 7 = 0 THEN 'school/community district mismatch' WHEN NOT official THEN 'non-official source' WHEN k % 4 = 0 THEN 'community name is not an explicit official enrollment-area entity'
          WHEN k % 5 = 0 THEN 'official quote does not contain complete community name' ELSE 'official quote explicitly contains complete official enrollment-area name' END AS reason, official FROM r""",
    "q94_row_edits": """SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'Renamed' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey = 5 THEN 12.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (1, 2, 7)
      UNION ALL SELECT max(c_custkey) + 1, 'New one', 3, NULL, NULL FROM customer""",
    "q95_value_rules": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 't' || event_id WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'l' || event_id WHEN 4 THEN 'true' END AS shown,
      CASE WHEN event_id % 2 = 0 THEN '一' || event_id || '；二；三' ELSE 'many words ' || event_id END AS summary, CASE WHEN event_id % 3 = 1 THEN 'b' ELSE 'a' || event_id % 3 || '|b' END AS aliases, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 6 END::BIGINT AS size,
      CASE event_id % 3 WHEN 0 THEN (event_id % 90) * 10000.0 + 5000 WHEN 1 THEN event_id * 10000.0 ELSE event_id * 1.0 END::DOUBLE AS likes, CASE WHEN event_id % 4 > 1 THEN (event_id + 1) * 1000.0 END::DOUBLE AS price FROM events""",
}
