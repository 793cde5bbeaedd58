"""DuckDB SQL for the queries that SQL can express on whole tables."""

ORACLES = {
    "op8_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
""",
    "op11_secrets": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), patterns(kind, name, p) AS (VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'),
  (2, 'hex', '[0-9a-f]+'),
  (3, 'identifier', '(?:ASIA|AROA|AIDA)[A-Z0-9]{16,}|(?i:user|user[_-]?name|user[_-]?id|login|client[_-]?id|account[_-]?id|tenant[_-]?id|access[_-]?key[_-]?id)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._+-]{3,}'),
  (4, 'credential', '[a-z][a-z0-9+]{1,14}://[^\t-\r "''<>:/@]+:[^\t-\r "''<>@]+@[^\t-\r "''<>]+|(?i:pwd|pass|passphrase|auth|credentials?|private[_-]?key|secret[_-]?access[_-]?key|signature|token|password|passwd|secret|api[_-]?key)["'']?\x20*[:=]\x20*["'']?[^\t-\r "'',;:=]{4,}|[A-Za-z0-9+/_-]{20,}={0,2}'),
  (5, 'endpoint', '[a-z][a-z0-9+]{1,14}://[^\t-\r "''<>]{4,}|(?i:host|hostname|endpoint|server|database|bucket)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9._:/-]{3,}')
), cut AS (
  SELECT id, kind, name, string_split_regex(text, p) AS pieces, list_append(regexp_extract_all(text, p), NULL) AS found
  FROM d, patterns WHERE regexp_matches(text, p)
), listed AS (
  SELECT id, kind, name, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS piece, unnest(found) AS m FROM cut
), placed AS (
  SELECT id, kind, name, m,
         sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
         sum(len(regexp_extract_all(piece, '\n[ \t\r]*\n'))) OVER w AS block
  FROM listed WINDOW w AS (PARTITION BY id, kind ORDER BY i)
), parts AS (
  SELECT id, kind, name, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, block FROM placed
  WHERE m IS NOT NULL AND CASE kind
    WHEN 0 THEN length(regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 6
    WHEN 1 THEN length(m) >= 20
    WHEN 2 THEN length(m) >= 24
    WHEN 4 THEN NOT regexp_matches(m, '^[A-Za-z0-9+/_-]+={0,2}$') OR (regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]'))
    ELSE true END
), own AS (
  SELECT * FROM parts p WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM parts b WHERE b.id = p.id AND b.kind < 3 AND b.s <= p.s AND p.s < b.e)
), pairs AS (
  SELECT a.id, a.kind AS kind1, a.s AS s1, b.kind AS kind2, b.s AS s2
  FROM own a JOIN own b ON a.id = b.id AND a.block = b.block AND a.kind IN (0, 2, 4) AND b.kind IN (1, 3, 5) AND b.s BETWEEN a.s - 240 AND a.e + 240
), spans AS (
  SELECT id, kind, name, s, e FROM own o
  WHERE kind < 3 OR EXISTS (SELECT 1 FROM pairs q WHERE q.id = o.id AND (q.kind1 = o.kind AND q.s1 = o.s OR q.kind2 = o.kind AND q.s2 = o.s))
)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN spans USING (id) GROUP BY id, doc_id
""",
    "op12_phrases": r"""
WITH pieces AS (
  SELECT lang, [x for x in string_split_regex(piece, '[ \t]+') if x <> ''] AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), places AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k)
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM places
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS c FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.c, x.f AS l, y.f AS r, CAST(c.a AS HUGEINT) * 2000000 // (x.f + y.f) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.c], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.c + 1 : c.k], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_spans AS (
  SELECT lang, a, k, w, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k
), longest AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM inner_spans GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longest i USING (lang, phrase) WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
