"""DuckDB SQL for the queries that SQL can express."""

SQL = {}

SQL["op5_benchmark_decontamination"] = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'b', item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL
), b AS (
  SELECT DISTINCT id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i+least(5, len(w))-1], ' '))) AS g FROM w WHERE side = 'b' AND len(w) > 0
), d AS (
  SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM w, (SELECT DISTINCT k FROM b) WHERE side = 'd' AND len(w) >= k
), n AS (SELECT id AS item_id, count(*) AS n_item FROM b GROUP BY id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (k, g) GROUP BY 1, 2)
JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 80
"""

SQL["op9_url_filters"] = r"""
WITH p AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT p.*, (SELECT arg_max(struct_pack(rule := rh || rp, v := v), length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS hit FROM p
)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.v, 'allow') AS verdict FROM m
"""

SQL["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT u.b, c.r FROM c JOIN u ON u.a = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.r AS component_id, d.doc_id = c.r AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS r FROM c GROUP BY 1) c USING (doc_id)
"""

SQL["op8_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(role) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

SQL["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS s FROM documents
), h AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

SQL["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS m
  FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY 1, 2
), x(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (SELECT a.k || b.k || c.k || d.k || e.k AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (SELECT o, i AS step, o[i] AS k, o[1:i-1] AS before FROM o, range(1, 6) r(i)
), p AS (SELECT DISTINCT part FROM c
), r AS (
  SELECT p.part, s.o AS filter_order, s.step, s.k,
         coalesce(sum(n) FILTER (translate(m, before || k, '') = m), 0) AS kept,
         coalesce(sum(n) FILTER (contains(m, k) AND translate(m, before, '') = m), 0) AS removed,
         coalesce(sum(n) FILTER (contains(m, k) AND translate(m, before, '') <> m), 0) AS redundant,
         coalesce(sum(n) FILTER (m = k), 0) AS unique_fails,
         coalesce(sum(good) FILTER (contains(m, k) AND translate(m, before, '') = m), 0) AS good_lost,
         coalesce(sum(bad) FILTER (contains(m, k) AND translate(m, before, '') = m), 0) AS toxic_lost
  FROM p, s, c WHERE c.part = p.part GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM r
"""
