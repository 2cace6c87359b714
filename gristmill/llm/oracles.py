"""DuckDB SQL of those queries that SQL can express."""

from .spotsigs import ANCHORS

_OP2 = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM items WHERE len(words) > 0)
), grams AS (
  SELECT id, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram
  FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)
), found AS (
  SELECT id, i, n, item_id FROM grams JOIN windows USING (n, gram)
), hit AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM found) GROUP BY id
), named AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY id
)
SELECT w.id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON hit.id = w.id LEFT JOIN named ON named.id = w.id
"""

_OP3 = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), best AS (
  SELECT host, path, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(verdict, len(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""

_OP4 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)
), f AS (
  SELECT k, min(doc_id * 1000000000 + i) AS first FROM g GROUP BY k HAVING count(*) > 1
), dup AS (
  SELECT doc_id, i FROM g JOIN f USING (k) WHERE doc_id * 1000000000 + i > first
), islands AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM dup)
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM islands GROUP BY doc_id, r
), gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM runs
), cut AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

_OP5 = """
WITH rows AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), last AS (
  SELECT digest, max(page_id) AS last FROM rows WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS DISTINCT FROM last AND n >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last AND n >= 1000 THEN last END AS refers_to
FROM rows LEFT JOIN last USING (digest)
"""

_ANCHORS = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))

_NEAR_CLASSES = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS words FROM documents
), c AS (
  SELECT doc_id, words, list_filter(words, lambda x: NOT list_contains([{_ANCHORS}], x)) AS content FROM w
), p AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM c
), a AS (
  SELECT doc_id, pos, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j FROM p WHERE word IN ({_ANCHORS})
), s AS (
  SELECT DISTINCT doc_id, word || '|' || content[pos - j + 1] || coalesce('|' || content[pos - j + 2], '') AS sig
  FROM a JOIN c USING (doc_id) WHERE content[pos - j + 1] IS NOT NULL
), all_sigs AS (
  SELECT * FROM s UNION ALL SELECT doc_id, '=' || array_to_string(words, ' ') FROM c WHERE len(words) > 0 AND doc_id NOT IN (SELECT doc_id FROM s)
), sets AS (
  SELECT d.doc_id, coalesce(list(sig ORDER BY sig) FILTER (WHERE sig IS NOT NULL), []) AS sigs FROM documents d LEFT JOIN all_sigs USING (doc_id) GROUP BY d.doc_id
), classes AS (
  SELECT sigs, min(doc_id) AS class_id, len(sigs) AS n FROM sets GROUP BY sigs
), e AS (
  SELECT class_id, n, unnest(sigs) AS sig FROM classes
), shared AS (
  SELECT x.class_id, x.n AS n, y.n AS m, count(*) AS k FROM e x JOIN e y ON x.sig = y.sig AND x.class_id <> y.class_id GROUP BY x.class_id, y.class_id, x.n, y.n
), links AS (
  SELECT class_id, count(*) AS n_links FROM shared WHERE k / (n + m - k) >= 0.8 GROUP BY class_id
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM sets JOIN classes USING (sigs) LEFT JOIN links USING (class_id)
"""

ORACLES = {"spotsigs_near_classes": _NEAR_CLASSES, "op2_decontamination": _OP2, "op3_url_filter": _OP3, "op4_suffix_dedup": _OP4, "op5_warc": _OP5}
