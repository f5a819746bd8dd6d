"""DuckDB SQL for the operators that SQL can express: brute force over all pairs or all strings."""

from __future__ import annotations

#: Of nodes n (id) and links l (x, y, in both directions), the least id that each reaches.
REACHED = "r AS (SELECT id, id AS m FROM n UNION SELECT l.x, r.m FROM r JOIN l ON l.y = r.id), c AS (SELECT id, min(m) AS component_id FROM r GROUP BY id)"

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
 l AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
 n AS (SELECT vec_id AS id FROM embeddings), {REACHED}, k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
 SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN k ON k.x = vec_id"""

SHINGLES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS shingle FROM w),
 k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM i JOIN k a ON a.doc_id = x JOIN k b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)), n AS (SELECT doc_id AS id FROM documents), {REACHED}
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""

STRINGS = """WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
 p AS (SELECT doc_id, unnest(range(CAST(length(h) // 2 - 399 AS BIGINT))) AS i FROM d WHERE length(h) >= 800), g AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS s FROM p JOIN d USING (doc_id)),
 t AS (SELECT doc_id, i FROM g JOIN (SELECT s FROM g GROUP BY s HAVING count(*) > 1) USING (s)),
 b AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS first FROM t), o AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b),
 r AS (SELECT doc_id, span, min(i) AS low, max(i) + 400 AS high FROM o GROUP BY ALL), f AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM r),
 x AS (SELECT doc_id, count(*) AS n, CAST(sum(high - low) AS BIGINT) AS gone, max(high) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (low - before) AS BIGINT)), '' ORDER BY low) AS kept FROM f JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256, n IS NOT NULL AS touched FROM d LEFT JOIN x ON x.doc_id = d.doc_id"""

COUNTS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
 p AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times FROM p),
 m AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(3) r(k) WHERE times > 1 GROUP BY doc_id),
 c AS (SELECT w.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN m ON m.doc_id = w.doc_id)
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""

RULES = """WITH u AS (SELECT page_id, contains(url, '://') AS ok, substr(url, instr(url, '://') + 3) AS rest FROM pages),
 p AS (SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
 r AS (SELECT *, '.' || host AS h, CASE WHEN h LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7' WHEN h LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
  WHEN h LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/' WHEN h LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/' WHEN h LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM p)
 SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM r"""

ORACLE_SQL = {"quality_counts": COUNTS, "url_rules": RULES, "op3_embedding_dedup": EMBEDDINGS, "op4_suffix_dedup": STRINGS, "op10_ngram_jaccard": SHINGLES}
