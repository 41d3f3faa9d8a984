"""DuckDB SQL for operators whose modules don't hold it: brute force over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

MINHASH_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || chr(10) || ws[i + 1]) END) AS g FROM w
), n AS (
  SELECT w.doc_id, count(s.g)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id, n.doc_id = min(reach.b) AS kept
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.c AS component_id, v.vec_id = least.c AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 34], chr(10)) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1
), word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), mark AS (
  SELECT word.doc_id, word.i, word,
         max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.i = word.i
)
SELECT w.doc_id, count(mark.i)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN mark ON mark.doc_id = w.doc_id GROUP BY w.doc_id
"""

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Expectation-maximisation as a recursion over one row: the vote patterns and the model.
QUALITY_RULES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (
    SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))
), cov AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE c > 1) GROUP BY doc_id
), line AS (
  SELECT doc_id, len(ls) - len(list_distinct(ls)) AS n FROM (
    SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: length(trim(x, {_BLANK})) > 0) AS ls FROM d)
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, line.n::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(string_split(t, chr(10))) AS n_lines, len(regexp_extract_all(t, '\\p{{L}}')) AS n_letters, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper
  FROM d JOIN line USING (doc_id) LEFT JOIN cov USING (doc_id)
), r AS (
  SELECT *, word_chars::DOUBLE / greatest(n_words, 1) AS mean, n_symbols::DOUBLE / greatest(n_words, 1) AS sym,
         n_symbols::DOUBLE / greatest(word_chars, 1) AS share, n_letters::DOUBLE / greatest(word_chars, 1) AS letters,
         n_dup_lines::DOUBLE / n_lines AS dup, n_repeat_words::DOUBLE / greatest(n_words, 1) AS rep, n_upper::DOUBLE / greatest(n_letters, 1) AS up FROM m
), voted AS (
  SELECT *, [CASE WHEN n_words < 100 THEN 0 WHEN n_words >= 200 THEN 1 ELSE -1 END,
    CASE WHEN mean < 2 OR mean > 15 THEN 0 WHEN mean BETWEEN 3 AND 10 THEN 1 ELSE -1 END,
    CASE WHEN mean < 3.5 OR mean > 10 THEN 0 WHEN mean BETWEEN 4 AND 9 THEN 1 ELSE -1 END,
    CASE WHEN sym > 0.1 THEN 0 WHEN sym <= 0.02 THEN 1 ELSE -1 END,
    CASE WHEN share > 0.03 THEN 0 WHEN share <= 0.005 THEN 1 ELSE -1 END,
    CASE WHEN letters < 0.8 THEN 0 WHEN letters >= 0.9 THEN 1 ELSE -1 END,
    CASE WHEN n_dup_lines >= 3 AND dup > 0.3 THEN 0 WHEN dup = 0 THEN 1 ELSE -1 END,
    CASE WHEN n_dup_lines >= 1 THEN 0 ELSE 1 END,
    CASE WHEN rep > 0.3 THEN 0 WHEN rep <= 0.1 THEN 1 ELSE -1 END,
    CASE WHEN rep > 0.2 THEN 0 WHEN rep <= 0.05 THEN 1 ELSE -1 END,
    CASE WHEN up > 0.5 THEN 0 WHEN up <= 0.15 THEN 1 ELSE -1 END,
    CASE WHEN up > 0.2 THEN 0 WHEN up <= 0.1 THEN 1 ELSE -1 END] AS v FROM r
), pat AS (
  SELECT list(struct_pack(v := v, n := n) ORDER BY v) AS t FROM (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v)
), em(round, c, g, b) AS (
  SELECT 0, 1.0::DOUBLE, list_transform(range(12), lambda j: 0.1::DOUBLE), list_transform(range(12), lambda j: -2.0::DOUBLE)
  UNION ALL
  SELECT round + 1, ln((list_sum(q) + 1) / (total - list_sum(q) + 1)),
         list_transform(ab, lambda x: ln(x.a / (1 - x.b))), list_transform(ab, lambda x: ln((1 - x.a) / x.b))
  FROM (
    SELECT round, q, total, list_transform(rb, lambda x: struct_pack(a := x.a, b := greatest(x.b, 1 - x.a))) AS ab FROM (
      SELECT round, q, total, list_transform(range(1, 13), lambda j: struct_pack(
        a := (list_sum(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].v[j] = 1 THEN q[i] ELSE 0 END)) + 1)
             / (list_sum(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].v[j] >= 0 THEN q[i] ELSE 0 END)) + 2),
        b := (list_sum(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].v[j] = 0 THEN t[i].n - q[i] ELSE 0 END)) + 1)
             / (list_sum(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].v[j] >= 0 THEN t[i].n - q[i] ELSE 0 END)) + 2))) AS rb, t
      FROM (
        SELECT em.round, pat.t, list_sum(list_transform(pat.t, lambda p: p.n)) AS total,
               list_transform(pat.t, lambda p: p.n / (1 + exp(-(em.c + list_sum(list_transform(range(1, 13), lambda j:
                 CASE p.v[j] WHEN 1 THEN em.g[j] WHEN 0 THEN em.b[j] ELSE 0 END)))))) AS q
        FROM em, pat WHERE em.round < 30)))
), model AS (SELECT c, g, b FROM em WHERE round = 30)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND odds >= 0 AS kept FROM (
  SELECT voted.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         model.c + list_sum(list_transform(range(1, 13), lambda j: CASE v[j] WHEN 1 THEN model.g[j] WHEN 0 THEN model.b[j] ELSE 0 END)) AS odds
  FROM voted, model)
"""
