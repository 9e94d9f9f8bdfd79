"""The same questions in DuckDB's SQL, for the operators that SQL can express."""

PII = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
  (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  (3, 'card', '[0-9](?:[\x20-]?[0-9])+'),
  (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (5, 'iban', '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?'),
  (6, 'ssn', '[0-9]{3}-[0-9]{2}-[0-9]{4}'),
  (7, 'localphone', '\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}')) v(kid, kind, re)),
raw AS (SELECT doc_id, kid, kind, regexp_extract_all(t, re) AS m, string_split_regex(t, re) AS g FROM d, k WHERE regexp_matches(t, re)),
one AS (SELECT doc_id, kid, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM raw),
spots AS (
  SELECT doc_id, kid, kind, m[i] AS s,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b
  FROM one),
placed AS (SELECT p.*, substr(t, CAST(greatest(b - 40, 0) AS BIGINT) + 1, CAST(least(b, 40) AS BIGINT)) AS before,
    substr(t, CAST(b + length(s) AS BIGINT) + 1, 40) AS after FROM spots p JOIN d USING (doc_id)),
dig AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS n,
    lower(before || '|' || after) AS near,
    regexp_matches(right(before, 1), '[A-Za-z0-9]') OR regexp_matches(left(after, 1), '[A-Za-z0-9]') AS touched FROM placed),
ok AS (SELECT * FROM dig WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS BIGINT), 0) > 255)) = 0
  WHEN 'card' THEN length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda p:
      CASE WHEN p % 2 = 1 THEN CAST(substr(reverse(n), p, 1) AS INT)
           ELSE CAST(substr('0246813579', CAST(substr(reverse(n), p, 1) AS INT) + 1, 1) AS INT) END)) % 10 = 0
  WHEN 'phone' THEN length(n) BETWEEN 9 AND 15
  WHEN 'iban' THEN NOT touched AND length(replace(s, ' ', '')) BETWEEN 15 AND 34 AND
      list_reduce(list_prepend(0, list_transform(string_split(substr(replace(s, ' ', ''), 5) || left(replace(s, ' ', ''), 4), ''),
        lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)),
        lambda a, v: CASE WHEN v > 9 THEN a * 100 + v ELSE a * 10 + v END % 97) = 1
  WHEN 'ssn' THEN NOT touched AND regexp_matches(near, 'ssn|social security|tax id')
  ELSE NOT touched AND regexp_matches(near, 'phone|tel|call|mobile|fax') END),
spans AS (SELECT doc_id, kid, b, kind, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + length(s) AS BIGINT) AS span FROM ok),
agg AS (SELECT doc_id, count(*) FILTER (kid = 1) AS n_email, count(*) FILTER (kid = 2) AS n_ip, count(*) FILTER (kid = 3) AS n_card,
    count(*) FILTER (kid = 4) AS n_phone,
    string_agg(span, ',' ORDER BY kid, b) FILTER (kid <= 4) AS base, string_agg(span, ',' ORDER BY kid, b) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)
"""

LEAKS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) - 4 AS m, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM d WHERE len(w) >= 5
  UNION ALL SELECT doc_id, 1, [array_to_string(w, ' ')] FROM d WHERE len(w) BETWEEN 1 AND 4),
bs AS (SELECT item_id, len(w) - 4 AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM b WHERE len(w) >= 5
  UNION ALL SELECT item_id, 1, [array_to_string(w, ' ')] FROM b WHERE len(w) BETWEEN 1 AND 4),
de AS (SELECT doc_id, m, unnest(range(0, len(s))) AS pos, unnest(s) AS h FROM ds),
be AS (SELECT item_id, n, h, count(*) AS c FROM (SELECT item_id, n, unnest(s) AS h FROM bs) GROUP BY ALL),
hits AS (SELECT doc_id, item_id, m, n, c, pos, h FROM de JOIN be USING (h)),
starts AS (SELECT DISTINCT doc_id, item_id, m, n, least(pos, greatest(m - n, 0)) AS start FROM hits),
parts AS (SELECT s.doc_id, s.item_id, s.m, s.n, s.start, x.h, least(count(*), any_value(x.c)) AS o
  FROM starts s JOIN hits x ON s.doc_id = x.doc_id AND s.item_id = x.item_id AND x.pos >= s.start AND x.pos < s.start + s.n GROUP BY ALL),
sims AS (SELECT doc_id, item_id, start, sum(o) / (n + least(m, n) - sum(o)) AS similarity FROM parts GROUP BY doc_id, item_id, start, m, n)
SELECT doc_id, item_id, CAST(max(similarity) AS DOUBLE) AS similarity FROM sims GROUP BY doc_id, item_id HAVING max(similarity) >= 0.8
"""

REPEATS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
hit AS (SELECT DISTINCT doc_id, i FROM v JOIN f USING (h) WHERE v.doc_id > f.least),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, 50) r(k)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
agg AS (SELECT x.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept
  FROM words x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN agg USING (doc_id)
"""

MIDDLES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

LINES = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
g AS (SELECT k.*, coalesce(k.doc_id > f.first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
