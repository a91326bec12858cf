"""SQL that gives the results of queries of this subpackage, for those that SQL can express."""

GRID_JOIN = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, body, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h || '00', (5 * i // 4 + 1)::INT, 3))::INT >> (7 - 5 * i % 4)::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""

LINE_RULES = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS w,
    unnest(range(1, len(words) - 1)) AS i FROM t WHERE len(words) > 2),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT k)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, host, body, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN covered USING (doc_id)),
line AS (
  SELECT doc_id, host, body, unnest(list_transform(lines, lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))))) AS line FROM t),
size AS (SELECT host, count(DISTINCT body) AS texts FROM t GROUP BY host),
often AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT body) AS n FROM line GROUP BY host, line) JOIN size USING (host)
  WHERE n >= 20 AND n >= texts * 0.1::DOUBLE),
lost AS (
  SELECT doc_id, sum(len(string_split(line, ' ')))::BIGINT AS w, count(*)::BIGINT AS k FROM line JOIN often USING (host, line) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(w, 0) >= n_words * 0.5::DOUBLE AS kept,
  coalesce(k, 0)::BIGINT AS n_lines_removed, (n_words - coalesce(w, 0))::BIGINT AS words_left
FROM m LEFT JOIN lost USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
starts AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
first AS (SELECT g, min(doc_id) AS m FROM starts GROUP BY g),
hit AS (SELECT doc_id, i FROM starts JOIN first USING (g) WHERE m < doc_id),
edge AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, r, min(i) AS s, max(i) + 50 AS e FROM run GROUP BY doc_id, r),
gap AS (
  SELECT doc_id, coalesce(lag(e) OVER w, 0) AS a, s AS b FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT d.doc_id, coalesce(max(e), 0), any_value(n) FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('11:' || coalesce(doc_id::VARCHAR, '')) AS mark,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, no % 3 + 1 AS weight, 3 * size AS cap FROM s),
round(i, rest, open) AS (
  SELECT 0, sum(size)::BIGINT, sum(weight)::BIGINT FROM w
  UNION ALL
  SELECT i + 1, (SELECT sum(size)::BIGINT FROM w) - coalesce(sum(cap) FILTER (weight * rest >= cap * open), 0)::BIGINT,
    (SELECT sum(weight)::BIGINT FROM w) - coalesce(sum(weight) FILTER (weight * rest >= cap * open), 0)::BIGINT
  FROM round, w WHERE i < 40 GROUP BY i, rest, open),
share AS (SELECT rest, open FROM round ORDER BY i DESC LIMIT 1),
aim AS (
  SELECT source, no, size, CASE WHEN weight * rest >= cap * greatest(open, 1) THEN cap::DOUBLE
    ELSE weight::DOUBLE * rest::DOUBLE / greatest(open, 1)::DOUBLE END AS target FROM w, share),
quotient AS (
  SELECT no, target / (2 * j - 1) AS q, j FROM (SELECT no, target, unnest(range(1, 3 * ((size + 15) // 16) + 1)) AS j FROM aim)),
quota AS (
  SELECT no, count(*) AS blocks FROM (SELECT no FROM quotient WHERE q > 0 ORDER BY q DESC, no, j
    LIMIT (SELECT (sum(size)::BIGINT + 8) // 16 FROM s)) GROUP BY no),
cell AS (
  SELECT no, source, shard, words, sum(words) OVER (PARTITION BY no ORDER BY shard) - words AS start FROM (
    SELECT no, s.source, ('0x' || mark[1:2])::INT AS shard, sum(d.size)::BIGINT AS words
    FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL)),
block AS (
  SELECT no, source, shard, b, b - min(b) OVER (PARTITION BY no, shard) AS i, count(*) OVER (PARTITION BY no, shard) AS n FROM (
    SELECT no, source, shard, unnest(range((start::BIGINT + 15) // 16, (start::BIGINT + words + 15) // 16)) AS b FROM cell)),
own AS (
  SELECT no, shard, count(*) AS won FROM (
    SELECT no, shard, row_number() OVER (PARTITION BY no ORDER BY n / (2 * j - 1) DESC, shard, j) AS place FROM (
      SELECT no, shard, n, unnest(range(1, 3 * n + 1)) AS j FROM (SELECT DISTINCT no, shard, n FROM block)))
  JOIN quota USING (no) WHERE place <= blocks GROUP BY no, shard),
times AS (
  SELECT no, b, won // n + (i + turn + 1) * (won % n) // n - (i + turn) * (won % n) // n AS times FROM (
    SELECT no, b, i, n, coalesce(won, 0) AS won, ('0x' || md5('11:' || coalesce(source, '') || ':' || shard)[1:8])::BIGINT % n AS turn
    FROM block LEFT JOIN own USING (no, shard))),
place AS (
  SELECT doc_id, no, d.size, s.size AS source_size,
    sum(d.size) OVER (PARTITION BY no ORDER BY mark, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS pos
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
part AS (
  SELECT doc_id, no, size, pos, unnest(range(pos // 16, (pos + size + 15) // 16)) AS b FROM place WHERE size > 0),
got AS (
  SELECT doc_id, no, size, pos, sum(times * (least(pos + size, 16 * b + 16) - greatest(pos, 16 * b)))::BIGINT AS taken
  FROM part JOIN times USING (no, b) GROUP BY doc_id, no, size, pos)
SELECT p.doc_id, p.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, aim.source
FROM place p JOIN aim ON aim.no = p.no LEFT JOIN got g ON g.doc_id IS NOT DISTINCT FROM p.doc_id AND g.no = p.no AND g.pos = p.pos AND g.size = p.size
"""

VARIANTS = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY ALL),
code AS (
  SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM own),
step(w, n, h, i, c) AS (
  SELECT w, n, h, 0, 4294967295::BIGINT FROM code
  UNION ALL
  SELECT w, n, h, i + 1, xor(t[(xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) & 255) + 1], c >> 8) FROM step, crc WHERE 2 * i < length(h)),
hashed AS (SELECT w, n, xor(c, 4294967295) AS c FROM step WHERE 2 * i = length(h)),
words AS (
  SELECT CASE WHEN c % 31 = 0 THEN substr(w, 1, (c % length(w))::INT) || substr(w, (c % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM words GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
part AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pair AS (
  SELECT a.word, b.word AS other, b.n AS m FROM part a JOIN part b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, v.word, v.n FROM part a JOIN v ON a.key = v.word
  UNION ALL SELECT v.word, a.word, a.n FROM part a JOIN v ON a.key = v.word),
near AS (SELECT DISTINCT word, other, m FROM pair),
best AS (
  SELECT word, count(*)::BIGINT AS n_near, max(m) AS m FROM near GROUP BY word),
form AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * v.n THEN m END AS form_n,
    CASE WHEN m >= 10 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND near.m = best.m) END AS form
  FROM v LEFT JOIN best USING (word)),
walk(word, root) AS (
  SELECT word, word FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NOT NULL),
last AS (SELECT walk.word, root FROM walk JOIN form ON form.word = root WHERE form.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN last USING (word)
"""
