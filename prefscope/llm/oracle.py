"""DuckDB SQL for the queries that SQL can express. Its constants are written
out here and not taken from the operators."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = """
WITH g AS (
  SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size
  FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.t
"""

OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lined AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
windows AS (
  SELECT r, i, w[i : i + 7] AS k
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
often AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows),
hit AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM often WHERE c > 1) GROUP BY r),
m AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(hit.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lined USING (r) LEFT JOIN hit USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS x FROM f GROUP BY 1),
s AS (
  SELECT sum(n)::DOUBLE AS big, count(*) AS k, sum(n::DOUBLE * n) AS n2, sum(x) / sum(n)::DOUBLE AS m,
         sum(x::DOUBLE * x / n) AS fp FROM h),
t AS (
  SELECT m, big - n2 / big - (k - 1) AS room, fp - big * m * m - (k - 1) * m * (1 - m) AS spread FROM s),
p AS (
  SELECT m, CASE WHEN room > 0 AND spread > 0 THEN greatest(m * (1 - m) * room / spread - 1, 0) END AS b FROM t),
rate AS (SELECT source, coalesce((x + b * m) / (n + b), m) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN rate ON f.source IS NOT DISTINCT FROM rate.source
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, {WORDS} AS w FROM documents),
q AS (
  SELECT doc_id, source, len(w)::BIGINT AS size,
         -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
             / 4503599627370496.0)
         / CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 1.0 END AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM q GROUP BY source),
level AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (
               ORDER BY 3 * source_size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (SELECT source, source_size, least(3.0 * source_size, max(level) OVER () * weight)::DOUBLE AS target FROM level),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM t),
o AS (
  SELECT q.doc_id, q.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
         coalesce(sum(q.size) OVER (PARTITION BY q.source ORDER BY key, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM q JOIN e ON q.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN budget - start >= size / 2.0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""

# Licence sentences that stand for a licence alone; the documents have no
# others (the rules of several sentences are tested on full licence texts).
OP7 = r"""
WITH known(id, s, rank, license) AS (VALUES
  ('ref-mit', 'released under the mit license', 8, 'MIT'),
  ('ref-mit-2', 'licensed under the mit license', 8, 'MIT'),
  ('ref-apache', 'licensed under the apache license version 2.0', 6, 'Apache-2.0'),
  ('ref-gpl3', 'this work is licensed under the gnu general public license version 3', 7, 'GPL-3.0-only'),
  ('ref-cc-by-nc', 'licensed under cc by nc 4.0', 1, 'CC-BY-NC-4.0'),
  ('ref-cc-by-sa', 'licensed under cc by sa 4.0', 2, 'CC-BY-SA-4.0'),
  ('ref-cc-by', 'licensed under cc by 4.0', 3, 'CC-BY-4.0'),
  ('mit-title', 'the mit license mit', 8, 'MIT'),
  ('reserved', 'all rights reserved', 9, 'All-Rights-Reserved')),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, unnest(p) AS p, generate_subscripts(p, 1) AS i
  FROM (SELECT r, string_split(regexp_replace(lower(regexp_replace(text,
          '([.!?;:])[ \t\n\r\f]+|\n[ \t\r\f]*\n', '\1' || chr(1), 'g')),
          '[^a-z0-9.+\x01]+', ' ', 'g'), chr(1)) AS p FROM d)),
found AS (
  SELECT r, i, id, license, rank
  FROM (SELECT r, i, ' ' || regexp_replace(p, '[ .+]+$', '') AS s FROM parts
        WHERE p LIKE '%licen%' OR p LIKE '%reserved%') x
  JOIN known ON suffix(x.s, ' ' || known.s)),
ids AS (SELECT r, list(id ORDER BY i) AS sentence_ids FROM found GROUP BY r),
names AS (
  SELECT r, list(license ORDER BY rank) AS licenses
  FROM (SELECT r, license, min(rank) AS rank FROM found GROUP BY r, license) GROUP BY r)
SELECT doc_id, coalesce(array_to_string(sentence_ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(licenses, ','), '') AS licenses, '' AS unresolved
FROM d LEFT JOIN ids USING (r) LEFT JOIN names USING (r)
"""

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS k
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
often AS (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM windows),
gone AS (
  SELECT r, list(DISTINCT p) AS ps
  FROM (SELECT r, unnest(generate_series(i, i + 34)) AS p FROM often WHERE c > 1) GROUP BY r),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t
  FROM (SELECT d.r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d) u
  LEFT JOIN (SELECT r, unnest(ps) AS i, true AS g FROM gone) USING (r, i)
  WHERE g IS NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sha256(array_to_string(w[i : i + 3], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN lowest ON lowest.x = d.doc_id
"""

# The decimal conv_id's CRC-32, bit by bit.
CRC = """xor(4294967295::BIGINT, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP11 = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
k AS (
  SELECT conv_id, turn, md5(strlen(role) || ':' || role || text) AS token, strlen(text)::BIGINT AS size FROM t),
own AS (
  SELECT conv_id, list({{'token': token, 'size': size}} ORDER BY turn NULLS FIRST, token) AS own
  FROM k GROUP BY conv_id),
h AS (SELECT *, {CRC} % 9 AS h FROM own),
seq AS (
  SELECT h.conv_id, list_concat(coalesce(base.own, [])[1:h.h], h.own[h.h + 1:]) AS s
  FROM h LEFT JOIN own base ON base.conv_id = h.conv_id - h.conv_id % 5),
p AS (
  SELECT conv_id, d, array_to_string([x.token FOR x IN s[1:d]], '') AS path,
         array_to_string([x.token FOR x IN s[1:d - 1]], '') AS up, len(s) = d AS ends,
         CASE WHEN d = 0 THEN 0 ELSE s[d].size END AS size
  FROM (SELECT conv_id, s, unnest(generate_series(0, len(s))) AS d FROM seq)),
node AS (
  SELECT d, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(size) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, path),
kids AS (SELECT d - 1 AS d, up AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
n AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, path)),
climb AS (
  SELECT d, path, up, own, (n_children = 0)::BIGINT AS leaf FROM n
  UNION ALL
  SELECT n.d, n.path, n.up, climb.own, climb.leaf FROM climb JOIN n ON climb.d > 0 AND n.d = climb.d - 1 AND n.path = climb.up),
sums AS (SELECT d, path, sum(leaf)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM climb GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM n JOIN sums USING (d, path) LEFT JOIN n parent ON n.d > 0 AND parent.d = n.d - 1 AND parent.path = n.up
"""

OP12 = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, w
  FROM (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, w, k, a, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, total.n, x.a AS l, y.a AS r, cut,
         ((1000::HUGEINT * c.a * total.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 :], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM f b WHERE b.lang = s.lang AND 100 * b.a >= 100 * s.a AND len(b.phrase) > len(s.phrase)
      AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
"""

ORACLE = {"op2_exact_dedup": OP2, "op3_quality_rules": OP3, "op6_mixing": OP6, "op7_license_scan": OP7,
          "op9_substring_dedup": OP9, "op10_ngram_join": OP10,
          "op11_conversation_trie": OP11, "op12_collocations": OP12}
