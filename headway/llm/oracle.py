"""The operators' queries in DuckDB's SQL, where SQL can express them."""

ORACLE: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH lines AS (
  SELECT doc_id, i AS line_no, line, i < n AS more
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i, len(lines) AS n
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
),
pieces AS (
  SELECT doc_id, line_no, k, CASE WHEN k = n AND more THEN piece || chr(10) ELSE piece END AS piece,
         trim(regexp_replace(lower(piece), '\s+', ' ', 'g')) AS words
  FROM (
    SELECT doc_id, line_no, more, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS k, len(p) AS n
    FROM (
      SELECT *, CASE WHEN line = '' THEN [''] ELSE
        regexp_extract_all(line, '.*?(?:[.!?…]["''”’)\]]*(?:[ \t]+|$)|[。！？]["''”’)\]」』]*[ \t]*)|.+') END AS p
      FROM lines
    )
  )
),
numbered AS (
  SELECT *, sum(CASE WHEN words <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no, k) AS unit FROM pieces
),
units AS (
  SELECT doc_id, unit, string_agg(piece, '' ORDER BY line_no, k) AS piece, max(words) AS words, min(line_no) FILTER (WHERE words <> '') AS line_no
  FROM numbered GROUP BY doc_id, unit
),
marked AS (
  SELECT *, words <> '' AND row_number() OVER (PARTITION BY words ORDER BY doc_id, unit) > 1 AS again FROM units
),
runs AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id, again ORDER BY unit) AS run,
         sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY unit) - length(piece) AS start
  FROM marked
),
judged AS (
  SELECT *, again AND (sum(length(words)) OVER (PARTITION BY doc_id, again, run) >= 40
                       OR (bool_and(again) OVER (PARTITION BY doc_id, line_no)
                           AND sum(length(words)) OVER (PARTITION BY doc_id, line_no) >= 24)) AS gone FROM runs
),
texts AS (
  SELECT doc_id, string_agg(CASE WHEN gone THEN '' ELSE piece END, '' ORDER BY unit) AS text FROM judged GROUP BY doc_id
),
spans AS (
  SELECT doc_id, gone, min(start) AS start, sum(length(piece)) AS length
  FROM (SELECT *, unit - row_number() OVER (PARTITION BY doc_id, gone ORDER BY unit) AS stretch FROM judged WHERE piece <> '')
  GROUP BY doc_id, gone, stretch
),
listed AS (
  SELECT doc_id,
         string_agg(start || '+' || length, ' ' ORDER BY start) FILTER (WHERE gone) AS removed,
         string_agg(start || '+' || length, ' ' ORDER BY start) FILTER (WHERE NOT gone) AS kept
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, d.lang, d.source, d.n_chars,
       coalesce(removed, '') AS removed, coalesce(kept, '') AS kept
FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN listed USING (doc_id)
""",
    "op8_line_quality": r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
),
words AS (
  SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts
),
windows AS (
  SELECT r, i, list_slice(words, i, i + 2) AS shingle
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM words)
),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, shingle) AS n FROM windows) WHERE n > 1
),
covered AS (
  SELECT r, count(DISTINCT i + shift) AS n_repeat_words
  FROM again, (SELECT unnest([0, 1, 2]) AS shift) GROUP BY r
),
lines AS (
  SELECT r, line, words, row_number() OVER (PARTITION BY r ORDER BY nth) AS place
  FROM (
    SELECT r, nth, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
    FROM (
      SELECT r, unnest(string_split(text, chr(10))) AS line,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nth
      FROM texts
    )
  )
  WHERE len(words) > 0
),
rated AS (
  SELECT r, line, len(words) AS n,
    len(list_filter(words, lambda w: w IN ('|', '»', '›', '→', '/', '>'))) >= 2
    OR len(regexp_extract_all(line, '(?i)\b(?:uses? cookies|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|javascript is (?:disabled|required)|sign in|log in|subscribe to our|click here|licensed under|released under|lorem ipsum)\b')) * 25 >= greatest(len(words), 1)
    OR len(list_filter(words, lambda w: regexp_matches(w, '[#*$%&|<>]|!!'))) > 0.3 * len(words)
    OR place > 1 AND len(words) < 8 AND NOT regexp_matches(line, '[.!?…:;。！？]["''”’»)\]]*[ \t\v\f\r]*$') AS fails
  FROM lines
),
stays AS (
  SELECT r, sum(CASE WHEN fails THEN 0 ELSE n END)::BIGINT AS n_kept_words,
         (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM rated GROUP BY r
),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_kept_words, 0) AS n_kept_words
  FROM words LEFT JOIN covered USING (r) LEFT JOIN stays USING (r)
),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_kept_words >= 0.5 * n_words AS kept, n_kept_words
FROM failed
""",
    "op10_decontamination": r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents
),
items AS (
  SELECT item_id, words, len(words) AS m, least(5, len(words)) AS q
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM benchmark)
  WHERE len(words) > 0
),
item_shingles AS (
  SELECT item_id, q, m, shingle, count(*) AS n
  FROM (SELECT item_id, q, m, list_slice(words, i, i + q - 1) AS shingle
        FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM items))
  GROUP BY ALL
),
shingles AS (
  SELECT r, n_doc, q, i - 1 AS place, list_slice(words, i, i + q - 1) AS shingle
  FROM (SELECT r, words, len(words) AS n_doc, q, unnest(range(1, greatest(len(words) - q + 2, 1))) AS i
        FROM docs, (SELECT DISTINCT q FROM items))
),
hits AS (
  SELECT r, n_doc, item_id, i.q, least(m, n_doc) AS length, place
  FROM shingles s JOIN item_shingles i ON i.shingle = s.shingle AND i.q = s.q
),
starts AS (
  SELECT DISTINCT r, item_id, q, length,
         unnest(range(greatest(place - (length - q), 0), least(place, n_doc - length) + 1)) AS start
  FROM hits
),
own AS (
  SELECT w.r, item_id, w.q, length, start, shingle, count(*) AS n
  FROM starts w JOIN shingles s ON s.r = w.r AND s.q = w.q AND s.place BETWEEN start AND start + length - w.q
  GROUP BY ALL
),
rated AS (
  SELECT r, o.item_id, length, start, sum(least(o.n, coalesce(i.n, 0))) AS common, sum(o.n) AS total
  FROM own o LEFT JOIN item_shingles i ON i.item_id = o.item_id AND i.shingle = o.shingle
  GROUP BY r, o.item_id, length, start
),
similar_ AS (
  SELECT r, item_id, length, start, CAST(common AS DOUBLE) / CAST(total + m - q + 1 - common AS DOUBLE) AS similarity
  FROM rated JOIN items USING (item_id)
)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS n_words, similarity
FROM similar_ JOIN docs USING (r)
WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, start) = 1
""",
    "op11_prefix_trie": r"""
WITH digests AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), digest) - 1 AS place,
         digest, bytes
  FROM (
    SELECT conv_id, turn, role, strlen(coalesce(text, '')) AS bytes,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL
  )
),
ids AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: unicode(c)::bigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
  )) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM digests)
),
turns AS (
  SELECT d.conv_id, place, digest, bytes FROM digests d JOIN ids USING (conv_id) WHERE place >= h
  UNION ALL
  SELECT i.conv_id, place, digest, bytes FROM ids i JOIN digests d ON d.conv_id = i.conv_id - i.conv_id % 5 WHERE place < h
),
ways AS (
  SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS way
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
),
lengths AS (SELECT conv_id, max(depth) AS depth FROM ways GROUP BY conv_id),
nodes AS (
  SELECT w.way, w.depth, min(w.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
         sha256(coalesce(string_agg(w.conv_id::varchar, ',' ORDER BY w.conv_id) FILTER (WHERE l.depth = w.depth), '')) AS ends_sha256
  FROM ways w JOIN lengths l USING (conv_id) GROUP BY w.way, w.depth
),
counted AS (
  SELECT n.*, coalesce(k, 0) AS n_children
  FROM nodes n LEFT JOIN (
    SELECT left(way, 32 * (depth - 1)) AS way, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1
  ) USING (way)
),
sums AS (
  SELECT left(way, 32 * d) AS way, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.depth::bigint AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves::bigint AS n_leaves,
       saved_tokens::bigint AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (way) LEFT JOIN nodes p ON c.depth > 0 AND p.way = left(c.way, 32 * (c.depth - 1))
""",
    "op12_spelling_groups": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
  )
  WHERE length(run) >= 6 GROUP BY doc_id, run
),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id::varchar, ':', run), ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [unicode(c)::bigint] ELSE [195::bigint, unicode(c)::bigint - 64] END))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
  )) AS h
  FROM runs WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT run, n, 1 FROM runs WHERE doc_id IS NULL
),
words AS (
  SELECT word, sum(n)::bigint AS n
  FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) ELSE run END AS word, n
    FROM hashed
  )
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
cuts AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::int AS i FROM words)
),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION
  SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) AS n_near, arg_min(struct_pack(other := other, n := n), struct_pack(less := -n, other := other)) AS top
  FROM near GROUP BY word
),
formed AS (
  SELECT w.word, CASE WHEN top.n >= 5 * w.n THEN top.other END AS form, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN top.n >= 5 * w.n THEN top.n END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
ways AS (
  SELECT word, word AS here, 0 AS steps FROM formed
  UNION ALL
  SELECT w.word, f.form, steps + 1 FROM ways w JOIN formed f ON f.word = w.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(here, steps) AS root FROM ways GROUP BY word) r USING (word)
""",
}
