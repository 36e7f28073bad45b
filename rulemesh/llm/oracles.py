"""SQL counterparts of those corpus queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op3_web_archive": r"""
WITH own AS (
  SELECT page_id, lower(coalesce(url, '')) AS url, coalesce(html, '') AS html,
         sha256(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ')
           AS captured_at
  FROM pages
),
keyed AS (
  SELECT *, array_to_string(list_reverse(string_split(
              regexp_extract(url, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.')), ',')
            || ')' || regexp_replace(url, '^[a-z][a-z0-9+.-]*://[^/?#]*', '') AS url_key,
         CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END
           AS first_id
  FROM own
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       url_key, captured_at,
       row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS position
FROM keyed
""",
    "op4_near_duplicates": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct([array_to_string(w[i : i + 4], ' ')
                                FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s
  FROM worded WHERE len(w) > 0
),
classes AS (
  SELECT min(doc_id) AS rep, any_value(s) AS s, len(any_value(s)) AS n FROM sets GROUP BY list_sort(s)
),
members AS (
  SELECT s.doc_id, c.rep FROM sets s JOIN classes c ON list_sort(s.s) = list_sort(c.s)
),
items AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT rep AS start, rep AS node FROM classes
  UNION
  SELECT r.start, e.b FROM reached r JOIN edges e ON e.a = r.node
),
roots AS (SELECT start, min(node) AS root FROM reached GROUP BY start)
SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles,
       coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM documents d
LEFT JOIN sets s USING (doc_id) LEFT JOIN members m USING (doc_id) LEFT JOIN roots r ON r.start = m.rep
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE crc_steps AS (
  SELECT i AS byte, 0 AS step, i AS value FROM range(256) t(i)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END
  FROM crc_steps WHERE step < 8
),
crc AS (SELECT list(value ORDER BY byte) AS steps FROM crc_steps WHERE step = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
),
counted AS (SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS bytes FROM runs
            WHERE length(run) >= 6 GROUP BY doc, run),
sealed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295, [CAST(('0x' || substr(bytes, 2 * i - 1, 2)) AS BIGINT) FOR i IN range(1, len(bytes) // 2 + 1)]),
           lambda a, x: xor(steps[xor(a, x) % 256 + 1], a >> 8))) AS h
  FROM counted, crc
),
spelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END
           AS word, n
  FROM sealed
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
shorter AS (SELECT DISTINCT h.word AS longer, h.n AS longer_n, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT word, longer, longer_n FROM shorter
  UNION ALL SELECT longer, word, n FROM shorter
),
best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(a := -near_n, b := near)) AS top FROM near GROUP BY word
),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -top.a >= 5 * w.n THEN top.b END AS form, CASE WHEN -top.a >= 5 * w.n THEN -top.a END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
),
steps AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL
  SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON f.word = s.next
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN steps s ON s.word = f.word AND s.next IS NULL
""",
    "op13_ranked_search": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
),
totals AS (SELECT count(*) AS n, sum(len(t)) AS l FROM docs WHERE len(t) > 0),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, term
),
held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, totals GROUP BY term, n
),
shares AS (SELECT r, doc_id, CAST(75 + (25 * len(t) * n) // l AS BIGINT) AS m FROM docs, totals),
scored AS (
  SELECT a.item_id, s.r, s.doc_id,
         CAST(sum(a.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * s.m))) AS BIGINT) AS score
  FROM held h JOIN shares s ON s.r = h.r JOIN weights w ON w.term = h.term JOIN asked a ON a.term = h.term
  GROUP BY a.item_id, s.r, s.doc_id
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
         doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
""",
}
