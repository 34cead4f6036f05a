"""SQL for the corpus queries that SQL can state without a tokenizer, a model or a hash of Spark's."""

# CRC-32 of a string: one lookup table, then a byte at a time.
_CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_of
)"""


def _crc(text):
    return f"""xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, length(hex(encode({text}))) // 2 + 1),
        lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, crc_of[(xor(a, b) & 255) + 1])), 4294967295)"""


PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
plans AS (
  SELECT c.conv_id, b.conv_id AS base, {_crc("c.conv_id::VARCHAR")} % 6 AS h, coalesce(b.n, 0) AS n_base
  FROM sizes c CROSS JOIN crc_table LEFT JOIN sizes b ON b.conv_id = c.conv_id - c.conv_id % 100
),
rebuilt AS (
  SELECT p.conv_id, t.nth AS d, t.role, t.text FROM plans p JOIN turns t ON t.conv_id = p.base AND t.nth <= p.h
  UNION ALL
  SELECT p.conv_id, least(p.h, p.n_base) + t.nth - p.h, t.role, t.text
  FROM plans p JOIN turns t ON t.conv_id = p.conv_id AND t.nth > p.h
),
keyed AS (
  SELECT conv_id, d, length(text) AS chars, md5(string_agg(
           length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k
  FROM rebuilt
),
members AS (
  SELECT conv_id, 0 AS d, 0 AS chars, 'root' AS k FROM sizes UNION ALL SELECT conv_id, d, chars, k FROM keyed
),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars FROM members GROUP BY d, k),
links AS (
  SELECT n.d, n.k, m.k AS above, a.conv_id AS above_id
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.d = n.d - 1 JOIN nodes a ON a.d = m.d AND a.k = m.k
),
kids AS (SELECT d - 1 AS d, above AS k, count(*) AS n FROM links GROUP BY 1, 2),
full_nodes AS (
  SELECT n.*, l.above_id, coalesce(c.n, 0) AS n_children
  FROM nodes n LEFT JOIN links l ON l.d = n.d AND l.k = n.k LEFT JOIN kids c ON c.d = n.d AND c.k = n.k
),
sums AS (
  SELECT m.d, m.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n - 1) * f.chars) AS saved
  FROM full_nodes f JOIN members m ON m.conv_id = f.conv_id AND m.d <= f.d GROUP BY 1, 2
),
depths AS (SELECT conv_id, max(d) AS d FROM members GROUP BY conv_id),
ends AS (
  SELECT m.d, m.k, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS sha
  FROM members m JOIN depths x ON x.conv_id = m.conv_id AND x.d = m.d GROUP BY 1, 2
)
SELECT f.conv_id, f.d AS depth, f.above_id AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM full_nodes f JOIN sums s ON s.d = f.d AND s.k = f.k LEFT JOIN ends e ON e.d = f.d AND e.k = f.k
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FEATURES = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLED = f"""
WITH {_CRC_TABLE},
features AS (
  SELECT 0 AS side, doc_id, unnest({_FEATURES}) AS w FROM documents
  UNION ALL SELECT 1, NULL, unnest({_FEATURES}) FROM benchmark
),
counts AS (SELECT side, doc_id, w, count(*) AS n FROM features GROUP BY ALL),
buckets AS (
  SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM counts) CROSS JOIN crc_table
),
totals AS (SELECT sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counts),
by_bucket AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
  FROM counts JOIN buckets USING (w) GROUP BY bucket
),
gains AS (
  SELECT bucket, floor(1000 * ln((b.t + 1)::DOUBLE * (coalesce(x.s, 0) + 10000)::DOUBLE
           / ((b.s + 1)::DOUBLE * (coalesce(x.t, 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM by_bucket b CROSS JOIN totals x
),
weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight
  FROM counts JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
),
scores AS (
  SELECT d.doc_id, coalesce(w.n_features, 0)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
         (coalesce(w.weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id
),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scores WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.rank <= 10 * r.n // 100 THEN r.rank END AS rank
FROM scores s LEFT JOIN ranks r ON r.doc_id = s.doc_id
"""
