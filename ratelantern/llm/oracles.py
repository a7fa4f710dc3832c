"""DuckDB SQL for the operators that SQL can express."""

ORACLES: dict[str, str] = {}

# One period of the schedule by recursion over its slots: the released block with the earliest
# deadline, the first source by name among equals.
ORACLES["op4_mix_sources"] = """
WITH RECURSIVE src AS (
  SELECT source, CASE source WHEN 'src0' THEN 5 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END AS w,
         CAST(ceil(count(*) / 16.0) AS BIGINT) AS blocks,
         row_number() OVER (ORDER BY source) AS j
  FROM documents GROUP BY source
), listed AS (
  SELECT list(w ORDER BY j) AS ws, sum(w)::BIGINT AS q FROM src
), run(t, nxt, j) AS (
  SELECT -1::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT FROM listed
  UNION ALL
  SELECT t, list_transform(range(1, len(nxt) + 1), lambda i: nxt[i] + CASE WHEN i = j THEN 1 ELSE 0 END), j
  FROM (
    SELECT run.t + 1 AS t, nxt, ws, q,
           list_min(list_filter(list_transform(range(1, len(ws) + 1), lambda i:
             CASE WHEN nxt[i] < ws[i] AND (nxt[i] * q) // ws[i] <= run.t + 1
                  THEN (((nxt[i] + 1) * q + ws[i] - 1) // ws[i]) * 1000000 + i END), lambda v: v IS NOT NULL)) % 1000000 AS j
    FROM run, listed WHERE run.t + 1 < q
  )
), period AS (
  SELECT j, row_number() OVER (PARTITION BY j ORDER BY t) - 1 AS k, t FROM run WHERE t >= 0
), placed AS (
  SELECT doc_id, d.source, src.w, src.j,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % src.blocks AS block
  FROM documents d JOIN src ON d.source IS NOT DISTINCT FROM src.source
)
SELECT doc_id, source, placed.w::BIGINT AS weight, block, (block // placed.w) * q + period.t AS slot,
       (block * q) // placed.w AS release, ((block + 1) * q + placed.w - 1) // placed.w AS deadline
FROM placed, listed JOIN period ON period.j = placed.j AND period.k = block % placed.w
"""

ORACLES["op7_substring_dedup"] = r"""
WITH listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM listed)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM windows WHERE nth > 1
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM listed
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM listed LEFT JOIN kept USING (doc_id)
"""

# Pairs share a shingle, so counting shared shingles finds all of them.
ORACLES["op9_near_duplicates"] = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s
  FROM listed
), sizes AS (
  SELECT doc_id, count(s) AS n FROM listed LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.id, CASE WHEN l.a = reach.other THEN l.b ELSE l.a END FROM reach JOIN links l ON reach.other IN (l.a, l.b)
)
SELECT doc_id, n AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM sizes JOIN (SELECT id, min(other) AS least_id FROM reach GROUP BY id) ON id = doc_id
"""

ORACLES["op5_embedding_near_duplicates"] = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), degree AS (
  SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.id, CASE WHEN l.a = reach.other THEN l.b ELSE l.a END FROM reach JOIN links l ON reach.other IN (l.a, l.b)
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least_id AS component_id, e.vec_id = least_id AS kept
FROM embeddings e LEFT JOIN degree ON degree.id = e.vec_id
JOIN (SELECT id, min(other) AS least_id FROM reach GROUP BY id) r ON r.id = e.vec_id
"""

# crc32 by its eight steps a byte; nodes are lists of turns, subtrees all nodes that start with them.
ORACLES["op11_prefix_trie"] = """
WITH numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS tt
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id AS c, list(tt ORDER BY pos) AS ts,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
           lambda s: [ord(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a % 2) * 3988292384) END) AS crc
  FROM numbered GROUP BY conv_id
), rebuilt AS (
  SELECT a.c, list_concat(CASE WHEN b.c IS NULL OR h = 0 THEN [] ELSE b.ts[1:h] END, a.ts[h + 1:]) AS ts
  FROM (SELECT *, xor(crc, 4294967295) % 9 AS h FROM convs) a LEFT JOIN convs b ON b.c = a.c - a.c % 5
), placed AS (
  SELECT c, d, ts[1:d] AS path, len(ts) = d AS ends, CASE WHEN d > 0 THEN strlen(ts[d].t) ELSE 0 END AS bytes
  FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, path, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS digest
  FROM placed GROUP BY d, path
), families AS (
  SELECT p.d, p.path, p.c, q.c AS parent FROM nodes p LEFT JOIN nodes q ON q.d = p.d - 1 AND q.path = p.path[1:p.d - 1]
), children AS (
  SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), above AS (
  SELECT x.d, x.path, x.n, x.bytes, coalesce(k.n, 0) AS kids, unnest(range(0, x.d + 1)) AS up
  FROM nodes x LEFT JOIN children k ON k.d = x.d AND k.path = x.path
), sums AS (
  SELECT up AS d, path[1:up] AS path, sum((n - 1) * bytes) AS saved, count(*) FILTER (kids = 0) AS leaves FROM above GROUP BY 1, 2
)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, f.parent AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, x.digest AS ends_sha256
FROM nodes x JOIN families f ON f.d = x.d AND f.path = x.path JOIN sums s ON s.d = x.d AND s.path = x.path
LEFT JOIN children k ON k.d = x.d AND k.path = x.path
"""

# Every kept term of a language for every source of it, occurring or not.
ORACLES["op13_divergence_audit"] = r"""
WITH docs AS MATERIALIZED (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), terms AS MATERIALIZED (
  SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), vocabulary AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), units AS (
  SELECT DISTINCT lang, source FROM docs
), grid AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM (SELECT u.lang, u.source, k.term, coalesce(c.n, 0) AS n, v FROM units u JOIN kept k USING (lang) JOIN vocabulary USING (lang)
        LEFT JOIN counts c ON c.lang = u.lang AND c.source = u.source AND c.term = k.term)
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n, any_value(v) AS v FROM counts JOIN vocabulary USING (lang) GROUP BY lang, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM units a JOIN units b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM grid JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""

# Strings of bytes as hexadecimal text.
ORACLES["op12_suffix_dedup"] = """
WITH hexed AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), named AS MATERIALIZED (
  SELECT row, i, md5(h[2 * i + 1:2 * i + 400]) AS name FROM (SELECT row, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM hexed)
), hits AS (
  SELECT row, i FROM named WHERE name IN (SELECT name FROM named GROUP BY name HAVING count(*) > 1)
), opened AS (
  SELECT row, i, CASE WHEN i - lag(i) OVER (PARTITION BY row ORDER BY i) <= 200 THEN 0 ELSE 1 END AS opens FROM hits
), spans AS MATERIALIZED (
  SELECT row, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT row, i, sum(opens) OVER (PARTITION BY row ORDER BY i) AS span FROM opened) GROUP BY row, span
), gaps AS (
  SELECT row, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL
  SELECT row, max(b), any_value(length(h) // 2) FROM spans JOIN hexed USING (row) GROUP BY row
), kept AS (
  SELECT row, string_agg(h[2 * a + 1:2 * b], '' ORDER BY a) AS k FROM gaps JOIN hexed USING (row) WHERE b > a GROUP BY row
), sums AS (
  SELECT row, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY row
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM hexed LEFT JOIN sums USING (row) LEFT JOIN kept USING (row)
"""
