"""The queries that SQL can express, in DuckDB SQL.

Near duplicates and near vectors are found by all pairs here; the operators miss a pair only with the small
probability that their index states.
"""

_COMPONENTS = """
reach(node, seen) AS (
  SELECT id, id FROM nodes UNION SELECT links.a, reach.seen FROM reach JOIN links ON links.b = reach.node),
least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)"""

_NEAR_VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT e.vec_id, coalesce(n, 0) AS n_links, component AS component_id, e.vec_id = component AS kept
FROM embeddings e JOIN least ON least.node = e.vec_id LEFT JOIN counts ON counts.node = e.vec_id"""

_NEAR_TEXTS = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
                    FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE common / (sa.size + sb.size - common) >= 0.8),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, component AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, d.doc_id = component AS kept
FROM documents d JOIN least ON least.node = d.doc_id LEFT JOIN counts ON counts.node = d.doc_id"""

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_CONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT item, list_slice(w, i, i + least(len(w), 13) - 1) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
windows AS (SELECT g, len(g) AS size, list(DISTINCT item) AS names FROM item_windows GROUP BY g),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
hits AS (
  SELECT doc_id, i, size, names
  FROM (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS g
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size))
  JOIN windows USING (g, size)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, list(DISTINCT item ORDER BY item) AS found FROM (SELECT doc_id, unnest(names) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(found), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

# Conversation repair: crc32 by its table, then the cheapest edits of each state from the last row back (an insertion
# leads to the state that must come next), then the audit read forwards. Rows are ordered as in the operator.
_REPAIR = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
named AS (
  SELECT *, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''),
                           lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
diced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS dice
  FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role,
         CASE dice WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN dice = 3 THEN 2 ELSE 1 END)) AS copy FROM diced WHERE dice <> 0)),
placed AS (
  SELECT *, coalesce(conv_id, -9223372036854775807) AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS solid FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth FROM placed),
marked AS (
  SELECT *, left(role, 1) AS r, solid = '' AS blank, solid <> '' AND nth > 1 AS duplicate,
         solid <> '' AND nth = 1 AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated FROM counted),
costs AS (
  SELECT conv, i, role, r, text, blank OR duplicate AS gone, CASE WHEN truncated THEN 3 ELSE 0 END AS extra FROM marked),
back AS (
  SELECT conv, max(i) + 1 AS i, [{'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}] AS v
  FROM costs GROUP BY conv
  UNION ALL
  SELECT conv, i, [list_min([base[1], {'c': 3 + via.c, 'a': concat('I', via.a)}]), list_min([base[2], {'c': 3 + via.c, 'a': concat('I', via.a)}]),
                   via, list_min([base[4], {'c': 3 + base[3].c, 'a': concat('I', base[3].a)}])]
  FROM (SELECT conv, i, base, list_min([base[3], {'c': 3 + base[4].c, 'a': concat('I', base[4].a)}]) AS via
        FROM (SELECT costs.conv, costs.i, list_transform([[1, 3], [2, 3], [3, 4], [4, 3]], lambda q: list_min([
                {'c': 4 + v[q[1]].c, 'a': concat('D', v[q[1]].a)},
                {'c': CASE WHEN gone THEN 1000000000 ELSE 3 + extra + v[q[2]].c END, 'a': concat('R', v[q[2]].a)},
                {'c': CASE WHEN gone THEN 1000000000 WHEN r = 's' AND q[1] = 1 THEN extra + v[2].c
                           WHEN r = 'u' AND q[2] = 3 THEN extra + v[3].c WHEN r = 'a' AND q[2] = 4 THEN extra + v[4].c
                           ELSE 1000000000 END, 'a': concat('K', CASE WHEN r = 's' THEN v[2].a ELSE v[q[2]].a END)}])) AS base
              FROM back JOIN costs ON costs.conv = back.conv AND costs.i = back.i - 1))),
best AS (SELECT conv, v[1].c AS cost, v[1].a AS audit FROM back WHERE i = 1),
told AS (
  SELECT conv, audit, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS i, 1 AS q, CAST(NULL AS VARCHAR) AS line FROM best
  UNION ALL
  SELECT t.conv, audit, k + 1, CASE WHEN e = 'I' THEN t.i ELSE t.i + 1 END,
         CASE WHEN e = 'D' THEN q WHEN e = 'K' AND r = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END,
         CASE WHEN e = 'D' THEN NULL WHEN e = 'K' THEN concat(c.role, ':', c.text)
              ELSE concat(CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END, CASE WHEN e = 'R' THEN c.text ELSE '' END) END
  FROM (SELECT *, audit[k + 1] AS e FROM told WHERE k < length(audit)) t LEFT JOIN costs c ON c.conv = t.conv AND c.i = t.i),
lines AS (SELECT conv, string_agg(line, chr(10) ORDER BY k) AS whole FROM told WHERE line IS NOT NULL GROUP BY conv),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, CASE WHEN lag(r) OVER w IS NOT NULL THEN concat(lag(r) OVER w, r) END AS pair FROM marked
        WINDOW w AS (PARTITION BY conv ORDER BY i)) GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -9223372036854775807) AS conv FROM conversations)
LEFT JOIN counts USING (conv) LEFT JOIN best USING (conv) LEFT JOIN lines USING (conv)"""

ORACLES = {
    "op3_pivot_near_vectors": _NEAR_VECTORS,
    "op4_minhash_jaccard_join": _NEAR_TEXTS,
    "op10_winnowing_decontamination": _CONTAMINATION,
    "op11_run_length_repair": _REPAIR,
}
