"""DuckDB SQL of the operators that SQL can express."""

OP3_SOURCE_MIXING = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         (source_size * 2.0::DOUBLE) AS cap
  FROM sources
), levels AS (
  SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS clamped,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighed
), leveled AS (
  SELECT *, (wanted - clamped) / open_weight AS level FROM levels
), chosen AS (
  SELECT arg_min(level, ratio) AS level FROM leveled WHERE ratio > level
), targets AS (
  SELECT source, source_size, CASE WHEN c.level IS NULL THEN cap ELSE least(cap, c.level * weight) END AS target
  FROM leveled CROSS JOIN chosen c
), placed AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size) END::BIGINT AS whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY place, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, whole + CASE WHEN running - size / 2.0::DOUBLE <= target - whole * source_size AND size > 0 AND whole < 2 THEN 1 ELSE 0 END AS copies
  FROM placed
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM counted
"""

OP7_SUBSTRING_DEDUP = """
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS words
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM split WHERE len(words) >= 35)
), repeated AS (
  SELECT words FROM windows GROUP BY words HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos
  FROM (SELECT doc_id, i FROM windows SEMI JOIN repeated USING (words)), (SELECT unnest(range(35)) AS k)
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS words
  FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT split.doc_id, len(split.words)::BIGINT AS n_words, (len(split.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept_words, '')) AS kept_sha256
FROM split LEFT JOIN (SELECT doc_id, n, words AS words FROM kept) AS k(doc_id, n, kept_words) USING (doc_id)
"""

OP1_NGRAM_JACCARD = """
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * k >= 90 * (s.n + t.n - k)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)
"""

OP11_STRUCTURE_REPAIR = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations
), chosen AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda crc, b:
           list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS how
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) FROM chosen WHERE how <> 0)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(role)::VARCHAR || ':' || role || text)) AS i, left(role, 1) AS initial,
         regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS bare
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'whole' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM ordered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), inserts(state, stop, cost, audit, out) AS (
  VALUES ('E', 'E', 0, '', []::VARCHAR[]), ('S', 'S', 0, '', []), ('U', 'U', 0, '', []), ('A', 'A', 0, '', []),
         ('E', 'U', 2, 'I', ['user:']), ('S', 'U', 2, 'I', ['user:']), ('A', 'U', 2, 'I', ['user:']), ('U', 'A', 2, 'I', ['assistant:']),
         ('E', 'A', 4, 'II', ['user:', 'assistant:']), ('S', 'A', 4, 'II', ['user:', 'assistant:'])
), edits(state, stop, cost, edit, initial) AS (
  VALUES ('E', 'E', 3, 'D', ''), ('S', 'S', 3, 'D', ''), ('U', 'U', 3, 'D', ''), ('A', 'A', 3, 'D', ''),
         ('E', 'S', 0, 'K', 's'), ('E', 'U', 0, 'K', 'u'), ('S', 'U', 0, 'K', 'u'), ('A', 'U', 0, 'K', 'u'), ('U', 'A', 0, 'K', 'a'),
         ('E', 'U', 2, 'R', 'user'), ('S', 'U', 2, 'R', 'user'), ('A', 'U', 2, 'R', 'user'), ('U', 'A', 2, 'R', 'assistant')
), ways AS (
  SELECT n.conv_id, 0::BIGINT AS i, f.stop AS state, {'cost': f.cost::BIGINT, 'audit': f.audit, 'out': f.out} AS way
  FROM (SELECT DISTINCT conv_id FROM damaged) n, inserts f WHERE f.state = 'E'
  UNION ALL
  SELECT w.conv_id, w.i + 1, f.stop, min({
    'cost': (w.way.cost + e.cost + f.cost + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END)::BIGINT,
    'audit': w.way.audit || e.edit || f.audit,
    'out': list_concat(w.way.out, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.initial || ':' || r.text] END, f.out)})
  FROM ways w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN edits e ON e.state = w.state JOIN inserts f ON f.state = e.stop
  WHERE e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.initial = r.initial)
  GROUP BY w.conv_id, w.i + 1, f.stop
), best AS (
  SELECT w.conv_id, min(w.way) AS way FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
  WHERE w.state IN ('E', 'A') GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.way.cost, 0)::BIGINT AS cost,
       coalesce(b.way.audit, '') AS audit, sha256(coalesce(array_to_string(b.way.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP12_HARD_NEGATIVES = """
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.row <> b.row WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLES = {"op1_ngram_jaccard": OP1_NGRAM_JACCARD, "op3_source_mixing": OP3_SOURCE_MIXING, "op7_substring_dedup": OP7_SUBSTRING_DEDUP, "op11_structure_repair": OP11_STRUCTURE_REPAIR, "op12_hard_negatives": OP12_HARD_NEGATIVES}
