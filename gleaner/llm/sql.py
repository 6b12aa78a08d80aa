"""SQL twins of the operators' queries, for an engine with ``sha256`` and list functions."""

MERKLE = r"""
WITH RECURSIVE
crc(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM crc WHERE k < 8),
bytes AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
hit AS (
  SELECT doc_id, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 3 = 0 AS yes
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), bytes),
head AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS start
  FROM documents),
leaf AS (
  SELECT head.doc_id, lang, sha256(start || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit.yes THEN sha256(start || coalesce(strlen(text) || ':'
      || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS again
  FROM head LEFT JOIN hit ON head.doc_id = hit.doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaf),
nodes(level, g, pos, n, h) AS (
  SELECT 0, g, pos, n, leaf FROM placed
  UNION ALL
  SELECT level + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY level, g, pos // 8, n),
subroots AS (SELECT g, level AS depth, h, count(*) OVER () AS n FROM nodes WHERE n = 1),
top(level, pos, n, h) AS (
  SELECT 0, g, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
root AS (SELECT h AS root, level AS depth FROM top WHERE n = 1),
runs AS (
  SELECT level, g, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT level, NULL, pos // 8, list(h ORDER BY pos) FROM top WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT p.g, p.pos, p.doc_id, p.leaf, p.again, s.depth, s.h AS subroot, r.root, r.depth AS upper
  FROM placed p JOIN subroots s ON p.g = s.g, root r),
walk(g, pos, doc_id, leaf, subroot, root, level, place, depth, upper, proof, folded) AS (
  SELECT g, pos, doc_id, leaf, subroot, root, 0, pos, depth, upper, '', coalesce(again, leaf) FROM steps
  UNION ALL
  SELECT w.g, w.pos, doc_id, leaf, subroot, root, w.level + 1,
    (CASE WHEN w.level < depth THEN w.place WHEN w.level = depth THEN w.g ELSE w.place END) // 8, depth, upper,
    proof || array_to_string(list_concat(hs[:slot], hs[slot + 2:]), ''),
    sha256(array_to_string(hs[:slot], '') || folded || array_to_string(hs[slot + 2:], ''))
  FROM (SELECT *, (CASE WHEN level = depth THEN g ELSE place END) % 8 AS slot,
      (CASE WHEN level = depth THEN g ELSE place END) // 8 AS run FROM walk WHERE level < depth + upper) w
  JOIN runs r ON r.run = w.run
    AND ((w.level < depth AND r.g = w.g AND r.level = w.level) OR (w.level >= depth AND r.g IS NULL AND r.level = w.level - depth)))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk WHERE level = depth + upper
"""

LEXICAL = r"""
WITH items AS (SELECT item_id, text, row_number() OVER () AS item FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (
  SELECT DISTINCT item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
docs AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT doc, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS total FROM sizes),
counts AS (
  SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, whole WHERE term IN (SELECT term FROM asked) GROUP BY term),
scores AS (
  SELECT item, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc), whole GROUP BY item, doc),
ranked AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
  FROM scores JOIN sizes USING (doc) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 50
"""

REPEATS = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT d, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
windows AS (SELECT d, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT d, i + k AS p FROM windows JOIN twice USING (h), range(35) r(k)),
words AS (SELECT d, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
kept AS (SELECT d, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (d, p) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (d)
"""

NEAR_COPIES = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT d, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT d, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT d, count(*) AS n FROM shingles GROUP BY d),
met AS (SELECT x.d AS a, y.d AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.d < y.d GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes p ON p.d = a JOIN sizes q ON q.d = b WHERE 100 * met.n >= 80 * (p.n + q.n - met.n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(d, r) AS (SELECT d, d FROM docs UNION SELECT reach.d, ways.b FROM reach JOIN ways ON reach.r = ways.a),
least AS (SELECT reach.d, min(doc_id) AS component_id FROM reach JOIN docs ON docs.d = reach.r GROUP BY reach.d)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM docs JOIN least USING (d) LEFT JOIN sizes USING (d)
"""
