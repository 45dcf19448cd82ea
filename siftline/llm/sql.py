"""DuckDB SQL of the queries that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Classes of equal sets stand for their documents; links are found over shared shingles.
OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS gs FROM w
), n AS (SELECT doc_id, len(gs)::BIGINT AS n FROM s),
g AS (SELECT doc_id, unnest(gs) AS gram FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS low FROM n UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(low) AS component_id FROM r JOIN n USING (doc_id) GROUP BY r.doc_id
"""

_WORD5 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{_WORD5}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{_WORD5}') AS ws FROM benchmark),
win AS (
  SELECT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda j: array_to_string(ws[j:j + 9], ' '))) AS t
  FROM i WHERE len(ws) > 0
), ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS p, ws FROM d, ks WHERE len(ws) >= k),
h AS (SELECT dw.doc_id, dw.p, dw.k, win.item_id FROM dw JOIN win ON win.k = dw.k AND win.t = array_to_string(dw.ws[dw.p:dw.p + dw.k - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP7 = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (SELECT doc_id, p, line, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, p, sha256(array_to_string(ws[p:p + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM d WHERE len(ws) >= 35)
), r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM r),
t AS (SELECT doc_id, generate_subscripts(ws, 1) AS q, unnest(ws) AS word FROM d),
j AS (SELECT t.*, gone.q IS NOT NULL AS removed FROM t LEFT JOIN gone USING (doc_id, q)),
a AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (WHERE NOT removed) AS kept
  FROM j GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

#: crc32 of a string's bytes (all ASCII), bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"

#: Prefixes are told apart by their whole texts; each node's words go to all its ancestors along its smallest member.
OP11 = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, {_CRC.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL SELECT t.conv_id, t.pos, t.role, t.text FROM t JOIN c ON c.conv_id = t.conv_id WHERE t.pos > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w AS path,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), u AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(path) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM p),
n AS (SELECT path, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(words) AS words FROM u GROUP BY path, depth),
k AS (SELECT up AS path, count(*)::BIGINT AS n_children FROM n WHERE depth > 0 GROUP BY up),
s AS (
  SELECT a.path, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.path IS NULL)::BIGINT AS n_leaves
  FROM n v JOIN p a ON a.conv_id = v.conv_id AND a.depth <= v.depth LEFT JOIN k ON k.path = v.path GROUP BY a.path
), e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM u WHERE last GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(e.ends, '')) AS ends_sha256
FROM n LEFT JOIN n m ON m.path = n.up LEFT JOIN k ON k.path = n.path JOIN s ON s.path = n.path LEFT JOIN e ON e.path = n.path
"""

OP12 = rf"""
WITH w AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: {LOWER.format("x")}) AS ts FROM documents
), o AS (SELECT d, lang, source, unnest(ts) AS term FROM w),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM w),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM x JOIN v USING (lang)
), l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM x GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q FROM l JOIN v USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(a.p - b.p)), 0) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
"""
