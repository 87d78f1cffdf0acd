"""SQL twins of the queries that SQL can express on whole tables."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{UPPER.lower()}')"


def decontaminated(size: int) -> str:
    """Windows of benchmark items among the windows of documents, position by position."""
    split = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, {split.format(lowered("text"))} w FROM documents),
b AS (SELECT item_id, {split.format(lowered("text"))} w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), {size}) n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' ')) END) k FROM b),
z AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, z WHERE len(w) >= n)),
h AS (SELECT p.r, p.i, p.n, g.item_id FROM p JOIN g ON p.k = g.k AND p.n = g.n),
c AS (SELECT r, count(DISTINCT x) n_hit FROM (SELECT r, unnest(range(i, i + n)) x FROM h) GROUP BY r),
t AS (SELECT r, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""


def archived() -> str:
    """Digest, kind and reference of every payload."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = "0123456789abcdef"
    bits = f"array_to_string(list_transform(range(1, 41), lambda i: substr('{''.join(f'{i:04b}' for i in range(16))}', 4 * (instr('{hexed}', h[i:i]) - 1) + 1, 4)), '')"
    five = "16 * CAST(b[5 * i + 1:5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2:5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3:5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4:5 * i + 4] AS INT) + CAST(b[5 * i + 5:5 * i + 5] AS INT)"
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) first_id, {bits} b FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{alphabet}', {five} + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM q"""


def near_duplicates(size: int, percent: int, source: str = "documents") -> str:
    """Exact shingle sets, all pairs with a common shingle, and what can be reached from each document."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({lowered("text")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w FROM {source}),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) END g FROM d),
u AS (SELECT doc_id, unnest(g) g FROM s),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= {percent} * (len(x.g) + len(y.g) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id id, doc_id other FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT id, min(other) component_id FROM r GROUP BY id)
SELECT s.doc_id AS doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.id = s.doc_id"""


def spelling_variants(least_chars: int, least_times: int, every: int, times: int) -> str:
    """Occurrences with their crc32 worked out byte by byte, and pairs of words by what is left without one letter."""
    # the checksum's table by its rule: each byte's value shifted eight times, with the polynomial where a one falls out
    step = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    fold = "lambda c, b: xor(t[CAST(xor(c & 255, b) AS INT) + 1], c >> 8)"
    left = "w[1:CAST({0} AS INT)] || w[CAST({0} AS INT) + 2:]"
    return f"""
WITH RECURSIVE z AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), {step}, CAST(i AS BIGINT))) t),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' i, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{UPPER}', '{UPPER.lower()}') w FROM documents),
a AS (SELECT i, w, count(*) n FROM o WHERE len(w) >= {least_chars} GROUP BY i, w),
b AS (SELECT i, w, n, flatten(list_transform(string_split(i || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) y FROM a),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(y, lambda v: CAST(v AS BIGINT)), {fold}, 4294967295)) h FROM b, z),
v AS (SELECT w, CAST(sum(n) AS BIGINT) n FROM (SELECT CASE WHEN h % {every} = 0 THEN {left.format("(h % len(w))")} ELSE w END w, n FROM h)
  WHERE len(w) >= {least_chars} GROUP BY w HAVING sum(n) >= {least_times}),
k AS (SELECT w, i, {left.format("i")} x FROM (SELECT w, unnest(range(0, len(w))) i FROM v)),
e AS (SELECT p.w a, q.w b FROM k p JOIN k q ON p.i = q.i AND p.x = q.x AND p.w <> q.w
  UNION SELECT p.w, q.w FROM k p JOIN v q ON p.x = q.w UNION SELECT q.w, p.w FROM k p JOIN v q ON p.x = q.w),
g AS (SELECT a, count(*) n_near, max(n) most FROM e JOIN v ON v.w = e.b GROUP BY a),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) n_near, CASE WHEN most >= {times} * v.n THEN most END form_n,
  (SELECT min(e.b) FROM e JOIN v u ON u.w = e.b WHERE e.a = v.w AND u.n = g.most AND g.most >= {times} * v.n) form FROM v LEFT JOIN g ON g.a = v.w),
r AS (SELECT w, w AS at FROM f UNION SELECT r.w, f.form FROM r JOIN f ON f.w = r.at WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form AS form, r.at AS root, f.n AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN r ON r.w = f.w JOIN f l ON l.w = r.at AND l.form IS NULL"""


def ranked(k: int) -> str:
    """Every document scored for every item."""
    terms = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, {terms.format(lowered("text"))} w FROM documents),
b AS (SELECT row_number() OVER () q, item_id, list_distinct({terms.format(lowered("text"))}) w FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) n_docs, CAST(sum(len(w)) AS BIGINT) n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) tf FROM (SELECT r, unnest(w) t FROM d) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) weight FROM p, s GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // n_terms m FROM d, s WHERE len(w) > 0),
g AS (SELECT q, item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) score
  FROM (SELECT q, item_id, unnest(w) t FROM b) JOIN p USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM g
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= {k}"""
