"""DuckDB SQL for those operators that SQL can express over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, met) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.met
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT id, min(met) AS component_id FROM reach GROUP BY 1) r ON r.id = d.doc_id
"""

_GROUP = "(concat('0x', substr(sha1(p), 10 * g + 1, 10)))::BIGINT"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
d AS (
  SELECT page_id, p, array_to_string(list_transform(range(0, 4), lambda g:
    array_to_string(list_transform(range(0, 8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_GROUP} >> (35 - 5 * i)) & 31)::INT + 1, 1)), '')), '') AS digest,
    max(page_id) OVER (PARTITION BY p) AS holder
  FROM p
)
SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM d
"""

_BYTES = "list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::BIGINT, 2))::BIGINT)"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; each byte's eight steps are taken one by one."""
    step = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda k, i: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END)".replace("[c,", "[xor(c, x),")
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format(text)}), lambda c, x: {step}))"


#: Near words share the letters left when one is taken away, at the same place or as a whole word.
SPELLING = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), c AS (SELECT doc_id, run, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || run AS named FROM r WHERE length(run) >= 7 GROUP BY 1, 2
), h AS (SELECT run, k, {_crc32('named')} AS h FROM c
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1
), v AS (SELECT word, n FROM w WHERE length(word) >= 7 AND n >= 2
), g AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM v
), o AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS gap FROM g
), near AS (
  SELECT a.word AS a, b.word AS b, b.n AS n FROM o a JOIN o b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT o.word, v.word, v.n FROM o JOIN v ON v.word = o.gap UNION SELECT v.word, o.word, o.n FROM o JOIN v ON v.word = o.gap
), best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM near GROUP BY 1
), first AS (SELECT near.a, min(b) AS b FROM near JOIN best ON best.a = near.a AND near.n = best.top GROUP BY 1
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN b END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n
  FROM v LEFT JOIN best ON best.a = v.word LEFT JOIN first ON first.a = v.word
), path AS (
  SELECT word, word AS at FROM f UNION SELECT path.word, f.form FROM path JOIN f ON f.word = path.at WHERE f.form IS NOT NULL
), ends AS (SELECT path.word, path.at AS root FROM path JOIN f ON f.word = path.at WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends ON ends.word = f.word
"""

TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT c, list({{'r': role, 't': text}} ORDER BY p) AS turns FROM t GROUP BY 1
), h AS (SELECT c, turns, {_crc32('c::VARCHAR')} % 9 AS h FROM l
), b AS (
  SELECT h.c, list_concat(list_slice(coalesce(o.turns, []), 1, h.h), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns FROM h LEFT JOIN l o ON o.c = h.c - h.c % 5
), x AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM b
), y AS (SELECT c, d, list_slice(turns, 1, d) AS node, list_slice(turns, 1, d - 1) AS up, d = len(turns) AS ends FROM x
), n AS (
  SELECT node, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(any_value(node)[d].t)) END AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM y GROUP BY 1, 2
), k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1
), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.node = n.node
), a AS (SELECT node, d, n_convs, bytes, n_children, unnest(range(0, d + 1)) AS above FROM m
), s AS (
  SELECT list_slice(node, 1, above) AS node, above AS d, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens, sum((n_children = 0)::INT)::BIGINT AS n_leaves FROM a GROUP BY 1, 2
)
SELECT m.conv_id, m.d AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s ON s.node = m.node AND s.d = m.d LEFT JOIN m o ON m.d > 0 AND o.node = m.up AND o.d = m.d - 1
"""

ORACLES: dict[str, str] = {"op5_jaccard": JACCARD, "op7_warc": WARC, "op12_spelling_variants": SPELLING, "op13_prefix_trie": TRIE}
