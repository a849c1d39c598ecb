"""Equivalent SQL, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from plateauscope.llm.licenses import DEN, NOTICES, NUM, PHRASES

_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz')")


def _words(text: str, gap: str) -> str:
    return f"list_filter(string_split_regex({text}, '{gap}'), lambda w: w <> '')"


_GRAMS = ("list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))")

# Shingles of documents and items as text, their exact shares.
_LEAKS = f"""
WITH words AS (SELECT doc_id, {_words("lower(coalesce(text, ''))", chr(92).join(['[^', 'p{L}', 'p{N}]+']))} AS w
    FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest({_GRAMS}) AS g FROM words WHERE len(w) >= 5),
item_words AS (SELECT item_id, {_words("lower(text)", chr(92).join(['[^', 'p{L}', 'p{N}]+']))} AS w
    FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
items AS (SELECT DISTINCT item_id, unnest({_GRAMS}) AS g FROM item_words WHERE len(w) >= 5),
short AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS g FROM item_words
    WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT item_id, count(*) AS q FROM items GROUP BY item_id)
SELECT doc_id, item_id, q AS n_shingles, count(*) AS n_shared, count(*) / q AS containment
FROM grams JOIN items USING (g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, q HAVING count(*) * 100 >= 75 * q
UNION ALL SELECT DISTINCT doc_id, item_id, 1, 1, 1.0 FROM words JOIN short ON len(w) >= n AND list_contains(
    list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')), g)
"""

# Every 200-byte window as hexadecimal text; windows that occur twice, merged per document.
_REPEATS = """
WITH bytes AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x
    FROM documents),
wins AS (SELECT r, unnest(range(0, len(x) // 2 - 199)) AS s FROM bytes WHERE len(x) >= 400),
keyed AS (SELECT w.r, w.s, md5_number(substr(b.x, 2 * w.s + 1, 400)) AS h
    FROM wins w JOIN bytes b USING (r)),
twice AS (SELECT r, s FROM keyed WHERE h IN (SELECT h FROM keyed GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 200 THEN 0 ELSE 1 END
    AS fresh FROM twice),
numbered AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS k FROM marked),
spans AS (SELECT r, k, min(s) AS a, max(s) + 200 AS b FROM numbered GROUP BY r, k),
gaps AS (SELECT s.r, s.k, s.a, s.b, coalesce(lag(s.b) OVER (PARTITION BY s.r ORDER BY s.k), 0) AS p
    FROM spans s),
kept AS (SELECT g.r, string_agg(substr(b.x, CAST(2 * g.p + 1 AS BIGINT), CAST(2 * (g.a - g.p) AS BIGINT)), '' ORDER BY g.k) AS head,
    max(g.b) AS tail, sum(g.b - g.a) AS removed, count(*) AS n FROM gaps g JOIN bytes b USING (r)
    GROUP BY g.r)
SELECT b.doc_id, CAST(len(b.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(k.n, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN k.r IS NULL THEN b.x ELSE k.head || substr(b.x, CAST(2 * k.tail + 1 AS BIGINT)) END)) AS kept_sha256
FROM bytes b LEFT JOIN kept k USING (r)
"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS other FROM v
    UNION SELECT r.node, l.w FROM reach r JOIN links l ON r.other = l.u),
low AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.component_id,
    v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.node = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""

_JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_words(_LOWER, "[ " + chr(9) + "-" + chr(13) + "]+")} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5
    THEN [array_to_string(w, ' ')] ELSE {_GRAMS} END) AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b USING (g)
    WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents
    UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.other = l.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM sets s
JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
"""


def _licenses() -> str:
    gap = "[" + "".join(f"{chr(92)}x{a:02X}-{chr(92)}x{b:02X}" for a, b in (
        (0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))) + "]+"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    notices = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(NOTICES))
    return f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, text, {_words(_LOWER, gap)} AS w FROM documents),
phrases(phrase, label) AS (VALUES {phrases}),
places AS (SELECT r, label, unnest(list_filter(range(0, len(w)),
        lambda i: array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase)) AS i
    FROM words, phrases WHERE contains(array_to_string(w, ' '), phrase)),
base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, list_distinct(list(label)) AS labels
    FROM places GROUP BY r),
notices(k, label, body) AS (VALUES {notices}),
sets AS (SELECT k, label, list_distinct(string_split(body, ' ')) AS s FROM notices),
lines AS (SELECT r, unnest(string_split({_LOWER}, chr(10))) AS text FROM words),
blocks AS (SELECT r, list_distinct({_words("text", gap)}) AS s FROM lines
    WHERE regexp_matches(text, '(licen|copyright|redistribution|permission|public domain|subject)')),
hits AS (SELECT b.r, n.label, len(list_intersect(b.s, n.s)) / len(n.s) AS c FROM blocks b, sets n
    WHERE len(list_intersect(b.s, n.s)) * {DEN} >= {NUM} * len(n.s)),
more AS (SELECT r, list_distinct(list(label)) AS labels, max(c) AS best FROM hits GROUP BY r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
    CAST(b.a AS BIGINT) AS first_word, CAST(b.b AS BIGINT) AS last_word,
    array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
    CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.best, 0.0) END AS score
FROM words w LEFT JOIN base b USING (r) LEFT JOIN more m USING (r)
"""


# crc32 of a list of bytes: the table by its rule, then one step a byte.
_CRC_TABLE = ("(SELECT list_transform(range(256), lambda n: list_reduce([n::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], "
              "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS crc)")


def _crc(bytes_: str) -> str:
    return (f"xor(list_reduce([4294967295::UBIGINT] || {bytes_}, "
            "lambda c, b: xor(crc[1 + (xor(c, b) & 255)::INT], c >> 8)), 4294967295::UBIGINT)")


def _utf8(text: str) -> str:
    """Bytes of a text of code points below 2048."""
    return (f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 "
            "THEN [ord(x)::UBIGINT] ELSE [(192 | (ord(x) >> 6))::UBIGINT, (128 | (ord(x) & 63))::UBIGINT] END))")


_INITIAL = "left(role, 1)"
# States 0 nothing, 1 system, 2 user, 3 assistant. Up to three rows inserted, then one edit of a row.
_CONVERSATIONS = f"""
WITH RECURSIVE tab AS {_CRC_TABLE},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc(_utf8("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS fate
    FROM conversations, tab),
dam AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN ''
    WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM src, range(2) q(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
convs AS (SELECT DISTINCT conv_id FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS said FROM dam),
rows_ AS MATERIALIZED (SELECT conv_id, turn, role, text, i, CASE WHEN said = '' THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag({_INITIAL}) OVER (PARTITION BY conv_id ORDER BY i) || {_INITIAL} AS pair FROM ranked),
ins(st, mid, more, done, said) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''),
    (3, 3, 0, '', ''), (0, 2, 2, 'I', 'u'), (1, 2, 2, 'I', 'u'), (3, 2, 2, 'I', 'u'), (2, 3, 2, 'I', 'a'),
    (0, 3, 4, 'II', 'ua'), (1, 3, 4, 'II', 'ua'), (3, 3, 4, 'II', 'ua'), (2, 2, 4, 'II', 'au'),
    (0, 2, 6, 'III', 'uau'), (1, 2, 6, 'III', 'uau'), (3, 2, 6, 'III', 'uau'), (2, 3, 6, 'III', 'aua')),
takes(st, ini, to_) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
opened AS (SELECT st, mid, more, done, replace(replace(said, 'u', chr(10) || 'user:'), 'A',
    chr(10) || 'assistant:') AS lines FROM (SELECT * REPLACE (replace(said, 'a', 'A') AS said) FROM ins)),
edits AS MATERIALIZED (SELECT conv_id, i, mid, mid AS to_, 3 AS more, 'D' AS letter, '' AS line
    FROM rows_, range(4) q(mid)
  UNION ALL SELECT conv_id, i, st, to_, CASE WHEN fault = 't' THEN 1 ELSE 0 END, 'K', chr(10) || role || ':' || text
    FROM rows_ JOIN takes ON ini = {_INITIAL} WHERE fault IN ('', 't')
  UNION ALL SELECT conv_id, i, st, to_, CASE WHEN fault = 't' THEN 3 ELSE 2 END, 'R',
    chr(10) || CASE WHEN to_ = 2 THEN 'user' ELSE 'assistant' END || ':' || text
    FROM rows_, takes WHERE ini <> 's' AND fault IN ('', 't')),
dp AS (SELECT conv_id, 0 AS i, 0 AS st, {{'cost': 0, 'audit': '', 'body': ''}} AS b FROM convs
  UNION ALL SELECT dp.conv_id, dp.i + 1, e.to_, min({{'cost': b.cost + o.more + e.more,
    'audit': b.audit || o.done || e.letter, 'body': b.body || o.lines || e.line}})
  FROM dp JOIN opened o ON o.st = dp.st JOIN edits e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id
    AND e.i = dp.i + 1 AND e.mid = o.mid GROUP BY dp.conv_id, dp.i, e.to_),
sizes AS (SELECT c.conv_id, count(r.i) AS n FROM convs c LEFT JOIN rows_ r
    ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
ends AS (SELECT dp.conv_id, min({{'cost': b.cost + o.more, 'audit': b.audit || o.done,
    'body': b.body || o.lines}}) AS b FROM dp JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id
    AND s.n = dp.i JOIN opened o ON o.st = dp.st AND o.mid IN (0, 3) GROUP BY dp.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost::BIGINT AS cost,
  b.audit AS audit, sha256(substr(b.body, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

# Near words share the first or the last half of the shorter one, or of one as long less a letter;
# the edit is then checked: strip the common beginning and end, and a letter at most is left.
_SPELLING = f"""
WITH RECURSIVE tab AS {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
low AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS r FROM runs WHERE length(r) >= 5) GROUP BY ALL),
hit AS (SELECT r, n, {_crc(_utf8("coalesce(doc_id::VARCHAR, '') || ':' || r"))} AS h FROM low, tab),
words AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN
    left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS w FROM hit)
    WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
halves AS MATERIALIZED (SELECT DISTINCT w, n, side, CASE side WHEN 0 THEN left(w, k) ELSE right(w, k) END AS half
    FROM (SELECT w, n, side, (length(w) - d) // 2 + side * c AS k FROM words, range(2) s(side), range(2) e(d),
      range(2) f(c))),
met AS (SELECT DISTINCT a.w AS a, b.w AS b, a.n, b.n AS m FROM halves a JOIN halves b
    ON a.side = b.side AND a.half = b.half AND abs(length(a.w) - length(b.w)) <= 1 AND a.w <> b.w),
same AS (SELECT *, list_sum(list_transform(range(1, least(length(a), length(b)) + 1),
    lambda i: CASE WHEN left(a, i::INT) = left(b, i::INT) THEN 1 ELSE 0 END)) AS p,
  list_sum(list_transform(range(1, least(length(a), length(b)) + 1),
    lambda i: CASE WHEN right(a, i::INT) = right(b, i::INT) THEN 1 ELSE 0 END)) AS q FROM met),
near AS MATERIALIZED (SELECT a, b, n, m FROM same WHERE least(length(a), length(b)) - least(p + q,
    least(length(a), length(b))) + abs(length(a) - length(b)) <= 1),
best AS (SELECT a, count(*) AS c, min({{'m': -m, 'b': b}}) AS f FROM near GROUP BY a),
forms AS MATERIALIZED (SELECT w, n, coalesce(c, 0) AS c, CASE WHEN -f.m >= 2 * n THEN f.b END AS form,
    CASE WHEN -f.m >= 2 * n THEN -f.m END AS form_n FROM words LEFT JOIN best ON a = w),
way AS (SELECT w, w AS at_, form AS next_ FROM forms
  UNION ALL SELECT y.w, f.w, f.form FROM way y JOIN forms f ON f.w = y.next_)
SELECT w AS word, form, at_ AS root, n, c AS n_near, form_n FROM forms JOIN way USING (w) WHERE next_ IS NULL
"""

ORACLES = {
    "op2_decontamination": _LEAKS,
    "op3_suffix_array_dedup": _REPEATS,
    "op5_embedding_near_dedup": _VECTORS,
    "op8_license_scan": _licenses(),
    "op10_ngram_jaccard_join": _JACCARD,
    "op11_conversation_repair": _CONVERSATIONS,
    "op12_spelling_variants": _SPELLING,
}
