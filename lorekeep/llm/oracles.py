"""DuckDB equivalents of the queries of this subpackage: brute force over all pairs or runs, for small tables."""

from __future__ import annotations

import unicodedata

from .lookalike import LOOKALIKES
from .pieces import P1_FOUND_SQL


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WIDE, _PLAIN = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
_BLANKS = "               　"
_LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))


def _joined(c: str) -> str:
    for a, b in _LIGATURES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def words(c: str) -> str:
    """Words of a text; of the compatibility forms those that occur are made plain."""
    return f"regexp_extract_all(lower(nfc_normalize(translate({_joined(c)}, {_text(_WIDE + chr(0xA0))}, {_text(_PLAIN + ' ')}))), '[\\p{{L}}\\p{{N}}]+')"


def form(c: str) -> str:
    """The consistent form of a text."""
    accented = {}
    for i in range(0x370, 0x530):
        whole = unicodedata.normalize("NFD", chr(i))
        plain = unicodedata.normalize("NFC", "".join(LOOKALIKES.get(x, x) for x in whole))
        if len(whole) > 1 and len(plain) == 1 and plain != chr(i):
            accented[chr(i)] = plain
    pairs = {**dict(zip(_WIDE, _PLAIN, strict=True)), **dict.fromkeys(_BLANKS, " "), **LOOKALIKES, **accented}
    bare = rf"regexp_replace({_joined(c)}, '[\p{{Cf}}\x{{FE00}}-\x{{FE0F}}]', '', 'g')"
    return f"nfc_normalize(translate({bare}, {_text(''.join(pairs))}, {_text(''.join(pairs.values()))}))"


LIVE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, id ORDER BY row_no) AS nth FROM mcp_documents WHERE id <> '' AND namespace <> '') WHERE nth = 1"


def runs(words_: str, n: int) -> str:
    """The different runs of n words of a list."""
    return f"list_distinct(list_transform(range(1, len({words_}) - {n - 2}), lambda i: list_aggregate({words_}[i:i + {n - 1}], 'string_agg', ' ')))"


def _similar(a: str, b: str) -> str:
    return f"count(*) * 10 >= (min({a}.n) + min({b}.n) - count(*)) * 7"


_STORED = f"""live AS ({LIVE}),
sw AS (SELECT row_no, namespace, {words('text')} AS ws FROM live WHERE layer IN (0, 4) AND text IS NOT NULL),
sets AS (SELECT row_no, namespace, {runs('ws', 3)} AS rs FROM sw),
s AS (SELECT row_no, namespace, len(rs) AS n, unnest(rs) AS run FROM sets)"""
_P5_LINKS = f"""SELECT a.row_no AS row_a, b.row_no AS row_b FROM s a JOIN s b ON a.namespace = b.namespace AND a.run = b.run AND a.row_no < b.row_no
GROUP BY a.row_no, b.row_no HAVING {_similar('a', 'b')}"""

P5_FOUND = f"WITH {_STORED} {_P5_LINKS}"
P5_GROUPS = f"""
WITH RECURSIVE {_STORED},
member AS (SELECT row_no, min(row_no) OVER (PARTITION BY namespace, list_sort(rs)) AS class_key FROM sets WHERE len(rs) > 0),
pair AS ({_P5_LINKS}),
link AS (SELECT DISTINCT x.class_key AS a, y.class_key AS b FROM pair JOIN member x ON x.row_no = row_a JOIN member y ON y.row_no = row_b WHERE x.class_key <> y.class_key),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT class_key AS node, class_key AS other FROM member UNION SELECT node, b FROM reach JOIN both_ways ON other = a)
SELECT row_no, class_key, count(*) OVER (PARTITION BY class_key) AS copies, (SELECT count(*) FROM both_ways WHERE a = class_key) AS links,
  (SELECT min(other) FROM reach WHERE node = class_key) AS group_key
FROM member
"""

# records in order, each with what it repeats; a list per namespace carries the records accepted so far
_P3 = f"""
WITH RECURSIVE {_STORED},
rw AS (SELECT rec_no, batch_no, namespace, {words('text')} AS ws FROM import_records WHERE text IS NOT NULL AND namespace IS NOT NULL),
rsets AS (SELECT rec_no, batch_no, namespace, {runs('ws', 3)} AS rs FROM rw),
r AS (SELECT rec_no, batch_no, namespace, len(rs) AS n, unnest(rs) AS run FROM rsets),
old AS (SELECT rec_no, min(row_no) AS duplicate_of FROM (
  SELECT r.rec_no, s.row_no FROM r JOIN s ON r.namespace = s.namespace AND r.run = s.run GROUP BY r.rec_no, s.row_no HAVING {_similar('r', 's')}) GROUP BY rec_no),
early AS (SELECT a.rec_no, b.rec_no AS other FROM r a JOIN r b ON a.namespace = b.namespace AND a.run = b.run AND (b.batch_no, b.rec_no) < (a.batch_no, a.rec_no)
  GROUP BY a.rec_no, b.rec_no HAVING {_similar('a', 'b')}),
rec AS (SELECT rec_no, namespace, row_number() OVER (PARTITION BY namespace ORDER BY batch_no, rec_no) AS nth, rec_no IN (SELECT rec_no FROM old) AS known,
  coalesce((SELECT list(other) FROM early e WHERE e.rec_no = x.rec_no), []) AS others FROM rsets x),
step AS (SELECT DISTINCT namespace, 0::BIGINT AS nth, []::BIGINT[] AS accepted, NULL::BIGINT AS turned_away FROM rec
  UNION ALL SELECT rec.namespace, rec.nth,
    CASE WHEN known OR list_has_any(others, accepted) THEN accepted ELSE list_append(accepted, rec_no) END, CASE WHEN known OR list_has_any(others, accepted) THEN rec_no END
  FROM step JOIN rec ON rec.namespace = step.namespace AND rec.nth = step.nth + 1),
cases AS (SELECT turned_away AS rec_no FROM step WHERE turned_away IS NOT NULL)
"""
P3_FOUND = _P3 + "SELECT rec_no FROM cases"
P3_BATCHES = _P3 + "SELECT rec_no, batch_no FROM cases JOIN import_records USING (rec_no)"
P3_DECISIONS = _P3 + "SELECT rec_no, batch_no, rec_no NOT IN (SELECT rec_no FROM cases) AS accepted, duplicate_of FROM import_records LEFT JOIN old USING (rec_no)"

P4_FOUND = f"""
WITH live AS ({LIVE}),
v AS (SELECT row_no, namespace, vector::DOUBLE[] AS x FROM live
  WHERE coalesce(len(vector) = 64 AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0, false)),
u AS (SELECT row_no, namespace, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)))) AS x FROM v),
p AS (SELECT a.row_no AS q, b.row_no AS n, list_inner_product(a.x, b.x) AS s, row_number() OVER (PARTITION BY a.row_no ORDER BY round(list_inner_product(a.x, b.x), 7) DESC, b.row_no) AS rank
  FROM u a JOIN u b ON a.namespace = b.namespace AND a.row_no <> b.row_no)
SELECT DISTINCT least(q, n) AS row_a, greatest(q, n) AS row_b FROM p WHERE rank <= 5
"""
P4_NEIGHBOURS = P4_FOUND.split("SELECT DISTINCT")[0] + "SELECT q AS row_no, n AS neighbour, round(s, 4) AS similarity, rank::INT AS rank FROM p WHERE rank <= 5"
P6_FOUND = f"""
WITH d AS (SELECT doc_id, {words('text')} AS ws FROM documents), i AS (SELECT item_id, {words('text')} AS ws FROM eval_items),
dr AS (SELECT doc_id, unnest({runs('ws', 12)}) AS run FROM d), ir AS (SELECT item_id, unnest({runs('ws', 12)}) AS run FROM i)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)
"""
_FORMS = f"WITH f AS (SELECT doc_id, text, {form('text')} AS form FROM documents WHERE text IS NOT NULL)"
P8_FOUND = _FORMS + "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id"
P8_CLASSES = _FORMS + """, c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS spellings, count(*) AS documents FROM f GROUP BY form)
SELECT doc_id, class_id, spellings, documents FROM f JOIN c USING (form)"""
P8_TEXTS = f"SELECT doc_id, {form('text')} AS text FROM documents"
P1_SIZES = """
SELECT 'mcp_documents' AS src, count(*) AS items, sum(length(text))::BIGINT AS chars, true AS within_limit, true AS within_overlap, true AS in_order FROM mcp_documents WHERE length(text) > 0
UNION ALL SELECT 'onion_slices', count(*), sum(length(content))::BIGINT, true, true, true FROM onion_slices WHERE length(content) > 0
"""

SQL = {
    "p1_found": P1_FOUND_SQL, "p1_sizes": P1_SIZES, "p3_found": P3_FOUND, "p3_batches": P3_BATCHES, "p3_decisions": P3_DECISIONS, "p4_found": P4_FOUND, "p4_neighbours": P4_NEIGHBOURS,
    "p5_found": P5_FOUND, "p5_groups": P5_GROUPS, "p6_found": P6_FOUND, "p8_found": P8_FOUND, "p8_classes": P8_CLASSES, "p8_texts": P8_TEXTS,
}
