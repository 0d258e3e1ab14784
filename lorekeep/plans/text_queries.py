"""Text functions, cleaning, slicing, chunks and conversations (T, D, W7-W10, A14, A15)."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions import pytext as P
from ..functions import text as X
from ..operators import clean as C
from ..operators import slicing as D
from ..operators import turns as U
from ..sources import table
from . import text_sql as Z
from .registry import WS, Registry, collapse, cut_words, pieces, strip, text_value

R = Registry()


def documents(spark, base, *cols):
    return table(spark, base, "documents", *(cols or ("doc_id", "text")))


def blocks(spark, base):
    return table(spark, base, "raw_blocks", "block_no", "session_id", "role", "content")


def with_text(spark, base, *cols):
    return documents(spark, base, "doc_id", "text", *cols).where("text is not null")


# ---- hashes and scalars -----------------------------------------------------
@R.add("t1_content_hash", "SELECT row_no, sha256(text) AS content_hash, coalesce(lower(content_hash) = sha256(text), false) AS is_right FROM mcp_documents")
def _(spark, base):
    d = table(spark, base, "mcp_documents", "row_no", "text", F.col("content_hash").alias("h"))
    return d.select("row_no", X.content_hash("text").alias("content_hash"), F.coalesce(F.lower("h") == X.content_hash("text"), F.lit(False)).alias("is_right"))


@R.add("t2_short_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents WHERE text IS NOT NULL")
def _(spark, base):
    return with_text(spark, base).select("doc_id", X.short_hash("text").alias("h"))


@R.add("t3_slice_ids", "SELECT slice_no, 'slice_' || substr(sha256(content || 'core'), 1, 16) || '_core' AS slice_id FROM onion_slices WHERE content IS NOT NULL")
def _(spark, base):
    return table(spark, base, "onion_slices", "slice_no", "content").where("content is not null").select("slice_no", X.slice_id("content", "core").alias("slice_id"))


@R.add("t4_normal_hash", f"SELECT sha256({collapse('lower(text)')}) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, base):
    return with_text(spark, base).groupBy(X.normal_hash("text").alias("h")).agg(F.count("*").alias("n"))


_RUNS = "regexp_extract_all({w}, '[\\p{{L}}\\p{{N}}]+')"
_ASCII = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARTS = "string_split(" + _ASCII.format(x="regexp_replace(s, '([a-z])([A-Z])', '\\1 \\2', 'g')") + ", ' ')"


def sql_tokens(src: str, key: str, text: str) -> str:
    """Tokens of every text: CTE kt(key, token)."""
    return f"""kr AS (SELECT {key}, {_RUNS.format(w='w')} AS segs FROM (SELECT {key}, unnest({pieces(text)}) AS w FROM {src} WHERE {text} IS NOT NULL)),
ks AS (SELECT {key}, list_transform(segs, lambda s: {_PARTS}) AS p, list_transform(segs, lambda s: CASE WHEN len({_PARTS}) > 1 AND strlen(lower(s)) BETWEEN 3 AND 30 THEN lower(s) END) AS wh FROM kr WHERE len(segs) > 0),
kt AS (SELECT {key}, unnest(flatten(list_transform(range(1, len(p) + 1), lambda i: list_concat(p[i], CASE WHEN wh[i] IS NOT NULL AND NOT list_contains(flatten(p[1:i]), wh[i]) AND NOT coalesce(list_contains(wh[1:i - 1], wh[i]), false) THEN [wh[i]] ELSE [] END)))) AS token FROM ks)"""


_SESSION = "((strlen({t}) > 12 AND regexp_full_match({t}, '[0-9A-Fa-f]+')) OR length(regexp_replace({t}, '[^0-9]', '', 'g')) >= 6 OR (strlen({t}) > 20 AND length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) < strlen({t}) // 3))"
_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(P.STOP_WORDS)) + ")"


def sql_keywords(key: str, most: int) -> str:
    """CTE kw(key, token, place) after sql_tokens."""
    ok = f"strlen(token) BETWEEN 3 AND 30 AND token NOT IN {_STOP} AND NOT {_SESSION.format(t='token')}"
    return f"kw AS (SELECT {key}, token, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, token) AS place FROM kt WHERE {ok} GROUP BY {key}, token QUALIFY place <= {most})"


@R.add("t6_keyword_tokens", f"WITH {sql_tokens('documents', 'doc_id', 'text')} SELECT token, count(*) AS n FROM kt GROUP BY 1")
def _(spark, base):
    return with_text(spark, base).select(F.explode(X.keyword_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@R.add("t7_keywords_topn", f"WITH {sql_tokens('documents', 'doc_id', 'text')}, {sql_keywords('doc_id', 10)} SELECT doc_id, place AS rank, token AS keyword FROM kw")
def _(spark, base):
    return D.keywords(documents(spark, base), ["doc_id"]).withColumn("rank", F.col("rank").cast("long"))


@R.add("a15_term_frequency", f"WITH {sql_tokens('documents', 'doc_id', 'text')} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM kt WHERE strlen(token) BETWEEN 3 AND 30 AND token NOT IN {_STOP} AND NOT {_SESSION.format(t='token')} GROUP BY 1")
def _(spark, base):
    t = with_text(spark, base).select("doc_id", F.explode(X.keyword_tokens("text")).alias("token"))
    ok = F.octet_length("token").between(3, 30) & ~F.col("token").isin(*sorted(P.STOP_WORDS)) & ~X.session_like("token")
    per = t.where(ok).groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


@R.add("t8_session_tokens", f"SELECT DISTINCT x AS token, {_SESSION.format(t='x')} AS is_session FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS x FROM mcp_documents WHERE text IS NOT NULL)")
def _(spark, base):
    t = table(spark, base, "mcp_documents", "text").select(F.explode(X.alnum_runs("text")).alias("token")).distinct()
    return t.withColumn("is_session", X.session_like("token"))


@R.add("t9_cut_words", f"SELECT doc_id, {cut_words('text', 120)} AS head FROM documents WHERE text IS NOT NULL")
def _(spark, base):
    return with_text(spark, base).select("doc_id", X.cut_words("text", 120).alias("head"))


@R.add("t10_cut_sentence", f"SELECT doc_id, {Z.cut_sentence('text', 400)} AS head FROM documents WHERE text IS NOT NULL")
def _(spark, base):
    return D._rows_from(documents(spark, base), lambda t: [{"head": P.cut_sentence(t, 400)}] if t is not None else [], [("head", "string")], ["doc_id"], ["text"])


@R.add("t11_sentences", f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS sentence_index, unnest(s) AS sentence FROM (SELECT doc_id, {Z.sentences('text')} AS s FROM documents WHERE text IS NOT NULL)")
def _(spark, base):
    return D.split_sentences(documents(spark, base), ["doc_id"])


@R.add("t12_key_content", f"WITH {Z.key_content('documents', 'doc_id', 'text', 600, 'q')} SELECT doc_id, content FROM qkc")
def _(spark, base):
    return D.key_contents(documents(spark, base), ["doc_id"])


@R.add("t14_collapse", f"SELECT doc_id, md5({collapse('text')}) AS h FROM documents WHERE text IS NOT NULL")
def _(spark, base):
    return with_text(spark, base).select("doc_id", F.md5(X.collapse("text")).alias("h"))


@R.add("t15_token_estimates", "SELECT doc_id, ceil(length(text) / 3.0)::BIGINT AS normal, ceil(length(text) / 4.0)::BIGINT AS english, ceil(length(text) / 2.5)::BIGINT AS multilingual FROM documents WHERE text IS NOT NULL")
def _(spark, base):
    return with_text(spark, base).select("doc_id", X.token_estimate("text").alias("normal"), X.token_estimate("text", 4.0).alias("english"), X.token_estimate("text", 2.5).alias("multilingual"))


@R.add("t16_over_token_limit", "SELECT source, count(*) AS n, count(*) FILTER (WHERE ceil(length(text) / 3.0) > 1000) AS over FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, base):
    return with_text(spark, base, "source").groupBy("source").agg(F.count("*").alias("n"), F.count_if(X.token_estimate("text") > 1000).alias("over"))


@R.add("t17_safe_chunks", "SELECT doc_id, ceil(length(text) / 2457.0)::BIGINT AS pieces FROM documents WHERE text IS NOT NULL")
def _(spark, base):
    room = X.safe_chunk_chars(1024)
    return with_text(spark, base).select("doc_id", F.ceil(F.length("text") / F.lit(float(room))).alias("pieces"))


_EXT = "CASE WHEN regexp_full_match(n, '.+\\.[^.]*') THEN lower(regexp_extract(n, '\\.([^.]*)$', 1)) END"
_TYPES = "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.DOC_TYPES.items()) + " END"


@R.add("t18_doc_types", f"SELECT coalesce({_TYPES}, 'none') AS kind, count(*) AS n FROM (SELECT {_EXT} AS e FROM (SELECT string_split({text_value('path')}, '/')[-1] AS n FROM mcp_documents)) GROUP BY 1")
def _(spark, base):
    p = table(spark, base, "mcp_documents", "metadata").select(M.text_value(M.parsed(), "path").alias("path"))
    return p.groupBy(F.coalesce(X.doc_type("path"), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@R.add("t19_context_prefix", f"""SELECT doc_id, CASE WHEN strlen(p) > 100 THEN substr(p, 1, 100) ELSE p END AS prefix FROM (SELECT doc_id, concat_ws(' ', CASE WHEN n <> '' THEN '[Source: ' || n || ']' END, '[Section: ' || lang || ']', '[Type: ' || ({_TYPES}) || ']') AS p FROM (SELECT *, {_EXT} AS e FROM (SELECT doc_id, lang, string_split(path, '/')[-1] AS n FROM documents)))""")
def _(spark, base):
    return documents(spark, base, "doc_id", "lang", "path").select("doc_id", X.context_prefix(X.file_name("path"), "lang", X.doc_type("path")).alias("prefix"))


@R.add("t20_layer_names", "SELECT coalesce(CASE layer WHEN 0 THEN 'flat' WHEN 1 THEN 'outer' WHEN 2 THEN 'middle' WHEN 3 THEN 'inner' WHEN 4 THEN 'core' END, 'none') AS layer_name, count(*) AS n FROM onion_slices GROUP BY 1")
def _(spark, base):
    return table(spark, base, "onion_slices", "layer").groupBy(F.coalesce(X.layer_name("layer"), F.lit("none")).alias("layer_name")).agg(F.count("*").alias("n"))


@R.add("t21_durations", "SELECT * FROM (VALUES ('30d', 30::BIGINT), ('6m', 180), ('1y', 365)) v(duration, days)")
def _(spark, base):
    return spark.createDataFrame([(d, X.day_count(d)) for d in ("30d", "6m", "1y")], "duration string, days long")


@R.add("t35_first_lines", f"SELECT doc_id, {cut_words('l', 96)} AS summary FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {collapse('x')}), lambda x: x <> '')[1] AS l FROM documents WHERE text IS NOT NULL)")
def _(spark, base):
    return with_text(spark, base).select("doc_id", X.cut_words(X.first_line("text"), 96).alias("summary"))


@R.add("t39_file_names", "SELECT string_split(path, '/')[1] AS folder, count(DISTINCT string_split(path, '/')[-1]) AS files FROM documents WHERE path IS NOT NULL GROUP BY 1")
def _(spark, base):
    return documents(spark, base, "path").where("path is not null").groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.countDistinct(X.file_name("path")).alias("files"))


# ---- JSON ---------------------------------------------------------------------
# one level of objects, as the tables have them
_STR = lambda k: f"CASE WHEN json_type(v, '$.{k}') = 'VARCHAR' THEN json_extract_string(v, '$.{k}') END"
_SAID = "list_filter([" + ", ".join(_STR(k) for k in ("content", "text", "message", "summary", "description", "body")) + f", ({_STR('role')}) || ': ' || ({_STR('content')})], lambda x: x IS NOT NULL AND x <> '')"
_TITLE = "coalesce(" + ", ".join(_STR(k) for k in ("title", "name", "uuid", "id")) + ", '')"
_KIND = """CASE WHEN json_type(v) <> 'OBJECT' THEN CASE json_type(v) WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' ELSE 'value' END
  WHEN list_contains(json_keys(v), 'chat_messages') OR list_contains(json_keys(v), 'mapping') THEN 'conversation' WHEN list_has_all(json_keys(v), ['messages', 'sessions']) THEN 'session'
  WHEN list_has_all(json_keys(v), ['role', 'content']) THEN 'message' WHEN list_has_all(json_keys(v), ['observations', 'name']) THEN 'entity' WHEN list_contains(json_keys(v), 'messages') THEN 'thread' ELSE 'object' END"""


_JSON = f"""t AS (SELECT slice_no, content, coalesce(json_valid(content), false) AS ok, CASE WHEN json_valid(content) THEN json_type(content) END AS type FROM onion_slices WHERE content IS NOT NULL),
e AS (SELECT slice_no, generate_subscripts(a, 1) - 1 AS element, unnest(a) AS v FROM (SELECT slice_no, json_extract(content, '$[*]') AS a FROM t WHERE type = 'ARRAY') UNION ALL SELECT slice_no, 0, content::JSON FROM t WHERE ok AND type <> 'ARRAY'),
p AS (SELECT slice_no, element, {_KIND} AS kind, {_SAID} AS parts, {_TITLE} AS title, v FROM e),
j AS (SELECT slice_no, element, kind, CASE WHEN kind = 'text' THEN json_extract_string(v, '$') ELSE array_to_string(CASE WHEN title <> '' AND len(list_filter(parts, lambda x: contains(x, title))) = 0 THEN list_prepend('[' || title || ']', parts) ELSE parts END, chr(10)) END AS content FROM p),
g AS (SELECT j.* FROM j JOIN t USING (slice_no) WHERE type <> 'ARRAY' OR strlen(j.content) > 50),
jd AS (SELECT slice_no, element::INT AS element, kind, content FROM g
UNION ALL SELECT slice_no, 0, 'text', content FROM t WHERE NOT ok UNION ALL SELECT slice_no, 0, 'array', content FROM t WHERE type = 'ARRAY' AND slice_no NOT IN (SELECT slice_no FROM g))"""


def json_documents(spark, base):
    return D.json_documents(table(spark, base, "onion_slices", "slice_no", "content").withColumnRenamed("content", "text"), ["slice_no"])


@R.add("s13_json_documents", f"WITH {_JSON} SELECT slice_no, element, kind, content FROM jd")
def _(spark, base):
    return json_documents(spark, base)


@R.add("t29_json_kinds", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(json_valid(metadata), false) THEN 'broken' WHEN json_type(metadata) <> 'OBJECT' THEN lower(json_type(metadata))
 WHEN list_contains(json_keys(metadata), 'role') AND list_contains(json_keys(metadata), 'content') THEN 'message' WHEN list_contains(json_keys(metadata), 'messages') THEN 'thread' ELSE 'object' END AS kind FROM mcp_documents) GROUP BY 1""")
def _(spark, base):
    v = M.parsed()
    has = lambda k: F.array_contains(F.json_object_keys("metadata"), k)
    kind = F.when(v.isNull(), "broken").when(~M.is_object(v), F.lower(F.schema_of_variant(v))).when(has("role") & has("content"), "message").when(has("messages"), "thread").otherwise("object")
    return table(spark, base, "mcp_documents", "metadata").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# ---- cleaning -------------------------------------------------------------------
_W_IN, _S_IN = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}", WS[1:-1]


def _re2(p: str) -> str:
    """A pattern for DuckDB, with the Unicode classes spelled out."""
    p = p.replace("(?md)", "(?m)").replace("(?d)", "")
    out, inside, i = [], False, 0
    while i < len(p):
        two = p[i : i + 2]
        if two in (r"\w", r"\s", r"\d"):
            body = {r"\w": _W_IN, r"\s": _S_IN, r"\d": r"\p{Nd}"}[two]
            out.append(body if inside else f"[{body}]")
            i += 2
            continue
        if two[:1] == "\\":
            out.append(two)
            i += 2
            continue
        inside = (inside or p[i] == "[") and p[i] != "]"
        out.append(p[i])
        i += 1
    return "".join(out).replace("'", "''")


def _sql_gone(c: str, patterns) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '{_re2(p)}', '', 'g')"
    return c


def sql_cleaned(c: str, metadata: bool = False) -> str:
    c = _sql_gone(c, (*C.TOOL_BLOCKS, C.TOOL_TAGS))
    c = _sql_gone(c, ["(?m)" + p for p in C.CLI])
    if metadata:
        for p, new in C.METADATA:
            c = f"regexp_replace({c}, '{_re2(p)}', '{new}', 'g')"
    c = _sql_gone(c, C.EMPTY)
    return strip(rf"regexp_replace(regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")


_NOISE = r"""CASE doc_id % 8 WHEN 0 THEN '<function_calls>run it</function_calls>' WHEN 1 THEN E'\n\n\n\nOn branch main\nmodified: a.rs\n' WHEN 2 THEN E'\ncompiling  twice\n   Compiling core v1\n--> src/a.rs' WHEN 3 THEN ' TODO: "content": [] "text": ""' WHEN 4 THEN E'\nnpm WARN old\nadded 12 packages\n' WHEN 5 THEN '<output>x</name> <result>y</result>' WHEN 6 THEN E'\n├── src/\n│   └── main.rs\ntotal 12\n' ELSE ' 2026-01-02T03:04:05Z 1700000000 session_id=ab-1' END"""


def noisy(spark, base):
    """Documents with noise of every pattern behind the text, chosen by the number of the document."""
    noise = ["<function_calls>run it</function_calls>", "\n\n\n\nOn branch main\nmodified: a.rs\n", "\ncompiling  twice\n   Compiling core v1\n--> src/a.rs", ' TODO: "content": [] "text": ""', "\nnpm WARN old\nadded 12 packages\n", "<output>x</name> <result>y</result>", "\n├── src/\n│   └── main.rs\ntotal 12\n", " 2026-01-02T03:04:05Z 1700000000 session_id=ab-1"]
    tail = F.element_at(F.array(*map(F.lit, noise)), (F.col("doc_id") % 8 + 1).cast("int"))
    return with_text(spark, base).select("doc_id", F.concat("text", tail).alias("text"))


@R.add("t31_cleaned", f"SELECT doc_id, length({sql_cleaned('x')}) AS n, md5({sql_cleaned('x')}) AS h FROM (SELECT doc_id, text || {_NOISE} AS x FROM documents WHERE text IS NOT NULL)")
def _(spark, base):
    c = noisy(spark, base).select("doc_id", C.cleaned("text").alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("h"))


@R.add("t31_cleaned_metadata", f"SELECT doc_id, md5({sql_cleaned('x', True)}) AS h FROM (SELECT doc_id, text || {_NOISE} AS x FROM documents WHERE text IS NOT NULL)")
def _(spark, base):
    return noisy(spark, base).select("doc_id", F.md5(C.cleaned("text", metadata=True)).alias("h"))


_TOOLS = f"(strlen(content) > 0 AND 1 - strlen({strip(_sql_gone('content', C.TOOL_BLOCKS))}) / strlen(content) > 0.8)"
_LINES = "CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\n$', ''), chr(10)) END"
_CLI = f"(len({_LINES}) > 0 AND len(list_filter({_LINES}, lambda l: regexp_matches(l, '{_re2('|'.join(f'(?:{p})' for p in C.CLI))}'))) / len({_LINES}) > 0.7)"


@R.add("t32_mostly_tools", f"SELECT block_no, {_TOOLS} AS tools FROM (SELECT block_no, CASE WHEN block_no % 5 = 0 THEN '<result>' || content || '</result> ok' ELSE content END AS content FROM raw_blocks WHERE content IS NOT NULL)")
def _(spark, base):
    b = blocks(spark, base).where("content is not null").withColumn("content", F.when(F.col("block_no") % 5 == 0, F.concat(F.lit("<result>"), "content", F.lit("</result> ok"))).otherwise(F.col("content")))
    return b.select("block_no", C.mostly_tools("content").alias("tools"))


@R.add("t33_mostly_cli", f"SELECT block_no, {_CLI} AS cli FROM raw_blocks WHERE content IS NOT NULL")
def _(spark, base):
    return blocks(spark, base).where("content is not null").select("block_no", C.mostly_cli("content").alias("cli"))


_REASON = f"CASE WHEN {_TOOLS} THEN 'tool_artifact' WHEN {_CLI} THEN 'cli_output' WHEN {strip(sql_cleaned('content'))} = '' THEN 'empty' WHEN strlen({sql_cleaned('content')}) < 50 THEN 'below_min_length' ELSE 'kept' END"


@R.add("a14_drop_reasons", f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM raw_blocks WHERE content IS NOT NULL) GROUP BY 1")
def _(spark, base):
    return blocks(spark, base).where("content is not null").groupBy(F.coalesce(C.drop_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@R.add("d11_filter_conversations", f"""
WITH RECURSIVE m AS (SELECT session_id, block_no, {_REASON} AS reason, {sql_cleaned('content')} AS clean FROM raw_blocks WHERE content IS NOT NULL),
k AS (SELECT session_id, block_no, list_distinct({pieces('clean')}) AS ws FROM m WHERE reason = 'kept' AND session_id IS NOT NULL),
w AS (SELECT session_id, block_no, len(ws) AS n, unnest(ws) AS word FROM k),
e AS (SELECT b.block_no, a.block_no AS other FROM w a JOIN w b ON a.session_id = b.session_id AND a.word = b.word AND a.block_no < b.block_no
  GROUP BY a.block_no, b.block_no HAVING count(*) >= {C.NEAR}::DOUBLE * (min(a.n) + min(b.n) - count(*))),
rec AS (SELECT session_id, block_no, row_number() OVER (PARTITION BY session_id ORDER BY block_no) AS nth, coalesce((SELECT list(other) FROM e WHERE e.block_no = k.block_no), []) AS others FROM k),
step AS (SELECT DISTINCT session_id, 0::BIGINT AS nth, []::BIGINT[] AS kept, NULL::BIGINT AS gone FROM rec
  UNION ALL SELECT rec.session_id, rec.nth, CASE WHEN list_has_any(others, kept) THEN kept ELSE list_append(kept, block_no) END, CASE WHEN list_has_any(others, kept) THEN block_no END
  FROM step JOIN rec ON rec.session_id = step.session_id AND rec.nth = step.nth + 1)
SELECT session_id, block_no, CASE WHEN block_no IN (SELECT gone FROM step WHERE gone IS NOT NULL) THEN 'near_duplicate' ELSE reason END AS reason FROM m""")
def _(spark, base):
    return C.filtered_conversations(blocks(spark, base)).select("session_id", "block_no", F.coalesce("reason", F.lit("kept")).alias("reason"))


@R.add("d12_filter_messages", f"SELECT min(block_no) AS block_no, h AS hash FROM (SELECT block_no, sha256({collapse('lower(c)')}) AS h FROM (SELECT block_no, {sql_cleaned('content')} AS c FROM raw_blocks WHERE content IS NOT NULL) WHERE strlen(c) >= 50) GROUP BY h")
def _(spark, base):
    return C.kept_messages(blocks(spark, base)).select("block_no", "hash")


WINDOWS = "list_transform(range(0, greatest(ceil((length(text) - 512) / 384.0), 0)::BIGINT + 1), lambda i: substr(text, i * 384 + 1, 512))"


# ---- slices and chunks --------------------------------------------------------------
_META = {k: text_value(k) for k in ("type", "format", "role", "project", "title", "conversation", "session", "agent")}


@R.add("d1_onion_slices", f"""WITH {Z.layers('mcp_documents', 'row_no', 'text', _META)}
SELECT row_no, id, layer::INT AS layer, content, lead(id) OVER w AS parent_id, coalesce(lag(id) OVER w, '') AS children, keywords FROM sl WINDOW w AS (PARTITION BY row_no ORDER BY layer)""")
def _(spark, base):
    d = table(spark, base, "mcp_documents", "row_no", "text", "metadata")
    return D.sliced(d, ["row_no"]).select("row_no", "id", "layer", "content", "parent_id", F.array_join("children_ids", ",").alias("children"), F.array_join("keywords", ",").alias("keywords"))


_FAST = f"""big AS (SELECT doc_id, {strip('text')} AS text FROM documents WHERE text IS NOT NULL AND strlen({strip('text')}) >= 200), {sql_tokens('big', 'doc_id', 'text')}, {sql_keywords('doc_id', 10)},
k AS (SELECT doc_id, '[' || string_agg(token, ', ' ORDER BY place) || '] ' AS p FROM kw WHERE place <= 5 GROUP BY 1),
f AS (SELECT doc_id, coalesce(p, '') AS p, {strip("regexp_extract(text, '^[^.!?]*')")} AS s FROM big LEFT JOIN k USING (doc_id)), g AS (SELECT *, greatest(0, 100 - strlen(p)) AS room FROM f),
fo AS (SELECT doc_id, p || CASE WHEN strlen(s) <= room OR length(s) <= room THEN s ELSE regexp_replace(substr(s, 1, room), ' [^ ]*$', '', 's') || '...' END AS content FROM g)"""


@R.add("d2_onion_fast_outer", f"WITH {_FAST} SELECT doc_id, content FROM fo")
def _(spark, base):
    d = with_text(spark, base).withColumn("metadata", F.lit(None).cast("string"))
    return D.sliced(d, ["doc_id"], fast=True).where("layer = 1").select("doc_id", "content")


@R.add("d3_conversation_slices", f"WITH {Z.layers('mcp_documents', 'row_no', 'text', _META)} SELECT row_no, layer::INT AS layer, content FROM sl WHERE row_no IN (SELECT row_no FROM mcp_documents WHERE {_META['type']} IN {tuple(P.CONVERSATION_TYPES)})")
def _(spark, base):
    d = table(spark, base, "mcp_documents", "row_no", "text", "metadata").where(M.text_value(M.parsed(), "type").isin(*P.CONVERSATION_TYPES))
    return D.sliced(d, ["row_no"]).select("row_no", "layer", "content")


@R.add("d16_json_indexing", f"""WITH {_JSON}, jk AS (SELECT slice_no * 100000 + element AS k, content AS text FROM jd WHERE strlen(content) >= 50), {Z.layers('jk', 'k', 'text', dict.fromkeys(_META, 'NULL::VARCHAR'))}
SELECT k // 100000 AS slice_no, (k % 100000)::INT AS element, layer::INT AS layer, id, content FROM sl""")
def _(spark, base):
    """The texts of JSON files, those of at least 50 bytes, in layers."""
    d = json_documents(spark, base).where(F.octet_length("content") >= 50).withColumn("metadata", F.lit(None).cast("string"))
    return D.sliced(d.withColumnRenamed("content", "text"), ["slice_no", "element"]).select("slice_no", "element", "layer", "id", "content")


@R.add("d18_plain_indexing", f"""WITH {_FAST}, sl AS (SELECT doc_id, 1 AS layer, content FROM fo UNION ALL SELECT doc_id, 4, {strip('text')} FROM documents WHERE text IS NOT NULL)
SELECT doc_id, layer, content, 'slice_' || substr(sha256(content || n), 1, 16) || '_' || n AS id FROM (SELECT *, CASE layer WHEN 1 THEN 'outer' ELSE 'core' END AS n FROM sl)""")
def _(spark, base):
    """All documents in two layers, copies too."""
    d = with_text(spark, base).withColumn("metadata", F.lit(None).cast("string"))
    return D.sliced(d, ["doc_id"], fast=True).select("doc_id", "layer", "content", "id")


@R.add("d19_pipeline_chunks", f"SELECT path || '_' || (i - 1) AS id, sha256(w[i]) AS content_hash, sha256(text) AS file_hash FROM (SELECT path, text, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id::VARCHAR AS path, text, {WINDOWS} AS w FROM documents WHERE length(text) > 0))")
def _(spark, base):
    from ..streaming.pipeline import chunk_rows

    files = documents(spark, base).select(F.col("doc_id").cast("string").alias("path"), "text")
    return chunk_rows(files, "files").select("id", "content_hash", "file_hash")


@R.add("t36_conversation_facets", f"WITH {Z.facets('raw_blocks', 'block_no', 'content', {})} SELECT block_no, block::INT AS block, label, summary, decision, next_action, entities FROM ff")
def _(spark, base):
    return D.facets(blocks(spark, base), ["block_no"])


_CHUNKS = f"WITH {Z.chunks('documents', 'doc_id, path', 'text')}, c AS (SELECT doc_id, path, (generate_subscripts(chunks, 1) - 1)::INT AS chunk_index, len(chunks)::INT AS total_chunks, unnest(chunks) AS chunk FROM ch)"


@R.add("d4_sentence_chunks", f"{_CHUNKS} SELECT doc_id, chunk_index, total_chunks, chunk FROM c")
def _(spark, base):
    return D.sentence_chunks(documents(spark, base), ["doc_id"])


@R.add("d5_window_chunks", f"SELECT doc_id, generate_subscripts(w, 1) - 1 AS chunk_index, unnest(w) AS chunk FROM (SELECT doc_id, {WINDOWS} AS w FROM documents WHERE length(text) > 0)")
def _(spark, base):
    return D.window_chunks(documents(spark, base), ["doc_id"]).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@R.add("w10_chunk_totals", f"SELECT doc_id, len(w) AS total_chunks, sum(len(w)) OVER (ORDER BY doc_id) - len(w) AS first_chunk FROM (SELECT doc_id, {WINDOWS} AS w FROM documents WHERE length(text) > 0)".replace("sum(len(w)) OVER (ORDER BY doc_id) - len(w)", "(sum(len(w)) OVER (ORDER BY doc_id) - len(w))::BIGINT"))
def _(spark, base):
    n = documents(spark, base).where(F.length("text") > 0).select("doc_id", F.size(X.fixed_windows("text")).cast("long").alias("total_chunks"))
    return U.running_total(n, "doc_id", "total_chunks", "first_chunk")


@R.add("d6_sections", """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^#{1,6}\\s+.+$'))) AS headings FROM t""")
def _(spark, base):
    heads = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?d)^#{1,6}\s+.+$")))
    return with_text(spark, base).select("doc_id", heads.cast("long").alias("headings"))


@R.add("d6_section_texts", f"SELECT doc_id, section_index, r.h AS heading, r.b AS body FROM (SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS section_index, unnest(s) AS r FROM (SELECT doc_id, {Z.sections('text')} AS s FROM documents WHERE text <> ''))")
def _(spark, base):
    return D.sections(documents(spark, base), ["doc_id"])


@R.add("d7_enriched_chunks", f"""WITH sec AS (SELECT doc_id, path, n, r.h AS section, r.b AS body FROM (SELECT doc_id, path, generate_subscripts(s, 1) AS n, unnest(s) AS r FROM (SELECT doc_id, path, {Z.sections('text')} AS s FROM documents WHERE text <> ''))),
{Z.chunks('sec', 'doc_id, path, n, section', 'body')}, c AS (SELECT doc_id, path, n, section, generate_subscripts(chunks, 1) AS i, unnest(chunks) AS original FROM ch),
f AS (SELECT *, {_EXT} AS e FROM (SELECT *, string_split(path, '/')[-1] AS n FROM (SELECT doc_id, path, section, (row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1)::INT AS chunk_index, original FROM c))),
g AS (SELECT *, concat_ws(' ', CASE WHEN n <> '' THEN '[Source: ' || n || ']' END, '[Section: ' || section || ']', '[Type: ' || ({_TYPES}) || ']') AS p FROM f)
SELECT doc_id, path, chunk_index, section, original, CASE WHEN p = '' THEN original ELSE CASE WHEN strlen(p) > 100 THEN substr(p, 1, 100) ELSE p END || chr(10) || chr(10) || original END AS chunk FROM g""")
def _(spark, base):
    return D.enriched(documents(spark, base, "doc_id", "path", "text"), ["doc_id", "path"])


@R.add("d13_flat_rows", f"{_CHUNKS} SELECT concat_ws('_', path, chunk_index) AS id, chunk_index, total_chunks, sha256(chunk) AS content_hash FROM c")
def _(spark, base):
    c = D.sentence_chunks(documents(spark, base, "doc_id", "path", "text"), ["doc_id", "path"])
    return c.select(F.concat_ws("_", "path", F.col("chunk_index").cast("string")).alias("id"), "chunk_index", "total_chunks", X.content_hash("chunk").alias("content_hash"))


@R.add("d14_flat_family", f"{_CHUNKS} SELECT CASE WHEN total_chunks = 1 THEN doc_id::VARCHAR ELSE doc_id || '::chunk::' || chunk_index END AS id, doc_id::VARCHAR AS original_id, chunk FROM c")
def _(spark, base):
    c = D.sentence_chunks(documents(spark, base), ["doc_id"])
    id_ = F.when(F.col("total_chunks") == 1, F.col("doc_id").cast("string")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("::chunk::"), F.col("chunk_index").cast("string")))
    return c.select(id_.alias("id"), F.col("doc_id").cast("string").alias("original_id"), "chunk")


@R.add("d15_flat_text", "SELECT doc_id, 0 AS layer, text, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def _(spark, base):
    return with_text(spark, base).select("doc_id", F.lit(0).alias("layer"), "text", X.content_hash("text").alias("content_hash"))


@R.add("d17_dedup_indexing", "SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL GROUP BY 2")
def _(spark, base):
    return with_text(spark, base).groupBy(X.content_hash("text").alias("file_hash")).agg(F.min("doc_id").alias("doc_id"))


_STEP = "CASE WHEN acc.items > 0 AND (acc.items >= 64 OR acc.chars + x.n > 128000) THEN {'n': 0::BIGINT, 'items': 1::BIGINT, 'chars': x.n, 'of': list_append(acc.of, acc.of[-1] + 1)} ELSE {'n': 0::BIGINT, 'items': acc.items + 1, 'chars': acc.chars + x.n, 'of': list_append(acc.of, coalesce(acc.of[-1], 0))} END"


@R.add("w9_embed_batches", f"""WITH s AS (SELECT doc_id, {Z.sentences('text')} AS parts FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, list_reduce(list_transform(parts, lambda p: {{'n': length(p), 'items': 0::BIGINT, 'chars': 0::BIGINT, 'of': []::INT[]}}), lambda acc, x: {_STEP}, {{'n': 0::BIGINT, 'items': 0::BIGINT, 'chars': 0::BIGINT, 'of': []::INT[]}}).of AS batches FROM s)
SELECT doc_id, (generate_subscripts(batches, 1) - 1)::INT AS sentence_index, unnest(batches) AS batch FROM b""")
def _(spark, base):
    """The sentences of each document packed in order into requests."""
    return D.embed_batches(documents(spark, base), ["doc_id"])


# ---- conversations ----------------------------------------------------------------------
_ROLE = f"CASE WHEN lower({strip('role')}) IN ('user', 'human') THEN 'user' WHEN lower({strip('role')}) IN ('assistant', 'bot', 'model') THEN 'assistant' WHEN lower({strip('role')}) IN ('reasoning', 'analysis', 'thinking', 'tool') THEN 'reasoning' END"
_TURNS = f"""told AS (SELECT session_id, block_no, {_ROLE} AS role, {strip('content')} AS text FROM raw_blocks WHERE session_id IS NOT NULL),
good AS (SELECT * FROM told WHERE role IS NOT NULL AND text <> ''),
turns AS (SELECT *, sum(CASE WHEN role = 'user' AND NOT first THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY block_no)::BIGINT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY block_no) = 1 AS first FROM good))"""


@R.add("d10_roles", f"SELECT coalesce({_ROLE}, 'none') AS known, count(*) AS n FROM raw_blocks GROUP BY 1")
def _(spark, base):
    return blocks(spark, base).groupBy(F.coalesce(U.role("role"), F.lit("none")).alias("known")).agg(F.count("*").alias("n"))


@R.add("d10_conversation_exports", f"""WITH told AS (SELECT session_id, block_no, {_ROLE} AS role, {strip('content')} AS text FROM raw_blocks WHERE session_id IS NOT NULL AND content IS NOT NULL)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY block_no) - 1 AS entry, role, text AS body FROM told WHERE role IS NOT NULL AND strlen(text) >= 20""")
def _(spark, base):
    """Sessions written as JSON exports, in a shape chosen by their hash, and read back by the extractor."""
    b = table(spark, base, "raw_blocks", "session_id", "block_no", "role", "content").where("session_id is not null and content is not null")
    m = F.struct("block_no", "role", F.col("role").alias("sender"), F.col("content").alias("text"))
    s = b.groupBy("session_id").agg(F.array_sort(F.collect_list(m)).alias("m"))  # the export files of the fixture
    nodes = F.map_from_entries(F.transform("m", lambda x: F.struct(x["block_no"].cast("string"), F.struct(F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(x["text"]).alias("parts")).alias("content"), x["block_no"].alias("create_time")).alias("message")))))
    shapes = [
        F.to_json(F.struct(F.array(F.struct(F.struct(F.col("session_id").alias("sessionId")).alias("info"), F.col("m").alias("messages"))).alias("sessions"))), F.to_json(F.struct(F.col("session_id").alias("uuid"), F.col("m").alias("messages"))),
        F.to_json(F.struct(F.col("session_id").alias("uuid"), F.col("m").alias("chat_messages"))), F.to_json(F.struct(F.col("session_id").alias("id"), nodes.alias("mapping"))),
    ]
    files = s.select("session_id", F.element_at(F.array(*shapes), (F.pmod(F.xxhash64("session_id"), F.lit(4)) + 1).cast("int")).alias("text"))
    return D.conversation_entries(files, ["session_id"]).select("session_id", "entry", "role", "body")


@R.add("w7_turns", f"WITH {_TURNS} SELECT session_id, block_no, role, turn FROM turns")
def _(spark, base):
    return U.turns(blocks(spark, base)).select("session_id", "block_no", "role", "turn")


@R.add("w8_repeats_dropped", f"WITH {_TURNS} SELECT session_id, block_no FROM turns QUALIFY lag(text) OVER (PARTITION BY session_id, turn, role ORDER BY block_no) = text")
def _(spark, base):
    t = U.turns(blocks(spark, base))
    return t.withColumn("p", F.lag("text").over(Window.partitionBy("session_id", "turn", "role").orderBy("block_no"))).where("p = text").select("session_id", "block_no")


_TURN_DOCS = f"""{_TURNS}, said AS (SELECT * FROM turns QUALIFY coalesce(lag(text) OVER (PARTITION BY session_id, turn, role ORDER BY block_no) <> text, true)),
s AS (SELECT session_id, turn, role, string_agg(text, chr(10) ORDER BY block_no) AS body FROM said GROUP BY 1, 2, 3),
d AS (SELECT session_id, turn, concat_ws(chr(10) || chr(10), max(CASE WHEN role = 'user' THEN 'User request:' || chr(10) || body END), max(CASE WHEN role = 'assistant' THEN 'Assistant response:' || chr(10) || body END), max(CASE WHEN role = 'reasoning' THEN 'Reasoning focus:' || chr(10) || body END)) AS content FROM s GROUP BY 1, 2),
docs_ AS (SELECT session_id, turn, content, session_id || '-' || lpad(turn::VARCHAR, greatest(4, length(turn::VARCHAR))::INT, '0') || '-' || substr(sha256(content), 1, 16) AS id FROM d WHERE strlen(content) >= 20)"""


@R.add("d8_turn_documents", f"WITH {_TURN_DOCS} SELECT session_id, turn, content, id FROM docs_")
def _(spark, base):
    return U.turn_documents(blocks(spark, base))


@R.add("t30_transcript_headers", f"""SELECT doc_id, nullif({strip("regexp_extract(i, '(^| [|] )project:(.*?)( [|] |$)', 2)")}, '') AS project, nullif({strip("regexp_extract(i, '(^| [|] )date:(.*?)( [|] |$)', 2)")}, '') AS day
FROM (SELECT doc_id, regexp_extract({strip('string_split(text, chr(10))[1]')}, '^\\[\\s*(project:.*)\\]$', 1, 's') AS i FROM documents WHERE text IS NOT NULL) WHERE i <> ''""")
def _(spark, base):
    head = F.element_at(F.split("text", "\n"), 1)
    d = with_text(spark, base).select("doc_id", U.header_field(head, "project").alias("project"), U.header_field(head, "date").alias("day"))
    return d.where("project is not null or day is not null")


@R.add("d9_transcript_entries", rf"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
e AS (SELECT *, regexp_extract(raw, '^\s*\[(\d\d:\d\d:\d\d)\]\s*([^:]*):\s*(.*)$', 1) AS tm, {strip("regexp_extract(raw, '^\\s*\\[(\\d\\d:\\d\\d:\\d\\d)\\]\\s*([^:]*):\\s*(.*)$', 2)")} AS role FROM l)
SELECT doc_id, count(*) AS entries, min(tm) AS first_time, max(tm) AS last_time FROM e WHERE lower(role) IN ('user', 'human', 'assistant', 'bot', 'model', 'reasoning', 'analysis', 'thinking', 'tool') GROUP BY 1""")
def _(spark, base):
    e = U.entry_lines(with_text(spark, base), ["doc_id"])
    return e.groupBy("doc_id").agg(F.count("*").alias("entries"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


_ENTRY = r"^\s*\[(\d\d:\d\d:\d\d)\]\s*([^:]*):\s*(.*)$"


@R.add("d9_transcript_turns", rf"""WITH tl AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) WHERE len(list_filter(x, lambda y: regexp_matches(y, '^\s*\[\s*project:.*\]\s*$'))) > 0),
ts AS (SELECT doc_id, line, {strip('raw')} AS raw FROM tl),
te AS (SELECT doc_id, line, raw, {_ROLE.replace('role', f"regexp_extract(raw, '{_ENTRY}', 2)", 3)} AS role, regexp_extract(raw, '{_ENTRY}', 3) AS body FROM ts),
ti AS (SELECT *, count(role) OVER w AS n, coalesce(arg_max(raw = '[signals]', line) FILTER (WHERE raw IN ('[signals]', '[/signals]')) OVER w, false) AS inside FROM te WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
raw_blocks AS (SELECT doc_id AS session_id, min(line) AS block_no, max(role) AS role, {strip("string_agg(CASE WHEN role IS NOT NULL THEN body ELSE raw END, chr(10) ORDER BY line)")} AS content FROM ti
  WHERE n > 0 AND (role IS NOT NULL OR (NOT inside AND raw NOT IN ('', '[signals]', '[/signals]'))) GROUP BY doc_id, n),
{_TURN_DOCS} SELECT session_id AS doc_id, turn, id, content FROM docs_""")
def _(spark, base):
    e = U.entry_lines(with_text(spark, base), ["doc_id"], headed=True)
    return U.turn_documents(e.withColumn("line", F.col("line").cast("long")), "doc_id", "line", "body", "role").select("doc_id", "turn", "id", "content")
