"""DuckDB SQL for the text algorithms that walk through a text: sentences, chunks, sections, key content, conversations, layers."""

from __future__ import annotations

import re

from ..functions import pytext as P
from .registry import WS, collapse, cut_words, pieces, strip

NL = "chr(10)"
_ASCII = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def low(c: str) -> str:
    return _ASCII.format(x=c)


def texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def cut_sentence(c: str, most: int) -> str:
    head = f"substr({c}, 1, {most})"
    end = f"regexp_extract({head}, '^.*[.!?\\n]', 0, 's')"
    return f"CASE WHEN length({c}) <= {most} THEN {c} WHEN length({end}) - 1 > {most // 2} THEN {end} WHEN regexp_matches({head}, '[ \\t\\n]') THEN regexp_extract({head}, '^(.*)[ \\t\\n]', 1, 's') ELSE {head} END"


def sentences(c: str) -> str:
    """Ends that don't count get a mark behind them, then texts are split behind the others."""
    short = "|".join(re.escape(a) for a in P.ABBREVIATIONS)
    kept = f"regexp_replace({c}, '(\\p{{Lu}}[.!?])({WS})', '\\1' || chr(2) || '\\2', 'g')"
    kept = f"regexp_replace({kept}, '({short})({WS})', '\\1' || chr(2) || '\\2', 'g')"
    ends = f"replace(regexp_replace({kept}, '([.!?]){WS}', '\\1' || chr(1), 'g'), chr(10) || chr(10), chr(1))"
    return f"list_filter(list_transform(string_split(replace({ends}, chr(2), ''), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


def chunks(src: str, keys: str, c: str, target: int = 512, overlap: int = 128, p: str = "") -> str:
    """CTE {p}ch(keys, chunks) for rows of `src` with text."""
    carry = min(max(overlap // 50, 1), 3)
    again = "CASE WHEN len({r}) > 0 THEN array_to_string({r}, ' ') || ' ' ELSE '' END"
    flush = f"(acc.now <> '' AND length(acc.now) + length(x.s) > {target + target // 2})"
    n1 = f"CASE WHEN {flush} THEN {again.format(r='acc.recent')} ELSE acc.now END"
    r1 = f"CASE WHEN {flush} THEN []::VARCHAR[] ELSE acc.recent END"
    c1 = f"CASE WHEN {flush} THEN list_append(acc.chunks, {strip('acc.now')}) ELSE acc.chunks END"
    n2, r2 = f"(({n1}) || x.s || ' ')", f"(list_append({r1}, x.s)[-{carry}:])"
    full = f"length({n2}) >= {target}"
    state = f"{{'s': '', 'now': CASE WHEN {full} THEN {again.format(r=r2)} ELSE {n2} END, 'recent': CASE WHEN {full} THEN []::VARCHAR[] ELSE {r2} END, 'chunks': CASE WHEN {full} THEN list_append({c1}, {strip(n2)}) ELSE {c1} END}}"
    empty = "'now': '', 'recent': []::VARCHAR[], 'chunks': []::VARCHAR[]"
    return f"""{p}cp AS (SELECT {keys}, {c} AS body, {sentences(c)} AS parts FROM {src} WHERE {c} <> ''),
{p}cs AS (SELECT {keys}, body, parts, list_reduce(list_transform(parts, lambda s: {{'s': s, {empty}}}), lambda acc, x: {state}, {{'s': '', {empty}}}) AS st FROM {p}cp),
{p}cr AS (SELECT *, {strip('st.now')} AS rest FROM {p}cs),
{p}ch AS (SELECT {keys}, CASE WHEN len(parts) = 0 OR length(body) <= {target} THEN [body] WHEN rest = '' THEN st.chunks
  WHEN len(st.chunks) > 0 AND length(rest) < {target // 4} THEN list_append(st.chunks[1:len(st.chunks) - 1], st.chunks[-1] || ' ' || rest) ELSE list_append(st.chunks, rest) END AS chunks FROM {p}cr)"""


def sections(c: str) -> str:
    """A list of (h, b): headings with their bodies."""
    mark = f"(?m)^#{{1,6}}{WS}+(.+)$"
    bodies = f"list_transform(regexp_split_to_array({c}, '{mark.replace('(.+)', '.+')}'), lambda x: {strip('x')})"
    found = f"list_filter(list_transform(range(1, len({bodies}) + 1), lambda i: {{'h': CASE WHEN i > 1 THEN regexp_extract_all({c}, '{mark}', 1)[i - 1] END, 'b': {bodies}[i]}}), lambda r: r.b <> '')"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{{'h': NULL::VARCHAR, 'b': {c}}}] END"


def tokens(src: str, key: str, text: str, most: int, p: str) -> str:
    """CTE {p}kw(key, token, place): the keywords of every text."""
    from .text_queries import sql_keywords, sql_tokens

    return re.sub(r"\bk([rstw])\b", rf"{p}k\1", f"{sql_tokens(src, key, text)}, {sql_keywords(key, most)}")


def key_content(src: str, key: str, c: str, most: int, p: str) -> str:
    """CTE {p}kc(key, content)."""
    words = pieces("part")
    bare = r"lower(regexp_replace(w, '[^\p{L}\p{N}]+', '', 'g'))"
    return f"""{tokens(src, key, c, 10, p)},
{p}kl AS (SELECT {key}, list(token) AS keys FROM {p}kw GROUP BY {key}),
{p}pp AS (SELECT {key}, {c} AS body, list_filter(list_transform(regexp_split_to_array({c}, '[.!?]'), lambda x: {strip('x')}), lambda x: x <> '') AS parts FROM {src} WHERE {c} IS NOT NULL),
{p}pu AS (SELECT {key}, len(parts) AS total, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM {p}pp),
{p}pw AS (SELECT u.*, {words} AS ws, coalesce(keys, []::VARCHAR[]) AS keys FROM {p}pu u LEFT JOIN {p}kl USING ({key})),
{p}ps AS (SELECT *, (CASE WHEN i = 1 THEN 2 WHEN i = total THEN 1.5 ELSE 0 END)::DOUBLE + CASE WHEN len(ws) > 0 THEN 3::DOUBLE * len(list_filter(ws, lambda w: list_contains(keys, {bare}))) / len(ws) ELSE 0 END - (CASE WHEN strlen(part) < 20 THEN 0.5 ELSE 0 END)::DOUBLE AS worth FROM {p}pw),
{p}pr AS (SELECT *, sum(strlen(part) + 2) OVER w AS used, row_number() OVER w AS place FROM {p}ps WINDOW w AS (PARTITION BY {key} ORDER BY worth DESC, i ROWS UNBOUNDED PRECEDING)),
{p}pj AS (SELECT {key}, string_agg(part, '. ' ORDER BY i) || '.' AS joined FROM {p}pr WHERE place = 1 OR used <= {most} GROUP BY {key}),
{p}kc AS (SELECT {key}, CASE WHEN strlen(body) <= {most} THEN body WHEN len(parts) = 0 THEN {cut_words('body', most)} ELSE joined END AS content FROM {p}pp LEFT JOIN {p}pj USING ({key}))"""


# ---- conversations ------------------------------------------------------------------------
def _labelled(body: str, labels) -> str:
    line = strip("l")
    rest = f"substr({line}, instr({low(line)}, b) + length(b))"
    stop = f"list_min(list_filter(list_transform({texts(P.DECISION_LABELS + P.NEXT_LABELS)}, lambda o: instr({low(rest)}, o)), lambda q: q > 0))"
    found = f"CASE WHEN instr({low(line)}, b) > 0 THEN {strip(f'substr({rest}, 1, coalesce({stop} - 1, length({rest})))')} END"
    every = f"flatten(list_transform(string_split({body}, {NL}), lambda l: list_transform({texts(labels)}, lambda b: {found})))"
    return f"list_filter({every}, lambda x: x IS NOT NULL AND x <> '')[1]"


def _mentioning(body: str, words) -> str:
    return f"list_filter(list_concat(string_split({body}, {NL}), regexp_split_to_array({body}, '[.!?]')), lambda y: {strip('y')} <> '' AND len(list_filter({texts(words)}, lambda w: contains({low('y')}, w))) > 0)[1]"


def facets(src: str, key: str, c: str, meta: dict[str, str], p: str = "f") -> str:
    """CTE {p}f(key, block, blocks, label, heading, body, summary, decision, next_action, entities) of texts `c`; `meta` has SQL for its text fields."""
    field = lambda k: f"({meta.get(k, 'NULL::VARCHAR')})"
    heads = "CASE {h} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.HEADINGS.items()) + " END"
    head = heads.format(h=low(strip("lines[i]")))
    names = [f"CASE WHEN {strip(field(k))} NOT IN ('', 'unknown') THEN {strip(field(k))} END" for k in ("project", "title", "conversation", "session", "agent")]
    label = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in P.ROLE_LABELS.items()) + " ELSE 'Message' END"
    heading = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in P.ROLE_LABELS.items()) + " ELSE CASE WHEN name = '' THEN 'Message' ELSE upper(substr(name, 1, 1)) || substr(name, 2) END END"
    first = f"coalesce(list_filter(list_transform(string_split(body, {NL}), lambda x: {collapse('x')}), lambda x: x <> '')[1], {collapse('body')})"
    cut = lambda x: cut_words(collapse(x), 96)
    said = lambda labels, words: f"coalesce({cut(_labelled('body', labels))}, {cut(_mentioning('body', words))})"
    return f"""{p}l AS (SELECT {key}, {c} AS whole, string_split({c}, {NL}) AS lines, [{', '.join(names)}] AS named, {field('role')} AS role, {field('format')} AS format FROM {src} WHERE {c} IS NOT NULL),
{p}h AS (SELECT *, list_filter(list_transform(range(1, len(lines) + 1), lambda i: {{'at': i, 'role': {head}}}), lambda x: x.role IS NOT NULL) AS heads FROM {p}l),
{p}r AS (SELECT *, list_filter(list_transform(range(1, len(heads) + 1), lambda i: {{'role': heads[i].role, 'body': {strip(f"array_to_string(lines[heads[i].at + 1:CASE WHEN i < len(heads) THEN heads[i + 1].at - 1 ELSE len(lines) END], {NL})")}}}), lambda x: x.body <> '') AS raw FROM {p}h),
{p}q AS (SELECT {key}, named, list_filter(CASE WHEN len(raw) > 0 THEN raw WHEN len(heads) > 0 OR format = 'markdown_transcript' THEN [{{'role': 'transcript', 'body': {strip('whole')}}}] ELSE [{{'role': coalesce(role, 'message'), 'body': {strip('whole')}}}] END, lambda x: x.body <> '') AS raw FROM {p}r),
{p}u AS (SELECT {key}, named, len(raw) AS blocks, generate_subscripts(raw, 1) - 1 AS block, unnest(raw) AS b FROM {p}q),
{p}v AS (SELECT *, row_number() OVER () AS bid, b.body AS body, {strip('b.role')} AS name FROM {p}u),
{p}n AS (SELECT *, CASE {low('name')} WHEN 'human' THEN 'user' WHEN 'bot' THEN 'assistant' ELSE {low('name')} END AS k FROM {p}v),
{tokens(f'{p}n', 'bid', 'body', 6, p)},
{p}e AS (SELECT bid, list(token ORDER BY place) FILTER (WHERE strlen(token) > 3) AS keys FROM {p}kw GROUP BY bid),
{p}m AS (SELECT *, list_filter(list_concat(named, coalesce(keys, []::VARCHAR[])), lambda x: x IS NOT NULL) AS found FROM {p}n LEFT JOIN {p}e USING (bid)),
{p}d AS (SELECT {key}, block, blocks, body, {label} AS label, {heading} AS heading, {cut_words(first, 96)} AS summary, {said(P.DECISION_LABELS, P.DECISION_WORDS)} AS d0, {said(P.NEXT_LABELS, P.NEXT_WORDS)} AS n0,
  array_to_string(list_filter(list_transform(range(1, len(found) + 1), lambda i: CASE WHEN i = 1 OR found[i] <> found[i - 1] THEN found[i] END), lambda x: x IS NOT NULL), ', ') AS e1, len(found) AS e2 FROM {p}m),
{p}x AS (SELECT *, CASE WHEN {low('d0')} <> {low('summary')} THEN d0 END AS decision, CASE WHEN e2 > 0 THEN {cut_words('e1', 96)} END AS e0 FROM {p}d),
{p}y AS (SELECT *, CASE WHEN {low('n0')} <> {low('summary')} AND {low('n0')} IS DISTINCT FROM {low('decision')} THEN n0 END AS next_action FROM {p}x),
{p}f AS (SELECT *, CASE WHEN {low('e0')} <> {low('summary')} AND {low('e0')} IS DISTINCT FROM {low('decision')} AND {low('e0')} IS DISTINCT FROM {low('next_action')} THEN e0 END AS entities FROM {p}y)"""


def _facet_lines(parts: str, kinds) -> str:
    """Lines of the kinds given, repeats left out, over a list of blocks."""
    column = {"Decision": "decision", "Next": "next_action", "Entities": "entities"}
    every = "list_concat(" + ", ".join(f"list_transform({parts}, lambda b: '{k}: ' || b.{column[k]})" for k in kinds) + ")" if len(kinds) > 1 else f"list_transform({parts}, lambda b: '{kinds[0]}: ' || b.{column[kinds[0]]})"
    kept = f"list_filter({every}, lambda x: x IS NOT NULL)"
    return f"list_filter(list_transform(range(1, len({kept}) + 1), lambda i: CASE WHEN NOT list_contains(({kept})[1:i - 1], ({kept})[i]) THEN ({kept})[i] END), lambda x: x IS NOT NULL)"


def conversation_layers(src: str, key: str, p: str = "t") -> str:
    """CTE {p}l(key, outer_text, middle_text, inner_text) from the facets `src`."""
    kinds = ("Decision", "Next", "Entities")
    width = "CASE b.label WHEN 'Request' THEN 36 WHEN 'Response' THEN 44 ELSE 40 END"
    rows = f"list_transform(parts, lambda b: b.label || ': ' || {cut_words('b.summary', width)})"
    for kind, w in (("Decision", 44), ("Next", 44), ("Entities", 36)):
        rows = f"list_concat({rows}, list_transform({_facet_lines('parts', (kind,))}, lambda x: {cut_words('x', w)}))"
    each = "greatest(600 // greatest(len(parts), 1), 120)"
    told = f"list_transform(parts, lambda b: b.heading || ':' || {NL} || {cut_words(collapse('b.body'), each)})"
    grown = "CASE WHEN acc.t = '' THEN x.t ELSE acc.t || ' | ' || x.t END"
    stopped = f"CASE WHEN acc.t = '' THEN {cut_words('x.t', 100)} WHEN length(acc.t) + 4 <= 100 THEN acc.t || ' | …' ELSE acc.t END"
    step = f"CASE WHEN acc.done THEN acc WHEN length({grown}) <= 100 THEN {{'t': {grown}, 'done': false}} ELSE {{'t': {stopped}, 'done': true}} END"
    return f"""{p}p AS (SELECT {key}, list({{'label': label, 'heading': heading, 'body': body, 'summary': summary, 'decision': decision, 'next_action': next_action, 'entities': entities}} ORDER BY block) AS parts FROM {src} GROUP BY {key}),
{p}s AS (SELECT {key}, parts, list_concat(list_transform(parts, lambda b: b.label || ': ' || b.summary), {_facet_lines('parts', kinds)}) AS segments, array_to_string({_facet_lines('parts', kinds)}, {NL}) AS details FROM {p}p),
{p}l AS (SELECT {key}, list_reduce(list_transform(segments, lambda x: {{'t': x, 'done': false}}), lambda acc, x: {step}, {{'t': '', 'done': false}}).t AS outer_text,
  {cut_words(f"array_to_string({rows}, {NL})", 300)} AS middle_text, {cut_words(f"array_to_string(CASE WHEN details <> '' THEN list_append({told}, details) ELSE {told} END, {NL} || {NL})", 600)} AS inner_text FROM {p}s)"""


def layers(src: str, key: str, c: str, meta: dict[str, str]) -> str:
    """CTEs up to sl(key, layer, content, id, keywords): all layers of the texts `c`."""
    talk = f"(coalesce({meta['type']} IN {tuple(P.CONVERSATION_TYPES)}, false) OR coalesce({meta['format']} IN {tuple(P.CONVERSATION_FORMATS)}, false))"
    first = strip("regexp_extract(m.content, '^[^.!?]*')")
    prefix = "coalesce('[' || array_to_string(keys[1:5], ', ') || '] ', '')"
    names = "CASE layer WHEN 1 THEN 'outer' WHEN 2 THEN 'middle' WHEN 3 THEN 'inner' ELSE 'core' END"
    most = "CASE layer WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 7 ELSE CASE WHEN lone THEN 5 ELSE 10 END END"
    return f"""tx AS (SELECT *, {strip(c)} AS content, strlen({strip(c)}) < 200 AS short, {talk} AS talk FROM {src} WHERE {c} IS NOT NULL),
plain AS (SELECT * FROM tx WHERE NOT talk AND NOT short),
{tokens('plain', key, 'content', 10, 'c')},
ck AS (SELECT {key}, list(token ORDER BY place) AS keys FROM ckw GROUP BY {key}),
{key_content('plain', key, 'content', 600, 'i')},
{key_content('ikc', key, 'content', 300, 'm')},
os AS (SELECT m.{key}, {prefix} AS prefix, {first} AS first FROM mkc m LEFT JOIN ck USING ({key})),
oc AS (SELECT {key}, prefix, first, greatest(0, 100 - strlen(prefix)) AS room FROM os),
talks AS (SELECT * FROM tx WHERE talk),
{facets('talks', key, 'content', meta, 'z')},
{conversation_layers('zf', key, 'y')},
al AS (SELECT {key}, 4 AS layer, content, short AND NOT talk AS lone FROM tx
  UNION ALL SELECT {key}, 3, content, false FROM ikc UNION ALL SELECT {key}, 2, content, false FROM mkc
  UNION ALL SELECT {key}, 1, prefix || CASE WHEN strlen(first) <= room THEN first ELSE {cut_words('first', 'room')} END, false FROM oc
  UNION ALL SELECT {key}, 1, coalesce(outer_text, ''), false FROM talks LEFT JOIN yl USING ({key}) UNION ALL SELECT {key}, 2, coalesce(middle_text, ''), false FROM talks LEFT JOIN yl USING ({key}) WHERE NOT short UNION ALL SELECT {key}, 3, coalesce(inner_text, ''), false FROM talks LEFT JOIN yl USING ({key}) WHERE NOT short),
an AS (SELECT *, {key} * 10 + layer AS lid FROM al),
{tokens('an', 'lid', 'content', 10, 's')},
sl AS (SELECT {key}, layer, content, 'slice_' || substr(sha256(content || {names}), 1, 16) || '_' || {names} AS id, coalesce((SELECT string_agg(token, ',' ORDER BY place) FROM skw WHERE skw.lid = an.lid AND place <= {most}), '') AS keywords FROM an)"""
