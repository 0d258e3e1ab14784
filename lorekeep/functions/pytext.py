"""Text algorithms that walk through a text step by step; operators call them on Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from itertools import groupby

# Words that are never keywords.
STOP_WORDS = frozenset(
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can this that these those i you he she it we they"
    " what which who whom when where why how all each every both few more most other some such no not only own same so than too very just also now here there then once if into through during before after"
    " above below between under again further about out over up down off any because until while".split()
)
# Abbreviations that don't end a sentence, and the sizes of layers in characters.
ABBREVIATIONS = ("Mr.", "Mrs.", "Dr.", "Prof.", "vs.", "etc.", "e.g.", "i.e.")
LAYER_SIZE = {"outer": 100, "middle": 300, "inner": 600}
SHORT = 200  # bytes below which a text isn't layered


def size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else "".join(c.lower() if c.isascii() else c for c in s)


_RUN = re.compile(r"[^\W_]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def keyword_tokens(text: str):
    for word in text.split():
        seen: list[str] = []
        for run in _RUN.findall(word):
            parts = ascii_lower(_HUMP.sub(" ", run)).split(" ")
            seen += parts
            whole = run.lower()
            if len(parts) > 1 and 3 <= size(whole) <= 30 and whole not in seen:
                seen.append(whole)
        yield from seen


def session_like(t: str) -> bool:
    digits = sum("0" <= c <= "9" for c in t)
    letters = sum(c.isascii() and c.isalpha() for c in t)
    n = size(t)
    return (n > 12 and all(c in "0123456789abcdefABCDEF" for c in t)) or digits >= 6 or (n > 20 and letters < n // 3)


def keywords(text: str, most: int) -> list[str]:
    """The most frequent tokens, ties in order of the token."""
    n = Counter(t for t in keyword_tokens(text) if 3 <= size(t) <= 30 and t not in STOP_WORDS and not session_like(t))
    return [t for t, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:most]]


def cut_words(text: str, most: int) -> str:
    if len(text) <= most:
        return text
    head = text[:most]
    at = head.rfind(" ")
    return (head if at < 0 else head[:at]) + "..."


def cut_sentence(text: str, most: int) -> str:
    """At most `most` characters: to a sentence end in the second half, else to white space, else hard."""
    if len(text) <= most:
        return text
    head = text[:most]
    at = max(head.rfind(c) for c in ".!?\n")
    if at > most // 2:
        return head[: at + 1]
    at = max(head.rfind(c) for c in " \t\n")
    return head if at < 0 else head[:at]


def sentences(text: str) -> list[str]:
    """Sentences by end mark and white space, and by blank lines; abbreviations and single capitals don't end one."""
    out, begin, i, n = [], 0, 0, len(text)

    def close(end: int, go_on: int) -> int:
        s = text[begin:end].strip()
        if s:
            out.append(s)
        return go_on

    while i < n:
        c = text[i]
        if c in ".!?":
            if i + 1 == n:
                begin = close(n, n)
            elif text[i + 1].isspace():
                tail = text[max(begin, i - 5) : i + 1]
                if not (tail.endswith(ABBREVIATIONS) or (len(tail) >= 2 and tail[-2].isupper())):
                    begin = close(i + 1, i + 2)
                    i += 1
        elif c == "\n" and text[i + 1 : i + 2] == "\n":
            begin = close(i + 1, i + 2)  # nothing but white space closes nothing
            i += 1
        i += 1
    if begin < n:
        close(n, n)
    return out


def sentence_chunks(text: str, target: int = 512, overlap: int = 128) -> list[str]:
    """Sentences packed to about `target` characters; each chunk begins with the last sentences of the one before."""
    parts = sentences(text)
    if not parts or len(text) <= target:
        return [text]
    carry = min(max(overlap // 50, 1), 3)
    chunks: list[str] = []
    now, recent = "", []

    def flush() -> str:
        chunks.append(now.strip())
        again = " ".join(recent)
        recent.clear()
        return again + " " if again else ""

    for s in parts:
        if now and len(now) + len(s) > target + target // 2:
            now = flush()
        now += s + " "
        recent.append(s)
        del recent[:-carry]
        if len(now) >= target:
            now = flush()
    rest = now.strip()
    if rest:
        if chunks and len(rest) < target // 4:
            chunks[-1] += " " + rest
        else:
            chunks.append(rest)
    return chunks or [text]


_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def sections(text: str) -> list[tuple[str | None, str]]:
    """(heading, body) of the parts between Markdown headings; blank parts are left out."""
    marks = [(m.start(), m.end(), m.group(2)) for m in _HEADING.finditer(text)]
    heads = [None, *(h for _, _, h in marks)]
    starts = [0, *(e for _, e, _ in marks)]
    ends = [*(s for s, _, _ in marks), len(text)]
    found = [(h, text[s:e].strip()) for h, s, e in zip(heads, starts, ends, strict=True) if text[s:e].strip()]
    return found or [(None, text)]


_END = re.compile(r"[.!?]")


def key_content(text: str, most: int) -> str:
    """The sentences that say most, up to about `most` bytes, in their order."""
    if size(text) <= most:
        return text
    parts = [p for p in (s.strip() for s in _END.split(text)) if p]
    if not parts:
        return cut_words(text, most)
    keys = set(keywords(text, 10))
    last = len(parts) - 1

    def worth(i: int) -> float:
        words = parts[i].split()
        hits = sum("".join(c for c in w if c.isalnum()).lower() in keys for w in words)
        place = 2.0 if i == 0 else 1.5 if i == last else 0.0
        return place + (3.0 * hits / len(words) if words else 0.0) - (0.5 if size(parts[i]) < 20 else 0.0)

    picked, used = [], 0
    for i in sorted(range(len(parts)), key=lambda i: -worth(i)):
        cost = size(parts[i]) + 2
        if picked and used + cost > most:
            break
        picked.append(i)
        used += cost
    return ". ".join(parts[i] for i in sorted(picked)) + "."


def outer_summary(text: str, keys: list[str], most: int = 100) -> str:
    prefix = f"[{', '.join(keys[:5])}] " if keys else ""
    room = max(0, most - size(prefix))
    first = _END.split(text, maxsplit=1)[0].strip()
    return prefix + (first if size(first) <= room else cut_words(first, room))


def slice_id(content: str, layer: str) -> str:
    return f"slice_{hashlib.sha256((content + layer).encode('utf-8', 'surrogatepass')).hexdigest()[:16]}_{layer}"


# ---- conversations --------------------------------------------------------
# Kinds of conversations, and labels and words in their texts.
CONVERSATION_TYPES = ("conversation", "transcript_turn")
CONVERSATION_FORMATS = ("markdown_transcript", "sessions", "claude_web", "chatgpt")
ROLE_LABELS = {"user": ("Request", "User request"), "assistant": ("Response", "Assistant response"), "reasoning": ("Reasoning", "Reasoning focus"), "system": ("Context", "System context"), "tool": ("Tool", "Tool output")}
HEADINGS = {"user request:": "user", "assistant response:": "assistant", "reasoning focus:": "reasoning"}
DECISION_LABELS = ("decision:", "decided:", "resolution:")
NEXT_LABELS = ("next action:", "next steps:", "next:", "todo:", "action item:", "follow-up:")
DECISION_WORDS = ("decid", "agreed", "going with", "chosen", "we will use", "resolved")
NEXT_WORDS = ("next", "todo", "follow up", "follow-up", "need to", "i'll", "we'll", "will add", "will wire", "plan to")


def is_conversation(meta: dict) -> bool:
    return meta.get("type") in CONVERSATION_TYPES or meta.get("format") in CONVERSATION_FORMATS


def squeeze(text: str) -> str:
    return " ".join(text.split())


def labelled(text: str, labels: tuple[str, ...]) -> str | None:
    """What stands behind the first of `labels` in a line, up to the next label of any kind."""
    every = DECISION_LABELS + NEXT_LABELS
    for line in (x.strip() for x in text.split("\n")):
        low = ascii_lower(line)
        for label in labels:
            at = low.find(label)
            if at < 0:
                continue
            rest = line[at + len(label) :]
            stops = [p for p in (ascii_lower(rest).find(o) for o in every) if p >= 0]
            found = rest[: min(stops, default=len(rest))].strip()
            if found:
                return cut_words(squeeze(found), 96)
    return None


def mentioning(text: str, words: tuple[str, ...]) -> str | None:
    for part in (*text.split("\n"), *_END.split(text)):
        low = ascii_lower(part)
        if part.strip() and any(w in low for w in words):
            return cut_words(squeeze(part), 96)
    return None


def entities(meta: dict, content: str) -> str | None:
    named = [meta[k].strip() for k in ("project", "title", "conversation", "session", "agent") if isinstance(meta.get(k), str)]
    found = [v for v in named if v and v != "unknown"] + [k for k in keywords(content, 6) if size(k) > 3]
    return cut_words(", ".join(k for k, _ in groupby(found)), 96) if found else None


def blocks(content: str, meta: dict) -> list[dict]:
    """The turns of a conversation text: heading, label, content, summary and facets of each."""
    lines = content.split("\n")
    heads = [(i, HEADINGS[k]) for i, line in enumerate(lines) if (k := ascii_lower(line.strip())) in HEADINGS]
    if heads:
        bounds = [*heads, (len(lines), "")]
        raw = [(role, "\n".join(lines[i + 1 : j]).strip()) for (i, role), (j, _) in zip(bounds, bounds[1:], strict=False)]
        raw = [(r, c) for r, c in raw if c] or [("transcript", content.strip())]
    elif meta.get("format") == "markdown_transcript":
        raw = [("transcript", content.strip())]
    else:
        raw = [(meta["role"] if isinstance(meta.get("role"), str) else "message", content.strip())]
    out = []
    for role, body in raw:
        if not body:
            continue
        key = {"human": "user", "bot": "assistant"}.get(k := ascii_lower(role.strip()), k)
        name = role.strip()
        label, heading = ROLE_LABELS.get(key, ("Message", name[:1].upper() + name[1:] if name else "Message"))
        line = next((squeeze(x) for x in body.split("\n") if x.strip()), squeeze(body))
        summary = cut_words(line, 96)
        facets: list[tuple[str, str]] = []
        for kind, value in ((label, summary), ("Decision", labelled(body, DECISION_LABELS) or mentioning(body, DECISION_WORDS)), ("Next", labelled(body, NEXT_LABELS) or mentioning(body, NEXT_WORDS)), ("Entities", entities(meta, body))):
            if value is not None and not any(kind == k or ascii_lower(value) == ascii_lower(v) for k, v in facets):
                facets.append((kind, value))
        out.append({"label": label, "heading": heading, "content": body, "summary": summary, "facets": facets})
    return out


def facet_lines(parts: list[dict], kinds: tuple[str, ...]) -> list[str]:
    every = (f"{k}: {v}" for kind in kinds for b in parts for k, v in [next(((k, v) for k, v in b["facets"] if k == kind), (None, None))] if k)
    return list(dict.fromkeys(every))


def packed(segments: list[str], most: int) -> str:
    text = ""
    for s in segments:
        grown = f"{text} | {s}" if text else s
        if len(grown) <= most:
            text = grown
            continue
        if not text:
            return cut_words(s, most)
        return text + " | …" if len(text) + 4 <= most else text
    return text


def conversation_layer(parts: list[dict], layer: str) -> str:
    most = LAYER_SIZE[layer]
    if layer == "outer":
        return packed([f"{b['label']}: {b['summary']}" for b in parts] + facet_lines(parts, ("Decision", "Next", "Entities")), most)
    if layer == "middle":
        width = {"Request": 36, "Response": 44}
        rows = [f"{b['label']}: {cut_words(b['summary'], width.get(b['label'], 40))}" for b in parts]
        rows += [cut_words(x, w) for kind, w in (("Decision", 44), ("Next", 44), ("Entities", 36)) for x in facet_lines(parts, (kind,))]
        return cut_words("\n".join(rows), most)
    each = max(most // max(len(parts), 1), 120)
    rows = [f"{b['heading']}:\n{cut_words(squeeze(b['content']), each)}" for b in parts]
    details = facet_lines(parts, ("Decision", "Next", "Entities"))
    return cut_words("\n\n".join([*rows, "\n".join(details)] if details else rows), most)


def slices(content: str, meta: dict, fast: bool = False) -> list[dict]:
    """The layers of a text from outer to core; each but the core has the next as parent and the one before as child.

    A short text becomes one core slice, or outer and core in a conversation.
    """
    content = content.strip()
    talk = is_conversation(meta)
    short = size(content) < SHORT
    if short and not talk:
        return [{"id": slice_id(content, "core"), "layer": 4, "content": content, "parent_id": None, "children_ids": [], "keywords": keywords(content, 5)}]
    core_keys = keywords(content, 10)
    made: list[tuple[str, int, str, list[str]]] = []
    wanted = ("outer",) if fast or short else ("inner", "middle", "outer")
    if talk:
        parts = blocks(content, meta)
        texts = {layer: conversation_layer(parts, layer) for layer in wanted}
    else:
        texts, source = {}, content
        for layer in wanted:
            source = texts[layer] = outer_summary(source, core_keys) if layer == "outer" else key_content(source, LAYER_SIZE[layer])
    for layer, code, n in (("outer", 1, 3), ("middle", 2, 5), ("inner", 3, 7)):
        if layer in texts:
            made.append((layer, code, texts[layer], keywords(texts[layer], n)))
    made.append(("core", 4, content, core_keys))
    ids = [slice_id(text, layer) for layer, _, text, _ in made]
    return [
        {"id": ids[i], "layer": code, "content": text, "parent_id": ids[i + 1] if i + 1 < len(made) else None, "children_ids": [ids[i - 1]] if i else [], "keywords": keys}
        for i, (_, code, text, keys) in enumerate(made)
    ]


# ---- JSON -----------------------------------------------------------------
def json_text(value, most_elements: int | None = None, most_messages: int | None = None, most_observations: int | None = None, most_chars: int | None = None) -> str:
    """Readable text of a JSON value: message fields, role and content, nested messages, observations, title.

    Limits, off by default: elements of an array, nested messages, observations, characters of a value without text.
    """
    within = lambda v: json_text(v, most_elements, most_messages, most_observations, most_chars)
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in map(within, value[:most_elements]) if t)
    if not isinstance(value, dict):
        return json.dumps(value)
    parts = [v for k in ("content", "text", "message", "summary", "description", "body") if isinstance(v := value.get(k), str) and v]
    role, content = value.get("role"), value.get("content")
    if isinstance(role, str):
        if isinstance(content, str):
            parts.append(f"{role}: {content}")
        elif isinstance(content, list):
            parts += [f"{role}: {b['text']}" for b in content if isinstance(b, dict) and isinstance(b.get("text"), str)]
    for k in ("messages", "chat_messages"):
        if isinstance(value.get(k), list):
            parts += [t for t in map(within, value[k][:most_messages]) if size(t) > 10]
    if isinstance(value.get("name"), str) and isinstance(value.get("observations"), list):
        seen = [o for o in value["observations"] if isinstance(o, str)][:most_observations]
        if seen:
            parts.append(f"{value['name']}: {'; '.join(seen)}")
    title = next((value[k] for k in ("title", "name", "uuid", "id") if isinstance(value.get(k), str)), "")
    if title and not any(title in p for p in parts):
        parts.insert(0, f"[{title}]")
    return "\n".join(parts) if parts else json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)[:most_chars]


def json_kind(value) -> str:
    if isinstance(value, dict):
        has = value.keys()
        for kind, keys in (("conversation", ("chat_messages",)), ("conversation", ("mapping",)), ("session", ("messages", "sessions")), ("message", ("role", "content")), ("entity", ("observations", "name")), ("thread", ("messages",))):
            if all(k in has for k in keys):
                return kind
        return "object"
    return "array" if isinstance(value, list) else "text" if isinstance(value, str) else "value"


def embed_batches(sizes: list[int], most_items: int = 64, most_chars: int = 128_000) -> list[int]:
    """The batch number of each text when texts are packed in order by number and characters."""
    out, batch, items, chars = [], 0, 0, 0
    for n in sizes:
        if items and (items >= most_items or chars + n > most_chars):
            batch, items, chars = batch + 1, 0, 0
        out.append(batch)
        items, chars = items + 1, chars + n
    return out


def known_role(value) -> str | None:
    low = ascii_lower(value.strip()) if isinstance(value, str) else ""
    for role, spelled in (("user", ("user", "human")), ("assistant", ("assistant", "bot", "model")), ("reasoning", ("reasoning", "analysis", "thinking", "tool"))):
        if low in spelled:
            return role
    return None


def _plain_message(m: dict, who: str, when: str) -> tuple:
    text = m.get("text")
    if not isinstance(text, str):
        content = m.get("content")
        parts = content if isinstance(content, list) else []
        text = content if isinstance(content, str) else " ".join(b["text"] for b in parts if isinstance(b, dict) and isinstance(b.get("text"), str))
    return m.get(who), m.get(when), text


def _node_message(node) -> tuple:
    m = node.get("message") if isinstance(node, dict) else None
    m = m if isinstance(m, dict) else {}
    author, content = m.get("author"), m.get("content")
    parts = content.get("parts") if isinstance(content, dict) else None
    at = m.get("create_time")
    text = " ".join(p for p in parts if isinstance(p, str)) if isinstance(parts, list) else ""
    return author.get("role") if isinstance(author, dict) else None, at if isinstance(at, int | float) else None, text


def conversation_entries(value) -> list[dict]:
    """(session, entry, role, time, text) of the messages of a conversation export in any of four shapes.

    sessions of messages, one list of messages, chat messages by sender, or a
    mapping of nodes in order of their creation.  Unknown roles and texts under
    20 bytes are left out.  An array gives the conversations of its elements.
    """
    if isinstance(value, list):
        return [e for v in value for e in conversation_entries(v)]
    if not isinstance(value, dict):
        return []
    name = lambda *keys: next((value[k] for k in keys if isinstance(value.get(k), str)), "unknown")[:8]
    talks: list[tuple[str, list[tuple]]] = []
    if isinstance(value.get("sessions"), list):
        for s in (s for s in value["sessions"] if isinstance(s, dict)):
            info = s.get("info") if isinstance(s.get("info"), dict) else {}
            id_ = info.get("sessionId") if isinstance(info.get("sessionId"), str) else "unknown"
            talks.append((f"sess-{id_[:8]}", [_plain_message(m, "role", "timestamp") for m in s.get("messages") or [] if isinstance(m, dict)]))
    elif isinstance(value.get("messages"), list):
        who = lambda m: "sender" if "sender" in m else "role"
        talks.append((f"conv-{name('uuid', 'id')}", [_plain_message(m, who(m), "created_at" if "created_at" in m else "timestamp") for m in value["messages"] if isinstance(m, dict)]))
    elif isinstance(value.get("chat_messages"), list):
        talks.append((f"chat-{name('uuid')}", [_plain_message(m, "sender", "created_at") for m in value["chat_messages"] if isinstance(m, dict)]))
    elif isinstance(value.get("mapping"), dict):
        nodes = sorted(map(_node_message, value["mapping"].values()), key=lambda m: m[1] or 0)
        talks.append((f"gpt-{name('id', 'conversation_id')}", nodes))
    out = []
    for session, messages in talks:
        told = [(known_role(r), t, (x or "").strip()) for r, t, x in messages]
        out += [{"session": session, "role": r, "time": None if t is None else str(t), "body": x} for r, t, x in told if r and size(x) >= 20]
    return [{"entry": i, **e} for i, e in enumerate(out)]
