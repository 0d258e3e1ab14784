"""Personal information in free text: finding it, and replacing it.

`find` gives the spans of email addresses (also disguised ones), phone numbers,
identity numbers, street addresses and person names.  Names are found from a
lexicon of given and family names, from the tokens beside them, and from words
that introduce a person; names inside email addresses and street addresses
don't count.

`replaced` writes a typed placeholder in place of each.  `surrogates` writes
keyed stand-ins of the same type and format instead: equal people, numbers and
addresses get equal stand-ins across all texts and spellings, different ones
get different ones, and no stand-in is a value that occurs.  Digits stay
digits, capitals stay capitals, order and disguise of the original are kept.
Numbers with a valid check digit or letter get a valid one.  Names keep their
script and the gender that a title, the name or its ending shows; an initial is taken for the one full name of the text that it fits.

Null texts give null; empty texts stay empty.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._given import gender, script, syllables
from ._spark import cut, small, written

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
MOST_NAMES = 1_000_000  # lexicon rows that may be sent to the executors

# ---- patterns -------------------------------------------------------------
_OPEN, _SHUT = r"[(\[{<][ ]?", r"[ ]?[)\]}>]"  # brackets of a disguised address
_AT = rf"(?:@|＠|[ ]?{_OPEN}(?i:at|@){_SHUT}[ ]?)"
_DOT = r"(?:\.|[ ]?[(\[{][ ]?(?i:dot|\.)[ ]?[)\]}][ ]?)"
_LOCAL = r"(?<![\w.+%'-])[\w](?:[\w.+%'-]*[\w])?"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
EMAIL = re.compile(
    rf"{_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}}|[ ](?i:at)[ ]{_LABEL}(?:[ ](?i:dot)[ ]{_LABEL})*[ ](?i:dot)[ ][^\W\d_]{{2,}})(?![\w@])"
)
EXT = r"(?:[ ]?(?:ext\.?|x|Durchwahl|wew\.)[ ]?\d{1,6})?"
PHONE = re.compile(
    r"(?<![\d+])(?:(?<![\w])|(?<=tel\.)|(?<=Tel\.))(?:"
    r"(?:\+|\b00)1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:\+|\b00)44[ -]?(?:\(0\)[ ]?)?(?:\d{4}[ -]?\d{6}|\d{2,3}[ -]\d{4}[ -]?\d{4}|\d{4}[ -]\d{3}[ -]\d{3})"
    r"|(?:\+|\b00)49[ -]?(?:\(0\)[ ]?)?\d{2,4}[ /-]?\d{3,8}(?:[ -]\d{2,4})?"
    r"|(?:\+|\b00)(?:33|32|41)[ .-]?\d(?:[ .-]?\d{2}){4}"
    r"|(?:\+|\b00)(?:48|34|351)[ -]?(?:\d{3}[ -]?\d{3}[ -]?\d{3}|\d{2}(?:[ -]\d{2,3}){3})"
    r"|\+\d{1,3}(?:[ .-]?\(?\d{2,5}\)?){2,4}"
    r"|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3}[ ]\d{3}[ ]\d{4}"
    r"|\(?0\d{2,4}\)?[ /-]\d{3,4}[ -]\d{3,4}|0\d{4}[ -]\d{6}|0\d(?:[ .]\d{2}){4}"
    rf"){EXT}(?![\d-])"
)
CALLED = re.compile(
    r"(?i:(?<!\w)(?:tel|phone|telefon|teléfono|mobile|mobil|cell|fax|call|sms|whatsapp|zadzwoń|llama al|rufen sie|answered on|number is|numer)[\"']?[.:]?[ \"']{0,3})$"
)
CALLED_NUMBER = re.compile(r"\+?\(?\d[\d ().-]{5,15}\d(?![\d:])")
NUMBER_RUN = re.compile(r"[+(\d][\d() ./+-]{6,}+")  # where numbers of several digits may stand; as short as the shortest CALLED_NUMBER
ID = re.compile(
    r"(?<![\w.#/+-])(?:\d{3}-\d{2}-\d{4}|\d{3}[ ]\d{2}[ ]\d{4}|\d{11}|\d{8}[ -]?[A-Z]|[XYZ][ -]?\d{7}[ -]?[A-Z]|[A-Z]{2}[ ]?\d{7})(?![\w/]|[.:-]\d|-\w)"
)
NAMED_ID = re.compile(
    r"(?:(?i:\b(?:ssn|social security(?: number)?|national id|pesel|dni|nie|nif|passport|paszport|pasaporte|reisepass(?:nummer)?|personalausweis|ausweis(?:nummer)?|id card)\b)(?i:[ ]?(?:no|nr|number|num)\b\.?)?[ ]?[:#]?[ ]?)([A-Z]{0,3}[ -]?\d[\d -]{4,14}\d(?:-?[A-Z]\b)?)(?!\w)"
)
_SW = r"(?:[^\W\d_][\w'’-]*\.?)"
# number, words, kind of street
STREET_EN = re.compile(
    rf"\d{{1,5}}(?:[ ]?[A-Za-z](?=[ ]))?,?[ ](?:{_SW}[ ]){{1,3}}?(?:(?i:street|road|lane|avenue|boulevard|drive|court|crescent|terrace|close|square|place|parkway|highway)\b|(?i:st|rd|ln|ave|blvd|dr)\b\.?)"
    r"(?:,?[ ](?i:apt|flat|unit|suite)\.?[ ]?\w{1,5}\b)?"
)
# name with the kind of street at its end, then number; the number is looked for first
STREET_DE = re.compile(r"[ ]\d{1,4}[ ]?[a-zA-Z]?\b")
DE_KINDS = ("straße", "strasse", "str.", "gasse", "allee")
DE_CAPITAL_KINDS = ("weg", "platz", "ring", "damm", "ufer")
DE_LEAD = re.compile(r"(?i)(?:alt|neu|lang|kurz|groß|klein|ober|unter)e[rsnm]?|am|an|im")
# a word for street, name, number
STREET_PL = re.compile(r"[uUaAoOpP][lLsS]\.[ ]?(?:[^\W\d_][\w.'’-]*[ ]){1,3}\d{1,4}[a-zA-Z]?(?:[ ]?/[ ]?\d{1,4}[a-zA-Z]?)?\b")
PL_WORDS = frozenset(("ul", "al", "os", "pl"))
STREET_ES = re.compile(r"[cCaApP](?i:alle|venida|vda\.|aseo|laza|amino|arrera|/)[ ]?(?:[^\W\d_][\w.'’-]*,?[ ]){1,5}\d{1,4}[a-zA-Z]?\b")
STREET_FR = re.compile(r"\d{1,4},?[ ](?i:rue|impasse|quai)(?:[ ][^\W\d_][\w'’-]*){1,4}")
# ---- fixed values ---------------------------------------------------------
# words inside "number words street" that show it isn't an address
NOT_STREET = frozenset("of the a an in on at and or to from for by with is was were rows files entries items records per this that".split())
PARTICLES = frozenset("de la las los del van der den von zu mac mc di da do dos du le el al bin ter".split())
TITLES = frozenset("dr mr mrs ms miss prof herr frau pan pani sr sra señor señora don doña patient patientin pacjent paciente author reviewer inż mgr lic ing sir".split())
# words that start sentences or lines, or stand before a name
NOT_NAME = TITLES | PARTICLES | frozenset(
    "the a an and or in on at for with from to by of as if we i my our your his her its it he she they this that these those then there here when while what why who how which is was were are be been do does did has have had not no yes"
    " according thanks ping call write cc remember decision decisión decyzja beschluss please nobody only also open question next action let see visits ship meet old address mobile office form verify id file note ayer mañana gestern heute"
    " morgen wczoraj dziś jutro warum dlaczego por para und oder mit der die das ein eine für von zu y el la los las un una que con o i w z na do się nie jest but so after before again today yesterday tomorrow hi hello dear regards".split()
)
# lexicon tokens that are also ordinary English words
ORDINARY = frozenset("will may mark hope grace rose frank drew stone cross field page price banks bright lamb birch key".split())
# second words of names of places and products
NOT_FAMILY = frozenset("gate avenue street road lane drive court blvd project agent team server cluster".split())
INTROS = ("patient ", "pacjent ", "dr. ", "prof. ", "herr ", "frau ", "pan ", "pani ", "señor ", "señora ", "sr. ", "sra. ", "mr ", "mr. ", "mrs ", "mrs. ", "ms. ", "reviewer was ", "assigned_to: ", "author: ", "spoke with ", "according to ", "thanks to ", "asked ", "reviewed by ", "by ", "from ", "cc ", *(f"name{a}:{gap}{b}" for a in "\"'" for gap in ("", " ") for b in "\"'"), "--\n", "-- \n")
NAMED_IDS = ("ssn", "social security", "national id", "pesel", "dni", "nie", "nif", "passport", "paszport", "pasaporte", "reisepass", "ausweis", "id card")
BRACKET_AT = re.compile(rf"{_OPEN}at{_SHUT}")
BEFORE_PERSON = re.compile(
    r"(?:(?<!\w)(?:Patient|Pacjent|Dr\.|Prof\.|Herr|Frau|Pan|Pani|Señor|Señora|Sra?\.|Mrs?\.|Ms\.|Reviewer was|assigned_to:|Author:|I spoke with|spoke with|According to|thanks to|Thanks to|asked|reviewed by|by|from|cc)[ ]|[\"']name[\"']:[ ]?[\"']|(?<!\S)--[ ]?\n)"
)
CHAT_TIME = re.compile(r"\[\d\d:\d\d\][ ]")  # introduces a person, too
TAIL = re.compile(r" \| | asked ")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_GAP = re.compile(r"[ \t\u00a0]{1,2}")


class Finder:
    """Finds spans in one text after another."""

    def __init__(self, given: set[str], family: set[str]):
        self.given = {g.lower() for g in given}
        self.family = {f.lower() for f in family if " " not in f}
        self.phrases = {tuple(f.lower().split()) for f in family if " " in f}
        self.family_last = {p[-1] for p in self.phrases}
        self.words = {*self.given, *self.family, *self.family_last}
        self.hints = ahocorasick.Automaton()
        for w in {x for w in self.words for x in re.split(r"['’-]", w) if len(x) > 1}:
            self.hints.add_word(w, (len(w), True))
        for w in INTROS:
            self.hints.add_word(w, (len(w), False))
        self.hints.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of what is found, in order; the spans don't overlap."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals grow; they are left as they are, so that positions agree
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: list[tuple[str, int, int]] = []
        taken = bytearray(len(text))

        def add(kind: str, s: int, e: int) -> None:
            if not any(taken[s:e]):
                found.append((kind, s, e))
                taken[s:e] = b"\1" * (e - s)

        if "@" in low or "＠" in low or (" at " in low and " dot " in low) or BRACKET_AT.search(low):
            for m in EMAIL.finditer(text):
                add("email", m.start(), m.end())
        if any(k in low for k in NAMED_IDS):
            for m in NAMED_ID.finditer(text):
                add("id_number", m.start(1), m.end(1))
        runs = [m.span() for m in NUMBER_RUN.finditer(text)]
        for a, b in runs:
            for m in PHONE.finditer(text, a, min(len(text), b + 24)):  # an extension may follow
                if m.start() >= b:  # of a later run, and maybe cut here
                    break
                n = sum(c.isdigit() for c in re.split(r"[ ]?(?:ext|x|Durch|wew)", m.group())[0])
                if 9 <= n <= 15:
                    add("phone", m.start(), m.end())
        for m in ID.finditer(text):
            add("id_number", m.start(), m.end())
        for a, _ in runs:
            if (m := CALLED_NUMBER.match(text, a)) and 7 <= sum(c.isdigit() for c in m.group()) <= 15 and CALLED.search(text[max(0, a - 20) : a]):
                add("phone", m.start(), m.end())
        for s, e in self._streets(text, low):
            add("street_address", s, e)
        self._names(text, low, taken, [s for kind, s, _ in found if kind == "email"], add)
        found.sort(key=lambda x: x[1])
        return found

    def _streets(self, text: str, low: str):
        free = lambda at: at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_#./:-")
        for m in STREET_EN.finditer(text):
            if free(m.start()) and not NOT_STREET & {w.strip(".,") for w in low[m.start() : m.end()].split()}:
                yield m.span()
        if any(k in low for k in (*DE_KINDS, *DE_CAPITAL_KINDS)):
            for m in STREET_DE.finditer(text):
                s = max(low.rfind(" ", 0, m.start()), low.rfind("\n", 0, m.start())) + 1
                while s < m.start() and not text[s].isalpha():
                    s += 1
                word = low[s : m.start()]
                if len(word) > 5 and (word.endswith(DE_KINDS) or (word.endswith(DE_CAPITAL_KINDS) and text[s].isupper())):
                    lead = re.search(r"([^\W\d_]+)[ ]$", text[max(0, s - 16) : s])
                    yield (s - len(lead.group()) if lead and DE_LEAD.fullmatch(lead.group(1)) else s), m.end()
                elif word in DE_KINDS and (lead := re.search(r"([^\W\d_][\w'’-]+)[ ]$", text[max(0, s - 30) : s])) and lead.group(1)[0].isupper():
                    yield s - len(lead.group()), m.end()
        for m in STREET_PL.finditer(text):
            if low[m.start() : m.start() + 2] in PL_WORDS and free(m.start()):
                yield m.span()
        for p in (STREET_ES, STREET_FR):
            for m in p.finditer(text):
                if free(m.start()):
                    yield m.span()

    def _names(self, text: str, low: str, taken: bytearray, emails: list[int], add) -> None:
        marks = list(emails)  # names stand before addresses, too
        heads: set[int] = set()
        n = len(text)
        for end, (size, name) in self.hints.iter(low):
            s, e = end - size + 1, end + 1
            if s and text[s - 1].isalnum():
                continue
            if name:
                if e == n or not text[e].isalnum():
                    marks.append(s)
            elif (m := BEFORE_PERSON.match(text, s)) or (s and text[s - 1] in "\"'" and (m := BEFORE_PERSON.match(text, s - 1))):
                heads.add(m.end())
                marks.append(m.end())
        if ":" in text and "] " in text:
            for m in CHAT_TIME.finditer(text):
                heads.add(m.end())
                marks.append(m.end())
        if not marks:
            return
        marks.sort()
        windows: list[list[int]] = []
        for p in marks:
            a, b = max(0, p - 60), min(n, p + 80)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = b
            else:
                windows.append([a, b])
        for a, b in windows:
            while a > 0 and text[a - 1].isalpha():
                a -= 1
            while b < n and text[b - 1].isalpha() and text[b].isalpha():
                b += 1
            self._window(text, a, b, heads, taken, add)

    def _window(self, text: str, a: int, b: int, heads: set[int], taken: bytearray, add) -> None:
        toks: list[tuple[int, int, str]] = []
        for m in _TOKEN.finditer(text, a, b):
            s, e, w = m.start(), m.end(), m.group()
            if taken[s]:
                continue
            if len(w) > 2 and w[-2] in "'’" and w[-1] in "sS" and w.lower() not in self.words:
                e, w = e - 2, w[:-2]
            toks.append((s, e, w))
        n = len(toks)
        low = [w.lower() for _, _, w in toks]
        used = [False] * n

        def is_given(i):
            return low[i] in self.given or ("-" in low[i] and all(p in self.given for p in low[i].split("-")))

        def is_family(i):
            return low[i] in self.family or ("-" in low[i] and any(p in self.family or p in self.family_last for p in low[i].split("-"))) or self._phrase(low, i)

        def gap(i, j):
            return text[toks[i][1] : toks[j][0]]

        def spaced(i, j):
            return 0 <= i and j < n and _GAP.fullmatch(gap(i, j)) is not None

        def initial(i):
            return 0 <= i < n and len(low[i]) == 1 and toks[i][2].isalpha() and text[toks[i][1] : toks[i][1] + 1] == "."

        def after_initial(i, j):
            return 0 <= i and j < n and re.fullmatch(r"\.[ \t\u00a0]{0,2}", gap(i, j)) is not None

        def capital(i):
            return toks[i][2][0].isupper()

        def quiet(i):
            """A lower-case token that may be a name beside a sure one."""
            return 0 <= i < n and toks[i][2].islower() and len(low[i]) > 2 and low[i] not in NOT_NAME and low[i] not in NOT_FAMILY and low[i] not in ORDINARY

        def unknown(i):
            return 0 <= i < n and capital(i) and len(low[i]) > 1 and low[i] not in NOT_NAME and low[i] not in NOT_FAMILY

        def family_at(j):
            """Last token of the family phrase that starts at j, or -1; and whether it is in the lexicon."""
            k = j
            while k < n and low[k] in PARTICLES and spaced(k, k + 1) and k - j < 3:
                k += 1
            if k >= n:
                return -1, False
            return k, is_family(k)

        def after_given(i):
            j = i + 1
            if initial(j) and spaced(i, j) and after_initial(j, j + 1):
                return j + 1
            return j if spaced(i, j) else -1

        def sure(i, k):
            """Not just two ordinary words: in capitals like a name, or one of them no ordinary word."""
            plain = {p for p in low[k].split("-")} <= ORDINARY and low[i] in ORDINARY
            if not plain:
                return True
            return toks[i][2][0].isupper() and toks[k][2][0].isupper() and not (toks[i][2].isupper() and toks[k][2].isupper())

        def take(i, k):
            if any(used[i : k + 1]):
                return False
            for x in range(i, k + 1):
                used[x] = True
            add("person_name", toks[i][0], toks[k][1])
            return True

        for i in range(n):  # given name, family name
            if is_given(i) and not used[i]:
                j = after_given(i)
                if j > 0:
                    k, known = family_at(j)
                    if k >= 0 and known and sure(i, k):
                        take(i, k)
        for i in range(n):  # family name, given name
            if used[i]:
                continue
            k, known = family_at(i)
            if k < 0 or not known or k + 1 >= n or used[k] or used[k + 1] or (i and low[i - 1] in PARTICLES and spaced(i - 1, i)):
                continue
            between = gap(k, k + 1)
            given = is_given(k + 1) or unknown(k + 1) or initial(k + 1)
            comma = re.fullmatch(r",[ \u00a0]{1,2}", between) is not None
            if (comma and given and (capital(k) or is_given(k + 1)) and sure(k + 1, k) and not (i and (initial(i - 1) or (not is_given(k + 1) and unknown(i - 1) and spaced(i - 1, i))))) or (_GAP.fullmatch(between) and is_given(k + 1) and not low[k] in ORDINARY):
                last = k + 1
                if initial(last + 1) and spaced(last, last + 1):
                    last += 1
                take(i, last)
        for i in range(n):  # initial or unknown given name before a family name
            if used[i]:
                continue
            k, known = family_at(i)
            if k < 0 or not known or used[k] or (i and low[i - 1] in PARTICLES and spaced(i - 1, i)):
                continue
            common = {p for p in low[k].split("-")} <= ORDINARY
            if initial(i - 1) and after_initial(i - 1, i) and (capital(k) or not common) and (toks[i - 1][2].isupper() or not common):
                start = i - 1
                if i >= 2 and spaced(i - 2, i - 1) and not used[i - 2] and (unknown(i - 2) or is_given(i - 2)) and not (low[i - 2] in ORDINARY and not capital(i - 2)):
                    start = i - 2
                take(start, k)
            elif i and spaced(i - 1, i) and unknown(i - 1) and not used[i - 1] and (not common or toks[i - 1][0] in heads or TAIL.match(text, toks[k][1])) and capital(k):
                take(i - 1, k)
            elif i and spaced(i - 1, i) and quiet(i - 1) and not used[i - 1] and not capital(k) and (not common or (toks[i - 1][0] in heads and self._ends(text, toks[k][1]))):
                take(i - 1, k)
        for i in range(n):  # known given name, unknown family name
            if used[i] or not is_given(i):
                continue
            j = after_given(i)
            if j > 0:
                k, _ = family_at(j)
                headed = toks[i][0] in heads
                strong = low[i] not in ORDINARY or headed or (j > i + 1) or (k >= 0 and TAIL.match(text, toks[k][1]))
                if k >= 0 and not used[k] and strong and unknown(k) and capital(i):
                    if take(i, k):
                        continue
                if k >= 0 and not used[k] and not capital(i) and ((low[i] not in ORDINARY and quiet(k)) or (headed and ((quiet(k) and self._ends(text, toks[k][1])) or (k > j and quiet(k)) or (low[i] not in ORDINARY and toks[k][2].islower() and low[k] in ORDINARY)))) and take(i, k):
                    continue
            if i and re.fullmatch(r",[ \u00a0]{1,2}", gap(i - 1, i)) and unknown(i - 1) and not used[i - 1] and capital(i) and (low[i] not in ORDINARY or toks[i - 1][0] in heads):
                start = i - 1
                while start and low[start - 1] in PARTICLES and spaced(start - 1, start):
                    start -= 1
                last = i + 1 if initial(i + 1) and spaced(i, i + 1) else i
                take(start, last)
        for i in range(n):  # two unknown names before an address of theirs, or after words that introduce a person
            if not used[i] and unknown(i) and low[i] not in ORDINARY and (j := after_given(i)) > 0:
                k, _ = family_at(j)
                if k >= 0 and not used[k] and unknown(k) and TAIL.match(text, toks[k][1]):
                    take(i, k)
            if used[i]:
                continue
            if initial(i) and after_initial(i, i + 1):
                k, _ = family_at(i + 1)
                if k >= 0 and not used[k] and unknown(k) and (toks[i][0] in heads or text.startswith(" | ", toks[k][1])):
                    take(i, k)
                continue
            if toks[i][0] not in heads:
                continue
            j = after_given(i)
            if j > 0 and quiet(i) and quiet(j) and self._ends(text, toks[j][1]) and text[toks[i][0] - 1] in "\n\"'":
                take(i, j)
                continue
            if not unknown(i) or low[i] in ORDINARY:
                continue
            if j > 0:
                k, _ = family_at(j)
                if k >= 0 and not used[k] and unknown(k):
                    take(i, k)
            elif i + 1 < n and re.fullmatch(r",[ ]", gap(i, i + 1)) and unknown(i + 1) and not used[i + 1] and re.match(r"[ ]?[A-Z]?\.?[ ]?(?:\(|\||\n|\"|$)", text[toks[i + 1][1] : toks[i + 1][1] + 6]):
                take(i, i + 1)

    @staticmethod
    def _ends(text: str, at: int) -> bool:
        """A line, string or field ends here."""
        return at == len(text) or text[at] in "\n\"'|<(," or text[at : at + 2] == " |"

    def _phrase(self, low: list[str], i: int) -> bool:
        return low[i] in self.family_last and any(tuple(low[max(0, i - len(p) + 1) : i + 1]) == p for p in self.phrases)


PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}
ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_at", T.IntegerType()), T.StructField("value", T.StringType())])


def _lexicon(lexicon: DataFrame):
    rows = lexicon.where(F.col("name_token").isNotNull()).select("name_token", "role").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names in the lexicon")
    spark = lexicon.sparkSession
    return spark.sparkContext.broadcast(({r.name_token for r in rows if r.role == "given"}, {r.name_token for r in rows if r.role == "family"}))


def find(df: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `entities` (kind, start_at counted from 1, value), empty where there are none or the text is null."""
    names = _lexicon(lexicon)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != "entities"), T.StructField("entities", T.ArrayType(ENTITY))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start_at", pa.int32()), ("value", pa.string())]))

    def run(batches):
        finder = Finder(*names.value)
        for batch in batches:
            got = [[{"kind": k, "start_at": s + 1, "value": t[s:e]} for k, s, e in finder.spans(t)] if t else [] for t in batch.column(text).to_pylist()]
            cols = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "entities"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, kind)], schema.names)

    return df.mapInArrow(run, schema)


def _rebuilt(df: DataFrame, text: str, out: str, pieces: str) -> DataFrame:
    """`df` with `out`: `text` with new values put in; `pieces` is an array of (start_at, length, new), in order."""
    gap = lambda at, to: F.substring(F.col(text), at, to - at)
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("at"))
    done = F.aggregate(pieces, start, lambda acc, x: F.struct(F.concat(acc["t"], gap(acc["at"], x["start_at"]), x["new"]).alias("t"), (x["start_at"] + x["length"]).alias("at")))
    return df.withColumn("_done", done).withColumn(out, F.concat(F.col("_done.t"), F.expr(f"substring(`{text}`, _done.at)"))).drop("_done")


def replaced(df: DataFrame, lexicon: DataFrame, text: str = "text", out: str = "clean") -> DataFrame:
    """`df` with `entities` and `out`, the text with a typed placeholder in place of each entity."""
    mark = F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv])
    found = find(df, lexicon, text).withColumn("_p", F.transform("entities", lambda e: F.struct(e["start_at"].alias("start_at"), F.length(e["value"]).alias("length"), mark[e["kind"]].alias("new"))))
    return _rebuilt(found, text, out, "_p").drop("_p")


# ---- surrogates -----------------------------------------------------------
def _stream(key: str, *parts: str):
    n = 0
    while True:
        yield from hashlib.blake2b("\0".join((*parts, str(n))).encode(), key=key.encode()[:64], digest_size=64).digest()
        n += 1


# Syllables of invented names and streets.
HEADS = "Ba Be Bo Ca Da De Do Fa Fe Ga Ha He Jo Ka Ke La Le Li Lo Ma Me Mi Na Ne No Pa Pe Ra Re Ro Sa Se So Ta Te To Va Ve Wa Ze".split()
TAILS = "bren dral fern gast hald jorn kest lorn mund nerd pold quist rand sted tand vard wick zell".split()


# a title that shows the gender, before a name
TITLE_BEFORE = re.compile(r"(?<!\w)(?:(?P<f>Frau|Pani|Señora|Sra\.|Mrs\.?|Ms\.?|Miss|[Dd]oña|Patientin)|(?P<m>Herrn?|Pan|Señor|Sr\.|Mr\.?|Sir|Don))[ ](?:(?:Dr|Prof|Ing)\.[ ])*$")
COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
STREET_WORD = re.compile(r"\w+(?:['’-]\w+)*")
EN_KINDS = frozenset("street road lane avenue boulevard drive court crescent terrace close square place parkway highway st rd ln ave blvd dr".split())
FIRST_KINDS = PL_WORDS | frozenset("calle avenida avda paseo plaza camino carrera c".split())
DE_KIND_END = re.compile(r"(?i)(?:straße|strasse|str|gasse|allee|weg|platz|ring|damm|ufer)$")


def national(value: str) -> str:
    """The digits of a phone number without country code, leading zeros and extension."""
    main = re.split(r"ext|x|durch|wew", value.lower())[0]
    digits = "".join(c for c in main if c.isdigit())
    if "+" in main or digits.startswith("00"):
        abroad = digits.lstrip("0")
        digits = abroad[m.end() :] if (m := COUNTRY.match(abroad)) else abroad
    return digits.lstrip("0") or digits


def street_names(words: list[str]) -> list[tuple[int, int]]:
    """(number of the word, its length without a kind of street at its end) of the words that make up the name of a street."""
    low = [w.lower() for w in words]
    numbers = {i for i, w in enumerate(low) if any(c.isdigit() for c in w)}
    aside = numbers | {i + 1 for i in numbers if i + 1 < len(low) and len(low[i + 1]) == 1}  # letters of numbers
    length = [len(w) for w in words]
    if 0 in numbers and low[1:2] and low[1] in ("rue", "impasse", "quai"):
        inside = [i for i in range(2, len(low)) if i not in aside]
    elif 0 in numbers:
        end = len(low) - 2 if low[-2:-1] and low[-2] in ("apt", "flat", "unit", "suite") else len(low)
        kind = next((i for i in range(end - 1, 0, -1) if low[i] in EN_KINDS), end)
        return [(i, length[i]) for i in range(1, kind) if i not in aside] or [(i, length[i]) for i in range(1, kind)]
    elif low and low[0] in FIRST_KINDS:
        inside = [i for i in range(1, len(low)) if i not in aside]
    else:
        length = [len(DE_KIND_END.sub("", w)) for w in words]
        inside = [i for i in range(len(low)) if i not in aside and length[i]]
    return [(i, length[i]) for i in inside if low[i] not in PARTICLES and low[i] not in ("am", "an", "im")] or [(i, length[i]) for i in inside]


def canonical_value(kind: str, value: str, given: set[str]) -> str:
    """One spelling for values that mean the same."""
    v = value.lower()
    if kind == "email":
        v = re.sub(r"[ ]?[(\[{<][ ]?(?:at|@)[ ]?[)\]}>][ ]?|[ ]at[ ]|＠", "@", v)
        return re.sub(r"[ ]?[(\[{][ ]?(?:dot|\.)[ ]?[)\]}][ ]?|[ ]dot[ ]", ".", v)
    if kind == "phone":
        return national(v)
    if kind == "id_number":
        return "".join(c for c in v if c.isalnum())
    if kind == "street_address":
        return " ".join(STREET_WORD.findall(v))
    if "," in v:
        last, first = v.split(",", 1)
        v = f"{first} {last}"
    toks = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?", v)
    if len(toks) > 1 and toks[-1] in given and toks[0] not in given:
        toks = [toks[-1], *toks[:-1]]
    return " ".join([toks[0].rstrip("."), *(t for t in toks[1:] if len(t.rstrip(".")) > 1 and not t.endswith("."))]) if toks else v


def canonical_entities(text: str, entities: list[dict], given: set[str]) -> list[tuple[str, str | None]]:
    """(canonical value, gender by title) of each entity of a text.

    An initial stands for the full given name if just one such name comes with
    the same family name in the text.
    """
    canons = [canonical_value(e["kind"], e["value"], given) for e in entities]
    full: dict[tuple[str, str], set[str]] = {}
    people = [i for i, e in enumerate(entities) if e["kind"] == "person_name"]
    for i in people:
        first, _, family = canons[i].partition(" ")
        if len(first) > 1:
            full.setdefault((first[0], family), set()).add(canons[i])
    out: list[tuple[str, str | None]] = [(c, None) for c in canons]
    for i in people:
        first, _, family = canons[i].partition(" ")
        fits = full.get((first, family), ())
        at = entities[i]["start_at"] - 1
        m = TITLE_BEFORE.search(text[max(0, at - 30) : at])
        out[i] = (next(iter(fits)) if len(fits) == 1 else canons[i], m.lastgroup if m else None)
    return out


DNI_LETTERS = "trwagmyfpdxbnjzsqvhlcke"  # fixed values: check letters by remainder
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)  # fixed values


def checked(canon: str) -> str | None:
    """A national number with its check digit or letter made right; None if it is of no kind that has one."""
    if re.fullmatch(r"\d{11}", canon):
        return canon[:10] + str(-sum(w * int(c) for w, c in zip(PESEL_WEIGHTS, canon, strict=False)) % 10)
    if m := re.fullmatch(r"([xyz]?)(\d{7,8})[a-z]", canon):
        lead, digits = m.groups()
        if len(lead) + len(digits) == 8:
            return lead + digits + DNI_LETTERS[int((str("xyz".index(lead)) if lead else "") + digits) % 23]
    return None


def surrogate_value(key: str, kind: str, canon: str, attempt: int, sex: str | None = None) -> str:
    """A stand-in for a canonical value, in canonical spelling; `sex` (f or m) goes before what the name tells."""
    s = _stream(key, kind, canon, str(attempt))

    def pick(few):
        return few[next(s) % len(few)]

    def name(like: str, size: int = 1, of: str | None = None) -> str:
        heads, tails, ends = (HEADS, TAILS, {"f": ("a",), "m": ("",), "n": ("e",)}) if (used := script(like)) == "LATIN" else syllables(used)
        return pick(heads) + "".join(pick(tails) for _ in range(size)) + (pick(ends[of]) if of else "")

    longer = attempt // 2
    if kind == "phone":  # the first digit of a long number, its kind, stays
        keep = len(canon) > 9
        return "".join(c if keep and i == 0 else str(next(s) % 9 + 1 if i == 0 else next(s) % 10) for i, c in enumerate(canon))
    if kind == "id_number":
        swap = lambda c: str(next(s) % 10) if c.isdigit() else chr(97 + next(s) % 26) if c.isalpha() else c
        valid = checked(canon) == canon
        lead = canon[0] if valid and canon[0] in "xyz" else ""
        new = lead + "".join(map(swap, canon[len(lead) :]))
        return checked(new) if valid else new
    if kind == "email":
        local = canon.split("@")[0]
        return f"{name(local)}.{name(local, 1 + longer)}@{name('a')}.example".lower()  # a domain that can't be owned
    if kind == "street_address":
        number = "".join(str(next(s) % 9 + 1) for c in (re.findall(r"\d+", canon) or ["1"])[0])
        words = canon.split(" ")
        names = street_names(words) or [(0, len(words[0]))]
        return " ".join([number, *(name(words[i], 1 + (longer if j == len(names) - 1 else 0)) for j, (i, _) in enumerate(names))]).lower()
    first, _, family = canon.partition(" ")
    return f"{name(first, of=sex or gender(first))} {name(family or first, 2 + longer)}".lower()


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else "-".join(w.capitalize() for w in word.split("-"))


def render(kind: str, value: str, stand_in: str) -> str:
    """The stand-in in the form of the original: its separators, order, case and disguise."""
    if kind in ("phone", "id_number"):
        main = re.split(r"[ ]?(?:ext|x|Durch|wew)", value)[0] if kind == "phone" else value
        places = [i for i, c in enumerate(main) if (c.isdigit() if kind == "phone" else c.isalnum())][-len(stand_in) :]
        out = list(value)
        for i, c in zip(places, stand_in[-len(places) :] if places else "", strict=True):
            out[i] = c.upper() if value[i].isupper() else c
        for i in range(len(main), len(value)):
            if out[i].isdigit():
                out[i] = stand_in[(i + 1) % len(stand_in)] if stand_in[(i + 1) % len(stand_in)].isdigit() else "0"
        return "".join(out)
    if kind == "email":
        at = re.search(r"[ ]?[(\[{<][ ]?(?i:at|@)[ ]?[)\]}>][ ]?|[ ](?i:at)[ ]|@|＠", value)
        dot = re.search(r"[ ]?[(\[{][ ]?(?i:dot|\.)[ ]?[)\]}][ ]?|[ ](?i:dot)[ ]|\.", value[at.end() :] if at else value)
        local, _, domain = stand_in.partition("@")
        return _cased(value if value.isupper() else "a", local) + (at.group() if at else "@") + (dot.group() if dot else ".").join(_cased(value if value.isupper() else "a", d) for d in domain.split("."))
    if kind == "street_address":
        number, *stems = stand_in.split(" ")
        words = list(STREET_WORD.finditer(value))
        names = {i: (size, stems[j % len(stems)]) for j, (i, size) in enumerate(street_names([w.group() for w in words]))}
        out, at = [], 0
        for i, w in enumerate(words):
            new = w.group()
            if i in names:
                size, stem = names[i]
                new = _cased(new[:size], stem) + new[size:]
            elif any(c.isdigit() for c in new):
                it = iter(number * (len(new) // max(1, len(number)) + 1))
                new = "".join(next(it) if c.isdigit() else c for c in new)
            out += [value[at : w.start()], new]
            at = w.end()
        return "".join(out) + value[at:]
    first, last = stand_in.split(" ", 1)
    if "," in value:
        a, b = value.split(",", 1)
        given, *more = b.strip().split(" ")
        lead = first[0].upper() + given[1:] if len(given.rstrip(".")) == 1 else _cased(given, first)
        return _cased(a.split(" ")[-1], last) + "," + (" " if b.startswith(" ") else "") + " ".join([lead, *(t for t in more if len(t.rstrip(".")) == 1)])
    if m := re.fullmatch(r"[^\W\d_]\.([^\W\d_].*)", value):  # an initial without blank after it
        return first[0].upper() + "." + _cased(m.group(1).split(" ")[-1], last)
    toks = value.split(" ")
    lead = first[0] + "." if toks[0].endswith(".") and len(toks[0]) == 2 else first
    mid = [t for t in toks[1:-1] if t.endswith(".")]
    return " ".join([_cased(toks[0] if len(toks[0]) > 2 else "A", lead), *mid, _cased(toks[-1], last)])


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, stand_in, mentions): a different stand-in for each different canonical value, none of which occurs.

    Names differ in the family name or the first letter, so they differ behind
    initials, too.  Values whose stand-in is taken, by a smaller value or by an original, try
    again with the next attempt until none is left.  `sex`, if there, is the
    gender by title of each mention; it counts where all mentions agree.
    """
    said = F.col("sex") if "sex" in entities.columns else F.lit(None).cast("string")
    people = entities.groupBy("kind", "canon").agg(F.min(said).alias("a"), F.max(said).alias("b"), F.count("*").alias("mentions"))
    originals = cut(people.select("kind", "canon", "mentions", F.when(F.col("a") == F.col("b"), F.col("a")).alias("sex")))
    family = F.regexp_replace("stand_in", "^(.)[^ ]* ", "$1 ")
    told = F.when(F.col("kind") == "person_name", family).otherwise(F.col("stand_in")).alias("told")  # what tells two of a kind apart, however they are written

    def tried(df: DataFrame, attempt: int) -> DataFrame:
        def run(batches):
            for b in batches:
                kinds, canons, sexes = (b.column(c).to_pylist() for c in ("kind", "canon", "sex"))
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canon"), pa.array([surrogate_value(key, k, c, attempt, x) for k, c, x in zip(kinds, canons, sexes, strict=True)], pa.string())], ["kind", "canon", "stand_in"])

        return df.select("kind", "canon", "sex").mapInArrow(run, "kind string, canon string, stand_in string")

    done, left, attempt = None, originals, 0
    while True:
        new = tried(left, attempt).withColumn("told", told).withColumn("_n", F.row_number().over(Window.partitionBy("kind", "told").orderBy("canon")))
        free = new.where("_n = 1").drop("_n").join(originals.select("kind", F.col("canon").alias("stand_in")), ["kind", "stand_in"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "told"), ["kind", "told"], "left_anti")
        free = cut(free.select("kind", "canon", "stand_in", "told"))
        done = free if done is None else done.union(free)
        left = cut(left.join(free, ["kind", "canon"], "left_anti").select("kind", "canon", "sex"))
        attempt += 1
        if not left.limit(1).count():
            return done.drop("told").join(originals.select("kind", "canon", "mentions"), ["kind", "canon"])


HOT_MENTIONS = 100_000  # of one value; such values are few and are looked up without a shuffle


def surrogates(df: DataFrame, lexicon: DataFrame, keys: list[str], key: str, text: str = "text", out: str = "clean") -> DataFrame:
    """`keys`, `text` and `out`: the text with stand-ins made with the secret `key`.  `keys` identify a row."""
    if not key:
        raise ValueError("a secret key is needed")
    names = _lexicon(lexicon)
    found = find(df.select(*keys, text), lexicon, text)
    some = found.where(F.size("entities") > 0)
    schema = T.StructType([*(some.schema[k] for k in keys), *(f for f in ENTITY.fields), T.StructField("canon", T.StringType()), T.StructField("sex", T.StringType())])

    def canon(batches):
        given = {g.lower() for g in names.value[0]}
        for b in batches:
            texts, lists = b.column(text).to_pylist(), b.column("entities").to_pylist()
            row = pa.array([i for i, es in enumerate(lists) for _ in es], pa.int64())
            flat = [e for es in lists for e in es]
            told = [c for t, es in zip(texts, lists, strict=True) for c in canonical_entities(t, es, given)]
            cols = [pa.array([e["kind"] for e in flat], pa.string()), pa.array([e["start_at"] for e in flat], pa.int32()), pa.array([e["value"] for e in flat], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in keys), *cols, *(pa.array([c[n] for c in told], pa.string()) for n in (0, 1))], schema.names)

    occ = written(some.mapInArrow(canon, schema), "entities")
    table = cut(surrogate_table(occ, key))
    hot = small(table.where(F.col("mentions") > HOT_MENTIONS))
    by = ["kind", "canon"]
    told = occ.join(hot, by).select(*occ.columns, "stand_in").unionByName(occ.join(hot.select(*by), by, "left_anti").join(table, by).select(*occ.columns, "stand_in"))
    rendered = T.StructType([*(df.schema[k] for k in keys), T.StructField("start_at", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("new", T.StringType())])

    def render_all(batches):
        for b in batches:
            vals = b.column("value").to_pylist()
            new = [render(k, v, s) for k, v, s in zip(b.column("kind").to_pylist(), vals, b.column("stand_in").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("start_at"), pa.array([len(v) for v in vals], pa.int32()), pa.array(new, pa.string())], rendered.names)

    news = told.select(*keys, "start_at", "kind", "value", "stand_in").mapInArrow(render_all, rendered)
    per_row = news.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_at", "length", "new"))).alias("_p"))  # the entities of one text
    whole = df.select(*keys, text).join(per_row, keys, "left").withColumn("_p", F.coalesce("_p", F.expr("cast(array() as array<struct<start_at:int,length:int,new:string>>)")))
    return _rebuilt(whole, text, out, "_p").select(*keys, text, out)


def _here(spark, base) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{base}/mcp_documents.parquet").select(F.lit("mcp_documents").alias("src"), F.col("row_no").alias("rec_no"), "text")
    blocks = spark.read.parquet(f"{base}/raw_blocks.parquet").select(F.lit("raw_blocks").alias("src"), F.col("block_no").alias("rec_no"), F.col("content").alias("text"))
    return docs.unionByName(blocks), spark.read.parquet(f"{base}/name_lexicon.parquet")


def p2_found(spark, base) -> DataFrame:
    return find(*_here(spark, base)).select("src", "rec_no", F.explode("entities").alias("e")).select("src", "rec_no", F.col("e.kind").alias("kind"), F.col("e.start_at").alias("start_at"))


def p2_texts(spark, base) -> DataFrame:
    """Every text with typed placeholders."""
    return replaced(*_here(spark, base)).select("src", "rec_no", "clean")


def p2_surrogates(spark, base) -> DataFrame:
    """Every text with keyed stand-ins; the key is the setting spark.lorekeep.surrogateKey, or a new one for this run."""
    docs, lexicon = _here(spark, base)
    key = spark.conf.get("spark.lorekeep.surrogateKey", None) or secrets.token_hex(32)
    return surrogates(docs, lexicon, ["src", "rec_no"], key).select("src", "rec_no", "clean")
