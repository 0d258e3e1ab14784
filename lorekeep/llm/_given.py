"""Whether a given name is a woman's or a man's, and syllables of invented names in several scripts."""

from __future__ import annotations

import unicodedata
from functools import cache

# Given names by usual gender; names of both are left to the words around them.
WOMEN = frozenset(
    """agata odile hyejin agnes aiko aisha alice amara amy ana anna anna-lene anne anneke astrid beatrice begoña bogna brigitte brona carmen caroline casimira catherine celina charlotte chloe christine claire dagmar delphine
    dolores edda edith eileen eliska elizabeth ellen elsbeth emily esi esther eve farida fatima frances gertrud gisela grace greta hannah heather helen hope ilse imogen ines inés ingrid irene isabel jane jennifer joan
    judith julie karen katherine katla keiko klara kirsten leilani lilian liv lucy łucja malwina margaret marie marion marit mary mercedes may mercy miriam mirela naomi nerys noemi parisa perpetua petra pilar rachel rosalind
    rose rosario rut ruth sarah saskia sigrid siobhan solveig soledad sophie susan tamsin thekla ulrika uzma vesna violet wambui wanda xenia yoko ysolde yusra yvonne zainab zofka zoe zoë żaneta
    анна мария ольга елена наталья татьяна любовь нинель μαρία ελένη איילת שרה מרים רחל רבקה נעמי יעל مريم زينب هند سعاد नीलम""".split()
)
MEN = frozenset(
    """adam jean jean-luc alexander andrea-luca andrew ansel antoni babak barnaba bastian benjamin bernard bonawentura carl cedric charles chidi chris christopher daisuke daniel david dorian edward emeric eric fergus florian frank george goran
    halvard hans henrik henry horatio hugo isamu ivan jack jacob jakob jan jarek james joe john joska josé juan jürgen kasimir karl kenji kofi kuba leander lorcan louis luca luka ludovic lutz mark martin michael mustafa nestor nikita nikola
    olumide oscar otto paul peter piers pierre quentin ravindra richard robert samuel sean sverre søren stefan tariq theo thomas tobin wilfred will william zdenko
    никита илья фома лука данила савва кузьма михаил иван пётр сергей алексей νικόλας אריה משה יהודה דוד יוסף أسامة حمزة طلحة محمد أحمد علي कृष्ण""".split()
)
BOTH = frozenset("alex andrea drew jaswinder jorvik kim maria-luis minh noor oriel robin sasha саша женя".split())


def gender(first: str) -> str:
    """f, m, or n where neither the name nor its ending tells."""
    for name in (first, first.split("-")[0]):
        for kind, names in (("f", WOMEN), ("m", MEN), ("n", BOTH)):
            if name in names:
                return kind
    return "f" if first[-1:] in {"a", "а", "я", "α", "η", "ά", "ή", "ة", "ה"} and len(first) > 1 else "m" if first[-1:] == "ς" else "n"


# Script: heads, tails, endings by gender.  Latin syllables are those of the caller.
SCRIPTS = {
    "CYRILLIC": ("ба бе бо ва ве да до за ка ке ла ле ма ме на не па ре ро са се та то".split(), "брен драл верн гаст кест лорн мунд полд ранд стед вард зелл".split(), {"f": ("а",), "m": ("",), "n": ("е",)}),
    "GREEK": ("βα γα δα δε ζα θε κα κε λα λε μα με να νε πα ρα ρο σα τα τε".split(), "βρεν δραλ φερν γαστ κεστ λορν μουνδ πολδ ρανδ στεδ βαρδ".split(), {"f": ("α",), "m": ("ος",), "n": ("ι",)}),
    "HEBREW": ("בא גל דב הר זמ חל טב יר כר לב מל נב סר פל צב קר רם של תב".split(), "ברן דרל גסט קסט לון מנד פלד רנד סטד ורד".split(), {"f": ("ה",), "m": ("",), "n": ("י",)}),
    "ARABIC": ("با جا دا را زا سا شا طا فا قا كا لا ما نا ها وا يا".split(), "برن درل غست كست لرن مند بلد رند ستد ورد".split(), {"f": ("ة",), "m": ("",), "n": ("ي",)}),
    "DEVANAGARI": ("क ख ग च ज त द न प ब म र ल व स ह".split(), "बरन दरल गसत कसट लरन मनद पलद रनद वरद".split(), {"f": ("ा",), "m": ("",), "n": ("े",)}),
    "CJK": (list("青白赤黒森林川山石田原野岡島浜谷沢木竹松梅杉"), list("崎沼塚橋里瀬倉坂津宮窪畑峰岸辺"), {"f": ("子", "美", "香"), "m": ("郎", "夫", "雄"), "n": ("真", "光", "薫")}),
    "HIRAGANA": ("あ か さ た な は ま や ら き し ち に み り く".split(), "けと そら ほし つゆ もり なぎ ふね むら".split(), {"f": ("こ", "み"), "m": ("お", "ろう"), "n": ("る",)}),
    "KATAKANA": ("ア カ サ タ ナ ハ マ ヤ ラ キ シ チ ニ ミ リ ク".split(), "ケト ソラ ホシ ツユ モリ ナギ フネ ムラ".split(), {"f": ("コ", "ミ"), "m": ("オ", "ロウ"), "n": ("ル",)}),
    "HANGUL": (list("가나다라마바사아자차카타파하고노도로모보"), list("람별솔달빛강산들결길온터"), {"f": ("희", "미"), "m": ("철", "호"), "n": ("진",)}),
}


@cache
def _letters(name: str) -> list[str]:
    """The small letters of a script without fixed syllables."""
    return [c for c in map(chr, range(0x250, 0x20000)) if c.isalpha() and c == c.lower() and unicodedata.name(c, "").startswith(f"{name} ")][:40]


def script(word: str) -> str:
    """The script of the first letter."""
    if word.isascii():
        return "LATIN"
    c = next((c for c in word if c.isalpha()), "a")
    name = unicodedata.name(unicodedata.normalize("NFKC", c)[0], "LATIN").split(" ")[0]
    return name if name in SCRIPTS or (name != "LATIN" and len(_letters(name)) >= 10) else "LATIN"


def syllables(name: str) -> tuple[list[str], list[str], dict[str, tuple[str, ...]]]:
    """Heads, tails and endings of a script that isn't Latin."""
    if name in SCRIPTS:
        return SCRIPTS[name]
    few = _letters(name)
    return few, [a + b for a, b in zip(few, few[7:] + few[:7], strict=True)], {"f": ("",), "m": ("",), "n": ("",)}
