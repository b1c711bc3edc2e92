"""Personal data in texts, also where it is disguised, with spans in the source text.

Base rules run on the text as it is. Then a chain of transducers rewrites disguises and keeps, for
every character it puts out, the source characters it stands for:

1. homoglyphs, full-width forms, foreign digits and odd dashes and spaces become the ASCII character
   they imitate; zero-width characters vanish;
2. "at" and "dot" (also in German, French and Spanish, bracketed, or bare between the parts of an address)
   become ``@`` and ``.``;
3. runs of spelled digits become digits, "plus" before them a plus sign.

The same rules run on the rewritten text; every identifier that needs a rewritten character and does not
lie inside a base span of its kind is mapped back. Texts without any disguise are never rewritten.

Defined cases: a null or empty text has no spans; repeated rows each get a row; an empty table gives
an empty result; offsets are code points, the end exclusive; spans of different kinds may overlap, and of equal starts the kind named first
comes first; texts of any length are scanned whole; only the id and text columns are read.
All rules are linear in the text's length, also on long runs of letters or digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from traffic_risk.llm.common import map_texts
from traffic_risk.llm.spans import SPAN, ordered

# The base rules.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS = range(14, 20)
PHONE_DIGITS = range(10, 16)

# Characters that imitate ASCII ones, by ASCII character.
IMITATIONS = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еε", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ",
    "n": "ո", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ",
    "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。", "-": "‐‑‒–—−", " ": "    ", "+": "﹢",
}
INVISIBLE = "​‌‍⁠﻿­"
FOREIGN_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6)
"""First of ten digits in a row: Arabic, Persian, Devanagari, Bengali."""
AT = "at|arroba|arobase|klammeraffe|ät"
DOT = "dot|punkt|punto|point"
TOP = "com|org|net|edu|gov|info|biz|io|ai|app|dev|eu|uk|us|de|fr|es|it|nl|at|ch|be|pl|ca|mx|ar|br|in|jp|cn|au|test|example"
"""Last parts of an address that is spelled without brackets; prose has "at" and "dot" too."""
PROSE = "the|a|an|this|that|each|every|some|any|one|which|no|my|your|his|her|its|our|their"
"""Before the word dot they speak of a dot."""
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "null": "0", "zéro": "0", "cero": "0",
    "one": "1", "eins": "1", "un": "1", "uno": "1",
    "two": "2", "zwei": "2", "zwo": "2", "deux": "2", "dos": "2",
    "three": "3", "drei": "3", "trois": "3", "tres": "3",
    "four": "4", "vier": "4", "quatre": "4", "cuatro": "4",
    "five": "5", "fünf": "5", "cinq": "5", "cinco": "5",
    "six": "6", "sechs": "6", "seis": "6",
    "seven": "7", "sieben": "7", "sept": "7", "siete": "7",
    "eight": "8", "acht": "8", "huit": "8", "ocho": "8",
    "nine": "9", "neun": "9", "neuf": "9", "nueve": "9",
}

_ONE = {ord(ch): plain for plain, all_ in IMITATIONS.items() for ch in all_}
_ONE |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_ONE |= {zero + i: str(i) for zero in FOREIGN_ZEROS for i in range(10)}
_ONE |= {ord(ch): "" for ch in INVISIBLE}
_STRANGE = re.compile("[" + "".join(re.escape(chr(k)) for k in sorted(_ONE)) + "]")
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_LEFT, _RIGHT = r"[\[({<]", r"[\])}>]"
_BRACKETED = re.compile(
    rf"\x20?{_LEFT}\x20?(?:(?P<at>{AT}|@)|(?P<dot>{DOT}|\.))\x20?{_RIGHT}\x20?", re.I
)
_PART = r"[A-Za-z0-9_%+-]{1,64}"
_SEP = rf"(?:\.|\x20(?:{DOT})\x20)"
_HOST = (
    rf"(?:{_PART}(?:{_SEP}{_PART}){{0,3}}{_SEP}(?:{TOP})|{_PART}\.{_PART}\.[A-Za-z]{{2,24}}|(?!(?:{PROSE})\x20){_PART}\x20dot\x20[A-Za-z]{{2,24}})(?![A-Za-z0-9-])"
)
"""What may follow a bare at: a known last part, three parts, or a spelled dot."""
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-]){_PART}(?:{_SEP}{_PART}){{0,4}}(?:\x20(?:{AT})\x20|@){_HOST}", re.I)
_WORD_AT = re.compile(rf"\x20(?:{AT})\x20", re.I)
_WORD_DOT = re.compile(rf"\x20(?:{DOT})\x20", re.I)
_SPELLED = re.compile(
    rf"(?<!\w)(?:plus[\x20-])?(?:(?:{_DIGIT})|[0-9])(?:[\x20,-]{{1,2}}(?:(?:{_DIGIT})|[0-9]+))+(?!\w)", re.I
)
_SPELLED_PART = re.compile(rf"(?<!\w)(?:plus|{_DIGIT})(?!\w)|[0-9]|[\x20,-]+", re.I)
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_DIGIT})[\x20,-]{{1,2}}(?:{_DIGIT})(?!\w)", re.I)
_DOT_HINT = re.compile(rf"(?:\x20|{_LEFT})(?:{DOT})(?:\x20|{_RIGHT})", re.I)
_AT_HINT = re.compile(rf"{_LEFT}\x20?(?:{AT})\x20?{_RIGHT}|\x20(?:{AT})\x20{_HOST}", re.I)
_SIGN_HINT = re.compile(rf"{_LEFT}\x20?[.@]\x20?{_RIGHT}")
_DOTS, _ATS = DOT.split("|"), AT.split("|")
_TELLING = frozenset(DIGIT_WORDS) - {"un", "uno"}


def detect(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the base rules."""
    if "@" in text:
        yield from _emails(text)
    for m in IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS.start:
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) in CARD_DIGITS and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if sum(map(m[0].count, "0123456789")) in PHONE_DIGITS:
                yield "phone", *m.span()


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """From each @ to the left: the leftmost match starts where the run of local characters does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


class Rewritten:
    """A text with, for each of its characters, where its source starts and ends, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.changed = [False] * len(text)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put other text in place of spans given in order; each new character stands for the whole span."""
        if not edits:
            return
        text, first, last, changed, done = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[done:a])
            first += self.first[done:a]
            last += self.last[done:a]
            changed += self.changed[done:a]
            if new:
                text.append(new)
                first += [self.first[a]] * len(new)
                last += [self.last[b - 1]] * len(new)
                changed += [True] * len(new)
            elif first and a < b:  # a vanished character: what stands before it is rewritten text now
                changed[-1] = True
            done = b
        self.text, self.first, self.last, self.changed = "".join(text), first, last, changed


def disguised(text: str) -> bool:
    """Whether a transducer has anything to do; runs of nothing but the articles un and uno do not count."""
    if not text.isascii() and _STRANGE.search(text) or _SIGN_HINT.search(text):
        return True
    lowered = text.lower()
    if any(word in lowered for word in _DOTS) and _DOT_HINT.search(text):
        return True
    if any(word in lowered for word in _ATS) and _AT_HINT.search(text):
        return True
    words = lowered.replace("-", " ").replace(",", " ").split()
    return not _TELLING.isdisjoint(words) and bool(_SPELLED_HINT.search(text))


def rewrite(text: str) -> Rewritten:
    """All transducers, one after the other."""
    now = Rewritten(text)
    now.replace([(m.start(), m.end(), _ONE[ord(m[0])]) for m in _STRANGE.finditer(now.text)])
    now.replace([(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(now.text)])
    bare = []
    for m in _BARE.finditer(now.text):
        found = [(x.start(), x.end(), "@") for x in _WORD_AT.finditer(now.text, m.start(), m.end())]
        found += [(x.start(), x.end(), ".") for x in _WORD_DOT.finditer(now.text, m.start(), m.end())]
        bare += sorted(found)
    now.replace(bare)
    spelled = []
    for m in _SPELLED.finditer(now.text):
        if _SPELLED_HINT.search(m[0]):
            for x in _SPELLED_PART.finditer(now.text, m.start(), m.end()):
                word = x[0].lower()
                digit = "+" if word == "plus" else DIGIT_WORDS.get(word, word if word.isdigit() else "")
                if digit != word:
                    spelled.append((x.start(), x.end(), digit))
    now.replace(spelled)
    return now


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans, and those that only the rewritten text shows."""
    base = list(detect(text))
    spans = [(*s, True) for s in base]
    if disguised(text):
        now = rewrite(text)
        for kind, a, b in detect(now.text):
            start, stop = now.first[a], now.last[b - 1]
            if any(now.changed[a:b]) and not any(k == kind and x <= start and stop <= y for k, x, y in base):
                spans.append((kind, start, stop, False))
    return spans


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and ``spans``."""
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])
    )

    def run(keys: pa.RecordBatch, texts: list) -> list:
        return [keys.column(0), pa.array([ordered(find(t), KINDS) for t in texts], kind)]

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col], text_col, run, f"{id_col} {id_type}, spans array<{SPAN}>")
