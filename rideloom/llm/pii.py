"""Personal information in free text, by a semi-Markov conditional random field.

A text is segmented into spans of a type (email, phone, national_id, address, person) and text outside. Candidate
spans are generated by form (every type may claim overlapping and nested spans), whole-span features score each
(the shape of the whole span, the cue words before and the word after it, lists of names, name endings, lengths), and dynamic
programming over end positions jointly chooses boundaries and types: the best-scoring set of spans that don't
overlap. A person has at most MOST_NAME_TOKENS tokens, so the work grows with the text's length only.

Features come in blocks, small tuples that many spans share; a block stands for a set of features, and its summed
weight is kept, so scoring a span is a few look-ups.

The weights are fitted here, by the gradient of the conditional likelihood (forward-backward over the same
candidates), on sentences made from a grammar of general knowledge (train_sentences) with known spans; their number is
a parameter. Names come from a list of known names, which is incomplete: most names of the sentences are not on it.

Defined results: null and empty texts have no spans; offsets count code points; rows are judged alone, so repeated
rows have the same spans; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rideloom.llm import pii_words as W
from rideloom.llm.pii_grammar import train_sentences

KINDS = ("email", "phone", "national_id", "address", "person")
MOST_NAME_TOKENS = 7
#: Sentences the weights are fitted on, and passes over them.
TRAIN_SENTENCES, PASSES = 4000, 5
#: Names on the list are at most this many; the list goes to every executor.
MOST_NAMES = 200_000

# ---- forms ------------------------------------------------------------------------------------------------------

_DOT = r"(?:\.|\s\.\s|\s+dot\s+|\s*\[\s*dot\s*\]\s*|\s*\(\s*dot\s*\)\s*|\s+punkt\s+|\s+punto\s+|\s+ponto\s+|\s+point\s+)"
_LOCAL = r"[\p{L}\p{M}\p{N}_](?:[\p{L}\p{M}\p{N}_+\-]|\.(?=[\p{L}\p{M}\p{N}_+\-]))*"
_LABEL = r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}\-]*[\p{L}\p{M}\p{N}])?"
_AT_SIGN = regex.compile(r"@|(?<=\s)at(?=\s)|\[\s*at\s*\]|\(\s*at\s*\)|(?<=\s)arroba(?=\s)", regex.I)
_DOMAIN = regex.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,}}", regex.I)
_DIGIT = regex.compile(r"\d")
_DOT_WORD = regex.compile(r"\b(?:dot|punkt|punto|ponto|point)\b")
_LOCAL_SIGN = regex.compile(r"[\p{L}\p{M}\p{N}_+\-.]")
_SPELLED_DOT = regex.compile(r"(?:\s\s*dot\s*\s|\s*\[\s*dot\s*\]\s*|\s*\(\s*dot\s*\)\s*)", regex.I)


def _local_start(text: str, end: int) -> int:
    """Where the local part of an address that ends at `end` starts; end itself if there is none. Parts may be joined by a spelled dot."""
    at = end
    while True:
        start = at
        while start and _LOCAL_SIGN.match(text[start - 1]):
            start -= 1
        while start < at and text[start] in ".+-":
            start += 1
        if start == at:
            return end if at == end else back
        back = start
        # A spelled dot before it joins another part.
        i = start
        while i and text[i - 1].isspace():
            i -= 1
        for tail in ("dot", "[dot]", "(dot)", "[ dot ]", "( dot )"):
            j = i - len(tail)
            if j > 0 and text[j:i].lower() == tail:
                while j and text[j - 1].isspace():
                    j -= 1
                if _SPELLED_DOT.fullmatch(text, j, start) and j:
                    at = j
                    break
        else:
            return start


PHONE = [
    ("plus", regex.compile(r"(?<![\w/+])\+\d{1,3}[\s.\-]?(?:\(\d{1,4}\)[\s.\-]?)?\d{1,4}(?:[\s.\-]?\d{2,8}){1,5}(?!\d)")),
    ("bracket", regex.compile(r"(?<![\d\w+])\(0?\d{2,4}\)[\s.\-/]?\d{2,5}(?:[\s.\-]?\d{2,6}){0,3}(?!\d)")),
    ("nanp", regex.compile(r"(?<![\d\w+#\-/])(?:1[\s.\-])?\(?[2-9]\d{2}\)?([\s.\-])[2-9]\d{2}\1?[\s.\-]?\d{4}(?!\d)(?![\-/]\d)")),
    ("nanp2", regex.compile(r"(?<![\d\w+#\-/])(?:1[\s.\-])?[2-9]\d{2}[\s.\-]\d{3}[\s.\-]\d{2}[\s.\-]\d{2}(?!\d)(?![\-/]\d)")),
    ("seven", regex.compile(r"(?<![\d\w+#\-/.])\d{3}[\-. ]\d{4}(?!\d)(?![\-/]\d)")),
    ("solid", regex.compile(r"(?<![\d\w+#\-/.])(?:0|1)?\d{9,10}(?!\d)(?![\-/]\d)")),
    ("zero", regex.compile(r"(?<![\d\w+#\-.])0\d{1,4}[\s/.\-]\d{2,8}(?:[\s.\-]\d{2,6}){0,4}(?!\d)(?![\-/]\d)")),
    ("pairs", regex.compile(r"(?<![\d\w+#\-.])0\d([\s.\-])\d{2}\1\d{2}\1\d{2}\1\d{2}(?!\d)")),
]
NATIONAL_ID = [
    ("three", regex.compile(r"(?<![\d\w#\-/])\d{3}([\s\-])\d{2}\1\d{4}(?!\d)(?!-\d)")),
    ("nine", regex.compile(r"(?<![\d\w#\-/.])\d{9}(?![\d\w])")),
    ("letters", regex.compile(r"(?<![\w#\-])[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z](?!\w)", regex.I)),
    ("prefix", regex.compile(r"(?<![\w#\-])[A-Z]{2,4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d(?!\w)", regex.I)),
    ("xletter", regex.compile(r"(?<![\w#\-])[XYZ][\s\-]?\d{7}[\s\-]?[A-Z](?!\w)", regex.I)),
    ("trailing", regex.compile(r"(?<![\w#\-])\d{8}[\s\-]?[A-Z](?!\w)", regex.I)),
]
#: What a form needs, found fast from its digits.
_ONLY_WITH = {
    "nanp": regex.compile(r"\d{3}\)?[\s.\-]\d{3}"),
    "nanp2": regex.compile(r"\d{3}[\s.\-]\d{3}[\s.\-]\d{2}"),
    "letters": regex.compile(r"\d\d\s?\d\d\s?\d\d\s?[A-Za-z](?!\w)"),
    "prefix": regex.compile(r"\d{4}[\s\-]?\d{4}[\s\-]?\d(?!\w)"),
}
#: Words of addresses.
_GERMAN_ENDS = ("strasse", "str", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "steig", "markt", "kamp", "hof", "feld", "berg", "stieg", "pfad", "graben", "chaussee", "promenade", "wall", "tor")
_GERMAN_WORDS = frozenset("am an der den im in zum zur auf dem alte alter altes neue neuer neues".split())
_STREET = r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|way|crescent|cres|drive|dr|court|ct|square|sq|terrace|ter|place|pl|row|quay|close|walk|hill|parade|grove|mews)"
_ROMANCE = r"(?:rue|avenue|av\.?|boulevard|bd|allée|allee|quai|place|chemin|impasse|calle|c/|avenida|avda\.?|paseo|plaza|camino|ronda|rua|travessa|praça|praca|largo|estrada|via|viale|piazza|corso)"
_IBERIAN = r"(?:calle|c/|avenida|avda\.?|paseo|plaza|camino|ronda|rua|travessa|praça|praca|largo|estrada|via|viale|piazza|corso)"
_GERMAN = r"(?:\p{L}+(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|markt|kamp|hof|feld|berg|stieg|pfad|graben|chaussee|promenade|wall|tor)|(?:am|an der|an den|im|in der|zum|zur|auf dem|alte[rs]?|neue[rs]?)\s+\p{Lu}\p{L}+)"
_TOWNNAME = r"\p{L}[\p{L}\p{M}’'\-]+(?:\s\p{L}[\p{L}\p{M}’'\-]+)?"
_UNIT = r"(?:,?\s*(?:apt|apartment|unit|suite|ste|flat|floor|fl|room)\.?\s*\#?\s*\w{1,5}|\s*,?\s*\#\s?\w{1,5})"
_FLOOR = r"(?:,\s*\d{1,2}\s?[ºª°]\s?(?:\p{L}{1,4}\b)?|,\s*(?:bajo|rez-de-chaussée|\d{1,2}\.\s?(?:OG|Stock)))"
_TAIL_EN = rf"(?P<unit>{_UNIT})?(?P<town>(?:,\s*|\s*[\r\n]+\s*){_TOWNNAME}(?:\s\d{{5}})?)?"
_TAIL = rf"(?P<unit>{_FLOOR})?(?P<town>(?:,\s*|\s*[\r\n]+\s*)\d{{5}}\s{_TOWNNAME}|(?:,\s*|\s*[\r\n]+\s*){_TOWNNAME}(?:\s\d{{5}})?)?"
ADDRESS = [
    ("english", regex.compile(rf"(?<![\w#.,\-/])\d{{1,5}}[a-z]?\s(?:[NSEW]\.?\s|old\s|new\s|upper\s|lower\s|north\s|south\s|east\s|west\s)?(?:\p{{L}}[\p{{L}}\p{{M}}’'\-]+\s){{1,2}}{_STREET}\b(?:\.(?=,|\s*(?:apt|unit|\#)))?{_TAIL_EN}", regex.I)),
    ("box", regex.compile(rf"(?<!\w)(?:p\.?\s?o\.?\s?box|postfach|apartado(?:\sde\scorreos)?|apdo\.?|boîte\spostale|b\.?p\.|caixa\spostal)\s\#?\d{{1,6}}{_TAIL_EN}", regex.I)),
    ("french", regex.compile(rf"(?<![\w#.\-/])\d{{1,4}}\s?(?:bis|ter|quater)?,?\s(?:{_ROMANCE})\s(?:(?:du|de|des|la|le|les|da|do|das|dos|del|los|las|l['’]|d['’])\s?)*\p{{L}}[\p{{L}}\p{{M}}’'\-]+{_TAIL}", regex.I)),
    ("iberian", regex.compile(rf"(?<!\w)(?:{_IBERIAN})\s(?:(?:du|de|des|la|le|les|da|do|das|dos|del|los|las)\s)*\p{{L}}[\p{{L}}\p{{M}}’'\-]+(?:\s\p{{L}}[\p{{L}}\p{{M}}’'\-]+)?,?\s(?:n[ºo°.]\.?\s?)?\d{{1,4}}[a-z]?\b{_TAIL}", regex.I)),
    ("german", regex.compile(rf"(?<!\w){_GERMAN}\s\d{{1,4}}(?:\s?[a-z]\b)?(?P<unit>{_FLOOR})?(?P<town>(?:,\s*|\s*[\r\n]+\s*)(?:\d{{5}}\s)?{_TOWNNAME})?", regex.I)),
]
#: Letters of scripts that write words apart; a byte pair read as Latin-1 (Ã¶) counts as a letter.
_LETTERS = r"(?:[\p{Latin}\p{Cyrillic}\p{Greek}\p{Arabic}\p{Devanagari}\p{M}]|(?<=[ÃÂ])[\x80-\xbf])+"
_TOKEN = regex.compile(rf"{_LETTERS}(?:['’](?!s\b|S\b){_LETTERS})*\.?|\d+|[\r\n]+|[^\s\p{{L}}\p{{M}}\d]|\p{{L}}")
_SIGN = regex.compile(r"[\p{L}\p{M}\p{N}]+|[\r\n]+|[^\s\p{L}\p{M}\p{N}]")
@lru_cache(maxsize=100_000)
def plain(word: str) -> str:
    """Without case and accents, for endings and lists: broken or missing accents then still match."""
    if word.isascii():
        return word.lower()
    if "Ã" in word:
        try:
            word = word.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFC", word).casefold()) if not unicodedata.combining(c))


@dataclass
class Names:
    """The list of known names, and how family names begin and end."""

    given: frozenset[str]
    family: frozenset[str]
    endings: frozenset[str] = field(default_factory=frozenset)
    stems: frozenset[str] = field(default_factory=frozenset)
    seen: dict[str, str] = field(default_factory=dict)  # kinds of words met before, emptied when large
    classes: dict[str, dict[str, str]] = field(default_factory=dict)  # classes of tokens by case of the text

    @staticmethod
    def of(rows: Iterable[tuple[str, str]]) -> Names:
        given, family = set(), set()
        for name, kind in rows:
            if name:
                (given if kind == "given" else family).add(plain(name))
        ends, heads = Counter(), Counter()
        for f in family:
            for k in range(3, min(7, len(f) - 1)):
                ends[f[-k:]] += 1
            for k in range(3, min(6, len(f))):
                heads[f[:k]] += 1
        least = max(3, len(family) // 100)
        return Names(frozenset(given), frozenset(family), frozenset(e for e, n in ends.items() if n >= least), frozenset(h for h, n in heads.items() if n >= least))

    def kind(self, word: str) -> str:
        """g: known given name, f: known family name, m: made like one (stem and ending), b: in both lists, or nothing."""
        k = self.seen.get(word)
        if k is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            k = self.seen[word] = self._kind(word)
        return k

    def _kind(self, word: str) -> str:
        p = plain(word)
        g, f = p in self.given, p in self.family
        if not (g or f) and ("'" in p or "’" in p):
            p = regex.split(r"['’]", p)[-1]
            f = p in self.family
        if not (g or f) and p.startswith("mc") and len(p) > 5:
            p = p[2:]
            f = p in self.family
        if g or f:
            return "b" if g and f else "g" if g else "f"
        return "m" if len(p) > 5 and any(p[:k] in self.stems and any(p[-e:] in self.endings for e in range(3, len(p) - k + 2)) for k in (3, 4, 5)) else ""


@dataclass(slots=True)
class Span:
    start: int
    end: int
    kind: str
    features: list


# ---- candidates -------------------------------------------------------------------------------------------------


_PLAIN_WORDS: dict[str, str] = {}


class Signs:
    """Tokens of a text, and its words, signs and line ends in order, to look up what stands before and after a place."""

    __slots__ = ("ends", "starts", "tokens", "words")

    def __init__(self, text: str) -> None:
        self.tokens = tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.starts, self.ends, self.words = starts, ends, words = [], [], []
        for w, a, b in tokens:
            p = _PLAIN_WORDS.get(w)
            if p is not None:  # the usual case: one word or sign
                starts.append(a)
                ends.append(b)
                words.append(p)
                continue
            parts = [(m.group(), a + m.start(), a + m.end()) for m in _SIGN.finditer(w)]
            for x, c, e in parts:
                starts.append(c)
                ends.append(e)
                words.append("\n" if x[0] in "\r\n" else "0" if x[0].isdigit() else plain(x))
            if len(parts) == 1 and parts[0][0] == w:
                if len(_PLAIN_WORDS) > 200_000:
                    _PLAIN_WORDS.clear()
                _PLAIN_WORDS[w] = words[-1]


def _plained(words: Iterable[str]) -> frozenset[str]:
    return frozenset(plain(w) for w in words)


PARTICLES, PLACE_WORDS, CALENDAR = _plained(W.PARTICLES), _plained(W.PLACE_WORDS), _plained(W.CALENDAR)
ORDINARY = _plained(W.ORDINARY).union(*map(_plained, W.ORDINARY_OTHER)) - PARTICLES
_CUE_OF = {w: kind for kind, words in (("kin", W.KIN), ("role", W.ROLE), ("sign", W.SIGN_OFF), ("greet", W.GREETING), ("title", W.TITLES)) for w in _plained(words)}
_NAMING = frozenset(" ".join(plain(w) for w in phrase.split()) for phrase in W.NAMING)
TITLES = _plained(W.TITLES)
_ELIDED = frozenset("j l d m n s t c qu".split())
_NAMING_ENDS = frozenset(phrase.rsplit(" ", 1)[-1] for phrase in _NAMING)
_SAYING = _plained(W.SAYING)
_NUMBER_OF = {w: kind for kind, words in W.NUMBER_WORDS.items() for w in _plained(words)}
_GAP = frozenset(":=,\"'(-—–>|{<.*\n")


def _cue(words: list[str], i: int) -> str:
    """What opens a name at sign i: its kind and the signs in between, or nothing."""
    j, gap = i - 1, ""
    while j >= 0 and words[j] in _GAP and len(gap) < 3:
        gap = words[j] + gap
        j -= 1
    if j < 0:
        return "^" + gap
    w = words[j]
    if w in _NAMING_ENDS:
        two = f"{words[j - 1]} {w}" if j else w
        if w in _NAMING or two in _NAMING or (j > 1 and (f"{words[j - 2]} {two}" in _NAMING or j > 2 and f"{words[j - 3]} {words[j - 2]} {two}" in _NAMING)):
            return "name" + gap
    kind = _CUE_OF.get(w)
    return kind + gap if kind else "/" + gap if gap else ""


_STRONG_CUES = frozenset(["name", "name:", "title", "title.", "greet", "greet,", "sign,\n", "sign\n", "role:", "role=", 'role":"'])


def _left(kind: str, signs: Signs, start: int) -> tuple:
    i = bisect_right(signs.ends, start)
    w = signs.words
    near = ""
    for j in range(i - 1, max(-1, i - 6), -1):
        near = _NUMBER_OF.get(w[j], "")
        if near:
            break
    return ("L", kind, w[i - 1] if i else "^", w[i - 2] if i > 1 else "^", near)


def _right(kind: str, signs: Signs, end: int) -> tuple:
    i = bisect_left(signs.starts, end)
    return ("R", kind, signs.words[i] if i < len(signs.words) else "$")


def expand(block: tuple) -> list[str]:
    """The features a block stands for."""
    tag, kind = block[:2]
    if tag == "L":
        _, _, a, b, near = block
        return [f"{kind}|bias", f"{kind}|l1={a}", f"{kind}|l2={b} {a}", f"{kind}|near={near}"]
    if tag == "R":
        r = block[2]
        return [f"{kind}|r1={r}", f"{kind}|saying={r in _SAYING}", f"{kind}|rplace={r in PLACE_WORDS}", f"{kind}|rord={r in ORDINARY}"]
    if tag == "F":
        return [f"{kind}|{x}" for x in block[2:]]
    if tag == "P":
        _, _, shape, mode, cue, prev, follow, known, first = block
        parts = shape.split(" ")
        coarse = " ".join("N" if x in ("g", "f", "b", "m", "C") else x for x in parts)
        kindc = cue.rstrip(":=,\"'(-—–>|{<.*\n")
        return [f"p|{x}" for x in (f"shape={shape}", f"shape={shape} {mode}", f"coarse={coarse}", f"coarse={coarse} cue={cue}", f"coarse={coarse} {kindc}", f"cue={cue}", f"shape={shape} {kindc}", f"prev={prev}", f"prev={prev} {coarse}", f"next={follow}", f"next={follow} {coarse}", f"known={known} {mode}", f"known={known} {kindc}", f"tokens={len(parts)}", f"place={'Z' in shape or 'z' in shape}", f"first={first} {shape}", f"first={first} {kindc}")]
    _, _, head, tail, low, calendar, ordinary, n, known = block
    return [f"w|{x}" for x in (f"head={head[-3:]}", f"head={head[-2:]}", f"tail={tail[-3:]}", f"tail={tail[-2:]}", f"tail4={tail[-4:]}", f"low={low} {n > 1} {known}", f"calendar={calendar} {n}", f"ordinary={ordinary} {n} {known}")]


def _digits(s: str) -> str:
    return regex.sub(r"\p{L}", "a", regex.sub(r"\d", "0", regex.sub(r"\s", " ", s)))


def candidates(text: str, names: Names) -> list[Span]:
    spans: dict[tuple[int, int, str], list[tuple]] = {}
    signs = Signs(text)

    def add(start: int, end: int, kind: str, *features: str) -> None:
        key = (start, end, kind)
        if key not in spans:
            spans[key] = [_left(kind, signs, start), _right(kind, signs, end)]
        spans[key].append(("F", kind, *features))

    for m in _AT_SIGN.finditer(text):
        lo, hi = m.span()
        while hi < len(text) and text[hi].isspace():
            hi += 1
        domain = _DOMAIN.match(text, hi)
        if domain is None:
            continue
        while lo and text[lo - 1].isspace():
            lo -= 1
        start = _local_start(text, lo)
        if start < lo:
            at = text[lo:hi]
            sign, dots = at.strip().lower(), " ".join(sorted(set(_DOT_WORD.findall(domain.group().lower()))))
            add(start, domain.end(), "email", "form=plain" if at == "@" else "form=spelled", f"at={sign}", f"dot={'.' in domain.group()}", f"dots={dots}", f"at={sign} dots={dots}", f"digit={any(map(str.isdigit, text[start:lo]))}")
    if _DIGIT.search(text):
        for kind, forms in (("phone", PHONE), ("national_id", NATIONAL_ID)):
            for form, rx in forms:
                if form in _ONLY_WITH and not _ONLY_WITH[form].search(text):
                    continue
                for m in rx.finditer(text):
                    shape = _digits(m.group())
                    add(m.start(), m.end(), kind, f"form={form}", f"shape={shape}", f"head={shape[:2]}", f"first={m.group()[0]}", f"digits={sum(c.isdigit() for c in m.group())}", *([f"part={m.group()[:3].strip('+(')}"] if kind == "phone" else []))
                    if kind == "phone" and "\n" in m.group():
                        spans[(m.start(), m.end(), kind)].append(("F", kind, "line"))
        german = any(w == "0" and i and (signs.words[i - 1].endswith(_GERMAN_ENDS) or i > 1 and (signs.words[i - 2] in _GERMAN_WORDS or signs.words[i - 1] == "." and signs.words[i - 2].endswith("str"))) for i, w in enumerate(signs.words))
        for form, rx in ADDRESS:
            if form == "german" and not german:
                continue
            for m in rx.finditer(text, overlapped=True):
                whole, ends = m.group(), {m.end()}
                for g in ("town", "unit"):  # with and without town and unit
                    if m.group(g):
                        ends.add(m.start(g))
                town = m.group("town")
                if town:
                    words = list(regex.finditer(r"\S+", town))
                    for w in words[:-1]:
                        ends.add(m.start("town") + w.end())
                    if regex.match(r"\W*\d{5}", town) is None and (z := regex.search(r"\d{5}", town)) is None and len(words) > 1:
                        ends.add(m.start("town") + words[0].end())
                for e in ends:
                    part = text[m.start() : e].rstrip(" ,\r\n\t\xa0")
                    if not part:
                        continue
                    e2 = m.start() + len(part)
                    has_zip = bool(regex.search(r"(?<!\d)\d{5}(?!\d)", part[6:]))
                    has_town = bool(town) and e > m.start("town") + 1
                    street = regex.match(r".*?\b(" + _STREET + r")\b", part, regex.I)
                    town_shape = ""
                    if has_town:
                        t = part[m.start("town") - m.start() :]
                        tw = regex.findall(r"[\p{L}\p{M}’'\-]+|\d+", t)
                        town_shape = " ".join("0" if w[0].isdigit() else "C" if w[0].isupper() else "c" for w in tw)
                    add(m.start(), e2, "address", f"form={form}", f"zip={has_zip}", f"town={has_town}", f"unit={bool(m.group('unit')) and e > m.start('unit')}", f"tail={town_shape}", f"form={form} tail={town_shape}", f"more={e2 < m.end()}", f"calendar={any(plain(w) in CALENDAR for w in regex.findall(r'[^\W\d]+', part))}", f"line={chr(10) in part}", *([f"street={plain(street.group(1))}"] if street else []))
                    if has_town:
                        last = plain(regex.findall(r"[\p{L}\p{N}]+", part)[-1])
                        spans[(m.start(), e2, "address")].append(("F", "address", f"last={'0' if has_zip else 'ordinary' if last in ORDINARY else 'place' if last in PLACE_WORDS else 'other'}"))
    _people(text, names, signs, spans)
    return [Span(s, e, k, f) for (s, e, k), f in spans.items()]


_STARTS = frozenset(("C", "g", "f", "b", "m", "Gl", "Fl", "Bl", "Ml", "I", "p"))


class _Latin:
    """Capital letters of the Latin script; in others a capital alone says too little, names there need an opening or the list."""

    def __contains__(self, letter: str) -> bool:
        return letter < "ʰ"


_LATIN = _Latin()


def _class_of(w: str, mode: str, names: Names, known: dict[str, str]) -> str:
    """Kind of a token: name kinds of the list, I and i initials, p particle, C capitalised, Z and z places, w word."""
    word = w.rstrip(".")
    if not word or not word[0].isalpha():
        c = w if w in "-,&" else ""
    else:
        p, k = plain(word), names.kind(word)
        if len(word) == 1 and (word.isupper() or mode == "L") and w.endswith("."):
            c = "I"
        elif len(word) == 1 and word.isupper():
            c = "i"
        elif k:
            c = k if (word[0].isupper() or mode != "M") else k.upper() + "l"
        elif p in PARTICLES:
            c = "p"
        elif word[0].isupper() and mode != "U" and not (len(word) > 3 and word.isupper()):
            bare = regex.split(r"['’]", p)[0]
            c = "Z" if p in PLACE_WORDS else "C" if word[0] in _LATIN and p not in TITLES and bare not in ORDINARY and bare not in _ELIDED else "w"
        else:
            c = "z" if mode != "M" and p in PLACE_WORDS else "w"
    if len(known) > 200_000:
        known.clear()
    known[w] = c
    return c


_NAMEISH = frozenset(("C", "g", "f", "b", "m", "w", "Z", "z", "Gl", "Fl", "Bl", "Ml"))
_SENTENCE = frozenset((".", "!", "?", "\n", ":", "-", "—", "|", "…", ">"))


def _people(text: str, names: Names, signs: Signs, spans: dict[tuple[int, int, str], list[tuple]]) -> None:
    upper, lower = sum(map(str.isupper, text)), sum(map(str.islower, text))
    mode = "U" if lower < upper else "L" if upper * 200 < lower and not regex.search(r"(?:^|[.!?]\s+)\p{Lu}\p{Ll}", text) else "M"
    toks, words = signs.tokens, signs.words
    known = names.classes.setdefault(mode, {})
    cls = [known.get(w) if w in known else _class_of(w, mode, names, known) for w, _, _ in toks]
    n = len(toks)
    lows = {w for w, _, _ in toks if w.islower()} if mode == "M" else frozenset()
    at = 0  # the sign a token starts with
    for i in range(n):
        c = cls[i]
        start = toks[i][1]
        if c not in _STARTS and c != "w":
            continue
        while signs.starts[at] < start:
            at += 1
        cue = _cue(words, at)
        cued = cue in _STRONG_CUES
        if c == "w" and not cued:
            continue
        before = words[at - 1] if at else "^"
        prev = cls[i - 1] if i else ""
        if i and start == toks[i - 1][2] and (prev == "-" or toks[i - 1][0] in "@_+/#"):
            continue
        if i and not (start - toks[i - 1][2] <= 1 and "\n" not in text[toks[i - 1][2] : start] and "\r" not in text[toks[i - 1][2] : start]):
            prev = "/"
        first = at == 0 or before in _SENTENCE
        # Spans from i, token by token; a comma may stand once, between family and given name.
        shape, has, comma, listed, low, j = [], False, False, False, False, i
        while j < n and j - i < MOST_NAME_TOKENS:
            w, s, e = toks[j]
            k = cls[j]
            if j > i:
                gap = s - toks[j - 1][2]
                if k == "-" and gap == 0 and shape[-1] not in ("-", ","):
                    shape.append("-")
                    j += 1
                    continue
                if k == "," and not comma and gap == 0 and has and j + 1 < n and _close(text, toks, j + 1) and cls[j + 1][:1] in ("g", "C", "b", "I", "w", "G", "B") and len([x for x in shape if x not in "-p"]) <= 2:
                    shape.append(",")
                    comma = True
                    j += 1
                    continue
                if shape[-1] == "-" and gap:
                    break
                if shape[-1] != "-" and not _close(text, toks, j):
                    break
            if k not in _NAMEISH and k not in ("I", "i", "p") or k == "w" and not (cued and j - i < 3):
                break
            stop = k != "I" and e - s > 1 and text[e - 1] == "."
            if stop:
                e -= 1
            shape.append(k)
            if k in _NAMEISH:
                has = has or k not in ("Z", "z")
                listed = listed or k[:1].lower() in ("g", "f", "b", "m")
                if not low and w.rstrip(".").lower() in lows:
                    low = True
                hyphen = j + 2 < n and toks[j + 1][0] == "-" and toks[j + 1][1] == toks[j][2] and toks[j + 2][1] == toks[j + 1][2]
                if has and not hyphen and (listed or cued or "C" in shape):
                    follow = (cls[j + 1] if toks[j + 1][0] != "&" else "&") if j + 1 < n and _close(text, toks, j + 1) else "/"
                    head, tail = plain(toks[i][0].rstrip(".")), plain(text[s:e])
                    block = ("P", "p", " ".join(shape), mode, cue, "&" if before == "&" else prev, follow, listed, first)
                    own = ("W", "w", head if c in ("C", "w") else "#", tail if k in ("C", "w") else "#", low, head in CALENDAR or tail in CALENDAR, head in ORDINARY or tail in ORDINARY, len(shape), listed)
                    spans[(start, e, "person")] = [_left("person", signs, start), _right("person", signs, e), block, own]
            if stop:
                break
            j += 1


def _close(text: str, toks: list[tuple[str, int, int]], i: int) -> bool:
    """Token i follows i - 1 with at most one blank between."""
    a, b = toks[i - 1][2], toks[i][1]
    return b == a or b - a == 1 and text[a] not in "\r\n"


# ---- the model --------------------------------------------------------------------------------------------------


def _lattice(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.end, s.start, s.kind))


class Scores(dict):
    """Summed weights of blocks, kept once computed; emptied when large."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, block: tuple) -> float:
        if len(self) > 500_000:
            self.clear()
        weights = self.weights
        self[block] = score = sum(weights.get(f, 0.0) for f in expand(block))
        return score


def decode(spans: list[Span], weights: Mapping) -> list[Span]:
    """The best-scoring segmentation: spans that don't overlap, the rest outside with score 0."""
    ordered = _lattice(spans)
    ends: list[int] = []
    best: list[float] = [0.0]  # best score using the first i spans
    took: list[bool] = []
    for s in ordered:
        score = 0.0
        for f in s.features:
            score += weights[f]
        before = best[bisect_right(ends, s.start)]
        ends.append(s.end)
        took.append(before + score > best[-1])
        best.append(max(best[-1], before + score))
    out, i = [], len(ordered)
    while i:
        if took[i - 1]:
            out.append(ordered[i - 1])
            i = bisect_right(ends, ordered[i - 1].start, 0, i)
        else:
            i -= 1
    return out[::-1]


def _marginals(ordered: list[Span], scores: list[float]) -> list[float]:
    """P(span is chosen) under the model, by forward and backward sums over segmentations."""
    n = len(ordered)
    ends = [s.end for s in ordered]
    fwd = [0.0] * (n + 1)  # log sum over segmentations of the first i spans
    for i, s in enumerate(ordered):
        a, b = fwd[i], fwd[bisect_right(ends, s.start, 0, i)] + scores[i]
        m = max(a, b)
        fwd[i + 1] = m + math.log(math.exp(a - m) + math.exp(b - m))
    by_start = sorted(range(n), key=lambda i: (ordered[i].start, ordered[i].end))
    starts = [ordered[i].start for i in by_start]
    bwd = [0.0] * (n + 1)  # the same over spans by start from position i on
    for k in range(n - 1, -1, -1):
        i = by_start[k]
        a, b = bwd[k + 1], bwd[bisect_left(starts, ordered[i].end)] + scores[i]
        m = max(a, b)
        bwd[k] = m + math.log(math.exp(a - m) + math.exp(b - m))
    z = fwd[n]
    return [math.exp(fwd[bisect_right(ends, s.start, 0, i)] + scores[i] + bwd[bisect_left(starts, s.end)] - z) for i, s in enumerate(ordered)]


def fit(sentences: Sequence[tuple[str, list[tuple[int, int, str]]]], names: Names, passes: int = PASSES, rate: float = 0.5, shrink: float = 1e-4, seed: int = 7) -> dict[str, float]:
    """Weights that maximise the conditional likelihood of the spans, by adaptive gradient steps."""
    data = []
    for text, gold in sentences:
        spans = _lattice(candidates(text, names))
        marked = set(gold)
        data.append((spans, [1.0 if (s.start, s.end, s.kind) in marked else 0.0 for s in spans], [[f for b in s.features for f in expand(b)] for s in spans]))
    w: dict[str, float] = {}
    g2: dict[str, float] = {}
    rng = random.Random(seed)
    for _ in range(passes):
        rng.shuffle(data)
        for spans, truth, features in data:
            if not spans:
                continue
            scores = [sum(w.get(f, 0.0) for f in fs) for fs in features]
            grad: dict[str, float] = {}
            for fs, p, t in zip(features, _marginals(spans, scores), truth):
                if abs(t - p) > 1e-4:
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + t - p
            for f, g in grad.items():
                g -= shrink * w.get(f, 0.0)
                g2[f] = g2.get(f, 1e-2) + g * g
                w[f] = w.get(f, 0.0) + rate * g / math.sqrt(g2[f])
    return {f: x for f, x in w.items() if abs(x) > 1e-3}



@dataclass
class Model:
    names: Names
    weights: dict[str, float]
    scores: Scores | None = None  # made where it is used

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        if self.scores is None:
            self.scores = Scores(self.weights)
        return [(s.start, s.end, s.kind) for s in decode(candidates(text, self.names), self.scores)]


def trained(rows: Sequence[tuple[str, str]], sentences: int = TRAIN_SENTENCES, passes: int = PASSES, seed: int = 7) -> Model:
    """A model from a list of (name, kind): fitted on made sentences most of whose names are not on it."""
    return _trained(tuple(rows), sentences, passes, seed)


@lru_cache(maxsize=2)
def _trained(rows: tuple[tuple[str, str], ...], sentences: int, passes: int, seed: int) -> Model:
    """Kept, so that several queries of a session fit once."""
    names = Names.of(rows)
    return Model(names, fit(train_sentences(rows, sentences, seed), names, passes, seed=seed))


def model_of(known_names: DataFrame, **options) -> Model:
    rows = known_names.select("name", "kind").dropna().distinct().orderBy("name", "kind").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} known names")
    return trained([(r["name"], r["kind"]) for r in rows], **options)


# ---- on tables --------------------------------------------------------------------------------------------------


def find_spans(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start_char, end_char) of each place."""
    d = documents.select(id_col, text_col)
    shared = d.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ids, kinds, starts, ends = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e, k in m.spans(text):
                    ids.append(i), kinds.append(k), starts.append(s), ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "kind", "start_char", "end_char"])

    return d.mapInArrow(run, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, kind string, start_char int, end_char int")


def masked(text: str | None, spans: Sequence[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by [KIND]."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): texts with typed placeholders; null stays null."""
    d = documents.select(id_col, text_col)
    shared = d.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [masked(t, m.spans(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return d.mapInArrow(run, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, text string")
