"""Problem 8: personal information inside free text.

Offset-preserving deobfuscation. Small transducers rewrite a text for detection only: look-alike and
full-width characters become the plain ones, invisible characters vanish, written-out at and dot
signs of addresses and spelled-out digits become signs and digits. Each rewritten character keeps
the place it came from, so a span found in the rewritten text maps back to the characters as they
are written. Most texts need no rewriting and are read as they are.

Detection starts at cheap anchors (a sign, a run of digits, a street word) and matches the full form
of the identifier around each of them. Names are found by titles, initials, particles, common given
names, signatures and salutations. What these find in the whole corpus tells which
endings its family names have; names with a learned ending are then found without such a sign too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.session import discard, materialize, spread

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# -- transducers ---------------------------------------------------------------------------------

#: Look-alikes of Latin letters (fixed values): Cyrillic and Greek letters that look the same.
_LOOKALIKES = dict(zip("асеорхуіјѕԁԛԝһАВСЕНІЈКМОРЅТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "aceopxyijsdqwhABCEHIJKMOPSTXYABEZHIKMNOPTYXoa", strict=True))
_FULL_WIDTH = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_SPACES = dict.fromkeys("\xa0             　", " ")
_DASHES = dict.fromkeys("‐‑‒–−", "-")
_ONE_TO_ONE = str.maketrans(_FULL_WIDTH | _SPACES | _DASHES)
_HAS_LETTER_LOOKALIKE = re.compile(r"[A-Za-z0-9.@][" + "".join(_LOOKALIKES) + r"]|[" + "".join(_LOOKALIKES) + r"][A-Za-z0-9.@]")
_LOOKALIKE_TABLE = str.maketrans(_LOOKALIKES)
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
#: Written-out signs inside an address, and spelled digits (fixed values, by language).
_AT = re.compile(r"[(\[{<] ?(?:at|ät|arroba|arobase) ?[)\]}>]", re.I)
_DOT = re.compile(r" ?[(\[{<] ?(?:dot|punkt|punto|point) ?[)\]}>] ?", re.I)
_WORDS_AT = re.compile(r" (?:at|arroba|arobase|ät) (?=[\w.-]+ (?:dot|punkt|punto|point) \w)", re.I)
_WORD_DOT = re.compile(r" (?:dot|punkt|punto|point) (?=\w)", re.I)
_LABEL = re.compile(r"[\w-]+")
_DOT_BEFORE = re.compile(r" ?[(\[{<] ?(?:dot|punkt|punto|point) ?[)\]}>] ?$", re.I)
_LOCAL_BEFORE = re.compile(r"[\w+%.-]+$")
_SPELLED = {
    **dict.fromkeys(("zero", "oh", "null", "cero", "zéro"), "0"), **dict.fromkeys(("one", "eins", "uno", "un"), "1"), **dict.fromkeys(("two", "zwei", "zwo", "dos", "deux"), "2"),
    **dict.fromkeys(("three", "drei", "tres", "trois"), "3"), **dict.fromkeys(("four", "vier", "cuatro", "quatre"), "4"), **dict.fromkeys(("five", "fünf", "cinco", "cinq"), "5"),
    **dict.fromkeys(("six", "sechs", "seis"), "6"), **dict.fromkeys(("seven", "sieben", "siete", "sept"), "7"), **dict.fromkeys(("eight", "acht", "ocho", "huit"), "8"),
    **dict.fromkeys(("nine", "neun", "nueve", "neuf"), "9"),
}
_DIGIT = "|".join(sorted(_SPELLED, key=len, reverse=True))
_BY_LETTER = "|".join(f"{c}(?:{'|'.join(w[1:] for w in sorted(_SPELLED, key=len, reverse=True) if w[0] == c)})" for c in sorted({w[0] for w in _SPELLED}))
_DIGIT_RUN = re.compile(rf"\b(?:(?:{_BY_LETTER}|plus|\d)[ ,-]{{1,2}}){{6,}}(?:{_BY_LETTER}|\d)\b", re.I)
#: What the five inner parts of a run of digits are, in lower case.
_DIGIT_PARTS = frozenset(_SPELLED) | frozenset("0123456789") | {"plus"}
_DIGIT_WORD = re.compile(rf"{_DIGIT}|plus|[ ,-]+|\d", re.I)


def _may_spell(low: str) -> bool:
    """Whether five digits, spelled or not, stand side by side, as in every run of seven."""
    parts = low.replace(",", " ").replace("-", " ").split()
    return "11111" in "".join(["1" if w in _DIGIT_PARTS or (len(w) == 1 and w.isdecimal()) else "0" for w in parts])


class Rewritten:
    """A text for detection and, for each of its characters, where the characters it stands for begin
    and end in the text as written (None: nothing was changed)."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def replace(self, spans: list[tuple[int, int, str]]) -> Rewritten:
        """Rewrite sorted, disjoint spans; every new character stands for its whole span."""
        if not spans:
            return self
        starts = self.starts if self.starts is not None else list(range(len(self.text)))
        ends = self.ends if self.ends is not None else list(range(1, len(self.text) + 1))
        text, first, last, at = [], [], [], 0
        for start, end, new in spans:
            text += [self.text[at:start], new]
            first += starts[at:start] + [starts[start]] * len(new)
            last += ends[at:start] + [ends[end - 1]] * len(new)
            at = end
        text.append(self.text[at:])
        return Rewritten("".join(text), first + starts[at:], last + ends[at:])


def rewrite(text: str) -> Rewritten:
    """The text as the detectors read it."""
    if text.isascii():
        plain = Rewritten(text)
    else:
        same_length = text.translate(_ONE_TO_ONE)
        if _HAS_LETTER_LOOKALIKE.search(same_length):
            same_length = same_length.translate(_LOOKALIKE_TABLE)
        plain = Rewritten(same_length)
        if _INVISIBLE.search(same_length):
            plain = plain.replace([(m.start(), m.end(), "") for m in _INVISIBLE.finditer(same_length)])
    body = plain.text
    low = body.lower()
    signs: list[tuple[int, int, str]] = []
    for m in _AT.finditer(body):
        start, end = m.span()
        signs.append((start - (body[start - 1 : start] == " "), end + (body[end : end + 1] == " "), "@"))
    if " dot " in low or " punkt " in low or " punto " in low or " point " in low:
        signs += [(m.start(), m.end(), "@") for m in _WORDS_AT.finditer(body)]
    if signs:
        dots = []
        for start, end, _ in signs:  # dots count only in the address that follows an at sign
            stop = end
            while label := _LABEL.match(body, stop):
                dot = _DOT.match(body, label.end()) or _WORD_DOT.match(body, label.end())
                if dot:
                    dots.append((dot.start(), dot.end(), "."))
                    stop = dot.end()
                elif body[label.end() : label.end() + 1] == ".":
                    stop = label.end() + 1
                else:
                    break
            before = start  # and in the part before it
            while label := _LOCAL_BEFORE.search(body, max(0, before - 64), before):
                dot = _DOT_BEFORE.search(body, max(0, label.start() - 16), label.start())
                if not dot:
                    break
                dots.append((dot.start(), dot.end(), "."))
                before = dot.start()
        plain = plain.replace(sorted(set(signs + dots)))
    if _may_spell(low) and _DIGIT_RUN.search(plain.text):
        spans = []
        for run in _DIGIT_RUN.finditer(plain.text):
            if not re.search(rf"\b(?:{_DIGIT})\b", run[0], re.I):
                continue
            for part in _DIGIT_WORD.finditer(plain.text, run.start(), run.end()):
                word = part[0].lower()
                new = _SPELLED.get(word, "+" if word == "plus" else "" if not word.strip(" ,-") else word)
                spans.append((part.start(), part.end(), new))
        plain = plain.replace(spans)
    return plain


# -- detectors -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


_EMAIL = re.compile(r"[\w%+'-]+(?:\.[\w%+'-]+)*@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w@]|[.-]\w)")


def emails(text: str) -> list[Span]:
    if "@" not in text:
        return []
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        first = at  # where the part before the sign can begin
        while first > done and (text[first - 1].isalnum() or text[first - 1] in "_%+'.-"):
            first -= 1
        m = _EMAIL.search(text, first)
        if m is None:
            break
        start, done = m.start(), m.end()
        while text[start] in "'-+%":
            start += 1
        found.append(Span("email", start, done))
        at = text.find("@", done)
    return found


#: A run that may hold a number: digits and what may stand between them, six characters at least.
_NUMBER_RUN = re.compile(r"[+(]?\d[\d ().\-/]{4,}\d")
_EDGE_BEFORE = r"(?<![\w.,/#-])"
_EDGE_AFTER = r"(?![\w/@]|[.,:-]\d|-\w)"
_PHONE = re.compile(
    _EDGE_BEFORE
    + r"(?:"
    + r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,8}){1,5}"
    + r"|00[1-9]\d{0,2}[ .-](?:\(0\)[ .-]?)?\(?\d{1,5}\)?(?:[ ./-]\d{2,8}){1,5}"
    + r"|(?:1[ .-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}"
    + r"|[2-9]\d\d[2-9]\d{6}"
    + r"|0[1-9](?:[ .-]\d\d){4}"
    + r"|07\d{9}|07\d{3}[ -]\d{3}[ -]?\d{3}"
    + r"|\(0[1-9]\d{1,4}\)[ /-]?\d{3,8}(?:[ -]\d{1,6}){0,2}"
    + r"|0[1-9]\d{1,4}[ /-]\d{3,8}(?:[ -]\d{1,6}){0,2}"
    + r"|[6789]\d\d \d{3} \d{3}|[6789]\d\d(?: \d\d){3}"
    + r")"
    + _EDGE_AFTER
)
_PHONE_CUE = re.compile(r"(?:phone|tel|tél|télf?|mobile|fax|call|text|ring|dial|callback|erreichbar unter|appeler le|llamar al|zadzwo\w+|number is|telefon\w*|anrufen)\W{0,4}$", re.I)
_PHONE_LOOSE = re.compile(_EDGE_BEFORE + r"[+(]?\d[\d ().\-/]{5,17}\d" + _EDGE_AFTER)

_ID_SHAPE = re.compile(
    r"(?<![\w.,/#-])(?:"
    r"(?P<nino>[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D])"
    r"|(?P<nir>[12] \d\d \d\d \d[\dAB] \d{3} \d{3}(?: \d\d)?)"
    r"|(?P<insured>\d\d ?\d{6} ?[A-Z] ?\d{3})"
    r"|(?P<ssn>\d{3}(?P<gap>[- ])\d\d(?P=gap)\d{4})"
    r"|(?P<passport>[A-Z]-?\d{7,8}(?:-?[A-Z])?)"
    r"|(?P<dni>(?:\d{8}|\d\d\.\d{3}\.\d{3})-?[A-Z])"
    r"|(?P<tax>\d\d \d{3} \d{3} \d{3})"
    r"|(?P<plain>[12]\d{12}(?:\d\d)?|\d{11}|\d{10}|\d{9})"
    r")(?![\w/@]|[.,:]\d|-\w)"
)
_ID_CUE = re.compile(
    r"(?:\bID|\bIDs?\s*(?:no\.?|number)|security (?:number|no\.?)|tax (?:number|no\.?|id)|passport(?: no\.?| number)?|national id|insured person|insurance (?:number|no\.?)|steuer-?id|steuernummer|"
    r"ausweis\w*|reisepass\w*|versicherungs\w*|\bdni|\bnif|\bnie|\bnir|sécurité sociale|la pièce|passeport|pièce d'identité|el documento|documento|pasaporte|seguridad social|pesel|dowód|paszport|ssn|nino|identity (?:number|card)|identität\w*|permit|licen[cs]e)"
    r"(?:\s*(?:no\.?|nr\.?|number|n[º°o]\.?))?[\s:#(=|\"-]{0,4}$",
    re.I,
)


#: Card numbers that mix letters and digits: only behind a cue.
_CARD_CUE = re.compile(r"(?:Ausweis\w*|Steuer-ID|Reisepass\w*|Passport no\.|National ID|DNI|NIE|passeport|pasaporte|documento|pièce|insured person|security number|tax number|\(ID)[\s:(#nNrR.º°]{1,5}(?=[A-Z0-9]{0,8}\d)")
_CARD = re.compile(r"(?=[A-Z0-9]*[A-Z])[A-Z0-9]{8,12}(?![\w-])")


def _next_id(text: str, start: int, run: re.Match) -> re.Match | None:
    """The first identity number from ``start`` on that begins inside a run of digits."""
    at, limit = max(start, run.start() - 4), min(len(text), run.end() + 32)
    while m := _ID_SHAPE.search(text, at, limit):
        if m.start() >= run.end():
            return None
        at = m.start() + 1
        m = _ID_SHAPE.match(text, m.start())  # with the true right edge
        if m:
            cue = _ID_CUE.search(text, max(0, m.start() - 48), m.start())
            weak = m["passport"] or m["tax"] or m["dni"]
            if cue or not (m["plain"] or (weak and _PHONE_CUE.search(text, max(0, m.start() - 24), m.start()))):
                return m
    return None


def _digits(m: re.Match) -> int:
    return sum(c.isdigit() for c in m[0])


def _phones(text: str, start: int, end: int, before_id: bool) -> list[Span]:
    """All phones between ``start`` and ``end``; an identity number may follow at ``end``."""
    found: list[Span] = []
    at = start
    while at < end:
        m = _PHONE.search(text, at, end if before_id else min(len(text), end + 1))
        if m is None:
            break
        at = m.start() + 1
        if not before_id:
            m = _PHONE.match(text, m.start())  # with the true right edge
        while m and _digits(m) > 15 and (cut := re.search(r"[ ./-]+(?=[^ ./-]*$)", m[0])):  # numbers side by side
            m = _PHONE.match(text, m.start(), m.start() + cut.start())
        if m and 7 <= _digits(m) <= 15:
            found.append(Span("phone", m.start(), m.end()))
            at = m.end()
    return found


def numbers(text: str) -> list[Span]:
    """Phones and identity numbers; a number after a cue of the other kind is left to that kind. A
    run is searched until it is used up, as what stands between numbers may be part of it."""
    found: list[Span] = []
    done = 0
    for run in _NUMBER_RUN.finditer(text):
        while done < run.end():
            start = max(done, run.start())
            m = _next_id(text, done, run)
            end = m.start() if m else run.end()
            phones = _phones(text, max(done, run.start() - 1), end, m is not None) if end - start >= 7 else []
            if not phones and end - start >= 7 and start == run.start() and _PHONE_CUE.search(text, max(0, start - 24), start):
                loose = _PHONE_LOOSE.match(text, start) if m is None else _PHONE_LOOSE.match(text, start, end)
                if loose and 7 <= _digits(loose) <= 15:
                    phones = [Span("phone", loose.start(), loose.end())]
            found += phones
            if m:
                found.append(Span("id_number", m.start(), m.end()))
                done = m.end()
            elif phones and phones[-1].end > done:
                done = phones[-1].end
            else:
                break
    if "Ausweis" in text or "ID" in text or "DNI" in text or "NIE" in text or "pass" in text or "Pass" in text or "pas" in text or "documento" in text or "pièce" in text or "person" in text or "number" in text:
        for cue in _CARD_CUE.finditer(text):
            m = _CARD.match(text, cue.end())
            if m and not any(s.start < m.end() and m.start() < s.end for s in found):
                found.append(Span("id_number", m.start(), m.end()))
    return found


_CAP = r"[A-ZÀ-ÞŁŚŻŹ][\w'’]*[a-zà-ÿłśżźćńęą]"
_TOWN = rf"{_CAP}(?:-{_CAP})?"
_POST_EN = r"(?:,? (?:[A-Z]{2} \d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}))"
_STREET_EN = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Boulevard|Blvd\.?|Way|Mews|Crescent|Close|Court|Ct\.?|Place|Square|Terrace|Parkway|Pkwy\.?|Row|Gardens|Hill|Hollow)"
_ADDRESS = re.compile(
    r"(?<![\w.])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|House) \d+\w?, )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}{_STREET_EN}(?:,? (?:Suite|Apt\.?|Unit|Flat|Floor|#) ?\w+)?, {_TOWN}{_POST_EN}?"
    rf"|(?:(?:Am|An der|Im|In der|Zum|Zur|Auf dem) )?(?:[A-ZÄÖÜ]\w*?(?:straße|strasse|weg|hof|platz|allee|gasse|ring|damm|ufer)|{_CAP} (?:Str\.|Straße)) \d+ ?[a-z]?, (?:(?:D-)?\d{{5}} )?{_TOWN}"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours|route) (?:de la |des |du |de |d['’]|de l['’])?{_CAP}(?: {_CAP})?, (?:\d{{5}} )?{_TOWN}"
    rf"|(?:Calle|C/|Avda\.|Av\.|Avenida|Plaza|Paseo|Camino|Ronda|Travesía) (?:de la |de los |de las |del |de )?{_CAP}(?: {_CAP})?,? \d{{1,4}}(?:, \d{{1,2}}\.?[ºª°] ?[A-Z]?)?(?:, (?:izq|dcha)\.)?, (?:\d{{5}} )?{_TOWN}"
    rf"|(?:ul\.|al\.|pl\.|os\.) {_CAP}(?: {_CAP})? \d+\w?(?:[/ ]m?\.? ?\d+)?, (?:\d\d-\d{{3}} )?{_TOWN}"
    r")"
)
#: What every address holds somewhere, a street word beside a number: what a text must hold, and the pattern.
_STREETS = (
    (
        ("Street", "St.", "St,", "St ", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Way", "Mews", "Crescent", "Close", "Court", "Ct", "Place", "Square", "Terrace", "Parkway", "Pkwy", "Row", "Gardens", "Hill", "Hollow"),
        r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Way|Mews|Crescent|Close|Court|Ct|Place|Square|Terrace|Parkway|Pkwy|Row|Gardens|Hill|Hollow)\b(?:[.,]| (?:Suite|Apt|Unit|Flat|Floor|#))",
    ),
    (("straße ", "strasse ", "weg ", "hof ", "platz ", "allee ", "gasse ", "ring ", "damm ", "ufer ", "Str. ", "Straße "), r"(?:straße|strasse|weg|hof|platz|allee|gasse|ring|damm|ufer| Str\.| Straße) \d"),
    (
        (" rue ", " avenue ", " boulevard ", " place ", " allée ", " chemin ", " impasse ", " quai ", " cours ", " route "),
        r"\d,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours|route) |(?:bis|ter),? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours|route) ",
    ),
    (("Calle ", "C/ ", "Avda. ", "Av. ", "Avenida ", "Plaza ", "Paseo ", "Camino ", "Ronda ", "Travesía "), r"\b(?:Calle|C/|Avda\.|Av\.|Avenida|Plaza|Paseo|Camino|Ronda|Travesía) "),
    (("ul. ", "al. ", "pl. ", "os. "), r"\b(?:ul|al|pl|os)\. [A-ZÀ-ÞŁŚŻŹ]"),
)
_STREET_ANCHOR = re.compile("|".join(pattern for _, pattern in _STREETS))


@lru_cache(maxsize=1 << len(_STREETS))
def _street_anchor(kinds: tuple[int, ...]) -> re.Pattern[str]:
    return re.compile("|".join(_STREETS[kind][1] for kind in kinds))


def addresses(text: str) -> list[Span]:
    found: list[Span] = []
    kinds = tuple(kind for kind, (hints, _) in enumerate(_STREETS) if any(w in text for w in hints))
    if not kinds:
        return found
    done = 0
    for anchor in _street_anchor(kinds).finditer(text):
        if anchor.start() < done:
            continue
        low = max(done, anchor.start() - 72)
        for m in _ADDRESS.finditer(text, low, min(len(text), anchor.end() + 96)):
            if m.start() > anchor.end():
                break
            if m.end() > anchor.start():
                found.append(Span("address", m.start(), m.end()))
                done = m.end()
                break
    return found


#: Documents in which an ordinary word stands ``LEAST_NAMES`` times; family names that must have an ending,
#: the share of them among all words with it, and the lengths of endings.
ORDINARY_ROWS, LEAST_NAMES, LEAST_SHARE, ENDING = 6_000, 4, 0.5, (3, 4, 5)
_STANDING = re.compile(r"(?<![\w@./-])[^\W\d_]{4,}(?:-[^\W\d_]{4,})?(?![\w@]|[-./]\w)")


@dataclass(frozen=True)
class FamilyNames:
    """Endings of the family names of a corpus, learned by ``learn_endings``."""

    endings: tuple[str, ...] = ()
    #: Ordinary words with such an ending.
    ordinary: frozenset[str] = frozenset()

    def pattern(self) -> re.Pattern[str] | None:
        return _family_pattern(self.endings)


@lru_cache(maxsize=8)
def _family_pattern(endings: tuple[str, ...]) -> re.Pattern[str] | None:
    if not endings:
        return None
    ends = "|".join(map(re.escape, endings))
    return re.compile(rf"[^\W\d_]{{2,12}}(?:{ends})(?:-[^\W\d_]{{2,12}}(?:{ends}))?(?![\w@]|-\w|\.[a-z])", re.I)


NO_ENDINGS = FamilyNames()


def _told(texts: list[str | None]) -> tuple[set[str], set[str], Counter]:
    """``(families, words, small)`` of some texts: family names told by their surroundings, all words, and
    how often a word stands in lower case."""
    families: set[str] = set()
    words: set[str] = set()
    standing: Counter = Counter()
    for text in texts:
        if not text:
            continue
        body = rewrite(text).text
        standing.update(_STANDING.findall(body))
        for s in _by_cue(body):
            told = _lower(body[s.start : s.end])
            last = told.split(",")[0] if "," in told else told
            families.update(w for w in re.findall(r"[^\W\d_]+", last.split(" ")[-1]) if len(w) >= 4)
    for word in standing:
        words.update(w for w in _lower(word).split("-") if len(w) >= 4)
    return families, words | families, Counter({w: n for w, n in standing.items() if w.islower()})


def _least_names(families: int) -> int:
    return max(LEAST_NAMES, families // 300)


def _shortest(endings: list[str]) -> tuple[str, ...]:
    """Endings that have no shorter one of the list."""
    chosen: list[str] = []
    for e in sorted(endings, key=lambda e: (len(e), e)):
        if not e.endswith(tuple(chosen)):
            chosen.append(e)
    return tuple(chosen)


def learn_endings(texts: list[str | None]) -> FamilyNames:
    """The endings that at least ``LEAST_NAMES`` different family names told by their surroundings have,
    and few other words; the shortest ones that do."""
    families, words, small = _told(texts)
    fine: list[str] = []
    for length in ENDING:
        held, among = Counter(w[-length:] for w in families), Counter(w[-length:] for w in words)
        fine += [e for e, n in held.items() if len(e) == length and n >= _least_names(len(families)) and n >= LEAST_SHARE * among[e]]
    chosen = _shortest(fine)
    ordinary = {w for w, n in small.items() if n >= LEAST_NAMES and w not in families and w.endswith(chosen)} if chosen else set()
    return FamilyNames(chosen, frozenset(ordinary))


_PARTICLES = re.compile(r"(?<![^\W\d_.'’-])(?:(?:van der|van den|van|von der|von|de la|de|du|af|della|di|da|dos|zu|ter|el|al|bin) )+$", re.I)
_INITIALS = re.compile(r"(?<![\w.])(?:[^\W\d_]\. )+$")
_GIVEN = re.compile(r"(?<![\w@.'’-])([^\W\d_]{2,12}(?:-[^\W\d_]{2,12})?) $")
_AFTER = re.compile(r", ([^\W\d_]{2,12}(?:-[^\W\d_]{2,12})?)((?: [^\W\d_]\.)*)(?![\w@]|[-.]\w)")
_TITLES = frozenset("frau herr herrn mr mrs ms miss dr prof sra sr srta señor señora mme mlle madame monsieur doctor docteur pan pani ingeniero ing sir lady".split())
_NOT_GIVEN = frozenset(
    "the a an to by and or of for from with via per ask user users team thanks contact please dear hello hi regards cc von und mit bei an für der die das ein eine ist sind war par pour avec "
    "et ou le la les un une est por para con y o el los las una es are is was be in on at als wie durch que qui owner approver name mail signed reviewed written reported ship text call see from "
    "freigegeben genehmigt geprüft bestätigt verfasst geschrieben gemeldet erstellt validé approuvé rédigé signalé écrit aprobado escrito revisado firmado informado approved "
    "gracias merci danke dziękuję kontakt przez od do dla i oraz não sobre como come it its we our your his her their this that".split()
)
_NO_NAMES = frozenset("benutzer nutzer besitzer jedermann kaufmann fachmann hauptmann lesson casanova supernova bossanova eisberg iceberg weinberg kodiak schützer unterstützer einzelmann mission ersatzspieler sitzer vorsitzer".split())
_STREETISH = re.compile(r"(?:straße|strasse|weg|hof|platz|allee|gasse|ring|damm|ufer)$|^(?:calle|plaza|avda|av|avenida|paseo|camino|ronda|am|an|im|zum|zur|flat|apt|unit|rue|avenue|suite|house)$", re.I)


def _case(word: str) -> str:
    letters = word.replace("-", "")
    if letters.isupper():
        return "upper"
    if letters.islower():
        return "lower"
    return "title" if word[0].isupper() else "mixed"


def _endings(text: str, endings: tuple[str, ...]) -> list[tuple[int, int]]:
    """Places of family-name endings at the end of a word, in order."""
    low = _lower(text)
    found = []
    for ending in endings:
        at = low.find(ending)
        while at >= 0:
            end = at + len(ending)
            if not low[end : end + 1].isalpha():
                found.append((at, end))
            at = low.find(ending, end)
    found.sort()
    return found


def _by_ending(text: str, family: FamilyNames) -> list[Span]:
    """Names around a family name: given names or initials and particles before it, or, of a family
    name alone, a given name after a comma. Letters of one name agree in case. A word that stands alone
    is no name here, whatever its ending."""
    found: list[Span] = []
    done = 0
    shape = family.pattern()
    for first, end in _endings(text, family.endings):
        if end <= done:
            continue
        while first > done and (text[first - 1].isalpha() or (text[first - 1] in "'’" and first - 1 > done and text[first - 2].isalpha())):
            first -= 1
        m = shape.match(text, first)
        if m is None or (first and (text[first - 1] in "-@._/`\\" or text[first - 1].isdigit())) or m[0].lower() in _NO_NAMES or m[0].lower() in family.ordinary:
            continue
        style = _case(m[0].split("-")[0])
        if style == "mixed":
            continue
        start, end = m.start(), m.end()
        low = max(done, start - 48)
        window = text[low:start]
        cut = max(window.rfind("\n"), window.rfind("\r"), window.rfind("\t"))
        if cut >= 0:
            window = window[cut + 1 :]
        particle = _PARTICLES.search(window)
        stem = window[: particle.start()] if particle else window
        had = len(window) - len(stem)
        initials = _INITIALS.search(stem)
        base = stem[: initials.start()] if initials else stem
        given = _GIVEN.search(base)
        ok = False
        if given:
            word = given[1]
            low_word = word.lower()
            agrees = _case(word.split("-")[0]) == style or (style == "title" and _case(word) == "title")
            ok = agrees and low_word not in _TITLES and low_word not in _NOT_GIVEN
            if ok and style == "lower" and not (had or initials) and len(word) < 3:
                ok = False
        after = _AFTER.match(text, end)
        if after and (
            _case(after[1].split("-")[0]) != style or _STREETISH.search(after[1]) or after[1].lower() in _NOT_GIVEN or re.match(r" \d", text[after.end() : after.end() + 2])
        ):
            after = None
        if ok and after and particle and not _sure(particle[0]) and not initials:
            ok = False  # "signed by Family, Given": the little word belongs to the sentence
        if ok:
            start -= had + (len(stem) - len(base)) + len(given[0])
        elif initials:
            start -= had + (len(stem) - len(base))
        else:
            if particle and not _sure(particle[0]) and stem.strip() and stem.rstrip()[-1] not in '"(|:;>,.':
                had = 0  # "von" and the like after other words
            start -= had
            if after:
                end = after.end()
            elif style == "lower" or not had:
                continue
        found.append(Span("name", start, end))
        done = end
    return found


#: Names told by what stands around them, whatever their ending: fixed values, by language.
_UPPER = "A-ZÀ-ÖØ-ÞĄĆČĎĐĘĚĞİŁŃŇŐŘŚŞŠŤŮŰŹŻŽ"
_WORD = rf"(?:[{_UPPER}]['’])?[{_UPPER}][^\W\d_]+(?:-[{_UPPER}][^\W\d_]+)*(?![\w@]|[-.]\w)"
_INITIAL = rf"[{_UPPER}]\. "
_PARTICLE = r"(?:van der|van den|van|von der|von|de la|de|du|af|della|di|da|dos|zu|ter|el|al|bin) "
_REST = rf"(?:{_PARTICLE})?{_WORD}"
_FORWARD = rf"(?:(?:{_WORD} ){{1,2}}(?:{_INITIAL})*|(?:{_INITIAL})+)(?:{_REST})"
_FULL = rf"{_FORWARD}|{_WORD}, {_WORD}(?: [{_UPPER}]\.)*"
_TITLED = re.compile(rf"(?<![\w.])(?:(?:Dr|Prof|Mr|Mrs|Ms|Sr|Sra|Srta|Ing)\.? |(?:Miss|Frau|Herrn?|Mme|Mlle|Madame|Monsieur|Señora?|Doña|Don|Pani?|Sir|Lady|Doctor|Docteur) )+(?P<name>{_FORWARD}|{_REST})")
#: What every title holds.
_TITLE_HINTS = ("Dr", "Prof", "Mr", "Ms", "Sr", "Ing", "Miss", "Frau", "Herr", "Mme", "Mlle", "Madame", "Monsieur", "Señor", "Doña", "Don", "Pan", "Sir", "Lady", "Doctor", "Docteur")
#: What stands before names (in lower case) and behind them.
_CUES = (
    "signed by", "signed off by", "written by", "reviewed by", "approved by", "reported by", "prepared by", "owned by", "authored by", "regards", "sincerely", "thanks to", "dear", "hello", "hi", "go to", "goes to", "escalate to", "ask", "email", "notify",
    "contact", "contact is", "contact person is", "contact person", "cc:", "from:", "to:", "geprüft von", "freigegeben von", "genehmigt von", "bestätigt von", "verfasst von", "geschrieben von", "gemeldet von", "erstellt von", "ansprechperson ist", "grüßen",
    "danke an", "validé par", "approuvé par", "rédigé par", "signalé par", "écrit par", "cordialement", "merci à", "aprobado por", "revisado por", "escrito por", "firmado por", "informado por", "contacto es", "saludos", "gracias a", "owner", "approver",
    "author", "reviewer", "user", "name",
)
_CUED = re.compile(rf"(?:,|:| ?\||\": ?\")?\s*(?P<name>{_FULL})")
_CUES_AFTER = re.compile(
    r" (?:signed off|chairs|reported|wrote|approved|reviewed|leitet|dirige|dirigió|hat (?:geprüft|freigegeben))\b| \((?:ID|SSN|DNI|NIE)\b|;[\w.+-]+@| <[\w.+-]+@"
    r"|, \d{1,5}[A-Za-z]?(?: bis| ter)?,? (?:[A-ZÀ-Þ]|rue |avenue |chemin |quai |allée )|, (?:Calle|C/|Avda\.|ul\.) "
)
_SIGNED = re.compile(rf"(?<![\w.@'’-])(?P<name>{_FULL})$")
_WITH_INITIALS = re.compile(rf"(?<![\w.@'’-])(?P<name>{_WORD} (?:{_INITIAL})+{_REST}|(?:{_INITIAL}){{2,}}{_REST})")
#: What the two patterns around them hold.
_INITIAL_AT, _PARTICLE_AT = re.compile(_INITIAL), re.compile(r" (?:van|della|af|ter|bin) ")
_WITH_PARTICLE = re.compile(rf"(?<![\w.@'’-])(?P<name>{_WORD} (?:van der|van den|van|della|af|ter|bin) {_WORD})")
_GIVEN_NAMES = (
    "Adam Agnieszka Alan Albert Alejandro Alexander Alice Ana Andrea Andreas Andrew Andrzej Angela Anna Anne Antoine Antonio Barbara Ben Benjamin Birgit Brian Camille Carlos Carmen Carol Caroline Catherine Charles "
    "Charlotte Chloé Christian Christine Christopher Claire Claudia Claus Daniel David Deborah Diego Dorothy Edward Elena Elizabeth Emily Emma Eric Erik Ewa Fatima Felix Fernando Florian Francisco François Françoise "
    "Frank George Georg Gerhard Grzegorz Hans Hannah Heather Heinrich Helen Henry Inge Ingrid Isabel Isabelle Jack Jacob Jacques James Jan Janet Javier Jean Jennifer Jens Jessica Jörg Joan Johann John Jonas Jorge José "
    "Joseph Juan Julia Julie Jürgen Karen Karin Karl Katarzyna Katharina Kevin Klaus Krzysztof Lars Laura Laurent Lena Linda Louis Louise Lucas Lucía Luis Lukas Magdalena Małgorzata Manuel Marcin Marek Margaret Maria "
    "María Marie Markus Marta Martin Mary Mateusz Matthew Michael Michał Michel Miguel Mohammed Monika Nancy Nathalie Nicolas Nina Olivia Pablo Pamela Patricia Patrick Paul Paula Paulo Pedro Peter Petra Philip Philippe "
    "Pierre Piotr Rachel Rafael Ralf Rebecca Richard Robert Roberto Ruth Samuel Sandra Sara Sarah Sébastien Sergio Simon Sofia Sophie Stefan Stephen Steven Susan Sven Teresa Thomas Timothy Tomasz Ursula Uwe Victoria "
    "William Wojciech Wolfgang Zofia"
)
_GIVEN_BY_LETTER = "|".join(f"{c}(?:{'|'.join(n[1:] for n in _GIVEN_NAMES.split() if n[0] == c)})" for c in sorted({n[0] for n in _GIVEN_NAMES.split()}))
_WITH_GIVEN = re.compile(rf"(?P<name>(?:{_GIVEN_BY_LETTER})(?:-{_WORD})? (?:{_WORD} |{_INITIAL})?{_REST})")
#: Words that open the next sentence where none ends before it.
_OPENERS = frozenset("until while when where every each any all once after before if then there these those some many most no not only since so during employees for until unless because although both but".split())
#: Words that end no name: bodies, documents and what is numbered by letters.
_NO_FAMILY = frozenset(
    "team teams board group department committee office service services support operations engineering security council desk staff crew platform product legal finance people human resources customer customers all "
    "everyone colleague colleagues abteilung gruppe équipe comité equipo grupo dział street road lane avenue drive".split()
)
_LETTERED = frozenset("plan appendix annex section part phase step option class group table figure version zone type tier level anhang teil abschnitt annexe partie anexo parte schedule exhibit item rule case".split())


def _lower(text: str) -> str:
    low = text.lower()
    # a few capital letters become two characters
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _cued(text: str):
    """Matches of names that are told by what stands around them, the surest first."""
    if any(title in text for title in _TITLE_HINTS):
        yield from _TITLED.finditer(text)
    low = _lower(text)
    for cue in _CUES:
        at = low.find(cue)
        while at >= 0:
            end = at + len(cue)
            if not (at and low[at - 1].isalnum()) and not low[end : end + 1].isalnum() and (m := _CUED.match(text, end)):
                yield m
            at = low.find(cue, end)
    for cue in _CUES_AFTER.finditer(text):
        if m := _SIGNED.search(text, max(0, cue.start() - 160), cue.start()):
            yield m
    for m in _WITH_GIVEN.finditer(text):
        if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_.@'’-")):
            yield m
    if _INITIAL_AT.search(text):
        yield from _WITH_INITIALS.finditer(text)
    if _PARTICLE_AT.search(text):
        yield from _WITH_PARTICLE.finditer(text)


def _by_cue(text: str) -> list[Span]:
    """Names behind titles, in signatures and salutations, with initials, particles or common given
    names, whatever their ending."""
    found: list[Span] = []
    for m in _cued(text):
        start, end = m.span("name")
        while (first := re.match(r"([^\W\d_]+)\.? ", text[start:end])) and first[1].lower() in _TITLES:  # titles stay outside
            start += first.end()
        words = [w.lower() for w in re.findall(r"[^\W\d_]+", text[start:end])]
        while len(words) > 2 and (words[-1] in _NOT_GIVEN or words[-1] in _OPENERS):  # the next sentence
            end = start + re.search(r"[^\w]+[^\W\d_]+$", text[start:end]).start()
            words.pop()
        if not words or words[-1] in _OPENERS or words[0] in _LETTERED or words[0] in _NOT_GIVEN or words[-1] in _NOT_GIVEN or any(w in _NO_FAMILY for w in words) or _STREETISH.search(words[0]):
            continue
        if not any(s.start < end and start < s.end for s in found):
            found.append(Span("name", start, end))
    return found


def names(text: str, family: FamilyNames = NO_ENDINGS) -> list[Span]:
    """Names by the endings of family names, and by what stands around them."""
    return disjoint([_by_ending(text, family), _by_cue(text)])


def disjoint(groups: list[list[Span]]) -> list[Span]:
    """All spans of the first group, and those of each later one that no span before overlaps, in order.
    Kept spans stay sorted, so each span meets its neighbours only."""
    kept: list[Span] = []
    starts: list[int] = []
    for group in groups:
        for s in group:
            at = bisect_left(starts, s.start)
            if (at < len(kept) and kept[at].start < s.end) or (at and kept[at - 1].end > s.start):
                continue
            starts.insert(at, s.start)
            kept.insert(at, s)
    return kept


def _sure(particle: str) -> bool:
    """Whether particles occur in names only; ``von``, ``de`` and the like are words as well."""
    return bool(re.match(r"(?:van|af|de la|von der|della|ter|bin) ", particle, re.I))


def spans(text: str | None, family: FamilyNames = NO_ENDINGS) -> list[Span]:
    """Disjoint spans of the text as written, in order. On overlaps the kind first in ``KINDS`` wins."""
    if not text:
        return []
    plain = rewrite(text)
    body = plain.text
    numbered = sorted(numbers(body), key=lambda s: (KINDS.index(s.kind), s.start))
    kept = disjoint([emails(body), numbered, addresses(body), names(body, family)])
    return [Span(s.kind, *plain.span(s.start, s.end)) for s in kept]


def redact(text: str | None, found: list[Span] | None = None) -> str | None:
    """The text with each span replaced by the placeholder of its kind, all else unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans(text) if found is None else found:
        out += [text[at : s.start], PLACEHOLDER[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


def learn(documents: DataFrame, text: str = "text") -> FamilyNames:
    """Endings learned from all documents, as ``learn_endings`` does for a few.

    The words are counted by Spark; the driver gets the endings that are chosen and the ordinary words
    that have one. A word is ordinary at ``LEAST_NAMES`` times in ``ORDINARY_ROWS`` documents.
    """

    def run(batches):
        for batch in batches:
            families, words, small = _told(batch.column(0).to_pylist())
            every = sorted(words | set(small))
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), pa.array([w in families for w in every], pa.bool_()), pa.array([w in words for w in every], pa.bool_()), pa.array([small[w] for w in every], pa.int64())],
                names=["word", "family", "known", "small"],
            )

    rows = spread(documents.select(F.col(text).alias("t")).where("t is not null"))
    words = rows.mapInArrow(run, "word string, family boolean, known boolean, small bigint").groupBy("word").agg(F.bool_or("family").alias("family"), F.bool_or("known").alias("known"), F.sum("small").alias("small"))
    words = materialize(words, "words")
    least = _least_names(words.where("family").count())
    ends = F.explode(F.array(*(F.when(F.length("word") >= n, F.right("word", F.lit(n))) for n in ENDING)))
    held = words.where("known").select(ends.alias("e"), "family").where("e is not null").groupBy("e").agg(F.count_if("family").alias("held"), F.count("*").alias("among"))
    # each has at least a 300th of the families: few
    chosen = _shortest([r.e for r in held.where((F.col("held") >= least) & (F.col("held") >= LEAST_SHARE * F.col("among"))).select("e").collect()])
    ordinary: list[str] = []
    if chosen:
        often = LEAST_NAMES * max(1.0, documents.where(F.col(text).isNotNull()).count() / ORDINARY_ROWS)
        has = F.lit(False)
        for n in ENDING:
            has = has | F.right("word", F.lit(n)).isin([e for e in chosen if len(e) == n])
        ordinary = [r.word for r in words.where(~F.col("family") & (F.col("small") >= often) & has).select("word").collect()]
    discard(words)
    return FamilyNames(chosen, frozenset(ordinary))


def found(documents: DataFrame, key: str = "doc_id", text: str = "text", family: FamilyNames | None = None) -> DataFrame:
    """``(doc_id, kind, value)``: one row for each different value of a document.

    A narrow map; values are told apart inside their document, so nothing is shuffled. NULL, empty
    and blank texts have no rows; rows of a repeated key give their rows each; texts are read whole;
    an empty table gives an empty one; other columns are ignored. ``family`` is learned from the
    documents where it isn't given.
    """
    family = family or learn(documents, text)

    def run(batches):
        for batch in batches:
            ids, kinds, values = [], [], []
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body:
                    for kind, value in dict.fromkeys((s.kind, body[s.start : s.end]) for s in spans(body, family)):
                        ids.append(row), kinds.append(kind), values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["k", "kind", "value"])

    rows = spread(documents.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("t is not null"))
    return rows.mapInArrow(run, "k bigint, kind string, value string").withColumnRenamed("k", key)


def redacted(documents: DataFrame, key: str = "doc_id", text: str = "text", family: FamilyNames | None = None) -> DataFrame:
    """``(doc_id, text)`` with placeholders; NULL texts stay NULL."""
    family = family or learn(documents, text)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact(t, spans(t, family)) for t in batch.column(1).to_pylist()], pa.string())], names=["k", "text"])

    rows = spread(documents.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")))
    return rows.mapInArrow(run, "k bigint, text string").withColumnRenamed("k", key)
