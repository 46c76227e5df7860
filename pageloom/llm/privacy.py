"""Problem 4: personal information inside free text.

Persons' names are found by a trained recogniser (``names``). Cues of other kinds
(labels, street words) are found by one Aho-Corasick automaton; an exact shape
is then read at each cue. Phones are read by the public numbering formats,
e-mails at their sign.

Method: surrogate generation. Every entity gets a keyed replacement of the same
type, script, letter case and format. Digits and letters go through a keyed
cipher that is a bijection of strings of one shape, and given names through a
keyed permutation of a pool of one script and gender, so distinct entities keep distinct
surrogates, and a name gets the same one in every spelling, also within an
e-mail address. ``collisions`` checks that over a whole corpus. Texts with plain
typed placeholders come out beside.

Defined results: null stays null; an empty text has no entities; of two entities
that overlap the longer stays; repeated pages count once; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import names
from pageloom.llm.common import page_and_web_texts, per_batch
from pageloom.llm.folding import plain_view

KINDS = ("email", "phone", "id", "address", "name")
_UP, _W, _CYR, _ARA = names.UP, names.WORD, names.CYR, names.ARA

#: Labels of identity numbers and the shapes of the numbers.
ID_LABELS = {
    "ID no.": r"\d{3}-\d\d-\d{4}", "ID number": r"\d{3}-\d\d-\d{4}", "SSN": r"\d{3}-\d\d-\d{4}", "social security number": r"\d{3}-\d\d-\d{4}",
    "identity card": r"\d{3}\s\d\d\s\d{4}|[A-Z0-9]{8,10}", "passport": r"[A-Z]\d{7,8}|[A-Z]{2}\d{6,7}", "passport no.": r"[A-Z]\d{7,8}|[A-Z]{2}\d{6,7}",
    "national insurance number": r"[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D]",
    "NIR": r"[12]\s?\d\d\s?\d\d\s?\d\d\s?\d{3}\s?\d{3}\s?\d\d", "sécurité sociale": r"[12]\s?\d\d\s?\d\d\s?\d\d\s?\d{3}\s?\d{3}\s?\d\d", "CNI": r"[A-Z]{2}\d{6}|\d{12}", "passeport": r"\d\d[A-Z]{2}\d{5}",
    "Ausweisnummer": r"[A-Z0-9]{9,10}", "Reisepass Nr.": r"[A-Z0-9]{9}", "Reisepass": r"[A-Z0-9]{9}", "Steuer-ID": r"\d\d\s?\d{3}\s?\d{3}\s?\d{3}", "Personalausweis": r"[A-Z0-9]{9,10}",
    "DNI": r"\d\d?\.?\d{3}\.?\d{3}-?[A-Z]", "NIE": r"[XYZ]-?\d{7}-?[A-Z]", "NIF": r"\d{3}\s?\d{3}\s?\d{3}|\d{8}-?[A-Z]", "pasaporte": r"[A-Z]{3}\d{6}",
    "cartão de cidadão": r"\d{8}\s?\d\s?[A-Z]{2}\d", "passaporte": r"[A-Z]{1,2}\d{6}",
    "СНИЛС": r"\d{3}-\d{3}-\d{3}[\s-]\d\d", "паспорт": r"\d\d\s?\d\d\s?(?:№\s?)?\d{6}", "ИНН": r"\d{12}|\d{10}",
    "رقم البطاقة الوطنية": r"[A-Z]{1,2}\d{5,6}", "البطاقة الوطنية": r"[A-Z]{1,2}\d{5,6}", "رقم الجواز": r"[A-Z]{2}\d{7}", "جواز السفر": r"[A-Z]{2}\d{7}",
}

_N = r"\d{1,4}"
_ADJ = r"(?:(?:Old|New|Upper|Lower|Great|Little|North|South|East|West|Saint|St\.)\s)?"
_FLAT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Room)\s\w{1,4},\s)?"
_AFTER_FLAT = r"(?:,\s(?:Flat|Apt\.?|Apartment|Unit|apt\.?|appt\.?|appartement|bât\.|étage|Wohnung|Whg\.|piso|puerta|kv\.)\s?\w{1,4})?"
#: Street words by the side on which name and number stand.
STREET_ENDS = "Street|St.|Lane|Avenue|Ave.|Ave|Road|Rd.|Rd|Square|Terrace|Close|Drive|Way|Court|Row|Hill|Gardens|Crescent".split("|")
STREETS_FR = "rue|avenue|av.|impasse|boulevard|bd|quai|place|chemin|allée|cours|passage|ruelle|route".split("|")
STREETS_ES = "calle|C/|avenida|avda.|Avda.|plaza|pza.|paseo|camino|travesía|callejón|ronda|Calle|Plaza".split("|")
STREETS_PT = "rua|R.|travessa|avenida|Av.|av.|largo|praça|alameda|beco|Rua|Travessa".split("|")
STREETS_RU = "ул.|улица|пер.|переулок|пр-т|проспект|пр.|пл.|площадь|наб.|набережная|шоссе|бульвар|проезд".split("|")
STREET_ENDS_DE = "straße|strasse|str.|weg|gasse|allee|platz|ufer|damm|ring|steig| Allee| Straße| Weg| Platz| Ring| Ufer".split("|")
STREETS_AR = "شارع|زنقة|نهج|درب|حي".split("|")
_OF = r"(?:(?:de\sla|de\slos|de\slas|des|du|de|da|do|dos|das|del|d['’]|la|le|les)\s?)?"
_TAIL = r"(?:,\s(?:\d{1,2}[.º°ª]*\s?(?:[A-Z]|izq\.?|dcha\.?|esq\.?|dto\.?|dta\.?)|piso\s\d+|puerta\s\w+|apt\.?\s\w+|appt\.?\s\w+|кв\.\s?\d+))?"

_MAIL = re.compile(r"([A-Za-z0-9][A-Za-z0-9._%+'-]*)\s?(?:@|\[at\]|\(at\)|\{at\}|\[@\]|\(a\)|\[arroba\]|\(arroba\))\s?((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?))+[A-Za-z]{2,})")
_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+'-]*\s?\Z")
_AT = re.compile(r"@|\[at\]|\(at\)|\{at\}|\(a\)|\[arroba\]|\(arroba\)")

#: Formats of phone numbers by country.
_PHONE = re.compile(
    r"(?<![\w.,/@#:;=-])(?:"
    r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)\s?|\d{3}[-.\s])\d{3}[-.\s]\d{4}"
    r"|\+1\d{10}"
    r"|(?:(?:\+44|0044)\s?(?:\(0\)\s?)?|\(?0)(?:20\)?[-\s]?\d{4}[-\s]?\d{4}|1\d{3}\)?[-\s]?\d{6}|7\d{3}[-\s]?\d{6}|1\d\d\)?[-\s]?\d{3}[-\s]?\d{4})"
    r"|(?:(?:\+33|0033)\s?(?:\(0\)\s?)?|0)[1-9](?:[\s.-]?\d\d){4}"
    r"|(?:(?:\+49|0049)\s?(?:\(0\)\s?)?|\(?0)[1-9]\d{1,4}(?:\)\s?|[\s/-]\s?)\d{3,6}(?:[\s-]\d{2,4})?"
    r"|(?:\+49|0049)\d{9,12}|01[5-7]\d{8,9}|0[1-9]\d{9,10}"
    r"|(?:(?:\+34|0034)\s?)?[6-9]\d\d(?:[\s.-]\d\d){4}|(?:(?:\+34|0034)\s?)?[6-9]\d{10}|(?:\+34|0034)\s?[6-9]\d\d(?:[\s.-]?\d){6}|[6-9]\d\d[\s.-]\d{3}[\s.-]\d{3}|[6-9]\d\d(?:[\s.-]\d\d){3}"
    r"|(?:(?:\+351|00351)\s?)?[29]\d\d(?:[\s.-]\d\d){4}|(?:(?:\+351|00351)\s?)?[29]\d{10}|(?:\+351|00351)\s?[29]\d\d(?:[\s.-]?\d){6}"
    r"|(?:\+7|8)[\s-]?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d\d[\s-]?\d\d"
    r"|(?:\+212|00212)[\s-]?\(?0?\)?\s?[5-7](?:[\s.-]?\d\d){4}"
    r"|[٠0][٥-٧5-7](?:[\s.-]?[٠-٩]{2}){4}|\+?٢١٢\s?[٥-٧](?:[\s.-]?[٠-٩]{2}){4}"
    r")(?![\w/@]|[.,:-]\d|-[A-Za-z])"
)


#: An identity number whose shape tells it also without a label; not behind words for other numbers.
_SSN = re.compile(r"(?<![\w.,/#:-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w/-]|\.\d)")
_REFERENCE = re.compile(r"(?:order|ref(?:erence)?|file|part|lot|item|invoice|model|serial|ticket|case|code|version|room|call|phone|tel|fax)\W{0,3}(?:(?:no|nr|number|#)\W{0,3})?\Z", re.IGNORECASE)


class _Scanner:
    """The compiled cues and shapes of one Python worker."""

    def __init__(self) -> None:
        import ahocorasick

        c = re.compile
        self.cues = ahocorasick.Automaton()
        every: dict[str, list[tuple[str, object]]] = {}

        def add(cue: str, kind: str, shape: object) -> None:
            every.setdefault(cue, []).append((kind, shape))

        for label, shape in ID_LABELS.items():
            add(label, "id", c(rf"(?:\s?(?:no\.?|Nr\.?|n\.?º|number|№))?\s?[:#]?\s?({shape})(?!\w)"))
        end = "|".join(map(re.escape, STREET_ENDS))
        self.back = {
            "en": c(rf"(?<![\w.,-])({_FLAT}{_N}[A-Za-z]?,?\s{_ADJ}{_W}(?:\s{_W})?\s(?:{end}))\Z"),
            "de": c(rf"(?<!\w)([{_UP}][\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig|\s(?:Allee|Straße|Weg|Platz|Ring|Ufer)))\Z"),
        }
        for cue in STREET_ENDS:
            add(" " + cue, "street_en", None)
        for cue in ("Am ", "An der ", "Im "):
            for word in ("an ", "wohnt ", "unter "):
                add(word + cue, "street_am", c(rf"{_W}\s\d{{1,4}}(?:\s?[a-h](?!\w))?" + _AFTER_FLAT + r"(?![\w.])"))
        for cue in STREET_ENDS_DE:
            add(cue, "street_de", c(r"\s\d{1,4}(?:\s?[a-h](?!\w))?" + _AFTER_FLAT + r"(?!\w)"))
        number = c(rf"(?<![\w.,-])({_N}(?:\s?[A-Da-d](?!\w))?(?:\s(?:bis|ter|quater))?,?\s)\Z")
        for cue in STREETS_FR:
            add(f" {cue} ", "street_fr", (number, c(rf"{_OF}{_W}(?:\s{_W})?" + _AFTER_FLAT)))
        for cue in (*STREETS_ES, *STREETS_PT):
            add(f" {cue} ", "street_es", c(rf"{_OF}{_W}(?:\s{_W})?,?\s(?:n\.?\s?[º°o]\.?\s?|núm\.\s|nº\s)?{_N}(?:\s?[A-Za-z](?!\w))?{_TAIL}(?![\w])"))
        for cue in STREETS_RU:
            add(f" {cue} ", "street_es", c(rf"{_CYR}(?:\s{_CYR})?,\s(?:д\.\s?|дом\s)?{_N}(?:\s?[а-гА-Г](?!\w))?(?:,\s?(?:корп\.|стр\.)\s?\d+)?(?:,\s?кв\.\s?\d+)?(?!\w)"))
        for cue in STREETS_AR:
            add(f" {cue} ", "street_ar", (c(r"(?<!\w)([\d٠-٩]{1,4}،?\s)\Z"), c(rf"({_ARA}(?:\s(?!رقم){_ARA})?)\sرقم\s[\d٠-٩]{{1,4}}(?!\w)"), c(rf"{_ARA}(?!\w)")))
        for cue, what in every.items():
            self.cues.add_word(cue, (len(cue), what))
        self.cues.make_automaton()

    def spans(self, s: str) -> list[tuple[int, int, str]]:
        """Entities of a text whose white space is plain."""
        out: list[tuple[int, int, str]] = []
        for x in _AT.finditer(s):
            a = _LOCAL.search(s, max(0, x.start() - 70), x.start())
            m = a and _MAIL.match(s, a.start())
            if m and m.end() > x.end():
                out.append((m.start(), m.end(), "email"))
        for x in _PHONE.finditer(s):
            out.append((x.start(), x.end(), "phone"))
        out += [(a, b, "name") for a, b, _ in names.find(s)]
        for x in _SSN.finditer(s):
            if not _REFERENCE.search(s[max(0, x.start() - 24) : x.start()]):
                out.append((x.start(), x.end(), "id"))
        for last, (size, what) in self.cues.iter(s):
            end, start = last + 1, last + 1 - size
            for kind, shape in what:
                if kind == "id":
                    if start and s[start - 1].isalnum():
                        continue
                    m = shape.match(s, end)
                    if m:
                        out.append((*m.span(1), "id"))
                elif kind == "street_en":
                    if s[end : end + 1].isalpha():
                        continue
                    low = max(0, start - 60)
                    m = self.back["en"].search(s[low:end])
                    if m:
                        tail = re.compile(_AFTER_FLAT).match(s, end)
                        out.append((low + m.start(1), tail.end() if tail else end, "address"))
                elif kind == "street_am":
                    m = shape.match(s, end)
                    if m:
                        out.append((s.index(" ", start) + 1, m.end(), "address"))
                elif kind == "street_de":
                    m = shape.match(s, end)
                    if m:
                        low = max(0, start - 40)
                        b = self.back["de"].search(s[low:end])
                        if b:
                            out.append((low + b.start(1), m.end(), "address"))
                elif kind == "street_fr":
                    m = shape[1].match(s, end)
                    if m:
                        low = max(0, start - 14)
                        b = shape[0].search(s[low : start + 1])
                        if b:
                            out.append((low + b.start(1), m.end(), "address"))
                elif kind == "street_es":
                    m = shape.match(s, end)
                    if m:
                        out.append((start + 1, m.end(), "address"))
                else:
                    m = shape[1].match(s, end)
                    if m:
                        out.append((start + 1, m.end(), "address"))
                        continue
                    low = max(0, start - 8)
                    b = shape[0].search(s[low : start + 1])
                    m = b and shape[2].match(s, end)
                    if m:
                        out.append((low + b.start(1), m.end(), "address"))
        return _apart(out)


def _apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans the longest, of equal ones the kind that comes first."""
    kept: list[tuple[int, int, str]] = []
    rank = {"id": 0, "email": 1, "address": 2, "phone": 3, "name": 4}
    for x in sorted(spans, key=lambda x: (x[0] - x[1], rank[x[2]], x[0])):
        if all(x[1] <= y[0] or x[0] >= y[1] for y in kept):
            kept.append(x)
    return sorted(kept)


@lru_cache(maxsize=1)
def scanner() -> _Scanner:
    return _Scanner()


def _plain(text: str) -> tuple[str, list[int] | None]:
    """The text as the scanner reads it, and the places of its characters if any were left out."""
    s = text.replace("\n", " ")
    if s.isascii():
        return s.replace("\t", " ").replace("\r", " "), None
    if _FULL.search(s):
        s = _FULL.sub(lambda x: chr(ord(x.group()) - 0xFEE0), s)
    return plain_view(s)


_FULL = re.compile("[！-～]")


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """Start, end and kind of each entity, in order."""
    if not text:
        return []
    s, places = _plain(text)
    found = scanner().spans(s)
    return found if places is None else [(places[a], places[b - 1] + 1, k) for a, b, k in found]


# --- surrogates -------------------------------------------------------------

@lru_cache(maxsize=8)
def _next_given(key: bytes) -> dict[str, str]:
    """The name that follows each given name in its pool's keyed order."""
    orders = [sorted(pool, key=lambda x: hmac.new(key, x.encode(), hashlib.sha256).digest()) for pool in names.GIVEN]
    return {a: b for order in orders for a, b in zip(order, [*order[1:], order[0]])}


#: Letters and digits that may take each other's place, each kind by itself.
_ALPHABETS = (
    "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿāăąēėęěīįōőœūůűų", "çćčďđģğķļľłńņňñŕřśşšţťŵźżž", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "ґєіїјљњћќўџђѓѕ",
    "0123456789", "٠١٢٣٤٥٦٧٨٩", "०१२३४५६७८९", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "أإآةىئءؤ", "پچژگکی", "αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώ",
)
#: Ranges of letters, and of vowel signs, of further scripts.
_RANGES = ((0x0905, 0x0914), (0x0915, 0x0939), (0x093E, 0x094C), (0x0E01, 0x0E2E), (0x05D0, 0x05EA), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_PLACE = {ch: (a, i) for a in _ALPHABETS for i, ch in enumerate(a)}


def _place(ch: str) -> tuple[str | range, int] | None:
    """The signs that can take a character's place, and its place among them; None for what isn't a letter or digit."""
    own = _PLACE.get(ch)
    if own or not (ch.isalnum() or 0x093E <= ord(ch) <= 0x094C):
        return own
    low, high = next((r for r in _RANGES if r[0] <= ord(ch) <= r[1]), (ord(ch) & ~15, ord(ch) | 15))
    signs = [c for c in range(low, high + 1) if chr(c) == ch or chr(c).isalnum() and not chr(c).isupper() or 0x093E <= c <= 0x094C] if high - low < 100 else range(low, high + 1)
    return ("".join(map(chr, signs)), signs.index(ord(ch))) if isinstance(signs, list) else (signs, ord(ch) - low)


@lru_cache(maxsize=1)
def own_key() -> bytes:
    """The key in ``PAGELOOM_SURROGATE_KEY``; without one a random key of this driver, known to nobody, so that surrogates agree within a run only."""
    given = os.environ.get("PAGELOOM_SURROGATE_KEY")
    return given.encode() if given else secrets.token_bytes(32)


def _stream(key: bytes, label: str, n: int) -> bytes:
    out, block = b"", 0
    while len(out) < n:
        out += hmac.new(key, f"{block}:{label}".encode(), hashlib.sha256).digest()
        block += 1
    return out[:n]


def _feistel(values: list[int], sizes: list[int], key: bytes, mask: str, rounds: int, back: bool) -> None:
    """Rounds of a network over the two halves of the values, or the same backwards."""
    half = max(1, len(values) // 2)
    for r in reversed(range(rounds)) if back else range(rounds):
        left, right = range(half), range(half, len(values))
        target, source = (left, right) if r % 2 else (right, left)
        noise = _stream(key, f"{r}|{mask}|{[values[i] for i in source]}", 2 * len(target) or 1)
        for k, i in enumerate(target):
            step = noise[2 * k] * 256 + noise[2 * k + 1]
            values[i] = (values[i] + (-step if back else step)) % sizes[i]


def cipher(word: str, key: bytes, rounds: int = 4) -> str:
    """A string of the same shape: each letter and digit becomes another of its kind, the rest stays as it is.

    The string's signs go through a keyed Feistel network, one is added to the
    number they then are, and the network is undone: a bijection of the strings
    of one shape that leaves none as it was.
    """
    base = unicodedata.normalize("NFC", word)
    shape = [_place(ch.lower() if len(ch.lower()) == 1 else ch) for ch in base]
    slots = [i for i, p in enumerate(shape) if p and len(p[0]) > 1]
    if not slots:
        return word
    values, sizes = [shape[i][1] for i in slots], [len(shape[i][0]) for i in slots]
    mask = "".join("." if p else ch for ch, p in zip(base, shape)) + repr(sizes)
    _feistel(values, sizes, key, mask, rounds, False)
    for i, size in enumerate(sizes):
        values[i] = (values[i] + 1) % size
        if values[i]:
            break
    _feistel(values, sizes, key, mask, rounds, True)
    out = list(base)
    for i, v in zip(slots, values):
        ch = shape[i][0][v]
        ch = chr(ch) if isinstance(ch, int) else ch
        out[i] = ch.upper() if base[i].isupper() and len(ch.upper()) == 1 else ch
    return "".join(out)


#: Endings of Russian family names and patronymics, which differ by gender.
_ENDINGS = ("овична", "евична", "ович", "евич", "ская", "ский", "цкая", "цкий", "ова", "ева", "ёва", "ина", "ына", "ов", "ев", "ёв", "ин", "ын")


def _gender_ending(word: str) -> str:
    return next((e for e in _ENDINGS if word.endswith(e) and len(word) > len(e) + 1), "")


@lru_cache(maxsize=100_000)
def _word_surrogate(word: str, key: bytes) -> str:
    """Surrogate of one part of a name: pool names permute among their gender, others are ciphered out of the pool."""
    low = word.lower()
    if low.capitalize() in names.GENDER:
        new = _next_given(key)[low.capitalize()]
        return new.upper() if word.isupper() else new.lower() if word.islower() and low != low.capitalize() else new
    end = _gender_ending(low)
    new = cipher(low.removesuffix(end), key) + end
    while new.capitalize() in names.GENDER or _gender_ending(new) != end:
        new = cipher(new.removesuffix(end), key) + end
    return new.upper() if word.isupper() and len(word) > 1 else new.capitalize() if word[:1].isupper() else new


def surrogate(value: str, kind: str, key: bytes) -> str:
    """A keyed replacement of the same type and format; the same entity always gets the same one."""
    if kind in ("name", "email"):
        local, at, domain = re.match(r"(.*?)(\s?(?:@|＠|\[at\]|\(at\)|\{at\}|\(a\)|\[arroba\]|\(arroba\))\s?)?([^@＠]*)\Z" if kind == "email" else r"(.*)()()\Z", value, re.DOTALL).groups()
        words = re.sub(r"[^\W\d_]+", lambda x: _word_surrogate(x.group(), key), local or domain)
        words = re.sub(r"\d+", lambda x: cipher(x.group(), key), words)
        return words if not at else words + at + (cipher(domain.rpartition(".")[0], key) + "." + domain.rpartition(".")[2])
    if kind == "address":  # the street's kind and the order of its parts stay
        known = {w.strip().lower() for w in (*STREET_ENDS, *STREETS_FR, *STREETS_ES, *STREETS_PT, *STREETS_RU, *STREETS_AR)}
        keep = known | {"bis", "ter", "de", "des", "du", "da", "do", "la", "n", "д", "кв", "رقم", "old", "new", "allee", "ул", "пер", "пр", "c", "av", "r"}

        def one(x: re.Match) -> str:
            word = x.group()
            if word.lower() in keep:
                return word
            for end in STREET_ENDS_DE:
                stem = end.strip().rstrip(".")
                if word.endswith(stem) and len(word) > len(stem):
                    return _word_surrogate(word[: -len(stem)], key) + stem
            return cipher(word, key) if word[0].isdigit() else _word_surrogate(word, key)

        return re.sub(r"\w+", one, value)
    if kind == "phone":  # a country code stays
        m = re.match(r"((?:\+|00)(?:1|7|33|34|44|49|351|212)(?!\d{2}\s\d)|8(?=\s?\())?(.*)\Z", value, re.DOTALL)
        return (m.group(1) or "") + cipher(m.group(2), key)
    return cipher(value, key)


def rewrite(text: str | None, key: bytes) -> tuple[str | None, str | None]:
    """The text with placeholders, and with surrogates, in place of its entities."""
    if not text:
        return text, text
    tagged, replaced, at = [], [], 0
    for a, b, kind in entities(text):
        tagged += [text[at:a], f"[{kind.upper()}]"]
        replaced += [text[at:a], surrogate(text[a:b], kind, key)]
        at = b
    return "".join(tagged) + text[at:], "".join(replaced) + text[at:]


def redact(texts: DataFrame, key: bytes | None = None) -> DataFrame:
    """``doc_id, page, redacted, surrogate``: texts with typed placeholders, and with surrogates under ``key`` (``own_key()`` if none is given)."""
    key = key or own_key()

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [rewrite(t, key) for t in batch["text"]]
        return batch[["doc_id", "page"]].assign(redacted=[r[0] for r in rows], surrogate=[r[1] for r in rows])

    return per_batch(texts.select("doc_id", "page", "text"), step, "doc_id long, page int, redacted string, surrogate string")


def _values(texts: DataFrame) -> DataFrame:
    def step(batch: pd.DataFrame) -> pd.DataFrame:
        out = [
            (doc, page, kind, re.sub(r"\s+", " ", text[a:b]))
            for doc, page, text in zip(batch["doc_id"], batch["page"], batch["text"])
            for a, b, kind in entities(text)
        ]
        return pd.DataFrame(out, columns=["doc_id", "page", "kind", "value"])

    return per_batch(texts.select("doc_id", "page", "text"), step, "doc_id long, page int, kind string, value string")


def found(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page, kind, value`` of every entity in web texts (page 0) and page texts."""
    return _values(page_and_web_texts(documents, pages).where("text is not null")).distinct()


def collisions(found_values: DataFrame, key: bytes | None = None) -> DataFrame:
    """``kind, surrogate, n``: surrogates that stand for more than one value; empty if distinctness holds."""
    key = key or own_key()

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(surrogate=[surrogate(v, k, key) for k, v in zip(batch["kind"], batch["value"])])

    values = found_values.select("kind", "value").distinct()
    return per_batch(values, step, "kind string, value string, surrogate string").groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
