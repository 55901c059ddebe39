"""Problem 5: personal information inside free text.

Validated patterns find emails (written-out forms included), phone numbers, identity numbers,
addresses and names; each item is replaced by a typed placeholder.  Digits and letters of validated
numbers and of dates are permuted by a keyed Feistel network within their format, so equal values
stay linked across documents and the number still looks like one; other items carry a keyed tag.

Positions are code points of the text as given, even where its encoding is garbled.

Defined results: null text stays null with no items; a text without items is returned unchanged;
overlapping finds keep the earlier kind in the order email, id_number, address, phone, name.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.llm import encoding as E, prose as P
from siltworks.llm.batches import map_columns

S = r"[  ]|\r?\n"
_S = rf"(?:{S})"

_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-])")
_AT = rf"(?:{_S}?[\[({{]{_S}?at{_S}?[\])}}]{_S}?|{_S}AT{_S})"
_DOT = rf"(?:{_S}?[\[({{]{_S}?dot{_S}?[\])}}]{_S}?|{_S}DOT{_S}|\.)"
_SPELT = re.compile(rf"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*(?:{_AT})[\w-]+(?:(?:{_DOT})[\w-]+)*?(?:{_DOT})[a-zA-Z]{{2,}}(?![\w-])")
_SPELT_LOW = re.compile(rf"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*{_S}at{_S}[\w-]+(?:{_S}dot{_S}[\w-]+)+(?![\w-])")

_ID = [
    ("ssn", re.compile(rf"(?<![\w-])\d{{3}}(-|{S})\d{{2}}(?:-|{S})\d{{4}}(?![\w-]|\.\d)")),
    ("nino", re.compile(rf"(?<!\w)[A-CEGHJ-PQR-TW-Z][A-Z]{_S}?\d{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?[A-D](?!\w)")),
    ("insee", re.compile(rf"(?<![\w.])[12]{_S}?\d{{2}}{_S}?(?:0[1-9]|1[0-2]|[2-9]\d){_S}?\d[\dAB]{_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d{{2}}(?!\w)")),
    ("tin", re.compile(rf"(?<![\w.,+])\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}(?![\w]|[.,]\d)")),
    ("dni", re.compile(r"(?<!\w)(?:\d{8}[- ]?|[XYZ]-?\d{7}-?)[A-HJ-NP-TV-Z](?!\w)")),
    ("passport", re.compile(r"(?<!\w)[A-Z]{1,2}\d{7,8}(?!\w)")),
    ("card", re.compile(r"(?<!\w)[A-Z]\d\d[A-Z]\d{5}(?!\w)")),
]
_NOT_BEFORE = re.compile(r"(?:order|ticket|isbn|version|bestellung|commande|pedido|grid point|meter showed|indiquait|zeigte|marcaba|invoice|item|no\.|#|v)\W{0,3}$", re.I)

# A phrase that announces an identity number.
_ANNOUNCED = re.compile(r"(?:insurance|passport|security|tax|id|identity|dni|nie|nif)\W+(?:no|number|es|que figura es)?\.?\W*$", re.I)

_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def check_part(kind: str, value: str) -> tuple[str, str] | None:
    """Body and check characters of a number whose kind has a check, with the check that the body
    asks for; None for other kinds."""
    if kind == "dni":
        x = re.sub(r"[- ]", "", value)
        return value[:-1], _DNI[int(x[:-1].translate(str.maketrans("XYZ", "012"))) % 23]
    if kind == "insee":
        x = re.sub(r"\D", "", value[:-2].replace("2A", "19").replace("2B", "18").replace("A", "0").replace("B", "0"))
        return value[:-2], f"{97 - int(x) % 97:02d}"
    return None


def valid(kind: str, value: str) -> bool | None:
    """Whether a number keeps the rules of its kind; None where a kind has no rule that tells a
    mistyped number from one that is written correctly."""
    if kind == "ssn":
        # Areas from 900 on are taxpayer numbers.
        d = re.sub(r"\D", "", value)
        return d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"
    if kind == "dni":
        return value[-1] == check_part(kind, value)[1]
    return None


_PHONE = [
    # International: plus, country, groups; trunk zero in brackets allowed.
    re.compile(rf"(?<![\w+])\+\d{{1,3}}(?:(?:{S}|[.\-/])?\(?\d{{1,5}}\)?){{2,6}}(?![\w]|[-.]\d)"),
    # North American, with any separators or none.
    re.compile(rf"(?<![\w.+-])(?:1(?:-|\.|{S}))?(?:\([2-9]\d{{2}}\)(?:-|{S})?|[2-9]\d{{2}}(?:[-.]|{S})?)[2-9]\d{{2}}(?:[-.]|{S})?\d{{4}}(?![\w]|[-.]\d)"),
    # French: ten digits in pairs.
    re.compile(rf"(?<![\w.+-])0[1-9](?:(?:[.\-]|{S})?\d\d){{4}}(?!\w|[-.]\d)"),
    # German: area code with zero, then the number in one or two groups.
    re.compile(rf"(?<![\w.+-])(?:\(0\d{{1,4}}\){_S}?|0\d{{1,4}}(?:[/-]|{S}))\d{{3,8}}(?:(?:-|{S})\d{{1,5}})?(?!\w|[-.]\d)"),
    # British: zero and ten digits in two or three groups.
    re.compile(rf"(?<![\w.+-])\(?0\d{{2,4}}\)?{_S}\d{{3,4}}{_S}\d{{3,4}}(?!\w|[-.]\d)"),
    # Spanish: nine digits from 6 to 9.
    re.compile(rf"(?<![\w.+-])[6-9]\d{{2}}(?:(?:{S})?\d{{2}}(?:{S})?\d{{2}}(?:{S})?\d{{2}}|{_S}\d{{3}}{_S}\d{{3}})(?!\w|[-.,]\d)"),
]

_CAP = r"[A-ZÀ-ÖØ-ÞŒŠŽ]"
_TYPE_EN = r"(?:Lane|Street|Road|Walk|Court|Avenue|Close|Drive|Way|Hill|Terrace|Crescent|Square|Row|Place|Gardens|Grove|Mews|Yard|Boulevard|Parade|Wharf|St|Rd|Ave|Ln|Blvd)"
_ADDRESS = [
    re.compile(rf"(?<![\w.,-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite){_S}\d+[a-z]?,?{_S})?\d{{1,4}}[a-zA-Z]?,?{_S}(?:(?:{_CAP}[\w'’-]+{_S}){{1,3}}{_TYPE_EN}(?!\w)|{_CAP}[a-z]+gate(?!\w))"),
    re.compile(rf"(?<![\w.,-])\d{{1,4}}(?:{_S}(?:bis|ter|quater))?,?{_S}(?:rue|avenue|boulevard|impasse|place|allée|chemin|quai|cours|route|square|passage|sentier)(?!\w)(?:{_S}(?:de|du|des|la|le|les)(?!\w)|{_S}(?:de{_S})?(?:l|d)['’])*{_S}?{_CAP}"),
    re.compile(rf"(?<!\w)(?:Calle|Avenida|Avda\.?|Plaza|Camino|Paseo|Ronda|Travesía|Carrera|Rua|Praça|Travessa|Largo|Via|Viale|Piazza)(?:{_S}(?:de|del|la|las|los|el|da|do|das|dos|di|della))*(?:{_S}{_CAP}[\w'’-]+){{1,3}},?{_S}(?:(?:nº|n\.º|n°|No\.?|núm\.?|número){_S}?)?\d{{1,4}}(?!\d)"),
    re.compile(rf"(?<!\w)(?:{_CAP}[\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|graben|markt|hof)|(?:Am|An{_S}der|An{_S}den|Auf{_S}der|Auf{_S}dem|Im|In{_S}der|Zum|Zur|Unter{_S}den|Hinter{_S}der|Hinter{_S}dem)(?:{_S}{_CAP}[\wäöüß-]+){{1,2}}|{_CAP}[\wäöüß-]+{_S}(?:Straße|Strasse|Weg|Gasse|Platz|Allee|Ufer|Ring)){_S}\d{{1,4}}{_S}?[a-z]?(?!\w)"),
    re.compile(r"(?:ул\.|улица|проспект|пр\.|переулок)\s+[А-ЯЁ][\w-]+(?:\s+[А-ЯЁ]?[\w-]+)?,?\s+(?:д\.|дом)?\s?\d+"),
]

# Given names common in the crawl's languages; fixed values.
GIVEN = frozenset("""mara falk leila yuki sanjit matteo tobin joren noemi elise lucian piet zoe bjorn ivo oskar anneke amadou dario petra ruben hugo celia greta ines lior nadja selma
james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna emma olivia sophia
pierre jean marie claire luc julien camille antoine chloe nicolas louis manon hans peter klaus jurgen wolfgang ursula helga monika sabine stefan andreas karl heinz
jose juan carlos maria carmen ana luis pedro pablo lucia sofia diego javier miguel joao paulo rui tiago beatriz mariana giovanni luca marco giulia francesca paolo
ivan sergei olga natalia dmitri elena alexei tatiana svetlana omar fatima ahmed aisha hassan wei li ming hiroshi akiko kenji priya raj arjun lars ingrid sven astrid freya nils
kofi ama kwame zainab yusuf leon mia noah lea felix jonas lena max paul nora ida alma otto emil clara""".split())
_PLACES = frozenset("street road lane walk avenue court saint port castel north south east west lower upper new old great river lake mount valle san santa puerto vila serra sankt bad the a".split())
_TITLE = r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Sir|Dame|Herr|Frau|M|Mme|Mlle|Monsieur|Madame|Sr|Sra|Don|Doña|Senhor|Senhora)\.?\s+)?"
_PART = r"(?:van der|van den|van de|van|von der|von|de la|de los|del|de|di|da|dos|al|el|ter|ten|le|la)"
_W = rf"{_CAP}[^\W\d_]*(?:['’\-]?{_CAP}[^\W\d_]+|['’\-][^\W\d_]+)*"
_PARTS = _PART.replace(" ", _S)
_PARTS_UP = _PART.upper().replace(" ", _S)
_SUR = rf"(?:{_PARTS}{_S})?{_W}"
_FIRST_LAST = re.compile(rf"(?<![\w@.+-])({_W})((?:{_S}{_CAP}\.)*){_S}({_SUR})(?![\w@])")
_INITIAL = re.compile(rf"(?<![\w@.+-])({_CAP}\.(?:{_S}?{_CAP}\.)*){_S}({_SUR})(?![\w@])")
_CUE = re.compile(
    r"(?:name is|name:|nom:|nombre:|nome:|named|signed by|thanks to|asked|applicant,|contact:|belongs to|call me|author:?|by|dear|from|and|mein name ist|formular von|erreichbar ist|gezeichnet von|m['’]appelle|signé par|joindre|me llamo|firmado por|localizar a|contactar a|chamo|assinado por|меня зовут|photo:|editor:?|guest:?|hello|hi)\s+$|(?:^|[\n;,|\t])\s*$",
    re.I,
)
_STRONG_CUE = re.compile(
    r"(?:name is|name:|nom:|nombre:|nome:|signed by|thanks to|i asked|applicant,|contact:|belongs to|mein name ist|formular von|erreichbar ist|m['’]appelle|signé par|joindre|me llamo|firmado por|localizar a|chamo|assinado por|меня зовут)\s+$",
    re.I,
)
_AFTER = re.compile(r"\s+(?:still\s+lives\s+at|lives\s+at|wohnt)", re.I)


def fold(w: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))


_CAPS_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def _soften(text: str) -> str:
    """A text in capitals as words with one capital, character for character."""
    raw = text.encode("utf-8", "surrogatepass")
    up = len(raw) - len(raw.translate(None, _UPPER))
    if up < 20 or up < 6 * (len(raw) - len(raw.translate(None, _LOWER))):
        return text
    out = _CAPS_WORD.sub(lambda m: m.group()[0] + m.group()[1:].lower() if len(m.group().lower()) == len(m.group()) else m.group(), text)
    return out if len(out) == len(text) else text


_CAPITAL = re.compile(r"(?<![\w@.+-])[A-ZÀ-ÖØ-Þ][^\W\d_]+")
_SURNAME_BEFORE = re.compile(rf"(?<![\w@.+-])((?:(?:{_PARTS}|{_PARTS_UP}){_S})?{_W}),{_S}$")
_NAME_BEFORE = re.compile(rf"(?<![\w@.+-])({_W})((?:{_S}{_CAP}\.)*){_S}({_SUR})$")
_CUE_WORDS = re.compile(
    r"(?:[Nn]ame is|signed by|[Tt]hanks to|I asked|applicant,|[Cc]ontact:|belongs to|[Nn]ame ist|[Ff]ormular von|[Ee]rreichbar ist|m['’]appelle|signé par|joindre|[Mm]e llamo|firmado por|localizar a|[Cc]hamo|assinado por|[Мм]еня зовут)\s+"
)
# Verbs and titles that take a person; what follows counts if it has the form of a full name and its
# first word stands for a person elsewhere in the text or nowhere for something else.
_PERSON_WORDS = re.compile(
    r"\b(?:[Ww]rite to|[Mm]et|[Cc]ontact|[Ss]poke (?:to|with)|[Tt]alked to|[Aa]sk for|[Ee]mailed|[Mm]arried|[Tt]hanked|[Rr]eplied to|[Ii]nterviewed|(?:Mr|Mrs|Ms|Dr|Prof)\.?"
    r"|[Ss]chreiben Sie an|[Tt]raf|[Ff]ragte|[Hh]eiratete|Herrn?|Frau|[Éé]crivez à|rencontré|épousé|Monsieur|Madame|Mme|[Ee]scriba a|conocí a|Señora?|Don|Doña|[Ee]screva para|conheci|Senhora?)\s+"
)
_AND_NAME = re.compile(rf"(?:,{_S}|{_S}(?:and|und|et|y|e){_S})")
_PERSON_LITERALS = ("rite to", "et ", "et\n", "ontact", "poke ", "alked to", "sk for", "mailed", "arried", "hanked", "eplied to", "nterviewed", "Mr", "Ms", "Dr", "Prof", "chreiben Sie", "raf ", "ragte", "eiratete", "Herr", "Frau", "crivez", "rencontré", "épousé", "Monsieur", "Madame", "Mme", "scriba a", "conoc", "Señor", "Don", "Doña", "screva para", "conheci", "Senhor")
# Words that open names of places, bodies and works rather than of persons; fixed values.
_NO_PERSON = frozenset(
    "university institute college school museum council committee ministry department office bank company hotel hospital church cathedral library theatre orchestra festival station airport bridge tower castle park garden island mount lake river port harbour bay cape fort city town village county district region republic kingdom united royal national international general central public local first second third january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday los las des der die das le les el il".split()
)
_NO_NAME = _NO_PERSON | _PLACES | P._ALL_COMMON
_LIVES = re.compile(r"\s+(?:still\s+lives\s+at|lives\s+at|wohnt)\b")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]+")
_INITIAL_HINT = re.compile(rf"{_CAP}\.\s")


class _Given(dict):
    """Whether words, as spelled, are given names; forgets what it met when it grows large."""

    def __missing__(self, w: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        v = self[w] = fold(w) in GIVEN
        return v


_IS_GIVEN = _Given()


# Literals of which one must occur for a pattern to match; a substring test costs next to nothing.
_CUE_LITERALS = ("ame is", "igned by", "hanks to", "I asked", "pplicant,", "ontact:", "elongs to", "ame ist", "ormular von", "rreichbar ist", "appelle", "signé par", "joindre", "e llamo", "irmado por", "ocalizar a", "hamo", "ssinado por", "еня зовут")
_STREET_LITERALS = (
    ("Lane", "Street", "Road", "Walk", "Court", "Avenue", "Close", "Drive", "Way", "Hill", "Terrace", "Crescent", "Square", "Row", "Place", "Gardens", "Grove", "Mews", "Yard", "Boulevard", "Parade", "Wharf", "St", "Rd", "Ave", "Ln", "Blvd", "gate"),
    ("rue", "avenue", "boulevard", "impasse", "place", "allée", "chemin", "quai", "cours", "route", "square", "passage", "sentier"),
    ("Calle", "Avenida", "Avda", "Plaza", "Camino", "Paseo", "Ronda", "Travesía", "Carrera", "Rua", "Praça", "Travessa", "Largo", "Via", "Piazza"),
    ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "steig", "graben", "markt", "hof", "Am ", "Am\n", "An ", "An\n", "Auf ", "Im ", "In ", "Zum ", "Zur ", "Unter ", "Hinter ", "Straße", "Strasse", "Weg", "Gasse", "Platz", "Allee", "Ufer", "Ring"),
    ("ул", "проспект", "пр.", "переулок"),
)
_NUMBERED_STREET = re.compile(rf"\d[a-zA-Z]?,?(?:{S}){_CAP}")


def _any(t: str, literals: tuple[str, ...]) -> bool:
    for x in literals:
        if x in t:
            return True
    return False


def _names(t: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    # Most texts hold no listed name: all their capital words are told at once.
    hit = {w for w in set(_CAPITALS.findall(t)) if _IS_GIVEN[w]}
    for h in _CAPITAL.finditer(t) if hit else ():
        if h.group() not in hit:
            continue
        i = h.start()
        m = _SURNAME_BEFORE.search(t[max(0, i - 48) : i])
        if m:
            last, start = m.group(1), max(0, i - 48) + m.start()
            if last[0].islower() and (x := re.match(rf"{_PARTS}{_S}", last)) and last[x.end() :].isupper():
                start += x.end()
                last = last[x.end() :]
            if (last.isupper() and len(last) > 2 or _CUE.search(t[max(0, start - 25) : start])) and fold(last).split()[-1] not in GIVEN:
                out.append((start, h.end()))
                continue
        m = _FIRST_LAST.match(t, i)
        if m and fold(m.group(3)) not in GIVEN | _PLACES:
            out.append(m.span())
    # Given names that the list lacks, where a phrase announces a name.
    for c in _CUE_WORDS.finditer(t) if _any(t, _CUE_LITERALS) else ():
        m = _FIRST_LAST.match(t, c.end())
        if m and fold(m.group(1)) not in _PLACES and re.search(r"[a-zà-ÿ]", m.group(1)):
            out.append(m.span())
    for c in _PERSON_WORDS.finditer(t) if _any(t, _PERSON_LITERALS) else ():
        m = _FIRST_LAST.match(t, c.end())
        while m and not {fold(m.group(1)), *fold(m.group(3)).split()} & _NO_NAME and re.search(r"[a-zà-ÿ]", m.group(1)):
            out.append(m.span())
            more = _AND_NAME.match(t, m.end())
            m = _FIRST_LAST.match(t, more.end()) if more else None
    for c in _LIVES.finditer(t) if "lives" in t or "wohnt" in t else ():
        a = max(0, c.start() - 60)
        m = _NAME_BEFORE.search(t[a : c.start()])
        if m and fold(m.group(1)) not in _PLACES:
            out.append((a + m.start(), c.start()))
    for m in _INITIAL.finditer(t) if _INITIAL_HINT.search(t) else ():
        before = t[max(0, m.start() - 25) : m.start()]
        if _CUE.search(before) or _AFTER.match(t, m.end()) or "-" in m.group(2) or " " in m.group(2):
            if not re.search(r"[.!?]\s*$", before) or _AFTER.match(t, m.end()) or _STRONG_CUE.search(before):
                out.append(m.span())
    return out


# A cluster of seven digits, or digits led by capitals: without one there is no number to look for.
_CLUSTER = re.compile(r"\d(?:[ \xa0.\-/()\r\n]{0,3}\d){6}")
_LETTERED = re.compile(r"[A-Z]\s?\d\d(?:\s?\d\d|[A-Z]\d)")
_NUMBERS = re.compile(r"\d+")
_AT_HINT, _AT_WORD = re.compile(r"[\[({]\s?at\s?[\])}]"), re.compile(r"\sAT\s")
_DOT_HINT = re.compile(r"\sdot\s")
#: Characters around a number in which an address with it stands.
REACH = 200


def _near_numbers(t: str) -> list[tuple[int, int]]:
    """Stretches around the numbers of a text, ending at white space where they can."""
    out: list[tuple[int, int]] = []
    for m in _NUMBERS.finditer(t):
        a, b = max(0, m.start() - REACH), min(len(t), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """Items ``(kind, start, end)`` in positions of ``text``."""
    clean, back = E.repair_map(text)
    t = _soften(clean)
    found: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        k = bisect.bisect_left(ends, a + 1)
        if k == len(ends) or starts[k] >= b:
            starts.insert(k, a)
            ends.insert(k, b)
            found.append((kind, a, b))

    starts: list[int] = []
    ends: list[int] = []

    if "@" in t:
        for m in _EMAIL.finditer(t):
            add("email", *m.span())
    for literal, hint, p in (("at", _AT_HINT, _SPELT), ("AT", _AT_WORD, _SPELT), ("dot", _DOT_HINT, _SPELT_LOW)):
        if literal in clean and hint.search(clean):
            for m in p.finditer(clean):
                add("email", *m.span())
    near = _near_numbers(t)
    if near:
        around = "\n".join(t[a:b] for a, b in near)
        cluster = _CLUSTER.search(around) is not None
        for kind, p in _ID if cluster or _LETTERED.search(around) else ():
            for m in (m for a, b in near for m in p.finditer(clean, a, b)):
                said = _ANNOUNCED.search(clean[max(0, m.start() - 30) : m.start()]) is not None
                if (said or not _NOT_BEFORE.search(clean[max(0, m.start() - 20) : m.start()])) and (said or valid(kind, m.group()) is not False):
                    add("id_number", *m.span())
        for i, p in enumerate(_ADDRESS):
            if _any(around, _STREET_LITERALS[i]) and (i > 0 or _NUMBERED_STREET.search(around)):
                for m in (m for a, b in near for m in p.finditer(t, a, b)):
                    add("address", *m.span())
        for p in _PHONE if cluster else ():
            for m in (m for a, b in near for m in p.finditer(t, a, b)):
                n = sum(c.isdigit() for c in m.group())
                if 8 <= n <= 15 and not _NOT_BEFORE.search(t[max(0, m.start() - 20) : m.start()]):
                    add("phone", *m.span())
    for a, b in _names(t):
        add("name", a, b)
    found.sort(key=lambda x: x[1])
    if back is None:
        return found
    return [(k, back[a], back[b]) for k, a, b in found]


# --- format-preserving pseudonyms ---------------------------------------------------------------


def _round(key: bytes, tweak: str, r: int, half: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{r}|{tweak}|{half}".encode(), key=key, digest_size=16).digest(), "big")


def feistel_digits(digits: str, key: bytes, tweak: str = "", rounds: int = 10, inverse: bool = False) -> str:
    """A keyed permutation of the decimal strings of one length (unbalanced halves, ten rounds)."""
    n = len(digits)
    if n < 2:
        if n == 0:
            return digits
        shift = _round(key, tweak, 0, "") % 10
        return str((int(digits) + (-shift if inverse else shift)) % 10)
    u = n // 2
    v = n - u
    a, b = digits[:u], digits[u:]
    order = range(rounds - 1, -1, -1) if inverse else range(rounds)
    for r in order:
        m = u if r % 2 == 0 else v
        if inverse:
            # Undo: (a, b) was (old b, (old a + F(old b)) mod 10**m).
            prev = (int(b) - _round(key, tweak, r, a)) % 10**m
            a, b = str(prev).zfill(m), a
        else:
            c = (int(a) + _round(key, tweak, r, b)) % 10**m
            a, b = b, str(c).zfill(m)
    return a + b


def permute(value: str, key: bytes, tweak: str, accept: Callable[[str], bool], inverse: bool = False) -> str:
    """A keyed permutation of the strings of one format that ``accept`` takes: digits stay digits,
    capitals stay capitals, all else stays.  The string is ranked among those of its format and walks
    the Feistel cycle until it is accepted; one that is not accepted itself stays as it is."""
    if not accept(value):
        return value
    bases = [10 if c in _DECIMALS else 26 if c in _CAPS else 1 for c in value]
    size = math.prod(bases)
    width = len(str(size - 1))
    rank = 0
    for c, b in zip(value, bases):
        rank = rank * b + (int(c) if b == 10 else ord(c) - 65 if b == 26 else 0)
    while True:
        rank = int(feistel_digits(str(rank).zfill(width), key, tweak, inverse=inverse))
        if rank >= size:
            continue
        x, out = rank, []
        for c, b in zip(reversed(value), reversed(bases)):
            x, d = divmod(x, b)
            out.append(str(d) if b == 10 else chr(65 + d) if b == 26 else c)
        if accept(s := "".join(reversed(out))):
            return s


_DECIMALS, _CAPS = frozenset("0123456789"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def swap_number(kind: str, value: str, key: bytes, inverse: bool = False) -> str:
    """The pseudonym of an identity number (``kind`` of its format) or phone, or with ``inverse`` what
    it stands for: a number of the same format, valid if the value is.  Right check characters are made
    anew, wrong ones are permuted with the rest; the plus and country digits of a phone stay.  Equal
    numbers written with other separators get equal digits."""
    text = re.sub(r"\s+", " ", value)
    bare = re.sub(r"[^0-9A-Z]", "", text)
    if kind == "phone":
        head = re.match(r"\+\d{1,2}", text)
        head = re.sub(r"\D", "", head.group()) if head else ""
        first = bare[len(head) : len(head) + 1]
        new = head + first + permute(bare[len(head) + 1 :], key, f"phone{head}|{first}", lambda s: True, inverse)
    else:
        check = check_part(kind, bare)
        pattern = dict(_ID)[kind]
        free = {"ssn": lambda s: f"{s[:3]}-{s[3:5]}-{s[5:]}", "tin": lambda s: f"{s[:2]} {s[2:5]} {s[5:8]} {s[8:]}"}.get(kind, lambda s: s)
        if check and bare.endswith(check[1]):
            any_check = "A" if kind == "dni" else "00"
            body = permute(check[0], key, kind, lambda s: pattern.fullmatch(s + any_check) is not None, inverse)
            new = body + check_part(kind, body + any_check)[1]
        else:
            was = valid(kind, bare)
            new = permute(bare, key, kind, lambda s: pattern.fullmatch(free(s)) is not None and valid(kind, s) == was and not ((k := check_part(kind, s)) and s.endswith(k[1])), inverse)
    letters = iter(new)
    return "".join(next(letters) if c in _DECIMALS or c in _CAPS else c for c in text)


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The placeholder of an item: numbers as pseudonyms of their format, other items as keyed tags."""
    if kind in ("id_number", "phone"):
        own = kind if kind == "phone" else next((k for k, p in _ID if p.fullmatch(value)), None)
        if own:
            return f"[{kind.upper()}:{swap_number(own, value, key)}]"
    tag = hashlib.blake2b(fold(re.sub(r"\s+", " ", value)).encode("utf-8", "surrogatepass"), key=key, digest_size=4).hexdigest()
    return f"[{kind.upper()}:{tag}]"


_DATE = re.compile(r"(?<![\w.-])(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?![\w.-])")


def shift_date(m: re.Match, key: bytes) -> str:
    """A calendar date permuted among the days of its own century."""
    import datetime as dt

    try:
        d = dt.date(int(m[1]), int(m[2]), int(m[3]))
    except ValueError:
        return m.group()
    base = dt.date(d.year // 100 * 100 or 1, 1, 1)
    n = (dt.date(base.year // 100 * 100 + 99, 12, 31) - base).days + 1
    x = (d - base).days
    while True:  # cycle walking keeps it a permutation of the days
        x = int(feistel_digits(str(x).zfill(5), key, "date"))
        if x < n:
            return (base + dt.timedelta(days=x)).isoformat()


def mask(text: str, key: bytes, items: list[tuple[str, int, int]] | None = None) -> str:
    out, at = [], 0
    for kind, a, b in find(text) if items is None else items:
        out += [_DATE.sub(lambda m: shift_date(m, key), text[at:a]), pseudonym(kind, text[a:b], key)]
        at = b
    out.append(_DATE.sub(lambda m: shift_date(m, key), text[at:]))
    return "".join(out)


def detect(docs: DataFrame, key: bytes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, items, masked`` per row; ``items`` are ``pii_type, start_pos, end_pos``.  Without a key
    there are no pseudonyms and ``masked`` is null."""

    def fn(ids: list, texts: list) -> list[list]:
        items = [find(t) if t else [] for t in texts]
        return [
            ids,
            [[{"pii_type": x, "start_pos": a, "end_pos": b} for x, a, b in i] for i in items],
            [mask(t, key, i) if t and key is not None else t if key is not None else None for t, i in zip(texts, items)],
        ]

    id_type = dict(docs.dtypes)[id_col]
    return map_columns(
        docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")),
        ["_i", "_t"],
        f"{id_col} {id_type}, items array<struct<pii_type:string,start_pos:long,end_pos:long>>, masked string",
        fn,
    )


def session_key(spark: SparkSession) -> bytes:
    """The secret in ``spark.siltworks.pseudonymKey``; without one a random key, with which equal
    values stay linked within one query only."""
    said = spark.conf.get("spark.siltworks.pseudonymKey", None)
    return said.encode()[:64] if said else secrets.token_bytes(32)


def found(docs: DataFrame) -> DataFrame:
    src = docs.where("length(trim(text)) > 0")
    return detect(src, None).select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.pii_type", "x.start_pos").distinct()
