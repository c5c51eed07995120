"""Personal information in free text: patterns propose, checksums and shapes confirm, context adjusts.

Kinds: ``email``, ``phone``, ``id_number``, ``address``, ``name``. Every pattern match is a proposal with a
base score. Forms that carry a check (card numbers: Luhn; IBAN and the French number with its key: mod 97) are kept only if
it is right; elsewhere a valid check digit raises the score. Words near by raise or lower it, and proposals above
``ACCEPT`` are kept. Of overlapping ones the better scored, then the longer, stays. Texts are read whole,
one task handles any number of them; nothing about the corpus is gathered.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.6
KINDS = ("email", "phone", "id_number", "address", "name")
MOST_KNOWN = 100_000


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    """Check digit of payment cards and several national numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return bool(digits) and total % 10 == 0


def mod97(number: str) -> bool:
    """ISO 7064 mod 97-10 over digits and letters: remainder 1, or a two-digit key 97 − n mod 97 at the end."""
    digits = "".join(str(int(c, 36)) for c in number if c.isalnum())
    if len(digits) < 4:
        return False
    body, key = int(digits[:-2]), int(digits[-2:])
    return int(digits) % 97 == 1 or key == 97 - body % 97


def iban(number: str) -> bool:
    """Country, check digits and account: mod 97 with the first four characters at the end."""
    plain = re.sub(r"\s", "", number).upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def card(number: str) -> bool:
    plain = re.sub(r"\D", "", number)
    return 13 <= len(plain) <= 19 and len(set(plain)) > 1 and luhn(plain)


def french_key(number: str) -> bool:
    """Fifteen digits end in their key; thirteen have none to check."""
    plain = re.sub(r"\D", "", number)
    return len(plain) != 15 or int(plain[13:]) == 97 - int(plain[:13]) % 97


# --- patterns ------------------------------------------------------------------------------------------


def _begins(first: str, after: str, rest: str) -> re.Pattern[str]:
    """``(?<!after)first rest``, written so that places are looked up by their first character and not tried one by one."""
    return re.compile(rf"{first}(?<!{after}{first}){rest}")


_TOKEN = r"[A-Za-zÀ-ÿ0-9_](?:[\w.\-+]*\w)?"
_EMAIL = re.compile(r"[A-Za-z0-9À-ÿ][\w.+%\-]*@[A-Za-z0-9](?:[\w\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[\w\-]*[A-Za-z0-9])?)+")
_EMAIL_MARKED = re.compile(
    r"[A-Za-z0-9À-ÿ](?:[\w.+%\-]|\s?[\[({<]\s?(?:dot|punkt|point)\s?[\])}>]\s?)*\s?[\[({<]\s?(?:at|ät|arobase)\s?[\])}>]\s?"
    r"[A-Za-z0-9](?:[\w\-]*\w)?(?:(?:\.|\s?[\[({<]\s?(?:dot|punkt|point)\s?[\])}>]\s?)[A-Za-z0-9](?:[\w\-]*\w)?)+",
    re.I,
)
_SPOKEN_JOIN = r"(?:dot|dash|hyphen|underscore|plus|punkt|point|tiret|minus|strich)"
_EMAIL_SPOKEN = re.compile(rf"\b{_TOKEN}(?:\s+{_SPOKEN_JOIN}\s+{_TOKEN})*\s+(?:at|ät|arobase)\s+{_TOKEN}(?:\s+{_SPOKEN_JOIN}\s+{_TOKEN})*\s+(?:dot|punkt|point)\s+[A-Za-z]{{2,10}}\b", re.I)
# each quick test below is implied by its patterns
_HAS_SPOKEN = re.compile(rf"\b(?:at|ät|arobase)\s+[\w.\-+]+\s+{_SPOKEN_JOIN}\b", re.I)
_HAS_MARKED = re.compile(r"[\[({<]\s?(?:at|ät|arobase)\s?[\])}>]", re.I)
_HAS_PHONE = re.compile(r"[+(\d](?:(?<=\+)\d|(?<=0)0\d\d|(?<=\()\d{2,5}\)|(?<=0)\d{2,4}[\s.\-]\d{3}|(?<=\d)\d{2}[.\-]\d{3}[.\-]\d{4})")
_HAS_ID = re.compile(r"\d[\d\s\-]{4,}\d")
_APART = "-,.;:!?()[]\"»«„“”"

_PHONES = [
    (re.compile(r"(?<![\w+])\+\d{1,3}(?:[\s.\-]?(?:\(\d{1,4}\)|\d{1,4})){2,5}(?:\d{1,4})?(?!\w)"), 0.75),
    (re.compile(r"(?<![\w.])00\d{2}[\s.\-]?(?:\(0\)\s?)?\d{1,4}(?:[\s.\-]\d{2,6}){1,4}(?!\w)"), 0.7),
    (re.compile(r"(?<![\w(])\(\d{2,5}\)[\s.\-]?\d{3,4}[\s.\-]\d{3,4}(?!\w)"), 0.65),
    (re.compile(r"(?<![\w.,/\-])0\d{2,4}[\s.\-]\d{3,4}[\s.\-]?\d{3,4}(?![\w/]|[\s.\-]\d)"), 0.6),
    (re.compile(r"(?<![\w.,/\-])\d{3}([.\-])\d{3}\1\d{4}(?![\w/]|[.\-]\d)"), 0.6),
]
# fixed values: digit words
_DIGIT_WORDS = (
    "zero oh nought one two three four five six seven eight nine double treble triple "
    "null eins ein zwei zwo drei vier fünf sechs sieben acht neun "
    "zéro un deux trois quatre cinq sept huit neuf"
).split()
_DIGIT = "(?:" + "|".join(sorted({v for w in _DIGIT_WORDS for v in (w, unicodedata.normalize("NFD", w))}, key=len, reverse=True)) + "|six)"
_DIGIT_SET = {v for w in (*_DIGIT_WORDS, "six") for v in (w, unicodedata.normalize("NFD", w))}
_ANY_DIGIT = re.compile(r"\d")
_PHONE_SPOKEN = re.compile(rf"\b{_DIGIT}(?:[\s,\-]+{_DIGIT}){{6,14}}\b", re.I)

_IDS = [
    (_begins(r"[A-Z]", r"\w", r"[A-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z](?!\w)"), 0.6),
    (_begins(r"\d", r"[\w.,]", r"\d{2}\s\d{3}\s\d{3}\s\d{2}(?!\w|[\s.,]\d)"), 0.5),
    (_begins(r"\d", r"[\w.,/\-]", r"\d{5}[-+]\d{4}(?![\w/]|-\d)"), 0.5),
    (_begins(r"\d", r"[\w.,/\-]", r"\d{3}-\d{4}-\d{2}(?![\w/]|-\d)"), 0.5),
    (_begins(r"[A-Z]", r"[\w\-]", r"[A-Z]{2}\d{2}[A-Z]\d{6}(?!\w)"), 0.6),
    (_begins(r"[A-Z]", r"[\w\-]", r"[A-Z]?\d{7,9}(?!\w)"), 0.55),
    (_begins(r"\d", r"[\w.,/\-]", r"\d{2}-\d{2}-\d{4}(?![\w/]|-\d)"), 0.4),
]
# forms with a check that decides
_CHECKED = [
    (_begins(r"[12]", r"[\w.,]", r"\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}(?:\s?\d{2})?(?!\w)"), french_key, 0.55),
    (_begins(r"[A-Z]", r"\w", r"[A-Z]\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)"), iban, 0.85),
    (_begins(r"\d", r"[\w.,/+\-]", r"\d{3}([\s\-]?)\d{4}\1\d{4}\1\d{1,7}(?![\w/]|[.,\-]\d)"), card, 0.75),
    (_begins(r"3", r"[\w.,/+\-]", r"\d{3}([\s\-]?)\d{6}\1\d{5}(?![\w/]|[.,\-]\d)"), card, 0.75),
]
_ID_NEAR = re.compile(
    r"insurance|identity|identification|\bIBAN\b|account|passport|claimant|social security|national number|licen[cs]e number"
    r"|versicher|ausweis|pass(?:nummer)?\b|personal(?:nummer|ausweis)|identit|sécurité sociale|passeport|assur|demandeur|antragsteller",
    re.I,
)
_NOT_PERSONAL = re.compile(r"\b(?:paper|drucksache|document|section|titel|titre|lots?|room|salle|raum|votes?|order)\W*$", re.I)

# fixed values: kinds of streets
_EN_STREET = "Street|St|Road|Rd|Lane|Ln|Walk|Mews|Row|Way|Close|Cl|Court|Ct|Drive|Dr|Crescent|Cres|Parade|Pde|Terrace|Ter|Gardens|Gdns|Avenue|Ave|Place|Pl|Square|Sq|Hill|Grove|Gr|Green|Rise|Yard|Wharf|Quay|Alley|Passage|View|Park"
_FR_STREET = r"rue|avenue|av\.?|boulevard|boul\.?|bd\.?|blvd|impasse|imp\.?|allées?|all\.?|place|pl\.?|quai|chemin|ch\.|cours|square|route|rte|passage|sentier|ruelle|venelle|villa|cité"
_DE_STREET = "straße|strasse|str\\.|gasse|weg|allee|ufer|platz|stieg|steig|ring|damm|graben|markt|hof|pfad|chaussee|zeile|winkel"
_UP = r"[A-ZÀ-ÖØ-Þ]"
_IN = r"[\w'’\xad̀-ͯ]"
_CAP = rf"{_UP}{_IN}*(?:-{_IN}+)*"
_HOUSE = r"\d{1,4}(?:\s?[A-Za-z](?!\w))?(?:\s?[-–/]\s?\d{1,4}(?:[A-Za-z](?!\w))?)?"
_ADDRESSES = [
    (re.compile(rf"(?<![\w.,/\-])(?:(?:Flat|Apartment|Apt\.?|Unit|Suite|Room)\s+\d+[A-Za-z]?,?\s+)?{_HOUSE},?\s+(?:{_CAP}\s+){{1,4}}(?:{_EN_STREET})\b\.?(?=\W|$)"), 0.75),
    (re.compile(rf"(?<![\w.,/\-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-Z])(?!\w))?(?:\s?[-–]\s?\d{{1,4}})?,?\s+(?i:{_FR_STREET})\s+(?:(?:de\s+la|de\s+l['’]|des|du|de|aux|au|à\s+la|d['’]|l['’])\s*)?{_CAP}(?:\s+(?:(?:de\s+la|de\s+l['’]|des|du|de)\s*)?{_CAP})*"), 0.75),
    (re.compile(rf"(?<!\w)(?:(?:Alte|Neue|Obere|Untere|Kleine|Große|Lange|Breite|Hohe)[nrs]?\s+)?{_UP}{_IN}*(?:-{_UP}{_IN}*)*(?:(?<=[a-zß])|-)(?i:{_DE_STREET})\s+(?:Nr\.?\s*)?\d{{1,4}}(?:\s?[a-z](?!\w))?(?:\s?[-–/]\s?\d{{1,4}}(?:\s?[a-z](?!\w))?)?(?!\w|,\d|\.\d)"), 0.7),
    (re.compile(rf"(?<!\w)(?:Straße|Platz|Weg|Allee|Ufer)\s+(?:der|des|am|zum)\s+{_CAP}\s+(?:Nr\.?\s*)?\d{{1,4}}(?:\s?[a-z](?!\w))?(?!\w)"), 0.7),
    (re.compile(rf"(?<!\w)(?:Im|Am|Zum|Zur|(?:An|Auf|Hinter|In|Unter|Bei|Vor|Über|Neben)\s+(?:der|dem|den))\s+{_CAP}(?:\s+{_CAP})?\s+(?:Nr\.?\s*)?\d{{1,4}}(?:\s?[a-z](?!\w))?(?!\w|[,./]\d|\s?%)"), 0.55),
]
_DE_NUMBERED = re.compile(rf"\s(?=\s*(?:Nr\.?\s*)?\d)(?i:{'|'.join(rf'(?<={k}\s)' for k in _DE_STREET.split('|'))})")
_DE_SQUARE = re.compile(r"(?:Straße|Platz|Weg|Allee|Ufer)\s+(?:der|des|am|zum)\s")
_DE_PLACE = re.compile(rf"(?:Im|Am|Zum|Zur|{'|'.join(rf'{k}\s+de[rmn]' for k in 'An Auf Hinter In Unter Bei Vor Über Neben'.split())})\s+{_UP}")
_EN_NUMBERED = re.compile(rf"\d(?:\s?[A-Za-z])?,?\s+{_UP}")
_FR_NUMBERED = re.compile(rf"\d(?:\s?(?:bis|ter|quater|[A-Z]))?,?\s+(?i:{_FR_STREET})\s")
_ADDRESS_NEAR = re.compile(r"lives? (?:at|in)|visited|delivery|cellar|address|wohnt|keller|haus\s*$|anschrift|zustell|habite|cave|livraison|adresse|domicili|besucht|Sendung|Paket|refus", re.I)
_NOT_STREET = re.compile(r"(?:Jahre?|Titel|Kapitel|Artikel|Absatz|Abschnitt|Saal|Raum|Drucksache|Haushaltsjahr|Sitzung|Punkt|Paragraf|Paragraph|Seite|Anlage|Nummer|Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Fall|Betrag|Umfang)\s+(?:Nr\.?\s*)?\d")

# words that tell of a private person, before and after the name
_PERSON_BEFORE = re.compile(
    r"(?:constituent|resident|witness|widow(?:er)? of|evidence from|letter from|patient|neighbour|(?:daughter|son|mother|father|wife|husband) of|\bDr\.?|spoke (?:to|with)"
    r"|bürger(?:in)?|anwohner(?:in)?|sprach(?: mit)?|stammt von|witwe(?:r)? (?:von)?|zeug(?:e|in)|brief von|nachbar(?:in)?|(?:tochter|sohn|mutter|vater) von"
    r"|habitante?|citoyen(?:ne)?|entendu|veuf|veuve de|lettre de|témoin|voisine?|docteur|(?:fille|fils|mère|père) de)\W*$",
    re.I,
)
_COLLEAGUE = re.compile(r"(?:colleague|kolleg(?:e|in|en)|coll[eè]gue)\s+$", re.I)
_PERSON_AFTER = re.compile(r"^\W*(?:wrote to|treated|sworn|as a witness|hat mir|als zeug|m['’]a écrit|comme témoin|a écrit|hat .{1,30} behandelt|a soigné|told me|told us|died|lives? (?:at|in)|wohnt)", re.I)
_PARTICLES = "van|von|de|du|der|den|la|le|zu|zum|af|di|da|del|ter|ten"
_PARTICLE = rf"(?:(?:(?:{_PARTICLES})\s+){{1,2}}|(?:(?:{_PARTICLES.upper()})\s+){{1,2}}(?={_UP}{{2}}))"
_WORD = rf"(?:{_UP}{_IN}+(?:-\s*\n\s*[a-zß-ÿ]{_IN}*)?)"
_SURNAME = rf"(?:{_PARTICLE})?(?:{_UP}['’])?{_WORD}(?:-{_WORD})*"
_LISTED_BEFORE = re.compile(rf"(?<![\w\-'’])(?P<s>{_SURNAME}),\s+$")
# fixed values: words for private people, and words that no name begins or ends with
_ROLES = (
    r"constituents?|residents?|witness|widow(?:er)?|neighbou?r|patient|tenant|pensioner|nurse|victim|daughter|son|mother|father|brother|sister|wife|husband"
    r"|bürger(?:in)?|anwohner(?:in)?|zeug(?:e|in)|witwer?|nachbar(?:in)?|patient(?:in)?|mieter(?:in)?|rentner(?:in)?|tochter|sohn|mutter|vater|bruder|schwester"
    r"|habitante?|citoyen(?:ne)?|témoin|veuve|veuf|voisine?|patiente|locataire|retraitée?|fille|fils|mère|père|frère|sœur"
)
_ACTS = r"evidence from|letter from|heard from|spoke (?:to|with)|wrote to|stammt von|brief von|sprach(?: mit)?|schrieb an|lettre de|entendu|écrit à"
_LINK = r"(?P<link>(?:\s+(?:of|from|von|de|named|namens|nommée?))?[,:]|\s+(?:of|von|de|named|namens|nommée?))"
_OWN = re.compile(r"\b(?:my|our|his|her|their|the|an?|one|mein\w*|unser\w*|sein\w*|ihr\w*|ein\w*|mon|ma|notre|son|sa|leur|une?|la|le)\s+$", re.I)
_CUE = rf"(?:(?P<role>(?i:{_ROLES})){_LINK}?\s+|(?i:{_ACTS})\s+|[Dd]r\.?\s+(?=(?:[^\s:(\[]+\s+){{2,4}}(?:treated|behandelt|a soigné)))"
# words by which a cue begins; a text without any has none
_CUE_WORDS = frozenset(
    "constituent constituents resident residents witness widow widower neighbor neighbour patient tenant pensioner nurse victim daughter son mother father brother sister wife husband "
    "bürger bürgerin anwohner anwohnerin zeuge zeugin witwe witwer nachbar nachbarin patientin mieter mieterin rentner rentnerin tochter sohn mutter vater bruder schwester "
    "habitant habitante citoyen citoyenne témoin veuve veuf voisin voisine patiente locataire retraité retraitée fille fils mère père frère sœur "
    "evidence letter heard spoke wrote stammt brief sprach schrieb lettre entendu écrit dr".split()
)
_CUE_PLACES = {w: re.compile(rf"[{w[0]}{w[0].upper()}{'ſ' if w[0] == 's' else ''}](?<!\w.)(?i:{w[1:]})\b") for w in _CUE_WORDS}
_NO_NAMES = frozenset(
    "the this that these those and but for not when while if in on at as he she it we they you i mr mrs ms miss dr prof sir lord lady prime minister president speaker chair "
    "chairman secretary committee commission council house government state chamber parliament member members colleague honourable right "
    "der die das den dem des ein eine und aber wenn herr herrn frau kollege kollegin kollegen minister ministerin ministerium präsident präsidentin regierung kommission ausschuss abgeordnete "
    "abgeordneter staatssekretär bundestag haus land bund le la les un une et mais si monsieur madame mme ministre président présidente commission assemblée chambre collègue député députée gouvernement".split()
)


def fold(s: str) -> str:
    t = unicodedata.normalize("NFKD", re.sub(r"-\s*\n\s*", "", s).replace("\xad", "").casefold().replace("ø", "o").replace("ß", "ss").replace("’", "'"))
    return " ".join("".join(c for c in t if not unicodedata.combining(c)).split())


def _near(a: str, b: str) -> bool:
    """Edit distance at most 2."""
    if abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > 2:
            return False
    return row[-1] <= 2


class Finder:
    """Finds spans in one text. ``known``: full names that are no cases (given name first)."""

    def __init__(self, known: list[str]):
        pairs = [(n.split()[0], " ".join(n.split()[1:])) for n in known if len(n.split()) > 1]
        self.known = {fold(f"{g} {s}") for g, s in pairs}
        self.by_given: dict[str, list[str]] = {}
        for g, s in pairs:
            self.by_given.setdefault(fold(g), []).append(fold(f"{g} {s}"))
        given = {v for g, _ in pairs for v in (unicodedata.normalize("NFC", g), unicodedata.normalize("NFD", g))}
        names = "|".join(sorted(map(re.escape, given), key=len, reverse=True)) or r"(?!)"
        first = rf"(?:{names})(?:-{_WORD})*"
        by_letter: dict[str, list[str]] = {}
        for v in sorted(given, key=len, reverse=True):
            by_letter.setdefault(v[0], []).append(re.escape(v[1:]))
        begun = "|".join(rf"{re.escape(c)}(?<![\w'’].)(?:{'|'.join(rests)})" for c, rests in by_letter.items()) or r"(?!)"
        initials = rf"(?:\s+{_UP}\.){{0,2}}"
        self.given = re.compile(rf"(?:{begun})(?!\w)")
        self.ahead = re.compile(rf"(?P<g>{first}){initials}\s+(?P<s>{_SURNAME})")
        self.listed = re.compile(rf"(?P<g>{first}){initials}(?![\w\-'’])")
        free = rf"{_WORD}(?:-{_WORD})*"
        self.cued = re.compile(rf"{_CUE}(?:(?P<s2>{_SURNAME}),\s+(?P<g2>{free}){initials}(?=\s*[,;]?\s+[a-zà-ÿ])|(?P<g>{free}){initials}\s+(?P<s>{_SURNAME}))")

    def _named(self, text: str, cues: set[str]) -> Iterator[tuple[int, int, str, str]]:
        """start, end, given and family name of every proposal."""
        for m in self.given.finditer(text):
            if text[m.start() - 1 : m.start()] == "-":
                continue  # the second part of a given or family name
            hit = self.ahead.match(text, m.start())
            if hit:
                yield m.start(), hit.end(), hit["g"], hit["s"]
            back = _LISTED_BEFORE.search(text, max(0, m.start() - 70), m.start())
            if back and not (hit and fold(hit.group()) in self.known):
                g = self.listed.match(text, m.start())
                if g:
                    yield back.start("s"), g.end(), g["g"], back["s"]
        for at in {m.start() for w in cues for m in _CUE_PLACES[w].finditer(text)}:
            m = self.cued.match(text, at)
            if not m or (m["role"] and not m["link"] and not _OWN.search(text, max(0, at - 14), at)):
                continue
            side = "" if m["g"] else "2"
            if m["g" + side].casefold() not in _NO_NAMES and m["s" + side].split()[-1].casefold() not in _NO_NAMES:
                yield m.start("g" if m["g"] else "s2"), m.end(), m["g" + side], m["s" + side]

    def spans(self, text: str | None) -> list[Span]:
        if not text:
            return []
        found: list[Span] = []
        digits = _ANY_DIGIT.search(text)
        if "@" in text:
            found += [Span(m.start(), m.end(), "email", 0.95) for m in _EMAIL.finditer(text)]
        low = text.lower()
        if _HAS_MARKED.search(text):
            found += [Span(m.start(), m.end(), "email", 0.95) for m in _EMAIL_MARKED.finditer(text)]
        if any(x in low for x in ("dot", "punkt", "point")) and _HAS_SPOKEN.search(text):
            found += [Span(m.start(), m.end(), "email", 0.9) for m in _EMAIL_SPOKEN.finditer(text)]
        if digits:
            if _HAS_ID.search(text):
                found += self._ids(text)
            if _HAS_PHONE.search(text):
                found += self._phones(text)
            found += self._addresses(text)
        for c in _APART:  # str.translate is slow on letters beyond ASCII
            low = low.replace(c, " ")
        words = low.split()
        if sum(map(_DIGIT_SET.__contains__, words)) >= 7:
            found += [Span(m.start(), m.end(), "phone", 0.8) for m in _PHONE_SPOKEN.finditer(text)]
        found += self._names(text, _CUE_WORDS.intersection(words))
        kept: list[Span] = []
        for s in sorted((s for s in found if s.score >= ACCEPT), key=lambda s: (-round(s.score, 2), s.start - s.end, s.start)):
            if all(s.end <= k.start or s.start >= k.end for k in kept):
                kept.append(s)
        return sorted(kept)

    def _ids(self, text: str) -> Iterator[Span]:
        for pattern, base in _IDS:
            for m in pattern.finditer(text):
                before = text[max(0, m.start() - 45) : m.start()]
                plain = re.sub(r"\W", "", m.group())
                score = base + 0.15 * (luhn(plain) if plain.isdigit() else mod97(plain)) + 0.15 * (plain.isdigit() and mod97(plain))
                score += 0.35 if _ID_NEAR.search(before) or _ID_NEAR.search(text[m.end() : m.end() + 20]) else -0.1
                if _NOT_PERSONAL.search(before):
                    score -= 0.5
                yield Span(m.start(), m.end(), "id_number", min(score, 0.93))
        for pattern, valid, base in _CHECKED:
            for m in pattern.finditer(text):
                end = m.end()
                while not valid(text[m.start() : end]) and " " in text[m.start() : end] and valid is iban:
                    end = text.rindex(" ", m.start(), end)  # a word in capitals may follow
                if valid(text[m.start() : end]):
                    near = _ID_NEAR.search(text[max(0, m.start() - 45) : m.start()]) or _ID_NEAR.search(text[end : end + 20])
                    yield Span(m.start(), end, "id_number", min(base + 0.35 * bool(near), 0.96))

    def _phones(self, text: str) -> Iterator[Span]:
        for pattern, base in _PHONES:
            for m in pattern.finditer(text):
                n = sum(c.isdigit() for c in m.group())
                before = text[max(0, m.start() - 40) : m.start()]
                score = base + 0.1 if 9 <= n <= 15 else 0.0
                if _NOT_PERSONAL.search(before):
                    score -= 0.5
                if _ID_NEAR.search(before[-30:]):
                    score -= 0.2
                yield Span(m.start(), m.end(), "phone", score)

    def _addresses(self, text: str) -> Iterator[Span]:
        wanted = (_EN_NUMBERED.search(text), _FR_NUMBERED.search(text), _DE_NUMBERED.search(text), _DE_SQUARE.search(text), _DE_PLACE.search(text))
        for k, (pattern, base) in enumerate(_ADDRESSES):
            if not wanted[k]:
                continue
            for m in pattern.finditer(text):
                start, end = m.span()
                if m.group().endswith(".") and not re.search(r"\b(?:St|Rd|Ave|Dr|Pl|Sq|Ct|Ln|Cl|Gr)\.$", m.group()):
                    end -= 1
                elif m.group().endswith("."):
                    end -= 1  # the full stop of the sentence, not of the short form
                score = base
                if _NOT_STREET.search(m.group()):
                    score -= 0.5
                if _ADDRESS_NEAR.search(text[max(0, start - 32) : start]):
                    score += 0.2
                yield Span(start, end, "address", score)

    def _names(self, text: str, cues: set[str]) -> Iterator[Span]:
        for start, end, given, family in self._named(text, cues):
            full = fold(f"{given} {family}")
            if full in self.known:
                continue
            before, after = text[max(0, start - 30) : start], text[end : end + 40]
            cue = bool(_PERSON_BEFORE.search(before)) + bool(_PERSON_AFTER.search(after))
            score = 0.5 + 0.3 * min(cue, 1) + 0.1 * (cue > 1)
            if not cue and _COLLEAGUE.search(before):
                score -= 0.3  # a member, cut short or misprinted beyond that
            if not cue and any(_near(full, k) for k in self.by_given.get(fold(given), ())):
                score -= 0.3  # a known name, misprinted
            if not cue and (re.match(r"\s*(?:\([^)]*\)\s*)?[:—–]|\s*\[[A-Z]", after) or not before.strip()):
                score -= 0.2  # the label of a speaker
            elif not cue:
                score += 0.1
            yield Span(start, end, "name", score)


def replaced(text: str, spans: list[Span]) -> str:
    """The text with ``[KIND]`` in place of every span; all else stays as it is."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


def _known_names(known: DataFrame, column: str) -> list[str]:
    names = [r[0] for r in known.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_KNOWN + 1).collect()]
    if len(names) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known names")
    return sorted(names)


def find_personal(documents: DataFrame, known: DataFrame, *, id: str, text: str, known_name: str) -> DataFrame:
    """id, kind, surface, start, end (places in characters), score: one row per span of every text.

    ``known`` holds the names that are no cases (at most ``MOST_KNOWN``, shipped with the tasks). Null and
    empty texts have no spans; a null id is kept as null; other columns are ignored.
    """
    names = _known_names(known, known_name)
    key = documents.schema[id].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for batch in batches:
            rows, spans = [], []
            texts = batch.column("text").to_pylist()
            for row, t in enumerate(texts):
                got = finder.spans(t)
                spans += got
                rows += [row] * len(got)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows, pa.int64())),
                    pa.array([s.kind for s in spans], pa.string()),
                    pa.array([texts[r][s.start : s.end] for r, s in zip(rows, spans, strict=True)], pa.string()),
                    pa.array([s.start for s in spans], pa.int32()),
                    pa.array([s.end for s in spans], pa.int32()),
                    pa.array([s.score for s in spans], pa.float64()),
                ],
                ["id", "kind", "surface", "start", "end", "score"],
            )

    return documents.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(find, f"id {key}, kind string, surface string, start int, end int, score double")


def redact(documents: DataFrame, known: DataFrame, *, id: str, text: str, known_name: str) -> DataFrame:
    """id, text with typed placeholders (null stays null), spans (number replaced)."""
    names = _known_names(known, known_name)
    key = documents.schema[id].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [finder.spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([t if t is None else replaced(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()), pa.array([len(s) for s in spans], pa.int32())],
                ["id", "text", "spans"],
            )

    return documents.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(clean, f"id {key}, text string, spans int")
