"""Personal information inside free text, found and replaced by typed placeholders.

Method: format-preserving Feistel pseudonyms. Each piece is found by its form and
context and validated (check digits, announcing words, street forms); its
placeholder carries a pseudonym of the same format: digits are permuted among
digits and letters among letters by one keyed Feistel network over the mixed
radix of the value, birth dates within the days of their century, and check
characters are computed again, keeping a right one right. Equal values therefore
get equal pseudonyms in every document without any table of values, and whoever
has the key can turn a pseudonym back (``restore``).

Names are found by form and context: a given name of the list with a word that
is no ordinary one, initials with such a word, or two capitalised words that
what stands around them shows to be a person (who is asked, called or thanked,
who says or approves, a title). Ordinary words are those that the public
vocabularies hold in lower case as one token; no list of surnames is used.

A text is read once, in one Python worker, whole; no shuffle is needed.

Defined results: null and empty texts have no pieces and stay as they are; of
overlapping finds the earlier kind in the order email, identity number, address,
phone, name wins; a piece that occurs twice in a text is two pieces; columns
other than key and text are untouched.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import hmac
import math
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import lexicon
from palimpsest.llm.tokenize import TOKENIZERS

AT = r"(?:\s*[\[(\{<]\s*at\s*[\])\}>]\s*|\s+at\s+)"
DOT = r"(?:\s*[\[(\{<]\s*dot\s*[\])\}>]\s*|\s+dot\s+)"
EMAIL = regex.compile(
    r"(?<![\w.+\-])[\w.+\-]*\w@(?:[\w\-]+\.)+\p{L}{2,}(?![\w\-]|:\w|\.\w)"
    rf"|(?<![\w.+\-])[\w.+\-]*\w(?:\s*[\[(\{{<]\s*at\s*[\])\}}>]\s*)[\w\-]+(?:(?:{DOT}|\.)[\w\-]+)+"
    rf"|(?<![\w.+\-])[\w.+\-]*\w\s+at\s+[\w\-]+(?:{DOT}[\w\-]+)+",
    regex.I,
)
#: What any address without its sign has.
MASKED = re.compile(r"[\[({<]\s*(?:at|dot)\s*[\])}>]|\sdot\s")
#: Words that announce a person's number, by kind of number.
ANNOUNCED = (
    r"(?:ssn|social[ -]security(?: (?:number|no\.?))?|ni[ -]number|nino|national insurance(?: (?:number|no\.?))?|dni|nif|nie|passport(?: (?:number|no\.?))?"
    r"|resident id(?:entity)?(?: (?:number|card))?|id card|identity (?:card|number)|身份证(?:号码?)?|personalausweis|reisepass|pasaporte|护照)"
)
ID_FORMS = r"(?:\d{17}[\dXx]|\d{3}[- ]\d{2}[- ]\d{4}|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]|[XYZxyz]-?\d{7}-?[A-Za-z]|\d{8}-?[A-Za-z]|[A-Za-z]{1,2}\d{7,8}|\d{9})"
ID_AFTER_WORD = regex.compile(rf"(?<!\w){ANNOUNCED}(?:[\s:(=#,]|is|was|are|given|in|the|chat|no\.?|number|of|my|her|his|their){{0,12}}(?<![\w])({ID_FORMS})(?![\w]|-\d)", regex.I)
RESIDENT = regex.compile(r"(?<![\w.-])\d{17}[\dXx](?![\w]|-\d)")
#: What a long number may count or name when it is no person's.
THING = regex.compile(r"(?:order|event|invoice|trace|shipment|batch|ticket|parcel|sku|serial|part|tag|code|account|tracking|transaction)(?: (?:number|no\.?|id|#))*[\s:#]*$", regex.I)
CAP = r"\p{Lu}[\p{L}'’]+"
PLACE = r"\p{Lu}\p{Ll}[\p{L}'’]*"
TOWN = rf"(?!Social|Passport|Resident|National|Identity|Phone|Tel){PLACE}(?:[ \u00a0-]{PLACE}){{0,2}}"
STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Court|Ct|Avenue|Ave|Drive|Dr|Way|Close|Terrace|Square|Sq|Place|Pl|Boulevard|Blvd|Row|Hill|Gardens|Crescent|Parkway)"
UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Ste|No)(?:\. ?| |(?=\d))|# ?)\w+"
ADDRESS = regex.compile(
    # number first, unit before or after, town, code
    rf"(?<![\w.\-])(?:{UNIT}, )?\d{{1,5}}[a-z]? (?:[NSEW]\.? )?(?:{CAP} ){{1,3}}{STREET}\b\.?(?:,? {UNIT})?(?:, {TOWN})?(?:(?<=\p{{L}}),? (?:\p{{Lu}}{{2}} )?\d{{4,6}}(?![\w\-])|(?<=\p{{L}}),? \p{{Lu}}{{1,2}}\d\w? \d\p{{Lu}}{{2}}\b)?"
    # kind of street first, then its number
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Via|Rue|C/)(?: (?:de|del|la|las|los|el))*(?: {CAP}){{1,3}},? \d{{1,4}}(?:, \d{{1,2}}º ?\p{{L}}?)?(?:, \d{{5}}(?: {TOWN})?)?(?:, {TOWN}(?: \d{{5}})?)?"
    # number first, then the kind of street
    rf"|(?<![\w.\-])\d{{1,4}},? (?:bis )?(?:[Rr]ue|[Bb]oulevard|[Qq]uai|[Ii]mpasse|[Aa]llée|[Aa]venue|[Pp]lace|[Vv]ia)(?: (?:de|du|des|la|le|les|di|del|della))*(?: (?:[dlDL]['’])?{CAP}){{1,3}}(?:, \d{{5}}(?: {TOWN})?)?(?:, {TOWN})?"
    # kind of street joined to its name
    rf"|(?<!\w)(?:{CAP}[ -]){{0,2}}\p{{Lu}}\p{{L}}*(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer) \d{{1,4}}(?: ?[a-z](?!\w))?(?:, \d{{5}}(?: {TOWN})?)?(?:, {TOWN}(?: \d{{5}})?)?"
)
PHONE = regex.compile(
    r"(?<![\w.+/\-])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ ./\-]?\d{2,8}){1,4}"
    r"|00\d{1,3}[ .](?:\(0\) ?)?\d{1,5}(?:[ ./\-]?\d{2,8}){1,3}|00[1-9]\d{9,13}"
    r"|\(0?\d{2,4}\)[ ]?\d{3,4}[ .\-]\d{3,5}"
    r"|0\d{1,4}[ /\-]\d{3,8}(?:[ \-]\d{2,5}){0,2}"
    r"|\d{3}([.\-])\d{3}\1\d{4})(?![\w]|[.\-/]\d)"
)
CALLED = regex.compile(r"(?<!\w)(?:tel|phone|call|text|mobile|number is|fax)[\s.:=]*((?<![\w.])\d{10,11})(?![\w]|[.\-]\d)", regex.I)
#: Nouns and marks of systems and directions that follow a given name in names of things.
THINGS = frozenset(
    """relay retry fan-out fanout east west north south edge core main primary secondary replica backup gateway queue server cluster service node
    pipeline bridge branch module bot build release worker router cache index street road lane avenue court hall tower house park bay river
    project lake county university college institute foundation prize award station airport hotel""".split()
)
#: Words that follow a given name without being a surname.
FOLLOWERS = frozenset(
    """the a an and or but so as at in on of for from to by with about after before over under said says sent asked moved met knows know knew agreed disagreed today
    yesterday tomorrow address phone owner is was are were has had have will would can could may might must never always only just then when
    while who whom whose which that this these those flat wrote told keeps kept thinks thought wants wanted likes likes prefers came went goes maybe
    apparently again now here there also still not never""".split()
)
_names = {n.lower() for n in lexicon.GIVEN_NAMES} | {n.lower() for n in lexicon.NICKNAMES} | {n.lower() for v in lexicon.NICKNAMES.values() for n in v.split() if len(n) > 2}
#: The first word of each given name, by which a text is searched for them.
_first_words: dict[str, set[str]] = {}
for _n in _names:
    _first_words.setdefault(_n.split("-")[0], set()).add(_n)
WORDS = re.compile(r"[^\W\d_]+")
WORD = r"\p{L}[\p{L}'’]*(?:-\p{L}[\p{L}'’]*)*"
AFTER = regex.compile(rf"((?:\s\p{{L}}\.){{0,2}})\s((?:(?:van|von|de|der|den|da|di|al|bin|la)\s){{0,2}})({WORD})", regex.I)
BEFORE = regex.compile(rf"({WORD})(,?)\s$")
INITIAL = regex.compile(rf"(?<![\w.@'’\-])((?:\p{{L}}\.\s?){{1,3}})\s?({WORD})", regex.I)
LAST_INITIAL = re.compile(r",?\s((?:[^\W\d_]\.){1,2})(?=[\s,;)\"'’]|$)")
LAST_WORD = regex.compile(rf"(?<![\w@.\-])({WORD})$")
SHORT_GIVEN = regex.compile(rf"(?<![\w@.\-])(\p{{Lu}}\p{{Ll}}{{1,3}})\.\s({WORD})")
#: Two capitalised words, and perhaps initials between them.
TWO = regex.compile(rf"(?<![\w@.'’\-/])(\p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?)((?: \p{{Lu}}\.){{0,2}}) ((?:(?:van|von|de|der|den|da|di|al|bin|la) ){{0,2}})(\p{{Lu}}['’]?\p{{L}}*\p{{Ll}}(?:-\p{{Lu}}\p{{Ll}}+)?)(?![\w@]|-\w)")
CAPITALS = re.compile(r"[A-Z\u00c0-\u00de\u0100-\u017f]\S* (?:\S{1,3} ){0,2}[A-Z\u00c0-\u00de\u0100-\u017f]")
#: Words before a person who is asked, met, thanked or named, and those that only may stand there.
ASKED = frozenset(
    """ask asked asking tell told telling call called calling contact contacted email emailed mail mailed ping pinged cc bcc meet met meeting invite invited thank thanks
    dear hi hello hey attn regards sincerely signed named colleague manager owner author reviewer mr mrs ms miss dr prof sir madam herr frau fräulein señor señora don doña
    monsieur madame i'm am frag frage fragen traf trafen sagte pregunta pregunte pregunté llama llamó dijo""".split()
)
MAYBE = frozenset("with from by to for is as mit von bei con de per avec".split())
#: Words after a person who says or does something that things do not.
SAYS = frozenset(
    """said says say saying called calls approved approves asked asks wrote writes told tells thinks thought agreed agrees knows knew wants wanted prefers likes liked reported
    replied replies answered answers confirmed suggested suggests proposed joined left signed mentioned mentions explained explains complained lives lived moved phoned emailed
    disagreed objected apologised apologized reminded insisted promised hopes hoped believes believed loves hates sagte sagt meint schrieb rief dijo dice llamó escribió""".split()
)
#: Words before places and things.
PLACED = frozenset("the a an in at near around of on into module project team room branch version ticket release der die das im am el la los las en le les".split())
_prefixes = frozenset(n[:i] for n in _names for i in range(2, 5) if len(n) > i)


@lru_cache(maxsize=4)
def ordinary_words(folder: str = TOKENIZERS) -> frozenset[str]:
    """Words that the public vocabularies hold in lower case as one token: some 40,000."""
    out = set()
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(os.path.join(folder, name), "rb") as f:
            for line in f:
                word = base64.b64decode(line.split()[0])
                if word[:1] == b" ":
                    try:
                        word = word[1:].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(word) > 2 and word.isalpha() and word.islower():
                        out.add(word)
    return frozenset(out - _names)


@lru_cache(maxsize=4096)
def _given(first: frozenset[str]) -> regex.Pattern:
    """The expression of the given names that begin with these words."""
    names = sorted({n for f in first for n in _first_words[f]}, key=lambda n: (-len(n), n))
    return regex.compile(r"(?<![\w@.'’\-])(?:" + "|".join(map(re.escape, names)) + r")(?![\w@]|-\p{L}|\.\p{L}|['’](?!s\b))", regex.I)


def resident_ok(number: str) -> bool:
    """Check digit and birth date of an 18-character resident number (weights are powers of 2 modulo 11)."""
    total = sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(number[:17]))
    month, day = int(number[10:12]), int(number[12:14])
    return "10X98765432"[total % 11] == number[17].upper() and 1 <= month <= 12 and 1 <= day <= 31 and number[6:8] in ("18", "19", "20")


def _clean(word: str) -> str:
    return regex.sub(r"['’]s$", "", word, flags=regex.I)


def _plain_word(low: str, ordinary: frozenset[str]) -> bool:
    """Whether a word in lower case is an ordinary one: it, or all its parts, are known words."""
    known = lambda w: w in ordinary or len(w) < 3 or any(w.endswith(e) and (w[: -len(e)] in ordinary or w[: -len(e)] + "e" in ordinary) for e in ("s", "es", "d", "ed", "ing"))
    return low in FOLLOWERS or low in THINGS or all(map(known, low.split("-")))


def find_names(text: str, taken: bytearray, ordinary: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Spans of persons' names outside taken characters."""
    found: list[tuple[int, int]] = []

    def put(a: int, b: int) -> bool:
        if any(taken[a:b]) or any(a < y and x < b for x, y in found):
            return False
        found.append((a, b))
        return True

    def surname(word: str, given_cap: bool, loose: bool) -> bool:
        """A word that is no ordinary one, or in capitals after a capitalised given name."""
        w = _clean(word)
        low = w.lower()
        if len(w) < 3 or low in FOLLOWERS or low in THINGS:
            return False
        if _plain_word(low, ordinary):
            return w[0].isupper() and loose and given_cap
        return True

    thing_next = lambda b: (m := regex.match(rf"\s({WORD})", text, pos=b)) and m[1].lower() in THINGS
    first = frozenset(_first_words.keys() & set(WORDS.findall(text.lower())))
    given = _given(first) if first else None
    for m in given.finditer(text) if given else ():
        a, b = m.span()
        if any(taken[a:b]) or any(x <= a < y for x, y in found):
            continue
        cap = text[a].isupper()
        n = AFTER.match(text, b)
        if n and not any(taken[n.start() : n.end()]) and surname(n[3], cap, cap or n[3][0].isupper()) and _clean(n[3]).lower() not in _names:
            if not (_plain_word(_clean(n[3]).lower(), ordinary) and thing_next(n.end())):
                put(a, n.start(3) + len(_clean(n[3])))
                continue
        p = BEFORE.search(text, max(0, a - 60), a)
        if p and not any(taken[p.start() : p.end()]) and p[1].lower() not in _names and len(p[1]) > 3:
            if not _plain_word(_clean(p[1]).lower(), ordinary) and p[1][0].isupper() == cap:
                put(p.start(1), b)
    if "." in text:
        for m in INITIAL.finditer(text):
            w = _clean(m[2])
            if len(w) > 4 and not _plain_word(w.lower(), ordinary) and (m[1][0].isupper() and w[0].isupper() or w.islower() and m[1].islower()):
                put(m.start(), m.start(2) + len(w))
        for m in LAST_INITIAL.finditer(text):
            w = LAST_WORD.search(text, max(0, m.start() - 60), m.start())
            if w and m[1][0].isupper() and w[1][0].isupper() and len(w[1]) > 4 and w[1].lower() not in _names and not _plain_word(w[1].lower(), ordinary):
                put(w.start(), m.end(1) - 1)  # without the last full stop
        for m in SHORT_GIVEN.finditer(text):
            w = _clean(m[2])
            if m[1].lower() in _prefixes and w[0].isupper() and len(w) > 5 and not _plain_word(w.lower(), ordinary) and m[1].lower() not in lexicon.TITLES:
                put(m.start(), m.start(2) + len(w))
    if CAPITALS.search(text):
        for a, b in _two_words(text, ordinary):
            put(a, b)
    yield from found


def _two_words(text: str, ordinary: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Two capitalised words that their context shows to be a person's name."""
    hits = list(TWO.finditer(text, overlapped=True))
    for m in hits:
        one, two = m[1].lower(), _clean(m[4]).lower()
        if {one, two} & (THINGS | FOLLOWERS | ASKED | PLACED) or len(two) < 3:
            continue
        before, after = LAST_WORD.search(text[max(0, m.start() - 30) : m.start()].rstrip(" ,")), regex.match(rf"(?:['’]s)?,?\s({WORD})", text, pos=m.start(4) + len(_clean(m[4])))
        prior, follows = before[1].lower() if before else "", after[1].lower() if after else ""
        if regex.search(r"[.:]\s$", text[max(0, m.start() - 2) : m.start()]):
            title = regex.search(r"(\w+)[.:]\s$", text[max(0, m.start() - 14) : m.start()])
            prior = title[1].lower() if title and (title[1].lower() in lexicon.TITLES or title[1].lower() in ("cc", "bcc", "attn", "contact")) else ""
            prior = "dr" if prior in lexicon.TITLES else prior
        joined = any(o is not m and (text[o.end() : m.start()] in (" and ", " & ", " und ", " y ", " et ") or text[m.end() : o.start()] in (" and ", " & ", " und ", " y ", " et ")) for o in hits)
        odd = (not _plain_word(one, ordinary)) + (not _plain_word(two, ordinary))
        score = odd + 2 * (prior in ASKED) + (prior in MAYBE or joined) + 2 * (follows in SAYS) - 2 * (prior in PLACED) - 3 * (follows in THINGS)
        if odd and score >= 3:
            yield m.start(), m.start(4) + len(_clean(m[4]))


def find_pii(text: str | None, ordinary: frozenset[str] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each piece, in order. ``ordinary``: see ``ordinary_words``."""
    if not text:
        return []
    if ordinary is None:
        ordinary = ordinary_words()
    taken = bytearray(len(text))
    out: list[tuple[int, int, str]] = []

    def put(a: int, b: int, kind: str) -> None:
        if a < b and not any(taken[a:b]):
            out.append((a, b, kind))
            taken[a:b] = b"\x01" * (b - a)

    low = text.lower()
    if "@" in text or MASKED.search(low):
        for m in EMAIL.finditer(text):
            put(*m.span(), "email")
    for m in ID_AFTER_WORD.finditer(text):
        n = m[1]
        if not (len(n) == 18 and n[:17].isdigit()) or resident_ok(n):
            put(*m.span(1), "id_number")
    for m in RESIDENT.finditer(text):
        if resident_ok(m[0]) and not THING.search(text, max(0, m.start() - 40), m.start()):
            put(*m.span(), "id_number")
    for m in ADDRESS.finditer(text):
        put(*m.span(), "address")
    for m in PHONE.finditer(text):
        put(*m.span(), "phone")
    for m in CALLED.finditer(text):
        put(*m.span(1), "phone")
    for a, b in find_names(text, taken, ordinary):
        put(a, b, "person_name")
    return sorted(out)


def _round(key: bytes, i: int, n: int, half: int, size: int) -> int:
    return int.from_bytes(hmac.new(key, b"%d|%d|%d" % (i, n, half), hashlib.sha256).digest()[:16], "big") % size


def feistel(value: int, left: int, right: int, key: bytes, rounds: int = 8) -> int:
    """A keyed permutation of 0 .. left * right - 1 by an alternating Feistel network."""
    a, b = divmod(value, right)
    for i in range(rounds):
        if i % 2 == 0:
            a = (a + _round(key, i, b, 0, left)) % left
        else:
            b = (b + _round(key, i, a, 1, right)) % right
    return a * right + b


def unfeistel(value: int, left: int, right: int, key: bytes, rounds: int = 8) -> int:
    a, b = divmod(value, right)
    for i in reversed(range(rounds)):
        if i % 2 == 0:
            a = (a - _round(key, i, b, 0, left)) % left
        else:
            b = (b - _round(key, i, a, 1, right)) % right
    return a * right + b


def _walk(value: int, size: int, key: bytes, way: Callable, ok: Callable[[int], bool] = lambda v: True) -> int:
    """A permutation of the values below ``size`` for which ``ok`` holds, by walking the Feistel cycle until one is met."""
    left = math.isqrt(size)
    right = -(-size // left)
    while True:
        value = way(value, left, right, key)
        if value < size and ok(value):
            return value


def _digits(value: str) -> list[int]:
    return [26 if c.isalpha() else 10 for c in value]


def _number(value: str) -> int:
    n = 0
    for c in value:
        n = n * 26 + ord(c.lower()) - 97 if c.isalpha() else n * 10 + int(c)
    return n


def _written(n: int, like: str) -> str:
    out = []
    for c in reversed(like):
        n, r = divmod(n, 26 if c.isalpha() else 10)
        out.append((chr(97 + r).upper() if c.isupper() else chr(97 + r)) if c.isalpha() else str(r))
    return "".join(reversed(out))


def _permute(value: str, key: bytes, way: Callable = feistel, ok: Callable[[str], bool] | None = None) -> str:
    """ASCII digits and letters permuted among the strings of their form, for which ``ok`` stays what it was."""
    if not value:
        return value
    size = math.prod(_digits(value))
    want = ok(value) if ok else None
    return _written(_walk(_number(value), size, key, way, (lambda v: ok(_written(v, value)) == want) if ok else lambda v: True), value)


#: Check characters of resident numbers and of DNI and NIE.
RESIDENT_CHECK = "10X98765432"
DNI_CHECK = "TRWAGMYFPDXBNJZSQVHLCKE"


def _resident_check(head: str) -> int:
    return sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(head)) % 11


def _checked(head: str, last: str, new: str, check: str, index: Callable[[str], int]) -> str:
    """The check character of the new head: right if the old one was, else off by as much."""
    off = (check.index(last.upper()) - index(head)) % len(check)
    c = check[(index(new) + off) % len(check)]
    return c.lower() if last.islower() else c


def _social_ok(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _dni_index(head: str) -> int:
    return int({"x": "0", "y": "1", "z": "2"}.get(head[0].lower(), head[0]) + head[1:]) % 23


def _id_number(c: str, key: bytes, way: Callable) -> str:
    """An identity number's letters and digits, permuted within what its kind allows."""
    if len(c) == 18 and c[:17].isdigit():
        first = datetime.date(int(c[6:8]) * 100, 1, 1) if int(c[6:8]) else None
        try:
            born = (datetime.date(int(c[6:10]), int(c[10:12]), int(c[12:14])) - first).days if first else None
        except ValueError:
            born = None
        if born is not None:
            days = (datetime.date(first.year + 100, 1, 1) - first).days
            body = _permute(c[:6] + c[14:17], key, way)
            head = body[:6] + (first + datetime.timedelta(_walk(born, days, key, way))).strftime("%Y%m%d") + body[6:]
            return head + _checked(c[:17], c[17], head, RESIDENT_CHECK, _resident_check)
    if re.fullmatch(r"(?:\d|[XYZxyz])\d{7}[A-Za-z]", c) and c[-1].upper() in DNI_CHECK:
        if c[0].isalpha():
            n = _walk("xyz".index(c[0].lower()) * 10**7 + int(c[1:8]), 3 * 10**7, key, way)
            new = ("XYZ" if c[0].isupper() else "xyz")[n // 10**7] + f"{n % 10**7:07d}"
        else:
            new = _permute(c[:8], key, way)
        return new + _checked(c[:8], c[8], new, DNI_CHECK, _dni_index)
    if re.fullmatch(r"[A-Za-z]{2}\d{6}[A-Da-d]", c):
        n = _walk(_number(c[:8]) * 4 + "abcd".index(c[8].lower()), 26 * 26 * 10**6 * 4, key, way)
        return _written(n // 4, c[:8]) + ("ABCD" if c[8].isupper() else "abcd")[n % 4]
    return _permute(c, key, way, _social_ok if re.fullmatch(r"\d{9}", c) else None)


def _format_preserved(value: str, kind: str, secret: bytes, way: Callable) -> str:
    k = hmac.new(secret, kind.encode(), hashlib.sha256).digest()
    fits = (lambda c: c.isascii() and c.isalnum()) if kind == "id_number" else lambda c: c.isascii() and c.isdigit()
    keep = 0
    if kind == "phone":  # the sign and the zeros that say how to dial stay
        keep = re.match(r"[+(]*(?:00?)?", value).end()
    at = [i for i in range(keep, len(value)) if fits(value[i])]
    core = "".join(value[i] for i in at)
    new = _id_number(core, k, way) if kind == "id_number" else _permute(core, k, way)
    out = list(value)
    for i, c in zip(at, new):
        out[i] = c
    return "".join(out)


@lru_cache(maxsize=100_000)
def pseudonym(value: str, kind: str, key: bytes) -> str:
    """A value of the same format: digits stay digits, letters letters of their case, everything else stays.

    A right check character stays right (resident numbers, DNI, NIE), a birth
    date stays a date of its century, a possible SSN stays possible. Emails and
    names get a keyed tag; equal ones (without case) get the same.
    """
    if kind in ("email", "person_name"):
        return hmac.new(key, f"{kind}|{' '.join(sorted(regex.findall(r'[\p{L}\p{N}]+', value.lower())))}".encode(), hashlib.sha256).hexdigest()[:8]
    return _format_preserved(value, kind, key, feistel)


def restore(value: str, kind: str, key: bytes) -> str:
    """The value of a pseudonym of numbers (identity numbers, phones)."""
    return _format_preserved(value, kind, key, unfeistel)


def redact(text: str | None, key: bytes, ordinary: frozenset[str] | None = None) -> str | None:
    """The text with each piece as ``[KIND pseudonym]``; of an address only its numbers stay as pseudonyms."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_pii(text, ordinary):
        value = text[a:b]
        if kind == "address":
            shown = "-".join(regex.findall(r"\d+", pseudonym(value, kind, key))) + "-" + hmac.new(key, value.lower().encode(), hashlib.sha256).hexdigest()[:6]
        else:
            shown = pseudonym(value, kind, key)
        out += [text[at:a], f"[{kind.upper()} {shown}]"]
        at = b
    return "".join(out) + text[at:]


def pii_pieces(df: DataFrame, key: str, text: str, *, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, pii_kind, found_text, start) of each piece. The ordinary words, some 400 kB, are read on the driver and broadcast."""
    kind = df.schema[key].dataType.simpleString()
    words = df.sparkSession.sparkContext.broadcast(ordinary_words(tokenizers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows, kinds, texts, starts = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for a, b, k in find_pii(t, words.value):
                        rows.append(i), kinds.append(k), texts.append(t[a:b]), starts.append(a)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(starts, pa.int32())], ["k", "pii_kind", "found_text", "start"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, pii_kind string, found_text string, start int").withColumnRenamed("k", key)


def redact_column(df: DataFrame, key: str, text: str, secret: bytes, *, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, redacted) with every piece replaced."""
    if not secret:
        raise ValueError("pseudonyms need a secret key")
    kind = df.schema[key].dataType.simpleString()
    words = df.sparkSession.sparkContext.broadcast(ordinary_words(tokenizers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([redact(t, secret, words.value) for t in part.column(1).to_pylist()], pa.string())], ["k", "redacted"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, redacted string").withColumnRenamed("k", key)


def earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory once: the earliest row of its id."""
    m = spark.read.parquet(f"{sf_dir}/memories.parquet").select("id", "content", "loaded_at")
    one = m.groupBy("id").agg(F.min(F.struct(F.col("loaded_at").isNull().alias("x"), "loaded_at", "content")).alias("r"))
    return one.select(F.col("id").alias("memory_id"), F.col("r.content").alias("content"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_pieces(earliest(spark, sf_dir), "memory_id", "content").select("memory_id", "pii_kind", "found_text").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory's content with placeholders, under the key of the setting; where none is set, under a new random key that is kept nowhere."""
    secret = spark.conf.get("spark.palimpsest.pii.key", None)
    return redact_column(earliest(spark, sf_dir), "memory_id", "content", secret.encode() if secret else os.urandom(32))
