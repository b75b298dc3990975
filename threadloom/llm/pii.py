"""Surrogates for personal data: keyed, type-consistent, one for one.

Found are e-mail addresses, telephone numbers (separated, with a country code or the trunk's zero, or after a word such as ``phone``), payment cards, US social security numbers, IBANs, IPv4, IPv6 and MAC
addresses, credentials, and persons named after a title or a label or with a well-known given name.  Every mention is reduced to a canonical value, so that
mentions of one entity agree however they are written, and an HMAC of kind and value under the key draws the
surrogate; it is then written in the mention's own format: separators, case, script, check digits, gender.  Names
are replaced word by word, so ``Ms. Ada Byron`` and a later ``Byron`` stay the same person, and a word of a name is one
entity in the whole corpus, whatever title or place it has; its gender is that on which all titles agree.

No two values may share a surrogate, and none may be a value that occurs.  All distinct values of the corpus are
drawn once and checked by aggregation and joins; losers draw again with the next attempt until nothing collides.
Texts are searched once: what is found is written beside them, and only documents that hold something are visited again,
with the values on which they need to be told more than they say themselves (a later attempt, another gender).

The key is a secret of whoever runs this: the queries take it from ``spark.threadloom.pii.key``.  Where that is not set, it is
drawn anew for each application, so surrogates can't be recomputed from the code, nor do they agree between runs.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The key where none is set: this application's own.
KEY = secrets.token_bytes(32)
KEY_SETTING = "spark.threadloom.pii.key"
MAX_ATTEMPTS = 64

_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])")
_NUMBERS = re.compile(r"(?<![\w.@+(-])[+(]?\(?\d[\d ().:/-]{5,}\d(?!\w)")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\d)")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}(?!\d)")
_SSN = re.compile(r"(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
_IP4 = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_HEXES = re.compile(r"(?<![\w:.-])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?![\w:])|(?<![\w-])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}(?![\w-])")
_TOKENS = re.compile(
    r"(?<!\w)(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?!\w)"
)
_TOKEN_SIGNS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "sk_", "xox", "AIza", "eyJ")
_ASSIGNED = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}([=:])\s{0,3}[\"']?([^\s\"'<>,;]{4,})", re.I)
#: What stands for a credential where there is none.  Fixed values.
_NO_SECRET = frozenset("changeme disabled empty enabled expired false forgotten hidden incorrect invalid missing mandatory necessary needed none null optional password protected redacted required reset secret string undefined unknown username value wrong".split())
_LINE_END = re.compile(r"[.)\]}]?[\"',;]|[.)\]}]?[ \t]*(?:$|[\r\n])")
#: Letters that no word of prose after a colon has.
LONG_WORD = 16
_USERINFO = re.compile(r"(?<=://)[^\s/:@\"'<>]{0,256}:([^\s/@\"'<>]+)@(?=[\w\[])")
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:\s|\\[nr])*+(?:[A-Za-z-]+: [^\n]*\n)*+(?:\s|\\[nr])*+")
_BODY = re.compile(r"((?:[A-Za-z0-9+/=\s]|\\[nr]){16,}+)-----END ")
#: A key's lines where its end is not there: long ones, then one that padding or a digit tells from a word.
_OPEN_BODY = re.compile(r"(?:[A-Za-z0-9+/=]{16,}(?:\s|\\[nr])*+)+(?:[A-Za-z+/]*[0-9=][A-Za-z0-9+/=]*(?!\w))?")
#: Words before a telephone number.  Fixed values.
_CALLED = re.compile(r"(?<!\w)(?:call|cell|fax|fon|handy|mobil|mobile|móvil|phone|portable|sms|tel|telefon|teléfono|telephone|téléphone|text|whatsapp)(?:[ .]{0,2}(?:number|no|nr|num|n°|me at|us at|at|on))?\.?[ ]?[:=#]?[ ]{0,2}([+(]?\d[\d ()./-]{4,}\d)(?![\w-])", re.I)
_DATE = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d)|\d{1,2}[-/.]\d{1,2}[-/.](?:\d\d){1,2}(?!\d)")
_PLAIN = re.compile(r"\+?\(?\d{3}\)?[ .-]?\d{3,4}[ .-]?\d{4}")
#: A number that begins with the trunk's zero, in groups.
_TRUNK = re.compile(r"(?<![\w.,:/+-])\(?0\d{1,4}\)?([ -])\d{2,4}(?:\1\d{2,4}){1,3}(?![\w-]|[.,:/]\d)")
#: Titles and the gender they tell: m, f or n.  Fixed values.
TITLES = {
    "Mr": "m", "Mister": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "Srta": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: Common given names by the gender they tell.  Fixed values.
GIVEN = {
    "m": "Alexander Andrew Anthony Antoine Benjamin Carlos Charles Christopher Daniel David Diego Edward Felix Fernando François Frank Fritz George Hans Heinrich Henry Jacques James Javier Jean Johann John Jonathan Jorge Joseph José Juan Jürgen Karl Kevin Klaus Laurent Luis Manuel Matthew Michael Miguel Nicholas Olivier Pablo Patrick Paul Pedro Peter Philippe Pierre Ricardo Richard Robert Samuel Stefan Stephen Thomas Timothy Uwe William Wolfgang",
    "f": "Alice Amanda Amélie Andrea Angela Anna Anne Barbara Beatriz Brigitte Camille Carmen Catherine Charlotte Christine Claudia Cristina Deborah Elena Elizabeth Emily Emma Florence Françoise Gabriele Hannah Heike Helen Inés Isabel Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucía Margaret Maria María Marie Martina Mary Michelle Monika Nathalie Nicole Olivia Patricia Petra Pilar Rachel Rebecca Sabine Sandra Sarah Sophie Susan Sylvie Teresa Ursula Valérie",
}
_GENDER = {name: gender for gender, names in GIVEN.items() for name in names.split()}
#: Months that are names too, which alone after such a word, or before a number, are months.  Fixed values.
MONTHS = frozenset(("april", "august", "avril", "juin", "june", "julio", "mai", "may", "mayo", "march", "märz"))
#: Words that are family names too: in small letters they are words.  Fixed values.
COMMON = frozenset(
    (
        "abbot archer arrow ash baker ball bank banks barber bell best berry bird bishop black blue bond book booth bow bowman branch bright brook brown brush bull burns bush butcher butler "
        "canon carpenter carter case chance chase church clay cliff close coach cole cook cooper corn cross crow day dean dear drew drum duke ease east english farmer field finch fish fisher "
        "fletcher flint flower flowers ford forest fox frank frost gold good grant grass gray green grey hall hand hard hardy hart heath hill hope horn house hunt hunter jewel joy judge just "
        "kay keen key kind king knight lamb land lane law light little long love low mark marsh martin mason may miles mill miller moon moss nice noble north page paige park parker pike pool "
        "pope porter post potter power price prince public rain read reed rice rich ring rivers road rob rock rose rush sage sand sharp shepherd short silver singer small smart smith snow south "
        "spring star steel stone storm street strong summer swan swift tanner taylor turner walker wall ward waters way weaver well wells west wheeler white wild will winter wise wolf wood woods "
        "worth wright young"
    ).split()
)
_ARTICLE = re.compile(r"(?<!\w)(?:a|an|the|this|that|these|those|my|your|his|her|its|our|their|no|some|any|every|each|very|so|too|as|ein|eine|einen|einem|einer|der|die|das|den|dem|un|une|le|la|les|des|el|los|las|una) \Z", re.I)
_DATED = re.compile(r"(?<!\w)(?:in|on|since|until|till|by|of|last|next|early|late|mid|im|am|seit|bis|ab|en|de|depuis|desde|hasta|le|\d{1,2}\.?) \Z", re.I)
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_CAPITAL = r"(?=[^\W\d_a-z])" + _WORD
#: Up to six words of a name, small ones such as ``van`` between capitalised ones.
_MORE = r"(?: (?:(?:de|del|della|di|da|dos|du|la|le|van|von|der|den|ter|zu|bin|ibn|al) ){0,3}" + _CAPITAL + r")"
_PERSON = re.compile(r"(?<!\w)(" + "|".join(sorted(TITLES, key=lambda t: -len(t))) + r")\.? (" + _CAPITAL + _MORE + r"{0,2})")
_LABELLED = re.compile(r"(?<!\w)(?i:name|full name|contact|attn|patient|customer|employee|author|signed|kontakt|kunde|nom|nombre|cliente)() ?[:=] ?(" + _CAPITAL + _MORE + r"{1,5})")
#: A capitalised word before another, or before an initial: it may be a given name.
_PAIR = re.compile(r"(?<!\w)([A-ZÀ-Þ][a-zß-ÿ]{2,}) (?=[A-ZÀ-Þdvtzbal])")
_KNOWN = re.compile(r"()(" + _CAPITAL + r"(?: [A-Z]\.)?" + _MORE + r"{1,2})")
_SMALL = re.compile(r"\b(?:de|del|della|di|da|dos|du|la|le|van|von|der|den|ter|zu|bin|ibn|al|[A-Z]\.)(?!\w)")

Span = tuple[int, int, str, str]  # first, end, kind, canonical value


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban_valid(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def script(word: str) -> str:
    c = ord(word[0])
    return "greek" if 0x370 <= c < 0x400 else "cyrillic" if 0x400 <= c < 0x530 else "latin" if c < 0x250 else "other"


def _numbers(text: str) -> Iterator[Span]:
    """Cards, numbers of telephones and social security, IPv4 addresses."""
    for run in _NUMBERS.finditer(text):
        at, end = run.span()
        while at < end:
            for kind, pattern in (("ip4", _IP4), ("ssn", _SSN), ("phone", _PHONE), ("card", _CARD)):
                m = pattern.match(text, at, min(len(text), end + 2))
                if not m or m.end() > end:
                    continue
                got, d = m.group(), _digits(m.group())
                if kind == "ip4":
                    if any(len(x) > 1 and x[0] == "0" for x in got.split(".")) or got.startswith(("0.", "127.")):
                        continue
                    yield at, m.end(), kind, got
                elif kind == "phone":
                    if not 8 <= len(d) <= 15:
                        continue
                    yield at, m.end(), kind, "+" + d if got[0] == "+" else "+1" + d
                elif kind == "card":
                    if not (d[0] in "3456" or len(d) == 16 and "2221" <= d[:4] <= "2720") or not luhn(d):
                        continue
                    yield at, m.end(), kind, d
                else:
                    yield at, m.end(), kind, d
                at = m.end()
                break
            else:
                # The next place in the run where a number may begin.
                at += 1
                while at < end and (text[at] not in "+(" and not (text[at].isdigit() and not text[at - 1].isdigit())):
                    at += 1


def _called(text: str) -> Iterator[Span]:
    """Numbers of telephones that a word before them, or the trunk's zero, tells."""
    for m in _CALLED.finditer(text):
        d = _digits(m.group(1))
        verb = m.group()[:4].casefold() in ("call", "cell", "text", "hand", "port")
        if 7 <= len(d) <= 15 and not _DATE.match(m.group(1)) and (not verb or _PLAIN.fullmatch(m.group(1))):
            yield *m.span(1), "phone", "+" + d if m.group(1)[0] == "+" else "+1" + d
    for m in _TRUNK.finditer(text):
        if 10 <= len(d := _digits(m.group())) <= 11:
            yield *m.span(), "phone", "+1" + d


def _is_secret(text: str, m: re.Match) -> bool:
    """Whether a value after a label is a credential: it has a digit, or is assigned, or is all there is on its line, or is no word."""
    sign, value = m.group(1), m.group(2)
    bare = value.rstrip(".)]}")
    if bare.casefold() in _NO_SECRET or len(bare) < 4 or bare[0] in "$%{<[(" or not any(c.isalnum() for c in bare):
        return False
    if any(c.isdigit() for c in bare) or sign == "=" or len(bare) >= LONG_WORD:
        return True
    return len(bare) >= 6 and _LINE_END.match(text, m.start(2) + len(bare)) is not None


def _keys(text: str) -> Iterator[Span]:
    """Bodies of private keys, with headers or without, to their end line or, where that is missing, as far as lines are a key's."""
    for head in _BEGIN.finditer(text):
        m = _BODY.match(text, head.end())
        first, body = (m.span(1)[0], m.group(1)) if m else (head.end(), (_OPEN_BODY.match(text, head.end()) or [""])[0])
        body = re.sub(r"(?:\s|\\[nr])+\Z", "", body)
        if len(body) >= 16:
            yield first, first + len(body), "secret", body


def find(text: str) -> list[Span]:
    """Mentions in order, none overlapping; of two that overlap the earlier, then the longer."""
    found: list[Span] = []
    hidden: set[int] = set()
    if "://" in text:
        for m in _USERINFO.finditer(text):
            found.append((*m.span(1), "secret", m.group(1)))
            hidden.add(m.end(1))
    at = text.find("@")
    while at >= 0:
        b = _DOMAIN.match(text, at + 1)
        if b:
            first = at
            while first and (text[first - 1].isalnum() or text[first - 1] in "_.%+-"):
                first -= 1
            while first < at and text[first] in ".%+-":
                first += 1
            if first < at and at not in hidden:
                found.append((first, b.end(), "email", text[first : b.end()].lower()))
        at = text.find("@", at + 1)
    found.extend(_numbers(text))
    found.extend(_called(text))
    for m in _IBAN.finditer(text):
        s = m.group().replace(" ", "")
        if 15 <= len(s) <= 34 and _iban_valid(s):
            found.append((*m.span(), "iban", s))
    if ":" in text or "-" in text:
        for m in _HEXES.finditer(text):
            s = m.group().lower()
            parts = re.split("[:-]", s)
            if len(parts) == 6 and all(len(p) == 2 for p in parts):
                found.append((*m.span(), "mac", "".join(parts)))
            elif "-" not in s and (s.count(":") == 7 and "::" not in s or s.count("::") == 1 and s.count(":") <= 7 and (s.count(":") > 2 or any(c.isdigit() for c in s))):
                head, _, tail = s.partition("::")
                a, b = head.split(":"), tail.split(":") if tail else []
                found.append((*m.span(), "ip6", ":".join(p.zfill(4) for p in a + ["0"] * (8 - len(a) - len(b)) + b)))
    if any(s in text for s in _TOKEN_SIGNS):
        found.extend((*m.span(), "secret", m.group()) for m in _TOKENS.finditer(text))
    if "=" in text or ":" in text:
        found.extend((*m.span(2), "secret", m.group(2)) for m in _ASSIGNED.finditer(text) if _is_secret(text, m))
    if "PRIVATE KEY" in text:
        found.extend(_keys(text))
    found.extend(_persons(text))
    found.sort(key=lambda s: (s[0], -s[1]))
    out, end = [], 0
    for s in found:
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


def _names_in(words: str) -> list[str]:
    """Words of a name; what follows on a possessive belongs to no name."""
    out = []
    for name in _SMALL.sub(" ", words).split():
        bare = re.sub(r"['’](?:s|S)?\Z", "", name)
        out.append(bare)
        if bare != name:
            break
    return [n for n in out if n]


def _persons(text: str) -> Iterator[Span]:
    kinds: dict[str, str] = {}
    seen: dict[str, int] = {}  # how a name is spelled, and where it is first introduced
    introduced: dict[str, int] = {}
    found = [(m, True) for m in _PERSON.finditer(text)]
    if ":" in text or "=" in text:
        found += [(m, True) for m in _LABELLED.finditer(text)]
    found += [(k, False) for m in _PAIR.finditer(text) if m.group(1) in _GENDER and (k := _KNOWN.match(text, m.start()))]
    for m, sure in found:
        names = _names_in(m.group(2))
        for k, name in enumerate(names):
            what = "family" if k == len(names) - 1 else "given"
            gender = TITLES.get(m.group(1)) or _GENDER.get(names[0], "n")
            kinds.setdefault(name.casefold(), f"{what} {gender} {script(name)}")
            seen[name] = min(m.start(), seen.get(name, m.start()))
            if sure:
                introduced[name.casefold()] = min(m.start(), introduced.get(name.casefold(), m.start()))
    if kinds:
        anywhere = re.compile(r"(?<!\w)(" + "|".join(re.escape(n) for n in sorted(seen, key=lambda n: (-len(n), n))) + r")(?!\w)", re.I)
        words: set[str] = set()  # names that occur as words
        for m in anywhere.finditer(text):
            # The pattern also takes a dotted capital I for an i, which is another letter.
            if (name := m.group().casefold()) in kinds:
                if name in MONTHS and (_DATED.search(text, max(0, m.start() - 12), m.start()) or re.match(r" \d", text[m.end() : m.end() + 2])):
                    continue
                if m.group().islower() and m.group() not in seen:
                    # In small letters it may be a word: of the common ones, before the person is introduced, or after an article.
                    at = introduced.get(name)
                    if at is None or name in COMMON or m.start() < at or _ARTICLE.search(text, max(0, m.start() - 12), m.start()):
                        words.add(name)
                    if name in words:
                        continue
                yield *m.span(), kinds[name], name


def is_name(kind: str) -> bool:
    return kind.count(" ") == 2


def entity(kind: str) -> str:
    """The kind that a mention's surrogate is drawn for: a name's place is none of its own, a family's gender neither."""
    if not is_name(kind):
        return kind
    what, gender, of = kind.split(" ")
    return f"name {gender if what in ('given', 'name') else 'n'} {of}"


class Draw:
    """Numbers from a keyed stream."""

    def __init__(self, key: bytes, *what: str):
        self.state, self.n, self.left = hmac.new(key, "\0".join(what).encode("utf-8", "surrogatepass"), hashlib.sha256), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            h = self.state.copy()
            h.update(self.n.to_bytes(4, "big"))
            self.left, self.n = self.left + h.digest(), self.n + 1
        v, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return v * n >> 32

    def of(self, s: str) -> str:
        return s[self.below(len(s))]


_SYLLABLES = {
    "latin": ("bcdfghjklmnprstvwz", "aeiou", {"m": ("o", "us", "an"), "f": ("a", "ia", "ine"), "n": ("en", "is", "el")}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": ("ор", "ан", "ий"), "f": ("а", "ия", "ина"), "n": ("ко", "ых", "юк")}),
    "greek": ("βγδζκλμνπρστ", "αειου", {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ια"), "n": ("ι", "ου", "ων")}),
}


def _alike(d: Draw, c: str) -> str:
    """Another letter of the same case and block, another digit; else the character itself."""
    if "0" <= c <= "9":
        return d.of("0123456789")
    if "a" <= c <= "z":
        return d.of("abcdefghijklmnopqrstuvwxyz")
    if "A" <= c <= "Z":
        return d.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if c.isalpha():
        block = ord(c) & ~0x3F
        same = [chr(x) for x in range(block, block + 64) if chr(x).isalpha() and chr(x).isupper() == c.isupper() and chr(x).islower() == c.islower()]
        return same[d.below(len(same))]
    return c


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of a canonical value."""
    d = Draw(key, kind, value, str(attempt))
    if kind == "email":
        local, _, domain = value.rpartition("@")
        top = domain.rpartition(".")[2]
        return "".join(_alike(d, c) for c in local) + "".join(d.of("abcdefghijklmnopqrstuvwxyz") for _ in range(attempt)) + f"@mail{d.below(10000)}.example.{top if top in ('com', 'org', 'net') else 'com'}"
    if kind == "phone":
        code = 1 if value.startswith("+1") and len(value) == 12 else min(2, len(value) - 8)
        out = value[1 : 1 + code]
        for k in range(len(value) - 1 - code):
            out += d.of("23456789") if code == 1 and k in (0, 3) else d.of("0123456789")
        return "+" + out
    if kind == "card":
        head = str(2221 + d.below(500)) if value[0] == "2" else value[0]
        body = head + "".join(d.of("0123456789") for _ in value[len(head) + 1 :])
        if not luhn(value):
            return body + d.of("0123456789")
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "ssn":
        area = 1 + d.below(898)
        return f"{area + (area >= 666):03d}{1 + d.below(99):02d}{1 + d.below(9999):04d}"
    if kind == "ip4":
        if re.match(r"10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.", value):
            return "10." + ".".join(str(d.below(256)) for _ in range(3))
        return f"{240 + d.below(15)}." + ".".join(str(d.below(256)) for _ in range(3))
    if kind == "ip6":
        # Groups of zeros stay, so that the short form does; later attempts fill them from the end.
        groups = value.split(":")
        return "2001:0db8:" + ":".join(f"{1 + d.below(65535):04x}" if g != "0000" or k >= 8 - attempt else g for k, g in enumerate(groups) if k > 1)
    if kind == "mac":
        return "02" + "".join(d.of("0123456789abcdef") for _ in range(10))
    if kind == "iban":
        body = "".join(_alike(d, c) for c in value[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "secret":
        keep = next((s for s in (*_TOKEN_SIGNS, "xoxb-", "xoxp-") if value.startswith(s)), "")
        rest, letters = value[len(keep) :], {c for c in value if c.isalpha()}
        if letters <= set("abcdef"):
            return "".join(d.of("0123456789abcdef") if c.isalnum() else c for c in rest)
        return keep + "".join(_alike(d, c) for c in rest)
    _, gender, of = kind.split(" ")
    if of == "other":
        return "".join(_alike(d, c) for c in value) + "".join(_alike(d, value[-1]) for _ in range(attempt))
    onset, vowel, ends = _SYLLABLES[of]
    n = 2 + d.below(2) + attempt
    return "".join(d.of(onset) + d.of(vowel) for _ in range(n)) + d.of(onset) + ends[gender][d.below(3)]


def drawn(kind: str, value: str, attempt: int, key: bytes, draw=surrogate, attempts: int = MAX_ATTEMPTS) -> str:
    """``draw``'s surrogate; after so many attempts, where a kind's format has no free values left, a mark without its format."""
    if attempt < attempts:
        return draw(kind, value, attempt, key)
    return f"[{kind} {hmac.new(key, chr(0).join((kind, value, str(attempt))).encode('utf-8', 'surrogatepass'), hashlib.sha256).hexdigest()[:32]}]"


def written(mention: str, kind: str, new: str) -> str:
    """A canonical surrogate in the format of a mention."""
    if new[:1] == "[" and new[-1:] == "]":
        return new
    if kind in ("phone", "card", "ssn"):
        digits = iter(_digits(new)[-len(_digits(mention)) :])
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        signs = iter(new)
        return "".join(c if c == " " else next(signs) for c in mention)
    if kind == "mac":
        sep = mention[2]
        out = sep.join(new[k : k + 2] for k in range(0, 12, 2))
        return out.upper() if mention.upper() == mention else out
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind in ("ip4", "secret"):
        return new
    if kind == "ip6":
        if "::" in mention:
            runs = sorted(re.finditer(r"(?:(?<=:)0000(?::|$)){1,8}", new), key=lambda m: (-len(m.group()), m.start()))
            new = new[: runs[0].start()] + ":" + new[runs[0].end() :] if runs else new
        if not re.search(r"(?<![0-9A-Fa-f])0[0-9A-Fa-f]{3}", mention):
            new = re.sub(r"(?<![0-9a-f])0{1,3}(?=[0-9a-f])", "", new)
        return new.upper() if mention.upper() == mention else new
    if mention.islower():
        return new
    return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]


def _rewritten(text: str, spans, key: bytes, told, cache: dict | None) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates for ``spans``.  ``told`` gives (attempt, kind to draw for) of values that need it."""
    shown, out, at = [], [], 0
    for first, end, kind, value in spans:
        n, what = (told or {}).get((kind, value)) or (0, entity(kind))
        new = cache.get((what, value, n)) if cache is not None else None
        if new is None:
            new = drawn(what, value, n, key)
            if cache is not None:
                if len(cache) > 100_000:
                    cache.clear()
                cache[what, value, n] = new
        new = written(text[first:end], kind, new)
        out += (text[at:first], new)
        shown.append((first, end, kind, new))
        at = end
    return ("".join(out) + text[at:] if shown else text), shown


def replaced(text: str, key: bytes, told: dict | None = None, cache: dict | None = None) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (first, end, kind, surrogate as written) of each mention in the old text."""
    return _rewritten(text, find(text), key, told, cache)


_FOUND = "array<struct<first:int,end:int,kind:string,value:string>>"
_SHOWN = "array<struct<first:int,end:int,kind:string,surrogate:string>>"


def marked(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs`` but text), ``text, id_, hash_`` and ``found``, the mentions; written to the shared folder."""
    rows = docs.select(common.row_of(docs, *[c for c in docs.columns if c != "text"]), "text", F.col("doc_id").cast("long").alias("id_"), F.xxhash64("text").alias("hash_"))

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        for batch in batches:
            found = [[dict(zip(("first", "end", "kind", "value"), s)) for s in find(t.as_py())] if t.is_valid else [] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=["row", "text", "id_", "hash_", "found"])

    schema = T.StructType(rows.schema.fields + T.StructType.fromDDL(f"found {_FOUND}").fields)
    return common.staged(rows.mapInArrow(run, schema))


def _compared(column: str):
    """Values are case-folded, which turns a final sigma into a plain one; surrogates are not."""
    return F.translate(column, "ς", "σ")


def assigned(found: DataFrame, key: bytes = KEY, draw=surrogate, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """``kind, value, attempt, surrogate`` for distinct ``kind, value`` rows, without collisions within or across kinds.

    A kind with more values than its format has surrogates for gets marks for the rest (see ``drawn``), distinct as well.
    """

    def of(rows: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                new = [drawn(k, v, n, key, draw, attempts) for k, v, n in zip(*cols)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "value", "attempt", "surrogate"])

        return rows.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")

    now = common.staged(of(found.withColumn("attempt", F.lit(0))))
    for _ in range(attempts + 2):
        # Over all kinds: two persons of different roles or genders are not to share a name either.
        drawn_as = now.withColumn("as", _compared("surrogate"))
        twice = drawn_as.groupBy("as").agg(F.min(F.struct("attempt", "kind", "value")).alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1")
        losers = drawn_as.join(twice, "as").where(F.struct("attempt", "kind", "value") != F.col("winner")).select("kind", "value")
        real = now.select(_compared("value").alias("as"))
        taken = drawn_as.join(real, "as", "left_semi").select("kind", "value")
        again = common.staged(losers.union(taken).distinct().withColumn("lost", F.lit(True)))
        if again.isEmpty():
            return now
        marked = now.join(again, ["kind", "value"], "left")
        redone = of(marked.where("lost").withColumn("attempt", F.col("attempt") + 1))
        now = common.staged(marked.where("lost is null").select("kind", "value", "attempt", "surrogate").union(redone))
    raise ValueError("marks of 128 bits collide: the key is not secret, or this is a fault")


def entities(mentions: DataFrame) -> DataFrame:
    """``kind, value, own, drawn`` for distinct ``kind, value`` mentions: the entity's kind as a mention alone tells it, and as all do.

    A word of names is one entity.  Its gender is m or f where all given names that tell one agree, else n.
    """
    kind = F.split("kind", " ")
    named = F.size(kind) == 3
    gender = F.when(kind[0] == "given", kind[1]).otherwise("n")
    own = F.when(named, F.concat_ws(" ", F.lit("name"), gender, kind[2])).otherwise(F.col("kind"))
    each = mentions.select("kind", "value", own.alias("own"), named.alias("named"), gender.alias("gender"), kind[2].alias("script"))
    told = F.when(F.col("gender") != "n", F.col("gender"))
    people = each.where("named").groupBy("value").agg(F.min(told).alias("low"), F.max(told).alias("high"), F.min("script").alias("of"))
    agreed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("n")
    people = people.select(F.col("value").alias("value_"), F.concat_ws(" ", F.lit("name"), agreed, "of").alias("drawn"))
    names = each.where("named").join(people, F.col("value") == F.col("value_")).select("kind", "value", "own", "drawn")
    return names.union(each.where(~F.col("named")).select("kind", "value", "own", F.col("own").alias("drawn")))


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``spans``: first, end, kind and surrogate of each mention.

    Other columns stay as they are (a column ``spans`` is replaced).  A null text stays null and has no spans; rows that
    repeat get equal surrogates.  An empty table stays empty.
    """
    columns = [c for c in docs.columns if c != "spans"]
    rows = marked(docs.select(*[F.col(common.quoted(c)) for c in columns]))
    held = rows.where("size(found) > 0").select("id_", "hash_", F.explode(F.array_distinct(F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))).alias("m")).select("id_", "hash_", "m.kind", "m.value")
    known = common.staged(entities(held.select("kind", "value").distinct()))
    named = assigned(known.select(F.col("drawn").alias("kind"), "value").distinct(), key).select(F.col("kind").alias("drawn"), "value", "attempt")
    told = common.staged(known.join(named, ["drawn", "value"]).where("attempt > 0 or own <> drawn").select("kind", "value", "attempt", "drawn"))
    some = rows.where("size(found) > 0").select("row", "text", "id_", "hash_", "found")
    if told.isEmpty():
        some = some.select("row", "text", "found", F.lit(None).cast("map<string,struct<attempt:int,drawn:string>>").alias("told"))
    else:
        # What a document must be told; few values need it, but the documents that hold those may be many.
        each = held.join(told, ["kind", "value"]).groupBy("id_", "hash_").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\0", "kind", "value"), F.struct("attempt", "drawn")))).alias("told"))
        each = each.select(F.col("id_").alias("of_"), F.col("hash_").alias("with_"), "told")
        some = some.join(each, F.col("id_").eqNullSafe(F.col("of_")) & (F.col("hash_") == F.col("with_")), "left").select("row", "text", "found", "told")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))
        cache: dict = {}
        for batch in batches:
            texts, spans = [], []
            for text, found, more in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                known_ = {tuple(k.split("\0", 1)): (v["attempt"], v["drawn"]) for k, v in more} if more else None
                new, got = _rewritten(text, [tuple(f.values()) for f in found], key, known_, cache)
                texts.append(new)
                spans.append([dict(zip(("first", "end", "kind", "surrogate"), s)) for s in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["row", "text", "spans"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), *T.StructType.fromDDL(f"spans {_SHOWN}").fields])
    none = rows.where("size(found) = 0").select("row", "text", F.array().cast(_SHOWN).alias("spans"))
    out = some.mapInArrow(run, schema).union(none)
    return out.select(*[F.col("text") if c == "text" else common.unpacked(out, [c])[0] for c in columns], "spans")


def key_of(spark: SparkSession) -> bytes:
    """The key that is set for the session, else the application's own."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else KEY


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates under the session's key."""
    out = pseudonymised(common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key_of(spark))
    return out.select("doc_id", "text", F.size("spans").cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["kind"]))), ",").alias("kinds"))
