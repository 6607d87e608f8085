"""Format-preserving pseudonyms for personal data (operator 6).

Values that a rule finds and a check confirms (card numbers by Luhn's sum,
account numbers by their remainder, calendar dates, address parts in range)
are numbered within the set of all values of their format.  A keyed Feistel
network permutes those numbers, walking on until it is back in the set, so a
pseudonym is again a valid value of the same format.  The same value has the
same pseudonym in every document, no two values share one, and whoever holds
the key can turn it back.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import secrets
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, table, text_chunks

ROUNDS = 10
KINDS = ("card", "phone", "ip", "email", "iban", "ssn", "date", "secret")
KEY = "spark.framewise.pii.key"
_DRAWN = secrets.token_bytes(32)
#: Pseudonyms that a task keeps; beyond it the store starts anew.
CACHE = 100_000
#: Longer values, in bytes, are made anew each time.
KEPT = 400


@dataclass(frozen=True)
class PiiOptions:
    """``key``: the secret of the permutation, 16 bytes at least.  ``kinds``: what is replaced."""

    key: bytes
    kinds: tuple[str, ...] = KINDS

    def __post_init__(self) -> None:
        if len(self.key) < 16:
            raise ValueError("the key has 16 bytes at least")

    @classmethod
    def of_session(cls, spark: SparkSession) -> PiiOptions:
        """With the key that the session's configuration names as ``KEY``.

        Without it a key is drawn for this session: pseudonyms then agree
        within the session, and nobody can turn them back after it.
        """
        key = spark.conf.get(KEY, None)
        return cls(_DRAWN if key is None else key.encode())


class Feistel:
    """A keyed permutation of ``0 .. size - 1`` for any size: rounds on two unequal halves, and a walk back into the range."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=64).digest()

    def _round(self, tweak: bytes, i: int, half: int, size: int) -> int:
        text = b"%d:%d:%d:%s" % (size, i, half, tweak)
        return int.from_bytes(hashlib.blake2b(text, key=self.key).digest(), "big")

    def permute(self, x: int, size: int, tweak: bytes = b"", back: bool = False) -> int:
        if size < 2:
            return x
        if size.bit_length() > 400:
            raise ValueError("the format has too many values for one permutation")
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        sign = -1 if back else 1
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if i % 2:
                    right = (right + sign * self._round(tweak, i, left, size)) % b
                else:
                    left = (left + sign * self._round(tweak, i, right, size)) % a
            x = left * b + right
            if x < size:
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = sum(2 * d - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    """The two check digits of an account."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


#: Characters of an account number by country.
_IBAN_LENGTH = {k: int(n) for n, ks in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,TL,SO "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA "
    "30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for k in ks.split(",")}  # fmt: skip
#: Country codes of two digits; 1 and 7 have one, all others three.
_CODES_2 = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Digits after the country code, a trunk 0 not counted; for other codes what makes 8 to 15 digits.
_NATIONAL = {k: range(int(a), int(b) + 1) for k, a, b in (x.split(",") for x in (
    "1,10,10 7,10,10 20,8,10 27,9,9 30,10,10 31,9,9 32,8,9 33,9,9 34,9,9 36,8,9 39,6,11 40,9,9 41,9,9 43,7,11 44,9,10 45,8,8 46,7,10 47,8,8 48,9,9 49,6,11 "
    "51,8,9 52,10,10 54,10,11 55,10,11 56,9,9 57,10,10 60,8,10 61,9,9 62,8,12 63,8,10 64,8,10 65,8,8 66,8,9 81,9,10 82,8,10 84,9,10 86,10,11 90,10,10 91,10,10 "
    "92,9,10 98,10,10 351,9,9 352,6,9 353,7,9 358,6,10 380,9,9 420,9,9 421,9,9 852,8,8 971,8,9 972,8,9").split())}  # fmt: skip


#: Names of the months.  A name in several lists belongs to the first, so that it is read as it was written.
_MONTHS = [x.split() for x in (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "- - - - - - - - sept - - -",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)]
_MONTH_OF: dict[str, tuple[int, int]] = {}
for _i, _names in enumerate(_MONTHS):
    for _month, _name in enumerate(_names, 1):
        if _name != "-":
            _MONTH_OF.setdefault(_name, (_i, _month))


#: One digit in brackets, mostly the trunk 0 in a number with its country code; it stays.
_TRUNK = r"\([0-9]\)"


def _code(digits: str) -> str:
    """The country code of an international number."""
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in _CODES_2 else 3]


def _is_hex(text: str) -> bool:
    return len(text) >= 16 and set(text) <= set(_HEX)


def _national_length(number: str) -> bool:
    """Whether a number that begins with its country code has its country's length."""
    digits = re.sub(_TRUNK + r"|[^0-9]", "", number)
    code = _code(digits)
    return len(digits) - len(code) in _NATIONAL.get(code, range(8 - len(code), 16 - len(code)))


def _refilled(template: str, fill: str, of: str) -> str:
    """``template`` with its characters among ``of`` replaced, in order, by those of ``fill``."""
    chars = iter(fill)
    return "".join(next(chars) if c in of else c for c in template)


class Pseudonyms:
    """Replaces values; each method gives None where the check fails."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.feistel, self.back = Feistel(key), back

    def _digits(self, digits: str, tweak: bytes) -> str:
        return f"{self.feistel.permute(int(digits), 10 ** len(digits), tweak, self.back):0{len(digits)}d}"

    def _classes(self, text: str, tweak: bytes) -> str:
        """Each letter or digit becomes one of its class, hexadecimal texts stay such; other characters stay."""
        in_hex = _is_hex(text)
        while True:
            text = self._parts(text, tweak, in_hex)
            if _is_hex(text) == in_hex:  # else walk on: who turns it back must see the same classes
                return text

    def _parts(self, text: str, tweak: bytes, in_hex: bool) -> str:
        """40 characters at a time, each part tied to those before."""
        of = (lambda c: _HEX) if in_hex else (lambda c: next((k for k in (_LOWER, _UPPER, _DIGITS) if c in k), c))
        out, before, tied = [], hashlib.blake2b(), b""
        for i in range(0, len(text), 40):
            part = text[i : i + 40]
            sets = [of(c) for c in part]
            size, x = 1, 0
            for c, k in zip(part, sets):
                size, x = size * len(k), x * len(k) + k.index(c)
            y = self.feistel.permute(x, size, tweak + tied, self.back)
            made = []
            for k in reversed(sets):
                y, d = divmod(y, len(k))
                made.append(k[d])
            out.append("".join(reversed(made)))
            before.update((out[-1] if self.back else part).encode())
            tied = before.digest()
        return "".join(out)

    def card(self, text: str) -> str | None:
        """13 to 19 digits with a right Luhn sum; the first digit stays, the last is made anew."""
        digits = "".join(c for c in text if c in _DIGITS)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = digits[0] + self._digits(digits[1:-1], b"card" + digits[:1].encode())
        return _refilled(text, body + luhn_digit(body), _DIGITS)

    def phone(self, text: str) -> str | None:
        """An international number of 8 to 15 digits, after 00 of its country's length, whose country code stays; or a national one.

        National numbers are those of North America, area and exchange 200 to
        999, and those of 9 to 12 digits that begin with one 0.
        """
        digits = "".join(c for c in text if c in _DIGITS)
        if text[0] == "+" or digits.startswith("00"):
            lead = "" if text[0] == "+" else "00"
            digits = re.sub(_TRUNK + "|[^0-9]", "", text)[len(lead) :]
            if not 8 <= len(digits) <= 15 or (lead and not (_code(digits) in _NATIONAL and _national_length(text[2:]))):
                return None
            keep = len(_code(digits))
            made = lead + digits[:keep] + self._digits(digits[keep:], b"phone" + digits[:keep].encode())
            before, trunk, after = re.fullmatch(f"(.*?)({_TRUNK}|$)(.*)", text).groups()
            first = sum(c in _DIGITS for c in before)
            return _refilled(before, made[:first], _DIGITS) + trunk + _refilled(after, made[first:], _DIGITS)
        if digits[0] == "0":
            if not 9 <= len(digits) <= 12:
                return None
            size = 10 ** (len(digits) - 2)  # the first digit of the area is not 0
            x = self.feistel.permute(int(digits[1:]) - size, 9 * size, b"phone0", self.back) + size
            return _refilled(text, f"0{x}", _DIGITS)
        lead, area, exchange, line = digits[:-10], int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
        if lead not in ("", "1") or area < 200 or exchange < 200:
            return None
        x = self.feistel.permute(((area - 200) * 800 + exchange - 200) * 10_000 + line, 800 * 800 * 10_000, b"phone-", self.back)
        x, line = divmod(x, 10_000)
        area, exchange = divmod(x, 800)
        return _refilled(text, f"{lead}{area + 200}{exchange + 200}{line:04d}", _DIGITS)

    def ip(self, text: str) -> str | None:
        """Four numbers of 0 to 255 without leading zeros; or an address of version 6 with three groups at least, each of whose figures changes within its class."""
        if ":" in text:
            return self._ip6(text)
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip", self.back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _ip6(self, text: str) -> str | None:
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        if sum(map(bool, text.split(":"))) < 3:
            return None
        sets = [next(k for k in (_DIGITS, "abcdef", "ABCDEF") if c in k) for c in text if c != ":"]
        size, x = 1, 0
        for c, k in zip(text.replace(":", ""), sets):
            size, x = size * len(k), x * len(k) + k.index(c)
        y, made = self.feistel.permute(x, size, b"ip6", self.back), []
        for k in reversed(sets):
            y, d = divmod(y, len(k))
            made.append(k[d])
        return _refilled(text, "".join(reversed(made)), _DIGITS + "abcdefABCDEF")

    def email(self, text: str) -> str | None:
        """The local part changes, letters to letters and digits to digits; the domain stays."""
        local, _, domain = text.partition("@")
        return f"{self._classes(local, b'email' + domain.lower().encode())}@{domain}"

    def iban(self, text: str) -> str | None:
        """Country, two digits and the account, with a remainder of 1 by 97; country and kinds of characters stay."""
        plain = text.replace(" ", "")
        country, account = plain[:2], plain[4:]
        if not 15 <= len(plain) <= 34 or _IBAN_LENGTH.get(country, len(plain)) != len(plain) or iban_digits(country, account) != plain[2:4]:
            return None
        account = self._classes(account, b"iban" + country.encode())
        return _refilled(text, country + iban_digits(country, account) + account, _UPPER + _DIGITS)

    def ssn(self, text: str) -> str | None:
        """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
        area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.feistel.permute(x, 898 * 99 * 9999, b"ssn", self.back), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"

    def date(self, text: str) -> str | None:
        """A day of 1900 to 2099 as year-month-day, day.month.year or month/day/year (day/month/year where only that is a date), or with the month's name.

        The day is permuted once among all days, so every spelling of a day
        gets the same other day; the spelling follows it: a field of one digit
        has two where it takes them, and a month's name is of the list that the
        old one was found in.  So a day turns back, but perhaps with a 0 or another
        list's name.  Day/month/year alone stands apart, as its day must stay above 12.
        """
        at = [m for m in re.finditer(r"[0-9]+|[^\W\d_]+", text) if m[0].lower() not in ("de", "del")]
        parts = [m[0] for m in at]
        named = next((i for i, part in enumerate(parts) if not part.isdigit()), None)
        names, month = (None, 0) if named is None else _MONTH_OF[parts[named].lower()]
        if named is not None:
            order = (2, named, 1 - named)
        elif len(parts[0]) == 4:
            order = (0, 1, 2)
        elif "/" in text and int(parts[0]) <= 12:
            order = (2, 0, 1)
        else:
            order = (2, 1, 0)
        try:
            day = datetime.date(int(parts[order[0]]), month or int(parts[order[1]]), int(parts[order[2]])).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        swapped = "/" in text and order == (2, 1, 0)  # day first, as no month has its number: must stay so
        while True:
            day = _FIRST_DAY + self.feistel.permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, b"date", self.back)
            made = datetime.date.fromordinal(day)
            if not swapped or made.day > 12:
                break
        fields = [""] * 3
        for i, v in zip(order, (made.year, made.month, made.day)):
            fields[i] = f"{v:0{len(parts[i])}d}"
        if names is not None:
            name, old = _MONTHS[names][made.month - 1], parts[named]
            name = _MONTHS[1][made.month - 1] if name == "-" else name
            fields[named] = name.upper() if old.isupper() else name.title() if old.istitle() else name
        out, pos = "", 0
        for m, field in zip(at, fields):
            out, pos = out + text[pos : m.start()] + field, m.end()
        return out

    def secret(self, text: str) -> str | None:
        """A key or the value of 8 characters or more given to a password, token or secret: letters and digits change within their class, a known prefix and all other signs stay."""
        if len(text) < 8:
            return None
        prefix = _secret_prefix(text)
        while True:
            text = prefix + self._classes(text[len(prefix) :], b"secret" + prefix.encode())
            if _secret_prefix(text) == prefix:
                return text


def _secret_prefix(text: str) -> str:
    return next((p for p in ("AKIA", "ASIA", "ghp_", "sk-") if text.startswith(p)), "")


# No pattern reaches over a line feed.  Bytes of letters beyond ASCII count as word characters.
_B, _E = rb"(?<![0-9A-Za-z_\x80-\xff])", rb"(?![0-9A-Za-z_\x80-\xff])"
_YEAR = rb"(?:19|20)[0-9]{2}"
_NAMES = "|".join(sorted((f(n) for n in _MONTH_OF for f in (str.lower, str.title, str.upper)), key=len, reverse=True)).encode()
_PATTERNS = {
    # a value reaches to its closing quote, without quotes to white space
    "secret": rb"(?:(?i:(?<![0-9A-Za-z\x80-\xff])(?:password|passwd|pwd|token|secret(?:[_-]?key)?|api[_-]?key|access[_-]?key)\b[\"']?[ \t]*+[=:][ \t]*+)(?:(?P<quote>[\"'])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\n])++)(?P=quote)|[\"']?(?P<bare>[^\s\"'][^\s]{7,}))|"
    + _B + rb"(?P<key>(?:AKIA|ASIA)[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_\-]{20,})" + _E + rb")",
    # signs before the first letter or digit are not part of the address
    "email": rb"(?<![0-9A-Za-z._%+\-\x80-\xff])[._%+\-]*+(?P<address>[0-9A-Za-z\x80-\xff][0-9A-Za-z._%+\-\x80-\xff]*+@(?:[0-9A-Za-z]++(?:-++[0-9A-Za-z]++)*+\.)+(?:[A-Za-z]{2,}+|xn--[0-9A-Za-z\-]++))(?![0-9A-Za-z\x80-\xff])",
    "iban": _B + rb"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _E,
    "ip": rb"(?<![0-9A-Za-z_.\x80-\xff])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_\x80-\xff]|\.[0-9])|(?<![0-9A-Za-z_:.\x80-\xff])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z_:\x80-\xff])",
    "date": rb"(?<![0-9A-Za-z_/.\-\x80-\xff])(?:" + _YEAR + rb"-[0-9]{1,2}-[0-9]{1,2}|" + _YEAR + rb"/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\." + _YEAR + rb"|[0-9]{1,2}/[0-9]{1,2}/" + _YEAR
    + rb"|[0-9]{1,2}(?:\.? |-)(?:de )?(?:" + _NAMES + rb")(?:\.?,? |-)(?:del? )?" + _YEAR + rb"|(?:" + _NAMES + rb")\.? [0-9]{1,2},? " + _YEAR + rb")(?:(?=T[0-9]{2})|(?![0-9A-Za-z_/\-\x80-\xff]|\.[0-9]))",
    "ssn": rb"(?<![0-9A-Za-z_\-\x80-\xff])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_\-\x80-\xff])",
    "phone": rb"(?<![0-9A-Za-z_+\x80-\xff])(?:\+|00)[1-9][0-9]{0,2}(?:[ .\-]?\([0-9]{1,5}\))?(?:[ .\-][0-9])?(?:[ .\-]?[0-9]{2,4}){2,7}" + _E
    # within a country: North America's, pairs after 0, an area after 0 and the rest
    + rb"|(?<![0-9A-Za-z_+./\-\x80-\xff])(?:(?:1[ .\-])?(?:\([2-9][0-9]{2}\)[ .\-]?|[2-9][0-9]{2}[ .\-])[2-9][0-9]{2}[ .\-][0-9]{4}|0[1-9](?:[ .\-][0-9]{2}){4}"
    + rb"|(?:\(0[1-9][0-9]{0,4}\)[ ./\-]?|0[1-9][0-9]{1,4}[ ./\-])(?:[0-9]{5,8}|[0-9]{3,4}[ \-][0-9]{3,5}|[0-9]{2}(?: [0-9]{2}){2,3}))" + _E + rb"(?![./\-][0-9])",
    "card": rb"(?<![0-9A-Za-z_\-.\x80-\xff])(?:[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})(?![0-9A-Za-z_\-\x80-\xff]|\.[0-9])",
}
#: Where another value than the rest of a phone number may begin: told by the counts of digits alone, which pseudonyms keep.
_OTHER = re.compile(
    rb"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}([\-/])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
    rb"|[0-9]{4}([ \-])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{13,19}|[0-9]{3,4}[ .\-][0-9]{3,4}[ .\-][0-9]{3,4}|[0-9]{3,5}[ /\-][0-9]{5,8}|[0-9]{2}(?:[ .\-][0-9]{2}){4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})(?![0-9])"
)
_SIGNS = string.punctuation.encode() + b" \t"
_TRIGGER = re.compile(rb"[0-9@=:]")


def finder(kinds: tuple[str, ...]) -> re.Pattern[bytes]:
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    return re.compile(b"|".join(b"(?P<%s>%s)" % (k.encode(), p) for k, p in _PATTERNS.items() if k in kinds))


def phone_ends(line: bytes, a: int, b: int) -> list[int]:
    """Where the number that begins at ``a`` may end, the likeliest first: at the country's length, before another value, as late as possible."""
    if line[a : a + 1] != b"+" and line[a : a + 2] != b"00":
        return [b]
    ends = [m.end() for m in re.finditer(rb"[0-9]+", line[a:b])]
    gaps = [m.end() for m in re.finditer(rb"[ .\-]", line[a:b])]
    other = next((g for g in gaps if _OTHER.match(line, a + g) and len(re.sub(rb"[^0-9]", b"", line[a : a + g])) >= 8), b - a)
    return [a + end for end in sorted(ends, key=lambda end: (not _national_length(line[a : a + end].lstrip(b"+0").decode()), end > other, -end))]


def iban_ends(line: bytes, a: int, b: int) -> list[int]:
    """Where the account number that begins at ``a`` may end: after any of its groups, the last first."""
    return [a + m.end() for m in re.finditer(rb"[0-9A-Z]+", line[a:b])][::-1] if line[a : a + 2].decode() in _IBAN_LENGTH else [b]


def secret_ends(line: bytes, a: int, b: int) -> list[int]:
    """The end of a value without the signs that close it or follow it in a sentence, which no pseudonym changes."""
    end = a + len(line[a:b].rstrip(_SIGNS))
    return [end if len(line[a:end].decode()) >= 8 else b]


#: What is replaced of a match, where that is not all of it.
_GROUPS = {"secret": ("quoted", "bare", "key"), "email": ("address",)}
_ENDS = {"phone": phone_ends, "iban": iban_ends, "secret": secret_ends}


class Replacer:
    """Rewrites texts; one in each Python process keeps the pseudonyms it has made."""

    def __init__(self, options: PiiOptions, back: bool = False) -> None:
        self.find, self.kinds = finder(options.kinds), options.kinds
        made = Pseudonyms(options.key, back)
        self.of: dict[str, Callable[[str], str | None]] = {k: getattr(made, k) for k in options.kinds}
        self.cache: dict[tuple[str, bytes], bytes | None] = {}

    def _value(self, kind: str, value: bytes) -> bytes | None:
        if len(value) > KEPT:
            return self._new(kind, value)
        if (kind, value) not in self.cache:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[kind, value] = self._new(kind, value)
        return self.cache[kind, value]

    def _new(self, kind: str, value: bytes) -> bytes | None:
        new = self.of[kind](value.decode())
        return None if new is None else new.encode()

    def _line(self, line: bytes, found: list[str]) -> bytes:
        out, pos, at = [], 0, 0
        while m := self.find.search(line, at):
            kind = next(k for k in self.kinds if m[k] is not None)
            group = next(g for g in _GROUPS.get(kind, (kind,)) if m[g] is not None)
            a, b = m.span(group)
            ends = _ENDS[kind](line, a, b) if kind in _ENDS else [b]
            new, b = next(((new, e) for e in ends if (new := self._value(kind, line[a:e])) is not None), (None, b))
            if new is None:  # not confirmed; another kind may begin after its first number
                at = m.start() + max(1, len(re.match(rb"[0-9A-Za-z]*", line[m.start() : m.end()])[0]))
                continue
            found.append(kind)
            out += [line[pos:a], new]
            pos = at = b
        return b"".join([*out, line[pos:]]) if out else line

    def text(self, text: bytes) -> tuple[bytes, list[str]]:
        """The text rewritten, and the kinds of its values.  Only lines with a digit or one of ``@ = :`` are searched."""
        found: list[str] = []
        out, pos, at = [], 0, 0
        while m := _TRIGGER.search(text, at):
            a = text.rfind(b"\n", at, m.start()) + 1 or at
            b = text.find(b"\n", m.end())
            b = len(text) if b < 0 else b
            if (new := self._line(line := text[a:b], found)) is not line:
                out += [text[pos:a], new]
                pos = b
            at = b
        return (b"".join([*out, text[pos:]]) if out else text), found


_MADE: dict[tuple[PiiOptions, bool], Replacer] = {}


def _replacer(options: PiiOptions, back: bool = False) -> Replacer:
    if (options, back) not in _MADE:
        _MADE[options, back] = Replacer(options, back)
    return _MADE[options, back]


def pseudonymised(docs: DataFrame, options: PiiOptions, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """``doc_id``, the whole ``text`` with pseudonyms, ``n_values`` replaced, and a count ``n_<kind>`` for each kind.

    A null text stays null, an empty one empty, with no values.  Rows that
    repeat an id are rewritten row by row; a null id stays null; an empty table
    gives an empty one; other columns are not read.  One pass without a
    shuffle: pseudonyms depend on key and value alone, so they agree between
    documents, tasks and runs.  ``back`` turns pseudonyms into the values.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_values", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS)])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = _replacer(options, back)
        for batch, texts in text_chunks(batches):
            new, found = zip(*map(replacer.text, texts))
            new = [t if valid else None for t, valid in zip(new, batch.column(1).is_valid().to_pylist())]
            yield record_batch(schema, batch.column(0), pa.array(new, pa.binary()).cast(pa.string()), list(map(len, found)), *([f.count(k) for f in found] for k in KINDS))

    names = "doc_id long, text string, n_values long" + "".join(f", n_{k} long" for k in KINDS)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(replace, names)


def pseudonymise(docs: DataFrame, options: PiiOptions) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_chars`` to match where it is there; rows and other columns stay.

    A null text stays null, an empty one empty; rows that repeat stay, each
    rewritten alike; an empty table stays empty.
    """
    names = docs.columns
    i_text = names.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = _replacer(options)
        for batch, texts in text_chunks(batches):
            new = [replacer.text(t)[0] if valid else None for t, valid in zip(texts, batch.column(i_text).is_valid().to_pylist())]
            columns = batch.columns
            columns[i_text] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(replace, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` with pseudonyms under the session's key; nulls and odd rows as in :func:`pseudonymised`."""
    return pseudonymised(table(spark, sf_dir, "documents"), PiiOptions.of_session(spark))
