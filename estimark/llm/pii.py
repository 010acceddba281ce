"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Found and validated: card numbers (Luhn), IBANs (mod 97), phone numbers, US social security
numbers, IPv4 addresses, calendar dates, e-mail addresses, and access keys and secrets. Each
value is permuted within its own format by a Feistel network whose rounds are keyed hashes, so
the same value gets the same pseudonym in every document, different values get different ones,
and a pseudonym passes the same validation: check digits are computed again, and a date stays
a date (values outside the valid ones are walked on until they are valid again).

Null texts stay null, empty ones empty; both have no findings. Repeated rows are treated each.
Other columns pass through ``pseudonymise`` unchanged.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import logging
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The session's setting that holds the secret key.
KEY_SETTING = "spark.estimark.pseudonyms.key"
ROUNDS = 8
KINDS = ["email", "iban", "card", "phone", "ssn", "ip", "date", "secret"]


class Feistel:
    """A keyed permutation of the numbers 0 .. size - 1."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.key, self.tweak, self.size = key, tweak.encode(), size
        self.a = max(2, int(size**0.5))
        while self.a * self.a < size:
            self.a += 1

    def _round(self, k: int, x: int) -> int:
        digest = hashlib.blake2b(b"%d|%d|" % (k, x) + self.tweak, key=self.key, digest_size=16).digest()
        return int.from_bytes(digest, "big")

    def permute(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The image of x. Images that are out of range or not ``valid`` are permuted again, so
        valid numbers are permuted among themselves."""
        while True:
            left, right = divmod(x, self.a)
            for k in range(ROUNDS):
                left, right = right, (left + self._round(k, right)) % self.a
            x = left * self.a + right
            if x < self.size and valid(x):
                return x


@functools.lru_cache(maxsize=4096)
def feistel(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def refill(text: str, new: str) -> str:
    """``text`` with its digits replaced in order by ``new``'s."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def permute_digits(key: bytes, tweak: str, digits: str, valid: Callable[[str], bool] = lambda _: True) -> str:
    n = len(digits)
    if not n:
        return digits
    return f"{feistel(key, f'{tweak}{n}', 10**n).permute(int(digits), lambda x: valid(f'{x:0{n}d}')):0{n}d}"


def permute_symbols(key: bytes, tweak: str, text: str, alphabet: str) -> str:
    """Permutes the characters of ``text`` that are in ``alphabet`` as one number."""
    base, picked = len(alphabet), [c for c in text if c in alphabet]
    if not picked:
        return text
    number = 0
    for c in picked:
        number = number * base + alphabet.index(c)
    number = feistel(key, f"{tweak}{len(picked)}", base ** len(picked)).permute(number)
    out = []
    for _ in picked:
        number, r = divmod(number, base)
        out.append(alphabet[r])
    it = iter(reversed(out))
    return "".join(next(it) if c in alphabet else c for c in text)


LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += (d * 2 - 9 * (d > 4)) if k % 2 == 0 else d
    return -total % 10


def card(key: bytes, text: str) -> str | None:
    d = digits_of(text)
    if not 13 <= len(d) <= 19 or int(d[-1]) != luhn(d[:-1]) or len(set(d)) == 1:
        return None
    body = d[0] + permute_digits(key, "card" + d[0], d[1:-1])
    return refill(text, body + str(luhn(body)))


def iban(key: bytes, text: str) -> str | None:
    s = text.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = permute_symbols(key, "iban-letters" + s[:2], permute_symbols(key, "iban-digits" + s[:2], s[4:], DIGITS), UPPER)
    new = s[:2] + f"{98 - number(body + s[:2] + '00') % 97:02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def phone(key: bytes, text: str) -> str | None:
    d = digits_of(text)
    if not 10 <= len(d) <= 15:
        return None
    # the last ten digits alone decide, so a number is linked with and without its country's code
    code = len(d) - 10
    return refill(text, d[:code] + permute_digits(key, "phone", d[code:], lambda x: x[0] not in "01" or d[code] in "01"))


def ssn(key: bytes, text: str) -> str | None:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = digits_of(text)
    return refill(text, permute_digits(key, "ssn", d, ok)) if ok(d) else None


def ip(key: bytes, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    x = int.from_bytes(bytes(parts), "big")
    new = feistel(key, "ip", 1 << 32).permute(x, lambda y: (0 < y >> 24 < 224) == (0 < x >> 24 < 224))
    return ".".join(str(b) for b in new.to_bytes(4, "big"))


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(key: bytes, text: str) -> str | None:
    """Dates of 1900 to 2099: year-month-day, or day first (month first where only that fits).
    The day itself is permuted, so it is linked in all ways of writing it; the pseudonym is
    written as the original was, month first if it was so, whatever its day."""
    sep = next(c for c in text if not c.isdigit())
    p = text.split(sep)
    order = (0, 1, 2) if len(p[0]) == 4 else (2, 1, 0) if int(p[1]) <= 12 else (2, 0, 1)
    try:
        day = datetime.date(*(int(p[k]) for k in order)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + feistel(key, "date", LAST_DAY - FIRST_DAY + 1).permute(day - FIRST_DAY))
    fields = dict(zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"), strict=True))
    return sep.join(fields[k] for k in range(3))


def email(key: bytes, text: str) -> str | None:
    """Name and host by permutations of their own; the top-level domain stays. Addresses and
    hosts are linked whatever the case of the host's letters."""
    name, _, host = text.rpartition("@")
    labels, _, top = host.rpartition(".")
    new = name
    for tweak, alphabet in (("a", LOWER), ("A", UPPER), ("0", DIGITS)):
        new = permute_symbols(key, "email" + tweak + host.lower(), new, alphabet)
    hidden = permute_symbols(key, "host0", permute_symbols(key, "host", labels.lower(), LOWER), DIGITS)
    return f"{new}@{hidden}.{top}"


def secret(key: bytes, text: str) -> str | None:
    head = re.match(r"AKIA|gh[pousr]_|sk-|(?i:(?:token|password|passwd|secret|api_?key)\s*[=:]\s*[\"']?)", text)
    at = head.end() if head else 0
    body = text[at:]
    if re.fullmatch(r"[0-9a-f]+", body):
        return text[:at] + permute_symbols(key, "hex", body, HEX)
    for tweak, alphabet in (("a", LOWER), ("A", UPPER), ("0", DIGITS)):
        body = permute_symbols(key, "secret" + tweak, body, alphabet)
    return text[:at] + body


#: Kinds in the order in which they are tried where several could begin at one place.
PATTERN = re.compile(
    r"(?P<secret>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})\b|(?i:\b(?:token|password|passwd|secret|api_?key)\s*[=:]\s*[\"']?)[A-Za-z0-9]{8,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
#: Each kind's own pattern, for the kinds after one that begins at a place and isn't valid.
ALONE = [(kind, re.compile(body)) for kind, body in re.findall(r"\(\?P<(\w+)>(.*?)\)(?=\|\(\?P<|$)", PATTERN.pattern)]
#: The length that each country gives its IBANs.
IBAN_LENGTHS = {
    k[:2]: int(k[2:])
    for k in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()
}
RULES = {"card": card, "iban": iban, "phone": phone, "ssn": ssn, "ip": ip, "date": date, "secret": secret, "email": email}
#: Places near which anything can be found: a digit, or the @ of an address.
SPARK = re.compile(r"[0-9@]")
SECRET_HEAD = re.compile(r"(?i)token|password|passwd|secret|api_?key|sk-|gh[pousr]_")


def shorter(kind: str, found: str) -> Iterator[str]:
    """Beginnings of a card or IBAN that end at a separator, the longest first: what follows
    may be an expiry date or another word. An IBAN of a known country has that one's length."""
    length = IBAN_LENGTHS.get(found[:2]) if kind == "iban" else None
    if kind in ("card", "iban"):
        for end in range(len(found) - 1, 0, -1):
            if found[end] in " -" and (length is None or len(found[:end].replace(" ", "")) == length):
                yield found[:end]


def candidates(text: str, match: re.Match) -> Iterator[tuple[str, str]]:
    """(kind, string) of all that could begin where ``match`` does, itself first."""
    first = [kind for kind, _ in ALONE].index(match.lastgroup)
    for kind, pattern in ALONE[first:]:
        own = match if kind == match.lastgroup else pattern.match(text, match.start())
        if own:
            yield kind, own.group()
            yield from ((kind, x) for x in shorter(kind, own.group()))


def replace(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with its findings replaced, and how many there are of each kind."""
    counts: dict[str, int] = {}
    if not text or not (SPARK.search(text) or SECRET_HEAD.search(text)):
        return text, counts

    def put(match: re.Match) -> str:
        counts["email"] = counts.get("email", 0) + 1
        return email(key, match.group())

    if "@" in text:
        text = EMAIL.sub(put, text)
    out, done, at = [], 0, 0
    while match := PATTERN.search(text, at):
        start = match.start()
        # where nothing valid begins, something valid may begin inside
        at = start + 1
        for kind, found in candidates(text, match):
            new = RULES[kind](key, found)
            if new is not None:
                counts[kind] = counts.get(kind, 0) + 1
                out += [text[done:start], new]
                done = at = start + len(found)
                break
    return "".join([*out, text[done:]]), counts


def key_of(spark: SparkSession) -> bytes:
    """The secret key that the session's setting ``KEY_SETTING`` holds. Where there is none, a
    new one that nobody knows: values are then linked in this run, and never again."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        logging.getLogger(__name__).warning("%s is not set: pseudonyms of this run are linked with no other run's", KEY_SETTING)
    return key.encode() if key else secrets.token_bytes(32)


def pseudonymise(docs: DataFrame, key: bytes, found: str | None = "pii") -> DataFrame:
    """``docs`` with ``text`` replaced under the secret ``key`` and, if ``found`` is given, a map
    of that name (which ``docs`` must not have) from kind to number of findings."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    key = hashlib.sha256(key).digest()
    if found in docs.columns:
        raise ValueError(f"there is a column {found} already")
    names, types = docs.columns, dict(docs.dtypes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replace(x, key) for x in batch.column("text").to_pylist()]
            columns = [pa.array([x for x, _ in done], pa.string()) if n == "text" else batch.column(n) for n in names]
            counts = [pa.array([list(c.items()) for _, c in done], pa.map_(pa.string(), pa.int32()))] if found else []
            yield pa.RecordBatch.from_arrays([*columns, *counts], [*names, *([found] if found else [])])

    return docs.mapInArrow(emit, ", ".join([*[f"`{n}` {types[n]}" for n in names], *([f"`{found}` map<string,int>"] if found else [])]))
