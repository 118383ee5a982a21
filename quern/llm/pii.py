"""Personal data replaced by format-preserving Feistel pseudonyms.

Each value found is mapped to a number, permuted under a key by a balanced Feistel network with
cycle walking over exactly the values of its format, and written back in that format: a card
number stays a number with a right check digit, a date a date, an IBAN an IBAN. The permutation
depends on key and kind alone, so equal values get equal pseudonyms in all documents and
different ones never meet. A telephone number is linked in all its ways of writing, with and without its country code; an e-mail
address whatever the case of its letters. Not looked for: dates with the year first and slashes, IPv6 addresses, and
telephone numbers without a country code in other groups than three, three and four digits.

Defined results: a null text stays null and an empty one empty, with no findings; whole texts of
any length are read; rows are handled one by one (ties, repeated rows, null keys, empty tables); other
columns stay as they are, but for one of the name of ``counts``, which the result replaces.
"""

from __future__ import annotations

import datetime
import logging
import re
from collections.abc import Callable
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.llm.common import map_batches

ROUNDS = 10
#: Pseudonyms kept in a worker's memory, of values of one stretch at most.
MEMORY_VALUES = 100_000
#: Characters permuted as one number; longer secrets are permuted stretch by stretch, as one large number takes quadratic time.
STRETCH = 512
#: For tests and demonstrations; whoever knows the key can undo the pseudonyms.
DEMO_KEY = b"quern demonstration key; pass your own"
#: Setting of a session that holds the secret key.
KEY_SETTING = "quern.pii.key"

PATTERN = re.compile(
    r"""
    (?P<secret>(?i:\b(?:token|api[_-]?key|secret|passwd|password|access[_-]?key|bearer)\b)["']?\s{0,3}[=:]\s{0,3}["']?(?P<value>[A-Za-z0-9_\-+/.=~]{8,}))
  | (?P<known>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})\b)
  | (?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,255}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<date>(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d\-/]))
  | (?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d))
  | (?P<phone>(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\)[ ]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-]))
  | (?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))
  | (?P<number>(?<![\d.])(?:\d{13,19}|\d{4}(?P<gap>[ \-])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<gap2>[ \-])\d{6}(?P=gap2)\d{5})(?!\d))
    """,
    re.VERBOSE,
)
#: A text without a digit of any script, an @, a word that announces a secret or the head of a known key holds nothing to replace.
HINT = re.compile(r"[\d@]|(?i:token|key|secret|passw|bearer)|xox|AKIA|gh[pousr]_")

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class Feistel:
    """A keyed permutation of 0 to n - 1 for any n."""

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        self.key, self.rounds = blake2b(key, digest_size=32).digest(), rounds

    def _round(self, tag: bytes, k: int, half: int, width: int) -> int:
        size = (width.bit_length() + 7) // 8 + 8
        data = half.to_bytes((half.bit_length() + 7) // 8 or 1, "little")
        out = b"".join(
            blake2b(data, digest_size=64, key=self.key, salt=bytes([k, i & 255]), person=tag[:16]).digest()
            for i in range(-(-size // 64))
        )
        return int.from_bytes(out[:size], "little") % width

    def permute(self, tag: str, x: int, n: int, inverse: bool = False) -> int:
        if n < 2:
            return x
        width = isqrt(n - 1) + 1
        name = blake2b(f"{tag}:{n}".encode(), digest_size=16).digest()
        while True:
            high, low = divmod(x, width)
            for k in reversed(range(self.rounds)) if inverse else range(self.rounds):
                if inverse:
                    high, low = (low - self._round(name, k, high, width)) % width, high
                else:
                    high, low = low, (high + self._round(name, k, low, width)) % width
            x = high * width + low
            if x < n:  # cycle walking: leave out what is no value of the format
                return x


def _alphabets(text: str) -> list[str]:
    return [DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else "" for c in text]


def permute_text(cipher: Feistel, tag: str, text: str, alphabets: list[str] | None = None) -> str:
    """Each digit and letter replaced by one of its kind; all else stays."""
    alphabets = alphabets or _alphabets(text)
    x, n = 0, 1
    for c, letters in zip(text, alphabets, strict=True):
        if letters:
            x, n = x * len(letters) + letters.index(c), n * len(letters)
    shape = "".join(letters[:1] or c for c, letters in zip(text, alphabets, strict=True))
    x = cipher.permute(f"{tag}:{shape}", x, n)
    out = []
    for c, letters in zip(reversed(text), reversed(alphabets), strict=True):
        if letters:
            x, k = divmod(x, len(letters))
            c = letters[k]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it valid."""
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def number(cipher: Feistel, text: str) -> str | None:
    """A card number, which keeps a right check digit; other long numbers stay."""
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    head = permute_text(cipher, "card", digits[:-1])
    return _refill(text, head + luhn_digit(head))


def _day(cipher: Feistel, day: datetime.date) -> datetime.date:
    """A day from 1900 to 2099 for each, the same whatever format it is written in.

    Days of the month up to 12 and later ones stay among themselves, so that what is written with the month
    first, because it can't be read otherwise, stays so.
    """
    x = day.toordinal() - FIRST_DAY
    while True:
        x = cipher.permute("date", x, LAST_DAY - FIRST_DAY + 1)
        new = datetime.date.fromordinal(FIRST_DAY + x)
        if (new.day > 12) == (day.day > 12):
            return new


def date(cipher: Feistel, text: str) -> str | None:
    """Year first, day first, or month first where it can't be read otherwise; numbers are as wide as they were."""
    a, b, c = map(int, re.split(r"\D", text))
    sep = re.search(r"\D", text)[0]
    day_of = {"ymd": lambda: (a, b, c), "dmy": lambda: (c, b, a), "mdy": lambda: (c, a, b)}
    for order in ("ymd",) if sep == "-" else ("dmy", "mdy") if sep == "/" else ("dmy",):
        try:
            day = datetime.date(*day_of[order]())
        except ValueError:
            continue
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            continue
        d = _day(cipher, day)
        n = (lambda x: f"{x:02d}") if sep == "-" or len(text) == 10 else str
        parts = {"ymd": (f"{d.year}", n(d.month), n(d.day)), "dmy": (n(d.day), n(d.month), f"{d.year}"), "mdy": (n(d.month), n(d.day), f"{d.year}")}
        return sep.join(parts[order])
    return None


def ip(cipher: Feistel, text: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    x = cipher.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def iban(cipher: Feistel, text: str) -> str | None:
    plain = text.replace(" ", "")
    as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_text(cipher, f"iban{plain[:2]}", plain[4:])
    full = plain[:2] + f"{98 - as_number(body + plain[:2] + '00') % 97:02d}" + body
    rest = iter(full)
    return "".join(c if c == " " else next(rest) for c in text)


def ssn(cipher: Feistel, text: str) -> str | None:
    right = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    if not right(text):
        return None
    while True:
        text = permute_text(cipher, "ssn", text)
        if right(text):
            return text


# Country codes of one and of two digits; all others have three.
ONE_DIGIT = "1 7".split()
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def phone(cipher: Feistel, text: str) -> str | None:
    """The digits behind the country code, as one number however they are grouped; the code and the layout stay."""
    digits = re.sub(r"[^0-9]", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    code = 0 if text[0] != "+" else 1 if digits[:1] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3
    return _refill(text, digits[:code] + permute_text(cipher, "phone", digits[code:]))


def email(cipher: Feistel, text: str) -> str:
    """Letters and digits of both sides, but for the top-level domain; the case of letters stays and does not count."""
    head, _, top = text.rpartition(".")
    new = permute_text(cipher, "email", "".join(c.lower() if c in UPPER else c for c in head))
    return "".join(n.upper() if c in UPPER else n for c, n in zip(head, new, strict=True)) + f".{top}"


def permute_long(cipher: Feistel, tag: str, text: str, letters: str = "") -> str:
    """permute_text of a text of any length, in time linear in it.

    Even stretches are permuted under a digest of those before them, and then from the end under a digest of
    those behind them. Either way can be undone, so different texts stay different, and each character counts
    for all.
    """
    n = -(-len(text) // STRETCH)
    if n < 2:
        return permute_text(cipher, tag, text, [letters] * len(text) if letters else None)
    cuts = [k * len(text) // n for k in range(n + 1)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for way, places in (("on", range(n)), ("back", reversed(range(n)))):
        seen = blake2b(digest_size=32)
        for k in places:
            own = parts[k]
            new = permute_text(cipher, f"{tag}:{way}:{n}:{k}:{seen.hexdigest()}", own, [letters] * len(own) if letters else None)
            seen.update((own if way == "on" else new).encode())
            parts[k] = new
    return "".join(parts)


def secret(cipher: Feistel, text: str) -> str:
    for letters in ("0123456789abcdef", "0123456789ABCDEF"):
        if len(text) >= 16 and set(text) <= set(letters):
            return permute_long(cipher, "hex", text, letters)
    return permute_long(cipher, "secret", text)


KINDS: dict[str, Callable[[Feistel, str], str | None]] = {
    "secret": secret, "known": secret, "email": email, "iban": iban, "date": date, "ip": ip, "phone": phone, "ssn": ssn, "number": number,
}


class Pseudonyms:
    """Finds values in texts and puts their pseudonyms in place."""

    def __init__(self, key: bytes) -> None:
        self.cipher = Feistel(key)
        self.memory: dict[tuple[str, str], str | None] = {}

    def of(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None for what only looks like a value of the kind."""
        if len(value) > STRETCH:
            return KINDS[kind](self.cipher, value)
        if (kind, value) not in self.memory:
            if len(self.memory) >= MEMORY_VALUES:
                self.memory.clear()
            self.memory[kind, value] = KINDS[kind](self.cipher, value)
        return self.memory[kind, value]

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        if not HINT.search(text):
            return text, {}
        counts: dict[str, int] = {}
        out: list[str] = []
        done = at = 0
        while m := PATTERN.search(text, at):
            kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
            group = "value" if kind == "secret" else kind
            new = self.of(kind, m[group])
            if new is None:  # not valid: look again behind its first character
                at = m.start() + 1
                continue
            counts[kind] = counts.get(kind, 0) + 1
            out += [text[done : m.start(group)], new]
            done = at = m.end(group)
        return ("".join(out) + text[done:] if out else text), counts


def session_key(spark: SparkSession) -> bytes:
    """The key that the session is set to; without one the demonstration key, as tests and the queries on given tables have."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        logging.getLogger("quern").warning("personal data gets pseudonyms under a public key, which anyone can undo: set %s", KEY_SETTING)
    return key.encode() if key else DEMO_KEY


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", counts: str = "pii_counts") -> DataFrame:
    """docs with the personal data in its texts replaced under the key, and counts (kind to number of values)."""
    rest = docs.drop(counts)
    place = rest.columns.index(text)
    schema = T.StructType([*rest.schema.fields, T.StructField(counts, T.MapType(T.StringType(), T.LongType()))])
    made: dict[str, Pseudonyms] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = made.get("it") or made.setdefault("it", Pseudonyms(key))
        found = [(None, {}) if t is None else names.replace(t) for t in batch.column(place).to_pylist()]
        columns = list(batch.columns)
        columns[place] = pa.array([t for t, _ in found], columns[place].type)
        numbers = pa.array([list(c.items()) for _, c in found], pa.map_(pa.string(), pa.int64()))
        return pa.RecordBatch.from_arrays([*columns, numbers], [*batch.schema.names, counts])

    return map_batches(rest, run, schema)
