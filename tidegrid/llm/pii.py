"""Pseudonyms for personal data that keep the format of what they replace.

A value is permuted inside its format by a Feistel network under a key: equal values get equal pseudonyms in every document
and different values different ones, and whoever has the key can invert them. Only validated values are touched: card numbers
by their check digit, IBANs by theirs, dates by the calendar, addresses by their parts. The pseudonym is valid the same way.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.workers import map_batches, texts_of

ROUNDS = 8
DEMO_KEY = b"tidegrid pseudonyms"  # a run that matters brings its own
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """Keyed permutations of 0..n-1 for any n; ``name`` separates the formats."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, name: str, n: int, i: int, half: int) -> int:
        said = f"{name}|{n}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big")

    def _once(self, x: int, n: int, name: str, back: bool) -> int:
        low = 1
        while low * low < n:
            low *= 2
        high = -(-n // low)
        a, b = divmod(x, low)  # a < high, b < low
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                a = (a + sign * self._round(name, n, i, b)) % high
            else:
                b = (b + sign * self._round(name, n, i, a)) % low
        return a * low + b

    def permute(self, x: int, n: int, name: str, fits: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """Another number below n, one to one; ``fits`` must hold for x, and holds for the result."""
        while True:
            x = self._once(x, n, name, back)
            if x < n and fits(x):
                return x


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


class Pseudonyms:
    """The recognisers, each a pattern and a function that gives the pseudonym of a match or None if it is not valid."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.first_day = datetime.date(1900, 1, 1).toordinal()
        self.days = datetime.date(2100, 1, 1).toordinal() - self.first_day

    def number(self, digits: str, name: str) -> str:
        """Digits of the same number, whatever they were."""
        if not digits:
            return digits
        return str(self.feistel.permute(int(digits), 10 ** len(digits), name)).zfill(len(digits))

    def card(self, text: str) -> str | None:
        d = _digits(text)
        if not (13 <= len(d) <= 19 and d[0] in "23456" and luhn(d)):
            return None
        body = d[0] + self.number(d[1:-1], "card")
        return _refill(text, next(body + c for c in "0123456789" if luhn(body + c)))

    def phone(self, text: str) -> str | None:
        """The country code, or the first digit where there is none, stays."""
        d = _digits(text)
        if not 8 <= len(d) <= 15:
            return None
        stays = len(re.match(r"\+?(\d{1,3})(?!\d)|", text)[1] or "") if text[0] == "+" else 0
        stays = max(1, stays)
        rest = d[stays:]
        # numbers do not begin with 0 or 1 after the code, and the pseudonym only does if the number did
        low = rest[:1] in "01"
        fits = lambda x: (str(x).zfill(len(rest))[0] in "01") == low
        new = str(self.feistel.permute(int(rest), 10 ** len(rest), "phone", fits)).zfill(len(rest))
        return _refill(text, d[:stays] + new)

    def social(self, text: str) -> str | None:
        valid = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4
        n = int(_digits(text))
        if not valid(n):
            return None
        return _refill(text, str(self.feistel.permute(n, 10**9, "social", valid)).zfill(9))

    def address(self, text: str) -> str | None:
        """An IPv4 address; local ones say nothing about a person and stay."""
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        n = int.from_bytes(bytes(map(int, parts)), "big")
        if n >= _RESERVED:
            n = _RESERVED + self.feistel.permute(n - _RESERVED, (1 << 32) - _RESERVED, "reserved address")
            return ".".join(map(str, n.to_bytes(4, "big")))
        if not _public(n):
            return None
        return ".".join(map(str, self.feistel.permute(n, 1 << 32, "address", _public).to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        """A calendar date of 1900 to 2099: 2024-01-31, 2024/01/31, 31.01.2024, 31/01/2024, or 01/31/2024 where only that is one.

        The same day gets the same pseudonym in all of them.
        """
        a, b, c = re.split(r"[-/.]", text)
        if len(a) == 4:
            orders = [(a, b, c)]
        else:
            orders = [(c, b, a), (c, a, b)] if "/" in text else [(c, b, a)]
        for i, (year, month, day) in enumerate(orders):
            try:
                n = datetime.date(int(year), int(month), int(day)).toordinal() - self.first_day
            except ValueError:
                continue
            if not 0 <= n < self.days:
                return None
            new = datetime.date.fromordinal(self.feistel.permute(n, self.days, "date") + self.first_day)
            order = ("%Y", "%m", "%d") if len(a) == 4 else ("%d", "%m", "%Y") if i == 0 else ("%m", "%d", "%Y")
            return new.strftime(re.search(r"[-/.]", text)[0].join(order))
        return None

    def iban(self, text: str) -> str | None:
        s = re.sub(" ", "", text)
        if not 15 <= len(s) <= 34 or int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 != 1:
            return None
        body = self.signs(s[4:], "iban")
        check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
        new = iter(f"{s[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def signs(self, text: str, name: str) -> str:
        """Digits stay digits, small letters small, capitals capital, other signs what they are; long runs go by parts."""
        out = []
        for begin in range(0, len(text), 32):
            part = text[begin:begin + 32]
            sizes = [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in part]
            n, x = 1, 0
            for c, k in zip(part, sizes, strict=True):
                value = int(c) if k == 10 else _LETTERS.index(c.lower()) if k == 26 else 0
                n, x = n * k, x * k + value
            if n > 1:
                x = self.feistel.permute(x, n, f"{name}:{begin}")
            new = []
            for c, k in zip(reversed(part), reversed(sizes), strict=True):
                x, value = divmod(x, k)
                new.append(c if k == 1 else str(value) if k == 10 else
                           _LETTERS[value].upper() if c.isupper() else _LETTERS[value])
            out += reversed(new)
        return "".join(out)

    def mail(self, text: str) -> str:
        """The name is permuted, and the domain's name too, but for its last label."""
        name, _, domain = text.partition("@")
        head, _, last = domain.rpartition(".")
        return f"{self.signs(name, 'mail')}@{self.signs(head, 'domain')}.{last}"

    def secret(self, text: str) -> str:
        return self.signs(text, "secret")


#: From 224.0.0.0 on: a class of its own, as such an address is nobody's host and its pseudonym should not be one.
_RESERVED = 224 << 24


def _public(n: int) -> bool:
    first, second = n >> 24, n >> 16 & 255
    return 1 <= first < 224 and first not in (10, 127) and not (first == 172 and 16 <= second < 32) and (
        first, second) not in ((192, 168), (169, 254))


_END = r"(?![\w])(?![-./]\d)"
#: Tried in this order where a number begins.
NUMBERS = [
    ("date", re.compile(r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})" + _END)),
    ("address", re.compile(r"\d{1,3}(?:\.\d{1,3}){3}" + _END)),
    ("social", re.compile(r"\d{3}-\d{2}-\d{4}" + _END)),
    ("card", re.compile(r"\d(?:[ -]?\d){12,18}" + _END)),
    ("phone", re.compile(r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|"
                         r"\d{3}[ .-]\d{3}[ .-]\d{4})" + _END)),
]
_NUMBER = re.compile(r"(?<![\w.])(?:\+?\(?)\d")
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
                  r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS_KEY = re.compile(r"(?<!\w)(AKIA|ASIA)([A-Z0-9]{16})(?!\w)")
ASSIGNED = re.compile(r"(?i)((?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,4}[=:]\s{0,4}[\"']?)"
                      r"([A-Za-z0-9+/_.~-]{8,})")
_WORDS = re.compile(r"(?i)passw|pwd|secret|token|api.?key")


def replace(text: str, names: Pseudonyms) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were replaced. No value is looked at twice."""
    taken: list[tuple[int, int, str, str]] = []

    def take(kind: str, span: tuple[int, int], new: str | None) -> None:
        i = bisect.bisect(taken, (*span, "", ""))
        free = (i == 0 or taken[i - 1][1] <= span[0]) and (i == len(taken) or span[1] <= taken[i][0])
        if new is not None and free:
            taken.insert(i, (*span, kind, new))

    if "AKIA" in text or "ASIA" in text:
        for m in ACCESS_KEY.finditer(text):
            take("secret", m.span(2), names.secret(m[2]))
    if ("=" in text or ":" in text) and _WORDS.search(text):
        for m in ASSIGNED.finditer(text):
            take("secret", m.span(2), names.secret(m[2]))
    if "@" in text:
        for m in MAIL.finditer(text):
            take("mail", m.span(), names.mail(m[0]))
    numbers = _NUMBER.search(text) is not None
    if numbers:
        for m in IBAN.finditer(text):
            take("iban", m.span(), names.iban(m[0]))
    if numbers:
        taken = _with_numbers(text, taken, names)
    counts: dict[str, int] = {}
    out, copied = [], 0
    for begin, end, kind, new in taken:
        counts[kind] = counts.get(kind, 0) + 1
        out += [text[copied:begin], new]
        copied = end
    return "".join([*out, text[copied:]]), counts


def _with_numbers(text: str, taken: list[tuple[int, int, str, str]], names: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """Spans in order, with those of valid numbers between them."""
    out: list[tuple[int, int, str, str]] = []
    after, next_, done = [*taken, (len(text) + 1, 0, "", "")], 0, 0
    for at in _NUMBER.finditer(text):
        begin = at.start()
        while after[next_][0] <= begin:
            out.append(after[next_])
            done, next_ = after[next_][1], next_ + 1
        if begin < done:
            continue
        for kind, pattern in NUMBERS:
            # a sign before the number need not belong to it
            m = pattern.match(text, begin) or pattern.match(text, at.end() - 1)
            if m and m.end() <= after[next_][0] and (new := getattr(names, kind)(m[0])):
                out.append((*m.span(), kind, new))
                done = m.end()
                break
    return out + after[next_:-1]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its text column; all other columns and all rows stay.

    A null text stays null, an empty one empty. Texts of any length are read whole. An empty table gives an empty one.
    """
    at = docs.columns.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            new = [None if t is None else replace(t, names)[0] for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, rewrite, docs.schema)


KINDS = ("mail", "phone", "card", "social", "address", "date", "iban", "secret")


def pseudonym_report(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text`` with pseudonyms, ``n_replaced`` and a count per kind, for each row of ``docs`` (doc_id, text)."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            found = [(None, {}) if t is None else replace(t, names) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t for t, _ in found], pa.string()),
                 pa.array([sum(c.values()) for _, c in found], pa.int64()),
                 *(pa.array([c.get(k, 0) for _, c in found], pa.int64()) for k in KINDS)],
                ["doc_id", "text", "n_replaced", *(f"n_{k}" for k in KINDS)])

    return map_batches(texts_of(docs), rewrite, ", ".join(
        ["doc_id long", "text string", "n_replaced long", *(f"n_{k} long" for k in KINDS)]))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), DEMO_KEY)
