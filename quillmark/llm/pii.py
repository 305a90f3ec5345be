"""Format-preserving pseudonyms: personal numbers, dates and addresses permuted within their format.

A found value is validated (check digits, ranges, calendar), read as a whole number in the mixed radix
of its format, and moved by a keyed permutation of that number's domain: a Feistel network with cycle
walking. The pseudonym has the layout of the value and passes the same validation. It depends on key
and value alone, so equal values stay equal across documents without any shared table.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import common

KINDS = ("email", "phone", "card", "iban", "ip", "ssn", "date", "secret")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_FINDERS = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"),
    ("secret", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:(?<!\w)(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\"']?)[A-Za-z0-9_\-]{6,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?![\w-])"),
    ("card", r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\N\d{4}\N\d{1,7}|\d{4}([ -])\d{6}\M\d{5})(?![\w-])"),
]
_PATTERN = "|".join(f"(?P<{k}>{p})" for k, p in _FINDERS)
_PATTERN = _PATTERN.replace(r"\d{4}([ -])\d{4}\N\d{4}\N", r"\d{4}(?P<s4>[ -])\d{4}(?P=s4)\d{4}(?P=s4)").replace(r"\d{4}([ -])\d{6}\M", r"\d{4}(?P<s6>[ -])\d{6}(?P=s6)")


# The country codes of one and two digits in the numbering plan E.164; all others have three.
_SHORT_CODES = """1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58
60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98""".split()


def _country(digits: str) -> str:
    """The country code that an international number begins with."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in _SHORT_CODES), digits[:3])


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points (for n > 1), the same on every machine."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key, rounds

    def _round(self, tweak: str, i: int, value: int, width: int) -> int:
        text = f"{tweak}|{i}|{value}".encode()
        need = (width.bit_length() + 7) // 8 + 8
        raw = b""
        while len(raw) < need:
            raw += hashlib.blake2b(text + len(raw).to_bytes(4, "big"), key=self.key).digest()
        return int.from_bytes(raw[:need], "big") % width

    def _feistel(self, x: int, n: int, tweak: str, back: bool) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        tweak = f"{tweak}|{n}"
        while True:  # cycle walking: a * b is less than n + a, so a few turns at most
            left, right = divmod(x, b)
            for i in reversed(range(self.rounds)) if back else range(self.rounds):
                if i % 2 == 0:
                    left = (left + (-1 if back else 1) * self._round(tweak, i, right, a)) % a
                else:
                    right = (right + (-1 if back else 1) * self._round(tweak, i, left, b)) % b
            x = left * b + right
            if x < n:
                return x

    def __call__(self, x: int, n: int, tweak: str) -> int:
        """Conjugating a shift with the Feistel permutation moves every value."""
        if n < 2:
            return x
        shift = 1 + self._round(tweak, -1, n, n - 1)
        return self._feistel((self._feistel(x, n, tweak, False) + shift) % n, n, tweak, True)


class Pseudonyms:
    """The pseudonym of each found value; None where the value isn't valid for its kind."""

    def __init__(self, key: bytes, most: int = 100_000):
        self.permute, self.most, self.known = Permutation(key), most, {}

    def __call__(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[kind, value] = getattr(self, f"_{kind}")(value)
        return self.known[kind, value]

    def _mixed(self, symbols: str, alphabets: list[str], tweak: str) -> str:
        """Permute the string whose i-th symbol is from the i-th alphabet."""
        x, n = 0, 1
        for s, a in zip(symbols, alphabets, strict=True):
            x, n = x * len(a) + a.index(s), n * len(a)
        x, out = self.permute(x, n, tweak), []
        for a in reversed(alphabets):
            x, r = divmod(x, len(a))
            out.append(a[r])
        return "".join(reversed(out))

    def _classes(self, text: str, tweak: str) -> str:
        """Letters and digits permuted within their class; other signs stay."""
        kinds = [next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None) for c in text]
        new = iter(self._mixed("".join(c for c, k in zip(text, kinds, strict=True) if k), [k for k in kinds if k], tweak + "".join("." if k is None else str(len(k)) for k in kinds)))
        return "".join(next(new) if k else c for c, k in zip(text, kinds, strict=True))

    @staticmethod
    def _refill(layout: str, digits: str) -> str:
        new = iter(digits)
        return "".join(next(new) if c in _DIGITS else c for c in layout)

    def _email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        return f"{self._classes(local, 'email@' + domain.lower())}@{domain}"

    def _secret(self, value: str) -> str:
        m = re.fullmatch(r"(?s)(AKIA|.*[=:\s\"'])(.+)", value)
        if re.fullmatch("[0-9a-f]+", m[2]):
            return m[1] + self._mixed(m[2], [_DIGITS + "abcdef"] * len(m[2]), f"hex{len(m[2])}")
        return m[1] + self._classes(m[2], "secret")

    def _card(self, value: str) -> str | None:
        d = re.sub(r"\D", "", value)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        body = d[0] + self._mixed(d[1:-1], [_DIGITS] * (len(d) - 2), "card" + d[0])
        return self._refill(value, body + luhn_digit(body))

    def _phone(self, value: str) -> str | None:
        """Digits alone choose the format, so a number has one pseudonym in every layout.

        Ten digits are a number of the North American plan, with or without its country code 1; other
        numbers need a plus and keep their country code. A trunk zero in brackets stays and counts for
        nothing. The first digits of area and exchange keep their class (0 and 1, or 2 to 9).
        """
        layout = value.replace("(0)", "(\0)") if value.startswith("+") else value
        d = "".join(c for c in layout if c in _DIGITS)
        code = _country(d) if value.startswith("+") else d[: len(d) - 10]
        rest = d[len(code) :]
        if code in ("", "1") and len(rest) == 10:
            if rest[0] in "01" and not value.startswith("+"):
                return None
            kind = lambda c: _DIGITS[:2] if c in "01" else _DIGITS[2:]
            shape = [kind(rest[0]), _DIGITS, _DIGITS, kind(rest[3])] + [_DIGITS] * 6
            new = self._mixed(rest, shape, f"nanp{len(shape[0])}{len(shape[3])}")
        elif value.startswith("+") and 8 <= len(d) <= 15:
            new = self._mixed(rest, [_DIGITS] * len(rest), "phone" + code)
        else:
            return None
        return self._refill(layout, code + new).replace("\0", "0")

    def _ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts) or not 1 <= int(parts[0]) <= 223:
            return None
        x = (((int(parts[0]) - 1) * 256 + int(parts[1])) * 256 + int(parts[2])) * 256 + int(parts[3])
        x = self.permute(x, 223 << 24, "ip")
        return f"{(x >> 24) + 1}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"

    def _ssn(self, value: str) -> str | None:
        area, group, serial = (int(p) for p in value.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = self.permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        x, serial = divmod(x, 9999)
        x, group = divmod(x, 99)
        return f"{areas[x]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        as_int = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or as_int(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._classes(plain[4:], "iban" + plain[:2])
        new = iter(plain[:2] + f"{98 - as_int(body + plain[:2] + '00') % 97:02d}" + body)
        return "".join(c if c == " " else next(new) for c in value)

    def _date(self, value: str) -> str | None:
        """A date of 1900 to 2099; day first unless only the month can come first."""
        a, sign, b, c = re.fullmatch(r"(\d+)([-./])(\d+)[-./](\d+)", value).groups()
        if len(a) == 4:
            order, y, m, d = "ymd", int(a), int(b), int(c)
        elif sign == "." or int(b) <= 12:
            order, y, m, d = "dmy", int(c), int(b), int(a)
        else:
            order, y, m, d = "mdy", int(c), int(a), int(b)
        try:
            day = dt.date(y, m, d)
        except ValueError:
            return None
        first, last = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
        if not first <= day <= last:
            return None
        new = first + dt.timedelta(self.permute((day - first).days, (last - first).days + 1, "date"))
        out = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sign.join(out[k] for k in order)


def pseudonymise(text: str, names: Pseudonyms, finder: re.Pattern[str]) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms in place of valid values, and how many of each kind."""
    found: dict[str, int] = {}

    def swap(m: re.Match[str]) -> str:
        kind = m.lastgroup if m.lastgroup in KINDS else "card"
        new = names(kind, m[0])
        if new is None:
            return m[0]
        found[kind] = found.get(kind, 0) + 1
        return new

    return finder.sub(swap, text), found


def _mapper(key: bytes, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replace column ``at`` and append the counts of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, finder = Pseudonyms(key), re.compile(_PATTERN)
        for batch in batches:
            for a, b in common.byte_slices(batch.column(at), 16 << 20):
                part = batch.slice(a, b - a)
                texts = part.column(at)
                counts = {k: [0] * len(texts) for k in KINDS}
                hit = [i for i, x in enumerate(pc.match_substring_regex(texts, r"[0-9@]|AKIA|(?i:password|passwd|secret|token|api_?key)").to_pylist()) if x]
                if hit:
                    new = texts.take(pa.array(hit)).to_pylist()
                    for j, i in enumerate(hit):
                        new[j], found = pseudonymise(new[j], names, finder)
                        for k, n in found.items():
                            counts[k][i] = n
                    mask = pa.array([False] * len(texts)) if not hit else pc.is_in(pa.array(range(len(texts))), value_set=pa.array(hit))
                    texts = pc.replace_with_mask(texts, mask, pa.array(new, texts.type))
                columns = [texts if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[k], pa.int32()) for k in KINDS)], names=[*part.schema.names, *(f"n_{k}" for k in KINDS)])

    return run


def pseudonymise_documents(docs: DataFrame, key: str | bytes, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id, text) with pseudonyms in ``text``, then ``n_email`` ... for each kind.

    Whoever has ``key`` can undo the permutations, so it is given by the caller and kept apart from the
    result; an empty one raises ``ValueError``. One pass without a shuffle; whole texts, rows and order
    stay. A null text stays null and has no findings, an empty text stays empty; a text without valid
    values stays byte for byte. Null ids, ties and repeated rows are treated row by row; an empty table
    gives no rows. Other columns, such as one that is also called ``n_email``, are not read unless
    ``columns`` names them; a named column that clashes with a count raises ``ValueError``
    (``pseudonymise_texts`` has no counts, so nothing clashes).
    """
    columns = columns or ["doc_id", "text"]
    if clash := {f"n_{k}" for k in KINDS} & set(columns):
        raise ValueError(f"columns clash with the counts: {sorted(clash)}")
    rows = docs.select(*(F.col(f"`{c.replace('`', '``')}`") for c in columns))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"n_{k}", T.IntegerType()) for k in KINDS)])
    return rows.mapInArrow(_mapper(_key(key), columns.index("text")), schema)


def pseudonymise_texts(docs: DataFrame, key: str | bytes) -> DataFrame:
    """``docs``, all columns, with pseudonyms in ``text``; whatever the other columns are called, they stay as they are."""
    return common.map_rows(docs, _mapper(_key(key), docs.columns.index("text")))


def _key(key: str | bytes) -> bytes:
    """The key of the round function: 64 bytes derived from the caller's."""
    if not key:
        raise ValueError("a key is needed")
    return hashlib.blake2b(key.encode() if isinstance(key, str) else key).digest()
