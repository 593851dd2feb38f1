"""Format-preserving pseudonyms for personal numbers, dates and mail names.

Values are found by format, validated (check digits, ranges, calendar), and replaced by a keyed
permutation of the set of valid values of the same format: a balanced Feistel network over the value's
rank, walked until it falls inside the set.  Separators, letter case and lengths stay.  The
permutation depends on the key, the kind and the format alone, so a value has one pseudonym in every
document, two values never share one, and the key's owner can invert it.

Kinds: card (13-19 digits, Luhn; solid, 4-4-4-4, 4-6-5 or 4-6-4), iban (mod 97; solid or in groups of four), ssn (3-2-4 digits in issued ranges), phone (3-3-4
digits, the area code bracketed or not, after a country code or none; ten digits have no check digit to validate), ip (four octets), date (year first, or day and month first; read as month first only where the day is over 12),
mail (name@domain; each letter or digit of the name among its own kind).

Defined cases: a null text stays null, with no findings; an empty text stays empty; values inside
longer runs of letters or digits are not values; repeated rows get equal results; an empty table
gives no rows; very long texts are read whole; extra columns are kept by ``pseudonymise``, where one named
pii_spans is replaced, and dropped by the query.  The key has no default: whoever has it can invert.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

ROUNDS = 8
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # 1900-2099


class Feistel:
    """A keyed permutation of 0..size-1, and its inverse."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.key = hmac.new(key, tweak.encode(), "sha256").digest()
        side = 2
        while side * side < size:
            side *= 2
        self.side = side  # a power of two; the square is under four times the size, or 4

    def _round(self, k: int, half: int) -> int:
        raw = hashlib.blake2b(half.to_bytes(16, "big"), key=self.key, digest_size=16, salt=bytes([k])).digest()
        return int.from_bytes(raw, "big") % self.side

    def _once(self, x: int) -> int:
        a, b = divmod(x, self.side)
        for k in range(ROUNDS):
            a, b = b, (a + self._round(k, b)) % self.side
        return a * self.side + b

    def _back(self, x: int) -> int:
        a, b = divmod(x, self.side)
        for k in reversed(range(ROUNDS)):
            a, b = (b - self._round(k, a)) % self.side, a
        return a * self.side + b

    def permute(self, x: int, inverse: bool = False) -> int:
        step = self._back if inverse else self._once
        x = step(x)
        while x >= self.size:
            x = step(x)
        return x


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn(body + c))


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isascii() and c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isascii() and c.isdigit())


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonyms:
    def __init__(self, key: bytes):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = key
        self.made: dict[tuple[str, int], Feistel] = {}
        self.kinds: dict[str, Callable[[str, bool], str | None]] = {k: getattr(self, f"_{k}") for k in KINDS}

    def _permute(self, kind: str, size: int, x: int, inverse: bool) -> int:
        if (kind, size) not in self.made:
            self.made[kind, size] = Feistel(self.key, f"{kind}:{size}", size)
        return self.made[kind, size].permute(x, inverse)

    def _card(self, s: str, inverse: bool) -> str | None:
        d = _digits(s)
        if not 13 <= len(d) <= 19 or not luhn(d):
            return None
        body = str(self._permute("card", 10 ** (len(d) - 1), int(d[:-1]), inverse)).zfill(len(d) - 1)
        return _refill(s, body + _luhn_digit(body))

    def _iban(self, s: str, inverse: bool) -> str | None:
        solid = re.sub("[ -]", "", s)
        if _mod97(solid[4:] + solid[:4]) != 1:
            return None
        body = self._classes("iban" + solid[:2], solid[4:], inverse)
        check = 98 - _mod97(body + solid[:2] + "00")
        new = iter(f"{solid[:2]}{check:02d}{body}")
        return "".join(c if c in " -" else next(new) for c in s)

    def _ssn(self, s: str, inverse: bool) -> str | None:
        if not _ssn_ok(_digits(s)):
            return None
        x = int(_digits(s))
        while True:
            x = self._permute("ssn", 10**9, x, inverse)
            if _ssn_ok(d := str(x).zfill(9)):
                return _refill(s, d)

    def _phone(self, s: str, inverse: bool) -> str | None:
        # The last ten digits are the number; a country code stays, and +1 is the same number as none.
        d = _digits(s)
        code, own = d[:-10], d[-10:]
        return _refill(s, code + str(self._permute("phone" + code * (code != "1"), 10**10, int(own), inverse)).zfill(10))

    def _ip(self, s: str, inverse: bool) -> str | None:
        octets = s.split(".")
        if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
            return None
        x = self._permute("ip", 1 << 32, int.from_bytes(bytes(map(int, octets)), "big"), inverse)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, s: str, inverse: bool) -> str | None:
        parts = re.findall(r"\d+|\D", s)
        order = (0, 2, 4) if len(parts[0]) == 4 else (4, 2, 0)
        month_first = False
        try:
            day = dt.date(*(int(parts[k]) for k in order)).toordinal() - FIRST_DAY
        except ValueError:
            # A format of its own: month first with a day over 12, which no date with the day first looks like.
            if order[0] == 0:
                return None
            order, month_first = (4, 0, 2), True
            try:
                day = dt.date(*(int(parts[k]) for k in order)).toordinal() - FIRST_DAY
            except ValueError:
                return None
        if not 0 <= day < DAYS:
            return None
        # Among the dates that this format can write: one without leading zeros keeps its widths.
        widths = [len(parts[k]) for k in order]
        while True:
            day = self._permute(f"{'us' * month_first}date{widths}", DAYS, day, inverse)
            new = dt.date.fromordinal(day + FIRST_DAY)
            values = [str(v).zfill(w) for v, w in zip((new.year, new.month, new.day), widths)]
            if (new.day > 12 or not month_first) and all(len(v) == w and (w > 1 or v[0] != "0") for v, w in zip(values, widths)):
                for k, v in zip(order, values):
                    parts[k] = v
                return "".join(parts)

    def _classes(self, kind: str, s: str, inverse: bool) -> str:
        """Each ASCII letter or digit becomes one of its own kind, all together one permutation."""
        bases = [("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else (c, 1) for c in s]
        shape = "".join(b for b, _ in bases)
        x, size = 0, 1
        for c, (base, n) in zip(s, bases):
            x = x * n + (ord(c) - ord(base) if n > 1 else 0)
            size *= n
        if size == 1:
            return s
        x = self._permute(f"{kind}:{shape}", size, x, inverse)
        out = []
        for base, n in reversed(bases):
            x, k = divmod(x, n)
            out.append(chr(ord(base) + k) if n > 1 else base)
        return "".join(reversed(out))

    def _mail(self, s: str, inverse: bool) -> str | None:
        name, _, domain = s.partition("@")
        return f"{self._long(name, inverse)}@{domain}"

    def _long(self, name: str, inverse: bool) -> str:
        # The Feistel halves take 128 bits: long names are permuted in parts of 40 characters.
        return "".join(self._classes("mail", name[k : k + 40], inverse) for k in range(0, len(name), 40))

    def replace(self, text: str, inverse: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in the original."""
        if not _LIKELY.search(text):
            return text, []
        out, spans, at = [], [], 0
        start, grouped = 0, None
        while m := PATTERN.search(text, start):
            kind, start = m.lastgroup, m.end()
            new = self.kinds[kind](m.group(), inverse)
            if new is None and kind == "iban" and m.group()[4] in " -":
                # Groups after letters may be a card of their own.
                start, grouped = m.start() + 5, (m.start(), m.end())
            if new is not None:
                # Walked on until the groups around it still are no iban, so that the inverse finds the same values.
                while grouped and m.end() <= grouped[1] and self._iban("".join((text[grouped[0] : m.start()], new, text[m.end() : grouped[1]])), False) is not None:
                    new = self.kinds[kind](new, inverse)
                out += (text[at : m.start()], new)
                spans.append((kind, m.start(), m.end()))
                at = m.end()
        return "".join(out) + text[at:] if spans else text, spans


# Lengths of the countries' ibans, which tell where one in groups ends.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped_ibans() -> str:
    """Ibans in groups of four, with one separator throughout."""
    forms = []
    for n, countries in _IBAN_LENGTHS.items():
        full, rest = divmod(n - 4, 4)
        for sep in " -":
            forms.append(f"(?:{countries.replace(' ', '|')})\\d{{2}}(?:{sep}[A-Z0-9]{{4}}){{{full}}}" + (f"{sep}[A-Z0-9]{{{rest}}}" if rest else "") + "(?![A-Za-z0-9])")
    return "|".join(forms)


# The formats, tried in this order at each place.
_FORMATS = {
    "mail": r"[A-Za-z0-9](?:[\w.+-]{0,62}[\w+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])|" + _grouped_ibans(),
    "date": r"\d{4}([-/.])\d{1,2}\1\d{1,2}(?![\w]|[-/.]\d)|\d{1,2}([-/.])\d{1,2}\2\d{4}(?![\w]|[-/.]\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "card": r"\d{4}[ -]\d{6}[ -]\d{4,5}(?![\w]|[ -]\d)|\d{4}(?:[ -]\d{4}){3}(?![\w]|[ -]\d{4}(?!\d))|\d{13,19}(?![\w])",
    "phone": r"(?:\+\d{1,3}[ ])?\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}[ ]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<!\d)\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
}
KINDS = tuple(_FORMATS)


def _compiled() -> re.Pattern:
    # Back references are numbered within the whole pattern; the two dates' separators are named.
    parts = []
    for kind, form in _FORMATS.items():
        if kind == "date":
            form = form.replace(r"([-/.])\d{1,2}\1", r"(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)").replace(r"([-/.])\d{1,2}\2", r"(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)")
        parts.append(f"(?P<{kind}>{form})")
    return re.compile(r"(?<![\w.+])(?:" + "|".join(parts) + ")", re.ASCII)


PATTERN = _compiled()
_LIKELY = re.compile("[0-9@]")


def pseudonymise(docs: DataFrame, text: str, key: bytes, inverse: bool = False) -> DataFrame:
    """All columns, with text replaced and pii_spans (kind, start, end; ends exclusive) added."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    docs = docs.drop(*(c for c in docs.columns if c.lower() == "pii_spans" and c != text))
    schema = T.StructType([*docs.schema.fields, T.StructField("pii_spans", span)])
    at = docs.schema.fieldNames().index(text)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key)
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts, spans = [], []
            for t in batch.column(at).to_pylist():
                new, found = (t, []) if t is None else made.replace(t, inverse)
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, arrow)], [*batch.schema.names, "pii_spans"])

    return docs.mapInArrow(run, schema)


#: The query's key, for test tables only.
TEST_KEY = b"pseudonym key of the test tables"


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", TEST_KEY)
    count = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *(count(k) for k in KINDS), F.size("pii_spans").cast("long").alias("n_pii"))
