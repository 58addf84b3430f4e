"""Format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that their own checks confirm (payment cards by Luhn, IBAN by mod 97,
IPv4 octets, phone, social security and calendar rules), mail addresses and secrets
after a telling name are replaced inside their format: digits stay digits, separators
stay, check digits are made anew, dates stay dates. The permutation depends on the key,
the kind and the value only, so equal values have equal pseudonyms in all documents and
different values different ones.

A permutation of ``range(n)`` is a balanced Feistel network on the next even number of
bits, walked until it is back in the range; rounds are keyed BLAKE2b. A value of more
than ``SHORT`` symbols (long secrets and addresses) goes through a Feistel network on its
two halves of symbols, each added to a key stream of the other, in time that grows with
its length only.

Edge cases: null texts stay null with no finds; texts without finds stay as they are;
very long texts are searched whole and a find may have any length; where several finds
start at one place the kind that is listed first in the pattern counts; repeated rows
have repeated results; empty tables give empty results; all other columns pass through
``pseudonymise_texts``, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import arrow_types, giving_back
from facetry.session import ship

ROUNDS = 8
KEY_SETTING = "spark.facetry.pii.key"
#: Symbols of a value that is permuted as one number, at most.
SHORT = 48
FIRST_DAY, DAYS = date(1900, 1, 1), 73_049  # to 2099-12-31

_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9À-ɏ][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
    |(?P<secret>(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*["']?(?P<value>[0-9A-Za-z_\-]{8,})(?![0-9A-Za-z_\-]))
    |(?P<iban>(?<![\w])(?-i:[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?)(?![\w]))
    |(?P<date>(?<![\w.])(?:\d{4}(?P<s1>[-/])\d{2}(?P=s1)\d{2}(?=T\d{2}|(?!\w))|\d{2}(?P<s2>[./-])\d{2}(?P=s2)\d{4}(?![\w])))
    |(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])(?!\.\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<card>(?<![\w])\d(?:[\ -]?\d){12,18}(?![\w]))
    |(?P<phone>(?<![\w])\+\d{1,3}[\ .-]?(?:\(\d{1,4}\)[\ .-]?)?\d{2,4}(?:[\ .-]?\d{2,4}){1,4}(?![\w])|(?<![\w(])\(\d{3}\)\ ?\d{3}-\d{4}(?![\w])|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))
    """,
    re.VERBOSE | re.IGNORECASE,
)
#: A text without these has nothing to find.
_ANY = re.compile(r"[0-9@=:]")
_IBAN_CASE = re.compile(r"[A-Z0-9 ]+")
_RUN = re.compile(r"\d(?:[ -]?\d)*")
_DIGITS = re.compile(r"\d+")


class Feistel:
    """Keyed permutations of ranges, bound to a name for each format."""

    def __init__(self, key: bytes) -> None:
        self.key = blake2b(key, digest_size=32).digest()

    def number(self, name: str, value: int, size: int) -> int:
        """The image of ``value`` in ``range(size)``."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        salt = f"{name}/{size}".encode()
        while True:
            left, right = value >> half, value & mask
            for turn in range(ROUNDS):
                mixed = self._stream(b"%d|%d|" % (turn, right) + salt, (half + 7) // 8 + 4)
                left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
            value = left << half | right
            if value < size:
                return value

    def _stream(self, about: bytes, size: int) -> bytes:
        """``size`` keyed bytes: one digest, or for more than it holds a counter's."""
        if size <= 64:
            return blake2b(about, key=self.key, digest_size=size).digest()
        seed = blake2b(about, key=self.key).digest()
        return b"".join(blake2b(b"%d" % k, key=seed).digest() for k in range(-(-size // 64)))[:size]

    def vector(self, name: str, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The image of a row of symbols, each in a range of its own size."""
        half = len(values) // 2
        parts, ranges = [values[:half], values[half:]], [sizes[:half], sizes[half:]]
        for turn in range(ROUNDS):
            own, other = turn % 2, 1 - turn % 2
            about = b"%d/%s/" % (turn, name.encode()) + parts[other].astype(np.uint8).tobytes()
            keys = np.frombuffer(self._stream(about, 8 * len(parts[own])), "<u8") % ranges[own].astype(np.uint64)
            parts[own] = (parts[own] + keys.astype(np.int64)) % ranges[own]
        return np.concatenate(parts)

    def until(self, name: str, value: int, size: int, valid: Callable[[int], bool]) -> int:
        """The image of a valid value among the valid ones."""
        while True:
            value = self.number(name, value, size)
            if valid(value):
                return value

    def symbols(self, name: str, text: str) -> str:
        """Digits and ASCII letters permuted as one number of mixed radix; case and all
        other characters stay."""
        sizes = [10 if c.isdigit() and c.isascii() else 26 if c.isalpha() and c.isascii() else 1 for c in text]
        if len(text) > SHORT:
            return self._long(name, text, sizes)
        value, total = 0, 1
        for c, n in zip(text, sizes, strict=True):
            if n > 1:
                value = value * n + (ord(c) - 48 if n == 10 else ord(c.lower()) - 97)
                total *= n
        shape = "".join("d" if n == 10 else "a" if n == 26 else c for c, n in zip(text, sizes, strict=True))
        value = self.number(name + shape, value, total)
        out = []
        for c, n in zip(reversed(text), reversed(sizes), strict=True):
            if n > 1:
                value, k = divmod(value, n)
                c = chr(48 + k) if n == 10 else chr(97 + k).upper() if c.isupper() else chr(97 + k)
            out.append(c)
        return "".join(reversed(out))

    def _long(self, name: str, text: str, sizes: list[int]) -> str:
        """``symbols`` of a long text."""
        places = [k for k, n in enumerate(sizes) if n > 1]
        values = np.array([ord(text[k]) - 48 if sizes[k] == 10 else ord(text[k].lower()) - 97 for k in places], np.int64)
        shape = blake2b("".join("d" if n == 10 else "a" if n == 26 else c for c, n in zip(text, sizes, strict=True)).encode("utf-8", "surrogatepass")).hexdigest()
        out = list(text)
        for k, v in zip(places, self.vector(name + shape, values, np.array([sizes[k] for k in places], np.int64)).tolist(), strict=True):
            out[k] = chr(48 + v) if sizes[k] == 10 else chr(97 + v).upper() if text[k].isupper() else chr(97 + v)
        return "".join(out)


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_rest(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _refill(shape: str, symbols: str) -> str:
    """``symbols`` in the places of letters and digits of ``shape``."""
    left = iter(symbols)
    return "".join(next(left) if c.isalnum() else c for c in shape)


def _date_parts(text: str) -> list[tuple[int, int, int]]:
    """``(year, month, day)`` places that make a date, the likeliest order first."""
    if text[4] in "-/":
        return [(0, 5, 8)]
    return [(6, 3, 0), (6, 0, 3)] if text[2] != "/" else [(6, 0, 3), (6, 3, 0)]


def _replace(feistel: Feistel, kind: str, text: str) -> str | None:
    """The pseudonym of a find, or None where its check fails."""
    digits = "".join(c for c in text if c.isdigit())
    if kind == "email":
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return feistel.symbols("local", local) + "@" + feistel.symbols("domain", host) + "." + top
    if kind == "card":
        if len(set(digits)) < 2 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = str(feistel.number("card", int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
        return _refill(text, body + luhn_digit(body))
    if kind == "iban":
        plain = text.replace(" ", "")
        if not _IBAN_CASE.fullmatch(text) or not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
            return None
        body = feistel.symbols("iban" + plain[:2], plain[4:])
        check = 98 - _iban_rest(plain[:2] + "00" + body)
        return _refill(text, f"{plain[:2]}{check:02d}{body}")
    if kind == "ipv4":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        value = feistel.number("ipv4", int.from_bytes(bytes(octets), "big"), 1 << 32)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "ssn":
        valid = lambda v: 0 < v // 10**6 < 900 and v // 10**6 != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0
        if not valid(int(digits)):
            return None
        return _refill(text, f"{feistel.until('ssn', int(digits), 10**9, valid):09d}")
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        head = len(re.match(r"\+(\d*)", text)[1]) if text[0] == "+" else 0
        if head and len(digits) - head < 6:
            head = 1
        rest = digits[head:]
        return _refill(text, digits[:head] + str(feistel.number("phone", int(rest), 10 ** len(rest))).zfill(len(rest)))
    if kind == "date":
        for year, month, day in _date_parts(text):
            try:
                there = (date(int(text[year : year + 4]), int(text[month : month + 2]), int(text[day : day + 2])) - FIRST_DAY).days
            except ValueError:
                continue
            if 0 <= there < DAYS:
                to = FIRST_DAY + timedelta(days=feistel.number("date", there, DAYS))
                out = list(text)
                out[year : year + 4], out[month : month + 2], out[day : day + 2] = f"{to.year:04d}", f"{to.month:02d}", f"{to.day:02d}"
                return "".join(out)
        return None
    return None


def pseudonymise(text: str, feistel: Feistel) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and ``(start, stop, kind)`` of the finds in the text as
    it was."""
    if not _ANY.search(text):
        return text, []
    out, spans, at, pos = [], [], 0, 0
    cards, run_end = {}, 0  # the cards of the digit groups up to there
    while found := _PATTERN.search(text, pos):
        kind = next(k for k in ("email", "secret", "iban", "date", "ipv4", "ssn", "card", "phone") if found[k] is not None)
        start, stop = found.span("value" if kind == "secret" else kind)
        whole = text[start:stop]
        if kind == "secret":
            new = (_hex(feistel, whole) if re.fullmatch("[0-9a-f]+|[0-9A-F]+", whole) else feistel.symbols("secret", whole)) if any(map(str.isdigit, whole)) else None
        elif kind == "card" and start < run_end:
            stop = cards.get(start, stop)
            new = _replace(feistel, kind, text[start:stop]) if start in cards else None
        else:
            new = _replace(feistel, kind, whole)
            if new is None and kind == "card":
                cards, run_end = _cards(text, start)
                stop = cards.get(start, stop)
                new = _replace(feistel, kind, text[start:stop]) if start in cards else None
            elif new is None and kind in ("iban", "phone"):
                # what follows the value may have been taken for its end
                for stop in [k for k in range(stop - 1, start, -1) if text[k - 1].isalnum() and not (text[k].isalnum() or text[k] == "_")]:
                    if (new := _replace(feistel, kind, text[start:stop])) is not None:
                        break
        if new is None:
            pos = found.start() + 1
            continue
        out += (text[at:start], new)
        at = pos = stop
        spans.append((start, stop, kind))
    return "".join(out) + text[at:], spans


def _cards(text: str, start: int) -> tuple[dict[int, int], int]:
    """The card numbers made of whole digit groups in the run of groups at ``start``, as
    start and stop, and the end of the run. Of overlapping ones the longest counts, then
    the first."""
    end = _RUN.match(text, start).end()
    groups = [m.span() for m in _DIGITS.finditer(text, start, end)]
    if text[end : end + 1].isalnum() or text[end : end + 1] == "_":
        groups.pop()
    valid = []
    for i in range(len(groups)):
        digits = ""
        for j in range(i, len(groups)):
            digits += text[slice(*groups[j])]
            if len(digits) > 19:
                break
            if len(digits) > 12 and len(set(digits)) > 1 and luhn_digit(digits[:-1]) == digits[-1]:
                valid.append((-len(digits), i, j))
    taken, chosen = set(), {}
    for _, i, j in sorted(valid):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            chosen[groups[i][0]] = groups[j][1]
    return chosen, end


def _hex(feistel: Feistel, text: str) -> str:
    if len(text) > SHORT:
        digits = np.array([int(c, 16) for c in text], np.int64)
        out = "".join(f"{v:x}" for v in feistel.vector(f"hex{len(text)}", digits, np.full(len(text), 16)).tolist())
        return out.upper() if text.isupper() else out
    value = feistel.number("hex", int(text, 16), 16 ** len(text))
    out = f"{value:x}".zfill(len(text))
    return out.upper() if text.isupper() else out


def key_of(spark, otherwise: bytes | None = None) -> bytes:
    """The key from the session's settings. Without one, and without a key that the
    caller names for tests, there are no pseudonyms: a public key could undo them."""
    key = spark.conf.get(KEY_SETTING, "").encode() or otherwise
    if not key:
        raise ValueError(f"set {KEY_SETTING} or pass a key")
    return key


def pseudonymise_texts(documents: DataFrame, key: bytes | None = None, report: bool = False) -> DataFrame:
    """The documents with pseudonyms in ``text``; ``report`` adds ``n_found`` and
    ``kinds`` (counts by kind)."""
    spark = documents.sparkSession
    ship(spark)
    key = key or key_of(spark)
    # columns by place, as names may hold anything
    names = [f"c{k}" for k in range(len(documents.columns))]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, documents.schema, strict=True)) + (", n_found long, kinds string" if report else "")
    types = arrow_types(documents, schema)
    place = documents.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                done = [(None, []) if x is None else pseudonymise(x, feistel) for x in batch.column(place).to_pylist()]
                columns = list(batch.columns)
                columns[place] = pa.array([x for x, _ in done], types.field(place).type)
                if report:
                    columns.append(pa.array([len(x) for _, x in done], pa.int64()))
                    columns.append(pa.array([",".join(f"{k}:{n}" for k, n in sorted(Counter(y[2] for y in x).items())) for _, x in done], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=types)

    return documents.toDF(*names).mapInArrow(giving_back(work), schema).toDF(*documents.columns, *(["n_found", "kinds"] if report else []))


def pii_report(documents: DataFrame, key: bytes | None = None) -> DataFrame:
    """``doc_id, text, n_found, kinds`` of every document."""
    return pseudonymise_texts(documents.select("doc_id", F.col("text")), key, report=True)
