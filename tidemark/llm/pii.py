"""Format-preserving pseudonyms of personal data in texts, by a keyed Feistel network.

Found values are validated (card numbers by Luhn's check digit, account numbers by
modulus 97, social-security and network numbers by their ranges, dates by the calendar;
telephone numbers by their form alone) and permuted within their own format: a valid number becomes another valid
number with the same punctuation, a date another date; telephone numbers in ranges that
aren't given out become others of these; numbers of other countries are left as they are.
Mail addresses (but for the last part of their domain) and access credentials of any length
have their letters and digits permuted, each within its own alphabet. The
permutation depends on the key, the kind and the value alone, so equal values stay linked
across documents however they are written, and the holder of the key can reverse it.

Texts are worked on whole. Null texts stay null, empty ones empty, both with zero counts.
Values that don't validate are left as they are. Rows are independent: repeats, ties and
extra columns (kept by pseudonymise(), whatever their names) don't matter.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import text_blocks, thrifty

ROUNDS = 8
#: Digits of the longest card.
MOST_CARD = 19

#: Values of more than LONG characters are permuted in pieces, so that a half of the network fits one digest.
LONG, PIECE = 128, 64

#: Used where no key is given; a production run sets its own in the session.
DEVELOPMENT_KEY = "tidemark development key"
KEY_SETTING = "spark.tidemark.pseudonyms.key"

KINDS = ("mail", "card", "account", "phone", "ssn", "address", "date", "secret")


class Feistel:
    """A keyed permutation of range(n) for any n: a balanced network over the next power of four, walked until it lands in the range."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, tweak: str, n: int, i: int, half: int, bits: int) -> int:
        """bits pseudo-random bits of one half."""
        message = f"{tweak}|{n}|{i}|{half}".encode()
        digest = hashlib.blake2b(message, key=self.key, digest_size=min(64, max(8, (bits + 7) // 8))).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _network(self, tweak: str, n: int, x: int, half: int, order: range) -> int:
        mask = (1 << half) - 1
        left, right = x >> half, x & mask
        forward = order.step > 0
        for i in order:
            if forward:
                left, right = right, left ^ self._round(tweak, n, i, right, half)
            else:
                left, right = right ^ self._round(tweak, n, i, left, half), left
        return left << half | right

    def permute(self, tweak: str, n: int, x: int, back: bool = False) -> int:
        if n < 2:
            return x
        half = ((n - 1).bit_length() + 1) // 2
        order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        while True:
            x = self._network(tweak, n, x, half, order)
            if x < n:
                return x


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """digits put where shape has digits."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Pseudonyms:
    """Finds and replaces; each method takes a match and returns its pseudonym, or None if it doesn't validate."""

    def __init__(self, key: str):
        self.feistel = Feistel(key)

    @staticmethod
    def is_card(text: str) -> bool:
        d = _digits(text)
        return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1

    def card(self, text: str, back: bool = False) -> str:
        d = _digits(text)
        n = len(d) - 2  # the first digit tells the network, the last one checks
        body = d[0] + str(self.feistel.permute(f"card{d[0]}", 10**n, int(d[1:-1]), back)).zfill(n)
        return _refill(text, body + luhn_digit(body))

    def cards(self, text: str, taken: list[tuple[int, int, str]], back: bool = False) -> list[tuple[int, int, str]]:
        """Spans and pseudonyms of the cards outside the taken spans, which are in order.

        Digit groups as cards are printed are tried first, wherever they stand in a run of
        groups, then the longest runs of any groups. What stands next to a card may make an
        overlapping span validate that was tried before it and didn't; the pseudonym is
        permuted again until none does, so that the way back finds the same spans.
        """
        starts = [a for a, _, _ in taken]

        def free(a: int, b: int, spans: list, firsts: list[int]) -> bool:
            i = bisect.bisect_left(firsts, b)
            return not i or spans[i - 1][1] <= a

        tried: list[tuple[int, int]] = []
        for run in self.GROUPS.finditer(text):
            ends = [(g.start() + run.start(), g.end() + run.start()) for g in re.finditer(r"[0-9]+", run[0])]
            sizes = [b - a for a, b in ends]
            for i in range(len(ends)):
                tried += [(ends[i][0], ends[i + len(p) - 1][1]) for p in self.PRINTED if tuple(sizes[i : i + len(p)]) == p]
        tried += [m.span() for m in self.ANY_GROUPS.finditer(text)]
        tried = [x for x in dict.fromkeys(tried) if free(*x, taken, starts)]
        found: list[tuple[int, int]] = []
        rank: list[int] = []
        for k, (a, b) in enumerate(tried):
            if self.is_card(text[a:b]):
                i = bisect.bisect_left(found, (b, 0))
                if not i or found[i - 1][1] <= a:
                    found.insert(i, (a, b))
                    rank.append(k)
        if not found:
            return []
        failed = sorted((a, b, k) for k, (a, b) in enumerate(tried) if not self.is_card(text[a:b]))
        now = list(text)
        for k in reversed(rank) if back else rank:
            a, b = tried[k]
            at = bisect.bisect_left(failed, (a - 2 * MOST_CARD, 0, 0))
            near = []
            while at < len(failed) and failed[at][0] < b:
                if failed[at][1] > a and failed[at][2] < k:
                    near.append(failed[at][:2])
                at += 1
            new = text[a:b]
            while True:
                new = self.card(new, back)
                now[a:b] = new
                if self.is_card(new) and not any(self.is_card("".join(now[c:d])) for c, d in near):
                    break
        return [(a, b, "".join(now[a:b])) for a, b in found]

    def account(self, m: re.Match, back: bool = False) -> str | None:
        text = re.sub(r"\s", "", m[0])
        country, check, body = text[:2], text[2:4], text[4:]
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 11 <= len(body) <= 30 or number(body + country + check) % 97 != 1:
            return None
        body = self._alphabets(f"account{country}", body, back)
        check = str(98 - number(body + country + "00") % 97).zfill(2)
        it = iter(country + check + body)
        return re.sub(r"\S", lambda _: next(it), m[0])

    def phone(self, m: re.Match, back: bool = False) -> str | None:
        d = _digits(m[0])
        country, d = d[:-10], d[-10:]
        if d[0] in "01" or d[3] in "01":  # no such number is given out; these are permuted among themselves
            x = int(d)
            while True:
                x = self.feistel.permute("phone10", 10**10, x, back)
                new = f"{x:010d}"
                if new[0] in "01" or new[3] in "01":
                    return _refill(m[0], country + new)
        x = (((int(d[0]) - 2) * 100 + int(d[1:3])) * 8 + int(d[3]) - 2) * 10**6 + int(d[4:])
        x = self.feistel.permute("phone", 8 * 100 * 8 * 10**6, x, back)
        x, tail = divmod(x, 10**6)
        x, exchange = divmod(x, 8)
        first, rest = divmod(x, 100)
        return _refill(m[0], f"{country}{first + 2}{rest:02d}{exchange + 2}{tail:06d}")

    def ssn(self, m: re.Match, back: bool = False) -> str | None:
        area, group, serial = m[0].split("-")
        valid = [a for a in (int(area),) if 0 < a < 900 and a != 666]
        if not valid or group == "00" or serial == "0000":
            return None
        a = valid[0] - 1 - (valid[0] > 666)
        x = self.feistel.permute("ssn", 898 * 99 * 9999, (a * 99 + int(group) - 1) * 9999 + int(serial) - 1, back)
        x, serial_ = divmod(x, 9999)
        a, group_ = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}-{group_ + 1:02d}-{serial_ + 1:04d}"

    def address(self, m: re.Match, back: bool = False) -> str | None:
        """Each number keeps its count of digits."""
        parts = m[0].split(".")
        if any(str(int(x)) != x or int(x) > 255 for x in parts) or int(parts[0]) in (0, 127, 255):
            return None
        ranges = [[v for v in range(*((0, 10), (10, 100), (100, 256))[len(x) - 1]) if i or v not in (0, 127, 255)] for i, x in enumerate(parts)]
        n, x = 1, 0
        for choice, part in zip(ranges, parts, strict=True):
            n, x = n * len(choice), x * len(choice) + choice.index(int(part))
        x = self.feistel.permute("address" + "".join(str(len(p)) for p in parts), n, x, back)
        out = []
        for choice in reversed(ranges):
            x, v = divmod(x, len(choice))
            out.append(str(choice[v]))
        return ".".join(reversed(out))

    def date(self, m: re.Match, back: bool = False) -> str | None:
        text = m[0]
        iso = text[4] in "-/."
        sep = text[4] if iso else text[2]
        a, b, c = text.split(sep)
        year, month, day = (int(a), int(b), int(c)) if iso else (int(c), int(b), int(a))
        american = not iso and month > 12 >= day
        if american:
            month, day = day, month
        if not (1900 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
            return None
        x = datetime.date(year, month, day).toordinal() - FIRST_DAY
        while True:
            x = self.feistel.permute("date", LAST_DAY - FIRST_DAY + 1, x, back)
            to = datetime.date.fromordinal(FIRST_DAY + x)
            if not american or to.day > 12:  # else it would read as day and month
                break
        if iso:
            return f"{to.year}{sep}{to.month:02d}{sep}{to.day:02d}"
        return f"{to.month:02d}{sep}{to.day:02d}{sep}{to.year}" if american else f"{to.day:02d}{sep}{to.month:02d}{sep}{to.year}"

    def _alphabets(self, tweak: str, text: str, back: bool = False) -> str:
        """Letters and digits of text permuted together, each within its alphabet; of a long text piece by piece."""
        if len(text) > LONG:
            return "".join(self._alphabets(f"{tweak}{len(text)}@{i}", text[i : i + PIECE], back) for i in range(0, len(text), PIECE))
        bases = [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in text]
        n, x = 1, 0
        for c, base in zip(text, bases, strict=True):
            if base > 1:
                n, x = n * base, x * base + (int(c) if base == 10 else ord(c.lower()) - 97)
        x = self.feistel.permute(f"{tweak}{len(text)}", n, x, back)
        out = []
        for c, base in zip(reversed(text), reversed(bases), strict=True):
            if base > 1:
                x, v = divmod(x, base)
                c = str(v) if base == 10 else chr((97 if c.islower() else 65) + v)
            out.append(c)
        return "".join(reversed(out))

    def mail(self, m: re.Match, back: bool = False) -> str | None:
        local, _, domain = m[0].partition("@")
        names, dot, top = domain.rpartition(".")
        other = f"{self._alphabets('domain', names, back)}{dot}{top}"
        plain = other if back else domain
        return f"{self._alphabets('mail' + plain.lower(), local, back)}@{other}"

    def _hex(self, text: str, where: str, back: bool) -> str:
        return f"{self.feistel.permute(f'hex{where}{len(text)}', 16 ** len(text), int(text, 16), back):0{len(text)}x}"

    def secret(self, m: re.Match, back: bool = False) -> str | None:
        text = m["value"]
        at = m.start("value") - m.start()
        if re.fullmatch(r"[0-9a-f]+", text):  # stays hexadecimal
            cuts = [(i, f"{len(text)}@{i}") for i in range(0, len(text), PIECE)] if len(text) > LONG else [(0, "")]
            text = "".join(self._hex(text[i : i + PIECE] if at else text, at, back) for i, at in cuts)
        elif text.startswith(("AKIA", "ASIA")):
            text = text[:4] + self._base32(text[4:], back)
        else:
            text = self._alphabets("secret", text, back)
        return m[0][:at] + text + m[0][at + len(m["value"]) :]

    def _base32(self, text: str, back: bool) -> str:
        letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        x = 0
        for c in text:
            x = x * 36 + letters.index(c)
        x = self.feistel.permute("base36", 36 ** len(text), x, back)
        out = ""
        for _ in text:
            x, v = divmod(x, 36)
            out = letters[v] + out
        return out

    #: In the order in which they are tried; what one has replaced, the next may not touch.
    PATTERNS: tuple[tuple[str, str], ...] = (
        ("mail", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
        ("secret", r"(?:(?<![A-Za-z0-9])(?P<value>(?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9]))"),
        ("secret", r"(?i:password|passwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[A-Za-z0-9_+/.-]{5,}[A-Za-z0-9_+/-])"),
        ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
        ("date", r"(?<![0-9A-Za-z./-])(?:[0-9]{4}(?P<s>[-/.])[0-9]{2}(?P=s)[0-9]{2}|[0-9]{2}(?P<t>[-/.])[0-9]{2}(?P=t)[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])"),
        ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        ("address", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
        ("phone", r"(?<![0-9A-Za-z(+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    )

    ANY_GROUPS = re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-]|\.[0-9])")
    GROUPS = re.compile(r"(?<![0-9A-Za-z.-])[0-9]+(?:[ -][0-9]+)*(?![0-9A-Za-z-]|\.[0-9])")
    #: Sizes of the digit groups of a card as printed; the longer ones first.
    PRINTED = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), *((n,) for n in range(19, 12, -1)))

    COMPILED = tuple((kind, re.compile(pattern)) for kind, pattern in PATTERNS)
    some = re.compile(r"[0-9@]|(?i:password|passwd|secret|token|key)")

    def replace(self, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
        """The text with its values replaced (or restored with back), and how many of each kind."""
        counts = dict.fromkeys(KINDS, 0)
        if not self.some.search(text):
            return text, counts
        spans: list[tuple[int, int, str]] = []
        for kind, pattern in self.COMPILED:
            if kind == "mail" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                at = bisect.bisect_left(spans, (m.end(),))  # spans are sorted and don't overlap: the last one that begins before the end decides
                if at and m.start() < spans[at - 1][1]:
                    continue
                new = getattr(self, kind)(m, back)
                if new is not None:
                    spans.insert(at, (m.start(), m.end(), new))
                    counts[kind] += 1
        own = self.cards(text, spans, back)
        counts["card"] += len(own)
        spans += own
        if not spans:
            return text, counts
        out, at = [], 0
        for a, b, new in sorted(spans):
            out += [text[at:a], new]
            at = b
        return "".join(out) + text[at:], counts


def _mapper(names: list[str], text_at: int, key: str, counts: bool) -> Callable:
    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in text_blocks(batches, names[text_at], most=1 << 20):
            found = [(None, dict.fromkeys(KINDS, 0)) if t is None else own.replace(t) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array([x[0] for x in found], pa.string())
            if counts:
                columns += [pa.array([x[1][k] for x in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=names + ([f"n_{k}" for k in KINDS] if counts else []))

    return run


def session_key(spark: SparkSession) -> str:
    """The key that the session names; without one the development key, which anyone can reverse, and a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} isn't set: pseudonyms are made with the public development key", stacklevel=2)
    return key or DEVELOPMENT_KEY


def pseudonymise(docs: DataFrame, key: str = DEVELOPMENT_KEY) -> DataFrame:
    """All columns of docs, text with pseudonyms in place of personal data."""
    return docs.mapInArrow(_mapper(docs.columns, docs.columns.index("text"), key, False), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def report(docs: DataFrame, key: str = DEVELOPMENT_KEY) -> DataFrame:
    """doc_id, the pseudonymised text and the number of values of each kind."""
    some = docs.select("doc_id", "text")
    return some.mapInArrow(_mapper(["doc_id", "text"], 1, key, True), T.StructType([*some.schema.fields, *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS)]))
