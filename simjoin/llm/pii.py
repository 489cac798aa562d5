"""Format-preserving pseudonyms for personal data.

A validated number, date, address or name of a mailbox is permuted within its own format by
a keyed Feistel network: cards stay valid cards, dates stay dates, and equal values become
equal pseudonyms in every document, so that they stay linked, and none stays as it is. Who
has the key can invert it: where a value begins and ends follows from shapes, which
pseudonyms keep, and not from digits.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Characters that are permuted as one number; longer names take several.
BLOCK = 64
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of 0 .. n - 1 for any n, by walking cycles of a balanced network."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        data = b"%d|%d|%d|%b" % (i, bits, half, tweak)
        size = -(-bits // 8)
        out = b"".join(hashlib.blake2b(data, key=self.key, digest_size=min(64, size), person=b"%d" % k).digest() for k in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, i, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, i, right, bits)
        return left << bits | right

    def _image(self, x: int, n: int, bits: int, tweak: bytes, back: bool) -> int:
        while True:
            x = self._once(x, bits, tweak, back)
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: bytes, back: bool = False, valid: Callable[[int], bool] | None = None) -> int:
        """The image of x in 0 .. n - 1; with ``valid``, of a valid x among the valid numbers.

        A number becomes the next one, or the next valid one, in a secret order of all. So
        none stays as it is, unless it is the only one.
        """
        if n < 2:
            return x
        bits = max(1, -(-(n - 1).bit_length() // 2))
        at = self._image(x, n, bits, tweak, False)
        while True:
            at = (at + (-1 if back else 1)) % n
            x = self._image(at, n, bits, tweak, True)
            if valid is None or valid(x):
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` and it a valid number."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


_ASCII = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(maxsize=4_096)
def alphabet(c: str) -> str:
    """The characters that one becomes, itself among them.

    For others than ASCII: the letters, or digits, of its 256 code points that have its
    category and, like it or unlike it, are in Unicode's composed form.
    """
    for own in _ASCII:
        if c in own:
            return own
    if c < "\x80" or not c.isalnum():
        return c
    like = lambda x: (x.isalnum(), unicodedata.category(x), unicodedata.normalize("NFC", x) == x)
    first = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(max(first, 0x80), first + 256)) if like(x) == like(c))


def _permute_block(f: Feistel, text: str, tweak: bytes, back: bool) -> str:
    own = [alphabet(c) for c in text]
    n, x = 1, 0
    for c, letters in zip(text, own, strict=True):
        x, n = x * len(letters) + letters.index(c), n * len(letters)
    shape = "".join(letters[0] for letters in own).encode("utf-8", "surrogatepass")
    x = f.permute(x, n, tweak + b"|" + shape, back)
    out = []
    for letters in reversed(own):
        x, d = divmod(x, len(letters))
        out.append(letters[d])
    return "".join(reversed(out))


def permute_text(f: Feistel, text: str, tweak: bytes, back: bool = False) -> str:
    """Digits become digits and letters letters of their case and script; other characters stay.

    Texts longer than a block are permuted block by block, each by its place.
    """
    return "".join(_permute_block(f, text[at : at + BLOCK], tweak + (b"|%d" % at if at else b""), back) for at in range(0, len(text), BLOCK))


def _refill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


@dataclass(frozen=True)
class Kind:
    """What to look for, and how a match becomes its pseudonym (None: not valid, left alone)."""

    name: str
    pattern: re.Pattern
    needs: str  # a character without which no text has this kind
    swap: Callable[[Feistel, str, bool], str | None] | None = None
    find: Callable[[str], Iterator[tuple[int, int]]] | None = None  # instead of the pattern's own matches
    parts: Callable[[Feistel, str, bool], list[tuple[int, int, str]]] | None = None  # instead, of matches that may hold several


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ backwards, so that a long run of characters is walked once."""
    at, free = text.find("@"), 0
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > free and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def _email(f: Feistel, m: str, back: bool) -> str | None:
    local, _, domain = m.rpartition("@")
    if all(len(alphabet(c)) < 2 for c in local):
        return None
    return f"{permute_text(f, local, b'email|' + domain.lower().encode(), back)}@{domain}"


def _is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1


def _card(f: Feistel, m: str, back: bool, fits: Callable[[str], bool] = lambda new: True) -> str | None:
    d = re.sub(r"\D", "", m)
    if not _is_card(d):
        return None
    n = len(d) - 1
    told = lambda x: (p := f"{x:0{n}d}") + luhn_digit(p)
    # numbers of one repeated digit are no cards, so none becomes one
    new = f.permute(int(d[:-1]), 10**n, b"card", back, lambda x: len(set(told(x))) > 1 and fits(_refill(m, told(x))))
    return _refill(m, told(new))


#: How cards are usually grouped.
LAYOUTS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))


def _groups(run: str) -> list[tuple[int, int]]:
    return [x.span() for x in re.finditer(r"\d+", run)]


def _candidates(run: str, groups: list[tuple[int, int]], low: int, high: int) -> list[tuple]:
    """The valid cards of whole groups that begin in groups low to high - 1: (order, first group, last group).

    Sums of digits from the left, with every second one doubled, tell whether any stretch
    ends in its check digit, so no stretch is read by itself.
    """
    digits = "".join(run[s:e] for s, e in groups)
    ends, sums, same, parted = [0], ([0], [0]), [], [0] * len(groups)
    for s, e in groups:
        ends.append(ends[-1] + e - s)
    for k, d in enumerate(digits):
        v = ord(d) - 48
        doubled = 2 * v - 9 * (v > 4)
        sums[k % 2].append(sums[k % 2][-1] + v)  # digits at places of k's parity are as they are
        sums[1 - k % 2].append(sums[1 - k % 2][-1] + doubled)
        same.append(k if not k or d != digits[k - 1] else same[-1])  # where the stretch of one digit begins
    between = [run[groups[g][1]] for g in range(len(groups) - 1)]
    for g in range(1, len(between)):
        parted[g] = parted[g - 1] if between[g] == between[g - 1] else g
    found = []
    for i in range(low, high):
        for j in range(i, len(groups)):
            a, b = ends[i], ends[j + 1]
            if b - a > 19:
                break
            own = sums[(b - 1) % 2]
            if b - a < 13 or (own[b] - own[a]) % 10 or same[b - 1] <= a:
                continue
            whole = j - i + 1 == len(groups)
            if whole or j - i < 2 or parted[j - 1] <= i:
                usual = i == j or tuple(e - s for s, e in groups[i : j + 1]) in LAYOUTS
                found.append(((not whole, not usual, a - b, groups[i][0]), i, j))
    return found


def _chosen(found: list[tuple], groups: list[tuple[int, int]]) -> list[tuple]:
    """The candidates that are taken, by place."""
    taken, out = bytearray(len(groups)), []
    for order, i, j in sorted(found):
        if not any(taken[i : j + 1]):
            taken[i : j + 1] = b"\1" * (j + 1 - i)
            out.append((order, i, j))
    return sorted(out, key=lambda x: x[1])


def card_parts(run: str) -> list[tuple[int, int]]:
    """Where in a run of groups of digits the cards are, in order.

    The whole run is tried first, then groups in the usual layouts, then all others with
    one separator, longest first; always whole groups. A part that is taken blocks others.
    """
    groups = _groups(run)
    return [(groups[i][0], groups[j][1]) for _, i, j in _chosen(_candidates(run, groups, 0, len(groups)), groups)]


def _cards(f: Feistel, run: str, back: bool) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of the cards in a run; they are found in the same places in the run of pseudonyms.

    For that, a candidate that a pseudonym makes across its borders must not go before it,
    unless another part blocks that candidate. A candidate has at most 19 groups, so only
    groups that near are looked at.
    """
    groups, out = _groups(run), []
    parts = _chosen(_candidates(run, groups, 0, len(groups)), groups)
    owner: list[tuple | None] = [None] * len(groups)
    for order, i, j in parts:
        owner[i : j + 1] = [order] * (j + 1 - i)
    digits = [run[s:e] for s, e in groups]  # as they are after the cards before
    for order, i, j in reversed(parts) if back else parts:
        low, high = max(0, i - 19), min(len(groups), j + 20)
        base, start, end = groups[low][0], groups[i][0], groups[j][1]
        near = [(s - base, e - base) for s, e in groups[low:high]]

        def fits(new: str, order=order, i=i, j=j, low=low, high=high, base=base, near=near) -> bool:
            text = _refill(run[base : groups[high - 1][1]], "".join([*digits[low:i], re.sub(r"\D", "", new), *digits[j + 1 : high]]))
            for (*kind, at), a, b in _candidates(text, near, 0, j + 1 - low):
                mine, blocks = (*kind, at + base), owner[low + a : low + b + 1]
                if b >= i - low and mine < order and not any(o and o < mine for o in blocks):
                    return False
            return True

        new = _card(f, _refill(run[start:end], "".join(digits[i : j + 1])), back, fits)
        out.append((start, end, new))
        for k in range(i, j + 1):
            digits[k] = new[groups[k][0] - start : groups[k][1] - start]
    return sorted(out)


def _ssn(f: Feistel, m: str, back: bool) -> str | None:
    ok = lambda x: (a := x // 10**6) not in (0, 666) and a < 900 and x // 10**4 % 100 and x % 10**4
    x = int(m.replace("-", ""))
    return _refill(m, f"{f.permute(x, 10**9, b'ssn', back, lambda v: bool(ok(v))):09d}") if ok(x) else None


_PHONE = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
#: Country codes of one and two digits; the others have three.
_CODES = re.compile("[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")


def _phone(f: Feistel, m: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", m)
    if re.fullmatch(_PHONE, m):
        keep = len(d) - 10  # the country's code
    elif "." in m and (" " in m or "-" in m):
        return None
    else:
        keep = len(code[0]) if (code := _CODES.match(d)) else 3
    n = len(d) - keep
    return _refill(m, d[:keep] + f"{f.permute(int(d[keep:]), 10**n, b'phone|' + d[:keep].encode(), back):0{n}d}")


def _ip(f: Feistel, m: str, back: bool) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(f: Feistel, m: str, back: bool) -> str | None:
    text = m.replace(" ", "")
    if not 15 <= len(text) <= 34 or mod97(text[4:] + text[:4]) != 1:
        return None
    body = permute_text(f, text[4:], b"iban|" + text[:2].encode(), back)
    new = iter(f"{text[:2]}{98 - mod97(body + text[:2] + '00'):02d}{body}")
    return "".join(c if c == " " else next(new) for c in m)


def _date(f: Feistel, m: str, back: bool) -> str | None:
    parts = re.split(r"[-./]", m)
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy") if "." in m or "-" in m else ("mdy", "dmy")
    for order in orders:
        v = dict(zip(order, parts, strict=True))
        try:
            day = datetime.date(*(int(v[k]) for k in "ymd")).toordinal()
        except ValueError:
            continue
        if not _FIRST <= day <= _LAST:
            continue
        # a date and its image are read in the same order, if the digits leave a choice
        fits = lambda x: order == orders[0] or datetime.date.fromordinal(_FIRST + x).day > 12  # noqa: B023, E731
        new = datetime.date.fromordinal(_FIRST + f.permute(day - _FIRST, _LAST - _FIRST + 1, b"date" if order == orders[0] else b"date|" + order.encode(), back, fits))
        text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return "".join(x + s for x, s in zip((text[k] for k in order), [*re.findall(r"[-./]", m), ""], strict=True))
    return None


def _shape(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\d", "[0-9]"))  # digits of other scripts would not come back


# Of overlapping matches the kind listed first wins, then the earlier.
KINDS = (
    Kind("email", _DOMAIN, "@", _email, _emails),
    Kind("iban", _shape(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]|[./-]\d)"), "", _iban),
    Kind("card", _shape(r"(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-]|\.\d)"), "", parts=_cards),
    Kind("ssn", _shape(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "-", _ssn),
    Kind("phone", _shape(rf"(?<![\w+])(?<!\d\.){_PHONE}(?!\w)|(?<![\w+])\+[1-9](?:(?: ?\(|[ .-])?\d\)?){{7,14}}(?!\w|\.\d)"), "", _phone),
    Kind("date", _shape(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}([./-])\d{2}\1\d{4})(?![\w/-])"), "", _date),
    Kind("ip", _shape(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), ".", _ip),
)
_ANY = re.compile("[0-9@]")


def spans(text: str, f: Feistel, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of what is found, in order, without overlaps."""
    if not _ANY.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []
    for kind in KINDS:
        if kind.needs not in text:
            continue
        taken, at, more = found, 0, []  # both in order, so one walk finds the overlaps
        # what has the shape of another number, whatever its digits, is so in the text of pseudonyms too
        shapes, seen = sorted(x.span() for k in KINDS if k.name in ("iban", "ssn", "phone", "date") for x in k.pattern.finditer(text)) if kind.parts else [], 0
        for first, end in kind.find(text) if kind.find else (m.span() for m in kind.pattern.finditer(text)):
            while at < len(taken) and taken[at][1] <= first:
                at += 1
            if kind.parts:
                # what is left of the match between those that were taken and those shapes
                while seen < len(shapes) and max(shapes[seen]) <= first:
                    seen += 1
                held, k = [], seen
                while k < len(shapes) and shapes[k][0] < end:
                    held.append(shapes[k])
                    k += 1
                k = at
                while k < len(taken) and taken[k][0] < end:
                    held.append(taken[k][:2])
                    k += 1
                runs, start = [(first, text[first:end])], first
                if held:
                    runs = []
                    for s, e in [*sorted(held), (end, end)]:
                        if start < s:
                            runs += [(r.start(), r[0]) for r in kind.pattern.finditer(text, start, s)]
                        start = max(start, e)
                more += [(r + s, r + e, kind.name, new) for r, part in runs for s, e, new in kind.parts(f, part, back)]
            elif (at == len(taken) or taken[at][0] >= end) and (new := kind.swap(f, text[first:end], back)) is not None:
                more.append((first, end, kind.name, new))
        found = sorted([*found, *more])
    return found


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def pseudonymised(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """The rows, with all their columns, their text pseudonymised with a secret ``key``.

    Adds ``pii``, an array of (start, end, kind) of what was replaced, by code points of the
    input; a column of that name is replaced. n_chars, where present as an integer column,
    follows the new text. With ``back``, pseudonyms become the values again. The time of a
    text grows with its length, whatever it holds.

    A null text stays null and an empty one empty. Rows are taken each by itself, in one
    narrow pass, so repeated rows, null ids and empty tables need nothing special.
    """
    columns = [c for c in docs.columns if c != "pii"]
    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    text_at, chars_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                data = part.column(text_at).to_pylist()
                found = [spans(t or "", f, back) for t in data]
                new = [t if t is None or not s else replaced(t, s) for t, s in zip(data, found, strict=True)]
                arrays = list(part.columns)
                arrays[text_at] = pa.array(new, part.schema.field(text_at).type)
                if chars_at is not None and pa.types.is_integer(arrays[chars_at].type):
                    held = arrays[chars_at].to_pylist()
                    arrays[chars_at] = pa.array([len(t) if s and t is not None else n for t, s, n in zip(new, found, held, strict=True)], arrays[chars_at].type)
                arrays.append(pa.array([[{"start": s, "end": e, "kind": k} for s, e, k, _ in x] for x in found], found_type))
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "pii"])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, kind + ", pii array<struct<start:long,end:long,kind:string>>")
