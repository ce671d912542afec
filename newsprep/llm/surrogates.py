"""PII: every detected entity becomes a keyed surrogate of its own kind.

A surrogate keeps what the kind and the format need and permutes the rest: digits among digits,
vowels among vowels, consonants among consonants, each within script and case. The permutation is a
Feistel network over all values of the same shape, keyed by the secret and the shape, made one cycle so
that no value stays as it is: equal entities get equal surrogates in every document and task, and
different ones different surrogates, without any table of what was seen. ``collisions`` checks that over a whole result.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which they claim text; an entity is the group ``x`` or the whole match.
KINDS: tuple[tuple[str, re.Pattern, str], ...] = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}+@(?:[\w-]{1,63}+\.)++[A-Za-z]{2,24}(?![\w-])"), "@"),
    ("secret", re.compile(r"(?<!\w)(?:AKIA|ASIA)(?P<x>[0-9A-Z]{16})(?!\w)"), "IA"),
    ("secret", re.compile(r"(?i)(?<!\w)(?:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<x>[\w+/.~-]{6,}+)"), "=:"),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}(?P<x>\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"), ""),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"), "."),
    ("card", re.compile(r"(?<![\w-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"), ""),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "-"),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])"), "-. "),
    ("person", re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora|Sr|Sra)\.? (?P<x>[^\W\d_]{2,30}(?:[ -][^\W\d_]{2,30}){0,2})"), " "),
)
#: Letters of a script, vowels first; a letter or digit that stands in none of them has those of its kind nearby, see ``_group``.
ALPHABETS = (
    ("aeiou", "bcdfghjklmnpqrstvwxyz"), ("áàâäãåéèêëíìîïóòôöõúùûü", "çñß"),
    ("αεηιουω", "βγδζθκλμνξπρστφχψ"), ("аеиоуыэюя", "бвгдзклмнпрстфхцчшщж"),
    ("اأإآويى", "بتثجحخدذرزسشصضطظعغفقكلمنه"), ("אהוי", "בגדזחטכלמנסעפצקרשת"),
)
#: Characters of a secret that are permuted as one number.
PIECE = 200
_CLASS = {c: group for pair in ALPHABETS for group in pair for c in group}
_CLASS |= {c.upper(): "".join(x.upper() for x in group if len(x.upper()) == 1) for c, group in _CLASS.items() if len(c.upper()) == 1}
_CLASS |= dict.fromkeys("0123456789", "0123456789")
_HEX = dict.fromkeys("0123456789abcdef", "0123456789abcdef")


@functools.cache
def _near(block: int, category: str) -> str:
    """Letters or digits of one category in a block of 128 code points, without those of ``ALPHABETS``."""
    every = map(chr, range(block << 7, (block + 1) << 7))
    return "".join(c for c in every if c.isalnum() and c not in _CLASS and unicodedata.category(c) == category)


@functools.cache
def _alone() -> str:
    """All that are the only ones of their block and category."""
    every = {(i >> 7, unicodedata.category(chr(i))) for i in range(0x110000) if chr(i).isalnum() and chr(i) not in _CLASS}
    return "".join(sorted(near for near in (_near(*x) for x in every) if len(near) == 1))


def _group(c: str) -> str | None:
    """The characters among which ``c`` is permuted; the groups do not overlap, and only what is no letter or digit has none."""
    if c in _CLASS or not c.isalnum():
        return _CLASS.get(c)
    near = _near(ord(c) >> 7, unicodedata.category(c))
    return near if len(near) > 1 else _alone()


def _feistel(number: int, half: int, key: bytes, back: bool) -> int:
    """Four keyed rounds over ``2 * half`` bits, or their inverse."""
    mask = (1 << half) - 1
    left, right = number >> half, number & mask
    for step in range(4):
        seen = left if back else right
        digest = hashlib.blake2b(bytes([3 - step if back else step]) + seen.to_bytes(half // 8 + 1, "big"), key=key, digest_size=64).digest()
        bits = int.from_bytes(digest * (half // 512 + 1), "big") & mask
        left, right = (right ^ bits, left) if back else (right, left ^ bits)
    return left << half | right


def _permute(number: int, size: int, key: bytes, good: Callable[[int], bool]) -> int:
    """A keyed bijection of the good numbers below ``size``: the next one in a keyed order of all of them.

    The order is a Feistel network walked until the value is below ``size``, and the last number is
    followed by the first. That is one cycle, so no number stays unless no other is good.
    """
    half = max(1, (size - 1).bit_length() + 1 >> 1)

    def walk(n: int, back: bool) -> int:
        n = _feistel(n, half, key, back)
        while n >= size:
            n = _feistel(n, half, key, back)
        return n

    place = walk(number, False)
    while True:
        place = (place + 1) % size
        number = walk(place, True)
        if good(number):
            return number


def _shaped(text: str, kind: str, secret: bytes, fixed: Callable[[int, str], bool] = lambda i, c: False, good: Callable[[str], bool] = lambda s: True, classes: Callable[[str], str | None] = _group) -> str:
    """``text`` with its free letters and digits permuted within their classes."""
    free = [(i, group) for i, c in enumerate(text) if not fixed(i, c) and (group := classes(c))]
    if not free:
        return text
    shape = list(text)
    for i, group in free:
        shape[i] = group[0]
    key = hashlib.blake2b(f"{kind}\0{''.join(shape)}\0{[i for i, _ in free]}".encode(), key=secret[:64], digest_size=32).digest()
    number, size = 0, 1
    for i, group in free:
        number, size = number * len(group) + group.index(text[i]), size * len(group)

    def spelled(n: int) -> str:
        out = list(text)
        for i, group in reversed(free):
            n, at = divmod(n, len(group))
            out[i] = group[at]
        return "".join(out)

    needs = good(text)  # values that break the rule of their kind are permuted among themselves
    return spelled(_permute(number, size, key, lambda n: good(spelled(n)) == needs))


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def _address(text: str, secret: bytes) -> str:
    """The surrogate of four octets, public or not as before; an octet with a leading zero is one of 00 to 09 and stays so."""
    octets = text.split(".")
    if not text.isascii():  # other digits: each among those of its script
        return _shaped(text, "ip", secret, good=lambda s: all(int(x) < 256 for x in s.split(".")))
    padded = [len(x) > 1 and x[0] == "0" for x in octets]
    number, size = 0, 1
    for x, short in zip(octets, padded, strict=True):
        base = 10 if short else 256
        number, size = number * base + int(x), size * base

    def split(n: int) -> list[int]:
        out = []
        for short in reversed(padded):
            n, x = divmod(n, 10 if short else 256)
            out.append(x)
        return out[::-1]

    public = lambda n: ipaddress.IPv4Address(bytes(split(n))).is_global
    was = public(number)
    shape = "".join(".0" if short else "." for short in padded) if any(padded) else ""
    key = hashlib.blake2b(f"ip{shape}".encode(), key=secret[:64], digest_size=32).digest()
    new = split(_permute(number, size, key, lambda n: public(n) == was))
    return ".".join(f"{x:02d}" if short else str(x) for x, short in zip(new, padded, strict=True))


def _secret(piece: str, after: str, secret: bytes) -> str:
    if re.fullmatch(r"[0-9a-f]+", piece):
        return _shaped(piece, f"hex{after}", secret, classes=_HEX.get)
    return _shaped(piece, f"secret{after}", secret, good=lambda s: not re.fullmatch(r"[0-9a-f]+", s))  # hex values are met by hex values only


def surrogate(kind: str, text: str, secret: bytes) -> str:
    """The surrogate of one entity."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        # The domain by itself, so that addresses of one domain stay in one domain.
        return f"{_shaped(local, f'local {domain.lower()}', secret)}@{_shaped(name, 'domain', secret)}.{top}"
    if kind == "ip":
        return _address(text, secret)
    if kind == "card":
        rest = _luhn(re.sub(r"\D", "", text))  # 0 for a valid number; kept
        # The last digit follows from the others and the rest, so it is no part of the key.
        body, zero = _shaped(text[:-1], f"card {rest}", secret, lambda i, c: i == 0), ord(text[-1]) - int(text[-1])
        return next(s for s in (body + chr(zero + d) for d in range(10)) if _luhn(re.sub(r"\D", "", s)) == rest)
    if kind == "phone":
        code = re.match(r"\+\d{1,3}", text)
        start = code.end() if code else 0
        return _shaped(text, kind, secret, lambda i, c: i < start, lambda s: re.sub(r"\D", "", s[start:])[:1] not in ("0", "1"))
    if kind == "person":  # each name by itself: a family keeps one name; the last letter stays, as it often shows the gender
        return re.sub(r"[^\W\d_]+", lambda m: _shaped(m[0], "name", secret, lambda i, c: i == len(m[0]) - 1), text)
    if kind == "secret":
        # Long values in pieces, so that the cost is linear; what was before a piece is part of its key.
        out, before = [], hashlib.blake2b(digest_size=16)
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            out.append(_secret(piece, f" {before.hexdigest()}" if i else "", secret))
            before.update(piece.encode())
        return "".join(out)
    return _shaped(text, kind, secret)


def detect(text: str) -> list[tuple[int, int, str]]:
    """Entities in order, as start, end and kind; earlier kinds win where two overlap."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray()
    digits = any(c in text for c in "0123456789")
    for kind, pattern, hint in KINDS:
        if hint and not any(c in text for c in hint) or kind in ("iban", "ip", "card", "ssn", "phone") and not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span("x") if "x" in pattern.groupindex else m.span()
            if kind == "phone" and not 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            if kind == "secret" and not any(map(str.isalnum, m["x"])):  # dots or dashes in place of a value
                continue
            taken = taken or bytearray(len(text))
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                found.append((a, b, kind))
    return sorted(found)


def replace(text: str | None, secret: bytes) -> tuple[str | None, list[tuple[str, str, str, int]]]:
    """The text with surrogates, and ``kind, entity, surrogate, start`` of each."""
    out, at, entities = [], 0, []
    for a, b, kind in detect(text or ""):
        new = surrogate(kind, text[a:b], secret)
        entities.append((kind, text[a:b], new, a))
        out += [text[at:a], new]
        at = b
    return (text if not entities else "".join([*out, text[at:]])), entities


def with_surrogates(docs: DataFrame, secret: bytes, text_col: str = "text", into: str = "entities") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and the found entities in ``into``.

    Null text stays null and empty text empty, without entities; an existing column ``into`` is
    replaced. Each row stands for itself, so repeated rows and ids give equal results. Ask for the
    entities only where the originals may be kept.
    """
    docs = docs.drop(into)
    kind = "array<struct<kind: string, entity: string, surrogate: string, start: int>>"
    entity = pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = x.schema.get_field_index(text_col)
            rows = [replace(text.as_py(), secret) for text in x.column(at)]
            columns = list(x.columns)
            columns[at] = pa.array([r[0] for r in rows], x.schema.field(at).type)
            columns.append(pa.array([[dict(zip(("kind", "entity", "surrogate", "start"), e, strict=True)) for e in r[1]] for r in rows], pa.list_(entity)))
            yield pa.RecordBatch.from_arrays(columns, names=[*x.schema.names, into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{into}` {kind}"])
    return docs.mapInArrow(run, schema)


def collisions(found: DataFrame, entities: str = "entities") -> DataFrame:
    """``kind, surrogate, originals`` of surrogates that stand for several entities: empty unless something is wrong."""
    each = found.select(F.explode(entities).alias("e")).select("e.kind", "e.entity", "e.surrogate").distinct()
    return each.groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).where("originals > 1")
