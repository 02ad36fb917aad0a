"""Personal data replaced by surrogates of the same type and form.

Detected: e-mail and IP addresses, telephone, card, account and social security numbers, secrets
given to a name or standing as long hexadecimal strings, and personal names (after a title, or a
known first name before a surname).  Each becomes a keyed surrogate:

* Characters are permuted within their class (digits, hexadecimal digits, small and capital
  letters, accented letters, vowels and consonants in names; letters of other scripts among those of
  their script, case and block) by a keyed Feistel network over all strings of that form, so two
  values of one form never share a first surrogate, and one value has the same in all documents
  where it need not be drawn again.  Separators, country prefixes and top-level domains stay; a
  card number keeps its check-digit status, an address stays private or public.
* Listed first names go to names of the same gender and script by a keyed permutation.
* Within a document a surrogate that equals another's, or any original there, is drawn again
  with the next counter, until it is free: listed first names after LISTED_DRAWS draws as any
  name of their form, all others after each DRAWS draws one character longer, addresses of
  the smaller private ranges in the largest.  What is drawn again depends on the document: there a value may
  have another surrogate than elsewhere, and one that a different value has elsewhere.  Later mentions of a part of a name get the part's surrogate.

A secret without a letter or digit (a line to be filled in) is none.  Null texts stay null, empty
ones empty; repeated rows get equal results.  The key is the caller's: who has it can undo the permutations.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from placemetrics.llm.common import documents

#: Key of the registered query, whose results are compared between runs; real data need one of their own.
QUERY_KEY = "key of the registered query"
KINDS = ("email", "ip", "phone", "card", "account", "social", "secret", "name")

FIRST_NAMES = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Emma Clara Elena Sara Lucia Marie Claire Camille Eva Lena Helga Ingrid Carmen Isabel Alice Emily Olivia Grace Nora".split(),
    ("latin", "m"): "Paul Thomas Peter Martin David Daniel Lucas Hugo Pierre Jean Louis Hans Karl Jürgen Klaus Carlos Juan Miguel Pablo James John Robert Henry Oliver".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Андрей Николай Михаил".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Mme Mlle Madame Sra Señora Doña".split(), "m": "Mr Herr Monsieur Sr Señor Don".split(),
          "": "Dr Prof Professor".split()}
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
            "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
            "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
            "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_SPOKEN = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", *_CLASSES[3:5],
           "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", *_CLASSES[7:])
#: Draws from the list of first names, and draws before a form gets more room.
LISTED_DRAWS, DRAWS = 64, 1000
_HEX = ("0123456789abcdef",)


def permuted(value: int, size: int, key: bytes, about: str) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network, walked on until it lands inside."""
    if size < 2:
        return value
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for turn in range(8):
            h = hashlib.blake2b(right.to_bytes(width, "big"), key=key, person=bytes([turn]), salt=hashlib.blake2b(about.encode(), digest_size=16).digest(),
                                digest_size=min(64, max(8, width)))
            drawn = h.digest() if width <= 64 else hashlib.shake_256(h.digest()).digest(width)
            left, right = right, left ^ (int.from_bytes(drawn, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


@cache
def _own_class(ch: str) -> str:
    """The letters of a letter's script and case in its block of 128 characters."""
    def kind(c: str) -> tuple[str, str]:
        return unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]

    known = "".join(_CLASSES)
    if not ch.isalpha() or ch in known:
        return ""
    first = ord(ch) & ~127
    return "".join(c for c in map(chr, range(first, first + 128)) if c.isalpha() and kind(c) == kind(ch) and c not in known)


def reformed(text: str, key: bytes, about: str, classes: tuple[str, ...] = _CLASSES) -> str:
    """``text`` permuted among all strings with the same class of character at each place."""
    found = [next((c for c in classes if ch in c), "") or _own_class(ch) for ch in text]
    size = value = 0
    for ch, members in zip(text, found, strict=True):
        if members:
            size = (size or 1) * len(members)
            value = value * len(members) + members.index(ch)
    if size < 2:
        return text
    form = "".join(str(classes.index(c)) if c in classes else f"[{c[0]}]" if c else ch for ch, c in zip(text, found, strict=True))
    value = permuted(value, size, key, f"{about}|{form}")
    out = []
    for ch, members in zip(reversed(text), reversed(found), strict=True):
        if members:
            value, k = divmod(value, len(members))
            out.append(members[k])
        else:
            out.append(ch)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _digits_into(form: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdecimal() else c for c in form)


def _card(value: str, key: bytes, about: str) -> str:
    digits = "".join(c for c in value if c.isdecimal())
    off = (int(digits[-1]) - _luhn(digits[:-1])) % 10
    body = reformed(digits[:-1], key, about)
    return _digits_into(value, body + str((_luhn(body) + off) % 10))


def _phone(value: str, key: bytes, about: str) -> str:
    start = re.match(r"\+\d{1,3}(?=\D)|\+\d", value)
    kept = start[0] if start else ""
    return kept + reformed(value[len(kept) :], key, about + kept)


def _ip(value: str, key: bytes, about: str) -> str:
    if ":" in value:
        return reformed(value.lower(), key, about, ("0123456789abcdef",))
    a, b, c, d = (int(x) for x in value.split("."))
    number = ((a << 8 | b) << 8 | c) << 8 | d
    for base, bits in ((10 << 24, 24), ((192 << 8 | 168) << 16, 16), ((172 << 4 | 1) << 20, 20), (127 << 24, 24)):
        if number >> bits == base >> bits:
            number = base | permuted(number & ((1 << bits) - 1), 1 << bits, key, f"{about}{base}")
            break
    else:
        number = permuted(number, 1 << 32, key, about)
        while number >> 24 in (10, 127) or number >> 16 == 192 << 8 | 168 or number >> 20 == 172 << 4 | 1:
            number = permuted(number, 1 << 32, key, about)
    return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))


def _email(value: str, key: bytes, about: str) -> str:
    local, _, domain = value.rpartition("@")
    rest, _, top = domain.rpartition(".")
    return f"{reformed(local + '@' + rest, key, about)}.{top}"


def _secret(value: str, key: bytes, about: str) -> str:
    return reformed(value, key, about, _HEX if re.fullmatch(r"[0-9a-f]+", value) else _CLASSES)


def script(word: str) -> str:
    return unicodedata.name(next((c for c in word if c.isalpha()), "a"), "LATIN").split()[0].lower()


def gender(first: str) -> str:
    return next((g for (_, g), names in FIRST_NAMES.items() if first in names), "")


def first_name(value: str, key: bytes, about: str, known_gender: str = "") -> str:
    """A name of the same script and gender where the name is listed, else one of the same form."""
    for (kind, g), names in FIRST_NAMES.items():
        if value in names:
            return names[permuted(names.index(value), len(names), key, about + kind + g)]
    return reformed(value, key, about + known_gender, _SPOKEN)


def _surname(value: str, key: bytes, about: str) -> str:
    return reformed(value, key, about, _SPOKEN)


MAKERS: dict[str, Callable[[str, bytes, str], str]] = {
    "email": _email, "ip": _ip, "phone": _phone, "card": _card, "account": reformed, "social": reformed, "secret": _secret}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GIVEN_SECRET = re.compile(r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)([A-Za-z0-9_\-+/]{8,})")
_LONG_IP = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
_PATTERNS = (
    ("email", re.compile(r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("secret", _GIVEN_SECRET),
    ("secret", re.compile(r"\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,}\b")),
    ("ip", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)")),
    ("ip", _LONG_IP),
    ("account", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("social", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)")),
    ("phone", re.compile(r"(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])")),
)
_ANY_TITLE = "|".join(sorted((t for group in TITLES.values() for t in group), key=len, reverse=True))
_NAME = r"[^\W\d_][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_TITLED = re.compile(rf"\b({_ANY_TITLE})\.? ({_NAME})(?: ({_NAME}))?")
_FIRST = re.compile(rf"\b({'|'.join(n for names in FIRST_NAMES.values() for n in names)}) ({_NAME})")
_DIGIT = re.compile(r"\d")


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, detail) of what is found, in order, without overlaps; the first kind wins."""
    found: list[tuple[int, int, str, str]] = []
    digit = _DIGIT.search(text)
    for kind, pattern in _PATTERNS:
        # a given secret and a long address may be letters alone; all others but e-mail addresses have a digit
        if "@" in text if kind == "email" else digit or pattern is _GIVEN_SECRET or pattern is _LONG_IP:
            for m in pattern.finditer(text):
                if kind != "secret" or any(map(str.isalnum, m[m.lastindex or 0])):
                    found.append((*m.span(m.lastindex or 0), kind, ""))
    for pattern in (_TITLED, _FIRST):
        for m in pattern.finditer(text):
            title = m[1] if pattern is _TITLED else ""
            names = [k for k in ((2, 3) if title else (1, 2)) if m[k] and m[k][0] == m[k][0].title()]
            g = next((g for g, titles in TITLES.items() if title in titles), "")
            if not title and len(names) < 2:
                continue
            for n, k in enumerate(names):
                part = "first" if n == 0 and (len(names) > 1 or gender(m[k])) else "last"
                found.append((*m.span(k), "name", f"{part}{g or (gender(m[k]) if part == 'first' else '')}"))
    out: list[tuple[int, int, str, str]] = []
    kept: list[tuple[int, int]] = []
    for a, b, kind, detail in found:
        at = bisect(kept, (a, b))
        if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
            kept.insert(at, (a, b))
            out.append((a, b, kind, detail))
    return sorted(out)


def roomier(kind: str, value: str, times: int) -> str:
    """``value`` in a form with more surrogates, where ``times`` rounds of draws found none free."""
    if times and kind in ("name", "secret"):
        return value + "a" * times
    if times and kind in ("phone", "card", "account", "social"):
        return value + "0" * times
    if times and kind == "email":
        return "a" * times + value
    if times and kind == "ip" and re.match(r"192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.", value):
        return "10." + value.split(".", 1)[1]
    return value


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, original, surrogate) of each place in order."""
    found = entities(text)
    if not found:
        return text, []
    originals = {text[a:b] for a, b, _, _ in found}
    chosen: dict[str, tuple[str, str]] = {}
    used: set[str] = set()
    for a, b, kind, detail in found:
        value = text[a:b]
        if value in chosen:
            continue
        for attempt in count():
            about = kind if attempt == 0 else f"{kind}#{attempt}"
            form = roomier(kind, value, attempt // DRAWS)
            if kind != "name":
                new = MAKERS[kind](form, key, about)
            elif detail.startswith("first") and attempt < LISTED_DRAWS:
                new = first_name(form, key, about + "first", detail[5:])
            elif detail.startswith("first"):
                new = reformed(form, key, about + "first" + detail[5:], _SPOKEN)
            else:
                new = _surname(form, key, about + "last")
            if new not in used and new not in originals:
                break
        chosen[value] = (kind, new)
        used.add(new)
    names = sorted((v for v, (kind, _) in chosen.items() if kind == "name"), key=len, reverse=True)
    if names:  # later mentions of a part of a name
        spans = [(a, b) for a, b, _, _ in found]
        covered = set(spans)
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, names))})\b", text):
            if m.span() not in covered and not any(a < m.end() and m.start() < b for a, b in spans):
                found.append((*m.span(), "name", ""))
        found.sort()
    out, at, log = [], 0, []
    for a, b, _, _ in found:
        kind, new = chosen[text[a:b]]
        out += [text[at:a], new]
        log.append((kind, text[a:b], new))
        at = b
    return "".join([*out, text[at:]]), log


@cache
def _derived(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in its texts, plus n_entities and, for each kind, n_<kind>.

    Columns of the input with these names are replaced.
    """
    added = ["n_entities", *(f"n_{k}" for k in KINDS)]
    docs = docs.drop(*added)
    names, text_at = docs.columns, docs.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(text_at).to_pylist():
                new, log = (None, []) if text is None else replaced(text, _derived(key))
                texts.append(new)
                counts.append([len(log), *(sum(kind == k for kind, _, _ in log) for k in KINDS)])
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            numbers = [pa.array([c[k] for c in counts], pa.int32()) for k in range(len(added))]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], [*names, *added])

    return docs.mapInArrow(replace, T.StructType([*docs.schema.fields, *(T.StructField(a, T.IntegerType()) for a in added)]))


def op9_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return with_surrogates(documents(spark, folder).select("doc_id", "text"), QUERY_KEY)
