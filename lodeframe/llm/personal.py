"""Personal data in plain and in disguise: e-mail addresses, IPv4 addresses, card and phone numbers.

Base spans are those of fixed patterns in the text as it stands.  Then
transducers rewrite a copy of the text, and every character that they write
remembers the characters it was read from: look-alike characters become ASCII
and invisible ones go; spelled digits become digits; ``at`` and ``dot``, in
brackets or as words, become signs where an address can be read around them.
The patterns run on the copy, and what they find is mapped back to the source.
Spans that no transducer had a part in are the base's own and aren't added.

Scans are linear in the text: a run that fails is not tried again from within.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import in_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}|[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Look-alikes of Latin letters that Unicode's compatibility forms don't name.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ս": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "օ": "o", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "﹫": "@", "ⓐ": "a",
    "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-",
    "➀": "1", "➁": "2", "➂": "3", "➃": "4", "➄": "5", "➅": "6", "➆": "7", "➇": "8", "➈": "9",
}
# Characters that are not seen.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"
# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "ein": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Signs as words.
AT_WORDS = ["at", "arobase", "arroba", "klammeraffe", "ät"]
DOT_WORDS = ["dot", "punkt", "point", "punto", "period"]
PLUS_WORDS = ["plus", "más"]
DASH_WORDS = ["dash", "hyphen", "minus", "bindestrich", "tiret", "guion", "guión"]
# Last labels that an address written with bare words must end in.
LAST_LABELS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "co", "ai", "app", "dev", "me", "tv", "eu", "de", "fr", "es", "it", "nl", "be", "ch", "at", "pt", "pl", "se", "no", "dk", "fi", "ie",
    "uk", "us", "ca", "mx", "br", "ar", "cl", "au", "nz", "jp", "cn", "in", "ru", "za", "kr", "test", "example", "invalid", "local",
]


# Base spans


def emails(text: str) -> list[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: each begins with the whole run before its sign."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        # The run before the next sign begins behind this one at the earliest.
        done = max(done, at + 1)
        at = text.find("@", done)
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if "." in m[0] and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() < 40 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


_FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


# Transducers


class Copy:
    """A rewritten text; ``source(start, end)`` are the characters that a part of it was read from.

    ``edits`` are (start, end, characters) over the text before, in order.
    """

    def __init__(self, before: str, edits: list[tuple[int, int, str]]) -> None:
        #: Where the pieces of the copy begin in it, where in the text before, and where a rewritten one ends there; -1: kept as it is.
        self.at: list[int] = []
        self.origin: list[int] = []
        self.ends: list[int] = []
        pieces: list[str] = []
        old = new = 0
        for start, end, text in [*edits, (len(before), len(before), "")]:
            for origin, stop, piece in ((old, -1, before[old:start]), (start, end, text)):
                if piece:
                    self.at.append(new)
                    self.origin.append(origin)
                    self.ends.append(stop)
                    pieces.append(piece)
                    new += len(piece)
            old = end
        self.text = "".join(pieces)

    def source(self, start: int, end: int) -> Span:
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.origin[a] + (0 if self.ends[a] >= 0 else start - self.at[a])
        last = self.ends[b] if self.ends[b] >= 0 else self.origin[b] + end - self.at[b]
        return first, last


@lru_cache(maxsize=1)
def characters() -> dict[int, str]:
    """ASCII for each character that looks like it: compatibility forms, decimal digits, and the look-alikes."""
    table = {}
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        if len(form) == 1 and " " <= form <= "~":
            table[code] = form
        elif c.isdecimal():
            table[code] = str(unicodedata.decimal(c))
    return table | {ord(c): x for c, x in LOOK_ALIKES.items()}


def _words(words: list[str] | dict[str, str]) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_DIGIT = rf"(?:{_words(DIGIT_WORDS)})"
#: One digit as a word, or digits, or a sign within numbers.
_ITEM = re.compile(rf"(?P<word>\b{_DIGIT}\b)|(?P<digits>[0-9]+)|\b(?:(?P<plus>{_words(PLUS_WORDS)})|(?P<dash>{_words(DASH_WORDS)})|(?P<dot>{_words(DOT_WORDS)})|(?P<oh>oh|o))\b|(?P<point>{_OPEN}?\.{_SHUT}?)", re.I)
_SIGNS = {"plus": "+", "dash": "-", "dot": ".", "point": ".", "oh": "0"}
_GAP = re.compile(r"[ \t]*(?:[,\-]?[ \t]*\n?[ \t]*)")
#: Fewer digits as words than these may be prose.
SPELLED = 3
#: Letters between digits that are read as digits.
_LETTERS = re.compile(r"[0-9]([OolI|]{1,3})(?=[0-9])")

_DOT = rf"(?:\s{{0,3}}{_OPEN}\s?(?:{_words(DOT_WORDS)}|\.)\s?{_SHUT}\s{{0,3}}|\s{{1,3}}(?:{_words(DOT_WORDS)})\s{{1,3}}|[-_](?:{_words(DOT_WORDS)})[-_])"
_AT = re.compile(rf"(?P<shut>\s{{0,3}}{_OPEN}\s?(?:{_words(AT_WORDS)}|@|a)\s?{_SHUT}\s{{0,3}}|_(?:{_words(AT_WORDS)})_)|(?P<bare>\s{{1,3}}(?:{_words(AT_WORDS)})\s{{1,3}}|\s{{1,3}}@\s{{0,3}}|@\s{{1,3}})|(?P<sign>@)", re.I)
_AT_CORE = re.compile(rf"@|(?<![A-Za-z0-9])(?:{_words(AT_WORDS)}|a(?=\s?{_SHUT}))(?![A-Za-z0-9])", re.I)
_DOT_BEFORE = re.compile(rf"(?:{_DOT})\Z", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NEXT_LABEL = re.compile(rf"(?:(?P<plain>\.)|(?P<dot>{_DOT}))(?P<label>[A-Za-z0-9-]+)", re.I)
_DOTTED_DIGITS = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.I)
_LAST = frozenset(LAST_LABELS)
#: Code points that a sign in disguise may take.
_REACH = 24

_TOKEN = re.compile(r"[^\W\d_]+")
#: What a word may stand for: a digit, the sign of an address, a dot, or another sign within numbers.
_STANDS = {w: c for words, c in ((DIGIT_WORDS, "d"), (AT_WORDS, "@"), (DOT_WORDS, "."), ([*PLUS_WORDS, *DASH_WORDS, "oh", "o"], "-")) for w in words}
_RUN = re.compile(r"d[-.]?d[-.]?d")
_IN_BRACKETS = re.compile(rf"{_OPEN}\s?(?:\.|@|a)\s?{_SHUT}", re.I)
_NAME_DOT = re.compile(r"\.[A-Za-z]")
_ANY_DIGIT = re.compile("[0-9]")
#: Characters whose words are looked at together.
_WINDOW = 1 << 20


def _hints(text: str) -> set[str]:
    """Which disguises may be there: ``spelled`` digits, ``at``, ``dot``, ``letters`` among digits.  A missing one surely isn't."""
    found = set()
    for k in range(0, len(text), _WINDOW):
        # Windows overlap by more than a few words.
        stands = "".join([_STANDS.get(w, " ") for w in _TOKEN.findall(text[k : k + _WINDOW + 256].lower())])
        if _RUN.search(stands):
            found.add("spelled")
        found.update(name for sign, name in (("@", "at"), (".", "dot")) if sign in stands)
    if _IN_BRACKETS.search(text):
        found |= {"at", "dot"}
    if "@" in text:
        found.add("at")
    if "dot" not in found and not _NAME_DOT.search(text):
        found.discard("at")
    if _LETTERS.search(text):
        found.add("letters")
    return found


def _characters(text: str) -> Copy | None:
    """Look-alikes as ASCII, invisible characters left out."""
    if text.isascii():
        return None
    table = characters()
    # A text has few distinct characters.
    odd = {c: table.get(ord(c), "") for c in set(text) if ord(c) in table or c in INVISIBLE}
    if not odd:
        return None
    edits = [(m.start(), m.end(), odd[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, odd)) + "]", text)]
    return Copy(text, edits)


def _numbers(text: str, hints: set[str]) -> Copy | _Both | None:
    """Spelled digits as digits, what lies between them left out; letters between digits as digits; dots between digits."""
    edits = [(m.start(1), m.end(1), "".join("0" if c in "Oo" else "1" for c in m[1])) for m in _LETTERS.finditer(text)] if "letters" in hints else []
    if "spelled" in hints:
        held: list[re.Match] = []

        def close() -> None:
            """Rewrite a run of items that holds enough digits as words."""
            while held and held[-1].lastgroup not in ("word", "digits"):
                held.pop()
            while held and held[0].lastgroup not in ("word", "digits", "plus"):
                held.pop(0)
            if sum(m.lastgroup == "word" for m in held) >= SPELLED:
                for k, m in enumerate(held):
                    kind = m.lastgroup
                    value = m[0] if kind == "digits" else DIGIT_WORDS[m[0].lower()] if kind == "word" else _SIGNS[kind]
                    # The gap before an item goes with it where either side is a word.
                    begin = held[k - 1].end() if k and (kind != "digits" or held[k - 1].lastgroup != "digits") else m.start()
                    if begin < m.start():
                        edits.append((begin, m.start(), ""))
                    if value != m[0]:
                        edits.append((m.start(), m.end(), value))
            held.clear()

        for m in _ITEM.finditer(text):
            if held and not _GAP.fullmatch(text, held[-1].end(), m.start()):
                close()
            held.append(m)
        close()
        edits.sort()
    first = Copy(text, edits) if edits else None
    now = first.text if first else text
    dots = [(m.start(), m.end(), ".") for m in _DOTTED_DIGITS.finditer(now)] if "dot" in hints else []
    return _then(first, Copy(now, dots) if dots else None)


class _Both:
    """A copy of a copy."""

    def __init__(self, first: Copy | _Both, second: Copy) -> None:
        self.first, self.second, self.text = first, second, second.text

    def source(self, start: int, end: int) -> Span:
        return self.first.source(*self.second.source(start, end))


def _then(first: Copy | _Both | None, second: Copy | None) -> Copy | _Both | None:
    return _Both(first, second) if first and second else second or first


def _disguised_emails(text: str) -> list[Span]:
    """Addresses around signs that stand for themselves or in brackets or as words."""
    found = []
    for core in _AT_CORE.finditer(text):
        # The sign with the blanks or brackets around it.
        sign = next((m for k in range(max(0, core.start() - 6), core.start() + 1) if (m := _AT.match(text, k)) and m.start() <= core.start() < m.end()), None)
        if not sign:
            continue
        first = _LABEL.match(text, sign.end())
        if not first:
            continue
        # Labels of the domain, as far as they go; ``bare``: read with the help of a word without brackets.
        ends, bare, dotted, at = [], bool(sign["bare"]), sign["shut"] is not None, first.end()
        while True:
            label = _NEXT_LABEL.match(text, at)
            if not label:
                break
            worded = bool(label["dot"]) and not re.search(r"[\[({<]", label["dot"])
            bare, dotted = bare or worded, dotted or bool(label["dot"])
            ends.append((label.end(), label["label"], bare, dotted))
            at = label.end()
        start = sign.start()
        local_dots = False
        while True:
            k = start
            while k and text[k - 1] in _LOCAL:
                k -= 1
            if k == start:
                # A sign, but nothing before it.
                break
            start = k
            dot = _DOT_BEFORE.search(text, max(0, start - _REACH), start)
            if not dot or not dot.start() or text[dot.start() - 1] not in _LOCAL:
                break
            # A bare word before the address may be prose: only one in brackets or between signs in disguise is read.
            if not re.search(r"[\[({<_-]", dot[0]) and not (sign["bare"] or sign["shut"]):
                break
            start, local_dots = dot.start(), True
        if start == sign.start() or not ends:
            continue
        local = text[start : sign.start()]
        loose = bool(sign["bare"]) or any(e[2] for e in ends) or bool(sign["shut"]) and re.fullmatch(r"\s*.a.\s*", sign[0], re.I)
        if loose:
            # With bare words the address must end in a known label, and a dot must be in disguise or the name look like one.
            ends = [e for e in ends if e[1].lower() in _LAST]
            named = local_dots or any(c in "._%+-0123456789" for c in local.strip(".")) or "@" in sign[0]
            ends = [e for e in ends if e[3] or named]
        else:
            ends = [e for e in ends if len(e[1]) > 1 or sign["sign"]]
        if ends:
            found.append((start, ends[-1][0]))
    return found


def _outside(span: Span, base: list[Span]) -> bool:
    """Whether a span is new: it meets no base span, or holds those it meets and more."""
    at = bisect_right(base, (span[0], sys.maxsize)) - 1
    meets = [b for b in base[max(at, 0) : at + 1] if b[1] > span[0]]
    k = at + 1
    while k < len(base) and base[k][0] < span[1]:
        meets.append(base[k])
        k += 1
    return all(span[0] <= b[0] and b[1] <= span[1] and b != span for b in meets)


def base_spans(text: str) -> dict[str, list[Span]]:
    numbers = _ANY_DIGIT.search(text)
    return {kind: find(text) if numbers or kind == "email" else [] for kind, find in _FINDERS.items()}


def spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans of each kind, and those that the transducers add."""
    base = base_spans(text)
    plain = _characters(text)
    now = plain.text if plain else text
    hints = _hints(now)
    numbers = _numbers(now, hints)
    copies = [c for c in (plain, _then(plain, numbers) if numbers else None) if c]
    added: dict[str, list[Span]] = {}
    for kind, find in _FINDERS.items():
        seen = set()
        for copy in copies:
            for start, end in find(copy.text):
                source = copy.source(start, end)
                if text[slice(*source)] != copy.text[start:end]:
                    seen.add(source)
        if kind == "email" and "at" in hints:
            seen.update(_disguised_emails(text))
            seen.update(copy.source(*s) for copy in copies for s in _disguised_emails(copy.text))
        # Of spans within one another the longest stays.
        kept: list[Span] = []
        for s in sorted((s for s in seen if _outside(s, base[kind])), key=lambda x: (x[0], -x[1])):
            if not kept or s[1] > kept[-1][1]:
                kept.append(s)
        added[kind] = kept
    return base, added


def listed(found: dict[str, list[Span]]) -> str:
    """``kind:start:end`` by start, then kind, then end, joined with commas."""
    rows = sorted((s, KINDS.index(kind), e) for kind, some in found.items() for s, e in some)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_disguised long, base_sha256 string, spans string"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base, added = spans(text)
            every = {k: base[k] + added[k] for k in KINDS}
            rows.append((*(len(every[k]) for k in KINDS), sum(map(len, added.values())), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each document: n_email, n_ip, n_card, n_phone (spans in plain and in disguise), n_disguised (added ones), base_sha256, spans.

    ``spans`` lists all of them as ``kind:start:end`` by start, then kind; places
    are code points of the source, the end is exclusive.  base_sha256 is the digest
    of the same list of base spans alone.

    A null text is an empty one and has no spans.  Null and repeated doc_ids and
    equal rows stay rows of their own.  Without documents there is no row.
    Columns but doc_id and text are ignored.
    """
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), _found, _SCHEMA)
