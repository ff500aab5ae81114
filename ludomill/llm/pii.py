"""Personal data in texts, plain and disguised, at its place in the source.

Plain kinds are found by their patterns in the text as it is.  A transducer then
rewrites disguises in one pass: look-alike and full-width characters, invisible
characters, spelled digits, and at/dot in words or brackets.  It keeps, for every
character it writes, the source characters it stands for, so what is found in the
rewritten text maps back to a span of the source.  Spans that touch nothing
rewritten are the plain ones again and are not added.

Nulls are empty texts and have no spans.  Empty tables give empty results.  All
patterns run in time proportional to the text.  Repeated rows count each; other
columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits, for it would have begun with the run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Spans of the plain kinds by start, then kind as listed; ends are exclusive."""
    spans: list[tuple[int, int, int]] = []
    end = at = 0
    while (at := text.find("@", max(at, end))) >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            spans.append((begin, 0, end))
        at += 1
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    spans.sort()
    return [(KINDS[kind], a, b) for a, kind, b in spans]


# Look-alikes of Latin letters and of the marks in identifiers.
_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "α": "a", "ο": "o",
    "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "İ": "I", "ſ": "s", "․": ".",
    "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹢": "+", " ": " ",
    " ": " ", " ": " ",
}
_ALIKE |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
_ALIKE |= {chr(start + i): str(i) for start in (0x0660, 0x06F0, 0x0966) for i in range(10)}  # digits of other scripts
_UNSEEN = "­​‌‍⁠﻿"

# Names of the digits.
_DIGITS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
} | {"oh": "0"}
_DIGIT = "(?:" + "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w))) + ")"
_AT = r"(?:at|arroba|chez|ät)"
_DOT = r"(?:dot|punto|punkt|point)"
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_HOST = r"[A-Za-z0-9-]+"
_ANY_DOT = rf"(?:\x20{{1,3}}{_DOT}\x20{{1,3}}|\x20{{0,3}}{_OPEN}\x20{{0,3}}(?:{_DOT}|\.)\x20{{0,3}}{_CLOSE}\x20{{0,3}})"
_RUN = rf"{_DIGIT}(?:[\x20-]{{1,2}}{_DIGIT})*"
_RULES = re.compile(
    rf"(?P<at>\x20{{0,3}}{_OPEN}\x20{{0,3}}(?:{_AT}|@)\x20{{0,3}}{_CLOSE}\x20{{0,3}}"
    # a bare "at" only where a disguised dot follows the next name
    rf"|(?<=[A-Za-z0-9])\x20{{1,3}}{_AT}\x20{{1,3}}(?=[A-Za-z0-9-]{{1,63}}{_ANY_DOT}))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_ANY_DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<digits>(?<![^\W_])(?:{_RUN}(?:{_ANY_DOT}{_RUN}){{3}}|(?:plus[\x20-]{{1,2}})?(?:{_DIGIT}[\x20-]{{1,2}}){{2,}}{_DIGIT})(?![^\W_]))",
    re.IGNORECASE,
)
_BRACKETED = re.compile(rf"{_OPEN}\x20{{0,3}}(?:{_AT}|@|{_DOT}|\.)\x20{{0,3}}{_CLOSE}", re.IGNORECASE)
_BARE_DOTS = (" dot ", " punto ", " punkt ", " point ")
_ODD = re.compile("[" + re.escape("".join(_ALIKE) + _UNSEEN) + "]")
_PART = re.compile(rf"(?P<mark>plus|{_ANY_DOT})|{_DIGIT}", re.IGNORECASE)


def _hinted(text: str) -> bool:
    """Whether a rule may apply: a quick look that misses nothing the rules find."""
    low = text.lower()
    if any(dot in low for dot in _BARE_DOTS):
        return True
    if any(mark in low for mark in "([{<") and _BRACKETED.search(low):
        return True
    named = 0
    for word in low.replace("-", " ").split():
        if word.strip(".,;:!?") in _DIGITS:
            named += 1
            if named == 3:
                return True
    return False


def rewrite(text: str) -> tuple[str, list[int], list[int], list[bool]] | None:
    """The text without disguises, with source start and end of every character and whether it was rewritten.

    None if there is nothing to rewrite.
    """
    odd = not text.isascii() and _ODD.search(text) is not None
    if not odd and not _hinted(text):
        return None
    if odd:
        chars, begin = [], []
        for i, c in enumerate(text):
            if c not in _UNSEEN:
                chars.append(_ALIKE.get(c, c))
                begin.append(i)
        clean = "".join(chars)
        ends = [i + 1 for i in begin]
        changed = [clean[k] != text[i] or (k > 0 and begin[k - 1] != i - 1) for k, i in enumerate(begin)]
    else:
        clean, begin, ends = text, list(range(len(text))), list(range(1, len(text) + 1))
        changed = [False] * len(text)
    out: list[str] = []
    starts: list[int] = []
    stops: list[int] = []
    marks: list[bool] = []

    def copy(a: int, b: int) -> None:
        out.append(clean[a:b])
        starts.extend(begin[a:b])
        stops.extend(ends[a:b])
        marks.extend(changed[a:b])

    def put(char: str, a: int, b: int) -> None:
        out.append(char)
        starts.append(begin[a])
        stops.append(ends[b - 1])
        marks.append(True)

    at = 0
    for m in _RULES.finditer(clean):
        copy(at, m.start())
        at = m.end()
        if m.lastgroup == "at":
            put("@", m.start(), m.end())
        elif m.lastgroup == "dot":
            put(".", m.start(), m.end())
        else:
            for part in _PART.finditer(clean, m.start(), m.end()):
                word = part.group().lower()
                mark = "+" if word == "plus" else "."
                put(mark if part.group("mark") else _DIGITS[word], part.start(), part.end())
    copy(at, len(clean))
    return "".join(out), starts, stops, marks


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and plain with disguised ones; both by start, then kind as listed."""
    if not text:
        return [], []
    plain = plain_spans(text)
    rewritten = rewrite(text)
    if rewritten is None:
        return plain, plain
    clean, starts, stops, marks = rewritten
    added = []
    for kind, a, b in plain_spans(clean):
        if any(marks[a:b]):
            span = (kind, starts[a], stops[b - 1])
            if not any(k == kind and s <= span[1] and span[2] <= e for k, s, e in plain):
                added.append(span)
    every = sorted(set(plain) | set(added), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return plain, every


def redact(text: str | None, spans: list[Span]) -> str | None:
    """Spans replaced by their kind in brackets; spans that overlap are replaced as one."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_TYPE = "array<struct<kind: string, start: bigint, end: bigint>>"


def find(docs: DataFrame, redacted: bool = False, spans: bool = True) -> DataFrame:
    """``docs`` with plain_spans and all_spans, in code points; columns of these names are replaced.

    ``redacted`` rewrites text (and n_chars); without ``spans`` no column is added.
    """
    names = ["plain_spans", "all_spans"] if spans else []
    columns = [c for c in docs.columns if c not in names]
    schema = T.StructType(
        [docs.schema[c] for c in columns] + [T.StructField(n, T._parse_datatype_string(_SPANS_TYPE)) for n in names]
    )

    def rows(found: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in found]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            found = [all_spans(t) for t in texts]
            arrays = {c: batch.column(c) for c in columns}
            if redacted:
                new = [redact(t, every) for t, (_, every) in zip(texts, found)]
                arrays["text"] = pa.array(new, batch.schema.field("text").type)
                if "n_chars" in arrays:
                    kind = batch.schema.field("n_chars").type
                    old = arrays["n_chars"].to_pylist()
                    counts = [n if t is None or t is u else len(t) for t, u, n in zip(new, texts, old)]
                    arrays["n_chars"] = pa.array(counts, kind)
            every = [pa.array([rows(f[i]) for f in found], _SPANS) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays.values(), *every], names=[*columns, *names])

    return docs.mapInArrow(apply, schema)
