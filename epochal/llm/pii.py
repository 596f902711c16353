"""Personal data with offsets into the source text, disguises included.

Base rules find plain e-mail addresses, IP addresses, card numbers and telephone numbers. For texts that show a disguise, a
chain of transducers rewrites the text: look-alike characters to ASCII, spelled digits to digits, written "at" and "dot" to
their signs. Each transducer carries, for every character it puts out, the span of the source it came from, so what the same
rules find in the rewritten text maps back to source characters. Base spans always stay; disguised ones are added.

One pass over the documents, no shuffle. Null texts count as empty and have no spans; texts of any length are read whole;
repeated rows are judged each. Other columns of the documents are kept or not read, whatever their names. Of spans that overlap
both stay; masking replaces them as one.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def find_base(text: str) -> list[Span]:
    """The four base rules, each leftmost and without overlaps, in linear time."""
    found: list[Span] = []
    at, free = text.find("@"), 0  # no match may begin before free
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _DOTTED.finditer(text):
        if (parts := m.group().split("."))[3:]:
            start = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append((start, 1, end))
                start = end + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


#: Letters of other scripts that look like ASCII ones.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅԌԚԜаеорсухіјѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρικτυχϲϳ",
        "ABEKMHOPCTYXIJSGQWaeopcyxijsdqwhlABEZHIKMNOPTYXoavpiktuxcj",
        strict=True,
    )
)
_HIDDEN = frozenset("­​‌‍‎‏⁠﻿")


def _plain_char(c: str) -> str:
    """What a character looks like in ASCII; itself where nothing is known."""
    if c in _HIDDEN:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if unicodedata.category(c) == "Pd" or c == "\u2212":  # dashes, and the minus sign
        return "-"
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    if c in "․。．｡":
        return "."
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() and len(folded) == 1 else c


class Tape:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, starts: list[int], ends: list[int]):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, pattern: re.Pattern, put: Callable[[re.Match], str]) -> Tape:
        """Each match becomes what ``put`` returns, spread over the match's source span."""
        chars: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        last = 0
        for m in pattern.finditer(self.text):
            new = put(m)
            if new == m.group():
                continue
            a, b = m.span()
            chars.append(self.text[last:a])
            starts += self.starts[last:a]
            ends += self.ends[last:a]
            chars.append(new)
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            last = b
        chars.append(self.text[last:])
        return Tape("".join(chars), starts + self.starts[last:], ends + self.ends[last:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "(?:" + "|".join(_DIGIT_WORDS) + ")"
_SIGN = r"(?:\s*[(\[{{<]\s*(?:{0})\s*[)\]}}>]\s*)"
_OTHER = re.compile(r"[^\x00-\x7f]")
_PLUS = re.compile(rf"\bplus\s+(?=\d|{_DIGIT}\b)", re.I)
_SPELLED = re.compile(rf"\b{_DIGIT}(?:[\s,-]*\b{_DIGIT})*\b", re.I)
_BESIDE = re.compile(rf"(?:(?<=\d)[\s,-]+(?={_DIGIT}\b))|(?:(?<=\d)(?<!\s)-?\s*\b(?={_DIGIT}\b))", re.I)
_AT = re.compile(_SIGN.format("at|@|arroba|arobase") + r"|(?<=[\w.%+-])\s+at\s+(?!(?:the|a|an|this|that|my|your|our|its|any|each|one)\b)(?=[A-Za-z0-9-]+(?:\s+dot\s+|\s*[(\[{<]\s*dot))", re.I)
_AT_DOMAIN = re.compile(r"(?<=[\w.%+-])\s+at\s+(?=([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))", re.I)
_DOT = re.compile(_SIGN.format(r"dot|\.|punto|point|punkt") + r"|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.I)
_WORDS = re.compile(_DIGIT, re.I)


def _value(word: str) -> str:
    return _DIGIT_WORDS[word.replace("\u0130", "i").replace("\u0131", "i").lower()]  # both match i where case is ignored


def _digits(m: re.Match) -> str:
    words = _WORDS.findall(m.group())
    return "".join(map(_value, words)) if len(words) > 1 else m.group()


def _one_digit(m: re.Match) -> str:
    return _value(m.group())


#: A single spelled digit between digits or dots belongs to the number around it.
_LONE = re.compile(rf"(?:(?<=[\d.+])|(?<=\d[\s-]))\b{_DIGIT}\b|\b{_DIGIT}\b(?=[\s-]?\d|\.\d)", re.I)


def normalise(text: str) -> Tape:
    """The text as a reader would read it, in ASCII where a disguise is known."""
    tape = Tape.of(text).rewrite(_OTHER, lambda m: _plain_char(m.group()))
    plain = tape

    def at_disguised(m: re.Match) -> str:
        """A written "at" before a domain with its dots stands for the sign only where the domain is disguised itself."""
        a, b = plain.source(m.start(1), m.end(1))
        return m.group() if text[a:b] == m.group(1) else "@"

    if tape.text != text:
        tape = tape.rewrite(_AT_DOMAIN, at_disguised)
    tape = tape.rewrite(_AT, lambda m: "@").rewrite(_DOT, lambda m: ".").rewrite(_PLUS, lambda m: "+")
    return tape.rewrite(_SPELLED, _digits).rewrite(_LONE, _one_digit)


def find_disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that appear only in the rewritten text and overlap no base span of their kind."""
    tape = normalise(text)
    if tape.text == text:
        return []
    found = []
    for start, kind, end in find_base(tape.text):
        a, b = tape.source(start, end)
        if text[a:b] != tape.text[start:end] and not any(k == kind and a < e and s < b for s, k, e in base):
            found.append((a, kind, b))
    return found


#: Rows that can hold a base span. A linear scan without Python per row.
_MAY_HOLD = r"[0-9@]"


def _ranges(code_points: list[int]) -> str:
    """The inside of a character class of these code points, which are sorted."""
    out: list[list[int]] = []
    for c in code_points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


@functools.cache
def disguise_pattern() -> str:
    """Rows that show a disguise, as one pattern for a linear scan: it holds wherever a transducer of ``normalise`` can rewrite.

    Its characters are all that ``_plain_char`` changes; white space and letters are those of the transducers' patterns.
    """
    other = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    changed = _ranges([c for c in other if _plain_char(chr(c)) != chr(c)])
    space = "[" + _ranges([c for c in (*range(0x80), *other) if chr(c).isspace()]) + "]"
    between = space[:-1] + ",.-]*"
    digit = "(?:" + "|".join(w.replace("i", r"[i\x{130}\x{131}]") for w in _DIGIT_WORDS) + ")"
    return (
        rf"[{changed}]"
        rf"|(?i)[(\[{{<]{space}*(?:at|@|arroba|arobase|dot|\.|punto|po[i\x{{130}}\x{{131}}]nt|punkt){space}*[)\]}}>]|{space}dot{space}"
        rf"|{digit}{between}(?:{digit}|[0-9])|[0-9]{between}{digit}|[.+]{digit}|plus{space}+(?:[0-9]|{digit})"
    )


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def find_spans(text: pa.Array, disguise: str) -> list[tuple[list[Span], list[Span]]]:
    """Base and disguised spans of each text of an Arrow array without nulls; ``disguise`` is the pattern of that name."""
    holds = pc.match_substring_regex(text, _MAY_HOLD).to_numpy(zero_copy_only=False)
    hides = pc.match_substring_regex(text, disguise).to_numpy(zero_copy_only=False)
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(text)
    for i in np.flatnonzero(holds | hides):
        t = text[i].as_py()
        base = find_base(t) if holds[i] else []
        out[i] = (base, find_disguised(t, base) if hides[i] else [])
    return out


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row, as in ``SCHEMA``, for every row of ``docs`` (doc_id, text). Offsets are code points, ends exclusive."""
    disguise = disguise_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, (base, more) in zip(batch.column(0).to_pylist(), find_spans(batch.column(1), disguise)):
                counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                rows.append((doc, *counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(base + more), len(more)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()])],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def mask_text(text: str) -> str:
    """The text with every found span replaced by its kind in brackets; overlapping spans are replaced as one."""
    base = find_base(text)
    spans = sorted(base + find_disguised(text, base))
    out: list[str] = []
    last = 0
    for s, k, e in spans:
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``column`` replaced; all other columns, and texts without any, stay as they are."""
    disguise = disguise_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            text = pc.fill_null(batch.column(at), "")
            hit = pc.or_(pc.match_substring_regex(text, _MAY_HOLD), pc.match_substring_regex(text, disguise)).to_numpy(zero_copy_only=False)
            if not hit.any():
                yield batch
                continue
            new = [mask_text(t.as_py()) if h else t.as_py() for t, h in zip(batch.column(at), hit)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
