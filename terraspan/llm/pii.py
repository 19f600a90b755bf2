"""Personal data: base detectors on the text itself, and again on a deobfuscated text that remembers its offsets.

A transducer rewrites disguises and carries, for every character it emits, the range
of source characters it stands for:

* look-alike letters, full-width and styled forms become ASCII; invisible characters vanish,
* runs of digits that are spelled in part (with "plus", "dot", "dash") or have bracketed dots become figures and signs,
* "at" and "dot" disguises, bracketed or spelled between the parts of an address, become signs.

The same detectors run over its output; their spans are mapped back to the source
and added when the source range itself was disguised. Base spans always stay.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import annotate, sha256

KINDS = ("email", "ip", "card", "phone")
FIELDS = T.StructType([
    T.StructField("n_email", T.LongType()), T.StructField("n_ip", T.LongType()), T.StructField("n_card", T.LongType()),
    T.StructField("n_phone", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and the look-behind keep every scan linear; they find what the plain patterns find.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def _luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _is_ip(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in value.split("."))


def _is_card(value: str) -> bool:
    digits = value.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(value: str) -> bool:
    return 8 <= sum(c.isdigit() for c in value) <= 15


def detect(text: str) -> list[Span]:
    """Base spans of a text by kind and start: leftmost, not overlapping within a kind, failing ones dropped."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, rule, good in ((1, IP, _is_ip), (2, CARD, _is_card)):
        spans += [(kind, m.start(), m.end()) for m in rule.finditer(text) if good(m[0])]
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if _is_phone(m[0])]
    return spans


# Letters of other scripts that look like the ASCII letter after them.
LOOKALIKES = dict(zip(
    "аеорсухіјѕһԁɡԛԝвкмнтАВЕКМНОРСТХІЈЅоοαινυρκτχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıℓ",
    "aeopcyxijshdgqwbkmhtABEKMHOPCTXIJSooaivupktxABEZHIKMNOPTYXil",
))
# Spelled digits in four languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGNS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-"}
_INVISIBLE = "­​‌‍⁠﻿"


def _character_table() -> dict[str, str]:
    """What single characters are rewritten to: compatibility forms of one ASCII character, look-alikes, nothing for invisible ones."""
    table = {}
    for first, last in ((0x2100, 0x2190), (0x2460, 0x2500), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2010, 0x2016), (0x2212, 0x2213)):
        for c in map(chr, range(first, last)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                table[c] = plain
    table |= dict.fromkeys("‐‑‒–−", "-") | dict.fromkeys("    ", " ")
    return table | LOOKALIKES | dict.fromkeys(_INVISIBLE, "")


CHARACTERS = _character_table()
# Every rewritten character lies in these ranges; most texts hold none of them.
_SUSPECT = re.compile("[\u00a0\u00ad\u0131\u0250-\U0010ffff]")
_GROUP = "(?:[0-9]++|" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_SIGN = "(?:" + "|".join(SIGNS) + ")"
_GAP = r"[\x20\t,-]"
_BOXED_DOT = r"[\x20\t]*[\[({<][\x20\t]*(?:dot|point|punkt|punto|\.)[\x20\t]*[\])}>][\x20\t]*"
# Groups of figures and spelled digits with gaps and signs between, in small letters; which of them count, _digits tells.
_RUN = re.compile(rf"\b(?:plus[\x20\t-]++)?{_GROUP}(?:(?:{_BOXED_DOT}|{_GAP}*+(?:{_SIGN}{_GAP}*+)?|\.){_GROUP})+(?![^\W_])")
_PIECE = re.compile(rf"(?P<boxed>{_BOXED_DOT})|(?P<sign>{_SIGN})|(?P<figures>[0-9]++)|(?P<word>{_GROUP})|(?P<gap>{_GAP}++)|\.")
LEAST_DIGITS = 4  # an address of the shortest kind, 8.8.8.8; the detectors ask for more where it is needed
# An address whose signs are bracketed or spelled out.
_AT = r"(?:[\x20\t]*[\[({<][\x20\t]*(?:at|@)[\x20\t]*[\])}>][\x20\t]*|[\x20\t]+(?:at|@)[\x20\t]+|@)"
_DOT = r"(?:[\x20\t]*[\[({<][\x20\t]*(?:dot|\.)[\x20\t]*[\])}>][\x20\t]*|[\x20\t]+dot[\x20\t]+|\.)"
_LABEL = r"[A-Za-z0-9_%+-]++"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_%+-]){_LABEL}(?:{_DOT}{_LABEL})*+(?P<at>{_AT})(?P<domain>[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*{_DOT}[A-Za-z]{{2,}}+)", re.I
)
_ADDRESS_PART = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})|{_LABEL}", re.I)
_BRACKETED = re.compile(r"[\[({<][\x20\t]*(?:at|@|dot|\.)[\x20\t]*[\])}>]", re.I)


class Tape:
    """Rewritten text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges of the present text; ``edits`` are in order and do not overlap."""
        if not edits:
            return
        text, starts, ends, changed, at = [], [], [], [], 0
        for first, last, new in edits:
            text += [self.text[at:first], new]
            starts += self.starts[at:first] + [self.starts[first]] * len(new)
            ends += self.ends[at:first] + [self.ends[last - 1]] * len(new)
            changed += self.changed[at:first] + [True] * len(new)
            at = last
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]


def _lowered(text: str) -> str:
    """Small letters, each at the place of its source."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _characters(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or not _SUSPECT.search(text):
        return []
    return [(i, i + 1, CHARACTERS[c]) for i, c in enumerate(text) if c in CHARACTERS]


def _digits(text: str) -> list[tuple[int, int, str]]:
    edits, low = [], _lowered(text)
    for run in _RUN.finditer(low):
        pieces = list(_PIECE.finditer(low, run.start(), run.end()))
        if not _disguised(pieces):
            continue
        dots = sum(m.lastgroup in (None, "boxed") or SIGNS.get(m[0]) == "." for m in pieces)
        for i, m in enumerate(pieces):
            if m.lastgroup == "gap":
                new = _gap(m[0], pieces[i - 1], pieces[i + 1], dots)
            else:
                new = "." if m.lastgroup == "boxed" else SPELLED.get(m[0]) or SIGNS.get(m[0]) or m[0]
            if new != m[0]:
                edits.append((m.start(), m.end(), new))
    return edits


def _disguised(pieces: list[re.Match]) -> bool:
    """Whether a run has digits enough and a bracketed dot, two spelled pieces, or one between others.

    One spelled digit before or behind figures is prose: "+1 555 010 9999 two times".
    """
    if sum(len(m[0]) if m.lastgroup == "figures" else m.lastgroup == "word" for m in pieces) < LEAST_DIGITS:
        return False
    spelled = [m.lastgroup in ("word", "sign") for m in pieces]
    return any(m.lastgroup == "boxed" for m in pieces) or sum(spelled) > 1 or any(spelled[1:-1])


def _gap(gap: str, before: re.Match, after: re.Match, dots: int) -> str:
    """Nothing within a number, but a sign that no address holds between two numbers.

    Those are figures of several places side by side, or set apart by a comma from others. In
    a list with more dots than one address has, so are all figures side by side and all commas.
    """
    kinds = (before.lastgroup, after.lastgroup)
    if not {"sign", "boxed"}.isdisjoint(kinds):
        return ""
    places = any(m.lastgroup == "figures" and len(m[0]) > 1 for m in (before, after))
    apart = (places or dots > 3) and ("," in gap or kinds == ("figures", "figures"))
    return "" if not apart else gap if gap in (" ", "-") else " "


def _addresses(text: str) -> list[tuple[int, int, str]]:
    return _address_edits(text) if _hides_address(text) else []


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for address in _ADDRESS.finditer(text):
        spelled = address["at"].strip(" \t").lower() == "at"
        if spelled and "." in _BRACKETED.sub("", address["domain"]):
            continue  # a plain "at" counts only when the dots behind it are disguised, too
        for m in _ADDRESS_PART.finditer(text, address.start(), address.end()):
            sign = "@" if m["at"] else "." if m["dot"] else None
            if sign and m[0] != sign:
                edits.append((m.start(), m.end(), sign))
    return edits


def _hides_address(text: str) -> bool:
    """Whether a text holds a sign that an address may hide behind: true wherever _address_edits finds one.

    A spelled "at" needs no test, as it counts only before a disguised dot.
    """
    low = text.lower().replace("\t", " ")
    if " dot " in low or " @ " in low:
        return True
    return any(c in text for c in "[({<") and _BRACKETED.search(text) is not None


def deobfuscate(text: str) -> Tape | None:
    """The rewritten text, or None if nothing in it is disguised."""
    tape = None
    for rule in (_characters, _digits, _addresses):
        edits = rule(tape.text if tape else text)
        if edits:
            tape = tape or Tape(text)
            tape.rewrite(edits)
    return tape


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base with added spans; both by kind and start."""
    base = detect(text)
    tape = deobfuscate(text)
    if tape is None:
        return base, base
    known, added = set(base), []
    for kind, start, end in detect(tape.text):
        span = (kind, tape.starts[start], tape.ends[end - 1])
        hidden = any(tape.changed[start:end]) or end - start != span[2] - span[1]
        if hidden and span not in known:
            added.append(span)
    return base, sorted([*base, *added])


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts and digest of the base spans and all spans as text; every row is kept.

    A null text counts as empty; without spans ``spans`` is empty and the digest that of
    the empty string. Offsets count code points of the source text, end exclusive. Whole
    texts of any length are read. Columns of ``docs`` that bear an added name are replaced.
    """

    def kernel(column: pa.Array) -> dict:
        found = [find(t or "") for t in column.to_pylist()]
        counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in range(len(KINDS))]
        return {
            **{f"n_{name}": c for name, c in zip(KINDS, counts)},
            "base_sha256": [sha256(_text(base)) for base, _ in found], "spans": [_text(spans) for _, spans in found],
        }

    return annotate(docs, text, FIELDS, lambda: kernel)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` whose texts have each span replaced by its kind in brackets; overlapping spans go as one."""

    def clean(value: str | None) -> str | None:
        out, at = [], 0
        for kind, start, end in sorted(find(value)[1], key=lambda s: (s[1], -s[2])) if value else []:
            if start >= at:
                out += [value[at:start], f"[{KINDS[kind]}]"]
            at = max(at, end)
        return value if not out else "".join([*out, value[at:]])

    fields = T.StructType([T.StructField("_clean", T.StringType())])
    masked = annotate(docs, text, fields, lambda: lambda column: {"_clean": [clean(t) for t in column.to_pylist()]})
    return masked.select(*[F.col("_clean").alias(n) if n == text else F.col(f"`{n}`") for n in docs.columns])
