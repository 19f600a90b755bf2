"""Secret scan: all rules in one automaton, one pass over the bytes of whole texts.

The combined automaton tells after every byte which rules have a match that ends
there. Only texts with such a byte go on: the reversed automaton marks every byte
where a match starts, and each rule's own automaton runs from the first marked byte
to its longest match. Matches of a rule are leftmost and do not overlap. A check on
the matched text drops matches that are too short; dropped ones are not retried.

The first three rules are the base; the others add spans of well-known formats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton, compile_rules
from .batches import annotate, joined, raw_texts, sha256

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Kind, pattern, either case, least length of a match (of group 2 for the first rule). A hex
# run is that common in plain words that its least length is part of the pattern; a shorter run is no match.
RULES = [
    ("assign", ASSIGN, True, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0),
    ("repo_token", r"gh[opsur]_[A-Za-z0-9]+", False, 40),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", False, 15),
]
BASE = 3
_ASSIGN = re.compile(ASSIGN.encode(), re.I)

FIELDS = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


@dataclass
class Scanner:
    ends: Automaton
    starts: Automaton
    single: list[Automaton]


def build_scanner() -> Scanner:
    patterns, fold = [r[1] for r in RULES], [r[2] for r in RULES]
    return Scanner(
        compile_rules(patterns, fold), compile_rules(patterns, fold, backwards=True),
        [compile_rules([p], [f], anywhere=False) for p, f in zip(patterns, fold)],
    )


def _longest(rule: Automaton, text: bytes, at: int) -> int:
    """End of the longest match that starts at ``at``."""
    table, column_of, accepts, width = rule.table, rule.column_of, rule.accepts, rule.width
    row, end = 0, at
    for i in range(at, len(text)):
        row = int(table[row + column_of[text[i]]])
        if accepts[row // width]:
            end = i + 1
        elif row == rule.dead:
            break
    return end


def _matches(scanner: Scanner, text: bytes, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes; ``starts`` has the rules that start at each byte."""
    found = []
    for bit in range(len(RULES)):
        end = 0
        for at in np.flatnonzero(starts >> np.uint32(bit) & np.uint32(1)).tolist():
            if at < end:
                continue
            end = _longest(scanner.single[bit], text, at)
            size = end - at if bit else len(_ASSIGN.fullmatch(text, at, end)[2])
            if size >= RULES[bit][3]:
                found.append((at, bit, end))
    return sorted(found)


def scan(scanner: Scanner, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, rule, end) of each text in code points."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return found
    buffer, first, last = joined(texts, b"\xff")
    hits = np.flatnonzero(scanner.ends.run(buffer))
    docs = np.unique(np.searchsorted(first, hits, side="right") - 1).tolist()
    if not docs:
        return found
    back, begin, end = joined([texts[d][::-1] for d in docs], b"\xff")
    marks = scanner.starts.run(back)
    for d, a, b in zip(docs, begin, end):
        spans = _matches(scanner, texts[d], marks[a:b][::-1])
        if spans and not texts[d].isascii():
            points = np.concatenate(([0], np.cumsum((np.frombuffer(texts[d], np.uint8) & 0xC0) != 0x80)))
            spans = [(int(points[s]), r, int(points[e])) for s, r, e in spans]
        found[d] = spans
    return found


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[r][0]}:{s}:{e}" for s, r, e in spans)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of all rules and counts and digest of the base rules; every row is kept.

    A null text counts as empty; no span gives an empty ``spans`` and the digest of the
    empty string. Spans count code points, end exclusive, ordered by start and then by
    rule. Texts of any length are scanned whole. Columns of ``docs`` that bear one of
    the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_scanner())

    def kernel(column: pa.Array) -> dict:
        spans = scan(shared.value, raw_texts(column))
        base = [[s for s in row if s[1] < BASE] for row in spans]
        counts = [[sum(s[1] == bit for s in row) for row in base] for bit in range(BASE)]
        return {
            "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
            "base_sha256": [sha256(_text(row)) for row in base], "spans": [_text(row) for row in spans],
        }

    return annotate(docs, text, FIELDS, lambda: kernel)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` whose texts have every found span replaced by ``mask``; overlapping spans become one mask."""
    shared = docs.sparkSession.sparkContext.broadcast(build_scanner())

    def clean(value: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        out, at = [], 0
        for start, _, end in spans:
            if end <= at:
                continue
            if start >= at:
                out += [value[at:start], mask]
            at = end
        return value if not out else "".join([*out, value[at:]])

    def kernel(column: pa.Array) -> dict:
        return {text: [clean(v, s) for v, s in zip(column.to_pylist(), scan(shared.value, raw_texts(column)))]}

    names = docs.columns
    fields = T.StructType([T.StructField("_clean", T.StringType())])
    masked = annotate(docs, text, fields, lambda: lambda column: {"_clean": kernel(column)[text]})
    return masked.select(*[F.col("_clean").alias(n) if n == text else F.col(f"`{n}`") for n in names])
