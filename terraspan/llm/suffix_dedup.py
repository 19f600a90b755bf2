"""Removal of repeated byte strings by refined q-gram buckets.

Every 100-byte string that also starts earlier is repeated; all bytes under repeated
strings go. Strings are grouped as in a suffix array built by bucket refinement, but
only as deep as 100 bytes and only where it is still open:

1. Initial buckets are 8-byte grams. A bucket is refined by the bucket identifiers at
   later offsets (8, then 16 bytes on), and each update is reused by the next: 8, 16 and
   32 bytes are told apart. Identifiers are 64-bit values, the same on every machine.
2. Of the 69 32-grams inside a string the one with the smallest identifier is its anchor.
   Equal strings have equal anchors, so strings are grouped by anchor: runs of
   consecutive strings share one row (about one row in 35 bytes).
3. Rows of an anchor bucket are refined by the identifiers over their whole range. Rows of
   one class are equal throughout: all but the earliest are repeated. A bucket of one
   class is done.
4. The earliest rows of buckets with several classes fetch their bytes, and their
   strings are compared one by one.

Blocks of text fold their own repeats before anything is shuffled. Buckets that hold very
many different classes (found on a sample of documents; it only steers how rows are
laid out) are split into the buckets of their single strings, so that no bucket gathers
in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .batches import Powers, joined, mix, raw_texts, spans_of

LENGTH = 100
GRAM = 32
CHOICES = LENGTH - GRAM + 1
BLOCK = 4_000_000  # bytes whose own repeats are folded before the shuffle
PIECE = 2_000_000  # longer texts are worked on in pieces; their strings overlap the border
SAMPLE = 64  # one document in so many tells which buckets are crowded
CROWDED, LEAST_SHARE = 32, 2e-5  # different classes in the sample, and their least share of it: at most 50,000 buckets

_PREFIX = Powers(0x2545F4914F6CDD1D)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_UNITS = "kind tinyint, key bigint, class bigint, doc bigint, at bigint"
UNIT, REPEAT, OPEN = 0, 1, 2


def buckets(buffer: np.ndarray) -> np.ndarray:
    """Identifier of the 32 bytes from each offset on, by doubling from the 8-byte grams."""
    n = len(buffer) - 7
    grams = np.empty(max(n, 0), np.uint64)
    raw = buffer.tobytes()
    for shift in range(min(8, max(n, 0))):
        part = np.frombuffer(raw, "<u8", count=(len(raw) - shift) // 8, offset=shift)
        grams[shift::8] = part
    ids = grams
    for step in (8, 16):
        if len(ids) <= step:
            return np.zeros(0, np.uint64)
        ids = mix(ids[:-step] * _A + ids[step:])
    return ids


def _anchors(ids: np.ndarray) -> np.ndarray:
    """Offset of the anchor of the string that starts at each offset: the first smallest identifier."""
    keys = (ids & ~np.uint64(0xFFFFFF)) | np.arange(len(ids), dtype=np.uint64)
    span = 1
    while span * 2 <= CHOICES:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = CHOICES - span
    keys = np.minimum(keys[:-rest], keys[rest:])
    return (keys & np.uint64(0xFFFFFF)).astype(np.int64)


class _Units:
    """Runs of strings with a common anchor in a block of pieces."""

    def __init__(self, pieces: list[tuple[int, int, bytes, int]]):
        """``pieces``: document, offset of the piece in it, bytes, number of string starts that belong to the piece."""
        buffer, starts, _ = joined([p[2] for p in pieces], b"\xff")
        self.ids = buckets(buffer)
        empty = np.zeros(0, np.int64)
        if len(self.ids) < CHOICES:
            self.first = self.last = self.anchor = self.doc = self.shift = empty
            return
        anchor = _anchors(self.ids)
        counts = np.fromiter((p[3] for p in pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces)), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
        if not len(at):
            self.first = self.last = self.anchor = self.doc = self.shift = empty
            return
        a = anchor[at]
        cut = np.flatnonzero((a[1:] != a[:-1]) | (owner[1:] != owner[:-1])) + 1
        head, tail = np.concatenate(([0], cut)), np.append(cut, len(at)) - 1
        self.first, self.last, self.anchor = at[head], at[tail], a[head]
        owner = owner[head]
        self.doc = np.fromiter((p[0] for p in pieces), np.int64, len(pieces))[owner]
        self.shift = (np.fromiter((p[1] for p in pieces), np.int64, len(pieces)) - starts)[owner]  # to offsets in the document

    def keys(self) -> np.ndarray:
        return self.ids[self.anchor].view(np.int64)

    def classes(self) -> np.ndarray:
        prefix = _PREFIX.prefix(self.ids)
        whole = _PREFIX.ranges(prefix, self.first, self.last + CHOICES)
        place = (self.anchor - self.first).astype(np.uint64) * _B + (self.last - self.first).astype(np.uint64) * _C
        return mix(whole + place).view(np.int64)

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two identifiers, document and offset of every single string of the chosen runs."""
        counts = (self.last - self.first + 1)[chosen]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[chosen], counts)
        parts = [self.ids[at + o] for o in (0, GRAM, 2 * GRAM, LENGTH - GRAM)]  # identifiers at later offsets cover all 100 bytes
        one = mix(parts[0] * _A + parts[1] * _B + parts[2] * _C + parts[3] * _D)
        two = mix(parts[0] * _D + parts[1] * _C + parts[2] * _B + parts[3] * _A + _A)
        return one.view(np.int64), two.view(np.int64), np.repeat(self.doc[chosen], counts), at + np.repeat(self.shift[chosen], counts)


def _pieces(doc: int, raw: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    strings = len(raw) - LENGTH + 1
    for at in range(0, max(strings, 0), PIECE):
        count = min(PIECE, strings - at)
        yield doc, at, raw[at : at + count + LENGTH - 1], count


def _blocks(batch: pa.RecordBatch) -> Iterator[_Units]:
    docs, raws = batch.column(0).to_numpy(zero_copy_only=False), raw_texts(batch.column(1))
    pieces = [p for d, r in zip(docs.tolist(), raws) for p in _pieces(int(d), r)]
    for first, last in spans_of(np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces)), BLOCK):
        yield _Units(pieces[first:last])


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges merged where they overlap or touch within a document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # running maximum of the ends that begins anew with each document
    rank = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    reach = np.maximum.accumulate(end + rank * (1 << 44)) - rank * (1 << 44)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _fold(key: np.ndarray, cls: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, class, document, offset), and which of the ordered rows are later than the first of their class."""
    order = np.lexsort((at, doc, cls, key))
    k, c, d, a = key[order], cls[order], doc[order], at[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    return order, (d != d[lead]) | (a >> 14 != a[lead] >> 14)


def _rows(kind: int, key, cls, doc, at) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(doc), kind, np.int8)), *[pa.array(np.asarray(x, np.int64)) for x in (key, cls, doc, at)]]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "class", "doc", "at"])


def _map(crowded: np.ndarray):
    """Units that remain after each block has folded its own repeats, and the repeats.

    ``at`` of a unit packs first offset, distance to the anchor and number of strings less one;
    a repeat has its end as class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for units in _blocks(batch):
                key, cls = units.keys(), units.classes() if len(units.doc) else np.zeros(0, np.int64)
                hot = np.isin(key, crowded)
                first = units.first + units.shift
                at = first << 14 | (units.anchor - units.first) << 7 | (units.last - units.first)
                cold = ~hot
                parts = [(key[cold], cls[cold], units.doc[cold], at[cold])]
                if hot.any():
                    one, two, doc, where = units.strings(hot)
                    parts.append((one, two, doc, where << 14))
                key, cls, doc, at = (np.concatenate(x) for x in zip(*parts))
                order, later = _fold(key, cls, doc, at)
                kept, gone = order[~later], order[later]
                yield _rows(UNIT, key[kept], cls[kept], doc[kept], at[kept])
                start = at[gone] >> 14
                d, s, e = _runs(doc[gone], start, start + (at[gone] & 127) + LENGTH)
                yield _rows(REPEAT, mix(d.astype(np.uint64) * _A + s.astype(np.uint64)).view(np.int64), e, d, s)

    return run


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted units of whole buckets: later rows of a class are repeats, first rows of several classes stay open."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        kind = batch.column(0).to_numpy()
        if (kind == REPEAT).any():
            yield batch.filter(pa.array(kind == REPEAT))
        columns = [batch.column(i).to_numpy()[kind == UNIT] for i in range(1, 5)]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        done = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        held = [c[done:] for c in columns]
        if done:
            yield from _resolve(*[c[:done] for c in columns])
    if held is not None and len(held[0]):
        yield from _resolve(*held)


def _resolve(key: np.ndarray, cls: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    order, later = _fold(key, cls, doc, at)
    key, cls, doc, at = key[order], cls[order], doc[order], at[order]
    start = at[later] >> 14
    yield _rows(REPEAT, key[later], start + (at[later] & 127) + LENGTH, doc[later], start)
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    number = np.cumsum(head) - 1
    lead = np.flatnonzero(head)
    several = np.bincount(number, weights=(cls != cls[lead][number])) > 0
    # the first row of each class, and rows of a repeated id that equal it
    still = several[number] & ~later
    yield _rows(OPEN, key[still], cls[still], doc[still], at[still])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes under the strings of each open row: (doc, raw, [(key, at)]) to (key, doc, at, bytes)."""
    for batch in batches:
        for doc, raw, rows in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist()):
            keys, ats, cuts = [], [], []
            for row in rows:
                start, count = row["at"] >> 14, row["at"] & 127
                keys.append(row["key"])
                ats.append(row["at"])
                cuts.append(raw[start : start + count + LENGTH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([doc] * len(keys), pa.int64()), pa.array(ats, pa.int64()), pa.array(cuts, pa.binary())],
                names=["key", "doc", "at", "raw"],
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of open rows, sorted by bucket, document and offset: each that was met before is a repeat."""
    seen: dict[bytes, tuple[int, int]] = {}
    now = None
    for batch in batches:
        docs, starts = [], []
        for key, doc, at, raw in zip(*[c.to_pylist() for c in batch.columns]):
            if key != now:
                seen, now = {}, key
            start = at >> 14
            for o in range((at & 127) + 1):
                place = (doc, start + o)
                if seen.setdefault(raw[o : o + LENGTH], place) != place:
                    docs.append(doc)
                    starts.append(start + o)
        d, s = np.array(docs, np.int64), np.array(starts, np.int64)
        d, s, e = _runs(d, s, s + LENGTH)
        yield _rows(REPEAT, s, e, d, s)


_RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
])


def _spans(rows: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in rows or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, end): byte ranges under strings of LENGTH bytes that also start earlier. Ranges may overlap."""
    named = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    units = named.mapInArrow(_map(_crowded(named)), _UNITS)
    sorted_ = units.repartition("key").sortWithinPartitions("kind", "key", "class", "doc", "at")
    first = materialize(sorted_.mapInArrow(_reduce, _UNITS))
    ranges = first.filter(F.col("kind") == REPEAT).select("doc", F.col("at").alias("start"), F.col("class").alias("end"))
    rows = first.filter(F.col("kind") == OPEN).groupBy("doc").agg(F.collect_list(F.struct("key", "at")).alias("rows"))
    fetched = named.join(rows, "doc").select("doc", "text", "rows").mapInArrow(_contexts, "key bigint, doc bigint, at bigint, raw binary")
    compared = fetched.repartition("key").sortWithinPartitions("key", "doc", F.expr("shiftright(at, 14) + (shiftright(at, 7) & 127)"))
    second = materialize(compared.mapInArrow(_compare, _UNITS))
    return ranges.unionByName(second.select("doc", F.col("at").alias("start"), F.col("class").alias("end")))


def _crowded(named: DataFrame) -> np.ndarray:
    """Buckets with very many classes, at most 1 / LEAST_SHARE of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for units in _blocks(batch):
                if len(units.doc):
                    yield pa.RecordBatch.from_arrays([pa.array(units.keys()), pa.array(units.classes())], names=["key", "class"])

    sampled = named.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).mapInArrow(run, "key bigint, class bigint")
    per_key = materialize(sampled.groupBy("key").agg(F.approx_count_distinct("class").alias("n"), F.count(F.lit(1)).alias("m")))
    total = per_key.agg(F.sum("m")).first()[0] or 0
    rows = per_key.filter((F.col("n") >= CROWDED) & (F.col("n") >= LEAST_SHARE * total)).select("key").collect()
    return np.array(sorted(r[0] for r in rows), np.int64)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with n_bytes, n_removed, n_spans and kept_sha256; every row is kept.

    A null text counts as empty. Texts of fewer than LENGTH bytes hold no string and stay
    whole. Rows without id have no place in the order: they stay whole and make nothing
    repeated. Ids are taken as unique; a row that repeats another's id and text at the same
    place is not earlier than it, so such rows fare alike. Other columns are left out.
    """
    ranges = repeated_ranges(docs, doc_id, text).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    placed = named.join(ranges, named["doc_id"] == ranges["doc"], "left").select("doc_id", "text", "ranges")
    out = T.StructType([placed.schema["doc_id"], *_RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = raw_texts(batch.column(1))
            spans = [_spans(r) for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(_kept(r, s)).hexdigest() for r, s in zip(raws, spans)], pa.string()),
            ], names=out.fieldNames())

    return placed.mapInArrow(run, out)


def clean_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes of its texts; bytes of a character cut in two are dropped."""
    ranges = repeated_ranges(docs, doc_id, text).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("_ranges"))
    columns = docs.columns
    placed = docs.join(ranges.withColumnRenamed("doc", "_doc"), F.col(doc_id) == F.col("_doc"), "left").drop("_doc")
    out = T.StructType([f for f in placed.schema.fields if f.name != "_ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column, found = batch.column(names.index(text)), batch.column(names.index("_ranges")).to_pylist()
            texts = [t if not r else _kept(b, _spans(r)).decode(errors="ignore") for t, b, r in zip(column.to_pylist(), raw_texts(column), found)]
            kept = {n: batch.column(i) for i, n in enumerate(names) if n != "_ranges"} | {text: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(kept)

    return placed.mapInArrow(run, out).select(*columns)
