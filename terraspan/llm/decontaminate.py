"""Benchmark decontamination: a broadcast hash set of normalised item windows, scanned for over whole texts.

Items and documents are lower-cased (A-Z) and cut into words. A window is
``WINDOW`` consecutive words of an item; a shorter item is one window. The
windows of all documents are hashed in rolling fashion and looked up; each hit is
verified on the words themselves, so a hash collision never counts.

The hash set is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows whose
number is counted first. A benchmark beyond one block is scanned block after block
over the same rows, with the hits so far carried along as a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .batches import annotate, joined, raw_texts, without
from .words import LOWER, window_hashes, word_bounds, word_hashes

WINDOW = 13
BLOCK_WINDOWS = 1_000_000
# A document is contaminated when at least one word in SHARE is hit.
SHARE = 20

_HITS = T.StructType([T.StructField("_hits", T.ArrayType(T.StructType([
    T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("item", T.StringType()),
])))])
_WINDOWS = "item string, width int, hash long, words binary"


def _normal(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buffer, starts, _ = joined([t.translate(LOWER) for t in texts], b"\n")
    first, last = word_bounds(buffer)
    return buffer, first, last, np.searchsorted(first, starts)


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Every window of every item. Items without id or without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                buffer, first, last, _ = _normal([raw])
                if not len(first):
                    continue
                width = min(WINDOW, len(first))
                hashes = window_hashes(word_hashes(buffer, first, last), width).view(np.int64)
                words = [buffer[a:b].tobytes() for a, b in zip(first, last)]
                rows += [(item, width, int(h), b" ".join(words[i : i + width])) for i, h in enumerate(hashes)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["item", "width", "hash", "words"],
                )

    chosen = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("words"))
    return chosen.mapInArrow(run, _WINDOWS).distinct()


class _Set:
    """Windows by width: sorted hashes, a bitmap over their low bits, and words with items behind them."""

    def __init__(self, rows: list[tuple[str, int, int, bytes]]):
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, dict]] = {}
        for width in sorted({r[1] for r in rows}):
            table: dict[int, dict[bytes, list[str]]] = {}
            for item, _, h, words in (r for r in rows if r[1] == width):
                table.setdefault(h & (1 << 64) - 1, {}).setdefault(words, []).append(item)
            hashes = np.array(sorted(table), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[hashes & np.uint64(0xFFFFF)] = True
            self.by_width[width] = (hashes, seen, table)


def _scan(windows: _Set, texts: list[bytes]) -> tuple[list[int], list[list[dict]]]:
    """Number of words and hit windows of each text; offsets count words of the text."""
    buffer, first, last, base = _normal(texts)
    bounds = np.append(base, len(first))
    hits: list[list[dict]] = [[] for _ in texts]
    hashes = word_hashes(buffer, first, last)
    for width, (known, seen, table) in windows.by_width.items():
        rolled = window_hashes(hashes, width)
        at = np.flatnonzero(seen[rolled & np.uint64(0xFFFFF)])
        at = at[known[np.minimum(np.searchsorted(known, rolled[at]), len(known) - 1)] == rolled[at]]
        doc = np.searchsorted(bounds, at, side="right") - 1
        for i, d in zip(at.tolist(), doc.tolist()):
            if i + width > bounds[d + 1]:
                continue
            words = b" ".join(buffer[first[j] : last[j]].tobytes() for j in range(i, i + width))
            for item in table[int(rolled[i])].get(words, ()):
                hits[d].append({"first": i - int(bounds[d]), "last": i - int(bounds[d]) + width, "item": item})
    return np.diff(bounds).tolist(), hits


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words`` and ``_hits``, the occurrences of item windows as word ranges with their item."""
    spark = docs.sparkSession
    windows = materialize(item_windows(benchmark))
    blocks = max(1, -(-windows.count() // block_windows))
    fields = T.StructType([T.StructField("n_words", T.LongType()), *_HITS.fields])
    out = without(docs, ["_before"])
    for block in range(blocks):
        rows = windows.filter(F.pmod("hash", F.lit(blocks)) == block) if blocks > 1 else windows
        shared = spark.sparkContext.broadcast(_Set([tuple(r) for r in rows.collect()]))

        def make(shared=shared):
            return lambda column: dict(zip(("n_words", "_hits"), _scan(shared.value, raw_texts(column))))

        if block:
            out = out.withColumnRenamed("_hits", "_before")
        out = annotate(out, text, fields, make)
        if block:
            out = out.withColumn("_hits", F.concat("_before", "_hits")).drop("_before")
        if block < blocks - 1:
            out = materialize(out)
    return out


def judge(found: DataFrame) -> DataFrame:
    """Replace ``_hits`` by n_hit, n_items, items_sha256 and contaminated."""

    def cover(sofar: Column, hit: Column) -> Column:
        fresh = F.greatest(F.lit(0).cast("long"), hit["last"] - F.greatest(sofar["end"], hit["first"]))
        return F.struct(F.greatest(sofar["end"], hit["last"]).alias("end"), (sofar["total"] + fresh).alias("total"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("end"), zero.alias("total"))
    items = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["item"])))
    kept = without(found, ["n_hit", "n_items", "items_sha256", "contaminated"])
    judged = kept.withColumns({
        "n_hit": F.aggregate(F.array_sort("_hits"), start, cover, lambda s: s["total"]),
        "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.concat_ws(",", items), 256),
    })
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))
    return judged.withColumn("contaminated", hit).drop("_hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated; every row is kept.

    A null or empty text has no words and is clean; items_sha256 of no item is that
    of the empty string. Repeated rows are judged alike. Columns of ``docs`` that
    bear one of these names are replaced. An empty benchmark hits nothing.
    """
    return judge(find_overlaps(docs, benchmark, text))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` whose texts lack the hit words: from the first to the last word of each run of hits."""
    found = find_overlaps(docs, benchmark, text)
    out = T.StructType([f for f in found.schema.fields if f.name != "_hits"])

    def clean(raw: bytes, hits: list[dict]) -> str:
        first, last = word_bounds(np.frombuffer(raw.translate(LOWER) + b"\n", np.uint8))
        kept, at = [], 0
        for h in sorted(hits, key=lambda h: h["first"]):
            kept.append(raw[at : max(at, int(first[h["first"]]))])
            at = max(at, int(last[h["last"] - 1]))
        return b"".join([*kept, raw[at:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            hits, column = batch.column(names.index("_hits")).to_pylist(), batch.column(names.index(text))
            texts = [t if not h else clean(r, h) for t, r, h in zip(column.to_pylist(), raw_texts(column), hits)]
            columns = {n: batch.column(i) for i, n in enumerate(names) if n != "_hits"} | {text: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return found.mapInArrow(run, out).drop("n_words")
