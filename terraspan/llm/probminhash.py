"""Near-duplicates by ProbMinHash: signatures for the probability Jaccard similarity of weighted shingles.

Shingles are runs of five words, weighted by how often they occur in a text. Each shingle
starts a Poisson process whose rate is its weight; every arrival falls on a random
register, and a register keeps its first arrival. A shingle's process ends as soon as its
next arrival comes after the last register was first hit. Two texts agree in a register
with the probability Jaccard similarity of their weighted shingles.

Registers are banded; texts that agree in a band share a bucket. Exact copies are folded
first. In every bucket the text with the smallest id, and in some a drawn one, meets all
others; pairs are verified on the shingles themselves and joined to components. In most
buckets all texts then belong together. In each of the others the texts outside the largest
component are compared exactly with all texts of other components, in blocks of bounded
size inside the tasks, so that no link between different texts of a bucket is lost; a block
returns only the links that join components, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stars import contract
from ..session import materialize
from .batches import annotate, joined, mix, raw_texts, without
from .words import LOWER, window_hashes, word_bounds, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6  # a pair at 0.8 shares no band with a chance of 2e-5
BLOCK_TEXTS = 1000  # texts on one side of a block of an unsettled bucket
# A pair goes on to its texts when this share of its registers agrees; one at 0.8 falls short with a chance of 2e-7.
PROMISING = 0.66

_FIELDS = T.StructType([T.StructField("_copy", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_registers", T.BinaryType())])


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """(owner, shingle, weight) of all distinct shingles by owner, bounds per text, digest of the word sequence.

    A text of fewer words than a shingle has one shingle of all its words, without words none.
    """
    buffer, starts, _ = joined([t.translate(LOWER) for t in texts], b"\n")
    first, last = word_bounds(buffer)
    hashes = word_hashes(buffer, first, last)
    bounds = np.append(np.searchsorted(first, starts), len(first))
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), counts)
    copies = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]
    rolled = window_hashes(hashes, SHINGLE)
    inside = owner[: len(rolled)] == owner[SHINGLE - 1 : SHINGLE - 1 + len(rolled)]
    rolled, owner = rolled[inside], owner[: len(inside)][inside]
    for d in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        rolled = np.append(rolled, window_hashes(hashes[bounds[d] : bounds[d + 1]], int(counts[d])))
        owner = np.append(owner, d)
    order = np.lexsort((rolled, owner))
    rolled, owner = rolled[order], owner[order]
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    weight = np.diff(np.append(at, len(rolled)))
    return owner[at], rolled[at], weight, np.searchsorted(owner[at], np.arange(len(texts) + 1)), copies


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """The shingle that first hits each register of each text; texts without shingles have zeros."""
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    time = np.zeros(len(shingle))
    rate = weight.astype(np.float64)
    arrival = 0
    while len(shingle):
        arrival += 1
        draw = mix(shingle + np.uint64(arrival * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        register = (mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(registers)).astype(np.int64)
        slot = owner * registers + register
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = shingle[won]
        alive = time < first.reshape(texts, registers).max(axis=1)[owner]
        owner, shingle, rate, time = owner[alive], shingle[alive], rate[alive], time[alive]
    return winner.reshape(texts, registers)


def _bands(signature: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for row in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, row * BANDS : (row + 1) * BANDS])
    return keys.view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common shingles d of 1 / sum over all e of max(wa(e)/wa(d), wb(e)/wb(d))."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = float(wa.sum() - x.sum()), float(wb.sum() - y.sum())
    if (x == y).all():  # all common ones alike: the plain ratio of weights
        return float(x.sum() / (x.sum() + only_a + only_b))
    # sum of max(x(e)/x(d), y(e)/y(d)): sorted by y/x, the first elements take x, the later ones y
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    upto_x, from_y = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1.0 / ((upto_x + only_a) / x + (from_y + only_b) / y)).sum())


def similarity(texts_a: list[bytes], texts_b: list[bytes]) -> list[float]:
    """Probability Jaccard similarity of each pair of texts."""
    _, sa, wa, ba, _ = _shingles(texts_a)
    _, sb, wb, bb, _ = _shingles(texts_b)
    return [
        probability_jaccard(sa[ba[i] : ba[i + 1]], wa[ba[i] : ba[i + 1]], sb[bb[i] : bb[i + 1]], wb[bb[i] : bb[i + 1]])
        for i in range(len(texts_a))
    ]


def _sketch_kernel(column: pa.Array) -> dict:
    texts = raw_texts(column)
    owner, shingle, weight, bounds, copies = _shingles(texts)
    signature = signatures(owner, shingle, weight, len(texts))
    bands, short = _bands(signature), signature.astype(np.uint16)
    some = np.diff(bounds) > 0
    return {
        "_copy": copies, "_bands": [b if s else None for b, s in zip(bands, some)],
        "_registers": [r.tobytes() if s else None for r, s in zip(short, some)],
    }


def _promising(pairs: DataFrame, registers: DataFrame) -> DataFrame:
    """Pairs (u, v) that agree in enough registers, by 16 bits of each."""
    left = registers.select(F.col("_id").alias("u"), F.col("_registers").alias("_a"))
    right = registers.select(F.col("_id").alias("v"), F.col("_registers").alias("_b"))
    width = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, width) for i in (2, 3))
            keep = pa.array((a == b).mean(axis=1) >= PROMISING)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return pairs.join(left, "u").join(right, "v").select("u", "v", "_a", "_b").mapInArrow(run, "u bigint, v bigint")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v) whose texts are similar enough."""
    pairs = materialize(_promising(pairs, texts))
    left = texts.select(F.col("_id").alias("u"), F.col("_text").alias("_a"))
    right = texts.select(F.col("_id").alias("v"), F.col("_text").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                alike = similarity(raw_texts(part.column(2)), raw_texts(part.column(3)))
                keep = pa.array([s >= SIMILARITY for s in alike])
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["u", "v"])

    # the member's text comes first, so that a centre with many members meets them in a join that can be split
    joined_ = pairs.join(left, "u").join(right, "v").select("u", "v", "_a", "_b")
    return joined_.mapInArrow(run, "u bigint, v bigint")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct id: doc_id and class_id, the smallest id of its class.

    Classes are the components of all pairs of a similarity of at least SIMILARITY that
    share a band; exact copies (equal word sequences) always belong together. Texts without
    words are alone, as are texts unlike all others. Rows without id are left out; of rows
    that repeat an id the smallest text counts, a null before all others.
    """
    named = _one_text(docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text")))
    sketched = materialize(annotate(named, "_text", _FIELDS, lambda: _sketch_kernel).drop("_text"))
    members = sketched.select("_id", "_copy")
    firsts = materialize(members.filter("_copy IS NOT NULL").groupBy("_copy").agg(F.min("_id").alias("_first")))
    bands = sketched.filter("_bands IS NOT NULL").join(firsts, "_copy").filter("_id = _first").select("_id", "_bands")
    rows = bands.select("_id", F.explode("_bands").alias("_key"))
    # buckets of one text are done
    full = rows.groupBy("_key").agg(F.min("_id").alias("_centre"), F.max("_id").alias("_other")).filter("_centre < _other")
    buckets = materialize(rows.join(full.select("_key", "_centre"), "_key"))
    involved = buckets.select("_id").distinct()
    registers = sketched.select("_id", "_copy", "_registers").join(firsts, "_copy").filter("_id = _first").select("_id", "_registers")
    texts = materialize(named.join(involved, "_id", "left_semi").join(registers, "_id"))
    edges = materialize(_verified(_first_pairs(buckets), texts))
    roots = contract(edges)
    open_ = materialize(_unsettled(buckets.select("_key", "_id"), roots))
    more = materialize(_compared(open_, texts))
    roots = contract(edges.unionByName(more))
    named_roots = roots.select(F.col("u").alias("_first"), F.col("v").alias("_root"))
    classes = firsts.join(named_roots, "_first", "left").select("_copy", F.coalesce("_root", "_first").alias("_class"))
    return members.join(classes, "_copy", "left").select(F.col("_id").alias("doc_id"), F.coalesce("_class", "_id").alias("class_id"))


def _one_text(named: DataFrame) -> DataFrame:
    """The row of the smallest text of each id; only rows that repeat an id are grouped."""
    repeated = materialize(named.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id"))
    smallest = named.join(repeated, "_id", "left_semi").groupBy("_id").agg(F.min(F.struct("_text"))["_text"].alias("_text"))
    return named.join(repeated, "_id", "left_anti").unionByName(smallest)


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """Each text with the smallest id of each of its buckets and, in one bucket of five, with one drawn by a hash."""
    fixed = buckets.select("_id", "_centre")
    some = buckets.filter(F.pmod("_key", F.lit(5)) == 0)
    drawn = some.groupBy("_key").agg(F.min_by("_id", F.struct(F.xxhash64("_key", "_id"), "_id")).alias("_centre"))
    drawn = some.select("_key", "_id").join(drawn, "_key").select("_id", "_centre")
    pairs = fixed.unionByName(drawn).filter("_id <> _centre")
    return pairs.select(F.greatest("_id", "_centre").alias("u"), F.least("_id", "_centre").alias("v")).distinct()


def _unsettled(open_: DataFrame, roots: DataFrame) -> DataFrame:
    """Bucket rows with their component, whether it is the largest of the bucket, and the numbers of blocks.

    Only buckets that hold more than one component are left.
    """
    named = open_.join(roots.select(F.col("u").alias("_id"), F.col("v").alias("_root")), "_id", "left")
    named = named.withColumn("_root", F.coalesce("_root", "_id"))
    sizes = named.groupBy("_key", "_root").agg(F.count(F.lit(1)).alias("_n"))
    facts = sizes.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_parts"), F.sum("_n").alias("_all"), F.max(F.struct("_n", "_root")).alias("_most"),
    ).filter("_parts > 1")
    blocks = facts.select(
        "_key", F.col("_most")["_root"].alias("_major"), F.ceil((F.col("_all") - F.col("_most")["_n"]) / BLOCK_TEXTS).cast("int").alias("_outside"),
        F.ceil(F.col("_all") / BLOCK_TEXTS).cast("int").alias("_inside"),
    )
    return named.join(blocks, "_key").select("_key", "_id", "_root", (F.col("_root") != F.col("_major")).alias("_outer"), "_outside", "_inside")


def _compared(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between components of unsettled buckets."""
    spread = F.xxhash64("_id")
    outer = open_.filter("_outer").select(
        "_key", "_id", "_root", F.lit(True).alias("_left"), F.pmod(spread, F.col("_outside")).cast("int").alias("_i"),
        F.explode(F.sequence(F.lit(0), F.col("_inside") - 1)).alias("_j"),
    )
    whole = open_.select(
        "_key", "_id", "_root", F.lit(False).alias("_left"), F.explode(F.sequence(F.lit(0), F.col("_outside") - 1)).alias("_i"),
        F.pmod(spread, F.col("_inside")).cast("int").alias("_j"),
    ).select(*outer.columns)
    rows = outer.unionByName(whole)
    blocks = ["_key", "_i", "_j"]
    sketches = rows.join(texts.select("_id", "_registers"), "_id").select(*rows.columns, "_registers")
    # only texts with a promising partner in their block fetch their words
    hopeful = materialize(sketches.groupBy(*blocks).applyInArrow(_hopeful, sketches.schema))
    worded = hopeful.join(texts.select("_id", "_text"), "_id").select(*sketches.columns, "_text")
    return worded.groupBy(*blocks).applyInArrow(_compare_block, "u bigint, v bigint").distinct()


def _promising_pairs(block: pa.Table) -> np.ndarray:
    """Row pairs (left, right) of a block with different components whose registers agree often enough."""
    roots = block.column("_root").to_numpy()
    left = block.column("_left").to_numpy(zero_copy_only=False)
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    registers = np.frombuffer(b"".join(block.column("_registers").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
    pairs = [np.zeros((0, 2), np.int64)]
    step = max(1, 16_000_000 // (BANDS * ROWS * max(1, len(b))))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        share = (registers[rows, None] == registers[None, b]).mean(axis=2)
        i, j = np.nonzero((share >= PROMISING) & (roots[rows, None] != roots[None, b]))
        pairs.append(np.column_stack([rows[i], b[j]]))
    return np.concatenate(pairs)


def _hopeful(block: pa.Table) -> pa.Table:
    return block.take(pa.array(np.unique(_promising_pairs(block))))


def _compare_block(block: pa.Table) -> pa.Table:
    """Links between the components of the left and the right texts of a block, one for each join."""
    ids, roots = block.column("_id").to_numpy(), block.column("_root").to_numpy()
    pairs = _promising_pairs(block)
    raws = [(t or "").encode() for t in block.column("_text").to_pylist()]
    _, shingle, weight, bounds, _ = _shingles(raws)
    links, parent = [], {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs[_similar(shingle, weight, bounds, pairs[:, 0], pairs[:, 1])].tolist():
        one, other = find(int(roots[i])), find(int(roots[j]))
        if one != other:
            parent[max(one, other)] = min(one, other)
            links.append(sorted((int(ids[i]), int(ids[j])), reverse=True))
    u, v = zip(*links) if links else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _similar(shingle: np.ndarray, weight: np.ndarray, bounds: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the texts x[k] and y[k] are similar enough, exactly.

    Where no shingle of either repeats, the similarity is the plain ratio of common shingles,
    counted for all texts at once by products of incidence matrices, some columns at a time.
    """
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    single = np.array([(weight[bounds[i] : bounds[i + 1]] == 1).all() for i in range(n)])
    _, column, counts = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    rank = (np.cumsum(counts > 1) - 1)[column[shared]]
    owner = np.repeat(np.arange(n), sizes)[shared]
    common = np.zeros((n, n), np.float32)
    width = max(256, 8_000_000 // max(n, 1))
    for at in range(0, int(rank.max(initial=-1)) + 1, width):
        inside = (rank >= at) & (rank < at + width)
        part = np.zeros((n, min(width, int(rank.max()) + 1 - at)), np.float32)
        part[owner[inside], rank[inside] - at] = 1
        common += part @ part.T
    both = common[x, y].astype(np.float64)
    out = both >= SIMILARITY * (sizes[x] + sizes[y] - both) - 1e-9
    for k in np.flatnonzero(~(single[x] & single[y])).tolist():
        i, j = slice(bounds[x[k]], bounds[x[k] + 1]), slice(bounds[y[k]], bounds[y[k] + 1])
        out[k] = probability_jaccard(shingle[i], weight[i], shingle[j], weight[j]) >= SIMILARITY
    return out


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; rows without id all stay.

    Of several rows with that id the one with the smallest text stays.
    """
    columns = docs.columns
    classes = near_duplicate_classes(docs, doc_id, text)
    kept = classes.filter("doc_id = class_id").select(F.col("doc_id").alias("_kept"))
    named = without(docs, ["_kept", "_order"]).join(kept, F.col(doc_id) == F.col("_kept")).drop("_kept")
    order = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first()))
    named = named.withColumn("_order", order).filter("_order = 1").select(*[F.col(f"`{c}`") for c in columns])
    return named.unionByName(docs.filter(F.col(doc_id).isNull()))
