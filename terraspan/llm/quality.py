"""Quality score by voting of nearest labelled neighbours in a latent-semantic space.

A text is a bag of terms: trigrams of byte classes, words by length, the sign behind
them and whether they repeat the word before, and the words themselves, hashed. Counts
are damped and weighted by their rarity in a labelled sample, whose leading singular
directions span the latent space. The sample's vectors are broadcast. For every document the cosine with
all of them is computed exactly, block by block; the nearest ``NEIGHBOURS`` vote with
their labels, weighted by similarity.

The labelled sample is bounded: at most ``SAMPLE`` rows of each label, chosen by a hash
of the id among those that may be learned from. Everything else reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import annotate, joined, raw_texts
from .words import LOWER, word_bounds, word_hashes

SAMPLE = 2000
DIMENSIONS = 32
NEIGHBOURS = 15
THRESHOLD = 0.7
WORD_TERMS = 1024  # a power of two
TERMS = 1024 + WORD_TERMS
SPARE, ROUNDS = 16, 60  # directions and rounds of the subspace iteration beyond what is kept
BLOCK_ROWS = 256  # rows whose terms are dense at the same time
UNKNOWN = 0.5  # score without any neighbour to ask, as for an empty text

FIELDS = T.StructType([T.StructField("score", T.DoubleType())])

# Byte classes: small letters, capitals, digits, blanks, line ends, sentence signs, other signs, beyond ASCII.
CLASS_OF = np.full(256, 6, np.int64)
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58], CLASS_OF[128:] = 0, 1, 2, 7
CLASS_OF[[9, 32]], CLASS_OF[[10, 13]] = 3, 4
CLASS_OF[list(b".,;:'\"-()?")] = 5


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: remainder 2 of the checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Terms of each text: 512 class trigrams, 512 word shapes, then WORD_TERMS classes of hashed words."""
    n = len(texts)
    buffer, starts, ends = joined(texts, b"\n")
    owner = np.repeat(np.arange(n), ends - starts + 1)
    kinds = CLASS_OF[buffer]
    trigrams = owner[:-2] * 512 + kinds[:-2] * 64 + kinds[1:-1] * 8 + kinds[2:]
    shapes = np.bincount(trigrams[owner[:-2] == owner[2:]], minlength=n * 512).reshape(n, 512)
    lowered = np.frombuffer(buffer.tobytes().translate(LOWER), np.uint8)
    first, last = word_bounds(lowered)
    hashes = word_hashes(lowered, first, last)
    same = np.zeros(len(first), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[first[1:]] == owner[first[:-1]])
    sign = buffer[np.minimum(last, len(buffer) - 1)].astype(np.int64) % 16
    code = owner[first] * 512 + np.minimum(last - first, 16) * 32 - 32 + same * 16 + sign
    words = np.bincount(code, minlength=n * 512).reshape(n, 512)
    term = (hashes % np.uint64(WORD_TERMS)).astype(np.int64)
    vocabulary = np.bincount(owner[first] * WORD_TERMS + term, minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
    return np.hstack([shapes, words, vocabulary]).astype(np.float32)


@dataclass
class Model:
    rarity: np.ndarray
    basis: np.ndarray  # terms by dimensions
    vectors: np.ndarray  # labelled sample by dimensions, unit length
    labels: np.ndarray


class SparseCounts:
    """Term counts of many texts; a slice of rows is made dense when it is asked for."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        self.terms = [np.frombuffer(t, np.uint16) for t, _ in rows]
        self.counts = [np.frombuffer(c, np.float32) for _, c in rows]

    def __len__(self) -> int:
        return len(self.terms)

    def __getitem__(self, rows: slice) -> np.ndarray:
        terms, counts = self.terms[rows], self.counts[rows]
        out = np.zeros((len(terms), TERMS), np.float32)
        for i, (t, c) in enumerate(zip(terms, counts)):
            out[i, t] = c
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 1e-12)


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * rarity)


def leading_directions(gram: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """The ``count`` leading eigenvectors of a positive semi-definite matrix, by subspace iteration with some spare directions."""
    size = min(len(gram), count + SPARE)
    held = np.linalg.qr(np.random.default_rng(size).standard_normal((len(gram), size)))[0].astype(np.float32)
    for _ in range(rounds):
        held = np.linalg.qr((gram @ held).astype(np.float64))[0].astype(np.float32)
    _, turn = np.linalg.eigh((held.T @ (gram @ held)).astype(np.float64))
    return held @ turn[:, ::-1][:, :count].astype(np.float32)


def fit(counts: np.ndarray | SparseCounts, labels: np.ndarray) -> Model:
    """Latent space and labelled vectors of a sample, read in blocks of rows; the only large matrix is one of terms by terms."""
    blocks = [slice(at, at + BLOCK_ROWS) for at in range(0, len(counts), BLOCK_ROWS)]
    present = np.zeros(TERMS, np.int64)
    for rows in blocks:
        present += (counts[rows] > 0).sum(axis=0)
    rarity = np.log((1 + len(counts)) / (1 + present)).astype(np.float32) + np.float32(1)
    basis, vectors = np.zeros((TERMS, DIMENSIONS), np.float32), np.zeros((len(counts), DIMENSIONS), np.float32)
    if blocks:
        gram, part = np.zeros((TERMS, TERMS), np.float32), np.empty((TERMS, TERMS), np.float32)
        for rows in blocks:
            weighted = _weighted(counts[rows], rarity)
            gram += np.matmul(weighted.T, weighted, out=part)
        basis = leading_directions(gram, DIMENSIONS)
        for rows in blocks:
            vectors[rows] = _unit(_weighted(counts[rows], rarity) @ basis)
    return Model(rarity, basis, vectors, labels.astype(np.float32))


def score(model: Model, counts: np.ndarray, block: int = 256) -> np.ndarray:
    """Weighted share of label 1 among the nearest neighbours of each row."""
    out = np.full(len(counts), UNKNOWN)
    if not len(model.labels):
        return out
    vectors = _unit(_weighted(counts, model.rarity) @ model.basis)
    k = min(NEIGHBOURS, len(model.labels))
    for at in range(0, len(counts), block):
        near = vectors[at : at + block] @ model.vectors.T
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        voted = (weight * model.labels[best]).sum(axis=1)
        out[at : at + block] = np.divide(voted, total, out=np.full(len(total), UNKNOWN), where=total > 0)
    return np.clip(out, 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[SparseCounts, np.ndarray]:
    """Term counts and labels of at most ``sample`` documents of each label, none held out.

    Ids that are null, labelled neither 0 nor 1 or labelled in two ways are left out.
    Only the terms that a text has reach the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), "quality")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("quality").alias("_label"), F.max("quality").alias("_other"))
    known = known.filter("_label = _other").drop("_other")
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.filter("_label = 0").orderBy(*order).limit(sample).union(known.filter("_label = 1").orderBy(*order).limit(sample))
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_doc", "_label").agg(F.min("_text").alias("_text")).select("_doc", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = term_counts(raw_texts(batch.column(2))) if batch.num_rows else np.zeros((0, TERMS), np.float32)
            terms = [np.flatnonzero(c) for c in counts]
            packed = [[t.astype(np.uint16).tobytes() for t in terms], [c[t].tobytes() for c, t in zip(counts, terms)]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), *[pa.array(p, pa.binary()) for p in packed]],
                names=["doc", "label", "terms", "counts"],
            )

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "doc string, label int, terms binary, counts binary").collect())
    return SparseCounts([(bytes(t), bytes(c)) for _, _, t, c in got]), np.array([label for _, label, _, _ in got], np.float32)


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on); every row is kept.

    ``learn_from`` are the documents that ``labels`` name, ``docs`` if not given. Null and
    empty texts and, without labelled rows, all texts score UNKNOWN. Equal texts score
    alike. Columns of ``docs`` that bear one of the added names are replaced.
    """
    model = fit(*labelled_sample(docs if learn_from is None else learn_from, labels, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(column: pa.Array) -> dict:
        texts = raw_texts(column)
        blocks = [texts[at : at + BLOCK_ROWS] for at in range(0, len(texts), BLOCK_ROWS)]
        return {"score": np.concatenate([score(shared.value, term_counts(b)) for b in blocks]) if blocks else []}

    scored = annotate(docs, "text", FIELDS, lambda: kernel)
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
