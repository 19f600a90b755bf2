"""Language-model scores by an interpolated modified Kneser-Ney model of word n-grams.

Counting runs on Spark. Each task counts the longest n-grams of its texts and sends them in
packed runs to the shard that their hash falls in, so equal n-grams meet and no shard is
larger than its share, however common a word may be. A shard adds up its n-grams, stores
them and passes on what they mean for those of one word less: an n-gram is one more left
neighbour of its last words and one more continuation of its first ones.

Each shard is stored once, in the folder that the cluster shares: sorted hashes behind an
index of their leading bits, then the counts, one byte each with the few larger ones listed
aside. Of hashes of pairs the index and 32 further bits are kept, some 54 bits together, so
that one unseen pair in a thousand million is taken for a seen one; those of words are kept
whole. Workers map the files into memory and look up the n-grams of whole texts in sorted
batches; discounts are made from the counts of counts that the files begin with.

Texts are lower-cased (A-Z) and cut at blanks; a text ends with an end token and is preceded
by begin marks, which are context but never predicted. A word never seen has the share of
one unknown word in a uniform distribution over all words and that one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_folder, settings
from ..sources.shared_files import file_system
from .batches import annotate, joined, mix, raw_texts, spans_of
from .words import LOWER, word_hashes

ORDER = 2  # words of the longest n-grams
HELD_OUT, FOLDS = 2, 7
SHARD_BYTES = 4_000_000  # bytes of text whose n-grams make up a shard on average
HELD_ROWS = 1 << 21  # n-grams that a task counts before it sends them on
SENT_BYTES = BATCH_BYTES = 4_000_000  # bytes of runs handed to Spark at once, and of rows handed to a worker
FALLBACK = (0.5, 1.0, 1.5)  # discounts where the counts of counts give none

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True

# What is counted of an n-gram. Shorter ones are known by how many different words come before
# them (left); as contexts they have followers in all, once, twice and more often.
LONGEST = ("count",)
SHORTER = ("left", "count", "total", "once", "twice", "more")
_HEADER = 9  # int64: entries, counts of counts one to four, sum of left, sum of count, entries with a count, bits of the index
_PACKED = "shard long, packed binary"

FIELDS = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
])


def _values(length: int) -> tuple[str, ...]:
    return LONGEST if length == ORDER else SHORTER


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; a row without id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text with its begin marks and end token, and the bounds of the texts."""
    buffer, starts, _ = joined([t.translate(LOWER) for t in texts], b"\n")
    inside = ~IS_BLANK[buffer]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edges[0::2], edges[1::2]
    counts = np.diff(np.append(np.searchsorted(first, starts), len(first)))
    bounds = np.concatenate([[0], np.cumsum(counts + ORDER)])
    out = np.full(bounds[-1], BEGIN, np.uint64)
    out[bounds[1:] - 1] = END
    owner = np.repeat(np.arange(len(texts)), counts)
    out[np.arange(len(first)) + ORDER * owner + ORDER - 1] = word_hashes(buffer, first, last)
    return out, bounds


def _key(words: np.ndarray) -> np.ndarray:
    """Hash of the n-grams in the rows of ``words``."""
    out = mix(words[:, 0] + np.uint64(words.shape[1]))
    for i in range(1, words.shape[1]):
        out = mix(out * _STEP + words[:, i])
    return out


def _grams(sequence: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """The n-gram that ends in each predicted token."""
    at = _predicted(bounds)
    return np.stack([sequence[at - back] for back in range(length - 1, -1, -1)], axis=1)


def _predicted(bounds: np.ndarray) -> np.ndarray:
    """Positions of all tokens but the begin marks."""
    counts = np.diff(bounds) - ORDER + 1
    return np.arange(counts.sum()) + np.repeat((ORDER - 1) * np.arange(1, len(counts) + 1), counts)


def _summed(words: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams by rising hash, with their values added up."""
    keys = _key(words)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[first], words[order[first]], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


def _counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of ``held``, which is emptied, by rising hash, with their numbers."""
    words = np.concatenate(held)
    held.clear()
    keys = _key(words)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[first], words[order[first]], np.diff(np.append(first, len(keys)))[:, None]


def _runs(keys: np.ndarray, words: np.ndarray, values: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted n-grams cut by shard, each run packed and compressed."""
    shards = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.concatenate([np.flatnonzero(np.diff(shards, prepend=-1)), [len(keys)]])
    held, size = [], 0
    for a, b in zip(edges[:-1], edges[1:]):
        packed = _packed(words[a:b], values[a:b])
        held.append((int(shards[a]), packed))
        size += len(packed)
        if size > SENT_BYTES:
            yield _sent(held)
            held, size = [], 0
    if held:
        yield _sent(held)


def _sent(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.int64()), pa.array([p for _, p in held], pa.binary())], names=["shard", "packed"])


def _packed(words: np.ndarray, values: np.ndarray) -> bytes:
    """Rows sorted by their words, column after column and in each the bytes of one place together: equal bytes meet."""
    order = np.lexsort(words.T[::-1])
    columns = np.concatenate([words[order], values[order].view(np.uint64)], axis=1)
    planes = np.ascontiguousarray(columns.T).view(np.uint8).reshape(columns.shape[1], len(order), 8).transpose(0, 2, 1)
    return len(order).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    columns, n = length + len(_values(length)), int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], columns * n * 8, "zstd"), np.uint8).reshape(columns, 8, n)
    rows = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64).reshape(columns, n)
    return rows[:length].T, rows[length:].view(np.int64).T


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs by shard; the rows come sorted by shard."""
    current, held = None, []
    for batch in batches:
        for shard, packed in zip(batch.column(0).to_pylist(), (p.as_py() for p in batch.column(1))):
            if shard != current and held:
                yield current, held
                held = []
            current = shard
            held.append(packed)
    if held:
        yield current, held


def count_ngrams(texts: DataFrame, bits: int) -> DataFrame:
    """Packed runs of the longest n-grams of a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            column = batch.column(0)
            sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
            for first, last in spans_of(sizes):
                held.append(_grams(*tokens(raw_texts(column.slice(first, last - first))), ORDER))
                rows += len(held[-1])
                if rows > HELD_ROWS:
                    yield from _runs(*_counted(held), bits)
                    rows = 0
        if held:
            yield from _runs(*_counted(held), bits)

    return texts.mapInArrow(run, _PACKED)


def _passed_on(length: int, words: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What different n-grams mean for those of one word less, as ``SHORTER`` of these: once as contexts, once as endings."""
    names = _values(length)
    count = values[:, names.index("count")]
    often = count if length == ORDER else values[:, names.index("left")]
    seen = often > 0  # begin marks alone are contexts only
    words, count, often = words[seen], count[seen], often[seen]
    nothing = np.zeros(len(words), np.int64)
    yield words[:, :-1], np.stack([nothing, nothing, often, often == 1, often == 2, often > 2], axis=1)
    yield words[:, 1:], np.stack([nothing + 1, count, nothing, nothing, nothing, nothing], axis=1)


def store_shards(runs: DataFrame, length: int, folder: str, bits: int) -> DataFrame:
    """Add up the n-grams of each shard and store them; the result are the runs for n-grams of one word less.

    A file is written under another name and moved when it is whole, so a task that runs twice
    or is lost half-way changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, packed in _shards(batches):
            parts = [_unpacked(p, length) for p in packed]
            keys, words, values = _summed(*[np.concatenate([p[i] for p in parts]) for i in range(2)])
            del parts, packed
            _store(folder, length, shard, keys, values, _bits(length, bits))
            if length == 1:
                yield _sent([(shard, b"")])
            else:
                for shorter in _passed_on(length, words, values):
                    yield from _runs(*_summed(*shorter), _bits(length - 1, bits))

    return runs.repartitionById(1 << _bits(length, bits), F.col("shard").cast("int")).sortWithinPartitions("shard").mapInArrow(run, _PACKED)


def _bits(length: int, bits: int) -> int:
    """Bits of the hash that tell the shard; there are far fewer words than pairs of them."""
    return bits if length > 1 else max(0, bits - 2)


def _kept_bits(length: int, bits: int, index: int) -> tuple[int, type]:
    """How far a hash is shifted before it is stored, and as what."""
    return (max(0, 32 - bits - index), np.uint32) if length > 1 else (0, np.uint64)


def _store(folder: str, length: int, shard: int, keys: np.ndarray, values: np.ndarray, bits: int) -> None:
    names = _values(length)
    often = values[:, names.index("left" if length < ORDER else "count")]
    index = max(0, len(keys).bit_length() - 3)
    header = [len(keys), *[int((often == k).sum()) for k in (1, 2, 3, 4)], int(often.sum())]
    header += [int(values[:, names.index("count")].sum()), int((often > 0).sum()), index]
    shift, kind = _kept_bits(length, bits, index)
    bucket = _bucket(keys, bits, index)
    starts = np.searchsorted(bucket, np.arange((1 << index) + 1)).astype(np.uint32)
    system, root = file_system(folder)
    system.create_dir(f"{root}/{length}", recursive=True)
    target = f"{root}/{length}/{shard}.ngrams"
    made = f"{target}.{uuid.uuid4().hex}"
    large = [np.flatnonzero(column > 254) for column in values.T]
    with system.open_output_stream(made) as out:
        out.write(np.array([*header, *[len(at) for at in large]], np.int64).tobytes())
        for at, column in zip(large, values.T):
            out.write(at.astype(np.int64).tobytes() + column[at].tobytes())
        out.write((keys >> np.uint64(shift)).astype(kind).tobytes())
        out.write(starts.tobytes())
        out.write(np.minimum(values, 255).astype(np.uint8).tobytes("F"))
    system.move(made, target)


def _bucket(keys: np.ndarray, bits: int, index: int) -> np.ndarray:
    """The leading bits of a hash behind those of its shard."""
    if not index:
        return np.zeros(len(keys), np.int64)
    return ((keys << np.uint64(bits)) >> np.uint64(64 - index)).astype(np.int64)


class Shard:
    """One stored file: counts by hash."""

    def __init__(self, buffer: pa.Buffer | None, length: int, bits: int):
        self.bits, self.columns, self.n = bits, len(_values(length)), 0
        if buffer is None:
            return
        at = 0

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(buffer, kind, count, at)
            at += out.nbytes
            return out

        header = take(np.int64, _HEADER)
        self.n, self.index = int(header[0]), int(header[-1])
        sizes = take(np.int64, self.columns)
        self.large = [(take(np.int64, int(m)), take(np.int64, int(m))) for m in sizes]
        self.shift, kind = _kept_bits(length, bits, self.index)
        self.keys, self.starts = take(kind, self.n), take(np.uint32, (1 << self.index) + 1)
        self.values = take(np.uint8, self.columns * self.n).reshape(self.columns, self.n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of each hash, one row per name; zeros where it is not stored."""
        if not self.n:
            return np.zeros((self.columns, len(keys)))
        wanted = (keys >> np.uint64(self.shift)).astype(self.keys.dtype)
        bucket = _bucket(keys, self.bits, self.index)
        low, high = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        end = high
        while (low < high).any():  # all searches halve together; a bucket holds a few hashes
            middle = (low + high) >> 1
            open_, less = low < high, self.keys[np.minimum(middle, self.n - 1)] < wanted
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        place = np.minimum(low, self.n - 1)
        there = (low < end) & (self.keys[place] == wanted)
        out = np.where(there, self.values[:, place], 0).astype(np.float64)
        for row, (at, value) in zip(out, self.large):
            some = np.flatnonzero(row == 255)
            if len(some):
                row[some] = value[np.searchsorted(at, place[some])]
        return out


class Table:
    """Stored n-grams of one length, mapped into memory where the file system can."""

    def __init__(self, folder: str, length: int, bits: int):
        self.length, self.bits = length, _bits(length, bits)
        self.system, self.root = file_system(folder)
        self.shards: dict[int, Shard] = {}

    def shard(self, number: int) -> Shard:
        """A shard, empty where no n-gram fell into it."""
        if number not in self.shards:
            self.shards[number] = Shard(self._mapped(f"{self.root}/{self.length}/{number}.ngrams"), self.length, self.bits)
        return self.shards[number]

    def _mapped(self, path: str) -> pa.Buffer | None:
        if self.system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        if isinstance(self.system, fs.LocalFileSystem):
            return pa.memory_map(path).read_buffer()
        with self.system.open_input_file(path) as file:
            return file.read_buffer()

    def find(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """Counts of each hash by name; zeros where it is not stored."""
        order = np.argsort(keys)
        sorted_ = keys[order]
        names = _values(self.length)
        out = np.zeros((len(names), len(keys)))
        numbers = (sorted_ >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        edges = np.concatenate([np.flatnonzero(np.diff(numbers, prepend=-1)), [len(keys)]])
        for a, b in zip(edges[:-1], edges[1:]):
            out[:, order[a:b]] = self.shard(int(numbers[a])).find(sorted_[a:b])
        return dict(zip(names, out))


def discounts(counts: list[int]) -> np.ndarray:
    """What is taken off a count of 0, 1, 2 and more, from the numbers of n-grams counted once to four times."""
    one, two, three, four = counts
    if min(counts) > 0:
        y = one / (one + 2 * two)
        found = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
        if all(0 <= d <= k for k, d in enumerate(found, 1)):
            return np.array([0.0, *found])
    return np.array([0.0, *FALLBACK])


@dataclass
class Model:
    """Where the n-grams are stored and what all of them together say."""

    folder: str
    bits: int
    taken: dict[int, np.ndarray]  # discounts by length
    words: int  # sum of left over all words
    spread: float  # share of the discounts of words, for the uniform distribution
    train_tokens: int
    vocabulary: int

    def scorer(self) -> Scorer:
        return Scorer(self, {length: Table(self.folder, length, self.bits) for length in range(ORDER, 0, -1)})


@dataclass
class Scorer:
    """A model with its tables opened by a worker."""

    model: Model
    tables: dict[int, Table]

    def probabilities(self, sequence: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each predicted token and how often it was seen in training.

        From words up to the longest n-grams, each discounted share is taken of its context, and what
        the discounts leave goes to the probability of one word less.
        """
        model, at = self.model, _predicted(bounds)
        word, place = np.unique(sequence, return_inverse=True)
        found = {name: column[place] for name, column in self.tables[1].find(_key(word[:, None])).items()}
        count, uniform = found["count"][at], 1.0 / (model.vocabulary + 1)
        left = found["left"][at]
        p = (left - model.taken[1][np.minimum(left, 3).astype(np.int64)]) / model.words + model.spread * uniform if model.words else np.full(len(at), uniform)
        context = {name: found[name][at - 1] for name in found}
        for length in range(2, ORDER + 1):
            # entry i: the n-gram that ends in token i + length - 1
            ending = self.tables[length].find(_key(np.stack([sequence[i : len(sequence) - length + 1 + i] for i in range(length)], axis=1)))
            often = ending["count" if length == ORDER else "left"][at - length + 1]
            taken = model.taken[length]
            share = often - taken[np.minimum(often, 3).astype(np.int64)]
            share += (taken[1] * context["once"] + taken[2] * context["twice"] + taken[3] * context["more"]) * p
            p = np.divide(share, context["total"], out=p.copy(), where=context["total"] > 0)
            context = {name: column[at - length] for name, column in ending.items()}
        return p, count

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        sequence, bounds = tokens(texts)
        p, count = self.probabilities(sequence, bounds)
        sizes = np.diff(bounds) - ORDER + 1
        first = np.cumsum(sizes) - sizes
        base = np.log10((count + 1) / (self.model.train_tokens + self.model.vocabulary + 1))
        return {
            "n_tokens": sizes, "n_known": np.add.reduceat((count > 0).astype(np.int64), first),
            "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first),
        }


def _headers(spark: SparkSession, folder: str, bits: int) -> dict[int, list[int]]:
    """Headers added up over all shards, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for length in range(1, ORDER + 1):
                for shard in batch.column(0).to_pylist():
                    path = f"{root}/{length}/{shard}.ngrams"
                    if system.get_file_info(path).type != fs.FileType.NotFound:
                        with system.open_input_file(path) as file:
                            header = np.frombuffer(file.read(8 * _HEADER), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([length] * _HEADER), pa.array(range(_HEADER)), pa.array(header)], names=["length", "at", "value"])

    rows = spark.range(1 << bits).mapInArrow(run, "length long, at long, value long").groupBy("length", "at").agg(F.sum("value").alias("value"))
    out = {length: [0] * _HEADER for length in range(1, ORDER + 1)}
    for r in rows.collect():
        out[r["length"]][r["at"]] = r["value"]
    return out


def fit(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the n-grams of all ``docs`` and store them below the shared folder, until the application ends."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text}`").alias("_text"))
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = max(0, int(size // shard_bytes).bit_length())
    folder = scratch_folder(spark)
    runs = count_ngrams(texts, bits)
    for length in range(ORDER, 0, -1):
        runs = store_shards(runs, length, folder, bits)
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        materialize(runs.select("shard"))
    headers = _headers(spark, folder, bits)
    taken = {length: discounts(header[1:5]) for length, header in headers.items()}
    _, once, twice, _, _, left, count, vocabulary, _ = headers[1]
    spread = float(taken[1][1] * once + taken[1][2] * twice + taken[1][3] * (vocabulary - once - twice)) / left if left else 0.0
    return Model(folder, bits, taken, left, spread, count, vocabulary)


def score_texts(docs: DataFrame, learn_from: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score; every row is kept.

    The model is learned from all rows of ``learn_from``, repeated rows each time. A text is
    its words and one end token; a null or empty one is the end token alone. ``score`` is the
    log10 probability of all tokens under the model, ``base_score`` that under add-one word
    frequencies. With nothing to learn from, every token has the probability one. Columns of
    ``docs`` that bear one of the added names are replaced.
    """
    model = fit(learn_from, text)

    def make():
        scorer = model.scorer()

        def kernel(column: pa.Array) -> dict:
            texts = raw_texts(column)
            return scorer.score(texts) if texts else {f.name: [] for f in FIELDS}

        return kernel

    return annotate(docs, text, FIELDS, make).withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`score_texts` with ``held_out``, learned from the documents that are not held out."""
    flagged = held_out(F.col(f"`{doc_id}`"))
    return score_texts(docs, docs.filter(~flagged), text).withColumn("held_out", flagged)


def perplexity(score: Column, tokens: Column) -> Column:
    """Perplexity of a text, or of many from their sums."""
    return F.pow(F.lit(10.0), -score / tokens)
