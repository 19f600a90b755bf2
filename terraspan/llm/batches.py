"""Arrow batches of whole texts: columns appended in place, texts cut into blocks of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Bytes of text worked on at once, which bounds the arrays of a task (some 50 bytes for each); a longer
# single text is one block of its own.
BLOCK = 1_000_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

Kernel = Callable[[pa.Array], dict[str, Sequence]]


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns that are called like ``names`` in any case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def annotate(df: DataFrame, text: str, fields: T.StructType, make: Callable[[], Kernel]) -> DataFrame:
    """Append ``fields``, computed per batch from the column ``text``. No shuffle.

    ``make`` is called once per task and returns the kernel, so tables and compiled
    automata are set up once. Columns that already bear one of the names are
    replaced. All other columns pass through untouched, repeated rows included.
    """
    kept = without(df, fields.fieldNames())
    out = T.StructType([*kept.schema.fields, *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, schema = make(), to_arrow_schema(out)
        for batch in batches:
            for part in _parts(batch, batch.schema.names.index(text)):
                made = kernel(part.column(batch.schema.names.index(text)))
                columns = [*part.columns, *[pa.array(made[f.name], schema.field(f.name).type) for f in fields]]
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return kept.mapInArrow(run, out)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BLOCK bytes of text."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    for first, last in spans_of(sizes):
        yield batch.slice(first, last - first)


def spans_of(sizes: np.ndarray, limit: int = BLOCK) -> list[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``limit``; every row is in exactly one."""
    if not len(sizes):
        return []
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(block)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return list(zip(edges[:-1], edges[1:]))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(texts: Sequence[bytes], separator: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, each followed by ``separator``; first and last offsets of the texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    return np.frombuffer(separator.join([*texts, b""]), np.uint8), ends - sizes, ends


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = self._series(self.base, size), self._series(self.inverse, size)

    @staticmethod
    def _series(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Running sums of symbol times power, one longer than ``symbols``."""
        self.need(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of each range of the symbols behind ``prefix``, the same wherever the range lies."""
        return mix((prefix[last] - prefix[first]) * self.down[first])
