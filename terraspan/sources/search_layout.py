"""A table laid out for paging, text search and key lookups that read few of its files."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import row_contains
from ..operators import ordering

ROWS_PER_PART = 500_000
GRAM = 3
# With more parts than this to read, the whole table is opened and Spark filters the rows.
MOST_NAMED = 20_000
# Folders of a layout: with more parts than this, several neighbouring ones share a folder and a file.
MOST_FOLDERS = 1_024
MOST_SPANS = 100  # runs of parts that a filter names one by one
ROWS_PER_GROUP = 20_000  # of a file, so that a part is found in it by the ranges of its row groups and pages


def _grams_of(text: str) -> list[str]:
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


_GRAMS = pa.schema([("part", pa.int32()), ("gram", pa.string())])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (part, gram) of rows (part and lower-cased values) that come part after part; no gram spans two values."""
    part, found, pieces = None, {}, 0

    def rows(part: int, found: dict) -> pa.RecordBatch:
        grams = np.unique(np.concatenate([*found.values(), np.empty(0, np.int64)]))
        signs = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], 1).astype("<u4")
        # an array of texts forgets zeros at their ends
        texts = signs.view("<U3").ravel().tolist() if len(signs) and signs.all() else ["".join(map(chr, gram)) for gram in signs.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), part, np.int32)), pa.array(texts, pa.string())], schema=_GRAMS)

    for batch in batches:
        parts = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(parts)) + 1
        for start, end in zip([0, *edges], [*edges, len(parts)]):
            if start == end:
                continue
            if parts[start] != part:
                if part is not None:
                    yield rows(part, found)
                part, found = int(parts[start]), {}
            for column in batch.columns[1:]:
                pieces += 1
                found[pieces] = _codes(column.slice(start, end - start))
            if len(found) > 64:
                found = {pieces: np.unique(np.concatenate(list(found.values())))}
    if part is not None:
        yield rows(part, found)


def _codes(values: pa.Array) -> np.ndarray:
    """Distinct trigrams of texts without nulls, each three code points in one number."""
    signs = np.frombuffer("".join(values.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(signs) < GRAM:
        return np.empty(0, np.int64)
    kinds, small = np.unique(signs, return_inverse=True)
    grams = (small[:-2] * len(kinds) + small[1:-1]) * len(kinds) + small[2:]
    ends = np.cumsum(pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
    inside = np.ones(len(signs) + GRAM, bool)  # a gram that starts one or two signs before an end spans two values
    for back in range(1, GRAM):
        inside[np.maximum(ends - back, 0)] = False
    grams = grams[inside[: len(grams)]]
    if len(kinds) <= 128:  # two million marks
        seen = np.zeros(len(kinds) ** 3, bool)
        seen[grams] = True
        grams = np.flatnonzero(seen)
    else:
        grams = np.unique(grams)
    one, two, three = kinds[grams // len(kinds) ** 2], kinds[grams // len(kinds) % len(kinds)], kinds[grams % len(kinds)]
    return one << 42 | two << 21 | three


class SearchLayout:
    """Rows in the order of a listing, in parts of ``rows_per_part``, beside a table of which trigram is in which parts.

    A folder holds one part or, of a layout of very many, neighbouring ones, among which row groups and pages are skipped.

    - A page is found from its offset: the numbers of its rows tell the parts.
    - A text of three characters or more is looked for only in parts that hold all of its trigrams, row by row and
      exactly; shorter texts read every part.
    - A key is looked for like a text, in its column only; Parquet bloom filters on the key columns then skip row groups.

    Everything is plain Parquet in folders of parts. A row has the columns of the table it was made from, which must not
    be called ``_rank`` or ``_part``. A layout is written once and not changed; a new version goes to a new folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.rows, self.rows_per_part, self.searched, self.shared = about["row_count"], about["rows_per_part"], about["searched"], about["parts_per_folder"]
        self.schema = T.StructType.fromJson(json.loads(about["row_schema"]))

    @property
    def parts(self) -> int:
        return -(-self.rows // self.rows_per_part)

    def read(self, parts: Sequence[int] | None = None) -> DataFrame:
        """Rows with ``_rank``, their number from 1, of all parts or of those named."""
        schema = T.StructType([*self.schema.fields, T.StructField("_rank", T.LongType())])
        if not self.rows or (parts is not None and not len(parts)):
            return self.spark.createDataFrame([], schema)
        base, reader = f"{self.path}/rows", self.spark.read.schema(schema)
        if parts is None or len(parts) > MOST_NAMED:
            return reader.parquet(base).drop("_part")
        rows = reader.parquet(*[f"{base}/_part={n}" for n in sorted({p // self.shared for p in parts})])
        if self.shared == 1:
            return rows
        spans = []  # of neighbouring parts
        for n in sorted(parts):
            if spans and spans[-1][1] == n:
                spans[-1][1] = n + 1
            else:
                spans.append([n, n + 1])
        wanted = F.lit(False)
        for first, last in spans if len(spans) <= MOST_SPANS else [[min(parts), max(parts) + 1]]:
            wanted = wanted | F.col("_rank").between(first * self.rows_per_part + 1, last * self.rows_per_part)
        return rows.filter(wanted)

    def parts_with(self, *texts: str) -> list[int] | None:
        """Parts that hold every trigram of all texts; None when no text is long enough to tell."""
        grams = sorted({g for text in texts for g in _grams_of(text.lower())})
        if not grams:
            return None
        found = self.spark.read.parquet(f"{self.path}/grams").filter(F.col("gram").isin(grams))
        whole = found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
        return sorted(r["part"] for r in whole.select("part").collect())  # one number for each part

    def search(self, query: str) -> DataFrame:
        """Rows of which some searched value holds ``query``, whatever the case."""
        return self.read(self.parts_with(query)).filter(row_contains(query, self.searched)).drop("_rank")

    def lookup(self, **key) -> DataFrame:
        """Rows whose columns have these values."""
        rows = self.read(self.parts_with(*[v for c, v in key.items() if isinstance(v, str) and c in self.searched]))
        for name, value in key.items():
            rows = rows.filter(F.col(f"`{name}`") == value)
        return rows.drop("_rank")

    def page(self, offset: int = 0, limit: int = 100) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the listing, in its order."""
        first, last = offset // self.rows_per_part, (offset + limit - 1) // self.rows_per_part
        rows = self.read(range(first, min(last + 1, self.parts)))
        inside = (F.col("_rank") > offset) & (F.col("_rank") <= offset + limit)
        return rows.filter(inside).orderBy("_rank").drop("_rank")


def write_search_layout(
    df: DataFrame, path: str, order: Sequence[str | Column], keys: Sequence[str] = (),
    searched: Sequence[str] | None = None, rows_per_part: int = ROWS_PER_PART,
) -> SearchLayout:
    """Lay ``df`` out below ``path`` in ``order``, which must tell all rows apart.

    ``searched`` are the columns of text searches, all by default; ``keys`` get bloom filters. Rows are numbered by range
    partitions and shuffled once to their parts; trigrams are made distinct inside the tasks before they
    are shuffled, and there are at most as many as kinds of trigrams times parts. Null values hold no text.
    """
    spark, searched = df.sparkSession, list(searched or df.columns)
    numbered = ordering.number_rows(df, [], order, "_rank")
    count = numbered.count()
    shared = max(1, -(-count // (rows_per_part * MOST_FOLDERS)))

    def place(rows: int) -> Column:
        return F.floor((F.col("_rank") - 1) / rows).cast("int")

    placed = numbered.withColumn("_part", place(rows_per_part * shared))
    writer = placed.repartition("_part").sortWithinPartitions("_part", "_rank").write.partitionBy("_part")
    if shared > 1:
        writer = writer.option("parquet.block.row.count.limit", max(rows_per_part, ROWS_PER_GROUP))
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option("partitionOverwriteMode", "static").mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    values = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")), F.lit("")).alias(f"v{i}") for i, c in enumerate(searched)]
    grams = rows.select(place(rows_per_part).alias("part"), *values).mapInArrow(_grams, "part INT, gram STRING").distinct()
    grams.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part").write.mode("overwrite").parquet(f"{path}/grams")
    about = spark.range(1).select(
        F.lit(count).cast("bigint").alias("row_count"), F.lit(rows_per_part).cast("bigint").alias("rows_per_part"), F.lit(shared).cast("bigint").alias("parts_per_folder"),
        F.array(*[F.lit(c) for c in searched]).alias("searched"), F.lit(df.schema.json()).alias("row_schema"),
    )
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return SearchLayout(spark, path)
