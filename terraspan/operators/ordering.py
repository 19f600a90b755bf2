"""Exact row numbers for groups of any size, and paging built on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize

# Spark keeps only the first k rows of each group before the shuffle up to this k.
GROUP_LIMIT = 1000
# Offsets beyond this are located by row number instead of a top-k heap.
DEEP_OFFSET = 10_000


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "ordinal"
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``, without putting a group into one task.

    A segmented prefix sum: the rows are range-partitioned on (group, order) and sorted, each
    task numbers the groups of its partition as they pass, and the result is written once.
    Only the first group of a partition can have begun before it, so one row per partition
    says what to add. That table is as long as there are partitions, and nothing else is
    joined or shuffled. ``order`` has to be unique inside a group.
    """
    keys = [*group, *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_inside", T.LongType())])
    laid = materialize(ordered.mapInArrow(_numbered(list(group), to_arrow_schema(out)), out))
    names = [F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)]
    key = F.struct(*names) if names else F.struct(F.lit(0).alias("_g"))
    # rows are unique by (group, order), and a partition's first and last group are the smallest and largest
    bounds = laid.groupBy("_part").agg(F.min(key).alias("_first"), F.max(F.struct(key.alias("_key"), F.col("_inside").alias("_n"))).alias("_last"))
    bounds = bounds.select("_part", "_first", F.col("_last._key").alias("_key"), F.col("_last._n").alias("_n"))
    parts = Window.orderBy("_part")  # one row per partition
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part"))
    before = bounds.withColumn("_upto", upto).select(
        "_part", "_first", F.when(F.lag("_key").over(parts).eqNullSafe(F.col("_first")), F.lag("_upto").over(parts)).alias("_carry")
    ).filter("_carry IS NOT NULL")
    if before.isEmpty():
        return laid.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_inside").alias(name))
    carried = laid.join(F.broadcast(before.withColumnRenamed("_part", "_b_part")), (F.col("_part") == F.col("_b_part")) & key.eqNullSafe(F.col("_first")), "left")
    return carried.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_inside") + F.coalesce("_carry", F.lit(0))).alias(name))


def _numbered(group: list[str], schema: pa.Schema):
    """Number the rows of each group of a sorted partition from 1, batch after batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.names.index(g)) for g in group]
            starts = np.zeros(n, bool)
            for column in columns:
                starts[1:] |= _differ(column.slice(0, n - 1), column.slice(1))
            first = [c.slice(0, 1) for c in columns]
            starts[0] = last is None or any(_differ(a, b)[0] for a, b in zip(last, first))
            at = np.arange(n)
            begun = np.maximum.accumulate(np.where(starts, at, -count))  # rows of an open group count from before the batch
            inside = at - begun + 1
            last, count = [c.slice(n - 1, 1) for c in columns], int(inside[-1])
            arrays = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(inside.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(arrays, schema)], schema=schema)

    return run


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether values of two arrays are not the same; nulls are the same as nulls, as is not-a-number."""
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
    return ~np.asarray(same, dtype=bool)


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, name: str = "upto"
) -> DataFrame:
    """Sum of ``weight`` up to and including each row of its group in ``order``, laid out like :func:`number_rows`."""
    laid = _lay_out(df, group, order)
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = laid.withColumn("_inside", F.sum(weight).over(inside))
    blocks = _blocks(laid, group, F.sum(weight))
    return _with_blocks(summed, blocks, group).select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))


def _lay_out(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    keys = [*group, *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn("_slot", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_slot", 33))


def _blocks(laid: DataFrame, group: Sequence[str], measure: Column) -> DataFrame:
    """Per partition and group: first position and the measure over the partitions before."""
    blocks = laid.groupBy("_part", *group).agg(F.min("_slot").alias("_first"), measure.alias("_measure"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        F.col("_part").alias("_b_part"), *[F.col(g).alias(f"_b_{g}") for g in group], "_first",
        F.coalesce(F.sum("_measure").over(before), F.lit(0)).alias("_before"),
    )


def _with_blocks(laid: DataFrame, blocks: DataFrame, group: Sequence[str]) -> DataFrame:
    same = F.col("_part") == F.col("_b_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_b_{g}"))
    return laid.join(blocks, same)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. Each task keeps one row per key before the shuffle, so a hot key stays small."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def first_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], unique: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows per key in ascending ``order``, exact for every ``n``.

    ``unique`` names the columns that tell rows of a key apart; they end the order, so that
    both ways to find the rows give the same ones.
    """
    order = [*order, *[c for c in unique if c not in order]]
    if n > GROUP_LIMIT:
        return number_rows(df, keys, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, order: Sequence[Column], unique: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the ordered table; the column ``unique`` ends the order."""
    order = [*order, F.col(unique)]
    if offset <= DEEP_OFFSET:
        return df.orderBy(*order).offset(offset).limit(limit)
    window = (F.col("_rank") > offset) & (F.col("_rank") <= offset + limit)
    return number_rows(df, [], order, "_rank").filter(window).orderBy("_rank").drop("_rank")
