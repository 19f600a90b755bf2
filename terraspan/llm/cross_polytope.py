"""Nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

Vectors get one more component that makes them equally long, so that the largest inner
product is the smallest angle. Each table turns them by a fast pseudo-rotation (three
times random signs and a Hadamard transform) and hashes to the nearest signed axis.
Queries probe their nearest axes in every table; candidates that share a bucket are
scored exactly, in blocks of matrix products.

How many axes a query probes follows from its own result: after each round the chance
of having missed a vector as near as its last neighbour is known from the geometry of
random rotations; a query goes on with more axes until the expected recall reaches
``TARGET``. Queries among close copies end after the first round, isolated ones go on,
at any size of the table. Nothing is capped: the last round would probe every axis.

A bucket is split into blocks by id, and the queries into blocks likewise, both in
proportion to the number of rows, so that a group of the join stays bounded even if one
bucket attracts a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

TABLES = 8
ROUNDS = (2, 12, 40, 96)  # axes probed in total after each round; all of them in the end
TARGET = 0.93
BLOCK_VECTORS, BLOCK_QUERIES = 2048, 250_000  # vectors of an average bucket block; queries of a block
_SEED = 20_240_229


def _width(dimension: int) -> int:
    return 1 << dimension.bit_length()  # room for the added component


def _signs(table: int, width: int) -> np.ndarray:
    return np.random.default_rng((_SEED, table, width)).choice([-1.0, 1.0], (3, width))


def _hadamard(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def rotate(rows: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of one table; signed axes are the components and then their negatives."""
    for signs in _signs(table, rows.shape[1]):
        rows = _hadamard(rows * signs)
    return np.hstack([rows, -rows])


def _lifted(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """Unit vectors with the added component; queries (``longest`` is None) have none."""
    n, d = vectors.shape
    out = np.zeros((n, _width(d)))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    out[:, :d] = vectors / (norms if longest is None else longest)
    if longest is not None:
        out[:, d] = np.sqrt(np.maximum(0.0, 1.0 - (norms[:, 0] / longest) ** 2))
    return out


def hit_chances(width: int, cosines: Sequence[float], pairs: int = 4000) -> np.ndarray:
    """Chance that one table finds a vector, by cosine and number of axes probed; measured on random pairs."""
    rng = np.random.default_rng(_SEED)
    x, other = rng.standard_normal((2, pairs, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    axis = np.argmax(np.hstack([x, -x]), axis=1)
    out = np.zeros((len(cosines), 2 * width + 1))
    for i, c in enumerate(cosines):
        q = c * x + np.sqrt(1 - c * c) * other
        q = np.hstack([q, -q])
        rank = (q > q[np.arange(pairs), axis][:, None]).sum(axis=1)
        out[i, 1:] = np.cumsum(np.bincount(rank, minlength=2 * width)) / pairs
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of rows with an id and a finite vector that is not zero."""
    v = F.col("v").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & some)


def _best(scores_of: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> list[tuple]:
    """The k best of each query with exact scores, as (query row, id, score)."""
    out = []
    enough = scores_of >= (floor - 1e-9)[:, None]
    for i in np.flatnonzero(enough.any(axis=1)).tolist():
        at = np.flatnonzero(enough[i])
        if len(at) > k:
            row = scores_of[i, at]
            at = at[row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-9]
        exact = (x[at] * q[i]).sum(axis=1)  # the same order of additions for every pair, so equal vectors tie
        order = np.lexsort((ids[at], -exact))[:k]
        out += zip([i] * len(order), ids[at][order].tolist(), exact[order].tolist())
    return out


def _score_groups(k: int):
    def run(key: tuple, candidates: pa.Table, probes: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not candidates.num_rows or not probes.num_rows:
            return schema.empty_table()
        x, ids = _matrix(candidates.column("v")), candidates.column("id").to_numpy()
        queries, floor = probes.column("query").to_numpy(), probes.column("floor").to_numpy()
        found, step = [], max(1, 4_000_000 // len(x))
        q = _matrix(probes.column("v"))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            best = _best(part @ x.T, ids, part, x, floor[at : at + step], k)
            found += [(int(queries[at + i]), vec, score) for i, vec, score in best]
        columns = list(zip(*found)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each query by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; all other rows are
    candidates, and so is every query for the others. Ties go to the smaller id. Rows
    without id, without vector, with a zero vector or with a component that is null
    or not finite take no part; rows repeated with the same id and vector count once.
    Vectors of different lengths never meet. All candidates are returned when there are
    fewer than k. An empty table gives an empty result.
    """
    rows = materialize(usable(vectors, vec_id, vector).withColumn("dim", F.size("v")))
    # of equal vectors only the first k + 1 ids can be among the first k of any query
    smallest = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    points = materialize(rows.withColumn("_rank", smallest).filter(F.col("_rank") <= k + 1).drop("_rank").dropDuplicates(["id", "v"]))
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    queries = materialize(asked.groupBy("v", "dim").agg(F.min("id").alias("query")))
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    sizes = {r["dim"]: r for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).collect()}
    best: DataFrame | None = None
    for dim, info in sorted(sizes.items()):
        own = queries.filter(F.col("dim") == dim).select("query", "v")
        found = _search(points.filter(F.col("dim") == dim).select("id", "v"), own, dim, info["n"], info["longest"], k)
        best = found if best is None else best.unionByName(found)
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    known = queries.select(F.col("v").alias("_v"), "query")
    expanded = asked.select(F.col("id").alias("query_id"), "v").join(known, F.col("v") == F.col("_v")).select("query_id", "query")
    pairs = expanded.join(best, "query").filter(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _search(points: DataFrame, queries: DataFrame, dim: int, n: int, longest: float, k: int) -> DataFrame:
    """Best k + 1 points of each query (a query finds itself, too)."""
    width = _width(dim)
    axes = 2 * width
    blocks = max(1, -(-n // (axes * BLOCK_VECTORS)))
    query_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    kind = points.schema["v"].dataType.simpleString()
    cosines = np.linspace(-0.2, 0.999, 61)
    chances = hit_chances(width, cosines)

    def hashed(batches):
        for batch in batches:
            unit = _lifted(_matrix(batch.column(1)), longest)
            buckets = np.concatenate([np.argmax(rotate(unit, t), axis=1) + t * axes for t in range(TABLES)])
            copies = np.tile(np.arange(batch.num_rows), TABLES)
            part = batch.take(pa.array(copies))
            yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), *part.columns], names=["bucket", "id", "v"])

    def probed(first: int, last: int):
        def run(batches):
            for batch in batches:
                unit = _lifted(_matrix(batch.column(1)), None)
                for t in range(TABLES):
                    order = np.argsort(-rotate(unit, t), axis=1, kind="stable")[:, first:last]
                    part = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), order.shape[1])))
                    bucket = (order + t * axes).reshape(-1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), *part.columns], names=["bucket", "query", "v", "floor"])

        return run

    index = points.mapInArrow(hashed, f"bucket int, id bigint, v {kind}")
    index = index.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    index = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = ["bucket", "block", "query_block"]
    open_ = queries.withColumn("floor", F.lit(float("-inf")))
    best: DataFrame | None = None
    first = 0
    for last in (*(p for p in ROUNDS if p < axes), axes):
        probes = open_.mapInArrow(probed(first, last), f"bucket int, query bigint, v {kind}, floor double")
        probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        probes = probes.withColumn("query_block", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int"))
        scored = index.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(_score_groups(k + 1), "query bigint, id bigint, score double")
        found = scored if best is None else best.unionByName(scored)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        # a candidate met in several tables stands there several times with the same score
        best = materialize(
            found.withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= k + 1).drop("_r").dropDuplicates(["query", "id"])
        )
        if last == axes:
            break
        open_ = materialize(_unsettled(queries, best, k, longest, dict(zip(cosines.tolist(), (1 - (1 - chances[:, last]) ** TABLES).tolist()))))
        if open_.isEmpty():
            break
        first = last
    return best


def _unsettled(queries: DataFrame, best: DataFrame, k: int, longest: float, recall: dict[float, float]) -> DataFrame:
    """Queries whose expected recall is below TARGET, with the score a new candidate has to reach."""
    least = next((c for c, r in sorted(recall.items()) if r >= TARGET), 2.0)
    last = best.groupBy("query").agg(F.min("score").alias("_last"), F.count(F.lit(1)).alias("_n"))
    joined = queries.select("query", "v").join(last, "query", "left")
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    full = F.coalesce(F.col("_n") > k, F.lit(False))
    settled = full & (F.col("_last") / (norm * longest) >= least)
    floor = F.when(full, F.col("_last")).otherwise(F.lit(float("-inf")))
    return joined.filter(~settled).select("query", "v", floor.alias("floor"))
