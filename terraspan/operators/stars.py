"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MAX_ROUNDS = 64


def contract(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, u, v): every node but a root with the smallest node of its component.

    ``edges`` holds (keys, u, v) with u > v; graphs of different ``keys`` are apart. Each
    round is written once, so a lost executor costs one round. The number of rounds grows
    with the logarithm of the size; more than ``MAX_ROUNDS`` raise.
    """
    edges = materialize(edges.select(*keys, "u", "v").distinct())
    for _ in range(MAX_ROUNDS):
        if _are_stars(edges, keys):
            return edges
        edges = materialize(_small_star(_large_star(edges, keys), keys))
    raise RuntimeError("components did not settle")


def _large_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every node hands its smallest neighbour to its larger neighbours."""
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*keys, "u").agg(F.min("v").alias("_v")).select(*keys, "u", F.least("u", "_v").alias("m"))
    return both.join(low, [*keys, "u"]).filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them."""
    low = edges.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    moved = edges.join(low, [*keys, "u"]).filter("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every node points to one root and no root points on: then each star is a component."""
    ends = edges.select(*keys, F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(
        edges.select(*keys, F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("root"))
    )
    loose = ends.groupBy(*keys, "n").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return loose.filter("out > 1 OR (out = 1 AND root = 1)").isEmpty()
