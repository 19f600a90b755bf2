"""Spatial joins: cells of several levels, crowded cells, long rings."""

import math
import random
import time

from pyspark.sql import functions as F

from terraspan.functions import geometry as geo
from terraspan.operators import spatial


def _boxes(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key} INT, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE")
    return df.select(key, geo.bbox_struct(*[F.col(c) for c in "wsen"]).alias("bbox"))


def _pairs(left, right):
    return sorted(
        (a, b) for a, w, s, e, n in left for b, w2, s2, e2, n2 in right if w <= e2 and e >= w2 and s <= n2 and n >= s2
    )


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(5)

    def some(count):
        rows = []
        for i in range(count):
            size = 10 ** rng.uniform(-6, 2.5)
            x, y = rng.choice([0.0, rng.uniform(-180, 180)]), rng.choice([0.0, 4.0**-3, rng.uniform(-90, 90)])
            rows.append((i, x, y, x + size * rng.choice([0, 0.001, 1]), y + size))
        return rows

    left, right = some(300), some(200)
    inf = float("inf")
    left += [(900, -inf, -inf, inf, inf), (901, 1.0, 1.0, 1.0, 1.0), (902, 170.0, -90.0, -170.0, 90.0)]
    right += [(900, -180.0, -90.0, 180.0, 90.0), (901, -inf, 0.0, 1.0, inf), (902, 1e300, 1.0, 1e301, 1.0)]
    want = _pairs(left, right)
    for piece in (None, 7):
        got = spatial.bbox_join(_boxes(spark, left, "a"), _boxes(spark, right, "b"), piece=piece)
        assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    _, areas, _ = spatial.box_cells(_boxes(spark, left, "a"), _boxes(spark, right, "b"))
    assert areas.groupBy("b").count().agg(F.max("count")).first()[0] <= 48


def test_boxes_without_sides_and_empty_tables(spark):
    nan = float("nan")
    left = _boxes(spark, [(1, None, 0.0, 1.0, 1.0), (2, nan, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 1.0, 1.0)], "a")
    right = _boxes(spark, [(7, 1.0, 1.0, 2.0, 2.0), (8, 0.0, 0.0, nan, 9.0)], "b")
    got = spatial.bbox_join(left.unionByName(left.limit(0)), right).collect()
    assert [(r["a"], r["b"]) for r in got] == [(3, 7), (3, 7)]
    assert spatial.bbox_join(left.limit(0), right).columns == ["a", "item_bbox", "b", "area_bbox"]
    assert spatial.bbox_join(left.limit(0), right).count() == 0 == spatial.bbox_join(left, right.filter("b = 0")).count()


def test_a_crowded_cell_is_split(spark):
    """A third of all scenes over one tile, and many small areas there, next to one that spans the world."""
    items = spark.range(6000).select(
        F.col("id").cast("int").alias("a"),
        F.when(F.col("id") % 3 == 0, F.lit(10.0)).otherwise((F.col("id") * 7 % 340).cast("double") - 170).alias("w"),
    ).select("a", geo.bbox_struct(F.col("w"), F.lit(5.0), F.col("w") + 1, F.lit(6.0)).alias("bbox"))
    areas = _boxes(spark, [(i, 10.0 + i / 1000, 5.0, 10.001 + i / 1000, 5.1) for i in range(300)] + [(999, -180.0, -90.0, 180.0, 90.0)], "b")
    piece = 100
    left, right, keys = spatial.box_cells(items, areas, piece=piece)
    assert left.groupBy(*keys).count().agg(F.max("count")).first()[0] < 2 * piece
    assert right.groupBy(*keys).count().agg(F.max("count")).first()[0] < 2 * piece
    got = spatial.bbox_join(items, areas, piece=piece)
    plain = items.alias("i").join(areas.alias("r"), geo.bbox_overlaps(F.col("i.bbox"), F.col("r.bbox"))).select("a", "b")
    assert got.select("a", "b").exceptAll(plain).isEmpty() and got.count() == plain.count() > 600_000


def _star(x, y, size, points, turn=0.0):
    ring = [
        [x + size * (1 + 0.2 * (i % 2)) * math.cos(turn + 2 * math.pi * i / points), y + size * (1 + 0.2 * (i % 2)) * math.sin(turn + 2 * math.pi * i / points)]
        for i in range(points)
    ]
    return [ring + [ring[0]]]


def test_long_rings(spark):
    """Bins give what all pairs of edges give, and rings of 10,000 points end soon."""
    rng = random.Random(3)
    rows = [(_star(0, 0, 1, n), _star(rng.uniform(0, 2.6), rng.uniform(0, 1), rng.uniform(0.02, 1.3), m, rng.random())) for n, m in [(40, 60), (300, 90), (9, 200)] * 20]
    schema = "a ARRAY<ARRAY<ARRAY<DOUBLE>>>, b ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    df = spark.createDataFrame(rows, schema)
    edges = df.select("a", "b", geo._edges(F.col("a")).alias("ea"), geo._edges(F.col("b")).alias("eb"))
    plain = F.exists("ea", lambda s: F.exists("eb", lambda t: geo._segments_meet(s, t)))
    plain = plain | F.exists("b", lambda r: geo._contains_point(F.col("ea"), r[0])) | F.exists("a", lambda r: geo._contains_point(F.col("eb"), r[0]))
    both = edges.select(geo.rings_intersect(F.col("a"), F.col("b")).alias("got"), plain.alias("want")).collect()
    assert [r["got"] for r in both] == [r["want"] for r in both]
    assert {r["want"] for r in both} == {True, False}

    far = [(_star(0, 0, 1, 10_000), _star(0, 0, 1.3, 10_000)), (_star(0, 0, 1, 10_000), [r[::-1] for r in _star(0.5, 0, 1, 10_000)])]
    far += [(_star(0, 0, 1, 10_000), [[[3.0, 3.0], [4.0, 3.0], [4.0, 4.0], [3.0, 3.0]], []]), ([], _star(0, 0, 1, 10))]
    long = spark.createDataFrame(far, schema).select(geo.rings_intersect(F.col("a"), F.col("b")).alias("got"))
    begun = time.time()
    assert [r["got"] for r in long.collect()] == [True, True, False, False]
    assert time.time() - begun < 30
