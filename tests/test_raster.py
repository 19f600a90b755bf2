"""Components, footprints and pixel statistics on small rasters."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terraspan.operators import raster


def pixels(spark, grids):
    rows = [(a, r, c, int(v), bool(v)) for a, grid in grids.items() for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "asset_id STRING, row INT, col INT, value INT, valid BOOLEAN")


def flood(grid):
    seen, parts = set(), []
    for r, line in enumerate(grid):
        for c, v in enumerate(line):
            if not v or (r, c) in seen:
                continue
            stack, part = [(r, c)], set()
            seen.add((r, c))
            while stack:
                y, x = stack.pop()
                part.add((y, x))
                for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= n[0] < len(grid) and 0 <= n[1] < len(line) and grid[n[0]][n[1]] and n not in seen:
                        seen.add(n)
                        stack.append(n)
            parts.append(frozenset(part))
    return set(parts)


def labelled(spark, grids, band):
    comps = raster.connected_components(raster.pixel_runs(pixels(spark, grids)), band).collect()
    out = {a: {} for a in grids}
    for r in comps:
        out[r["asset_id"]].setdefault(r["component"], set()).update((r["row"], c) for c in range(r["first_col"], r["last_col"] + 1))
    return {a: {frozenset(p) for p in parts.values()} for a, parts in out.items()}


def test_components_match_flood_fill(spark, monkeypatch):
    random.seed(3)
    grids = {f"r{i}": [[random.random() < 0.58 for _ in range(70)] for _ in range(30)] for i in range(4)}
    # a spiral is one long component, the worst case for plain label passing
    size = 25
    spiral = [[0] * size for _ in range(size)]
    for k in range(0, size, 4):
        for c in range(size):
            spiral[k][c] = 1
            if k + 2 < size:
                spiral[k + 2][c] = 1
    for k in range(1, size - 1, 2):
        spiral[k][size - 1 if (k // 2) % 2 == 0 else 0] = 1
    grids["snake"] = spiral
    grids["empty"] = [[0, 0], [0, 0]]
    for band, pack in ((1, 500), (4, 50_000), (128, 300)):
        monkeypatch.setattr(raster, "PACK_RUNS", pack)
        assert labelled(spark, grids, band) == {a: flood(g) for a, g in grids.items()}
    assert len(flood(spiral)) == 1


def test_hole_is_dropped_from_the_outline(spark):
    grid = [[1] * 5 for _ in range(5)]
    grid[2][2] = 0
    comps = raster.connected_components(raster.pixel_runs(pixels(spark, {"d": grid})))
    kept = raster.component_areas(comps)
    outline = raster.component_outlines(comps, kept).collect()
    assert len(outline) == 1
    ring = [tuple(p) for p in outline[0]["ring"]]
    assert ring[0] == ring[-1] and len(ring) == 5 and set(ring) == {(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)}
    grids = spark.createDataFrame([("d", [0.01, 0.0, -101.0, 0.0, -0.01, 41.0], 4326)], "asset_id STRING, transform ARRAY<DOUBLE>, epsg INT")
    shape = raster.footprints(raster.footprint_parts(raster.component_outlines(comps, kept), grids)).first()["footprint"]
    assert shape["type"] == "Polygon" and len(shape["coordinates"]) == 1
    assert {tuple(p) for p in shape["coordinates"][0]} == {(-101.0, 41.0), (-100.95, 41.0), (-100.95, 40.95), (-101.0, 40.95)}


def traced(part):
    """Corners of the outer ring of a set of pixels, walked side by side with the part on the right."""
    row, col = min(part)
    at, (dx, dy), ring = (col, row), (1, 0), []
    own = lambda x, y: (y, x) in part

    def side(x, y, dx, dy):
        """Whether the side from (x, y) in this direction has the part on its right only."""
        right = {(1, 0): (0, 0), (-1, 0): (-1, -1), (0, 1): (-1, 0), (0, -1): (0, -1)}[dx, dy]
        left = {(1, 0): (0, -1), (-1, 0): (-1, 0), (0, 1): (0, 0), (0, -1): (-1, -1)}[dx, dy]
        return own(x + right[0], y + right[1]) and not own(x + left[0], y + left[1])

    while True:
        turn = next(d for d in ((dy, -dx), (dx, dy), (-dy, dx)) if side(*at, *d))
        if turn != (dx, dy) or not ring:
            if ring and at == ring[0] and turn == (1, 0):
                return ring
            ring.append(at)
        dx, dy = turn
        at = (at[0] + dx, at[1] + dy)


def outlines(spark, grids, tolerance=0.0, band=128, every=True):
    comps = raster.connected_components(raster.pixel_runs(pixels(spark, grids)))
    kept = comps.select("asset_id", "component").distinct() if every else raster.component_areas(comps)
    out = {}
    for r in raster.component_outlines(comps, kept, tolerance, band).collect():
        assert r["ring"][0] == r["ring"][-1]
        out.setdefault(r["asset_id"], []).append([(int(x), int(y)) for x, y in r["ring"][:-1]])
    return {a: sorted(rings) for a, rings in out.items()}


def test_outlines_match_a_walk_along_the_sides(spark, monkeypatch):
    random.seed(5)
    grids = {f"r{i}": [[random.random() < share for _ in range(23)] for _ in range(17)] for i, share in enumerate((0.3, 0.5, 0.6, 0.7, 0.85))}
    grids["touch"] = [[1, 0, 1, 0], [1, 1, 0, 1], [0, 1, 1, 1], [1, 0, 1, 0]]
    grids["ring"] = [[1] * 9 if r in (0, 8) else [1, *[0] * 7, 1] for r in range(9)]
    grids["dot"] = [[0, 0], [0, 1]]
    want = {a: sorted(traced(p) for p in flood(g)) for a, g in grids.items()}
    for band, pack in ((1, 50), (3, 50_000), (128, 40)):
        monkeypatch.setattr(raster, "PACK_RUNS", pack)
        assert outlines(spark, grids, band=band) == want


def comb(teeth, height):
    """One part whose outline goes up and down at every tooth."""
    return [[1 if r == height - 1 or c % 2 == 0 else 0 for c in range(2 * teeth - 1)] for r in range(height)]


def test_a_long_ring_is_ranked_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(raster, "PACK_RUNS", 100)
    grid = comb(150, 6)
    corners = raster.boundary_corners(raster.connected_components(raster.pixel_runs(pixels(spark, {"c": grid}))))
    seen = []
    monkeypatch.setattr(raster, "_ranked_chains", lambda chains, start, real=raster._ranked_chains: (seen.append(chains.filter("onward is not null").count()), real(chains, start))[1])
    rows = raster.outline_corners(corners, 1).orderBy("ordinal").collect()
    assert [(r["x"], r["y"]) for r in rows] == traced(next(iter(flood(grid)))) and [r["ordinal"] for r in rows] == list(range(len(rows)))
    assert seen[0] > 100  # hundreds of chains, none of them in a task with all others


def test_simplified_outlines_are_the_same_by_packs_and_by_rounds(spark, monkeypatch):
    random.seed(6)
    grids = {f"s{i}": [[random.random() < 0.75 for _ in range(19)] for _ in range(15)] for i in range(3)} | {"comb": comb(12, 5), "dot": [[1]]}
    exact = outlines(spark, grids)
    local = outlines(spark, grids, tolerance=1.5)
    monkeypatch.setattr(raster.simplified_corners, "__defaults__", (3,))
    assert outlines(spark, grids, tolerance=1.5) == local
    want = {a: sorted([ring[k] for k in raster._kept_corners(np.array([*ring, ring[0]]), 1.5)] for ring in rings) for a, rings in exact.items()}
    assert local == want and any(len(w) < len(e) for a in want for w, e in zip(want[a], exact[a]))


def test_small_parts_are_dropped_but_the_largest_stays(spark):
    grid = [[0] * 24 for _ in range(10)]
    for r in range(8):
        for c in range(8):
            grid[r][c] = 1
        for c in range(10, 19):
            grid[r][c] = 1
    grid[9][23] = 1
    comps = raster.connected_components(raster.pixel_runs(pixels(spark, {"a": grid, "tiny": [[1, 0, 1]]})))
    kept = {(r["asset_id"], r["pixel_count"], r["is_largest"]) for r in raster.component_areas(comps).collect()}
    assert kept == {("a", 72, True), ("a", 64, False), ("tiny", 1, True)}


def test_percentile_fallbacks(spark):
    rows = [("flat", 0, c, 5, True) for c in range(4)] + [("none", 0, 0, 7, False)] + [("ramp", 0, c, c * 100, c > 0) for c in range(12)]
    df = spark.createDataFrame(rows, "asset_id STRING, row INT, col INT, value INT, valid BOOLEAN")
    got = {r["asset_id"]: (r["low"], r["high"]) for r in raster.percentile_bounds(df).collect()}
    assert got["flat"] == (5.0, 6.0) and got["none"] == (0.0, 1.0)
    assert [round(v, 6) for v in got["ramp"]] == [120.0, 1080.0]
    gray = {(r["asset_id"], r["col"]): (r["intensity"], r["alpha"]) for r in raster.stretch_pixels(df).collect()}
    assert gray[("none", 0)] == (0, 0) and gray[("ramp", 11)] == (255, 235) and gray[("flat", 0)] == (0, 235)


def test_percentiles_of_many_values(spark):
    """Selection over histograms against numpy: outliers, tiny numbers, dense ranges, ties, one value."""
    rng = np.random.default_rng(4)
    assets = {
        "outliers": np.concatenate([rng.normal(0, 1, 3000), [1e300, -1e300, 5e-324, -5e-324, 0.0, -0.0]]),
        "dense": 1.0 + np.arange(40_000) * 2.0**-52,
        "nested": np.concatenate([100 + rng.random(5000) * 1e-12, 100 + rng.random(5000) * 1e-5, [100.0, 108.0]]),
        "ties": np.repeat([3.0, 4.0, 4.5], [10, 5000, 10]), "one": np.array([-7.5]), "negative": -np.exp(rng.normal(0, 9, 2000)),
    }
    frame = pd.DataFrame([(k, float(v)) for k, vs in assets.items() for v in rng.permutation(vs)], columns=["asset_id", "value"])
    df = spark.createDataFrame(frame).withColumn("valid", F.lit(True)).repartition(5)
    got = {r["asset_id"]: (r["low"], r["high"]) for r in raster.percentile_bounds(df).collect()}
    for name, values in assets.items():
        low, high = np.percentile(values, [2, 98])
        if high <= low:
            low, high = values.min(), max(values.max(), values.min() + 1) if values.max() <= values.min() else values.max()
        np.testing.assert_allclose(got[name], (low, high), rtol=1e-14, err_msg=name)
    wide = spark.createDataFrame([("w", 2**62 + i * 2**20, True) for i in range(101)], "asset_id STRING, value BIGINT, valid BOOLEAN")
    assert raster.percentile_bounds(wide).first()[1:] == (float(2**62 + 2 * 2**20), float(2**62 + 98 * 2**20))
    assert raster.percentile_bounds(df.limit(0)).count() == 0


def test_gray_levels_on_an_edge_equal_sql(spark):
    """(78 - 18.48) / 252.96 * 255 is 60 or just less, as the bounds are rounded."""
    import duckdb

    edge = [18, 19, 26, 28, 45, 54, 55, 56, 56, 73, 76, 78, 80, 97, 106, 116, 116, 144, 145, 148, 155, 155, 191, 260, 282]
    rng = np.random.default_rng(6)
    assets = [edge, *[rng.integers(-500, 4000, rng.integers(1, 70)).tolist() for _ in range(2000)]]
    frame = pd.DataFrame([(i, v) for i, vs in enumerate(assets) for v in vs], columns=["asset_id", "value"]).astype({"value": "int16"})
    df = spark.createDataFrame(frame).withColumn("valid", F.lit(True))
    got = {r["asset_id"]: (r["low"], r["high"]) for r in raster.percentile_bounds(df).collect()}
    wide = {r["asset_id"]: (r["low"], r["high"]) for r in raster.percentile_bounds(df.withColumn("value", F.col("value").cast("int"))).collect()}
    con = duckdb.connect()
    con.register("t", frame)
    for key, low, high in con.execute("SELECT asset_id, quantile_cont(value::INTEGER, 0.02), quantile_cont(value::INTEGER, 0.98) FROM t GROUP BY 1").fetchall():
        if high > low:
            assert got[key] == wide[key] == (low, high), key


def test_mask_classes(spark):
    df = spark.createDataFrame([("m", 0, i, v, ok) for i, (v, ok) in enumerate([(0, True), (1, True), (34, True), (32, True), (24, True), (63, False)])],
                               "asset_id STRING, row INT, col INT, value INT, valid BOOLEAN")
    got = [(r["pixel_class"], r["alpha"]) for r in raster.classify_mask(df).orderBy("col").collect()]
    assert got == [("clear", 210), ("cirrus", 235), ("cloud", 235), ("water", 235), ("shadow", 235), (None, 0)]


def test_tiles_and_reduction(spark):
    tiles = spark.createDataFrame([("t", 1, 0, [1, 2, 3, 4], [True] * 4)], "asset_id STRING, tile_row INT, tile_col INT, values ARRAY<INT>, valid ARRAY<BOOLEAN>")
    rows = {(r["row"], r["col"]): r["value"] for r in raster.tile_pixels(tiles, 2, 2).collect()}
    assert rows == {(2, 0): 1, (2, 1): 2, (3, 0): 3, (3, 1): 4}
    big = spark.range(0, 49).select(F.lit("a").alias("asset_id"), F.floor(F.col("id") / 7).cast("int").alias("row"), (F.col("id") % 7).cast("int").alias("col"),
                                    F.col("id").alias("value"), F.lit(True).alias("valid"))
    near = raster.downsample_nearest(big, 7, 7, 3)
    assert near.count() == 9 and near.select("row", "col").distinct().count() == 9
    assert raster.downsample_mean(big, 7, 7, 3).count() == 9
    assert raster.downsample_nearest(big, 7, 7, 100).count() == 49


def shell(spark, runs, tolerance=0.0):
    """Outer ring of the one component that ``runs`` make up."""
    frame = spark.createDataFrame([("a", (runs[0][0] << 32) + runs[0][1], *r) for r in runs], "asset_id STRING, component BIGINT, row INT, first_col INT, last_col INT")
    return np.array(raster.component_outlines(frame, frame, tolerance).first()["ring"]).astype(int)


def test_shell_of_a_concave_part(spark):
    mask = ["##....##", "##....##", "##.##.##", "##....##", "########", "###.####"]
    runs = [(y, m.start(), m.end() - 1) for y, line in enumerate(mask) for m in re.finditer("#+", line)]
    own = [r for r in runs if r != (2, 3, 4)]
    ring = shell(spark, own)
    x, y = ring[:, 0], ring[:, 1]
    assert (ring[0] == ring[-1]).all() and abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2 == sum(b - a + 1 for _, a, b in own)
    straight = ((x[:-2] == x[1:-1]) & (x[1:-1] == x[2:])) | ((y[:-2] == y[1:-1]) & (y[1:-1] == y[2:]))
    assert not straight.any()
    rough = shell(spark, own, 2.0)
    assert 4 <= len(rough) < len(ring) and (rough[0] == ring[0]).all()


def test_shell_leaves_out_a_hole_that_touches_it(spark):
    # a hole that meets the outside in one corner only stays a hole
    mask = ["####", "#.##", "##.#"]
    runs = [(y, m.start(), m.end() - 1) for y, line in enumerate(mask) for m in re.finditer("#+", line)]
    ring = shell(spark, runs)
    x, y = ring[:, 0], ring[:, 1]
    assert abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2 == 11
