"""Pixel statistics, connected components and footprints over pixel rows (asset_id, row, col, value, valid)."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import pixels as px
from ..profiles import MASK_CLASSES, mask_classes
from ..session import materialize
from .stars import contract

SHARES = (0.02, 0.98)
COLUMN_BLOCK = 32
BAND_ROWS = 128
PACK_RUNS = 50_000
MIN_PART_PIXELS = 64
FINE_BINS = 65_536
# Bins under refinement (some 100 bytes each) that are sent to all tasks; more are left to Spark's choice of join.
BROADCAST_BINS = 500_000
# Rings of more corners are simplified in rounds over rows, shorter ones inside a task.
RING_GROUP = 100_000


def tile_pixels(tiles: DataFrame, tile_height: int, tile_width: int) -> DataFrame:
    """Pixel rows from row-major tiles (asset_id, tile_row, tile_col, values, valid)."""
    rows = tiles.select("asset_id", "tile_row", "tile_col", F.posexplode(F.arrays_zip("values", "valid")).alias("_pos", "_px"))
    return rows.select(
        "asset_id", (F.col("tile_row") * tile_height + F.floor(F.col("_pos") / tile_width)).cast("int").alias("row"),
        (F.col("tile_col") * tile_width + F.col("_pos") % tile_width).cast("int").alias("col"),
        F.col("_px")["values"].alias("value"), F.col("_px")["valid"].alias("valid"),
    )


def _usable() -> Column:
    """Valid pixels with a finite value."""
    value = F.col("value").cast("double")
    return F.coalesce(F.col("valid") & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def percentile_bounds(pixels: DataFrame) -> DataFrame:
    """Stretch bounds per asset: 2nd and 98th percentile of the valid pixels, with fallbacks for flat data.

    For 8 and 16-bit values the values are counted, at most 65,536 of an asset. Other types
    may have as many values as pixels; their ranks are narrowed down by histograms, so no
    task holds the values of an asset.
    """
    small = isinstance(pixels.schema["value"].dataType, (T.ByteType, T.ShortType))
    usable = F.when(_usable(), F.col("value"))
    if small:
        stats = _counted_percentiles(pixels.select("asset_id", usable.alias("value")))
    else:
        extremes = [F.min(usable).cast("double").alias("_min"), F.max(usable).cast("double").alias("_max")]
        stats = pixels.groupBy("asset_id").agg(*extremes).join(_ranked_percentiles(pixels.select("asset_id", usable.alias("value"))), "asset_id", "left")
    flat = F.col("_p")[1] <= F.col("_p")[0]
    low = F.when(flat, F.col("_min")).otherwise(F.col("_p")[0])
    high = F.when(flat, F.col("_max")).otherwise(F.col("_p")[1])
    none = F.col("_min").isNull()
    return stats.select(
        "asset_id", F.when(none, 0.0).otherwise(low).alias("low"),
        F.when(none, 1.0).when(high <= low, low + 1.0).otherwise(high).alias("high"),
    )


def _ranks(total: Column) -> list[Column]:
    return [(total - 1) * share for share in SHARES]


def _interpolated() -> Column:
    """Percentiles between the values at the lower and the upper rank (``_v0``, ``_v1`` and so on) of ``_total``.

    Rounded as the SQL counterpart does it, so that a pixel on the edge between two gray levels gets the same one.
    """
    parts = [rank - F.floor(rank) for rank in _ranks(F.col("_total"))]
    ends = [(F.col(f"_v{2 * i}").cast("double"), F.col(f"_v{2 * i + 1}").cast("double")) for i in range(len(SHARES))]
    return F.array(*[F.when(low == high, low).otherwise(px.fused(low, 1 - part, high * part)) for (low, high), part in zip(ends, parts)])


def _counted_percentiles(values: DataFrame) -> DataFrame:
    """Percentiles and extremes of few distinct values by their running counts; null values count for nothing."""
    counts = values.groupBy("asset_id", "value").agg(F.count("value").alias("_n"))
    asset = Window.partitionBy("asset_id")
    upto = asset.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(asset)})
    ranks = [end(rank) for rank in _ranks(F.col("_total")) for end in (F.floor, F.ceil)]
    at = [F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), F.col("value"))).alias(f"_v{i}") for i, rank in enumerate(ranks)]
    extremes = [F.min("value").cast("double").alias("_min"), F.max("value").cast("double").alias("_max")]
    return rows.groupBy("asset_id").agg(F.max("_total").alias("_total"), *at, *extremes).select("asset_id", _interpolated().alias("_p"), "_min", "_max")


def _coarse_bin(value: Column) -> Column:
    """Some fifteen bins for each power of two, in the order of the values: at most 63,000 for all doubles."""
    size = F.floor((F.log2(F.abs(value)) + 1075) * 15) + 1
    return F.when(value == 0, 0).otherwise(F.signum(value) * size).cast("int")


def _fine_bin(value: Column, low: Column, high: Column) -> Column:
    """Equal bins between two values, the lower in the first and the upper in the last."""
    return F.least(F.lit(FINE_BINS - 1), F.floor((value - low) / (high - low) * FINE_BINS)).cast("int")


def _picked(histogram: DataFrame, group: list[str]) -> DataFrame:
    """Bins that hold a wanted rank (``_wanted``: slot and rank inside the group), with ranks inside the bin."""
    bins = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = histogram.withColumn("_before", F.coalesce(F.sum("_n").over(bins), F.lit(0)))
    here = F.filter("_wanted", lambda t: (t["at"] >= F.col("_before")) & (t["at"] < F.col("_before") + F.col("_n")))
    inside = F.transform(here, lambda t: F.struct(t["slot"].alias("slot"), (t["at"] - F.col("_before")).alias("at")))
    return rows.withColumn("_wanted", inside).filter(F.size("_wanted") > 0).select("asset_id", "_n", "_low", "_high", "_wanted")


def _ranked_percentiles(values: DataFrame) -> DataFrame:
    """Linearly interpolated percentiles by radix selection over histograms.

    The first histogram counts coarse bins of each asset; only values in a bin that holds a wanted rank are counted
    again, in fine bins between that bin's least and greatest value. A rank is settled once it is the first or the last
    of its bin or the bin has one value, which takes one fine round for most data and four for any doubles. Histograms add up inside the tasks,
    so what is shuffled is bins, and the values are neither sorted nor copied; they are read once a round.
    """
    values = values.select("asset_id", F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull())
    counted = [F.count(F.lit(1)).alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")]
    coarse = values.groupBy("asset_id", _coarse_bin(F.col("value")).alias("_bin")).agg(*counted)
    total = F.sum("_n").over(Window.partitionBy("asset_id"))
    ranks = _ranks(F.col("_total"))
    wanted = [F.struct(F.lit(2 * i + up).alias("slot"), end(rank).cast("bigint").alias("at")) for i, rank in enumerate(ranks) for up, end in enumerate((F.floor, F.ceil))]
    coarse = coarse.withColumn("_total", total).withColumn("_wanted", F.array(*wanted))
    totals = materialize(coarse.select("asset_id", "_total", "_bin", "_n", "_low", "_high", "_wanted"))
    bins, settled = materialize(_picked(totals, ["asset_id"])), []
    is_end = lambda t: (t["at"] == 0) | (t["at"] == F.col("_n") - 1) | (F.col("_low") == F.col("_high"))
    while True:
        ends = bins.select("asset_id", "_low", "_high", F.explode(F.filter("_wanted", is_end)).alias("_t"))
        settled.append(ends.select("asset_id", F.col("_t.slot").alias("_slot"), F.when(F.col("_t.at") == 0, F.col("_low")).otherwise(F.col("_high")).alias("_value")))
        unsettled = bins.withColumn("_wanted", F.filter("_wanted", lambda t: ~is_end(t))).filter(F.size("_wanted") > 0)
        open_bins = unsettled.count()
        if not open_bins:
            break
        ranges = unsettled.select(F.col("asset_id").alias("_asset"), F.col("_low").alias("_from"), F.col("_high").alias("_to"), "_wanted")
        if open_bins <= BROADCAST_BINS:
            ranges = F.broadcast(ranges)
        again = values.join(ranges, (F.col("asset_id") == F.col("_asset")) & F.col("value").between(F.col("_from"), F.col("_to")))
        fine = again.groupBy("asset_id", "_from", _fine_bin(F.col("value"), F.col("_from"), F.col("_to")).alias("_bin"))
        bins = materialize(_picked(fine.agg(*counted, F.first("_wanted").alias("_wanted")), ["asset_id", "_from"]))
    found = functools.reduce(DataFrame.unionByName, settled).groupBy("asset_id").agg(
        *[F.max(F.when(F.col("_slot") == slot, F.col("_value"))).alias(f"_v{slot}") for slot in range(2 * len(SHARES))]
    ).join(totals.select("asset_id", "_total").distinct(), "asset_id")
    return found.select("asset_id", _interpolated().alias("_p"))


def valid_stats(pixels: DataFrame, pixel_area: Column | float = 1.0) -> DataFrame:
    area = F.lit(pixel_area) if isinstance(pixel_area, (int, float)) else F.max(pixel_area)
    return pixels.groupBy("asset_id").agg(
        F.count_if("valid").alias("valid_pixels"), F.bool_or("valid").alias("any_valid"), area.alias("_area")
    ).select("asset_id", "valid_pixels", "any_valid", (F.col("valid_pixels") * F.col("_area")).alias("coverage_area"))


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """Horizontal runs of valid pixels (asset_id, row, first_col, last_col). A window spans one raster row."""
    line = Window.partitionBy("asset_id", "row").orderBy("col")
    valid = pixels.filter("valid").select("asset_id", "row", "col")
    island = valid.withColumn("_island", F.col("col") - F.row_number().over(line))
    return island.groupBy("asset_id", "row", "_island").agg(
        F.min("col").alias("first_col"), F.max("col").alias("last_col")
    ).drop("_island")


def _node(row: Column, col: Column) -> Column:
    return F.shiftleft(row.cast("bigint"), 32) + col


def run_edges(runs: DataFrame) -> DataFrame:
    """Pairs of runs that touch in consecutive rows, as (asset_id, u, v) with u > v.

    Runs meet by blocks of columns, so a row pair compares at most the few runs of
    one block; a pair is kept in the block where its overlap starts.
    """
    blocks = F.sequence(F.floor(F.col("first_col") / COLUMN_BLOCK), F.floor(F.col("last_col") / COLUMN_BLOCK))
    cut = runs.withColumn("_block", F.explode(blocks))
    below = cut.select(
        "asset_id", "_block", (F.col("row") - 1).alias("row"), F.col("first_col").alias("f2"), F.col("last_col").alias("l2")
    )
    touch = (F.col("first_col") <= F.col("l2")) & (F.col("f2") <= F.col("last_col"))
    here = F.floor(F.greatest("first_col", "f2") / COLUMN_BLOCK) == F.col("_block")
    return cut.join(below, ["asset_id", "row", "_block"]).filter(touch & here).select(
        "asset_id", _node(F.col("row") + 1, F.col("f2")).alias("u"), _node(F.col("row"), F.col("first_col")).alias("v")
    )


def _touching(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of runs that touch in consecutive rows; runs are sorted by row and column."""
    width = int(last.max()) + 2
    starts, ends = row * width + first, row * width + last
    low = np.searchsorted(ends, (row + 1) * width + first, "left")
    high = np.searchsorted(starts, (row + 1) * width + last, "right")
    count = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(row)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return upper, np.repeat(low, count) + within


def _smallest_reachable(size: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each index: hook roots together, then shorten all paths."""
    label = np.arange(size)
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter


def _label_pack(runs: pd.DataFrame) -> pd.DataFrame:
    """Components of the runs of a pack of bands, each named by its first run."""
    asset = pd.factorize(runs["asset_id"])[0]
    runs = runs.assign(_line=asset * (int(runs["row"].max()) + 2) + runs["row"].to_numpy(np.int64))
    runs = runs.sort_values(["_line", "first_col"], ignore_index=True)
    row, line, first, last = (runs[c].to_numpy(np.int64) for c in ("row", "_line", "first_col", "last_col"))
    label = _smallest_reachable(len(runs), *_touching(line, first, last))
    runs["component"] = ((row << 32) + first)[label]
    return runs[["asset_id", "row", "first_col", "last_col", "component"]]


def connected_components(runs: DataFrame, band: int = BAND_ROWS) -> DataFrame:
    """4-connected components of the valid pixels: each run with the smallest node of its component.

    Bands of rows are labelled on their own, in packs of bounded size. Only runs
    on the border of two bands tie their labels together; that small graph is
    solved by alternating star contractions, in a number of rounds that grows with
    its logarithm. Each round is written once, so the plan stays short and a lost
    executor costs one round.
    """
    kind = runs.schema["asset_id"].dataType.simpleString()
    schema = f"asset_id {kind}, row INT, first_col INT, last_col INT, component BIGINT"
    runs = materialize(runs.select("asset_id", "row", "first_col", "last_col"))
    # small rasters share a task: bands are packed by hash to about PACK_RUNS runs, whole bands only
    packs = max(1, -(-runs.count() // PACK_RUNS))
    pack = F.pmod(F.xxhash64("asset_id", F.floor(F.col("row") / band)), F.lit(packs))
    local = materialize(runs.withColumn("_pack", pack).groupBy("_pack").applyInPandas(_label_pack, schema))

    top, bottom = F.col("row") % band == 0, F.col("row") % band == band - 1
    lower = local.select("asset_id", _node(F.col("row"), F.col("first_col")).alias("u"), F.col("component").alias("_lower"))
    upper = local.select("asset_id", _node(F.col("row"), F.col("first_col")).alias("v"), F.col("component").alias("_upper"))
    ties = run_edges(local.filter(top | bottom).select("asset_id", "row", "first_col", "last_col")).filter(
        F.shiftright("u", 32) % band == 0
    )
    ties = ties.join(lower, ["asset_id", "u"]).join(upper, ["asset_id", "v"])
    edges = contract(
        ties.select("asset_id", F.greatest("_lower", "_upper").alias("u"), F.least("_lower", "_upper").alias("v")).filter("u <> v"), ["asset_id"]
    )
    roots = edges.select("asset_id", F.col("u").alias("component"), F.col("v").alias("_root"))
    return local.join(roots, ["asset_id", "component"], "left").select(
        "asset_id", "row", "first_col", "last_col", F.coalesce("_root", "component").alias("component")
    )


def component_areas(components: DataFrame, px_x: float = 1.0, px_y: float = 1.0) -> DataFrame:
    """Components worth keeping: the largest of each asset and all of at least 64 square pixels."""
    areas = components.groupBy("asset_id", "component").agg(
        F.sum(F.col("last_col") - F.col("first_col") + 1).alias("pixel_count")
    )
    # the largest part is found by aggregation, which combines map-side even when one asset has most parts
    largest = areas.groupBy("asset_id").agg(
        F.max(F.struct("pixel_count", (-F.col("component")).alias("_c"))).alias("_best")
    ).select("asset_id", (-F.col("_best")["_c"]).alias("_largest"))
    area = F.col("pixel_count") * abs(px_x * px_y)
    enough = area >= MIN_PART_PIXELS * max(abs(px_x), abs(px_y)) ** 2
    return areas.join(largest, "asset_id").filter((F.col("component") == F.col("_largest")) | enough).select(
        "asset_id", "component", "pixel_count", area.alias("area"), (F.col("component") == F.col("_largest")).alias("is_largest")
    )


def _corner(y: Column, x: Column, turn: Column | int = 0) -> Column:
    """Number of a corner: by row, then column, then which of the two that meet where pixels touch in a point only."""
    return F.shiftleft(y.cast("bigint"), 33) + F.shiftleft(x.cast("bigint"), 1) + turn


def boundary_corners(components: DataFrame) -> DataFrame:
    """Corners of the boundaries of all components as (asset_id, component, node, succ), the component on the right.

    Each run adds its two ends to the grid line above it and the one below it; where the ends
    of both sides meet, the boundary goes straight on. What is left are corners. Their
    walls end at the next corner in the same column, their edges at the next one in the same
    line, so a task holds one raster line or column of a component at a time. Where two pixels
    meet in a corner only, the boundary goes on along the outside.
    """
    line = ["asset_id", "component", "y"]
    row, left, right = F.col("row").cast("bigint"), F.col("first_col").cast("bigint"), F.col("last_col").cast("bigint") + 1
    ends = components.select("asset_id", "component", F.explode(F.array(*[
        F.struct(y.alias("y"), x.alias("x"), F.lit(above).alias("above"), F.lit(below).alias("below"))
        for y, x, above, below in ((row, left, 0, 1), (row, right, 0, -1), (row + 1, left, 1, 0), (row + 1, right, -1, 0))
    ])).alias("_e")).select("asset_id", "component", "_e.*")
    # +1 where the component starts to the right of the point, -1 where it ends, above and below the line
    points = ends.repartition(*line).groupBy(*line, "x").agg(F.sum("above").alias("above"), F.sum("below").alias("below")).filter("above <> below")
    points = points.withColumn("_pinch", (F.col("above") * F.col("below") == -1).cast("int"))
    along = Window.partitionBy(*line).orderBy("x")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    lined = points.select(
        "*", F.lead("x").over(along).alias("_right"), F.lag("x").over(along).alias("_left"), F.lag("_pinch").over(along).alias("_left_pinch"),
        F.sum(F.col("below") - F.col("above")).over(upto).alias("_side"),  # to the right of the point: 1 inside below only, -1 above only
    )
    down = Window.partitionBy("asset_id", "component", "x").orderBy("y")
    walled = lined.select("*", F.lead("y").over(down).alias("_down"), F.lag("y").over(down).alias("_up"), F.lag("_pinch").over(down).alias("_up_pinch"))
    # the corner reached in each direction; only on the way left and up can it be the second one of a pair
    east, west = _corner(F.col("y"), F.col("_right")), _corner(F.col("y"), F.col("_left"), F.col("_left_pinch"))
    south, north = _corner(F.col("_down"), F.col("x")), _corner(F.col("_up"), F.col("x"), F.col("_up_pinch"))
    before = F.col("_side") - F.col("below") + F.col("above")
    only = F.when(F.col("_side") == 1, east).when(before == -1, west).when(F.col("above") == 1, north).otherwise(south)
    ways = F.when((F.col("above") == -1) & (F.col("below") == 1), F.array(east, west)).when(
        (F.col("above") == 1) & (F.col("below") == -1), F.array(north, south)
    ).otherwise(F.array(only))
    return walled.select("asset_id", "component", "y", "x", F.posexplode(ways).alias("_turn", "succ")).select(
        "asset_id", "component", _corner(F.col("y"), F.col("x"), F.col("_turn")).alias("node"), "succ"
    )


def _halved(step: np.ndarray, *folded: tuple[np.ndarray, np.ufunc]) -> list[np.ndarray]:
    """Pointer doubling: ``step`` after so many jumps that every chain has ended, each array folded along the way."""
    values = [v.copy() for v, _ in folded]
    for _ in range(max(1, len(step)).bit_length()):
        values = [fold(v, v[step]) for v, (_, fold) in zip(values, folded)]
        step = step[step]
    return [step, *values]


def _chain_pack(corners: pd.DataFrame, band: int) -> pd.DataFrame:
    """Chains of the corners of whole bands: for each corner its chain's first corner, its place in it and, at its end, where it goes on."""
    corners = corners.assign(_part=corners.groupby(["asset_id", "component"], sort=False, dropna=False).ngroup())
    corners = corners.sort_values(["_part", "node"], ignore_index=True)
    node, succ = corners["node"].to_numpy(np.int64), corners["succ"].to_numpy(np.int64)
    part = corners["_part"].to_numpy(np.int64)
    inside = pd.MultiIndex.from_arrays([part, node]).get_indexer(pd.MultiIndex.from_arrays([part, succ]))
    inside = np.where((node >> 33) // band == (succ >> 33) // band, inside, -1)
    at = np.arange(len(node))
    # a ring that never leaves the band starts at its smallest corner
    end, low = _halved(np.where(inside < 0, at, inside), (at, np.minimum))
    closed = inside[end] >= 0
    back = at.copy()
    follows = np.flatnonzero(inside >= 0)
    back[inside[follows]] = follows
    back = np.where(closed & (low == at), at, back)
    head, place = _halved(back, ((back != at).astype(np.int64), np.add))
    corners["chain"], corners["place"] = node[head], place
    corners["onward"] = pd.array(np.where(inside < 0, succ, 0), dtype="Int64")
    corners.loc[inside >= 0, "onward"] = pd.NA
    return corners[["asset_id", "component", "node", "chain", "place", "onward"]]


def outline_corners(corners: DataFrame, band: int = BAND_ROWS) -> DataFrame:
    """Corners of the outer ring of each component (asset_id, component, ordinal, x, y), clockwise from its first pixel.

    List ranking: the chains inside bands of rows are found in the tasks, in packs of bounded
    size. Chains that go on in another band are ranked by pointer doubling: each round joins
    every chain with the one it points to, so rings of any length take a number of rounds
    that grows with the logarithm of their chains. No task holds a ring, and rings around
    holes are left out before their corners are numbered.
    """
    kind = corners.schema["asset_id"].dataType.simpleString()
    keys = ["asset_id", "component"]
    corners = materialize(corners)
    packs = max(1, -(-corners.count() // PACK_RUNS))
    pack = F.pmod(F.xxhash64(*keys, F.floor(F.shiftright("node", 33) / band)), F.lit(packs))
    schema = f"asset_id {kind}, component BIGINT, node BIGINT, chain BIGINT, place BIGINT, onward BIGINT"
    chained = materialize(corners.withColumn("_pack", pack).groupBy("_pack").applyInPandas(lambda g: _chain_pack(g.drop(columns="_pack"), band), schema))
    chains = chained.groupBy(*keys, "chain").agg(F.count(F.lit(1)).alias("length"), F.min("node").alias("low"), F.max("onward").alias("onward"))
    # the component's first pixel is at the smallest corner of its outer ring
    start = F.shiftleft(F.shiftright("component", 32), 33) + F.shiftleft(F.col("component").bitwiseAND(F.lit((1 << 32) - 1)), 1)
    ranked = _ranked_chains(materialize(chains), start)
    first = chained.filter(F.col("node") == start).select(*keys, F.col("place").alias("_offset"))
    placed = chained.join(ranked, [*keys, "chain"]).join(first, keys)
    node = F.col("node")
    return placed.select(
        *keys, F.pmod(F.col("before") + F.col("place") - F.col("_offset"), F.col("total")).alias("ordinal"),
        F.shiftright(node.bitwiseAND(F.lit((1 << 33) - 1)), 1).alias("x"), F.shiftright(node, 33).alias("y"),
    )


def _ranked_chains(chains: DataFrame, start: Column) -> DataFrame:
    """(asset_id, component, chain, before, total): corners of the outer ring before a chain and in all."""
    keys = ["asset_id", "component"]
    whole = chains.filter("onward IS NULL").filter(F.col("low") == start).select(*keys, "chain", F.lit(0).cast("long").alias("before"), F.col("length").alias("total"))
    open_ = chains.filter("onward IS NOT NULL")
    if open_.isEmpty():
        return whole
    # smallest corner of each ring
    state = open_.select(*keys, "chain", "low", F.col("onward").alias("jump"))
    while True:
        ahead = state.select(*keys, F.col("chain").alias("jump"), F.col("low").alias("_low"), F.col("jump").alias("_jump"))
        state = materialize(state.join(ahead, [*keys, "jump"]).select(
            *keys, "chain", F.least("low", "_low").alias("low"), F.col("_jump").alias("jump"), (F.col("_low") < F.col("low")).alias("_lower")
        ))
        if state.filter("_lower").isEmpty():
            break
        state = state.drop("_lower")
    outer = open_.join(state.filter(F.col("low") == start).select(*keys, "chain"), [*keys, "chain"], "left_semi")
    # corners from each chain to the end of the ring, which is cut before the chain with that corner
    ends = F.col("low") == start
    firsts = outer.filter(ends).select(*keys, F.col("chain").alias("_head"))
    state = outer.join(firsts, keys).select(
        *keys, "chain", "_head", F.col("length").alias("rest"), F.when(F.col("onward") != F.col("_head"), F.col("onward")).alias("jump")
    )
    while True:
        ahead = state.select(*keys, F.col("chain").alias("jump"), F.col("rest").alias("_rest"), F.col("jump").alias("_jump"))
        state = materialize(state.join(ahead, [*keys, "jump"], "left").select(
            *keys, "chain", "_head", (F.col("rest") + F.coalesce("_rest", F.lit(0))).alias("rest"), F.col("_jump").alias("jump")
        ))
        if state.filter("jump IS NOT NULL").isEmpty():
            break
    totals = state.filter("chain = _head").select(*keys, F.col("rest").alias("total"))
    return whole.unionByName(state.join(totals, keys).select(*keys, "chain", (F.col("total") - F.col("rest")).alias("before"), "total"))


def simplified_corners(corners: DataFrame, tolerance: float, group: int = RING_GROUP) -> DataFrame:
    """Corners of :func:`outline_corners` without those within ``tolerance`` of the line between kept ones.

    The first corner and the one farthest from it stay; of the corners between two kept ones
    the farthest from their line stays if it is beyond the tolerance, and so on. Rings that
    would keep fewer than three corners stay whole. Rings of up to ``group`` corners are worked
    on in packs; in longer ones a round decides one corner of every piece, all pieces at once.
    """
    kind = corners.schema["asset_id"].dataType.simpleString()
    keys = ["asset_id", "component"]
    corners = materialize(corners)
    sizes = corners.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = corners.join(sizes, keys)
    packs = max(1, -(-corners.count() // PACK_RUNS))
    schema = f"asset_id {kind}, component BIGINT, ordinal BIGINT, x BIGINT, y BIGINT"

    def simplify(pack: pd.DataFrame) -> pd.DataFrame:
        pack = pack.sort_values([*keys, "ordinal"], ignore_index=True)
        kept = []
        for rows in pack.groupby(keys, sort=False, dropna=False).indices.values():
            ring = pack.loc[rows, ["x", "y"]].to_numpy(np.int64)
            kept.append(rows[_kept_corners(np.vstack([ring, ring[:1]]), tolerance)])
        return pack.loc[np.concatenate(kept), [*keys, "ordinal", "x", "y"]]

    pack = F.pmod(F.xxhash64(*keys), F.lit(packs))
    short = sized.filter(F.col("_n") <= group).drop("_n").withColumn("_pack", pack).groupBy("_pack").applyInPandas(simplify, schema)
    long_rings = sized.filter(F.col("_n") > group)
    return short if long_rings.isEmpty() else short.unionByName(_simplified_rounds(materialize(long_rings), tolerance))


def _simplified_rounds(corners: DataFrame, tolerance: float) -> DataFrame:
    """Simplification of long rings (asset_id, component, ordinal, x, y, _n), one corner of every piece a round."""
    keys = ["asset_id", "component"]
    piece = [*keys, "_a", "_b"]
    order, far = F.col("ordinal"), F.hypot(F.col("x") - F.col("_x0"), F.col("y") - F.col("_y0"))
    first = corners.filter("ordinal = 0").select(*keys, F.col("x").alias("_x0"), F.col("y").alias("_y0"))
    at = F.struct("ordinal", "x", "y")
    farthest = corners.join(first, keys).groupBy(*keys, "_n", "_x0", "_y0").agg(F.max_by(at, F.struct(far, -order)).alias("_k"))
    ends = farthest.select(*keys, F.struct(F.lit(0).cast("long").alias("ordinal"), F.col("_x0").alias("x"), F.col("_y0").alias("y")).alias("_p"), "_k",
                           F.struct(F.col("_n").alias("ordinal"), F.col("_x0").alias("x"), F.col("_y0").alias("y")).alias("_q"))
    kept = [ends.select(*keys, "_p.*"), ends.select(*keys, "_k.*")]
    columns = [*keys, "ordinal", "x", "y"]
    early = order < F.col("_k.ordinal")

    def cut(rows: DataFrame, ends: DataFrame, on: list[str]) -> DataFrame:
        """Corners between new ends, with the piece they are in."""
        return rows.join(ends, on).filter(order != F.col("_k.ordinal")).select(
            *columns, F.when(early, F.col("_p")).otherwise(F.col("_k")).alias("_a"), F.when(early, F.col("_k")).otherwise(F.col("_q")).alias("_b")
        )

    rows = materialize(cut(corners.filter("ordinal > 0").select(*columns), ends, keys))
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    px, py = F.col("x") - F.col("_a.x"), F.col("y") - F.col("_a.y")
    length = F.hypot(dx, dy)
    away = F.when(length > 0, F.abs(px * dy - py * dx) / length).otherwise(F.hypot(px, py))
    while not rows.isEmpty():
        best = rows.groupBy(*piece).agg(F.max_by(F.struct(at.alias("at"), away.alias("away")), F.struct(away, -order)).alias("_best"))
        splits = materialize(best.filter(F.col("_best.away") > tolerance).select(*piece, F.col("_best.at").alias("_k")))
        kept.append(splits.select(*keys, "_k.*"))
        rows = materialize(cut(rows, splits.select(*piece, F.col("_a").alias("_p"), "_k", F.col("_b").alias("_q")), piece))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    thin = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n < 3").select(*keys)
    return out.join(thin, keys, "left_anti").unionByName(corners.select(*columns).join(thin, keys, "left_semi"))


def component_outlines(components: DataFrame, kept: DataFrame, tolerance: float = 0.0, band: int = BAND_ROWS) -> DataFrame:
    """Outer ring of each kept component in pixel corners, holes dropped, clockwise from its first pixel.

    The ring follows the sides that the component shares with no pixel of its own, so
    parts that are concave in any direction come out exactly. Above a ``tolerance`` in
    pixels, corners closer than that to the line between their neighbours are left out.
    The corners of a ring meet in one row only here, where they become its value.
    """
    runs = components.join(kept.select("asset_id", "component"), ["asset_id", "component"], "left_semi")
    corners = outline_corners(boundary_corners(runs), band)
    corners = simplified_corners(corners, tolerance) if tolerance > 0 else corners
    rings = corners.groupBy("asset_id", "component").agg(F.sort_array(F.collect_list(F.struct("ordinal", "x", "y"))).alias("_ring"))
    ring = F.transform("_ring", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    return rings.select("asset_id", "component", F.concat(ring, F.slice(ring, 1, 1)).alias("ring"))


def _kept_corners(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the corners of a closed ring that are beyond ``tolerance`` of the line between kept ones; at least three."""
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    keep = {0, far}
    stack = [(0, far), (far, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q = ring[a].astype(float), ring[b].astype(float)
        inner, along = ring[a + 1 : b] - p, q - p
        length = float(np.hypot(*along))
        away = np.abs(inner[:, 0] * along[1] - inner[:, 1] * along[0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(keep)) if len(keep) >= 3 else np.arange(len(ring) - 1)


def footprint_parts(outlines: DataFrame, grids: DataFrame) -> DataFrame:
    """Outlines in longitude and latitude, 8 decimals. ``grids``: asset_id, transform, epsg."""
    t, epsg = F.col("transform"), F.col("epsg")

    def place(p: Column) -> Column:
        x = t[0] * p[0] + t[1] * p[1] + t[2]
        y = t[3] * p[0] + t[4] * p[1] + t[5]
        return F.transform(geo.utm_to_lonlat(epsg, x, y), lambda v: F.round(v, 8))

    return outlines.join(grids, "asset_id").select(
        "asset_id", "component", F.transform("ring", place).alias("ring")
    )


def footprints(parts: DataFrame) -> DataFrame:
    """One geometry per asset from its parts; the number of parts is bounded by the raster's own size."""
    rings = parts.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("component", "ring"))).alias("_parts"))
    return rings.select("asset_id", geo.rings_geometry(F.transform("_parts", lambda p: p["ring"])).alias("footprint"))


def classify_mask(pixels: DataFrame) -> DataFrame:
    """Pixel class and colour of a quality mask."""
    table = mask_classes(pixels.sparkSession).select("pixel_class", "red", "green", "blue", "alpha")
    classed = pixels.withColumn("pixel_class", px.mask_class(F.when(_usable(), F.col("value")).cast("int"), _usable()))
    out = classed.join(F.broadcast(table), "pixel_class", "left")
    clear = next(row for row in MASK_CLASSES if row[0] == "clear")
    for name, value in zip(("red", "green", "blue"), clear[2:5]):
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out.withColumn("alpha", F.coalesce("alpha", F.lit(0)))


def stretch_pixels(pixels: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Gray level and opacity of each pixel between the stretch bounds of its asset."""
    bounds = percentile_bounds(pixels) if bounds is None else bounds
    value = F.when(_usable(), F.col("value").cast("double"))
    return pixels.join(bounds, "asset_id").select(
        "asset_id", "row", "col", px.stretch(value, F.col("low"), F.col("high")).alias("intensity"),
        F.when(_usable(), 235).otherwise(0).alias("alpha"),
    )


def downsample_mean(pixels: DataFrame, width: int, height: int, max_size: int) -> DataFrame:
    """Block mean of the valid pixels on the reduced grid."""
    scale = min(1.0, max_size / max(width, height))
    out_w, out_h = max(1, round(width * scale)), max(1, round(height * scale))
    r, c = F.floor(F.col("row") * F.lit(out_h) / F.lit(height)), F.floor(F.col("col") * F.lit(out_w) / F.lit(width))
    return pixels.filter("valid").groupBy("asset_id", r.cast("int").alias("row"), c.cast("int").alias("col")).agg(
        F.avg("value").alias("value")
    )


def downsample_nearest(pixels: DataFrame, width: int, height: int, max_size: int) -> DataFrame:
    """Keep the source pixel at the centre of each reduced pixel; a filter, nothing is shuffled."""
    scale = min(1.0, max_size / max(width, height))
    out_w, out_h = max(1, round(width * scale)), max(1, round(height * scale))

    # counted from the reduced side: pixel t takes the source pixel floor((t + 1/2) full / out), so each is met once
    def target(at: Column, out: int, full: int) -> Column:
        return F.ceil((at * (2 * out) - full) / F.lit(2 * full)).cast("int")

    def centre(at: Column, out: int, full: int) -> Column:
        t = target(at, out, full)
        return t.between(0, out - 1) & (F.floor((t * 2 + 1) * F.lit(full) / F.lit(2 * out)) == at)

    row, col = F.col("row"), F.col("col")
    return pixels.filter(centre(row, out_h, height) & centre(col, out_w, width)).select(
        "asset_id", target(row, out_h, height).alias("row"), target(col, out_w, width).alias("col"), "value", "valid"
    )
