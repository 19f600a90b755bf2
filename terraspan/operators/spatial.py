"""Spatial joins and map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import text
from . import audit, ordering


# Cells of the grid at level k are CELL * 4^k wide; a box is kept at the first level whose cells are as wide as it is.
CELL = 2.0**-10
LEVELS = 32
# Sides beyond this are held to it, which keeps cell numbers inside a long and leaves overlaps as they are.
FARTHEST = 1e15
# A cell with more rows of a side than this, and more than its share of all rows, is split.
PIECE_ROWS = 50_000
PIECES = 2048


def _side(box: Column, low: str, high: str) -> tuple[Column, Column]:
    hold = lambda v: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), v))
    return hold(F.least(box[low], box[high])), hold(F.greatest(box[low], box[high]))


def _levelled(df: DataFrame, cell: float) -> DataFrame:
    """Rows whose box has four known sides, with the level of the box."""
    box = F.col("bbox")
    known = F.lit(True)
    for side in ("minx", "miny", "maxx", "maxy"):
        known = known & box[side].isNotNull() & ~F.isnan(box[side].cast("double"))
    (x1, x2), (y1, y2) = _side(box, "minx", "maxx"), _side(box, "miny", "maxy")
    width = F.greatest(x2 - x1, y2 - y1) / cell
    level = F.when(width > 1, F.least(F.ceil(F.log2(width) / 2), F.lit(LEVELS - 1))).otherwise(0)
    return df.filter(known).withColumn("_own", level.cast("int"))


def _seen(sides: list[DataFrame]) -> list[tuple[int, list[int]]]:
    """Rows and levels of each side, by one job over the boxes."""
    marked = [side.select(F.lit(i).alias("_of"), "_own") for i, side in enumerate(sides)]
    counts = marked[0].unionByName(marked[1]).groupBy("_of", "_own").count().collect()  # at most LEVELS rows a side
    return [(sum(r["count"] for r in counts if r["_of"] == i), sorted(r["_own"] for r in counts if r["_of"] == i)) for i in range(2)]


def _in_cells(levelled: DataFrame, met: list[int], cell: float) -> DataFrame:
    """One row for each cell of the box at its own level and at the coarser levels of the other side."""
    box = F.col("bbox")
    coarser = F.filter(F.array(*[F.lit(k) for k in met]), lambda k: k > F.col("_own"))
    rows = levelled.withColumn("_k", F.explode(F.concat(F.array("_own"), coarser)))
    size = F.lit(cell) * F.pow(F.lit(4.0), F.col("_k"))
    for name, low, high in (("_cx", "minx", "maxx"), ("_cy", "miny", "maxy")):
        first, last = _side(box, low, high)
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor(first / size), F.floor(last / size))))
    return rows


def _crowded(cells: DataFrame, piece: int, name: str) -> DataFrame:
    """Cells with more than ``piece`` rows and into how many parts they go: at most rows / piece cells."""
    counts = cells.groupBy("_k", "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > piece).select("_k", "_cx", "_cy", F.ceil(F.col("_n") / piece).cast("int").alias(name))


def _hashable(kind: T.DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def box_cells(
    items: DataFrame, areas: DataFrame, cell: float = CELL, split: int = 1, piece: int | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides laid out in the cells of :func:`bbox_join`, and the columns they meet by.

    Each box lies in at most four cells of its own level and in some of each coarser level that the other
    side has, so a box that spans the world is one of few coarse cells and not all of the fine ones. Cells with
    more than ``piece`` rows of a side are split by a hash of the row, which repeats the other side's rows
    of that cell only. Crowded cells are found by counting all rows; there are at most some thousands.
    """
    sides = [_levelled(items, cell), _levelled(areas, cell)]
    seen = _seen(sides)
    cells = [_in_cells(side, seen[1 - i][1], cell) for i, side in enumerate(sides)]
    pieces = [piece or max(PIECE_ROWS, n // PIECES) for n, _ in seen]
    key = ["_k", "_cx", "_cy"]
    parts = ["_item_part", "_area_part"]
    splits = []
    for i, (n, _) in enumerate(seen):
        least = split if i == 0 else 1
        if n > pieces[i]:  # otherwise no cell can hold more
            crowded = F.broadcast(_crowded(cells[i], pieces[i], f"{parts[i]}s"))
            cells = [c.join(crowded, key, "left") for c in cells]
            splits.append(F.greatest(F.coalesce(F.col(f"{parts[i]}s"), F.lit(1)), F.lit(least)))
        else:
            splits.append(F.lit(least))
    out = []
    for i, frame in enumerate((items, areas)):
        row = F.xxhash64(*[F.col(f"`{f.name}`") for f in frame.schema if _hashable(f.dataType)])
        spread = cells[i].withColumn(parts[i], F.pmod(row, splits[i]).cast("int"))
        spread = spread.withColumn(parts[1 - i], F.explode(F.sequence(F.lit(0), splits[1 - i] - 1)))
        own, box = ("_item_own", "item_bbox") if i == 0 else ("_area_own", "area_bbox")
        names = [F.col("bbox").alias(box) if c == "bbox" else F.col(f"`{c}`") for c in frame.columns]
        out.append(spread.select(*names, F.col("_own").alias(own), *key, *parts))
    return out[0], out[1], [*key, *parts]


def bbox_join(items: DataFrame, areas: DataFrame, cell: float = CELL, split: int = 1, piece: int | None = None) -> DataFrame:
    """Pairs of rows whose ``bbox`` structs overlap, as an equi-join on the cells of a hierarchy of grids.

    A pair meets at the coarser of the two levels (see :func:`box_cells`), in every cell both boxes cover there, and is
    kept only in the cell of the lower-left corner of the overlap, so no deduplication is needed.
    ``cell`` is the width of the finest cells, ``split`` the least number of parts of a cell of ``items``. Boxes with a null or
    not-a-number side overlap nothing; repeated rows pair as often as they stand. Levels and row counts are
    looked up when the join is built: keep an expensive input in a table first. Apart from ``bbox``, the
    sides share no column names.
    """
    left, right, keys = box_cells(items, areas, cell, split, piece)
    a, b = F.col("item_bbox"), F.col("area_bbox")
    size = F.lit(cell) * F.pow(F.lit(4.0), F.col("_k"))
    held = lambda v: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), v))
    corner = F.lit(True)
    for name, low in (("_cx", "minx"), ("_cy", "miny")):
        corner = corner & (F.col(name) == F.floor(held(F.greatest(a[low], b[low])) / size))
    meet = F.col("_k") == F.greatest("_item_own", "_area_own")
    return left.join(right, keys).filter(meet & geo.bbox_overlaps(a, b) & corner).drop(*keys, "_item_own", "_area_own")


def intersection_join(
    items: DataFrame, areas: DataFrame, cell: float = CELL, split: int = 1, piece: int | None = None
) -> DataFrame:
    """Pairs whose ring geometries (``rings`` and ``area_rings``) share a point; boxes prune first."""
    pairs = bbox_join(items, areas, cell, split, piece)
    return pairs.filter(geo.rings_intersect(F.col("rings"), F.col("area_rings")))


def spatial_features(
    assets: DataFrame, footprints: DataFrame | None = None, files: DataFrame | None = None
) -> DataFrame:
    """Assets with the best geometry known: valid data, raster grid, item geometry, bounding box.

    ``footprints`` (asset_id, footprint: geometry struct) is the stored exact coverage; it counts only for
    previewable assets. Assets without any geometry are dropped.
    """
    raster = F.col("raster_metadata")
    rows = assets.withColumn("previewable", audit.previewable(F.col("local_path"), raster))
    if files is not None:
        there = files.select(F.col("path").alias("local_path"), F.lit(True).alias("_there"))
        rows = rows.join(there, "local_path", "left").withColumn("previewable", F.col("previewable") & F.coalesce("_there", F.lit(False)))
    corners = geo.grid_corners(raster["transform"], raster["width"], raster["height"])
    if footprints is not None:
        rows = rows.join(footprints, "asset_id", "left")
        valid = F.when(F.col("previewable"), F.col("footprint"))
    else:
        valid = F.lit(None).cast("struct<type: string, coordinates: array<array<array<double>>>>")
    # which geometry is there shows in cheap tests; only the chosen one is built
    has_grid = geo.is_known_epsg(raster["epsg"]) & (F.size(raster["transform"]) == 6) & (raster["width"] >= 1) & (raster["height"] >= 1)
    has_box = (F.size("bbox") == 4) & ~F.exists("bbox", lambda v: v.isNull())
    source = (
        F.when(valid.isNotNull(), "valid_data").when(has_grid, "raster_grid")
        .when(F.col("geometry").isNotNull(), "stac").when(has_box, "bbox")
    )
    rows = rows.withColumns({"geometry_source": source, "_valid": valid}).filter(F.col("geometry_source").isNotNull())
    rows = rows.withColumn("preview_coordinates", geo.corners_to_lonlat(raster["epsg"], corners))
    kind = F.col("geometry_source")
    shape = (
        F.when(kind == "valid_data", F.col("_valid"))
        .when(kind == "raster_grid", geo.rings_geometry(geo.corners_to_rings(F.col("preview_coordinates"))))
        .when(kind == "stac", F.col("geometry")).otherwise(geo.rings_geometry(geo.bbox_rings(F.col("bbox"))))
    )
    key = F.when(F.col("previewable"), text.preview_key(F.col("checksum_sha256"), F.col("byte_size")))
    return rows.select(
        "asset_id", "product_id", F.col("asset_key").alias("variable"), "datetime", "status", "source_item_id", "byte_size",
        "previewable", "preview_coordinates", key.alias("preview_cache_key"), "geometry_source", shape.alias("geometry"),
    )


def filter_features(
    features: DataFrame, product: str | None = None, variable: str | None = None, status: str | None = None,
    query: str | None = None,
) -> DataFrame:
    for column, value in (("product_id", product), ("variable", variable), ("status", status)):
        if value:
            features = features.filter(F.col(column) == value)
    if query:
        shown = [c for c in features.columns if c not in ("geometry", "preview_coordinates")]
        features = features.filter(text.row_contains(query, shown))
    return features


def with_coverage(features: DataFrame) -> DataFrame:
    corners = F.col("preview_coordinates")
    ratio = F.when(
        F.size(corners) == 4,
        geo.coverage_ratio(geo.rings_envelope(F.col("geometry")["coordinates"]), geo.rings_envelope(F.array(corners))),
    )
    return features.withColumn("coverage_ratio", F.coalesce(ratio, F.lit(0.0)))


def granule_representatives(features: DataFrame, order: str = "ordinal") -> DataFrame:
    """Best covered feature of each granule; the earlier one wins ties."""
    keyed = features.withColumns(
        {
            "_product": text.first_truthy(F.col("product_id"), F.lit("unknown")),
            "_granule": text.first_truthy(F.col("source_item_id"), F.col("asset_id")),
        }
    )
    best = ordering.first_per_key(keyed, ["_product", "_granule"], [F.desc("coverage_ratio"), F.col(order)])
    return best.drop("_product", "_granule")


def preferred_feature(features: DataFrame, order: str = "ordinal") -> DataFrame:
    """Red band first, then anything but the mask, then anything; by coverage within each."""
    rank = F.when(F.col("variable") == "B04", 0).when(F.col("variable") != "Fmask", 1).otherwise(2)
    return features.orderBy(rank, F.desc("coverage_ratio"), order).limit(1)


def extent(boxes: DataFrame) -> DataFrame:
    """Envelope of all ``bbox`` structs."""
    box = F.col("bbox")
    return boxes.agg(
        F.min(box["minx"]).alias("minx"), F.min(box["miny"]).alias("miny"),
        F.max(box["maxx"]).alias("maxx"), F.max(box["maxy"]).alias("maxy"),
    )
