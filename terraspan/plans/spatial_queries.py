"""Queries over geometries, map features and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import pixels as px
from ..operators import raster, spatial
from ..profiles import MASK_CLASSES, quality_bits
from .base import query
from .views import Views

KRUEGER = """
    t0 AS (SELECT asset_id, easting, northing, epsg % 100 AS zone, 6378137.0::DOUBLE AS a, (1 / 298.257223563) / (2 - 1 / 298.257223563) AS n FROM v_geo),
    t1 AS (SELECT *, northing / (0.9996 * a / (1 + n) * (1 + n*n/4 + n*n*n*n/64)) AS xi, (easting - 500000) / (0.9996 * a / (1 + n) * (1 + n*n/4 + n*n*n*n/64)) AS eta FROM t0),
    t2 AS (SELECT *, xi - (n/2 - 2*n*n/3 + 37*n*n*n/96) * sin(2*xi) * cosh(2*eta) - (n*n/48 + n*n*n/15) * sin(4*xi) * cosh(4*eta) - (17*n*n*n/480) * sin(6*xi) * cosh(6*eta) AS xp,
                  eta - (n/2 - 2*n*n/3 + 37*n*n*n/96) * cos(2*xi) * sinh(2*eta) - (n*n/48 + n*n*n/15) * cos(4*xi) * sinh(4*eta) - (17*n*n*n/480) * cos(6*xi) * sinh(6*eta) AS ep FROM t1),
    t3 AS (SELECT *, asin(sin(xp) / cosh(ep)) AS chi FROM t2),
    v_lonlat AS (SELECT asset_id, degrees(atan2(sinh(ep), cos(xp))) + zone * 6 - 183 AS lon,
        degrees(chi + (2*n - 2*n*n/3 - 2*n*n*n) * sin(2*chi) + (7*n*n/3 - 8*n*n*n/5) * sin(4*chi) + (56*n*n*n/15) * sin(6*chi)) AS lat FROM t3)"""


def _wkt(west: str = "west", south: str = "south", east: str = "east", north: str = "north"):
    w, s, e, n = (F.col(c).cast("string") for c in (west, south, east, north))
    pair = lambda x, y: F.concat_ws(" ", x, y)
    ring = F.concat_ws(", ", pair(w, s), pair(e, s), pair(e, n), pair(w, n), pair(w, s))
    return F.concat(F.lit("POLYGON (("), ring, F.lit("))"))


@query("p09_bbox_overlap_filter", """
    SELECT asset_id FROM v_geo WHERE west <= 30 AND east >= -20 AND south <= 45 AND north >= -15""", "v_geo")
def p09(v: Views):
    area = geo.bbox_struct(*[F.lit(float(n)) for n in (-20, -15, 30, 45)])
    return v.geo().filter(geo.bbox_overlaps(F.col("bbox"), area)).select("asset_id")


@query("j11_aoi_bbox_join", """
    SELECT asset_id, area_id FROM v_geo g JOIN v_areas a ON g.west <= a.east AND g.east >= a.west AND g.south <= a.north AND g.north >= a.south""", "v_geo", "v_areas")
def j11(v: Views):
    pairs = spatial.bbox_join(v.geo().select("asset_id", "bbox"), v.areas().select("area_id", "bbox"))
    return pairs.select("asset_id", "area_id")


@query("j12_aoi_intersects_join", """
    WITH tri AS (SELECT asset_id, [west, east, west] AS xs, [south, south, north] AS ys, west, south, east, north FROM v_geo),
    dia AS (SELECT area_id, [west + 10, west + 20, west + 10, west] AS xs, [south, south + 10, south + 20, south + 10] AS ys, west, south, east, north FROM v_areas),
    cand AS (SELECT asset_id, area_id, t.xs AS tx, t.ys AS ty, d.xs AS dx, d.ys AS dy FROM tri t JOIN dia d
             ON t.west <= d.east AND t.east >= d.west AND t.south <= d.north AND t.north >= d.south),
    te AS (SELECT asset_id, area_id, i, tx[i] AS ax, ty[i] AS ay, tx[i % 3 + 1] AS bx, ty[i % 3 + 1] AS by_ FROM cand, (VALUES (1), (2), (3)) v(i)),
    de AS (SELECT asset_id, area_id, j, dx[j] AS cx, dy[j] AS cy, dx[j % 4 + 1] AS ex, dy[j % 4 + 1] AS ey FROM cand, (VALUES (1), (2), (3), (4)) v(j)),
    crossing AS (SELECT DISTINCT te.asset_id, te.area_id FROM te JOIN de USING (asset_id, area_id)
      WHERE least(ax, bx) <= greatest(cx, ex) AND greatest(ax, bx) >= least(cx, ex) AND least(ay, by_) <= greatest(cy, ey) AND greatest(ay, by_) >= least(cy, ey)
        AND sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * sign((bx - ax) * (ey - ay) - (by_ - ay) * (ex - ax)) <= 0
        AND sign((ex - cx) * (ay - cy) - (ey - cy) * (ax - cx)) * sign((ex - cx) * (by_ - cy) - (ey - cy) * (bx - cx)) <= 0),
    inside AS (SELECT asset_id, area_id FROM cand
      WHERE abs(tx[1] - dx[1]) + abs(ty[1] - dy[2]) < 10)
    SELECT asset_id, area_id FROM crossing UNION SELECT asset_id, area_id FROM inside""", "v_geo", "v_areas")
def j12(v: Views):
    """Right triangles against diamonds: boxes overlap more often than the shapes do."""
    w, s, e, n = (F.col(c).cast("string") for c in ("west", "south", "east", "north"))
    pair = lambda x, y: F.concat_ws(" ", x, y)
    triangle = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", pair(w, s), pair(e, s), pair(w, n), pair(w, s)), F.lit("))"))
    items = v.geo().select("asset_id", "bbox", geo.wkt_rings(triangle).alias("rings"))
    mx, my = ((F.col(c) + 10).cast("string") for c in ("west", "south"))
    diamond = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", pair(mx, s), pair(e, my), pair(mx, n), pair(w, my), pair(mx, s)), F.lit("))"))
    areas = v.areas().select("area_id", "bbox", geo.wkt_rings(diamond).alias("area_rings"))
    return spatial.intersection_join(items, areas).select("asset_id", "area_id")


@query("f05_cmr_polygon_parse", """
    SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type,
           CASE c_custkey % 3 WHEN 1 THEN 10 ELSE 5 END AS points, west AS first_x, south AS first_y, east AS max_x, north AS max_y FROM v_geo""", "v_geo")
def f05(v: Views):
    w, s, e, n = (F.col(c).cast("string") for c in ("west", "south", "east", "north"))
    one, box = F.concat_ws(" ", s, w, s, e, n, e, n, w), F.concat_ws(" ", s, w, n, e)
    kind = F.col("c_custkey") % 3
    none = F.array().cast("array<array<string>>")
    polygons = F.when(kind == 0, F.array(F.array(one))).when(kind == 1, F.array(F.array(one), F.array(one))).otherwise(none)
    rows = v.geo().select("c_custkey", geo.cmr_rings(polygons, F.array(box)).alias("rings"))
    env = geo.rings_envelope(F.col("rings"))
    return rows.select(
        "c_custkey", geo.rings_geometry(F.col("rings"))["type"].alias("geometry_type"), F.size(F.flatten("rings")).alias("points"),
        F.col("rings")[0][0][0].alias("first_x"), F.col("rings")[0][0][1].alias("first_y"), env[2].alias("max_x"), env[3].alias("max_y"),
    )


@query("f05_malformed", """
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'Polygon' END AS geometry_type,
           CASE c_custkey % 4 WHEN 0 THEN west WHEN 1 THEN west - 1 WHEN 2 THEN west - 1 END AS min_x FROM v_geo""", "v_geo")
def f05_malformed(v: Views):
    """One good ring beside a bad one; a bad ring, half a point, and a bad box."""
    w, s, e, n = (F.col(c).cast("string") for c in ("west", "south", "east", "north"))
    kind = F.col("c_custkey") % 4
    one = F.concat_ws(" ", s, w, s, e, n, e, n, w)
    broken, half = F.concat_ws(" ", s, w, s, F.lit("1.2.3"), n, e, n, w), F.concat_ws(" ", s, w, s, e, n, e, n, w, s)
    polygons = F.when(kind == 0, F.array(F.array(broken), F.array(one))).when(kind == 2, F.array(F.array(half))).otherwise(F.array(F.array(broken)))
    box = F.when(kind == 3, "1 x 3 4").otherwise(F.concat_ws(" ", s, (F.col("west") - 1).cast("string"), n, e))
    rings = geo.cmr_rings(polygons, F.array(box))
    return v.geo().select("c_custkey", rings.alias("rings")).select(
        "c_custkey", geo.rings_geometry(F.col("rings"))["type"].alias("geometry_type"), geo.rings_envelope(F.col("rings"))[0].alias("min_x"),
    )


@query("f06_wkt_forms", """
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN c_custkey ELSE -0.25 END::DOUBLE AS minx,
           CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN -20 ELSE 1 END::DOUBLE AS miny FROM customer""")
def f06_forms(v: Views):
    """Numbers without a digit before the point, with a plus sign, with an exponent."""
    k = F.col("c_custkey")
    wkt = (
        F.when(k % 3 == 0, F.concat(F.lit("POINT (.5 "), k, F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("POINT(+"), k, F.lit(" -2.E1)")))
        .otherwise(F.concat(F.lit("MULTIPOINT ((-.25 1), ("), k, F.lit(". +7e0))")))
    )
    b = geo.wkt_bounds(wkt)
    return v.table("customer").select("c_custkey", b[0].alias("minx"), b[1].alias("miny"))


@query("f06_wkt_bounds", "SELECT asset_id, west AS minx, south AS miny, east AS maxx, north AS maxy FROM v_geo", "v_geo")
def f06(v: Views):
    b = geo.wkt_bounds(_wkt())
    return v.geo().select("asset_id", b[0].alias("minx"), b[1].alias("miny"), b[2].alias("maxx"), b[3].alias("maxy"))


@query("f07_bbox_to_polygon", """
    SELECT asset_id, CASE WHEN c_custkey % 4 <> 0 THEN '{"type":"Polygon","coordinates":[[[' || west || ',' || south || '],[' || east || ',' || south || '],[' || east || ',' || north
           || '],[' || west || ',' || north || '],[' || west || ',' || south || ']]]}' END AS geojson FROM v_geo""", "v_geo")
def f07(v: Views):
    sides = F.array("west", "south", "east", F.when(F.col("c_custkey") % 4 != 0, F.col("north")))
    return v.geo().select("asset_id", geo.geometry_json(geo.rings_geometry(geo.bbox_rings(sides))).alias("geojson"))


def _corners():
    transform = F.array(F.lit(30.0), F.lit(0.0), F.col("easting"), F.lit(0.0), F.lit(-30.0), F.col("northing"))
    return geo.grid_corners(transform, F.lit(100), F.lit(200))


@query("f08_grid_corners", """
    SELECT asset_id, easting AS x0, northing AS y0, easting + 3000 AS x2, northing - 6000 AS y2 FROM v_geo""", "v_geo")
def f08(v: Views):
    c = _corners()
    return v.geo().select("asset_id", c[0][0].alias("x0"), c[0][1].alias("y0"), c[2][0].alias("x2"), c[2][1].alias("y2"))


@query("f09_utm_to_lonlat", f"""
    , {KRUEGER.strip()} SELECT asset_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM v_lonlat""", "v_geo")
def f09(v: Views):
    p = geo.utm_to_lonlat(F.col("epsg"), F.col("easting"), F.col("northing"))
    return v.geo().select("asset_id", F.round(p[0], 7).alias("lon"), F.round(p[1], 7).alias("lat"))


@query("f10_corners_to_polygon", """
    SELECT asset_id, 5 AS points, easting AS last_x, northing AS last_y FROM v_geo""", "v_geo")
def f10(v: Views):
    ring = geo.corners_to_rings(_corners())[0]
    return v.geo().select(
        "asset_id", F.size(ring).alias("points"), F.element_at(ring, -1)[0].alias("last_x"), F.element_at(ring, -1)[1].alias("last_y")
    )


@query("a12_bbox_envelope", "SELECT asset_id, west AS minx, south AS miny, east + 1 AS maxx, north AS maxy FROM v_geo", "v_geo")
def a12(v: Views):
    shifted = F.array(geo.box_ring(F.col("west"), F.col("south"), F.col("east"), F.col("north")),
                      geo.box_ring(F.col("west"), F.col("south"), F.col("east") + 1, F.col("north")))
    b = geo.rings_envelope(shifted)
    return v.geo().select("asset_id", b[0].alias("minx"), b[1].alias("miny"), b[2].alias("maxx"), b[3].alias("maxy"))


@query("a13_extent_union", "SELECT min(west) AS minx, min(south) AS miny, max(east) AS maxx, max(north) AS maxy FROM v_geo", "v_geo")
def a13(v: Views):
    return spatial.extent(v.geo())


# ---- features ----------------------------------------------------------------


def _assets(v: Views):
    """Scenes as assets: half with a raster grid, some with only an item geometry, a box, or nothing."""
    k = F.col("c_custkey")
    grid = {
        "driver": F.lit("GTiff"), "crs_wkt": F.lit(None).cast("string"), "epsg": F.lit(4326),
        "transform": F.array(F.lit(0.01), F.lit(0.0), F.col("west"), F.lit(0.0), F.lit(-0.01), F.col("north")),
        "width": F.lit(200), "height": F.lit(100),
    }
    raster_ = F.when(k % 2 == 0, F.struct(*[c.alias(n) for n, c in grid.items()]))
    item = geo.rings_geometry(F.array(geo.box_ring(F.col("west"), F.col("south"), F.col("east"), F.col("north"))))
    sides = F.array("west", "south", "east", "north")
    key = F.element_at(F.array(F.lit("B04"), F.lit("Fmask"), F.lit("B05")), (k % 3 + 1).cast("int"))
    return v.geo().select(
        "asset_id", "product_id", key.alias("asset_key"), F.lit("2024-01-01T00:00:00Z").alias("datetime"),
        F.when(k % 5 == 0, "skipped").otherwise("downloaded").alias("status"), F.concat(F.lit("granule-"), F.floor(k / 3)).alias("source_item_id"),
        (k * 1000).alias("byte_size"), F.concat(F.lit("source/x/"), "asset_id", F.lit(".tif")).alias("local_path"), F.sha2("asset_id", 256).alias("checksum_sha256"),
        raster_.alias("raster_metadata"), F.when((k % 2 == 1) & (k % 3 == 0), item).alias("geometry"),
        F.when((k % 2 == 1) & (k % 5 != 1), sides).alias("bbox"), k.alias("ordinal"), "west", "south", "east", "north", "c_custkey",
    )


def _features(v: Views):
    return spatial.with_coverage(spatial.spatial_features(_assets(v)))


FEATURES_SQL = """
    feat AS (SELECT asset_id, c_custkey, product_id, ['B04', 'Fmask', 'B05'][c_custkey % 3 + 1] AS variable, 'granule-' || c_custkey // 3 AS source_item_id,
             CASE WHEN c_custkey % 5 = 0 THEN 'skipped' ELSE 'downloaded' END AS status, c_custkey % 2 = 0 AS previewable,
             CASE WHEN c_custkey % 2 = 0 THEN 'raster_grid' WHEN c_custkey % 3 = 0 THEN 'stac' WHEN c_custkey % 5 <> 1 THEN 'bbox' END AS geometry_source,
             CASE WHEN c_custkey % 2 = 0 THEN west + 2 ELSE east END AS maxx, CASE WHEN c_custkey % 2 = 0 THEN north - 1 ELSE south END AS miny,
             CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS coverage_ratio FROM v_geo)"""


@query("e09_spatial_features", f"""
    , {FEATURES_SQL.strip()} SELECT asset_id, product_id, variable, status, source_item_id, previewable, geometry_source, round(maxx, 6) AS maxx, round(miny, 6) AS miny,
      CASE WHEN previewable THEN substr(sha256(asset_id), 1, 24) || '-' || lower(to_hex(c_custkey * 1000)) || '-preview-v1' END AS preview_cache_key
    FROM feat WHERE geometry_source IS NOT NULL""", "v_geo")
def e09(v: Views):
    f = spatial.spatial_features(_assets(v))
    env = geo.rings_envelope(F.col("geometry")["coordinates"])
    return f.select(
        "asset_id", "product_id", "variable", "status", "source_item_id", "previewable", "geometry_source",
        F.round(env[2], 6).alias("maxx"), F.round(env[1], 6).alias("miny"), "preview_cache_key",
    )


@query("f11_geometry_fallback", f"""
    , {FEATURES_SQL.strip()} SELECT CASE WHEN previewable AND c_custkey % 4 = 0 THEN 'valid_data' ELSE geometry_source END AS geometry_source, count(*) AS features
    FROM feat WHERE geometry_source IS NOT NULL GROUP BY 1""", "v_geo")
def f11(v: Views):
    assets = _assets(v)
    shape = geo.rings_geometry(F.array(geo.box_ring(F.col("west"), F.col("south"), F.col("east"), F.col("north"))))
    prints = assets.filter("c_custkey % 4 = 0").select("asset_id", shape.alias("footprint"))
    return spatial.spatial_features(assets, prints).groupBy("geometry_source").agg(F.count(F.lit(1)).alias("features"))


@query("p12_spatial_feature_filter", f"""
    , {FEATURES_SQL.strip()} SELECT asset_id, variable FROM feat
    WHERE geometry_source IS NOT NULL AND variable = 'B04' AND status = 'downloaded' AND source_item_id LIKE '%granule-1%'""", "v_geo")
def p12(v: Views):
    return spatial.filter_features(_features(v), variable="B04", status="downloaded", query="GRANULE-1").select("asset_id", "variable")


@query("f13_coverage_ratio", """
    SELECT asset_id, round(least(1.0, ((east - west) * (north - south)) / 16.0), 9) AS coverage_ratio FROM v_geo""", "v_geo")
def f13(v: Views):
    footprint = F.array("west", "south", "east", "north")
    whole = F.array(F.col("west"), F.col("south"), F.col("west") + 4, F.col("south") + 4)
    return v.geo().select("asset_id", F.round(geo.coverage_ratio(footprint, whole), 9).alias("coverage_ratio"))


@query("w06_granule_representative", f"""
    , {FEATURES_SQL.strip()} SELECT product_id, source_item_id, asset_id, coverage_ratio FROM feat WHERE geometry_source IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY product_id, source_item_id ORDER BY coverage_ratio DESC, c_custkey) = 1""", "v_geo")
def w06(v: Views):
    features = _features(v).withColumn("ordinal", F.regexp_extract("asset_id", "-([0-9]+)$", 1).cast("bigint"))
    return spatial.granule_representatives(features).select("product_id", "source_item_id", "asset_id", "coverage_ratio")


@query("w07_preferred_feature", f"""
    , {FEATURES_SQL.strip()} SELECT asset_id, variable FROM feat WHERE geometry_source IS NOT NULL
    ORDER BY CASE WHEN variable = 'B04' THEN 0 WHEN variable <> 'Fmask' THEN 1 ELSE 2 END, coverage_ratio DESC, c_custkey LIMIT 1""", "v_geo")
def w07(v: Views):
    features = _features(v).withColumn("ordinal", F.regexp_extract("asset_id", "-([0-9]+)$", 1).cast("bigint"))
    return spatial.preferred_feature(features).select("asset_id", "variable")


@query("s14_feature_json", f"""
    , {FEATURES_SQL.strip()} SELECT asset_id, 'Feature' AS type, variable, geometry_source FROM feat WHERE geometry_source IS NOT NULL""", "v_geo")
def s14(v: Views):
    from ..sources.features import feature_lines

    line = feature_lines(spatial.spatial_features(_assets(v)))
    at = lambda p: F.get_json_object("value", f"$.{p}")
    return line.select(
        at("id").alias("asset_id"), at("type").alias("type"), at("properties.variable").alias("variable"), at("properties.geometry_source").alias("geometry_source")
    )


# ---- pixels ------------------------------------------------------------------


@query("s15_raster_pixel_scan", 'SELECT asset_id, "row", col, value, valid FROM v_pixels', "v_pixels")
def s15(v: Views):
    tiles = v.table("embeddings").select(
        F.col("vec_id").alias("asset_id"), F.lit(0).alias("tile_row"), F.lit(0).alias("tile_col"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("values"),
        F.transform("embedding", lambda x: x > 0).alias("valid"),
    )
    return raster.tile_pixels(tiles, 8, 8)


@query("a17_percentile_bounds", """
    SELECT asset_id, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.98), 6) AS high FROM v_pixels WHERE valid GROUP BY asset_id""", "v_pixels")
def a17(v: Views):
    return _rounded_bounds(v.pixels().withColumn("value", F.col("value").cast("smallint")))


def _rounded_bounds(pixels):
    return raster.percentile_bounds(pixels).select("asset_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("a17_percentile_bounds_wide", """
    SELECT asset_id, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.98), 6) AS high
    FROM (SELECT asset_id, CAST(value AS DOUBLE) / 7 AS value FROM v_pixels WHERE valid) GROUP BY asset_id""", "v_pixels")
def a17_wide(v: Views):
    return _rounded_bounds(v.pixels().withColumn("value", F.col("value").cast("double") / 7))


@query("a17_nonfinite", """
    SELECT asset_id, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.98), 6) AS high
    FROM (SELECT asset_id, CAST(value AS DOUBLE) AS value FROM v_pixels WHERE valid AND ("row" * 8 + col) % 9 > 2) GROUP BY asset_id""", "v_pixels")
def a17_nonfinite(v: Views):
    """A third of the pixels is infinite, minus infinite or not a number."""
    kind = (F.col("row") * 8 + F.col("col")) % 9
    odd = F.when(kind == 0, float("inf")).when(kind == 1, float("-inf")).when(kind == 2, float("nan"))
    return _rounded_bounds(v.pixels().withColumn("value", F.coalesce(odd, F.col("value").cast("double")))).filter("low <> 0 OR high <> 1")


@query("a18_valid_pixel_stats", """
    SELECT asset_id, count(*) FILTER (valid) AS valid_pixels, bool_or(valid) AS any_valid, count(*) FILTER (valid) * 900.0::DOUBLE AS coverage_area
    FROM v_pixels GROUP BY asset_id""", "v_pixels")
def a18(v: Views):
    return raster.valid_stats(v.pixels(), 900.0)


@query("w08_pixel_runs", 'SELECT asset_id, "row", first_col, last_col FROM v_pixel_runs', "v_pixel_runs")
def w08(v: Views):
    return raster.pixel_runs(v.pixels())


COMPONENTS_SQL = """
    nodes AS (SELECT *, CAST("row" AS BIGINT) * 4294967296 + first_col AS node FROM v_pixel_runs),
    half AS (SELECT a.asset_id, a.node AS u, b.node AS w FROM nodes a JOIN nodes b
             ON a.asset_id = b.asset_id AND b."row" = a."row" + 1 AND a.first_col <= b.last_col AND b.first_col <= a.last_col),
    edge AS (SELECT asset_id, u, w FROM half UNION ALL SELECT asset_id, w, u FROM half),
    reach AS (SELECT asset_id, node AS a, node AS b FROM nodes UNION
              SELECT r.asset_id, r.a, e.w FROM reach r JOIN edge e ON r.asset_id = e.asset_id AND r.b = e.u),
    label AS (SELECT asset_id, a AS node, min(b) AS component FROM reach GROUP BY asset_id, a),
    comp AS (SELECT n.asset_id, n."row", n.first_col, n.last_col, l.component FROM nodes n JOIN label l USING (asset_id, node)),
    area AS (SELECT asset_id, component, CAST(sum(last_col - first_col + 1) AS BIGINT) AS pixel_count FROM comp GROUP BY asset_id, component),
    kept AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY pixel_count DESC, component) = 1 AS is_largest FROM area
             QUALIFY is_largest OR pixel_count >= 64)"""


@query("c01_valid_components", 'SELECT asset_id, "row", first_col, last_col, component FROM comp', "v_pixel_runs", recursive=COMPONENTS_SQL)
def c01(v: Views):
    return raster.connected_components(raster.pixel_runs(v.pixels()))


@query("a19_component_area", "SELECT asset_id, component, pixel_count, pixel_count * 900.0::DOUBLE AS area, is_largest FROM kept", "v_pixel_runs", recursive=COMPONENTS_SQL)
def a19(v: Views):
    return raster.component_areas(raster.connected_components(raster.pixel_runs(v.pixels())), 30.0, -30.0)


SHELL_SQL = COMPONENTS_SQL + """,
    own AS (SELECT c.asset_id, c.component, c."row", unnest(range(first_col, last_col + 1)) AS col FROM comp c JOIN kept USING (asset_id, component)),
    cell AS (SELECT asset_id, component, y, x FROM kept, (SELECT unnest(range(-1, 9)) AS y) ys, (SELECT unnest(range(-1, 9)) AS x) xs),
    free AS (SELECT c.* FROM cell c ANTI JOIN own o ON c.asset_id = o.asset_id AND c.component = o.component AND c.y = o."row" AND c.x = o.col),
    outside AS (SELECT asset_id, component, y, x FROM free WHERE y = -1 AND x = -1 UNION
                SELECT f.asset_id, f.component, f.y, f.x FROM outside o JOIN free f
                ON f.asset_id = o.asset_id AND f.component = o.component AND abs(f.y - o.y) + abs(f.x - o.x) = 1),
    filled AS (SELECT c.* FROM cell c ANTI JOIN outside o USING (asset_id, component, y, x)),
    sides AS (SELECT f.asset_id, f.component, count(*) AS n FROM filled f JOIN outside o
              ON o.asset_id = f.asset_id AND o.component = f.component AND abs(o.y - f.y) + abs(o.x - f.x) = 1 GROUP BY ALL)"""


@query("c02_footprint_polygon", """
    SELECT f.asset_id, f.component, count(*)::DOUBLE AS area, any_value(s.n)::DOUBLE AS perimeter,
           min(x)::DOUBLE AS minx, max(x + 1)::DOUBLE AS maxx, min(y)::DOUBLE AS miny, max(y + 1)::DOUBLE AS maxy
    FROM filled f JOIN sides s USING (asset_id, component) GROUP BY ALL""", "v_pixel_runs", recursive=SHELL_SQL)
def c02(v: Views):
    """Shells of concave parts: their area and perimeter are those of the part with its holes filled."""
    components = raster.connected_components(raster.pixel_runs(v.pixels()))
    outlines = raster.component_outlines(components, raster.component_areas(components))
    box = geo.rings_envelope(F.array("ring"))
    ring = F.col("ring")
    pairs = F.sequence(F.lit(0), F.size(ring) - 2)
    shoelace = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + ring[i][0] * ring[i + 1][1] - ring[i + 1][0] * ring[i][1])
    length = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.abs(ring[i + 1][0] - ring[i][0]) + F.abs(ring[i + 1][1] - ring[i][1]))
    return outlines.select(
        "asset_id", "component", (shoelace / 2).alias("area"), length.alias("perimeter"),
        box[0].alias("minx"), box[2].alias("maxx"), box[1].alias("miny"), box[3].alias("maxy"),
    )


@query("c02_footprint_lonlat", f"""
    , corner AS (SELECT CAST(c.asset_id AS VARCHAR) || ':' || component AS asset_id, 500000.0::DOUBLE + 30 * first_col AS easting, 4000000.0::DOUBLE - 30 * "row" AS northing,
                        32601 + c.asset_id % 60 AS epsg FROM comp c JOIN kept USING (asset_id, component)
                 QUALIFY row_number() OVER (PARTITION BY c.asset_id, component ORDER BY "row", first_col) = 1),
    {KRUEGER.strip().replace("FROM v_geo", "FROM corner")}
    SELECT asset_id AS part, round(lon, 6) AS lon, round(lat, 6) AS lat FROM v_lonlat""", "v_pixel_runs", recursive=COMPONENTS_SQL)
def c02_lonlat(v: Views):
    """First corner of each simplified outline in longitude and latitude."""
    components = raster.connected_components(raster.pixel_runs(v.pixels()))
    outlines = raster.component_outlines(components, raster.component_areas(components), tolerance=2.0)
    transform = F.array(*[F.lit(x) for x in (30.0, 0.0, 500000.0, 0.0, -30.0, 4000000.0)])
    grids = v.table("embeddings").select(F.col("vec_id").alias("asset_id"), transform.alias("transform"), (F.col("vec_id") % 60 + 32601).alias("epsg"))
    corner = F.col("ring")[0]
    return raster.footprint_parts(outlines, grids).select(
        F.concat_ws(":", "asset_id", "component").alias("part"), F.round(corner[0], 6).alias("lon"), F.round(corner[1], 6).alias("lat")
    )


# Sides of the filled parts with the part on the right, each with the side it goes on with (outside first), walked from the first pixel.
SIMPLIFIED_SQL = SHELL_SQL + """,
    side AS (SELECT f.asset_id, f.component, f.x + d.x0 AS x0, f.y + d.y0 AS y0, f.x + d.x1 AS x1, f.y + d.y1 AS y1, d.heading
             FROM filled f, (VALUES (0, -1, 0, 0, 1, 0, 0), (1, 0, 1, 0, 1, 1, 1), (0, 1, 1, 1, 0, 1, 2), (-1, 0, 0, 1, 0, 0, 3)) d(ox, oy, x0, y0, x1, y1, heading)
             JOIN outside o ON o.asset_id = f.asset_id AND o.component = f.component AND o.x = f.x + d.ox AND o.y = f.y + d.oy),
    follows AS (SELECT a.asset_id, a.component, a.x0, a.y0, a.heading, b.x0 AS nx, b.y0 AS ny, b.heading AS nh FROM side a
                JOIN side b ON a.asset_id = b.asset_id AND a.component = b.component AND b.x0 = a.x1 AND b.y0 = a.y1 AND (b.heading - a.heading + 4) % 4 <> 2
                QUALIFY row_number() OVER (PARTITION BY a.asset_id, a.component, a.x0, a.y0, a.heading ORDER BY (b.heading - a.heading + 5) % 4) = 1),
    walk AS (SELECT asset_id, component, CAST(component % 4294967296 AS INTEGER) AS x, CAST(component // 4294967296 AS INTEGER) AS y, 0 AS heading, 0 AS step FROM kept UNION ALL
             SELECT w.asset_id, w.component, f.nx, f.ny, f.nh, w.step + 1 FROM walk w JOIN follows f
             ON f.asset_id = w.asset_id AND f.component = w.component AND f.x0 = w.x AND f.y0 = w.y AND f.heading = w.heading
             WHERE NOT (f.nh = 0 AND f.nx = w.component % 4294967296 AND f.ny = w.component // 4294967296)),
    bend AS (SELECT *, lag(heading) OVER (PARTITION BY asset_id, component ORDER BY step) AS came FROM walk),
    ring AS (SELECT asset_id, component, x, y, row_number() OVER (PARTITION BY asset_id, component ORDER BY step) - 1 AS i FROM bend WHERE came IS NULL OR came <> heading),
    size AS (SELECT asset_id, component, count(*) AS n FROM ring GROUP BY ALL),
    closed AS (SELECT * FROM ring UNION ALL SELECT r.asset_id, r.component, r.x, r.y, s.n FROM ring r JOIN size s USING (asset_id, component) WHERE r.i = 0),
    far AS (SELECT r.asset_id, r.component, r.i, s.n FROM ring r JOIN size s USING (asset_id, component) JOIN ring z USING (asset_id, component) WHERE z.i = 0
            QUALIFY row_number() OVER (PARTITION BY r.asset_id, r.component ORDER BY (r.x - z.x) ** 2 + (r.y - z.y) ** 2 DESC, r.i) = 1),
    piece AS (SELECT asset_id, component, 0 AS a, i AS b FROM far UNION ALL SELECT asset_id, component, i, n FROM far UNION ALL
              SELECT asset_id, component, unnest([a, k]), unnest([k, b]) FROM (
                SELECT asset_id, component, a, b, arg_max(i, (away, -i)) AS k, max(away) AS most FROM (
                  SELECT p.asset_id, p.component, p.a, p.b, v.i, CASE WHEN e.x = s.x AND e.y = s.y THEN sqrt((v.x - s.x) ** 2 + (v.y - s.y) ** 2)
                    ELSE abs((v.x - s.x) * (e.y - s.y) - (v.y - s.y) * (e.x - s.x)) / sqrt((e.x - s.x) ** 2 + (e.y - s.y) ** 2) END AS away
                  FROM piece p JOIN closed s ON s.asset_id = p.asset_id AND s.component = p.component AND s.i = p.a
                  JOIN closed e ON e.asset_id = p.asset_id AND e.component = p.component AND e.i = p.b
                  JOIN ring v ON v.asset_id = p.asset_id AND v.component = p.component AND v.i > p.a AND v.i < p.b) GROUP BY ALL) WHERE most > 1.5),
    stays AS (SELECT DISTINCT asset_id, component, a AS i FROM piece),
    enough AS (SELECT asset_id, component FROM stays GROUP BY ALL HAVING count(*) >= 3)"""


@query("c02_simplified_vertices", """
    SELECT r.asset_id, r.component, r.x::DOUBLE AS x, r.y::DOUBLE AS y, row_number() OVER (PARTITION BY r.asset_id, r.component ORDER BY r.i) - 1 AS place
    FROM ring r LEFT JOIN stays s USING (asset_id, component, i) LEFT JOIN enough e USING (asset_id, component)
    WHERE s.i IS NOT NULL OR e.component IS NULL""", "v_pixel_runs", recursive=SIMPLIFIED_SQL)
def c02_simplified(v: Views):
    """Every corner that a tolerance of one and a half pixels leaves."""
    components = raster.connected_components(raster.pixel_runs(v.pixels()))
    outlines = raster.component_outlines(components, raster.component_areas(components), tolerance=1.5)
    corners = outlines.select("asset_id", "component", F.posexplode(F.slice("ring", 1, F.size("ring") - 1)).alias("_at", "_p"))
    return corners.select("asset_id", "component", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"), F.col("_at").cast("long").alias("place"))


_MASK = "(VALUES " + ", ".join(f"('{c}', {r}, {g}, {b}, {a})" for c, _, r, g, b, a in MASK_CLASSES) + ") m(pixel_class, red, green, blue, alpha)"


@query("f27_fmask_class", f"""
    WITH c AS (SELECT asset_id, "row", col, CASE WHEN NOT valid THEN NULL WHEN q & 1 <> 0 THEN 'cirrus' WHEN q & 2 <> 0 THEN 'cloud' WHEN q & 4 <> 0 THEN 'adjacent'
           WHEN q & 8 <> 0 THEN 'shadow' WHEN q & 16 <> 0 THEN 'snow' WHEN q & 32 <> 0 THEN 'water' ELSE 'clear' END AS pixel_class
    FROM (SELECT *, abs(value) % 64 AS q FROM v_pixels))
    SELECT asset_id, "row", col, c.pixel_class, coalesce(red, 83) AS red, coalesce(green, 105) AS green, coalesce(blue, 96) AS blue, coalesce(alpha, 0) AS alpha
    FROM c LEFT JOIN {_MASK} ON m.pixel_class = c.pixel_class""", "v_pixels")
def f27(v: Views):
    mask = v.pixels().withColumn("value", F.abs("value") % 64)
    return raster.classify_mask(mask).select("asset_id", "row", "col", "pixel_class", "red", "green", "blue", "alpha")


@query("f26_quality_bits", """
    SELECT bit, meaning, count(*) FILTER ((abs(value) >> bit) & 1 = 1) AS pixels
    FROM v_pixels, (VALUES (0, 'missing'), (1, 'cloud'), (2, 'cloud_shadow'), (3, 'snow'), (4, 'saturation'), (5, 'low_quality'), (6, 'interpolated'), (7, 'temporally_filled')) b(bit, meaning)
    GROUP BY bit, meaning""", "v_pixels")
def f26(v: Views):
    value = F.abs("value")
    counts = v.pixels().agg(*[F.count_if(px.has_bit(value, b)).alias(f"b{b}") for b in range(8)])
    long = counts.select(F.posexplode(F.array(*[F.col(f"b{b}") for b in range(8)])).alias("bit", "pixels"))
    return long.join(F.broadcast(quality_bits(v.spark)), "bit").select("bit", "meaning", "pixels")


@query("f28_stretch", """
    WITH b AS (SELECT asset_id, quantile_cont(value, 0.02) AS low, quantile_cont(value, 0.98) AS high FROM v_pixels WHERE valid GROUP BY asset_id)
    SELECT asset_id, "row", col, CASE WHEN valid THEN CAST(trunc(least(greatest((value - low) / (high - low), 0), 1) * 255) AS INTEGER) ELSE 0 END AS intensity,
           CASE WHEN valid THEN 235 ELSE 0 END AS alpha
    FROM v_pixels JOIN b USING (asset_id)""", "v_pixels")
def f28(v: Views):
    return raster.stretch_pixels(v.pixels().withColumn("value", F.col("value").cast("smallint")))


@query("f29_downsample", """
    SELECT asset_id, "row" // 2 AS "row", col // 2 AS col, round(avg(value), 9) AS value FROM v_pixels WHERE valid GROUP BY ALL""", "v_pixels")
def f29(v: Views):
    return raster.downsample_mean(v.pixels(), 8, 8, 4).withColumn("value", F.round("value", 9))


@query("f29_downsample_nearest", """
    SELECT asset_id, "row" // 2 AS "row", col // 2 AS col, value, valid FROM v_pixels WHERE "row" % 2 = 1 AND col % 2 = 1""", "v_pixels")
def f29_nearest(v: Views):
    return raster.downsample_nearest(v.pixels(), 8, 8, 4)


@query("f29_nearest_5_of_8", """
    SELECT asset_id, t AS "row", u AS col, value, valid FROM v_pixels JOIN (SELECT unnest(range(5)) AS t) r ON "row" = floor((t + 0.5) * 8 / 5)
    JOIN (SELECT unnest(range(5)) AS u) c ON col = floor((u + 0.5) * 8 / 5)""", "v_pixels")
def f29_nearest_5(v: Views):
    return raster.downsample_nearest(v.pixels(), 8, 8, 5)


@query("f29_nearest_7_of_8", """
    SELECT asset_id, t AS "row", u AS col, value, valid FROM v_pixels JOIN (SELECT unnest(range(7)) AS t) r ON "row" = floor((t + 0.5) * 8 / 7)
    JOIN (SELECT unnest(range(7)) AS u) c ON col = floor((u + 0.5) * 8 / 7)""", "v_pixels")
def f29_nearest_7(v: Views):
    return raster.downsample_nearest(v.pixels(), 8, 8, 7)
