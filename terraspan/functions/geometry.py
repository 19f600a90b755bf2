"""Planar geometry over arrays of rings, as Column expressions that stay in the JVM.

A geometry is a list of rings, a ring a list of ``[x, y]`` points. Holes and the
parts of a multi-polygon are further rings, told apart by the even-odd rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Up to so many pairs of edges are compared without bins.
FEW_EDGE_PAIRS = 256
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def bbox_struct(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(west.alias("minx"), south.alias("miny"), east.alias("maxx"), north.alias("maxy"))


def bbox_overlaps(a: Column, b: Column) -> Column:
    """Closed boxes: touching counts."""
    return (a.minx <= b.maxx) & (a.maxx >= b.minx) & (a.miny <= b.maxy) & (a.maxy >= b.miny)


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    corner = F.array
    return F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))


def bbox_rings(bbox: Column) -> Column:
    return F.when(
        (F.size(bbox) == 4) & ~F.exists(bbox, lambda v: v.isNull()),
        F.array(box_ring(bbox[0], bbox[1], bbox[2], bbox[3])),
    )


def rings_envelope(rings: Column) -> Column:
    """``[minx, miny, maxx, maxy]`` over all points; null without points."""
    def box(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
        return F.when(
            F.size(points) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
        )

    return let(F.flatten(rings), box)


def _close(ring: Column) -> Column:
    return F.when(ring[0] != F.element_at(ring, -1), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def _numbers(text: Column) -> Column:
    """Numbers of a blank-separated text; one that cannot be read is null."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.when(t.rlike(f"^{_NUMBER}$"), t.try_cast("double")))


def _all_known(values: Column) -> Column:
    return ~F.exists(values, lambda v: v.isNull())


def cmr_rings(polygons: Column, boxes: Column) -> Column:
    """Rings from ``"lat lon lat lon"`` texts, closed, of four points or more; else from the first ``S W N E`` box.

    A text with a number that cannot be read, or half a point, is no ring.
    """

    def parse(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1),
            lambda i: F.array(F.get(v, i * 2 + 1), F.get(v, i * 2)),
        )

    numbers = F.filter(F.transform(F.flatten(polygons), _numbers), lambda v: (F.size(v) >= 2) & (F.size(v) % 2 == 0) & _all_known(v))
    rings = F.filter(F.transform(F.transform(numbers, parse), _close), lambda ring: F.size(ring) >= 4)

    def from_box(v: Column) -> Column:
        south, west, north, east = (F.get(v, F.lit(i)) for i in range(4))
        return F.when((F.size(v) >= 4) & _all_known(v), F.array(box_ring(west, south, east, north)))

    return F.when(F.size(rings) > 0, rings).when(F.size(boxes) > 0, let(_numbers(F.get(boxes, F.lit(0))), from_box))


def rings_geometry(rings: Column) -> Column:
    """Geometry struct: one ring is a polygon, several shells a multi-polygon (one ring per part)."""

    def build(r: Column) -> Column:
        kind = F.when(F.size(r) == 1, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
        return F.when(F.size(r) > 0, F.struct(kind.alias("type"), r.alias("coordinates")))

    return let(rings, build)


def geometry_json(geometry: Column) -> Column:
    """GeoJSON text; each shell of a multi-polygon becomes a part of its own."""
    single = F.to_json(F.struct(geometry["type"].alias("type"), geometry["coordinates"].alias("coordinates")))
    multi = F.to_json(
        F.struct(
            geometry["type"].alias("type"),
            F.transform(geometry["coordinates"], lambda ring: F.array(ring)).alias("coordinates"),
        )
    )
    return F.when(geometry["type"] == "MultiPolygon", multi).when(geometry.isNotNull(), single)


def wkt_bounds(wkt: Column) -> Column:
    """``[minx, miny, maxx, maxy]`` of two-dimensional WKT; null without coordinates."""
    values = F.regexp_extract_all(wkt, F.lit(f"({_NUMBER})"), 1).cast("array<double>")
    xs, ys = F.filter(values, lambda _, i: i % 2 == 0), F.filter(values, lambda _, i: i % 2 == 1)
    return F.when(
        F.size(values) >= 2, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    )


def wkt_rings(wkt: Column) -> Column:
    """Rings of two-dimensional text of any kind: one per innermost pair of parentheses."""
    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)
    return F.transform(texts, lambda t: F.transform(F.split(t, ","), _numbers))


def wkt_is_valid(wkt: Column) -> Column:
    """Well-formed, non-empty two-dimensional WKT of a point, line or area, single or multiple.

    The text is taken apart into its innermost lists of points and a skeleton in which each
    of them is the letter r. Lists are checked as arrays, so their length does not matter.
    """

    def listed(text: Column, letter: str) -> Column:
        """Letters with commas between them."""
        return ~F.exists(F.split(text, ","), lambda part: part != letter)

    def wrapped(text: Column, letter: str) -> Column:
        return text.startswith("(") & text.endswith(")") & listed(F.substring(text, F.lit(2), F.length(text) - 2), letter)

    def judge(g: Column) -> Column:
        kind, skeleton, rings = g["kind"], g["skeleton"], g["rings"]
        sound = ~F.exists(rings, lambda r: F.exists(r, lambda p: (F.size(p) != 2) | ~_all_known(p)))

        def least(n: int) -> Column:
            return ~F.exists(rings, lambda r: F.size(r) < n)

        def single() -> Column:
            return ~F.exists(rings, lambda r: F.size(r) != 1)

        closed = least(4) & ~F.exists(rings, lambda r: r[0] != F.element_at(r, -1))
        groups = F.regexp_replace(skeleton, r"\([r,]*\)", "g")
        parts = F.regexp_extract_all(skeleton, F.lit(r"\(([r,]*)\)"), 1)
        areas = wrapped(groups, "g") & ~F.exists(parts, lambda t: ~listed(t, "r"))
        return sound & (
            F.when(kind == "POINT", (skeleton == "r") & single())
            .when(kind == "LINESTRING", (skeleton == "r") & least(2))
            .when(kind == "POLYGON", wrapped(skeleton, "r") & closed)
            .when(kind == "MULTIPOINT", (skeleton == "r") | (wrapped(skeleton, "r") & single()))
            .when(kind == "MULTILINESTRING", wrapped(skeleton, "r") & least(2))
            .when(kind == "MULTIPOLYGON", areas & closed)
            .otherwise(False)
        )

    text = F.upper(F.trim(F.regexp_replace(F.coalesce(wkt, F.lit("")), r"\s+", " ")))
    body = F.regexp_extract(text, r"^[A-Z]+ ?(\(.*\))$", 1)
    skeleton = F.regexp_replace(F.regexp_replace(body, r"\([^()]+\)", "r"), " ", "")
    parsed = F.struct(F.regexp_extract(text, r"^([A-Z]+)", 1).alias("kind"), skeleton.alias("skeleton"), wkt_rings(body).alias("rings"))
    return let(parsed, judge)


def _edges(rings: Column) -> Column:
    return F.flatten(
        F.transform(
            rings,
            lambda r: F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))),
                lambda i: F.struct(
                    r[i][0].alias("x1"), r[i][1].alias("y1"),
                    F.coalesce(F.get(r, i + 1), r[i])[0].alias("x2"), F.coalesce(F.get(r, i + 1), r[i])[1].alias("y2"),
                ),
            ),
        )
    )


def _side(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _segments_meet(s: Column, t: Column) -> Column:
    """Closed segments share a point: boxes overlap and neither lies strictly on one side of the other."""
    boxes = (
        (F.least(s.x1, s.x2) <= F.greatest(t.x1, t.x2)) & (F.greatest(s.x1, s.x2) >= F.least(t.x1, t.x2))
        & (F.least(s.y1, s.y2) <= F.greatest(t.y1, t.y2)) & (F.greatest(s.y1, s.y2) >= F.least(t.y1, t.y2))
    )
    t_splits = _side(s.x1, s.y1, s.x2, s.y2, t.x1, t.y1) * _side(s.x1, s.y1, s.x2, s.y2, t.x2, t.y2) <= 0
    s_splits = _side(t.x1, t.y1, t.x2, t.y2, s.x1, s.y1) * _side(t.x1, t.y1, t.x2, t.y2, s.x2, s.y2) <= 0
    return boxes & t_splits & s_splits


def _contains_point(edges: Column, point: Column) -> Column:
    """Even-odd rule; points on the border are found by the edge test instead."""
    x, y = point[0], point[1]
    crossings = F.filter(
        edges,
        lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1),
    )
    return F.size(crossings) % 2 == 1


def _band(value: Column, low: Column, high: Column, count: Column) -> Column:
    """Which of ``count`` equal bands between ``low`` and ``high`` a value is in; values outside are in the outer ones."""
    at = F.floor(F.when(high > low, (value - low) / (high - low)).otherwise(0.0) * count)
    return F.greatest(F.lit(0), F.least(count - 1, at))


def _in_band(edges: Column, axis: str, low: Column, high: Column, count: Column, band: Column) -> Column:
    first, last = f"{axis}1", f"{axis}2"
    return F.filter(
        edges,
        lambda e: (_band(F.least(e[first], e[last]), low, high, count) <= band)
        & (_band(F.greatest(e[first], e[last]), low, high, count) >= band),
    )


def _borders_meet(ea: Column, eb: Column, a_box: Column, b_box: Column) -> Column:
    """Whether an edge of one side meets one of the other.

    Only edges that reach into the box common to both sides count. They are put into upright bands and those
    into cells, about the third root of the number of edges each way, and edges meet inside a cell: n edges take
    some n^(4/3) steps instead of n^2. Edges with overlapping boxes share a cell, so none is missed.
    """
    common = F.struct(
        F.greatest(a_box[0], b_box[0]).alias("x1"), F.greatest(a_box[1], b_box[1]).alias("y1"),
        F.least(a_box[2], b_box[2]).alias("x2"), F.least(a_box[3], b_box[3]).alias("y2"),
    )

    def reaching(edges: Column, c: Column) -> Column:
        return F.filter(
            edges,
            lambda e: (F.least(e.x1, e.x2) <= c["x2"]) & (F.greatest(e.x1, e.x2) >= c["x1"])
            & (F.least(e.y1, e.y2) <= c["y2"]) & (F.greatest(e.y1, e.y2) >= c["y1"]),
        )

    def plain(p: Column) -> Column:
        return F.exists(p["a"], lambda s: F.exists(p["b"], lambda t: _segments_meet(s, t)))

    def binned(p: Column, c: Column, axes: str) -> Column:
        axis = axes[0]
        low, high, count = c[f"{axis}1"], c[f"{axis}2"], p["n"]
        bands = F.sequence(F.lit(0), (count - 1).cast("int"))

        def within(band: Column) -> Column:
            part = F.struct(*[_in_band(p[side], axis, low, high, count, band).alias(side) for side in ("a", "b")], count.alias("n"))
            return let(part, lambda q: (F.size(q["a"]) > 0) & (F.size(q["b"]) > 0) & (plain(q) if len(axes) == 1 else binned(q, c, axes[1:])))

        return F.exists(bands, within)

    def decide(c: Column) -> Column:
        sides = F.struct(reaching(ea, c).alias("a"), reaching(eb, c).alias("b"))

        def choose(p: Column) -> Column:
            count = F.ceil(F.cbrt(F.size(p["a"]) + F.size(p["b"])))
            cells = F.struct(p["a"].alias("a"), p["b"].alias("b"), count.alias("n"))
            few = F.size(p["a"]) * F.size(p["b"]).cast("bigint") <= FEW_EDGE_PAIRS
            return F.when(few, plain(p)).otherwise(let(cells, lambda q: binned(q, c, "xy")))

        return let(sides, choose)

    return let(common, decide)


def rings_intersect(a: Column, b: Column) -> Column:
    """Exact test: borders meet, or a part of one lies inside the other. Rings without points count for nothing."""
    full = lambda rings: F.filter(rings, lambda r: F.size(r) > 0)

    def inside(rings: Column, edges: Column, box: Column) -> Column:
        def within(ring: Column) -> Column:
            x, y = ring[0][0], ring[0][1]
            return (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3]) & _contains_point(edges, ring[0])

        return F.exists(rings, within)

    both = F.struct(full(a).alias("a"), full(b).alias("b"))

    def prepared(p: Column) -> Column:
        return F.struct(
            p["a"].alias("a"), p["b"].alias("b"), _edges(p["a"]).alias("ea"), _edges(p["b"]).alias("eb"),
            rings_envelope(p["a"]).alias("box_a"), rings_envelope(p["b"]).alias("box_b"),
        )

    return let(
        let(both, prepared),
        lambda p: _borders_meet(p["ea"], p["eb"], p["box_a"], p["box_b"])
        | inside(p["b"], p["ea"], p["box_a"]) | inside(p["a"], p["eb"], p["box_b"]),
    )


def grid_corners(transform: Column, width: Column, height: Column) -> Column:
    """Native coordinates of the four raster corners, clockwise from the origin."""
    a, b, c, d, e, f = (transform[i] for i in range(6))

    def at(x: Column, y: Column) -> Column:
        return F.array(a * x + b * y + c, d * x + e * y + f)

    zero = F.lit(0)
    return F.when(
        (F.size(transform) == 6) & (width >= 1) & (height >= 1),
        F.array(at(zero, zero), at(width, zero), at(width, height), at(zero, height)),
    )


def corners_to_rings(corners: Column) -> Column:

    def close(c: Column) -> Column:
        whole = (F.size(c) == 4) & ~F.exists(c, lambda p: (F.size(p) != 2) | p[0].isNull() | p[1].isNull())
        return F.when(whole, F.array(F.concat(c, F.slice(c, 1, 1))))

    return let(corners, close)


# ---- inverse transverse Mercator, third-order series in the third flattening ----
_A, _F0, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F0 / (2 - _F0)
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_to_lonlat(epsg: Column, x: Column, y: Column) -> Column:
    """``[lon, lat]`` for UTM zones (EPSG 326xx, 327xx) and EPSG 4326; null for any other system."""
    zone, south = epsg % 100, epsg.between(32701, 32760)
    is_utm = epsg.between(32601, 32660) | south
    scaled = F.struct(
        ((y - F.when(south, 10_000_000.0).otherwise(0.0)) / (_K0 * _RECTIFYING)).alias("xi"),
        ((x - 500_000.0) / (_K0 * _RECTIFYING)).alias("eta"),
    )

    def remove_series(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for j, beta in enumerate(_BETA, 1):
            xi = xi - beta * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            eta = eta - beta * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def on_sphere(p: Column) -> Column:
        return F.struct(
            F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"), F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])).alias("lon")
        )

    def degrees(p: Column) -> Column:
        lat = p["chi"]
        for j, delta in enumerate(_DELTA, 1):
            lat = lat + delta * F.sin(2 * j * p["chi"])
        return F.array(p["lon"] * (180.0 / math.pi) + zone * 6.0 - 183.0, lat * (180.0 / math.pi))

    projected = let(let(let(scaled, remove_series), on_sphere), degrees)
    return F.when(epsg == 4326, F.array(x.cast("double"), y.cast("double"))).when(is_utm, projected)


def is_known_epsg(epsg: Column) -> Column:
    return (epsg == 4326) | epsg.between(32601, 32660) | epsg.between(32701, 32760)


def corners_to_lonlat(epsg: Column, corners: Column) -> Column:
    return F.when(is_known_epsg(epsg) & corners.isNotNull(), F.transform(corners, lambda p: utm_to_lonlat(epsg, p[0], p[1])))


def coverage_ratio(footprint: Column, raster: Column) -> Column:
    """Area of the footprint envelope over that of the raster envelope, at most 1; 0 when unusable."""

    def area(box: Column) -> Column:
        return let(box, lambda b: F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1]))

    areas = F.struct(area(footprint).alias("f"), area(raster).alias("r"))
    ratio = let(areas, lambda p: F.when(p["r"] > 0, F.least(F.lit(1.0), p["f"] / p["r"])))
    return F.coalesce(ratio, F.lit(0.0))
