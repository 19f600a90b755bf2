"""Column rules on hand-made values."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraspan.functions import geometry as geo
from terraspan.functions import progress as pg
from terraspan.functions import semantics, text
from terraspan.functions.sql import register_functions
from terraspan.operators import ingest, planning, spatial
from terraspan.schemas import RASTER_DDL


def one(spark, column, schema="x INT", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("value, expected", [
    ("../../outside", "outside"), ("../item", "item"), ("a/b/", "b"), ("a/.", "a"), ("..", "unknown"), (".", "unknown"), ("", "unknown"),
    (None, "unknown"), ("/", "unknown"), ("a\\b", "b"), ("x" * 200, "x" * 120), (".hidden", ".hidden"), ("a/..", "unknown"), ("./", "unknown"),
])
def test_safe_component(spark, value, expected):
    assert one(spark, text.safe_component(F.col("s")), "s STRING", (value,)) == expected
    register_functions(spark)
    assert one(spark, F.expr("safe_component(s, 'unknown')"), "s STRING", (value,)) == expected


@pytest.mark.parametrize("href, expected", [
    ("https://h/a/scene%20one.tif?sig=1#f", "scene one.tif"), ("https://h", "B04.data"), ("https://h/a+b.tif", "a+b.tif"),
    ("s3://bucket/k/x.tif", "x.tif"), ("https://h/bad%zz.tif", "bad%zz.tif"), ("rel/path/y.nc", "y.nc"), ("", "B04.data"),
    ("https://h/a/..%2F..%2Fetc", "etc"), ("https://h/x.tif;v=1", "x.tif"),
])
def test_asset_filename(spark, href, expected):
    assert one(spark, text.asset_filename(F.lit("B04"), F.col("s")), "s STRING", (href,)) == expected


def test_paths_and_keys(spark):
    path = text.asset_path(F.lit("nasa"), F.lit("HLSL30_V2.0"), F.lit("granule-1"), F.lit("scene.B04.tif"))
    assert one(spark, path) == "source/nasa/HLSL30_V2.0/granule-1/scene.B04.tif"
    for name, key in [("HLS.B04.tif", "B04"), ("file", "file"), ("a.tif", "a"), ("x.y.z.nc", "z")]:
        assert one(spark, text.link_asset_key(F.lit(name))) == key
    assert one(spark, text.media_type(F.lit("a/b.TIF"))) == "image/tiff"
    assert one(spark, text.media_type(F.lit("a/b"))) == "application/octet-stream"
    assert one(spark, text.path_suffix(F.lit(".zgroup"))) == ""
    assert one(spark, text.preview_key(F.lit("ab" * 32), F.lit(255).cast("bigint"))) == "ab" * 12 + "-ff-preview-v1"
    assert one(spark, text.preview_key(F.lit(""), F.lit(255).cast("bigint"))) is None


def sequential(keys):
    seen, out = set(), []
    for key in keys:
        name, n = key, 2
        while name in seen:
            name, n = f"{key}_{n}", n + 1
        seen.add(name)
        out.append(name)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["a", "a_2", "a_3", "b"]), min_size=1, max_size=8))
def test_unique_keys_follow_the_sequential_rule(spark, keys):
    df = spark.createDataFrame([([(k, "h") for k in keys],)], "links ARRAY<STRUCT<key: STRING, href: STRING>>")
    assert [r["key"] for r in df.select(ingest.unique_keys(F.col("links")).alias("v")).first()["v"]] == sequential(keys)


def test_number_link_keys_replays_clashing_groups(spark):
    groups = {"g1": ["B04", "B04_2", "B04"], "g2": ["B04", "B04", "B04"], "g3": ["x"]}
    rows = [(g, i, k, f"{g}-{i}") for g, keys in groups.items() for i, k in enumerate(keys)]
    out = ingest.number_link_keys(spark.createDataFrame(rows, "g STRING, pos INT, key STRING, href STRING"), ["g"], ["pos"])
    got = {r["href"]: r["key"] for r in out.collect()}
    want = {f"{g}-{i}": name for g, keys in groups.items() for i, name in enumerate(sequential(keys))}
    assert got == want


def test_cmr_rings(spark):
    schema = "polygons ARRAY<ARRAY<STRING>>, boxes ARRAY<STRING>"
    rings = geo.cmr_rings(F.col("polygons"), F.col("boxes"))
    open_ring = one(spark, rings, schema, ([["39 -101 39 -99 41 -99 41 -101"]], None))
    assert open_ring == [[[-101.0, 39.0], [-99.0, 39.0], [-99.0, 41.0], [-101.0, 41.0], [-101.0, 39.0]]]
    assert one(spark, rings, schema, ([["1 2 3 4"]], ["-5 -6 7 8"])) == [[[-6.0, -5.0], [8.0, -5.0], [8.0, 7.0], [-6.0, 7.0], [-6.0, -5.0]]]
    assert one(spark, rings, schema, (None, None)) is None
    two = one(spark, geo.rings_geometry(rings), schema, ([["0 0 0 1 1 1"], ["5 5 5 6 6 6"]], None))
    assert two["type"] == "MultiPolygon" and len(two["coordinates"]) == 2
    js = one(spark, geo.geometry_json(geo.rings_geometry(rings)), schema, ([["0 0 0 1 1 1"]], None))
    assert js == '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]}'


def test_wkt(spark):
    ok = ["POINT (-100 40)", "POLYGON ((0 0, 1 0, 1 1, 0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "LINESTRING (0 0, 1e2 1)"]
    bad = ["POLYGON EMPTY", "", "POINT (1)", "POLYGON ((0 0, 1 1)", "CIRCLE (0 0)", None]
    for value in ok + bad:
        assert one(spark, geo.wkt_is_valid(F.col("s")), "s STRING", (value,)) is (value in ok), value
    assert one(spark, geo.wkt_bounds(F.lit("POINT (-100 40.5)"))) == [-100.0, 40.5, -100.0, 40.5]


def test_utm(spark):
    at = lambda e, x, y: one(spark, geo.utm_to_lonlat(F.lit(e), F.lit(x), F.lit(y)))
    lon, lat = at(32619, 500000.0, 5500000.0)
    assert abs(lon + 69.0) < 1e-9 and abs(lat - 49.6525429) < 1e-6
    lon, lat = at(32733, 500000.0, 10000000.0)
    assert abs(lon - 15.0) < 1e-9 and abs(lat) < 1e-9
    assert at(4326, -101.0, 41.0) == [-101.0, 41.0]
    assert at(3857, 0.0, 0.0) is None


def _inside(point, ring):
    x, y, hit = *point, False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def _meet(p, q, r, s):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    sign = lambda v: (v > 0) - (v < 0)
    boxes = all(min(p[i], q[i]) <= max(r[i], s[i]) and max(p[i], q[i]) >= min(r[i], s[i]) for i in (0, 1))
    return boxes and sign(side(p, q, r)) * sign(side(p, q, s)) <= 0 and sign(side(r, s, p)) * sign(side(r, s, q)) <= 0


def test_intersection_join_against_brute_force(spark):
    random.seed(7)

    def shape():
        cx, cy, n, size = random.uniform(-60, 60), random.uniform(-40, 40), random.randint(3, 7), random.uniform(1, 25)
        turns = sorted(random.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [[cx + size * math.cos(t), cy + size * math.sin(t)] for t in turns]
        return ring + [ring[0]]

    left, right = [(i, [shape()]) for i in range(60)], [(i, [shape()]) for i in range(40)]

    def frame(rows, key, rings):
        df = spark.createDataFrame(rows, f"{key} INT, {rings} ARRAY<ARRAY<ARRAY<DOUBLE>>>")
        box = geo.rings_envelope(F.col(rings))
        return df.withColumn("bbox", geo.bbox_struct(box[0], box[1], box[2], box[3]))

    got = {
        (r["a"], r["b"]) for split in (1, 3)
        for r in spatial.intersection_join(frame(left, "a", "rings"), frame(right, "b", "area_rings"), 10.0, split).collect()
    }
    want = set()
    for a, (ra,) in left:
        for b, (rb,) in right:
            if any(_meet(p, q, r, s) for p, q in zip(ra, ra[1:]) for r, s in zip(rb, rb[1:])) or _inside(ra[0], rb) or _inside(rb[0], ra):
                want.add((a, b))
    assert got == want and want


def test_holes_are_outside(spark):
    outer, hole = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[2, 2], [8, 2], [8, 8], [2, 8], [2, 2]]
    small = [[4, 4], [5, 4], [5, 5], [4, 5], [4, 4]]
    as_double = lambda rings: [[[float(v) for v in p] for p in ring] for ring in rings]
    schema = "a ARRAY<ARRAY<ARRAY<DOUBLE>>>, b ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    test = geo.rings_intersect(F.col("a"), F.col("b"))
    assert one(spark, test, schema, (as_double([outer, hole]), as_double([small]))) is False
    assert one(spark, test, schema, (as_double([outer]), as_double([small]))) is True
    touching = [[10, 10], [12, 10], [12, 12], [10, 10]]
    assert one(spark, test, schema, (as_double([outer]), as_double([touching]))) is True


def test_main_assets(spark):
    def chosen(collection, keys, roles=None):
        assets = {k: (f"https://example/{k}.tif", (roles or {}).get(k)) for k in keys}
        df = spark.createDataFrame(
            [("nasa", collection, "i", assets)],
            "catalog STRING, collection STRING, source_item_id STRING, assets MAP<STRING, STRUCT<href: STRING, roles: ARRAY<STRING>>>",
        )
        return {r["asset_key"] for r in planning.explode_assets(df).collect()}

    assert chosen("HLSL30_V2.0", ["B04", "B05", "B08", "Fmask"]) == {"B04", "B05", "Fmask"}
    assert chosen("HLSS30_V2.0", ["B04", "B05", "B8A", "Fmask"]) == {"B04", "B8A", "Fmask"}
    assert chosen("other", ["x"]) == {"x"}
    assert chosen("other", ["x", "y", "B08"], {"y": ["Visual"]}) == {"y", "B08"}
    assert chosen("other", ["x", "z"]) == set()


def test_items_without_assets_are_reported(spark):
    schema = "catalog STRING, collection STRING, source_item_id STRING, assets MAP<STRING, STRUCT<href: STRING, roles: ARRAY<STRING>>>"
    items = spark.createDataFrame([("c", "o", "i1", {"x": ("u", None), "y": ("u", None)}), ("c", "o", "i2", {"b04": ("u", None), "y": ("u", None)})], schema)
    jobs = planning.explode_assets(items)
    assert [r["source_item_id"] for r in planning.items_without_assets(items, jobs).collect()] == ["i1"]


@pytest.mark.parametrize("collection, expected", [
    ("HLSL30_V2.0", ("observation", "2.0", "hls_mgrs_30m")), ("Sentinel-2-L2A", ("observation", "unknown", "sentinel-2-l2a_native")),
    ("ERA5-land", ("forcing", "unknown", "era5-land_native")), ("landcover-modis", ("observation", "unknown", "landcover-modis_native")),
    ("soilgrids", ("static", "unknown", "soilgrids_native")), ("zzz", ("observation", "unknown", "zzz_native")),
])
def test_product_semantics(spark, collection, expected):
    c = F.lit(collection)
    assert tuple(one(spark, f(c)) for f in (semantics.modality, semantics.product_version, semantics.fallback_grid_id)) == expected


def test_grid_id_fingerprint(spark):
    import hashlib
    import json

    facts = {"epsg": 32619, "transform": [30.0, 0.0, 500000.0, 0.0, -30.0, 5500000.25], "width": 2, "height": 3}
    raster = F.from_json(F.lit(json.dumps(facts)), RASTER_DDL)
    digest = hashlib.sha1(json.dumps(facts, sort_keys=True).encode()).hexdigest()[:12]
    assert one(spark, semantics.grid_id(F.lit("HLSL30_V2.0"), raster)) == f"hls_mgrs_30m_epsg32619_{digest}"
    assert one(spark, semantics.grid_id(F.lit("zzz"), F.lit(None).cast(RASTER_DDL))) == "zzz_native"


def test_progress_rules(spark):
    v = lambda c: one(spark, c)
    assert v(pg.file_progress(F.lit(1), F.lit(3), F.lit("downloading"))) == 33.33
    assert v(pg.file_progress(F.lit(0), F.lit(0), F.lit("completed"))) == 100.0
    assert v(pg.file_progress(F.lit(0), F.lit(0), F.lit("queued"))) == 0.0
    assert v(pg.byte_progress(F.lit(200), F.lit(100), F.lit(1), F.lit(2))) == 99.9
    assert v(pg.byte_progress(F.lit(200), F.lit(0), F.lit(1), F.lit(2))) == 50.0
    assert v(pg.remaining_seconds(F.lit(10.0), F.lit(25.0), F.lit("downloading"))) == 30.0
    assert v(pg.remaining_seconds(F.lit(10.0), F.lit(1.0), F.lit("downloading"))) is None
    assert v(pg.remaining_seconds(F.lit(10.0), F.lit(50.0), F.lit("failed"))) == 0.0
    retry = lambda code, n, e=None: v(pg.retry_class(F.lit(code).cast("int"), F.lit(e).cast("string"), F.lit(n)))
    assert [retry(401, 1), retry(503, 1), retry(503, 3), retry(404, 1), retry(None, 2, "reset"), retry(None, 3, "reset"), retry(200, 1)] == [
        "auth_required", "retry", "failed", "failed", "retry", "failed", "ok"
    ]


def test_granule_cursor(spark):
    c = lambda *a: one(spark, ingest.granule_cursor(*[F.lit(x) for x in a]))
    assert c(0, 1, 0, 100, 2) == '{"collection_index":1,"page_num":1}'
    assert c(0, 1, 100, 100, 2) == '{"collection_index":0,"page_num":2}'
    assert c(1, 3, 5, 100, 2) is None


def test_static_collections_skip_the_date_filter(spark):
    items = spark.createDataFrame([("2020-01-01T00:00:00Z",), ("2021-01-01T00:00:00Z",)], "datetime STRING")
    assert ingest.temporal_filter(items, "2020-01-01", "2020-01-01", ["a"]).count() == 1
    assert ingest.temporal_filter(items, "2020-01-01", "2020-01-01", ["a", "COP-DEM"]).count() == 2


def test_folder_and_parent_are_those_of_the_patterns(spark):
    from terraspan.functions import text

    paths = [(p,) for p in ("", "a", "/", "/a", "a/", "a//", "a/b", "a/b/c.tif", "a/b\n", "a\n/b", "ä/ö.tif", None)]
    rows = spark.createDataFrame(paths, "path string").select(
        text.folder(F.col("path")).alias("folder"), F.regexp_replace("path", r"[^/]*$", "").alias("_folder"),
        text.parent(F.col("path")).alias("parent"), F.regexp_replace("path", r"/[^/]*$", "").alias("_parent"),
    ).collect()
    assert [(r.folder, r.parent) for r in rows] == [(r._folder, r._parent) for r in rows]


def test_packed_digests_come_back(spark):
    texts = ["ab" * 32, "0" * 64, "f" * 64, "F" * 64, "ab" * 32 + "\n", "ab" * 31, "p7", "", "ä" * 64, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.packed(F.col("t")).alias("p"))
    rows = rows.withColumn("back", text.unpacked(F.col("p"))).collect()
    assert [r.back for r in rows] == texts and [len(r.p) for r in rows[:3]] == [33] * 3
    digests = sorted(r.t for r in rows[:3])
    assert [r.t for r in sorted(rows[:3], key=lambda r: r.p)] == digests
