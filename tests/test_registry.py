"""Registration, upserts, run records and listings."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from terraspan.operators import audit, catalog, ordering, registry
from terraspan.schemas import RASTER_DDL, parse
from terraspan.session import materialize
from terraspan.sources.registry_store import RegistryStore

DELIVERY = (
    "run_id STRING, catalog STRING, collection STRING, item_id STRING, asset_key STRING, source_url STRING, local_path STRING, "
    "byte_size BIGINT, checksum_sha256 STRING, datetime STRING, bbox ARRAY<DOUBLE>, "
    "geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>, "
    f"raster {RASTER_DDL}, status STRING, collection_metadata STRING, registered_at STRING, seq BIGINT"
)
GRID = {"driver": "GTiff", "epsg": 32619, "transform": [30.0, 0.0, 500000.0, 0.0, -30.0, 5500000.0], "x_origin": 500000.0, "y_origin": 5500000.0,
        "pixel_size_x": 30.0, "pixel_size_y": -30.0, "width": 2, "height": 3, "band_count": 1, "dtype": "int16", "nodata": "-9999.0", "tags": {}}


def delivery(spark, **changes):
    base = dict(
        run_id="run-1", catalog="nasa", collection="HLSL30_V2.0", item_id="granule-1", asset_key="B04", source_url="https://example/scene.B04.tif",
        local_path="source/nasa/HLSL30_V2.0/granule-1/scene.B04.tif", byte_size=10, checksum_sha256="c" * 64, datetime="2024-01-01T12:00:00Z",
        bbox=[-101.0, 39.0, -99.0, 41.0], geometry=None, raster=GRID, status="downloaded", collection_metadata=None,
        registered_at="2024-01-02T00:00:00Z", seq=1,
    )
    base.update(changes)
    raster = base.pop("raster")
    df = spark.createDataFrame([json.dumps(base)], "STRING").select(F.from_json("value", parse(DELIVERY)).alias("d")).select("d.*")
    return df.withColumn("raster", F.from_json(F.lit(json.dumps(raster)) if raster else F.lit(None).cast("string"), RASTER_DDL))


def test_register_twice_keeps_lineage(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path))
    store.merge(registry.register(delivery(spark)))
    again = delivery(spark, run_id="run-2", status="skipped", registered_at="2024-01-03T00:00:00Z", byte_size=11, seq=2)
    store.merge(registry.register(again))
    asset = store.read("assets").collect()
    assert len(asset) == 1
    asset = asset[0]
    assert (asset["status"], asset["run_id"], asset["created_at"], asset["updated_at"], asset["byte_size"]) == (
        "downloaded", "run-1", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", 11)
    assert asset["asset_id"] == hashlib.sha256(b"nasa|HLSL30_V2.0|granule-1|B04|https://example/scene.B04.tif").hexdigest()
    variable = store.read("variables").first()
    assert (variable["canonical_name"], variable["unit"], variable["central_wavelength_nm"], variable["nodata"]) == ("surface_reflectance_red", "1", 655.0, "-9999.0")
    assert (variable["scale_factor"], variable["add_offset"], variable["dtype"], variable["quality_variable"]) == (0.0001, 0.0, "int16", "quality_fmask")
    grid = store.read("grids").first()
    assert (grid["epsg"], grid["x_origin"], grid["y_origin"], grid["pixel_size_x"], grid["pixel_size_y"]) == (32619, 500000.0, 5500000.0, 30.0, -30.0)
    product = store.read("products").first()
    assert product["title"] == "Harmonized Landsat Sentinel-2 L30 Version 2.0"
    assert "hlsl30v002" in product["documentation_urls"][0]
    assert store.read("sources").first()["provider"] == "NASA Earthdata"
    rollup = catalog.product_rollup(store.read("products"), store.read("assets"), store.read("variables")).first()
    assert (rollup["asset_count"], rollup["variable_count"], rollup["byte_size"]) == (1, 1, 11)
    assert [r["bbox"] for r in catalog.product_bboxes(store.read("products"), store.read("assets")).collect()] == [[-101.0, 39.0, -99.0, 41.0]]


def test_one_batch_equals_two(spark):
    first, second = delivery(spark), delivery(spark, run_id="run-2", status="skipped", seq=2, registered_at="2024-01-05T00:00:00Z")
    other = delivery(spark, asset_key="B05", source_url="https://example/scene.B05.tif", seq=3)
    whole = registry.register(first.unionByName(second).unionByName(other))
    empty = registry.empty_registries(spark)
    step = registry.merge_registries(registry.merge_registries(empty, registry.register(first)), registry.register(second.unionByName(other)))
    for table in ("assets", "variables", "grids", "sources", "products"):
        assert sorted(map(str, whole[table].collect())) == sorted(map(str, step[table].collect())), table
    twice = registry.merge_registries(registry.merge_registries(empty, whole), whole)
    assert sorted(map(str, twice["assets"].collect())) == sorted(map(str, whole["assets"].collect()))


def test_fmask_variable(spark):
    raster = {**GRID, "dtype": "uint8", "nodata": "255.0", "tags": {"Fmask bit description": "cloud and water bits"}}
    row = registry.register(delivery(spark, asset_key="Fmask", raster=raster))["variables"].first()
    assert (row["unit"], row["nodata"], row["quality_flag_definition"], row["role"], row["scale_factor"]) == (None, "255.0", "cloud and water bits", "quality", None)


def test_tags_override_the_profile(spark):
    raster = {**GRID, "tags": {"scale_factor": "0.5", "add_offset": "bad"}}
    row = registry.register(delivery(spark, raster=raster))["variables"].first()
    assert (row["scale_factor"], row["add_offset"]) == (0.5, None)


def test_poorer_metadata_does_not_overwrite(spark):
    meta = json.dumps({"type": "Collection", "title": "Rich", "description": "Long", "license": "CC-BY", "keywords": ["a", "b", "a"],
                       "extent": {"temporal": {"interval": [["2013-01-01", None]]}}, "summaries": {"gsd": [30]},
                       "links": [{"rel": "About", "href": "https://d"}, {"rel": "self", "href": "https://s"}]})
    rich = registry.register(delivery(spark, collection="abc", collection_metadata=meta))
    row = rich["products"].first()
    assert (row["title"], row["license"], row["keywords"], row["temporal_start"], row["temporal_end"], row["documentation_urls"], row["spatial_resolution_m"]) == (
        "Rich", "CC-BY", ["a", "b"], "2013-01-01", None, ["https://d"], 30.0)
    poor = registry.register(delivery(spark, collection="abc", seq=9))
    base = registry.merge_registries(registry.empty_registries(spark), rich)
    kept = registry.merge_registries(base, poor)["products"].first()
    assert (kept["temporal_start"], kept["collection_metadata"]) == ("2013-01-01", meta)
    replaced = registry.merge_registries(base, poor, mode="replace")["products"].first()
    assert (replaced["title"], replaced["temporal_start"]) == ("abc", None)


def test_runs(spark):
    runs = registry.empty_registries(spark)["processing_runs"]
    started = spark.createDataFrame([("r1", "t0", "running"), ("r2", "t1", "running")], "run_id STRING, start_time STRING, status STRING")
    runs = registry.start_runs(runs, started)
    assert registry.start_runs(runs, started).count() == 2
    assets = spark.createDataFrame([("b" * 64, "r1"), ("a" * 64, "r1"), ("a" * 64, "r1")], "asset_id STRING, run_id STRING")
    finished = spark.createDataFrame([("r1", "completed", "t9"), ("nope", "failed", "t9")], "run_id STRING, status STRING, end_time STRING")
    closed, unknown = registry.finish_runs(runs, finished, assets)
    assert [r["run_id"] for r in unknown.collect()] == ["nope"]
    r1 = closed.filter("run_id = 'r1'").first()
    ids = sorted({"a" * 64, "b" * 64})
    assert (r1["status"], r1["end_time"]) == ("completed", "t9")
    assert sorted(tuple(r) for r in registry.run_outputs(assets).collect()) == [("r1", i) for i in ids]
    assert r1["checksum"] == hashlib.sha256("\n".join(ids).encode()).hexdigest()
    assert closed.filter("run_id = 'r2'").first()["status"] == "running"


def test_digest_is_the_same_for_runs_of_any_size(spark):
    ids = sorted({hashlib.sha256(str(i).encode()).hexdigest() for i in range(30_000)})
    pairs = [(i, "large") for i in ids] + [(ids[0], "small"), (ids[0], "small")]
    rows = {r["run_id"]: r for r in registry.run_digests(spark.createDataFrame(pairs, "asset_id STRING, run_id STRING").repartition(7)).collect()}
    assert (rows["large"]["checksum"], rows["large"]["output_count"]) == (hashlib.sha256("\n".join(ids).encode()).hexdigest(), len(ids))
    assert (rows["small"]["checksum"], rows["small"]["output_count"]) == (hashlib.sha256(ids[0].encode()).hexdigest(), 1)


def test_merge_touches_only_the_parts_of_its_rows(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path))
    rows = spark.range(0, 400).selectExpr("concat('a', id) AS asset_id", "concat('p', id % 3) AS product_id", "concat('i', id) AS source_item_id", "id AS byte_size", "'x' AS status")
    store.write("assets", rows)
    before = store.manifest("assets")["parts"]
    delta = registry.conform(rows.filter("asset_id = 'a7'").withColumn("byte_size", F.lit(1_000_000)), "assets")
    store.merge({"assets": delta})
    after = store.manifest("assets")["parts"]
    changed = [p for p in after if after[p] != before.get(p)]
    assert len(changed) == 1 and after.keys() == before.keys() and len(before) > 50
    sizes = {r["asset_id"]: r["byte_size"] for r in store.read("assets").collect()}
    assert len(sizes) == 400 and sizes["a7"] == 1_000_000 and sizes["a8"] == 8
    replaced = store.manifest("assets")["expired"]
    assert replaced == [before[changed[0]]] and os.path.isdir(f"{tmp_path}/assets/{replaced[0]}")
    store.merge({"assets": delta})
    assert not os.path.exists(f"{tmp_path}/assets/{replaced[0]}") and store.read("assets").count() == 400


def test_number_rows_with_a_hot_group(spark):
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), ((F.col("id") * 7919) % 30011).alias("k"))
    got = ordering.number_rows(df, ["g"], ["k"], "n")
    pdf = got.toPandas().sort_values(["g", "k"])
    assert (pdf["n"] == pdf.groupby("g").cumcount() + 1).all() and len(pdf) == 30000
    nulls = ordering.number_rows(spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "g STRING, k INT"), ["g"], ["k"], "n")
    assert sorted((str(r["g"]), r["k"], r["n"]) for r in nulls.collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1)]


def test_deep_page_equals_shallow(spark, monkeypatch):
    rows = spark.range(0, 500).select(F.col("id").cast("string").alias("asset_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("updated_at"))
    want = [tuple(r) for r in catalog.registry_page(rows, "assets", 123, 20).collect()]
    monkeypatch.setattr(ordering, "DEEP_OFFSET", 10)
    assert [tuple(r) for r in catalog.registry_page(rows, "assets", 123, 20).collect()] == want
    with pytest.raises(KeyError):
        catalog.registry_page(rows, "unknown")


def test_schema_evolution(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path))
    assert store.read("grids").count() == 0
    old = spark.createDataFrame([("g1", "32619", "x")], "grid_id STRING, epsg STRING, surplus STRING")
    store.write("grids", old)
    row = store.read("grids").first()
    assert (row["grid_id"], row["epsg"], row["crs_wkt"]) == ("g1", 32619, None) and "surplus" not in row.asDict()


def test_stale_grids(spark):
    grids = spark.createDataFrame([("hls_mgrs_30m", None), ("hls_mgrs_30m_epsg1_x", 1), ("hls_mgrs_30m_used", None), ("other", None)], "grid_id STRING, epsg INT")
    assets = spark.createDataFrame([("hls_mgrs_30m_used",)], "grid_id STRING")
    assert {r["grid_id"] for r in registry.drop_stale_grids(grids, assets).collect()} == {"hls_mgrs_30m_epsg1_x", "hls_mgrs_30m_used", "other"}


def test_audit_ignores_junk(spark):
    assets = spark.createDataFrame([("source/a/1.tif",), ("source/a/2.tif",)], "local_path STRING")
    paths = ["source/a/1.tif", "source/a/._1.tif", "source/a/.DS_Store", "source/a/metadata.json", "source/a/3.tif.part", "source/a/4.tif", "cache/5.tif"]
    files = spark.createDataFrame([(p,) for p in paths], "path STRING")
    assert [r["path"] for r in audit.missing_assets(assets, files).collect()] == ["source/a/2.tif"]
    assert [r["path"] for r in audit.unregistered_files(assets, files).collect()] == ["source/a/4.tif"]


def test_normalize_json(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, ""), (3, "not json"), (4, None)], "id INT, bbox_json STRING")
    out = catalog.normalize_json(df, ["bbox_json"]).select("id", F.to_json("bbox").alias("v"))
    assert {r["id"]: r["v"] for r in out.collect()} == {1: '{"a":1}', 2: None, 3: '"not json"', 4: None}


def test_materialize_reads_back(spark):
    df = spark.createDataFrame([(1, [1.0, None], {"a": "b"})], "x INT, y ARRAY<DOUBLE>, z MAP<STRING, STRING>")
    assert materialize(df).collect() == df.collect()


def test_audit_by_range_joins_what_differs(spark):
    """Nearly equal sides: same rows as a whole join, and only folders whose digests differ reach it."""
    paths = spark.range(5000).select(F.format_string("source/d%03d/%05d.tif", F.col("id") % 500, "id").alias("path"))
    gone = F.col("path").startswith("source/d007/") | (F.col("path") == "source/d009/00009.tif")
    files = paths.filter(~gone).unionByName(spark.createDataFrame([("source/new/1.tif",), ("source/d011/.DS_Store",)], "path STRING"))
    assets = paths.withColumnRenamed("path", "local_path")
    assets = assets.unionByName(spark.createDataFrame([("",), (None,), ("source/d020/00020.tif",)], "local_path STRING"))
    for find in (audit.missing_assets, audit.unregistered_files, audit.path_audit):
        assert sorted(find(assets, files, by_range=True).collect()) == sorted(find(assets, files).collect())
    assert audit.path_audit(assets, files, by_range=True).first()[:] == (11, 1)
    left, right = audit.differing(paths, files)
    assert left.count() == 30 and right.count() == 9 + 1 + 11  # the folders d007, d009, d011 and new; junk is a path here
    same = audit.differing(paths, paths.repartition(7))
    assert [side.count() for side in same] == [0, 0]
    x, y = (spark.createDataFrame([(p,)] * 2 + [(None,)], "path STRING") for p in ("a/x", "a/y"))
    assert [r["path"] for r in audit.path_except(x, y, by_range=True).collect()] == ["a/x"]
    assert [r["path"] for r in audit.path_except(x, y.filter("path IS NOT NULL"), by_range=True).orderBy("path").collect()] == [None, "a/x"]
    assert audit.path_except(x, x, by_range=True).isEmpty() and audit.path_except(x.limit(0), y, by_range=True).isEmpty()


def test_assets_are_folded_where_the_join_left_them(spark):
    """Two shuffles for the join and none for the fold, which is keyed by what the ids are made of."""
    from terraspan.plans.views import Views
    from terraspan.session import settings

    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        folded = Views(spark, "/root/testdata/sf0.001").assets("local_path", "status", "byte_size")
        plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_files_whose_grid_changes_keep_both_grids(spark):
    """Grids come from the folded files while each has one, else from all deliveries."""
    one, other = delivery(spark), delivery(spark, seq=2, registered_at="2024-01-03T00:00:00Z", raster={**GRID, "width": 5})
    again = delivery(spark, seq=3, registered_at="2024-01-04T00:00:00Z")
    grids = registry.register(one.unionByName(other).unionByName(again))["grids"].collect()
    assert sorted((r["tile_width"], r["created_at"][:10], r["updated_at"][:10]) for r in grids) == [(2, "2024-01-02", "2024-01-04"), (5, "2024-01-03", "2024-01-03")]
    grid = registry.register(one.unionByName(again))["grids"].collect()
    assert [(r["tile_width"], r["created_at"][:10], r["updated_at"][:10]) for r in grid] == [(2, "2024-01-02", "2024-01-04")]


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    from terraspan.session import settings

    rows = spark.range(0, 60_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("asset_id"), F.lit("p").alias("product_id"), F.lit("one").alias("source_item_id"))
    store = RegistryStore(spark, str(tmp_path))
    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}):
        store.write("assets", rows)
    (folder,) = store.manifest("assets")["parts"].values()
    assert len([f for f in os.listdir(f"{tmp_path}/assets/{folder}") if f.endswith(".parquet")]) > 1
    assert store.read("assets").select("asset_id").distinct().count() == 60_000


def test_registration_writes_kinds_of_files_not_files(spark, monkeypatch):
    """The fold of wide deliveries stays a plan; of the assets only the asked columns travel through it."""
    written = []
    monkeypatch.setattr(registry, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    many = delivery(spark).drop("item_id").crossJoin(spark.range(40).select(F.concat(F.lit("granule-"), "id").alias("item_id")))
    made = registry.register(many, asset_columns=("created_at", "updated_at"))
    assert [df.count() for df in written] == [1]
    whole = registry.register(many)["assets"]
    columns = ["asset_id", "created_at", "updated_at"]
    assert sorted(made["assets"].select(columns).collect()) == sorted(whole.select(columns).collect()) and whole.count() == 40
    exchange = made["assets"].select(columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "checksum_sha256" not in exchange.split("Aggregate")[1].splitlines()[0]


def test_merge_into_an_absent_table_joins_nothing(spark, tmp_path):
    rows = registry.conform(spark.range(3).select(F.col("id").cast("string").alias("asset_id")), "assets")
    merged = registry.merge_registries({"assets": RegistryStore(spark, str(tmp_path)).read("assets")}, {"assets": rows})["assets"]
    assert merged.count() == 3 and "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_run_digests_count_a_repeated_pair_once_and_shuffle_once(spark):
    ids = ["p7", "b" * 64, "0a" * 32, "c", "b" * 64, "p7"]
    made = registry.run_digests(spark.createDataFrame([("r", i) for i in ids] + [("s", "b" * 64)], "run_id string, asset_id string"))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = {r.run_id: (r.output_count, r.checksum) for r in made.collect()}
    assert rows == {"r": (4, hashlib.sha256("\n".join(sorted(set(ids))).encode()).hexdigest()), "s": (1, hashlib.sha256(b"b" * 64).hexdigest())}


def test_sidecars_meet_files_before_the_wide_assets(spark):
    from terraspan.schemas import ITEM_DDL

    names = "asset_id string, product_id string, source_item_id string, asset_key string, source_url string, local_path string, status string, run_id string, datetime string, updated_at string"
    paths = {"odd": "lone.tif", "0a" * 32: "source/nasa/c/i/a.tif", "top": "/root.tif", "none": "source/nasa/c/j/b.tif"}
    assets = spark.createDataFrame([(i, "p", "own", "k", "u", p, "s", "r", "d", "t") for i, p in paths.items()], names)
    files = spark.createDataFrame([(p, n, "c") for n, p in enumerate(paths.values())], "path string, byte_size bigint, checksum_sha256 string")
    files = files.withColumn("raster", F.lit(None).cast(RASTER_DDL))
    item = F.from_json(F.lit('{"id":"i1"}'), ITEM_DDL)
    sidecars = spark.createDataFrame([("source/nasa/c/i",), ("",)], "parent string").withColumn("item", item)
    products = spark.createDataFrame([("p", "c")], "product_id string, collection_id string")
    none = spark.createDataFrame([], "collection string, collection_metadata string")
    made = registry.reindex(assets, products, files, sidecars, none, "now")
    rows = {r.seq.asset_id: (r.local_path, r.item_id, r.byte_size) for r in made.collect()}
    assert rows == {"odd": ("lone.tif", "own", 0), "0a" * 32: (paths["0a" * 32], "i1", 1), "top": ("/root.tif", "i1", 2), "none": (paths["none"], "own", 3)}
    assert "_rest" in made._jdf.queryExecution().optimizedPlan().toString()


def test_reindex_rewrites_assets_where_they_lie(spark):
    """As registering and merging all deliveries, but only ids with several claims are shuffled again."""
    from terraspan.schemas import ITEM_DDL

    def stored(*names):
        rows = spark.createDataFrame([(i,) for i in names], "source_item_id string").withColumns(
            {"asset_key": F.lit("B04"), "source_url": F.concat(F.lit("https://example/"), "source_item_id"), "local_path": F.concat(F.lit("source/nasa/c/"), "source_item_id", F.lit("/a.tif")),
             **{c: F.lit(v) for c, v in {"product_id": "p", "grid_id": "c_native", "byte_size": 99, "status": "downloaded", "run_id": "run-1", "datetime": "2024", "created_at": "2025", "updated_at": "2026"}.items()}})
        identity = F.concat_ws("|", F.lit("nasa"), F.lit("C"), "source_item_id", "asset_key", "source_url")
        return registry.conform(rows.withColumns({"asset_id": F.sha2(identity, 256), "checksum_sha256": F.when(F.col("source_item_id") < "m", "cd" * 32)}), "assets")

    held = stored("held").withColumns({"asset_id": F.sha2(F.lit("nasa|C|unknown|B04|https://example/nameless"), 256), "run_id": F.lit("first")})
    odd, lost = stored("odd").withColumn("asset_id", F.lit("not a digest")), stored("lost").withColumn("local_path", F.lit(None).cast("string"))
    start = {**registry.empty_registries(spark), "products": registry.conform(spark.createDataFrame([("p", "C")], "product_id string, collection_id string"), "products")}
    names = ["plain", "dated", "nameless", "twice", "twice", "odd", "held", "new"]
    files = spark.createDataFrame([(f"source/nasa/c/{i}/a.tif", names.index(i), "ab" * 32 if i < "m" else None) for i in names], "path string, byte_size bigint, checksum_sha256 string")
    files = files.withColumn("raster", F.from_json(F.when(F.col("byte_size") < 3, json.dumps(GRID)), RASTER_DDL))
    items = {"dated": '{"id":"dated","properties":{"datetime":"2030"},"bbox":[1,2,3,4]}', "nameless": "{}", "twice": '{"id":"other","collection":"d"}', "held": None}
    sidecars = spark.createDataFrame([(f"source/nasa/c/{i}", t) for i, t in items.items()], "parent string, value string").select("parent", F.from_json("value", ITEM_DDL).alias("item"))
    records = spark.createDataFrame([("d", "about d")], "collection string, collection_metadata string")

    start["assets"] = materialize(stored("plain", "gone", "dated", "nameless", "twice").unionByName(odd).unionByName(lost).unionByName(held))
    made = registry.rebuild(start, files, sidecars, records, "2031")
    want = registry.merge_registries(start, registry.register(registry.reindex(start["assets"], start["products"], files, sidecars, records, "2031")))
    for table in ("assets", "products"):
        assert sorted(map(str, made[table].collect())) == sorted(map(str, want[table].collect())), table
    assert made["assets"].count() == 11  # new ids: of the file listed twice, of the odd and the held one; the file without a name meets the held id
    start["assets"] = materialize(stored("plain", "gone", "nameless"))
    single = registry.rebuild(start, files, sidecars, records, "2031")["assets"]
    assert single.count() == 4 and "Exchange" not in single._jdf.queryExecution().executedPlan().toString()


def test_assets_are_dealt_by_path_while_narrow(spark):
    """A join by path shuffles the assets before their names and ids are made, and not again."""
    from terraspan.plans.views import Views
    from terraspan.session import settings

    v = Views(spark, "/root/testdata/sf0.001")
    columns = ["local_path", "source_url", "status", "updated_at"]
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        met = v.assets(*columns, by_path=True).join(v.files().select(F.col("path").alias("local_path")).distinct(), "local_path")
        plan = met._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("REPARTITION_BY_COL")
    assert "https://example/" in before and "https://example/" not in after and before.count("Exchange") == 1
    without = v.assets(*columns).join(v.files().select(F.col("path").alias("local_path")).distinct(), "local_path")
    assert sorted(met.collect()) == sorted(without.collect())
