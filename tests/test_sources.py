"""Files on disk: listings, digests, headers, pages, sidecars, sinks."""

import hashlib
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from terraspan.operators import audit, ingest, planning
from terraspan.sources import catalog_tree, features, inventory, page_files, pages
from terraspan.sources.raster_headers import raster_headers


def tiff(path, width, height, bits, sample_format, scale, origin, geo_keys, nodata=None, xml=None, order="<", big=False):
    """A GeoTIFF with only a header and directory; enough for everything but the pixels."""
    entries = []

    def add(tag, kind, values):
        code = {3: "H", 4: "I", 12: "d", 16: "Q"}.get(kind)
        data = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{code}", *values)
        entries.append((tag, kind, len(values), data))

    for tag, value in ((256, width), (257, height), (258, bits), (277, 1), (339, sample_format)):
        add(tag, 3, [value])
    add(33550, 12, [scale, scale, 0.0])
    add(33922, 12, [0.0, 0.0, 0.0, origin[0], origin[1], 0.0])
    add(34735, 3, [1, 1, 0, len(geo_keys)] + [v for k, val in geo_keys for v in (k, 0, 1, val)])
    if xml:
        add(42112, 2, xml.encode() + b"\0")
    if nodata is not None:
        add(42113, 2, nodata.encode() + b"\0")
    inline, entry, off = (8, 20, "Q") if big else (4, 12, "I")
    head = 16 if big else 8
    body = struct.pack(order + ("Q" if big else "H"), len(entries))
    where = head + len(body) + entry * len(entries) + inline
    tail = b""
    for tag, kind, count, data in entries:
        body += struct.pack(f"{order}HH{off}", tag, kind, count)
        if len(data) <= inline:
            body += data.ljust(inline, b"\0")
        else:
            body += struct.pack(order + off, where + len(tail))
            tail += data
    body += b"\0" * inline
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(start + body + tail)


def put(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data)


def test_inventory_and_checksums(spark, tmp_path):
    root = str(tmp_path)
    put(f"{root}/source/nasa/c/i/a.tif", b"abc")
    put(f"{root}/source/nasa/c/i/._a.tif")
    put(f"{root}/source/nasa/c/i/.DS_Store")
    put(f"{root}/source/nasa/c/i/_underscore.NC", b"12345")
    put(f"{root}/cache/p.png")
    os.makedirs(f"{root}/entities/empty")
    files = inventory.inventory(spark, root)
    rows = {r["path"]: r for r in files.collect()}
    assert set(rows) == {"source", "source/nasa", "source/nasa/c", "source/nasa/c/i", "source/nasa/c/i/a.tif", "source/nasa/c/i/_underscore.NC",
                         "cache", "cache/p.png", "entities", "entities/empty"}
    assert rows["source/nasa/c/i/_underscore.NC"]["suffix"] == ".nc" and rows["source/nasa/c/i/a.tif"]["byte_size"] == 3
    layers = {r["layer"]: (r["file_count"], r["directory_count"], r["byte_size"]) for r in audit.layer_scan(files).collect()}
    assert layers["source"] == (2, 3, 8) and layers["entities"] == (0, 1, 0) and layers["virtual"] == (0, 0, 0)
    assert [r["path"] for r in audit.list_layer(files, "source", 3).collect()] == ["source/nasa", "source/nasa/c", "source/nasa/c/i"]
    sums = {r["path"]: r["checksum_sha256"] for r in inventory.checksums(files.filter("kind = 'file'"), root).collect()}
    assert sums["source/nasa/c/i/a.tif"] == hashlib.sha256(b"abc").hexdigest() and len(sums) == 3
    assert inventory.inventory(spark, f"{root}/absent").count() == 0
    os.symlink(root, f"{root}/entities/loop")
    os.symlink(f"{root}/source/nasa/c/i/a.tif", f"{root}/entities/file.tif")
    os.symlink(f"{root}/nowhere", f"{root}/entities/dangling")
    kinds = {r["path"]: r["kind"] for r in inventory.inventory(spark, root, "entities").collect()}
    assert kinds == {"entities/empty": "directory", "entities/loop": "link", "entities/file.tif": "file"}
    assert list(inventory._entries(f"{root}/gone")) == []


def test_raster_headers(spark, tmp_path):
    root = str(tmp_path)
    tiff(f"{root}/a.tif", 2, 3, 16, 2, 30.0, (500000.0, 5500000.0), [(1024, 1), (1025, 1), (3072, 32619)], "-9999")
    xml = '<GDALMetadata><Item name="Fmask bit description">bits</Item><Item name="x" sample="0" role="description">band one</Item></GDALMetadata>'
    tiff(f"{root}/b.tif", 1, 1, 8, 1, 30.0, (500000.0, 5500000.0), [(3072, 32619)], "255", xml, order=">")
    tiff(f"{root}/c.tif", 4, 3, 16, 1, 0.01, (-101.0, 41.0), [(2048, 4326)], "0", big=True)
    put(f"{root}/bad.tif", b"II*\0garbage")
    put(f"{root}/text.tif", b"hello")
    files = spark.createDataFrame([(n,) for n in ("a.tif", "b.tif", "c.tif", "bad.tif", "text.tif", "absent.tif")], "path STRING")
    got = {r["path"]: r["raster"] for r in raster_headers(files, root).collect()}
    a = got["a.tif"]
    assert (a["epsg"], a["width"], a["height"], a["dtype"], a["nodata"], a["x_origin"], a["pixel_size_y"]) == (32619, 2, 3, "int16", "-9999.0", 500000.0, -30.0)
    assert a["transform"] == [30.0, 0.0, 500000.0, 0.0, -30.0, 5500000.0] and a["bounds"] == [500000.0, 5499910.0, 500060.0, 5500000.0]
    assert a["tags"] == {"AREA_OR_POINT": "Area"}
    b = got["b.tif"]
    assert (b["dtype"], b["nodata"], b["description"], b["tags"]) == ("uint8", "255.0", "band one", {"Fmask bit description": "bits"})
    assert (got["c.tif"]["epsg"], got["c.tif"]["dtype"]) == (4326, "uint16")
    assert got["bad.tif"] is None and got["text.tif"] is None and got["absent.tif"] is None


def test_array_stores(spark, tmp_path):
    root = str(tmp_path)
    put(f"{root}/arrays/x/a.zarr/.zgroup", b'{"zarr_format": 2}')
    put(f"{root}/arrays/x/a.zarr/t/0.0", b"1234")
    put(f"{root}/arrays/b/zarr.json", b"{broken")
    os.makedirs(f"{root}/arrays/c.zarr")
    put(f"{root}/arrays/plain/file")
    rows = {r["path"]: r for r in inventory.array_stores(spark, root).collect()}
    assert set(rows) == {"arrays/x/a.zarr", "arrays/b", "arrays/c.zarr"}
    a = rows["arrays/x/a.zarr"]
    assert (a["file_count"], a["directory_count"], a["byte_size"]) == (2, 1, 22) and json.loads(a["metadata"][".zgroup"]) == {"zarr_format": 2}
    assert json.loads(rows["arrays/b"]["metadata"]["zarr.json"]) == {"error": "metadata could not be read"}
    assert rows["arrays/c.zarr"]["file_count"] == 0 and rows["arrays/c.zarr"]["metadata"] == {}
    assert inventory.array_stores(spark, f"{root}/none").count() == 0


ITEMS = "run_id STRING, page_number INT, position BIGINT, id STRING, collection STRING, assets MAP<STRING, STRUCT<href: STRING, roles: ARRAY<STRING>>>"


def page_rows(spark):
    asset = lambda n: {f"B0{k}": (f"https://example/{n}.B0{k}.tif", ["data"]) for k in range(n, n + 1)}
    two = {"B04": ("https://example/2.B04.tif", ["data"]), "Fmask": ("https://example/2.Fmask.tif", ["data"])}
    rows = [("r1", 1, 0, "i1", "HLSL30_V2.0", {"B04": ("https://example/1.B04.tif", ["data"])}), ("r1", 2, 0, "i2", "HLSL30_V2.0", two),
            ("r1", 2, 1, "i1", "HLSL30_V2.0", asset(5))]
    return spark.createDataFrame(rows, ITEMS)


def test_pages_round_trip_and_plan(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages.write_pages(page_rows(spark), path)
    items = pages.read_pages(spark, path)
    got = [(r["run_id"], r["page_number"], r["position"], r["id"]) for r in items.orderBy("page_number", "position").collect()]
    assert got == [("r1", 1, 0, "i1"), ("r1", 2, 0, "i2"), ("r1", 2, 1, "i1")]
    assert pages.page_checksums(spark, path).count() == 2
    found = ingest.discover_items(items.withColumn("catalog", F.lit("nasa")).withColumnRenamed("id", "source_item_id"))
    assert found.count() == 2
    jobs = planning.explode_assets(found, only_main=False, keep=["run_id", "page_number"])
    plan = planning.plan_batches(jobs, 2)
    sizes = [r["count"] for r in plan.groupBy("batch_number").count().orderBy("batch_number").collect()]
    assert sizes == [2, 1] and plan.select("attempt_id").distinct().count() == 3


def test_pages_written_again_replace_the_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages.write_pages(page_rows(spark), path, file_bytes=1)  # a file for each page
    pages.write_pages(page_rows(spark).filter("page_number = 2 AND position = 0"), path)
    got = [(r["page_number"], r["position"], r["id"]) for r in pages.read_pages(spark, path).orderBy("page_number", "position").collect()]
    assert got == [(1, 0, "i1"), (2, 0, "i2")]
    assert pages.page_checksums(spark, path).select("path").distinct().count() == 3


def test_a_failed_write_leaves_nothing_to_see(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages.write_pages(page_rows(spark).filter("page_number = 1"), path)
    before = sorted(os.listdir(f"{path}/data"))
    bad = page_rows(spark).withColumn("id", F.when(F.col("page_number") == 2, F.raise_error("broken")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        pages.write_pages(bad, path)
    assert sorted(os.listdir(f"{path}/data")) == before and os.listdir(f"{path}/_commits") == ["000000000001.json"]
    assert [r["page_number"] for r in pages.read_pages(spark, path).collect()] == [1]


def test_page_ranges_inside_a_file(tmp_path):
    packer = page_files._Packer(str(tmp_path), page_files.file_system(str(tmp_path))[0], 1 << 20)
    for page in range(20):
        packer.add("r", page, [f'{{"id":"{page}.{i}"}}' for i in range(3)])
    packer.close()
    writer = page_files.PageWriter(str(tmp_path), 1 << 20)
    writer.commit([page_files.Written(packer.files), None])
    size = packer.files[0][2]
    parts = page_files.PageReader(str(tmp_path), size // 4, False).partitions()
    read = [[v for b in page_files._read_pages(str(tmp_path), p) for v in b.column("value").to_pylist()] for p in parts]
    assert len(parts) > 2 and sum(read, []) == [f'{{"id":"{page}.{i}"}}' for page in range(20) for i in range(3)]
    assert page_files.PageReader(str(tmp_path / "none"), 100, False).partitions()[0].value == []


def test_sidecars(spark, tmp_path):
    root = str(tmp_path)
    put(f"{root}/source/n/c/i1/metadata.json", json.dumps({"id": "i1", "collection": "c", "properties": {"datetime": "d"}}).encode())
    put(f"{root}/source/n/c/i2/metadata.json", b"{broken")
    put(f"{root}/source/n/c/i3/metadata.json", b"[1]")
    rows = {r["parent"]: r["item"] for r in pages.read_sidecars(spark, root).collect()}
    assert rows["source/n/c/i1"]["properties"]["datetime"] == "d" and rows["source/n/c/i2"] is None and rows["source/n/c/i3"] is None


def test_files_are_dealt_to_many_tasks(spark, tmp_path):
    """A table of one row group is one task; its files are not."""
    from terraspan.plans.file_queries import _written
    from terraspan.plans.views import Views

    spark.range(0, 2500, 1, 1).select(F.concat_ws("/", F.lit("d"), "id", F.lit("metadata.json")).alias("path")).write.parquet(str(tmp_path / "t"))
    paths = spark.read.parquet(str(tmp_path / "t"))
    assert paths.rdd.getNumPartitions() == 1 and inventory.dealt(paths).rdd.getNumPartitions() == 5
    root = _written(Views(spark, str(tmp_path)), paths.withColumn("content", F.concat(F.lit('{"id":"'), "path", F.lit('"}'))))
    docs = pages.read_sidecars(spark, root)
    assert docs.rdd.getNumPartitions() >= 5
    rows = docs.select("parent", "item.id").collect()
    assert len(rows) == 2500 and all(r["id"] == f"{r['parent']}/metadata.json" for r in rows)


def test_item_files_fold_equal_short_keys(spark):
    head = "'c' AS catalog, 'col' AS collection, 'r' AS run_id, 'm' AS media_type, 'big' AS source_item_id, 's' AS checksum_sha256"
    df = spark.range(0, 3000).selectExpr("concat('x', id % 2, '/k', id div 2) AS asset_key", "concat('p', id) AS local_path", "concat('a', id) AS asset_id", *head.split(", "))
    files = {r["key"]: r["asset"]["href"] for r in catalog_tree.item_files(df).collect()}
    assert len(files) == 1500 and files["k7"] == "p15"


def test_catalog_tree_and_features(spark, tmp_path):
    from test_registry import delivery

    from terraspan.functions.geometry import geometry_json
    from terraspan.operators import registry, spatial

    made = registry.register(delivery(spark))
    assets = made["assets"].withColumns({"catalog": F.lit("nasa"), "collection": F.lit("HLSL30_V2.0"), "geometry": geometry_json(F.col("geometry"))})
    catalog_tree.write_catalog_tree(assets, made["products"], str(tmp_path / "stac"))
    item = json.loads(spark.read.text(str(tmp_path / "stac/items")).first()["value"])
    file = json.loads(spark.read.text(str(tmp_path / "stac/files")).first()["value"])
    assert item["id"] == file["item"] == "granule-1" and file["key"] == "B04" and file["asset"]["lake:asset_id"] == made["assets"].first()["asset_id"]
    assert json.loads(spark.read.text(str(tmp_path / "stac/collections")).first()["value"])["id"] == "hlsl30_v2.0"
    rows = spatial.spatial_features(made["assets"])
    features.write_features(rows, str(tmp_path / "features"))
    feature = json.loads(spark.read.text(str(tmp_path / "features")).first()["value"])
    assert feature["properties"]["geometry_source"] == "raster_grid" and len(feature["geometry"]["coordinates"][0]) == 5
    assert feature["properties"]["previewable"] is True


def test_few_folders_are_listed_by_a_task_each(spark, tmp_path):
    for name in "abc":
        os.makedirs(tmp_path / "arrays" / name / "k.zarr")
    assert [inventory.listing_tasks(n) for n in (1, 3, 64, 65, 1_000_000, 10_000_000)] == [1, 3, 64, 64, 500, 1024]
    found = inventory.inventory(spark, str(tmp_path), "arrays")
    assert sorted(r.path for r in found.collect()) == sorted([*(f"arrays/{n}" for n in "abc"), *(f"arrays/{n}/k.zarr" for n in "abc")])
    paths = spark.range(4_000).select(F.col("id").cast("string").alias("path"))
    assert inventory.dealt(paths, inventory.SMALL_FILES_PER_TASK).rdd.getNumPartitions() == 2


def test_headers_of_many_small_files_take_few_tasks(spark, tmp_path):
    spark.range(0, 2500, 1, 1).select(F.concat(F.lit("source/0/"), "id", F.lit(".tif")).alias("path")).write.parquet(str(tmp_path / "t"))
    found = raster_headers(spark.read.parquet(str(tmp_path / "t")), str(tmp_path))
    assert found.rdd.getNumPartitions() == 2 and found.filter("raster IS NULL").count() == 2500


def test_item_files_keep_odd_paths_and_digests(spark):
    rows = [("B1", "0a" * 32, "source/n/c/i/x.tif", "ab" * 32), ("B2", "odd", "elsewhere/y.tif", "no digest"), ("B3", "ff" * 32, None, None)]
    df = spark.createDataFrame(rows, "asset_key string, asset_id string, local_path string, checksum_sha256 string").withColumns(
        {"catalog": F.lit("n"), "collection": F.lit("c"), "source_item_id": F.lit("i"), "run_id": F.lit("r"), "media_type": F.lit("m")}
    )
    made = catalog_tree.item_files(df)
    back = [(r.key, r.asset["lake:asset_id"], r.asset["href"], r.asset["lake:checksum_sha256"]) for r in made.orderBy("key").collect()]
    assert back == rows and "max(_row" in made._jdf.queryExecution().analyzed().toString()  # each id travels once


def test_lines_are_dealt_by_rows_whatever_they_shrink_to(spark, tmp_path):
    from terraspan.plans.views import Views

    spark.range(0, 2500, 1, 1).select(F.lit(7).alias("l_partkey"), (F.col("id") % 50).alias("l_orderkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    lines = Views(spark, str(tmp_path)).lines_by_order(rows=500)
    assert lines.rdd.getNumPartitions() == 5 and lines.count() == 2500


def test_page_ends_of_a_batch():
    import pyarrow as pa

    runs = pa.array(["a", "a", "b", "b", None, None, "c"])
    numbers = pa.array([1, 1, 1, 2, 2, None, None], pa.int32())
    assert page_files._page_ends(runs, numbers) == [2, 3, 4, 5, 6]
    assert page_files._page_ends(runs[:1], numbers[:1]) == [] == page_files._page_ends(runs[:0], numbers[:0])
