"""Queries over real files, which executors write from the tables below the scratch folder."""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir, settings
from ..sources import inventory, pages, raster_headers
from .base import query
from .views import Views


def _written(v: Views, rows: DataFrame, encode: Callable[[str], bytes] = str.encode) -> str:
    """Write each row (path, content) to a file of its own in a new shared folder; returns the folder."""
    root = re.sub(r"^file:/+", "/", f"{scratch_dir(v.spark)}/{uuid.uuid4().hex}")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out = open(f"{root}/{path}", "wb", buffering=0)
                except FileNotFoundError:  # the first file of a folder
                    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                    out = open(f"{root}/{path}", "wb", buffering=0)
                with io.BufferedWriter(out) as whole:
                    whole.write(encode(content))
            yield pd.DataFrame({"n": [len(batch)]})

    # a table of one row group would be one task; small batches, as contents may be long
    with settings(v.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}):
        inventory.dealt(rows.select("path", "content"), inventory.SMALL_FILES_PER_TASK).mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    return root


def _page_files(v: Views) -> DataFrame:
    """Pages as files of ten folders, some with names that listings like to hide, some junk."""
    k = F.col("page_id")
    name = F.concat(
        F.when(k % 7 == 1, "._").when(k % 7 == 2, ".").when(k % 7 == 3, "_").otherwise(""), k.cast("string"), F.when(k % 2 == 0, ".HTML").otherwise(".htm")
    )
    return v.table("pages").select(F.concat_ws("/", F.lit("source"), (k % 10).cast("string"), name).alias("path"), F.col("html").alias("content"))


_PAGE_FILES = """
    f AS (SELECT 'source/' || page_id % 10 || '/' || CASE page_id % 7 WHEN 1 THEN '._' WHEN 2 THEN '.' WHEN 3 THEN '_' ELSE '' END || page_id
                 || CASE WHEN page_id % 2 = 0 THEN '.HTML' ELSE '.htm' END AS path, html, page_id FROM pages WHERE page_id % 7 <> 1)"""


@query("s08_inventory", f"""
    WITH {_PAGE_FILES.strip()}
    SELECT path, 'file' AS kind, CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.htm' END AS suffix, strlen(html) AS byte_size FROM f
    UNION ALL SELECT DISTINCT 'source/' || page_id % 10, 'directory', NULL, NULL FROM pages
    UNION ALL SELECT 'source', 'directory', NULL, NULL UNION ALL SELECT 'source/loop', 'link', NULL, NULL""")
def s08(v: Views):
    """A whole listing: hidden names are there, junk is not, a link back to the top is not entered."""
    root = _written(v, _page_files(v))
    os.symlink(root, f"{root}/source/loop")
    return inventory.inventory(v.spark, root).select("path", "kind", "suffix", "byte_size")


@query("s12_checksums", f"WITH {_PAGE_FILES.strip()} SELECT path, sha256(html) AS checksum_sha256 FROM f")
def s12(v: Views):
    root = _written(v, _page_files(v))
    return inventory.checksums(inventory.inventory(v.spark, root).filter("kind = 'file'"), root)


@query("s06_sidecars", """
    SELECT 'source/nasa/c/' || c_custkey AS parent, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS id,
           CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS datetime FROM customer""")
def s06(v: Views):
    """Sidecars of every scene: a whole document, a broken one, and one that is no object."""
    k = F.col("c_custkey")
    whole = F.to_json(F.struct(F.col("c_name").alias("id"), F.lit("c").alias("collection"), F.struct(F.col("c_mktsegment").alias("datetime")).alias("properties")))
    content = F.when(k % 3 == 0, whole).when(k % 3 == 1, F.lit("{broken")).otherwise(F.lit("[1]"))
    root = _written(v, v.table("customer").select(F.concat(F.lit("source/nasa/c/"), k, F.lit("/metadata.json")).alias("path"), content.alias("content")))
    item = F.col("item")
    return pages.read_sidecars(v.spark, root).select("parent", item["id"].alias("id"), item["properties"]["datetime"].alias("datetime"))


def _store_files(v: Views) -> DataFrame:
    """A store for each customer: named only, marked only, or both with chunks in a folder."""
    k = F.col("c_custkey")
    key = k.cast("string")
    chunk = F.repeat(F.lit("x"), (k % 7 + 1).cast("int"))

    def file(path: Column, content: Column) -> Column:
        return F.struct(path.alias("path"), content.alias("content"))

    files = (
        F.when(k % 3 == 0, F.array(file(F.concat(F.lit("arrays/a/"), key, F.lit(".zarr/0.0")), chunk)))
        .when(k % 3 == 1, F.array(file(F.concat(F.lit("arrays/b/"), key, F.lit("/zarr.json")), F.lit('{"zarr_format":3}'))))
        .otherwise(F.array(
            file(F.concat(F.lit("arrays/c/"), key, F.lit(".zarr/.zgroup")), F.lit("{")),
            file(F.concat(F.lit("arrays/c/"), key, F.lit(".zarr/t/0")), chunk), file(F.concat(F.lit("arrays/c/"), key, F.lit(".zarr/t/1")), chunk),
        ))
    )
    return v.table("customer").select(F.explode(files).alias("f")).select("f.path", "f.content")


_STORES = """
    SELECT CASE c_custkey % 3 WHEN 0 THEN 'arrays/a/' || c_custkey || '.zarr' WHEN 1 THEN 'arrays/b/' || c_custkey ELSE 'arrays/c/' || c_custkey || '.zarr' END AS path,
           [1, 1, 3][c_custkey % 3 + 1] AS file_count, [0, 0, 1][c_custkey % 3 + 1] AS directory_count,
           [c_custkey % 7 + 1, 17, 2 * (c_custkey % 7 + 1) + 1][c_custkey % 3 + 1] AS byte_size,
           [NULL, '{"zarr_format":3}', '{"error": "metadata could not be read"}'][c_custkey % 3 + 1] AS document
    FROM customer"""


@query("s10_array_stores", _STORES)
def s10(v: Views):
    found = inventory.array_stores(v.spark, _written(v, _store_files(v)))
    document = F.coalesce(F.element_at("metadata", F.lit("zarr.json")), F.element_at("metadata", F.lit(".zgroup")))
    return found.select("path", "file_count", "directory_count", "byte_size", document.alias("document"))


@query("u07_candidates", f"SELECT path, split_part(path, '/', 3) AS name FROM ({_STORES})")
def u07(v: Views):
    """Candidates by name and candidates by marker, once each."""
    return inventory.array_stores(v.spark, _written(v, _store_files(v))).select("path", "name")


def _geotiff(text: str) -> bytes:
    """Header and directory of a small GeoTIFF from "width height epsg x y"; other texts as they are."""
    parts = text.split()
    if len(parts) != 5:
        return text.encode()
    width, height, epsg, x, y = map(int, parts)
    doubles = struct.pack("<9d", 30.0, 30.0, 0.0, 0.0, 0.0, 0.0, float(x), float(y), 0.0)
    keys = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, epsg)
    start = 8 + 2 + 8 * 12 + 4
    entries = [(256, 3, 1, width), (257, 3, 1, height), (258, 3, 1, 16), (277, 3, 1, 1), (339, 3, 1, 1), (33550, 12, 3, start), (33922, 12, 6, start + 24), (34735, 3, 8, start + 72)]
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + bytes(4) + doubles + keys


@query("s11_headers", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN 100 + c_custkey % 900 END AS width, CASE WHEN c_custkey % 5 > 0 THEN 200 END AS height,
           CASE WHEN c_custkey % 5 > 0 THEN 32601 + c_nationkey END AS epsg, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey * 10)::DOUBLE END AS x_origin,
           CASE WHEN c_custkey % 5 > 0 THEN 5000000.0::DOUBLE - 30 * 200 END AS bottom, CASE WHEN c_custkey % 5 > 0 THEN 'uint16' END AS dtype, NULL::VARCHAR AS crs_wkt
    FROM customer""")
def s11(v: Views):
    """Headers of hand-made GeoTIFFs, a thousand in a folder, as one folder takes one new file at a time; every fifth file is none."""
    k = F.col("c_custkey")
    content = F.when(k % 5 == 0, F.lit("no raster")).otherwise(F.concat_ws(" ", (k % 900 + 100), F.lit(200), F.col("c_nationkey") + 32601, k * 10, F.lit(5_000_000)))
    rows = v.table("customer").select(F.concat(F.lit("source/"), F.floor(k / 1000), F.lit("/"), k, F.lit(".tif")).alias("path"), content.alias("content"))
    found = raster_headers.raster_headers(rows.select("path"), _written(v, rows, _geotiff))
    r = F.col("raster")
    return found.select(
        F.regexp_extract("path", "([0-9]+)[.]tif$", 1).cast("bigint").alias("c_custkey"), r["width"].alias("width"), r["height"].alias("height"), r["epsg"].alias("epsg"),
        r["x_origin"].alias("x_origin"), r["bounds"][1].alias("bottom"), r["dtype"].alias("dtype"), r["crs_wkt"].alias("crs_wkt"),
    )
