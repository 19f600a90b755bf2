"""Queries over items, pages, attempts and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import progress as pg
from ..functions import text
from ..operators import audit, catalog, ingest, planning, runs
from ..schemas import GRANULE_RESPONSE_DDL
from ..session import scratch_dir
from ..sources import pages
from ..sources.registry_store import RegistryStore, part_of
from ..streaming import ingest as ingest_stream
from ..streaming import progress as live
from .base import query
from .views import DEALT_BY, Views

SIGHTING_ORDER = ("page_number", "l_partkey", "l_suppkey", "arrived_at")


# ---- items -------------------------------------------------------------------


@query("e03_item_assets_explode", """
    SELECT catalog, collection, source_item_id, CAST(position AS INTEGER) AS position, asset_key, source_url, local_path AS destination FROM v_item_assets""", "v_item_assets")
def e03(v: Views):
    return planning.explode_assets(v.items(), only_main=False)


@query("p05_only_main_select", "SELECT source_item_id, asset_key, source_url FROM v_main_assets", "v_main_assets")
def p05(v: Views):
    return planning.explode_assets(v.items()).select("source_item_id", "asset_key", "source_url")


@query("w01_batch_plan", """
    WITH p AS (SELECT catalog AS run_id, source_item_id, asset_key,
                      row_number() OVER (PARTITION BY catalog ORDER BY source_item_id, collection, position) AS job_number FROM v_main_assets)
    SELECT run_id, source_item_id, asset_key, job_number, (job_number - 1) // 20 + 1 AS batch_number FROM p""", "v_main_assets")
def w01(v: Views):
    jobs = planning.explode_assets(v.items()).withColumn("run_id", F.col("catalog"))
    plan = planning.plan_batches(jobs, 20, order=("source_item_id", "collection", "position"))
    return plan.select("run_id", "source_item_id", "asset_key", "job_number", "batch_number")


@query("l05_page_slicing", """
    WITH i AS (SELECT DISTINCT catalog, collection, source_item_id FROM v_raw),
    n AS (SELECT *, (row_number() OVER (PARTITION BY catalog ORDER BY source_item_id, collection) - 1) // 100 + 1 AS page_number FROM i)
    SELECT catalog, page_number, count(*) AS item_count, CASE WHEN count(*) = 100 THEN CAST(page_number * 100 AS VARCHAR) END AS outgoing_cursor
    FROM n GROUP BY catalog, page_number""", "v_raw")
def l05(v: Views):
    items = v.sightings().select("catalog", "collection", "source_item_id").distinct()
    return ingest.page_cursors(ingest.slice_pages(items, ["catalog"], ["source_item_id", "collection"]), ["catalog"])


@query("p08_temporal_filter", """
    SELECT asset_id, datetime FROM v_raw WHERE datetime BETWEEN '1996-03-01T00:00:00Z' AND '1996-09-30T23:59:59Z'""", "v_raw")
def p08(v: Views):
    rows = v.sightings().select("asset_id", "datetime")
    return ingest.temporal_filter(rows, "1996-03-01", "1996-09-30", ["sentinel-2-l2a", "HLSL30_V2.0"])


@query("w04_asset_key_dedup", """
    SELECT source_item_id, source_url, asset_key || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS asset_key
    FROM (SELECT *, row_number() OVER (PARTITION BY source_item_id, asset_key ORDER BY arrived_at, l_partkey, l_suppkey) AS n FROM v_raw)""", "v_raw")
def w04(v: Views):
    links = v.sightings().select("source_item_id", F.col("asset_key").alias("key"), F.col("source_url").alias("href"), "arrived_at", "l_partkey", "l_suppkey")
    named = ingest.number_link_keys(links, ["source_item_id"], ["arrived_at", "l_partkey", "l_suppkey"])
    return named.select("source_item_id", F.col("href").alias("source_url"), F.col("key").alias("asset_key"))


@query("u01_union_sources", """
    SELECT catalog, collection, count(DISTINCT source_item_id) AS items FROM v_raw GROUP BY ALL""", "v_raw")
def u01(v: Views):
    items = v.sightings(v.lines_by_order()).select("catalog", "collection", "source_item_id")
    parts = [items.filter(F.col("catalog") == name) for name in ("microsoft", "earth-search", "nasa")]
    return ingest.union_items(parts).distinct().groupBy("catalog", "collection").agg(F.count(F.lit(1)).alias("items"))


@query("j10_alias_lookup", """
    SELECT product_id, CASE collection WHEN 'HLSL30_V2.0' THEN 'HLSL30' WHEN 'HLSS30_V2.0' THEN 'HLSS30' ELSE collection END AS short_name,
           CASE WHEN collection LIKE 'HLS%' THEN '2.0' END AS version FROM v_products""", "v_products")
def j10(v: Views):
    return ingest.resolve_aliases(v.products()).select("product_id", "short_name", "version")


@query("p06_data_link_filter", """
    SELECT page_id, (page_id % 2 = 0 AND page_id % 3 <> 1) AS is_data FROM pages""")
def p06(v: Views):
    n = F.col("page_id")
    href = F.concat(
        F.lit("https://example/"), F.when(n % 3 == 1, "OPeNDAP/").otherwise("d/"), n.cast("string"),
        F.element_at(F.array(*[F.lit(e) for e in (".nc", ".ZIP", ".nc.zip", ".tif", ".TIFF")]), (n % 5 + 1).cast("int")),
    )
    rel = F.when(n % 2 == 0, "http://example/data#").otherwise("http://example/browse#")
    return v.table("pages").select("page_id", text.is_data_link(href, rel).alias("is_data"))


def _granules(v: Views):
    """Landed granule responses built from the scenes: polygon, two polygons, or box."""
    g = v.geo(v.spread("customer", "c_custkey", "c_nationkey", "c_mktsegment", rows=20_000))
    w, s, e, n = (F.col(c).cast("int").cast("string") for c in ("west", "south", "east", "north"))
    one = F.concat_ws(" ", s, w, s, e, n, e, n, w)
    box = F.concat_ws(" ", s, w, n, e)
    kind = F.col("c_custkey") % 3
    polygons = (
        F.when(kind == 0, F.concat(F.lit('[["'), one, F.lit('"]]')))
        .when(kind == 1, F.concat(F.lit('[["'), one, F.lit('"],["'), one, F.lit('"]]'))).otherwise("[]")
    )
    key = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("https://example/HLS."), key)
    links = F.concat(
        F.lit('[{"rel":"http://x/data#","href":"'), name, F.lit('.B04.tif"},{"rel":"http://x/data#","href":"'), name,
        F.lit('.B04.tif"},{"rel":"http://x/data#","href":"'), name, F.lit('.B08.tif"},{"rel":"http://x/browse#","href":"'), name, F.lit('.jpg"}]'),
    )
    text_ = F.concat(
        F.lit('{"feed":{"entry":[{"id":"'), F.col("asset_id"), F.lit('","time_start":"2024-01-01T00:00:00Z","polygons":'), polygons,
        F.lit(',"boxes":["'), box, F.lit('"],"links":'), links, F.lit("}]}}"),
    )
    return g.select(F.from_json(text_, GRANULE_RESPONSE_DDL).alias("r"), F.lit("HLSL30_V2.0").alias("collection")).select("collection", "r.feed")


@query("e01_granule_items", """
    SELECT asset_id AS id, 'HLSL30_V2.0' AS collection, west AS minx, south AS miny, east AS maxx, north AS maxy,
           CASE WHEN c_custkey % 3 = 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type,
           CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END AS rings, '2024-01-01T00:00:00Z' AS datetime FROM v_geo""", "v_geo")
def e01(v: Views):
    items = ingest.granule_items(_granules(v))
    b = F.col("bbox")
    return items.select(
        "id", "collection", b[0].alias("minx"), b[1].alias("miny"), b[2].alias("maxx"), b[3].alias("maxy"),
        F.col("geometry")["type"].alias("geometry_type"), F.size(F.col("geometry")["coordinates"]).alias("rings"),
        F.col("properties")["datetime"].alias("datetime"),
    )


@query("e02_links_to_assets", """
    SELECT asset_id AS id, unnest(['B04', 'B04_2', 'B08']) AS asset_key,
           unnest(['B04', 'B04', 'B08']) AS band FROM v_geo""", "v_geo")
def e02(v: Views):
    items = ingest.granule_items(_granules(v))
    rows = items.select("id", F.explode("assets").alias("asset_key", "_a"))
    return rows.select("id", "asset_key", text.link_asset_key(text.asset_filename(F.lit("data"), F.col("_a")["href"])).alias("band"))


@query("p07_request_validation", """
    SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'invalid or empty WKT;' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN 'no collection;' ELSE '' END
           || CASE WHEN c_custkey % 3 = 0 THEN 'start after end;' ELSE '' END || CASE WHEN c_custkey % 11 = 0 THEN 'unknown catalog;' ELSE '' END AS errors
    FROM customer""")
def p07(v: Views):
    k = F.col("c_custkey")
    w, s = F.col("west").cast("string"), F.col("south").cast("string")
    requests = v.geo().select(
        k, F.when(k % 7 == 0, "POLYGON EMPTY").otherwise(F.concat(F.lit("POINT ("), w, F.lit(" "), s, F.lit(")"))).alias("wkt"),
        F.when(k % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit(" a "), F.lit(""))).alias("collections"),
        F.when(k % 3 == 0, "2024-02-01").otherwise("2024-01-01").alias("start_date"), F.lit("2024-01-31").alias("end_date"),
        F.when(k % 11 == 0, "other").otherwise("nasa").alias("catalog"), F.lit(None).cast("int").alias("max_items"),
    )
    checked = ingest.validate_requests(requests)
    return checked.select("c_custkey", F.array_join(F.transform("errors", lambda e: F.concat(e, F.lit(";"))), "").alias("errors"))


@query("p07_long_wkt", """
    SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM customer""")
def p07_long(v: Views):
    """Areas of many kinds, some of 10,000 points; every third is not closed, has a bad number or too few points."""
    k = F.col("c_custkey")
    points = F.transform(F.sequence(F.lit(1), F.when(k % 50 == 1, 10_000).otherwise(4 + k % 9)), lambda i: F.concat_ws(" ", i, i % 7))
    open_ = F.array_join(points, ", ")
    ring = F.concat(F.lit("("), open_, F.lit(", 1 1)"))
    good = (
        F.when(k % 5 == 0, F.concat(F.lit("POLYGON ("), ring, F.lit(" , "), ring, F.lit(")")))
        .when(k % 5 == 1, F.concat(F.lit("MultiPolygon((("), open_, F.lit(",1 1)),("), ring, F.lit("))")))
        .when(k % 5 == 2, F.concat(F.lit("MULTIPOINT ((+1 .5), ("), k, F.lit(" -2e1))")))
        .when(k % 5 == 3, F.concat(F.lit("LINESTRING("), open_, F.lit(")"))).otherwise(F.concat(F.lit(" multipoint (1 2, "), k, F.lit(" 3.) ")))
    )
    bad = (
        F.when(k % 5 == 0, F.concat(F.lit("POLYGON (("), open_, F.lit(", 1 2))"))).when(k % 5 == 1, F.lit("POLYGON ((0 0, 1 1))"))
        .when(k % 5 == 2, F.concat(F.lit("POINT (1.2.3 "), k, F.lit(")"))).when(k % 5 == 3, F.lit("POINT EMPTY")).otherwise(F.concat(F.lit("POLYGON (("), open_))
    )
    return v.spread("customer", "c_custkey").select("c_custkey", geo.wkt_is_valid(F.when(k % 3 == 0, bad).otherwise(good)).alias("valid"))


@query("e06_collection_discovery", """
    SELECT asset_id AS id, 'T' || c_custkey AS title, NULL::VARCHAR AS description, '2020-01-01' AS start_date, NULL::VARCHAR AS end_date
    FROM v_geo WHERE west <= 20 AND east >= -20 AND south <= 40 AND north >= -10 AND c_custkey % 9 <> 0""", "v_geo")
def e06(v: Views):
    g = v.geo()
    box = F.concat_ws(",", *[F.col(c).cast("string") for c in ("west", "south", "east", "north")])
    record = F.concat(
        F.lit('{"id":"'), "asset_id", F.lit('","title":"T'), "c_custkey", F.lit('","extent":{"spatial":{"bbox":['),
        F.when(F.col("c_custkey") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("["), box, F.lit("]"))),
        F.lit(']},"temporal":{"interval":[["2020-01-01",null]]}}}'),
    )
    return ingest.discover_collections(g.select(record.alias("record")), "stac", (-20, -10, 20, 40))


@query("e06_cmr_collections", """
    SELECT c_name AS id, 'T' || c_custkey AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description, '2015-06-01' AS start_date,
           CASE WHEN c_custkey % 3 = 0 THEN '2020-01-01' END AS end_date
    FROM customer WHERE c_custkey % 7 <> 0""")
def e06_cmr(v: Views):
    """Collection records of the service that filters by area itself; a record without a name is skipped."""
    k = F.col("c_custkey")
    record = F.to_json(F.struct(
        F.when(k % 7 != 0, F.col("c_name")).otherwise("").alias("short_name"), F.concat(F.lit("T"), k).alias("title"),
        F.when(k % 2 == 0, F.col("c_mktsegment")).alias("summary"), F.lit("2015-06-01").alias("time_start"), F.when(k % 3 == 0, "2020-01-01").alias("time_end"),
    ))
    return ingest.discover_collections(v.table("customer").select(record.alias("record")), "cmr")


@query("l05_granule_cursor", """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{"collection_index":' || c_custkey % 3 || ',"page_num":' || c_custkey % 5 + 2 || '}'
                           WHEN c_custkey % 3 < 2 THEN '{"collection_index":' || c_custkey % 3 + 1 || ',"page_num":1}' END AS cursor
    FROM customer""")
def l05_cursor(v: Views):
    """Where a granule search goes on: the next page while pages are full, then the next collection, then nowhere."""
    k = F.col("c_custkey")
    entries = F.when(k % 2 == 0, 100).otherwise(k % 100)
    return v.table("customer").select("c_custkey", ingest.granule_cursor(k % 3, k % 5 + 1, entries, F.lit(100), F.lit(3)).alias("cursor"))


@query("f19_collection_details", """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Title ' || c_custkey ELSE 'Harmonized Landsat Sentinel-2 L30 Version 2.0' END AS title,
           CASE WHEN c_custkey % 2 = 0 THEN 'CC-BY' ELSE 'unknown' END AS license,
           CASE WHEN c_custkey % 2 = 0 THEN 'A|B' ELSE 'ORG' END AS providers,
           CASE WHEN c_custkey % 2 = 0 THEN 'x|y' ELSE 'HLS|Landsat|surface reflectance|30 m|NASA' END AS keywords,
           CASE WHEN c_custkey % 2 = 0 THEN CAST(10 + c_custkey % 5 AS DOUBLE) ELSE 30.0::DOUBLE END AS spatial_resolution_m,
           '2015-06-01' AS temporal_start,
           CASE WHEN c_custkey % 2 = 0 THEN 'https://doc' ELSE 'https://lpdaac.usgs.gov/products/hlsl30v002/' END AS documentation_urls
    FROM customer""")
def f19(v: Views):
    from ..functions import semantics
    from ..operators.registry import _with_profile

    k = F.col("c_custkey")
    stac = F.concat(
        F.lit('{"type":"Collection","title":"Title '), k, F.lit('","license":"CC-BY","keywords":["x","y","x"],"providers":[{"name":"A"},"B",{"name":"A"}],'
        '"extent":{"temporal":{"interval":[["2015-06-01",null]]}},"summaries":{"gsd":["n/a",'), k % 5 + 10,
        F.lit(']},"links":[{"rel":"self","href":"https://s"},{"rel":"About","href":"https://doc"}]}'),
    )
    cmr = F.lit('{"time_start":"2015-06-01","organizations":["ORG"]}')
    rows = v.table("customer").select(
        k, F.when(k % 2 == 0, "HLSS30_V2.0").otherwise("HLSL30_V2.0").alias("collection"), F.when(k % 2 == 0, stac).otherwise(cmr).alias("collection_metadata")
    )
    d = semantics.collection_columns(F.col("collection"), F.col("collection_metadata"), "p_")
    return _with_profile(rows).select(
        "c_custkey", d["title"].alias("title"), d["license"].alias("license"), F.array_join(d["providers"], "|").alias("providers"),
        F.array_join(d["keywords"], "|").alias("keywords"), d["spatial_resolution_m"].alias("spatial_resolution_m"),
        d["temporal_start"].alias("temporal_start"), F.array_join(d["documentation_urls"], "|").alias("documentation_urls"),
    )


# ---- pages -------------------------------------------------------------------


@query("w02_first_wins_dedup", """
    SELECT run_id, catalog, collection, source_item_id, page_number FROM v_page_items
    QUALIFY row_number() OVER (PARTITION BY run_id, catalog, collection, source_item_id ORDER BY page_number, l_partkey, l_suppkey, arrived_at) = 1""", "v_page_items")
def w02(v: Views):
    found = ingest.discover_items(v.page_items(), SIGHTING_ORDER)
    return found.select("run_id", "catalog", "collection", "source_item_id", "page_number")


@query("l03_max_items", """
    WITH d AS (SELECT * FROM v_page_items QUALIFY row_number() OVER (PARTITION BY run_id, catalog, collection, source_item_id ORDER BY page_number, l_partkey, l_suppkey, arrived_at) = 1)
    SELECT run_id, source_item_id, page_number FROM d
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY page_number, l_partkey, l_suppkey, arrived_at, source_item_id) <= 150""", "v_page_items")
def l03(v: Views):
    found = ingest.discover_items(v.page_items(), SIGHTING_ORDER)
    return ingest.limit_items(found, 150, (*SIGHTING_ORDER, "source_item_id")).select("run_id", "source_item_id", "page_number")


@query("l03_max_items_large", """
    WITH d AS (SELECT * FROM v_page_items QUALIFY row_number() OVER (PARTITION BY run_id, catalog, collection, source_item_id ORDER BY page_number, l_partkey, l_suppkey, arrived_at) = 1)
    SELECT run_id, source_item_id, page_number FROM d
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY page_number, l_partkey, l_suppkey, arrived_at, source_item_id) <= 2500""", "v_page_items")
def l03_large(v: Views):
    found = ingest.discover_items(v.page_items(), SIGHTING_ORDER)
    return ingest.limit_items(found, 2500, (*SIGHTING_ORDER, "source_item_id")).select("run_id", "source_item_id", "page_number")


@query("a11_discovered_count", """
    SELECT run_id, count(*) AS discovered_items FROM (SELECT DISTINCT run_id, catalog, collection, source_item_id FROM v_page_items) GROUP BY run_id""", "v_page_items")
def a11(v: Views):
    return ingest.discovered_counts(v.page_items())


@query("w05_search_checkpoint", """
    SELECT r.conv_id AS run_id, coalesce(max(page_number), 0) + 1 AS next_page, arg_max_null(outgoing_cursor, page_number) AS cursor,
           coalesce(arg_max_null(outgoing_cursor, page_number) IS NULL AND max(page_number) IS NOT NULL, false) AS complete
    FROM (SELECT DISTINCT conv_id FROM conversations) r LEFT JOIN v_pages p ON p.run_id = r.conv_id GROUP BY 1""", "v_pages")
def w05(v: Views):
    return ingest.search_checkpoints(v.table("conversations").select(F.col("conv_id").alias("run_id")).distinct(), v.pages())


# ---- attempts ----------------------------------------------------------------


@query("w09_latest_attempt_state", "SELECT attempt_id, status, downloaded_bytes, updated_at FROM v_latest", "v_latest")
def w09(v: Views):
    return runs.latest_attempts(v.attempts()).select("attempt_id", "status", "downloaded_bytes", "updated_at")


_COUNTS = """count(*) AS total_files, count(*) FILTER (status IN ('completed', 'skipped')) AS completed_files,
           count(*) FILTER (status = 'failed') AS failed_files"""
_STATUS = """CASE WHEN bool_or(status = 'downloading') THEN 'downloading' WHEN bool_or(status = 'queued') THEN 'queued'
           WHEN bool_or(status = 'failed') AND bool_or(status IN ('completed', 'skipped')) THEN 'partial' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END"""


@query("a07_batch_status", f"""
    SELECT run_id, batch_number, {_COUNTS}, {_STATUS} AS status FROM v_latest GROUP BY run_id, batch_number""", "v_latest")
def a07(v: Views):
    return runs.batch_status(runs.latest_attempts(v.attempts()))


@query("a08_run_status", f"""
    SELECT run_id, {_COUNTS}, {_STATUS} AS status FROM v_latest GROUP BY run_id""", "v_latest")
def a08(v: Views):
    return runs.run_status(runs.latest_attempts(v.attempts()))


@query("a07_in_flight", f"""
    SELECT run_id, {_COUNTS}, {_STATUS} AS status FROM (SELECT run_id, CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS status FROM v_latest) GROUP BY run_id""", "v_latest")
def a07_in_flight(v: Views):
    """Status of runs right after their failed attempts were queued again: no run with such an attempt is done."""
    latest = runs.latest_attempts(v.attempts()).withColumn("error", F.lit("x"))
    events = latest.unionByName(runs.requeue_failed(latest, "2100-01-01T00:00:00Z"))
    return runs.run_status(runs.latest_attempts(events))


@query("a09_run_progress", f"""
    SELECT r.c_custkey AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'queued' END AS status, coalesce(total_files, 0) AS total_files,
           coalesce(completed_files, 0) AS completed_files, coalesce(failed_files, 0) AS failed_files,
           CASE WHEN total_files > 0 THEN round((completed_files + failed_files) / total_files * 100, 2) WHEN c_custkey % 2 = 0 THEN 100.0 ELSE 0.0 END AS progress
    FROM customer r LEFT JOIN (SELECT run_id, {_COUNTS} FROM v_latest GROUP BY run_id) l ON l.run_id = r.c_custkey""", "v_latest")
def a09(v: Views):
    all_runs = v.table("customer").select(
        F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 2 == 0, "completed").otherwise("queued").alias("status")
    )
    return runs.run_progress(runs.latest_attempts(v.attempts()), all_runs)


@query("a10_byte_progress", f"""
    SELECT run_id, round(CASE WHEN run_id % 4 = 0 THEN completed_files / total_files * 100 ELSE least(99.9, done / total * 100) END, 6) AS progress
    FROM (SELECT run_id, {_COUNTS}, sum(downloaded_bytes) AS total, sum(downloaded_bytes) FILTER (status IN ('completed', 'skipped')) AS done
          FROM v_latest GROUP BY run_id)""", "v_latest")
def a10(v: Views):
    done = F.col("status").isin(*runs.DONE)
    sums = runs.latest_attempts(v.attempts()).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(done).alias("done_files"), F.sum("downloaded_bytes").alias("total"),
        F.sum(F.when(done, F.col("downloaded_bytes"))).alias("done"),
    )
    total = F.when(F.col("run_id") % 4 != 0, F.col("total"))
    return sums.select("run_id", F.round(pg.byte_progress(F.col("done"), total, F.col("done_files"), F.col("files")), 6).alias("progress"))



def _seconds():
    start, end = F.min("updated_at"), F.max("updated_at")
    return (F.unix_micros(F.to_timestamp(end)) - F.unix_micros(F.to_timestamp(start))) / F.lit(1000000.0)


@query("a20_transfer_totals", """
    SELECT run_id, count(*) AS total_files, count(*) FILTER (status IN ('completed', 'skipped')) AS completed_files,
           CAST(sum(downloaded_bytes) AS BIGINT) AS downloaded_bytes, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) AS elapsed,
           round(CASE WHEN max(ts) > min(ts) THEN sum(downloaded_bytes) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) ELSE 0 END, 6) AS speed
    FROM v_latest GROUP BY run_id""", "v_latest")
def a20(v: Views):
    totals = runs.transfer_totals(runs.latest_attempts(v.attempts()), _seconds())
    return totals.withColumns({"elapsed": F.round("elapsed", 3), "speed": F.round("speed", 6)})


@query("f22_eta", f"""
    SELECT run_id, CASE WHEN p > 1 THEN round(greatest(0, e / (p / 100) - e), 2) END AS remaining_time
    FROM (SELECT run_id, round((completed_files + failed_files) / total_files * 100, 2) AS p, e
          FROM (SELECT run_id, {_COUNTS}, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS e FROM v_latest GROUP BY run_id))""", "v_latest")
def f22(v: Views):
    latest = runs.latest_attempts(v.attempts())
    done = F.col("status").isin("completed", "skipped", "failed")
    rows = latest.groupBy("run_id").agg(
        F.round(F.count_if(done) / F.count(F.lit(1)) * 100, 2).alias("progress"), F.floor(_seconds()).alias("elapsed")
    )
    return rows.select("run_id", pg.remaining_seconds(F.col("elapsed"), F.col("progress"), F.lit("downloading")).alias("remaining_time"))


@query("f21_status_alias", """
    SELECT CASE k % 3 WHEN 0 THEN 'searching' ELSE status END AS status, count(*) AS attempts FROM v_attempts GROUP BY 1""", "v_attempts")
def f21(v: Views):
    status = F.when(F.col("k") % 3 == 0, "discovering").otherwise(F.col("status"))
    return v.attempts().groupBy(pg.status_alias(status).alias("status")).agg(F.count(F.lit(1)).alias("attempts"))


@query("e08_retry_classification", """
    SELECT seq, CASE WHEN h IN (401, 403) THEN 'auth_required' WHEN (h IN (429, 500, 502, 503, 504) OR h IS NULL) AND n < 3 THEN 'retry'
                WHEN h = 200 THEN 'ok' ELSE 'failed' END AS decision,
           CASE WHEN (h IN (429, 500, 502, 503, 504) OR h IS NULL) AND n < 3 THEN 0.1 * pow(2, n - 1) END AS backoff
    FROM (SELECT seq, 1 + k % 3 AS n, [401, 403, 404, 429, 500, 503, 200, NULL][1 + k % 8] AS h FROM v_attempts)""", "v_attempts")
def e08(v: Views):
    codes = F.array(*[F.lit(c).cast("int") for c in (401, 403, 404, 429, 500, 503, 200, None)])
    tries = v.attempts().select(
        "seq", (F.col("k") % 3 + 1).alias("attempts"), F.element_at(codes, F.col("k") % 8 + 1).alias("http_status"),
        F.when(F.col("k") % 8 == 7, "timeout").alias("error"),
    )
    return runs.classify_retries(tries).select("seq", "decision", "backoff")


@query("u08_retry_requeue", """
    SELECT attempt_id, 'queued' AS status, seq + 1 AS seq FROM v_latest WHERE status = 'failed'""", "v_latest")
def u08(v: Views):
    latest = runs.latest_attempts(v.attempts()).withColumn("error", F.lit("x"))
    return runs.requeue_failed(latest, "2024-01-02T00:00:00Z").select("attempt_id", "status", "seq")


@query("u08_requeue_batches", f"""
    SELECT run_id, batch_number, CASE WHEN run_id % 2 = 0 AND status IN ('failed', 'partial') THEN 0 ELSE failed_files END AS failed_files,
           CASE WHEN run_id % 2 = 0 AND status IN ('failed', 'partial') THEN 'queued' ELSE status END AS status
    FROM (SELECT run_id, batch_number, {_COUNTS}, {_STATUS} AS status FROM v_latest GROUP BY run_id, batch_number)""", "v_latest")
def u08_batches(v: Views):
    batches = runs.batch_status(runs.latest_attempts(v.attempts()))
    asked = v.attempts().filter("run_id % 2 = 0").select("run_id")
    return runs.requeue_batches(batches, asked).select("run_id", "batch_number", "failed_files", "status")


@query("u08_requeue_runs", f"""
    SELECT run_id, CASE WHEN f > 0 THEN 0 ELSE f END AS failed_files, CASE WHEN f > 0 THEN 'queued' ELSE status END AS status,
           CASE WHEN f > 0 THEN NULL ELSE 'e' END AS error, CASE WHEN f > 0 THEN 'Failed transfers queued for retry.' ELSE 'm' END AS message,
           CASE WHEN f > 0 THEN NULL ELSE 't0' END AS finished_at, CASE WHEN f > 0 THEN 't1' ELSE 't0' END AS updated_at
    FROM (SELECT run_id, count(*) FILTER (status = 'failed') AS f, {_STATUS} AS status FROM v_latest GROUP BY run_id)""", "v_latest")
def u08_runs(v: Views):
    latest = runs.latest_attempts(v.attempts())
    rows = runs.run_status(latest).withColumns({"error": F.lit("e"), "message": F.lit("m"), "finished_at": F.lit("t0"), "updated_at": F.lit("t0")})
    again = runs.requeue_runs(rows, runs.requeue_counts(latest).filter("requeued > 0"), "t1")
    return again.select("run_id", "failed_files", "status", "error", "message", "finished_at", "updated_at")


@query("u08_requeue_counts", """
    SELECT run_id, count(*) FILTER (status = 'failed') AS requeued FROM v_latest GROUP BY run_id""", "v_latest")
def u08_counts(v: Views):
    return runs.requeue_counts(runs.latest_attempts(v.attempts()))


@query("u09_recover_requeue", """
    SELECT l.attempt_id, CASE WHEN l.status = 'downloading' AND l.run_id % 3 <> 0 THEN 'queued' ELSE l.status END AS status
    FROM v_latest l""", "v_latest")
def u09(v: Views):
    owners = v.table("customer").select(
        F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 3 == 0, "paused").otherwise("downloading").alias("status")
    )
    return runs.recover_attempts(runs.latest_attempts(v.attempts()), owners).select("attempt_id", "status")


@query("t05_live_progress", """
    SELECT run_id, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS updates,
           count(*) FILTER (status IN ('completed', 'skipped')) AS completed_files, count(*) FILTER (status = 'failed') AS failed_files,
           CAST(sum(downloaded_bytes) AS BIGINT) AS downloaded_bytes, sum(downloaded_bytes) / 3600 AS speed
    FROM v_attempts GROUP BY 1, 2""", "v_attempts")
def t05(v: Views):
    events = v.attempts().withColumn("ts", F.col("ts").cast("timestamp"))
    rows = live.live_progress(events, window="1 hour")
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("t04_attempt_state_stream", """
    SELECT attempt_id, status, downloaded_bytes FROM v_latest""", "v_latest")
def t04(v: Views):
    return live.attempt_state_snapshot(v.spark, f"{v.folder}", v).select("attempt_id", "status", "downloaded_bytes")


@query("j13_attempt_item_join", """
    SELECT a.attempt_id, i.item FROM v_latest a JOIN (SELECT c_custkey AS run_id, c_custkey % 2 AS c, unnest(range(10)) AS i, c_name || '-' || unnest(range(10)) AS item FROM customer) i
    ON a.run_id = i.run_id AND a.k % 2 = i.c AND a.batch_number = i.i""", "v_latest")
def j13(v: Views):
    latest = runs.latest_attempts(v.attempts()).withColumns({
        "collection": F.concat(F.lit("c"), F.col("k") % 2), "source_item_id": F.concat(F.lit("i"), "batch_number"),
    })
    k = F.col("c_custkey")
    items = v.table("customer").select(k.alias("run_id"), F.concat(F.lit("c"), k % 2).alias("collection"), "c_name", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    items = items.select("run_id", "collection", F.concat(F.lit("i"), "i").alias("source_item_id"), F.concat_ws("-", "c_name", "i").alias("item"))
    return runs.attempts_with_items(latest, items).select("attempt_id", "item")


# ---- runs --------------------------------------------------------------------


@query("l02_keyset_page", """
    SELECT run_id, created_at, status FROM v_runs WHERE created_at < '1996-06-01T00:00:00Z' OR (created_at = '1996-06-01T00:00:00Z' AND run_id < 500)
    ORDER BY created_at DESC, run_id DESC LIMIT 51""", "v_runs")
def l02(v: Views):
    return runs.list_runs(v.runs(), "1996-06-01T00:00:00Z|500", 50).select("run_id", "created_at", "status")


@query("l04_recent_runs_topk", """
    SELECT run_id, created_at FROM v_runs WHERE status = 'queued' ORDER BY created_at DESC, run_id DESC LIMIT 6""", "v_runs")
def l04(v: Views):
    return runs.recent_runs(v.runs(), 6, "queued").select("run_id", "created_at")


@query("u05_idempotent_submit", """
    SELECT run_id, CASE WHEN run_id = f THEN 'created' WHEN request = q THEN 'reused' ELSE 'conflict' END AS outcome,
           CASE WHEN request = q THEN f END AS resolved_run_id
    FROM (SELECT *, first_value(run_id) OVER w AS f, first_value(request) OVER w AS q FROM v_runs WINDOW w AS (PARTITION BY idempotency_key ORDER BY created_at, run_id))""", "v_runs")
def u05(v: Views):
    return runs.submit_idempotent(v.runs()).select("run_id", "outcome", "resolved_run_id")


@query("p14_run_control_matrix", """
    SELECT r.run_id, a.action, a.next_status FROM v_runs r JOIN (VALUES ('queued', 'pause', 'paused'), ('queued', 'cancel', 'cancelled'), ('partial', 'retry', 'queued')) a(status, action, next_status)
    USING (status)""", "v_runs")
def p14(v: Views):
    return runs.allowed_actions(v.runs()).select("run_id", "action", "next_status")


@query("a15_attention_count", """
    SELECT (SELECT count(*) FROM (SELECT path FROM v_registered EXCEPT SELECT path FROM v_source_files))
         + (SELECT count(*) FROM (SELECT path FROM v_source_files EXCEPT SELECT path FROM v_registered))
         + (SELECT count(*) FROM v_runs WHERE status IN ('failed', 'partial')) AS issues""", "v_registered", "v_source_files", "v_runs")
def a15(v: Views):
    return catalog.attention_count(audit.path_audit(v.sightings().select("local_path"), v.files()), v.runs())


@query("j14_task_view_merge", """
    SELECT CAST(run_id AS VARCHAR) AS task_id, status FROM v_runs
    UNION ALL SELECT CAST(c_custkey * 7 AS VARCHAR), 'legacy' FROM customer WHERE c_custkey * 7 NOT IN (SELECT run_id FROM v_runs)""", "v_runs")
def j14(v: Views):
    persisted = v.runs().select(F.col("run_id").cast("string").alias("task_id"), "status")
    legacy = v.table("customer").select((F.col("c_custkey") * 7).cast("string").alias("task_id"), F.lit("legacy").alias("status"))
    return runs.merge_tasks(persisted, legacy)


@query("u09_recover_runs", """
    SELECT status, message, count(*) AS runs FROM (
      SELECT CASE WHEN status = 'queued' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'queued' THEN 'Recovered after process restart.' ELSE '' END AS message FROM v_runs)
    GROUP BY ALL""", "v_runs")
def u09_runs(v: Views):
    return runs.recover_runs(v.runs().withColumn("message", F.lit(""))).groupBy("status", "message").agg(F.count(F.lit(1)).alias("runs"))


# ---- stores and streams --------------------------------------------------------


@query("s04_search_page_roundtrip", """
    SELECT run_id, page AS page_number, source_item_id AS id, collection, count(*) AS sightings FROM v_search_pages GROUP BY ALL""", "v_search_pages")
def s04(v: Views):
    path = f"{scratch_dir(v.spark)}/{uuid.uuid4().hex}"
    pages.write_pages(_landed(v), path)
    back = pages.read_pages(v.spark, path, "id STRING, collection STRING")
    return back.groupBy(F.col("run_id").cast("bigint").alias("run_id"), "page_number", "id", "collection").agg(F.count(F.lit(1)).alias("sightings"))


def _landed(v: Views):
    """Page items in the shape that pages are written in, in pages of 100."""
    order = [*SIGHTING_ORDER, "source_item_id"]
    items = v.page_items().withColumnRenamed("page_number", "line").drop("catalog")
    cut = ingest.slice_pages(items, ["run_id"], ["line" if c == "page_number" else c for c in order], 100)
    return cut.select(
        "run_id", "page_number", F.col("source_item_id").alias("id"), "collection", (F.col("line") * 1000000 + F.col("l_partkey")).cast("bigint").alias("position"),
        F.create_map(F.lit("B04"), F.struct(F.lit("u").alias("href"), F.array(F.lit("data")).alias("roles"))).alias("assets"),
    )


@query("t01_page_ingest_stream", """
    SELECT DISTINCT run_id, collection, source_item_id FROM v_page_items""", "v_page_items")
def t01(v: Views):
    """Pages land, a stream reads them a few files at a time and keeps each item of a run once."""
    return _streamed(v).select("run_id", "collection", "source_item_id")


@query("t02_first_page_wins", """
    SELECT run_id, collection, source_item_id, min(page) AS page_number FROM v_search_pages GROUP BY ALL""", "v_search_pages")
def t02(v: Views):
    """The same stream, with the page that each item was first seen on."""
    return _streamed(v).select("run_id", "collection", "source_item_id", "page_number")


def _streamed(v: Views):
    home = f"{scratch_dir(v.spark)}/{uuid.uuid4().hex}"
    pages.write_pages(_landed(v), f"{home}/pages")
    stream = pages.stream_pages(v.spark, f"{home}/pages")
    ingest_stream.ingest_pages(stream, "nasa", f"{home}/items", f"{home}/checkpoint").awaitTermination()
    return ingest_stream.read_items(v.spark, f"{home}/items").withColumn("run_id", F.col("run_id").cast("bigint"))


@query("t03_stream_register", """
    SELECT asset_id, status, run_id, created_at, updated_at, byte_size FROM v_assets""", "v_assets")
def t03(v: Views):
    """Deliveries stream into the registries: a stream of lines, a static join, an upsert per micro-batch. A file belongs to one order."""
    from .registry_queries import deliveries

    home = f"{scratch_dir(v.spark)}/{uuid.uuid4().hex}"
    schema = v.table("lineitem").schema
    lines = v.spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(v.folder)
    store = RegistryStore(v.spark, f"{home}/registry")
    ingest_stream.register_stream(
        lines, store, f"{home}/checkpoint", lambda batch: deliveries(v, batch), lambda batch: deliveries(v, batch, part_of("assets")), DEALT_BY
    ).awaitTermination()
    return store.read("assets").select("asset_id", "status", "run_id", "created_at", "updated_at", "byte_size")
