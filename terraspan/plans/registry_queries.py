"""Queries over registries: registration, rollups, listings, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import semantics, text
from ..operators import audit, catalog, ordering, planning, registry
from ..profiles import PROFILE_BANDS, SOURCE_INFO
from ..schemas import RASTER_DDL
from ..session import materialize, scratch_dir, scratch_folder
from ..sources.registry_store import RegistryStore
from ..sources.search_layout import write_search_layout
from .base import query
from .views import ARRIVAL, DEALT_BY, Views

CUTOFF = "1997-01-01T00:00:00Z"


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value + "'" if isinstance(value, str) else repr(value)


BANDS_SQL = "(VALUES " + ", ".join(
    "(" + ", ".join(_sql(v) for v in row) + ")" for row in PROFILE_BANDS
) + ") b(b_collection, b_key, canonical_name, long_name, wavelength, bandwidth, unit, scale_factor, role)"
SOURCES_SQL = "(VALUES " + ", ".join(
    "(" + ", ".join(_sql(v) for v in row) + ")" for row in SOURCE_INFO
) + ") s(s_catalog, provider, endpoint, auth_type)"


def _registry(v: Views) -> dict:
    return {
        "assets": v.assets("source_item_id", "local_path", "byte_size", "updated_at"),
        "variables": v.variables(), "products": v.products(), "processing_runs": v.run_records(),
    }


@query("a01_product_rollup", """
    SELECT p.product_id, coalesce(a.asset_count, 0) AS asset_count, coalesce(a.byte_size, 0) AS byte_size,
           coalesce(v.variable_count, 0) AS variable_count, a.start_datetime, a.end_datetime
    FROM v_products p
    LEFT JOIN (SELECT product_id, count(*) AS asset_count, CAST(sum(byte_size) AS BIGINT) AS byte_size,
                      min(datetime) AS start_datetime, max(datetime) AS end_datetime FROM v_assets GROUP BY product_id) a USING (product_id)
    LEFT JOIN (SELECT source_product AS product_id, count(*) AS variable_count FROM v_variables GROUP BY 1) v USING (product_id)
    """, "v_products", "v_assets", "v_variables")
def a01(v: Views):
    rollup = catalog.product_rollup(v.products(), v.assets("product_id", "byte_size", "datetime"), v.variables())
    return rollup.select("product_id", "asset_count", "byte_size", "variable_count", "start_datetime", "end_datetime")


@query("u02_asset_upsert", """
    SELECT asset_id, status, run_id, created_at, updated_at, byte_size, datetime FROM v_assets""", "v_assets")
def u02(v: Views):
    s = v.sightings().select("asset_id", "status", "run_id", "created_at", "updated_at", "byte_size", "datetime", *ARRIVAL)
    keep = ["status", "run_id", "created_at"]

    def fold(df):
        return registry.fold_arrivals(df, "asset_id", ARRIVAL, first=keep)

    old, new = fold(s.filter(F.col("arrived_at") < CUTOFF)), fold(s.filter(F.col("arrived_at") >= CUTOFF))
    return registry.upsert(old, new, "asset_id", keep=["status", "run_id"]).select(
        "asset_id", "status", "run_id", "created_at", "updated_at", "byte_size", "datetime"
    )


@query("w03_last_wins_upsert", """
    SELECT asset_id, byte_size, datetime, run_id FROM v_raw
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY arrived_at DESC, l_partkey DESC, l_suppkey DESC) = 1""", "v_raw")
def w03(v: Views):
    rows = v.sightings().select("asset_id", "byte_size", "datetime", "run_id", *ARRIVAL)
    newest = ordering.first_per_key(rows, ["asset_id"], [F.col(c).desc() for c in ARRIVAL])
    return newest.select("asset_id", "byte_size", "datetime", "run_id")


@query("u03_dimension_upsert", """
    SELECT product_id || ':' || asset_key AS variable_id, min(created_at) AS created_at, max(updated_at) AS updated_at
    FROM v_raw GROUP BY 1""", "v_raw")
def u03(v: Views):
    s = v.sightings().select(
        F.concat_ws(":", "product_id", "asset_key").alias("variable_id"), "created_at", "updated_at", "arrived_at"
    )

    def fold(df):
        return registry.fold_arrivals(df, "variable_id", ["arrived_at"], first=["created_at"], last=["updated_at"])

    return registry.upsert(
        fold(s.filter(F.col("arrived_at") < CUTOFF)), fold(s.filter(F.col("arrived_at") >= CUTOFF)), "variable_id"
    )


@query("j08_existing_asset_lookup", f"""
    WITH old AS (SELECT asset_id, arg_min(run_id, (arrived_at, l_partkey, l_suppkey)) AS run_id FROM v_raw
                 WHERE arrived_at < '{CUTOFF}' GROUP BY asset_id),
         new AS (SELECT asset_id, arg_min(run_id, (arrived_at, l_partkey, l_suppkey)) AS run_id FROM v_raw
                 WHERE arrived_at >= '{CUTOFF}' GROUP BY asset_id)
    SELECT new.asset_id, coalesce(old.run_id, new.run_id) AS lineage_run_id, old.run_id IS NULL AS is_new
    FROM new LEFT JOIN old USING (asset_id)""", "v_raw")
def j08(v: Views):
    s = v.sightings().select("asset_id", "run_id", *ARRIVAL)

    def fold(df):
        return registry.fold_arrivals(df, "asset_id", ARRIVAL, first=["run_id"], last=[])

    old = fold(s.filter(F.col("arrived_at") < CUTOFF)).withColumnRenamed("run_id", "_old")
    new = fold(s.filter(F.col("arrived_at") >= CUTOFF))
    return new.join(old, "asset_id", "left").select(
        "asset_id", F.coalesce("_old", "run_id").alias("lineage_run_id"), F.col("_old").isNull().alias("is_new")
    )


@query("e04_register_assets", """
    SELECT 'sources' AS table_name, catalog AS key, min(created_at) AS created_at, max(updated_at) AS updated_at FROM v_raw GROUP BY catalog
    UNION ALL SELECT 'products', product_id, min(created_at), max(updated_at) FROM v_raw GROUP BY product_id
    UNION ALL SELECT 'variables', product_id || ':' || asset_key, min(created_at), max(updated_at) FROM v_raw GROUP BY 2
    UNION ALL SELECT 'grids', CASE WHEN collection LIKE 'HLS%' THEN 'hls_mgrs_30m' ELSE product_id || '_native' END, min(created_at), max(updated_at) FROM v_raw GROUP BY 2
    UNION ALL SELECT 'assets', asset_id, min(created_at), max(updated_at) FROM v_raw GROUP BY asset_id""", "v_raw")
def e04(v: Views):
    made = registry.register(deliveries(v), asset_columns=("created_at", "updated_at"))
    parts = None
    for table, df in made.items():
        key = df.columns[0]
        one = df.select(F.lit(table).alias("table_name"), F.col(key).alias("key"), "created_at", "updated_at")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def deliveries(v: Views, lines=None, parts: Column | None = None):
    """Sightings in the shape that registration takes; ``lines`` are all or a batch of lineitem. With ``parts`` dealt by DEALT_BY, see :meth:`Views.sightings`."""
    return v.sightings(lines, parts).select(
        *(DEALT_BY if parts is not None else ()),
        "run_id", "catalog", "collection", F.col("source_item_id").alias("item_id"), "asset_key", "source_url", "local_path",
        "byte_size", F.sha2("local_path", 256).alias("checksum_sha256"), "datetime",
        F.lit(None).cast("array<double>").alias("bbox"),
        F.lit(None).cast("struct<type: string, coordinates: array<array<array<double>>>>").alias("geometry"),
        F.lit(None).cast(RASTER_DDL.replace("STRUCT<", "struct<")).alias("raster"), "status",
        F.lit(None).cast("string").alias("collection_metadata"), F.col("created_at").alias("registered_at"),
        F.struct(*ARRIVAL).alias("seq"),
    )


_NOW = "2024-01-02T00:00:00Z"


def _sidecars(v: Views):
    """Sidecar items of the stored scenes: one in four whole, one without id and date, one broken, one absent."""
    from ..schemas import ITEM_DDL

    scenes = v.scenes().withColumn("parent", F.regexp_replace("local_path", "/[^/]*$", ""))
    kind = F.col("l_orderkey") % 4
    whole = F.concat(F.lit('{"id":"'), "source_item_id", F.lit('","collection":"'), "collection", F.lit('","properties":{"datetime":"2030-01-01T00:00:00Z"}}'))
    text_ = F.when(kind == 0, whole).when(kind == 1, F.lit('{"properties":{}}')).otherwise("{broken")
    rows = scenes.filter(kind < 3).select("parent", text_.alias("value"))
    item = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", ITEM_DDL))
    return rows.select("parent", item.alias("item"))


def _stored(v: Views, by_path: bool = False):
    return v.assets("product_id", "source_item_id", "asset_key", "source_url", "local_path", "status", "run_id", "datetime", "created_at", "updated_at", by_path=by_path)


def _file_facts(v: Views):
    return v.files().select("path", "byte_size", F.sha2("path", 256).alias("checksum_sha256"), F.lit(None).cast(RASTER_DDL).alias("raster"))


def _product_records(v: Views):
    return v.products().select("product_id", F.col("collection").alias("collection_id"))


@query("j09_sidecar_join", """
    SELECT a.asset_id, CASE l_orderkey % 4 WHEN 1 THEN 'unknown' ELSE source_item_id END AS item_id, a.collection,
           CASE l_orderkey % 4 WHEN 0 THEN '2030-01-01T00:00:00Z' WHEN 1 THEN NULL ELSE datetime END AS datetime,
           CASE WHEN a.collection = 'era5-land' THEN 'about era5-land' END AS collection_metadata, f.byte_size, split_part(a.local_path, '/', 2) AS catalog
    FROM v_assets a JOIN (SELECT DISTINCT path, byte_size FROM v_files) f ON f.path = a.local_path""", "v_assets", "v_files")
def j09(v: Views):
    """Every file with its sidecar item, its collection record and the collection its product is stored with."""
    records = v.products().filter("collection = 'era5-land'").select("collection", F.concat(F.lit("about "), "collection").alias("collection_metadata"))
    rows = registry.reindex(_stored(v), _product_records(v), _file_facts(v), _sidecars(v), records, _NOW)
    return rows.select(F.col("seq")["asset_id"].alias("asset_id"), "item_id", "collection", "datetime", "collection_metadata", "byte_size", "catalog")


_E05_COLUMNS = ("product_id", "source_item_id", "asset_key", "source_url", "local_path", "grid_id", "media_type", "checksum_sha256", "status", "run_id", "datetime")


@query("e05_reindex", f"""
    WITH found AS (SELECT a.*, f.path IS NOT NULL AS again, f.byte_size AS size, l_orderkey % 4 = 1 AS nameless,
                          CASE WHEN a.collection LIKE 'HLS%' THEN 'hls_mgrs_30m' ELSE product_id || '_native' END AS own_grid
                   FROM v_assets a LEFT JOIN (SELECT DISTINCT path, byte_size FROM v_files) f ON f.path = a.local_path)
    SELECT 'assets' AS table_name, asset_id AS key, product_id, source_item_id, asset_key, source_url, local_path,
           CASE WHEN again THEN own_grid END AS grid_id, CASE WHEN again THEN 'image/tiff' END AS media_type, CASE WHEN again THEN sha256(local_path) END AS checksum_sha256,
           status, run_id, CASE WHEN again AND l_orderkey % 4 = 0 THEN '2030-01-01T00:00:00Z' ELSE datetime END AS datetime,
           CASE WHEN again THEN size END AS byte_size, created_at, CASE WHEN again THEN '{_NOW}' ELSE updated_at END AS updated_at
    FROM (SELECT * REPLACE (again AND NOT nameless AS again) FROM found)
    UNION ALL
    SELECT 'assets', sha256(split_part(local_path, '/', 2) || '|' || collection || '|unknown|' || asset_key || '|' || source_url), product_id, 'unknown', asset_key, source_url,
           local_path, own_grid, 'image/tiff', sha256(local_path), status, run_id, NULL, size, '{_NOW}', '{_NOW}'
    FROM found WHERE again AND nameless
    UNION ALL
    SELECT 'grids', own_grid, {", ".join("NULL" for _ in _E05_COLUMNS)}, NULL, '{_NOW}', '{_NOW}' FROM found WHERE again GROUP BY own_grid""", "v_assets", "v_files")
def e05(v: Views):
    """The whole reindex: files and sidecars to deliveries, registration, merge, stale grids.

    Assets keep their ids, but those beside a sidecar without an id: they are registered anew as those of an unknown item.
    """
    stale = v.spark.createDataFrame([("hls_mgrs_30m_old", None)], "grid_id string, epsg int")
    before = {**registry.empty_registries(v.spark), "assets": registry.conform(_stored(v, by_path=True), "assets"), "grids": registry.conform(stale, "grids"),
              "products": registry.conform(_product_records(v), "products")}
    after = registry.rebuild(before, _file_facts(v), _sidecars(v), v.spark.createDataFrame([], "collection string, collection_metadata string"), _NOW)
    grids = after["grids"].select(F.lit("grids").alias("table_name"), F.col("grid_id").alias("key"), *[F.lit(None).cast("string").alias(c) for c in _E05_COLUMNS],
                                  F.lit(None).cast("bigint").alias("byte_size"), "created_at", "updated_at")
    rows = after["assets"].select(F.lit("assets").alias("table_name"), F.col("asset_id").alias("key"), *_E05_COLUMNS, "byte_size", "created_at", "updated_at")
    return rows.unionByName(grids)


@query("u02_delta_upsert", f"""
    WITH kept AS (SELECT * FROM v_raw WHERE arrived_at < '{CUTOFF}' OR l_orderkey % 100 = 0),
         first AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY arrived_at, l_partkey, l_suppkey) = 1),
         last AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY arrived_at DESC, l_partkey DESC, l_suppkey DESC) = 1)
    SELECT l.asset_id, l.product_id, f.status, f.run_id, f.created_at, l.updated_at, l.byte_size FROM last l JOIN first f USING (asset_id)""", "v_raw")
def u02_delta(v: Views):
    """One order in a hundred arrives anew: a merge into the store, which rewrites only the parts they fall into."""
    names = ["product_id", "source_item_id", "status", "run_id", "created_at", "updated_at", "byte_size"]
    s = v.sightings().select("asset_id", "l_orderkey", *names, *ARRIVAL)

    def fold(df):
        first = ["status", "run_id", "created_at"]
        return registry.fold_arrivals(df, "asset_id", ARRIVAL, first=first, last=[n for n in names if n not in first])

    store = RegistryStore(v.spark, f"{scratch_dir(v.spark)}/{uuid.uuid4().hex}")
    store.write("assets", fold(s.filter(F.col("arrived_at") < CUTOFF)))
    delta = fold(s.filter((F.col("arrived_at") >= CUTOFF) & (F.col("l_orderkey") % 100 == 0)))
    store.merge({"assets": registry.conform(delta, "assets")})
    return store.read("assets").select("asset_id", "product_id", "status", "run_id", "created_at", "updated_at", "byte_size")


@query("j05_stale_grids", """
    WITH grids AS (
      SELECT 'hls_mgrs_30m_' || c_custkey AS grid_id, CASE WHEN c_custkey % 3 = 0 THEN epsg END AS epsg FROM v_geo),
    used AS (SELECT DISTINCT 'hls_mgrs_30m_' || o_custkey AS grid_id FROM v_raw)
    SELECT grid_id, epsg FROM grids WHERE NOT (epsg IS NULL AND grid_id NOT IN (SELECT grid_id FROM used))""", "v_geo", "v_raw")
def j05(v: Views):
    grids = v.geo().select(
        F.concat(F.lit("hls_mgrs_30m_"), "c_custkey").alias("grid_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("epsg")).alias("epsg")
    )
    used = v.sightings().select(F.concat(F.lit("hls_mgrs_30m_"), "o_custkey").alias("grid_id"))
    return registry.drop_stale_grids(grids, used)


@query("a06_run_outputs", """
    SELECT run_id, count(DISTINCT asset_id) AS output_count, sha256(string_agg(DISTINCT asset_id, chr(10) ORDER BY asset_id)) AS checksum
    FROM v_assets GROUP BY run_id""", "v_assets")
def a06(v: Views):
    return registry.run_digests(v.assets("run_id"))


@query("u04_run_upsert", """
    WITH outs AS (SELECT run_id, sha256(string_agg(DISTINCT asset_id, chr(10) ORDER BY asset_id)) AS checksum FROM v_assets GROUP BY run_id)
    SELECT r.run_id, CASE WHEN r.status = 'failed' THEN 'running' ELSE r.status END AS status, r.start_time,
           CASE WHEN r.status = 'failed' THEN NULL ELSE r.end_time END AS end_time,
           CASE WHEN r.status = 'failed' THEN NULL ELSE coalesce(o.checksum, sha256('')) END AS checksum
    FROM v_run_records r LEFT JOIN outs o USING (run_id)""", "v_assets", "v_run_records")
def u04(v: Views):
    records = v.run_records()
    started = records.select("run_id", "start_time", F.lit("running").alias("status"))
    running = registry.start_runs(registry.empty_registries(v.spark)["processing_runs"], started)
    finished = records.filter("status <> 'failed'").select("run_id", "status", "end_time")
    closed, _ = registry.finish_runs(running, finished, v.assets("run_id"))
    return closed.select("run_id", "status", "start_time", "end_time", "checksum")


@query("l01_registry_page", """
    SELECT asset_id, updated_at, byte_size FROM v_assets ORDER BY updated_at DESC, asset_id LIMIT 100 OFFSET 100""", "v_assets")
def l01(v: Views):
    return catalog.registry_page(v.assets("updated_at", "byte_size"), "assets", offset=100, limit=100)


@query("l01_registry_deep_page", """
    SELECT asset_id, updated_at, byte_size FROM v_assets ORDER BY updated_at DESC, asset_id LIMIT 100 OFFSET 20000""", "v_assets")
def l01_deep(v: Views):
    return catalog.registry_page(v.assets("updated_at", "byte_size"), "assets", offset=20000, limit=100)


@query("p01_normalize_row", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def p01(v: Views):
    rows = catalog.normalize_json(v.table("events").select("event_id", F.col("props").alias("props_json")), ["props_json"])
    return rows.select("event_id", F.variant_get("props", "$.k", "bigint").alias("k"))


@query("p02_eq_filter_assets", """
    SELECT asset_id, local_path, byte_size FROM v_assets WHERE product_id = 'hlsl30_v2.0' AND status = 'skipped'""", "v_assets")
def p02(v: Views):
    rows = v.assets("product_id", "status", "local_path", "byte_size")
    return catalog.search_assets(rows, product_id="hlsl30_v2.0", status="skipped").select("asset_id", "local_path", "byte_size")


@query("p03_registry_text_search", """
    SELECT asset_id, local_path, status FROM v_assets
    WHERE lower(asset_id) LIKE '%7.b04%' OR lower(local_path) LIKE '%7.b04%' OR lower(status) LIKE '%7.b04%'""", "v_assets")
def p03(v: Views):
    return catalog.search_rows(v.assets("local_path", "status"), "7.B04").select("asset_id", "local_path", "status")


def _laid_out(v: Views, *columns: str):
    newest = F.coalesce("updated_at", F.lit("")).desc()
    return write_search_layout(v.assets(*columns), scratch_folder(v.spark), [newest, F.col("asset_id")], keys=["asset_id"], rows_per_part=5_000)


@query("p03_indexed_text_search", """
    SELECT asset_id, local_path, status FROM v_assets
    WHERE lower(asset_id) LIKE '%99.b04%' OR lower(local_path) LIKE '%99.b04%' OR lower(status) LIKE '%99.b04%'""", "v_assets")
def p03_indexed(v: Views):
    """Only parts that hold every trigram of the text are read."""
    return _laid_out(v, "local_path", "status", "updated_at").search("99.B04").select("asset_id", "local_path", "status")


@query("l01_indexed_page", """
    SELECT asset_id, updated_at, byte_size FROM v_assets ORDER BY updated_at DESC, asset_id LIMIT 100 OFFSET 4950""", "v_assets")
def l01_indexed(v: Views):
    """A page over two parts."""
    return _laid_out(v, "updated_at", "byte_size").page(offset=4950, limit=100).select("asset_id", "updated_at", "byte_size")


@query("p04_indexed_lookup", """
    SELECT asset_id, updated_at, byte_size FROM v_assets WHERE asset_id = (SELECT max(asset_id) FROM v_assets)""", "v_assets")
def p04_indexed(v: Views):
    laid = _laid_out(v, "updated_at", "byte_size")
    last = laid.read().agg(F.max("asset_id")).first()[0]
    return laid.lookup(asset_id=last).select("asset_id", "updated_at", "byte_size")


@query("p03_text_search_with_keys", """
    SELECT run_id, request FROM v_runs
    WHERE lower('{"run_id":' || run_id || ',"request":"' || request || '"}') LIKE '%request":"1-urg%'""", "v_runs")
def p03_keys(v: Views):
    return catalog.search_rows(v.runs().select("run_id", "request"), 'request":"1-URG', include_keys=True)


@query("p04_point_lookup", "SELECT run_id, created_at, status FROM v_runs WHERE run_id = 42", "v_runs")
def p04(v: Views):
    return catalog.lookup(v.runs().select("run_id", "created_at", "status"), run_id=42)


@query("f01_safe_component", r"""
    WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '/', '\') WHEN 2 THEN url || '/./'
                      WHEN 3 THEN url || '/..' ELSE '' END AS raw FROM pages),
    u AS (SELECT page_id, regexp_replace(replace(CASE raw WHEN '' THEN 'unknown' ELSE raw END, '\', '/'), '(/\.?)+$', '') AS path FROM t)
    SELECT page_id, CASE WHEN list_last(string_split(path, '/')) IN ('', '.', '..') THEN 'unknown'
                    ELSE substr(list_last(string_split(path, '/')), 1, 120) END AS component FROM u""")
def f01(v: Views):
    n, url = F.col("page_id") % 5, F.col("url")
    raw = (
        F.when(n == 0, url).when(n == 1, F.translate(url, "/", "\\")).when(n == 2, F.concat(url, F.lit("/./")))
        .when(n == 3, F.concat(url, F.lit("/.."))).otherwise("")
    )
    return v.table("pages").select("page_id", text.safe_component(raw).alias("component"))


@query("f02_asset_filename", r"""
    WITH t AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages)
    SELECT page_id, CASE WHEN regexp_replace(url_decode(path), '(/\.?)+$', '') = '' THEN 'page.data'
           ELSE substr(list_last(string_split(regexp_replace(url_decode(path), '(/\.?)+$', ''), '/')), 1, 120) END AS filename
    FROM t""")
def f02(v: Views):
    return v.table("pages").select("page_id", text.asset_filename(F.lit("page"), F.col("url")).alias("filename"))


@query("f03_asset_path", "SELECT DISTINCT asset_id, local_path FROM v_raw", "v_raw")
def f03(v: Views):
    name = text.asset_filename(F.col("asset_key"), F.col("source_url"))
    path = text.asset_path(F.col("catalog"), F.col("collection"), F.col("source_item_id"), name)
    return v.sightings().select("asset_id", path.alias("local_path")).distinct()


@query("f04_link_asset_key", "SELECT asset_key, count(*) AS links FROM v_raw GROUP BY asset_key", "v_raw")
def f04(v: Views):
    key = text.link_asset_key(text.asset_filename(F.lit("data"), F.col("source_url")))
    return v.sightings().groupBy(key.alias("asset_key")).agg(F.count(F.lit(1)).alias("links"))


@query("f12_preview_cache_key", """
    SELECT asset_id, substr(sha256(local_path), 1, 24) || '-' || lower(to_hex(byte_size)) || '-preview-v1' AS preview_cache_key
    FROM v_assets""", "v_assets")
def f12(v: Views):
    return v.assets("local_path", "byte_size").select(
        "asset_id", text.preview_key(F.sha2("local_path", 256), F.col("byte_size")).alias("preview_cache_key")
    )


@query("f14_product_semantics", """
    SELECT product_id, CASE WHEN collection LIKE 'HLS%' OR collection LIKE 'sentinel%' THEN 'observation'
                            WHEN collection LIKE 'era5%' THEN 'forcing' ELSE 'static' END AS modality,
           CASE WHEN collection LIKE 'HLS%' THEN '2.0' ELSE 'unknown' END AS product_version,
           CASE WHEN collection LIKE 'HLS%' THEN 'hls_mgrs_30m' ELSE product_id || '_native' END AS grid_id, count(*) AS assets
    FROM v_raw GROUP BY ALL""", "v_raw")
def f14(v: Views):
    c = F.col("collection")
    rows = v.sightings().groupBy("product_id", "collection").agg(F.count(F.lit(1)).alias("assets"))
    return rows.select(
        "product_id", semantics.modality(c).alias("modality"), semantics.product_version(c).alias("product_version"),
        semantics.fallback_grid_id(c).alias("grid_id"), "assets",
    )


def _rasters(v: Views, zero_every: int = 0):
    """Scene rasters; with ``zero_every`` some without facts and some with zero sizes."""
    size = F.lit(3660) if not zero_every else F.when(F.col("c_custkey") % zero_every == 0, 0).otherwise(3660)
    fields = {
        "crs_wkt": F.lit(None).cast("string"), "epsg": F.col("epsg"),
        "transform": F.array(F.lit(30.0), F.lit(0.0), F.col("easting"), F.lit(0.0), F.lit(-30.0), F.col("northing")),
        "x_origin": F.col("easting"), "y_origin": F.col("northing"), "pixel_size_x": F.lit(30.0),
        "pixel_size_y": F.lit(-30.0), "width": size, "height": size,
    }
    raster = F.struct(*[c.alias(n) for n, c in fields.items()])
    if zero_every:
        raster = F.when(F.col("c_custkey") % 3 != 0, raster)
    return v.geo().withColumns({
        "raster": raster, "collection": F.when(F.col("c_custkey") % 2 == 0, "HLSL30_V2.0").otherwise("sentinel-2-l2a")
    })


@query("f15_grid_id", """
    SELECT asset_id, CASE WHEN c_custkey % 2 = 0 THEN 'hls_mgrs_30m' ELSE 'sentinel-2-l2a_native' END || '_epsg' || epsg || '_' ||
           substr(sha1('{"epsg": ' || epsg || ', "height": 3660, "transform": [30.0, 0.0, ' || CAST(easting AS BIGINT) || '.0, 0.0, -30.0, '
                       || CAST(northing AS BIGINT) || '.0], "width": 3660}'), 1, 12) AS grid_id
    FROM v_geo""", "v_geo")
def f15(v: Views):
    return _rasters(v).select("asset_id", semantics.grid_id(F.col("collection"), F.col("raster")).alias("grid_id"))


@query("f16_grid_defaults", """
    SELECT asset_id, CASE WHEN c_custkey % 2 = 0 THEN 'MGRS/UTM per tile' ELSE 'source-native' END AS crs_wkt,
           CASE WHEN c_custkey % 3 <> 0 THEN epsg END AS epsg,
           CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 2 = 0 THEN 30.0::DOUBLE END AS pixel_size_x,
           CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN 3660 WHEN c_custkey % 2 = 0 THEN 3660 END AS tile_width,
           CASE WHEN c_custkey % 2 = 0 THEN 'MGRS' ELSE 'source-native' END AS tile_scheme
    FROM v_geo""", "v_geo")
def f16(v: Views):
    columns = semantics.grid_columns(F.col("collection"), F.col("raster"))
    names = ["crs_wkt", "epsg", "pixel_size_x", "tile_width", "tile_scheme"]
    return _rasters(v, zero_every=7).select("asset_id", *[columns[n].alias(n) for n in names])


@query("f17_variable_semantics", f"""
    SELECT variable_id, coalesce(canonical_name, source_product || '_' || lower(asset_key)) AS canonical_name,
           coalesce(long_name, asset_key) AS long_name, unit, scale_factor, coalesce(role, 'data') AS role,
           wavelength AS central_wavelength_nm,
           CASE WHEN canonical_name IS NOT NULL THEN 'instantaneous' WHEN collection = 'cop-dem-glo-30' THEN 'static' END AS temporal_type
    FROM v_variables LEFT JOIN {BANDS_SQL} ON collection = b_collection AND asset_key = b_key""", "v_variables")
def f17(v: Views):
    rows = registry.with_profile_band(
        v.variables().withColumn("raster", F.lit(None).cast(RASTER_DDL)).withColumn("modality", semantics.modality(F.col("collection")))
    )
    facts = semantics.variable_columns(F.col("source_product"), F.col("modality"), F.col("raster"), "b_")
    names = ["canonical_name", "long_name", "unit", "scale_factor", "role", "central_wavelength_nm", "temporal_type"]
    return rows.select("variable_id", *[facts[n].alias(n) for n in names])


@query("j06_profile_lookup", f"""
    SELECT coalesce(canonical_name, 'none') AS canonical_name, count(*) AS assets, CAST(sum(byte_size) AS BIGINT) AS byte_size
    FROM v_raw LEFT JOIN {BANDS_SQL} ON collection = b_collection AND asset_key = b_key GROUP BY 1""", "v_raw")
def j06(v: Views):
    joined = registry.with_profile_band(v.sightings().select("collection", "asset_key", "byte_size"))
    return joined.groupBy(F.coalesce("b_canonical_name", F.lit("none")).alias("canonical_name")).agg(
        F.count(F.lit(1)).alias("assets"), F.sum("byte_size").alias("byte_size")
    )


@query("j07_source_info", f"""
    SELECT provider, endpoint, auth_type, count(*) AS assets FROM v_raw JOIN {SOURCES_SQL} ON catalog = s_catalog GROUP BY ALL""", "v_raw")
def j07(v: Views):
    return registry.with_source_info(v.sightings().select("catalog")).groupBy("provider", "endpoint", "auth_type").agg(
        F.count(F.lit(1)).alias("assets")
    )


@query("j01_product_assets_left", """
    SELECT p.product_id, count(a.asset_id) AS asset_count FROM v_products p LEFT JOIN v_assets a USING (product_id) GROUP BY 1""",
       "v_products", "v_assets")
def j01(v: Views):
    return catalog.product_rollup(v.products(), v.assets("product_id", "byte_size", "datetime"), v.variables()).select("product_id", "asset_count")


@query("j02_product_variables_left", """
    SELECT p.product_id, v.variable_id FROM v_products p LEFT JOIN v_variables v ON v.source_product = p.product_id""",
       "v_products", "v_variables")
def j02(v: Views):
    return catalog.product_variables(v.products(), v.variables().select("variable_id", "source_product"))


@query("a02_registry_counts", """
    SELECT 'assets' AS table_name, count(*) AS row_count FROM v_assets UNION ALL SELECT 'variables', count(*) FROM v_variables
    UNION ALL SELECT 'products', count(*) FROM v_products UNION ALL SELECT 'processing_runs', count(*) FROM v_run_records""",
       "v_assets", "v_variables", "v_products", "v_run_records")
def a02(v: Views):
    return registry.registry_counts({**_registry(v), "assets": v.assets()})


@query("a03_lake_summary", """
    WITH miss AS (SELECT count(*) AS n FROM (SELECT path FROM v_registered EXCEPT SELECT path FROM v_source_files)),
         extra AS (SELECT count(*) AS n FROM (SELECT path FROM v_source_files EXCEPT SELECT path FROM v_registered))
    SELECT count(*) AS asset_count, CAST(sum(byte_size) AS BIGINT) AS asset_bytes, count(*) - (SELECT n FROM miss) AS available_assets,
           (SELECT n FROM miss) AS missing_assets, (SELECT n FROM extra) AS unregistered_source_files,
           (SELECT arg_max(end_time, (start_time, run_id)) FROM v_run_records WHERE status = 'completed') AS last_successful_run
    FROM v_assets""", "v_assets", "v_registered", "v_source_files", "v_run_records")
def a03(v: Views):
    assets = v.assets("byte_size", "status")
    return catalog.lake_summary(assets, v.run_records(), audit.path_audit(v.sightings().select("local_path"), v.files()))


@query("a03_lake_summary_by_status", """
    SELECT count(*) AS asset_count, CAST(sum(byte_size) AS BIGINT) AS asset_bytes, count(*) - count(*) FILTER (status = 'missing') AS available_assets,
           count(*) FILTER (status = 'missing') AS missing_assets, 0 AS unregistered_source_files,
           (SELECT arg_max(end_time, (start_time, run_id)) FROM v_run_records WHERE status = 'completed') AS last_successful_run
    FROM (SELECT byte_size, CASE WHEN status = 'skipped' AND l_linenumber = 3 THEN 'missing' ELSE status END AS status FROM v_assets)""",
       "v_assets", "v_run_records")
def a03_status(v: Views):
    lost = (F.col("status") == "skipped") & (F.col("l_linenumber") == 3)
    assets = v.assets("byte_size", "status", "l_linenumber").withColumn("status", F.when(lost, "missing").otherwise(F.col("status")))
    return catalog.lake_summary(assets, v.run_records())


@query("a04_layer_stats_registry", """
    WITH dirs AS (
      SELECT DISTINCT 'source/' || catalog AS d FROM v_raw UNION SELECT DISTINCT 'source/' || catalog || '/' || collection FROM v_raw
      UNION SELECT DISTINCT 'source/' || catalog || '/' || collection || '/' || source_item_id FROM v_raw),
    known AS (
      SELECT 'source' AS layer, count(*) AS file_count, (SELECT count(*) FROM dirs) AS directory_count, CAST(sum(byte_size) AS BIGINT) AS byte_size,
             max(updated_at) AS modified_at FROM v_assets
      UNION ALL SELECT 'catalog', count(DISTINCT source_item_id), 0, 0, max(updated_at) FROM v_assets
      UNION ALL SELECT 'registry', 4, 0, 0, greatest((SELECT max(updated_at) FROM v_assets), (SELECT max(start_time) FROM v_run_records))
      UNION ALL SELECT 'manifests', count(*), 0, 0, max(end_time) FROM v_run_records)
    SELECT l.layer, coalesce(file_count, 0) AS file_count, coalesce(directory_count, 0) AS directory_count,
           coalesce(byte_size, 0) AS byte_size, modified_at
    FROM (VALUES ('protocol'), ('catalog'), ('registry'), ('source'), ('entities'), ('arrays'), ('virtual'), ('manifests'), ('cache')) l(layer)
    LEFT JOIN known USING (layer)""", "v_assets", "v_run_records")
def a04(v: Views):
    tables = _registry(v)
    none = F.lit(None).cast("string")
    return catalog.layer_stats({n: (df if "updated_at" in df.columns or "start_time" in df.columns else df.withColumn("updated_at", none)) for n, df in tables.items()})


@query("a05_layer_stats_scan", """
    WITH f AS (SELECT * FROM v_inventory WHERE path NOT LIKE '%/._%')
    SELECT l.layer, coalesce(n, 0) AS file_count, coalesce(d, 0) AS directory_count, coalesce(b, 0) AS byte_size, m AS modified_at
    FROM (VALUES ('protocol'), ('catalog'), ('registry'), ('source'), ('entities'), ('arrays'), ('virtual'), ('manifests'), ('cache')) l(layer)
    LEFT JOIN (SELECT split_part(path, '/', 1) AS layer, count(*) FILTER (kind = 'file') AS n, count(*) FILTER (kind = 'directory') AS d, CAST(sum(byte_size) AS BIGINT) AS b, max(modified_at) AS m FROM f GROUP BY 1) s USING (layer)""",
       "v_inventory")
def a05(v: Views):
    return audit.layer_scan(v.inventory())


@query("a14_distinct_options", "SELECT DISTINCT asset_key FROM v_raw ORDER BY 1", "v_raw")
def a14(v: Views):
    return catalog.distinct_options(v.sightings(), "asset_key")


@query("a16_layer_share", """
    WITH s AS (SELECT product_id AS layer, CAST(sum(byte_size) AS BIGINT) AS byte_size FROM v_assets GROUP BY 1)
    SELECT layer, byte_size, byte_size / greatest((SELECT max(byte_size) FROM s), 1) AS share FROM s""", "v_assets")
def a16(v: Views):
    sizes = v.assets("product_id", "byte_size").groupBy(F.col("product_id").alias("layer")).agg(F.sum("byte_size").alias("byte_size"))
    return catalog.layer_share(sizes)


@query("j03_missing_assets", "SELECT path FROM v_registered EXCEPT SELECT path FROM v_source_files", "v_registered", "v_source_files")
def j03(v: Views):
    return audit.missing_assets(v.sightings().select("local_path"), v.files())


@query("j04_unregistered_files", "SELECT path FROM v_source_files EXCEPT SELECT path FROM v_registered", "v_registered", "v_source_files")
def j04(v: Views):
    return audit.unregistered_files(v.sightings().select("local_path"), v.files())


@query("j03_missing_by_range", "SELECT path FROM v_registered EXCEPT SELECT path FROM v_source_files", "v_registered", "v_source_files")
def j03_by_range(v: Views):
    """Only ranges of folders whose digests differ are joined. Both sides are read twice and so made once, from their joins."""
    return audit.missing_assets(materialize(v.sightings().select("local_path")), materialize(v.files().select("path", "kind")), by_range=True)


@query("u06_except_by_range", "SELECT path FROM v_files EXCEPT SELECT path FROM v_registered", "v_files", "v_registered")
def u06_by_range(v: Views):
    return audit.path_except(materialize(v.files().select("path")), materialize(audit.registered_paths(v.sightings().select("local_path"))), by_range=True)


@query("u06_path_except", "SELECT path FROM v_files EXCEPT SELECT path FROM v_registered", "v_files", "v_registered")
def u06(v: Views):
    return audit.path_except(v.files(), audit.registered_paths(v.sightings().select("local_path")))


@query("p16_source_files", """
    SELECT DISTINCT path FROM v_inventory WHERE kind = 'file' AND path NOT LIKE '%/metadata.json' AND path NOT LIKE '%.part' AND path NOT LIKE '%/._%'""", "v_inventory")
def p16(v: Views):
    return audit.source_files(v.inventory())


@query("s09_resource_listing", """
    SELECT path, kind, byte_size FROM v_inventory WHERE path LIKE 'source/%' ORDER BY lower(path), path LIMIT 500""", "v_inventory")
def s09(v: Views):
    return audit.list_layer(v.inventory(), "source").select("path", "kind", "byte_size")


@query("p10_previewable", """
    SELECT asset_id FROM v_assets WHERE local_path IN (SELECT path FROM v_files) AND l_linenumber % 2 = 0""", "v_assets", "v_files")
def p10(v: Views):
    grid = F.struct(
        F.lit(3660).alias("width"), F.when(F.col("l_linenumber") % 2 == 0, 3660).alias("height"),
        F.array(*[F.lit(float(n)) for n in (30, 0, 0, 0, -30, 0)]).alias("transform"),
    )
    assets = v.assets("local_path", "l_linenumber").withColumn("raster_metadata", grid)
    return audit.previewable_assets(assets, v.files()).select("asset_id")


@query("p11_safe_path_guard", r"""
    WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'source/a/' || page_id || '.TIF' WHEN 1 THEN 'source/../' || page_id || '.tif'
                      WHEN 2 THEN '/source/' || page_id || '.tif' WHEN 3 THEN 'source/' || page_id || '.nc' ELSE '' END AS p FROM pages)
    SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'outside the source layer' WHEN 2 THEN 'outside the source layer'
                    WHEN 3 THEN 'not a GeoTIFF' WHEN 4 THEN 'no local path' END AS error FROM t""")
def p11(v: Views):
    n, key = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = (
        F.when(n == 0, F.concat(F.lit("source/a/"), key, F.lit(".TIF"))).when(n == 1, F.concat(F.lit("source/../"), key, F.lit(".tif")))
        .when(n == 2, F.concat(F.lit("/source/"), key, F.lit(".tif"))).when(n == 3, F.concat(F.lit("source/"), key, F.lit(".nc"))).otherwise("")
    )
    return v.table("pages").select("page_id", text.path_error(path).alias("error"))


@query("e07_transfer_outcomes", """
    SELECT a.asset_id, CASE WHEN f.path IS NULL THEN 'downloaded' WHEN a.byte_size % 3 = 0 AND f.byte_size <> a.byte_size THEN 'failed' ELSE 'skipped' END AS outcome
    FROM v_assets a LEFT JOIN (SELECT DISTINCT path, byte_size FROM v_files) f ON f.path = a.local_path""", "v_assets", "v_files")
def e07(v: Views):
    jobs = v.assets("local_path", "byte_size").select(
        "asset_id", F.col("local_path").alias("destination"),
        F.when(F.col("byte_size") % 3 == 0, F.col("byte_size")).otherwise(0).alias("expected_size"),
    )
    return planning.transfer_outcomes(jobs, v.files()).select("asset_id", "outcome")


@query("f20_media_type", """
    SELECT CASE WHEN path LIKE '%.json' THEN 'application/json' WHEN path LIKE '%.tif' THEN 'image/tiff' ELSE 'application/octet-stream' END AS media_type,
           count(*) AS files FROM v_inventory WHERE kind = 'file' GROUP BY 1""", "v_inventory")
def f20(v: Views):
    return v.inventory().filter("kind = 'file'").groupBy(text.media_type(F.col("path")).alias("media_type")).agg(F.count(F.lit(1)).alias("files"))


@query("f25_source_catalog", "SELECT split_part(path, '/', 2) AS catalog, count(*) AS files FROM v_inventory WHERE kind = 'file' GROUP BY 1", "v_inventory")
def f25(v: Views):
    return v.inventory().filter("kind = 'file'").groupBy(text.source_catalog(F.col("path")).alias("catalog")).agg(F.count(F.lit(1)).alias("files"))


@query("f18_optional_float", "SELECT page_id, try_cast(regexp_extract(url, '([^/]*)$', 1) AS DOUBLE) AS number FROM pages")
def f18(v: Views):
    return v.table("pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).try_cast("double").alias("number"))


@query("p13_product_filter", """
    SELECT DISTINCT product_id FROM v_raw WHERE collection NOT LIKE 'era5%' AND collection NOT LIKE 'cop%' AND lower(product_id) LIKE '%hls%'""", "v_raw")
def p13(v: Views):
    rows = v.sightings().select("product_id", semantics.modality(F.col("collection")).alias("modality")).distinct()
    return catalog.filter_products(rows, modality="observation", query="HLS").select("product_id")


@query("s13_catalog_tree", """
    SELECT collection, source_item_id, 'B0' || l_linenumber % 3 AS key, local_path AS href, 'image/tiff' AS type, asset_id, sha256(local_path) AS checksum, run_id AS lineage
    FROM v_assets QUALIFY row_number() OVER (PARTITION BY catalog, collection, source_item_id, l_linenumber % 3 ORDER BY l_linenumber DESC) = 1""", "v_assets")
def s13(v: Views):
    """Files of the item documents; keys such as d1/B01 and d4/B01 shorten to the same name, and the last stays."""
    from ..sources.catalog_tree import item_files

    rows = v.assets("collection", "catalog", "source_item_id", "l_linenumber", "local_path", "run_id", "datetime", "product_id")
    key = F.concat(F.lit("d"), "l_linenumber", F.lit("/B0"), F.col("l_linenumber") % 3)
    rows = rows.withColumns({"asset_key": key, "checksum_sha256": F.sha2("local_path", 256), "media_type": F.lit("image/tiff")})
    a = F.col("asset")
    return item_files(rows).select(
        "collection", "source_item_id", "key", a["href"].alias("href"), a["type"].alias("type"), a["lake:asset_id"].alias("asset_id"),
        a["lake:checksum_sha256"].alias("checksum"), a["lake:lineage_id"].alias("lineage"),
    )


@query("s13_item_heads", """
    SELECT catalog, collection, source_item_id, arg_min(datetime, (asset_key, asset_id)) AS datetime FROM v_assets GROUP BY ALL""", "v_assets")
def s13_heads(v: Views):
    from ..sources.catalog_tree import item_documents

    rows = v.assets("collection", "catalog", "source_item_id", "asset_key", "datetime", "product_id")
    nothing = {"grid_id": F.lit("g"), "bbox": F.lit(None).cast("array<double>"), "geometry": F.lit(None).cast("string")}
    return item_documents(rows.withColumns(nothing)).select("catalog", "collection", "source_item_id", "datetime")


@query("l01_registry_total", "SELECT count(*) AS total, 'asset_id,updated_at,byte_size' AS columns FROM v_assets", "v_assets")
def l01_total(v: Views):
    rows = v.assets("updated_at", "byte_size").select("asset_id", "updated_at", "byte_size")
    return catalog.page_summary(rows).withColumn("columns", F.array_join("columns", ","))


@query("a01_product_bboxes", """
    SELECT product_id, asset_id, west, south, east, north FROM v_geo WHERE c_custkey % 4 <> 0""", "v_geo")
def a01_bboxes(v: Views):
    box = F.when(F.col("c_custkey") % 4 != 0, F.array("west", "south", "east", "north"))
    scenes = v.geo().select("product_id", "asset_id", box.alias("bbox"))
    rows = catalog.product_bboxes(scenes.select("product_id").distinct(), scenes)
    return rows.select("product_id", "asset_id", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("west", "south", "east", "north"))])


@query("s01_registry_roundtrip", """
    SELECT asset_id, product_id, local_path, byte_size, CAST(NULL AS VARCHAR) AS grid_id FROM v_assets""", "v_assets")
def s01(v: Views):
    """Write a registry version, with a column too many and some absent, and read it back (S01, S02, S03)."""
    store = RegistryStore(v.spark, f"{scratch_dir(v.spark)}/{uuid.uuid4().hex}")
    store.write("assets", v.assets("product_id", "local_path", "byte_size").withColumn("surplus", F.lit(1)))
    return store.read("assets").select("asset_id", "product_id", "local_path", "byte_size", "grid_id")


@query("p15_junk_filter", "SELECT path FROM v_inventory WHERE path NOT LIKE '%/._%'", "v_inventory")
def p15(v: Views):
    return v.inventory().filter(~text.is_junk_file(F.substring_index("path", "/", -1))).select("path")
