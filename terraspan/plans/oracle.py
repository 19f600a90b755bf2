"""DuckDB counterparts of the views, as named common table expressions."""

from __future__ import annotations

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "v_raw0": ((), """
        SELECT CASE o_orderstatus WHEN 'F' THEN 'microsoft' WHEN 'O' THEN 'earth-search' ELSE 'nasa' END AS catalog,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'HLSL30_V2.0' WHEN '2-HIGH' THEN 'HLSS30_V2.0'
                    WHEN '3-MEDIUM' THEN 'sentinel-2-l2a' WHEN '4-NOT SPECIFIED' THEN 'era5-land' ELSE 'cop-dem-glo-30' END AS collection,
               'item-' || l_orderkey AS source_item_id, 'B0' || l_linenumber AS asset_key,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS byte_size,
               strftime(l_shipdate, '%Y-%m-%dT00:00:00Z') AS datetime,
               CASE WHEN l_linestatus = 'F' THEN 'downloaded' ELSE 'skipped' END AS status,
               'run-' || l_suppkey AS run_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "v_raw1": (("v_raw0",), """
        SELECT *, 'https://example/' || collection || '/' || l_orderkey || '.' || asset_key || '.tif' AS source_url,
               'source/' || catalog || '/' || collection || '/' || source_item_id || '/' || l_orderkey || '.' || asset_key || '.tif' AS local_path,
               lower(collection) AS product_id, datetime AS arrived_at, datetime AS created_at, datetime AS updated_at
        FROM v_raw0"""),
    "v_raw": (("v_raw1",), """
        SELECT *, sha256(catalog || '|' || collection || '|' || source_item_id || '|' || asset_key || '|' || source_url) AS asset_id
        FROM v_raw1"""),
    "v_assets": (("v_raw",), """
        SELECT l.* EXCLUDE (status, run_id, created_at, rn), f.status, f.run_id, f.created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY arrived_at DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM v_raw) l
        JOIN (SELECT asset_id, status, run_id, created_at,
                     row_number() OVER (PARTITION BY asset_id ORDER BY arrived_at, l_partkey, l_suppkey) AS rn FROM v_raw) f
          ON l.asset_id = f.asset_id
        WHERE l.rn = 1 AND f.rn = 1"""),
    "v_variables": (("v_raw",), """
        SELECT DISTINCT product_id || ':' || asset_key AS variable_id, product_id AS source_product, collection, asset_key FROM v_raw"""),
    "v_products": ((), """
        SELECT DISTINCT lower(collection) AS product_id, collection FROM (
          SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'HLSL30_V2.0' WHEN '2-HIGH' THEN 'HLSS30_V2.0'
                    WHEN '3-MEDIUM' THEN 'sentinel-2-l2a' WHEN '4-NOT SPECIFIED' THEN 'era5-land' ELSE 'cop-dem-glo-30' END AS collection
          FROM orders)"""),
    "v_files": (("v_raw",), """
        SELECT path, 'file' AS kind, length(path) * 10 AS byte_size, '2024-01-01T00:00:00Z' AS modified_at FROM (
          SELECT DISTINCT local_path AS path FROM v_raw WHERE l_orderkey % 17 <> 0
          UNION ALL SELECT 'source/nasa/extra/' || o_orderkey || '.tif' FROM orders WHERE o_orderkey % 101 = 0
          UNION ALL SELECT 'source/nasa/extra/' || o_orderkey || '/metadata.json' FROM orders WHERE o_orderkey % 101 = 0
          UNION ALL SELECT 'source/nasa/extra/' || o_orderkey || '.tif.part' FROM orders WHERE o_orderkey % 101 = 0
          UNION ALL SELECT 'source/nasa/extra/._' || o_orderkey || '.tif' FROM orders WHERE o_orderkey % 101 = 0)"""),
    "v_inventory": (("v_raw",), """
        SELECT path, kind, CASE kind WHEN 'file' THEN length(path) * 10 ELSE 0 END AS byte_size, '2024-01-01T00:00:00Z' AS modified_at FROM (
          SELECT DISTINCT local_path AS path, 'file' AS kind FROM v_raw
          UNION ALL SELECT 'source/nasa/extra/' || o_orderkey || '.tif', 'file' FROM orders
          UNION ALL SELECT 'source/nasa/extra/' || o_orderkey || '/metadata.json', 'file' FROM orders
          UNION ALL SELECT 'source/nasa/extra/' || o_orderkey || '.tif.part', 'file' FROM orders
          UNION ALL SELECT 'source/nasa/extra/._' || o_orderkey || '.tif', 'file' FROM orders
          UNION ALL SELECT * FROM (SELECT 'source/' || catalog, 'directory' FROM v_raw UNION SELECT 'source/' || catalog || '/' || collection, 'directory' FROM v_raw
            UNION SELECT 'source/' || catalog || '/' || collection || '/' || source_item_id, 'directory' FROM v_raw))"""),
    "v_registered": (("v_raw",), "SELECT DISTINCT local_path AS path FROM v_raw"),
    "v_source_files": (("v_files",), """
        SELECT DISTINCT path FROM v_files
        WHERE path LIKE 'source/%' AND path NOT LIKE '%/metadata.json' AND path NOT LIKE '%.part' AND path NOT LIKE '%/._%'"""),
    "v_page_items": (("v_raw",), """
        SELECT l_suppkey % 10 AS run_id, catalog, collection, source_item_id, l_linenumber AS page_number, l_partkey, l_suppkey, arrived_at
        FROM v_raw"""),
    "v_search_pages": (("v_page_items",), """
        SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY page_number, l_partkey, l_suppkey, arrived_at, source_item_id) - 1) // 100 + 1 AS page
        FROM v_page_items"""),
    "v_item_assets": (("v_raw",), """
        SELECT *, count(*) OVER (PARTITION BY catalog, collection, source_item_id) AS n,
               row_number() OVER (PARTITION BY catalog, collection, source_item_id ORDER BY asset_key) - 1 AS position
        FROM (SELECT DISTINCT catalog, collection, source_item_id, asset_key, source_url, local_path FROM v_raw)"""),
    "v_main_assets": (("v_item_assets",), """
        SELECT * FROM v_item_assets WHERE CASE collection
          WHEN 'HLSL30_V2.0' THEN asset_key IN ('B04', 'B05', 'Fmask')
          WHEN 'HLSS30_V2.0' THEN asset_key IN ('B04', 'B8A', 'Fmask')
          ELSE n = 1 OR lower(asset_key) IN ('visual', 'rendered_preview', 'overview', 'b04', 'b08', 'fmask') END"""),
    "v_pages": ((), """
        SELECT conv_id AS run_id, turn + 1 AS page_number,
               CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN 'page-' || (turn + 2) END AS outgoing_cursor
        FROM conversations"""),
    "v_attempts": ((), """
        SELECT user_id AS run_id, k % 10 AS batch_number, user_id || '-' || k AS attempt_id,
               CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'downloading' WHEN 'purchase' THEN 'completed'
                    WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'failed' END AS status,
               CAST(round(value * 1000) AS BIGINT) AS downloaded_bytes, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS updated_at,
               event_id AS seq, ts, k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""),
    "v_latest": (("v_attempts",), """
        SELECT * FROM v_attempts QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY updated_at DESC, seq DESC) = 1"""),
    "v_runs": ((), """
        SELECT o_orderkey AS run_id, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'partial' END AS status,
               'cust-' || o_custkey AS idempotency_key, o_orderpriority AS request
        FROM orders"""),
    "v_run_records": (("v_raw",), """
        SELECT run_id, min(datetime) AS start_time, max(datetime) AS end_time,
               CASE WHEN max(l_suppkey) % 3 = 0 THEN 'failed' ELSE 'completed' END AS status
        FROM v_raw GROUP BY run_id"""),
    "v_geo": ((), """
        SELECT 'scene-' || c_custkey AS asset_id, *, west + c_custkey % 5 + 1 AS east, south + c_custkey % 5 + 1 AS north,
               32600 + c_nationkey % 60 + 1 AS epsg, CAST(300000 + (c_custkey * 100) % 400000 AS DOUBLE) AS easting,
               CAST(1000000 + (c_custkey * 977) % 7000000 AS DOUBLE) AS northing
        FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, lower(c_mktsegment) AS product_id,
                     CAST((c_custkey * 37) % 340 - 170 AS DOUBLE) AS west, CAST((c_custkey * 53) % 160 - 80 AS DOUBLE) AS south FROM customer)"""),
    "v_areas": ((), """
        SELECT *, west + 20 AS east, south + 20 AS north FROM (
          SELECT CAST(n_nationkey AS BIGINT) AS area_id, CAST((n_nationkey * 37) % 340 - 170 AS DOUBLE) AS west,
                 CAST((n_nationkey * 53) % 160 - 80 AS DOUBLE) AS south FROM nation)"""),
    "v_pixels": ((), """
        SELECT asset_id, CAST(pos // 8 AS INTEGER) AS "row", CAST(pos % 8 AS INTEGER) AS col,
               CAST(floor(CAST(x AS DOUBLE) * 1000) AS INTEGER) AS value, x > 0 AS valid
        FROM (SELECT vec_id AS asset_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)"""),
    "v_pixel_runs": (("v_pixels",), """
        SELECT asset_id, "row", min(col) AS first_col, max(col) AS last_col
        FROM (SELECT *, col - row_number() OVER (PARTITION BY asset_id, "row" ORDER BY col) AS island FROM v_pixels WHERE valid)
        GROUP BY asset_id, "row", island"""),
}


def with_views(body: str, *names: str, recursive: str = "") -> str:
    """``body`` after the WITH clause that defines ``names`` and all they need."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in CTE[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    clauses = [f"{name} AS ({CTE[name][1].strip()})" for name in ordered]
    if recursive:
        clauses.append(recursive.strip())
    if not clauses:
        return body.strip()
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(clauses) + "\n" + body
