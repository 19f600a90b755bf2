"""Declared schemas. Timestamps stay ISO-8601 text because ordering and min/max are defined on the text."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import types as T


@lru_cache(maxsize=None)
def parse(ddl: str) -> T.StructType:
    """Schema of a DDL text; needs an active session, hence not done at import."""
    return T.StructType.fromDDL(ddl)


GEOMETRY_DDL = "STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
RASTER_DDL = (
    "STRUCT<driver: STRING, crs_wkt: STRING, epsg: INT, transform: ARRAY<DOUBLE>, x_origin: DOUBLE, "
    "y_origin: DOUBLE, pixel_size_x: DOUBLE, pixel_size_y: DOUBLE, width: INT, height: INT, "
    "band_count: INT, dtype: STRING, nodata: STRING, description: STRING, tags: MAP<STRING, STRING>, "
    "bounds: ARRAY<DOUBLE>>"
)

REGISTRY: dict[str, str] = {
    "sources": (
        "source_id STRING, catalog STRING, provider STRING, endpoint STRING, auth_type STRING, "
        "created_at STRING, updated_at STRING"
    ),
    "products": (
        "product_id STRING, source_id STRING, collection_id STRING, product_name STRING, "
        "product_version STRING, modality STRING, processing_level STRING, license STRING, title STRING, "
        "description STRING, keywords ARRAY<STRING>, providers ARRAY<STRING>, temporal_start STRING, "
        "temporal_end STRING, documentation_urls ARRAY<STRING>, spatial_resolution_m DOUBLE, "
        "collection_metadata STRING, created_at STRING, updated_at STRING"
    ),
    "variables": (
        "variable_id STRING, canonical_name STRING, source_name STRING, long_name STRING, "
        "standard_name STRING, unit STRING, dtype STRING, scale_factor DOUBLE, add_offset DOUBLE, "
        "central_wavelength_nm DOUBLE, bandwidth_nm DOUBLE, valid_min DOUBLE, valid_max DOUBLE, "
        "fill_value STRING, nodata STRING, flag_values ARRAY<STRING>, flag_meanings STRING, "
        "quality_flag_definition STRING, profile_version STRING, modality STRING, role STRING, "
        "temporal_type STRING, temporal_support STRING, spatial_support STRING, quality_variable STRING, "
        "source_product STRING, processing_level STRING, created_at STRING, updated_at STRING"
    ),
    "grids": (
        "grid_id STRING, crs_wkt STRING, epsg INT, axis_order STRING, x_origin DOUBLE, y_origin DOUBLE, "
        "pixel_size_x DOUBLE, pixel_size_y DOUBLE, tile_width INT, tile_height INT, tile_scheme STRING, "
        "spatial_support STRING, transform ARRAY<DOUBLE>, width INT, height INT, created_at STRING, "
        "updated_at STRING"
    ),
    "assets": (
        "asset_id STRING, product_id STRING, grid_id STRING, source_item_id STRING, asset_key STRING, "
        "source_url STRING, local_path STRING, media_type STRING, byte_size BIGINT, "
        "checksum_sha256 STRING, datetime STRING, bbox ARRAY<DOUBLE>, "
        f"geometry {GEOMETRY_DDL}, raster_metadata {RASTER_DDL}, status STRING, run_id STRING, "
        "created_at STRING, updated_at STRING"
    ),
    "processing_runs": (
        "run_id STRING, code_commit STRING, container_image STRING, input_asset_ids ARRAY<STRING>, "
        "output_asset_ids ARRAY<STRING>, parameters STRING, start_time STRING, end_time STRING, "
        "status STRING, checksum STRING"
    ),
}

REGISTRY_KEY = {
    "sources": "source_id",
    "products": "product_id",
    "variables": "variable_id",
    "grids": "grid_id",
    "assets": "asset_id",
    "processing_runs": "run_id",
}

# Column a registry listing is ordered by, newest first.
REGISTRY_ORDER = {name: "start_time" if name == "processing_runs" else "updated_at" for name in REGISTRY}

ITEM_DDL = (
    "id STRING, collection STRING, bbox ARRAY<DOUBLE>, "
    f"geometry {GEOMETRY_DDL}, "
    "properties STRUCT<datetime: STRING, cloud_cover: STRING, producer_granule_id: STRING>, "
    "assets MAP<STRING, STRUCT<href: STRING, roles: ARRAY<STRING>>>"
)

GRANULE_RESPONSE_DDL = (
    "feed STRUCT<entry: ARRAY<STRUCT<id: STRING, time_start: STRING, cloud_cover: STRING, "
    "producer_granule_id: STRING, polygons: ARRAY<ARRAY<STRING>>, boxes: ARRAY<STRING>, "
    "links: ARRAY<STRUCT<rel: STRING, href: STRING>>>>>"
)

FILE_ENTRY_DDL = (
    "path STRING, name STRING, parent STRING, kind STRING, suffix STRING, byte_size BIGINT, modified_at STRING"
)


def registry_schema(table: str) -> T.StructType:
    if table not in REGISTRY:
        raise KeyError(table)
    return parse(REGISTRY[table])
