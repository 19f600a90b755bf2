"""Names under which SQL users reach the column rules. They are SQL functions, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# ---- fixed values: name, parameters, result type, body ----
FUNCTIONS = [
    (
        "safe_component", "value STRING, fallback STRING", "STRING",
        r"""CASE WHEN element_at(split(regexp_replace(translate(coalesce(nullif(value, ''), fallback), '\\', '/'), '(/\\.?)+$', ''), '/'), -1) IN ('', '.', '..')
            THEN fallback ELSE substring(element_at(split(regexp_replace(translate(coalesce(nullif(value, ''), fallback), '\\', '/'), '(/\\.?)+$', ''), '/'), -1), 1, 120) END""",
    ),
    ("source_catalog", "path STRING", "STRING", "CASE WHEN path LIKE 'source/_%' THEN split_part(path, '/', 2) ELSE 'unknown' END"),
    (
        "preview_key", "checksum STRING, byte_size BIGINT", "STRING",
        "CASE WHEN checksum <> '' THEN concat(substring(checksum, 1, 24), '-', coalesce(lower(hex(byte_size)), 'unknown'), '-preview-v1') END",
    ),
    (
        "bbox_overlaps", "aw DOUBLE, as_ DOUBLE, ae DOUBLE, an DOUBLE, bw DOUBLE, bs DOUBLE, be DOUBLE, bn DOUBLE", "BOOLEAN",
        "aw <= be AND ae >= bw AND as_ <= bn AND an >= bs",
    ),
]


def register_functions(spark: SparkSession) -> list[str]:
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
