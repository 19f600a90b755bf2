"""Map features as line-delimited GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import geometry_json


def feature_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, in column ``value``."""
    properties = F.to_json(
        F.struct(
            "asset_id", "product_id", "variable", "datetime", "status", "source_item_id", "byte_size", "previewable",
            "preview_coordinates", "preview_cache_key", "geometry_source",
        ),
        {"ignoreNullFields": "false"},
    )
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("asset_id").alias("id")))
    return features.select(
        F.concat(
            F.regexp_replace(head, r"\}$", ""), F.lit(',"geometry":'), F.coalesce(geometry_json(F.col("geometry")), F.lit("null")),
            F.lit(',"properties":'), properties, F.lit("}"),
        ).alias("value")
    )


def write_features(features: DataFrame, path: str) -> None:
    feature_lines(features).write.mode("overwrite").text(path)
