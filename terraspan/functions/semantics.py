"""What a collection, band or grid means: classification, defaults and metadata normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import DOCUMENTATION_RELS, MODALITY_TOKENS, PROFILE_COLLECTIONS
from .text import first_truthy, safe_component


def is_profiled(collection: Column) -> Column:
    return collection.isin(*PROFILE_COLLECTIONS)


def modality(collection: Column) -> Column:
    low = F.lower(collection)
    rule = F.when(is_profiled(collection), "observation")
    for name, tokens in MODALITY_TOKENS:
        rule = rule.when(reduce(lambda a, b: a | b, [low.contains(t) for t in tokens]), name)
    return rule.otherwise("observation")


def product_version(collection: Column) -> Column:
    return F.when(is_profiled(collection), "2.0").otherwise("unknown")


def fallback_grid_id(collection: Column) -> Column:
    native = F.concat(safe_component(F.lower(collection)), F.lit("_native"))
    return F.when(is_profiled(collection), "hls_mgrs_30m").otherwise(native)


def _json_number(value: Column) -> Column:
    """Number as JSON text with a decimal point, so that equal grids give equal fingerprints."""
    whole = value.cast("bigint").cast("string")
    return F.when(
        (value == F.floor(value)) & (F.abs(value) < 1e15), F.concat(whole, F.lit(".0"))
    ).otherwise(value.cast("string"))


def grid_fingerprint(epsg: Column, transform: Column, width: Column, height: Column) -> Column:
    null = F.lit("null")
    numbers = F.array_join(F.transform(transform, _json_number), ", ")
    return F.concat(
        F.lit('{"epsg": '), F.coalesce(epsg.cast("string"), null),
        F.lit(', "height": '), F.coalesce(height.cast("string"), null),
        F.lit(', "transform": '), F.coalesce(F.concat(F.lit("["), numbers, F.lit("]")), null),
        F.lit(', "width": '), F.coalesce(width.cast("string"), null), F.lit("}"),
    )


def grid_id(collection: Column, raster: Column) -> Column:
    """Fallback id without raster facts; else fallback, projection and a digest of the grid."""
    projection = F.when(raster["epsg"] != 0, F.concat(F.lit("epsg"), raster["epsg"].cast("string"))).otherwise("native")
    digest = F.sha1(grid_fingerprint(raster["epsg"], raster["transform"], raster["width"], raster["height"]))
    fallback = fallback_grid_id(collection)
    return F.when(raster.isNull(), fallback).otherwise(
        F.concat_ws("_", fallback, projection, F.substring(digest, 1, 12))
    )


def grid_columns(collection: Column, raster: Column) -> dict[str, Column]:
    """Grid registry values; a zero from the raster counts as absent."""
    profiled = is_profiled(collection)

    def value(name: str, default: float | int) -> Column:
        return F.coalesce(F.nullif(raster[name], F.lit(0)), F.when(profiled, F.lit(default)))

    native = F.when(profiled, "MGRS/UTM per tile").otherwise("source-native")
    return {
        "crs_wkt": first_truthy(raster["crs_wkt"], native),
        "epsg": raster["epsg"],
        "axis_order": F.lit("x,y"),
        "x_origin": raster["x_origin"],
        "y_origin": raster["y_origin"],
        "pixel_size_x": value("pixel_size_x", 30.0),
        "pixel_size_y": value("pixel_size_y", -30.0),
        "tile_width": value("width", 3660),
        "tile_height": value("height", 3660),
        "tile_scheme": F.when(profiled, "MGRS").otherwise("source-native"),
        "spatial_support": F.when(profiled, "pixel_area"),
        "transform": F.when(F.size(raster["transform"]) > 0, raster["transform"]),
        "width": raster["width"],
        "height": raster["height"],
    }


def variable_columns(product_id: Column, modality_: Column, raster: Column, band: str) -> dict[str, Column]:
    """Variable registry values. ``band`` prefixes the joined profile-band columns, null when unknown."""
    key = F.col("asset_key")
    known = F.col(f"{band}canonical_name").isNotNull()
    quality = F.lower(key) == "fmask"
    tag = raster["tags"]
    scale, offset = F.try_element_at(tag, F.lit("scale_factor")), F.try_element_at(tag, F.lit("add_offset"))
    native_type = F.when(known, F.when(quality, "uint8").otherwise("int16"))
    return {
        "canonical_name": F.coalesce(
            F.col(f"{band}canonical_name"), F.concat(product_id, F.lit("_"), F.lower(key))
        ),
        "source_name": key,
        "long_name": F.coalesce(F.col(f"{band}long_name"), key),
        "unit": F.when(~quality, F.col(f"{band}unit")),
        "dtype": first_truthy(raster["dtype"], native_type),
        "scale_factor": F.when(scale.isNotNull(), scale.try_cast("double"))
        .when(~quality, F.col(f"{band}scale_factor")),
        "add_offset": F.when(offset.isNotNull(), offset.try_cast("double")).when(known & ~quality, F.lit(0.0)),
        "central_wavelength_nm": F.col(f"{band}central_wavelength_nm"),
        "bandwidth_nm": F.col(f"{band}bandwidth_nm"),
        "nodata": raster["nodata"],
        "quality_flag_definition": F.when(quality, F.try_element_at(tag, F.lit("Fmask bit description"))),
        "modality": modality_,
        "role": F.when(quality, "quality").otherwise(F.coalesce(F.col(f"{band}role"), F.lit("data"))),
        "temporal_type": F.when(known, "instantaneous").when(modality_ == "static", "static"),
        "spatial_support": F.when(known, "pixel"),
        "quality_variable": F.when(known & ~quality, "quality_fmask"),
        "source_product": product_id,
        "processing_level": F.lit("source"),
    }


def _texts(raw: Column) -> Column:
    """JSON text of an array or of a single value as an array of its text values."""
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.startswith("["), listed).when(raw.isNotNull() & (raw != ""), F.array(raw))


def _filled(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def collection_columns(collection: Column, metadata: Column, profile: str) -> dict[str, Column]:
    """Product columns from a STAC Collection or a CMR collection record held as JSON text.

    ``profile`` prefixes the joined profile columns that fill what the record leaves out.
    """

    def at(path: str) -> Column:
        return F.get_json_object(metadata, f"$.{path}")

    def prof(name: str) -> Column:
        return F.col(f"{profile}{name}")

    def interval(side: int) -> Column:
        # an open end is a JSON null inside the array, which comes back as text
        return F.nullif(at(f"extent.temporal.interval[0][{side}]"), F.lit("null"))

    empty = F.array().cast("array<string>")
    is_stac = (at("type") == "Collection") | at("extent").isNotNull()
    is_stac = F.coalesce(is_stac, F.lit(False))

    def name_of(entry: Column) -> Column:
        return F.when(entry.startswith("{"), F.get_json_object(entry, "$.name")).otherwise(entry)

    stac_providers = F.transform(F.coalesce(_texts(at("providers")), empty), name_of)
    cmr_providers = F.coalesce(_filled(_texts(at("providers"))), _filled(_texts(at("organizations"))), empty)
    providers = F.filter(F.when(is_stac, stac_providers).otherwise(cmr_providers), lambda p: p.isNotNull() & (p != ""))

    links = F.from_json(at("links"), "array<struct<rel: string, href: string>>")
    documents = F.transform(
        F.filter(links, lambda l: (l.href != "") & F.lower(l.rel).isin(*DOCUMENTATION_RELS)), lambda l: l.href
    )

    gsd = F.coalesce(F.nullif(F.nullif(at("summaries.gsd"), F.lit("0")), F.lit("[]")), at("gsd"))
    raw_resolution = F.when(is_stac, gsd).otherwise(at("spatial_resolution"))
    unquoted = F.regexp_replace(raw_resolution, r'"[^"]*"', "")
    number = F.regexp_extract(unquoted, r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", 1)
    scalar_text = ~raw_resolution.startswith("[") & ~F.get_json_object(metadata, "$").rlike(
        r'"(gsd|spatial_resolution)"\s*:\s*[-0-9\[]'
    )
    resolution = F.when(~scalar_text, number.try_cast("double"))

    return {
        "title": first_truthy(at("title"), prof("title"), collection),
        "description": first_truthy(at("description"), at("summary"), prof("description")),
        "license": first_truthy(at("license"), F.lit("unknown")),
        "keywords": F.array_distinct(F.coalesce(_filled(_texts(at("keywords"))), prof("keywords"), empty)),
        "providers": F.array_distinct(F.coalesce(_filled(providers), prof("providers"), empty)),
        "temporal_start": F.when(is_stac, interval(0)).otherwise(at("time_start")),
        "temporal_end": F.when(is_stac, interval(1)).otherwise(at("time_end")),
        "documentation_urls": F.array_distinct(F.coalesce(_filled(documents), prof("documentation_urls"), empty)),
        "spatial_resolution_m": F.coalesce(resolution, prof("spatial_resolution_m")),
    }
