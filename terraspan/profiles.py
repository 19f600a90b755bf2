"""Small dimension tables of fixed values, each a literal relation that is safe to broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: catalogs -------------------------------------------------
CATALOGS = ("microsoft", "earth-search", "nasa")
SOURCE_INFO = [
    ("microsoft", "Microsoft Planetary Computer", "https://planetarycomputer.microsoft.com/api/stac/v1", "signed_url"),
    ("earth-search", "Element 84 Earth Search", "https://earth-search.aws.element84.com/v1", "none"),
    ("nasa", "NASA Earthdata", "https://cmr.earthdata.nasa.gov/search", "earthdata_netrc"),
]
COLLECTION_ALIASES = [("HLSL30_V2.0", "HLSL30", "2.0"), ("HLSS30_V2.0", "HLSS30", "2.0")]

# ---- fixed values: product profiles -----------------------------------------
PROFILE_VERSION = "hls-v2.0-2026.07"
PROFILES = [
    (
        "HLSL30_V2.0", PROFILE_VERSION, "Harmonized Landsat Sentinel-2 L30 Version 2.0",
        "Harmonized Landsat and Sentinel-2 surface reflectance observations derived from Landsat 8/9 at 30 metre spatial resolution.",
        ("HLS", "Landsat", "surface reflectance", "30 m", "NASA"), ("NASA", "LP DAAC"),
        ("https://lpdaac.usgs.gov/products/hlsl30v002/",), 30.0,
    ),
    (
        "HLSS30_V2.0", PROFILE_VERSION, "Harmonized Landsat Sentinel-2 S30 Version 2.0",
        "Harmonized Landsat and Sentinel-2 surface reflectance observations derived from Sentinel-2 at 30 metre spatial resolution.",
        ("HLS", "Sentinel-2", "surface reflectance", "30 m", "NASA"), ("NASA", "LP DAAC"),
        ("https://lpdaac.usgs.gov/products/hlss30v002/",), 30.0,
    ),
]
PROFILE_COLLECTIONS = tuple(row[0] for row in PROFILES)

# (asset key, canonical name, long name, wavelength nm, bandwidth nm, unit, scale, role)
_ANGLES = [
    ("SZA", "solar_zenith_angle", "Solar zenith angle", None, None, "degree", 0.01, "ancillary"),
    ("SAA", "solar_azimuth_angle", "Solar azimuth angle", None, None, "degree", 0.01, "ancillary"),
    ("VZA", "view_zenith_angle", "View zenith angle", None, None, "degree", 0.01, "ancillary"),
    ("VAA", "view_azimuth_angle", "View azimuth angle", None, None, "degree", 0.01, "ancillary"),
]
_MASK = [("Fmask", "quality_fmask", "HLS quality bit mask", None, None, None, None, "quality")]
_L30 = [
    ("B01", "surface_reflectance_coastal_aerosol", "Coastal aerosol surface reflectance", 443.0, 20.0, "1", 1e-4, "data"),
    ("B02", "surface_reflectance_blue", "Blue surface reflectance", 482.0, 65.0, "1", 1e-4, "data"),
    ("B03", "surface_reflectance_green", "Green surface reflectance", 561.0, 57.0, "1", 1e-4, "data"),
    ("B04", "surface_reflectance_red", "Red surface reflectance", 655.0, 37.0, "1", 1e-4, "data"),
    ("B05", "surface_reflectance_nir", "Near-infrared surface reflectance", 865.0, 28.0, "1", 1e-4, "data"),
    ("B06", "surface_reflectance_swir1", "Shortwave-infrared 1 surface reflectance", 1609.0, 85.0, "1", 1e-4, "data"),
    ("B07", "surface_reflectance_swir2", "Shortwave-infrared 2 surface reflectance", 2201.0, 187.0, "1", 1e-4, "data"),
    ("B09", "surface_reflectance_cirrus", "Cirrus surface reflectance", 1373.0, 20.0, "1", 1e-4, "data"),
    ("B10", "brightness_temperature_tirs1", "Thermal infrared 1 brightness temperature", 10895.0, 590.0, "K", 0.01, "data"),
    ("B11", "brightness_temperature_tirs2", "Thermal infrared 2 brightness temperature", 12005.0, 1010.0, "K", 0.01, "data"),
]
_S30 = [
    ("B01", "surface_reflectance_coastal_aerosol", "Coastal aerosol surface reflectance", 443.0, 21.0, "1", 1e-4, "data"),
    ("B02", "surface_reflectance_blue", "Blue surface reflectance", 497.0, 98.0, "1", 1e-4, "data"),
    ("B03", "surface_reflectance_green", "Green surface reflectance", 560.0, 45.0, "1", 1e-4, "data"),
    ("B04", "surface_reflectance_red", "Red surface reflectance", 665.0, 38.0, "1", 1e-4, "data"),
    ("B05", "surface_reflectance_red_edge_1", "Red-edge 1 surface reflectance", 704.0, 19.0, "1", 1e-4, "data"),
    ("B06", "surface_reflectance_red_edge_2", "Red-edge 2 surface reflectance", 740.0, 18.0, "1", 1e-4, "data"),
    ("B07", "surface_reflectance_red_edge_3", "Red-edge 3 surface reflectance", 783.0, 28.0, "1", 1e-4, "data"),
    ("B08", "surface_reflectance_nir_broad", "Broad near-infrared surface reflectance", 835.0, 145.0, "1", 1e-4, "data"),
    ("B8A", "surface_reflectance_nir", "Near-infrared surface reflectance", 865.0, 33.0, "1", 1e-4, "data"),
    ("B09", "surface_reflectance_water_vapour", "Water-vapour surface reflectance", 945.0, 26.0, "1", 1e-4, "data"),
    ("B11", "surface_reflectance_swir1", "Shortwave-infrared 1 surface reflectance", 1614.0, 91.0, "1", 1e-4, "data"),
    ("B12", "surface_reflectance_swir2", "Shortwave-infrared 2 surface reflectance", 2202.0, 175.0, "1", 1e-4, "data"),
]
PROFILE_BANDS = [("HLSL30_V2.0", *band) for band in _L30 + _MASK + _ANGLES] + [
    ("HLSS30_V2.0", *band) for band in _S30 + _MASK + _ANGLES
]

# ---- fixed values: asset choice and naming ----------------------------------
MAIN_BANDS = {"HLSL30_V2.0": ("B04", "B05", "Fmask"), "HLSS30_V2.0": ("B04", "B8A", "Fmask")}
MAIN_ROLES = ("visual", "overview")
MAIN_KEYS = ("visual", "rendered_preview", "overview", "b04", "b08", "fmask")
DATA_EXTENSIONS = (".nc", ".zip", ".nc.zip", ".tif", ".tiff")
STATIC_COLLECTION_TOKENS = ("dem", "nasadem", "alpsml")
MODALITY_TOKENS = [
    ("observation", ("sentinel", "landsat", "modis", "smap", "grace")),
    ("forcing", ("era5", "nldas", "gpm")),
    ("static", ("dem", "soil", "geology", "landcover")),
]
DOCUMENTATION_RELS = ("about", "documentation", "describedby", "license", "metadata")
MEDIA_TYPES = [
    (".tif", "image/tiff"), (".tiff", "image/tiff"), (".nc", "application/x-netcdf"), (".zip", "application/zip"),
    (".json", "application/json"), (".xml", "text/xml"), (".jpg", "image/jpeg"), (".jpeg", "image/jpeg"),
    (".png", "image/png"), (".hdf", "application/x-hdf"), (".h5", "application/x-hdf5"), (".txt", "text/plain"),
    (".csv", "text/csv"), (".html", "text/html"), (".htm", "text/html"), (".pdf", "application/pdf"),
    (".tar", "application/x-tar"),
]
DEFAULT_MEDIA_TYPE = "application/octet-stream"

# ---- fixed values: lake layout and vocabularies -----------------------------
LAYERS = ("protocol", "catalog", "registry", "source", "entities", "arrays", "virtual", "manifests", "cache")
QUALITY_BITS = [
    (0, "missing"), (1, "cloud"), (2, "cloud_shadow"), (3, "snow"),
    (4, "saturation"), (5, "low_quality"), (6, "interpolated"), (7, "temporally_filled"),
]
# (class, bit, red, green, blue, alpha); the first set bit in this order decides the class.
MASK_CLASSES = [
    ("cirrus", 1, 180, 119, 190, 235), ("cloud", 2, 238, 112, 94, 235), ("adjacent", 4, 232, 158, 71, 235),
    ("shadow", 8, 92, 72, 111, 235), ("snow", 16, 241, 246, 249, 235), ("water", 32, 54, 128, 190, 235),
    ("clear", 0, 83, 105, 96, 210),
]

# ---- fixed values: run control ----------------------------------------------
TERMINAL_STATUSES = ("completed", "partial", "failed", "cancelled")
ACTIVE_STATUSES = ("queued", "recovering", "discovering", "planning", "downloading", "finalizing", "cancelling")
ALL_STATUSES = (*ACTIVE_STATUSES, "paused", "auth_required", *TERMINAL_STATUSES)
_OPEN = tuple(s for s in ALL_STATUSES if s not in TERMINAL_STATUSES)
TRANSITIONS = (
    [(s, "pause", "paused") for s in _OPEN]
    + [(s, "resume", "queued") for s in ("paused", "auth_required", "failed")]
    + [(s, "cancel", "cancelled") for s in (*_OPEN, "cancelled")]
    + [(s, "retry", "queued") for s in ("failed", "partial", "auth_required")]
)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, tuple):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def relation(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A literal relation: Catalyst knows its size, folds it and broadcasts it."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def source_info(spark: SparkSession) -> DataFrame:
    return relation(spark, ["catalog", "provider", "endpoint", "auth_type"], SOURCE_INFO)


def collection_aliases(spark: SparkSession) -> DataFrame:
    return relation(spark, ["collection", "short_name", "version"], COLLECTION_ALIASES)


def profiles(spark: SparkSession) -> DataFrame:
    return relation(
        spark,
        ["collection", "profile_version", "title", "description", "keywords", "providers", "documentation_urls",
         "spatial_resolution_m"],
        PROFILES,
    )


def profile_bands(spark: SparkSession) -> DataFrame:
    return relation(
        spark,
        ["collection", "asset_key", "canonical_name", "long_name", "central_wavelength_nm", "bandwidth_nm", "unit",
         "scale_factor", "role"],
        PROFILE_BANDS,
    )


def transitions(spark: SparkSession) -> DataFrame:
    return relation(spark, ["status", "action", "next_status"], TRANSITIONS)


def quality_bits(spark: SparkSession) -> DataFrame:
    return relation(spark, ["bit", "meaning"], QUALITY_BITS)


def mask_classes(spark: SparkSession) -> DataFrame:
    return relation(spark, ["pixel_class", "bit_value", "red", "green", "blue", "alpha"], MASK_CLASSES)
