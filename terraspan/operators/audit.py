"""Registry against storage: what is missing, what is unregistered, what each layer holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..profiles import LAYERS, relation


# Ranges of folders that are compared by digest: 65,536 rows of 40 bytes on each side.
RANGES = 65_536


def _registered(assets: DataFrame) -> DataFrame:
    return assets.select(F.col("local_path").alias("path")).filter("path <> ''")


def _sources(files: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    if "kind" in files.columns:
        files = files.filter("kind = 'file'")
    return files.filter(
        F.col("path").startswith("source/") & text.is_payload_file(F.col("path")) & ~text.is_junk_file(name)
    ).select("path")


def registered_paths(assets: DataFrame) -> DataFrame:
    return _registered(assets).distinct()


def source_files(files: DataFrame) -> DataFrame:
    """Payload paths of the source layer: no sidecars, no partial transfers, no junk."""
    return _sources(files).distinct()


def _range(ranges: int) -> Column:
    return F.pmod(F.xxhash64(text.folder(F.col("path"))), F.lit(ranges)).cast("int")


def range_digests(paths: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Per range of folders a digest of its paths that does not depend on their order.

    A range is the folders with the same hash modulo ``ranges``, so a lost or new folder lies in one. The digest is the
    number of paths, the sums of the halves of one hash and the exclusive or of another: repeated paths count, and
    unlike ranges agree with a chance of about 2^-128. Sums are formed inside the tasks; at most ``ranges`` rows leave.
    """
    one, other = F.xxhash64("path"), F.xxhash64(F.lit(1), "path")
    return paths.groupBy(_range(ranges).alias("range")).agg(
        F.count(F.lit(1)).alias("paths"), F.sum(one.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned(one, 32)).alias("high"), F.bit_xor(other).alias("mixed"),
    )


def differing(left: DataFrame, right: DataFrame, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """Both sides (``path``) without the ranges whose digests agree.

    What one side has and the other has not is the same before and after, while of two sides that are nearly equal
    only the few ranges that differ are left to be shuffled and joined. Each side is read twice. A path that one side
    repeats makes its range differ, which costs time and changes no result; so do nulls, which form a range.
    """
    a, b = range_digests(left, ranges), range_digests(right, ranges)
    b = b.select("range", F.struct("paths", "low", "high", "mixed").alias("_b"))
    both = a.select("range", F.struct("paths", "low", "high", "mixed").alias("_a")).join(b, "range", "full_outer")
    unlike = F.broadcast(both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("range"))  # at most ``ranges`` numbers
    return tuple(side.select("path", _range(ranges).alias("range")).join(unlike, "range", "left_semi").select("path") for side in (left, right))


def _known_and_there(assets: DataFrame, files: DataFrame, by_range: bool) -> tuple[DataFrame, DataFrame]:
    known, there = _registered(assets), _sources(files)
    known, there = differing(known, there) if by_range else (known, there)
    return known.distinct(), there.distinct()


def missing_assets(assets: DataFrame, files: DataFrame, by_range: bool = False) -> DataFrame:
    """Registered paths without a file. ``by_range`` compares digests first, for sides that are nearly equal."""
    known, there = _known_and_there(assets, files, by_range)
    return known.join(there, "path", "left_anti")


def unregistered_files(assets: DataFrame, files: DataFrame, by_range: bool = False) -> DataFrame:
    """Files of the source layer that no asset names. ``by_range`` as in :func:`missing_assets`."""
    known, there = _known_and_there(assets, files, by_range)
    return there.join(known, "path", "left_anti")


def path_audit(assets: DataFrame, files: DataFrame, by_range: bool = False) -> DataFrame:
    """One row with the number of missing and of unregistered paths; without ``by_range`` each side is read once."""
    known, there = _known_and_there(assets, files, by_range)
    known, there = known.withColumn("_known", F.lit(True)), there.withColumn("_there", F.lit(True))
    return known.join(there, "path", "full_outer").agg(
        F.count_if(F.col("_there").isNull()).alias("missing_assets"), F.count_if(F.col("_known").isNull()).alias("unregistered_source_files")
    )


def path_except(left: DataFrame, right: DataFrame, by_range: bool = False) -> DataFrame:
    """Distinct paths of ``left`` that ``right`` has not; a null counts as a path. ``by_range`` as in :func:`missing_assets`."""
    left, right = left.select("path"), right.select("path")
    left, right = differing(left, right) if by_range else (left, right)
    return left.subtract(right)


def layer_scan(files: DataFrame) -> DataFrame:
    """Files, directories, bytes and newest change per layer, from an inventory of files and directories."""
    layer = F.substring_index("path", "/", 1)
    clean = files.filter(~text.is_junk_file(F.substring_index("path", "/", -1)))
    is_file = F.col("kind") == "file"
    stats = clean.groupBy(layer.alias("layer")).agg(
        F.count_if(is_file).alias("file_count"),
        F.count_if((F.col("kind") == "directory") & F.col("path").contains("/")).alias("directory_count"),
        F.sum(F.when(is_file, F.col("byte_size")).otherwise(0)).alias("byte_size"),
        F.max("modified_at").alias("modified_at"),
    )
    zero = F.lit(0).cast("bigint")
    layers = relation(files.sparkSession, ["layer"], [(name,) for name in LAYERS])
    return layers.join(stats, "layer", "left").select(
        "layer", *[F.coalesce(c, zero).alias(c) for c in ("file_count", "directory_count", "byte_size")], "modified_at"
    )


def list_layer(files: DataFrame, layer: str, limit: int = 500) -> DataFrame:
    """First entries of a layer by path, regardless of case."""
    if layer not in LAYERS:
        raise KeyError(layer)
    inside = files.filter(F.col("path").startswith(layer + "/"))
    return inside.orderBy(F.lower("path"), "path").limit(limit)


def previewable(local_path: Column, raster: Column) -> Column:
    """A GeoTIFF of the source layer with a whole grid description."""
    inside = local_path.startswith("source/") & ~local_path.rlike(r"(^|/)\.\.(/|$)")
    grid = raster["width"].isNotNull() & raster["height"].isNotNull() & (F.size(raster["transform"]) == 6)
    return F.coalesce(F.lower(local_path).rlike(r"\.tiff?$") & inside & grid, F.lit(False))


def previewable_assets(assets: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Assets that can be previewed; with ``files`` also those whose file exists."""
    ok = assets.filter(previewable(F.col("local_path"), F.col("raster_metadata")))
    if files is None:
        return ok
    return ok.join(files.select(F.col("path").alias("local_path")), "local_path", "left_semi")
