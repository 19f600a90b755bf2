"""Catalog, collection, item and file documents as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

ITEM = ("catalog", "collection", "source_item_id")


def item_files(assets: DataFrame) -> DataFrame:
    """One row per file of an item document: its key, shortened to a safe name, and the asset entry.

    Files whose keys shorten to the same name are one entry, the last by key and id (ids that are no digests come after digests). Rows
    rather than a map per item hold the files, so an item may have any number of them.
    """
    # key and id come first, so that the largest row is the last by them and the id travels once; digests travel as bytes,
    # paths without the folder of their item, and what is the same for all is added after the fold
    path, home = F.col("local_path"), F.concat(F.lit("source/"), F.concat_ws("/", *ITEM), F.lit("/"))
    inside = path.startswith(home)
    facts = [
        "asset_key", text.packed(F.col("asset_id")).alias("id"), inside.alias("inside"), F.when(inside, F.substring(path, F.length(home) + 1, F.length(path))).otherwise(path).alias("path"),
        "media_type", text.packed(F.col("checksum_sha256")).alias("checksum"), "run_id",
    ]
    rows = assets.select(*ITEM, text.safe_component(F.col("asset_key"), "data").alias("key"), F.struct(*facts).alias("_row"))
    last = rows.groupBy(*ITEM, "key").agg(F.max("_row").alias("_row"))
    row = F.col("_row")
    entry = F.struct(
        F.when(row["inside"], F.concat(home, row["path"])).otherwise(row["path"]).alias("href"), row["media_type"].alias("type"), F.array(F.lit("data")).alias("roles"),
        text.unpacked(row["id"]).alias("lake:asset_id"), text.unpacked(row["checksum"]).alias("lake:checksum_sha256"), row["run_id"].alias("lake:lineage_id"),
    )
    return last.select(*ITEM, "key", entry.alias("asset"))


def item_documents(assets: DataFrame) -> DataFrame:
    """One row per item with the head of its document."""
    head = [F.min_by(c, F.struct("asset_key", "asset_id")).alias(c) for c in ("product_id", "datetime", "grid_id", "bbox", "geometry")]
    return assets.groupBy(*ITEM).agg(*head)


def collection_documents(products: DataFrame) -> DataFrame:
    """One document per product; the extent is the whole globe and open in time until items narrow it."""
    described = F.coalesce("description", F.concat(F.lit("Source assets for "), "collection_id"))
    return products.select(
        F.col("product_id").alias("collection"),
        F.to_json(
            F.struct(
                F.lit("Collection").alias("type"), F.col("product_id").alias("id"), "title", described.alias("description"),
                F.coalesce("license", F.lit("various")).alias("license"),
                F.struct(
                    F.struct(F.array(F.array(*[F.lit(v) for v in (-180.0, -90.0, 180.0, 90.0)])).alias("bbox")).alias("spatial"),
                    F.struct(F.array(F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))).alias("interval")).alias("temporal"),
                ).alias("extent"),
            )
        ).alias("value"),
    )


def write_catalog_tree(assets: DataFrame, products: DataFrame, path: str) -> None:
    """Write ``collections`` and, partitioned by collection, ``items`` and their ``files`` below ``path``."""
    collection_documents(products).select("collection", "value").write.mode("overwrite").partitionBy("collection").text(f"{path}/collections")
    name = text.product_id(F.col("collection")).alias("collection")
    item = text.safe_component(F.col("source_item_id"))
    head = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), item.alias("id"), "bbox", "geometry",
            F.struct("datetime", F.col("collection").alias("product"), "grid_id").alias("properties"),
        )
    )
    item_documents(assets).select(name, head.alias("value")).write.mode("overwrite").partitionBy("collection").text(f"{path}/items")
    line = F.to_json(F.struct(item.alias("item"), "catalog", "key", "asset"))
    item_files(assets).select(name, line.alias("value")).write.mode("overwrite").partitionBy("collection").text(f"{path}/files")
