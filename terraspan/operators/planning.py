"""From items to transfer jobs, batches and expected outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..profiles import MAIN_BANDS, MAIN_KEYS, MAIN_ROLES
from . import ordering


def is_main_asset(collection: Column, key: Column, roles: Column, count: Column) -> Column:
    """Representative files: the sensor's band set, else a lone asset, a visual role or a known key."""
    rule = None
    for name, bands in MAIN_BANDS.items():
        chosen = key.isin(*bands)
        rule = F.when(collection == name, chosen) if rule is None else rule.when(collection == name, chosen)
    low_roles = F.transform(F.coalesce(roles, F.array().cast("array<string>")), F.lower)
    visual = F.arrays_overlap(low_roles, F.array(*[F.lit(r) for r in MAIN_ROLES]))
    other = (count == 1) | F.coalesce(visual, F.lit(False)) | F.lower(key).isin(*MAIN_KEYS)
    return rule.otherwise(other)


def explode_assets(items: DataFrame, only_main: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """One job per selected asset of an item: link, file name and destination; blank links are skipped.

    ``items`` has catalog, collection, source_item_id and the ``assets`` map.
    """
    head = [*keep, "catalog", "collection", "source_item_id"]
    rows = items.select(*head, F.size("assets").alias("_count"), F.posexplode("assets").alias("position", "asset_key", "_asset"))
    href = F.col("_asset")["href"]
    rows = rows.filter(href != "")
    if only_main:
        rows = rows.filter(
            is_main_asset(F.col("collection"), F.col("asset_key"), F.col("_asset")["roles"], F.col("_count"))
        )
    filename = text.asset_filename(F.col("asset_key"), href)
    return rows.select(
        *head, "position", "asset_key", href.alias("source_url"),
        text.asset_path(F.col("catalog"), F.col("collection"), F.col("source_item_id"), filename).alias("destination"),
    )


def items_without_assets(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items that gave no job at all; each is reported as a failure of its run."""
    key = ["catalog", "collection", "source_item_id"]
    return items.select(*key).join(jobs.select(*key).distinct(), key, "left_anti")


def plan_batches(
    jobs: DataFrame,
    batch_size: int = 20,
    group: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("page_number", "source_item_id", "collection", "position"),
) -> DataFrame:
    """Number the jobs of each run in discovery order and cut them into batches, from 1."""
    numbered = ordering.number_rows(jobs, group, order, "job_number")
    batch = (F.floor((F.col("job_number") - 1) / batch_size) + 1).cast("bigint")
    return numbered.withColumns(
        {
            "batch_number": batch,
            "attempt_id": text.attempt_id(
                F.col("run_id").cast("string"), F.col("collection"), F.col("source_item_id"), F.col("asset_key")
            ),
        }
    )


def transfer_outcomes(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """What a transfer of each job would come to, given the files already there.

    ``jobs`` has destination and expected_size (0 when unknown); ``files`` has path and byte_size.
    """
    there = files.select(F.col("path").alias("destination"), F.col("byte_size").alias("actual_size"))
    rows = jobs.join(there, "destination", "left")
    expected, actual = F.col("expected_size"), F.col("actual_size")
    differs = (F.coalesce(expected, F.lit(0)) != 0) & (actual != expected)
    return rows.withColumn(
        "outcome", F.when(actual.isNull(), "downloaded").when(differs, "failed").otherwise("skipped")
    )
