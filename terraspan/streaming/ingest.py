"""Resumable ingestion: pages to items, items to a plan, deliveries to the registries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry
from ..operators.ingest import ITEM_KEY
from ..schemas import ITEM_DDL, parse
from ..session import SMALL_TASKS, scratch_scope, settings
from ..sources.registry_store import RegistryStore
from . import changes

ORDER = ("page_number", "position")
LAST = (1 << 62) - 1  # place of a row without one


def _named(column: str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown"))


def page_items(rows: DataFrame, catalog: str) -> DataFrame:
    """Rows of pages (run_id, page_number, value) with the identity and place of their item; ``value`` stays text."""
    item = F.from_json("value", "id STRING, collection STRING, position BIGINT")
    return rows.withColumn("_i", item).select(
        F.coalesce("run_id", F.lit("")).alias("run_id"), F.lit(catalog).alias("catalog"), _named("_i.collection").alias("collection"), _named("_i.id").alias("source_item_id"),
        F.coalesce(F.col("page_number").cast("bigint"), F.lit(LAST)).alias("page_number"), F.coalesce("_i.position", F.lit(LAST)).alias("position"), "value",
    )


def ingest_pages(
    pages: DataFrame, catalog: str, path: str, checkpoint: str, idle_ms: int = changes.IDLE_MS, shards: int = changes.SHARDS
) -> StreamingQuery:
    """Keep the items of landed pages, each in its earliest sighting. After a stop the query goes on with the pages not yet read.

    A sighting that arrives late but comes earlier in the order of the pages replaces the one
    that was kept. The state of a run is dropped once no page of it has come for ``idle_ms``.
    """
    items = changes.winning_rows(page_items(pages, catalog), "run_id", ITEM_KEY, ORDER, idle_ms=idle_ms, shards=shards)

    def write(batch: DataFrame, batch_id: int) -> None:
        changes.append_changes(batch, batch_id, path, ITEM_KEY, ORDER)

    with changes.keyed_state(pages.sparkSession):
        return items.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of :func:`ingest_pages`, each in its earliest sighting."""
    rows = changes.current_rows(spark, path, ITEM_KEY, ORDER)
    item = F.from_json("value", parse(ITEM_DDL))
    return rows.withColumn("_i", item).select(
        *ITEM_KEY, *[F.when(F.col(c) < LAST, F.col(c)).alias(c) for c in ORDER],
        "_i.assets", "_i.bbox", "_i.geometry", F.col("_i.properties.datetime").alias("datetime"),
    )


def register_stream(
    arrivals: DataFrame, store: RegistryStore, checkpoint: str, deliver: Callable[[DataFrame], DataFrame] | None = None,
    deal: Callable[[DataFrame], DataFrame] | None = None, dealt_by: Sequence[str] = (),
) -> StreamingQuery:
    """Upsert the registries with each micro-batch of delivered files.

    The upsert is keyed by asset and keeps the first status, run and creation time,
    so a batch that is replayed after a failure changes nothing. A batch is read twice rather than
    held; its scratch is deleted when its merge is done. ``deliver`` makes deliveries of the rows of a batch, if they are none yet. ``deal`` makes the
    same ones, but dealt by the columns ``dealt_by``: first the part of the store, then such in which the deliveries of an asset are equal.
    Where rows are narrow before they become deliveries, that shuffle is the only one they need.
    """

    def write(batch: DataFrame, _: int) -> None:
        with scratch_scope(batch.sparkSession):
            made = registry.register(deliver(batch) if deliver else batch)
            if deal:
                made["assets"] = registry.register_dealt(deal(batch), dealt_by)
            store.merge(made, dealt=["assets"] if deal else [])

    with settings(arrivals.sparkSession, SMALL_TASKS):  # the stream keeps the settings it starts with
        return (
            arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
