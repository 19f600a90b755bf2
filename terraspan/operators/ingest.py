"""From landed catalog responses to deduplicated items and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text
from ..profiles import CATALOGS, STATIC_COLLECTION_TOKENS, collection_aliases
from . import ordering

ITEM_KEY = ("run_id", "catalog", "collection", "source_item_id")


def unique_keys(links: Column) -> Column:
    """``links`` (key, href) in order to (key, href) with repeated keys suffixed ``_2``, ``_3`` and so on.

    A suffixed name that an earlier link already took is skipped.
    """

    def add(done: Column, link: Column) -> Column:
        taken = F.transform(done, lambda d: d["key"])
        suffixes = F.transform(
            F.sequence(F.lit(2), F.size(done) + 2), lambda n: F.concat_ws("_", link["key"], n.cast("string"))
        )
        free = F.get(F.filter(suffixes, lambda k: ~F.array_contains(taken, k)), F.lit(0))
        key = F.when(F.array_contains(taken, link["key"]), free).otherwise(link["key"])
        return F.concat(done, F.array(F.struct(key.alias("key"), link["href"].alias("href"))))

    start = F.array().cast("array<struct<key: string, href: string>>")
    return F.aggregate(links, start, add)


def link_assets(links: Column) -> Column:
    """Data links of a granule as a map of asset key to (href, roles)."""
    data = F.filter(links, lambda l: text.is_data_link(l["href"], l["rel"]))
    named = F.transform(
        data,
        lambda l: F.struct(
            text.link_asset_key(text.asset_filename(F.lit("data"), l["href"])).alias("key"), l["href"].alias("href")
        ),
    )
    return F.map_from_entries(
        F.transform(
            unique_keys(named),
            lambda a: F.struct(a["key"], F.struct(a["href"].alias("href"), F.array(F.lit("data")).alias("roles"))),
        )
    )


def granule_items(responses: DataFrame, collection: str = "collection") -> DataFrame:
    """Item rows from landed granule responses; ``collection`` names the column with the asked collection."""
    entry = F.col("entry")
    rows = responses.select(F.col(collection).alias("collection"), F.posexplode("feed.entry").alias("position", "entry"))
    rows = rows.withColumn("rings", geo.cmr_rings(entry["polygons"], entry["boxes"]))
    return rows.select(
        entry["id"].alias("id"), "collection", geo.rings_envelope(F.col("rings")).alias("bbox"),
        geo.rings_geometry(F.col("rings")).alias("geometry"),
        F.struct(
            entry["time_start"].alias("datetime"), entry["cloud_cover"].alias("cloud_cover"),
            entry["producer_granule_id"].alias("producer_granule_id"),
        ).alias("properties"),
        link_assets(entry["links"]).alias("assets"), "position",
    )


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Short name and version of a collection; unknown names stand for themselves without a version."""
    dim = collection_aliases(df.sparkSession).withColumnRenamed("collection", "_alias")
    joined = df.join(F.broadcast(dim), F.col("collection") == F.col("_alias"), "left").drop("_alias")
    return joined.withColumn("short_name", F.coalesce("short_name", "collection"))


def union_items(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def temporal_filter(items: DataFrame, start: str, end: str, collections: Sequence[str], moment: str = "datetime") -> DataFrame:
    """Items of the closed day range; no filter when any asked collection holds static elevation data."""
    names = [c.lower() for c in collections]
    if any(token in name for name in names for token in STATIC_COLLECTION_TOKENS):
        return items
    return items.filter(F.col(moment).between(f"{start}T00:00:00Z", f"{end}T23:59:59Z"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds the cleaned collections and the list of what is wrong with each search request."""
    cleaned = F.filter(F.transform("collections", lambda c: F.trim(c)), lambda c: c != "")
    start, end = F.col("start_date").try_cast("date"), F.col("end_date").try_cast("date")
    checks = F.array_compact(
        F.array(
            F.when(~geo.wkt_is_valid(F.col("wkt")), "invalid or empty WKT"),
            F.when(F.coalesce(F.size(cleaned), F.lit(0)) < 1, "no collection"),
            F.when(start.isNull() | end.isNull(), "invalid date"),
            F.when(start > end, "start after end"),
            F.when(~F.coalesce(F.col("catalog"), F.lit("")).isin(*CATALOGS), "unknown catalog"),
            F.when(F.col("max_items") < 1, "max_items below 1"),
        )
    )
    return requests.withColumns({"collections": cleaned, "errors": checks})


def discover_items(sightings: DataFrame, order: Sequence[str] = ("page_number", "position")) -> DataFrame:
    """First sighting of each item of a run wins."""
    return ordering.first_per_key(sightings, ITEM_KEY, [F.col(c) for c in order])


def discovered_counts(sightings: DataFrame) -> DataFrame:
    return sightings.select(*ITEM_KEY).distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("discovered_items"))


def limit_items(items: DataFrame, max_items: int, order: Sequence[str] = ("page_number", "position")) -> DataFrame:
    """At most ``max_items`` of the deduplicated items of each run, in discovery order."""
    return ordering.first_n_per_key(items, ["run_id"], order, ITEM_KEY, max_items)


def search_checkpoints(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Where each run resumes: next page, cursor, and whether the last page had no cursor."""
    last = pages.groupBy("run_id").agg(
        F.max("page_number").alias("_page"),
        F.max_by(F.struct("outgoing_cursor"), "page_number")["outgoing_cursor"].alias("_cursor"),
    )
    return runs.select("run_id").join(last, "run_id", "left").select(
        "run_id", (F.coalesce("_page", F.lit(0)) + 1).alias("next_page"), F.col("_cursor").alias("cursor"),
        (F.col("_page").isNotNull() & F.col("_cursor").isNull()).alias("complete"),
    )


def slice_pages(items: DataFrame, group: Sequence[str], order: Sequence[str], page_size: int = 100) -> DataFrame:
    """Number items into logical pages of ``page_size``; exact for runs of any size."""
    numbered = ordering.number_rows(items, group, order, "_n")
    return numbered.withColumn("page_number", (F.floor((F.col("_n") - 1) / page_size) + 1).cast("bigint")).drop("_n")


def page_cursors(sliced: DataFrame, group: Sequence[str], page_size: int = 100) -> DataFrame:
    """Item count and outgoing offset of each page; a page that is not full ends the search."""
    counts = sliced.groupBy(*group, "page_number").agg(F.count(F.lit(1)).alias("item_count"))
    offset = (F.col("page_number") * page_size).cast("string")
    return counts.withColumn("outgoing_cursor", F.when(F.col("item_count") == page_size, offset))


def granule_cursor(index: Column, page: Column, entries: Column, page_size: Column, collections: Column) -> Column:
    """Next (collection, page) of a granule search as JSON; null after the last collection."""

    def state(i: Column, p: Column) -> Column:
        return F.to_json(F.struct(i.cast("int").alias("collection_index"), p.cast("int").alias("page_num")))

    return F.when(entries == page_size, state(index, page + 1)).when(index + 1 < collections, state(index + 1, F.lit(1)))


def discover_collections(records: DataFrame, catalog_kind: str, aoi: Sequence[float] | None = None) -> DataFrame:
    """Collections from landed records (``record``: JSON text), as id, title, description and dates.

    STAC records keep only those whose first box meets the area; records without an
    id, box or interval are skipped. CMR responses were filtered by the service.
    """

    def at(path: str) -> Column:
        return F.get_json_object("record", f"$.{path}")

    if catalog_kind == "cmr":
        picked = records.select(
            at("short_name").alias("id"), at("title").alias("title"), at("summary").alias("description"),
            at("time_start").alias("start_date"), at("time_end").alias("end_date"),
        )
        return picked.filter(F.col("id") != "")
    rows = records.withColumn("_box", F.from_json(at("extent.spatial.bbox[0]"), "array<double>")).filter(
        (F.size("_box") >= 4) & at("extent.temporal.interval[0]").isNotNull() & (at("id") != "")
    )
    if aoi is not None:
        box = geo.bbox_struct(F.col("_box")[0], F.col("_box")[1], F.col("_box")[2], F.col("_box")[3])
        area = geo.bbox_struct(*[F.lit(float(v)) for v in aoi])
        rows = rows.filter(geo.bbox_overlaps(box, area))
    return rows.select(
        at("id").alias("id"), at("title").alias("title"), at("description").alias("description"),
        F.nullif(at("extent.temporal.interval[0][0]"), F.lit("null")).alias("start_date"),
        F.nullif(at("extent.temporal.interval[0][1]"), F.lit("null")).alias("end_date"),
    )


def number_link_keys(links: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """:func:`unique_keys` over rows (key, href) instead of arrays, for groups of any size.

    The n-th link of a key gets the suffix ``_n``. Only groups in which such a name
    equals a key that is there anyway need the sequential rule; they are replayed link by
    link. A replayed group is the link list of one scene, which came in one document.
    """
    numbered = ordering.number_rows(links, [*group, "key"], order, "_n")
    suffixed = F.concat_ws("_", "key", F.col("_n").cast("string"))
    named = F.when(F.col("_n") == 1, F.col("key")).otherwise(suffixed)
    suspects = numbered.filter((F.col("_n") == 1) & F.col("key").rlike("_[0-9]+$")).select(*group, "key")
    made = numbered.filter("_n > 1").select(*group, suffixed.alias("key"))
    clashing = made.join(suspects, [*group, "key"], "left_semi").select(*group).distinct()
    plain = numbered.join(clashing, list(group), "left_anti").withColumn("key", named)
    replay = (
        numbered.join(clashing, list(group), "left_semi").groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct(*order, "key", "href"))).alias("_links"))
        .select(*group, F.explode(unique_keys(F.transform("_links", lambda l: F.struct(l["key"], l["href"])))).alias("_l"))
        .select(*group, "_l.key", "_l.href")
    )
    return plain.select(*group, "key", "href").unionByName(replay)
