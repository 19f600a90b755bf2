"""Registration: deliveries to registry rows, idempotent upserts, run records and output digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics, text
from ..profiles import profile_bands, profiles, source_info
from ..schemas import REGISTRY, REGISTRY_KEY, registry_schema
from ..session import SMALL_TASKS, materialize, settings


def conform(df: DataFrame, table: str) -> DataFrame:
    """Declared columns in the declared order and type; absent ones become null, others are dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in registry_schema(table).fields
        ]
    )


def fold_arrivals(
    df: DataFrame, key: str, order: Sequence[str], first: Sequence[str] = (), last: Sequence[str] | None = None, same: Sequence[str] = (), dealt_by: Sequence[str] = ()
) -> DataFrame:
    """One row per key: ``first`` columns from the earliest arrival, ``last`` ones from the newest.

    Folding rows in arrival order through an upsert gives the same, but here each
    task folds its own rows before the shuffle, so a key seen often stays small.
    Columns named in ``same`` are replaced by ``<name>_same``: whether all arrivals have equal values, none null.
    Rows that are dealt to tasks by ``dealt_by``, columns in which rows of a key are equal, are folded where they are.
    """
    last = [c for c in df.columns if c != key and c not in first and c not in order and c not in same and c not in dealt_by] if last is None else list(last)
    by = F.struct(*order)
    parts = [F.max_by(F.struct(*last), by).alias("_last")] if last else []
    if first:
        parts.append(F.min_by(F.struct(*first), by).alias("_first"))
    parts += [(F.min(c) == F.max(c)).alias(f"{c}_same") for c in same]
    if not parts:
        return df.select(*dealt_by, key).distinct().select(key)
    return df.groupBy(*dealt_by, key).agg(*parts).select(key, *[f"_last.{c}" for c in last], *[f"_first.{c}" for c in first], *[f"{c}_same" for c in same])


def upsert(
    old: DataFrame,
    new: DataFrame,
    key: str,
    keep: Sequence[str] = (),
    created: str | None = "created_at",
    fill: Sequence[str] = (),
) -> DataFrame:
    """Merge ``new`` (one row per key) into ``old`` (one row per key).

    New rows replace old ones, but ``keep`` columns stay as first registered,
    ``created`` stays unless empty, and ``fill`` columns fall back to the old value
    where the new one is null. Keys are unique on both sides, so no join key is hot.
    """
    o, n = old.alias("o"), new.alias("n")
    there, here = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    columns = [_merged(name, F.col(f"o.{name}"), F.col(f"n.{name}"), there, here, key, keep, created, fill) for name in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def _merged(
    name: str, was: Column, now: Column, there: Column, here: Column, key: str, keep: Sequence[str] = (), created: str | None = "created_at", fill: Sequence[str] = ()
) -> Column:
    """A column of an upsert: ``there`` and ``here`` tell whether the old and the new row exist."""
    if name == key:
        value = F.coalesce(now, was)
    elif name in keep:
        value = F.when(there, was).otherwise(now)
    elif name == created:
        value = F.when(here, text.first_truthy(was, now)).otherwise(was)
    elif name in fill:
        value = F.coalesce(now, was)
    else:
        value = F.when(here, now).otherwise(was)
    return value.alias(name)


GRID_ID_FACTS = ("epsg", "transform", "width", "height")
GRID_FACTS = ("crs_wkt", "x_origin", "y_origin", "pixel_size_x", "pixel_size_y")
ASSET_KEEP = ("status", "run_id")
PRODUCT_FILL = (
    "license", "title", "description", "keywords", "providers", "temporal_start", "temporal_end",
    "documentation_urls", "spatial_resolution_m", "collection_metadata",
)


def register(deliveries: DataFrame, asset_columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Registry rows of delivered files, one row per key, ready for :func:`merge_registries`.

    ``deliveries`` has run_id, catalog, collection, item_id, asset_key, source_url,
    local_path, byte_size, checksum_sha256, datetime, bbox, geometry, raster,
    status, collection_metadata, registered_at and seq (arrival order). They are read twice. The
    assets are no more than a plan: of the fold of wide rows nothing is written here. With
    ``asset_columns`` only these and what they are made of travel through it; the others are null.
    """
    spark = deliveries.sparkSession
    given = _given(deliveries)
    collection, raster = F.col("collection"), F.col("raster")

    # Source, product, variable and grid of a file are functions of its catalog, collection, key and grid: the
    # deliveries are folded to one row for each of these, which are few, inside the tasks, and serve four tables.
    parts = {"catalog": F.col("catalog"), "collection": collection, "asset_key": F.col("asset_key"), "_known": raster.isNotNull()}
    parts.update({f"_{f}": raster[f] for f in GRID_ID_FACTS})
    families = materialize(
        given.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(
            F.max_by(F.struct(F.col("registered_at").alias("updated_at"), "raster", "collection_metadata"), "seq").alias("_l"),
            F.min_by("registered_at", "seq").alias("created_at"), F.min("seq").alias("_first_seq"), F.max("seq").alias("_last_seq"),
        )
    ).select("*", "_l.*").drop("_l").withColumns({"product_id": text.product_id(collection), "modality": semantics.modality(collection)})

    # a file inspected again may have another grid, and both stay registered
    same_grid = F.when(F.col("_known"), F.struct(*[F.col(f"_{f}").alias(f) for f in GRID_ID_FACTS], *[raster[f].alias(f) for f in GRID_FACTS]))
    grids = families.withColumn("raster", same_grid).groupBy(semantics.grid_id(collection, raster).alias("grid_id")).agg(
        F.max_by(F.struct("collection", "raster", "updated_at"), "_last_seq").alias("_l"), F.min_by("created_at", "_first_seq").alias("created_at"),
    ).select("grid_id", "_l.*", "created_at")
    grid = semantics.grid_columns(collection, raster)
    grids = grids.select("grid_id", *[c.alias(n) for n, c in grid.items()], "created_at", "updated_at")

    def dimension(key: Column, *last: str) -> DataFrame:
        """One row per key: creation from the first arrival, the rest from the newest."""
        picked = families.select(key.alias("_key"), "_first_seq", "_last_seq", "created_at", "updated_at", *last)
        made = picked.groupBy("_key").agg(
            F.max_by(F.struct("updated_at", *last), "_last_seq").alias("_l"), F.min_by("created_at", "_first_seq").alias("created_at")
        )
        return made.select("_key", "_l.*", "created_at")

    sources = with_source_info(dimension(F.col("catalog")).withColumn("catalog", F.col("_key")))
    sources = sources.withColumn("source_id", F.col("_key"))

    products = _with_profile(dimension(F.col("product_id"), "catalog", "collection", "modality", "collection_metadata"))
    details = semantics.collection_columns(F.col("collection"), F.col("collection_metadata"), "p_")
    products = products.select(
        F.col("_key").alias("product_id"), F.col("catalog").alias("source_id"), F.col("collection").alias("collection_id"),
        F.col("collection").alias("product_name"), semantics.product_version(F.col("collection")).alias("product_version"),
        "modality", F.lit("source").alias("processing_level"), *[c.alias(n) for n, c in details.items()],
        "collection_metadata", "created_at", "updated_at",
    )

    variables = with_profile_band(
        dimension(F.concat_ws(":", "product_id", "asset_key"), "product_id", "collection", "asset_key", "modality", "raster")
    )
    facts = semantics.variable_columns(F.col("product_id"), F.col("modality"), F.col("raster"), "b_")
    versions = profiles(spark).select(F.col("collection").alias("p_collection"), "profile_version")
    variables = variables.join(F.broadcast(versions), F.col("collection") == F.col("p_collection"), "left").select(
        F.col("_key").alias("variable_id"), "profile_version", *[c.alias(n) for n, c in facts.items()], "created_at", "updated_at"
    )

    made = {"sources": sources, "products": products, "grids": grids, "variables": variables, "assets": _registered_assets(given, asset_columns)}
    return {table: conform(df, table) for table, df in made.items()}


def register_dealt(deliveries: DataFrame, dealt_by: Sequence[str]) -> DataFrame:
    """The assets of :func:`register` from deliveries that are dealt to tasks by further columns, in which those of an asset are equal: they are folded without a shuffle."""
    return conform(_registered_assets(_given(deliveries), None, dealt_by), "assets")


def _given(deliveries: DataFrame) -> DataFrame:
    return deliveries.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("collection", "item_id")})


def _delivered_id() -> Column:
    """Id of the asset that a delivery registers."""
    return text.asset_id(*[F.col(c) for c in ("catalog", "collection", "item_id", "asset_key", "source_url")])


def _asset_values() -> dict[str, tuple[Column, list[str]]]:
    """Columns of an asset that its newest delivery gives, and the columns they are made of."""
    made = {
        "product_id": (text.product_id(F.col("collection")), ["collection"]), "grid_id": (semantics.grid_id(F.col("collection"), F.col("raster")), ["collection", "raster"]),
        "source_item_id": (F.col("item_id"), ["item_id"]), "media_type": (text.media_type(F.col("local_path")), ["local_path"]),
        "raster_metadata": (F.col("raster"), ["raster"]), "updated_at": (F.col("registered_at"), ["registered_at"]),
    }
    made.update({c: (F.col(c), [c]) for c in ("asset_key", "source_url", "local_path", "byte_size", "checksum_sha256", "datetime", "bbox", "geometry")})
    return made


def _registered_assets(given: DataFrame, columns: Sequence[str] | None, dealt_by: Sequence[str] = ()) -> DataFrame:
    """Deliveries folded to assets. The ids travel through the fold as 32 bytes, not as 64 digits."""
    made = _asset_values()
    asked = [c for c in (*made, *ASSET_KEEP, "created_at") if columns is None or c in columns]
    first = [c for c in (*ASSET_KEEP, "created_at") if c in asked]
    last = list(dict.fromkeys(raw for c in asked if c in made for raw in made[c][1]))
    rows = given.withColumns({"_id": F.unhex(_delivered_id()), "created_at": F.col("registered_at")})
    folded = fold_arrivals(rows, "_id", ["seq"], first=first, last=last, dealt_by=dealt_by)
    return folded.select(F.lower(F.hex("_id")).alias("asset_id"), *[made[c][0].alias(c) if c in made else c for c in asked])


def _with_profile(products: DataFrame) -> DataFrame:
    dim = profiles(products.sparkSession)
    dim = dim.select(*[F.col(c).alias(f"p_{c}") for c in dim.columns])
    return products.join(F.broadcast(dim), F.col("collection") == F.col("p_collection"), "left")


def with_profile_band(df: DataFrame) -> DataFrame:
    """Left join of the 32 fixed band rows on (collection, asset_key); their columns get the prefix ``b_``."""
    dim = profile_bands(df.sparkSession)
    dim = dim.select(*[F.col(c).alias(f"b_{c}") for c in dim.columns])
    same = (F.col("collection") == F.col("b_collection")) & (F.col("asset_key") == F.col("b_asset_key"))
    return df.join(F.broadcast(dim), same, "left")


def with_source_info(df: DataFrame) -> DataFrame:
    """Provider, endpoint and access kind of the catalog, with a default for unknown ones."""
    dim = source_info(df.sparkSession).withColumnRenamed("catalog", "s_catalog")
    joined = df.join(F.broadcast(dim), F.col("catalog") == F.col("s_catalog"), "left")
    return joined.withColumns(
        {
            "provider": F.coalesce("provider", "catalog"),
            "endpoint": F.coalesce("endpoint", F.lit("")),
            "auth_type": F.coalesce("auth_type", F.lit("unknown")),
        }
    ).drop("s_catalog")


def merge_registries(
    old: dict[str, DataFrame], new: dict[str, DataFrame], mode: str = "fill"
) -> dict[str, DataFrame]:
    """Upsert every table of ``new``. ``mode='replace'`` lets poorer product details overwrite richer ones."""
    merged = {}
    for table, delta in new.items():
        keep = ASSET_KEEP if table == "assets" else ()
        fill = PRODUCT_FILL if table == "products" and mode == "fill" else ()
        merged[table] = upsert(conform(old[table], table), delta, REGISTRY_KEY[table], keep=keep, fill=fill)
    return merged


def drop_stale_grids(grids: DataFrame, assets: DataFrame) -> DataFrame:
    """Remove profile grids without a projection that no asset refers to any more."""
    used = assets.filter(F.col("grid_id") != "").select("grid_id").distinct()
    stale = grids.join(used, "grid_id", "left_anti").filter(
        F.col("grid_id").startswith("hls_mgrs_30m") & F.col("epsg").isNull()
    )
    return grids.join(stale.select("grid_id"), "grid_id", "left_anti")


def reindex(
    assets: DataFrame, products: DataFrame, files: DataFrame, sidecars: DataFrame, collections: DataFrame, now: str
) -> DataFrame:
    """Deliveries rebuilt from registered assets whose file exists, their sidecar item and collection record.

    ``files``: path, byte_size, checksum_sha256, raster. ``sidecars``: parent, item; a null
    item (a broken document) counts as none. ``collections``: collection,
    collection_metadata. An asset without a sidecar keeps the collection its product was
    registered with, and thereby its id.
    """
    base = assets.select(
        text.packed(F.col("asset_id")).alias("_id"), "product_id", "source_item_id", "asset_key", "source_url", "local_path", "status", "run_id", "datetime", "updated_at",
    )
    named = products.select("product_id", F.col("collection_id").alias("_collection"))
    joined = base.join(_beside(files, sidecars), "local_path").join(named, "product_id", "left")
    return joined.select(*_delivery(F.col, text.unpacked(F.col("_id")), now)).join(collections, "collection", "left")


def _beside(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Facts of each file and the item of its sidecar, as far as a delivery takes something from it.

    Sidecars meet the files, not the assets: a file is a path and few facts, an asset is wide and travels once.
    """
    facts = files.select(F.col("path").alias("local_path"), F.col("byte_size").alias("_size"), text.packed(F.col("checksum_sha256")).alias("_sum"), F.col("raster").alias("_raster"))
    facts = facts.withColumn("parent", text.parent(F.col("local_path")))
    facts = facts.withColumn("_rest", F.substring("local_path", F.length("parent") + 1, F.length("local_path"))).drop("local_path")
    item = F.col("item")
    used = F.struct(item["id"].alias("id"), item["collection"].alias("collection"), item["properties"]["datetime"].alias("datetime"), item["bbox"].alias("bbox"), item["geometry"].alias("geometry"))
    items = sidecars.select("parent", F.when(item.isNotNull(), used).alias("item"))
    return facts.join(items, "parent", "left").withColumn("local_path", F.concat("parent", "_rest")).drop("parent", "_rest")


def _delivery(was: Callable[[str], Column], asset_id: Column, now: str) -> list[Column]:
    """Columns of the delivery that an asset makes with its file and sidecar; ``was`` gives the columns of the asset."""
    item = F.col("item")
    return [
        text.first_truthy(was("run_id"), F.lit("reindex")).alias("run_id"),
        text.source_catalog(F.col("local_path")).alias("catalog"),
        text.first_truthy(item["collection"], F.coalesce("_collection", was("product_id"))).alias("collection"),
        F.when(item.isNull(), was("source_item_id")).otherwise(text.first_truthy(item["id"], F.lit("unknown"))).alias("item_id"),
        was("asset_key").alias("asset_key"), was("source_url").alias("source_url"), "local_path", F.col("_size").alias("byte_size"), text.unpacked(F.col("_sum")).alias("checksum_sha256"),
        F.when(item.isNull(), was("datetime")).otherwise(item["datetime"]).alias("datetime"),
        item["bbox"].alias("bbox"), item["geometry"].alias("geometry"), F.col("_raster").alias("raster"), was("status").alias("status"),
        F.lit(now).alias("registered_at"), F.struct(was("updated_at").alias("updated_at"), asset_id.alias("asset_id")).alias("seq"),
    ]


def rebuild(
    registries: dict[str, DataFrame], files: DataFrame, sidecars: DataFrame, collections: DataFrame, now: str
) -> dict[str, DataFrame]:
    """The registries after a full reindex: deliveries rebuilt, registered and merged, stale grids dropped.

    Assets are read once. Each is written with its file and sidecar; most keep their id, and so become their new row
    where they lie. Only ids that more than one row lays claim to are folded and merged.
    """
    # few rows, known to be few when the joins with them are planned
    registries, collections = {**registries, "products": materialize(conform(registries["products"], "products"))}, materialize(collections)
    with settings(files.sparkSession, SMALL_TASKS):
        met = materialize(_met(conform(registries["assets"], "assets"), registries["products"], files, sidecars))
        old = F.struct(*[_was(c).alias(c) for c in registry_schema("assets").names]).alias("_old")
        found = met.select(old, "_found", F.col("_id").isNotNull().alias("_odd"), F.struct(*_own_identity(_was)[1:3]).alias("_own"), *_delivery(_was, _was("asset_id"), now))
        assets = _rewritten(_given(found))
        new = register(found.filter("_found").drop("_old", "_found", "_odd", "_own").join(collections, "collection", "left"))
    new.pop("assets")
    merged = {**registries, **merge_registries(registries, new), "assets": assets}
    return {**merged, "grids": drop_stale_grids(merged["grids"], merged["assets"])}


def _met(assets: DataFrame, products: DataFrame, files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Assets with the facts of their file and sidecar, if there are any. An id that is the digest of its own row does not travel: it is made again."""
    named = products.select("product_id", F.col("collection_id").alias("_collection"))
    own = text.asset_id(*_own_identity(F.col))
    columns = [text.packed(F.col(c)).alias(c) if c == "checksum_sha256" else F.col(c) for c in assets.columns if c not in ("asset_id", "local_path")]
    rows = assets.join(named, "product_id", "left").select(
        "local_path", "_collection", F.when(~own.eqNullSafe(F.col("asset_id")), text.packed(F.col("asset_id"))).alias("_id"), F.struct(*columns).alias("_was"))
    beside = _beside(files, sidecars).withColumn("_found", F.lit(True))
    return rows.join(beside, "local_path", "left").withColumn("_found", F.coalesce("_found", F.lit(False)))


def _own_identity(was: Callable[[str], Column]) -> list[Column]:
    """Identity of a delivery of the asset itself, without a sidecar."""
    known = [F.coalesce("_collection", was("product_id"), F.lit("unknown")), F.coalesce(was("source_item_id"), F.lit("unknown"))]
    return [text.source_catalog(F.col("local_path")), *known, was("asset_key"), was("source_url")]


def _was(name: str) -> Column:
    """A column of the asset in the rows of :func:`_met`."""
    value = F.col("_was")[name]
    if name == "asset_id":
        return F.coalesce(text.unpacked(F.col("_id")), text.asset_id(*_own_identity(lambda c: F.col("_was")[c])))
    return F.col(name) if name == "local_path" else text.unpacked(value) if name == "checksum_sha256" else value


def _rewritten(found: DataFrame) -> DataFrame:
    """Assets (``_old``) after the upsert of the deliveries beside them, those with ``_found``.

    The rows lay claim to their old id and, if it differs, to the new one. An id with one claim has at most one old row and one
    delivery, side by side. Claims are counted by 8 bytes of the ids; those that share these go to the fold and the join by id.
    """
    fields = registry_schema("assets").fields
    values = {"asset_id": _delivered_id(), "created_at": F.col("registered_at"), **{c: F.col(c) for c in ASSET_KEEP}, **{c: made for c, (made, _) in _asset_values().items()}}
    # with its own collection and item a file keeps the id, if that is a digest; only for others it is made and compared
    other = F.col("_odd") | (F.struct("collection", "item_id") != F.col("_own"))
    rows = found.withColumn("_moved", F.when(F.col("_found") & other, F.col("_old.asset_id") != _delivered_id()).otherwise(False))
    stayed = rows.withColumn("_claim", F.xxhash64("_old.asset_id"))
    moved = rows.filter("_moved").withColumn("_claim", F.xxhash64(_delivered_id()))
    claims = stayed.select("_claim").unionByName(moved.select("_claim"))
    several = materialize(claims.groupBy("_claim").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_claim"))

    def written(stayed: DataFrame, moved: DataFrame) -> DataFrame:
        here = F.col("_found") & ~F.col("_moved")
        now = {f.name: values[f.name].cast(f.dataType) for f in fields}
        kept = [_merged(c, F.col("_old")[c], F.col("_old.asset_id") if c == "asset_id" else now[c], F.lit(True), here, "asset_id", ASSET_KEEP) for c in now]
        return stayed.select(*kept).unionByName(moved.select(*[value.alias(c) for c, value in now.items()]))

    if several.isEmpty():
        return written(stayed, moved)
    old = stayed.join(several, "_claim", "left_semi").select("_old.*").dropDuplicates(["asset_id"])
    again = found.filter("_found").withColumn("_claim", F.xxhash64(_delivered_id())).join(several, "_claim", "left_semi")
    folded = upsert(old, conform(_registered_assets(again, None), "assets"), "asset_id", keep=ASSET_KEEP)
    alone = [side.join(several, "_claim", "left_anti") for side in (stayed, moved)]
    return written(*alone).unionByName(materialize(folded))


# ---- processing runs -------------------------------------------------------


def start_runs(runs: DataFrame, started: DataFrame) -> DataFrame:
    """Insert runs that are not there yet; a known run id is left alone."""
    fresh = conform(started, "processing_runs").join(runs.select("run_id"), "run_id", "left_anti")
    return runs.unionByName(fresh)


def run_outputs(assets: DataFrame) -> DataFrame:
    """Distinct (run_id, asset_id) pairs."""
    return assets.select("run_id", "asset_id").distinct()


def run_digests(assets: DataFrame) -> DataFrame:
    """Per run: number of distinct outputs and SHA-256 of their sorted, newline-joined ids.

    A digest is one chain over all ids of its run, so a run is one stream: its ids are
    sorted (with spilling, if need be) and fed to the hash one batch after another in
    constant memory, 65 bytes for an id. The definition is the same for runs of any size.
    """
    kind = assets.schema["run_id"].dataType.simpleString()
    # a pair seen twice is next to itself once sorted, so that no shuffle of its own has to find it
    ids = assets.select("run_id", text.packed(F.col("asset_id")).alias("_id")).repartition("run_id")
    ids = ids.select("run_id", text.unpacked(F.col("_id")).alias("asset_id")).sortWithinPartitions("run_id", "asset_id")
    return ids.mapInArrow(_digest_runs, f"run_id {kind}, output_count bigint, checksum string")


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run from rows sorted by (run, id); equal rows count once."""
    run, digest, count, schema, before = None, None, 0, None, None

    def row() -> pa.RecordBatch:
        columns = [pa.array([run], schema), pa.array([count], pa.int64()), pa.array([digest.hexdigest()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["run_id", "output_count", "checksum"])

    for batch in batches:
        schema = batch.schema.field("run_id").type
        for name, asset in zip(batch.column("run_id").to_pylist(), batch.column("asset_id").to_pylist()):
            if digest is None or name != run:
                if digest is not None:
                    yield row()
                run, digest, count = name, hashlib.sha256(), 0
            elif asset == before:
                continue
            digest.update(asset.encode() if not count else b"\n" + asset.encode())
            before, count = asset, count + 1
    if digest is not None:
        yield row()


def finish_runs(runs: DataFrame, finished: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Close runs (``finished``: run_id, status, end_time); returns the runs and the unknown run ids.

    The output ids of a run are the rows of :func:`run_outputs`, for runs of any size; the
    list column of the run row stays as it is, since one row cannot hold a large run.
    """
    unknown = finished.join(runs.select("run_id"), "run_id", "left_anti").select("run_id")
    digests = run_digests(assets.join(finished.select("run_id"), "run_id", "left_semi"))
    closed = finished.select("run_id", F.col("status").alias("_status"), F.col("end_time").alias("_end")).join(digests, "run_id", "left")
    closed = closed.select("run_id", "_status", "_end", F.coalesce("checksum", F.sha2(F.lit(""), 256)).alias("_checksum"))
    there = F.col("_status").isNotNull()
    updated = runs.join(closed, "run_id", "left").withColumns(
        {
            "status": F.when(there, F.col("_status")).otherwise(F.col("status")),
            "end_time": F.when(there, F.col("_end")).otherwise(F.col("end_time")),
            "checksum": F.when(there, F.col("_checksum")).otherwise(F.col("checksum")),
        }
    )
    return conform(updated, "processing_runs"), unknown


def registry_counts(registries: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(table).alias("table_name"), "row_count")
        for table, df in registries.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def empty_registries(spark) -> dict[str, DataFrame]:
    return {table: spark.createDataFrame([], registry_schema(table)) for table in REGISTRY}
