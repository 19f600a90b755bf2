"""Read-only questions over the registries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import row_contains
from ..profiles import LAYERS, relation
from ..schemas import REGISTRY_KEY, REGISTRY_ORDER
from . import ordering


def normalize_json(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parse JSON text columns into variants under their name without ``_json``; invalid text stays text."""
    out = []
    for name in df.columns:
        if name not in columns:
            out.append(F.col(name))
            continue
        raw = F.nullif(F.col(name), F.lit(""))
        quoted = F.parse_json(F.to_json(F.struct(raw.alias("v"))))
        value = F.coalesce(F.try_parse_json(raw), F.variant_get(quoted, "$.v", "variant"))
        out.append(F.when(raw.isNotNull(), value).alias(name.removesuffix("_json")))
    return df.select(*out)


def search_assets(
    assets: DataFrame,
    product_id: str | None = None,
    status: str | None = None,
    query: str | None = None,
    include_keys: bool = False,
) -> DataFrame:
    """Optional equality filters, which reach the Parquet scan, and a text search over the row."""
    if product_id:
        assets = assets.filter(F.col("product_id") == product_id)
    if status:
        assets = assets.filter(F.col("status") == status)
    return search_rows(assets, query, include_keys) if query else assets


def search_rows(df: DataFrame, query: str, include_keys: bool = False) -> DataFrame:
    return df.filter(row_contains(query, df.columns, include_keys))


def lookup(df: DataFrame, **key: str) -> DataFrame:
    for name, value in key.items():
        df = df.filter(F.col(name) == value)
    return df.limit(1)


def registry_page(df: DataFrame, table: str, offset: int = 0, limit: int = 100, query: str | None = None) -> DataFrame:
    """Newest first, empty times last, ties by key. The page is cut before any further projection."""
    if table not in REGISTRY_KEY:
        raise KeyError(table)
    if query:
        df = search_rows(df, query)
    newest = F.coalesce(F.col(REGISTRY_ORDER[table]), F.lit("")).desc()
    return ordering.page(df, [newest], REGISTRY_KEY[table], offset, limit)


def page_summary(df: DataFrame, query: str | None = None) -> DataFrame:
    """What goes with a page of a registry: the number of rows that it pages through, and their columns."""
    rows = search_rows(df, query) if query else df
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("columns", F.array(*[F.lit(c) for c in df.columns]))


def product_rollup(products: DataFrame, assets: DataFrame, variables: DataFrame) -> DataFrame:
    """Products with asset count, bytes, first and last acquisition time and variable count.

    Both facts are aggregated before they are joined. Times are grouped first so
    that the large pass is a hash aggregation; text minima would need a sort.
    """
    times = F.nullif(F.col("datetime"), F.lit(""))
    by_time = assets.groupBy("product_id", times.alias("_time")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("byte_size", F.lit(0))).alias("_bytes")
    )
    facts = by_time.groupBy("product_id").agg(
        F.sum("_n").alias("asset_count"), F.sum("_bytes").alias("byte_size"),
        F.min("_time").alias("start_datetime"), F.max("_time").alias("end_datetime"),
    )
    counts = variables.groupBy(F.col("source_product").alias("product_id")).agg(
        F.count(F.lit(1)).alias("variable_count")
    )
    zero = F.lit(0).cast("bigint")
    return (
        products.join(facts, "product_id", "left").join(counts, "product_id", "left")
        .withColumns({n: F.coalesce(n, zero) for n in ("asset_count", "byte_size", "variable_count")})
    )


def product_bboxes(products: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per registered bbox of a product: a list per product would be unbounded."""
    boxes = assets.filter(F.col("bbox").isNotNull()).select("product_id", "asset_id", "bbox")
    return products.select("product_id").join(boxes, "product_id")


def product_variables(products: DataFrame, variables: DataFrame) -> DataFrame:
    """Products with each of their variables, one row per pair; products without variables stay."""
    return products.join(variables, products["product_id"] == variables["source_product"], "left").select(
        products["product_id"], *[variables[c] for c in variables.columns if c not in ("source_product",)]
    )


def lake_summary(assets: DataFrame, runs: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """One row of totals. ``audit`` is the one-row path audit; without it the status column decides what is missing."""
    measures = [
        assets.agg(
            F.count(F.lit(1)).alias("asset_count"),
            F.sum(F.coalesce("byte_size", F.lit(0))).alias("asset_bytes"),
            F.count_if(F.col("status") == "missing").alias("status_missing"),
        ),
        runs.filter("status = 'completed'").agg(
            F.max_by("end_time", F.struct(F.coalesce("start_time", F.lit("")), "run_id")).alias("last_successful_run")
        ),
    ]
    zero = F.lit(0).cast("bigint")
    if audit is not None:
        measures.append(audit)
        missing, extra = F.col("missing_assets"), F.col("unregistered_source_files")
    else:
        missing, extra = F.col("status_missing"), zero
    return one_row(measures).select(
        "asset_count", F.coalesce("asset_bytes", zero).alias("asset_bytes"), (F.col("asset_count") - missing).alias("available_assets"),
        missing.alias("missing_assets"), extra.alias("unregistered_source_files"), "last_successful_run",
    )


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row aggregates side by side: stacked with nulls, then folded, which needs no join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def ancestor_directories(paths: DataFrame, path: str) -> DataFrame:
    """Distinct ancestor directories of the paths, without the root of the source layer."""
    parents = paths.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("_dir")).filter("_dir <> ''").distinct()
    segments = F.split("_dir", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))
    return parents.select(F.explode(prefixes).alias("directory")).filter("directory <> 'source'").distinct()


def layer_stats(registries: dict[str, DataFrame]) -> DataFrame:
    """Per-layer counts estimated from the registries alone."""
    assets, runs = registries["assets"], registries["processing_runs"]
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")

    def facts(layer: str, files: Column = zero, directories: Column = zero, size: Column = zero, changed: Column = none) -> Column:
        return F.struct(
            F.lit(layer).alias("layer"), files.alias("file_count"), directories.alias("directory_count"), size.alias("byte_size"),
            changed.alias("modified_at"),
        )

    rows = F.count(F.lit(1))
    # one pass over the assets feeds three layers
    totals = assets.agg(
        F.count_if(F.col("local_path") != "").alias("located"), F.sum(F.coalesce("byte_size", F.lit(0))).alias("size"),
        F.max(F.nullif("updated_at", F.lit(""))).alias("changed"), rows.alias("n"),
    )
    size, changed = F.coalesce("size", zero), F.col("changed")
    parts = [
        totals.select(F.inline(F.array(
            facts("source", F.col("located"), size=size, changed=changed), facts("catalog", changed=changed),
            facts("registry", (F.col("n") > 0).cast("bigint"), changed=changed),
        ))),
        ancestor_directories(assets.filter(F.col("local_path") != ""), "local_path").agg(rows.alias("n")).select(
            F.inline(F.array(facts("source", directories=F.col("n"))))
        ),
        assets.filter(F.col("source_item_id") != "").select("source_item_id").distinct().agg(rows.alias("n")).select(
            F.inline(F.array(facts("catalog", F.col("n"))))
        ),
        runs.agg(
            rows.alias("n"), F.max(F.nullif("start_time", F.lit(""))).alias("started"),
            F.max(F.coalesce(F.nullif("end_time", F.lit("")), F.nullif("start_time", F.lit("")))).alias("ended"),
        ).select(F.inline(F.array(
            facts("manifests", F.col("n"), changed=F.col("ended")),
            facts("registry", (F.col("n") > 0).cast("bigint"), changed=F.col("started")),
        ))),
    ]
    for table, df in registries.items():
        if table in ("assets", "processing_runs"):
            continue
        stamp = F.max(F.nullif("updated_at", F.lit(""))) if "updated_at" in df.columns else none
        parts.append(df.agg(rows.alias("n"), stamp.alias("changed")).select(
            F.inline(F.array(facts("registry", (F.col("n") > 0).cast("bigint"), changed=F.col("changed"))))
        ))
    layers = relation(assets.sparkSession, ["layer"], [(name,) for name in LAYERS]).select("layer", *[
        F.lit(0).cast("bigint").alias(c) for c in ("file_count", "directory_count", "byte_size")], none.alias("modified_at"))
    return reduce(DataFrame.unionByName, [layers, *parts]).groupBy("layer").agg(
        *[F.sum(c).alias(c) for c in ("file_count", "directory_count", "byte_size")], F.max("modified_at").alias("modified_at")
    )


def layer_share(stats: DataFrame) -> DataFrame:
    """Bar length of a layer relative to the largest; the window runs over the nine layer rows."""
    largest = F.greatest(F.max("byte_size").over(Window.partitionBy()), F.lit(1))
    return stats.select("layer", "byte_size", (F.col("byte_size") / largest).alias("share"))


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column) != "").distinct().orderBy(column)


def filter_products(products: DataFrame, modality: str | None = None, query: str | None = None) -> DataFrame:
    if modality:
        products = products.filter(F.col("modality") == modality)
    return search_rows(products, query) if query else products


def attention_count(audit: DataFrame, runs: DataFrame) -> DataFrame:
    """Missing and unregistered files plus runs that failed wholly or in part."""
    troubled = runs.agg(F.count_if(F.col("status").isin("failed", "partial")).alias("_troubled"))
    issues = F.col("missing_assets") + F.col("unregistered_source_files") + F.col("_troubled")
    return one_row([audit, troubled]).select(issues.alias("issues"))
