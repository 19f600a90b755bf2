"""Search pages in packed files, and item sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ITEM_DDL, parse
from . import inventory, page_files


def write_pages(items: DataFrame, path: str, file_bytes: int = page_files.FILE_BYTES) -> None:
    """Add items (run_id, page_number, position, item columns) as pages; one write becomes visible as a whole.

    A page written again replaces the earlier one. A page is bounded by the page size of the search.
    """
    rows = items.withColumn("value", F.to_json(F.struct(*[c for c in sorted(items.columns) if c not in ("run_id", "page_number")])))
    placed = rows.repartition("run_id", "page_number").sortWithinPartitions("run_id", "page_number", "position")
    page_files.registered(items.sparkSession)
    placed.select(F.col("run_id").cast("string").alias("run_id"), F.col("page_number").cast("int").alias("page_number"), "value").write.format(
        page_files.FORMAT
    ).mode("append").option("fileBytes", file_bytes).save(path)


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """The pages themselves: run_id, page_number, commit, file, offset, size, number of items and SHA-256."""
    return page_files.registered(spark).read.format(page_files.FORMAT).option("index", True).load(path)


def replaced_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that were written more than once, with their newest commit."""
    versions = page_index(spark, path).groupBy("run_id", "page_number").agg(F.count(F.lit(1)).alias("_n"), F.max("commit").alias("_newest"))
    return versions.filter("_n > 1").select("run_id", "page_number", "_newest")


def read_pages(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """Items of all pages with run_id, page_number and position; the schema is declared, nothing is inferred.

    ``columns`` declares fewer item columns; of an item only what is declared is parsed.
    """
    rows = page_files.registered(spark).read.format(page_files.FORMAT).load(path)
    replaced = replaced_pages(spark, path)
    if not replaced.isEmpty():  # else no page has to be compared with any other
        rows = rows.join(replaced, ["run_id", "page_number"], "left").filter("_newest IS NULL OR commit = _newest").drop("_newest")
    return parsed_items(rows.drop("commit"), columns)


def parsed_items(rows: DataFrame, columns: str | None = None) -> DataFrame:
    """Item columns from the JSON text of each row in ``value``, those of ``columns`` if given; the other columns stay."""
    schema = parse(columns or ITEM_DDL + ", position BIGINT")
    item = rows.withColumn("_i", F.from_json("value", schema))
    return item.select(*[c for c in rows.columns if c != "value"], "_i.*")


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows (run_id, page_number, value) of pages as writes become visible; ``value`` is the JSON text of an item."""
    return page_files.registered(spark).readStream.format(page_files.FORMAT).load(path).drop("commit")


def page_checksums(spark: SparkSession, path: str) -> DataFrame:
    """File, place, size and SHA-256 of each page as it is stored, from the index."""
    return page_index(spark, path).select("path", "offset", "byte_size", "checksum_sha256")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """``metadata.json`` beside assets as (parent, item); an invalid document gives a null item.

    Folders are listed and documents read by the executors. Spark's file source would list every folder on the driver
    and plan every document as a file of its own there. As in that source, hidden folders and what is below them are left out.
    """
    files = inventory.files_named(spark, root, "metadata.json")
    docs = inventory.texts(files.filter(~F.col("path").rlike("(^|/)[._]")), root)
    parent = F.regexp_replace("path", r"/?metadata\.json$", "")
    valid = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    return docs.select(parent.alias("parent"), F.when(valid, F.from_json("value", parse(ITEM_DDL))).alias("item"))
