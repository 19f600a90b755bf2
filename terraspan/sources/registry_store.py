"""Registry tables as Parquet folders under a manifest that is swapped atomically."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.registry import conform, merge_registries
from ..schemas import REGISTRY, REGISTRY_KEY, registry_schema
from ..session import shuffle_files_freed, materialize, scratch_scope

MANIFEST = "_current"
BUCKETS = 32
WHOLE = "all"
DIGESTS = ("asset_id", "checksum_sha256")


def part_of(table: str) -> Column:
    """Part a row is stored in: assets by product and a bucket of their item, both fixed by the asset's identity."""
    if table != "assets":
        return F.lit(WHOLE)
    product = F.regexp_replace(F.coalesce("product_id", F.lit("")), r"[^A-Za-z0-9_.-]", "_")
    bucket = F.pmod(F.xxhash64("product_id", "source_item_id"), F.lit(BUCKETS))
    return F.concat_ws("-", product, F.lpad(bucket.cast("string"), 2, "0"))


class RegistryStore:
    """The six registry tables below ``root``.

    A table is a set of parts; the manifest names the folder of each. A merge reads and
    rewrites only the parts its rows fall into, then swaps the manifest, so readers keep a
    whole version and a failed write leaves the old one in place. Folders that the last but
    one manifest still used are deleted. One writer per table at a time is assumed; other
    formats with MERGE can replace this class.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def manifest(self, table: str) -> dict:
        """``parts``: folder of each part; ``expired``: folders that no reader of the present manifest needs."""
        fs, pointer = self._fs(f"{self.root}/{table}/{MANIFEST}")
        if not fs.exists(pointer):
            return {"parts": {}, "expired": []}
        stream = fs.open(pointer)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """Rows in the declared schema, of all parts or of those named; an absent table is empty."""
        known = self.manifest(table)["parts"]
        folders = [f"{self.root}/{table}/{f}" for p, f in sorted(known.items()) if parts is None or p in parts]
        if not folders:
            # known to be empty when a query is planned, so that joins with it go
            return self.spark.createDataFrame([], registry_schema(table)).limit(0)
        return evolve(self.spark.read.schema(registry_schema(table)).parquet(*folders), table)

    def read_all(self) -> dict[str, DataFrame]:
        return {table: self.read(table) for table in REGISTRY}

    def write(self, table: str, df: DataFrame) -> None:
        """Replace a table."""
        self._store(table, df, None)

    def _store(self, table: str, df: DataFrame, touched: list[str] | None, dealt: bool = False) -> None:
        """Write the rows of the touched parts (all if None) to a new folder and point the manifest there; ``dealt`` rows lie by part already."""
        version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        rows = conform(df, table).withColumn("_part", part_of(table))
        order = ["_part", REGISTRY_KEY[table]]
        if dealt:
            laid = rows.sortWithinPartitions(*order)
        else:
            digests = [c for c in DIGESTS if c in rows.columns]
            # a part of any size is split over several tasks (and files), small ones meet in one; digests travel as bytes
            laid = rows.withColumns({c: text.packed(F.col(c)) for c in digests}).hint("rebalance", F.col("_part")).sortWithinPartitions(*order)
            laid = laid.withColumns({c: text.unpacked(F.col(c)) for c in digests})
        with shuffle_files_freed(self.spark):
            laid.write.option("compression", "zstd").partitionBy("_part").parquet(f"{self.root}/{table}/{version}")
        fs, home = self._fs(f"{self.root}/{table}/{version}")
        written = [s.getPath().getName() for s in fs.listStatus(home) if s.isDirectory()]
        if touched is not None and not written:
            fs.delete(home, True)
            return
        fresh = {name.removeprefix("_part="): f"{version}/{name}" for name in written}
        before = self.manifest(table)
        kept = {} if touched is None else {p: f for p, f in before["parts"].items() if p not in touched}
        self._point(table, {"parts": kept | fresh, "expired": sorted(set(before["parts"].values()) - set(kept.values()))})
        for folder in before["expired"]:
            old_fs, old = self._fs(f"{self.root}/{table}/{folder}")
            old_fs.delete(old, True)

    def _point(self, table: str, manifest: dict) -> None:
        fs, pointer = self._fs(f"{self.root}/{table}/{MANIFEST}")
        _, temporary = self._fs(f"{self.root}/{table}/{MANIFEST}.{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            pointer.toUri(), self.spark._jsc.hadoopConfiguration()
        )
        flags = self.spark.sparkContext._gateway.new_array(options, 1)
        flags[0] = options.OVERWRITE
        context.rename(temporary, pointer, flags)

    def merge(self, delta: dict[str, DataFrame], mode: str = "fill", dealt: Sequence[str] = ()) -> None:
        """Upsert registration rows. Of each table only the parts that the rows fall into are read and rewritten.

        The names of touched parts are collected: at most BUCKETS for each product. Rows of a table that has no parts yet are written as they are made,
        those of the tables named in ``dealt`` by the tasks that they lie in.
        """
        for table, df in delta.items():
            if not self.manifest(table)["parts"]:
                self._store(table, merge_registries({table: self.read(table)}, {table: conform(df, table)}, mode)[table], [], table in dealt)
                continue
            with scratch_scope(self.spark):
                rows = materialize(conform(df, table))  # packed, and the shuffles that made it are gone before the merge makes its own
                touched = [r[0] for r in rows.select(part_of(table).alias("p")).distinct().collect()]
                if touched:
                    merged = merge_registries({table: self.read(table, touched)}, {table: rows}, mode)
                    self._store(table, merged[table], touched)


def evolve(df: DataFrame, table: str) -> DataFrame:
    """Older files in the declared schema: absent columns null, surplus ones dropped, types cast."""
    return conform(df, table)
