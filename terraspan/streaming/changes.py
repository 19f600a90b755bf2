"""The winning row of every key of a stream: keyed state with timers, changes out, no log to fold.

Each key has one winning row, the first or the newest in some order. The state knows what
order the winner of each key has; a micro-batch emits the rows that win now, and what they
replace. Keys are dealt to shards by their hash, and the state of a shard is a map of
packed values of bounded size, each read and written once a micro-batch, however many groups or
keys it holds. The rows of a micro-batch pass in chunks and wait in a file until it is known
which of them win. When a group has been silent in a shard for a while it counts as closed: a
timer drops its keys.
"""

from __future__ import annotations

import os
import pickle
import sys
import tempfile
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import settings

SHARDS = 64  # states; a group of any size is spread over all of them
KEYS_PER_BUCKET = 50_000  # keys of a shard that are read, compared and written at once
HELD_ROWS = 20_000  # rows of a shard that wait in memory; more wait in a file
IDLE_MS = 24 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# names that do not start with an underscore, which rows lose on their way to the processor
_DIGEST, _PLACE, _GROUP, _SEEN = ("key_digest_a", "key_digest_b"), "place_in_batch", "group_digest", "seen_at"


# The process that asks a processor for its states, on the driver, does not see shipped packages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Waiting:
    """Chunks of rows that are read twice: in memory while they are few, else in a local file."""

    def __init__(self):
        self.chunks, self.rows, self.file = [], 0, None

    def add(self, chunk: pd.DataFrame) -> None:
        self.chunks.append(chunk)
        self.rows += len(chunk)
        if self.rows > HELD_ROWS:
            if self.file is None:
                local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                self.file = tempfile.TemporaryFile(dir=local if os.path.isdir(local) else None)
            for held in self.chunks:
                pickle.dump(held, self.file, protocol=5)
            self.chunks = []

    def again(self) -> Iterator[pd.DataFrame]:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield pickle.load(self.file)
            self.file.close()
        yield from self.chunks


class Winner(StatefulProcessor):
    """Keeps the order columns of the winner of each key of a shard, in Arrow tables of some ``KEYS_PER_BUCKET`` keys."""

    def __init__(self, order: Sequence[str], newest: bool, idle_ms: int):
        self.order, self.newest, self.idle_ms = list(order), newest, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("buckets", "bucket INT", "packed BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, waiting, narrow, kinds = int(time.time() * 1000), _Waiting(), [], None
        for chunk in rows:
            table = pa.Table.from_pandas(chunk[[*_DIGEST, *self.order, _GROUP]], schema=kinds, preserve_index=False)
            kinds = table.schema
            narrow.append(table.append_column(_PLACE, pa.array(np.arange(waiting.rows, waiting.rows + len(chunk)))))
            waiting.add(chunk)
        places, replaced = self._merge(now, pa.concat_tables(narrow))
        narrow, start = None, 0
        for chunk in waiting.again():
            first, last = np.searchsorted(places, (start, start + len(chunk)))
            out = chunk.iloc[places[first:last] - start].drop(columns=[*_DIGEST, _GROUP]).reset_index(drop=True)
            a, b = np.searchsorted(replaced[_PLACE], (start, start + len(chunk)))
            at = np.searchsorted(places[first:last], replaced[_PLACE].iloc[a:b])
            for c in self.order:  # as objects: whole numbers stay exact beside nulls
                values = np.full(len(out), None, object)
                values[at] = replaced[c].iloc[a:b].astype(object)
                out[f"replaced_{c}"] = values
            start += len(chunk)
            if len(out):
                yield out

    def _merge(self, now: int, fresh: pa.Table) -> tuple[np.ndarray, pd.DataFrame]:
        """Bring the state up to date; places of the rows that win now, and the order columns of what some of them replace."""
        groups = fresh[_GROUP].unique().to_pandas()
        bits = self._grown(now, len(fresh))
        bucket = fresh[_DIGEST[1]].to_numpy() & ((1 << bits) - 1)
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange((1 << bits) + 1))
        del bucket
        places, replaced, oldest = [], [], now
        for n in range(1 << bits):
            name = (1 << bits) + n
            rows = fresh.take(pa.array(by_bucket[cuts[n] : cuts[n + 1]])).to_pandas()
            rows[_SEEN] = now
            known = self._open(name, now)
            # what is known comes first, so that an equal row changes nothing
            both = rows if known is None else pd.concat([known.assign(**{_PLACE: -1}), rows], ignore_index=True)
            both = both.sort_values(self.order, ascending=not self.newest, kind="stable")
            winners = both.drop_duplicates(list(_DIGEST)).copy()
            winners.loc[winners[_GROUP].isin(groups), _SEEN] = now
            self._keep(name, winners)
            won = winners.loc[winners[_PLACE] >= 0, [*_DIGEST, _PLACE]]
            places.append(won[_PLACE].to_numpy(np.int64))
            if known is not None:
                replaced.append(won.merge(known[[*_DIGEST, *self.order]], on=list(_DIGEST))[[_PLACE, *self.order]])
            if len(winners):
                oldest = min(oldest, int(winners[_SEEN].min()))
        self._settle(oldest)
        gone = pd.concat(replaced).sort_values(_PLACE) if replaced else pd.DataFrame(columns=[_PLACE, *self.order])
        return np.sort(np.concatenate(places)), gone.reset_index(drop=True)

    def _names(self) -> list[int]:
        """Buckets that hold keys. Bucket n of 2^b is named 2^b + n."""
        return [key[0] for key in self.known.keys()]

    def _grown(self, now: int, more: int) -> int:
        """Number of bits that tell buckets apart, after the buckets were split for ``more`` keys."""
        names = self._names()
        before = names[0].bit_length() - 1 if names else 0
        one = self._open(names[0], now) if names else None  # keys are dealt by hash, so a bucket tells of the others
        keys, bits = (0 if one is None else len(one) << before), before
        while keys + more > KEYS_PER_BUCKET << bits:
            bits += 1
        for name in names if bits > before else ():
            known = self._open(name, now)
            self.known.removeKey((name,))
            for part in range(name - (1 << before), 1 << bits, 1 << before):
                self._keep((1 << bits) + part, known[known[_DIGEST[1]] & ((1 << bits) - 1) == part])
        return bits

    def _open(self, bucket: int, now: int) -> pd.DataFrame | None:
        """What is known of groups that are not closed."""
        packed = self.known.getValue((bucket,)) if self.known.containsKey((bucket,)) else None
        if packed is None:
            return None
        known = pa.ipc.open_stream(packed[0]).read_pandas()
        return known[known[_SEEN] + self.idle_ms > now].reset_index(drop=True)

    def _keep(self, bucket: int, rows: pd.DataFrame) -> None:
        if not len(rows):
            if self.known.containsKey((bucket,)):
                self.known.removeKey((bucket,))
            return
        table = pa.Table.from_pandas(rows[[*_DIGEST, *self.order, _GROUP, _SEEN]], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.known.updateValue((bucket,), (sink.getvalue().to_pybytes(),))

    def _settle(self, oldest: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(oldest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, oldest = int(time.time() * 1000), []
        for name in self._names():
            left = self._open(name, now)
            self._keep(name, left)
            oldest += [int(left[_SEEN].min())] if len(left) else []
        if oldest:
            self._settle(min(oldest))
        return iter(())

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in the store that keyed state needs.

    Timers are looked at with the micro-batches that have data: batches without any, which Spark
    would run for them again and again, would never let a stream over what is there now end.
    """
    return settings(spark, {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"})


def winning_rows(
    rows: DataFrame, group: str, key: Sequence[str], order: Sequence[str], newest: bool = False, idle_ms: int = IDLE_MS, shards: int = SHARDS
) -> DataFrame:
    """Stream of rows that win among those of their ``key``, with the order columns of what they replace (``replaced_*``).

    ``group`` is a column that keys of one run share. All keys are spread over ``shards`` states,
    whose number stays the same for the life of a stream. Keys are told apart by 128 bits of hash.
    A row that arrives after its group's state is gone counts as new. The caller fills order
    and group columns, so that none is null; other columns are texts or hold no nulls, and
    no name starts with an underscore.
    """
    digest = [F.xxhash64(*key), F.xxhash64(F.lit(1), *key)]
    dealt = rows.withColumns(dict(zip(_DIGEST, digest))).withColumn(_GROUP, F.xxhash64(group)).withColumn("key_shard", F.pmod(_DIGEST[0], F.lit(shards)).cast("int"))
    replaced = [T.StructField(f"replaced_{c}", rows.schema[c].dataType) for c in order]
    out = T.StructType([*rows.schema.fields, T.StructField("key_shard", T.IntegerType()), *replaced])
    made = dealt.groupBy("key_shard").transformWithStateInPandas(Winner(order, newest, idle_ms), out, "Update", "ProcessingTime")
    return made.drop("key_shard")


def append_changes(batch: DataFrame, batch_id: int, path: str, key: Sequence[str], order: Sequence[str]) -> None:
    """Add a micro-batch of :func:`winning_rows` to the table at ``path``; a replay writes the same folders again."""
    spark, rows = batch.sparkSession, f"{path}/rows/batch={batch_id}"
    batch.write.mode("overwrite").parquet(rows)
    gone = spark.read.schema(batch.schema).parquet(rows).filter(F.col(f"replaced_{order[0]}").isNotNull())
    gone.select(*key, *[F.col(f"replaced_{c}").alias(c) for c in order]).write.mode("overwrite").parquet(f"{path}/replaced/batch={batch_id}")


def current_rows(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The winning row of every key: all rows but those replaced since, which are few and listed aside."""
    rows = spark.read.parquet(f"{path}/rows").drop("batch", *[f"replaced_{c}" for c in order])
    gone = spark.read.parquet(f"{path}/replaced").drop("batch").distinct()
    same = [rows[c].eqNullSafe(gone[c]) for c in (*key, *order)]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return rows.join(gone, condition, "left_anti")


def compact(spark: SparkSession, path: str, target: str, key: Sequence[str], order: Sequence[str]) -> None:
    """Write the winning rows at ``path`` as the first batch of a new table at ``target``.

    Run it while no stream writes and go on with ``target``; the stream's own state stays as it is.
    """
    rows = current_rows(spark, path, key, order)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    rows.select("*", *[F.lit(None).cast(kinds[c]).alias(f"replaced_{c}") for c in order]).write.mode("overwrite").parquet(f"{target}/rows/batch=-1")
    rows.select(*key, *order).limit(0).write.mode("overwrite").parquet(f"{target}/replaced/batch=-1")
