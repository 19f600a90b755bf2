"""Streams: resumption, deduplication, registration, live state."""

from pyspark.sql import functions as F
from test_registry import delivery
from test_sources import page_rows

from terraspan.operators import registry, runs
from terraspan.session import settings
from terraspan.sources import pages
from terraspan.sources.registry_store import RegistryStore
from terraspan.streaming import changes, ingest, progress


def test_page_stream_resumes_and_deduplicates(spark, tmp_path):
    landed, out, check = str(tmp_path / "pages"), str(tmp_path / "items"), str(tmp_path / "check")
    pages.write_pages(page_rows(spark).filter("page_number = 1"), landed)
    stream = lambda: ingest.ingest_pages(pages.stream_pages(spark, landed), "nasa", out, check)
    stream().awaitTermination()
    assert [r["source_item_id"] for r in ingest.read_items(spark, out).collect()] == ["i1"]
    pages.write_pages(page_rows(spark).filter("page_number = 2"), landed)
    stream().awaitTermination()
    assert sorted((r["source_item_id"], r["page_number"]) for r in ingest.read_items(spark, out).collect()) == [("i1", 1), ("i2", 2)]


def sighting(spark, run, page, position, item):
    asset = {"B04": (f"https://example/{item}.tif", ["data"])}
    columns = "run_id STRING, page_number INT, position BIGINT, id STRING, collection STRING, assets MAP<STRING, STRUCT<href: STRING, roles: ARRAY<STRING>>>"
    return spark.createDataFrame([(run, page, position, item, "c", asset)], columns)


def test_closed_runs_leave_no_state(spark, tmp_path):
    landed, out, check = str(tmp_path / "pages"), str(tmp_path / "items"), str(tmp_path / "check")
    states = []

    def land(*rows):
        for row in rows:
            pages.write_pages(row, landed)
        query = ingest.ingest_pages(pages.stream_pages(spark, landed), "nasa", out, check, idle_ms=1, shards=2)
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        return sorted((r["run_id"], r["source_item_id"], r["page_number"], r["position"]) for r in ingest.read_items(spark, out).collect())

    first = sighting(spark, "r", 5, 0, "i")
    for position in range(1, 12):
        first = first.unionByName(sighting(spark, "r", 5, position, f"i{position}"))
    assert len(land(first)) == 12 and states[-1] == 2  # one packed value for each shard
    # the timers of the first micro-batch fire with the second one, which holds another run only
    assert len(land(sighting(spark, "s", 1, 0, "k"))) == 13 and states[-1] == 1


def test_a_late_page_replaces_a_later_sighting(spark, tmp_path):
    landed, out, check = str(tmp_path / "pages"), str(tmp_path / "items"), str(tmp_path / "check")
    for page in (5, 7, 2):  # each is taken by a micro-batch of its own
        pages.write_pages(sighting(spark, "r", page, 0, "i"), landed)
        ingest.ingest_pages(pages.stream_pages(spark, landed), "nasa", out, check).awaitTermination()
    assert [(r["source_item_id"], r["page_number"]) for r in ingest.read_items(spark, out).collect()] == [("i", 2)]
    assert [(r["page_number"]) for r in spark.read.parquet(f"{out}/replaced").collect()] == [5]


def test_register_stream_equals_batch(spark, tmp_path):
    landed = str(tmp_path / "deliveries")
    first, second = delivery(spark), delivery(spark, run_id="run-2", status="skipped", seq=2, registered_at="2024-01-05T00:00:00Z")
    first.write.parquet(landed)
    store = RegistryStore(spark, str(tmp_path / "lake"))
    source = lambda: spark.readStream.schema(first.schema).parquet(landed)
    ingest.register_stream(source(), store, str(tmp_path / "check")).awaitTermination()
    second.write.mode("append").parquet(landed)
    ingest.register_stream(source(), store, str(tmp_path / "check")).awaitTermination()
    batch = registry.merge_registries(registry.empty_registries(spark), registry.register(first.unionByName(second)))
    for table in ("assets", "products", "variables", "grids", "sources"):
        assert sorted(map(str, store.read(table).collect())) == sorted(map(str, batch[table].collect())), table


def test_dealt_deliveries_are_shuffled_while_narrow(spark, tmp_path, monkeypatch):
    """Lines and orders meet, their rows are dealt by part, and neither fold nor store shuffles or writes them before the store has parts."""
    from terraspan.plans.registry_queries import deliveries
    from terraspan.plans.views import DEALT_BY, Views
    from terraspan.sources import registry_store

    v = Views(spark, "/root/testdata/sf0.001")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        dealt = registry.register_dealt(deliveries(v, None, registry_store.part_of("assets")), DEALT_BY)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange") == 3
    monkeypatch.setattr(registry_store, "materialize", None)
    store = RegistryStore(spark, str(tmp_path))
    store.merge({"assets": dealt.limit(0)}, dealt=["assets"])
    assert store.manifest("assets")["parts"] == {}
    store.merge({"assets": dealt}, dealt=["assets"])
    want = registry.register(deliveries(v))["assets"]
    assert sorted(map(str, store.read("assets").collect())) == sorted(map(str, want.collect()))


def test_dealt_batches_meet_what_is_stored(spark, tmp_path):
    first = delivery(spark).unionByName(delivery(spark, item_id="granule-2", checksum_sha256="not a digest"))
    second = delivery(spark, run_id="run-2", status="skipped", seq=2, registered_at="2024-01-05T00:00:00Z", checksum_sha256=None)
    store, landed = RegistryStore(spark, str(tmp_path / "lake")), str(tmp_path / "landed")
    deal = lambda rows: rows.withColumns({"_part": F.lit("p"), "item": F.col("item_id")}).repartitionByRange(2, "_part", "item")
    for batch in (first, second):
        batch.write.mode("append").parquet(landed)
        source = spark.readStream.schema(first.schema).parquet(landed)
        ingest.register_stream(source, store, str(tmp_path / "check"), deal=deal, dealt_by=["_part", "item"]).awaitTermination()
    batch = registry.merge_registries(registry.empty_registries(spark), registry.register(first.unionByName(second)))
    assert sorted(map(str, store.read("assets").collect())) == sorted(map(str, batch["assets"].collect()))


def test_attempt_state_stream(spark, tmp_path):
    from test_runs import events

    log, state, check = str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "check")
    df = events(spark)
    df.filter("seq <= 3").write.parquet(log)
    source = lambda: spark.readStream.schema(df.schema).parquet(log)
    progress.attempt_state_stream(source(), state, check).awaitTermination()
    df.filter("seq > 3").write.mode("append").parquet(log)
    progress.attempt_state_stream(source(), state, check).awaitTermination()
    short = str(tmp_path / "short")
    progress.compact_state(spark, state, short)
    assert sorted(map(str, progress.read_state(spark, short).collect())) == sorted(map(str, progress.read_state(spark, state).collect()))
    got = {(r["attempt_id"], r["status"]) for r in progress.read_state(spark, state).collect()}
    assert got == {(r["attempt_id"], r["status"]) for r in runs.latest_attempts(df).collect()}


def test_live_progress_stream_closes_windows(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("r", "completed", 60, "2024-01-01 00:00:10"), ("r", "failed", 0, "2024-01-01 00:00:50"), ("r", "queued", 0, "2024-01-01 02:00:00")],
                                 "run_id STRING, status STRING, downloaded_bytes BIGINT, ts STRING").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(log)
    stream = progress.live_progress(spark.readStream.schema(rows.schema).parquet(log))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["updates"], r["completed_files"], r["failed_files"], r["speed"]) for r in done] == [(2, 1, 1, 1.0)]


def test_rows_of_a_shard_pass_in_chunks(spark, tmp_path, monkeypatch):
    """Many keys in one shard, in buckets of few and with rows that wait in a file: the same winners, replaced once a micro-batch."""
    monkeypatch.setattr(changes, "KEYS_PER_BUCKET", 100)
    monkeypatch.setattr(changes, "HELD_ROWS", 50)
    landed, out, check = str(tmp_path / "rows"), str(tmp_path / "out"), str(tmp_path / "check")
    far = (1 << 60) + 1  # no double holds it
    rows = spark.range(900).select((F.col("id") % 300).alias("name"), F.lit("g").alias("grp"), (far + F.col("id") * 7 % 900).alias("place"))

    def run():
        stream = changes.winning_rows(spark.readStream.schema(rows.schema).parquet(landed), "grp", ["name"], ["place"], shards=1)
        write = lambda batch, n: changes.append_changes(batch, n, out, ["name"], ["place"])
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "40"}), changes.keyed_state(spark):
            stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    rows.write.parquet(landed)
    run()
    assert spark.read.parquet(f"{out}/rows").count() == 300 and spark.read.parquet(f"{out}/replaced").count() == 0
    earlier = rows.filter("name < 200").withColumn("place", F.col("place") - 1000)
    earlier.write.mode("append").parquet(landed)
    run()
    got = changes.current_rows(spark, out, ["name"], ["place"]).select("name", "place")
    want = rows.unionByName(earlier).groupBy("name").agg(F.min("place").alias("place"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert spark.read.parquet(f"{out}/replaced").count() == 200
