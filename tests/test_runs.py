"""Run state: control, listing, recovery, submission."""

from pyspark.sql import functions as F

from terraspan.operators import ingest, ordering, runs

EVENT = "attempt_id STRING, run_id STRING, batch_number INT, status STRING, downloaded_bytes BIGINT, updated_at STRING, seq BIGINT, error STRING"


def events(spark):
    rows = [("a1", "r1", 1, "queued", 0, "t1", 1, None), ("a1", "r1", 1, "completed", 5, "t3", 4, None), ("a2", "r1", 1, "failed", 0, "t2", 3, "boom"),
            ("a3", "r2", 1, "failed", 0, "t2", 5, "x"), ("a4", "r3", 1, "skipped", 7, "t2", 6, None), ("a5", "r4", 1, "downloading", 1, "t2", 7, None)]
    return spark.createDataFrame(rows, EVENT)


def test_status_folds(spark):
    latest = runs.latest_attempts(events(spark))
    assert {r["run_id"]: r["status"] for r in runs.run_status(latest).collect()} == {"r1": "partial", "r2": "failed", "r3": "completed", "r4": "downloading"}
    assert {(r["run_id"], r["status"]) for r in runs.batch_status(latest).collect()} == {("r1", "partial"), ("r2", "failed"), ("r3", "completed"), ("r4", "downloading")}


def test_retry_and_recover(spark):
    log = events(spark)
    again = runs.requeue_failed(runs.latest_attempts(log), "t9")
    assert {(r["attempt_id"], r["status"], r["error"]) for r in again.collect()} == {("a2", "queued", None), ("a3", "queued", None)}
    after = runs.latest_attempts(log.unionByName(again))
    assert {r["attempt_id"]: r["status"] for r in after.collect()}["a2"] == "queued"
    state = spark.createDataFrame([("r1", "paused", ""), ("r4", "downloading", ""), ("r5", "completed", "")], "run_id STRING, status STRING, message STRING")
    assert {r["run_id"]: r["status"] for r in runs.recover_runs(state).collect()} == {"r1": "paused", "r4": "queued", "r5": "completed"}
    assert {r["attempt_id"]: r["status"] for r in runs.recover_attempts(runs.latest_attempts(log), state).collect()}["a5"] == "queued"


def test_control(spark):
    state = spark.createDataFrame([("q", "queued"), ("p", "paused"), ("c", "cancelled"), ("f", "failed"), ("d", "completed"), ("a", "auth_required")], "run_id STRING, status STRING")
    allowed = {}
    for r in runs.allowed_actions(state).collect():
        allowed.setdefault(r["run_id"], {})[r["action"]] = r["next_status"]
    assert allowed["q"] == {"pause": "paused", "cancel": "cancelled"}
    assert allowed["p"] == {"pause": "paused", "resume": "queued", "cancel": "cancelled"}
    assert allowed["c"] == {"cancel": "cancelled"}
    assert allowed["f"] == {"resume": "queued", "retry": "queued"} and "d" not in allowed
    assert allowed["a"] == {"pause": "paused", "resume": "queued", "cancel": "cancelled", "retry": "queued"}
    asked = spark.createDataFrame([("c", "resume")], "run_id STRING, action STRING")
    assert runs.allowed_actions(state, asked).first()["next_status"] is None


def test_keyset_paging_walks_everything(spark):
    df = spark.range(0, 57).select(F.col("id").cast("string").alias("run_id"), F.concat(F.lit("t"), F.col("id") % 5).alias("created_at"))
    seen, cursor = [], None
    while True:
        rows, cursor = runs.page_of_runs(df, cursor, 10)
        seen += [(r["created_at"], r["run_id"]) for r in rows]
        if cursor is None:
            break
    assert seen == sorted(seen, reverse=True) and len(set(seen)) == 57


def test_idempotent_submission(spark):
    rows = [("r1", "k", "A", "t1"), ("r2", "k", "A", "t2"), ("r3", "k", "B", "t3"), ("r4", "z", "B", "t1")]
    out = runs.submit_idempotent(spark.createDataFrame(rows, "run_id STRING, idempotency_key STRING, request STRING, created_at STRING"))
    assert {r["run_id"]: (r["outcome"], r["resolved_run_id"]) for r in out.collect()} == {
        "r1": ("created", "r1"), "r2": ("reused", "r1"), "r3": ("conflict", None), "r4": ("created", "r4")}


def test_checkpoints(spark):
    pages = spark.createDataFrame([("r1", 1, "page-2"), ("r1", 2, None), ("r2", 1, "page-2")], "run_id STRING, page_number INT, outgoing_cursor STRING")
    state = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id STRING")
    got = {r["run_id"]: (r["next_page"], r["cursor"], r["complete"]) for r in ingest.search_checkpoints(state, pages).collect()}
    assert got == {"r1": (3, None, True), "r2": (2, "page-2", False), "r3": (1, None, False)}


def test_task_view(spark):
    df = spark.createDataFrame([("r1", "discovering", 50.0, None), ("r2", "failed", 10.0, "boom")], "run_id STRING, status STRING, progress DOUBLE, error STRING")
    got = {r["task_id"]: (r["status"], r["remaining_time"], r["failures"]) for r in runs.task_view(df, F.lit(10.0)).collect()}
    assert got == {"r1": ("searching", 10.0, []), "r2": ("failed", 0.0, ["boom"])}
    legacy = spark.createDataFrame([("r1", "old"), ("x", "old")], "task_id STRING, status STRING")
    persisted = spark.createDataFrame([("r1", "new")], "task_id STRING, status STRING")
    assert {(r["task_id"], r["status"]) for r in runs.merge_tasks(persisted, legacy).collect()} == {("r1", "new"), ("x", "old")}


def test_numbers_of_groups_that_cross_partitions(spark):
    """One group over most partitions, some over a border, many inside one, null among the keys."""
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 40}", i) for i in range(900)] + [(None, i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, at bigint").withColumn("_first", F.lit(1)).repartition(5)
    for batch in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {(r["g"], r["at"]): r["n"] for r in ordering.number_rows(df, ["g"], ["at"], "n").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = {}
        for g in {g for g, _ in rows}:
            want.update({(g, at): n for n, at in enumerate(sorted(a for h, a in rows if h == g), 1)})
        assert got == want
    whole = ordering.number_rows(df.filter("g = 'hot'"), [], ["at"], "n").collect()
    assert sorted((r["at"], r["n"]) for r in whole) == [(i, i + 1) for i in range(3000)]
    assert ordering.number_rows(df.limit(0), ["g"], ["at"], "n").columns == ["g", "at", "_first", "n"]


def test_rows_that_are_heavy_are_dealt_to_many_tasks(spark):
    """The customers are one row group, which is one task; texts of their areas are checked by more."""
    from terraspan.plans.queries import QUERIES
    from terraspan.plans.views import Views

    folder = "/root/testdata/sf0.1"
    assert Views(spark, folder).table("customer").rdd.getNumPartitions() == 1
    assert Views(spark, folder).spread("customer", "c_custkey").rdd.getNumPartitions() == 8
    assert QUERIES["p07_long_wkt"](spark, folder).rdd.getNumPartitions() == 8
