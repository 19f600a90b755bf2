"""Acquisition runs: attempt state, folds over it, control, listing and recovery.

Attempt state is an append-only log. Counters are folds over the newest state of
each attempt, so they cannot drift from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import progress as pg
from ..profiles import ACTIVE_STATUSES, transitions
from . import ordering

DONE = ("completed", "skipped")


def latest_attempts(events: DataFrame, order: Sequence[str] = ("updated_at", "seq")) -> DataFrame:
    """Newest state of each attempt."""
    return ordering.first_per_key(events, ["attempt_id"], [F.col(c).desc() for c in order])


def _counted() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("status").isin(*DONE)).alias("completed_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
    ]


def _counts(latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    return latest.groupBy(*keys).agg(*_counted())


def _folded_status(latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    running = latest.groupBy(*keys).agg(F.count_if(F.col("status") == "downloading").alias("_running"), *_counted())
    status = pg.outcome(F.col("failed_files"), F.col("completed_files"), F.col("_running"), F.col("total_files"))
    return running.withColumn("status", status).drop("_running")


def batch_status(latest: DataFrame) -> DataFrame:
    return _folded_status(latest, ["run_id", "batch_number"])


def run_status(latest: DataFrame) -> DataFrame:
    return _folded_status(latest, ["run_id"])


def run_progress(latest: DataFrame, runs: DataFrame) -> DataFrame:
    """Share of finished files per run; a run without files stands at 100 once completed, else at 0."""
    counts = _counts(latest, ["run_id"])
    zero = F.lit(0).cast("bigint")
    joined = runs.select("run_id", "status").join(counts, "run_id", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("total_files", "completed_files", "failed_files")}
    )
    done = F.col("completed_files") + F.col("failed_files")
    return joined.withColumn("progress", pg.file_progress(done, F.col("total_files"), F.col("status")))


def transfer_totals(latest: DataFrame, elapsed: Column) -> DataFrame:
    """Files, bytes and speed per run; ``elapsed`` is an aggregate expression in seconds."""
    totals = latest.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("status").isin(*DONE)).alias("completed_files"),
        F.sum(F.coalesce("downloaded_bytes", F.lit(0))).alias("downloaded_bytes"), elapsed.alias("elapsed"),
    )
    return totals.withColumn("speed", pg.speed(F.col("downloaded_bytes"), F.col("elapsed")))


def classify_retries(attempts: DataFrame) -> DataFrame:
    decision = pg.retry_class(F.col("http_status"), F.col("error"), F.col("attempts"))
    return attempts.withColumn("decision", decision).withColumn(
        "backoff", F.when(F.col("decision") == "retry", pg.backoff_seconds(F.col("attempts")))
    )


def submit_idempotent(submissions: DataFrame, order: Sequence[str] = ("created_at", "run_id")) -> DataFrame:
    """Outcome of each submission: the first of a key creates a run, equal requests reuse it, others conflict."""
    firsts = submissions.groupBy("idempotency_key").agg(
        F.min_by(F.struct(F.col("run_id").alias("first_run_id"), F.col("request").alias("first_request")), F.struct(*order)).alias("_f")
    ).select("idempotency_key", "_f.*")
    rows = submissions.join(firsts, "idempotency_key")
    mine = F.col("run_id") == F.col("first_run_id")
    return rows.withColumn(
        "outcome", F.when(mine, "created").when(F.col("request") == F.col("first_request"), "reused").otherwise("conflict")
    ).withColumn("resolved_run_id", F.when(F.col("outcome") != "conflict", F.col("first_run_id"))).drop("first_request")


def allowed_actions(runs: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Legal actions of each run with the status they lead to.

    With ``actions`` (run_id, action) one row per asked action: ``next_status`` is null where it is illegal.
    """
    table = F.broadcast(transitions(runs.sparkSession))
    if actions is None:
        return runs.join(table, "status")
    return actions.join(runs.select("run_id", "status"), "run_id").join(table, ["status", "action"], "left")


PAGE_LIMIT = 200


def _page_size(limit: int) -> int:
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"a page of runs holds 1 to {PAGE_LIMIT} of them, not {limit}")
    return limit


def list_runs(runs: DataFrame, cursor: str | None = None, limit: int = 50) -> DataFrame:
    """One row more than the page, newest first; the last row tells whether there is a next page.

    A page holds at most PAGE_LIMIT runs; other limits raise.
    """
    limit = _page_size(limit)
    if cursor:
        created, run = cursor.split("|", 1)
        older = F.col("created_at") < created
        runs = runs.filter(older | ((F.col("created_at") == created) & (F.col("run_id") < run)))
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit + 1)


def page_of_runs(runs: DataFrame, cursor: str | None = None, limit: int = 50) -> tuple[list, str | None]:
    """A page of at most PAGE_LIMIT runs and the cursor of the next one."""
    limit = _page_size(limit)
    rows = list_runs(runs, cursor, limit).collect()
    more, rows = len(rows) > limit, rows[:limit]
    return rows, f"{rows[-1]['created_at']}|{rows[-1]['run_id']}" if more else None


def recent_runs(runs: DataFrame, n: int = 6, status: str | None = None) -> DataFrame:
    if status:
        runs = runs.filter(F.col("status") == status)
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def requeue_failed(latest: DataFrame, now: str) -> DataFrame:
    """Events that put failed attempts back in the queue, to be appended to the log."""
    return latest.filter("status = 'failed'").withColumns(
        {"status": F.lit("queued"), "error": F.lit(None).cast("string"), "updated_at": F.lit(now), "seq": F.col("seq") + 1}
    )


def requeue_batches(batches: DataFrame, asked: DataFrame) -> DataFrame:
    """Batches after their runs (``asked``: run_id) were told to retry: those with failures queue again without them."""
    mark = asked.select("run_id", F.lit(True).alias("_asked")).distinct()
    again = F.coalesce("_asked", F.lit(False)) & F.col("status").isin("failed", "partial")
    return batches.join(mark, "run_id", "left").withColumns({
        "failed_files": F.when(again, F.lit(0).cast("bigint")).otherwise(F.col("failed_files")),
        "status": F.when(again, "queued").otherwise(F.col("status")),
    }).drop("_asked")


def requeue_runs(runs: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """Runs (status, failed_files, error, message, finished_at, updated_at) after those of ``asked`` were told to retry."""
    mark = asked.select("run_id", F.lit(True).alias("_asked")).distinct()
    again = F.coalesce("_asked", F.lit(False))
    after = {
        "failed_files": F.lit(0).cast("bigint"), "error": F.lit(None).cast("string"), "message": F.lit("Failed transfers queued for retry."),
        "finished_at": F.lit(None).cast("string"), "updated_at": F.lit(now), "status": F.lit("queued"),
    }
    return runs.join(mark, "run_id", "left").withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in after.items()}).drop("_asked")


def requeue_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("run_id").agg(F.count_if(F.col("status") == "failed").alias("requeued"))


def recover_runs(runs: DataFrame) -> DataFrame:
    """Runs after a restart: active ones queue again, paused and finished ones stay."""
    active = F.col("status").isin(*ACTIVE_STATUSES)
    return runs.withColumns(
        {
            "message": F.when(active, "Recovered after process restart.").otherwise(F.col("message")),
            "status": F.when(active, "queued").otherwise(F.col("status")),
        }
    )


def recover_attempts(latest: DataFrame, runs: DataFrame) -> DataFrame:
    """Attempts after a restart: those in transfer queue again if their run was active."""
    active = runs.filter(F.col("status").isin(*ACTIVE_STATUSES)).select("run_id", F.lit(True).alias("_active"))
    again = (F.col("status") == "downloading") & F.coalesce("_active", F.lit(False))
    return latest.join(active, "run_id", "left").withColumn(
        "status", F.when(again, "queued").otherwise(F.col("status"))
    ).drop("_active")


def attempts_with_items(attempts: DataFrame, items: DataFrame) -> DataFrame:
    return attempts.join(items.select("run_id", "collection", "source_item_id", "item"), ["run_id", "collection", "source_item_id"])


def merge_tasks(persisted: DataFrame, legacy: DataFrame) -> DataFrame:
    """All persisted tasks plus the legacy ones that are not among them."""
    return persisted.unionByName(legacy.join(persisted.select("task_id"), "task_id", "left_anti"), allowMissingColumns=True)


def task_view(runs: DataFrame, elapsed: Column) -> DataFrame:
    """Runs as tasks: shown status, remaining seconds and the error as a list of failures."""
    return runs.select(
        F.col("run_id").alias("task_id"), pg.status_alias(F.col("status")).alias("status"), "progress",
        pg.remaining_seconds(elapsed, F.col("progress"), F.col("status")).alias("remaining_time"),
        F.when(F.col("error") != "", F.array("error")).otherwise(F.array().cast("array<string>")).alias("failures"),
    )
