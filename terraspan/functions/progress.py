"""Run status, progress and remaining-time rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome(failed: Column, completed: Column, running: Column, total: Column) -> Column:
    """Status folded from attempts: final only once all have ended.

    Until then it is downloading while any attempt runs, else queued. Of ended ones it is
    partial when both kinds occur, failed when only failures do, else completed.
    """
    return (
        F.when(running > 0, "downloading").when(failed + completed < total, "queued")
        .when((failed > 0) & (completed > 0), "partial").when(failed > 0, "failed").otherwise("completed")
    )


def file_progress(done: Column, total: Column, status: Column) -> Column:
    return (
        F.when(total > 0, F.round(done / total * 100, 2))
        .when(status == "completed", F.lit(100.0))
        .otherwise(F.lit(0.0))
    )


def byte_progress(downloaded: Column, total: Column, done: Column, files: Column) -> Column:
    """Share of bytes, held at 99.9 while running; share of files when no size is known."""
    by_bytes = F.when(total > 0, F.least(F.lit(99.9), downloaded / total * 100))
    return F.coalesce(by_bytes, done / F.nullif(files, F.lit(0)) * 100, F.lit(0.0))


def remaining_seconds(elapsed: Column, progress: Column, status: Column) -> Column:
    left = F.round(F.greatest(F.lit(0.0), elapsed / (progress / 100) - elapsed), 2)
    return F.when(status.isin("completed", "partial", "failed"), F.lit(0.0)).when(progress > 1, left)


def speed(downloaded: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, downloaded / elapsed).otherwise(F.lit(0.0))


def status_alias(status: Column) -> Column:
    return F.when(status == "discovering", "searching").otherwise(status)


def retry_class(http_status: Column, error: Column, attempts: Column) -> Column:
    """What a failed try leads to: ask for credentials, try again (three tries in all), or give up."""
    transient = http_status.isin(429, 500, 502, 503, 504) | (http_status.isNull() & error.isNotNull())
    return (
        F.when(http_status.isin(401, 403), "auth_required")
        .when(transient & (attempts < 3), "retry")
        .when(transient | (http_status >= 400), "failed")
        .otherwise("ok")
    )


def backoff_seconds(attempts: Column) -> Column:
    return F.lit(0.1) * F.pow(F.lit(2.0), attempts - 1)
