"""Binding of intermediate values inside Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often the body uses it.

    Inside CASE branches Catalyst does not share equal subexpressions; a
    one-element array binds them.
    """
    return F.transform(F.array(value), body)[0]
