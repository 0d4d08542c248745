"""Counts and percentages shared by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftledger.functions.domain import FULL, NOT_DONE, PARTIAL

STATUS_MEASURES = {"realizados": FULL, "parciais": PARTIAL, "nao_realizados": NOT_DONE}


def pct(part: Column | str, whole: Column | str) -> Column:
    """Percentage with one decimal, half-even; null over zero. Keep this order of operations."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.bround(F.try_divide(part, whole) * 100, 1)


def count_status(status: str, where: Column | None = None) -> Column:
    hit = F.col("status") == status
    return F.count_if(hit if where is None else hit & where)


def count_known(where: Column | None = None) -> Column:
    """Rows with a status: the denominator of grouped rates."""
    known = F.col("status").isNotNull()
    return F.count_if(known if where is None else known & where)
