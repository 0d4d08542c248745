"""Ids for new rows: the next free numbers after the highest one in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.operators.ranking import rank_in_group


def highest_id(*tables: DataFrame) -> int:
    """The greatest id of all tables; 0 if there is none."""
    tops = [t.agg(F.max("id")).first()[0] for t in tables]
    return max([t for t in tops if t is not None], default=0)


def number_missing(rows: DataFrame, top: int, order: list[str]) -> DataFrame:
    """The rows, those without an id numbered from ``top`` + 1 in the given order.

    The same rows and the same ``top`` give the same ids, so a repeated batch repeats its ids. Rows that tie on the order should be told
    apart by it or be alike. Columns keep their order.
    """
    missing = rows.where("id IS NULL")
    if missing.isEmpty():
        return rows
    ranked = rank_in_group(missing.drop("id"), [], order, "_n").withColumn("id", F.col("_n") + F.lit(top).cast("bigint"))
    return rows.where("id IS NOT NULL").unionByName(ranked.select(*rows.columns))
