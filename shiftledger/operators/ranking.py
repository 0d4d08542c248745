"""Exact positions in ordered groups, however large a single group is.

A plain window puts a whole group into one task. Here rows are range-partitioned on the group
and the order together, so a hot group spreads over many slices, and every row gets a serial
number that follows the global order. Positions then come from small per-slice counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiftledger.session import cut_lineage, shuffle_partitions

SERIAL = "_serie"
SLICE = "_faixa"
SLICE_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def serialized(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows in (keys, order) sequence with an increasing ``_serie``, fixed by writing them out.

    The range bounds are sampled, so two evaluations could disagree; the written rows cannot.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    placed = (
        df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn(SERIAL, F.monotonically_increasing_id())
    )
    return cut_lineage(placed)


def rank_in_group(
    df: DataFrame, keys: list[str], order: list[str], name: str, partitions: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row in its group. Keys and order must not be null and order must be total."""
    placed = serialized(df, keys, order, partitions).withColumn(SLICE, F.shiftright(SERIAL, SLICE_BITS))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        placed.groupBy(*keys, SLICE).agg(F.count("*").alias("_n"), F.min(SERIAL).alias("_inicio"))
        .select(*keys, SLICE, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_inicio")).alias("_ajuste"))
    )
    if not keys:
        shift = F.broadcast(shift)  # one row per slice
    return (
        placed.join(shift, [*keys, SLICE])
        .withColumn(name, F.col(SERIAL) + F.col("_ajuste"))
        .drop(SERIAL, "_ajuste", SLICE)
    )
