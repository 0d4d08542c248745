"""Plan against actuals: planned pairs nobody reported, and the rows that fill them.

Pairs meet on trimmed upper-case text of operator and client, per day.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.domain import DEFAULT_APPROVAL, GAP_NOTE, NOT_REPORTED
from shiftledger.functions.text import match_key
from shiftledger.operators.filters import between_days
from shiftledger.operators.numbering import highest_id, number_missing
from shiftledger.operators.plan import plan_long
from shiftledger.sources.schemas import RECORDS, conform

PAIR = ["dia", "op_chave", "cli_chave"]


def expected_pairs(schedule: DataFrame, first: date, last: date) -> DataFrame:
    """Distinct planned pairs per day in [first, last], with the number of plan cells behind each.

    Repeats are settled per weekday (the spelling is that of the first plan line); only then does
    each pair list its own dates in the range, so neither a calendar join nor a second shuffle is
    needed. Only plan columns of weekdays in the range are read.
    """
    weekdays = sorted({(first + timedelta(days=i)).weekday() for i in range(min(7, (last - first).days + 1))})
    cells = plan_long(schedule, weekdays).where("operador <> ''").select(
        "dia_idx", "id", "operador", "cliente",
        match_key("operador").alias("op_chave"), match_key("cliente").alias("cli_chave"),
    )
    pairs = cells.groupBy("dia_idx", "op_chave", "cli_chave").agg(
        F.count("*").alias("celulas"), F.min(F.struct("id", "operador", "cliente")).alias("_primeira")
    )
    start = F.date_add(F.lit(first), F.pmod(F.col("dia_idx") - F.lit(first.weekday()), F.lit(7)))
    dates = F.when(start <= F.lit(last), F.sequence(start, F.lit(last), F.expr("INTERVAL '7' DAY")))
    return pairs.select(
        F.explode(dates).alias("dia"), "op_chave", "cli_chave", "celulas",
        F.col("_primeira.id").alias("linha_id"), "_primeira.operador", "_primeira.cliente",
    )


def plan_days(schedule: DataFrame, first: date, last: date) -> DataFrame:
    """The expected pairs with a line for the day itself (no pair) besides, so that a stream of them moves on over days without a plan."""
    pairs = expected_pairs(schedule, first, last)
    days = schedule.sparkSession.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("dia"))
    return pairs.unionByName(days, allowMissingColumns=True)


def reported_pairs(records: DataFrame, first: date, last: date) -> DataFrame:
    """Distinct reported pairs per day; repeated reports collapse before the shuffle."""
    return records.where(between_days(first, last)).select(
        F.to_date("data_registro").alias("dia"),
        match_key("operador_nome").alias("op_chave"), match_key("cliente_nome").alias("cli_chave"),
    ).distinct()


def detect_gaps(schedule: DataFrame, records: DataFrame, first: date, last: date | None = None) -> DataFrame:
    """Planned pairs without a report, for one day or a range. Weekends have no plan."""
    last = first if last is None else last
    missing = expected_pairs(schedule, first, last).join(reported_pairs(records, first, last), PAIR, "left_anti")
    return missing.select("dia", "linha_id", "operador", "cliente")


def gap_summary(schedule: DataFrame, records: DataFrame, first: date, last: date) -> DataFrame:
    """Per day: planned cells, pairs to create, and cells already covered (repeats included)."""
    seen = reported_pairs(records, first, last).withColumn("_visto", F.lit(True))
    by_day = (
        expected_pairs(schedule, first, last).join(seen, PAIR, "left").groupBy("dia")
        .agg(F.sum("celulas").alias("esperados"), F.count_if(F.col("_visto").isNull()).alias("criados"))
    )
    calendar = records.sparkSession.range((last - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("dia")
    )
    zero = F.lit(0).cast("bigint")
    return calendar.join(by_day, "dia", "left").select(
        "dia", F.coalesce("esperados", zero).alias("esperados"), F.coalesce("criados", zero).alias("criados"),
        F.coalesce(F.col("esperados") - F.col("criados"), zero).alias("ja_existiam"),
    )


def gap_details(schedule: DataFrame, records: DataFrame, day: date, n: int = 50) -> DataFrame:
    """The first-n report of a day's gaps in plan order."""
    return detect_gaps(schedule, records, day).orderBy("linha_id", "cliente").limit(n).select("linha_id", "operador", "cliente")


def gap_fill_rows(schedule: DataFrame, records: DataFrame, first: date, last: date | None = None) -> DataFrame:
    """Record rows for the gaps, dated 23:59:00 of their day, without ids."""
    gaps = detect_gaps(schedule, records, first, last)
    return conform(gaps.select(
        (F.col("dia").cast("timestamp_ntz") + F.expr("INTERVAL '0 23:59:00' DAY TO SECOND")).alias("data_registro"),
        F.col("operador").alias("operador_nome"), F.col("cliente").alias("cliente_nome"),
        F.lit(NOT_REPORTED).alias("status"), F.lit(GAP_NOTE).alias("justificativa"),
        F.lit(DEFAULT_APPROVAL).alias("aprovado_gestor"),
    ), RECORDS)


def number_rows(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Ids for new rows, following the highest one in use."""
    order = ["data_registro", "operador_nome", "cliente_nome"]
    return conform(number_missing(rows, highest_id(records), order), RECORDS)


def fill_gaps(schedule: DataFrame, records: DataFrame, first: date, last: date | None = None) -> DataFrame:
    """Records with the gap rows appended under new ids. Running it again adds nothing."""
    return records.unionByName(number_rows(gap_fill_rows(schedule, records, first, last), records))
