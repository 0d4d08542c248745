"""The weekly plan: payload normalization, reshaping and its lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.domain import (
    EMPTY_CELL, MORNING, NO_PLAN_NAME, SUPPORT_PREFIX, WEEKDAY_LABELS, WEEKDAYS,
)
from shiftledger.functions.measures import pct
from shiftledger.functions.text import none_if_blank, strip
from shiftledger.operators.identity import contains_name

# Payload fields of each plan column, in the order they are tried.
PAYLOAD_FIELDS = {
    "operador": ["operador", "Operador"],
    "periodo": ["periodo", "Periodo"],
    "segunda": ["segunda", "Segunda"],
    "terca": ["terca", "Terca", "Terça"],
    "quarta": ["quarta", "Quarta"],
    "quinta": ["quinta", "Quinta"],
    "sexta": ["sexta", "Sexta"],
}


def schedule_listing(schedule: DataFrame) -> DataFrame:
    """The plan under its display labels, ordered by id."""
    days = [F.col(c).alias(label) for c, label in zip(WEEKDAYS, WEEKDAY_LABELS)]
    return schedule.select("id", F.col("operador").alias("Operador"), F.col("periodo").alias("Periodo"), *days).orderBy("id")


def normalize_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Plan rows from JSON payload text: first non-blank alias, upper-case names, '-' for empty days."""
    fields = F.from_json(payload, "map<string,string>")

    def pick(column: str) -> Column:
        return reduce(
            lambda a, b: F.coalesce(a, b),
            [none_if_blank(F.try_element_at(F.col("_campos"), F.lit(k))) for k in PAYLOAD_FIELDS[column]],
        )

    return df.withColumn("_campos", fields).select(
        *[c for c in df.columns if c != payload],
        F.coalesce(F.upper(pick("operador")), F.lit(NO_PLAN_NAME)).alias("operador"),
        F.upper(F.coalesce(pick("periodo"), F.lit(MORNING))).alias("periodo"),
        *[F.coalesce(pick(d), F.lit(EMPTY_CELL)).alias(d) for d in WEEKDAYS],
    )


def plan_cells(schedule: DataFrame, weekdays: list[int] | None = None) -> DataFrame:
    """One row per plan line and weekday (Monday 0; all by default); ``cliente`` is null where nothing is planned."""
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("dia_idx"), F.lit(d).alias("dia"),
            F.nullif(none_if_blank(d), F.lit(EMPTY_CELL)).alias("cliente"),
        )
        for i, d in enumerate(WEEKDAYS) if weekdays is None or i in weekdays
    ])
    if weekdays is not None and not any(i < len(WEEKDAYS) for i in weekdays):
        return plan_cells(schedule).where(F.lit(False))  # a weekend has no plan
    return schedule.select("id", strip("operador").alias("operador"), "periodo", F.inline(cells))


def plan_long(schedule: DataFrame, weekdays: list[int] | None = None) -> DataFrame:
    return plan_cells(schedule, weekdays).where("cliente IS NOT NULL")


def plan_clients(schedule: DataFrame, operator: str | None = None, day: str | None = None) -> DataFrame:
    """Sorted distinct planned clients: of the whole plan, of a weekday, of an operator's weekday."""
    cells = plan_long(schedule, None if day is None else [WEEKDAYS.index(day)])
    if operator:
        cells = cells.where(contains_name("operador", operator))
    return cells.select("cliente").distinct().orderBy("cliente")


def plan_clients_by_day(schedule: DataFrame) -> DataFrame:
    """The same lists for every operator and weekday at once."""
    return plan_long(schedule).select("operador", "dia_idx", "dia", "cliente").distinct()


def support_options(schedule: DataFrame) -> DataFrame:
    return plan_clients(schedule).select(F.concat(F.lit(SUPPORT_PREFIX), "cliente").alias("opcao"))


def plan_coverage(schedule: DataFrame) -> DataFrame:
    """Distinct operators, clients and covered days, and the share of filled cells."""
    filled = [F.nullif(none_if_blank(d), F.lit(EMPTY_CELL)) for d in WEEKDAYS]
    clients = schedule.select(F.explode(F.array_compact(F.array(*filled))).alias("cliente")).distinct().agg(F.count("*").alias("clientes"))
    operators = schedule.select(strip("operador").alias("operador")).distinct().agg(F.count("operador").alias("operadores"))
    # Days are five flags and cells plain sums, so lines combine before the shuffle without being multiplied.
    lines = schedule.agg(
        reduce(lambda a, b: a + b, [F.coalesce(F.max(c.isNotNull().cast("bigint")), F.lit(0)) for c in filled]).alias("dias_cobertos"),
        reduce(lambda a, b: a + b, [F.count(c) for c in filled]).alias("celulas_preenchidas"),
        (F.count("*") * len(WEEKDAYS)).alias("celulas"),
    )
    return lines.select(
        operators.scalar().alias("operadores"), clients.scalar().alias("clientes"), "*",
        F.coalesce(pct("celulas_preenchidas", "celulas"), F.lit(0.0)).alias("capacidade"),
    )


def day_agenda(schedule: DataFrame, day: str) -> DataFrame:
    """Planned (period, client) rows of a weekday, plus one flagged row per operator with none."""
    cells = plan_cells(schedule, [WEEKDAYS.index(day)])
    planned = cells.where("cliente IS NOT NULL")
    idle = cells.groupBy("operador").agg(F.count("cliente").alias("_n")).where("_n = 0")
    return planned.select("operador", "periodo", "cliente", F.lit(True).alias("tem_alocacao")).unionByName(
        idle.select(
            "operador", F.lit(None).cast("string").alias("periodo"),
            F.lit(None).cast("string").alias("cliente"), F.lit(False).alias("tem_alocacao"),
        )
    )


def agenda_by_operator(schedule: DataFrame, day: str) -> DataFrame:
    """A line per operator with the sorted array of (period, client) planned for a weekday; empty, and flagged, where nothing is."""
    cells = plan_cells(schedule, [WEEKDAYS.index(day)])
    entry = F.when(F.col("cliente").isNotNull(), F.struct("periodo", "cliente"))
    return cells.groupBy("operador").agg(F.array_sort(F.collect_list(entry)).alias("agenda")).withColumn("tem_alocacao", F.size("agenda") > 0)


def weekday_of_records(records: DataFrame) -> DataFrame:
    """Records with the weekday index (Monday 0) and its plan column; the weekend has none."""
    idx = F.weekday("data_registro")
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return records.select(
        "id", "data_registro", idx.alias("dia_idx"),
        F.when(idx < len(WEEKDAYS), F.try_element_at(names, idx + 1)).alias("coluna_escala"),
    )
