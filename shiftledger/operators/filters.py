"""Row filters of the dashboard, the reports and the search boxes.

Date predicates are ranges on the raw column, so they reach the Parquet scan.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.dates import instant
from shiftledger.functions.domain import WEEKDAYS
from shiftledger.functions.text import matches


def _midnight(day: date) -> datetime:
    return datetime.combine(day, time.min)


def between_days(first: date, last: date, column: str = "data_registro") -> Column:
    """The closed day range as a half-open instant range."""
    return (F.col(column) >= instant(_midnight(first))) & (
        F.col(column) < instant(_midnight(last + timedelta(days=1)))
    )


def on_day(day: date, column: str = "data_registro") -> Column:
    return between_days(day, day, column)


def last_days(days: int, as_of: datetime, column: str = "data_registro") -> Column:
    """No upper bound: rows dated in the future are in. The lower bound is an instant."""
    return F.col(column) >= instant(as_of - timedelta(days=days))


def in_month(as_of: datetime, column: str = "data_registro") -> Column:
    first = as_of.date().replace(day=1)
    following = (first + timedelta(days=32)).replace(day=1)
    return between_days(first, following - timedelta(days=1), column)


def period(name: str, as_of: datetime) -> Column | None:
    """Predicate of a named period; None for all rows, dated or not."""
    choices = {
        "Hoje": lambda: on_day(as_of.date()),
        "Últimos 7 dias": lambda: last_days(7, as_of),
        "Últimos 30 dias": lambda: last_days(30, as_of),
        "Este mês": lambda: in_month(as_of),
        "Todos": lambda: None,
    }
    return choices[name]()


def by_attributes(
    df: DataFrame, operator: str | None = None, status: str | None = None, client: str | None = None
) -> DataFrame:
    """Optional equality filters on the canonical operator, the status and the client."""
    wanted = {"operador_exibicao": operator, "status": status, "cliente_nome": client}
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def custom_report(
    records: DataFrame, client_term: str | None = None, status: str | None = None, start: date | None = None
) -> DataFrame:
    if client_term:
        records = records.where(matches("cliente_nome", client_term))
    if status is not None:
        records = records.where(F.col("status") == status)
    if start is not None:
        records = records.where(F.col("data_registro") >= instant(_midnight(start)))
    return records


def _search(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    if not term:
        return df
    return df.where(reduce(lambda a, b: a | b, [matches(c, term) for c in columns]))


def search_records(records: DataFrame, term: str, status: str | None = None) -> DataFrame:
    found = _search(records, ["cliente_nome", "operador_nome"], term)
    return found if status is None else found.where(F.col("status") == status)


def search_schedule(schedule: DataFrame, term: str) -> DataFrame:
    return _search(schedule, ["operador", *WEEKDAYS], term)
