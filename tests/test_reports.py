from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from rows import FULL, MONDAY, NOT_DONE, PARTIAL, records, schedule, values
from shiftledger.operators import filters, identity, kpi, reports

AS_OF = datetime(2024, 1, 31, 12)


def at(**delta):
    return AS_OF - timedelta(**delta)


def test_periods(spark):
    df = records(spark, [
        (1, at(days=7), "a", "c", FULL), (2, at(days=7, microseconds=1), "a", "c", FULL), (3, at(days=-90), "a", "c", FULL),
        (4, None, "a", "c", FULL), (5, datetime(2024, 1, 31, 23, 59, 59, 999999), "a", "c", FULL),
        (6, datetime(2024, 2, 1), "a", "c", FULL), (7, datetime(2024, 1, 1), "a", "c", FULL), (8, datetime(2023, 1, 31), "a", "c", FULL),
    ])

    def ids(name):
        where = filters.period(name, AS_OF)
        return sorted(r.id for r in (df if where is None else df.where(where)).collect())

    assert ids("Hoje") == [5]
    assert ids("Últimos 7 dias") == [1, 3, 5, 6]
    assert ids("Últimos 30 dias") == [1, 2, 3, 5, 6]
    assert ids("Este mês") == [1, 2, 5, 7]
    assert ids("Todos") == [1, 2, 3, 4, 5, 6, 7, 8]
    december = filters.in_month(datetime(2023, 12, 31))
    assert df.where(december).count() == 0


def test_custom_filter_and_search(spark):
    df = records(spark, [
        (1, MONDAY, "Ana", "Client 1", FULL), (2, MONDAY, "Bia", "Client 10", FULL), (3, None, "Bia", "Client 1", PARTIAL),
        (4, MONDAY, None, None, FULL),
    ])
    assert values(filters.custom_report(df, "^client 1$", None, date(2024, 1, 15)), "id") == [(1,)]
    assert values(filters.custom_report(df, "(1|9)$"), "id") == [(1,), (3,)]
    assert values(filters.search_records(df, "bia", FULL), "id") == [(2,)]
    assert filters.search_records(df, "").count() == 4
    plan = schedule(spark, [(1, "ANA", "TARDE", "X (1)"), (2, "BIA", "TARDE", "-", "-", "-", "-", "x (1)")])
    assert values(filters.search_schedule(plan, r"x \(1\)"), "id") == [(1,), (2,)]


def test_labels(spark):
    df = records(spark, [
        (1, MONDAY, "Óp07", "c", FULL), (2, MONDAY, "op07 Sb", "c", FULL), (3, MONDAY, "ÓP07 Sa ", "c", FULL),
        (4, MONDAY, None, "c", FULL), (5, MONDAY, "  ", "c", FULL), (6, MONDAY, "Zé", "c", FULL),
    ])
    got = dict(values(identity.canonical_operator(df), "id", "operador_exibicao"))
    tie = min("op07 Sb", "ÓP07 Sa")
    assert got == {1: tie, 2: tie, 3: tie, 4: "Sem nome", 5: "Sem nome", 6: "Zé"}
    stored = identity.operator_spellings(df.where("id < 6"))
    late = dict(values(identity.canonical_operator(df, stored), "id", "operador_exibicao"))
    assert late == got and late[6] == "Zé"


def test_blank_name_joins_an_operator_called_sem_nome(spark):
    df = records(spark, [(1, MONDAY, "Sem nome", "c", FULL), (2, MONDAY, None, "c", NOT_DONE)])
    assert values(kpi.operator_efficiency(df)) == [("Sem nome", 2, 1, 50.0)]


def test_denominators(spark):
    df = records(spark, [(1, MONDAY, "a", "c", FULL), (2, MONDAY, "a", "c", None), (3, MONDAY, "b", None, None), (4, MONDAY, "a", "c", "Não Se Aplica")])
    row = kpi.kpi_dashboard(df).first()
    assert (row.total, row.realizados, row.eficiencia) == (4, 1, 25.0)
    assert values(kpi.operator_efficiency(df)) == [("b", 0, 0, None), ("a", 2, 1, 50.0)]
    assert values(kpi.top_clients(df)) == [("c", 2, 1, 50.0)]
    assert values(kpi.status_distribution(df)) == [("Não Se Aplica", 1, 50.0), (FULL, 1, 50.0)]
    empty = kpi.kpi_dashboard(df.where("id > 9")).first()
    assert (empty.total, empty.eficiencia) == (0, 0.0)
    assert kpi.insights(df.where("id > 9")).count() == 0


def test_label_uses_all_rows_and_counts_only_the_period(spark):
    df = records(spark, [(1, MONDAY, "Ana", "c", FULL), (2, at(days=60), "Ana Maria", "c", NOT_DONE), (3, at(days=60), "Bia", "c", FULL)])
    recent = filters.last_days(30, AS_OF)
    assert values(kpi.operator_efficiency(df, recent)) == [("Ana Maria", 1, 1, 100.0)]
    assert values(kpi.operator_status_matrix(df, recent)) == [("Ana Maria", FULL, 1)]
    labelled = identity.canonical_operator(df).where(recent)
    assert values(labelled.groupBy("operador_exibicao").count()) == [("Ana Maria", 1)]


def test_insights(spark):
    def rows(name, full, other, start):
        return [(start + i, MONDAY, name, "c", FULL if i < full else NOT_DONE) for i in range(full + other)]

    df = records(spark, rows("boa", 4, 1, 0) + rows("bela", 4, 1, 10) + rows("rui", 2, 3, 20) + rows("par", 2, 0, 30))
    assert values(kpi.insights(df)) == [(1, "melhor", "bela", 80.0, 5), (2, "pior", "rui", 40.0, 5)]
    few = records(spark, rows("rui", 1, 3, 0))
    assert values(kpi.insights(few)) == [(3, "problemas", None, 75.0, 4)]
    assert values(kpi.insights(df, F.col("operador_nome") == "par")) == []


def test_trend_latest_and_report(spark):
    df = records(spark, [(1, MONDAY, "a", "c", FULL, "x"), (2, None, "a", "c", PARTIAL, "y"), (3, MONDAY, "a", "c", None)])
    assert values(kpi.daily_efficiency(df)) == [(date(2024, 1, 15), 2, 1, 1, 100.0)]
    assert values(kpi.latest_records(df, 2), "id") == [(1,), (3,)]
    assert values(kpi.latest_caption(df, 2)) == [(2, 3)]
    shown = reports.report_projection(df.where("id < 3"))
    assert shown.columns == ["Data", "Operador", "Cliente", "Status", "Justificativa", "ID"]
    assert values(shown, "Data", "Justificativa") == [("15/01/2024 09:30", ""), (None, "y")]
    assert "id" not in reports.without_control_columns(df).columns


def test_sums_agree(spark):
    """Distribution, matrix and ranking count the same rows."""
    from shiftledger.plans.catalog import Inputs

    df = Inputs(spark, "/root/testdata/sf0.001").records
    known = df.where("status IS NOT NULL").count()
    assert kpi.status_distribution(df).agg(F.sum("qtd")).first()[0] == known
    per_status = {r.operador: r.n for r in kpi.operator_status_matrix(df).groupBy("operador").agg(F.sum("qtd").alias("n")).collect()}
    assert per_status == {r.operador: r.total for r in kpi.operator_efficiency(df).where("total > 0").collect()}
