"""KPI rows, distributions, rankings and trends.

KPI rates divide by all rows; grouped rates divide by the rows that have a status. Null group
keys are dropped. Ties are settled by the key, ascending.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiftledger.functions.domain import FULL, STATUSES
from shiftledger.functions.measures import STATUS_MEASURES, count_known, count_status, pct
from shiftledger.functions.text import operator_key
from shiftledger.operators.identity import label_of, longest, operator_labels, operator_spellings

TOP_CLIENTS = 12
MIN_RANKED, MIN_WORST = 3, 5
BEST_FROM, WORST_BELOW, PROBLEMS_ABOVE = 80, 50, 35


def kpi_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("total"), *[count_status(s).alias(n) for n, s in STATUS_MEASURES.items()]
    )


def kpi_dashboard(records: DataFrame) -> DataFrame:
    """The KPI row: counts, shares of all rows, efficiency."""
    shares = {"pct_realizados": "realizados", "pct_parciais": "parciais", "pct_nao_realizados": "nao_realizados", "eficiencia": "realizados"}
    return kpi_counts(records).select("*", *[
        F.coalesce(pct(count, "total"), F.lit(0.0)).alias(name) for name, count in shares.items()
    ])


def kpi_month(records: DataFrame) -> DataFrame:
    return kpi_counts(records).select(
        "total", "realizados", "parciais", F.coalesce(pct("realizados", "total"), F.lit(0.0)).alias("eficiencia")
    )


def status_distribution(records: DataFrame) -> DataFrame:
    """Rows per status and their share; the total is summed from the counts."""
    counts = records.where(F.col("status").isNotNull()).groupBy("status").agg(F.count("*").alias("qtd"))
    total = counts.agg(F.sum("qtd").alias("total")).scalar()
    return counts.withColumn("participacao", pct(F.col("qtd"), total)).orderBy(F.desc("qtd"), "status")


def _by_operator(records: DataFrame, where: Column | None) -> DataFrame:
    """Counts per operator label in one pass over the records, without a join.

    The label comes from all rows, the counts from those that pass ``where``. Rows are counted
    per raw name first, with plain counters that combine before the shuffle; keys and labels are
    then worked out on the distinct names. Grouping by key and at last by label gives the same
    groups as labelling every row.
    """
    kept = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    problem = F.col("status").isin(STATUS_MEASURES["parciais"], STATUS_MEASURES["nao_realizados"])
    counts = ["linhas", "total", "realizados", "problemas"]
    sums = [F.sum(c).alias(c) for c in counts]
    by_name = records.groupBy("operador_nome").agg(
        F.count_if(kept).alias("linhas"), count_known(kept).alias("total"),
        count_status(FULL, kept).alias("realizados"), F.count_if(problem & kept).alias("problemas"),
    )
    by_key = by_name.groupBy(operator_key("operador_nome").alias("op_key")).agg(longest("operador_nome").alias("_best"), *sums)
    return by_key.groupBy(label_of("_best").alias("operador")).agg(*sums).where("linhas > 0")


def operator_efficiency(records: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows with a status, full executions and efficiency per canonical operator."""
    return (
        _by_operator(records, where)
        .select("operador", "total", "realizados", pct("realizados", "total").alias("eficiencia"))
        .orderBy("eficiencia", "operador")
    )


def insights(records: DataFrame, where: Column | None = None) -> DataFrame:
    """Best operator, worst operator and problem rate, each only past its threshold."""
    rated = _by_operator(records, where).withColumn("eficiencia", pct("realizados", "total"))
    ranked = F.col("total") >= MIN_RANKED
    facts = rated.agg(
        F.min(F.when(ranked, F.struct((-F.col("eficiencia")).alias("o"), "operador", "eficiencia", "total"))).alias("best"),
        F.min(F.when(ranked, F.struct(F.col("eficiencia").alias("o"), "operador", "eficiencia", "total"))).alias("worst"),
        F.sum("linhas").alias("linhas"), F.sum("problemas").alias("problemas"),
    ).withColumn("taxa", pct("problemas", "linhas"))

    def fact(order: int, kind: str, operator: Column, rate: Column, total: Column) -> Column:
        return F.struct(
            F.lit(order).alias("ordem"), F.lit(kind).alias("tipo"), operator.alias("operador"),
            rate.alias("taxa"), total.alias("total"),
        )

    best, worst, rate = F.col("best"), F.col("worst"), F.col("taxa")
    found = F.array(
        F.when(best["eficiencia"] >= BEST_FROM, fact(1, "melhor", best["operador"], best["eficiencia"], best["total"])),
        F.when(
            (worst["eficiencia"] < WORST_BELOW) & (worst["total"] >= MIN_WORST),
            fact(2, "pior", worst["operador"], worst["eficiencia"], worst["total"]),
        ),
        F.when(rate > PROBLEMS_ABOVE, fact(3, "problemas", F.lit(None).cast("string"), rate, F.col("linhas"))),
    )
    return facts.select(F.inline(F.array_compact(found)))


@dataclass(frozen=True)
class Dashboard:
    """KPI row, ranking and trend over one choice of rows."""

    kpi: DataFrame
    ranking: DataFrame
    trend: DataFrame


def dashboard(
    records: DataFrame, period: Column | None = None, operator: str | None = None, status: str | None = None, client: str | None = None
) -> Dashboard:
    """The dashboard for a period and attribute filters together.

    Period, status and client are predicates on raw columns, so they reach the scan. An operator is chosen by label, and labels come
    from all rows: the raw names behind one label are few and pick its rows by a lookup.
    """
    chosen = [p for p in (
        period, None if status is None else F.col("status") == status, None if client is None else F.col("cliente_nome") == client,
    ) if p is not None]
    where = reduce(lambda a, b: a & b, chosen) if chosen else None
    rows = records if where is None else records.where(where)
    ranking = operator_efficiency(records, where)
    if operator is not None:
        names = operator_spellings(records).where(F.col("operador_exibicao") == operator).select(F.col("operador_nome").alias("_nome"))
        rows = rows.join(names, F.col("operador_nome").eqNullSafe(F.col("_nome")), "left_semi")
        ranking = ranking.where(F.col("operador") == operator)
    return Dashboard(kpi_dashboard(rows), ranking, daily_efficiency(rows))


def operator_status_matrix(records: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows per canonical operator and status. The window sees one row per status of an operator."""
    kept = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    by_name = records.groupBy("operador_nome", "status").agg(F.count_if(kept).alias("qtd"))
    counts = by_name.groupBy(operator_key("operador_nome").alias("op_key"), "status").agg(
        longest("operador_nome").alias("_best"), F.sum("qtd").alias("qtd")
    )
    label = label_of(longest("_best").over(Window.partitionBy("op_key")))
    return (
        counts.select(label.alias("operador"), "status", "qtd")
        .where("status IS NOT NULL AND qtd > 0")
        .groupBy("operador", "status").agg(F.sum("qtd").alias("qtd"))
    )


def operator_status_wide(records: DataFrame, where: Column | None = None) -> DataFrame:
    """The same matrix with a column per status of the domain, and a line of totals (``nivel`` 1, operator null) by rollup."""
    wide = operator_status_matrix(records, where).groupBy("operador").pivot("status", STATUSES).agg(F.sum("qtd"))
    sums = [F.coalesce(F.sum(F.col(f"`{s}`")), F.lit(0).cast("long")).alias(s) for s in STATUSES]
    totals = wide.rollup("operador").agg(F.grouping("operador").cast("int").alias("nivel"), *sums)
    return totals.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"`{s}`") for s in STATUSES]))


def daily_volume(records: DataFrame) -> DataFrame:
    return (
        records.where(F.col("data_registro").isNotNull())
        .groupBy(F.to_date("data_registro").alias("dia")).agg(F.count("*").alias("quantidade"))
        .orderBy("dia")
    )


def daily_counts(records: DataFrame) -> DataFrame:
    return (
        records.where(F.col("data_registro").isNotNull())
        .groupBy(F.to_date("data_registro").alias("dia"))
        .agg(F.count("*").alias("quantidade"), count_known().alias("total"), count_status(FULL).alias("realizados"))
    )


def daily_efficiency(records: DataFrame) -> DataFrame:
    """Both trend series, volume and efficiency, from one aggregate."""
    return daily_counts(records).withColumn("eficiencia", pct("realizados", "total")).orderBy("dia")


def top_clients(records: DataFrame, n: int = TOP_CLIENTS) -> DataFrame:
    """The top-n report: clients by volume, with efficiency."""
    return (
        records.where(F.col("cliente_nome").isNotNull())
        .groupBy("cliente_nome").agg(count_known().alias("total"), count_status(FULL).alias("realizados"))
        .withColumn("eficiencia", pct("realizados", "total"))
        .orderBy(F.desc("total"), "cliente_nome").limit(n)
    )


def filter_options(records: DataFrame, schedule: DataFrame, where: Column | None = None) -> DataFrame:
    """Sorted distinct values per filter: canonical operator, status, client, plan operator."""
    kept = records if where is None else records.where(where)
    # Each list is made distinct on one narrow column, combined before its shuffle; labels come from the distinct names.
    names = kept.select("operador_nome").distinct() if where is None else None
    if names is None:
        operators = _by_operator(records, where).select(F.lit("operador").alias("atributo"), F.col("operador").alias("valor"))
    else:
        operators = operator_labels(names).select(F.lit("operador").alias("atributo"), F.col("operador_exibicao").alias("valor")).distinct()
    lists = [
        kept.select(F.lit(name).alias("atributo"), F.col(column).alias("valor")).where("valor IS NOT NULL").distinct()
        for name, column in {"status": "status", "cliente": "cliente_nome"}.items()
    ]
    planned = schedule.select(
        F.lit("operador_escala").alias("atributo"), F.nullif(F.btrim("operador"), F.lit("")).alias("valor")
    ).where("valor IS NOT NULL").distinct()
    return lists[0].unionByName(lists[1]).unionByName(planned).unionByName(operators).orderBy("atributo", "valor")


def latest_records(records: DataFrame, n: int = 50) -> DataFrame:
    """The newest-n report; runs as a distributed top-k, not as a full sort."""
    return records.orderBy(F.col("data_registro").desc_nulls_last(), F.col("id")).limit(n)


def latest_caption(records: DataFrame, n: int = 50) -> DataFrame:
    """How many of how many rows the newest-n report shows."""
    return records.agg(F.count("*").alias("total")).select(F.least(F.lit(n).cast("bigint"), "total").alias("exibidos"), "total")


def latest_with_caption(records: DataFrame, n: int = 50) -> tuple[list[Row], dict[str, int]]:
    """The newest-n report and its caption from one pass: the rows are counted on their way into the top-k."""
    seen = Observation("registros")
    rows = latest_records(records.observe(seen, F.count(F.lit(1)).alias("total")), n).collect()  # n rows
    return rows, {"exibidos": len(rows), "total": seen.get["total"]}
