"""The business tables derived from the test tables.

Each view is a list of expressions over one source table, in the SQL that Spark and the
oracle engine share, so that both sides of a check start from the same input.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31, 12, 0, 0)
GAP_DAY = date(2024, 1, 15)
GAP_START, GAP_END = date(2024, 1, 8), date(2024, 1, 21)
REQUESTS_AS_OF = datetime(1998, 6, 1)


def _n(expr: str, digits: int = 7) -> str:
    return f"lpad(CAST({expr} AS STRING), {digits}, '0')"


def _plus(ts: str, amount: str, unit: str) -> str:
    return f"{ts} + ({amount}) * INTERVAL '1' {unit}"


_OPERATOR = (
    f"CASE event_id % 3 WHEN 0 THEN 'ÓP' || {_n('user_id')} "
    f"WHEN 1 THEN 'Óp' || {_n('user_id')} || ' Silva' ELSE 'op' || {_n('user_id')} || ' S.' END"
)
_STATUS = (
    "CASE WHEN event_id % 89 = 7 THEN NULL "
    "WHEN (event_id*31 + user_id*17) % 100 < 30 + (user_id % 25 % 8) * 9 THEN 'Realizado Total' "
    "WHEN event_type IN ('click', 'view') THEN 'Realizado Parcial' "
    "WHEN event_type = 'error' THEN 'Não Realizado' "
    "WHEN event_type = 'signup' THEN 'Não Se Aplica' ELSE 'Não Informado' END"
)
_TS = "CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END"
_CLIENT = "'Client ' || CAST((event_id * 7) % 60 AS STRING)"
_NOTE = "CASE WHEN event_id % 13 = 0 THEN '' ELSE props END"


def _cell(d: int) -> str:
    mix = f"s_suppkey*3 + {d}*5 + p*7"
    return (
        f"CASE WHEN ({mix}) % 4 = 0 THEN '-' WHEN ({mix}) % 23 = 1 THEN ' ' "
        f"ELSE 'Client ' || CAST((s_suppkey*11 + {d}*13 + CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE p*29 END) % 60 AS STRING) END"
    )


_USERNAME = f"'Customer#' || {_n('o_custkey', 9)}"
_USER_NAME = (
    "CASE WHEN c_custkey % 50 = 49 THEN NULL WHEN c_custkey % 4 = 0 "
    f"THEN 'Óp' || {_n('CAST(floor(c_custkey / 20) AS BIGINT)')} "
    f"ELSE 'Óp' || {_n('CAST(floor(c_custkey / 20) AS BIGINT)')} || ' ' || "
    "upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) END"
)
_EMAIL = (
    "CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 11 = 0 THEN 'u' || CAST({k} AS STRING) "
    "ELSE 'u' || CAST({k} AS STRING) || '@example.org' END"
)
_REQUEST_STATUS = (
    "CASE o_orderstatus WHEN 'O' THEN 'pendente' WHEN 'P' THEN 'autorizado' "
    "ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'usado' ELSE 'rejeitado' END END"
)
_HAS_APPROVAL = "o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderkey % 2 = 0)"
_APPROVED_AT = f"CASE WHEN {_HAS_APPROVAL} THEN {_plus('o_orderdate', 'o_orderkey % 60', 'MINUTE')} END"
_ISO_DAY = "CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS STRING)"
_SHORT_DAY = "'202401' || lpad(CAST(1 + o_orderkey % 30 AS STRING), 2, '0')"
_ODD_DATE = (
    f"CASE o_orderkey % 6 WHEN 0 THEN {_SHORT_DAY} || 'T081530' WHEN 1 THEN {_SHORT_DAY} "
    f"WHEN 2 THEN '2024-W03-' || CAST(1 + o_orderkey % 7 AS STRING) WHEN 3 THEN {_ISO_DAY} || 'T0815' "
    f"WHEN 4 THEN {_ISO_DAY} || 'T08:15:30.1234567899' ELSE {_ISO_DAY} || 'T08:15:30+03:00:00' END"
)
_DATE_TEXT = (
    f"CASE WHEN o_orderkey % 11 = 5 THEN {_ODD_DATE} ELSE CASE o_orderkey % 8 WHEN 0 THEN {_ISO_DAY} || 'T08:15:30' WHEN 1 THEN {_ISO_DAY} || 'T08:15:30Z' "
    f"WHEN 2 THEN {_ISO_DAY} || 'T08:15:30+03:00' WHEN 3 THEN ' ' || {_ISO_DAY} || ' ' "
    f"WHEN 4 THEN 'amanhã' WHEN 5 THEN {_ISO_DAY} || ' 25:00:00' WHEN 6 THEN {_ISO_DAY} || ' 23:59:59.250' END END"
)

# name -> (source table, [(column, expression)])
VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "records": ("events", [
        ("id", "event_id"), ("data_registro", _TS), ("operador_nome",
            f"CASE WHEN event_id % 211 = 5 THEN NULL WHEN event_id % 211 = 6 THEN '  ' ELSE {_OPERATOR} END"),
        ("cliente_nome", _CLIENT), ("status", _STATUS), ("justificativa", _NOTE),
        ("caminho_evidencia", "CAST(NULL AS STRING)"), ("aprovado_gestor", "'Pendente'"),
    ]),
    "schedule": ("supplier_periods", [
        ("id", "s_suppkey * 2 + p"), ("operador", f"'ÓP' || {_n('s_suppkey')}"),
        ("periodo", "CASE WHEN p = 0 THEN 'MANHÃ' ELSE 'TARDE' END"),
        ("segunda", _cell(0)), ("terca", _cell(1)), ("quarta", _cell(2)), ("quinta", _cell(3)), ("sexta", _cell(4)),
    ]),
    "raw_schedule": ("supplier_periods", [
        ("ID", "s_suppkey * 2 + p"), ("Analista", f"' ÓP' || {_n('s_suppkey')} || ' '"),
        ("período", "CASE WHEN p = 0 THEN 'MANHÃ' ELSE NULL END"),
        ("SEGUNDA", _cell(0)), ("terça", f"CASE WHEN s_suppkey % 9 = 0 THEN 'nan' ELSE {_cell(1)} END"),
        ("Quarta", f"CASE WHEN s_suppkey % 8 = 0 THEN 'None' ELSE {_cell(2)} END"), ("quinta", f"' ' || ({_cell(3)})"),
    ]),
    "plan_payloads": ("customer", [
        ("ordem", "c_custkey"), ("id", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(floor(c_custkey / 2) AS BIGINT) END"),
        ("payload",
            "'{\"' || CASE WHEN c_custkey % 2 = 0 THEN 'operador' ELSE 'Operador' END || '\": \"' || "
            f"CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE ' óp' || {_n('c_custkey')} END || '\"' || "
            "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ', \"Periodo\": \"tarde\"' END || "
            "', \"segunda\": \"' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Client ' || CAST(c_custkey % 60 AS STRING) END || '\"' || "
            "', \"Terça\": \" Client ' || CAST((c_custkey * 3) % 60 AS STRING) || ' \"' || "
            "CASE WHEN c_custkey % 4 = 0 THEN ', \"terca\": \"Client T\"' ELSE '' END || "
            "', \"Sexta\": null}'"),
    ]),
    "users": ("customer", [
        ("id", "c_custkey"), ("username", "c_name"), ("nome", _USER_NAME), ("email", _EMAIL.format(k="c_custkey")),
        ("telefone", f"CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '11' || {_n('c_custkey', 8)} END"),
        ("perfil_completo", "TRUE"),
        ("role", "CASE c_custkey % 5 WHEN 0 THEN 'Operador' WHEN 1 THEN 'Visualizador' WHEN 2 THEN 'Gestor' "
                 "WHEN 3 THEN 'Admin' ELSE ' admin master ' END"),
        ("departamento_id", "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END"),
    ]),
    "departments": ("nation", [("id", "CAST(n_nationkey AS BIGINT)"), ("nome", "n_name")]),
    "requests": ("orders", [
        ("id", "o_orderkey"), ("username", _USERNAME),
        ("email", _EMAIL.format(k="o_custkey")), ("telefone", "CAST(NULL AS STRING)"),
        ("status", _REQUEST_STATUS), ("solicitado_em", "o_orderdate"), ("autorizado_em", _APPROVED_AT),
        ("expira_em", f"({_APPROVED_AT}) + INTERVAL '10' MINUTE"),
        ("usado_em", "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN "
                     f"{_plus('o_orderdate', 'o_orderkey % 60 + 5', 'MINUTE')} END"),
        ("autorizado_por", f"CASE WHEN {_HAS_APPROVAL} THEN 'Customer#000000003' END"),
    ]),
    "new_requests": ("orders", [
        ("id", "o_orderkey"),
        ("username", f"CASE WHEN o_orderkey % 13 = 0 THEN 'ghost' ELSE ' ' || {_USERNAME} END"),
        ("email", "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'U' || CAST(o_custkey AS STRING) || '@EXAMPLE.org' "
                  "WHEN 2 THEN 'other@example.org' ELSE '' END"),
        ("telefone", f"CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '11' || {_n('o_custkey', 8)} ELSE '00' END"),
        ("solicitado_em", _plus("o_orderdate", "o_orderkey % 60", "MINUTE")),
    ]),
    "request_log": ("events", [
        ("id", "event_id"), ("usuario", "'user' || CAST(user_id AS STRING)"),
        ("quando", "CAST('2024-01-01' AS {NTZ}) + event_id * INTERVAL '1' SECOND"),
        ("acao", "CASE event_type WHEN 'signup' THEN 'solicitar' WHEN 'click' THEN 'autorizar' "
                 "WHEN 'error' THEN 'rejeitar' ELSE 'usar' END"),
    ]),
    "edits": ("events", [
        ("ordem", "event_id"),
        ("id", "CASE WHEN event_id % 50 = 33 THEN NULL WHEN event_id % 20 = 19 THEN event_id - 1 ELSE event_id END"),
        ("cliente_nome", f"CASE WHEN event_id % 40 = 9 THEN ' ' ELSE CASE event_id % 5 WHEN 0 THEN ' ' || {_CLIENT} || ' ' WHEN 1 THEN 'Client X' ELSE {_CLIENT} END END"),
        ("status", f"CASE WHEN event_id % 40 = 7 THEN 'foo' ELSE CASE event_id % 5 WHEN 2 THEN 'Não Realizado' WHEN 3 THEN 'Realizado Parcial' ELSE {_STATUS} END END"),
        ("justificativa", f"CASE WHEN event_id % 5 = 3 THEN '' ELSE {_NOTE} END"),
        ("data_registro", "CASE WHEN event_id % 60 = 11 THEN NULL WHEN event_id % 5 = 4 THEN coalesce("
                          f"{_TS}, CAST('2024-01-31 12:00:00' AS {{NTZ}})) + INTERVAL '90' SECOND ELSE {_TS} END"),
    ]),
    "patches": ("orders", [
        ("ordem", "o_orderkey"), ("id", "CAST(floor(o_orderkey / 2) AS BIGINT) * 3"),
        ("tem_justificativa", "o_orderkey % 3 <> 0"),
        ("cliente_nome", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ' Client P' || CAST(o_custkey % 9 AS STRING) END"),
        ("status", "CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE 'Realizado Parcial ' END"),
        ("justificativa", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ' nota ' || CAST(o_orderkey % 7 AS STRING) END"),
        ("operador_nome", "CASE WHEN o_orderkey % 6 = 0 THEN ' op novo ' WHEN o_orderkey % 6 = 1 THEN '' END"),
        ("data_registro", _DATE_TEXT),
    ]),
    "submissions": ("orders", [
        ("ordem", "o_orderkey"),
        ("id", "CASE WHEN o_orderkey % 17 = 3 THEN NULL WHEN o_orderkey % 10 = 1 THEN o_orderkey - 1 ELSE o_orderkey END"),
        ("username", f"CASE WHEN o_orderkey % 19 = 0 THEN 'ghost' ELSE {_USERNAME} END"),
        ("cliente_nome", "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' "
                         "WHEN 2 THEN '  Client ' || CAST(o_custkey % 60 AS STRING) || ' ' "
                         "WHEN 3 THEN 'Selecione...' ELSE 'Client ' || CAST(o_custkey % 60 AS STRING) END"),
        ("cliente", "CASE WHEN o_orderkey % 2 = 0 THEN 'Alt ' || CAST(o_custkey % 9 AS STRING) END"),
        ("status", "CASE o_orderpriority WHEN '1-URGENT' THEN 'Realizado Total' WHEN '2-HIGH' THEN 'Realizado Parcial' "
                   "WHEN '3-MEDIUM' THEN 'Não Realizado' WHEN '4-NOT SPECIFIED' THEN 'Não Informado' ELSE 'Em Análise' END"),
        ("justificativa", "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN ' ' ELSE 'motivo ' || CAST(o_orderkey % 7 AS STRING) END"),
        ("operador_nome", f"CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' Óp' || {_n('o_orderkey % 40')} || ' ' END"),
        ("data_registro", _DATE_TEXT),
    ]),
    "tombstones": ("orders", [("id", "CASE WHEN o_orderstatus = 'F' THEN o_orderkey END")]),
    "role_changes": ("orders", [
        ("ordem", "o_orderkey"), ("id", "CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1000000000000 ELSE o_custkey END"),
        ("role", "CASE o_orderkey % 6 WHEN 0 THEN 'Operador' WHEN 1 THEN 'Visualizador' WHEN 2 THEN 'Gestor' "
                 "WHEN 3 THEN 'Admin' WHEN 4 THEN 'Coordenador' ELSE 'admin' END"),
    ]),
    "signups": ("orders", [
        ("ordem", "o_orderkey"),
        ("username", f"CASE o_orderkey % 3 WHEN 0 THEN {_USERNAME} WHEN 1 THEN 'novo ' || CAST(o_custkey AS STRING) "
                     "ELSE 'N' || CAST(o_orderkey AS STRING) || '!' END"),
        ("nome", "'Pessoa ' || CAST(o_orderkey AS STRING)"),
        ("email", "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE 'p' || CAST(o_orderkey AS STRING) || '@example.org' END"),
        ("role", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Gestor' END"),
    ]),
    "newcomers": ("orders", [
        ("id", "o_orderkey"), ("nome", "' Óp' || CAST(o_custkey % 10 AS STRING)"),
        ("sobrenome", "CASE o_orderkey % 500 WHEN 7 THEN 'Reis' WHEN 8 THEN 'Reis2' WHEN 9 THEN 'Reis22' ELSE "
                      "CASE WHEN o_orderkey % 3 = 0 THEN 'Ávila' ELSE 'Silva' END END"),
    ]),
    "taken_names": ("customer", [
        ("username", "'op' || CAST(c_custkey % 10 AS STRING) || CASE WHEN c_custkey % 300 = 31 THEN '.reis' ELSE '.silva' END || "
                     "CASE WHEN c_custkey < 10 THEN '' ELSE CAST(1 + 2 * CAST(floor(c_custkey / 10) AS BIGINT) AS STRING) END"),
    ]),
    "envelopes": ("events", [
        ("payload", "CASE WHEN event_id % 2 = 0 THEN '[' ELSE '{\"data\": [' END || "
                    "'{\"id\": ' || CAST(event_id AS STRING) || ', \"operador_nome\": \"op ' || CAST(user_id AS STRING) || "
                    "'\", \"status\": \"' || event_type || '\", \"extra\": 1}' || "
                    "CASE WHEN event_id % 2 = 0 THEN ']' ELSE ']}' END"),
    ]),
}


# Declared source schemas: no job to infer them, and a stream needs them anyway.
SOURCE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    file = "supplier" if table == "supplier_periods" else table
    base = spark.read.schema(SOURCE_SCHEMAS[file]).parquet(f"{sf_dir}/{file}.parquet")
    if table == "supplier_periods":
        return base.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1))))
    return base


def derive(source: DataFrame, name: str) -> DataFrame:
    """The view over its (static or streaming) source table."""
    exprs = [f"{e.replace('{NTZ}', 'TIMESTAMP_NTZ')} AS `{c}`" for c, e in VIEWS[name][1]]
    return source.selectExpr(*exprs)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(_source(spark, sf_dir, VIEWS[name][0]), name)


def view_sql(name: str) -> str:
    """The same view for the oracle engine."""
    table, columns = VIEWS[name]
    exprs = ", ".join(f'{e.replace("{NTZ}", "TIMESTAMP")} AS "{c}"' for c, e in columns)
    source = "(SELECT *, unnest([0, 1]) AS p FROM supplier)" if table == "supplier_periods" else table
    return f"SELECT {exprs} FROM {source}"
