"""Declared table schemas and the step that brings a frame into one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.functions.domain import EMPTY_CELL, WEEKDAY_LABELS
from shiftledger.functions.text import strip


_TYPES = {
    "bigint": T.LongType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


RECORDS = _schema(
    id="bigint", data_registro="timestamp_ntz", operador_nome="string", cliente_nome="string",
    status="string", justificativa="string", caminho_evidencia="string", aprovado_gestor="string",
)
SCHEDULE = _schema(
    id="bigint", operador="string", periodo="string",
    segunda="string", terca="string", quarta="string", quinta="string", sexta="string",
)
USERS = _schema(
    id="bigint", username="string", nome="string", email="string", telefone="string",
    perfil_completo="boolean", role="string", departamento_id="bigint",
)
DEPARTMENTS = _schema(id="bigint", nome="string")
REQUESTS = _schema(
    id="bigint", username="string", email="string", telefone="string", status="string",
    solicitado_em="timestamp_ntz", autorizado_em="timestamp_ntz", expira_em="timestamp_ntz",
    usado_em="timestamp_ntz", autorizado_por="string",
)
AUDIT = _schema(
    id="bigint", timestamp="timestamp_ntz", usuario_login="string", usuario_nome="string",
    ip_origem="string", acao="string", detalhes="string",
)

# Header spellings of the schedule, lower-cased.
SCHEDULE_HEADERS = {
    "operador": "Operador", "analista": "Operador",
    "periodo": "Periodo", "período": "Periodo",
    "segunda": "Segunda", "terca": "Terça", "terça": "Terça",
    "quarta": "Quarta", "quinta": "Quinta", "sexta": "Sexta", "id": "id",
}
# Date columns in the order they are looked for.
DATE_COLUMNS = ["created_at", "data_registro", "data", "created_date"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in order, cast without raising; missing ones become typed nulls."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def conform_schedule(df: DataFrame) -> DataFrame:
    """Schedule under its labels whatever the header spelling; blank and missing cells become '-'."""
    found: dict[str, str] = {}
    for name in df.columns:
        label = SCHEDULE_HEADERS.get(name.strip().lower())
        if label:
            found.setdefault(label, name)
    columns = []
    for label in ["Operador", "Periodo", *WEEKDAY_LABELS]:
        if label in found:
            text = strip(F.col(f"`{found[label]}`").cast("string"))
            blank = text.isNull() | text.isin("", "nan", "None")
            columns.append(F.when(blank, EMPTY_CELL).otherwise(text).alias(label))
        else:
            columns.append(F.lit(EMPTY_CELL).alias(label))
    if "id" in found:
        columns.append(F.col(f"`{found['id']}`").alias("id"))
    return df.select(*columns)


def with_report_date(df: DataFrame) -> DataFrame:
    """Add ``data_dt`` from the first known date column; bad text and no column give null."""
    for name in DATE_COLUMNS:
        if name in df.columns:
            return df.withColumn("data_dt", F.col(name).try_cast("timestamp_ntz"))
    return df.withColumn("data_dt", F.lit(None).cast("timestamp_ntz"))
