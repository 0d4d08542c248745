"""Small hand-written frames."""

import contextlib
import io
from datetime import datetime

RECORD = (
    "id bigint, data_registro timestamp_ntz, operador_nome string, cliente_nome string, status string, "
    "justificativa string, caminho_evidencia string, aprovado_gestor string"
)
PLAN = "id bigint, operador string, periodo string, segunda string, terca string, quarta string, quinta string, sexta string"

FULL, PARTIAL, NOT_DONE = "Realizado Total", "Realizado Parcial", "Não Realizado"
MONDAY = datetime(2024, 1, 15, 9, 30)


def records(spark, rows):
    """Rows as (id, date, operator, client, status[, note])."""
    full = [(*r[:5], r[5] if len(r) > 5 else "n", None, "Pendente") for r in rows]
    return spark.createDataFrame(full, RECORD)


def schedule(spark, rows):
    """Rows as (id, operator, period, monday..friday); missing days are '-'."""
    return spark.createDataFrame([tuple(r) + ("-",) * (8 - len(r)) for r in rows], PLAN)


def values(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def explain(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
