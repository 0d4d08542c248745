"""Report columns: order, labels, masking and display text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.dates import display
from shiftledger.functions.domain import FULL
from shiftledger.functions.text import display_value, status_class

# Report columns in order, with their labels.
REPORT_LABELS = {
    "data_registro": "Data", "created_at": "Data", "data": "Data",
    "operador_nome": "Operador",
    "cliente_nome": "Cliente", "cliente": "Cliente",
    "status": "Status",
    "justificativa": "Justificativa", "observacoes": "Observações",
    "id": "ID",
}
NOTE_COLUMNS = ["observacoes", "justificativa"]
CONTROL_COLUMNS = ["id", "created_at"]


def mask_notes(df: DataFrame) -> DataFrame:
    """Blank the notes of fully executed rows."""
    if "status" not in df.columns:
        return df
    blank = F.col("status") == FULL
    return df.withColumns({
        c: F.when(blank, "").otherwise(F.col(c)) for c in NOTE_COLUMNS if c in df.columns
    })


def report_projection(df: DataFrame) -> DataFrame:
    """Existing report columns in their order, under labels, dates as text; the first of two equal labels stays."""
    masked = mask_notes(df)
    kept: dict[str, str] = {}
    for name, label in REPORT_LABELS.items():
        if name in df.columns and label not in kept.values():
            kept[name] = label
    return masked.select(*[
        (display(name) if label == "Data" else F.col(name)).alias(label) for name, label in kept.items()
    ])


def without_control_columns(df: DataFrame) -> DataFrame:
    return df.drop(*CONTROL_COLUMNS)


def status_cells(df: DataFrame) -> DataFrame:
    """Status text and display class per row."""
    return df.select(
        "id", display_value("status").alias("status_texto"),
        F.when(F.col("status").isNotNull(), status_class("status")).alias("classe"),
    )
