"""What a role may do. Role text is trimmed and compared without case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftledger.functions.text import strip

# Role sets.
MANAGEMENT = ["admin", "admin master", "gestor", "coordenador"]
CAN_EDIT = [*MANAGEMENT, "operador"]
CAN_LAUNCH = [*CAN_EDIT, "visualizador"]
READ_ONLY = ["visualizador"]
FULL_VIEW = [*MANAGEMENT, "visualizador"]


def normalized(role: Column | str) -> Column:
    return F.lower(F.coalesce(strip(role), F.lit("")))


def is_management(role: Column | str) -> Column:
    return normalized(role).isin(MANAGEMENT)


def has_full_view(role: Column | str) -> Column:
    return normalized(role).isin(FULL_VIEW)


def capabilities(role: Column | str) -> dict[str, Column]:
    name = normalized(role)
    return {
        "role_norm": name,
        "can_edit": name.isin(CAN_EDIT),
        "can_launch": name.isin(CAN_LAUNCH),
        "read_only": name.isin(READ_ONLY),
        "management": name.isin(MANAGEMENT),
        "full_view": name.isin(FULL_VIEW),
    }
