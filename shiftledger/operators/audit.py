"""Audit rows: one per change that took effect, with what was stored.

Every function returns the columns of ``schemas.AUDIT`` without ids; ``tables.append_audit`` numbers them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.dates import instant
from shiftledger.functions.domain import WEEKDAYS
from shiftledger.operators import changes, users
from shiftledger.sources.schemas import AUDIT, conform


@dataclass(frozen=True)
class Actor:
    """Who made a batch of changes, and when."""

    login: str
    at: datetime
    name: str | None = None
    address: str | None = None


def entries(rows: DataFrame, actor: Actor, action: str, details: Column) -> DataFrame:
    return conform(rows.select(
        instant(actor.at).alias("timestamp"), F.lit(actor.login).alias("usuario_login"),
        F.lit(actor.name).cast("string").alias("usuario_nome"), F.lit(actor.address).cast("string").alias("ip_origem"),
        F.lit(action).alias("acao"), details.alias("detalhes"),
    ), AUDIT)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _subject(kind: str) -> Column:
    return F.concat(F.lit(f"{kind} "), _text(F.col("id")))


def _changes(columns: list[str], before: str, after: str) -> list[Column]:
    """``name: old -> new`` of the columns whose stored value differs."""
    return [
        F.when(
            ~F.col(after.format(c)).eqNullSafe(F.col(before.format(c))),
            F.concat(F.lit(f"{c}: "), _text(F.col(before.format(c))), F.lit(" -> "), _text(F.col(after.format(c)))),
        )
        for c in columns
    ]


def of_edits(edits: DataFrame, records: DataFrame, actor: Actor) -> DataFrame:
    """Edits that were applied; a cleared date is no part of it, since the old date stays."""
    applied = changes.judge_edits(edits, records).where("resultado = 'alterado'")
    stored = applied.withColumn("data_registro", F.coalesce("data_registro", "data_registro_antes"))
    parts = [
        F.when(F.col(f"mudou_{c}"), part)
        for c, part in zip([*changes.EDITED, "data_registro"], _changes([*changes.EDITED, "data_registro"], "{}_antes", "{}"))
    ]
    return entries(stored, actor, "editar_registro", F.concat_ws("; ", _subject("registro"), *parts))


def of_patches(patches: DataFrame, records: DataFrame, actor: Actor) -> DataFrame:
    """Records that a batch of patches leaves different, old and new values beside each other."""
    columns = [*changes.EDITED, "operador_nome", "data_registro"]
    patch = changes.compact_patches(patches)
    beside = records.join(patch, "id").select("id", *columns, *[F.coalesce(f"_{c}", c).alias(f"{c}_novo") for c in columns])
    parts = _changes(columns, "{}", "{}_novo")
    return entries(beside.where(F.coalesce(*parts).isNotNull()), actor, "atualizar_registro", F.concat_ws("; ", _subject("registro"), *parts))


def of_deletes(tombstones: DataFrame, records: DataFrame, actor: Actor) -> DataFrame:
    removed = changes.judge_deletes(tombstones, records).where(F.col("resultado") == changes.REMOVED)
    return entries(removed, actor, "excluir_registro", _subject("registro"))


def of_inserts(rows: DataFrame, actor: Actor) -> DataFrame:
    """Records that were added, by any path."""
    said = F.concat_ws("; ", _subject("registro"), *[
        F.concat(F.lit(f"{c}: "), _text(F.col(c))) for c in ("operador_nome", "cliente_nome", "status", "data_registro")
    ])
    return entries(rows, actor, "criar_registro", said)


def of_submissions(changed: DataFrame, stored: DataFrame, actor: Actor) -> DataFrame:
    """Records that a batch of submissions made or changed: ``changed`` as they are now, ``stored`` as they were."""
    columns = [*changes.EDITED, "operador_nome", "data_registro"]
    before = stored.select("id", *[F.col(c).alias(f"{c}_antes") for c in columns], F.lit(True).alias("_havia"))
    beside = changed.join(before, "id", "left")
    parts = _changes(columns, "{}_antes", "{}")
    updated = entries(
        beside.where(F.col("_havia") & F.coalesce(*parts).isNotNull()), actor, "atualizar_registro", F.concat_ws("; ", _subject("registro"), *parts)
    )
    return of_inserts(beside.where("_havia IS NULL"), actor).unionByName(updated)


def of_plan(schedule: DataFrame, payloads: DataFrame, actor: Actor, insert_unknown: bool = False) -> DataFrame:
    """Plan lines that were inserted or replaced."""
    lines = changes.judge_plan_upsert(schedule, payloads, insert_unknown)
    said = F.concat_ws("; ", _subject("linha"), F.when(F.col("novo"), "incluída").otherwise("substituída"), *[
        F.concat(F.lit(f"{c}: "), F.col(c)) for c in ("operador", "periodo", *WEEKDAYS)
    ])
    return entries(lines, actor, "salvar_cronograma", said)


def of_role_changes(wanted: DataFrame, people: DataFrame, actor: Actor) -> DataFrame:
    """Users whose role is another one after the batch."""
    after = users.apply_role_changes(people, wanted).select("id", F.col("role").alias("role_novo"))
    beside = people.select("id", "role").join(after, "id").where("NOT role <=> role_novo")
    return entries(beside, actor, "alterar_papel", F.concat_ws("; ", _subject("usuário"), *_changes(["role"], "{}", "{}_novo")))
