"""User tables: listings, quality, role changes, sign-ups, departments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.domain import ASSIGNABLE_ROLES, DEFAULT_ROLE
from shiftledger.functions.roles import capabilities
from shiftledger.functions.text import email_valid, initials, title_name, username_clean

MIN_USERNAME = 3


def users_listing(users: DataFrame) -> DataFrame:
    return users.select("id", "nome", "username", "email", "role").orderBy("nome", "id")


def role_capabilities(users: DataFrame) -> DataFrame:
    return users.select("id", "role", *[c.alias(n) for n, c in capabilities("role").items()])


def username_quality(users: DataFrame) -> DataFrame:
    clean = username_clean("username")
    return users.select(
        "username", clean.alias("username_limpo"), (F.length(clean) >= MIN_USERNAME).alias("valido")
    )


def email_quality(users: DataFrame) -> DataFrame:
    return users.select("id", "email", email_valid("email").alias("valido"))


def name_display(users: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("nome", F.lit("")), F.nullif("username", F.lit("")), F.lit("Usuário"))
    return users.select("id", title_name(name).alias("nome_exibicao"), initials(name).alias("iniciais"))


def users_by_department(users: DataFrame, departments: DataFrame) -> DataFrame:
    names = departments.select(F.col("id").alias("departamento_id"), F.col("nome").alias("departamento"))
    return users.join(names, "departamento_id", "left").select("id", "username", "departamento")


def judge_role_changes(changes: DataFrame, users: DataFrame) -> DataFrame:
    """Each change with its verdict; an invalid role is reported before an unknown id."""
    known = users.select("id", F.lit(True).alias("_existe"))
    verdict = (
        F.when(~F.coalesce(F.col("role").isin(ASSIGNABLE_ROLES), F.lit(False)), "papel_invalido")
        .when(F.col("_existe").isNull(), "usuario_desconhecido").otherwise("aplicado")
    )
    return changes.join(known, "id", "left").select("ordem", "id", "role", verdict.alias("resultado"))


def apply_role_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users after the valid changes; the last one per user (by ``ordem``) stays."""
    last = changes.where(F.col("role").isin(ASSIGNABLE_ROLES)).groupBy("id").agg(
        F.max_by("role", "ordem").alias("_role")
    )
    return users.join(last, "id", "left").select(*[
        (F.coalesce("_role", "role") if c == "role" else F.col(c)).alias(c) for c in users.columns
    ])


def ingest_users(batch: DataFrame, users: DataFrame) -> DataFrame:
    """Sign-ups with defaults and verdict. A taken name and a repeat in the batch are rejected.

    The first sign-up per name is found by an aggregate, so the joins see each name or row once.
    """
    first = batch.groupBy("username").agg(F.min("ordem").alias("ordem"))
    new = first.join(users.select("username").distinct(), "username", "left_anti")
    created = new.select("ordem", F.lit("criado").alias("_criado"))
    return batch.join(created, "ordem", "left").select(
        "ordem", "username", "nome",
        F.coalesce(F.nullif("email", F.lit("")), "username").alias("email"),
        F.coalesce(F.nullif("role", F.lit("")), F.lit(DEFAULT_ROLE)).alias("role"),
        F.coalesce("_criado", F.lit("duplicado")).alias("resultado"),
    )
