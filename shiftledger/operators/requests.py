"""Time-boxed approval requests: sweep, listings, checks and intake."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.dates import instant
from shiftledger.functions.domain import AUTHORIZED, EXPIRED, OPEN_REQUEST, PENDING, REJECTED, USED
from shiftledger.functions.text import literal_map, strip

# Icon per closed or granted status.
STATUS_ICON = {AUTHORIZED: "🟢", USED: "✅", EXPIRED: "⏱️", REJECTED: "🚫"}


def expire_requests(requests: DataFrame, as_of: datetime) -> DataFrame:
    """Granted requests past their expiry become expired."""
    past = (F.col("status") == AUTHORIZED) & (F.col("expira_em") < instant(as_of))
    return requests.withColumn("status", F.when(past, EXPIRED).otherwise(F.col("status")))


def pending_and_history(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    return requests.where(F.col("status") == PENDING), requests.where(F.col("status") != PENDING)


def requests_report(requests: DataFrame) -> DataFrame:
    """Every request with its list (pending or history) and its status text, newest first."""
    icon = F.coalesce(F.try_element_at(literal_map(STATUS_ICON), "status"), F.lit(""))
    pending = F.col("status") == PENDING
    return requests.select(
        "id", "username", F.when(pending, "pendentes").otherwise("historico").alias("lista"),
        F.when(pending, F.col("status")).otherwise(F.concat(icon, F.lit(" "), "status")).alias("status_texto"),
        "solicitado_em", "autorizado_em", "expira_em", "autorizado_por",
    ).orderBy(F.desc("solicitado_em"), F.desc("id"))


def request_counts(requests: DataFrame) -> DataFrame:
    pending = F.col("status") == PENDING
    return requests.agg(F.count_if(pending).alias("pendentes"), F.count_if(~pending).alias("historico"))


def _latest(requests: DataFrame, moment: str) -> DataFrame:
    """Latest request per user by a moment, then by id, as an aggregate with partial combine."""
    latest = F.max(F.struct(moment, "id", "status"))
    return requests.groupBy("username").agg(latest.alias("_r")).select(
        "username", F.col("_r.id").alias("id"), F.col("_r.status").alias("status"), F.col(f"_r.{moment}").alias(moment)
    )


def latest_open_request(requests: DataFrame) -> DataFrame:
    return _latest(requests.where(F.col("status").isin(OPEN_REQUEST)), "solicitado_em")


def latest_authorized_request(requests: DataFrame) -> DataFrame:
    return _latest(requests.where(F.col("status") == AUTHORIZED), "autorizado_em")


def _differs(ours: Column, theirs: Column, text) -> Column:
    both = (F.coalesce(ours, F.lit("")) != "") & (F.coalesce(theirs, F.lit("")) != "")
    return both & (text(ours) != text(theirs))


def contact_check(new_requests: DataFrame, users: DataFrame) -> DataFrame:
    """Verdict per request: unknown user, contact mismatch (both sides given), or ok."""
    people = users.select(
        F.col("username").alias("_username"), F.col("email").alias("_email"), F.col("telefone").alias("_telefone")
    )
    asked = new_requests.withColumn("username", strip("username"))
    mail = _differs(F.col("_email"), F.col("email"), lambda c: F.lower(strip(c)))
    phone = _differs(F.col("_telefone"), F.col("telefone"), strip)
    verdict = F.when(F.col("_username").isNull(), "nao_encontrado").when(mail | phone, "nao_confere").otherwise("ok")
    return asked.join(people, F.col("username") == F.col("_username"), "left").select(
        *new_requests.columns, verdict.alias("verificacao")
    )


def intake(new_requests: DataFrame, users: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """Verdict per new request after the sweep; one is ignored while its user has one open.

    Of several in the batch the earliest valid one per user is taken.
    """
    checked = contact_check(new_requests, users)
    first = checked.where("verificacao = 'ok'").groupBy("username").agg(
        F.min(F.struct("solicitado_em", "id")).alias("_r")
    )
    busy = expire_requests(requests, as_of).where(F.col("status").isin(OPEN_REQUEST)).select("username").distinct()
    taken = first.join(busy, "username", "left_anti").select(F.col("_r.id").alias("id"), F.lit("registrada").alias("_novo"))
    return checked.join(taken, "id", "left").select(
        "id", "username", "solicitado_em",
        F.when(F.col("verificacao") != "ok", F.col("verificacao"))
        .otherwise(F.coalesce("_novo", F.lit("em_andamento"))).alias("resultado"),
    )
