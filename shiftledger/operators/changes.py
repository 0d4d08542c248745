"""Batch changes to records and plan: ingest, rules, bulk edits, patches, deletes, upserts.

Every change is a table job: validate, set rejects aside, then join by key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.dates import instant, parse_record_date, to_minute
from shiftledger.functions.domain import CHOOSE_CLIENT, DEFAULT_APPROVAL, FULL, STATUSES
from shiftledger.functions.roles import is_management
from shiftledger.functions.text import none_if_blank, strip
from shiftledger.operators.numbering import highest_id, number_missing
from shiftledger.operators.plan import normalize_payloads
from shiftledger.sources.schemas import RECORDS

EDITED = ["cliente_nome", "status", "justificativa"]
CONTENT = [c for c in RECORDS.names if c != "id"]
NO_RECORD = "registro desconhecido"
_BEFORE_ALL = -(2**63)  # the place of a submission that gives none
NO_CLIENT = "cliente não informado"
NO_NOTE = "justificativa obrigatória"
BAD_STATUS = "status inválido"
APPLIED, REMOVED, UNKNOWN, BAD_DATE = "aplicado", "removido", "desconhecido", "data inválida"


def violations(client: str = "cliente_nome", status: str = "status", note: str = "justificativa") -> Column:
    """Broken submission rules of a row, as an array that is empty when the row is valid."""
    no_client = F.coalesce(strip(client), F.lit("")).isin("", CHOOSE_CLIENT)
    no_note = ~F.col(status).eqNullSafe(FULL) & none_if_blank(note).isNull()
    bad_status = ~F.coalesce(F.col(status).isin(STATUSES), F.lit(False))
    return F.array_compact(F.array(
        F.when(no_client, F.lit(NO_CLIENT)), F.when(no_note, F.lit(NO_NOTE)), F.when(bad_status, F.lit(BAD_STATUS)),
    ))


def check_records(records: DataFrame) -> DataFrame:
    return records.withColumn("violacoes", violations()).withColumn("valido", F.size("violacoes") == 0)


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of a batch."""
    checked = check_records(records)
    return checked.where("valido").drop("violacoes", "valido"), checked.where("NOT valido").drop("valido")


def ingest_records(batch: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    """Record rows from submissions. Only management may report under another operator's name.

    ``aceito`` is false, and the operator null, where the submitter is unknown. Ids and ``ordem``, the
    place of a submission among all, pass through; ``numbering.number_missing`` gives ids to those without.
    """
    people = users.select(
        "username", F.col("nome").alias("_nome"), F.col("role").alias("_role"), F.lit(True).alias("_existe")
    )
    own = F.coalesce(F.nullif("_nome", F.lit("")), F.col("username"))
    known = F.col("_existe").isNotNull()
    operator = F.when(is_management("_role"), F.coalesce(none_if_blank("operador_nome"), own)).otherwise(own)
    client = strip(F.coalesce(F.nullif("cliente_nome", F.lit("")), F.col("cliente"), F.lit("")))
    return batch.join(people, "username", "left").select(
        "id", F.coalesce(parse_record_date("data_registro"), instant(as_of)).alias("data_registro"),
        F.when(known, operator).alias("operador_nome"), client.alias("cliente_nome"), "status",
        F.coalesce("justificativa", F.lit("")).alias("justificativa"),
        F.lit(None).cast("string").alias("caminho_evidencia"), F.lit(DEFAULT_APPROVAL).alias("aprovado_gestor"),
        known.alias("aceito"), F.col("ordem") if "ordem" in batch.columns else F.lit(None).cast("bigint").alias("ordem"),
    )


def settle(submitted: DataFrame, stored: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """What valid submissions change in the table, and those that name no record.

    Only the table gives ids: a submission without one is a new record and gets the next free id after ``top``, in ``ordem`` order; one with an id
    is meant for the record of that id, stored or made by an earlier ``ordem`` of this batch. Of several the greatest (``ordem``, content) stays, and it
    must be greater than what is stored. So the same submissions give the same records however they are cut into batches, as long as new records come in
    ``ordem`` order. ``stored`` holds the rows of the ids that are named, with ``ordem`` and ``ordem_criacao``; so do the changed rows that are returned.
    """
    rows = submitted.select("id", *CONTENT, F.coalesce("ordem", F.lit(_BEFORE_ALL)).alias("ordem"))
    new = number_missing(rows.where("id IS NULL"), top, ["ordem", *CONTENT]).withColumn("ordem_criacao", F.col("ordem"))
    content = F.struct("ordem", *CONTENT)
    known = stored.select("id", *CONTENT, "ordem", "ordem_criacao").unionByName(new).select(
        F.col("id").alias("_id"), content.alias("_antes"), F.col("ordem_criacao").alias("_criacao")
    )
    met = rows.where("id IS NOT NULL").join(known, F.col("id") == F.col("_id"), "left")
    unknown = F.col("_id").isNull() | F.coalesce(F.col("ordem") <= F.col("_criacao"), F.lit(False))
    newer = F.col("_antes.ordem").isNull() | (content > F.col("_antes"))
    last = met.where(~unknown & newer).groupBy("id").agg(F.max(content).alias("_linha"), F.max("_criacao").alias("ordem_criacao"))
    last = last.select("id", "_linha.*", "ordem_criacao")
    return new.join(last, "id", "left_anti").unionByName(last), met.where(unknown).select("id", *CONTENT, "ordem")


def last_per_id(rows: DataFrame) -> DataFrame:
    """The row of greatest ``ordem`` per id, without ``ordem``; rows without an id name no record and fall out.

    Rows without an ``ordem`` column must be one per id, or the greatest of equal ids stays.
    """
    if "ordem" not in rows.columns:
        rows = rows.withColumn("ordem", F.lit(None).cast("bigint"))
    fields = [c for c in rows.columns if c not in ("id", "ordem")]
    return rows.where("id IS NOT NULL").groupBy("id").agg(
        F.max_by(F.struct(*fields), F.struct("ordem", *fields)).alias("_linha")
    ).select("id", "_linha.*")


def _compared(edits: DataFrame, records: DataFrame, how: str) -> DataFrame:
    """Records beside the last edit of each: new texts and date, old ones as ``_antes``, one flag per change and ``resultado``.

    One join serves outcome and overlay. A left join leaves ``resultado`` null where nothing was edited.
    """
    new = last_per_id(edits).select(
        F.col("id").alias("_edicao"), *[F.coalesce(strip(c), F.lit("")).alias(f"_{c}") for c in EDITED],
        to_minute("data_registro").alias("_data_registro"),
    )
    joined = records.join(new, F.col("id") == F.col("_edicao"), how)
    changed = {f"mudou_{c}": F.col(f"_{c}") != F.coalesce(strip(c), F.lit("")) for c in EDITED} | {
        "mudou_data_registro": ~F.col("_data_registro").eqNullSafe(to_minute("data_registro"))
    }
    broken = F.size(violations("_cliente_nome", "_status", "_justificativa")) > 0
    verdict = F.when(~F.greatest(*[F.col(c) for c in changed]), "inalterado").when(broken, "rejeitado").otherwise("alterado")
    return joined.withColumns(changed).withColumn("resultado", F.when(F.col("_edicao").isNotNull(), verdict))


def judge_edits(edits: DataFrame, records: DataFrame) -> DataFrame:
    """The last edit of every known record with its outcome: unchanged, rejected by the submission rules, or applied.

    Texts are trimmed and null is ''; dates count to the minute; a cleared date is a change, but the old date stays.
    """
    columns = [*EDITED, "data_registro"]
    return _compared(edits, records, "inner").select(
        "id", *[F.col(f"_{c}").alias(c) for c in columns], *[F.col(c).alias(f"{c}_antes") for c in columns],
        *[f"mudou_{c}" for c in columns], "resultado",
    )


def edit_diff(edits: DataFrame, records: DataFrame) -> DataFrame:
    """Edits that would change something, whether or not the rules let them."""
    return judge_edits(edits, records).where("resultado <> 'inalterado'").drop("resultado")


def edit_outcome(edits: DataFrame, records: DataFrame) -> DataFrame:
    return judge_edits(edits, records).groupBy("resultado").agg(F.count("*").alias("qtd"))


def apply_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Records after the valid edits. A cleared date keeps the old one."""
    return _written(_compared(edits, records, "left"), records.columns)


def edited_rows(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Only the records that valid edits change, after the change: the input of an upsert."""
    return _written(_compared(edits, records, "inner").where("resultado = 'alterado'"), records.columns)


def _written(compared: DataFrame, columns: list[str]) -> DataFrame:
    applied = F.col("resultado") == "alterado"
    return compared.select(*[
        (F.when(applied, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) if c in (*EDITED, "data_registro") else F.col(c)).alias(c)
        for c in columns
    ])


def _overlay(records: DataFrame, patch: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Replace columns by their ``_column`` of the patch where that is not null; one patch row per id."""
    joined = records.join(patch, "id", how)
    return joined.select(*[
        (F.coalesce(F.col(f"_{c}"), F.col(c)) if c in columns else F.col(c)).alias(c) for c in records.columns
    ])


def compact_patches(patches: DataFrame) -> DataFrame:
    """One patch row per id: per column the last value (by ``ordem``) that would be written.

    A client or status of null, a blank operator and an absent note write nothing; a bad date
    rejects its whole row.
    """
    moment = parse_record_date("data_registro")
    good = F.col("data_registro").isNull() | moment.isNotNull()
    parsed = patches.select(
        "id", *EDITED, "operador_nome", "tem_justificativa", moment.alias("_momento"), F.when(good, F.col("ordem")).alias("_ordem")
    )

    def last(value: Column, written: Column, name: str) -> Column:
        return F.max_by(value, F.when(written, F.col("_ordem"))).alias(name)

    return parsed.groupBy("id").agg(
        last(strip("cliente_nome"), F.col("cliente_nome").isNotNull(), "_cliente_nome"),
        last(strip("status"), F.col("status").isNotNull(), "_status"),
        last(F.coalesce(strip("justificativa"), F.lit("")), F.col("tem_justificativa"), "_justificativa"),
        last(strip("operador_nome"), F.nullif("operador_nome", F.lit("")).isNotNull(), "_operador_nome"),
        last(F.col("_momento"), F.col("_momento").isNotNull(), "_data_registro"),
    )


def apply_patches(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Records after a batch of partial updates, in ``ordem`` order per id."""
    return _overlay(records, compact_patches(patches), [*EDITED, "operador_nome", "data_registro"], "left")


def judge_patches(patches: DataFrame, records: DataFrame) -> DataFrame:
    """Every patch with its verdict; an unknown id is reported before a bad date."""
    known = records.where("id IS NOT NULL").select("id", F.lit(True).alias("_existe"))
    bad = F.col("data_registro").isNotNull() & parse_record_date("data_registro").isNull()
    verdict = F.when(F.col("_existe").isNull(), UNKNOWN).when(bad, BAD_DATE).otherwise(APPLIED)
    return patches.join(known, "id", "left").select("ordem", "id", verdict.alias("resultado"))


def judge_deletes(tombstones: DataFrame, records: DataFrame) -> DataFrame:
    """Every id to delete once, with how often it was asked for and whether there was a record."""
    asked = tombstones.groupBy("id").agg(F.count("*").alias("pedidos"))
    known = records.where("id IS NOT NULL").select("id", F.lit(True).alias("_existe"))
    return asked.join(known, "id", "left").select(
        "id", "pedidos", F.when(F.col("_existe").isNull(), UNKNOWN).otherwise(REMOVED).alias("resultado")
    )


def delete_by_id(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    gone = tombstones.select("id").where("id IS NOT NULL").distinct()
    return df.join(gone, "id", "left_anti")


REPLACED, INSERTED, OUTDATED = "substituída", "incluída", "superada"


def judge_plan_payloads(schedule: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every payload with its verdict: a new line, a replaced one, outdated by a later payload, or meant for a line that does not exist."""
    known = schedule.where("id IS NOT NULL").select("id", F.lit(True).alias("_existe"))
    last = payloads.where("id IS NOT NULL").groupBy("id").agg(F.max("ordem").alias("_ultima"))
    verdict = (
        F.when(F.col("id").isNull(), INSERTED).when(F.col("_existe").isNull(), UNKNOWN)
        .when(F.col("ordem") < F.col("_ultima"), OUTDATED).otherwise(REPLACED)
    )
    return payloads.join(known, "id", "left").join(last, "id", "left").select("ordem", "id", verdict.alias("resultado"))


def judge_plan_upsert(schedule: DataFrame, payloads: DataFrame, insert_unknown: bool = False) -> DataFrame:
    """The plan lines a batch of payloads leaves: the last ``ordem`` per id, new lines numbered; ``novo`` where inserted.

    A payload without an id is a line of its own and gets the next free id, in ``ordem`` order. One with an id that no line has changes nothing
    (``judge_plan_payloads`` tells), or with ``insert_unknown`` is a new line under that id; then free ids begin after those of the payloads, too.
    """
    rows = normalize_payloads(payloads)
    fields = [c for c in schedule.columns if c != "id"]
    winner = last_per_id(rows.select("id", "ordem", *fields))
    known = schedule.where("id IS NOT NULL").select("id")
    if insert_unknown:
        top = highest_id(schedule, payloads)
        met = known.distinct().withColumn("novo", F.lit(False))
        named = winner.join(met, "id", "left").withColumn("novo", F.coalesce("novo", F.lit(True)))
    else:
        top = highest_id(schedule)
        named = winner.join(known, "id", "left_semi").withColumn("novo", F.lit(False))
    fresh = number_missing(rows.where("id IS NULL"), top, ["ordem"]).select("id", *fields)
    return named.unionByName(fresh.withColumn("novo", F.lit(True)))


def upsert_schedule(schedule: DataFrame, payloads: DataFrame, insert_unknown: bool = False) -> DataFrame:
    """The plan after a batch of payload rows: known lines replaced, new ones appended."""
    changed = judge_plan_upsert(schedule, payloads, insert_unknown).drop("novo")
    return schedule.join(changed, "id", "left_anti").unionByName(changed)
