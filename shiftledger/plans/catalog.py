"""Registered queries: each runs one operator over whole tables derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.functions import dates, text
from shiftledger.functions.domain import NOT_REPORTED, WEEKDAYS
from shiftledger.operators import (
    audit, changes, filters, gaps, identity, kpi, lifecycle, numbering, plan, reports, requests, users,
)
from shiftledger.session import scratch_path
from shiftledger.sources import days, fixtures, schemas, tables
from shiftledger.sources.fixtures import AS_OF, GAP_DAY, GAP_END, GAP_START, REQUESTS_AS_OF
from shiftledger.streaming import approvals, live


MONTH = datetime(2024, 1, 1)


class Inputs:
    """The derived tables of one data folder, read on demand: ``inputs.records`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in fixtures.VIEWS:
            raise AttributeError(name)
        return fixtures.view(self.spark, self.sf_dir, name)

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream over its source file."""
        table = fixtures.VIEWS[name][0]
        source = live.read_table_stream(self.spark, self.sf_dir, fixtures.SOURCE_SCHEMAS[table], f"{table}.parquet")
        return fixtures.derive(source, name)


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


ENVELOPE_ROW = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("operador_nome", T.StringType()),
    T.StructField("status", T.StringType()),
])


# --- sources and sinks ---------------------------------------------------------------------

@query
def records_scan(t: Inputs) -> DataFrame:
    return tables.newest_first(schemas.conform(t.records, schemas.RECORDS))


@query
def schedule_scan(t: Inputs) -> DataFrame:
    return plan.schedule_listing(schemas.conform(t.schedule, schemas.SCHEDULE))


@query
def json_envelope(t: Inputs) -> DataFrame:
    return tables.unwrap_envelopes(t.envelopes, "payload", ENVELOPE_ROW)


@query
def schedule_conform(t: Inputs) -> DataFrame:
    return schemas.conform_schedule(t.raw_schedule)


@query
def report_dates(t: Inputs) -> DataFrame:
    return schemas.with_report_date(t.patches.select("ordem", "data_registro"))


@query
def export_csv(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    tables.export_csv(t.records, path)
    return tables.read_csv(t.spark, path, schemas.RECORDS)


@query
def snapshot_manifest(t: Inputs) -> DataFrame:
    saved = {"registros": t.records, "cronograma": t.schedule}
    return tables.write_snapshot(saved, scratch_path(t.spark, "snapshot"), AS_OF).manifest(t.spark)


@query
def records_partitioned(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "records")
    tables.write_records(t.records, path)
    start = AS_OF - timedelta(days=7)
    return tables.read_records(t.spark, path, start=start)


ACTOR = audit.Actor("gestor", AS_OF)


def _trail(t: Inputs, entries: DataFrame) -> DataFrame:
    """The audit trail after one append, as read back; ids only number the rows."""
    path = scratch_path(t.spark, "audit")
    tables.append_audit(entries, path)
    return tables.read_audit(t.spark, path).withColumn("id", F.lit(None).cast("bigint"))


@query
def audit_from_edits(t: Inputs) -> DataFrame:
    return _trail(t, audit.of_edits(t.edits, t.records, ACTOR))


@query
def audit_from_patches(t: Inputs) -> DataFrame:
    return _trail(t, audit.of_patches(t.patches, t.records, ACTOR))


@query
def audit_from_deletes(t: Inputs) -> DataFrame:
    return _trail(t, audit.of_deletes(t.tombstones, t.records, ACTOR))


@query
def audit_from_inserts(t: Inputs) -> DataFrame:
    new = gaps.number_rows(gaps.gap_fill_rows(t.schedule, t.records, GAP_START, GAP_END), t.records)
    return _trail(t, audit.of_inserts(new, ACTOR))


@query
def audit_from_plan(t: Inputs) -> DataFrame:
    return _trail(t, audit.of_plan(t.schedule, t.plan_payloads, ACTOR, insert_unknown=True))


@query
def audit_from_roles(t: Inputs) -> DataFrame:
    return _trail(t, audit.of_role_changes(t.role_changes, t.users, ACTOR))


# --- column functions ----------------------------------------------------------------------

@query
def operator_key(t: Inputs) -> DataFrame:
    return t.records.select("id", "operador_nome", text.operator_key("operador_nome").alias("op_key"))


@query
def strip_accents(t: Inputs) -> DataFrame:
    return t.records.select("id", text.strip_accents("operador_nome").alias("sem_acento"))


@query
def strip_accents_exact(t: Inputs) -> DataFrame:
    return t.records.select("id", text.strip_accents_exact("operador_nome").alias("sem_acento"))


@query
def name_slug(t: Inputs) -> DataFrame:
    return t.records.select("id", text.slug("operador_nome").alias("slug"))


@query
def parse_record_date(t: Inputs) -> DataFrame:
    return t.submissions.select("ordem", dates.parse_record_date("data_registro").alias("data_dt"))


@query
def fill_missing_dates(t: Inputs) -> DataFrame:
    return t.records.select("id", dates.fill_missing_date("data_registro", AS_OF).alias("data_registro"))


@query
def records_by_weekday(t: Inputs) -> DataFrame:
    return plan.weekday_of_records(t.records)


@query
def mask_notes(t: Inputs) -> DataFrame:
    return reports.mask_notes(t.records).select("id", "status", "justificativa")


@query
def report_projection(t: Inputs) -> DataFrame:
    return reports.report_projection(t.records)


@query
def control_columns_dropped(t: Inputs) -> DataFrame:
    return reports.without_control_columns(t.records)


@query
def status_class(t: Inputs) -> DataFrame:
    return reports.status_cells(t.records)


@query
def schedule_normalize(t: Inputs) -> DataFrame:
    return plan.normalize_payloads(t.plan_payloads)


@query
def username_quality(t: Inputs) -> DataFrame:
    return users.username_quality(t.signups.select("username"))


@query
def email_quality(t: Inputs) -> DataFrame:
    return users.email_quality(t.users)


@query
def role_capabilities(t: Inputs) -> DataFrame:
    return users.role_capabilities(t.users)


@query
def support_options(t: Inputs) -> DataFrame:
    return plan.support_options(t.schedule)


@query
def name_initials(t: Inputs) -> DataFrame:
    return users.name_display(t.users)


# --- filters -------------------------------------------------------------------------------

@query
def period_today(t: Inputs) -> DataFrame:
    return t.records.where(filters.period("Hoje", AS_OF - timedelta(days=10)))


@query
def period_last_n(t: Inputs) -> DataFrame:
    return t.records.where(filters.period("Últimos 7 dias", AS_OF))


@query
def period_last_30(t: Inputs) -> DataFrame:
    return t.records.where(filters.period("Últimos 30 dias", AS_OF))


@query
def period_month(t: Inputs) -> DataFrame:
    return t.records.where(filters.period("Este mês", AS_OF))


@query
def filter_attributes(t: Inputs) -> DataFrame:
    labelled = identity.canonical_operator(t.records)
    return filters.by_attributes(labelled, operator="Óp0000007 Silva", status="Realizado Total")


@query
def filter_custom(t: Inputs) -> DataFrame:
    return filters.custom_report(t.records, "client 1.$", "Realizado Parcial", (AS_OF - timedelta(days=20)).date())


@query
def search_records(t: Inputs) -> DataFrame:
    return filters.search_records(t.records, "^óp0+1[0-3]|client 7$")


@query
def search_schedule(t: Inputs) -> DataFrame:
    return filters.search_schedule(t.schedule, "CLIENT 1[25]$")


@query
def schedule_visibility(t: Inputs) -> DataFrame:
    return identity.schedule_visibility(t.users, t.schedule)


@query
def visibility_bitmaps(t: Inputs) -> DataFrame:
    seen = identity.visibility_bitmaps(t.users, identity.operator_numbers(t.schedule))
    return seen.select("nome_busca", "faixa", F.bitmap_count("operadores").alias("operadores"))


@query
def lines_seen_by_viewer(t: Inputs) -> DataFrame:
    numbered = identity.operator_numbers(t.schedule)
    return identity.lines_seen_by(t.schedule, numbered, identity.visibility_bitmaps(t.users, numbered), " Óp0000001")


@query
def viewer_scopes(t: Inputs) -> DataFrame:
    return identity.viewer_scopes(t.users, t.schedule)


@query
def visible_schedule(t: Inputs) -> DataFrame:
    return identity.visible_schedule(t.schedule, " Óp000000", "Operador")


@query
def requests_split(t: Inputs) -> DataFrame:
    return requests.requests_report(requests.expire_requests(t.requests, REQUESTS_AS_OF))


@query
def request_counts(t: Inputs) -> DataFrame:
    return requests.request_counts(t.requests)


# --- plan against actuals ------------------------------------------------------------------

@query
def gap_detect_day(t: Inputs) -> DataFrame:
    return gaps.detect_gaps(t.schedule, t.records, GAP_DAY)


@query
def gap_detect_range(t: Inputs) -> DataFrame:
    return gaps.detect_gaps(t.schedule, t.records, GAP_START, GAP_END)


@query
def gap_summary(t: Inputs) -> DataFrame:
    return gaps.gap_summary(t.schedule, t.records, GAP_START, GAP_END)


@query
def gap_details(t: Inputs) -> DataFrame:
    return gaps.gap_details(t.schedule, t.records, GAP_DAY)


@query
def gap_fill_rows(t: Inputs) -> DataFrame:
    return gaps.gap_fill_rows(t.schedule, t.records, GAP_START, GAP_END)


@query
def gap_rows_numbered(t: Inputs) -> DataFrame:
    return gaps.number_rows(gaps.gap_fill_rows(t.schedule, t.records, GAP_START, GAP_END), t.records)


@query
def records_gap_filled(t: Inputs) -> DataFrame:
    return gaps.fill_gaps(t.schedule, t.records, GAP_START, GAP_END)


@query
def records_gap_stored(t: Inputs) -> DataFrame:
    """The gap rows stored without ids: the table numbers them."""
    root = scratch_path(t.spark, "gaps")
    days.replace_rows(t.records, root, days.FIRST_LOAD)
    missing = gaps.gap_fill_rows(t.schedule, days.current_records(t.spark, root), GAP_START, GAP_END)
    days.insert_rows(missing, root, 0, ["data_registro", "operador_nome", "cliente_nome"])
    return schemas.conform(days.current_records(t.spark, root), schemas.RECORDS)


# --- identity ------------------------------------------------------------------------------

@query
def resolve_operator(t: Inputs) -> DataFrame:
    return identity.resolve_operator(t.records, t.schedule)


@query
def records_plan_spelling(t: Inputs) -> DataFrame:
    return identity.with_plan_spelling(t.records, t.schedule).select("id", "operador_nome", "operador_escala")


@query
def canonical_operator(t: Inputs) -> DataFrame:
    return identity.canonical_operator(t.records).select("id", "op_key", "operador_exibicao")


@query
def names_without_account(t: Inputs) -> DataFrame:
    return identity.names_without_account(t.schedule, t.users)


@query
def names_without_account_collated(t: Inputs) -> DataFrame:
    return identity.names_without_account_collated(t.schedule, t.users)


@query
def spellings_by_collation(t: Inputs) -> DataFrame:
    return identity.spellings_by_collation(t.records)


@query
def assign_usernames(t: Inputs) -> DataFrame:
    return identity.assign_usernames(t.newcomers, t.taken_names)


@query
def request_contact_check(t: Inputs) -> DataFrame:
    return requests.contact_check(t.new_requests, t.users).select("id", "username", "verificacao")


@query
def users_by_department(t: Inputs) -> DataFrame:
    return users.users_by_department(t.users, t.departments)


# --- aggregates and rankings ---------------------------------------------------------------

@query
def kpi_dashboard(t: Inputs) -> DataFrame:
    return kpi.kpi_dashboard(t.records)


@query
def kpi_week(t: Inputs) -> DataFrame:
    return kpi.kpi_counts(t.records.where(filters.last_days(7, AS_OF)))


@query
def kpi_month(t: Inputs) -> DataFrame:
    return kpi.kpi_month(t.records.where(filters.in_month(AS_OF)))


@query
def status_distribution(t: Inputs) -> DataFrame:
    return kpi.status_distribution(t.records)


@query
def operator_efficiency(t: Inputs) -> DataFrame:
    return kpi.operator_efficiency(t.records)


@query
def operator_efficiency_week(t: Inputs) -> DataFrame:
    return kpi.operator_efficiency(t.records, filters.last_days(7, AS_OF))


@query
def insights(t: Inputs) -> DataFrame:
    return kpi.insights(t.records)


def _dashboard(t: Inputs) -> kpi.Dashboard:
    return kpi.dashboard(t.records, filters.period("Últimos 30 dias", AS_OF), status="Realizado Parcial", client="Client 7")


@query
def dashboard_kpi(t: Inputs) -> DataFrame:
    return _dashboard(t).kpi


@query
def dashboard_ranking(t: Inputs) -> DataFrame:
    return _dashboard(t).ranking


@query
def dashboard_trend(t: Inputs) -> DataFrame:
    return _dashboard(t).trend


@query
def operator_status_matrix(t: Inputs) -> DataFrame:
    return kpi.operator_status_matrix(t.records)


@query
def operator_status_wide(t: Inputs) -> DataFrame:
    return kpi.operator_status_wide(t.records)


@query
def daily_volume(t: Inputs) -> DataFrame:
    return kpi.daily_volume(t.records)


@query
def daily_efficiency(t: Inputs) -> DataFrame:
    return kpi.daily_efficiency(t.records)


@query
def filter_options(t: Inputs) -> DataFrame:
    return kpi.filter_options(t.records, t.schedule)


@query
def latest_records(t: Inputs) -> DataFrame:
    return kpi.latest_records(t.records)


@query
def latest_caption(t: Inputs) -> DataFrame:
    return kpi.latest_caption(t.records)


@query
def listing_caption(t: Inputs) -> DataFrame:
    """The caption as counted by the job that makes the listing."""
    caption = kpi.latest_with_caption(t.records)[1]
    return t.spark.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in caption.items()])


@query
def top_clients(t: Inputs) -> DataFrame:
    return kpi.top_clients(t.records)


# --- plan ----------------------------------------------------------------------------------

@query
def plan_long(t: Inputs) -> DataFrame:
    return plan.plan_long(t.schedule)


@query
def plan_clients_by_day(t: Inputs) -> DataFrame:
    return plan.plan_clients_by_day(t.schedule)


@query
def plan_clients_of_operator(t: Inputs) -> DataFrame:
    return plan.plan_clients(t.schedule, operator="óp0000001 Silva", day=WEEKDAYS[2])


@query
def plan_clients_all(t: Inputs) -> DataFrame:
    return plan.plan_clients(t.schedule)


@query
def plan_coverage(t: Inputs) -> DataFrame:
    return plan.plan_coverage(t.schedule)


@query
def day_agenda(t: Inputs) -> DataFrame:
    return plan.day_agenda(t.schedule, WEEKDAYS[0])


@query
def agenda_by_operator(t: Inputs) -> DataFrame:
    return plan.agenda_by_operator(t.schedule, WEEKDAYS[1]).withColumn("agenda", F.to_json("agenda"))


# --- users and requests --------------------------------------------------------------------

@query
def users_listing(t: Inputs) -> DataFrame:
    return users.users_listing(t.users)


@query
def latest_open_request(t: Inputs) -> DataFrame:
    return requests.latest_open_request(t.requests)


@query
def latest_authorized_request(t: Inputs) -> DataFrame:
    return requests.latest_authorized_request(t.requests)


@query
def requests_expired(t: Inputs) -> DataFrame:
    return requests.expire_requests(t.requests, REQUESTS_AS_OF)


@query
def request_intake(t: Inputs) -> DataFrame:
    return requests.intake(t.new_requests, t.users, t.requests, REQUESTS_AS_OF)


# --- batch changes -------------------------------------------------------------------------

@query
def ingest_records(t: Inputs) -> DataFrame:
    taken = changes.ingest_records(t.submissions, t.users, AS_OF)
    return numbering.number_missing(taken, numbering.highest_id(t.records, t.submissions), ["ordem"])


@query
def record_quality(t: Inputs) -> DataFrame:
    checked = changes.check_records(changes.ingest_records(t.submissions, t.users, AS_OF))
    return checked.select("ordem", F.array_join("violacoes", "; ").alias("violacoes"), "valido")


@query
def edit_diff(t: Inputs) -> DataFrame:
    return changes.edit_diff(t.edits, t.records)


@query
def edit_outcome(t: Inputs) -> DataFrame:
    return changes.edit_outcome(t.edits, t.records)


@query
def records_edited(t: Inputs) -> DataFrame:
    return changes.apply_edits(t.records, t.edits)


@query
def records_edited_in_place(t: Inputs) -> DataFrame:
    """The stored table after two batches of edits, with only the touched days written anew.

    The edits of a record come in one batch, so both ways to cut them give the same table.
    """
    root = scratch_path(t.spark, "edited")
    days.replace_rows(t.records, root, days.FIRST_LOAD)
    first = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    for batch, edits in enumerate((t.edits.where(first), t.edits.where(~first))):
        stored = schemas.conform(days.rows_with(t.spark, root, edits), schemas.RECORDS)
        days.replace_rows(changes.edited_rows(stored, edits), root, batch)
    return schemas.conform(days.current_records(t.spark, root), schemas.RECORDS)


@query
def records_patched(t: Inputs) -> DataFrame:
    return changes.apply_patches(t.records, t.patches)


@query
def patch_outcome(t: Inputs) -> DataFrame:
    return changes.judge_patches(t.patches, t.records)


@query
def delete_outcome(t: Inputs) -> DataFrame:
    return changes.judge_deletes(t.tombstones, t.records)


@query
def records_after_delete(t: Inputs) -> DataFrame:
    return changes.delete_by_id(t.records, t.tombstones)


@query
def plan_payload_outcome(t: Inputs) -> DataFrame:
    return changes.judge_plan_payloads(t.schedule, t.plan_payloads)


@query
def schedule_upserted(t: Inputs) -> DataFrame:
    return changes.upsert_schedule(t.schedule, t.plan_payloads, insert_unknown=True)


@query
def role_changes(t: Inputs) -> DataFrame:
    return users.judge_role_changes(t.role_changes, t.users)


@query
def users_after_role_changes(t: Inputs) -> DataFrame:
    return users.apply_role_changes(t.users, t.role_changes)


@query
def ingest_users(t: Inputs) -> DataFrame:
    return users.ingest_users(t.signups, t.users)


# --- request lifecycle and streams ---------------------------------------------------------

@query
def request_lifecycle(t: Inputs) -> DataFrame:
    return lifecycle.log_effects(t.request_log)


@query
def requests_from_log(t: Inputs) -> DataFrame:
    return lifecycle.requests_from_log(lifecycle.log_effects(t.request_log), AS_OF)


@query
def stream_daily_kpi(t: Inputs) -> DataFrame:
    root = scratch_path(t.spark, "daily")
    live.run_daily_kpi(t.stream("records"), f"{root}/saida", f"{root}/checkpoint")
    live.compact_daily_kpi(t.spark, f"{root}/saida")
    return live.daily_kpi(t.spark, f"{root}/saida")


@query
def stream_late_rows(t: Inputs) -> DataFrame:
    """Records arrive in two deliveries: what managers filled in comes last, dated all over the range."""
    root = scratch_path(t.spark, "late")
    second = F.col("status").eqNullSafe(NOT_REPORTED)
    for delivery in (t.records.where(~second), t.records.where(second)):
        delivery.write.mode("append").parquet(f"{root}/entrada")
        source = live.read_table_stream(t.spark, f"{root}/entrada", schemas.RECORDS)
        live.run_late_rows(source, root, f"{root}/checkpoint")
    return live.late_rows(t.spark, root)


@query
def stream_late_days(t: Inputs) -> DataFrame:
    return live.recompute_late_days(t.records, stream_late_rows(t))


def _ingested(t: Inputs) -> str:
    """The stored records after three deliveries of submissions, in the order they were made; ids known and unknown, repeated and missing in each."""
    root = scratch_path(t.spark, "ingest")
    days.replace_rows(t.records, f"{root}/registros", days.FIRST_LOAD)
    last = t.submissions.agg(F.max("ordem")).first()[0]
    place = F.col("ordem") * 3
    for delivery in (place <= last, (place > last) & (place <= 2 * last), place > 2 * last):
        rows = t.submissions.where(delivery)
        rows.write.mode("append").parquet(f"{root}/entrada")
        source = live.read_table_stream(t.spark, f"{root}/entrada", rows.schema)
        live.run_ingest(source, t.users, root, f"{root}/checkpoint", AS_OF, ACTOR)
    return root


@query
def stream_ingest(t: Inputs) -> DataFrame:
    return schemas.conform(days.current_records(t.spark, f"{_ingested(t)}/registros"), schemas.RECORDS)


@query
def audit_from_stream(t: Inputs) -> DataFrame:
    return schemas.conform(t.spark.read.parquet(f"{_ingested(t)}/auditoria"), schemas.AUDIT)


@query
def stream_repeats(t: Inputs) -> DataFrame:
    """Deliveries that overlap by two days; rows without a date count as of the end and come last."""
    root = scratch_path(t.spark, "repeats")
    rows = t.records.withColumn("momento", dates.event_time(dates.fill_missing_date("data_registro", AS_OF)))
    dated = F.col("data_registro")
    for start, stop in ((0, 12), (10, 22), (20, 40)):
        own = dated.between(dates.instant(MONTH + timedelta(days=start)), dates.instant(MONTH + timedelta(days=stop)))
        rows.where(own | (dated.isNull() if stop == 40 else F.lit(False))).write.mode("append").parquet(f"{root}/entrada")
        source = live.read_table_stream(t.spark, f"{root}/entrada", rows.schema)
        live.run_append(live.without_repeats(source, ["id"], "momento", "3 days"), f"{root}/saida", f"{root}/checkpoint")
    return schemas.conform(t.spark.read.parquet(f"{root}/saida"), schemas.RECORDS)


def _lifecycle_stream(t: Inputs) -> DataFrame:
    """The log in three deliveries, each read by a query that starts anew; an event of nobody, long after, closes the last."""
    root = scratch_path(t.spark, "lifecycle")
    log = t.request_log
    last, newest = log.agg(F.max("id"), F.max("quando")).first()
    long_after = max(MONTH, newest or MONTH) + timedelta(days=400)
    end = t.spark.createDataFrame([(None, None, long_after, "fim")], log.schema)
    place = F.col("id") * 3
    for delivery in (log.where(place <= last), log.where((place > last) & (place <= 2 * last)), log.where(place > 2 * last).unionByName(end)):
        delivery.write.mode("append").parquet(f"{root}/entrada")
        source = live.read_table_stream(t.spark, f"{root}/entrada", log.schema)
        approvals.run_effects(source, f"{root}/saida", f"{root}/checkpoint")
    return t.spark.read.parquet(f"{root}/saida").drop(days.BATCH)


@query
def stream_request_lifecycle(t: Inputs) -> DataFrame:
    return _lifecycle_stream(t).where(F.col("efeito") != approvals.OVER)


@query
def stream_grants_run_out(t: Inputs) -> DataFrame:
    over = _lifecycle_stream(t).where(F.col("efeito") == approvals.OVER)
    return over.select("usuario", "solicitacao_id", F.col("quando").alias("expira_em"))


@query
def stream_gaps(t: Inputs) -> DataFrame:
    """Three deliveries of plan days, known some days ahead, and of records. Days of the range are closed by the end."""
    root = scratch_path(t.spark, "gaps")
    planned = gaps.plan_days(t.schedule, GAP_START, GAP_END + timedelta(days=9))
    moment, far = F.col("data_registro"), datetime(2100, 1, 1)
    edges = [datetime(1900, 1, 1), datetime(2024, 1, 11), datetime(2024, 1, 19), far]
    for start, stop in zip(edges, edges[1:]):
        ahead = [F.lit((e + timedelta(days=4)).date()) for e in (start, stop)]
        planned.where((F.col("dia") >= ahead[0]) & (F.col("dia") < ahead[1])).write.mode("append").parquet(f"{root}/plano")
        t.records.where((moment >= dates.instant(start)) & (moment < dates.instant(stop))).write.mode("append").parquet(f"{root}/entrada")
        waiting = live.read_table_stream(t.spark, f"{root}/plano", planned.schema)
        arrived = live.read_table_stream(t.spark, f"{root}/entrada", schemas.RECORDS)
        live.run_append(live.closing_gaps(waiting, arrived), f"{root}/saida", f"{root}/checkpoint")
    return t.spark.read.parquet(f"{root}/saida").drop(days.BATCH).where(F.col("dia") <= F.lit(GAP_END))


@query
def stream_series_corrected(t: Inputs) -> DataFrame:
    """What managers filled in comes last, dated all over the range; the live series drops most of it."""
    root = scratch_path(t.spark, "series")
    second = F.col("status").eqNullSafe(NOT_REPORTED)
    for delivery in (t.records.where(~second), t.records.where(second)):
        delivery.coalesce(1).write.mode("append").parquet(f"{root}/entrada")
        for name in ("vivo", "atraso"):
            source = live.read_table_stream(t.spark, f"{root}/entrada", schemas.RECORDS, files_per_batch=1)
            if name == "vivo":
                live.run_daily_kpi(source, f"{root}/vivo", f"{root}/checkpoint-vivo")
            else:
                live.run_late_days(source, lambda: t.spark.read.schema(schemas.RECORDS).parquet(f"{root}/entrada"), f"{root}/atraso", f"{root}/checkpoint-atraso")
    return live.corrected_series(t.spark, f"{root}/vivo", f"{root}/atraso")


@query
def stream_request_expiry(t: Inputs) -> DataFrame:
    root = scratch_path(t.spark, "expiry")
    live.run_expiry(live.approval_events(t.stream("requests")), f"{root}/saida", f"{root}/checkpoint")
    return live.settled(t.spark, f"{root}/saida")
