"""Live versions of the reports, as Structured Streaming jobs.

Event time needs ``timestamp``, while the tables hold zoneless times; they are read as UTC whatever
the session zone. Every job stops once the waiting input is processed (``availableNow``) and picks
up from its checkpoint at the next start.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shiftledger.functions.dates import event_day, event_time
from shiftledger.functions.domain import APPROVAL_MINUTES, EXPIRED, FULL, USED
from shiftledger.functions.measures import count_known, count_status, pct
from shiftledger.functions.text import match_key
from shiftledger.operators import audit, changes, kpi
from shiftledger.operators.numbering import highest_id
from shiftledger.session import cut_lineage
from shiftledger.sources import days
from shiftledger.sources.days import BATCH, exists, folders, write_batch

LATENESS = "48 hours"  # hours, because calendar days depend on the session zone


def read_table_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; the pattern picks one table of a shared folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _read_once(sink):
    """Keep a batch while its sink reads it more than once."""

    def kept(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            sink(df, batch)
        finally:
            df.unpersist()

    return kept


def _run(df: DataFrame, mode: str, checkpoint: str, sink) -> StreamingQuery:
    query = (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(sink).start()
    )
    query.awaitTermination()
    return query


def run_append(rows: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream gives, a folder per batch."""
    return _run(rows, "append", checkpoint, lambda df, batch: write_batch(df, root, batch))


# --- live daily KPI ------------------------------------------------------------------------

def daily_counts(records: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Counts per day over a stream of records; days behind the watermark are final."""
    return (
        records.where(F.col("data_registro").isNotNull())
        .withColumn("momento", event_time("data_registro"))
        .withWatermark("momento", lateness)
        .groupBy(F.window("momento", "1 day").alias("janela"))
        .agg(F.count("*").alias("quantidade"), count_known().alias("total"), count_status(FULL).alias("realizados"))
        .select(event_day("janela.start").alias("dia"), "quantidade", "total", "realizados")
    )


def run_daily_kpi(records: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    return _run(daily_counts(records), "update", checkpoint, lambda df, batch: write_batch(df, root, batch))


def compact_daily_kpi(spark: SparkSession, root: str) -> None:
    """Put the newest counts of all batches so far into one folder; older batches are then skipped.

    Days behind the watermark are final, so this is all that is ever needed of them.
    """
    done = [int(f.split("=")[1]) for f in folders(spark, root) if f.startswith(f"{BATCH}=")]
    if done:
        newest = _newest_counts(spark, root).withColumn("ate", F.lit(max(done)))
        newest.coalesce(1).write.mode("overwrite").parquet(f"{root}-resumo/ate={max(done)}")


def _newest_counts(spark: SparkSession, root: str) -> DataFrame:
    fields = ["quantidade", "total", "realizados"]
    summaries = sorted(int(f.split("=")[1]) for f in folders(spark, f"{root}-resumo") if exists(spark, f"{root}-resumo/{f}/_SUCCESS"))
    upto = summaries[-1] if summaries else -1
    later = [f"{root}/{f}" for f in folders(spark, root) if f.startswith(f"{BATCH}=") and int(f.split("=")[1]) > upto]
    parts = []
    if summaries:
        parts.append(spark.read.parquet(f"{root}-resumo/ate={upto}").select("dia", *fields, F.lit(upto).alias(BATCH)))
    if later:
        parts.append(spark.read.option("basePath", root).parquet(*later).select("dia", *fields, BATCH))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("dia").agg(F.max_by(F.struct(*fields), BATCH).alias("_atual")).select("dia", "_atual.*")


def daily_kpi(spark: SparkSession, root: str) -> DataFrame:
    """The current series: the newest counts of each day, from the last summary and the batches after it."""
    return _newest_counts(spark, root).withColumn("eficiencia", pct("realizados", "total"))


# --- back-dated records --------------------------------------------------------------------

_MARK = T.StructType([T.StructField("maior", T.TimestampType())])


def _limit(spark: SparkSession, root: str, batch: int, lateness: str) -> tuple[DataFrame, Column]:
    """The highest time of all earlier batches, and what that leaves the watermark at."""
    if batch > 0:
        mark = spark.read.schema(_MARK).parquet(f"{root}/marcas/{BATCH}={batch - 1}")
    else:
        mark = spark.createDataFrame([(None,)], _MARK)
    epoch = F.timestamp_micros(F.lit(0))  # where the first watermark stands
    return mark, mark.select(F.coalesce(F.max("maior") - F.expr(f"INTERVAL {lateness}"), epoch)).scalar()


def _write_mark(timed: DataFrame, mark: DataFrame, root: str, batch: int) -> None:
    highest = timed.agg(F.max("momento").alias("maior")).unionByName(mark).agg(F.max("maior").alias("maior"))
    write_batch(highest.coalesce(1), f"{root}/marcas", batch)


def run_late_rows(records: DataFrame, root: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Set aside the rows that the live aggregate drops: older than all earlier batches allow.

    The highest time seen so far is kept per batch in a one-row table, so a restart and a repeated
    batch see the same limit.
    """

    def sink(df: DataFrame, batch: int) -> None:
        timed = df.where(F.col("data_registro").isNotNull()).withColumn("momento", event_time("data_registro"))
        mark, limit = _limit(df.sparkSession, root, batch, lateness)
        write_batch(timed.where(F.col("momento") < limit).drop("momento"), f"{root}/atrasados", batch)
        _write_mark(timed, mark, root, batch)

    return _run(records, "append", checkpoint, _read_once(sink))


def run_late_days(
    records: DataFrame, everything: Callable[[], DataFrame], root: str, checkpoint: str, lateness: str = LATENESS
) -> StreamingQuery:
    """Count the closed days anew that a batch brings rows for; ``everything`` reads the whole table, the batch included.

    A day is closed once the watermark has passed its end: from then on the live aggregate drops its rows. A batch writes the days it counted
    into its own folder, so a repeated batch counts once. The stream must come in the same batches as the live one (same files per batch).
    """

    def sink(df: DataFrame, batch: int) -> None:
        timed = df.where(F.col("data_registro").isNotNull()).withColumn("momento", event_time("data_registro"))
        mark, limit = _limit(df.sparkSession, root, batch, lateness)
        ends = event_time(F.date_add(F.to_date("data_registro"), 1).cast("timestamp_ntz"))
        closed = timed.where(ends <= limit).select(F.to_date("data_registro").alias("dia")).distinct()
        counted = kpi.daily_counts(everything()).join(closed, "dia", "left_semi")
        write_batch(counted, f"{root}/recontados", batch)
        _write_mark(timed, mark, root, batch)

    return _run(records, "append", checkpoint, _read_once(sink))


def corrected_series(spark: SparkSession, live: str, late: str) -> DataFrame:
    """The live series with the days laid over it that late rows made count anew; of several counts of a day the newest stands."""
    fields = ["quantidade", "total", "realizados"]
    again = spark.read.option("basePath", f"{late}/recontados").parquet(f"{late}/recontados")
    rows = _newest_counts(spark, live).withColumn("_vez", F.lit(-1)).unionByName(again.withColumnRenamed(BATCH, "_vez"))
    newest = rows.groupBy("dia").agg(F.max_by(F.struct(*fields), "_vez").alias("_atual"))
    return newest.select("dia", "_atual.*").withColumn("eficiencia", pct("realizados", "total"))


def dropped_rows(query: StreamingQuery) -> int:
    """How many rows a finished run found behind its watermark."""
    return sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in p["stateOperators"])


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/atrasados").drop(BATCH)


def recompute_late_days(records: DataFrame, late: DataFrame) -> DataFrame:
    """The daily series from the whole table, for the days that late rows belong to."""
    days = late.select(F.to_date("data_registro").alias("dia")).distinct()
    return kpi.daily_efficiency(records).join(days, "dia", "left_semi")


# --- gaps as days close --------------------------------------------------------------------

def closing_gaps(planned: DataFrame, records: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Planned pairs that nobody reported, each once its day is closed for both streams.

    ``planned`` is a stream of ``gaps.plan_days``. A pair waits for a report of its day; what still waits when the watermark passes the end of
    the day comes out. The watermark is the lesser of both streams, so plan days must keep coming, some days ahead: after a restart a stream
    that brings nothing holds it where it was. State holds the open days.
    """
    plan = planned.withColumn("abre", event_time(F.col("dia").cast("timestamp_ntz"))).withWatermark("abre", lateness)
    day = F.expr("INTERVAL 24 HOURS")
    told = records.where(F.col("data_registro").isNotNull()).select(
        F.to_date("data_registro").alias("_dia"), match_key("operador_nome").alias("_op"), match_key("cliente_nome").alias("_cli"),
        event_time("data_registro").alias("momento"),
    )
    told = without_repeats(told, ["_dia", "_op", "_cli"], "momento", lateness)
    same = (F.col("dia") == F.col("_dia")) & (F.col("op_chave") == F.col("_op")) & (F.col("cli_chave") == F.col("_cli"))
    in_time = (F.col("momento") >= F.col("abre")) & (F.col("momento") < F.col("abre") + day)
    # Asked of both sides at once: asked of the plan alone, the lines of the days would be gone before the watermark sees them.
    missing = F.when(F.col("_dia").isNull(), F.col("linha_id")).isNotNull()
    return plan.join(told, same & in_time, "left_outer").where(missing).select("dia", "linha_id", "operador", "cliente")


# --- change ingest -------------------------------------------------------------------------

def without_repeats(rows: DataFrame, keys: list[str], moment: str, lateness: str = LATENESS) -> DataFrame:
    """A stream in which rows of equal keys come once, as long as they are no further apart than ``lateness``.

    ``moment`` is an event time (``timestamp``). Keys are forgotten once the watermark has passed them, so the state holds the keys of
    that span; a row behind the watermark does not come at all.
    """
    return rows.withWatermark(moment, lateness).dropDuplicatesWithinWatermark(keys)


def run_ingest(
    submissions: DataFrame, users: DataFrame, root: str, checkpoint: str, as_of: datetime, actor: audit.Actor | None = None
) -> StreamingQuery:
    """Ingest submissions into ``registros``: new records get the next free ids, known ones are replaced (``changes.settle``).

    What breaks the rules or names no record is set aside in ``quarentena``; ``auditoria`` gets a row for every record made or changed. All three
    are written per batch and replaced if a batch is repeated, so each change counts once. Rows that were there before the
    stream are loaded as batch ``days.FIRST_LOAD``. Pass the stream through ``without_repeats`` if deliveries can repeat.
    """
    table = f"{root}/registros"
    actor = actor or audit.Actor("ingestao", as_of)

    def sink(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        checked = cut_lineage(changes.check_records(changes.ingest_records(df, users, as_of)))
        good = F.col("valido") & F.col("aceito")
        taken = checked.where(good)
        stored = cut_lineage(days.rows_with(spark, table, taken.where("id IS NOT NULL"), before=batch))
        changed, unknown = changes.settle(taken, stored, highest_id(days.current_records(spark, table, before=batch)))
        changed = cut_lineage(changed)
        days.replace_rows(changed, table, batch, stored)
        write_batch(audit.of_submissions(changed, stored, actor), f"{root}/auditoria", batch)
        refused = checked.where(~good).select("id", *changes.CONTENT, "ordem", "violacoes").unionByName(
            unknown.withColumn("violacoes", F.array(F.lit(changes.NO_RECORD)))
        )
        write_batch(refused, f"{root}/quarentena", batch)

    return _run(submissions, "append", checkpoint, sink)


# --- expiry timers -------------------------------------------------------------------------

def approval_events(requests: DataFrame) -> DataFrame:
    """Grant and use of each request as events."""
    return requests.select("id", "username", F.inline(F.array(
        F.struct(F.lit("autorizar").alias("acao"), F.col("autorizado_em").alias("quando")),
        F.struct(F.lit("usar").alias("acao"), F.col("usado_em").alias("quando")),
    ))).where("quando IS NOT NULL")


def settled_approvals(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each granted request once its ten minutes are over for the stream: used in time, or expired.

    A session per request stays open until the watermark passes its expiry, which is the timer.
    Use at the very instant of expiry still counts, hence the extra microsecond.
    """

    def first(action: str) -> Column:
        return F.min(F.when(F.col("acao") == action, F.col("quando")))

    window = F.expr(f"INTERVAL '{APPROVAL_MINUTES}' MINUTE")
    return (
        events.withColumn("momento", event_time("quando")).withWatermark("momento", lateness)
        .groupBy("id", "username", F.session_window("momento", f"{APPROVAL_MINUTES} minutes 1 microsecond"))
        .agg(first("autorizar").alias("autorizado_em"), first("usar").alias("_uso"))
        .where(F.col("autorizado_em").isNotNull())
        .withColumn("expira_em", F.col("autorizado_em") + window)
        .withColumn("usado_em", F.when(F.col("_uso").between(F.col("autorizado_em"), F.col("expira_em")), F.col("_uso")))
        .select(
            "id", "username", "autorizado_em", "expira_em", "usado_em",
            F.when(F.col("usado_em").isNotNull(), USED).otherwise(EXPIRED).alias("status"),
        )
    )


def run_expiry(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    return _run(settled_approvals(events), "append", checkpoint, lambda df, batch: write_batch(df, root, batch))


def settled(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).drop(BATCH)
