import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace
from unittest import mock

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from test_lifecycle import brute_force, make_log
from rows import FULL, MONDAY, PARTIAL, explain, records, values
from shiftledger.operators import kpi
from shiftledger.plans import catalog
from shiftledger.plans.catalog import ENVELOPE_ROW
from shiftledger.operators import audit, changes, gaps, numbering
from shiftledger.sources import days, schemas, tables
from shiftledger.streaming import approvals, live


def test_envelope_files(spark, tmp_path):
    rows = [{"id": i, "operador_nome": f"o{i}", "status": FULL, "mais": 1} for i in range(4)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:2], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"data": rows[2:], "total": 2}))
    (tmp_path / "c.json").write_text(json.dumps({"data": []}))
    got = tables.read_envelopes(spark, str(tmp_path), ENVELOPE_ROW)
    assert sorted(values(got)) == [(i, f"o{i}", FULL) for i in range(4)]


def test_csv_keeps_text(spark, tmp_path):
    text = 'a, "b"\nc\\d '
    df = records(spark, [(1, datetime(2024, 1, 1, 1, 2, 3, 456789), " Zé ", "c", FULL, text), (2, None, None, "c", FULL, "")])
    path = str(tmp_path / "csv")
    assert tables.export_csv(df, path) == 2
    rows = {r.id: r for r in tables.read_csv(spark, path, schemas.RECORDS).collect()}
    assert (rows[1].justificativa, rows[1].operador_nome, rows[1].data_registro) == (text, " Zé ", datetime(2024, 1, 1, 1, 2, 3, 456789))
    assert (rows[2].data_registro, rows[2].operador_nome) == (None, None)


def test_counts_come_from_the_job_that_writes(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = records(spark, [(i, MONDAY, "a", "c", FULL) for i in range(70)])
    counted = df.mapInArrow(told, df.schema)
    saved = tables.write_snapshot({"a": counted, "b": df.limit(3), "c": df.where("false")}, str(tmp_path / "s"), MONDAY)
    assert sorted(values(saved.manifest(spark))) == [("a", 70), ("b", 3), ("c", 0)] and reads.value == 70
    assert spark.read.parquet(f"{saved.base}/tabela=a").count() == 70
    rows, caption = kpi.latest_with_caption(counted, 50)
    assert reads.value == 140 and len(rows) == 50 and caption == {"exibidos": 50, "total": 70}
    assert kpi.latest_with_caption(df.limit(3))[1] == {"exibidos": 3, "total": 3}


def test_partitioned_records(spark, tmp_path):
    path = str(tmp_path / "r")
    df = records(spark, [(1, MONDAY, "a", "c", FULL), (2, MONDAY + timedelta(days=3), "a", "c", FULL), (3, None, "a", "c", FULL)])
    tables.write_records(df, path)
    assert sorted(values(tables.read_records(spark, path), "id")) == [(1,), (2,), (3,)]
    part = tables.read_records(spark, path, start=MONDAY, end=MONDAY + timedelta(days=1))
    assert values(part, "id") == [(1,)]
    plan = explain(part)
    assert "PartitionFilters: [isnotnull(dia" in plan
    assert "GreaterThanOrEqual(data_registro" in plan and "LessThan(data_registro" in plan


def test_conform_adds_and_casts(spark):
    df = spark.createDataFrame([("7", "ruim", 1)], "id string, data_registro string, extra int")
    got = schemas.conform(df, schemas.RECORDS)
    assert got.schema.names == schemas.RECORDS.names and values(got, "id", "data_registro", "status") == [(7, None, None)]
    assert schemas.with_report_date(df).schema["data_dt"].dataType.typeName() == "timestamp_ntz"
    assert values(schemas.with_report_date(df.select("id")), "data_dt") == [(None,)]


def deliver(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return live.read_table_stream(spark, folder, schemas.RECORDS)


def test_live_series_over_several_deliveries(spark, tmp_path):
    inbox, out, marks = (str(tmp_path / n) for n in ("in", "out", "late"))
    first = records(spark, [(i, MONDAY + timedelta(hours=7 * i), "a", "c", FULL if i % 2 else PARTIAL) for i in range(12)])
    second = records(spark, [(100, MONDAY + timedelta(days=3), "a", "c", None), (101, MONDAY - timedelta(days=8), "a", "c", FULL), (102, None, "a", "c", FULL)])
    dropped = 0
    for batch in (first, second):
        deliver(batch, inbox)
        query = live.run_daily_kpi(stream(spark, inbox), out, str(tmp_path / "cp1"))
        dropped += live.dropped_rows(query)
        live.run_late_rows(stream(spark, inbox), marks, str(tmp_path / "cp2"))
    everything = first.unionByName(second)
    on_time = everything.where("id <> 101")
    assert sorted(values(live.daily_kpi(spark, out))) == sorted(values(kpi.daily_efficiency(on_time)))
    late = live.late_rows(spark, marks)
    assert dropped == 1 and values(late, "id") == [(101,)]
    again = live.recompute_late_days(everything, late)
    assert values(again, "quantidade", "realizados") == [(1, 1)]


def test_live_days_do_not_depend_on_the_session_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [(1, datetime(2018, 11, 4, 0, 30), "a", "c", FULL), (2, datetime(2018, 11, 4, 23, 59), "a", "c", PARTIAL), (3, datetime(1969, 12, 31, 23, 0), "a", "c", FULL)]
    deliver(records(spark, rows), str(tmp_path / "in"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        live.run_daily_kpi(stream(spark, str(tmp_path / "in")), str(tmp_path / "o"), str(tmp_path / "c"))
        live.run_late_rows(stream(spark, str(tmp_path / "in")), str(tmp_path / "l"), str(tmp_path / "c2"))
        got = sorted((r.dia.isoformat(), r.total, r.realizados) for r in live.daily_kpi(spark, str(tmp_path / "o")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [("2018-11-04", 2, 1)]
    assert values(live.late_rows(spark, str(tmp_path / "l")), "id") == [(3,)]  # a first watermark stands at 1970


def stored(spark, root, *more):
    return sorted(values(days.current_records(spark, root), "id", "operador_nome", "dia", *more))


def test_rows_are_replaced_move_and_survive_a_repeat(spark, tmp_path):
    root, day = str(tmp_path / "t"), timedelta(days=1)
    base = records(spark, [(1, MONDAY, "a", "c", FULL), (2, MONDAY, "a", "c", FULL), (3, MONDAY + day, "a", "c", FULL), (9, None, "a", "c", FULL)])
    days.replace_rows(base, root, days.FIRST_LOAD)
    change = records(spark, [(3, MONDAY + 2 * day, "b", "c", PARTIAL), (2, MONDAY, "b", "c", FULL), (4, MONDAY, "b", "c", FULL)])
    wanted = [(1, "a", "2024-01-15"), (2, "b", "2024-01-15"), (3, "b", "2024-01-17"), (4, "b", "2024-01-15"), (9, "a", tables.NO_DAY)]
    for _ in range(2):  # the second run stands for a repeated batch
        days.replace_rows(change, root, 0)
        assert stored(spark, root) == wanted  # the day that lost its only row is empty now
    days.replace_rows(records(spark, []), root, 1)
    assert stored(spark, root) == wanted
    (tmp_path / "t" / "lote=2" / "dia=2024-01-15").mkdir(parents=True)  # a batch that was not finished
    assert stored(spark, root) == wanted


def test_a_batch_writes_and_reads_only_its_days(spark, tmp_path):
    root, day = str(tmp_path / "t"), timedelta(days=1)
    days.replace_rows(records(spark, [(i, MONDAY + (i % 20) * day, "a", "c", FULL) for i in range(400)]), root, days.FIRST_LOAD)
    for batch in (0, 1, 2):
        found = days.rows_with(spark, root, spark.createDataFrame([(7,)], "id bigint"))
        assert found.count() == 1 and len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) == 1
        days.replace_rows(records(spark, [(7, MONDAY + (8 + batch) * day, "b", "c", FULL)]), root, batch)
        assert len(days.folders(spark, f"{root}/lote={batch}")) == 2
    assert days.current_records(spark, root).count() == 400 and "Join" not in explain(days.current_records(spark, root))


SUBMITTED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.RECORDS) + ", ordem bigint"


def submit(spark, root, batch, rows):
    df = spark.createDataFrame(rows, SUBMITTED)
    stored_rows = days.rows_with(spark, root, df.where("id IS NOT NULL"), before=batch)
    changed, unknown = changes.settle(df, stored_rows, numbering.highest_id(days.current_records(spark, root, before=batch)))
    refused = sorted(values(unknown, "id", "ordem"))
    days.replace_rows(changed, root, batch)
    return refused


def test_cuts_into_batches_do_not_matter(spark, tmp_path):
    """Known and unknown ids, none, ids that an earlier submission made, and several of one place."""
    rows = []
    for i in range(60):
        number = [None, 1 + i % 4, 10 + i % 3, 4 + i // 8, None, 777][i % 6]
        rows.append((number, MONDAY + timedelta(days=i % 3), f"o{i:02d}", "c", FULL, "n", None, "Pendente", i - i % 2))
    tables_made, refused = [], []
    for n, cuts in enumerate(([0, 60], [0, 11, 60], [0, 12, 26, 60], [0, 7, 21, 22, 60])):
        root = str(tmp_path / str(n))
        days.replace_rows(records(spark, [(i, MONDAY, "base", "c", FULL) for i in range(1, 5)]), root, days.FIRST_LOAD)
        refused.append(sorted(x for batch, (a, b) in enumerate(zip(cuts, cuts[1:])) for x in submit(spark, root, batch, rows[a:b])))
        tables_made.append(sorted(values(days.current_records(spark, root), *schemas.RECORDS.names, "ordem")))
    assert tables_made[0] == tables_made[1] == tables_made[2] == tables_made[3]
    assert len(tables_made[0]) == 4 + sum(r[0] is None for r in rows)  # no row without an id is lost
    assert all((777, o) in refused[0] for o in (4, 10, 16)) and {x[0] for x in refused[0]} >= {777}


def test_no_row_is_lost_between_batches(spark, tmp_path):
    row = lambda number, name, place: (number, MONDAY, name, "c", FULL, "n", None, "Pendente", place)
    for n, cut in enumerate(([[row(10, "a", 1), row(None, "b", 2), row(11, "c", 3)]], [[row(10, "a", 1), row(None, "b", 2)], [row(11, "c", 3)]])):
        root = str(tmp_path / str(n))
        days.replace_rows(records(spark, [(10, MONDAY, "x", "c", FULL)]), root, days.FIRST_LOAD)
        for batch, part in enumerate(cut):
            submit(spark, root, batch, part)
        assert [x[:2] for x in stored(spark, root)] == [(10, "a"), (11, "c")]  # 11 is the new record, which the third one names
    root = str(tmp_path / "equal")
    days.replace_rows(records(spark, [(1, MONDAY, "x", "c", FULL)]), root, days.FIRST_LOAD)
    submit(spark, root, 0, [row(1, "A", 5)])
    submit(spark, root, 1, [row(1, "B", 5), row(1, "C", 4), row(None, "new", None), row(None, "new", None)])
    submit(spark, root, 2, [row(1, "A", 5), row(2, "late", -1)])
    assert [x[:2] for x in stored(spark, root)] == [(1, "B"), (2, "late"), (3, "new")]


def test_compaction_keeps_the_series(spark, tmp_path):
    inbox, out, marks = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for i in range(4):
        deliver(records(spark, [(i, MONDAY + timedelta(days=i), "a", "c", FULL), (i + 10, MONDAY, "a", "c", PARTIAL)]), inbox)
        live.run_daily_kpi(stream(spark, inbox), out, marks)
        if i in (1, 2):
            series = sorted(values(live.daily_kpi(spark, out)))
            live.compact_daily_kpi(spark, out)
            assert sorted(values(live.daily_kpi(spark, out))) == series
    read = {f.split("lote=")[1].split("/")[0] for f in live.daily_kpi(spark, out).inputFiles() if "lote=" in f}
    assert len(read) < len(days.folders(spark, out))  # what the summary holds is not read again
    assert sum(r.quantidade for r in live.daily_kpi(spark, out).collect()) == 8


INBOX = (
    "id bigint, username string, cliente_nome string, cliente string, status string, justificativa string, operador_nome string, data_registro string, "
    "ordem bigint, chegada timestamp"
)


def test_ingest_sets_aside_and_audits_once(spark, tmp_path):
    people = spark.createDataFrame([("ana", "Ana", "Operador")], "username string, nome string, role string")
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    days.replace_rows(records(spark, [(1, MONDAY, "Ana", "C", FULL, "")]), f"{root}/registros", days.FIRST_LOAD)
    deliveries = [
        [(1, "ana", "C", None, FULL, "", None, "2024-01-15", 1, None), (2, "ana", "", None, FULL, "", None, None, 2, None), (3, "x", "C", None, FULL, "", None, None, 3, None),
         (None, "ana", "N", None, FULL, "", None, "2024-01-17", 4, None), (50, "ana", "C", None, FULL, "", None, None, 5, None)],
        [(1, "ana", "C2", None, FULL, "", None, "2024-01-16", 6, None), (1, "ana", "C2", None, FULL, "", None, "2024-01-16", 6, None),
         (2, "ana", "N2", None, FULL, "", None, "2024-01-17", 7, None)],
    ]
    for repeat in ("a", "b"):  # with a new checkpoint all batches come once more
        for n, rows in enumerate(deliveries):
            folder = f"{inbox}-{repeat}"
            deliver(spark.createDataFrame(rows, INBOX), folder)
            source = live.read_table_stream(spark, folder, spark.createDataFrame([], INBOX).schema, files_per_batch=1)
            live.run_ingest(source, people, root, str(tmp_path / f"cp-{repeat}"), MONDAY, audit.Actor("eu", MONDAY))
            if n == 1:
                assert sorted(values(days.current_records(spark, f"{root}/registros"), "id", "cliente_nome", "dia")) == [(1, "C2", "2024-01-16"), (2, "N2", "2024-01-17")]
    refused = sorted((r.id, list(r.violacoes)) for r in spark.read.parquet(f"{root}/quarentena").collect())
    assert [i for i, _ in refused] == [2, 3, 50] and refused[2][1] == [changes.NO_RECORD]
    trail = sorted(r.detalhes for r in spark.read.parquet(f"{root}/auditoria").collect())
    assert trail == [
        "registro 1; cliente_nome: C -> C2; data_registro: 2024-01-15 12:00:00 -> 2024-01-16 12:00:00", "registro 1; data_registro: 2024-01-15 09:30:00 -> 2024-01-15 12:00:00",
        "registro 2; cliente_nome: N -> N2", "registro 2; operador_nome: Ana; cliente_nome: N; status: Realizado Total; data_registro: 2024-01-17 12:00:00"]


def test_repeats_come_once(spark, tmp_path):
    kind = "id bigint, momento timestamp"
    hour = timedelta(hours=1)
    deliveries = [
        [(1, MONDAY), (1, MONDAY), (2, MONDAY + hour)], [(1, MONDAY), (2, MONDAY + 2 * hour), (3, MONDAY + 50 * hour)],
        [(3, MONDAY + 50 * hour), (4, MONDAY - 90 * hour), (1, MONDAY + 51 * hour)],
    ]
    for rows in deliveries:
        deliver(spark.createDataFrame(rows, kind), str(tmp_path / "in"))
        source = live.read_table_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema)
        live.run_append(live.without_repeats(source, ["id"], "momento", "24 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = sorted(values(spark.read.parquet(str(tmp_path / "out")), "id", "lote"))
    # 4 lies behind the watermark; 1 has been forgotten by then.
    assert [i for i, _ in found] == [1, 1, 2, 3] and len({b for i, b in found if i == 1}) == 2


def test_gaps_come_out_when_their_day_closes(spark, tmp_path):
    plan = spark.createDataFrame(
        [(1, " Ana ", "MANHÃ", "A", "B", "-", "-", "-"), (2, "Bia", "MANHÃ", "C", "D", "E", "-", "-")],
        "id bigint, operador string, periodo string, segunda string, terca string, quarta string, quinta string, sexta string",
    )
    day, monday = timedelta(days=1), MONDAY.date()
    pairs = gaps.plan_days(plan, monday, monday + 8 * day)
    arrived = [
        [(1, MONDAY, "ana", " a", FULL), (2, MONDAY, "ana", "a", FULL)], [(3, MONDAY + day, "BIA", "d", FULL), (4, MONDAY + 3 * day, "x", "y", FULL)],
        [(5, MONDAY + 7 * day, "z", "z", FULL)],
    ]
    told = []
    for n, rows in enumerate(arrived):
        deliver(pairs.where(pairs.dia.between(monday + 3 * n * day, monday + (3 * n + 2) * day)), str(tmp_path / "plan"))
        deliver(records(spark, rows), str(tmp_path / "in"))
        missing = live.closing_gaps(live.read_table_stream(spark, str(tmp_path / "plan"), pairs.schema), stream(spark, str(tmp_path / "in")), "12 hours")
        live.run_append(missing, str(tmp_path / "out"), str(tmp_path / "cp"))
        told.append(sorted(values(spark.read.schema(missing.schema).parquet(str(tmp_path / "out")), "dia", "operador", "cliente")))
    everything = records(spark, [r for rows in arrived for r in rows])
    wanted = sorted(values(gaps.detect_gaps(plan, everything, monday, monday + 6 * day), "dia", "operador", "cliente"))
    assert told[0] == [] and told[1] == [x for x in wanted if x[0] < monday + 2 * day] and told[2] == wanted and len(wanted) == 3


def test_late_days_are_laid_over_the_series(spark, tmp_path):
    inbox, day = str(tmp_path / "in"), timedelta(days=1)
    deliveries = [
        [(i, MONDAY + i * day / 2, "a", "c", FULL if i % 2 else PARTIAL) for i in range(12)],
        [(100, MONDAY, "a", "c", FULL), (101, MONDAY + 5 * day, "a", "c", PARTIAL), (102, MONDAY - 30 * day, "a", "c", None), (103, None, "a", "c", FULL)],
        [(104, MONDAY, "b", "c", PARTIAL), (105, MONDAY + 9 * day, "b", "c", FULL)], [(106, MONDAY + 3 * day, "b", "c", FULL)],
    ]
    for n, rows in enumerate(deliveries):
        deliver(records(spark, rows), inbox)
        live.run_daily_kpi(live.read_table_stream(spark, inbox, schemas.RECORDS, files_per_batch=1), str(tmp_path / "live"), str(tmp_path / "cp1"))
        for again in range(2 if n == 2 else 1):  # a second query from the start stands for repeated batches
            folder = "late" if not again else "late-again"
            live.run_late_days(live.read_table_stream(spark, inbox, schemas.RECORDS, files_per_batch=1), lambda: spark.read.parquet(inbox), str(tmp_path / folder), str(tmp_path / f"cp-{folder}"))
        everything = spark.read.schema(schemas.RECORDS).parquet(inbox)
        assert sorted(values(live.corrected_series(spark, str(tmp_path / "live"), str(tmp_path / "late")))) == sorted(values(kpi.daily_efficiency(everything)))
    assert sorted(values(live.daily_kpi(spark, str(tmp_path / "live")))) != sorted(values(kpi.daily_efficiency(everything)))


def test_expiry_timers(spark, tmp_path):
    kind = "id bigint, username string, acao string, quando timestamp_ntz"
    ten = timedelta(minutes=10)
    events = [
        (1, "a", "autorizar", MONDAY), (1, "a", "usar", MONDAY + ten), (2, "b", "autorizar", MONDAY), (3, "c", "autorizar", MONDAY),
        (3, "c", "usar", MONDAY + ten + timedelta(seconds=1)), (4, "d", "usar", MONDAY),
    ]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (events, [(9, "z", "autorizar", MONDAY + timedelta(days=5))]):
        deliver(spark.createDataFrame(rows, kind), inbox)
        source = live.read_table_stream(spark, inbox, spark.createDataFrame([], kind).schema)
        live.run_expiry(source, out, str(tmp_path / "cp"))
    got = {r.id: r.status for r in live.settled(spark, out).collect()}
    assert got == {1: "usado", 2: "expirado", 3: "expirado"}


@pytest.mark.parametrize("seed", [1, 2])
def test_lifecycle_as_events_arrive(spark, tmp_path, seed):
    """Out of order within the lateness, in deliveries that each start the query anew; told once, as by the plain walk."""
    log = make_log(seed, n=300, users=4, spread=200)
    draw = random.Random(seed)
    arrived = sorted(log, key=lambda e: e["quando"] + timedelta(seconds=draw.randint(0, 1500)))
    kind = "id bigint, usuario string, quando timestamp_ntz, acao string"
    end = [{"id": None, "usuario": None, "quando": datetime(2025, 1, 1), "acao": "fim"}]
    told = []
    for rows in (arrived[:90], arrived[90:100], arrived[100:], end):
        deliver(spark.createDataFrame(rows, kind), str(tmp_path / "in"))
        source = live.read_table_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema)
        approvals.run_effects(source, str(tmp_path / "out"), str(tmp_path / "cp"), "40 minutes")
        told.append(spark.read.parquet(str(tmp_path / "out")).count())
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    wanted = brute_force(log)
    assert {r.id: (r.efeito, r.solicitacao_id) for r in found if r.efeito != approvals.OVER} == wanted
    assert len(found) - sum(r.efeito == approvals.OVER for r in found) == 300 and 0 < told[0] < told[2] < told[3]
    moment = {e["id"]: e["quando"] for e in log}
    granted = {target: moment[i] + timedelta(minutes=10) for i, (effect, target) in wanted.items() if effect == "autorizada"}
    closed = {target for effect, target in wanted.values() if effect in ("usada", "rejeitada")}
    over = {r.solicitacao_id: r.quando for r in found if r.efeito == approvals.OVER}
    assert over == {r: t for r, t in granted.items() if r not in closed} and over


def test_events_of_a_batch_wait_as_one_entry():
    """State is written per user and batch: as many events as come, one entry."""
    handle, entries, timers = mock.Mock(), [], []
    handle.getListState.return_value.appendList = entries.extend
    handle.registerTimer = timers.append
    walk = approvals.Approvals()
    walk.init(handle)
    event = Row("quando", "id", "codigo", "acao")
    assert list(walk.handleInputRows(("ana",), iter([event(5000 - i, i, 1, "solicitar") for i in range(500)]), None)) == []
    assert len(entries) == 1 and len(entries[0][0]) == 500 and timers == [5]


def test_a_log_longer_than_a_year_is_told_to_its_end(spark, tmp_path):
    """The event that closes the log comes after all others, however long the log is."""
    kind = "id bigint, usuario string, quando timestamp_ntz, acao string"
    rows = [(i, "ana", MONDAY + timedelta(days=100 * i), "solicitar" if i % 2 == 0 else "autorizar") for i in range(7)]
    rows += [(7, "bia", rows[-1][2] + timedelta(seconds=1), "solicitar"), (8, "bia", rows[-1][2] + timedelta(seconds=2), "autorizar")]
    inputs = SimpleNamespace(spark=spark, request_log=spark.createDataFrame(rows, kind))
    found = catalog._lifecycle_stream(inputs).collect()
    told = {r.id: r.efeito for r in found if r.efeito != approvals.OVER}
    assert sorted(told) == list(range(9)) and (told[7], told[8]) == ("aberta", "autorizada")
    assert rows[8][2] + timedelta(minutes=10) in [r.quando for r in found if r.efeito == approvals.OVER]


def test_a_batch_reads_the_stored_rows_once(spark, tmp_path, monkeypatch):
    """The stored rows of a batch are found once, for the table, the audit and the refused rows alike; the days they leave come from them."""
    people = spark.createDataFrame([("ana", "Ana", "Operador")], "username string, nome string, role string")
    root, read, searches = str(tmp_path / "out"), spark.sparkContext.accumulator(0), []
    rows_with, days_of = days.rows_with, days.days_of

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def counted(*args, **kwargs):
        found = rows_with(*args, **kwargs)
        return found.mapInArrow(told, found.schema)

    monkeypatch.setattr(days, "rows_with", counted)
    monkeypatch.setattr(days, "days_of", lambda *args, **kwargs: searches.append(1) or days_of(*args, **kwargs))
    days.replace_rows(records(spark, [(i, MONDAY + timedelta(days=i), "Ana", "C", FULL, "") for i in range(1, 4)]), f"{root}/registros", days.FIRST_LOAD)
    assert not searches  # nothing was stored
    rows = [(1, "ana", "D", None, FULL, "", None, "2024-01-20", 1, None), (50, "ana", "C", None, FULL, "", None, None, 2, None)]
    deliver(spark.createDataFrame(rows, INBOX), str(tmp_path / "in"))
    source = live.read_table_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], INBOX).schema)
    live.run_ingest(source, people, root, str(tmp_path / "cp"), MONDAY)
    assert (read.value, len(searches)) == (1, 1)
    assert sorted(values(days.current_records(spark, f"{root}/registros"), "id", "cliente_nome", "dia")) == [
        (1, "D", "2024-01-20"), (2, "C", "2024-01-17"), (3, "C", "2024-01-18")]
    assert [r.id for r in spark.read.parquet(f"{root}/quarentena").collect()] == [50]
