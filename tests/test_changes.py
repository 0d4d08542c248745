from datetime import datetime
from types import SimpleNamespace

from rows import FULL, MONDAY, NOT_DONE, PARTIAL, explain, records, schedule, values
from shiftledger.operators import audit, changes, numbering, requests, users
from shiftledger.plans import catalog

AS_OF = datetime(2024, 1, 31, 12)
USER = "id bigint, username string, nome string, email string, telefone string, role string"
EDIT = "id bigint, cliente_nome string, status string, justificativa string, data_registro timestamp_ntz"
PATCH = (
    "ordem bigint, id bigint, tem_justificativa boolean, cliente_nome string, status string, "
    "justificativa string, operador_nome string, data_registro string"
)


def people(spark):
    return spark.createDataFrame([
        (1, "ana", "Ana Luz", "a@b.c", "11", "Operador"), (2, "gil", "", None, None, " GESTOR "), (3, "zoe", None, "z@z.z", "", "Operador"),
    ], USER)


def test_ingest(spark):
    batch = spark.createDataFrame([
        (1, "ana", None, " Alt ", FULL, None, "Outro", "2024-01-15"), (2, "gil", "C", None, FULL, "j", " Outro ", "ruim"),
        (3, "gil", "", None, FULL, "j", " ", None), (4, "nada", "C", None, FULL, "j", None, None), (5, "zoe", "  ", "Alt", FULL, "j", None, None),
    ], "id bigint, username string, cliente_nome string, cliente string, status string, justificativa string, operador_nome string, data_registro string")
    got = {r.id: (r.operador_nome, r.cliente_nome, r.data_registro, r.justificativa, r.aceito) for r in changes.ingest_records(batch, people(spark), AS_OF).collect()}
    assert got == {
        1: ("Ana Luz", "Alt", datetime(2024, 1, 15, 12), "", True), 2: ("Outro", "C", AS_OF, "j", True),
        3: ("gil", "", AS_OF, "j", True), 4: (None, "C", AS_OF, "j", False), 5: ("zoe", "", AS_OF, "j", True)}


def test_rules(spark):
    df = records(spark, [
        (1, MONDAY, "a", "c", FULL, None), (2, MONDAY, "a", " ", FULL), (3, MONDAY, "a", "Selecione...", PARTIAL, " "),
        (4, MONDAY, "a", "c", "Outro", ""), (5, MONDAY, "a", "c", None, "x"), (6, MONDAY, "a", "c", "Não Informado", "x"),
    ])
    broken = {r.id: list(r.violacoes) for r in changes.check_records(df).collect()}
    assert broken == {
        1: [], 2: [changes.NO_CLIENT], 3: [changes.NO_CLIENT, changes.NO_NOTE], 4: [changes.NO_NOTE, changes.BAD_STATUS],
        5: [changes.BAD_STATUS], 6: []}
    good, bad = changes.split_valid(df)
    assert sorted(r.id for r in good.collect()) == [1, 6] and bad.count() == 4 and good.columns == df.columns


def test_bulk_edit(spark):
    base = records(spark, [(i, MONDAY if i != 5 else None, "a", "c", PARTIAL, None if i == 6 else "n") for i in range(1, 9)])
    late = MONDAY.replace(second=40)
    edits = spark.createDataFrame([
        (1, " c ", PARTIAL, "n ", late), (2, "d", PARTIAL, "n", MONDAY), (3, "c", PARTIAL, "", MONDAY), (4, "c", FULL, "", MONDAY),
        (5, "c", PARTIAL, "n", AS_OF), (6, "c", PARTIAL, None, MONDAY), (7, "c", PARTIAL, "n", None), (99, "c", FULL, "n", MONDAY),
    ], EDIT)
    outcome = dict(values(changes.judge_edits(edits, base), "id", "resultado"))
    assert outcome == {1: "inalterado", 2: "alterado", 3: "rejeitado", 4: "alterado", 5: "alterado", 6: "inalterado", 7: "alterado"}
    assert sum(q for _, q in values(changes.edit_outcome(edits, base))) == 7
    after = {r.id: r for r in changes.apply_edits(base, edits).collect()}
    assert len(after) == 8 and after[2].cliente_nome == "d" and after[3].justificativa == "n"
    assert (after[4].status, after[4].justificativa) == (FULL, "") and after[5].data_registro == AS_OF
    assert after[7].data_registro == MONDAY
    trail = sorted(r.detalhes for r in audit.of_edits(edits, base, audit.Actor("eu", AS_OF)).collect())
    # Of what was rejected nothing is said; the cleared date of record 7 stays, and so is not in its entry.
    assert trail == [
        "registro 2; cliente_nome: c -> d", "registro 4; status: Realizado Parcial -> Realizado Total; justificativa: n -> ",
        "registro 5; data_registro:  -> 2024-01-31 12:00:00", "registro 7"]


def test_an_edit_that_comes_twice_counts_once(spark):
    base = records(spark, [(1, MONDAY, "a", "c", PARTIAL), (2, MONDAY, "a", "c", PARTIAL), (3, MONDAY, "a", "c", PARTIAL)])
    edits = spark.createDataFrame([
        (1, 1, "d", PARTIAL, "n", MONDAY), (2, 1, "e", PARTIAL, "n", MONDAY), (3, None, "f", PARTIAL, "n", MONDAY),
        (4, 2, "", "foo", "n", MONDAY), (5, 3, "g", FULL, "", MONDAY), (6, 3, "Selecione...", FULL, "", MONDAY),
    ], "ordem bigint, " + EDIT)
    assert sorted(values(changes.apply_edits(base, edits), "id", "cliente_nome")) == [(1, "e"), (2, "c"), (3, "c")]
    assert dict(values(changes.edit_outcome(edits, base))) == {"alterado": 1, "rejeitado": 2}
    assert values(changes.edited_rows(base, edits), "id") == [(1,)]
    assert audit.of_edits(edits, base, audit.Actor("eu", AS_OF)).count() == 1


def test_bulk_edit_joins_the_records_once(spark):
    base = records(spark, [(1, MONDAY, "a", "c", PARTIAL)])
    edits = spark.createDataFrame([(1, 1, "d", PARTIAL, "n", MONDAY)], "ordem bigint, " + EDIT)
    tree = explain(changes.apply_edits(base, edits)).split("(1)")[0]
    assert tree.count("Join") == 1


def test_verdicts_of_patches_and_deletes(spark):
    base = records(spark, [(1, MONDAY, "a", "c", PARTIAL), (2, MONDAY, "a", "c", PARTIAL)])
    patches = spark.createDataFrame([
        (1, 1, False, "x", None, None, None, "ruim"), (2, 1, False, "x", None, None, None, None), (3, 9, False, None, None, None, None, "ruim"),
        (4, None, False, None, None, None, None, None), (5, 2, False, "c", None, None, None, "20240115"),
    ], PATCH)
    assert sorted(values(changes.judge_patches(patches, base), "ordem", "resultado")) == [
        (1, "data inválida"), (2, "aplicado"), (3, "desconhecido"), (4, "desconhecido"), (5, "aplicado")]
    gone = spark.createDataFrame([(2,), (2,), (None,), (77,)], "id bigint")
    got = {r.id: (r.pedidos, r.resultado) for r in changes.judge_deletes(gone, base).collect()}
    assert got == {2: (2, "removido"), None: (1, "desconhecido"), 77: (1, "desconhecido")}
    actor = audit.Actor("eu", AS_OF, "Eu", "::1")
    assert [r.detalhes for r in audit.of_deletes(gone, base, actor).collect()] == ["registro 2"]
    trail = sorted(tuple(r)[1:] for r in audit.of_patches(patches, base, actor).collect())
    assert trail == [
        (AS_OF, "eu", "Eu", "::1", "atualizar_registro", "registro 1; cliente_nome: c -> x"),
        (AS_OF, "eu", "Eu", "::1", "atualizar_registro", "registro 2; data_registro: 2024-01-15 09:30:00 -> 2024-01-15 00:00:00")]


def test_new_rows_get_the_next_ids(spark):
    rows = records(spark, [(None, MONDAY, "b", "c", FULL), (40, MONDAY, "a", "c", FULL), (None, MONDAY, "a", "c", FULL), (None, None, "a", "c", FULL)])
    got = numbering.number_missing(rows, numbering.highest_id(rows, records(spark, [(7, MONDAY, "a", "c", FULL)])), ["data_registro", "operador_nome"])
    assert sorted(values(got, "id", "operador_nome")) == [(40, "a"), (41, "a"), (42, "a"), (43, "b")]
    assert numbering.highest_id(records(spark, [])) == 0
    payloads = spark.createDataFrame([(1, None, '{"operador": "x"}'), (2, None, '{"operador": "y"}'), (3, None, '{"operador": "z"}'), (4, 1, '{"operador": "w"}')], "ordem bigint, id bigint, payload string")
    plan = changes.upsert_schedule(schedule(spark, [(1, "ANA", "TARDE"), (5, "BIA", "TARDE")]), payloads)
    assert dict(values(plan, "id", "operador")) == {1: "W", 5: "BIA", 6: "X", 7: "Y", 8: "Z"}


def test_patches(spark):
    base = records(spark, [(i, MONDAY, "a", "c", PARTIAL, "n") for i in range(1, 5)])
    patches = spark.createDataFrame([
        (1, 1, False, " x ", None, None, "", None), (2, 1, True, None, FULL, None, " b ", "2024-02-01"), (3, 1, False, "y", None, None, None, "ruim"),
        (4, 2, True, None, None, " m ", None, None), (5, 9, True, "z", None, None, None, None),
    ], PATCH)
    got = {r.id: (r.cliente_nome, r.status, r.justificativa, r.operador_nome, r.data_registro) for r in changes.apply_patches(base, patches).collect()}
    assert got == {
        1: ("x", FULL, "", "b", datetime(2024, 2, 1, 12)), 2: ("c", PARTIAL, "m", "a", MONDAY),
        3: ("c", PARTIAL, "n", "a", MONDAY), 4: ("c", PARTIAL, "n", "a", MONDAY)}


def test_delete_and_upsert(spark):
    base = records(spark, [(i, MONDAY, "a", "c", NOT_DONE) for i in range(1, 5)])
    gone = spark.createDataFrame([(2,), (2,), (None,), (77,)], "id bigint")
    assert sorted(r.id for r in changes.delete_by_id(base, gone).collect()) == [1, 3, 4]
    payloads = spark.createDataFrame([(1, 1, '{"operador": "x"}'), (2, 1, '{"operador": "y"}'), (3, 8, '{"operador": "z"}')], "ordem bigint, id bigint, payload string")
    got = dict(values(changes.upsert_schedule(schedule(spark, [(1, "ANA", "TARDE"), (2, "BIA", "TARDE")]), payloads), "id", "operador"))
    assert got == {1: "Y", 2: "BIA"}  # no line has the id 8, so that payload changes nothing
    verdicts = dict(values(changes.judge_plan_payloads(schedule(spark, [(1, "ANA", "TARDE"), (2, "BIA", "TARDE")]), payloads.unionByName(
        spark.createDataFrame([(4, None, '{"operador": "w"}')], payloads.schema))), "ordem", "resultado"))
    assert verdicts == {1: "superada", 2: "substituída", 3: "desconhecido", 4: "incluída"}


def test_plan_lines_of_unknown_ids_can_be_inserted(spark):
    base = schedule(spark, [(1, "ANA", "TARDE"), (2, "BIA", "TARDE")])
    payloads = spark.createDataFrame(
        [(1, 8, '{"operador": "x"}'), (2, 8, '{"operador": "z"}'), (3, None, '{"operador": "w"}'), (4, 2, '{"operador": "y"}')], "ordem bigint, id bigint, payload string")
    got = values(changes.upsert_schedule(base, payloads, insert_unknown=True), "id", "operador")
    assert sorted(got) == [(1, "ANA"), (2, "Y"), (8, "Z"), (9, "W")]
    twice = base.unionByName(base)  # a line that is stored twice is replaced once
    lines = changes.judge_plan_upsert(twice, payloads, insert_unknown=True)
    assert sorted(values(lines, "id", "operador", "novo")) == [(2, "Y", False), (8, "Z", True), (9, "W", True)]


def test_queries_insert_plan_lines_of_unknown_ids(spark):
    payloads = spark.createDataFrame([(1, 8, '{"operador": "x"}'), (2, 1, '{"operador": "y"}')], "ordem bigint, id bigint, payload string")
    tables = SimpleNamespace(spark=spark, schedule=schedule(spark, [(1, "ANA", "TARDE")]), plan_payloads=payloads)
    assert sorted(values(catalog.QUERIES["schedule_upserted"](tables), "id", "operador")) == [(1, "Y"), (8, "X")]
    told = sorted(r.detalhes.split("; ")[:3] for r in catalog.QUERIES["audit_from_plan"](tables).collect())
    assert told == [["linha 1", "substituída", "operador: Y"], ["linha 8", "incluída", "operador: X"]]


def test_role_changes_and_signups(spark):
    wanted = spark.createDataFrame([(1, 1, "Gestor"), (2, 1, "Admin"), (3, 2, "Coordenador"), (4, 9, "Admin"), (5, 1, "chefe")], "ordem bigint, id bigint, role string")
    assert sorted(values(users.judge_role_changes(wanted, people(spark)), "ordem", "resultado")) == [
        (1, "aplicado"), (2, "aplicado"), (3, "papel_invalido"), (4, "usuario_desconhecido"), (5, "papel_invalido")]
    assert dict(values(users.apply_role_changes(people(spark), wanted), "id", "role"))[1] == "Admin"
    batch = spark.createDataFrame([(1, "ana", "A", None, None), (2, "novo", "B", "", ""), (3, "novo", "C", "c@c.c", "Gestor")], "ordem bigint, username string, nome string, email string, role string")
    got = {r.ordem: (r.email, r.role, r.resultado) for r in users.ingest_users(batch, people(spark)).collect()}
    assert got == {1: ("ana", "Operador", "duplicado"), 2: ("novo", "Operador", "criado"), 3: ("c@c.c", "Gestor", "duplicado")}


def test_requests(spark):
    kind = "id bigint, username string, email string, telefone string, solicitado_em timestamp_ntz"
    new = spark.createDataFrame([
        (1, " ana ", "A@B.C ", "11", MONDAY), (2, "ana", "x@b.c", None, MONDAY), (3, "gil", "q@q.q", "9", MONDAY),
        (4, "nada", None, None, MONDAY), (5, "zoe", "", "5", MONDAY), (6, "zoe", None, None, MONDAY),
    ], kind)
    assert dict(values(requests.contact_check(new, people(spark)), "id", "verificacao")) == {
        1: "ok", 2: "nao_confere", 3: "ok", 4: "nao_encontrado", 5: "ok", 6: "ok"}
    held = spark.createDataFrame([
        (90, "ana", "autorizado", MONDAY, MONDAY), (91, "gil", "pendente", MONDAY, None), (92, "zoe", "usado", MONDAY, MONDAY),
    ], "id bigint, username string, status string, solicitado_em timestamp_ntz, expira_em timestamp_ntz")
    assert dict(values(requests.intake(new, people(spark), held, AS_OF), "id", "resultado")) == {
        1: "registrada", 2: "nao_confere", 3: "em_andamento", 4: "nao_encontrado", 5: "registrada", 6: "em_andamento"}
    edge = requests.expire_requests(held, MONDAY)
    assert dict(values(edge, "id", "status"))[90] == "autorizado"  # at the instant of expiry it still holds
    twins = held.unionByName(held.withColumn("id", held.id + 100))
    assert sorted(values(requests.latest_open_request(twins), "username", "id")) == [("ana", 190), ("gil", 191)]
    pending, history = requests.pending_and_history(held)
    assert (pending.count(), history.count()) == (1, 2)
