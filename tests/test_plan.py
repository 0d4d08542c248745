import random
from datetime import date, datetime

from pyspark.sql import functions as F

from rows import FULL, MONDAY, explain, records, schedule, values
from shiftledger.operators import gaps, identity, plan
from shiftledger.sources.schemas import conform_schedule


def make_plan(spark):
    return schedule(spark, [
        (1, " Ana ", "MANHÃ", "Client A", "Client B"), (2, "ANA", "TARDE", "client a ", " "),
        (3, "Bia", "MANHÃ", "Client C", None), (4, " ", "MANHÃ", "Client D"), (5, "Caio", "TARDE"),
    ])


def test_gaps_of_a_day(spark):
    done = records(spark, [(1, MONDAY, "bia", " CLIENT C", FULL), (2, datetime(2024, 1, 16), "Ana", "Client A", FULL), (3, None, "Ana", "Client A", FULL)])
    got = gaps.detect_gaps(make_plan(spark), done, date(2024, 1, 15))
    assert values(got) == [(date(2024, 1, 15), 1, "Ana", "Client A")]
    assert values(gaps.gap_details(make_plan(spark), done, date(2024, 1, 15))) == [(1, "Ana", "Client A")]
    summary = values(gaps.gap_summary(make_plan(spark), done, date(2024, 1, 13), date(2024, 1, 16)).orderBy("dia"))
    assert summary == [
        (date(2024, 1, 13), 0, 0, 0), (date(2024, 1, 14), 0, 0, 0), (date(2024, 1, 15), 3, 1, 2), (date(2024, 1, 16), 1, 1, 0)]


def test_day_is_closed_at_both_ends(spark):
    ends = records(spark, [(1, datetime(2024, 1, 15), "Bia", "Client C", FULL), (2, datetime(2024, 1, 15, 23, 59, 59, 999999), "Ana", "Client A", FULL)])
    assert gaps.detect_gaps(make_plan(spark), ends, date(2024, 1, 15)).count() == 0


def test_weekend_and_empty_inputs(spark):
    none = records(spark, [])
    assert gaps.detect_gaps(make_plan(spark), none, date(2024, 1, 13)).count() == 0
    assert gaps.detect_gaps(schedule(spark, []), none, date(2024, 1, 15)).count() == 0
    assert gaps.detect_gaps(make_plan(spark), none, date(2024, 1, 15)).count() == 2


def test_filling_twice_adds_nothing(spark):
    span = date(2024, 1, 10), date(2024, 1, 17)
    start = records(spark, [(7, MONDAY, "bia", "Client C", FULL)])
    once = gaps.fill_gaps(make_plan(spark), start, *span)
    assert gaps.detect_gaps(make_plan(spark), once, *span).count() == 0
    assert gaps.fill_gaps(make_plan(spark), once, *span).count() == once.count()
    assert once.where("id IS NULL").count() == 0 and once.select("id").distinct().count() == once.count()
    row = once.where("id <> 7 AND cliente_nome = 'Client A'").first()
    assert (row.data_registro, row.status, row.aprovado_gestor) == (datetime(2024, 1, 15, 23, 59), "Não Informado", "Pendente")
    numbered = gaps.number_rows(gaps.gap_fill_rows(make_plan(spark), start, *span), start)
    assert sorted(r.id for r in numbered.collect()) == list(range(8, 8 + once.count() - 1))


def test_every_weekday_lands_on_its_dates(spark):
    everyday = schedule(spark, [(1, "Ana", "MANHÃ", "S", "T", "Q", "QI", "SX")])
    got = gaps.detect_gaps(everyday, records(spark, []), date(2024, 1, 3), date(2024, 1, 17))
    expected = [(d, "S T Q QI SX".split()[date(2024, 1, d).weekday()]) for d in range(3, 18) if date(2024, 1, d).weekday() < 5]
    assert sorted((r.dia.day, r.cliente) for r in got.collect()) == expected


def test_plan_lists(spark):
    df = make_plan(spark)
    assert [c for (c,) in values(plan.plan_clients(df))] == ["Client A", "Client B", "Client C", "Client D", "client a"]
    assert [c for (c,) in values(plan.plan_clients(df, "ana souza", "segunda"))] == ["Client A", "client a"]
    assert values(plan.support_options(df))[0] == ("Suporte - Client A",)
    row = plan.plan_coverage(df).first()
    assert (row.operadores, row.dias_cobertos, row.celulas_preenchidas, row.celulas, row.capacidade) == (5, 2, 5, 25, 20.0)
    agenda = values(plan.day_agenda(df, "segunda").where("NOT tem_alocacao"), "operador")
    assert agenda == [("Caio",)]
    nested = {r.operador: ([tuple(x) for x in r.agenda], r.tem_alocacao) for r in plan.agenda_by_operator(df, "segunda").collect()}
    assert nested == {
        "Ana": ([("MANHÃ", "Client A")], True), "ANA": ([("TARDE", "client a")], True), "Bia": ([("MANHÃ", "Client C")], True),
        "": ([("MANHÃ", "Client D")], True), "Caio": ([], False)}


def test_headers_and_cells_conform(spark):
    raw = spark.createDataFrame([(1, " Ana ", "nan", None)], "ID int, Analista string, `período` string, TERCA string")
    got = conform_schedule(raw)
    assert got.columns == ["Operador", "Periodo", "Segunda", "Terça", "Quarta", "Quinta", "Sexta", "id"]
    assert values(got) == [("Ana", "-", "-", "-", "-", "-", "-", 1)]
    assert conform_schedule(raw.drop("ID")).columns[-1] == "Sexta"


def test_payloads(spark):
    df = spark.createDataFrame([(1, '{"operador": " ", "Operador": "ana", "Terça": "x", "extra": 1}'), (2, "{}")], "id int, payload string")
    assert values(plan.normalize_payloads(df)) == [
        (1, "ANA", "MANHÃ", "-", "x", "-", "-", "-"), (2, "SEM NOME", "MANHÃ", "-", "-", "-", "-", "-")]


def test_plan_spelling(spark):
    df = schedule(spark, [(1, "Ana Paula", "TARDE"), (2, "ANA", "TARDE"), (3, "Mariana", "TARDE"), (4, "ÓP00", "TARDE"), (5, "Ana", "TARDE")])
    done = records(spark, [(i, MONDAY, n, "c", FULL) for i, n in enumerate(["ana x", "Marian", "op00 S.", " Zé ", None, "a.a"])])
    got = dict(values(identity.resolve_operator(done, df)))
    assert got == {"ana x": "ANA", "Marian": "Mariana", "op00 S.": "op00 S.", " Zé ": "Zé", "": "", "a.a": "a.a"}
    assert identity.with_plan_spelling(done, df).count() == 6


def test_visibility(spark):
    df = schedule(spark, [(1, "ANA PAULA", "TARDE"), (2, "BIA", "TARDE"), (3, "MARIANA", "TARDE")])
    people = spark.createDataFrame([
        (1, "a", "Ana", "Operador"), (2, "b", "Zeca", "Operador"), (3, "c", "Bia", " GESTOR "), (4, "d", None, "Operador"), (5, "e", "ana ", "operador"),
    ], "id bigint, username string, nome string, role string")
    assert sorted(values(identity.schedule_visibility(people, df))) == [("ana", "ANA PAULA"), ("ana", "MARIANA")]
    scopes = {r.id: (r.escopo, r.nome_busca) for r in identity.viewer_scopes(people, df).collect()}
    assert scopes == {1: ("propria", "ana"), 2: ("geral", None), 3: ("geral", None), 4: ("geral", None), 5: ("propria", "ana")}
    assert values(identity.visible_schedule(df, "Ana", "Operador"), "id") == [(1,), (3,)]
    assert identity.visible_schedule(df, "Zeca", "Operador").count() == 3
    assert identity.visible_schedule(df, "Ana", "Gestor").count() == 3


def test_names_without_account(spark):
    df = schedule(spark, [(1, "ÁNA Lima", "TARDE"), (2, "Bia", "TARDE"), (3, " Bia", "MANHÃ"), (4, None, "TARDE")])
    people = spark.createDataFrame([("ana souza",), (None,), ("",)], "nome string")
    assert values(identity.names_without_account(df, people)) == [("Bia",)]


def test_collation_stands_in_for_the_slug(spark):
    df = schedule(spark, [(1, "ÁNA Lima", "TARDE"), (2, "Bia", "TARDE"), (3, " Bia", "MANHÃ"), (4, None, "TARDE"), (5, "Zé-Luís X", "TARDE")])
    people = spark.createDataFrame([("ana souza",), (None,), ("",), ("ZELUIS",)], "nome string")
    assert values(identity.names_without_account_collated(df, people)) == values(identity.names_without_account(df, people)) == [("Bia",)]
    done = records(spark, [(i, MONDAY, n, "c", FULL) for i, n in enumerate(["Ána x", "ANA", "ana y", "Bê", " ", None, "ANA"])])
    got = sorted(values(identity.spellings_by_collation(done), "nome", "grafias", "linhas"))
    assert got == [("ANA", 3, 4), ("Bê", 1, 1)]
    names = spark.createDataFrame([("Straße",), ("STRASSE",), ("Ana",), ("ána",), ("ø",), ("o",), (None,)], "n string")
    apart = {(r.nome, r.diferenca) for r in identity.collation_differences(names, "n").collect()}
    assert not {n for n, _ in apart} & {"Ana", "ána"}  # where both agree nothing is listed


def test_bitmaps_of_what_viewers_see(spark):
    operators = [f"OP {chr(97 + i % 26)}{chr(97 + i % 7)} {i:05d}" for i in range(5000)]
    df = spark.createDataFrame([(i, n, "TARDE", *["-"] * 5) for i, n in enumerate(operators)], schedule(spark, []).schema)
    names = [*"abcdefghijklmnopqrstuvwxyz", "op a", "00012", "zz top", "é"]
    people = spark.createDataFrame([(i, f"u{i}", n, "Operador") for i, n in enumerate(names * 20)], "id bigint, username string, nome string, role string")
    numbered = identity.operator_numbers(df)
    maps = identity.visibility_bitmaps(people, numbered)
    rows = {r.nome_busca: r for r in maps.withColumn("n", F.bitmap_count("operadores")).collect()}
    assert {n: r.n for n, r in rows.items()} == {n: k for n in names if (k := sum(n in o.lower() for o in operators))}
    assert sum(r.n for r in rows.values()) > 10_000 and len(rows) < 30  # no line per pair
    for viewer in (" A", "op a", "00012", "nobody"):
        seen = {r.id for r in identity.lines_seen_by(df, numbered, maps, viewer).collect()}
        assert seen == {i for i, n in enumerate(operators) if viewer.strip().lower() in n.lower()}


def one_by_one(newcomers, taken):
    """User names as drawn one request at a time."""
    import unicodedata

    def slug(s):
        flat = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return "".join(c for c in flat.lower().strip() if c.isalnum())

    taken, out = set(taken), {}
    for i, first, last in sorted(newcomers):
        base = name = f"{slug(first.strip().split(' ')[0])}.{slug(last)}"
        n = 1
        while name in taken:
            n += 1
            name = f"{base}{n}"
        taken.add(name)
        out[i] = name
    return out


def assign(spark, newcomers, taken):
    people = spark.createDataFrame(newcomers, "id bigint, nome string, sobrenome string")
    names = spark.createDataFrame([(t,) for t in taken], "username string")
    return dict(values(identity.assign_usernames(people, names), "id", "username"))


def test_usernames_fill_the_gaps(spark):
    newcomers = [(i, "Ána" if i % 3 else "Bê", "Luz" if i % 5 else "Sol") for i in range(60)]
    taken = ["ana.luz", "ana.luz2", "ana.luz5", "ana.luz02", "ana.luz1", "ana.luz0", "be.sol3", "ana.luz100", "x"]
    assert assign(spark, newcomers, taken) == one_by_one(newcomers, taken)
    assert assign(spark, newcomers, []) == one_by_one(newcomers, [])


def test_usernames_across_bases_are_those_of_a_walk(spark):
    newcomers = [(i, "x", "y" if i % 2 else "y2") for i in range(1, 31)]
    for taken in (["x.y", "x.y22"], [], ["x.y2", "x.y3", "x.y222", "x.y02"]):
        assert assign(spark, newcomers, taken) == one_by_one(newcomers, taken)
    # Nothing is taken, and the base that ends in a digit comes first.
    first = [(1, "x", "y2"), (2, "x", "y"), (3, "x", "y"), (4, "x", "y")]
    assert assign(spark, first, []) == one_by_one(first, []) == {1: "x.y2", 2: "x.y", 3: "x.y3", 4: "x.y4"}
    draw = random.Random(3)
    many = [(i, draw.choice(["x", "z"]), draw.choice(["y", "y2", "y22", "w", "w9"])) for i in range(400)]
    used = ["x.y3", "x.y23", "z.w99", "z.w", "x.y222"]
    assert assign(spark, many, used) == one_by_one(many, used)


def test_a_hot_family_is_settled_by_positions(spark, monkeypatch):
    draw = random.Random(11)
    hot = [(i, "x", draw.choice(["y", "y", "y2", "y2", "y22", "y1", "y10"])) for i in range(1500)] + [(i, f"n{i % 50}", "z") for i in range(1500, 3000)]
    used = ["x.y3", "x.y23", "x.y2210", "n3.z", "n3.z2", "x.y100", "x.y1001"]
    people = spark.createDataFrame(hot, "id bigint, nome string, sobrenome string")
    for many in (1 << 18, 0):  # also as if there were too many shared names for one task
        monkeypatch.setattr(identity, "_MANY", many)
        found = identity.assign_usernames(people, spark.createDataFrame([(t,) for t in used], "username string"))
        assert dict(values(found, "id", "username")) == one_by_one(hot, used)
    assert "Python" not in explain(found) and "Pandas" not in explain(found)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        again = identity.assign_usernames(people, spark.createDataFrame([(t,) for t in used], "username string"))
        sizes = [len(p) for p in again.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 3000 / 2  # not in one task


def test_long_names_are_matched_in_linear_space(spark):
    long = " ".join(f"n{i}" for i in range(420))[:2000]
    df = schedule(spark, [(1, long.upper(), "TARDE"), (2, "ANA", "TARDE"), (3, None, "TARDE")])
    assert identity.name_grams(identity.plan_names(df), "nome_escala").count() <= 3 * len(long) + 20
    rows = records(spark, [(1, MONDAY, "n399", "c", FULL), (2, MONDAY, "n3999", "c", FULL), (3, MONDAY, "a", "c", FULL), (4, MONDAY, " ", "c", FULL)])
    got = dict(values(identity.resolve_operator(rows, df)))
    assert got == {"n399": long.upper(), "n3999": "n3999", "a": "ANA", " ": ""}
    people = spark.createDataFrame([
        (1, "a", "N", "Operador"), (2, "b", "n1 n2 n3", "Operador"), (3, "c", "n2 n1", "Operador"), (4, "d", "-", "Operador"), (5, "e", "an", "Operador"),
    ], "id bigint, username string, nome string, role string")
    seen = sorted(values(identity.schedule_visibility(people, df)))
    assert seen == [("-", "-"), ("an", "ANA"), ("n", "ANA"), ("n", long.upper()), ("n1 n2 n3", long.upper())]
    assert dict(values(identity.viewer_scopes(people, df), "id", "escopo")) == {1: "propria", 2: "propria", 3: "geral", 4: "propria", 5: "propria"}
    assert values(identity.visible_schedule(df, " - ", "operador"), "id") == [(3,)]


def test_one_day_reads_one_plan_column(spark, tmp_path):
    make_plan(spark).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    for df in (gaps.expected_pairs(stored, MONDAY.date(), MONDAY.date()), plan.day_agenda(stored, "segunda"), plan.plan_clients(stored, day="segunda")):
        text = explain(df)
        assert "segunda" in text and "quinta" not in text
    assert gaps.expected_pairs(stored, date(2024, 1, 20), date(2024, 1, 21)).count() == 0
    assert "Expand" not in explain(plan.plan_coverage(stored))
