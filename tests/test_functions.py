from datetime import date, datetime, time, timezone

import pytest
from pyspark.sql import functions as F

from shiftledger.functions import dates, measures, roles, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr("c").alias("x")).collect()]


def test_operator_key(spark):
    names = ["ÓP07", "Óp07 Silva", "  op07\tS.", None, "", "   ", "Ñandú x"]
    assert column(spark, names, text.operator_key) == ["op07", "op07", "op07", "", "", "", "ñandu"]


def test_accents_and_slug(spark):
    names = ["Ação Ñ", "éx", "ǅ", None, "ﬁ 1º"]
    assert column(spark, names, text.strip_accents)[:2] == ["Acao N", "ex"]
    assert column(spark, names, text.strip_accents)[3] == ""
    assert column(spark, names, text.strip_accents_exact) == ["Acao N", "ex", "Dz", "", "fi 1o"]
    assert column(spark, [" D'Ávila-2 ", None, "--"], text.slug) == ["davila2", "", ""]


@pytest.mark.parametrize("term, hits", [("a.c", [True, True, False, False]), ("^AB", [False, True, False, False]), ("(x)?c$", [True, True, False, False])])
def test_search_is_a_regular_expression(spark, term, hits):
    assert column(spark, ["a.c", "abc", "ac.d", None], lambda c: text.matches(c, term)) == hits


def test_search_ignores_case_of_accents(spark):
    assert column(spark, ["ÓP1"], lambda c: text.matches(c, "óp")) == [True]


def test_contact_rules(spark):
    mails = ["a@b.c", "a.b@c", "ab.c", "", None, " x@y@z.w "]
    assert column(spark, mails, text.email_valid) == [True, False, False, True, True, True]
    assert column(spark, [" Ana Luz ", "á!b_1", None], text.username_clean) == ["ana_luz", "áb_1", ""]


def test_names(spark):
    names = ["ana maria da luz", "o'neil", "", " ÓP07 silva"]
    assert column(spark, names, text.title_name) == ["Ana Maria Da Luz", "O'Neil", "", "Óp07 Silva"]
    assert column(spark, names, text.initials) == ["AM", "O", "U", "ÓS"]


def test_display(spark):
    cells = [None, " ", "NaN", "none", "NaT", " x "]
    assert column(spark, cells, text.display_value) == ["—"] * 5 + ["x"]
    assert column(spark, ["REALIZADO TOTAL", "nao realizado", "outro"], text.status_class) == ["ok", "danger", "muted"]


def test_parse_record_date(spark):
    given = [
        "2024-01-15", " 2024-01-15 ", "2024-01-15T10:20:30Z", "2024-01-15T10:20:30+03:00", "2024-01-15 10:20",
        "2024-01-15T10:20:30.123456", "2024-13-01", "2024-01-15T25:00:00", "ontem", "", None, "2024-02-30", "15/01/2024",
    ]
    noon, late = datetime(2024, 1, 15, 12), datetime(2024, 1, 15, 10, 20, 30)
    assert column(spark, given, dates.parse_record_date) == [
        noon, noon, late, late, datetime(2024, 1, 15, 10, 20), late.replace(microsecond=123456), *[None] * 7
    ]


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        given = ["2018-11-04", "2018-11-04T00:30:00"]  # midnight does not exist there on that day
        assert column(spark, given, dates.parse_record_date) == [datetime(2018, 11, 4, 12), datetime(2018, 11, 4, 0, 30)]
        skipped = [datetime(2018, 11, 4, 0, 30, 15, 7)]
        assert column(spark, skipped, dates.to_minute, "timestamp_ntz") == [datetime(2018, 11, 4, 0, 30)]
        assert column(spark, skipped, dates.display, "timestamp_ntz") == ["04/11/2018 00:30"]
        micros = column(spark, skipped, lambda c: F.unix_micros(dates.event_time(c)), "timestamp_ntz")
        assert micros == [int(skipped[0].replace(tzinfo=timezone.utc).timestamp()) * 1_000_000 + 7]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_dates(spark):
    moment = datetime(2024, 1, 13, 10, 20, 59, 999)
    as_of = datetime(2024, 1, 31, 12, 0, 30)
    assert column(spark, [moment, None], dates.to_minute, "timestamp_ntz") == [datetime(2024, 1, 13, 10, 20), None]
    assert column(spark, [moment, None], lambda c: dates.fill_missing_date(c, as_of), "timestamp_ntz") == [
        moment, datetime(2024, 1, 31, 12)]
    assert column(spark, [moment], dates.display, "timestamp_ntz") == ["13/01/2024 10:20"]


def test_percentages_round_half_even(spark):
    cases = {(1, 16): 6.2, (7, 2000): 0.4, (49, 400): 12.2, (3, 16): 18.8, (0, 0): None, (1, 3): 33.3}
    df = spark.createDataFrame([(k, n) for k, n in cases], "k bigint, n bigint")
    assert [r[0] for r in df.select(measures.pct("k", "n")).collect()] == list(cases.values())


def test_percentages_agree_with_python(spark):
    df = spark.range(0, 401).withColumnRenamed("id", "n").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), "n"))).where("n > 0")
    wrong = [r for r in df.select("k", "n", measures.pct("k", "n").alias("p")).toPandas().itertuples() if round(r.k / r.n * 100, 1) != r.p]
    assert wrong == []


def test_roles(spark):
    names = [" Admin Master ", "visualizador", "Operador", None, "x"]
    assert column(spark, names, roles.is_management) == [True, False, False, False, False]
    assert column(spark, names, roles.has_full_view) == [True, True, False, False, False]
    assert column(spark, names, lambda c: roles.capabilities(c)["can_edit"]) == [True, False, True, False, False]
    assert column(spark, names, lambda c: roles.capabilities(c)["can_launch"]) == [True, True, True, False, False]


def test_every_iso_spelling(spark):
    def plain(value):
        text = value.strip().replace("Z", "+00:00")
        try:
            if len(text) == 10 and text[4] == text[7] == "-":
                return datetime.combine(date.fromisoformat(text), time(12))
            return datetime.fromisoformat(text).replace(tzinfo=None)
        except ValueError:
            return None

    spellings = (
        "20240115T081530|20240115|2024-W03-1|2024-W03|2024W031|2024W03|2024-01-15T0815|2024-01-15T08:15:30.1234567899|2024-01-15T08:15:30+03:00:00|"
        "2024-01-15|2024-02-30|20230229|2024-W53-1|2020-W53-7|2024-01-15 25:00:00|2024-01-15T08|2024-01-15T08:15:60|2024-01-15T08:15:30,5|"
        "2024-01-15T08:15:30Z|2024-01-15T08:15:30+0300|2024-01-15T08:15:30+24:00|0000-01-01|00000101|2024-1-5|x|2024-01-15T|20240115 0815|2024-W03-1T10:00|"
        "2024-W00-1|2024-W03-8|9999-12-31T23:59:59.999999|2024-13-01|2024-01-15T08:15:30.|2024-01-15T081530.25| 2024-01-15 |2024-01-15T08:1530"
    ).split("|")
    assert column(spark, spellings, dates.parse_record_date) == [plain(s) for s in spellings]


def test_slugs_over_all_of_unicode(spark):
    """Every character assigned in Unicode 3.2, which both sides know."""
    import unicodedata

    known = [chr(c) for c in range(1, 0x110000) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = ["".join(known[i:i + 64]) for i in range(0, len(known), 64)]
    plain = ["".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)) for t in texts]
    assert column(spark, texts, text.strip_accents) == plain
    some = ["Ｌｕｉｓ", "ﬁm", "Ⅻ", "Ǆ", "각", "Ángela Öz"]
    assert column(spark, some, text.slug) == ["luis", "fim", "xii", "dz", unicodedata.normalize("NFKD", "각"), "angelaoz"]
