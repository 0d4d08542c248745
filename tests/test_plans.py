"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from rows import FULL, MONDAY, NOT_DONE, explain, records
from shiftledger.operators import filters, gaps, identity, kpi, requests
from shiftledger.operators.ranking import rank_in_group
from shiftledger.plans.catalog import QUERIES, Inputs

SF = "/root/testdata/sf0.001"
PYTHON = {"strip_accents_exact", "request_lifecycle", "requests_from_log"}
# The plan of a stream's result says nothing of the batches that made it; test_io_and_streams looks at those.
RUNS_JOBS = {n for n in QUERIES if n.startswith("stream_") or n == "audit_from_stream"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_JOBS))
def test_no_python_and_no_cross_join(spark, name):
    plan = explain(QUERIES[name](Inputs(spark, SF)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "records")
    Inputs(spark, SF).records.write.parquet(path)
    return spark.read.parquet(path)


def test_periods_reach_the_scan(stored):
    plan = explain(kpi.kpi_counts(stored.where(filters.last_days(7, MONDAY))))
    assert "GreaterThanOrEqual(data_registro" in plan
    assert "ReadSchema: struct<data_registro:timestamp_ntz,status:string>" in plan


def test_rows_are_hashed_not_sorted_before_the_first_shuffle(stored):
    for df in (kpi.operator_efficiency(stored), kpi.daily_efficiency(stored), kpi.top_clients(stored), identity.operator_labels(stored)):
        tree = explain(df).split("(1) Scan parquet")[0].splitlines()
        lowest = [line for line in tree if "Aggregate" in line][-1]
        assert "HashAggregate" in lowest, lowest


def test_names_resolve_in_one_read_of_the_records(spark, stored):
    df = identity.resolve_operator(stored, Inputs(spark, SF).schedule)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet [operador_nome#") == 1 and "ReusedExchange" in final


def test_efficiency_reads_once_and_never_joins(stored):
    tree = explain(kpi.operator_efficiency(stored)).split("(1) Scan parquet")[0]
    assert tree.count("Scan parquet") == 1 and "Join" not in tree


def test_reports_are_distinct_before_they_are_matched(spark, stored):
    first = MONDAY.date()
    tree = explain(gaps.detect_gaps(Inputs(spark, SF).schedule, stored, first)).split("(1) Scan parquet")[0]
    # Plan pairs, reports and, where no side is small, the join share these two shuffles.
    assert tree.count("Exchange") - tree.count("BroadcastExchange") <= 2


def test_newest_n_is_a_top_k(stored):
    assert "TakeOrderedAndProject" in explain(kpi.latest_records(stored))


@pytest.fixture
def small_partitions(spark):
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10000",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_records(spark, n=60_000):
    """Half of the rows belong to one operator."""
    name = F.when(F.col("id") % 2 == 0, "Hot Um").otherwise(F.concat(F.lit("op"), (F.col("id") % 997).cast("string")))
    return spark.range(0, n, 1, 8).select(
        "id", F.lit(MONDAY).cast("timestamp_ntz").alias("data_registro"), name.alias("operador_nome"),
        F.lit("c").alias("cliente_nome"), F.when(F.col("id") % 3 == 0, FULL).otherwise(NOT_DONE).alias("status"),
        F.sha2(F.col("id").cast("string"), 512).alias("justificativa"),
    )


def test_a_hot_operator_is_split_in_the_label_join(spark, small_partitions):
    df = identity.canonical_operator(hot_records(spark))
    assert df.groupBy("operador_exibicao").count().where("operador_exibicao = 'Hot Um'").first()["count"] == 30_000
    lookup = identity.canonical_operator(hot_records(spark)).select("id", "justificativa", "operador_exibicao")
    lookup.write.format("noop").mode("overwrite").save()
    rows = lookup.collect()
    assert len(rows) == 60_000
    assert "skew=true" in lookup._jdf.queryExecution().executedPlan().toString()


def test_a_hot_group_is_ranked_over_many_slices(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id")
    ranked = rank_in_group(df, ["g"], ["id"], "n", partitions=16)
    wrong = ranked.where("(g = 'hot' AND n <> id / 2 + 1)").count()
    assert wrong == 0 and ranked.count() == 20_000
    per_group = ranked.groupBy("g").agg(F.max("n").alias("m"), F.count_distinct("n").alias("d"), F.count("*").alias("c"))
    assert per_group.where("m <> c OR d <> c").count() == 0
    everything = rank_in_group(df, [], ["id"], "n", partitions=16)
    assert everything.where("n <> id + 1").count() == 0


def test_latest_request_combines_before_the_shuffle(spark):
    tree = explain(requests.latest_open_request(Inputs(spark, SF).requests)).split("(1) Scan parquet")[0]
    assert "Window" not in tree
    above, below = tree.split("Exchange", 1)
    assert "Aggregate" in above and "Aggregate" in below
