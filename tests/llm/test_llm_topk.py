"""Exact top-k against a full sort, and the registered queries against their SQL."""

import math

import numpy as np
import pytest
from compare import check, connect
from pyspark.sql import functions as F

from shiftledger.llm import queries, topk

SF = "/root/testdata/sf0.001"


def plain(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for n, (q, a) in enumerate(ok):
        if q % 20 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ok) if m != n and len(a) == len(b))[:k]
            found += [(q, place, i, -s) for place, (s, i) in enumerate(hits, 1)]
    return sorted(found)


def test_rows_of_one_id_are_candidates_of_their_own(spark):
    rows = [(20, [1]), (1, [1]), (1, [5]), (20, [3])]
    df = spark.createDataFrame([(i, [64 * x for x in v]) for i, v in rows], "vec_id bigint, vector array<bigint>")
    found = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 2).collect())
    assert found == [(20, 1, 1, 20480), (20, 1, 1, 61440), (20, 2, 1, 12288), (20, 2, 20, 12288)]


def test_scores_that_would_not_be_exact_are_refused(spark):
    df = spark.createDataFrame([(20, [1 << 27]), (1, [1 << 27])], "vec_id bigint, vector array<bigint>")
    with pytest.raises(Exception, match="not exact"):
        topk.top_k(df, F.col("vec_id") % 20 == 0).collect()


@pytest.mark.parametrize("ties", [False, True])
def test_top_k_is_exact(spark, monkeypatch, ties):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    draw = np.random.default_rng(7)
    values = draw.integers(-2, 3, (500, 6)) / 64 if ties else draw.normal(0, 0.3, (500, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    rows += [(600, None), (None, [1.0] * 6), (620, [1.0, None] * 3), (640, [float("nan")] * 6), (660, [float("inf")] * 6), (680, [1.0, 2.0]), (681, [3.0, 1.0]),
             (700, []), (20, rows[20][1]), (40, [9.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, score int, rank int")
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    vectors = df.select("vec_id", topk.quantized("embedding").alias("vector"))
    found = [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(found) == plain(rows, 20)


def test_far_regions_are_not_visited(spark, monkeypatch):
    """Tight bundles of vectors and a third of all rows equal: regions out of reach are left out, answers are those of a full sort."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 9)
    tables, keep = {}, topk.written

    def seen(df, name, *more):
        tables[name] = keep(df, name, *more)
        return tables[name]

    monkeypatch.setattr(topk, "written", seen)
    draw = np.random.default_rng(3)
    around = draw.choice([-9.0, 9.0], (8, 12))
    values = np.concatenate([around[draw.integers(0, 8, 800)] + draw.normal(0, 0.1, (800, 12)), np.full((400, 12), 0.25)])
    rows = [(i, v) for i, v in enumerate(np.float32(values[draw.permutation(1200)]).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = df.select("vec_id", topk.quantized("embedding").alias("vector"))
    found = [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(found) == plain(rows, 20)
    rounds = [tables[name] for name in tables if name.startswith("round")]
    visits = sum(r.select(F.sum(F.size("regions"))).first()[0] for r in rounds)
    first = rounds[0].count()
    assert first == 60 and visits < first * 24 / 2
    assert tables["dealt"].groupBy("vector").count().agg(F.max("count")).first()[0] == 21


def test_copies_are_limited_before_the_shuffle(spark):
    """The plan of the window that ``top_k`` keeps candidates by."""
    df = spark.range(1000).select(F.col("id").alias("vec_id"), F.array("id").alias("vector"), F.col("id").alias("row"))
    plan = topk.candidates_of(df, 20)._jdf.queryExecution().executedPlan().toString()
    before, after = plan.rindex("WindowGroupLimit"), plan.index("Exchange hashpartitioning(vector")
    assert plan.count("WindowGroupLimit") == 2 and before > after


def test_no_vector_of_a_region_passes_its_bound():
    draw = np.random.default_rng(5)
    vectors = draw.integers(-(1 << 22), 1 << 22, (3000, 7)).astype(float)
    vectors[:1000] = vectors[0]
    regions = topk.Regions(vectors[::30], 4)
    region, away = regions.nearest(vectors)
    np.maximum.at(regions.radii, region, away)
    queries = vectors[::50]
    scores = queries @ vectors.T
    for floors in (scores.max(axis=1), np.sort(scores, axis=1)[:, -20]):
        ahead = regions.ahead(queries, floors, [[]] * len(queries), None)
        for line, floor, own in zip(scores, floors, ahead):
            assert set(region[line >= floor].tolist()) <= set(own)


def test_vectors_without_components(spark):
    df = spark.createDataFrame([(20, []), (1, []), (2, [])], "vec_id bigint, vector array<bigint>")
    found = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert found == [(20, 1, 1, 0), (20, 2, 2, 0)]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, vector array<bigint>")
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert check(spark, connect(SF), SF, name) is None
