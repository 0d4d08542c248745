"""Exact top-k by inner product: ball trees over shards that lie together in space, searched by branch and bound.

Of equal vectors only those that can be among a query's best are candidates: the k + 1 rows of smallest id. The leaves of one ball tree over a bounded sample are the regions of space: every candidate goes to the region whose centre is nearest, and the
radius of a region is the distance of its farthest candidate. Regions of many candidates are cut into shards of bounded size by a hash of the row. A query
visits regions in rounds, those of the greatest upper bound (centre times query plus radius times the query's length) first: the best one, the next few,
then all others. Between rounds the k-th score found so far is shared, and a region whose bound lies below it is never
visited: neither the query nor, if no query comes, its candidates are moved.

In a shard a ball tree serves a block of queries at a time: nodes are taken in the order of their greatest bound, a query goes down only where the bound
reaches its current k-th score, and scores in leaves raise that score. The stated query set grows with the rows, so queries go in
blocks of bounded size: no task ever holds more than one shard and one block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.llm.common import ship, written

SHARD_ROWS = 4096
BLOCK_QUERIES = 4096
LEAF = 64
MOST_REGIONS = 1024  # asked of the tree, whose halving may make twice as many
SAMPLED_PER_REGION = 16  # so at most 16,384 vectors are sampled
ROUNDS = (1, 4, None)  # regions a query visits at most; None: all others
_MIN_REGIONS = 24
_OTHER = -1  # the region of vectors of another length than the sample's usual one
_NO_FLOOR = -(2**62)
_AT_ONCE = 1024


def _reach(queries: np.ndarray, lengths: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No vector of a ball has a greater inner product with a query: a line per query, with a margin for rounding."""
    spread = lengths[:, None] * radii
    far = lengths[:, None] * np.sqrt((centers**2).sum(axis=1))
    return queries @ centers.T + spread + 1e-9 * (far + spread) + 1e-6


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors**2).sum(axis=1))


class BallTree:
    """Splits at the median of the direction between two far points until a leaf is small."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, numbers: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        stack = [(0, len(vectors), None, 0)]
        while stack:
            start, stop, parent, side = stack.pop()
            rows = self.order[start:stop]
            points = vectors[rows]
            center = points.mean(axis=0)
            away = ((points - center) ** 2).sum(axis=1)
            node = len(self.center)
            self.center.append(center)
            self.radius.append(math.sqrt(float(away.max())))
            self.span.append((start, stop))
            self.children.append(None)
            if parent is not None:
                both = self.children[parent] or (node, node)
                self.children[parent] = (node, both[1]) if side == 0 else (both[0], node)
            if stop - start <= leaf or not away.max():
                continue
            one = points[int(away.argmax())]
            far = points[int(((points - one) ** 2).sum(axis=1).argmax())]
            along = points @ (far - one)
            half = (stop - start) // 2
            self.order[start:stop] = rows[np.argpartition(along, half)]
            stack += [(start + half, stop, node, 1), (start, start + half, node, 0)]
        self.vectors, self.ids, self.numbers = vectors[self.order], ids[self.order], numbers[self.order]
        self.centers, self.radii = np.array(self.center), np.array(self.radius)

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of each query's k best here (ties: smaller id) that reach its floor; the row ``own`` does not count.

        All numbers are integers below 2**53, so sums in floating point are exact; bounds get a margin for rounding.
        """
        n = len(queries)
        length = _lengths(queries)
        best = np.full((n, k), -np.inf)
        best_ids = np.full((n, k), np.iinfo(np.int64).max)
        current = floor.astype(float).copy()

        def bound(node: int, which: np.ndarray) -> np.ndarray:
            return _reach(queries[which], length[which], self.centers[node:node + 1], self.radii[node:node + 1])[:, 0]

        every = np.arange(n)
        first = bound(0, every)
        heap = [(-first.max(), 0, every, first)]
        while heap:
            _, node, which, reach = heapq.heappop(heap)
            live = reach >= current[which]
            which = which[live]
            if not len(which):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    ahead = bound(child, which)
                    on = ahead >= current[which]
                    if on.any():
                        heapq.heappush(heap, (-ahead[on].max(), child, which[on], ahead[on]))
                continue
            start, stop = self.span[node]
            ids = self.ids[start:stop]
            scores = queries[which] @ self.vectors[start:stop].T
            scores[self.numbers[None, start:stop] == own[which, None]] = -np.inf
            scores[scores < current[which, None]] = -np.inf
            hit = np.flatnonzero((scores > -np.inf).any(axis=1))
            if not len(hit):
                continue
            some = which[hit]
            all_scores = np.concatenate([best[some], scores[hit]], axis=1)
            all_ids = np.concatenate([best_ids[some], np.broadcast_to(ids, (len(hit), len(ids)))], axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[some] = np.take_along_axis(all_scores, order, axis=1)
            best_ids[some] = np.take_along_axis(all_ids, order, axis=1)
            current[some] = np.maximum(current[some], best[some, k - 1])
        row, place = np.nonzero(best > -np.inf)
        return row, best_ids[row, place], best[row, place].astype(np.int64)


class Regions:
    """The leaves of a ball tree over a sample of vectors of one length, and how far their candidates reach."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.size = sample.shape[1] if len(sample) else None
        self.centers = np.empty((0, 0))
        if len(sample):
            tree = BallTree(sample, np.arange(len(sample)), np.arange(len(sample)), leaf)
            self.centers = tree.centers[[both is None for both in tree.children]]
        self._squares = (self.centers**2).sum(axis=1)
        self.radii = np.full(len(self.centers), -1.0)  # no candidate

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The region of each vector, and its distance from the centre."""
        region = (self._squares - 2 * (vectors @ self.centers.T)).argmin(axis=1)
        return region, np.sqrt(((vectors - self.centers[region]) ** 2).sum(axis=1))

    def ahead(self, queries: np.ndarray, floors: np.ndarray, seen: list[list[int]], most: int | None) -> list[list[int]]:
        """For each query the regions to visit next, ``most`` at most: those not seen whose bound reaches its floor, the greatest bound first."""
        reach = _reach(queries, _lengths(queries), self.centers, self.radii)
        open_ = (reach >= floors[:, None]) & (self.radii >= 0)
        for line, regions in zip(open_, seen):
            line[regions] = False
        reach[~open_] = -np.inf
        first = np.argsort(-reach, axis=1, kind="stable")[:, :most]
        return [line[:n].tolist() for line, n in zip(first, open_.sum(axis=1))]


def _with(rows: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*rows.schema, *(T.StructField(name, kind) for name, kind in more.items())])


def _vectors(batch: pa.RecordBatch, rows: np.ndarray, size: int) -> np.ndarray:
    starts = batch["vector"].offsets.to_numpy()
    return batch["vector"].values.to_numpy(zero_copy_only=False)[starts[rows][:, None] + np.arange(size)].astype(float)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            yield batch.slice(start, _AT_ONCE)


def _deal(regions: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``region`` and ``away``, the distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            region, away = np.full(batch.num_rows, _OTHER), np.zeros(batch.num_rows)
            usual = np.flatnonzero(batch["size"].to_numpy() == regions.value.size)
            if len(usual):
                region[usual], away[usual] = regions.value.nearest(_vectors(batch, usual, regions.value.size))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(region, pa.int32()), pa.array(away)], names=[*batch.schema.names, "region", "away"]
            )

    return run


def _aim(regions: Broadcast, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``regions``, which each query visits in this round; those of unusual length visit the region of all such vectors once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            seen = batch["seen"].to_pylist()
            visits = [[_OTHER] if not s else [] for s in seen]
            usual = np.flatnonzero(batch["size"].to_numpy() == regions.value.size)
            if len(usual):
                floors = batch["floor"].to_numpy()[usual].astype(float)
                found = regions.value.ahead(_vectors(batch, usual, regions.value.size), floors, [seen[i] for i in usual], most)
                for i, own in zip(usual.tolist(), found):
                    visits[i] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "regions"])

    return run


def _search_cell(k: int) -> Callable[[pa.Table], pa.Table]:
    """One shard and one block of queries, told apart by ``floor``, which only queries have."""

    def run(cell: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        found: list[list[np.ndarray]] = [[] for _ in names]
        ids, numbers, sizes = cell["vec_id"].to_numpy(), cell["row"].to_numpy(), cell["size"].to_numpy()
        asks = cell["floor"].is_valid().to_numpy()
        floors = cell["floor"].fill_null(0).to_numpy()
        flat = cell["vector"].combine_chunks()
        starts, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False).astype(float)
        for size in np.unique(sizes):  # vectors of different length have no inner product
            candidates, queries = np.flatnonzero(~asks & (sizes == size)), np.flatnonzero(asks & (sizes == size))
            if not len(candidates) or not len(queries):
                continue
            take = lambda rows: values[starts[rows][:, None] + np.arange(size)]  # noqa: B023, E731
            tree, asked = BallTree(take(candidates), ids[candidates], numbers[candidates]), take(queries)
            if _lengths(tree.vectors).max() * _lengths(asked).max() >= 2**53:
                raise ValueError("scores of 2**53 and more are not exact; quantize more coarsely")
            row, vec, score = tree.search(asked, numbers[queries], floors[queries], k)
            for column, part in zip(found, (numbers[queries][row], ids[queries][row], vec, score)):
                column.append(part)
        return pa.table([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in found], names=names)

    return run


def quantized(column: str, by: int = 64) -> Column:
    """floor(by * x) of every component as integers; null unless all components are finite numbers."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(column, lambda x: F.floor(x.cast("double") * by)))


def candidates_of(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the k best of any query: of equal vectors, which score alike, the k + 1 of smallest id, as one may be the query's own.

    Spark limits the copies of a vector in every task before the shuffle.
    """
    smallest = Window.partitionBy("vector").orderBy("vec_id", "row")
    return rows.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1).drop("nth")


def _dealt(rows: DataFrame, candidates: DataFrame) -> tuple[Regions, DataFrame]:
    """Regions from a sample of at most MOST_REGIONS * SAMPLED_PER_REGION rows, and all candidates with theirs. What the sample is changes no result."""
    n, usual = rows.agg(F.count("*"), F.mode("size")).first()
    wanted = SAMPLED_PER_REGION * min(MOST_REGIONS, max(_MIN_REGIONS, math.ceil(n / SHARD_ROWS)))
    drawn = rows.where((F.col("size") == F.lit(usual)) & (F.pmod(F.xxhash64("row"), F.lit(max(n, 1))) < wanted)).limit(wanted)
    sample = drawn.select("vector").toArrow()["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    regions = Regions(sample.reshape(-1, usual or 1).astype(float), SAMPLED_PER_REGION)
    add = _deal(rows.sparkSession.sparkContext.broadcast(regions))
    return regions, written(candidates.mapInArrow(add, _with(rows, region=T.IntegerType(), away=T.DoubleType())), "dealt")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "vector") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of greatest inner product for every query.

    ``vectors`` has ``vec_id`` and an array of whole numbers; ``is_query`` picks the queries by ``vec_id``. Ties go to the
    smaller id; with fewer candidates than k all are returned. Rows without id or vector take no part. Rows that repeat an id are
    candidates, and queries, of their own: a query finds every row but itself, so perhaps another of its id, and answers of queries with one id stand
    beside each other. Vectors of different length are not compared. Scores from 2**53 on raise an error, since they would not be exact.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = written(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    ).withColumn("size", F.size("vector"))
    regions, dealt = _dealt(rows, candidates_of(rows, k))
    # A line per region: where its shards begin and how many they are.
    lines, first = [], 0
    for region, n, away in sorted(dealt.groupBy("region").agg(F.count("*"), F.max("away")).collect()):
        lines.append((region, first, -(-n // SHARD_ROWS)))
        first += lines[-1][-1]
        if region != _OTHER:
            regions.radii[region] = away
    shared = spark.sparkContext.broadcast(regions)
    shards = F.broadcast(spark.createDataFrame(lines, "region int, first long, shards long"))
    one_of = F.col("first") + F.pmod(F.xxhash64("row"), F.col("shards"))
    candidates = dealt.join(shards, "region").withColumns({"floor": F.lit(None).cast("long"), "shard": one_of})
    schema = "query_row long, query_id long, vec_id long, score long"
    fields = ("row", "vec_id", "vector", "size", "floor", "shard", "block")

    asks = rows.where(is_query).withColumns({"floor": F.lit(_NO_FLOOR), "seen": F.array().cast("array<int>")})
    hits = spark.createDataFrame([], schema)
    for number, most in enumerate(ROUNDS):
        aimed = written(asks.mapInArrow(_aim(shared, most), _with(asks, regions=T.ArrayType(T.IntegerType()))), f"round-{number}")
        visits = aimed.withColumn("region", F.explode("regions")).join(shards, "region").withColumn(
            "shard", F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1))
        )
        blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))
        asked = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), "blocks"))
        searched = candidates.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cells = searched.select(*fields).union(asked.select(*fields))
        hits = hits.union(written(cells.groupBy("shard", "block").applyInArrow(_search_cell(k), schema), f"hits-{number}"))
        # The k-th score so far bounds what any other region may still add.
        scores = F.sort_array(F.collect_list("score"), asc=False)
        floors = hits.groupBy("query_row").agg(F.get(scores, F.lit(k - 1)).alias("kth")).withColumnRenamed("query_row", "row")
        asks = aimed.join(floors, "row", "left").select(
            "row", "vec_id", "vector", "size", F.coalesce("kth", "floor").alias("floor"), F.concat("seen", "regions").alias("seen")
        )
    # Of a query's hits only the k best of each shard are left, so its group is small.
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k)
    return (
        hits.groupBy("query_row", "query_id").agg(best.alias("hits")).select("query_id", F.posexplode("hits").alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.down")).alias("score"))
    )
