"""Near copies among vectors by Euclidean p-stable hashing.

Of unit vectors, cosine c means a distance of ``sqrt(2 - 2c)``. A hash is a Gaussian projection, shifted and cut into buckets of width ``WIDTH``:
the closer two vectors, the likelier they share a bucket. A table joins k such hashes; its number k grows with the logarithm of the
vectors, so that unlike ones seldom meet, and the number of tables makes up for what k loses: a pair at the very threshold
is missed by all tables with probability ``MISS`` at most, a closer one less. Vectors that share a bucket are compared exactly, in double precision.

- Equal vectors (of one label) are one class with a weight, so copies cost nothing.
- Only (bucket, class) numbers are shuffled at first; vectors go to buckets of two and more.
- A link is counted in the first table that its vectors share and nowhere else. Projections are sums of whole numbers, exact in any order, so every
  task agrees which table that is.
- Buckets beyond ``BLOCK`` fall into blocks, and two blocks meet in one task. No pairs are listed: a task returns counts per class, and per component
  a star of edges.

For a bucket that holds many vectors the comparisons grow with its square, as the links to count do; the rows do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import ship, written
from shiftledger.llm.jaccard import components
from shiftledger.session import shuffle_partitions

COSINE = 0.98
MISS = 0.001
WIDTH = 2.0
BLOCK = 2048
_FAR = 32  # of so many bucket-mates by chance, one is expected in all tables' buckets of a vector
_SMALL = 32  # larger buckets are compared as matrices
_PAIRS = 1 << 15  # pairs looked at together
_STRIP = 1 << 19  # cells of a matrix product
_VECTORS = 4096  # vectors hashed together
_MAX_TABLES = 250
#: Vectors and projections as whole numbers: products of 2**20 * 2**14, summed over up to 2**16 components, stay exact in doubles.
_UNIT, _STEEP = 1 << 20, 1 << 11
_U = np.uint64
_BUCKETS_PER_PARTITION = 4
_LINKS, _EDGE = 0, 1


def chance(distance: float, width: float = WIDTH) -> float:
    """The probability that one hash puts two vectors at a distance into one bucket."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def size_of_index(vectors: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Hashes per table, and tables, for so many vectors."""
    near = chance(math.sqrt(2 - 2 * cosine))
    hashes = max(4, math.ceil(math.log(_FAR * max(1, vectors)) / -math.log(chance(math.sqrt(2)))))
    tables = math.ceil(math.log(miss) / math.log(1 - near**hashes))
    if tables > _MAX_TABLES:
        raise ValueError(f"{tables} tables would be needed; lower the share of links to be found or raise the cosine")
    return hashes, tables


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. Divided by the largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@lru_cache(maxsize=8)
def _projections(dim: int, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(dim)
    n = hashes * tables
    lines = np.rint(draw.normal(0, 1, (dim, n)) * _STEEP)
    shift = np.rint(draw.random(n) * WIDTH * _UNIT * _STEEP)
    odd = draw.integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)
    return lines, shift, odd


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buckets(units: np.ndarray, group: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """The bucket of every vector (rows) in every table (columns). Buckets of different groups and tables differ; the table is the top byte."""
    found = np.empty((len(units), tables), dtype=np.int64)
    lines, shift, odd = _projections(units.shape[1], hashes, tables)
    seed = _mix(group.view(np.uint64) + _U(units.shape[1]))
    top = np.arange(tables, dtype=np.uint64) << _U(56)
    for low in range(0, len(units), _VECTORS):
        cut = slice(low, low + _VECTORS)
        step = np.floor((np.rint(units[cut] * _UNIT) @ lines + shift) / (WIDTH * _UNIT * _STEEP)).astype(np.int64).view(np.uint64)
        mixed = (step * odd).reshape(-1, tables, hashes).sum(axis=2, dtype=np.uint64)
        found[cut] = ((_mix(mixed + seed[cut, None]) >> _U(8)) | top).view(np.int64)
    return found


def _by_dim(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors, for each length that occurs."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    starts, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, unit(flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64))


def _keys(hashes: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _VECTORS):
                part = batch.slice(low, _VECTORS)
                ids, group = part["class"].to_numpy(), part["grp"].to_numpy()
                for rows, units in _by_dim(part["vector"]):
                    found = buckets(units, group[rows], hashes, tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.ravel()), pa.array(np.repeat(ids[rows], tables))], names=["bucket", "class"]
                    )

    return run


class Found:
    """Links met in one task: weights per class, and components as labels."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.links = weights, np.zeros(len(weights), dtype=np.int64)
        self.label = np.arange(len(weights))

    def add(self, one: np.ndarray, other: np.ndarray) -> None:
        np.add.at(self.links, one, self.weights[other])
        np.add.at(self.links, other, self.weights[one])
        while len(one):  # the smallest label spreads over links until nothing changes
            a, b = self.label[one], self.label[other]
            open_ = a != b
            if not open_.any():
                return
            one, other, a, b = one[open_], other[open_], a[open_], b[open_]
            least = np.minimum(a, b)
            np.minimum.at(self.label, np.concatenate([a, b, one, other]), np.tile(least, 4))
            while ((up := self.label[self.label]) != self.label).any():
                self.label = up


def _first_shared(tables: np.ndarray, one: np.ndarray, other: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether a pair meets in this table and in none before it."""
    return (tables[one] == tables[other]).argmax(axis=1) == table


def _compare(units: np.ndarray, tables: np.ndarray, found: Found, one: np.ndarray, other: np.ndarray, table: np.ndarray, cosine: float) -> None:
    for low in range(0, len(one), _PAIRS):
        cut = slice(low, low + _PAIRS)
        near = np.flatnonzero((units[one[cut]] * units[other[cut]]).sum(axis=1) >= cosine) + low
        near = near[_first_shared(tables, one[near], other[near], table[near])]
        found.add(one[near], other[near])


def _cell(hashes: int, tables: int, cosine: float):
    """Compares the members of each bucket, or those of two blocks of one bucket."""

    def run(cell: pa.Table) -> pa.Table:
        ids, at = np.unique(cell["class"].to_numpy(), return_index=True)
        row_of = np.searchsorted(ids, cell["class"].to_numpy())
        group, found = cell["grp"].to_numpy()[at], Found(cell["weight"].to_numpy()[at])
        bucket, block = cell["bucket"].to_numpy(), cell["block"].to_numpy()
        blocks = cell["low"][0].as_py(), cell["high"][0].as_py()
        for rows, units in _by_dim(cell["vector"].take(pa.array(at)).combine_chunks()):
            place = np.full(len(ids), -1)
            place[rows] = np.arange(len(rows))
            own = buckets(units, group[rows], hashes, tables)
            mine = np.flatnonzero(place[row_of] >= 0)
            order = mine[np.argsort(bucket[mine], kind="stable")]
            member, home, part = place[row_of[order]], bucket[order], block[order]
            local = Found(found.weights[rows])
            starts = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
            length = np.diff(np.append(starts, len(home)))
            for n in np.unique(length[(length > 1) & (length <= _SMALL)]).tolist() if blocks[0] < 0 else []:
                lists = starts[length == n]
                one, other = np.triu_indices(n, 1)
                step = max(1, _PAIRS // len(one))
                for low in range(0, len(lists), step):
                    members = member[lists[low:low + step, None] + np.arange(n)]
                    table = np.repeat(home[lists[low:low + step]].view(np.uint64) >> _U(56), len(one)).astype(np.int64)
                    _compare(units, own, local, members[:, one].ravel(), members[:, other].ravel(), table, cosine)
            for start, n in zip(starts.tolist(), length.tolist()):
                if n > _SMALL or (blocks[0] >= 0 and n > 1):
                    members, parts = member[start:start + n], part[start:start + n]
                    table = int(home[start:start + 1].view(np.uint64)[0] >> _U(56))
                    _compare_large(units, own, local, members, parts, blocks, table, cosine)
            found.links[rows] += local.links
            found.label[rows] = rows[local.label]
        linked = np.flatnonzero(found.links)
        edge = np.flatnonzero(found.label != np.arange(len(ids)))
        none = np.zeros(len(edge), np.int64)
        return pa.table({
            "kind": pa.array(np.repeat([_LINKS, _EDGE], [len(linked), len(edge)]).astype(np.int32)),
            "a": pa.array(np.concatenate([ids[linked], ids[found.label[edge]]])), "b": pa.array(np.concatenate([np.zeros(len(linked), np.int64), ids[edge]])),
            "n": pa.array(np.concatenate([found.links[linked], none])),
        })

    return run


def _compare_large(
    units: np.ndarray, tables: np.ndarray, found: Found, members: np.ndarray, parts: np.ndarray, blocks: tuple[int, int], table: int, cosine: float
) -> None:
    """All pairs of one bucket, or of two of its blocks, as matrix products, a strip at a time."""
    low, high = blocks
    within = low == high  # both are -1 where the bucket is whole
    left = members if within else members[parts == low]
    right = members if within else members[parts == high]
    strip = max(1, _STRIP // max(1, len(right)))
    for start in range(0, len(left), strip):
        rows = left[start:start + strip]
        near = units[rows] @ units[right].T >= cosine
        if within:
            near &= np.arange(len(right))[None, :] > (start + np.arange(len(rows)))[:, None]
        i, j = np.nonzero(near)
        one, other = rows[i], right[j]
        for cut in range(0, len(one), _PAIRS):
            a, b = one[cut:cut + _PAIRS], other[cut:cut + _PAIRS]
            new = _first_shared(tables, a, b, np.full(len(a), table))
            found.add(a[new], b[new])


def comparable(vector: Column | str, label: Column | str) -> Column:
    """Whether a row takes part: a label, and components that are all finite and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(label.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_copies(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding, label``).

    Rows link if their labels are equal and not null and the cosine of their vectors is ``cosine`` or more; ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable by links, the own one included, ``kept`` says that it is the own one. Links below the
    threshold are never returned; one at it is missed with probability ``miss`` at most (equal vectors never). Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without a label, link with nothing; vectors of different length do not link. Rows that repeat an id are rows of their own;
    rows without an id link but name no component (alone they have none). An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    fits = comparable("embedding", "label")
    told = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(fits, F.col("embedding")).alias("vector"),
        F.when(fits, F.xxhash64(F.col("label").cast("string"))).alias("grp"),
    )
    # Two hashes of 64 bits name a label and its vector.
    given = F.col("vector").isNotNull()
    told = told.withColumns({"k1": F.when(given, F.xxhash64("grp", "vector")), "k2": F.when(given, F.xxhash64(F.lit(1), "vector", "grp"))})
    classes = written(
        told.where("k1 IS NOT NULL").groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("grp").alias("grp"), F.first("vector").alias("vector"))
        .withColumn("class", F.monotonically_increasing_id()), "classes",
    )
    hashes, tables = size_of_index(classes.count(), cosine, miss)
    keys = written(classes.select("class", "grp", "vector").mapInArrow(_keys(hashes, tables), "bucket long, class long"), "buckets")
    full = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = keys.join(full, "bucket")

    cells = _BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.when(parts > 1, F.pmod(F.xxhash64("class"), parts).cast("int")).otherwise(-1)
    other = F.explode(F.when(parts > 1, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(-1)))).alias("other")
    dealt = members.select("bucket", "class", "n", block.alias("block"), other).select(
        "bucket", "class", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") < 0, F.pmod("bucket", F.lit(cells))).otherwise(F.col("bucket")).alias("cell"),
    )
    rows = dealt.join(classes.select("class", "grp", "weight", "vector"), "class")
    met = written(
        rows.groupBy("cell", "low", "high").applyInArrow(_cell(hashes, tables, cosine), "kind int, a long, b long, n long"), "links"
    )

    links = met.where(F.col("kind") == _LINKS).groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = components(met.where(F.col("kind") == _EDGE).select("a", "b")).select(F.col("v").alias("class"), "root")
    known = (
        classes.select("k1", "k2", "class", "weight", "least").join(links, "class", "left").join(roots, "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    known = written(known, "known")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    told_of = known.join(named, "root").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.lit(True).alias("_known"))
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return told.select("vec_id", "k1", "k2").join(told_of, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

