"""Exact n-gram Jaccard join by a pigeonhole over a partitioned universe.

A document is the set of its distinct shingles, as 64-bit hashes. Two sets of r and s shingles link when they differ in at most
``H = floor((r + s) / 7)`` shingles (that is a Jaccard similarity of 0.75). For a band of sizes the universe of shingles is
hashed into segments, more than H of them: if a set fills more than H segments, then in one of these any partner
has exactly the same shingles. So sets meet under keys made of band, segment and the shingles in it (their "segment subset").

- Sets of equal content are one class from the start; copies cost nothing after that.
- A set enters its own band, and the band below if a partner may be there.
- Cost-based allocation: a key that more than ``LIST`` classes share is dear and is skipped. A set that still has more than H keys in the band
  is guaranteed to meet its partners elsewhere. Only pairs of two sets that lack such keys can be missed. A one-deletion neighbourhood doubles what a
  segment earns but costs a key per shingle, so it is allotted to such sets only, and settles some of them. The others are looked up under
  the dear keys, by themselves: first each against the set of its list that shares most keys, then, where that leaves a list in several
  components, all with all in blocks, as matrix products. Sets that fill too few segments in the first place share one more list per band.
- Candidates must share as many keys as the pigeonhole demands, and are then verified on their whole sets.

Only components are asked for, so a verified link spares all further pairs inside its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import id_and_text, slices, written
from shiftledger.session import shuffle_partitions

WORDS = 5
_SLICE = 1 << 20  # bytes of text worked on at a time; a set takes several times its text
#: A key shared by more classes is dear.
LIST = 8
#: So many links fit one task.
EDGES_IN_A_TASK = 200_000
_BLOCK = 1024  # sets compared with as many others in one task
_ROWS, _COLUMNS = 128, 2048  # sets and shingles of a matrix at a time
_MEMBERS = 64  # sets verified against one set at a time
_BITS = 1 << 25  # of the filter that spares reading texts nobody asks for; its size is fixed, its answers only ever too many
_BUCKETS_PER_PARTITION = 4
#: Shingles per segment by the largest size of the band: small sets get more segments, so that few of them collide.
_PER_SEGMENT = {4: 0.02, 8: 0.1, 16: 0.4, 32: 1.0, 64: 1.5, 128: 1.9, 256: 2.2, 512: 2.4}
_PER_SEGMENT_ABOVE = 2.55
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEPS = _mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | _U(1)


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of five words, hashed and sorted; of fewer words, the whole sequence; of none, nothing."""
    import xxhash

    # On bytes, lower() and split() know ASCII letters and ASCII white space only, as the definition asks.
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total += hashed[i:len(words) - width + 1 + i] * _STEPS[i]
    return np.unique(_mix(total))


def class_of(found: np.ndarray) -> int | None:
    """A 64-bit name for the set; None for the empty one."""
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None


def band_of(size: int) -> int:
    """Band z holds the sizes above 2 * 2**z up to 4 * 2**z; sets of one or two shingles link only with equals."""
    return (size - 1).bit_length() - 2


def segments(band: int) -> int:
    top = 4 << band
    return int(np.ceil(top / _PER_SEGMENT.get(top, _PER_SEGMENT_ABOVE)))


def few_key(band: int) -> int:
    """The key of the list of sets that fill too few segments."""
    return int((_mix(np.array([0xF0000000 + band], dtype=np.uint64))[0] & ~_U(63)) | _U(band))


def keys(sets: list[np.ndarray], bands: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of every set in its band, and the number of the set each belongs to. The band is the low six bits."""
    sizes = np.array([len(s) for s in sets])
    counts = np.array([segments(b) for b in bands], dtype=np.uint64)
    base = np.cumsum(counts) - counts
    tokens, which = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    place = base[which] + (tokens >> _U(20)) % counts[which]
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    subset = np.add.reduceat(_mix(tokens[order] + _U(0x51ED270B)), starts)
    owner = which[order][starts]
    band = np.array(bands, dtype=np.uint64)[owner]
    segment = place[starts] - base[owner]
    key = _mix(subset + _mix(segment * _U(64) + band))
    return (key & ~_U(63)) | band, owner


def variants(found: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-deletion neighbourhoods: the segments of a set, their keys, and whether a key is of the full subset or of it without one shingle.

    A single shingle is not deleted: what is left would be an empty segment, which has no key.
    """
    place = (found >> _U(20)) % _U(segments(band))
    order = np.argsort(place, kind="stable")
    place, mixed = place[order], _mix(found[order] + _U(0x51ED270B))
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    sizes = np.diff(np.append(starts, len(place)))
    whole = np.add.reduceat(mixed, starts)
    many = np.repeat(sizes, sizes) > 1
    less = (np.repeat(whole, sizes) - mixed)[many]
    segment = np.concatenate([place[starts], place[many]])
    key = _mix(np.concatenate([whole, less]) + _mix(segment * _U(64) + _U(band)))
    full = np.arange(len(segment)) < len(starts)
    return segment.astype(np.int32), (key & ~_U(63)) | _U(band), full


def _signatures(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per bucket of keys the keys and their classes, and what is known of the classes whose hash falls in the bucket."""
    seen: set[int] = set()
    for part in slices(batches, limit=_SLICE):
        sets, names = [], []
        for text in part["text"].to_pylist():
            found = shingles(text)
            name = class_of(found)
            if len(found) > 2 and name not in seen:
                seen.add(name)
                sets.append(found)
                names.append(name)
        if not sets:
            continue
        names = np.array(names, dtype=np.int64)
        bands = [band_of(len(s)) for s in sets]
        below = [i for i, (s, b) in enumerate(zip(sets, bands)) if b and 75 * len(s) <= 100 * (2 << b)]
        key, owner = keys(sets, bands)
        own = np.bincount(owner, minlength=len(sets))
        low = np.zeros(len(sets), dtype=np.int64)
        all_keys, all_names = [key], [names[owner]]
        if below:
            key, owner = keys([sets[i] for i in below], [bands[i] - 1 for i in below])
            low[below] = np.bincount(owner, minlength=len(below))
            all_keys.append(key)
            all_names.append(names[np.array(below)[owner]])
        sizes = np.array([len(s) for s in sets])
        band = np.array(bands)
        for short, at in ((own < credits_own(sizes), band), ((low > 0) & (low < credits_low(sizes, band)), band - 1)):
            all_keys.append(np.array([few_key(b) for b in at[short]], dtype=np.uint64))
            all_names.append(names[short])
        key, name = np.concatenate(all_keys), np.concatenate(all_names)
        bucket = ((key >> _U(6)) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        key, name = key[order].tobytes(), name[order].tobytes()
        home = names.astype(np.uint64) % _U(buckets)
        facts = np.stack([names, sizes, own, low], axis=1)
        rows, start = [], 0
        for b in range(buckets):
            mine = facts[home == b]
            end = int(ends[b]) * 8
            if end > start or len(mine):
                rows.append((b, key[start:end], name[start:end], mine.tobytes()))
            start = end
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
            names=["bucket", "keys", "classes", "facts"],
        )


def credits_own(sizes: np.ndarray) -> np.ndarray:
    """Segments a set must fill in its own band: more than it can differ in from its largest partner."""
    return (sizes + sizes * 100 // 75) // 7 + 1


def credits_low(sizes: np.ndarray, bands: np.ndarray) -> np.ndarray:
    return (sizes + (2 << bands.astype(np.int64))) // 7 + 1


_MET = "kind int, band int, key long, a long, b long, size long, own long, low long"
_PAIR, _DEAR, _FACT = 0, 1, 2


def _meet(bucket: pa.Table) -> pa.Table:
    """Pairs from short lists, the members of long ones, and one line per class."""
    whole = lambda name, kind: np.frombuffer(b"".join(bucket[name].to_pylist()), kind)
    key, name = whole("keys", "<u8"), whole("classes", "<i8")
    facts = np.unique(whole("facts", "<i8").reshape(-1, 4), axis=0)
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])) if len(key) else np.empty(0, bool)
    key, name = key[fresh], name[fresh]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
    length = np.diff(np.append(starts, len(key)))
    few = np.isin(key[starts], np.array([few_key(b) for b in range(60)], dtype=np.uint64))
    left, right, pair_band = [], [], []
    for n in range(2, LIST + 1):
        lists = starts[(length == n) & ~few]
        if len(lists):
            members = name[lists[:, None] + np.arange(n)]
            one, other = np.triu_indices(n, 1)
            left.append(members[:, one].ravel())
            right.append(members[:, other].ravel())
            pair_band.append(np.repeat(key[lists] & _U(63), len(one)).astype(np.int64))
    dear = np.repeat((length > LIST) | (few & (length > 1)), length)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    kinds = np.repeat([_PAIR, _DEAR, _FACT], [len(a), int(dear.sum()), len(facts)])
    band = np.concatenate([*(pair_band or [np.empty(0, np.int64)]), (key[dear] & _U(63)).astype(np.int64), np.zeros(len(facts), np.int64)])
    pad = lambda values, before, after: pa.array(
        np.concatenate([np.zeros(before, np.int64), values, np.zeros(after, np.int64)])
    )
    n_pairs, n_dear, n_facts = len(a), int(dear.sum()), len(facts)
    return pa.table({
        "kind": pa.array(kinds, pa.int32()), "band": pa.array(band, pa.int32()),
        "key": pad(key[dear].view(np.int64), n_pairs, n_facts),
        "a": pa.array(np.concatenate([a, name[dear], facts[:, 0]])), "b": pad(b, 0, n_dear + n_facts),
        **{c: pad(facts[:, i], n_pairs + n_dear, 0) for i, c in ((1, "size"), (2, "own"), (3, "low"))},
    })


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every vertex with the smallest of its component, by union-find over all edges that come."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        top = v
        while (above := up.setdefault(top, top)) != top:
            top = above
        while v != top:
            up[v], v = top, up[v]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            one, other = sorted((find(a), find(b)))
            up[other] = one
    names = list(up)
    for i in range(0, len(names), 65536):
        part = names[i:i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(v) for v in part], pa.int64())], names=["v", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``v, root``: every vertex of the edges (``a``, ``b``) with the smallest vertex of its component.

    As many edges as one task can surely hold are joined by union-find. Beyond that, large-star and small-star
    contraction alternate, so long chains take a logarithmic number of rounds; a hub is only ever reduced to its minimum.
    """
    state = written(edges.select("a", "b").distinct(), "edges")
    if state.limit(EDGES_IN_A_TASK + 1).count() <= EDGES_IN_A_TASK:
        return state.coalesce(1).mapInArrow(_union, "v long, root long")
    last = None
    while True:
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).union(state.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        state = written(small.where("a <> b").distinct(), "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return state.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("root")).union(
                state.select("a", "a").distinct()
            )
        last = now


def _shingle_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=_SLICE):
            sets = [shingles(t) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_hash"], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([class_of(s) for s in sets], pa.int64())],
                names=["doc_id", "text_hash", "n_shingles", "class"],
            )

    return id_and_text(docs, text_hash().alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, class long"
    )


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


class _Verifier:
    """Checks candidate pairs of classes on their whole sets, taken anew from one document of each class."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self._docs, self._classes = docs, classes

    def _sets(self, needed: DataFrame) -> DataFrame:
        """``class, hashes`` of the classes needed. A bitmap of fixed size keeps other texts from being worked on."""
        spark = self._docs.sparkSession
        spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(_BITS))  # int and long hash differently
        asked = self._classes.join(needed, "class", "left_semi").select(spot.alias("spot"))
        words = asked.groupBy((F.col("spot") / 64).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")
        ).toArrow()
        bitmap = np.zeros(_BITS // 64, dtype=np.int64)
        bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
        shared = spark.sparkContext.broadcast(bitmap)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value.view(np.uint64)
            for part in slices(batches, limit=_SLICE):
                at = part["spot"].to_numpy().astype(np.uint64)
                on = (bits[at >> _U(6)] >> (at & _U(63))) & _U(1)
                sets = [shingles(t) for t in part["text"].filter(pa.array(on.astype(bool))).to_pylist()]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["class", "hashes"],
                )

        rows = id_and_text(self._docs, spot.alias("spot")).mapInArrow(run, "class long, hashes binary")
        return rows

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (``a``, ``b``), those that link; each set ``a`` meets its partners a bounded number at a time."""
        pairs = written(pairs, "candidates")
        counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
        salted = pairs.join(counts, "a").select(
            "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / _MEMBERS)).alias("salt")
        )
        roles = written(
            salted.select(F.col("b").alias("class"), F.col("a").alias("hub"), "salt", F.lit(False).alias("is_hub"))
            .union(salted.select("a", "a", "salt", F.lit(True)).distinct()),
            "roles",
        )

        def check(group: pa.Table) -> pa.Table:
            names, hub_rows = group["class"].to_pylist(), group["is_hub"].to_pylist()
            sets = {n: np.frombuffer(h, "<u8") for n, h in zip(names, group["hashes"].to_pylist())}
            hub = next((n for n, h in zip(names, hub_rows) if h), None)
            found = []
            for name in sorted({n for n, h in zip(names, hub_rows) if not h}) if hub is not None else []:
                one, other = sets[hub], sets[name]
                both = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * both >= 75 * (len(one) + len(other) - both):
                    found.append(name)
            return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

        sets = self._sets(roles.select("class").distinct())
        met = roles.join(sets, "class")
        return written(met.groupBy("hub", "salt").applyInArrow(check, "a long, b long"), "links")


    def linked_in_blocks(self, members: DataFrame) -> DataFrame:
        """Links between components inside each group (``class, root, group``), compared block by block.

        Blocks hold a bounded number of sets; two blocks meet in one task as matrices over the shingles they share, so no pairs are
        listed. Of the links found, a task returns those that join components, at most one per set.
        """
        blocks = members.groupBy("group").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
        placed = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        placed = written(placed, "blocks")
        sets = placed.join(self._sets(placed.select("class").distinct()), "class")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        cells = sets.select("class", "root", "group", "block", "hashes", other).select(
            "class", "root", "group", "block", "hashes", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        )
        return written(cells.groupBy("group", "low", "high").applyInArrow(_compare_blocks, "a long, b long"), "links")


def _shared(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one list shares with each of the other."""
    both = np.intersect1d(np.concatenate(one), np.concatenate(other))
    counts = np.zeros((len(one), len(other)), dtype=np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        at = np.searchsorted(both, tokens)
        hit = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == tokens) if len(both) else np.zeros(len(tokens), bool)
        return row[hit], at[hit]

    (rows, columns), (rows_, columns_) = places(one), places(other)
    for start in range(0, len(both), _COLUMNS):
        left, right = (np.zeros((len(sets), _COLUMNS), dtype=np.float32) for sets in (one, other))
        for matrix, r, c in ((left, rows, columns), (right, rows_, columns_)):
            here = (c >= start) & (c < start + _COLUMNS)
            matrix[r[here], c[here] - start] = 1
        counts += left @ right.T
    return counts.astype(np.int32)


def _compare_blocks(cell: pa.Table) -> pa.Table:
    names, roots, blocks = (cell[c].to_numpy() for c in ("class", "root", "block"))
    sets = [np.frombuffer(h, "<u8") for h in cell["hashes"].to_pylist()]
    low, high = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    if cell["low"][0].as_py() != cell["high"][0].as_py() and blocks.min() == blocks.max():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})  # the other block is empty
    sizes = np.array([len(s) for s in sets])
    right = [sets[j] for j in high]
    hits = []
    for start in range(0, len(low), _ROWS):  # a strip of the matrix at a time
        rows = low[start:start + _ROWS]
        shared = _shared([sets[i] for i in rows], right)
        enough = 75 * (sizes[rows][:, None] + sizes[high][None, :]) <= 175 * shared
        enough &= roots[rows][:, None] != roots[high][None, :]
        hits += [(rows[i], high[j]) for i, j in zip(*np.nonzero(enough))]
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := parent.get(v, v)) != v:
            parent[v] = v = parent.get(up, up)
        return v

    found = []
    for i, j in hits:
        one, other = find(int(roots[i])), find(int(roots[j]))
        if one != other:
            parent[one] = other
            found.append(sorted((int(names[i]), int(names[j]))))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _rooted(pairs: DataFrame, roots: DataFrame, *names: str) -> DataFrame:
    """The rows with the root of each named class as ``root_<name>``; a class without links is its own."""
    for name in names:
        own = roots.select(F.col("v").alias(name), F.col("root").alias(f"root_{name}"))
        pairs = pairs.join(own, name, "left").withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))
    return pairs


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, component, text_hash`` of every row, for links of Jaccard similarity 0.75 or more.

    ``component_id`` is the smallest id reachable by links, the row's own included; ``component`` names the component itself (null without
    shingles). Null, empty and blank texts have no shingles and link
    with nothing. Rows may repeat; a row without an id links but names no component. Other columns are ignored.
    """
    spark = docs.sparkSession
    found = written(_shingle_rows(docs), "sets")
    classes = written(found.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("doc_id")), "classes")
    buckets = _BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    signatures = id_and_text(docs).mapInArrow(
        lambda batches: _signatures(batches, buckets), "bucket int, keys binary, classes binary, facts binary"
    )
    met = written(signatures.groupBy("bucket").applyInArrow(_meet, _MET), "met")

    facts = met.where(F.col("kind") == _FACT).select(F.col("a").alias("class"), "size", "own", "low")
    standing = facts.selectExpr(
        "class", "size", "length(bin(size - 1)) - 2 AS band", "own AS filled", "(size + size * 100 div 75) div 7 + 1 AS need"
    ).union(facts.where("low > 0").selectExpr(
        "class", "size", "length(bin(size - 1)) - 3", "low", "(size + shiftleft(2L, length(bin(size - 1)) - 2)) div 7 + 1"
    ))
    is_few = F.col("key").isin([int(np.uint64(few_key(b)).astype(np.int64)) for b in range(60)])
    dear = met.where(F.col("kind") == _DEAR).select("band", "key", F.col("a").alias("class"))
    dear_keys = dear.where(~is_few).groupBy("class", "band").agg(F.count("*").alias("dear"))
    standing = written(
        standing.join(dear_keys, ["class", "band"], "left").withColumn("credits", F.col("filled") - F.coalesce("dear", F.lit(0))), "standing"
    )

    shared = met.where(F.col("kind") == _PAIR).groupBy("a", "b", "band").agg(F.count("*").alias("keys"))
    side = lambda name: standing.select(
        F.col("class").alias(name), "band", F.col("size").alias(f"size_{name}"), F.col("credits").alias(f"credits_{name}")
    )
    differ = F.expr("(size_a + size_b) div 7")
    sizes_fit = 100 * F.least("size_a", "size_b") >= 75 * F.greatest("size_a", "size_b")
    candidates = written(
        shared.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
        .where(sizes_fit & (F.col("keys") >= F.greatest("credits_a", "credits_b") - differ)).select("a", "b"),
        "short-lists",
    )

    # Sets without enough keys of their own meet under the dear ones.
    poor = standing.where("credits < need").select("class", "band", "size", "need", (F.col("credits") / F.col("filled")).alias("own"))
    lists = written(dear.join(poor, ["class", "band"]), "long-lists")
    # The head shares most of its keys: among edited copies, that is the text they come from.
    heads = lists.groupBy("key").agg(F.min(F.struct("own", "class", "size")).alias("head"))
    stars = lists.join(heads, "key").select(
        F.col("head.class").alias("a"), F.col("class").alias("b"), F.col("head.size").alias("size_a"), F.col("size").alias("size_b")
    ).where((F.col("a") != F.col("b")) & sizes_fit).select("a", "b")
    candidates = written(candidates.union(stars).distinct(), "candidates")

    verifier = _Verifier(docs, classes)
    first = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verifier.linked(first)
    roots = written(components(links), "roots")
    # What the first links have not brought together, each pair once: pairs of short lists, and of one-deletion neighbourhoods.
    near, still_poor = _neighbours(verifier, poor)
    rest = candidates.union(near).distinct().join(written(first, "tried"), ["a", "b"], "left_anti")
    links, roots = _extended(verifier, links, roots, _rooted(rest, roots, "a", "b").where("root_a <> root_b").select("a", "b"))
    torn = _torn(_rooted(lists.join(still_poor, ["class", "band"], "left_semi"), roots, "class"))
    if not torn.isEmpty():
        links = links.union(verifier.linked_in_blocks(torn))
        roots = written(components(links), "roots")

    of_class = _rooted(classes.withColumnRenamed("class", "c"), roots, "c")
    ids = of_class.groupBy("root_c").agg(F.min("doc_id").alias("component_id"))
    named = of_class.join(ids, "root_c").select(F.col("c").alias("class"), "component_id", F.col("root_c").alias("component"))
    return found.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "component", "text_hash",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of which one per component stays: the one with the smallest id (null last), then text hash. Rows without shingles all stay.

    Rows of equal id are told apart by their text; entirely equal rows stay or go together. Columns come back as they are.
    """
    found = jaccard_components(docs)
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    grouped = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(place).alias("stays"))
    stays = grouped.select("stays.doc_id", "stays.text_hash").union(
        found.where(F.col("component").isNull()).select("doc_id", "text_hash").distinct()
    ).select(F.col("doc_id").alias("_stays_id"), F.col("text_hash").alias("_stays_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_stays_id")) & (F.col("_hash") == F.col("_stays_hash"))
    return rows.join(stays, same, "left_semi").select("_row.*")


def _neighbours(verifier: _Verifier, poor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that meet in one-deletion neighbourhoods, and the poor sets (``class, band``) for which that is not enough either.

    A segment earns a set two credits if its key and all keys with one shingle less are cheap: then any partner that differs by one shingle there is
    met. It earns one if its own key is cheap, none otherwise. A set with more credits than it can differ from a partner is done with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hashes", 1 << 20):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for name, bands, data in zip(*(batch[c].to_pylist() for c in ("class", "bands", "hashes"))):
                for band in bands:
                    segment, key, full = variants(np.frombuffer(data, "<u8"), band)
                    new = (np.full(len(key), name), np.full(len(key), band, np.int32), segment, key.view(np.int64), full)
                    for column, values in zip(columns, new):
                        column.append(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in columns], names=["class", "band", "segment", "key", "full"]
            )

    bands = poor.groupBy("class").agg(F.collect_list("band").alias("bands"))  # two at most
    sets = verifier._sets(poor.select("class").distinct())
    rows = written(
        sets.join(bands, "class").select("class", "bands", "hashes")
        .mapInArrow(run, "class long, band int, segment int, key long, full boolean"), "neighbourhoods"
    )
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
    cheap = F.col("n") <= LIST
    earned = rows.groupBy("class", "band", "segment").agg(
        F.min(cheap).alias("all_cheap"), F.min(F.when(F.col("full"), cheap)).alias("own_cheap"), F.count("*").alias("keys")
    ).select("class", "band", F.when(F.col("all_cheap") & (F.col("keys") > 1), 2).when(F.col("own_cheap"), 1).otherwise(0).alias("credit"))
    judged = written(
        earned.groupBy("class", "band").agg(F.sum("credit").alias("earned")).join(poor, ["class", "band"])
        .select("class", "band", "size", (F.col("earned") >= F.col("need")).alias("done")), "earned"
    )
    met = rows.where(cheap & (F.col("n") > 1)).join(judged, ["class", "band"])
    one, other = (
        met.select("key", F.col("class").alias(x), F.col("full").alias(f"full_{x}"), F.col("size").alias(f"size_{x}"), F.col("done").alias(f"done_{x}"))
        for x in "ab"
    )
    pairs = one.join(other, "key").where(
        "a < b AND (full_a OR full_b) AND (done_a OR done_b) AND 100 * least(size_a, size_b) >= 75 * greatest(size_a, size_b)"
    ).select("a", "b").distinct()
    return pairs, judged.where("NOT done").select("class", "band")


def _torn(lists: DataFrame) -> DataFrame:
    """``class, root, group`` of what stands in a dear list that is still in several components.

    Classes that share such a list, directly or through others, are a group: any link still missing is inside one.
    """
    open_keys = lists.groupBy("key").agg(
        F.min("root_class").alias("low"), F.max("root_class").alias("high"), F.min("class").alias("head")
    ).where("low < high").select("key", "head")
    rows = written(lists.join(open_keys, "key"), "torn")
    groups = components(rows.where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b")))
    own = rows.select("class", F.col("root_class").alias("root")).distinct()
    return written(own.join(groups.select(F.col("v").alias("class"), F.col("root").alias("group")), "class"), "groups")


def _extended(verifier: _Verifier, links: DataFrame, roots: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    pairs = written(pairs, "more-candidates")
    if pairs.isEmpty():
        return links, roots
    links = links.union(verifier.linked(pairs))
    return links, written(components(links), "roots")
