"""How far the sources of a language are from one another, by in-mapper stripes.

A task folds whole documents into stripes: for every term of a language its document frequency and its counts by source. Stripes
are spilled whenever the task holds ``SPILL`` counts, packed into one block per language and bucket of the term's hash. The blocks of a
bucket merge into one stripe per term, of which those with enough documents stay. So a term crosses the network once for
each spill, however often it occurs.

The merged stripes, beside the language's totals, emit the divergences directly: with counts smoothed into shares p (of a group) and q (of
another group or of the language), a term adds ``(p - q)**2 / q``. Terms that two sources both lack add one constant, so a block costs
its counts times the sources, not its terms times their pairs. What a task found about a source leaves it as lists, a row per source and
part: the sums of pairs are added up over the tasks, and of the terms' lists, each cut to the best, the best are taken.

All arithmetic is on whole numbers, and the sums do not depend on how documents are dealt.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import ship, slices, written
from shiftledger.session import shuffle_partitions

MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
#: Counts (of a term in a source) that a task holds before it spills.
SPILL = 500_000
_TEXT = 1 << 20  # bytes of one text cut into words at a time
_CELLS = 1 << 22  # sums of source pairs, and cells of a dense strip, that a task holds
_BUCKETS_PER_PARTITION = 4
_STRIP = 1024  # other sources whose sums are added up together
#: Letters stay, capitals become small, bytes of longer characters stay; everything else parts terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLOCK = "bucket int, lang string, names array<string>, terms binary, df binary, sizes binary, codes binary, counts binary"
_KEPT = "lang string, bucket int, n_terms long, names array<string>, sums array<long>, terms binary, sizes binary, codes binary, counts binary"
_FOUND = "lang string, source string, part string, item string, value long"
_LISTED = "lang string, source string, part string, strip int, items array<string>, amounts array<long>"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch of it at a time."""
    clean = text.translate(_TERM)
    start = 0
    while start < len(clean):
        stop = len(clean) if start + _TEXT >= len(clean) else clean.find(b" ", start + _TEXT)
        stop = len(clean) if stop < 0 else stop
        yield clean[start:stop].split()
        start = stop


class Stripes:
    """Term to document frequency and source counts, by language."""

    def __init__(self) -> None:
        self.held = 0
        self._found: dict[str, tuple[Counter, dict[str, Counter]]] = {}

    def add(self, lang: str, source: str, text: bytes) -> None:
        documents, sources = self._found.setdefault(lang, (Counter(), {}))
        own = sources.setdefault(source, Counter())
        before, seen = len(own), set()
        for part in words(text):
            own.update(part)
            seen.update(part)
        documents.update(seen)
        self.held += len(own) - before

    def spill(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Blocks of all stripes, which are then forgotten; the groups themselves go to bucket 0, terms or not."""
        import xxhash

        rows = []
        for lang, (documents, sources) in self._found.items():
            names = list(sources)
            rows.append((0, lang, names, *[b""] * 5))
            terms = list(documents)
            if not terms:
                continue
            number = dict(zip(terms, range(len(terms))))
            lengths = [len(own) for own in sources.values()]
            term = np.fromiter((number[t] for own in sources.values() for t in own), np.int64, sum(lengths))
            count = np.fromiter((n for own in sources.values() for n in own.values()), np.int64, sum(lengths))
            code = np.repeat(np.arange(len(names), dtype=np.int32), lengths)
            bucket_of = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms)) % np.uint64(buckets)
            place = np.argsort(bucket_of, kind="stable")  # terms by bucket
            rank = np.empty(len(terms), np.int64)
            rank[place] = np.arange(len(terms))
            order = np.argsort(rank[term], kind="stable")
            sizes = np.bincount(rank[term], minlength=len(terms))
            df = np.fromiter(documents.values(), np.int64, len(terms))[place]
            code, count, starts = code[order], count[order], np.append(0, np.cumsum(sizes))
            edges = np.append(0, np.cumsum(np.bincount(bucket_of.astype(np.int64), minlength=buckets)))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                low, high = int(edges[b]), int(edges[b + 1])
                at, to = int(starts[low]), int(starts[high])
                used, own = np.unique(code[at:to], return_inverse=True)
                rows.append((
                    b, lang, [names[i] for i in used.tolist()], b" ".join([terms[i] for i in place[low:high].tolist()]), df[low:high].tobytes(),
                    sizes[low:high].astype(np.int32).tobytes(), own.astype(np.int32).tobytes(), count[at:to].tobytes(),
                ))
        kinds = [pa.int32(), pa.string(), pa.list_(pa.string()), *[pa.binary()] * 5]
        names = ["bucket", "lang", "names", "terms", "df", "sizes", "codes", "counts"]
        for i in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 512]), kinds)], names=names)
        self._found, self.held = {}, 0


def _fold(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for part in slices(batches):
        columns = (part["lang"].to_pylist(), part["source"].to_pylist(), part["text"].cast(pa.binary()).to_pylist())
        for lang, source, text in zip(*columns):
            stripes.add(lang, source, text)
            if stripes.held >= SPILL:
                yield from stripes.spill(buckets)
    yield from stripes.spill(buckets)


def _terms(blobs: list[bytes]) -> pa.Array:
    """The terms of some blocks, one after the other; no term holds a blank."""
    joined = b" ".join(b for b in blobs if b)
    return pc.split_pattern(pa.array([joined.decode()], pa.large_string()), " ").values if joined else pa.array([], pa.large_string())


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each, in whole numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(values[order], starts) if len(starts) else np.empty(0, np.int64)


def _merge(min_docs: int):
    def run(bucket: pa.Table) -> pa.Table:
        """One block per language of a bucket: the stripes of the terms that enough documents hold."""
        langs, rows = bucket["lang"].to_pylist(), []
        for lang in sorted(set(langs)):
            own = bucket.filter(pa.array([x == lang for x in langs]))
            names, codes = {}, []
            for given, code in zip(own["names"].to_pylist(), own["codes"].to_pylist()):
                number = np.array([names.setdefault(n, len(names)) for n in given], dtype=np.int64)
                codes.append(number[np.frombuffer(code, np.int32)] if code else np.empty(0, np.int64))
            whole = lambda name, kind: np.frombuffer(b"".join(own[name].to_pylist()), kind)  # noqa: B023, E731
            coded = _terms(own["terms"].to_pylist()).dictionary_encode()
            term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, documents = _sums(term, whole("df", np.int64))
            kept = documents >= min_docs
            width = len(names)
            key, count = _sums(np.repeat(term, whole("sizes", np.int32)) * width + np.concatenate(codes), whole("counts", np.int64))
            on = kept[key // width] if len(key) else np.empty(0, bool)
            key, count = key[on], count[on]
            source, total = _sums(key % width, count)
            sums = np.zeros(width, dtype=np.int64)
            sums[source] = total
            staying = coded.dictionary.filter(pa.array(kept, pa.bool_())).to_pylist()
            sizes = np.bincount(key // width, minlength=len(kept))[kept]
            rows.append((
                lang, bucket["bucket"][0].as_py(), len(staying), list(names), sums.tolist(), " ".join(staying).encode(), sizes.astype(np.int32).tobytes(),
                (key % width).astype(np.int32).tobytes(), count.tobytes(),
            ))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split(" ")[0] for f in _KEPT.split(", ")])

    return run


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / whole)``, by long division in thousands so that counts up to 2**53 do not overflow."""
    head, rest = np.divmod((counts + 1) * 1000, whole)
    middle, rest = np.divmod(rest * 1000, whole)
    return 1 + (head * 1000 + middle) * 1000 + rest * 1000 // whole


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Block:
    """The kept stripes of one block beside the totals of its language; sources as numbers into the language's list."""

    def __init__(self, row: dict):
        self.lang, self.sources = row["lang"], row["sources"]
        number = {s: i for i, s in enumerate(self.sources)}
        codes = np.array([number[n] for n in row["names"]], dtype=np.int64)[np.frombuffer(row["codes"], np.int32)] if row["codes"] else np.empty(0, np.int64)
        self.terms = _terms([row["terms"]])
        self.term = np.repeat(np.arange(row["n_terms"]), np.frombuffer(row["sizes"], np.int32))
        self.code, count = codes, np.frombuffer(row["counts"], np.int64)
        whole = np.array(row["totals"], dtype=np.int64) + row["v"]
        self.share = shares(count, whole[codes])
        self.absent = shares(np.zeros(len(whole), np.int64), whole) if row["v"] else np.ones(len(whole), np.int64)
        _, everywhere = _sums(self.term, count)
        everywhere = shares(everywhere, int(sum(row["totals"])) + row["v"]) if row["v"] else everywhere
        self.of_lang = everywhere[self.term] if len(count) else np.empty(0, np.int64)
        by_source = np.argsort(codes, kind="stable")
        self._by_source = by_source, np.append(0, np.cumsum(np.bincount(codes, minlength=len(whole))))

    def pairs(self, first: int, stop: int) -> np.ndarray:
        """Sums of the terms here for sources first to stop - 1 (rows) against every source (columns)."""
        n, width = len(self.terms), len(self.sources)
        order, starts = self._by_source
        filled = np.flatnonzero(np.diff(starts))
        found = np.empty((stop - first, width), dtype=np.int64)
        strip = max(1, _CELLS // width)
        for s in range(first, stop):
            lacking = gaps(self.absent[s], self.absent)  # a term that neither has
            found[s - first] = n * lacking
            mine = order[starts[s]:starts[s + 1]]
            has = np.zeros(n, dtype=bool)
            has[self.term[mine]] = True
            # Terms that only the other has.
            change = np.where(has[self.term], 0, gaps(self.absent[s], self.share) - lacking[self.code])[order]
            if len(filled):
                found[s - first, filled] += np.add.reduceat(change, starts[filled])
            # Terms that this source has, against all sources.
            entry = np.flatnonzero(has[self.term])
            slot = np.cumsum(has) - 1
            for low in range(0, len(mine), strip):
                part = mine[low:low + strip]
                p = np.tile(self.absent, (len(part), 1))
                here = entry[(slot[self.term[entry]] >= low) & (slot[self.term[entry]] < low + strip)]
                p[slot[self.term[here]] - low, self.code[here]] = self.share[here]
                own = self.share[part][np.argsort(slot[self.term[part]], kind="stable")]
                found[s - first] += gaps(own[:, None], p).sum(axis=0) - len(part) * lacking
        return found

    def top(self, n: int) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Per source the n terms that stand out most from the language: source numbers, terms, values."""
        out = np.flatnonzero(self.share > self.of_lang)
        value = gaps(self.share[out], self.of_lang[out])
        name = np.empty(len(self.terms), dtype=np.int64)
        name[pc.sort_indices(self.terms.cast(pa.large_binary())).to_numpy()] = np.arange(len(self.terms))
        chosen = first_of(self.code[out], value, name[self.term[out]], n)
        return self.code[out][chosen], self.terms.take(pa.array(self.term[out][chosen])).to_pylist(), value[chosen]


def first_of(group: np.ndarray, value: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Of each group the n rows of greatest value, by the smallest tie."""
    order = np.lexsort((tie, -value, group))
    group = group[order]
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    return order[place < n]


def _emit(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Sums of source pairs and the terms that stand out, gathered over the blocks of a task."""
    names = [*(f.split(" ")[0] for f in _FOUND.split(", ")), "strip"]
    sums: dict[str, tuple[list[str], np.ndarray]] = {}
    best: dict[tuple[str, str], tuple[list[str], list[int]]] = {}

    def rows(lang: list, source: list, part: str, item: list, value: np.ndarray, strip: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(lang), 65536):
            cut = slice(i, i + 65536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang[cut], pa.string()), pa.array(source[cut], pa.string()), pa.array([part] * len(lang[cut])),
                 pa.array(item[cut], pa.string()), pa.array(value[cut], pa.int64()), pa.array(strip[cut], pa.int32())], names=names)

    def matrix(lang: str, sources: list[str], first: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, other = (x.ravel() for x in np.indices(values.shape))
        on = one + first != other
        own, item = ([sources[i] for i in x[on].tolist()] for x in (one + first, other))
        yield from rows([lang] * len(own), own, "pair", item, values.ravel()[on], other[on] // _STRIP)

    def cut(key: tuple[str, str]) -> None:
        terms, values = best[key]
        value = np.array(values, dtype=np.int64)
        tie = np.empty(len(terms), dtype=np.int64)
        tie[pc.sort_indices(pa.array(terms, pa.large_string()).cast(pa.large_binary())).to_numpy()] = np.arange(len(terms))
        chosen = first_of(np.zeros(len(terms), np.int64), value, tie, top).tolist()
        best[key] = [terms[i] for i in chosen], [values[i] for i in chosen]

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (sources, values) in sums.items():
            yield from matrix(lang, sources, 0, values)
        for key in best:
            cut(key)
        for (lang, source), (terms, values) in best.items():
            yield from rows([lang] * len(terms), [source] * len(terms), "term", terms, np.array(values, dtype=np.int64), np.zeros(len(terms), np.int32))
        sums.clear()
        best.clear()

    for batch in slices(batches, "terms"):
        for row in batch.to_pylist():
            block = Block(row)
            width = len(block.sources)
            if width * width <= _CELLS:
                if block.lang not in sums and sum(v.size for _, v in sums.values()) + width * width > _CELLS:
                    yield from flush()
                held = sums.setdefault(block.lang, (block.sources, np.zeros((width, width), dtype=np.int64)))
                held[1][...] += block.pairs(0, width)
            else:
                step = max(1, _CELLS // width)
                for first in range(0, width, step):
                    yield from matrix(block.lang, block.sources, first, block.pairs(first, min(width, first + step)))
            code, terms, values = block.top(top)
            edges = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(code)]):
                key = block.lang, block.sources[int(code[a])]
                held = best.setdefault(key, ([], []))
                held[0].extend(terms[a:b])
                held[1].extend(values[a:b].tolist())
                if len(held[0]) > 16 * top:
                    cut(key)
            if sum(len(t) for t, _ in best.values()) > _CELLS:
                yield from flush()
    yield from flush()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one source, part and strip as lists."""
    names = [f.split(" ")[0] for f in _LISTED.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.append(True, np.zeros(batch.num_rows - 1, dtype=bool))
        for key in names[:4]:
            own = batch[key].dictionary_encode().indices.to_numpy()
            new[1:] |= own[1:] != own[:-1]
        starts = np.flatnonzero(new)
        edges = pa.array(np.append(starts, batch.num_rows), pa.int32())
        keys = [batch[key].take(pa.array(starts)) for key in names[:4]]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(edges, batch[c]) for c in ("item", "value"))], names=names)


def _gathered(top: int):
    def run(own: pa.Table) -> pa.Table:
        """One source over all tasks: the sums of its pairs with a strip of others, or the best of its terms, each of which is in one list only."""
        items, values = (own[c].combine_chunks().flatten() for c in ("items", "amounts"))
        if own["part"][0].as_py() == "pair":
            coded = items.dictionary_encode()
            _, sums = _sums(coded.indices.to_numpy().astype(np.int64), values.to_numpy())
            items, values = coded.dictionary, pa.array(sums, pa.int64())
        else:
            tie = np.empty(len(items), dtype=np.int64)
            tie[pc.sort_indices(items.cast(pa.large_binary())).to_numpy()] = np.arange(len(items))
            chosen = pa.array(first_of(np.zeros(len(items), np.int64), values.to_numpy(), tie, top))
            items, values = items.take(chosen), values.take(chosen)
        keys = {key: own[key].take(pa.array(np.zeros(len(items), np.int64))) for key in ("lang", "source", "part")}
        return pa.table({**keys, "item": items, "value": values})

    return run


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others, and by which terms from the language.

    Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z made small; those in at least ``min_docs`` documents of a
    language count. Part ``pair`` has a row for each other source of the language, part ``term`` the ``top`` terms that a source uses more than
    the language does. Ranks go from the greatest value down, ties by the item's UTF-8 bytes. Null text, lang and source are ''. Rows that
    repeat are documents of their own; a document's id plays no part, and other columns are ignored. A language without kept terms has
    pairs of value 0 and no terms, one with a single source no pairs; an empty table gives no rows. Texts are read whole, however long.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = _BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    blocks = rows.mapInArrow(lambda batches: _fold(batches, buckets), _BLOCK)
    kept = written(blocks.groupBy("bucket").applyInArrow(_merge(min_docs), _KEPT), "stripes")

    by_source = kept.select("lang", F.inline(F.arrays_zip("names", "sums"))).groupBy("lang", F.col("names").alias("source")).agg(F.sum("sums").alias("n"))
    listed = by_source.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("all"))  # a line per source
    sizes = kept.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    totals = sizes.join(listed, "lang").select("lang", "v", F.col("all.source").alias("sources"), F.col("all.n").alias("totals"))
    # By language and bucket, so that no language is one key.
    spread = totals.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    found = written(kept.join(spread, ["lang", "bucket"]).mapInArrow(lambda batches: _listed(_emit(batches, top)), _LISTED), "divergences")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.groupBy("lang", "source", "part", "strip").applyInArrow(_gathered(top), _FOUND).withColumn("rank", F.row_number().over(order))
