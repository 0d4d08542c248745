"""Language-model scores of documents, with a word-count base beside them.

Texts become chunks: per chunk a list of its distinct words with their subword ids, and every document as numbers into that list.
Word counts meet by bucket of the word's hash, one line per chunk and bucket, and go back to the chunks the same way; so
the exact count of every word reaches every document although neither words nor counts are ever gathered in one place. The model
(see ``attention``) takes its counts from all training text: those of pairs of subwords meet and go back in the same way, by bucket of the pair.
What is gathered has a line per subword id, whatever the text. Attention weights are trained data-parallel: every task
runs Adam over its share of the windows, and weights are averaged between rounds, those of an id over the tasks that saw it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm import attention
from shiftledger.llm.common import id_and_text, slices, written
from shiftledger.llm.tokens import encoder
from shiftledger.session import shuffle_partitions

STEPS = 600  # that every task makes at least, over all rounds
BATCH = 64
RATE = 0.01
_WINDOWS_PER_TASK = 8192
_PARTS = 64  # sums with a line per subword id are taken in so many parts
_SUMS = "part long, ids binary, sums binary"
_BUCKETS_PER_PARTITION = 4
_CHUNK_BYTES = 8 << 20  # of text; the larger, the fewer words and pairs meet, and the more a task holds
_CHUNK = "kind int, chunk long, bucket int, words binary, counts binary, docs binary, known binary, lengths binary, flat binary, subwords binary, sizes binary, place binary"
_REQUEST, _TEXT, _SINGLES = 0, 1, 2
END_WORD = b""  # no word is empty; numbered 0 in every chunk


def words(text: str) -> list[bytes]:
    """ASCII capitals lowered, cut at ASCII white space: on bytes, lower() and split() know no other."""
    return text.encode().lower().split()


def _numbered(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What ``words`` finds in each text, by Arrow: the distinct words by first place, END_WORD before them; the texts as numbers into this list, each with
    the end at its end; and how many numbers each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = cut.values.dictionary_encode()
    listed = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
    numbers, starts = found.indices.to_numpy(), cut.offsets.to_numpy()
    if "" in listed:  # white space at a text's ends leaves empty pieces
        empty = listed.index("")
        some = numbers != empty
        starts = np.append(0, np.cumsum(some))[starts]
        numbers = numbers[some]
        numbers -= numbers > empty
        del listed[empty]
    lengths = np.diff(starts) + 1
    ends = np.cumsum(lengths) - 1
    flat = np.empty(len(numbers) + len(lengths), dtype="<u4")
    inside = np.ones(len(flat), dtype=bool)
    inside[ends] = False
    flat[inside] = numbers + 1
    flat[ends] = 0
    return [END_WORD.decode(), *listed], flat, lengths.astype("<i4")


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes by first place, and which of them each is: by hashing, which takes a fraction of the time of np.unique."""
    found = pa.array(codes).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _chunks(batches: Iterator[pa.RecordBatch], tokenizer: str, buckets: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    spell, part = encoder(tokenizer), TaskContext.get().partitionId()
    end = np.uint32(spell.vocabulary - 1)
    names = [f.split()[0] for f in _CHUNK.split(", ")]
    singles = np.zeros(spell.vocabulary, dtype=np.int64)
    for number, batch in enumerate(slices(batches, limit=_CHUNK_BYTES)):
        spell.turn()
        listed, flat, lengths = _numbered(batch["text"])
        held = batch["held_out"].to_numpy(zero_copy_only=False)
        counts = np.bincount(flat[np.repeat(~held, lengths)], minlength=len(listed))
        spelled, sizes = spell.spell(listed[1:])
        subwords, sizes = np.append(end, spelled).astype("<u4"), np.append(1, sizes).astype("<i4")
        singles += np.bincount(subwords, weights=np.repeat(counts, sizes), minlength=len(singles)).astype(np.int64)
        # Words in the order of their buckets; place says which number each has in the texts.
        bucket = (np.fromiter(map(xxh3_64_intdigest, listed), np.uint64, len(listed)) % np.uint64(buckets)).astype(np.int64)
        place = np.argsort(bucket, kind="stable")
        ends, start, rows = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist(), 0, []
        chunk = (part << 24) + number
        for b, stop in enumerate(ends):
            if stop > start:
                own = place[start:stop]
                rows.append({
                    "kind": _REQUEST, "chunk": chunk, "bucket": b, "words": " ".join([listed[i] for i in own.tolist()]).encode(),
                    "counts": counts[own].astype("<i8").tobytes(),
                })
            start = stop
        ids = batch["doc_id"]
        rows.append({
            "kind": _TEXT, "chunk": chunk, "docs": ids.fill_null(0).to_numpy().tobytes(),
            "known": np.stack([ids.is_valid().to_numpy(zero_copy_only=False), held]).astype(np.uint8).tobytes(),
            "lengths": lengths.tobytes(), "flat": flat.tobytes(), "subwords": subwords.tobytes(), "sizes": sizes.tobytes(),
            "place": place.astype("<u4").tobytes(),
        })
        yield _batch(rows, names)
    if singles.any():
        used = np.flatnonzero(singles)
        yield _batch([{"kind": _SINGLES, "flat": used.astype("<u4").tobytes(), "counts": singles[used].tobytes()}], names)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "chunk": pa.int64(), "bucket": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.binary())) for n in names], names=names)


class _Text:
    """One chunk's documents, unpacked."""

    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["docs"], "<i8")
        known = np.frombuffer(row["known"], np.uint8).reshape(2, -1).astype(bool)
        self.has_id, self.held = known
        self.lengths, self.flat = np.frombuffer(row["lengths"], "<i4"), np.frombuffer(row["flat"], "<u4").astype(np.int64)
        self._subwords, self._sizes = np.frombuffer(row["subwords"], "<u4"), np.frombuffer(row["sizes"], "<i4")

    def spelled(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The subword ids of a sequence of words, and how many each word has."""
        sizes = self._sizes[flat]
        before = np.cumsum(self._sizes) - self._sizes
        kind = np.int32 if max(before[-1], n := int(sizes.sum())) < 1 << 31 else np.int64
        at = np.repeat((before[flat] - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
        at += np.arange(n, dtype=kind)
        return self._subwords[at], sizes

    def subwords(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The subword ids of the documents marked, end on end, and where each document begins."""
        ids, sizes = self.spelled(self.flat[np.repeat(which, self.lengths)])
        lengths = self.lengths[which].astype(np.int64)
        # Every document has its end word at least.
        own = np.add.reduceat(sizes, np.cumsum(lengths) - lengths, dtype=np.int64) if len(lengths) else lengths
        return ids, np.cumsum(own) - own


def _meet(bucket: pa.Table) -> pa.Table:
    """The count of every word, for each chunk in the order it asked; one more line, of chunk -1, with distinct words and tokens."""
    # Split and told apart by Arrow, not word by word: a bucket holds each chunk's list once.
    lists = pc.split_pattern(bucket["words"].combine_chunks(), " ")
    found = lists.values.dictionary_encode()
    which, counts = found.indices.to_numpy(), np.concatenate([np.frombuffer(c, "<i8") for c in bucket["counts"].to_pylist()])
    total = np.bincount(which, counts).astype("<i8")
    answers = [a.tobytes() for a in np.split(total[which], lists.offsets.to_numpy()[1:-1])]
    seen = np.array([np.count_nonzero(total), total.sum()], dtype="<i8").tobytes()
    return pa.table({
        "chunk": pa.array([*bucket["chunk"].to_pylist(), -1], pa.int64()),
        "bucket": pa.array([*bucket["bucket"].to_pylist(), None], pa.int32()), "counts": pa.array([*answers, seen], pa.binary()),
    })


class Ranks:
    """Subword ids by frequency, each that training text has with a rank of its own: rank 0 is the end mark. The last rank is of ids it never has."""

    def __init__(self, singles: np.ndarray):
        end, found = len(singles) - 1, int(np.count_nonzero(singles[:-1]))
        order = np.append(end, np.argsort(-singles[:-1], kind="stable")[:found])
        self.size, unseen = len(order) + 1, max(1, len(singles) - len(order))
        self.of = np.full(len(singles), self.size - 1, dtype=np.int32)
        self.of[order] = np.arange(len(order))
        #: How often each rank occurs in training text, and what is added for each of its ids.
        self.counts, self.little = np.append(singles[order], 0), np.append(np.full(len(order), 0.1), 0.1 * unseen)
        #: Natural log probability of an id given its rank: nothing tells those never seen apart.
        self.alone = np.where(self.of == self.size - 1, -np.log(unseen), 0).astype(np.float32)

    def seen(self, ids: np.ndarray) -> np.ndarray:
        """The ranks of ids, behind an end mark."""
        found = np.zeros(len(ids) + 1, dtype=np.int64)
        found[1:] = self.of[ids]
        return found

    def pairs(self, seen: np.ndarray) -> np.ndarray:
        """A code for each rank and the one before it."""
        codes = seen[:-1] * self.size
        codes += seen[1:]
        return codes


def _dealt(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in the order of their buckets, and where in this order each bucket ends."""
    bucket = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))


def _ask_pairs(batches: Iterator[pa.RecordBatch], ranks: Ranks, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct pairs by bucket, and how often each is in its training text."""
    for batch in batches:
        for row in batch.to_pylist():
            text = _Text(row)
            ids, begins = text.subwords(np.ones(len(text.lengths), dtype=bool))
            codes, which = _distinct(ranks.pairs(ranks.seen(ids)))
            learn = np.repeat(~text.held, np.diff(np.append(begins, len(ids))))
            counts = np.bincount(which[learn], minlength=len(codes))
            order, ends = _dealt(codes, buckets)
            found, start = [], 0
            for bucket, end in enumerate(ends.tolist()):
                if end > start:
                    own = order[start:end]
                    found.append((row["chunk"], bucket, codes[own].astype("<i8").tobytes(), counts[own].astype("<i4").tobytes()))
                start = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "bucket", "pairs", "counts"]
            )


def _meet_pairs(bucket: pa.Table) -> pa.Table:
    """The count of every pair, for each chunk in the order it asked; one more line, of chunk -1, with all pairs that training text has."""
    asked = [np.frombuffer(p, "<i8") for p in bucket["pairs"].to_pylist()]
    counts = [np.frombuffer(c, "<i4") for c in bucket["counts"].to_pylist()]
    codes, which = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts)).astype("<i8")
    answers = np.split(total[which], np.cumsum([len(a) for a in asked])[:-1])
    nothing, learned = [None] * len(asked), total > 0
    return pa.table({
        "chunk": pa.array([*bucket["chunk"].to_pylist(), -1], pa.int64()), "bucket": pa.array([*bucket["bucket"].to_pylist(), None], pa.int32()),
        "pairs": pa.array([*nothing, codes[learned].tobytes()], pa.binary()),
        "counts": pa.array([*(a.tobytes() for a in answers), total[learned].tobytes()], pa.binary()),
    })


def _in_parts(ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    part = ids % _PARTS
    for p in np.unique(part).tolist():
        own = part == p
        yield pa.RecordBatch.from_arrays([
            pa.array([p], pa.int64()), pa.array([ids[own].astype("<i8").tobytes()], pa.binary()), pa.array([rows[own].astype("<f8").tobytes()], pa.binary()),
        ], names=["part", "ids", "sums"])


def _summed(rows: DataFrame, size: int, width: int) -> np.ndarray:
    """Sums of rows of numbers by id, a line for each id up to size."""

    def add(part: pa.Table) -> pa.Table:
        # One table's rows at a time: a part has one line per id, a task's rows may be as many.
        ids = np.unique(np.concatenate([np.frombuffer(i, "<i8") for i in part["ids"].to_pylist()]))
        total = np.zeros((len(ids), width))
        for own, sums in zip(part["ids"], part["sums"]):
            total[np.searchsorted(ids, np.frombuffer(own.as_py(), "<i8"))] += np.frombuffer(sums.as_py(), "<f8").reshape(-1, width)
        return pa.table({"part": part["part"].slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((size, width))
    for line in rows.groupBy("part").applyInArrow(add, _SUMS).toArrow().to_batches():
        for ids, sums in zip(line["ids"], line["sums"]):
            out[np.frombuffer(ids.as_py(), "<i8")] = np.frombuffer(sums.as_py(), "<f8").reshape(-1, width)
    return out


def _count(pairs: DataFrame, ranks: Ranks) -> attention.Counted:
    """Classes and their counts, from all distinct pairs of training text with their counts."""
    n = ranks.size

    def read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [r for b in batches for r in b.to_pylist()]
        codes, counts = (np.concatenate([np.empty(0, "<i8"), *(np.frombuffer(r[c], "<i8") for r in rows)]) for c in ("pairs", "counts"))
        return codes // n, codes % n, counts

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_parts(*attention.projected(*read(batches), n))

    classes = attention.cluster(_summed(pairs.mapInArrow(project, _SUMS), n, attention.PROJECTED), ranks.counts)
    many = int(classes.max()) + 1

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, after, counts = read(batches)
        cell, which = np.unique(previous * many + classes[after], return_inverse=True)
        yield from _in_parts(cell, np.bincount(which, counts, minlength=len(cell)))

    return attention.Counted.of_classes(classes, ranks.counts, _summed(pairs.mapInArrow(by_class, _SUMS), n * many, 1).reshape(n, many), ranks.little)


def _learned(batches: Iterator[pa.RecordBatch], ranks: Ranks, share: int, shares: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ranks of each chunk's training texts of this share, behind an end mark, and the places of the marks that texts follow."""
    for batch in batches:
        for row in batch.to_pylist():
            text = _Text(row)
            learn = ~text.held
            ids, begins = text.subwords(learn & (np.cumsum(learn) % shares == share))
            if len(ids):
                yield ranks.seen(ids), begins


def _windows(batches: Iterator[pa.RecordBatch], ranks: Ranks, share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray]:
    size = attention.WINDOW + 1
    cut = [(np.empty((0, size), "<u4"), np.empty((0, size - 1), bool)), *(attention.windows(*seen) for seen in _learned(batches, ranks, share, shares))]
    return tuple(np.concatenate(c) for c in zip(*cut))


def _train(texts: DataFrame, ranks: Ranks, subwords: int, counted: attention.Counted, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Averages, over tasks, of the weights each gets from its part of the training text, all of it; as many passes as STEPS asks for.

    A pass is a round; where one pass is enough, it is two rounds of every other text each, so that weights meet halfway. Windows are cut
    anew from the texts in every round, so none is stored.
    """
    spark, n = texts.sparkSession, -(-subwords // attention.WINDOW)
    dealt = texts.coalesce(max(1, min(shuffle_partitions(spark), n // _WINDOWS_PER_TASK)))
    tasks = dealt.rdd.getNumPartitions()
    tables, others, ids = ("query", "key", "value", "gate"), ("near", "out"), ranks.size
    width, sizes = 4 * attention.WIDTH, np.cumsum([weights[k].size for k in others])
    lines = -(-int(sizes[-1]) // width)
    passes = max(1, -(-STEPS * BATCH * max(1, tasks) // n)) if n else 0
    passes = min(passes, STEPS // 20)  # a handful of windows is not learned by heart
    shares = 2 if passes == 1 else 1
    rounds = passes * shares
    for number in range(rounds):
        shared = spark.sparkContext.broadcast((weights, counted, ranks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, counts, ranks = shared.value
            data, valid = _windows(batches, ranks, number % shares, shares)  # noqa: B023
            if not len(data):
                return
            got, steps = attention.train(now, counts, data, valid, RATE * (1 - number / rounds), BATCH, number)  # noqa: B023
            # An id's weights count by the steps in which the task changed them, the others alike; the last number of a line is what it counts.
            used = np.flatnonzero(steps)
            rows = np.column_stack([*(got[k][used] for k in tables), np.ones(len(used))]) * steps[used][:, None]
            rest = np.resize(np.concatenate([got[k].ravel() for k in others]), (lines, width))
            yield from _in_parts(np.append(used, ids + np.arange(lines)), np.concatenate([rows, np.column_stack([rest, np.ones(lines)])]))

        sums = _summed(dealt.mapInArrow(run, _SUMS), ids + lines, width + 1)
        shared.destroy()
        used = np.flatnonzero(sums[:ids, -1])
        mean = (sums[:, :-1] / np.maximum(sums[:, -1:], 1)).astype(np.float32)
        weights = {k: v.copy() for k, v in weights.items()}
        for k, rows in zip(tables, np.split(mean[used], 4, axis=1)):
            weights[k][used] = rows
        if sums[ids:, -1].any():
            for k, flat in zip(others, np.split(mean[ids:].ravel()[:sizes[-1]], sizes[:-1])):
                weights[k] = flat.reshape(weights[k].shape)
    return weights


def score(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; scores are log10 of whole texts.

    Words are cut at ASCII white space and ASCII capitals lowered; every text ends with an end token. Null text is the end alone. Learned from
    rows whose crc32 of the id as text is not divisible by ten; rows without an id are held out. The base is a smoothed count of
    words. The model spells each word, behind a space, in subwords of the tokenizer file, whose last id marks the end.
    Ids may repeat; other columns are ignored. Without training rows the model falls back to even odds.
    """
    spark = docs.sparkSession
    buckets = _BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True)).alias("held_out")
    chunks = written(id_and_text(docs, held).mapInArrow(lambda b: _chunks(b, tokenizer, buckets), _CHUNK), "chunks", "zstd")
    texts = chunks.where(F.col("kind") == _TEXT).drop("kind", "bucket", "words", "counts")

    asked = chunks.where(F.col("kind") == _REQUEST).select("chunk", "bucket", "words", "counts")
    answers = written(asked.groupBy("bucket").applyInArrow(_meet, "chunk long, bucket int, counts binary"), "word-counts", "zstd")
    distinct = tokens = 0
    for line in answers.where("chunk = -1").select("counts").toLocalIterator():  # one short line per bucket
        d, t = np.frombuffer(line["counts"], "<i8").tolist()
        distinct, tokens = distinct + d, tokens + t

    def singles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, counts in zip(batch["flat"].to_pylist(), batch["counts"].to_pylist()):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(ids, "<u4").astype(np.int64)), pa.array(np.frombuffer(counts, "<i8")),
                ], names=["id", "n"])

    single = chunks.where(F.col("kind") == _SINGLES).select("flat", "counts").mapInArrow(singles_of, "id long, n long")
    single = single.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    singles = np.zeros(encoder(tokenizer).vocabulary, dtype=np.int64)
    singles[single["id"].to_numpy()] = single["n"].to_numpy()
    ranks = Ranks(singles)

    texts_alone = texts.select("docs", "known", "lengths", "flat", "subwords", "sizes")
    pair_buckets = shuffle_partitions(spark)
    asked = texts.mapInArrow(lambda b: _ask_pairs(b, ranks, pair_buckets), "chunk long, bucket int, pairs binary, counts binary")
    pairs = written(asked.groupBy("bucket").applyInArrow(_meet_pairs, asked.schema), "pair-counts", "zstd")
    counted = _count(pairs.where("chunk = -1").select("pairs", "counts").coalesce(_PARTS), ranks)
    weights = _train(
        texts_alone, ranks, int(singles.sum()), counted, attention.fresh_weights(*counted.classes_after.shape)
    )
    answers = answers.where("chunk >= 0").union(
        pairs.where("chunk >= 0").select("chunk", (F.col("bucket") + buckets).alias("bucket"), "counts")
    )
    model = spark.sparkContext.broadcast((ranks, counted, weights))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        got = sorted(zip(right["bucket"].to_pylist(), right["counts"].to_pylist()))
        for row in left.to_pylist():
            text = _Text(row)
            counts = np.empty(len(text._sizes), dtype=np.int64)
            counts[np.frombuffer(row["place"], "<u4")] = np.frombuffer(b"".join(c for b, c in got if b < buckets), "<i8")
            base = np.log10((counts + 0.1) / (tokens + 0.1 * (distinct + 1)))
            starts = np.cumsum(text.lengths) - text.lengths
            per_doc = lambda values: np.add.reduceat(values, starts, dtype=np.float64)  # noqa: B023, E731
            ranks, counted, weights = model.value
            ids, begins = text.subwords(np.ones(len(starts), dtype=bool))
            seen = ranks.seen(ids)
            codes, which = _distinct(ranks.pairs(seen))
            often = np.empty(len(codes), dtype=np.int64)
            often[_dealt(codes, pair_buckets)[0]] = np.frombuffer(b"".join(c for b, c in got if b >= buckets), "<i8")
            counted.inside = replace(counted.inside, pairs=codes, counts=often)
            log = attention.score(weights, counted, seen, begins, which) + ranks.alone[ids]
            scores = np.add.reduceat(log, begins, dtype=np.float64) / np.log(10)
            parts.append(pa.table({
                "doc_id": pa.array(text.docs, mask=~text.has_id), "held_out": pa.array(text.held),
                "n_tokens": pa.array(text.lengths.astype(np.int64)),
                "n_known": pa.array(per_doc((counts > 0)[text.flat]).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(starts), tokens)),
                "base_score": pa.array(per_doc(base[text.flat])), "score": pa.array(scores),
            }))
        return pa.concat_tables(parts) if parts else _NOTHING

    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, _SCORED)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_NOTHING = pa.table({
    "doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()),
    "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()),
    "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()),
})
