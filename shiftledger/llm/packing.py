"""Mixture-controlled packing by deficit round-robin over source queues.

Each source has a queue of tokens: its documents, one after the other. In every round a source is credited its
target share of a window; whole tokens are served at once and the fraction stays as its deficit for the next round. The served
tokens form one stream, which is cut into windows. So a window holds the target proportions to within one
token per source, and only the very last window can be short.

What a source has been credited after ``r`` rounds is ``floor(quantum * r)``. So the state of the round-robin at any
round, deficits included, needs no walk: a task computes it for the rounds its documents fall in, and
partitions run in parallel while deficits carry over exactly. When a source runs dry the round-robin
goes on with the others; such a change is a phase. The plan lists phases and holds one line per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import id_and_text, slices, written
from shiftledger.llm.tokens import END, encoder

WINDOW = 2048
#: Target shares are fractions of this. With it, 64-bit numbers last for 2**34 rounds of 2048 tokens.
_SCALE = 1 << 18
_NO_SOURCE = "\0"
_CELLS = 1 << 18  # rounds times sources looked at together
_IDS = 1 << 20  # bytes of ids placed together
_STRETCH = 1 << 16  # tokens of one queue placed together
_PIECES = 1 << 17  # pieces returned together


class Phase:
    """Rounds in which the same sources are served."""

    def __init__(self, sources: np.ndarray, shares: np.ndarray, taken: np.ndarray, left: np.ndarray, start: int, window: int):
        self.sources, self.start, self.window = sources, start, window
        self._credit = shares * window  # tokens a round, times the sum of the shares
        self._sum = int(shares.sum())
        self.taken = taken  # what each source had been served before
        self.rounds = int(((left + 1) * self._sum - 1).astype(object).__floordiv__(self._credit.astype(object)).min())
        self.served = self.upto(np.array([self.rounds]))[0]
        self.length = int(self.served.sum())

    def upto(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens served to each source (columns) in the first so many rounds (rows)."""
        return rounds.reshape(-1, 1) * self._credit // self._sum

    def chunks(self, k: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens a to b - 1 of the k-th source's queue, counted from this phase on: starts, ends, places in the stream.

        Only rounds that serve one of these tokens are looked at, some at a time: a rare source is passed over in most.
        """
        credit, total = int(self._credit[k]), self._sum
        first = ((a + 1) * total + credit - 1) // credit - 1  # the round that serves token a
        last = (b * total + credit - 1) // credit - 1
        in_a_row = last - first < b - a
        n, step = last - first + 1 if in_a_row else b - a, max(1, _CELLS // len(self.sources))
        found = []
        for low in range(0, n, step):
            if in_a_row:
                served = self.upto(np.arange(first + low, first + min(n, low + step) + 1, dtype=np.int64))
                now, after = served[:-1], served[1:]
            else:  # a round serves one token at most
                rounds = (np.arange(a + low + 1, a + min(n, low + step) + 1, dtype=np.int64) * total + credit - 1) // credit - 1
                now, after = self.upto(rounds), self.upto(rounds + 1)
            mine = now[:, k]
            begin = self.start + now[:, k:].sum(axis=1) + after[:, :k].sum(axis=1) - mine
            lo, hi = np.maximum(mine, a), np.minimum(after[:, k], b)
            found.append((lo, hi, begin + lo))
        lo, hi, at = (np.concatenate(x) for x in zip(*found))
        full = hi > lo
        return lo[full], hi[full], at[full]


class Flush:
    """The rest of a source that has not enough for one more round."""

    def __init__(self, source: int, taken: int, left: int, start: int):
        self.source, self.taken, self.length, self.start = source, taken, left, start


def plan_mixture(totals: list[int], targets: list[float] | None = None, window: int = WINDOW) -> list[Phase | Flush]:
    """The phases for queues of so many tokens; targets are relative, by default the totals."""
    weights = np.array(totals if targets is None else targets, dtype=float)
    left, taken = np.array(totals, dtype=np.int64), np.zeros(len(totals), dtype=np.int64)
    active, start = [i for i in range(len(totals)) if totals[i]], 0
    plan: list[Phase | Flush] = []
    while active:
        which = np.array(active)
        w = weights[which]
        share = w / w.sum() if w.sum() > 0 else np.full(len(which), 1 / len(which))
        phase = Phase(which, np.maximum(1, np.round(share * _SCALE)).astype(np.int64), taken[which].copy(), left[which], start, window)
        if phase.rounds:
            plan.append(phase)
            left[which] -= phase.served
            taken[which] += phase.served
            start += phase.length
        ahead = phase.upto(np.array([phase.rounds, phase.rounds + 1]))
        for i, need in zip(active, ahead[1] - ahead[0]):
            if left[i] < need or not left[i]:
                if left[i]:
                    plan.append(Flush(i, int(taken[i]), int(left[i]), start))
                    start += int(left[i])
                    left[i] = 0
        active = [i for i in active if left[i]]
    return plan


def places(plan: list[Phase | Flush], source: int, a: int, b: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens a to b - 1 of a source's queue go, cut at windows: starts, ends, places in the stream, by start."""
    found = []
    for step in plan:
        if isinstance(step, Flush):
            if step.source != source:
                continue
            first, until = step.taken, step.taken + step.length
            lo, hi = max(a, first), min(b, until)
            if lo < hi:
                found.append((np.array([lo]), np.array([hi]), np.array([step.start + lo - first])))
            continue
        k = int(np.searchsorted(step.sources, source))
        if k == len(step.sources) or step.sources[k] != source:
            continue
        first = int(step.taken[k])
        lo, hi = max(a, first), min(b, first + int(step.served[k]))
        if lo < hi:
            starts, ends, at = step.chunks(k, lo - first, hi - first)
            found.append((starts + first, ends + first, at))
    starts, ends, at = (np.concatenate(x) for x in zip(*found))
    # A stretch that crosses the border of a window, or of several, falls into one part for each.
    parts = (at + (ends - starts) - 1) // window - at // window + 1
    if (parts > 1).any():
        which = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        border = (at[which] // window + number) * window
        new_at = np.maximum(at[which], border)
        new_end = np.minimum(at[which] + (ends - starts)[which], border + window)
        starts, ends, at = starts[which] + new_at - at[which], starts[which] + new_end - at[which], new_at
    return starts, ends, at


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Neighbouring stretches of a buffer as binary values, without a copy."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _tokenize(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """The ids of every text and where in its task's share of the source's queue they begin."""
    words, part = encoder(tokenizer), TaskContext.get().partitionId()
    small = words.vocabulary <= 1 << 16
    stop = np.array([END], "<u4").tobytes()
    queued: dict[str, int] = {}
    for batch in slices(batches):
        ids = words.encode(batch["text"].to_pylist())
        n, before = [len(x) // 4 + 1 for x in ids], []
        for source, count in zip(batch["source"].to_pylist(), n):
            before.append(queued.get(source, 0))
            queued[source] = before[-1] + count
        flat = np.frombuffer(stop.join([*ids, b""]), "<u4")
        flat = flat.astype("<u2") if small else flat
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], batch["source"], pa.array(np.full(len(ids), part, np.int32)), pa.array(before, pa.int64()), pa.array(n, pa.int64()),
            _binary(flat, np.cumsum(n) * flat.itemsize),
        ], names=["doc_id", "source", "part", "before", "n", "ids"])


def _place(batches: Iterator[pa.RecordBatch], plan: list[Phase | Flush], number: dict[str, int], window: int) -> Iterator[pa.RecordBatch]:
    """The pieces of every document. Documents that follow one another in a queue are placed together and then cut at their borders."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source"]
    for batch in slices(batches, "ids", _IDS):
        n = batch["n"].to_numpy()
        first = batch["base"].to_numpy() + batch["before"].to_numpy()
        data = batch["ids"].to_pylist()
        queue = np.array([number[s] for s in batch["source"].to_pylist()])
        order = np.lexsort((first, queue))
        follows = (queue[order][1:] == queue[order][:-1]) & (first[order][1:] == (first + n)[order][:-1])
        held: list[tuple[np.ndarray, ...]] = []

        def pieces() -> pa.RecordBatch:
            which, start, length, at, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            rows = pa.array(which)
            return pa.RecordBatch.from_arrays([
                batch["doc_id"].take(rows), pa.array(start), pa.array(length), _binary(ids, np.cumsum(length) * 4), batch["n"].take(rows),
                pa.array(at // window), pa.array(at % window), batch["source"].take(rows),
            ], names=names)

        for rows in np.split(order, np.flatnonzero(~follows) + 1):
            begins = first[rows]
            joined = b"".join([data[i] for i in rows.tolist()])
            low, high = int(begins[0]), int(begins[-1] + n[rows[-1]])
            ids = np.frombuffer(joined, "<u2" if len(joined) < 4 * (high - low) else "<u4")
            for a in range(low, high, _STRETCH):
                b = min(high, a + _STRETCH)
                starts, _, at = places(plan, int(queue[rows[0]]), a, b, window)
                cuts = np.union1d(starts, begins[(begins > a) & (begins < b)])
                within = np.searchsorted(starts, cuts, side="right") - 1
                owner = np.searchsorted(begins, cuts, side="right") - 1
                held.append((rows[owner], cuts - begins[owner], np.diff(np.append(cuts, b)), at[within] + cuts - starts[within], ids[a - low:b - low].astype("<u4")))
                if sum(len(h[0]) for h in held) >= _PIECES:
                    yield pieces()
        if held:
            yield pieces()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Packs every token of ``docs`` (``doc_id, text, source``) into sequences of ``window`` tokens.

    A document is its ids by the tokenizer file, then the id 1; null text is empty, so it is the id 1 alone. Rows without a source
    are a queue of their own. Returns one row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, source``; ``ids`` are
    little-endian unsigned 32-bit. Every sequence is full but the last. ``targets`` gives relative token shares by
    source; sources it lacks count as 0 and are served last. By default they are the sources' shares of all tokens.
    Ids may be null or repeat, texts be of any length; an empty table gives no pieces. Other columns are ignored.

    The plan has a line per source and phase, so it suits thousands of sources, not millions; what else a task holds does not grow with sources
    or with the rarity of one. A source that is due less than a token a window gives pieces of one token.
    """
    rows = id_and_text(docs, F.coalesce(F.col("source").cast("string"), F.lit(_NO_SOURCE)).alias("source"))
    queues = written(
        rows.mapInArrow(lambda batches: _tokenize(batches, tokenizer), "doc_id long, source string, part int, before long, n long, ids binary"), "queues"
    )
    # Where each partition's share of a queue begins: one line per partition and source.
    by_part = queues.groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(by_part.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "queue-starts")
    totals = {r["source"]: r["n"] for r in base.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()}
    names = list(totals)
    wanted = None if targets is None else [float(targets.get(None if s == _NO_SOURCE else s, 0)) for s in names]
    plan = plan_mixture(list(totals.values()), wanted, window)
    number = {s: i for i, s in enumerate(names)}
    placed = queues.join(base.select("source", "part", "base"), ["source", "part"]).select("doc_id", "source", "base", "before", "n", "ids").mapInArrow(
        lambda batches: _place(batches, plan, number, window),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string"
    )
    return placed.withColumn("source", F.when(F.col("source") != _NO_SOURCE, F.col("source")))
