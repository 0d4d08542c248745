"""Repair of conversation structure by a rank-convergence parallel Viterbi.

A conversation is sound if its roles read ``(system? (user assistant)+)?``. Every row is kept, given another role or deleted, and empty rows
may be inserted; the cheapest edits win, of equally cheap ones those whose initials come first in ASCII order.

The least cost of mending what is left, by the four states of that pattern, is a vector per row, worked out from the back. Long runs are cut into
chunks, inside a task (all chunks advance in step, as lanes of arrays) and across tasks (a range-partitioned conversation may cover many).
Every chunk starts from a speculative cost vector. Fix-up passes run a chunk again from the vector its successor really has, and stop
where the vector differs from the earlier one only by a constant: from there on the chunk was right. What decides is the difference of costs, so
vectors are kept without their constant. Edits follow from the vectors behind each row, whatever stands before; the state at a chunk's start
comes from the stitched chunks before it.

Rows that must go (blank ones and repeats) leave every vector as it is, so they take no part. Between tasks only vectors and states of the first and
last conversation of a partition pass.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.llm.common import ship, written
from shiftledger.operators.ranking import SERIAL, SLICE_BITS, serialized

CHUNK = 256
REROLE, DELETE, INSERT, FAULT = 1, 2, 5, 5
#: States: nothing yet, behind the system row, behind a user row, behind an assistant row.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_INITIALS = ("s", "u", "a")
#: The state that an inserted row, or one with a new role, leads to from each state.
_TURN = np.array([_USER, _USER, _ASSISTANT, _USER])
_TWICE = _TURN[_TURN]
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: The state a kept row leads to, by its initial and the state before; -1 where it cannot stay.
_STAY = np.array([[_SYSTEM, -1, -1, -1], [_USER, _USER, -1, _USER], [-1, -1, _ASSISTANT, -1], [-1, -1, -1, -1]])
_ENDING = (0, 2 * INSERT, INSERT, 0)
_D, _I, _K, _R = range(4)  # in ASCII order
_LETTERS = "DIKR"
_NEVER = 10**6
#: Codes of rows: the initial, more by _CUT for a truncated text; _GONE for what must be deleted.
_OTHER, _CUT, _GONE = 3, 4, 8
_BLANKS = "\x20\t\n\x0b\x0c\r"

CHUNK_LINES = "part long, first boolean, last boolean, conv string, tail int, codes binary"


# --- the walk inside a task ----------------------------------------------------------------

def choices(codes: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Costs of each edit (delete, keep, new role) and the least of all, by row and state before it, from the vectors behind the rows."""
    behind = behind.astype(np.int64)
    fault = np.where(codes >= _CUT, FAULT, 0)[:, None]
    stay = _STAY[codes % _CUT]
    delete = behind + DELETE
    keep = np.where(stay >= 0, np.take_along_axis(behind, np.maximum(stay, 0), axis=1), _NEVER) + fault
    rerole = behind[:, _TURN] + REROLE + fault
    least = np.minimum(np.minimum(delete, keep), rerole)
    least = np.minimum(least, np.minimum(INSERT + least[:, _TURN], 2 * INSERT + least[:, _TWICE]))
    return delete, keep, rerole, least


def plain(vectors: np.ndarray) -> np.ndarray:
    """Vectors without their constant."""
    return (vectors - vectors.min(axis=1, keepdims=True)).astype(np.int8)


def backward(codes: np.ndarray, first: np.ndarray, stop: np.ndarray, more: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost vectors behind every row and before every chunk, each up to a constant.

    Chunks hold rows first to stop - 1; where ``more`` is set the next chunk continues the conversation. ``ends`` are the vectors behind the
    chunks, speculative where there is more.
    """
    behind, before, ends = np.zeros((len(codes), 4), np.int8), ends.copy(), ends.copy()
    lanes, fresh = np.arange(len(first)), True
    while len(lanes):
        live, at, now = lanes, stop[lanes] - 1, ends[lanes]
        while len(live):
            if not fresh:  # converged: the vector is the earlier one but for a constant
                new = (behind[at] != now).any(axis=1)
                live, at, now = live[new], at[new], now[new]
            behind[at] = now
            now = plain(choices(codes[at], now)[3])
            done = at == first[live]
            before[live[done]] = now[done]
            live, at, now = live[~done], at[~done] - 1, now[~done]
        fresh = False
        joint = np.flatnonzero(more)
        lanes = joint[(before[joint + 1] != ends[joint]).any(axis=1)]
        ends[lanes] = before[lanes + 1]
    return behind, before


def edits(codes: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row and state before it: rows inserted first, the edit of the row itself, the state behind it. The least letter wins each time."""
    delete, keep, rerole, least = choices(codes, behind)
    insert = INSERT + least[:, _TURN]
    letter = np.select([delete == least, insert == least, keep == least], [_D, _I, _K], _R)
    state, inserted = np.tile(np.arange(4), (len(codes), 1)), np.zeros((len(codes), 4), np.int8)
    for _ in range(2):  # after two a third could never be cheapest
        again = np.take_along_axis(letter, state, axis=1) == _I
        inserted += again
        state = np.where(again, _TURN[state], state)
    letter = np.take_along_axis(letter, state, axis=1)
    stay = np.take_along_axis(_STAY[codes % _CUT], state, axis=1)
    return inserted, letter.astype(np.int8), np.select([letter == _D, letter == _K], [state, stay], _TURN[state]).astype(np.int8)


def reach(following: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The state behind each chunk by the state before it."""
    found = np.tile(np.arange(4, dtype=np.int8), (len(first), 1))
    live, at = np.arange(len(first)), first.copy()
    while len(live):
        found[live] = np.take_along_axis(following[at], found[live].astype(np.int64), axis=1)
        on = at + 1 < stop[live]
        live, at = live[on], at[on] + 1
    return found


def states(following: np.ndarray, first: np.ndarray, stop: np.ndarray, more: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before every row and behind every chunk; ``entry`` holds the states before chunks that begin a run."""
    entry = entry.copy()
    if more.any():
        through = reach(following, first, stop)
        for c in np.flatnonzero(more).tolist():
            entry[c + 1] = through[c, entry[c]]
    found = np.zeros(len(following), np.int8)
    live, at, now = np.arange(len(first)), first.copy(), entry.copy()
    behind = entry.copy()
    while len(live):
        found[at] = now
        now = following[at, now]
        behind[live] = now
        on = at + 1 < stop[live]
        live, at, now = live[on], at[on] + 1, now[on]
    return found, behind


def cut(starts: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of runs that begin at ``starts``: first rows, stops, whether the run goes on, and the number of the run."""
    ends = np.append(starts[1:], n)[:len(starts)]
    parts = -(-(ends - starts) // size)
    run = np.repeat(np.arange(len(starts)), parts)
    first = starts[run] + (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
    stop = np.minimum(first + size, ends[run])
    return first, stop, np.append(run[1:] == run[:-1], False)[:len(run)], run


# --- rows, faults and chunks as tables -----------------------------------------------------

def conversation_key(column: Column) -> Column:
    """Text that tells conversations apart; rows without an id are a conversation of their own."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def _told(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        conversation_key(F.col("conv_id")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def _runs(told: DataFrame) -> DataFrame:
    """Alike rows of one turn as one line with their number, and their fault: only one of them is not a repeat."""
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    shape = F.when(bare == "", _GONE).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(_CUT)
    lines = told.select("conv", "conv_id", "turn", "role", "digest", shape.alias("shape"))
    runs = lines.groupBy("conv", "conv_id", "turn", "role", "digest", "shape").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = runs.groupBy("conv", "role", "digest").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = F.coalesce(place > F.col("_first"), F.lit(False))
    known = F.array_position(F.array(*map(F.lit, _INITIALS)), F.left("role", F.lit(1)))
    initial = F.when(known > 0, known - 1).otherwise(_OTHER)
    return runs.join(firsts, ["conv", "role", "digest"], "left").select(
        "conv", "conv_id", "turn", "role", "digest", "copies", (F.col("shape") == _GONE).alias("blank"), later.alias("later"),
        (initial + F.when((F.col("shape") == _GONE) | later, _GONE).otherwise(F.col("shape"))).cast("int").alias("code"),
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each written partition."""
    part, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        here = batch[SERIAL][0].as_py() >> SLICE_BITS
        if held and here != part:
            yield part, pa.Table.from_batches(held)
            held = []
        part = here
        held.append(batch)
    if held:
        yield part, pa.Table.from_batches(held)


def _conversations(table: pa.Table) -> np.ndarray:
    """Where conversations begin."""
    conv = table["conv"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))


def _chunk_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of each partition, which alone may go on beyond it."""
    names = [f.split(" ")[0] for f in CHUNK_LINES.split(", ")]
    for part, table in _parts(batches):
        codes, starts = table["code"].to_numpy().astype(np.int8), _conversations(table)
        edges = np.append(starts, len(codes))
        rows = []
        for k in sorted({0, len(starts) - 1}):
            own = codes[edges[k]:edges[k + 1]]
            conv = table["conv"][int(edges[k])].as_py()
            rows.append((part, k == 0, k == len(starts) - 1, conv, int(own[-1] % _CUT), own[own < _GONE].tobytes()))
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _chains(lines: list[Row]) -> list[list[Row]]:
    """Chunks of one conversation that follow one another over partitions; two lines a partition at most."""
    found: list[list[Row]] = []
    for line in sorted(lines, key=lambda r: (r["part"], not r["first"])):
        if line["first"] and found and found[-1][-1]["last"] and found[-1][-1]["conv"] == line["conv"]:
            found[-1].append(line)
        else:
            found.append([line])
    return [chain for chain in found if len(chain) > 1]


def _in_chunks(codes: np.ndarray, end: tuple[int, ...], size: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Vectors behind the rows of one run and before it, and its chunks, from the vector behind it."""
    first, stop, more, _ = cut(np.zeros(1, dtype=np.int64), len(codes), size)
    ends = np.tile(np.array(_ENDING, np.int8), (len(first), 1))
    ends[-1] = end
    behind, before = backward(codes, first, stop, more, ends)
    return behind, before[0], (first, stop, more)


class Borders:
    """What partitions must know of one another: by (partition, whether it is the first conversation there)."""

    def __init__(self) -> None:
        self.ends: dict[tuple[int, bool], tuple[int, ...]] = {}
        self.entry: dict[tuple[int, bool], int] = {}
        self.before: dict[tuple[int, bool], int] = {}
        self.goes_on: set[tuple[int, bool]] = set()


def _stitch(lines: DataFrame, size: int) -> tuple[Borders, int]:
    """Solves the chains over partitions. Returns the borders and the number of passes that chunks were run in."""
    spark = lines.sparkSession
    chains = _chains(lines.select("part", "first", "last", "conv", "tail").collect())
    borders, passes = Borders(), 0
    if not chains:
        return borders, passes
    key = lambda r: (r["part"], r["first"])
    wanted = {key(r) for chain in chains for r in chain}
    asked = spark.createDataFrame(sorted(wanted), "part long, first boolean")
    chunks = lines.join(asked, ["part", "first"], "left_semi")
    for chain in chains:
        for left, right in zip(chain, chain[1:]):
            borders.before[key(right)] = left["tail"]
            borders.goes_on.add(key(left))

    known: dict[tuple[int, bool], dict[tuple, tuple]] = defaultdict(dict)
    tried: set[tuple] = set()
    guesses = {_ENDING}
    while guesses:
        found = chunks.mapInArrow(_runner(sorted(guesses), size), "part long, first boolean, behind array<int>, before array<int>")
        passes += 1
        tried |= guesses
        for r in found.collect():  # a line per chunk and vector; vectors are few, their entries at most ten apart
            known[key(r)][tuple(r["behind"])] = tuple(r["before"])
        missing = set()
        for chain in chains:
            vector = _ENDING
            for r in reversed(chain):
                borders.ends[key(r)] = vector
                if vector not in known[key(r)]:
                    missing.add(vector)
                    break
                vector = known[key(r)][vector]
        guesses = ({v for own in known.values() for v in own.values()} - tried) if missing else set()

    ends = dict(borders.ends)
    through = {key(r): r["through"] for r in chunks.mapInArrow(_crosser(ends, size), "part long, first boolean, through array<int>").collect()}
    for chain in chains:
        state = _START
        for r in chain:
            borders.entry[key(r)] = state
            state = through[key(r)][state]
    return borders, passes


def _runner(guesses: list[tuple[int, ...]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                codes = np.frombuffer(r["codes"], np.int8)
                for guess in guesses:
                    before = _in_chunks(codes, guess, size)[1].tolist() if len(codes) else list(guess)
                    rows.append((r["part"], r["first"], list(guess), before))
            kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "first", "behind", "before"])

    return run


def _crosser(ends: dict[tuple[int, bool], tuple[int, ...]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                codes, through = np.frombuffer(r["codes"], np.int8), np.arange(4)
                if len(codes):
                    behind, _, (first, stop, _) = _in_chunks(codes, ends[r["part"], r["first"]], size)
                    for step in reach(edits(codes, behind)[2], first, stop):
                        through = step[through]
                rows.append((r["part"], r["first"], through.tolist()))
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.bool_(), pa.list_(pa.int32())])], names=["part", "first", "through"]
            )

    return run


_MORE = [("edit", T.StringType()), ("new_role", T.StringType()), ("lead", T.ArrayType(T.StringType())), ("tail", T.ArrayType(T.StringType())),
         ("illegal", T.LongType()), ("cost", T.LongType())]


def _inserted(state: int, n: int) -> list[str]:
    roles = []
    for _ in range(n):
        state = int(_TURN[state])
        roles.append(_ROLE[state])
    return roles


#: The roles of inserted rows by state and number, and those that a conversation needs at its end.
_LEAD = [[_inserted(s, n) for n in range(3)] for s in range(4)]
_TAIL = [_LEAD[s][_ENDING[s] // INSERT] for s in range(4)]


def _trace(batches: Iterator[pa.RecordBatch], borders: Borders, size: int) -> Iterator[pa.RecordBatch]:
    """The edits of every line of a partition."""
    for part, table in _parts(batches):
        code, copies, starts = table["code"].to_numpy().astype(np.int64), table["copies"].to_numpy(), _conversations(table)
        n, edges = len(code), np.append(starts, len(code))
        keys = [(part, k == 0) for k in range(len(starts))]  # the last conversation is the first too if it is alone
        alive = np.flatnonzero(code < _GONE)
        runs = np.searchsorted(alive, starts)
        filled = np.append(runs[1:], len(alive)) > runs
        first, stop, more, run = cut(runs[filled], len(alive), size)
        of = np.flatnonzero(filled)[run]  # the conversation of each chunk
        final = np.append(run[1:] != run[:-1], True)[:len(run)]
        opening = np.append(True, run[1:] != run[:-1])[:len(run)]
        ends = np.tile(np.array(_ENDING, np.int8), (len(first), 1))
        entry = np.zeros(len(first), np.int64)
        state_of = np.zeros(len(starts), np.int64)  # of conversations without a row that may stay
        for k in sorted({0, len(starts) - 1}):
            state_of[k] = borders.entry.get(keys[k], _START)
            ends[(of == k) & final] = borders.ends.get(keys[k], _ENDING)
            entry[(of == k) & opening] = state_of[k]
        rows = code[alive]
        behind, _ = backward(rows, first, stop, more, ends)
        inserted, letter, following = edits(rows, behind)
        before, after = states(following, first, stop, more, entry)
        state_of[of[final]] = after[final]

        mine = np.arange(len(alive)), before
        letters = np.full(n, _D)
        letters[alive] = letter[mine]
        lead = np.zeros(n, np.int64)
        lead[alive] = inserted[mine]
        came = np.zeros(n, np.int64)
        came[alive] = before
        went = np.zeros(n, np.int64)
        went[alive] = following[mine]
        fault = np.where((letters != _D) & (code >= _CUT) & (code < _GONE), FAULT, 0)
        price = np.array([DELETE, INSERT, 0, REROLE])
        cost = price[letters] + fault + DELETE * (copies - 1) + INSERT * lead
        last = edges[1:] - 1
        tail = [None] * n
        for k, at in enumerate(last.tolist()):
            if k < len(starts) - 1 or keys[k] not in borders.goes_on:
                tail[at] = _TAIL[state_of[k]]
                cost[at] += INSERT * len(tail[at])
        initial = code % _CUT
        previous = np.append(-1, initial[:-1])
        previous[starts] = -1
        if keys[0] in borders.before:
            previous[0] = borders.before[keys[0]]
        fits = ((previous == 0) & (initial == 1)) | ((previous == 1) & (initial == 2)) | ((previous == 2) & (initial == 1))
        illegal = copies - 1 + ((previous >= 0) & ~fits)
        more_columns = [
            pa.array([_LETTERS[x] for x in letters.tolist()]),
            pa.array([_ROLE.get(w) if x == _R else None for x, w in zip(letters.tolist(), went.tolist())], pa.string()),
            pa.array([_LEAD[s][i] for s, i in zip(came.tolist(), lead.tolist())], pa.list_(pa.string())),
            pa.array(tail, pa.list_(pa.string())), pa.array(illegal.astype(np.int64)), pa.array(cost.astype(np.int64)),
        ]
        whole = table
        for (name, _), column in zip(_MORE, more_columns):
            whole = whole.append_column(name, column)
        yield from whole.combine_chunks().to_batches(max_chunksize=20_000)


def repair(rows: DataFrame, chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """The cheapest edits of every conversation, a row per edit in the order of ``conv_id, place, step``.

    ``rows`` has ``conv_id, turn, role, text``; a conversation is taken by turn (nulls first), rows of one turn by role and then by the SHA-256 of their
    text. Null role and text are one space. Rows without ``conv_id`` are one conversation. A row's fault is ``blank`` (only white space), else
    ``duplicate`` (role and text came earlier, alike rows of one turn included), else ``truncated`` (does not end in one of ``.!?``). Returns ``edit`` (K kept, R new
    role, D deleted, I inserted) with the ``role`` and ``text`` the row has afterwards (null where deleted), ``copies`` (alike rows of one turn come as one row; all but
    the first are deleted), the faults, ``illegal`` (pairs of neighbouring rows whose initials are not su, ua or au, counted at the second) and ``cost``. Other columns
    are ignored; no rows give no edits. ``place`` orders rows and has gaps.

    Conversations are range-partitioned together with their rows, so one that holds a third of all rows is spread over many tasks; a task holds
    one partition, without texts.
    """
    ship(rows.sparkSession)
    told = _told(rows)
    placed = serialized(_runs(told), ["conv"], ["turn", "role", "digest"], partitions)
    lines = written(placed.mapInArrow(_chunk_lines, CHUNK_LINES), "chunks")
    borders, _ = _stitch(lines, chunk)
    kind = T.StructType([*placed.schema.fields, *[T.StructField(n, t) for n, t in _MORE]])
    traced = placed.mapInArrow(lambda batches: _trace(batches, borders, chunk), kind)

    texts = told.groupBy("conv", "turn", "role", "digest").agg(F.first("text").alias("text"))
    a, b = traced.alias("a"), texts.alias("b")
    same = (F.col("a.conv") == F.col("b.conv")) & F.col("a.turn").eqNullSafe(F.col("b.turn")) & (F.col("a.role") == F.col("b.role"))
    stays = F.col("a.edit") != "D"
    met = a.join(b, same & (F.col("a.digest") == F.col("b.digest")) & stays, "left")
    zero = F.lit(0).cast("long")

    def row(step, edit, copies, turn, role, text, blank, later, cut, illegal, cost):
        names = ("step", "edit", "copies", "turn", "role", "text", "blank", "duplicate", "truncated", "illegal", "cost")
        return F.struct(*[v.alias(n) for n, v in zip(names, (step, edit, copies, turn, role, text, blank, later, cut, illegal, cost))])

    def new(base: int):
        return lambda role, i: row(
            F.lit(base) + i, F.lit("I"), F.lit(1).cast("long"), F.lit(None).cast("long"), role, F.lit(""), zero, zero, zero, zero, F.lit(INSERT).cast("long")
        )

    blank, later = F.col("a.blank"), F.col("a.later")
    spare = F.col("a.copies") - 1
    tail = F.coalesce("a.tail", F.array().cast("array<string>"))
    own_cost = F.col("a.cost") - INSERT * (F.size("a.lead") + F.size(tail)).cast("long")
    own = row(
        F.lit(10), F.col("a.edit"), F.col("a.copies"), F.col("a.turn"), F.when(stays, F.coalesce("a.new_role", "a.role")), F.col("b.text"),
        F.when(blank, F.col("a.copies")).otherwise(zero), F.when(blank, zero).when(later, F.col("a.copies")).otherwise(spare),
        F.when(F.col("a.code").between(_CUT, _GONE - 1), F.lit(1).cast("long")).otherwise(zero), F.col("a.illegal"), own_cost,
    )
    every = F.concat(F.transform("a.lead", new(0)), F.array(own), F.transform(tail, new(20)))
    return met.select("a.conv_id", F.col(f"a.{SERIAL}").alias("place"), F.inline(every))


def repaired(edits: DataFrame) -> DataFrame:
    """The sound conversations: the rows that stay or are new, in the order of ``conv_id, place, step``."""
    return edits.where("edit <> 'D'").select("conv_id", "place", "step", "role", "text")


_SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTED = ("blank", "duplicate", "truncated", "illegal", "cost")


class _Summary:
    def __init__(self, conv: str):
        self.conv, self.sums, self.letters, self.hash, self.begun = conv, dict.fromkeys(_COUNTED, 0), [], hashlib.sha256(), False
        self.turns, self.low, self.high = 0, None, None

    def add(self, edit: str, copies: int, turn: int | None, role: str | None, text: str | None) -> None:
        self.letters.append(edit + "D" * (copies - 1))
        if edit != "D":
            self.hash.update(("\n" if self.begun else "").encode() + f"{role}:{text}".encode())
            self.begun = True
        if edit != "I" and turn is not None and turn != self.high:  # turns come in order
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def line(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.sums.values(), "".join(self.letters), self.hash.hexdigest())


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in _SUMMARY.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    held, done = None, []
    columns = ("conv", "edit", "copies", "turn", "role", "text", *_COUNTED)
    for batch in batches:
        for conv, edit, copies, turn, role, text, *counts in zip(*(batch[c].to_pylist() for c in columns)):
            if held is None or conv != held.conv:
                if held is not None:
                    done.append(held.line())
                held = _Summary(conv)
            held.add(edit, copies, turn, role, text)
            for name, n in zip(_COUNTED, counts):
                held.sums[name] += n
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
            done = []
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(held.line()), kinds)], names=names)


def summary(edits: DataFrame, ids: DataFrame) -> DataFrame:
    """A line per distinct ``conv_id`` of ``ids``: gaps in the turns, faults, cost, the edits' initials, and the SHA-256 of the repaired ``role:text`` lines.

    The hash of a conversation runs over its whole text, so its rows go to one task, which streams them: what it holds is one row and the initials.
    Conversations of ``ids`` without edits have zeros, no initials and the hash of nothing.
    """
    rows = edits.select(conversation_key(F.col("conv_id")).alias("conv"), "place", "step", "edit", "copies", "turn", "role", "text", *_COUNTED)
    found = rows.repartition("conv").sortWithinPartitions("conv", "place", "step").mapInArrow(_summarize, _SUMMARY)
    wanted = ids.select("conv_id").distinct().withColumn("_key", conversation_key(F.col("conv_id")))
    zero = F.lit(0).cast("long")
    return wanted.join(found, F.col("_key") == F.col("conv"), "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", *_COUNTED)],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with one row in four damaged, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 doubles the row, 4 makes its role user. Nulls read as one space;
    ``conv_id`` and ``turn`` come back as they were.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(said("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.withColumn("_kind", kind).where("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")
