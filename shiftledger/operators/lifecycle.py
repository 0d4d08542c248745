"""The request lifecycle folded from an event log, per user and in time order.

Per user at most one request is open: none, pending, or granted until its expiry.

- ``solicitar`` opens a request when none is open, and is ignored otherwise;
- ``autorizar`` grants a pending request for ten minutes;
- ``rejeitar`` closes the open request;
- ``usar`` closes a granted request as used;
- a granted request whose expiry lies before the next event is over.

The fold is sequential per user, but one user may own a large part of the log. So the ordered log is
range-partitioned on user and time and written once; from there on nothing is shuffled. Each partition says
what state its first and its last user end in for every state they may start in; two such summaries
compose into one. They are chained over the partitions, two lines for each; then every partition is walked from the
known start of its first user, all in parallel.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.dates import instant
from shiftledger.functions.domain import APPROVAL_MINUTES, AUTHORIZED, EXPIRED, PENDING, REJECTED, USED
from shiftledger.operators.ranking import SERIAL, SLICE_BITS, serialized
from shiftledger.session import ship_with_tasks

ship_with_tasks(__name__)

IDLE, WAITING, GRANTED = 0, 1, 2
OWN = -1  # the request that was open when the run began
WINDOW_US = APPROVAL_MINUTES * 60 * 1_000_000
ASK, GRANT, REJECT, USE = 1, 2, 3, 4
ACTIONS = {"solicitar": ASK, "autorizar": GRANT, "rejeitar": REJECT, "usar": USE}
EFFECTS = ["ignorada", "aberta", "autorizada", "rejeitada", "usada"]  # an effect has the number of its action

State = tuple[int, int | None, int | None]  # phase, request, expiry
_BORDER = (
    "parte bigint, usuario string, primeiro boolean, ultimo boolean, livre array<bigint>, pendente array<bigint>, "
    "limites array<bigint>, reabertos array<array<bigint>>, resto array<bigint>"
)
_EFFECT = "id bigint, usuario string, quando timestamp_ntz, acao string, efeito int, solicitacao_id bigint"
START: State = (IDLE, None, None)


def _following(mask: np.ndarray) -> np.ndarray:
    """Index of the first marked event at or after each position; n if none."""
    n = len(mask)
    at = np.where(mask, np.arange(n), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], n)


def summarize(times: np.ndarray, actions: np.ndarray, ids: np.ndarray) -> dict:
    """End state of one user's run of events for each possible start state.

    Worked backwards: what follows from "none open" and from "pending" at each event depends only
    on later events. A granted start with expiry e ends at the first use or rejection, unless an
    earlier request finds it expired; those requests are listed with their times, once for each different end. So the list holds at
    most the requests of ten minutes in which nothing was used or rejected.
    """
    n = len(times)
    next_close, next_ask = _following(actions >= REJECT), _following(actions == ASK)
    free: list[State] = [START] * (n + 1)
    pending: list[State] = [(WAITING, OWN, None)] * (n + 1)

    def opened_at(i: int) -> State:
        phase, request, expiry = pending[i + 1]
        return (phase, int(ids[i]) if request == OWN else request, expiry)

    def granted(i: int, expiry: int) -> State:
        ask = next_ask[max(i, int(np.searchsorted(times, expiry, side="right")))]
        close = next_close[i]
        if ask < close:
            return opened_at(ask)
        return free[close + 1] if close < n else (GRANTED, OWN, expiry)

    for i in range(n - 1, -1, -1):
        free[i], pending[i] = free[i + 1], pending[i + 1]
        if actions[i] == ASK:
            free[i] = opened_at(i)
        elif actions[i] == REJECT:
            pending[i] = free[i + 1]
        elif actions[i] == GRANT:
            pending[i] = granted(i + 1, int(times[i]) + WINDOW_US)

    limits, reopened, i = [], [], int(next_ask[0])
    while i < next_close[0]:
        limits.append(int(times[i]))
        reopened.append(opened_at(i))
        if times[i] > times[0] + WINDOW_US:  # no grant from before the run lasts this long
            break
        i = int(next_ask[i + 1])
    rest = free[next_close[0] + 1] if next_close[0] < n else (GRANTED, OWN, None)
    return {"livre": free[0], "pendente": pending[0], **_thinned(limits, reopened), "resto": rest}


def _thinned(limits: list[int], reopened: list[State]) -> dict:
    """Of requests in a row that lead to the same end the last is enough."""
    keep = [i for i in range(len(limits)) if i + 1 == len(limits) or reopened[i] != reopened[i + 1]]
    return {"limites": [limits[i] for i in keep], "reabertos": [reopened[i] for i in keep]}


def advance(state: State, summary: dict) -> State:
    """The state after a run that began in ``state``."""
    phase, request, expiry = state
    if phase == IDLE:
        end = summary["livre"]
    elif phase == WAITING:
        end = summary["pendente"]
    else:
        at = bisect_right(summary["limites"], expiry)
        end = summary["reabertos"][at] if at < len(summary["limites"]) else summary["resto"]
    end_phase, end_request, end_expiry = end
    if end_phase == GRANTED and end_expiry is None:
        end_expiry = expiry
    return (end_phase, request if end_request == OWN else end_request, end_expiry)


def compose(first: dict, second: dict) -> dict:
    """The summary of one run followed by another."""
    limits, reopened = first["limites"], [advance(s, second) for s in first["reabertos"]]
    if first["resto"][0] == GRANTED and first["resto"][2] is None:  # the grant from before may still hold
        limits, reopened, rest = limits + second["limites"], reopened + second["reabertos"], second["resto"]
    else:
        rest = advance(first["resto"], second)
    return {
        "livre": advance(first["livre"], second), "pendente": advance(first["pendente"], second), **_thinned(limits, reopened), "resto": rest,
    }


def replay(times: np.ndarray, actions: np.ndarray, ids: np.ndarray, start: State) -> tuple[np.ndarray, np.ndarray, State]:
    """Effect and request (-1 for none) of each event of one user from a known start state, and the end state.

    Goes from one event that matters to the next; what lies between is ignored.
    """
    n = len(times)
    effects, requests = np.zeros(n, dtype=np.int32), np.full(n, -1, dtype=np.int64)
    phase, request, expiry = start
    ask, judge, close = (_following(m).tolist() for m in (actions == ASK, (actions == GRANT) | (actions == REJECT), actions >= REJECT))
    moments, kinds = times.tolist(), actions.tolist()
    i = 0
    while i < n:
        if phase == IDLE:
            j = ask[i]
            if j == n:
                break
            phase, request = WAITING, int(ids[j])
        elif phase == WAITING:
            j = judge[i]
            if j == n:
                break
            if kinds[j] == GRANT:
                phase, expiry = GRANTED, moments[j] + WINDOW_US
            else:
                phase = IDLE
        else:
            j, over = close[i], bisect_right(moments, expiry, i)
            if j >= over:  # expired before anyone closed it
                if over == n:
                    break
                phase, i = IDLE, over
                continue
            phase = IDLE
        effects[j], requests[j] = kinds[j], request
        i = j + 1
    return effects, requests, (phase, request, expiry)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int]]:
    """(user, start, stop) of neighbouring rows of one user."""
    users = batch["usuario"].to_numpy(zero_copy_only=False)
    edges = [*np.flatnonzero(np.append(True, users[1:] != users[:-1])).tolist(), len(users)]
    for a, b in zip(edges, edges[1:]):
        yield users[a], a, b


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    times = batch["quando"].cast(pa.int64()).to_numpy(zero_copy_only=False)
    return times, batch["codigo"].to_numpy(zero_copy_only=False), batch["id"].to_numpy(zero_copy_only=False)


def _part(batch: pa.RecordBatch) -> int:
    return batch[SERIAL][0].as_py() >> SLICE_BITS


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of the first and the last user of a partition: only they can continue beyond it.

    Batches follow one another, so a user's summary grows batch by batch and no more than a batch is held.
    """
    names = [f.split(" ")[0] for f in _BORDER.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
    part, user, summary, is_first, found = None, None, None, False, []

    def line(first: bool, last: bool) -> dict:
        return {"parte": part, "usuario": user, "primeiro": first, "ultimo": last, **summary}

    for batch in batches:
        if not batch.num_rows:
            continue
        here, (times, actions, ids) = _part(batch), _columns(batch)
        if here != part and part is not None:  # several written partitions may be read by one task
            found.append(line(is_first, True))
            user, summary = None, None
        fresh, part = here != part, here
        runs = list(_runs(batch))
        for k, (name, a, b) in enumerate(runs):
            continues = name == user and not (fresh and k == 0)
            if not continues:
                if user is not None and is_first:
                    found.append(line(True, False))
                is_first = fresh and k == 0
                user, summary = name, None
            if is_first or k == len(runs) - 1:  # the first user, or one that may turn out the last
                own = summarize(times[a:b], actions[a:b], ids[a:b])
                summary = own if summary is None else compose(summary, own)
        if found:
            yield _lines(found, names, kinds)
            found = []
    if user is not None:
        yield _lines([line(is_first, True)], names, kinds)


def _lines(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds)], names=names)


def chain(borders: list[dict]) -> dict[int, State]:
    """The state in which the first user of each partition comes into it; two lines per partition at most."""
    starts: dict[int, State] = {}
    user, state = None, START
    for line in sorted(borders, key=lambda r: (r["parte"], not r["primeiro"])):
        begin = state if line["primeiro"] and line["usuario"] == user else START
        if line["primeiro"]:
            starts[line["parte"]] = begin
        if line["ultimo"]:
            user, state = line["usuario"], advance(begin, line)
    return starts


def _walk(batches: Iterator[pa.RecordBatch], starts: dict[int, State]) -> Iterator[pa.RecordBatch]:
    part, user, state = None, None, START
    for batch in batches:
        if not batch.num_rows:
            continue
        times, actions, ids = _columns(batch)
        fresh, part = _part(batch) != part, _part(batch)
        effects, requests = np.empty(len(ids), dtype=np.int32), np.empty(len(ids), dtype=np.int64)
        for k, (name, a, b) in enumerate(_runs(batch)):
            if fresh and k == 0:
                state = starts.get(part, START)
            elif name != user:
                state = START
            user = name
            effects[a:b], requests[a:b], state = replay(times[a:b], actions[a:b], ids[a:b], state)
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["usuario"], batch["quando"], batch["acao"], pa.array(effects), pa.array(requests, mask=requests < 0)],
            names=["id", "usuario", "quando", "acao", "efeito", "solicitacao_id"],
        )


def log_effects(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every log event (id, usuario, quando, acao) with its effect and the request it acted on."""
    code = F.coalesce(*[F.when(F.col("acao") == name, F.lit(number)) for name, number in ACTIONS.items()], F.lit(0))
    columns = log.select("id", "usuario", "quando", "acao", code.alias("codigo"))
    placed = serialized(columns, ["usuario"], ["quando", "id"], partitions)
    starts = chain([r.asDict(recursive=True) for r in placed.mapInArrow(_borders, _BORDER).collect()])
    walked = placed.mapInArrow(lambda batches: _walk(batches, starts), _EFFECT)
    names = F.array(*[F.lit(e) for e in EFFECTS])
    return walked.withColumn("efeito", F.element_at(names, F.col("efeito") + 1))


def requests_from_log(effects: DataFrame, as_of: datetime) -> DataFrame:
    """The request table that a log leaves behind, swept at ``as_of`` (not before its last event)."""

    def at(effect: str):
        return F.max(F.when(F.col("efeito") == effect, F.col("quando")))

    return (
        effects.where("solicitacao_id IS NOT NULL")
        .groupBy(F.col("solicitacao_id").alias("id"))
        .agg(
            F.max("usuario").alias("username"), at("aberta").alias("solicitado_em"), at("autorizada").alias("autorizado_em"),
            at("usada").alias("usado_em"), at("rejeitada").alias("_rejeitado_em"),
        )
        .withColumn("expira_em", F.col("autorizado_em") + F.expr(f"INTERVAL '{APPROVAL_MINUTES}' MINUTE"))
        .withColumn(
            "status",
            F.when(F.col("usado_em").isNotNull(), USED)
            .when(F.col("_rejeitado_em").isNotNull(), REJECTED)
            .when(F.col("expira_em") < instant(as_of), EXPIRED)
            .when(F.col("autorizado_em").isNotNull(), AUTHORIZED)
            .otherwise(PENDING),
        )
        .select("id", "username", "status", "solicitado_em", "autorizado_em", "expira_em", "usado_em")
    )
