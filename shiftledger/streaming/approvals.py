"""The request lifecycle as events arrive: keyed state and event-time timers.

Per user the state is the open request, if any, and the events the watermark has not passed. Events may come in any order; they are held until no
earlier one can come, and then folded in time order by the same rules as the batch (``operators.lifecycle``). A timer at the expiry of a grant
tells that it is over, whether or not the user ever does anything again. A user's events within ``lateness`` are held
together, so it should be as short as deliveries allow; a log at rest is for the batch fold, which splits a hot user.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shiftledger.functions.dates import event_time
from shiftledger.operators.lifecycle import ACTIONS, EFFECTS, GRANT, GRANTED, REJECT, START, USE, WINDOW_US, replay
from shiftledger.session import ship_with_tasks
from shiftledger.streaming.live import run_append

ship_with_tasks(__name__)

EXPIRE, OVER = "expirar", "expirada"
LATENESS = "1 hour"
_EFFECTS = "id bigint, usuario string, quando bigint, acao string, efeito string, solicitacao_id bigint"  # the moment in microseconds
_LINE = Row(*[f.split(" ")[0] for f in _EFFECTS.split(", ")])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Approvals(StatefulProcessor):
    """Effects of one user's events, and the expiry of grants nobody used.

    What a user sends in one batch waits as one entry of arrays, so state is read and written per user and batch, not per event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("aberto", "fase int, pedido bigint, ate bigint")
        self._waiting = handle.getListState("espera", "quando array<bigint>, id array<bigint>, codigo array<int>, acao array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.quando, r.id, r.codigo, r.acao) for r in rows]
        self._waiting.appendList([_entry(new)])
        self._handle.registerTimer(_ms(min(r[0] for r in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [r for entry in self._waiting.get() for r in zip(*entry)]
        ready = sorted((r for r in held if r[0] <= passed), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        later = [r for r in held if r[0] > passed]
        kept = self._open.get()
        state = before = START if kept is None else tuple(kept)
        lines, grants = [], {state[1]: state[2]} if state[0] == GRANTED else {}
        if ready:
            times, codes = np.array([r[0] for r in ready]), np.array([r[2] for r in ready])
            effects, requests, state = replay(times, codes, np.array([r[1] or 0 for r in ready]), state)
            for (moment, number, _, action), effect, request in zip(ready, effects.tolist(), requests.tolist()):
                lines.append((number, key[0], moment, action, EFFECTS[effect], request if request >= 0 else None))
                if effect == GRANT:
                    grants[request] = moment + WINDOW_US
                elif effect in (USE, REJECT):
                    grants.pop(request, None)
            if later:
                self._waiting.put([_entry(later)])
            else:
                self._waiting.clear()
        lines += [(None, key[0], until, EXPIRE, OVER, request) for request, until in grants.items() if until <= passed]
        if state[0] == GRANTED and state[2] <= passed:
            state = START
        if state[0] == START[0]:
            if before != START:
                self._open.clear()
        else:
            self._open.update(state)
        if state[0] == GRANTED:
            self._handle.registerTimer(_ms(state[2]))
        if later:
            self._handle.registerTimer(_ms(min(r[0] for r in later)))
        return (_LINE(*line) for line in lines)

    def close(self) -> None:
        pass


def _entry(events: list[tuple]) -> tuple:
    return tuple(list(column) for column in zip(*events))


def _ms(micros: int) -> int:
    return -(-micros // 1000)


def effects(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """A stream of log events (id, usuario, quando, acao) as a stream of their effects, with a line for every grant that ran out.

    An event is told once the watermark has passed it; any later event, of whatever user, moves the watermark on.
    """
    code = F.coalesce(*[F.when(F.col("acao") == name, F.lit(number)) for name, number in ACTIONS.items()], F.lit(0))
    moment = event_time("quando")
    events = log.select("usuario", "id", F.unix_micros(moment).alias("quando"), code.alias("codigo"), "acao", moment.alias("momento"))
    told = events.withWatermark("momento", lateness).groupBy("usuario").transformWithState(
        statefulProcessor=Approvals(), outputStructType=_EFFECTS, outputMode="Append", timeMode="EventTime"
    )
    return told.withColumn("quando", F.expr("TIMESTAMP_NTZ '1970-01-01' + quando * INTERVAL '0.000001' SECOND"))


def run_effects(log: DataFrame, root: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Write the effects, a folder per batch. Timers need the RocksDB state store."""
    conf = log.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        return run_append(effects(log, lateness), root, checkpoint)
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)
