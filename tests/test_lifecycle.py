from datetime import datetime, timedelta

import numpy as np
import pytest

from rows import explain
from shiftledger.operators import lifecycle

ACTIONS = ["solicitar", "autorizar", "usar", "rejeitar"]


def brute_force(log):
    """Effects by a plain walk over each user's events."""
    out = {}
    for user in sorted({e["usuario"] for e in log}):
        open_request, granted_until = None, None
        for e in sorted((x for x in log if x["usuario"] == user), key=lambda x: (x["quando"], x["id"])):
            if granted_until is not None and granted_until < e["quando"]:
                open_request, granted_until = None, None
            effect, target = "ignorada", None
            if e["acao"] == "solicitar" and open_request is None:
                open_request, effect = e["id"], "aberta"
                target = open_request
            elif e["acao"] == "autorizar" and open_request is not None and granted_until is None:
                granted_until, effect, target = e["quando"] + timedelta(minutes=10), "autorizada", open_request
            elif e["acao"] == "rejeitar" and open_request is not None:
                effect, target, open_request, granted_until = "rejeitada", open_request, None, None
            elif e["acao"] == "usar" and granted_until is not None:
                effect, target, open_request, granted_until = "usada", open_request, None, None
            out[e["id"]] = (effect, target)
    return out


def make_log(seed, n=600, users=5, spread=90, weights=(0.4, 0.3, 0.15, 0.15)):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.4
    moment = datetime(2024, 1, 1)
    log = []
    for i in range(n):
        moment += timedelta(seconds=int(rng.integers(0, spread)))
        log.append({
            "id": i, "usuario": "hot" if hot[i] else f"u{rng.integers(users)}",
            "quando": moment, "acao": str(rng.choice(ACTIONS, p=weights)),
        })
    return log


@pytest.mark.parametrize("seed, spread, weights", [
    (1, 90, (0.4, 0.3, 0.15, 0.15)), (2, 400, (0.4, 0.3, 0.15, 0.15)),
    (3, 60, (0.6, 0.38, 0.01, 0.01)), (4, 0 + 1, (0.5, 0.3, 0.1, 0.1)),
])
def test_sliced_fold_equals_plain_walk(spark, seed, spread, weights):
    log = make_log(seed, spread=spread, weights=weights)
    df = spark.createDataFrame(log, "id bigint, usuario string, quando timestamp_ntz, acao string")
    for partitions, batch in ((1, 10_000), (3, 7), (40, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            rows = lifecycle.log_effects(df, partitions=partitions).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r.id: (r.efeito, r.solicitacao_id) for r in rows} == brute_force(log)


def test_a_dense_log_of_one_user(spark):
    """Thousands of requests within ten minutes: summaries stay short and the log is shuffled once."""
    log = make_log(11, n=6000, users=1, spread=2, weights=(0.7, 0.2, 0.05, 0.05))
    for e in log:
        e["usuario"] = "hot"
        e["quando"] = datetime(2024, 1, 1) + (e["quando"] - datetime(2024, 1, 1)) / 20
    df = spark.createDataFrame(log, "id bigint, usuario string, quando timestamp_ntz, acao string")
    found = lifecycle.log_effects(df, partitions=16)
    assert {r.id: (r.efeito, r.solicitacao_id) for r in found.collect()} == brute_force(log)
    assert "Exchange" not in explain(found)  # the written log is walked where it lies
    times = np.array([int(e["quando"].timestamp() * 1e6) for e in log])
    actions = np.array([lifecycle.ACTIONS[e["acao"]] for e in log])
    assert len(lifecycle.summarize(times, actions, np.arange(6000))["limites"]) < 300


def test_many_cuts_without_spark():
    """Chaining summaries, one by one or composed, gives the state that a walk through all events gives."""
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(1, 40))
        times = np.cumsum(rng.integers(0, 400, n)) * 1_000_000
        actions = rng.integers(0, 5, n)
        ids = np.arange(n)
        cuts = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
        state, whole, effects = lifecycle.START, None, []
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part = times[a:b], actions[a:b], ids[a:b]
            found, _, end = lifecycle.replay(*part, state)
            effects += found.tolist()
            own = lifecycle.summarize(*part)
            whole = own if whole is None else lifecycle.compose(whole, own)
            state = lifecycle.advance(state, own)
            assert shown(state, times[b - 1]) == shown(end, times[b - 1]) == shown(lifecycle.advance(lifecycle.START, whole), times[b - 1])
        assert effects == lifecycle.replay(times, actions, ids, lifecycle.START)[0].tolist()
        for start in ((lifecycle.WAITING, 99, None), (lifecycle.GRANTED, 99, int(rng.integers(0, 600)) * 1_000_000)):
            assert shown(lifecycle.advance(start, whole), times[-1]) == shown(lifecycle.replay(times, actions, ids, start)[2], times[-1])


def shown(state, now):
    """What of a state counts: its request and expiry only while they are open."""
    phase, request, expiry = state
    phase = lifecycle.IDLE if phase == lifecycle.GRANTED and expiry < now else phase
    return (phase, request if phase else None, expiry if phase == lifecycle.GRANTED else None)
