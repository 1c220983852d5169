"""Lifecycle events in blocks of any size, reasons of refusal, and overrides."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from ledgerloom.operators import lifecycle, reconcile
from ledgerloom.streaming.jobs import replay_state

START = datetime(2026, 1, 1)
ACTIONS = ["submit", "approve", "reject", "resubmit", "publish", "vanish"]


def history(n: int, settlements: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    return [(r.randrange(settlements), i, START + timedelta(minutes=r.randrange(n)), r.choice(ACTIONS)) for i in range(n)]


def plainly(rows: list[tuple]) -> dict:
    """Event id to (before, after, accepted), one event after another."""
    out = {}
    for s in {r[0] for r in rows}:
        state = {"status": "draft", "submitted_at": None, "audited_at": None, "published_at": None}
        for _, event, ts, action in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            before = state["status"]
            state, ok = replay_state(state, action, ts)
            out[event] = (before, state["status"], ok)
    return out


@pytest.mark.parametrize("bits", [0, 1, 9])
def test_events_in_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(lifecycle, "BITS", bits)
    rows = history(400, 3)
    actions = spark.createDataFrame(rows, "settlement_id long, event_id long, ts timestamp, action string").repartition(4)
    got = {r.event_id: (r.before, r.after, r.accepted) for r in lifecycle.lifecycle_events(actions).collect()}
    assert got == plainly(rows)


def test_blocks_are_made_once(spark):
    """Bounds of ranges are sampled from rows in the order in which they come, so events numbered twice may be numbered differently."""
    actions = spark.createDataFrame(history(400, 3), "settlement_id long, event_id long, ts timestamp, action string")
    assert "monotonically_increasing_id" not in lifecycle.lifecycle_events(actions)._jdf.queryExecution().toString()


def test_reasons(spark):
    names = ["submit", "submit", "publish", "approve", "publish", "publish", "resubmit", "reject", "vanish", None]
    rows = [(1, i, START + timedelta(days=i), a) for i, a in enumerate(names)]
    got = lifecycle.lifecycle_events(spark.createDataFrame(rows, "settlement_id long, event_id long, ts timestamp, action string")).orderBy("event_id").collect()
    assert [r.reason for r in got] == [
        None, "DRAFT 상태에서만 제출할 수 있습니다 (현재: submitted).", "승인된 결산안만 공개할 수 있습니다 (현재: submitted).", None, None, "이미 공개된 결산안입니다.",
        "반려 상태의 결산안만 재제출할 수 있습니다 (현재: approved).", "제출됨/재제출됨 상태의 결산안만 반려할 수 있습니다 (현재: approved).", "unknown action", "unknown action",
    ]


def test_resubmission_clears_the_audit(spark):
    rows = [(1, i, START + timedelta(days=i), a) for i, a in enumerate(["submit", "reject", "resubmit"])]
    (got,) = lifecycle.lifecycle_replay(spark.createDataFrame(rows, "settlement_id long, event_id long, ts timestamp, action string")).collect()
    assert (got.status, got.submitted_at, got.audited_at, got.accepted) == ("resubmitted", START + timedelta(days=2), None, 3)


def test_overrides_change_what_they_provide(spark):
    results = spark.createDataFrame([(1, 10, 100, 500, "matched", None), (2, 10, 101, None, "missing_bank_transaction", "x"), (3, 20, 200, 600, "matched", None)], "result_id long, settlement_id long, evidence_id long, tx_id long, status string, notes string")
    evidences = spark.createDataFrame([(100, 10), (101, 10), (200, 20)], "evidence_id long, settlement_id long")
    txs = spark.createDataFrame([(500, 10), (501, 10), (600, 20)], "tx_id long, settlement_id long")
    no = (False, None)

    def override(i, result, evidence=no, tx=no, status=no, notes=no):
        return (i, result, START + timedelta(days=i), *evidence, *tx, *status, *notes)

    log = [
        override(1, 1, tx=(True, None), status=(True, "manually_resolved")),  # undone by hand: a null that is set
        override(2, 1, notes=(True, "seen")), override(3, 1, notes=(True, None)),  # only the latest counts
        override(4, 2, tx=(True, 501)), override(5, 2, tx=(True, 600), notes=(True, "lost")),  # a row of another settlement: nothing of it counts
        override(6, 2, tx=(True, 999)), override(7, 3, evidence=(True, 100)), override(8, 9, notes=(True, "?")),
    ]
    overrides = spark.createDataFrame(log, "override_id long, result_id long, made_at timestamp, has_evidence boolean, evidence_id long, has_tx boolean, tx_id long, has_status boolean, status string, has_notes boolean, notes string")
    got = reconcile.apply_overrides(results, overrides, evidences, txs).orderBy("result_id").collect()
    assert [tuple(r) for r in got] == [(1, 10, 100, None, "manually_resolved", None), (2, 10, 101, 501, "missing_bank_transaction", "x"), (3, 20, 200, 600, "matched", None)]
    refused = {r.override_id: r.reason for r in reconcile.judged_overrides(results, overrides, evidences, txs).filter("reason is not null").collect()}
    assert refused == {5: reconcile.OTHER_TX, 6: reconcile.NO_TX, 7: reconcile.OTHER_EVIDENCE, 8: reconcile.NO_RESULT}
