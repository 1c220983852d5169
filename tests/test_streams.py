"""Streams: timers, restarts from checkpoints, late and repeated events, hot groups; parts of large settlements."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile, scope
from ledgerloom.operators.components import connected
from ledgerloom.sources.files import Work
from ledgerloom.streaming import jobs

DAY = datetime(2026, 1, 1)
INVITATION = "invitation_id long, event string, expires_at timestamp, ts timestamp"


def test_timers_and_restarts(spark, tmp_path):
    """Invitations expire by the clock of later events, in a run that goes on from the first one's checkpoint."""

    def run(rows):
        spark.createDataFrame(rows, INVITATION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = jobs.events_stream(jobs.stateful_session(spark), f"{tmp_path}/in", spark.read.schema(INVITATION).parquet(f"{tmp_path}/in").schema)
        jobs.invitation_stream(events).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out", "parquet", "append").awaitTermination()
        return sorted((r.invitation_id, r.status, r.at) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    due = DAY + timedelta(days=7)
    first = run([(1, "created", due, DAY), (2, "created", due, DAY), (3, "created", None, DAY), (2, "accepted", None, DAY + timedelta(days=1)), (4, "created", due, DAY)])
    assert first == [(1, "pending", DAY), (2, "accepted", DAY + timedelta(days=1)), (2, "pending", DAY), (3, "pending", DAY), (4, "pending", DAY)]
    assert run([(None, "tick", None, due)]) == first  # not yet over
    late = due + timedelta(days=1)
    assert set(run([(4, "accepted", None, late), (None, "tick", None, late)])) - set(first) == {(1, "expired", due), (4, "expired", due)}
    assert len(run([(1, "accepted", None, late + timedelta(days=1))])) == len(first) + 2  # what has expired stays so


def test_views_late_twice_and_repeated(spark, tmp_path):
    """Events count once within the lateness, older ones go aside, and a repeated batch changes nothing."""
    at = lambda m: DAY + timedelta(minutes=m)
    schema = "event_id long, settlement_id long, user_id long, ts timestamp"
    public = spark.createDataFrame([(1, "north"), (2, "south")], "settlement_id long, college_name string")
    visible = spark.createDataFrame([(7, "north"), (8, "south"), (9, None)], "user_id long, college_name string")

    def run(rows, state="state"):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.events_stream(spark, f"{tmp_path}/in", spark.read.schema(schema).parquet(f"{tmp_path}/in").schema, files_at_once=1)
        jobs.view_count_stream(stream, public, visible, f"{tmp_path}/out", f"{tmp_path}/{state}", lateness_s=3600).awaitTermination()
        late = spark.read.parquet(f"{tmp_path}/out/late")
        return {r.settlement_id: r.view_count for r in jobs.view_counts_of(spark, f"{tmp_path}/out").collect()}, sorted(r.event_id for r in late.collect())

    assert run([(1, 1, 7, at(0)), (1, 1, 7, at(0)), (2, 1, 8, at(1)), (3, 2, 8, at(2)), (4, 3, 7, at(2)), (5, 1, None, at(3)), (6, 1, 9, at(3))]) == ({1: 1, 2: 1}, [])
    assert run([(1, 1, 7, at(30)), (10, 1, 7, at(200))]) == ({1: 2, 2: 1}, [])  # 1 again, within the hour
    assert run([(11, 2, 8, at(130)), (1, 1, 7, at(150)), (12, 2, 8, at(205))]) == ({1: 3, 2: 2}, [11])  # 11 is too late, 1 is forgotten by now
    assert run([]) == ({1: 3, 2: 2}, [11])
    again = spark.read.parquet(f"{tmp_path}/out/events").count()
    assert run([], state="lost")[0] == {1: 3, 2: 2}  # all batches anew into the same folders
    assert spark.read.parquet(f"{tmp_path}/out/events").count() == again


def test_lifecycle_goes_on_from_its_state(spark, tmp_path):
    schema = "settlement_id long, event_id long, ts timestamp, action string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        actions = jobs.events_stream(jobs.stateful_session(spark), f"{tmp_path}/in", spark.read.schema(schema).parquet(f"{tmp_path}/in").schema)
        jobs.lifecycle_stream(actions).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out", "parquet", "append").awaitTermination()
        return {r.event_id: (r.before, r.after, r.reason is None) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert run([(1, 2, DAY + timedelta(days=1), "approve"), (1, 1, DAY, "submit")]) == {1: ("draft", "submitted", True), 2: ("submitted", "approved", True)}
    got = run([(1, 3, DAY + timedelta(days=2), "publish"), (1, 4, DAY + timedelta(days=3), "publish"), (2, 5, DAY, "reject")])
    assert {k: got[k] for k in (3, 4, 5)} == {3: ("approved", "approved", True), 4: ("approved", "approved", False), 5: ("draft", "draft", False)}


@pytest.mark.parametrize("split_over", [1, 7])
def test_parts_of_a_large_settlement(spark, split_over):
    """Chains of days and amounts, zeros, nulls and crowds: parts give what the whole gives."""
    r = random.Random(9)
    days = [date(2026, 3, 1) + timedelta(days=k) for k in range(40)]
    evidences, txs = [], []
    for s in (1, 2):
        for i in range(150):
            evidences.append((s, 1000 * s + i, "confirmed", r.choice([*days, None]), r.choice([None, Decimal(0), *(Decimal(100 * r.randrange(1, 400)) for _ in range(8))]), DAY + timedelta(minutes=r.randrange(50))))
            txs.append((s, 9000 * s + i, r.choice([*days, None]), r.choice([None, *(Decimal(-100 * r.randrange(1, 400)) for _ in range(8))]), DAY + timedelta(minutes=r.randrange(50))))
        for k in range(30):  # a chain: each day's amount is the next day's too
            evidences.append((s, 5000 + 1000 * s + k, "confirmed", date(2027, 1, 1) + timedelta(days=k), Decimal(700000 + k), DAY))
            txs.append((s, 99000 * s + k, date(2027, 1, 1) + timedelta(days=k), Decimal(700001 + k), DAY))
    e = spark.createDataFrame(evidences, "settlement_id long, evidence_id long, status string, evidence_date date, amount decimal(12,2), created_at timestamp")
    t = spark.createDataFrame(txs, "settlement_id long, tx_id long, transaction_date date, amount decimal(12,2), created_at timestamp")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(reconcile.reconcile(e, t, split_over=split_over)) == rows(reconcile.reconcile(e, t))


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 130)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    with Work(spark, "components") as work:
        got = {x.node: x.component for x in connected(spark.createDataFrame(edges, "a long, b long"), work).collect()}
        assert got == {x: find(x) for x in list(root) if find(x) != x}
        assert connected(spark.createDataFrame([], "a long, b long"), work).count() == 0


def test_a_large_organisation_is_shared_by_tasks(spark):
    members = spark.createDataFrame([(1, u, "auditor") for u in range(500)] + [(1, 3, "president"), (2, 9, "auditor")], "org_id long, user_id long, role string")
    settlements = spark.createDataFrame([(10, 1), (20, 2)], "settlement_id long, org_id long")
    actions = spark.createDataFrame([(i, 10 if i < 6 else 20, "submit" if i % 2 else "approve", i) for i in range(8)], "event_id long, settlement_id long, action string, actor_user_id long")
    rows = lambda d: sorted(map(tuple, d.collect()))
    whole = scope.notification_fanout(actions, settlements, members)
    cut = scope.notification_fanout(actions, settlements, members, listeners_at_once=20)
    assert rows(cut) == rows(whole) and len(rows(whole)) == 3 * 499 + 3 + 1
    buckets = members.filter("role = 'auditor' and org_id = 1").groupBy(F.pmod(F.xxhash64("user_id"), F.lit(25))).count()
    assert buckets.agg(F.max("count")).first()[0] < 50


def test_the_digest_of_notifications_is_that_of_the_fan_out(spark):
    r = random.Random(9)
    roles = ["student", "treasurer", "auditor", "president"]
    members = [(r.randrange(3), r.choice([None, *range(12)]), r.choice(roles)) for _ in range(60)] + [(3, 5, "auditor"), (4, None, "auditor"), (4, 5, "auditor"), (5, None, "auditor")]
    members = spark.createDataFrame(members, "org_id long, user_id long, role string")
    settlements = spark.createDataFrame([(10 + i, i) for i in range(7)], "settlement_id long, org_id long")
    acts = ["submit", "approve", "reject", "resubmit", "publish", "vanish"]
    actions = spark.createDataFrame([(i, 10 + r.randrange(8), r.choice(acts), r.choice([None, *range(14)])) for i in range(800)], "event_id long, settlement_id long, action string, actor_user_id long")
    rows = lambda d: sorted(map(tuple, d.collect()))
    told = scope.notification_fanout(actions, settlements, members).groupBy("event_id", "action").agg(F.count("*").alias("n"), F.min("user_id").alias("first_user"), F.sum("user_id").alias("ids"))
    assert rows(scope.notification_digest(actions, settlements, members)) == rows(told)


def test_the_fan_out_queries_make_no_row_for_each_listener(spark, sf_dir):
    from ledgerloom.plans import all_queries

    assert "explode" not in all_queries()["notification_fanout"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_banded_pairs(spark):
    r = random.Random(6)
    amounts = [Decimal(x) for x in ("0", "0.01", "1", "1.99", "2", "99.99", "100", "1099.99", "1100", "12345.67", "9999999999.99")] + [Decimal(r.randrange(1, 10**7)) / 100 for _ in range(60)]
    e = spark.createDataFrame([(1, i, "confirmed", date(2026, 1, 1), -a if i % 3 == 0 else a) for i, a in enumerate(amounts)], "settlement_id long, evidence_id long, status string, evidence_date date, amount decimal(12,2)")
    t = spark.createDataFrame([(1, i, date(2026, 1, 1), -b) for i, b in enumerate(amounts)], "settlement_id long, tx_id long, transaction_date date, amount decimal(12,2)")
    got = {(x.evidence_id, x.tx_id) for x in reconcile.candidates(e, t).collect()}
    assert got == {(i, j) for i, a in enumerate(amounts) for j, b in enumerate(amounts) if a == 0 or abs(a - b) <= max(10 * a, 1000)}
