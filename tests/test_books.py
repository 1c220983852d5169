from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

from ledgerloom.operators import ledger, reconcile, rollup

EVIDENCE = "settlement_id long, evidence_id long, status string, evidence_date date, amount decimal(12,2), created_at timestamp"
TX = "settlement_id long, tx_id long, transaction_date date, amount decimal(12,2), created_at timestamp"
AT = datetime(2026, 4, 1)


def matched(spark, evidences, txs):
    e = spark.createDataFrame([(1, i, "confirmed", d, None if a is None else Decimal(a), AT) for i, (d, a) in enumerate(evidences)], EVIDENCE)
    t = spark.createDataFrame([(1, 100 + i, d, Decimal(a), AT) for i, (d, a) in enumerate(txs)], TX)
    return reconcile.reconcile(e, t).collect()


def test_exact_match(spark):
    rows = matched(spark, [(date(2026, 4, 1), 50000)], [(date(2026, 4, 1), -50000)])
    assert [(r.evidence_id, r.tx_id, r.status) for r in rows] == [(0, 100, "matched")]


def test_one_of_each_status(spark):
    d = lambda k: date(2026, 4, k)
    rows = matched(spark, [(d(1), 10000), (d(2), 20000), (d(10), 30000), (d(20), 99999)], [(d(1), -10000), (d(2), -25000), (d(9), -30000), (d(30), -77777)])
    assert Counter(r.status for r in rows) == Counter(["matched", "amount_mismatch", "date_mismatch", "missing_bank_transaction", "missing_evidence"])


def test_wide_gap_is_no_match(spark):
    rows = matched(spark, [(date(2026, 6, 9), 3700)], [(date(2026, 6, 9), 300000)])
    assert Counter(r.status for r in rows) == Counter(["missing_bank_transaction", "missing_evidence"])


def test_missing_fields_take_nothing_and_zero_takes_the_first(spark):
    day = date(2026, 6, 9)
    rows = matched(spark, [(None, 100), (day, None), (day, 0)], [(day, 999999)])
    by = {r.evidence_id: (r.tx_id, r.status) for r in rows}
    assert by == {0: (None, "missing_bank_transaction"), 1: (None, "missing_bank_transaction"), 2: (100, "amount_mismatch")}


def test_no_rows(spark):
    e, t = spark.createDataFrame([], EVIDENCE), spark.createDataFrame([], TX)
    assert reconcile.reconcile(e, t).count() == 0


def test_group_summary_order(spark):
    rows = [(1, g, Decimal(a), False) for g, a in (("간식행사", 1000000), ("간식행사", 2000000), ("개강총회", 500000), (None, 9000000), ("환불", -50000))]
    e = spark.createDataFrame(rows, "settlement_id long, group_name string, amount decimal(12,2), is_refund boolean")
    got = [(r.group_name, int(r.amount)) for r in rollup.expense_summary(e).orderBy("rank").collect()]
    assert got == [("간식행사", 3000000), ("개강총회", 500000), ("환불", 50000), (None, 9000000)]


def test_ledger_block(spark):
    rows = [(1, i, date(2025, 12, d), g, Decimal(a), False, AT) for i, (d, a, g) in enumerate([(5, 820000, "간식행사"), (6, 400000, "간식행사"), (7, 10000, None)])]
    e = spark.createDataFrame(rows, "settlement_id long, evidence_id long, evidence_date date, group_name string, amount decimal(12,2), is_refund boolean, created_at timestamp")
    lines = ledger.ledger_lines(e).orderBy("seq").collect()
    assert [r.receipt_no for r in lines] == ["12*1", "12*2", "12*3"]
    assert [r.label for r in lines] == ["간식행사", None, None]
    assert [int(r.balance) for r in lines] == [-820000, -1220000, -1230000]
    totals = {(r.level, r.group_name): int(r.expense) for r in ledger.ledger_totals(e).collect()}
    assert totals == {(0, "간식행사"): 1220000, (0, "미분류"): 10000, (1, None): 1230000}


def test_what_students_read(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions.scalars import period_label, status_label

    rows = [(None, None, "미제출"), ("draft", None, "작성 중"), ("ready_for_review", None, "검토 준비"), ("submitted", None, "감사 중"), ("resubmitted", None, "감사 중"), ("under_audit", None, "under_audit"), ("rejected", AT, "반려"), ("approved", None, "승인 완료"), ("approved", AT, "공개 완료")]
    got = spark.createDataFrame(rows, "status string, published_at timestamp, want string").select("want", status_label(F.col("status"), F.col("published_at")).alias("label")).collect()
    assert [r.label for r in got] == [r.want for r in got]
    terms = spark.createDataFrame([("1",), ("summer",), ("winter",)], "s string").select(period_label(F.lit(2026), F.col("s")).alias("short"), period_label(F.lit(2026), F.col("s"), long=True).alias("long")).collect()
    assert [tuple(r) for r in terms] == [("2026-1학기", "2026학년도 1학기"), ("2026-여름학기", "2026학년도 여름학기"), ("2026-겨울학기", "2026학년도 겨울학기")]


def test_steps_of_a_settlement(spark):
    from ledgerloom.operators.lifecycle import progress_steps

    rows = [(1, "draft", None, None), (2, "submitted", AT, None), (3, "rejected", AT, AT), (4, "resubmitted", AT, None), (5, "approved", AT, AT)]
    got = progress_steps(spark.createDataFrame(rows, "settlement_id long, status string, submitted_at timestamp, audited_at timestamp")).orderBy("settlement_id", "step").collect()
    states = {k: [(r.state, r.completed_at is not None) for r in got if r.settlement_id == k] for k in range(1, 6)}
    done, waits, now = ("completed", True), ("pending", False), ("in_progress", False)
    assert states == {1: [waits, waits, waits], 2: [done, now, waits], 3: [done, done, waits], 4: [done, now, waits], 5: [done, done, done]}


def test_progress_has_two_decimals(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(1, 3), (2, 3), (0, 0), (5, 5)], "m long, n long").select(reconcile.progress(F.col("m"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [33.33, 66.67, 0.0, 100.0]


def test_who_hears_of_a_publication_and_who_may_be_invited(spark):
    from ledgerloom.operators import scope

    roles = ["student", "treasurer", "auditor", "president"]
    members = spark.createDataFrame([(1, u, r) for u, r in enumerate(roles)], "org_id long, user_id long, role string")
    actions = spark.createDataFrame([(1, 10, "publish", 3), (2, 10, "approve", None), (3, 10, "submit", 0)], "event_id long, settlement_id long, action string, actor_user_id long")
    heard = scope.notification_fanout(actions, spark.createDataFrame([(10, 1)], "settlement_id long, org_id long"), members).collect()
    assert sorted((r.event_id, r.user_id) for r in heard) == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 3), (3, 2)]
    asked = [(1, "treasurer_invite", "treasurer"), (2, "treasurer_invite", "auditor"), (3, "auditor_invite", "auditor"), (4, "auditor_invite", "student"), (5, "role_transfer", "president"), (6, "role_transfer", "student")]
    wrong = scope.invitation_rule_check(spark.createDataFrame(asked, "invitation_id long, invitation_type string, role string")).collect()
    assert sorted(r.invitation_id for r in wrong) == [2, 4, 6]


def test_days_of_review_are_from_submission_to_decision(spark):
    m = spark.createDataFrame([(1, 7, 70, "auditor", AT), (2, 7, 71, "auditor", AT)], "membership_id long, org_id long, user_id long, role string, created_at timestamp")
    at = lambda d: datetime(2026, 4, d)
    s = spark.createDataFrame([(10, 7, "approved", at(1), at(3)), (11, 7, "rejected", at(1), at(6)), (12, 7, "under_audit", at(1), None), (13, 7, "draft", None, None), (14, 8, "approved", at(1), at(9))], "settlement_id long, org_id long, status string, submitted_at timestamp, audited_at timestamp")
    c = spark.createDataFrame([(1, k, at(k)) for k in (10, 11, 12, 13, 14)] + [(1, 10, at(9))], "author_membership_id long, settlement_id long, created_at timestamp")
    got = {r.membership_id: r for r in rollup.auditor_activity(m, c, s).collect()}
    assert (got[1].reviewed, got[1].completed, got[1].pending, got[1].avg_review_days, got[1].last_activity_at) == (3, 2, 1, 3.5, at(13))
    assert (got[2].reviewed, got[2].avg_review_days, got[2].last_activity_at) == (0, None, AT)
