"""Roll-ups of settlements: sums, counts, progress, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import last_activity, semester_order, signed_amount
from .lifecycle import STATUSES as LIFECYCLE
from .reconcile import STATUSES, progress, status_counts

MONEY = "decimal(18,2)"
#: The roles whose dashboard is the treasurer's.
BOOKKEEPERS = ["treasurer", "president"]
#: Statuses that wait for an auditor, are with one, and are decided.
PENDING, IN_PROGRESS, COMPLETED = ["submitted", "resubmitted"], ["under_audit"], ["approved", "rejected"]


def money(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast(MONEY)


def expense_summary(evidences: DataFrame) -> DataFrame:
    """Per settlement and group: count, signed sum, rank (no group last, larger sums first) and the settlement's total."""
    by = evidences.groupBy("settlement_id", "group_name").agg(F.count("*").alias("item_count"), money(F.sum(signed_amount(F.col("amount"), F.col("is_refund")))).alias("amount"))
    at = Window.partitionBy("settlement_id")
    rank = F.row_number().over(at.orderBy(F.col("group_name").isNull(), F.col("amount").desc(), "group_name"))
    return by.select("*", rank.alias("rank"), F.sum("amount").over(at).cast(MONEY).alias("total_amount"))


def settlement_rollup(settlements: DataFrame, evidences: DataFrame, bank_tx: DataFrame, comments: DataFrame, recon: DataFrame) -> DataFrame:
    """Counts and sums of every settlement, each table aggregated before it is joined."""
    e = evidences.groupBy("settlement_id").agg(F.count("*").alias("evidence_count"), F.sum(signed_amount(F.col("amount"), F.col("is_refund"))).alias("evidence_sum"))
    t = bank_tx.groupBy("settlement_id").agg(F.count("*").alias("tx_count"))
    c = comments.groupBy("settlement_id").agg(F.count("*").alias("comment_count"))
    r = status_counts(recon)
    joined = settlements.select("settlement_id", "org_id", "status")
    for x in (e, t, c, r):
        joined = joined.join(x, "settlement_id", "left")
    zero = [*STATUSES, "total", "evidence_count", "tx_count", "comment_count"]
    full = joined.na.fill(0, zero).withColumn("evidence_sum", money(F.col("evidence_sum")))
    done = F.col("matched") + F.col("manually_resolved")
    return full.withColumn("progress_percent", progress(done, F.col("total"))).withColumn("unmatched_count", F.col("total") - done).withColumnRenamed("total", "recon_total")


def user_settlements(memberships: DataFrame, settlements: DataFrame, roles: list[str]) -> DataFrame:
    """(user_id, settlement columns) of the organisations in which a user has one of the roles."""
    return memberships.filter(F.col("role").isin(roles)).select("user_id", "org_id").distinct().join(settlements, "org_id")


def treasurer_dashboard(memberships: DataFrame, settlements: DataFrame, rollup: DataFrame) -> DataFrame:
    mine = user_settlements(memberships, settlements.select("settlement_id", "org_id", "status"), BOOKKEEPERS).join(rollup.drop("org_id", "status"), "settlement_id")
    done = F.sum("matched") + F.sum("manually_resolved")
    return mine.groupBy("user_id").agg(
        F.countDistinct("org_id").alias("org_count"), F.count("*").alias("settlement_count"), *(F.count_if(F.col("status") == x).alias(x) for x in LIFECYCLE),
        F.sum("evidence_count").alias("evidence_count"), F.sum("evidence_sum").cast(MONEY).alias("evidence_sum"), done.alias("matched_count"), (F.sum("recon_total") - done).alias("unmatched_count"), progress(done, F.sum("recon_total")).alias("progress_percent"),
    )


def recent_settlements(memberships: DataFrame, settlements: DataFrame, limit: int = 10) -> DataFrame:
    """The newest settlements of each bookkeeper: by submission, then creation.

    Only an organisation's newest can be among a member's, so each user meets these as one array an organisation."""
    newest = [F.desc_nulls_last("submitted_at"), F.desc("created_at"), "settlement_id"]
    first = settlements.withColumn("k", F.row_number().over(Window.partitionBy("org_id").orderBy(*newest))).filter(F.col("k") <= limit)
    # An array sorts by these: never submitted last, then the latest first.
    age = lambda c: (-F.unix_micros(F.col(c).cast("timestamp_ltz"))).alias(c)
    entry = F.struct(F.col("submitted_at").isNull().alias("never"), age("submitted_at"), F.col("created_at").isNull().alias("undated"), age("created_at"), "settlement_id", "status")
    tops = first.groupBy("org_id").agg(F.collect_list(entry).alias("top"))
    mine = memberships.filter(F.col("role").isin(BOOKKEEPERS)).select("user_id", "org_id").distinct().join(tops, "org_id")
    best = mine.groupBy("user_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, limit).alias("best"))
    return best.select("user_id", F.posexplode("best").alias("pos", "s")).select("user_id", "s.settlement_id", "s.status", (F.col("pos") + 1).alias("rank"))


def auditor_dashboard(scope: DataFrame, settlements: DataFrame) -> DataFrame:
    """Per auditor: organisations in scope, and their settlements by how far their audit is."""
    mine = scope.join(settlements, "org_id", "left")
    bucket = lambda xs: F.count_if(F.col("status").isin(xs))
    return mine.groupBy("user_id").agg(F.countDistinct("org_id").alias("org_count"), bucket(PENDING).alias("pending"), bucket(IN_PROGRESS).alias("in_progress"), bucket(COMPLETED).alias("completed"), F.count("settlement_id").alias("total"))


def auditor_pending(scope: DataFrame, settlements: DataFrame, limit: int = 10) -> DataFrame:
    """The newest settlements in each auditor's scope that wait for audit: by submission, then creation."""
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("submitted_at"), F.desc("created_at"), "settlement_id")
    waiting = scope.join(settlements.filter(F.col("status").isin(PENDING)), "org_id")
    return waiting.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("user_id", "settlement_id", "status", "rank")


def president_dashboard(memberships: DataFrame, users: DataFrame, settlements: DataFrame) -> DataFrame:
    team = memberships.groupBy("org_id").agg(F.countDistinct("user_id").alias("team_size"), F.min_by("user_id", F.struct(F.when(F.col("role") == "president", 0).otherwise(1), ~F.col("is_primary"), "created_at", "membership_id")).alias("first_id"), F.max((F.col("role") == "president").cast("int")).alias("has"))
    team = team.join(users.select(F.col("user_id").alias("first_id"), F.col("name").alias("president_name")), "first_id", "left").select("org_id", "team_size", F.when(F.col("has") == 1, F.col("president_name")).alias("president_name"))
    work = settlements.groupBy("org_id").agg(
        F.count_if(F.col("status").isin(PENDING + IN_PROGRESS + COMPLETED)).alias("submitted_count"), F.count_if(F.col("status").isin(COMPLETED)).alias("completed_count"), F.count_if(F.col("status").isin(PENDING + IN_PROGRESS)).alias("pending_count"),
        F.max(F.struct("academic_year", semester_order(F.col("semester")).alias("o"), "semester")).alias("p"),
    )
    return team.join(work, "org_id").select("org_id", "team_size", "president_name", "submitted_count", "completed_count", "pending_count", F.col("p.academic_year").alias("current_year"), F.col("p.semester").alias("current_semester"))


def auditor_activity(memberships: DataFrame, comments: DataFrame, settlements: DataFrame) -> DataFrame:
    """Per auditor membership: settlements of its organisation that it commented on, decided or waiting; days from
    submission to decision (each and their mean to one decimal, halves to even); last activity."""
    last = comments.groupBy("author_membership_id", "settlement_id").agg(F.max("created_at").alias("at"))
    days = F.bround((F.unix_seconds(F.col("audited_at").cast("timestamp")) - F.unix_seconds(F.col("submitted_at").cast("timestamp"))) / 86400.0, 1)
    done = F.col("status").isin(COMPLETED)
    auditors = memberships.filter("role = 'auditor'")
    own = auditors.select(F.col("membership_id").alias("author_membership_id"), F.col("org_id").alias("_org"))
    seen = last.join(settlements.select("settlement_id", "org_id", "status", "submitted_at", "audited_at"), "settlement_id").join(own, "author_membership_id").filter("org_id = _org")
    per = seen.groupBy(F.col("author_membership_id").alias("membership_id")).agg(
        F.count_if(done).alias("completed"), F.count_if(F.col("status").isin(PENDING + IN_PROGRESS)).alias("pending"), F.bround(F.avg(F.when(done, days)), 1).alias("avg_review_days"), F.max("at").alias("last_at"))
    out = auditors.join(per, "membership_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("membership_id", "org_id", "user_id", number(F.col("completed") + F.col("pending")).alias("reviewed"), *(number(c).alias(c) for c in ("completed", "pending")), "avg_review_days", F.coalesce("last_at", "created_at").alias("last_activity_at"))


def auditor_worklist(scope: DataFrame, rollup: DataFrame) -> DataFrame:
    return scope.join(rollup.filter(F.col("status").isin(PENDING + IN_PROGRESS + COMPLETED)), "org_id").select("user_id", "settlement_id", "status", "evidence_count", "tx_count", "comment_count", *STATUSES, "progress_percent")


def snapshot(settlements: DataFrame, evidences: DataFrame, strict: bool) -> DataFrame:
    """Count and signed sum of each settlement's evidences as of its publication. Not strict: unpublished ones count all."""
    dated = settlements.select("settlement_id", "published_at", "status")
    if strict:
        dated = public_gate(dated)
    seen = F.col("created_at") <= F.col("published_at")
    if not strict:
        seen = seen | F.col("published_at").isNull()
    e = dated.join(evidences.select("settlement_id", "amount", "is_refund", "created_at"), "settlement_id").filter(seen).groupBy("settlement_id").agg(F.count("*").alias("item_count"), F.sum(signed_amount(F.col("amount"), F.col("is_refund"))).alias("total_amount"))
    return dated.join(e, "settlement_id", "left").select("settlement_id", F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count"), money(F.col("total_amount")).alias("total_amount"))


def public_gate(settlements: DataFrame) -> DataFrame:
    return settlements.filter("status = 'approved' and published_at is not null")


def student_dashboard(memberships: DataFrame, settlements: DataFrame, evidences: DataFrame) -> DataFrame:
    """Per user and organisation: published settlements, last publication and views; the current period with its sum and count."""
    pub = public_gate(settlements).groupBy("org_id").agg(F.count("*").alias("published_count"), F.max("published_at").alias("last_published_at"), F.sum("view_count").alias("view_count"))
    last = settlements.groupBy("org_id").agg(F.max(F.struct("academic_year", semester_order(F.col("semester")).alias("o"), "settlement_id", "semester")).alias("p")).select("org_id", "p.academic_year", "p.semester", "p.settlement_id")
    now = last.join(snapshot(settlements, evidences, strict=False), "settlement_id")
    base = memberships.select("user_id", "org_id").distinct().join(now, "org_id").join(pub, "org_id", "left")
    return base.select("user_id", "org_id", "settlement_id", "academic_year", "semester", "item_count", "total_amount", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("published_count", "view_count")), "last_published_at")


def student_recent(settlements: DataFrame, evidences: DataFrame, comments: DataFrame, limit: int = 5) -> DataFrame:
    """Per organisation the settlements published last, with their sum as of publication and their latest comment."""
    w = Window.partitionBy("org_id").orderBy(F.desc("published_at"), "settlement_id")
    recent = public_gate(settlements).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("org_id", "settlement_id", "rank")
    return recent.join(snapshot(settlements, evidences, strict=False), "settlement_id").join(latest_comment(comments), "settlement_id", "left").select("org_id", "settlement_id", "rank", "total_amount", "comment")


def current_period(settlements: DataFrame) -> DataFrame:
    return settlements.groupBy("org_id").agg(F.max(F.struct("academic_year", semester_order(F.col("semester")).alias("o"), "semester")).alias("p")).select("org_id", "p.academic_year", "p.semester")


def public_settlements(visible: DataFrame, organizations: DataFrame, settlements: DataFrame, evidences: DataFrame) -> DataFrame:
    shown = public_gate(settlements).join(organizations.select("org_id", "college_name"), "org_id").join(snapshot(settlements, evidences, strict=True), "settlement_id")
    return visible.join(shown, "college_name").select("user_id", "settlement_id", "item_count", "total_amount")


def public_periods(visible: DataFrame, organizations: DataFrame, settlements: DataFrame) -> DataFrame:
    shown = public_gate(settlements).join(organizations.select("org_id", "college_name"), "org_id")
    per_college = shown.groupBy("college_name", "academic_year", "semester").agg(F.count("*").alias("n"))  # before users meet settlements
    by = visible.join(per_college, "college_name").groupBy("user_id", "academic_year", "semester").agg(F.sum("n").alias("published_count"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("academic_year"), F.desc(semester_order(F.col("semester"))))))


def spec_fields(settlements: DataFrame, organizations: DataFrame, rollup: DataFrame) -> DataFrame:
    """One row per settlement with the fields that report templates know, but for the time of making; dates in ISO form."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx").alias(c)
    orgs = organizations.select("org_id", F.col("name").alias("organization_name"), "college_name", "department_name")
    counts = rollup.select("settlement_id", F.col("evidence_sum").alias("total_evidence_amount"), "evidence_count", F.col("tx_count").alias("bank_transaction_count"), *(F.col(x).alias(f"{x}_count") for x in STATUSES[:5]))
    dated = settlements.select("settlement_id", "org_id", "title", "academic_year", "semester", *(iso(c) for c in ("submitted_at", "audited_at", "published_at")))
    return dated.join(orgs, "org_id").join(counts, "settlement_id").drop("org_id")


def notification_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("read_at").isNull()).alias("unread"))


def inbox(notifications: DataFrame, limit: int = 50) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("notification_id"))
    return notifications.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= min(limit, 200)).select("user_id", "notification_id", "rank")


def latest_comment(comments: DataFrame) -> DataFrame:
    return comments.groupBy("settlement_id").agg(F.max_by(F.struct("comment_id", "comment"), F.struct("created_at", "comment_id")).alias("c")).select("settlement_id", "c.comment_id", "c.comment")


def with_last_activity(settlements: DataFrame) -> DataFrame:
    return settlements.select("settlement_id", last_activity(settlements).alias("last_activity_at"))


def review_bundle(settlements: DataFrame, evidences: DataFrame, bank_tx: DataFrame, comments: DataFrame, recon: DataFrame) -> DataFrame:
    """The four sections of each settlement's review in one table: (settlement_id, section, ordinal, item_id)."""

    def section(no: int, rows: DataFrame, item: str, *order: object) -> DataFrame:
        w = Window.partitionBy("settlement_id").orderBy(*order)
        return rows.select("settlement_id", F.lit(no).alias("section"), F.row_number().over(w).alias("ordinal"), F.col(item).alias("item_id"))

    parts = [
        section(1, evidences, "evidence_id", F.asc_nulls_last("evidence_date"), "created_at", "evidence_id"),
        section(2, bank_tx, "tx_id", "transaction_date", "created_at", "tx_id"),
        section(3, recon.withColumn("item", F.coalesce("evidence_id", "tx_id")), "item", "status", "item"),
        section(4, comments, "comment_id", F.desc("created_at"), F.desc("comment_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
