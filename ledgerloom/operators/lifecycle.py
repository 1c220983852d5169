"""The settlement lifecycle as a scan over actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import cut

#: The statuses, which of them an action may follow, the status after it, and why it is refused otherwise.
STATUSES = ["draft", "ready_for_review", "submitted", "under_audit", "approved", "rejected", "resubmitted"]
RULES = {"submit": (["draft"], "submitted"), "approve": (["submitted", "resubmitted"], "approved"), "reject": (["submitted", "resubmitted"], "rejected"), "resubmit": (["rejected"], "resubmitted"), "publish": (["approved"], "approved")}
REASONS = {
    "submit": "DRAFT 상태에서만 제출할 수 있습니다 (현재: {}).",
    "approve": "제출됨/재제출됨 상태의 결산안만 승인할 수 있습니다 (현재: {}).",
    "reject": "제출됨/재제출됨 상태의 결산안만 반려할 수 있습니다 (현재: {}).",
    "resubmit": "반려 상태의 결산안만 재제출할 수 있습니다 (현재: {}).",
    "publish": "승인된 결산안만 공개할 수 있습니다 (현재: {}).",
}
ALREADY_PUBLIC = "이미 공개된 결산안입니다."
UNKNOWN = "unknown action"
#: Bits of the number of events in a block, and of blocks in a block of blocks.
BITS = 9


def moves() -> list[list[int]]:
    """For each action, and last for any other, the state after each state. A state is twice a status' place, and one more once published."""
    table = []
    for action, (froms, to) in RULES.items():
        row = []
        for s in range(2 * len(STATUSES)):
            ok = STATUSES[s // 2] in froms and not (action == "publish" and s % 2)
            row.append(2 * STATUSES.index(to) + (1 if action == "publish" else s % 2) if ok else s)
        table.append(row)
    return [*table, list(range(2 * len(STATUSES)))]


def refusal(action: Column, status: Column, published: Column) -> Column:
    """Why an action isn't allowed in a status; null where it is."""
    reason = F.when(~F.coalesce(action.isin(*RULES), F.lit(False)), UNKNOWN)
    for name, (froms, _) in RULES.items():
        head, tail = REASONS[name].split("{}")
        reason = reason.when((action == name) & ~status.isin(froms), F.concat(F.lit(head), status, F.lit(tail)))
    return reason.when((action == "publish") & published, ALREADY_PUBLIC)


def _running(items: Column, start: Column, after: object) -> Column:
    """The state before each item of an array, from ``start`` on."""
    states = F.aggregate(items, F.array(start), lambda done, x: F.concat(done, F.array(after(F.element_at(done, -1), x))))
    return F.slice(states, 1, F.size(items))


def lifecycle_events(actions: DataFrame) -> DataFrame:
    """(settlement_id, event_id, ts, action, before, after, accepted, reason): every action by time and event id, from draft.

    An action is a function from states to states, so a block of events is one too: blocks of 512 events, and blocks of as
    many blocks, are composed apart from each other, and a long history is no single group. The state before a block is
    that of all earlier blocks applied to a draft; within a block the events follow in order."""
    order = ["settlement_id", "ts", "event_id"]
    table = F.array(*[F.array(*map(F.lit, row)) for row in moves()])
    code = F.coalesce(*[F.when(F.col("action") == a, i) for i, a in enumerate(RULES)], F.lit(len(RULES)))
    size = 2 * len(STATUSES)
    identity = F.array(*map(F.lit, range(size)))
    placed = actions.select("settlement_id", "event_id", "ts", "action", code.alias("code")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())

    def composed(items: Column) -> Column:
        """What a run of functions does to every state, one after another."""
        return F.aggregate(items, identity, lambda f, g: F.transform(f, lambda s: F.get(g, s)))

    event = F.struct("at", "event_id", "ts", "action", "code")
    blocks = placed.groupBy("settlement_id", F.shiftright("at", BITS).alias("block")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    # Written once: the bounds of ranges are sampled anew each time, so a block that is made twice needn't have the same events.
    blocks = cut(blocks.withColumn("does", composed(F.transform("events", lambda e: F.get(table, e["code"])))))
    upper = blocks.groupBy("settlement_id", F.shiftright("block", BITS).alias("top")).agg(F.array_sort(F.collect_list(F.struct("block", "does"))).alias("blocks")).withColumn("does", composed(F.col("blocks.does")))
    whole = upper.groupBy("settlement_id").agg(F.array_sort(F.collect_list(F.struct("top", "does"))).alias("tops"))

    def before(items: str, start: Column) -> Column:
        return F.arrays_zip(F.col(items), _running(F.col(items), start, lambda s, x: F.get(x["does"], s)).alias("state"))

    starts = whole.select("settlement_id", F.inline(before("tops", F.lit(0)))).select("settlement_id", F.col("tops.top").alias("top"), "state")
    starts = upper.select("settlement_id", "top", "blocks").join(starts, ["settlement_id", "top"]).select("settlement_id", F.inline(before("blocks", F.col("state")))).select("settlement_id", F.col("blocks.block").alias("block"), "state")
    states = _running(F.col("events"), F.col("state"), lambda s, e: F.get(F.get(table, e["code"]), s))
    rows = blocks.join(starts, ["settlement_id", "block"]).select("settlement_id", F.inline(F.arrays_zip("events", states.alias("s"))))
    names = F.array(*map(F.lit, STATUSES))
    status = F.get(names, F.floor(F.col("s") / 2).cast("int"))
    reason = refusal(F.col("events.action"), status, F.col("s") % 2 == 1)
    later = F.get(names, F.floor(F.get(F.get(table, F.col("events.code")), F.col("s")) / 2).cast("int"))
    return rows.select("settlement_id", "events.event_id", "events.ts", "events.action", status.alias("before"), later.alias("after"), reason.isNull().alias("accepted"), reason.alias("reason"))


def lifecycle_replay(actions: DataFrame) -> DataFrame:
    """(settlement_id, status, submitted_at, audited_at, published_at, accepted, refused) after all actions, from draft.

    Submission and resubmission clear the audit's time."""
    at = F.struct("ts", "event_id")
    of = lambda *names: F.max(F.when(F.col("accepted") & F.col("action").isin(*names), at))
    last = lifecycle_events(actions).groupBy("settlement_id").agg(
        F.max_by("after", at).alias("status"), of("submit", "resubmit").alias("sent"), of("approve", "reject").alias("audited"), of("publish").alias("public"),
        F.count_if("accepted").cast("int").alias("accepted"), F.count_if(~F.col("accepted")).cast("int").alias("refused"))
    audited = F.when(F.col("sent").isNull() | (F.col("audited") > F.col("sent")), F.col("audited.ts"))
    return last.select("settlement_id", "status", F.col("sent.ts").alias("submitted_at"), audited.alias("audited_at"), F.col("public.ts").alias("published_at"), "accepted", "refused")


def view_counts(views: DataFrame, public: DataFrame, visible: DataFrame) -> DataFrame:
    """Views of each published settlement by users who may see it, each event once."""
    seen = views.dropDuplicates(["event_id"]).join(public, "settlement_id").join(visible, ["user_id", "college_name"], "left_semi")
    return seen.groupBy("settlement_id").agg(F.count("*").alias("view_count"))


def progress_steps(settlements: DataFrame) -> DataFrame:
    """(settlement_id, step, state, completed_at): submission, audit, approval."""
    status = F.col("status")
    sent, with_auditor, passed = F.col("submitted_at").isNotNull(), status.isin("submitted", "resubmitted"), status == "approved"
    audited = ~with_auditor & F.col("audited_at").isNotNull()

    def step(no: int, done: Column, at: Column, now: Column | None = None) -> Column:
        state = F.when(now, "in_progress") if now is not None else F
        return F.struct(F.lit(no).alias("step"), state.when(done, "completed").otherwise("pending").alias("state"), F.when(done, at).alias("completed_at"))

    steps = F.array(step(1, sent, F.col("submitted_at")), step(2, audited, F.col("audited_at"), with_auditor), step(3, passed, F.col("audited_at")))
    return settlements.select("settlement_id", F.inline(steps))
