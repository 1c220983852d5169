"""One-to-one reconciliation of receipts with bank transactions."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Callable, Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import Work, cut, lasting
from .components import connected

#: Evidence statuses that take part, and a near amount's limits.
OPEN_STATUSES = ["needs_review", "confirmed", "uploaded"]
GAP_FACTOR, GAP_LEAST = 10, 1000

#: Rows of a settlement from which on it is cut into its interacting parts.
SPLIT_OVER = 50_000
#: Settlements, and days and amounts of settlements, that are broadcast at most; beyond that rows are shuffled to them.
BROADCAST_IDS = 250_000

RESULT = "settlement_id long, evidence_id long, tx_id long, status string, tier int"


#: Stand for a day and for an amount that a row doesn't have.
NO_DAY, NO_AMOUNT = -(1 << 40), -1


class _Free:
    """Free transactions of a settlement by a key, in order of arrival; those taken elsewhere are passed over. Filed when first asked for."""

    def __init__(self, keys: Iterable[object], taken: bytearray) -> None:
        self.keys, self.taken = keys, taken

    @cached_property
    def by(self) -> dict[object, deque[int]]:
        out: dict[object, deque[int]] = defaultdict(deque)
        for i, key in enumerate(self.keys):
            out[key].append(i)
        return out

    def first(self, key: object) -> int | None:
        held, taken = self.by.get(key), self.taken
        while held:
            if not taken[held[0]]:
                return held[0]
            held.popleft()
        return None


def _nearest(held: list[int], a: int, first: Callable[[int], int]) -> int:
    """Of amounts in ascending order the one nearest to ``a``; of two equally near ones that whose first transaction came first."""
    at = bisect_left(held, a)
    near = held[max(at - 1, 0) : at + 1]
    if len(near) == 2 and a - near[0] == near[1] - a:
        return min(near, key=first)
    return min(near, key=lambda x: abs(x - a))


def match(days: list[int], amounts: list[int], tx_days: list[int], tx_amounts: list[int]) -> tuple[list[int | None], list[int | None]]:
    """The transaction's place that each evidence takes and its tier, or nulls; both are in order of arrival, amounts in
    cents without their sign.

    Each evidence takes the first free transaction of the best tier. Tier 1: same day and amount. Tier 2: same day, the
    nearest amount within the limits (an evidence of amount zero takes the first of the day). Tier 3: same amount on any day.
    A day's free amounts stand in one sorted list, each once, however many transactions have it."""
    taken = bytearray(len(tx_days))
    exact, by_day, by_amount = (_Free(keys, taken) for keys in (zip(tx_days, tx_amounts, strict=True), tx_days, tx_amounts))
    near_by: dict[int, list[int]] = defaultdict(list)
    for d, a in exact.by:
        if a != NO_AMOUNT:
            near_by[d].append(a)
    for held in near_by.values():
        held.sort()
    picks, tiers = [], []
    for day, a in zip(days, amounts, strict=True):
        pick = tier = None
        if a != NO_AMOUNT and day != NO_DAY:
            if (pick := exact.first((day, a))) is not None:
                tier = 1
            elif a == 0:
                pick, tier = by_day.first(day), 2
            elif held := near_by.get(day):
                near = _nearest(held, a, lambda x: exact.first((day, x)))  # noqa: B023
                if abs(near - a) <= max(GAP_FACTOR * a, GAP_LEAST * 100):
                    pick, tier = exact.first((day, near)), 2
            if pick is None:
                pick, tier = by_amount.first(a), 3
        if pick is None:
            tier = None
        else:
            taken[pick] = 1
            d, b = tx_days[pick], tx_amounts[pick]
            if b != NO_AMOUNT and exact.first((d, b)) is None:
                held = near_by[d]
                held.pop(bisect_left(held, b))
        picks.append(pick)
        tiers.append(tier)
    return picks, tiers


_STATUS = {1: "matched", 2: "amount_mismatch", 3: "date_mismatch", None: "missing_bank_transaction"}
_RESULT = pa.schema([("settlement_id", pa.int64()), ("evidence_id", pa.int64()), ("tx_id", pa.int64()), ("status", pa.string()), ("tier", pa.int32())])


def match_settlement(rows: pa.Table) -> pa.Table:
    """Results of rows that bear upon each other: evidences and transactions (is_tx, id, day, cents, created_at)."""
    rows = rows.sort_by([("created_at", "ascending"), ("id", "ascending")])
    ev, tx = rows.filter(pc.invert(rows["is_tx"])), rows.filter(rows["is_tx"])
    listed = lambda t: (pc.fill_null(pc.cast(t["day"], pa.int64()), NO_DAY).to_numpy().tolist(), pc.fill_null(pc.abs(t["cents"]), NO_AMOUNT).to_numpy().tolist())
    picks, tiers = match(*listed(ev), *listed(tx))
    places = pa.array(picks, pa.int64())
    free = np.ones(len(tx), bool)
    free[places.drop_null().to_numpy()] = False
    rest = tx["id"].filter(pa.array(free))
    n, m = len(ev), len(rest)
    both = lambda x, y: pa.chunked_array([*x.chunks, *y.chunks])
    none = lambda kind, k: pa.chunked_array([pa.nulls(k, kind)])
    status = pa.array([*(_STATUS[t] for t in tiers), *["missing_evidence"] * m], pa.string())
    tier = pa.array(tiers + [None] * m, pa.int32())
    return pa.table([pa.repeat(rows["settlement_id"][0], n + m), both(ev["id"], none(pa.int64(), m)), both(tx["id"].take(places), rest), status, tier], schema=_RESULT)


def parts_that_interact(rows: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """The settlements of rows (settlement_id, is_tx, by_day, by_amount) that have several components, after (node, component) of these.

    Choices meet only over a day or an amount of a settlement that has evidences and transactions both. Such days and
    amounts are nodes, a row that has a day and an amount among them ties the two, and a part is a component. Rows that
    are alike in these are looked at once."""
    kinds = work.table(rows.select("settlement_id", "is_tx", "by_day", "by_amount").distinct())
    nodes = kinds.select("settlement_id", "is_tx", F.explode(F.array("by_day", "by_amount")).alias("node")).filter("node is not null")
    live = work.table(nodes.groupBy("settlement_id", "node").agg(F.bool_or("is_tx").alias("in_tx"), F.bool_or(~F.col("is_tx")).alias("in_ev")).filter("in_tx and in_ev").select("settlement_id", "node"))
    ties = kinds.select("by_day", "by_amount").filter("by_day is not null and by_amount is not null").distinct()
    for c in ("by_day", "by_amount"):
        ties = ties.join(live.select(F.col("node").alias(c)), c)
    found = connected(ties.select(F.col("by_day").alias("a"), F.col("by_amount").alias("b")), work)
    part = cut(live.join(found, "node", "left").select("settlement_id", "node", F.coalesce("component", "node").alias("component")))
    several = part.groupBy("settlement_id").agg((F.min("component") != F.max("component")).alias("several")).filter("several").select("settlement_id")
    several = cut(several)
    return part.join(several, "settlement_id", "left_semi").select("node", "component"), several


def _small(table: DataFrame, number: int) -> DataFrame:
    return F.broadcast(table) if number <= BROADCAST_IDS else table


def reconcile(evidences: DataFrame, bank_tx: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """(settlement_id, evidence_id, tx_id, status, tier): one row per evidence that takes part and per transaction left.

    The greedy order is the result's meaning, so rows that bear upon each other are one group. A settlement of up to
    ``split_over`` rows is one; a larger one is cut into its interacting parts, which are dealt into as many groups as
    its size asks for. That changes nothing in the result, as parts don't bear upon each other. A worker holds about
    ``split_over`` rows, or the largest part; a settlement of one part stays as it is.

    Rows are written once, as Parquet, and shuffled once, to their groups: what is known of settlements and of their days
    and amounts is broadcast to them, up to ``BROADCAST_IDS`` of each."""
    day = lambda c: F.date_diff(F.col(c), F.lit("1970-01-01").cast("date")).alias("day")
    cents = (F.col("amount") * 100).cast("long").alias("cents")
    e = evidences.filter(F.col("status").isin(OPEN_STATUSES)).select("settlement_id", F.lit(False).alias("is_tx"), F.col("evidence_id").alias("id"), day("evidence_date"), cents, "created_at")
    t = bank_tx.select("settlement_id", F.lit(True).alias("is_tx"), F.col("tx_id").alias("id"), day("transaction_date"), cents, "created_at")
    rows = lasting(e.unionByName(t), "reconcile-rows")
    sizes = cut(rows.groupBy("settlement_id").agg(F.count("*").alias("n")))
    number, largest, over = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.col("n") > split_over)).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(number / SPLIT_OVER))
    matched = lambda d, *keys: d.repartition(tasks, *keys).groupBy(*keys).applyInArrow(match_settlement, RESULT)
    if largest <= split_over:
        return matched(rows, "settlement_id")
    large = _small(sizes.filter(F.col("n") > split_over).select("settlement_id", F.ceil(F.col("n") / split_over).cast("int").alias("groups")), over)
    looks = F.col("is_tx") | (F.col("day").isNotNull() & F.col("cents").isNotNull())
    node = lambda kind, c: F.when(looks & c.isNotNull(), F.xxhash64("settlement_id", F.lit(kind), c))
    dated = rows.withColumns({"by_day": node("day", F.col("day")), "by_amount": node("amount", F.abs("cents"))})
    with Work(rows.sparkSession, "reconcile") as work:
        part, several = parts_that_interact(dated.join(large, "settlement_id", "left_semi"), work)
    part = cut(part)
    nodes = _small(part, part.count())
    cuttable = _small(large.join(several, "settlement_id"), over)
    split = dated.join(cuttable, "settlement_id")
    for c in ("by_day", "by_amount"):
        split = split.join(nodes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")), c, "left")
    split = split.withColumn("part", F.coalesce("by_day_part", "by_amount_part"))
    columns = ["settlement_id", "is_tx", "id", "day", "cents", "created_at", "group"]
    whole = rows.join(cuttable, "settlement_id", "left_anti").withColumn("group", F.lit(0))
    # A row without a part can't be matched and may be in any group.
    dealt = split.withColumn("group", F.pmod(F.xxhash64(F.coalesce("part", "id")), F.col("groups")).cast("int"))
    return matched(whole.select(*columns).unionByName(dealt.select(*columns)), "settlement_id", "group")


def exact_kth(evidences: DataFrame, bank_tx: DataFrame) -> DataFrame:
    """Pairs the k-th evidence with the k-th transaction of the same settlement, day and amount."""
    keys = ["settlement_id", "day", "value", "k"]
    e = evidences.filter(F.col("status").isin(OPEN_STATUSES)).select("settlement_id", F.col("evidence_date").alias("day"), F.abs("amount").alias("value"), "evidence_id", "created_at").filter("day is not null and value is not null")
    t = bank_tx.select("settlement_id", F.col("transaction_date").alias("day"), F.abs("amount").alias("value"), "tx_id", "created_at")
    order = lambda i: Window.partitionBy("settlement_id", "day", "value").orderBy("created_at", i)
    return e.withColumn("k", F.row_number().over(order("evidence_id"))).drop("created_at").join(t.withColumn("k", F.row_number().over(order("tx_id"))).drop("created_at"), keys).select("settlement_id", "evidence_id", "tx_id", "k")


def amount_class(amount: Column) -> Column:
    """0 below 1,024, where every near band reaches or nearly so; from there on a class for each factor of 32."""
    return F.when(amount < 1024, 0).otherwise(F.least(F.floor((F.log2(amount) - 10) / 5) + 1, F.lit(TOP_CLASS))).cast("int")


def day_pairs(e: DataFrame, t: DataFrame, tasks: int | None = None) -> DataFrame:
    """Evidences with the transactions of their day whose amount is in a class that the near band reaches.

    An evidence of amount a takes up to a + max(10 a, 1000), and from nothing on (the band is wider than a), so it is filed under
    the classes up to the one of that bound, six at most; amount 0 takes any. Of a day's pairs only those are built that lie
    in the band or at most a factor of 32 beyond it."""
    top = F.when(F.col("a") == 0, F.lit(TOP_CLASS)).otherwise(amount_class(F.col("a") + F.greatest(F.col("a") * GAP_FACTOR, F.lit(GAP_LEAST))))
    filed = e.withColumn("class", F.explode(F.sequence(F.lit(0), top)))
    held = t.filter("b is not null").withColumn("class", amount_class(F.col("b"))).withColumnRenamed("transaction_date", "evidence_date")
    return _joined(filed, held, ["settlement_id", "evidence_date", "class"], tasks)


def _joined(a: DataFrame, b: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """The rows that agree in ``keys``, both sides dealt by them into ``tasks`` if that is given: Spark deals by what goes in,
    and here much more comes out."""
    if tasks:
        a, b = a.repartition(tasks, *keys), b.repartition(tasks, *keys)
    return a.join(b.hint("merge"), keys)


#: Amounts have twelve digits at most, so this class holds the largest.
TOP_CLASS = 5


def candidates(evidences: DataFrame, bank_tx: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every transaction that an evidence could take, with the tier and the gap: a banded join within days, and an equi-join on amounts.

    The pairs grow with the square of the rows. They stream out of merge joins, so a task holds none of them, only the
    transactions of one key; ``tasks`` is the number of tasks that the joins are dealt into."""
    e = evidences.filter(F.col("status").isin(OPEN_STATUSES)).select("settlement_id", "evidence_id", "evidence_date", F.abs("amount").alias("a")).filter("a is not null and evidence_date is not null")
    t = bank_tx.select("settlement_id", "tx_id", "transaction_date", F.abs("amount").alias("b"))
    gap = F.abs(F.col("a") - F.col("b")).cast("decimal(13,2)").alias("gap")
    same_day = day_pairs(e, t, tasks)
    day = same_day.select("settlement_id", "evidence_id", "tx_id", F.when(F.col("a") == F.col("b"), 1).otherwise(2).alias("tier"), gap, "a").filter((F.col("tier") == 1) | (F.col("a") == 0) | (F.col("gap") <= F.greatest(F.col("a") * GAP_FACTOR, F.lit(GAP_LEAST)))).drop("a")
    amount = _joined(e, t.withColumnRenamed("b", "a"), ["settlement_id", "a"], tasks).filter("evidence_date <> transaction_date").select("settlement_id", "evidence_id", "tx_id", F.lit(3).alias("tier"), F.lit(0).cast("decimal(13,2)").alias("gap"))
    return day.unionByName(amount)


#: Above any bound of a near band; where an evidence of amount zero looks, and where transactions without an amount are.
BEYOND = 10**12


def candidate_digest(evidences: DataFrame, bank_tx: DataFrame) -> DataFrame:
    """(settlement_id, evidence_id, exact, near, dated, tx_ids, gaps): for each evidence that takes part the number of
    transactions that ``candidates`` gives it in each of the three tiers, the sum of their ids and of their gaps.

    No pair is built. A day's transactions are summed up by amount, and running sums in the order of amounts, read just below
    an evidence's amount, at it and at its band's end, give the first two tiers; the band starts below nothing. The third
    is what a settlement has of the amount, less what the day has of it."""
    number, sums = "decimal(38,0)", ["n", "ids", "worth"]
    e = evidences.filter(F.col("status").isin(OPEN_STATUSES)).select("settlement_id", "evidence_id", F.col("evidence_date").alias("day"), F.abs("amount").alias("a")).filter("a is not null and day is not null")
    t = bank_tx.select("settlement_id", F.col("tx_id").cast(number).alias("tx_id"), F.col("transaction_date").alias("day"), F.abs("amount").alias("b"))
    each = t.groupBy("settlement_id", "day", "b").agg(F.count("*").alias("n"), F.sum("tx_id").alias("ids"), F.coalesce(F.sum("b"), F.lit(0)).cast("decimal(38,2)").alias("worth"))
    value = lambda c: c.cast("decimal(18,2)").alias("v")
    end = F.when(F.col("a") == 0, F.lit(BEYOND)).otherwise(F.col("a") + F.greatest(F.col("a") * GAP_FACTOR, F.lit(GAP_LEAST)))
    looks = F.array(*(F.struct(value(v), F.lit(side).alias("side")) for v, side in ((F.col("a"), -1), (F.col("a"), 1), (end, 2))))
    asked = e.select("settlement_id", "day", "a").distinct().select("settlement_id", "day", "a", F.inline(looks))
    held = each.select("settlement_id", "day", value(F.coalesce("b", F.lit(BEYOND))), F.lit(0).alias("side"), *sums)
    run = Window.partitionBy("settlement_id", "day").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = held.unionByName(asked, allowMissingColumns=True).withColumns({c: F.coalesce(F.sum(c).over(run), F.lit(0)) for c in sums}).filter("side <> 0")
    at = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    read = seen.groupBy("settlement_id", "day", "a").agg(*(at(c, side).alias(f"{c}_{name}") for c in sums for name, side in (("below", -1), ("upto", 1), ("all", 2))))
    whole = each.filter("b is not null").groupBy("settlement_id", F.col("b").alias("a")).agg(F.sum("n").alias("same"), F.sum("ids").alias("same_ids"))
    exact, exact_ids = F.col("n_upto") - F.col("n_below"), F.col("ids_upto") - F.col("ids_below")
    none = lambda c: F.coalesce(c, F.lit(0))
    gaps = F.col("a") * F.col("n_upto") - F.col("worth_upto") + (F.col("worth_all") - F.col("worth_upto")) - F.col("a") * (F.col("n_all") - F.col("n_upto"))
    met = e.join(read, ["settlement_id", "day", "a"], "left").join(whole, ["settlement_id", "a"], "left")
    return met.select(
        "settlement_id", "evidence_id", none(exact).alias("exact"), none(F.col("n_all") - exact).alias("near"), none(F.col("same") - exact).alias("dated"),
        none(F.col("ids_all") + none(F.col("same_ids") - exact_ids)).cast(number).alias("tx_ids"), none(gaps).cast("decimal(38,2)").alias("gaps"),
    )


def with_labels(results: DataFrame, evidences: DataFrame, bank_tx: DataFrame) -> DataFrame:
    """Results with their evidence's merchant and their transaction's description, if they have any. A result without one of
    the two ids is dealt by the other, so those don't meet in one task."""
    keyed = results.withColumns({"e_id": F.coalesce("evidence_id", "tx_id"), "t_id": F.coalesce("tx_id", "evidence_id"), "has_e": F.col("evidence_id").isNotNull(), "has_t": F.col("tx_id").isNotNull()})
    e = evidences.select(F.col("evidence_id").alias("e_id"), F.lit(True).alias("has_e"), "merchant_name")
    t = bank_tx.select(F.col("tx_id").alias("t_id"), F.lit(True).alias("has_t"), "description")
    return keyed.join(e, ["e_id", "has_e"], "left").join(t, ["t_id", "has_t"], "left").select("settlement_id", "evidence_id", "tx_id", "status", "merchant_name", "description")


def without_partner(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    paired = results.filter("evidence_id is not null and tx_id is not null").select(key)
    return rows.join(paired, key, "left_anti")


def cross_settlement(results: DataFrame, evidences: DataFrame) -> DataFrame:
    """Results that link an evidence of another settlement."""
    e = evidences.select("evidence_id", F.col("settlement_id").alias("evidence_settlement_id"))
    return results.join(e, "evidence_id").filter("settlement_id <> evidence_settlement_id").select("settlement_id", "evidence_id", "evidence_settlement_id")


def status_counts(results: DataFrame) -> DataFrame:
    """Per settlement the number of results in each status, and in all."""
    return results.groupBy("settlement_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count("*").alias("total"))


#: The statuses of a result.
STATUSES = ["matched", "amount_mismatch", "date_mismatch", "missing_bank_transaction", "missing_evidence", "manually_resolved"]


def progress(matched: Column, total: Column) -> Column:
    """Matched results in percent of all, two decimals, halves to even; 0 without results."""
    return F.when(total > 0, F.bround(matched / total * 100, 2)).otherwise(F.lit(0.0))


#: Why an override is refused.
NO_RESULT, OTHER_EVIDENCE, NO_TX, OTHER_TX = "결과를 찾을 수 없습니다.", "이 결산안에 속하지 않은 증빙입니다.", "거래내역을 찾을 수 없습니다.", "이 결산안에 속하지 않은 거래내역입니다."
#: Columns that an override may set, and the flags that say whether it does.
OVERRIDABLE = {"evidence_id": "has_evidence", "tx_id": "has_tx", "status": "has_status", "notes": "has_notes"}


def judged_overrides(results: DataFrame, overrides: DataFrame, evidences: DataFrame, bank_tx: DataFrame) -> DataFrame:
    """``overrides`` with ``reason``: null, or why it is refused. A link has to be to a row of the result's settlement.

    Overrides have override_id, result_id, made_at, the four columns of a result that may be set and a flag for each that
    tells a null that is set from a column that is left alone."""
    links = results.select("result_id", F.col("settlement_id").alias("_own"))
    e = evidences.select("evidence_id", F.col("settlement_id").alias("_of_evidence"))
    t = bank_tx.select("tx_id", F.col("settlement_id").alias("_of_tx"), F.lit(True).alias("_is_tx"))
    rows = overrides.join(links, "result_id", "left").join(e, "evidence_id", "left").join(t, "tx_id", "left")
    evidence, tx = F.col("has_evidence") & F.col("evidence_id").isNotNull(), F.col("has_tx") & F.col("tx_id").isNotNull()
    reason = (
        F.when(F.col("_own").isNull(), NO_RESULT).when(evidence & ~F.col("_of_evidence").eqNullSafe(F.col("_own")), OTHER_EVIDENCE)
        .when(tx & F.col("_is_tx").isNull(), NO_TX).when(tx & ~F.col("_of_tx").eqNullSafe(F.col("_own")), OTHER_TX)
    )
    return rows.select(*overrides.columns, reason.alias("reason"))


def apply_overrides(results: DataFrame, overrides: DataFrame, evidences: DataFrame, bank_tx: DataFrame) -> DataFrame:
    """``results`` (result_id, settlement_id, evidence_id, tx_id, status, notes) after all overrides that aren't refused.

    Each column has what the latest override (by made_at, override_id) that sets it says, a null too; others stay."""
    good = judged_overrides(results, overrides, evidences, bank_tx).filter("reason is null")
    at = F.struct("made_at", "override_id")
    latest = good.groupBy("result_id").agg(*(F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(flag), at)).alias(f"_{c}") for c, flag in OVERRIDABLE.items()))
    new = [F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.col(f"_{c}.v")).alias(c) for c in OVERRIDABLE]
    return results.join(latest, "result_id", "left").select("result_id", "settlement_id", *new)
