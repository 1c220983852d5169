"""Structured Streaming forms of the lifecycle jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import ALREADY_PUBLIC, REASONS, RULES, UNKNOWN
from ..operators.scope import notification_fanout

#: Stores with timers are kept by RocksDB.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that timers need; the given one's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return own


def events_stream(spark: SparkSession, path: str, schema: object, files_at_once: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, oldest first, as many files to a micro-batch as are given."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def started(rows: DataFrame, write: object, checkpoint: str) -> object:
    """Hand each micro-batch of all that is there now to ``write``; returns the started query."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


# Views


def view_count_stream(views: DataFrame, public: DataFrame, visible: DataFrame, out: str, checkpoint: str, lateness_s: int = 3600) -> object:
    """Count views (event_id, settlement_id, user_id, ts) as they come; returns the started query.

    Each micro-batch writes folders of its own under ``out``, and overwrites them when it is repeated after a restart, so
    nothing is counted twice: ``events`` has the events taken for the first time and whether their user may see the
    settlement, ``late`` those more than ``lateness_s`` older than the newest event of earlier batches. An event is taken
    once within the lateness; what is older than that is not looked up, so the look-up stays bounded.
    ``view_counts_of`` reads the counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _earlier(spark, f"{out}/events", batch_id)
        bound = before.agg((F.max("ts") - F.make_dt_interval(secs=F.lit(lateness_s))).alias("bound"))
        dated = batch.select("event_id", "settlement_id", "user_id", "ts").join(F.broadcast(bound))  # one row
        dated.filter("ts < bound").drop("bound").write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        fresh = dated.filter("bound is null or ts >= bound").drop("bound").dropDuplicates(["event_id"])
        recent = before.join(F.broadcast(bound)).filter("ts >= bound").select("event_id")
        fresh = fresh.join(recent, "event_id", "left_anti").join(public, "settlement_id", "left")
        allowed = visible.select("user_id", "college_name").withColumn("counts", F.lit(True))
        judged = fresh.join(allowed, ["user_id", "college_name"], "left").select("event_id", "settlement_id", "ts", F.coalesce("counts", F.lit(False)).alias("counts"))
        judged.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")

    return started(views, write, checkpoint)


_TAKEN = "event_id long, settlement_id long, ts timestamp, counts boolean, batch long"


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What batches before this one have taken."""
    if batch_id == 0:
        return spark.createDataFrame([], _TAKEN)
    return spark.read.schema(_TAKEN).parquet(path).filter(F.col("batch") < batch_id)


def view_counts_of(spark: SparkSession, out: str) -> DataFrame:
    """(settlement_id, view_count) of all batches so far."""
    return spark.read.schema(_TAKEN).parquet(f"{out}/events").filter("counts").groupBy("settlement_id").agg(F.count("*").alias("view_count"))


# Notifications


def fanout_stream(actions: DataFrame, settlements: DataFrame, memberships: DataFrame, out: str, checkpoint: str, made: Callable[..., DataFrame] = notification_fanout) -> object:
    """Append the notifications of each micro-batch of lifecycle events, or what ``made`` makes of it (as
    ``notification_digest``, a row an event), to a table of files; returns the started query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        made(batch, settlements, memberships).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return started(actions, write, checkpoint)


# Lifecycle

STATE = "status string, submitted_at timestamp, audited_at timestamp, published_at timestamp"
FIRST = {"status": "draft", "submitted_at": None, "audited_at": None, "published_at": None}


def replay_state(state: dict, action: str, ts: object) -> tuple[dict, bool]:
    """The state after an action, and whether its status allowed it."""
    froms, to = RULES.get(action, ([], None))
    if state["status"] not in froms or (action == "publish" and state["published_at"] is not None):
        return state, False
    new = state | {"status": to}
    if action in ("submit", "resubmit"):
        new |= {"submitted_at": ts, "audited_at": None}
    elif action in ("approve", "reject"):
        new |= {"audited_at": ts}
    else:
        new |= {"published_at": ts}
    return new, True


def _why(state: dict, action: str) -> str:
    if action not in RULES:
        return UNKNOWN
    return ALREADY_PUBLIC if state["status"] in RULES[action][0] else REASONS[action].format(state["status"])


class Lifecycle(StatefulProcessor):
    """A settlement's status and dates, moved on by each action."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        state = dict(zip(FIRST, self.held.get(), strict=True)) if self.held.exists() else FIRST
        for x in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            before, why = state["status"], None
            new, ok = replay_state(state, x.action, x.ts)
            if not ok:
                why = _why(state, x.action)
            state = new
            yield Row(settlement_id=key[0], event_id=x.event_id, ts=x.ts, action=x.action, before=before, after=state["status"], accepted=ok, reason=why)
        self.held.update(tuple(state.values()))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        yield from ()

    def close(self) -> None:
        pass


def lifecycle_stream(actions: DataFrame) -> DataFrame:
    """Each action as it comes (settlement_id, event_id, ts, action, before, after, accepted, reason), with each settlement's
    state kept by Spark. Actions of a settlement have to come in their order, but within a micro-batch they are sorted.
    ``actions`` is a stream of a ``stateful_session``."""
    schema = "settlement_id long, event_id long, ts timestamp, action string, before string, after string, accepted boolean, reason string"
    return actions.groupBy("settlement_id").transformWithState(Lifecycle(), schema, "append", "none")


# Invitations


#: What ends an invitation but time.
DECIDED = ("accepted", "revoked", "declined")


class Expiry(StatefulProcessor):
    """An invitation waits until it is decided, or its time is up; a timer tells the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("expires_at_ms", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        # Each call on the state or a timer goes to the JVM and back, so the state is read once and what is left of the changes is written.
        before = held = self.waiting.get()
        for x in sorted(rows, key=lambda r: (r.ts, r.event != "created")):
            at = int(x.ts.timestamp() * 1000)
            if x.event == "created":
                held = (None if x.expires_at is None else int(x.expires_at.timestamp() * 1000) + 1,)  # over once its time has passed
                yield Row(invitation_id=key[0], status="pending", at=x.ts)
            elif x.event in DECIDED and held is not None:
                if held[0] is not None and at >= held[0]:
                    continue  # too late: the timer is about to end it
                held = None
                yield Row(invitation_id=key[0], status=x.event, at=x.ts)
        self._change(before, held)

    def _change(self, before: tuple | None, after: tuple | None) -> None:
        """An invitation that waits has its timer, if its time is ever up, and no other."""
        if before is not None:
            before = tuple(before)
        if before == after:
            return
        old, new = (x[0] if x else None for x in (before, after))
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if after is None:
            self.waiting.clear()
            return
        self.waiting.update(after)
        if new is not None and new != old:
            self.handle.registerTimer(new)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        from datetime import datetime, timezone

        self.waiting.clear()
        at = datetime.fromtimestamp((expiredTimerInfo.getExpiryTimeInMs() - 1) / 1000, timezone.utc)
        yield Row(invitation_id=key[0], status="expired", at=at)

    def close(self) -> None:
        pass


def invitation_stream(events: DataFrame) -> DataFrame:
    """(invitation_id, status, at): what becomes of each invitation, as events (invitation_id, event, expires_at, ts) come.

    Events are created and those DECIDED; any other (a clock's tick) only moves the time on. An invitation that
    isn't decided expires when the watermark, the latest ts, passes expires_at; its state goes then.
    ``events`` is a stream of a ``stateful_session``."""
    timed = events.withWatermark("ts", "0 seconds")
    return timed.groupBy("invitation_id").transformWithState(Expiry(), "invitation_id long, status string, at timestamp", "append", "eventTime")
