"""What a source's pass, an operator's control and a rejected signal change in the state tables, each as one commit.

Tables: provenance (source_id, job_id, active, ...), source_status (source_id, state, observed_count, last_attempt_at, last_success_at,
last_failure_at, consecutive_failures), deliveries (id, channel, recipient, status, next_attempt_at, ...), bootstrap (key, mode, updated_at),
controls (source_id, control, reason, changed_at); log: events (kind, source_id, detail, at).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.operators.triage import READY, REBASELINE
from snapledger.state.store import Change, StateStore

STATUS = "source_id string, state string, observed_count bigint, last_attempt_at timestamp, last_success_at timestamp, last_failure_at timestamp, consecutive_failures bigint"
BOOTSTRAP = "key string, mode string, updated_at timestamp"
CONTROLS = "source_id string, control string, reason string, changed_at timestamp"
EVENTS = "kind string, source_id string, detail string, at timestamp"
# Controls, and how many distinct sources and failing sources in a row matter.
CONTROL_STATES = ("active", "quarantined")


@dataclass
class Pass:
    """A finished pass of a source: what it showed (job_id), the messages to send (id), and how many rows it had."""

    source_id: str
    shown: DataFrame
    messages: DataFrame
    channel: str
    recipient: str
    observed_count: int
    attempted_at: datetime
    bootstraps: bool = False


def _or_empty(store: StateStore, name: str, version: int, schema: str) -> DataFrame:
    found = store.read(name, version, schema)
    return store.spark.createDataFrame([], schema) if found is None else found


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def reconciled(provenance: DataFrame, source_id: str, shown: DataFrame) -> DataFrame:
    """provenance whose rows of the source are active exactly where shown (job_id) has their job. Other sources' rows stay."""
    seen = shown.select("job_id").distinct().withColumn("_seen", F.lit(True))
    mine = F.col("source_id") == source_id
    active = F.when(mine, F.coalesce("_seen", F.lit(False))).otherwise(F.col("active"))
    return provenance.join(seen, "job_id", "left").withColumn("active", active).select(*provenance.columns)


def succeeded(status: DataFrame, source_id: str, observed_count: int, at: datetime) -> DataFrame:
    """status after a success at a time; one older than the source's latest attempt changes nothing."""
    new = status.sparkSession.createDataFrame([(source_id, "success", observed_count, at, at, None, 0)], STATUS)
    before = status.where(F.col("source_id") == source_id).select("source_id", F.col("last_attempt_at").alias("_last"), F.col("last_failure_at").alias("_failed"))
    fresh = new.join(before, "source_id", "left").where("_last IS NULL OR _last <= last_attempt_at").withColumn("last_failure_at", F.col("_failed"))
    return replaced(status, fresh.drop("_last", "_failed").select(*status.columns), "source_id")


def activated(deliveries: DataFrame, chosen: DataFrame, channel: str, recipient: str, at: datetime) -> tuple[DataFrame, int]:
    """deliveries with the chosen (id) staged ones of the target pending, and their number. ValueError unless all of chosen are such."""
    wanted = chosen.select("id").distinct()
    target = (F.col("channel") == channel) & (F.col("recipient") == recipient) & (F.col("status") == "staged")
    asked = wanted.count()
    found = deliveries.where(target).join(wanted, "id", "left_semi").count() if asked else 0
    if found != asked:
        raise ValueError(f"activated {found} of {asked} staged messages")
    if not asked:
        return deliveries, 0
    rows = deliveries.join(wanted.withColumn("_chosen", F.lit(True)), "id", "left")
    now = F.lit(at).cast(deliveries.schema["next_attempt_at"].dataType)
    changed = rows.withColumn("status", F.when(F.col("_chosen"), "pending").otherwise(F.col("status"))).withColumn("next_attempt_at", F.when(F.col("_chosen"), now).otherwise(F.col("next_attempt_at")))
    return changed.select(*deliveries.columns), asked


def finalize(store: StateStore, done: Pass) -> int:
    """The visibility boundary of a pass: snapshot, status, messages and bootstrap change together or not at all. The number of messages activated.

    A conflicting commit makes it start again from the other writer's version. If any of the messages is not staged for the target, every
    table stays as it was.
    """
    if not (done.source_id.strip() and done.channel.strip() and done.recipient.strip()) or done.observed_count < 0:
        raise ValueError("a pass needs a source, a target and a count that is not negative")
    number = 0

    def work(version: int) -> Change:
        nonlocal number
        deliveries = store.read("deliveries", version)
        tables = {"source_status": succeeded(_or_empty(store, "source_status", version, STATUS), done.source_id, done.observed_count, done.attempted_at)}
        if deliveries is not None:
            changed, number = activated(deliveries, done.messages, done.channel, done.recipient, done.attempted_at)
            if number:
                tables["deliveries"] = changed
        elif not done.messages.isEmpty():
            raise ValueError("there are no staged messages")
        if (provenance := store.read("provenance", version)) is not None:
            tables["provenance"] = reconciled(provenance, done.source_id, done.shown)
        if done.bootstraps:
            tables["bootstrap"] = _with_mode(store, version, done.source_id, READY, done.attempted_at)
        return Change(tables)

    store.transact(work)
    return number


def _with_mode(store: StateStore, version: int, source_id: str, mode: str, at: datetime) -> DataFrame:
    old = _or_empty(store, "bootstrap", version, BOOTSTRAP)
    return replaced(old, store.spark.createDataFrame([(source_id, mode, at)], BOOTSTRAP), "key")


def bootstrap_mode(store: StateStore, source_id: str, version: int | None = None) -> str:
    """ready, rebaseline, or empty where the source has no baseline: only what a ready source shows is staged."""
    found = store.read("bootstrap", version, BOOTSTRAP)
    row = found.where(F.col("key") == source_id).select("mode").first() if found is not None else None
    return row["mode"] if row else ""


def fail(store: StateStore, source_id: str, at: datetime, error: str) -> int:
    """A failed pass: the streak grows, a ready baseline has to be made anew, and the event is logged; one commit.

    An attempt older than the latest is only logged.
    """

    def work(version: int) -> Change:
        status = _or_empty(store, "source_status", version, STATUS)
        before = status.where(F.col("source_id") == source_id).first()
        event = store.spark.createDataFrame([("pass_failed", source_id, error, at)], EVENTS)
        if before is not None and before["last_attempt_at"] is not None and before["last_attempt_at"] > at:
            return Change(appends={"events": event})
        streak = (before["consecutive_failures"] if before else 0) + 1
        row = (source_id, "failure", before["observed_count"] if before else 0, at, before["last_success_at"] if before else None, at, streak)
        tables = {"source_status": replaced(status, store.spark.createDataFrame([row], STATUS), "source_id")}
        if bootstrap_mode(store, source_id, version) == READY:
            tables["bootstrap"] = _with_mode(store, version, source_id, REBASELINE, at)
        return Change(tables, {"events": event})

    return store.transact(work)


def set_control(store: StateStore, source_id: str, control: str, reason: str, at: datetime) -> int:
    """A control and its audit event, as one commit; the event costs its own size, whatever the log's."""
    if control not in CONTROL_STATES:
        raise ValueError(f"unknown control {control}")

    def work(version: int) -> Change:
        old = _or_empty(store, "controls", version, CONTROLS)
        row = store.spark.createDataFrame([(source_id, control, reason, at)], CONTROLS)
        event = store.spark.createDataFrame([(f"control_{control}", source_id, reason, at)], EVENTS)
        return Change({"controls": replaced(old, row, "source_id")}, {"events": event})

    return store.transact(work)


def log_rejected_signals(store: StateStore, signals: DataFrame) -> int:
    """Add rejected market signals (source_id, reason, at) to the log of events."""
    return store.transact(lambda _: Change(appends={"events": signals.select(F.lit("signal_rejected").alias("kind"), "source_id", F.col("reason").alias("detail"), "at")}))


def control_history(events: DataFrame) -> DataFrame:
    """source_id, control, changes, changed_at: the last control of each source by its events, and how many there were."""
    rows = events.where(F.col("kind").startswith("control_"))
    return rows.groupBy("source_id").agg(
        F.max_by(F.substring("kind", 9, 20), F.struct("at", "kind")).alias("control"), F.count(F.lit(1)).alias("changes"), F.max("at").alias("changed_at")
    )
