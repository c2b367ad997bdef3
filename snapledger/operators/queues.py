"""Schedules, work queues, claims, the outbox and their state machine."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.dates import retry_delay

# Allowed changes of a delivery, as event, state before, state after.
TRANSITIONS = (
    ("activate", "staged", "pending"), ("claim", "pending", "claimed"), ("sent", "claimed", "sent"), ("ambiguous", "claimed", "uncertain"),
    ("failed", "claimed", "pending"), ("release", "claimed", "pending"),
)
OPEN = ("staged", "pending", "claimed")


def due(column: str, now: datetime) -> Column:
    return F.col(column).isNull() | (F.col(column) <= F.lit(now))


def schedule_sources(sources: DataFrame, status: DataFrame, now: datetime, limit: int) -> DataFrame:
    """The next sources: never tried ones first, then the longest untried; those that failed wait for their back-off."""
    rows = sources.join(status, "source_id", "left")
    retry = F.timestamp_seconds(F.unix_timestamp("last_failure_at") + retry_delay(F.col("consecutive_failures"))).cast("timestamp_ntz")
    waits = (F.col("state") == "failure") & F.col("last_failure_at").isNotNull() & (F.lit(now) < retry)
    ready = rows.where(~F.coalesce(waits, F.lit(False)))
    return ready.orderBy(F.asc_nulls_first("last_attempt_at"), "source_id").limit(limit)


def link_queue(jobs: DataFrame, visible: DataFrame, deliveries: DataFrame, now: datetime, limit: int) -> DataFrame:
    """Links to check next: unchecked, then those with a delivery on its way, then live ones, then the rest; newest jobs first."""
    waiting = deliveries.where(F.col("status").isin(*OPEN)).select(F.col("job_id").alias("id")).distinct().withColumn("_waiting", F.lit(True))
    rows = (
        jobs.where(F.col("apply_url") != "").where(due("next_check_at", now))
        .join(visible.select(F.col("job_id").alias("id")), "id", "left_semi")
        .join(waiting, "id", "left")
        .withColumn("rank", F.when(F.col("state") == "unchecked", 0).when(F.col("_waiting"), 1).when(F.col("state") == "live", 2).otherwise(3))
    )
    order = ["rank", F.desc("first_seen_at"), F.asc_nulls_first("next_check_at"), F.asc_nulls_first("checked_at"), "id"]
    return rows.orderBy(*order).limit(limit).drop("_waiting")


def claim(deliveries: DataFrame, now: datetime, owner: str, lease_seconds: int, limit: int) -> DataFrame:
    """The next deliveries by id that are due, or whose claim has run out, as they stand once claimed. One writer only."""
    free = (F.col("status") == "pending") & due("next_attempt_at", now) | (F.col("status") == "claimed") & (F.col("claim_expires_at") <= F.lit(now))
    return (
        deliveries.where(free).orderBy("id").limit(limit)
        .withColumn("status", F.lit("claimed")).withColumn("claim_owner", F.lit(owner))
        .withColumn("attempts", F.col("attempts") + 1)
        .withColumn("claim_expires_at", F.lit(now) + F.make_dt_interval(secs=F.lit(lease_seconds)))
    )


def insert_absent(existing: DataFrame, proposed: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows as they are, and proposed ones whose key is new; what is decided stays decided."""
    added = proposed.join(existing.select(*key), key, "left_anti")
    return existing.withColumn("inserted", F.lit(False)).unionByName(added.withColumn("inserted", F.lit(True)))


def transition(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """Deliveries after events (id, event, owner), one at most for each: only allowed changes by the owner take effect.

    `applied` is null where there was no event.
    """
    rules = deliveries.sparkSession.createDataFrame(list(TRANSITIONS), "event string, status string, new_status string")
    rows = deliveries.join(events.withColumnRenamed("owner", "_owner"), "id", "left").join(F.broadcast(rules), ["event", "status"], "left")
    mine = (F.col("status") != "claimed") | (F.col("claim_owner") == F.col("_owner"))
    applied = F.when(F.col("event").isNotNull(), F.col("new_status").isNotNull() & mine)
    return rows.withColumn("applied", applied).withColumn("status", F.when(F.col("applied"), F.col("new_status")).otherwise(F.col("status"))).drop(
        "new_status", "_owner"
    )


def activate_staged(deliveries: DataFrame, decided: DataFrame) -> DataFrame:
    """Staged deliveries of decided (id) become pending; all or none: `complete` is false if any is not staged."""
    wanted = decided.select("id", F.lit(True).alias("_wanted"))
    rows = deliveries.join(wanted, "id", "left")
    staged = F.col("_wanted") & (F.col("status") == "staged")
    complete = bool(rows.agg((F.count_if(staged) == F.count_if("_wanted")).alias("c")).first()["c"])
    changed = F.when(F.col("_wanted") & F.lit(complete), "pending").otherwise(F.col("status"))
    return rows.withColumn("status", changed).withColumn("complete", F.lit(complete)).drop("_wanted")


def next_wakeup(deliveries: DataFrame) -> DataFrame:
    """The earliest time at which a delivery wants attention: when it is next due, or when its claim runs out."""
    at = F.when(F.col("status") == "claimed", F.col("claim_expires_at")).when(F.col("status") == "pending", F.col("next_attempt_at"))
    return deliveries.agg(F.min(at).alias("next_at"))


def page_rows(rows: DataFrame, order: list, page: int, size: int = 50) -> DataFrame:
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)
