"""Operational status: roster, roll-ups, counts of due work, explanation of one source."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORKABLE = ("pending", "retry", "validating", "promoted")
RECENT = 20


def roster(configured: DataFrame, health: DataFrame, controls: DataFrame) -> DataFrame:
    """Every configured or observed source with its state; a control outweighs health, no attempt means pending."""
    rows = configured.withColumn("_configured", F.lit(True)).join(health, "source_id", "full").where(~F.col("source_id").startswith("market-"))
    rows = rows.join(controls, "source_id", "left")
    state = F.when(F.col("control").isNotNull(), F.col("control")).when(F.col("state").isNull(), "pending").when(F.col("state") == "success", "healthy").otherwise("failed")
    return rows.select(
        "source_id", F.coalesce("company", F.lit("")).alias("company"), F.coalesce("_configured", F.lit(False)).alias("configured"), state.alias("state"),
        F.coalesce("consecutive_failures", F.lit(0)).cast("bigint").alias("consecutive_failures"), "last_attempt_at",
    )


def rollup(rows: DataFrame) -> DataFrame:
    counts = rows.agg(
        *(F.count_if(F.col("state") == s).alias(s) for s in ("healthy", "failed", "quarantined", "pending")), F.count_if("configured").alias("configured")
    )
    return counts.withColumn("state", F.when(F.col("failed") > 0, "degraded").when(F.col("healthy") > 0, "healthy").otherwise("pending"))


def due_counts(deliveries: DataFrame, candidates: DataFrame, now: datetime) -> DataFrame:
    """Due work of three kinds, in one row: conditional counts over the union of both tables, so nothing is joined."""
    at = F.lit(now)
    rows = deliveries.select(
        ((F.col("status") == "pending") & (F.col("next_attempt_at") <= at)).alias("a"), ((F.col("status") == "claimed") & (F.col("claim_expires_at") <= at)).alias("b"), F.lit(False).alias("c")
    ).unionByName(
        candidates.select(F.lit(False).alias("a"), F.lit(False).alias("b"), (F.col("state").isin(*WORKABLE) & (F.col("next_attempt_at") <= at)).alias("c"))
    )
    return rows.agg(F.count_if("a").alias("deliveries_due"), F.count_if("b").alias("claims_expired"), F.count_if("c").alias("candidates_due"))


def explain(attempts: DataFrame, health: DataFrame, controls: DataFrame, source: str) -> DataFrame:
    """Control, health and the latest attempts of one source. The key's filter reaches each scan."""
    mine = F.col("source_id") == source
    recent = attempts.where(mine).orderBy(F.desc("at"), F.desc("arrival")).limit(RECENT).groupBy("source_id").agg(
        F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("at", "arrival")))), lambda r: r["arrival"]), ",").alias("recent")
    )
    return (
        health.where(mine).join(controls.where(mine), "source_id", "left").join(recent, "source_id", "left")
        .select("source_id", F.coalesce("control", F.lit("active")).alias("control"), "state", "consecutive_failures", "last_attempt_at", "recent")
    )


def state_map(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value as one map."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("counts"))
