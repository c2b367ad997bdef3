"""Ordered folds as window expressions: authority-guarded merges, failure streaks, link health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Terminal results in a row after which a link counts as gone.
GONE_AFTER = 2


def _before(*keys: str, order: list[str]):
    w = Window.partitionBy(*keys).orderBy(*order)
    return w, w.rowsBetween(Window.unboundedPreceding, -1)


def authority_fold(observations: DataFrame, key: str, order: list[str], always: list[str], when_given: list[str]) -> DataFrame:
    """The state of each key after its observations in order.

    A row counts if its authority is as strong as (at most) the strongest before it. Of the rows that count the last gives
    the columns in `always`, and each column in `when_given` comes from the last that has a value in it.
    """
    w, before = _before(key, order=order)
    best = F.min("authority").over(before)
    rows = observations.withColumn("_counts", best.isNull() | (F.col("authority") <= best)).withColumn("_nth", F.row_number().over(w))
    at = F.when(F.col("_counts"), F.col("_nth"))
    given = lambda c: F.max_by(c, F.when(F.col("_counts") & (F.col(c) != ""), F.col("_nth")))
    return rows.groupBy(key).agg(
        *(F.max_by(c, at).alias(c) for c in always),
        *(F.coalesce(given(c), F.lit("")).alias(c) for c in when_given),
        F.min("authority").alias("authority"),
        F.count_if("_counts").alias("accepted"),
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"),
    )


def failure_streaks(attempts: DataFrame) -> DataFrame:
    """Health of each source after attempts (source_id, arrival, at, ok), in order of arrival.

    An attempt older than one that has arrived is ignored; one of the same time counts.
    """
    w, before = _before("source_id", order=["arrival"])
    latest = F.max("at").over(before)
    kept = attempts.withColumn("_latest", latest).where("_latest IS NULL OR _latest <= at").drop("_latest")
    island = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        kept.withColumn("_island", island)
        .withColumn("_last", F.max("_island").over(Window.partitionBy("source_id")))
        .groupBy("source_id")
        .agg(
            F.max("at").alias("last_attempt_at"),
            F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"),
            F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_failure_at"),
            F.count_if((F.col("_island") == F.col("_last")) & ~F.col("ok")).alias("consecutive_failures"),
            F.max_by(F.when(F.col("ok"), "success").otherwise("failure"), "arrival").alias("state"),
        )
    )


def link_health(checks: DataFrame) -> DataFrame:
    """State of each job's link after checks (job_id, seq, outcome, url_changed): two gone results with no live one between.

    An unknown result neither counts nor resets. A changed address starts again as unchecked.
    """
    w, _ = _before("job_id", order=["seq"])
    resets = F.sum(((F.col("outcome") == "live") | F.col("url_changed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = Window.partitionBy("job_id")
    return (
        checks.withColumn("_island", resets)
        .withColumn("_last", F.max("_island").over(last))
        .where("_island = _last")
        .groupBy("job_id")
        .agg(
            F.count_if(F.col("outcome") == "gone").alias("consecutive_gone"),
            F.bool_or(F.col("outcome") == "live").alias("_live"),
        )
        .select(
            "job_id", "consecutive_gone",
            F.when(F.col("consecutive_gone") >= GONE_AFTER, "gone").when(F.col("_live"), "live").otherwise("unchecked").alias("state"),
        )
    )


def provenance(observations: DataFrame) -> DataFrame:
    """One row per job, source and native id: first and last sighting; active once any sighting was not pending."""
    return observations.groupBy("job_id", "source_id", "source_native_id").agg(
        F.min("observed_at").alias("first_observed_at"),
        F.max("observed_at").alias("last_observed_at"),
        F.bool_or(~F.col("snapshot_pending")).alias("active"),
    )
