"""Reconciliation of a source's rows with its latest snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(provenance: DataFrame, shown: DataFrame, passes: DataFrame) -> DataFrame:
    """provenance (source_id, job_id, active, ...) after passes (source_id, complete) that showed `shown` (source_id, job_id).

    A complete pass replaces the source's active set, also by nothing; an incomplete one, or none, leaves it alone. No row is
    deleted.
    """
    seen = shown.select("source_id", "job_id").distinct().withColumn("_seen", F.lit(True))
    done = passes.where("complete").select("source_id").distinct().withColumn("_done", F.lit(True))
    rows = provenance.join(seen, ["source_id", "job_id"], "left").join(done, "source_id", "left")
    return rows.withColumn("active", F.when(F.col("_done"), F.coalesce("_seen", F.lit(False))).otherwise(F.col("active"))).drop("_seen", "_done")


def complete_passes(pages: DataFrame) -> DataFrame:
    """source_id, complete of passes whose pages (source_id, complete) have come in: one truncated page spoils the pass."""
    return pages.groupBy("source_id").agg(F.bool_and("complete").alias("complete"))


def ownership_mismatch(snapshot: DataFrame, expected: DataFrame, key) -> DataFrame:
    """Whether any row of a source's snapshot (source_id, pos, company) names another company than expected (source_id, company).

    key: the column function by which companies are compared. The first other name is reported.
    """
    rows = snapshot.join(expected.select("source_id", F.col("company").alias("_expected")), "source_id")
    other = (F.col("company") != "") & (key(F.col("company")) != key(F.col("_expected")))
    return rows.groupBy("source_id").agg(
        F.bool_or(other).alias("mismatch"), F.min_by("company", F.when(other, F.col("pos"))).alias("reported")
    )


def quality(snapshot: DataFrame) -> DataFrame:
    """Counters of a snapshot (source_id, pos, title, apply_url, code): usable, relevant and rejected rows, first three titles."""
    usable = (F.col("title") != "") & (F.col("apply_url") != "")
    # three at a time: the list of a source never grows beyond them
    place = F.when(F.col("title") != "", F.col("pos"))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.asc_nulls_last(place)))
    snapshot = snapshot.withColumn("_nth", F.when(place.isNotNull(), nth))
    titles = F.array_sort(F.collect_list(F.when(F.col("_nth") <= 3, F.struct("_nth", "title"))))
    return snapshot.groupBy("source_id").agg(
        F.count_if(usable).alias("usable"), F.count_if(usable & F.col("code").isNull()).alias("relevant"),
        F.count_if(F.col("code").isNotNull()).alias("rejected"), F.transform(titles, lambda t: t["title"]).alias("titles"),
    )
