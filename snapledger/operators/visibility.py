"""Which provenance makes a job visible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_observations(
    observations: DataFrame, discovered: DataFrame, controls: DataFrame, require_active: bool = True
) -> DataFrame:
    """Observations of sources that are no market search, if discovered then promoted, and not quarantined.

    discovered (id, state) and controls (source_id, state) have a row per source; Spark broadcasts them if they are small.
    """
    seen = observations.where(~F.col("source_id").startswith("market-"))
    if require_active:
        seen = seen.where("active")
    hidden = discovered.where("state <> 'promoted'").select(F.col("id").alias("source_id"))
    hidden = hidden.unionByName(controls.where("state = 'quarantined'").select("source_id"))
    return seen.join(hidden, "source_id", "left_anti")


def visible_jobs(jobs: DataFrame, visible: DataFrame) -> DataFrame:
    return jobs.join(visible, jobs["id"] == visible["job_id"], "left_semi")


def without_quarantined(sources: DataFrame, controls: DataFrame) -> DataFrame:
    return sources.join(controls.where("state = 'quarantined'").select("source_id"), "source_id", "left_anti")


def multi_source_jobs(visible: DataFrame) -> DataFrame:
    """Jobs that more than one source shows."""
    return visible.groupBy("job_id").agg(F.countDistinct("source_id").alias("sources")).where("sources > 1")
