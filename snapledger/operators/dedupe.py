"""First-wins choices in an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def merge_by_priority(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables of the same columns; of equal keys that of the earliest table stays.

    Keys are unique within a table.
    """
    rows = None
    for i, t in enumerate(tables):
        t = t.withColumn("_rank", F.lit(i))
        rows = t if rows is None else rows.unionByName(t)
    return first_wins(rows, [key], ["_rank"]).drop("_rank")


def keep_best(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Of each key the row with the highest score; of equal scores the first."""
    columns = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*columns), F.struct(F.col(score), -F.col(order)))
    return rows.groupBy(key).agg(best.alias("_b")).select(key, *(F.col("_b")[c].alias(c) for c in columns))


def owners_by_rank(wanted: DataFrame, bound: DataFrame) -> DataFrame:
    """For each id of wanted (id, keys: array, strongest first) the job bound to the first key that is bound at all.

    bound: identity_key, job_id.
    """
    ranked = wanted.select("id", F.posexplode("keys").alias("rank", "identity_key"))
    return ranked.join(bound, "identity_key").groupBy("id").agg(F.min_by("job_id", "rank").alias("job_id"), F.min("rank").alias("rank"))


def round_robin(candidates: DataFrame, lane: Column, order: list[Column], limit: int | None = None) -> DataFrame:
    """One of each lane, then the second of each, and so on."""
    ranked = candidates.withColumn("lane", lane).withColumn("lane_rank", F.row_number().over(Window.partitionBy("lane").orderBy(*order)))
    ranked = ranked.orderBy("lane_rank", "lane")
    return ranked.limit(limit) if limit else ranked
