"""Coverage audit of candidates, and the extraction quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_kind(tag: Column) -> Column:
    return F.when(tag.startswith("priority-"), "priority").when(tag.startswith("curated-") | tag.startswith("benchmark-"), "provenance").otherwise("category")


def tag_counts(candidates: DataFrame) -> DataFrame:
    """Candidates per tag."""
    tags = candidates.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    return tags.groupBy(tag_kind(F.col("tag")).alias("kind"), "tag").agg(F.countDistinct("id").alias("n"))


def below_minimum(counts: DataFrame, minimums: dict[str, int]) -> DataFrame:
    """The tags that fall short, with what was asked and found."""
    wanted = counts.sparkSession.createDataFrame(list(minimums.items()), "tag string, minimum int")
    rows = wanted.join(counts.select("tag", "n"), "tag", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return rows.where("n < minimum").select("tag", "minimum", "n")


def priority_errors(candidates: DataFrame) -> DataFrame:
    """Candidates that do not have exactly one priority, or lack provenance, as sorted messages."""
    count = lambda prefix: F.size(F.filter("tags", lambda t: t.startswith(prefix)))
    rows = candidates.select("id", count("priority-").alias("p"), (count("curated-") + count("benchmark-")).alias("s"))
    texts = F.array_compact(F.array(F.when(F.col("p") != 1, F.concat("id", F.lit(": needs one priority"))), F.when(F.col("s") == 0, F.concat("id", F.lit(": needs provenance")))))
    return rows.select(F.explode(texts).alias("error")).orderBy("error")


def gate(cases: DataFrame, good: str, kept: str) -> DataFrame:
    """Precision, recall and junk rejection over labelled cases."""
    g, k = F.col(good), F.col(kept)
    return cases.agg(
        (F.count_if(g & k) / F.nullif(F.count_if(k), F.lit(0))).alias("precision"),
        (F.count_if(g & k) / F.nullif(F.count_if(g), F.lit(0))).alias("recall"),
        (F.count_if(~g & ~k) / F.nullif(F.count_if(~g), F.lit(0))).alias("junk_rejection"),
    )
