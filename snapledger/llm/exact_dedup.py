"""Exact dedup by skew-safe combining: locally, per salted digest group, then across the salts.

Every stage groups by the digest *and* the whole normalised text, so that two texts with one digest never merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import SPACES, full_text, stored, table

SALTS = 16


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(full_text(text), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are. Of equal texts the smallest id stays.

    1. Local: each task combines its own rows of a text (the map side of the first aggregate).
    2. Salted: the rows of a text meet in `salts` groups by a hash of their id, so that a text with a third of all
       rows is merged by several tasks.
    3. Global: at most `salts` winners of a text meet.

    The winners then go back to all rows by digest and salt; that join carries no text, and no text is one task's work
    alone. Only rows of a digest that more than one text shares are joined on the text itself.

    Null texts count as empty; null ids lose against any id, and a group of null ids alone keeps null. Rows that
    repeat an id and text are all returned and flagged alike. Texts of any length are compared whole. An empty table gives an empty result;
    further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_text"))
    keyed = rows.withColumn("_digest", F.unhex(F.sha2(F.col("_text"), 256))).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    salted = keyed.groupBy("_digest", "_text", "_salt").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    winners = salted.groupBy("_digest", "_text").agg(F.min("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    shared = stored(
        winners.groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_variants"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ),
        "exact-dedup",
    )
    ids = stored(keyed.select("_id", "_digest", "_salt"), "exact-dedup-ids")
    places = ids.groupBy("_digest", "_salt").agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    found = ids.join(places.join(shared.where("_variants = 1").drop("_variants"), "_digest"), ["_digest", "_salt"])
    found = found.select("_digest", "_id", "keep_id", "group_size")
    clashing = shared.where("_variants > 1").select("_digest")
    if not clashing.isEmpty():
        by_text = keyed.join(clashing, "_digest", "left_semi").join(winners, ["_digest", "_text"])
        found = found.unionByName(by_text.select("_digest", "_id", "keep_id", "group_size"))
    return found.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)"""
}
