"""Merging of jobs that have turned out to be one, with all that hangs on them.

pairs (canonical_id, duplicate_id, seq) says which job goes into which, in the order of seq. A job that has taken others in may go into a
third later on; the result is that of the merges one after the other. What does not depend on the way (identities, provenance) is
relabelled at once, by survivors that pointer jumping finds in as many rounds as the longest chain has binary digits. Fields
and messages depend on it: they are folded from the leaves of the chains up, every level by windows and aggregates, and only
jobs that take part in merges are touched by a level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.scratch import stored

#: Fields that keep their value unless a stronger row has one, and such as a stronger row always sets.
GIVEN, ALWAYS = ("location", "country", "employment_type", "level", "apply_url", "description"), ("company", "title", "source_id")
LINK = ("link_state", "link_gone")
#: Lists that a merge joins.
LISTS = ("native_sources",)
# Which status stays where two rows of one message meet.
PRECEDENCE = {"sent": 0, "suppressed": 1, "pending": 2, "claimed": 2, "staged": 3, "failed": 4}


def checked(pairs: DataFrame) -> DataFrame:
    """pairs without those of a job with itself, stored. Raises ValueError if a job is merged away twice, or takes one in once it is gone."""
    pairs = stored(pairs.select("canonical_id", "duplicate_id", "seq").where("canonical_id <> duplicate_id"), "merge-pairs")
    gone = pairs.groupBy("duplicate_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("gone_at"))
    late = pairs.join(gone.select(F.col("duplicate_id").alias("canonical_id"), "gone_at"), "canonical_id").where("gone_at <= seq")
    if not gone.where("n > 1").select("n").union(late.select("seq")).isEmpty():
        raise ValueError("a job is merged after it is gone")
    return pairs


def survivors(pairs: DataFrame) -> DataFrame:
    """job_id, survivor of every job that is merged away. Each round doubles the number of merges that a pointer jumps over."""
    jumps = checked(pairs).select(F.col("duplicate_id").alias("job_id"), F.col("canonical_id").alias("survivor"))
    while True:
        ahead = jumps.select(F.col("job_id").alias("survivor"), F.col("survivor").alias("_further"))
        farther = jumps.join(ahead, "survivor", "left")
        if farther.where("_further IS NOT NULL").isEmpty():
            return jumps
        jumps = stored(farther.select("job_id", F.coalesce("_further", "survivor").alias("survivor")), "merge-jumps")


def levels(pairs: DataFrame) -> list[DataFrame]:
    """pairs by the height of the job that takes in: in a level, no job that is merged away has merges of its own left."""
    return _levels(checked(pairs))


def _levels(rest: DataFrame) -> list[DataFrame]:
    out = []
    while not rest.isEmpty():
        waiting = rest.join(rest.select(F.col("canonical_id").alias("duplicate_id")).distinct(), "duplicate_id", "left_semi").select("canonical_id").distinct()
        out.append(stored(rest.join(waiting, "canonical_id", "left_anti"), "merge-level"))
        rest = stored(rest.join(waiting, "canonical_id", "left_semi"), "merge-rest")
    return out


def _by_levels(rows: DataFrame, pairs: DataFrame, key: str, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """rows after fold(rows, pairs of a level) for each level; rows of jobs that take no part go past the levels."""
    pairs = checked(pairs)  # stored: it is read for the levels and twice for the jobs that take part
    steps = _levels(pairs)
    if len(steps) < 2:
        return fold(rows, steps[0] if steps else pairs.limit(0))
    part = pairs.select(F.col("canonical_id").alias(key)).union(pairs.select("duplicate_id")).distinct()
    taking = rows.join(part, key, "left_semi")
    for step in steps:
        taking = stored(fold(taking, step), "merge-fold")
    return fold(rows.join(part, key, "left_anti"), steps[0].limit(0)).unionByName(taking)


def _relabelled(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """rows with the job that stays as key, _seq (0 for its own rows, above for others) and no others changed."""
    nth = F.row_number().over(Window.partitionBy("canonical_id").orderBy("seq"))
    moved = pairs.select(F.col("duplicate_id").alias(key), F.col("canonical_id").alias("_to"), nth.alias("_seq"))
    found = rows.join(moved, key, "left")
    return found.withColumn(key, F.coalesce("_to", key)).withColumn("_seq", F.coalesce("_seq", F.lit(0))).drop("_to")


def merge_jobs(jobs: DataFrame, pairs: DataFrame, policy: str) -> DataFrame:
    """jobs after all merges; see _merge_jobs for the columns and what one merge does."""
    return _by_levels(jobs, pairs, "id", lambda rows, step: _merge_jobs(rows, step, policy))


def _merge_jobs(jobs: DataFrame, pairs: DataFrame, policy: str) -> DataFrame:
    """jobs (id, authority, posted_at, policy_version, first_seen_at, last_seen_at, and those of GIVEN, ALWAYS and LINK it has).

    A duplicate of stronger (smaller) authority sets the fields and the older values fill its gaps; any other only fills gaps.
    So of all rows in order those that were the strongest yet come first, latest first, then the others, earliest first. The link's
    health goes with the address it belongs to.
    """
    rows = _relabelled(jobs, pairs, "id")
    w = Window.partitionBy("id").orderBy("_seq")
    before = F.min("authority").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_leads", before.isNull() | (F.col("authority") < before))
    rows = rows.withColumn("_rank", F.when(F.col("_leads"), -F.col("_seq")).otherwise(F.col("_seq")))
    have = set(jobs.columns)
    link_at = F.when((F.col("_seq") == 0) | (F.col("_leads") & (F.col("apply_url") != "")), F.col("_seq"))
    merged = [F.min_by(c, "_rank").alias(c) for c in ALWAYS if c in have]
    merged += [F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("_rank"))), F.lit("")).alias(c) for c in GIVEN if c in have]
    merged += [F.max_by(c, link_at).alias(c) for c in LINK if c in have]
    merged += [F.flatten(F.collect_list(c)).alias(c) for c in LISTS if c in have]
    return rows.groupBy("id").agg(
        *merged,
        F.min_by("posted_at", F.when(F.col("posted_at").isNotNull(), F.col("_rank"))).alias("posted_at"),
        F.min("authority").alias("authority"),
        F.when(F.bool_or(F.col("policy_version") == policy), F.lit(policy)).otherwise(F.max_by("policy_version", "_seq")).alias("policy_version"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def merge_deliveries(deliveries: DataFrame, pairs: DataFrame) -> DataFrame:
    """deliveries (job_id, channel, recipient, status, attempts, claim_owner, next_attempt_at, last_error, created_at, sent_at) after all merges.

    Messages of one channel and recipient become one: the status of the highest precedence (a claim is given back), the most
    attempts, the earliest times, the first error. Others move to their job unchanged. A payload (JSON text, if there is such a column)
    is that of the job that takes in, or else of the first that comes; its ID is set to its job unless the message was sent.
    """
    return _by_levels(deliveries, pairs, "job_id", _merge_deliveries)


def _merge_deliveries(deliveries: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = _relabelled(deliveries, pairs, "job_id")
    rank = F.coalesce(*(F.when(F.col("status") == s, r) for s, r in PRECEDENCE.items()), F.lit(max(PRECEDENCE.values())))
    alone = F.count(F.lit(1)) == 1
    names = F.element_at(F.array(*map(F.lit, ("sent", "suppressed", "pending", "staged", "failed"))), F.min(rank) + 1)
    payload = []
    if "payload" in deliveries.columns:
        moved = (F.col("_seq") > 0) & (F.col("status") != "sent")
        payload = [F.min_by(F.when(moved, with_id(F.col("payload"), F.col("job_id"))).otherwise(F.col("payload")), "_seq").alias("payload")]
    return rows.groupBy("job_id", "channel", "recipient").agg(
        F.when(alone, F.min("status")).otherwise(names).alias("status"),
        F.max("attempts").alias("attempts"),
        F.when(alone, F.min("claim_owner")).otherwise("").alias("claim_owner"),
        F.min("next_attempt_at").alias("next_attempt_at"),
        F.coalesce(F.min_by("last_error", F.when(F.col("last_error") != "", F.col("_seq"))), F.lit("")).alias("last_error"),
        F.min("created_at").alias("created_at"),
        F.min_by("sent_at", F.when(F.col("sent_at").isNotNull(), F.col("_seq"))).alias("sent_at"),
        *payload,
    )


def with_id(payload: Column, job: Column) -> Column:
    """A JSON object with its field ID set; other fields keep their text, and one without an ID gets one in front."""
    own = F.concat(F.lit('"ID":'), F.to_json(F.array(job)).substr(F.lit(2), F.length(F.to_json(F.array(job))) - 2))
    rest = F.regexp_replace(payload, '"ID"\\s*:\\s*"(?:[^"\\\\]|\\\\.)*"\\s*,?\\s*', "")
    inner = F.trim(F.regexp_replace(rest, "^\\s*\\{\\s*|,?\\s*\\}\\s*$", ""))
    return F.concat(F.lit("{"), F.concat_ws(",", own, F.when(inner != "", inner)), F.lit("}"))


def _of_survivors(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    found = rows.join(survivors(pairs), "job_id", "left")
    return found.withColumn("job_id", F.coalesce("survivor", "job_id")).drop("survivor").select(*rows.columns)


def merge_provenance(provenance: DataFrame, pairs: DataFrame) -> DataFrame:
    """provenance (job_id, source_id, source_native_id, first_observed_at, last_observed_at, active) under the jobs that stay."""
    return _of_survivors(provenance, pairs).groupBy("job_id", "source_id", "source_native_id").agg(
        F.min("first_observed_at").alias("first_observed_at"), F.max("last_observed_at").alias("last_observed_at"), F.bool_or("active").alias("active"),
    )


def merge_identities(identities: DataFrame, pairs: DataFrame) -> DataFrame:
    """identities (key, job_id) under the jobs that stay."""
    return _of_survivors(identities, pairs)
