"""Lifecycle of discovery candidates and the sources found for them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.classify import high_signal
from snapledger.functions.text import company_key, once
from snapledger.operators.dedupe import first_wins

# Preference of states where one route was found twice (others come last), providers whose boards are named by a
# path that does not tell cases apart, and failure codes that a better rating can undo.
STATE_RANK = {"promoted": 0, "candidate": 1}
SLUG_PROVIDERS = ("ashby", "gem", "greenhouse", "lever", "smartrecruiters", "workable", "yc_jobs")
QUALITY_CODES = ("company_quality",)
DEMOTE_AFTER = 3
# What tells pages about programmes and people from postings.
CONTENT_TITLES = (
    "intern spotlight", "employee spotlight", "student spotlight", "life at ", "meet our interns", "intern stories", "university program", "internship program",
    "early career program", "futureforce internships",
)
CONTENT_TEXTS = ("does not list a specific open role", "browse open jobs to find a specific role")


def plain_route(url: Column) -> Column:
    """A board's address without regard to case and closing slashes."""
    return F.lower(F.regexp_replace(F.trim(url), "/+$", ""))


def route(provider: Column, url: Column) -> Column:
    """The key under which two spellings of a board's address are one: scheme and host without regard to case, and the path too
    where the provider names boards by a slug. The provider's own case never counts.
    """
    text = F.regexp_replace(F.trim(url), "/+$", "")
    whole = "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)([^?#]*)(.*)$"
    base, path, rest = (F.regexp_extract(text, whole, k) for k in (1, 2, 3))
    slug = F.lower(F.trim(provider)).isin(*SLUG_PROVIDERS)
    joined = F.concat(F.lower(base), F.when(slug, F.lower(F.regexp_replace(path, "/+$", ""))).otherwise(path), rest)
    return F.concat(F.lower(F.trim(provider)), F.lit("|"), F.when(base != "", joined).otherwise(text))


def refresh_candidates(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """existing (id, name, website, tags, state, failure_code) after a new seed (id, name, website, tags).

    The seed's descriptions win, states stay, new candidates are pending; one that was parked for its quality is pending again if it now
    qualifies. Candidates that the seed lacks stay as they are.
    """
    e, s = existing.alias("e"), seed.alias("s")
    rows = e.join(s, F.col("e.id") == F.col("s.id"), "full")
    given = F.col("s.id").isNotNull()
    pick = lambda c: F.when(given, F.col(f"s.{c}")).otherwise(F.col(f"e.{c}")).alias(c)
    freed = given & (F.col("e.state") == "parked") & F.col("e.failure_code").isin(*QUALITY_CODES) & high_signal(F.col("s.tags"))
    return rows.select(
        F.coalesce("s.id", "e.id").alias("id"), pick("name"), pick("website"), pick("tags"),
        F.when(F.col("e.id").isNull() | freed, "pending").otherwise(F.col("e.state")).alias("state"),
        F.when(F.col("e.id").isNull() | freed, "").otherwise(F.col("e.failure_code")).alias("failure_code"),
    )


def fold_probes(probes: DataFrame) -> DataFrame:
    """State of each route after probes (provider, url, seq, candidate_id, ok, observed) in order.

    The first candidate to reach a route owns it; probes by others count as duplicates. A success promotes if anything was observed, or if
    the route was promoted before; DEMOTE_AFTER failures in a row make it unhealthy until the next success.
    """
    key = ["provider", "route"]
    rows = probes.withColumn("route", plain_route(F.col("url")))
    w = Window.partitionBy(*key).orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("owner", F.first("candidate_id").over(upto)).withColumn("mine", F.col("owner") == F.col("candidate_id"))
    duplicates = rows.groupBy(*key).agg(F.count_if(~F.col("mine")).alias("duplicates"))
    own = rows.where("mine").withColumn("island", F.sum(F.col("ok").cast("int")).over(upto))
    own = own.withColumn("last", F.max("island").over(Window.partitionBy(*key)))
    folded = own.groupBy(*key).agg(
        F.first("owner").alias("candidate_id"), F.bool_or(F.col("ok") & (F.col("observed") > 0)).alias("ever"),
        F.count_if((F.col("island") == F.col("last")) & ~F.col("ok")).alias("consecutive_failures"),
    )
    state = F.when(F.col("consecutive_failures") >= DEMOTE_AFTER, "unhealthy").when(F.col("ever"), "promoted").otherwise("candidate")
    return folded.join(duplicates, key).select(*key, "candidate_id", state.alias("state"), "consecutive_failures", "duplicates")


def suppress_duplicates(discovered: DataFrame) -> DataFrame:
    """discovered (id, provider, url, state, promoted_at, last_checked_at): of the rows of one route that are no duplicates yet the
    best keeps its state, the others become duplicates.
    """
    rank = F.when(F.col("state") == "promoted", STATE_RANK["promoted"]).when(F.col("state") == "candidate", STATE_RANK["candidate"]).otherwise(len(STATE_RANK))
    live = F.col("state") != "duplicate"
    w = Window.partitionBy(route(F.col("provider"), F.col("url")), live).orderBy(rank, F.asc_nulls_last("promoted_at"), "last_checked_at", "id")
    rows = discovered.withColumn("_nth", F.row_number().over(w))
    return rows.withColumn("state", F.when(F.col("_nth") > 1, "duplicate").otherwise(F.col("state"))).drop("_nth")


def suppress_catalogued(discovered: DataFrame, catalog: DataFrame) -> DataFrame:
    """discovered, those whose provider and address the catalog (provider, url) has being duplicates, whatever the case of either."""
    known = catalog.select(F.lower("provider").alias("_provider"), plain_route(F.col("url")).alias("_route")).distinct().withColumn("_known", F.lit(True))
    keyed = discovered.withColumn("_provider", F.lower("provider")).withColumn("_route", plain_route(F.col("url")))
    rows = keyed.join(known, ["_provider", "_route"], "left")
    return rows.withColumn("state", F.when(F.col("_known"), "duplicate").otherwise(F.col("state"))).drop("_known", "_route", "_provider")


def market_targets(observations: DataFrame, targets: DataFrame) -> DataFrame:
    """observations (seq, company) with the first target (pos, id, name) of the same company; an equi-join on the company's key."""
    keyed = first_wins(targets.withColumn("_key", company_key(F.col("name"))).where("_key <> ''"), ["_key"], ["pos"])
    rows = observations.withColumn("_key", company_key(F.col("company")))
    return rows.join(keyed.select("_key", F.col("id").alias("target_id")), "_key").drop("_key")


def content_page(title: Column, url: Column, text: Column) -> Column:
    """Whether a fetched page is about a programme or people, not a posting."""
    holds = lambda c, parts: once(F.lower(F.trim(c)), lambda t: reduce(or_, (t.contains(p) for p in parts)))
    programme = once(F.lower(F.trim(url)), lambda u: u.contains("/university/internships") & ~u.contains("/jobs/"))
    return programme | holds(title, CONTENT_TITLES) | holds(text, CONTENT_TEXTS)


def filter_results(results: DataFrame, blocked: tuple[str, ...], limit: int) -> DataFrame:
    """Search results (query, position, url): usable hosts, one per URL, the first `limit` of each query."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    bad = F.lit(False)
    for b in blocked:
        bad = bad | (host == b) | host.endswith(f".{b}")
    once = first_wins(results.where(host.isNotNull() & ~bad), ["query", "url"], ["position"])
    w = Window.partitionBy("query").orderBy("position", "url")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
