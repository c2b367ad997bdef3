"""Demotion of discovered sources, and what the end of a source's pass changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.board_match import board_matches
from snapledger.functions.classify import high_signal
from snapledger.functions.outcomes import any_of
from snapledger.functions.text import has_phrase, padded_text
from snapledger.operators.admission import BLOCKED_COMPANIES
from snapledger.operators.discovery import DEMOTE_AFTER

# Why a route is given up, with the states of its source and of its candidate.
REASONS = {
    "company lacks high-signal target evidence": ("rejected", "parked", "company_quality"),
    "company excluded by target policy": ("unhealthy", "duplicate", ""),
    "official route belongs to a job aggregator": ("unhealthy", "duplicate", ""),
    "discovered board identity does not match candidate company": ("unhealthy", "retry", ""),
}
READY, REBASELINE = "ready", "rebaseline"


def demotion_reason(aggregators: tuple[str, ...], matches: Column) -> Column:
    """Why a route (company, provider, name, website, tags) is given up, null if it stays; the first reason counts.

    aggregators: hosts of job aggregators. matches: whether the board belongs to the candidate; null counts as no.
    """
    low, excluded, aggregator, mismatch = REASONS
    host = F.lower(F.try_parse_url("website", F.lit("HOST")))
    listed = any_of((host == a) | host.endswith(f".{a}") for a in aggregators)
    blocked = any_of(has_phrase(padded_text(F.col(c)), BLOCKED_COMPANIES) for c in ("company", "name"))
    return (
        F.when(~high_signal(F.col("tags")), low).when(blocked, excluded)
        .when((F.col("provider") == "official_careers") & F.coalesce(listed, F.lit(False)), aggregator)
        .when(~F.coalesce(matches, F.lit(False)), mismatch)
    )


def demote(discovered: DataFrame, candidates: DataFrame, health: DataFrame, aggregators: tuple[str, ...], matches: Column | None = None, threshold: int = DEMOTE_AFTER) -> DataFrame:
    """discovered (id, candidate_id, company, provider, url, state) with new states, reason, failure_code and candidate_state.

    Live routes are held against candidates (id, name, website, tags); those that stay promoted are demoted after `threshold`
    failures in a row, as health (source_id, state, consecutive_failures) has them. Boards are matched by their names and sites, unless
    matches says otherwise.
    """
    if matches is None:
        matches = board_matches(*(F.col(k) for k in ("provider", "url", "name", "candidate_id", "website")), aggregators)
    c = candidates.select(F.col("id").alias("candidate_id"), "name", "website", "tags")
    h = health.select(F.col("source_id").alias("id"), (F.col("state") == "failure").alias("_fails"), F.col("consecutive_failures").alias("_failures"))
    rows = discovered.join(c, "candidate_id", "left").join(h, "id", "left")
    live = F.col("state").isin("promoted", "candidate") & F.col("name").isNotNull()
    rows = rows.withColumn("reason", F.when(live, demotion_reason(aggregators, matches)))
    known = lambda k, other: F.coalesce(*(F.when(F.col("reason") == r, v[k]) for r, v in REASONS.items()), other)
    failing = (F.col("state") == "promoted") & F.coalesce(F.col("_fails") & (F.col("_failures") >= threshold), F.lit(False))
    return rows.select(
        "id", "candidate_id", "company", "provider", "url", known(0, F.when(failing, "unhealthy").otherwise(F.col("state"))).alias("state"), "reason",
        known(2, F.lit("")).alias("failure_code"), known(1, F.when(failing, "retry")).alias("candidate_state"),
    )


def first_delivery_status(mode: Column, publish_bootstrap: bool = False) -> Column:
    """Status of a new message: staged where the source's baseline is ready, else suppressed, unless bootstraps are published too."""
    return F.when((F.coalesce(mode, F.lit("")) == READY) | F.lit(publish_bootstrap), "staged").otherwise("suppressed")


def activate_exactly(deliveries: DataFrame, chosen: DataFrame) -> DataFrame:
    """deliveries (id, status, ...), the staged ones that chosen (id) names being pending; fails if any of chosen is not staged.

    The counts are scalar subqueries of the plan, so nothing runs before the result is read, and nothing of it can be read if they
    differ.
    """
    wanted = chosen.select("id").distinct().withColumn("_chosen", F.lit(True))
    moved = F.coalesce(F.col("_chosen"), F.lit(False)) & (F.col("status") == "staged")
    rows = deliveries.join(wanted, "id", "left")
    same = rows.agg(F.count_if(moved)).scalar() == wanted.agg(F.count(F.lit(1))).scalar()
    status = F.when(same, "pending").otherwise(F.raise_error(F.lit("not every chosen message is staged")))
    return rows.withColumn("status", F.when(moved | ~same, status).otherwise(F.col("status"))).drop("_chosen")
