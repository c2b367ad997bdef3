"""The grouped, deduplicated feed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.classify import category, region, track
from snapledger.functions.outcomes import exact_company
from snapledger.functions.text import digest_prefix, feed_company, feed_text
from snapledger.operators.admission import rejection_code

DEFAULT_LIMIT, MAX_LIMIT = 50, 500


def scan_order() -> list[Column]:
    """Newest first, then company, title and id in binary order."""
    return [F.desc("first_seen_at"), F.asc("company"), F.asc("title"), F.asc("id")]


def shown_links(jobs: DataFrame, link_state: str = "link_state") -> DataFrame:
    """Jobs whose link is not known to be gone; one that was never checked stays."""
    return jobs.where(~F.col(link_state).eqNullSafe("gone"))


def without_hidden(feed: DataFrame, companies: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """feed (id, company, ...) without the companies (company) and the rows (id) that a reader has hidden, spelling of companies aside.

    Anti joins keep rows whose company is null, and hidden nulls hide nothing.
    """
    if companies is not None:
        hidden = companies.select(exact_company(F.col("company")).alias("_hidden")).distinct()
        feed = feed.join(hidden, exact_company(F.col("company")) == F.col("_hidden"), "left_anti")
    return feed if ids is None else feed.join(ids.select("id").distinct(), "id", "left_anti")


def openings(jobs: DataFrame, now: datetime, url: Column, posted: str | None = "posted_at") -> DataFrame:
    """Admitted postings, one for each identity, with what groups and filters them.

    The identity is company and canonical URL, or the id where there is no URL; the first in scan order stays. A window
    by identity splits the work by opening, so no task holds more than the copies of one.
    """
    key = feed_company(F.col("company"))
    rows = (
        jobs.where(rejection_code(now, posted).isNull())
        .withColumn("safe_url", url)
        .withColumn("company_key", key)
        .withColumn("identity", F.when(F.col("safe_url") != "", F.concat(key, F.lit("|url:"), F.col("safe_url"))).otherwise(F.concat(F.lit("id:"), F.col("id"))))
    )
    first = F.row_number().over(Window.partitionBy("identity").orderBy(*scan_order()))
    return rows.withColumn("_nth", first).where("_nth = 1").drop("_nth").select(
        "*",
        track(F.col("title"), F.col("employment_type"), F.col("level")).alias("track"),
        category(F.col("title")).alias("category"),
        region(F.col("country"), F.col("location")).alias("region"),
    ).withColumn("group_key", F.concat_ws("|", "company_key", feed_text(F.col("title")), feed_text(F.col("location")), "track"))


def grouped(opened: DataFrame) -> DataFrame:
    """One row per group of openings: a representative and its openings, newest first.

    Of the openings in scan order, the first gives company, title, place and classes, and (being the newest) times,
    employment and level; the first that has one gives the URL. min_by over an explicit order keeps this one aggregate.
    """
    newest = F.struct((-F.unix_micros(F.col("first_seen_at").cast("timestamp"))).alias("t"), "company", "title", "id")
    first = lambda c: F.min_by(c, newest).alias(c)
    return opened.groupBy("group_key").agg(
        *(first(c) for c in ("company", "title", "location", "country", "track", "category", "region", "level", "employment_type")),
        F.min_by("safe_url", F.when(F.col("safe_url") != "", newest)).alias("apply_url"),
        F.max("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.count(F.lit(1)).alias("opening_count"),
        F.min(newest).alias("_order"),
        F.array_sort(F.collect_list(F.struct(newest.alias("at"), F.col("safe_url").alias("apply_url"), "first_seen_at"))).alias("openings"),
    ).select(
        digest_prefix(F.col("group_key"), 16).alias("id"), "company", "title", "location", "country", "track", "category", "region", "level",
        "employment_type", F.coalesce("apply_url", F.lit("")).alias("apply_url"), "first_seen_at", "last_seen_at", "opening_count", "openings", "_order",
    )


def filtered(feed: DataFrame, query: str = "", region: str = "", track: str = "", role: str = "") -> DataFrame:
    """The groups that fit; an empty value or `all` lets everything pass."""
    if q := "".join(query.split()) and query:
        words = feed_text(F.lit(q))
        feed = feed.where(F.contains(feed_text(F.concat_ws(" ", "company", "title", "location")), words))
    for column, value in (("region", region), ("track", track), ("category", role)):
        if value not in ("", "all"):
            feed = feed.where(F.col(column) == value)
    return feed


def clamp_limit(limit) -> int:
    """Default for what is no positive number; never above the maximum."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        return DEFAULT_LIMIT
    return DEFAULT_LIMIT if n <= 0 else min(n, MAX_LIMIT)


def page(feed: DataFrame, sort: str = "recent", limit=DEFAULT_LIMIT) -> DataFrame:
    """The first groups, newest first or by company and title; what is equal keeps the order of first appearance."""
    order = [F.asc("company"), F.asc("title"), F.asc("_order")] if sort == "company" else [F.desc("first_seen_at"), F.asc("company"), F.asc("_order")]
    return feed.orderBy(*order).limit(clamp_limit(limit)).drop("_order")


def numbered_page(feed: DataFrame, sort: str = "recent", limit=DEFAULT_LIMIT) -> DataFrame:
    """page with each row's position (from one) and the total of groups before the limit.

    The total is a scalar subquery over the groups' keys alone; positions are given to the page, MAX_LIMIT rows at most.
    """
    order = [F.asc("company"), F.asc("title"), F.asc("_order")] if sort == "company" else [F.desc("first_seen_at"), F.asc("company"), F.asc("_order")]
    total = feed.agg(F.count(F.lit(1))).scalar()
    first = feed.orderBy(*order).limit(clamp_limit(limit))
    # one window over the page, which the limit bounds
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint")).withColumn("total", total).drop("_order")


def page_update(numbered: DataFrame, since: datetime | Column) -> DataFrame:
    """What a reader that has a page from `since` (a time, or a column) needs: position, id and total of every row, and the body (a struct) of those that are new."""
    names = [c for c in numbered.columns if c not in ("position", "id", "total")]
    body = F.when(F.col("first_seen_at") >= F.lit(since), F.struct(*names))
    return numbered.select("position", "id", "total", body.alias("body"))


def active_ids(update: DataFrame) -> DataFrame:
    """The ids of a page in their order, as one list."""
    return update.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("active_ids"))


def from_cache(cached: DataFrame, update: DataFrame, full: DataFrame) -> DataFrame:
    """The page after an update: new bodies, else those of cached (id, body), in the update's order; `reloaded` is false.

    If any row has neither, the page is that of full (position, id, body) as a whole, and `reloaded` is true. A cached row that the update
    does not name is gone. The choice is a scalar subquery: full is computed, but nothing of it kept, where the cache will do.
    """
    rows = update.select("position", "id", "body").join(cached.select("id", F.col("body").alias("_old")), "id", "left")
    rows = rows.select("position", "id", F.coalesce("body", "_old").alias("body"))
    missing = rows.agg(F.count_if(F.col("body").isNull())).scalar()
    kept = rows.where(missing == 0).withColumn("reloaded", F.lit(False))
    return kept.unionByName(full.select("position", "id", "body").where(missing > 0).withColumn("reloaded", F.lit(True)))


def incremental(feed: DataFrame, since: datetime) -> DataFrame:
    """The bodies of groups that first appeared at `since` or later, and the ids of all of them: active marks the latter."""
    return feed.select("id", (F.col("first_seen_at") >= F.lit(since)).alias("has_body"), "company", "title", "first_seen_at")


def summary(opened: DataFrame, now: datetime) -> DataFrame:
    """Counts over all openings, taken before any filter of a request."""
    today = F.date_trunc("day", F.lit(now))
    return opened.agg(
        F.count(F.lit(1)).alias("openings"),
        F.countDistinct("group_key").alias("roles"),
        F.countDistinct("company_key").alias("companies"),
        F.count_if(F.col("first_seen_at") >= today).alias("added_today"),
        F.count_if(F.col("first_seen_at") >= today - F.expr("INTERVAL 6 DAYS")).alias("added_week"),
        F.max("last_seen_at").alias("last_updated_at"),
    )


def summary_with_sources(opened: DataFrame, now: datetime, status: DataFrame, known_sources: int = 0) -> DataFrame:
    """summary with sources_healthy, sources_failed and sources_total, by status (source_id, state) of the sources.

    The total is the number of known sources, or of those with a status if that is more.
    """
    counts = lambda c: status.agg(c).scalar()
    return summary(opened, now).select(
        "*", counts(F.count_if(F.col("state") == "success")).alias("sources_healthy"), counts(F.count_if(F.col("state") == "failure")).alias("sources_failed"),
        counts(F.greatest(F.count(F.lit(1)), F.lit(known_sources).cast("bigint"))).alias("sources_total"),
    )
