"""Feed and admission queries over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.functions.url import canonical_url_plain
from snapledger.operators import admission, feed, fold
from snapledger.plans import domain as D
from snapledger.plans import sqltext as S

SINCE = datetime(2001, 6, 1)
PAGE_SINCE = datetime(2001, 10, 5)


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.openings(D.postings(spark, sf_dir), D.NOW, canonical_url_plain(F.col("apply_url")))


def _flat(groups: DataFrame) -> DataFrame:
    """The nested openings as text, so that both sides can compare them."""
    urls = F.array_join(F.transform("openings", lambda o: o["apply_url"]), ",")
    return groups.select(
        "id", "company", "title", "location", "track", "category", "region", "apply_url", "first_seen_at", "last_seen_at",
        F.col("opening_count").cast("bigint").alias("opening_count"), urls.alias("opening_urls"),
    )


def feed_recent(spark, sf_dir):
    groups = feed.grouped(_opened(spark, sf_dir))
    return _flat(feed.page(groups, "recent", 200))


def feed_company_sort(spark, sf_dir):
    return _flat(feed.page(feed.grouped(_opened(spark, sf_dir)), "company", 200))


def feed_filtered(spark, sf_dir):
    groups = feed.filtered(feed.grouped(_opened(spark, sf_dir)), region="us", track="internship", role="software")
    return _flat(groups)


def feed_search(spark, sf_dir):
    return _flat(feed.filtered(feed.grouped(_opened(spark, sf_dir)), query="quantitative"))


def feed_incremental(spark, sf_dir):
    return feed.incremental(feed.grouped(_opened(spark, sf_dir)), SINCE)


def _page(spark, sf_dir):
    """The first page of openings whose link is not gone and whose company is not hidden."""
    jobs = D.postings(spark, sf_dir).withColumn("link_state", F.when(F.col("id").endswith("7-A"), "gone").when(F.col("id").endswith("7-N"), "live"))
    groups = feed.grouped(feed.openings(feed.shown_links(jobs), D.NOW, canonical_url_plain(F.col("apply_url"))))
    hidden = D.table(spark, sf_dir, "supplier").where("s_nationkey % 3 = 0").select(F.upper("s_name").alias("company"))
    return feed.numbered_page(feed.without_hidden(groups, hidden), "recent", 200)


def feed_page(spark, sf_dir):
    return _page(spark, sf_dir).select("position", "id", "company", "title", "total")


def feed_page_update(spark, sf_dir):
    u = feed.page_update(_page(spark, sf_dir), PAGE_SINCE)
    return u.select("position", "id", F.col("body.company").alias("company"))


def feed_active_ids(spark, sf_dir):
    return feed.active_ids(feed.page_update(_page(spark, sf_dir), PAGE_SINCE)).select(F.array_join("active_ids", ",").alias("active_ids"))


def _reconciled(spark, sf_dir, since, cached_until):
    shown = _page(spark, sf_dir).select("position", "id", "total", "company", "first_seen_at")
    bodies = shown.select("position", "id", F.struct("company", "first_seen_at").alias("body"))
    cached = bodies.where(F.col("body.first_seen_at") < F.lit(cached_until)).select("id", F.struct(F.concat(F.lit("old "), "body.company").alias("company"), "body.first_seen_at").alias("body"))
    out = feed.from_cache(cached, feed.page_update(shown, since(shown)), bodies)
    return out.select("position", "id", "body.company", "reloaded")


def feed_from_cache(spark, sf_dir):
    """The cache has all that is older than the update."""
    return _reconciled(spark, sf_dir, lambda shown: F.lit(PAGE_SINCE), PAGE_SINCE)


def feed_reloaded(spark, sf_dir):
    """The cache ends before the update begins: its reader has had all of the page, whatever its dates, and lost what it had."""
    behind = lambda shown: shown.agg(F.max("first_seen_at") + F.expr("INTERVAL 1 SECOND")).scalar()
    return _reconciled(spark, sf_dir, behind, datetime(1990, 1, 1))


def feed_source_summary(spark, sf_dir):
    status = fold.failure_streaks(D.attempts(spark, sf_dir)).select("source_id", "state")
    return feed.summary_with_sources(_opened(spark, sf_dir), datetime(2001, 8, 30), status, 7)


def feed_summary(spark, sf_dir):
    return feed.summary(_opened(spark, sf_dir), datetime(2001, 8, 30))


def rejection_codes(spark, sf_dir):
    rows = D.observations(spark, sf_dir).withColumn("code", F.coalesce(admission.rejection_code(D.NOW), F.lit("accepted")))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def admission_rows(spark, sf_dir):
    return D.observations(spark, sf_dir).select("seq", F.coalesce(admission.rejection_code(D.NOW), F.lit("")).alias("code"))


def rejection_ledger(spark, sf_dir):
    return admission.rejection_ledger(D.observations(spark, sf_dir), D.NOW)


_CODE = S.rejection("2001-09-01", 2001, True)
_OPEN = D.with_views("v_post") + f""",
    acc AS (SELECT *, {S.plain_url('apply_url')} AS safe_url, replace({S.feed('company')}, ' ', '') AS company_key FROM v_post WHERE ({_CODE}) IS NULL),
    nth AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN safe_url <> '' THEN company_key || '|url:' || safe_url ELSE 'id:' || id END
                                         ORDER BY first_seen_at DESC, company, title, id) AS nth FROM acc),
    opened AS (SELECT *, {S.track('title', 'employment_type', 'level')} AS track, {S.category('title')} AS category, {S.region('country', 'location')} AS region,
                      company_key || '|' || {S.feed('title')} || '|' || {S.feed('location')} || '|' || {S.track('title', 'employment_type', 'level')} AS group_key
               FROM nth WHERE nth = 1),
    grp AS (SELECT substr(sha256(group_key), 1, 16) AS id, first(company ORDER BY first_seen_at DESC, company, title, id) AS company,
                   first(title ORDER BY first_seen_at DESC, company, title, id) AS title, first(location ORDER BY first_seen_at DESC, company, title, id) AS location,
                   first(track ORDER BY first_seen_at DESC, company, title, id) AS track, first(category ORDER BY first_seen_at DESC, company, title, id) AS category,
                   first(region ORDER BY first_seen_at DESC, company, title, id) AS region, first(safe_url ORDER BY first_seen_at DESC, company, title, id) AS apply_url,
                   max(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, count(*) AS opening_count,
                   string_agg(safe_url, ',' ORDER BY first_seen_at DESC, company, title, id) AS opening_urls, first(id ORDER BY first_seen_at DESC, company, title, id) AS lead
            FROM opened GROUP BY group_key)"""
_PAGE = _OPEN.replace("FROM v_post WHERE", "FROM v_post WHERE id NOT LIKE '%7-A' AND") + """,
    vis AS (SELECT * FROM grp WHERE lower(trim(company)) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_nationkey % 3 = 0)),
    pg AS (SELECT *, row_number() OVER (ORDER BY first_seen_at DESC, company, title, lead) AS position, (SELECT count(*) FROM vis) AS total FROM vis QUALIFY position <= 200)"""
_COLUMNS = "id, company, title, location, track, category, region, apply_url, first_seen_at, last_seen_at, opening_count, opening_urls"

QUERIES = {f.__name__: f for f in (feed_recent, feed_company_sort, feed_filtered, feed_search, feed_incremental, feed_page, feed_page_update, feed_active_ids, feed_from_cache, feed_reloaded, feed_source_summary, feed_summary, rejection_codes, admission_rows, rejection_ledger)}
ORACLE = {
    "feed_recent": f"{_OPEN} SELECT {_COLUMNS} FROM grp ORDER BY first_seen_at DESC, company, title, lead LIMIT 200",
    "feed_company_sort": f"{_OPEN} SELECT {_COLUMNS} FROM grp ORDER BY company, title, first_seen_at DESC, lead LIMIT 200",
    "feed_filtered": f"{_OPEN} SELECT {_COLUMNS} FROM grp WHERE region = 'us' AND track = 'internship' AND category = 'software'",
    "feed_search": f"{_OPEN} SELECT {_COLUMNS} FROM grp WHERE contains({S.feed(chr(39).join(['company || ', ' ', ' || title || ', ' ', ' || location']))}, 'quantitative')",
    "feed_incremental": f"{_OPEN} SELECT id, first_seen_at >= TIMESTAMP '2001-06-01' AS has_body, company, title, first_seen_at FROM grp",
    "feed_page": f"{_PAGE} SELECT position, id, company, title, total FROM pg",
    "feed_page_update": f"{_PAGE} SELECT position, id, CASE WHEN first_seen_at >= TIMESTAMP '2001-10-05' THEN company END AS company FROM pg",
    "feed_active_ids": f"{_PAGE} SELECT string_agg(id, ',' ORDER BY position) AS active_ids FROM pg",
    "feed_from_cache": f"{_PAGE} SELECT position, id, CASE WHEN first_seen_at >= TIMESTAMP '2001-10-05' THEN company ELSE 'old ' || company END AS company, false AS reloaded FROM pg",
    "feed_reloaded": f"{_PAGE} SELECT position, id, company, true AS reloaded FROM pg",
    "feed_source_summary": f"""{_OPEN.replace(D.with_views('v_post'), D.with_views('v_post', 'v_att'), 1)},
        st AS (SELECT source_id, arg_max(ok, strftime("at", '%Y%m%d%H%M%S%f') || arrival) AS ok FROM v_att GROUP BY source_id)
        SELECT count(*) AS openings, count(DISTINCT group_key) AS roles, count(DISTINCT company_key) AS companies,
        count(*) FILTER (first_seen_at >= TIMESTAMP '2001-08-30') AS added_today, count(*) FILTER (first_seen_at >= TIMESTAMP '2001-08-24') AS added_week, max(last_seen_at) AS last_updated_at,
        (SELECT count(*) FROM st WHERE ok) AS sources_healthy, (SELECT count(*) FROM st WHERE NOT ok) AS sources_failed, (SELECT greatest(count(*), 7) FROM st) AS sources_total FROM opened""",
    "feed_summary": f"""{_OPEN} SELECT count(*) AS openings, count(DISTINCT group_key) AS roles, count(DISTINCT company_key) AS companies,
        count(*) FILTER (first_seen_at >= TIMESTAMP '2001-08-30') AS added_today, count(*) FILTER (first_seen_at >= TIMESTAMP '2001-08-24') AS added_week,
        max(last_seen_at) AS last_updated_at FROM opened""",
    "rejection_codes": f"{D.with_views('v_obs')} SELECT coalesce({_CODE}, 'accepted') AS code, count(*) AS n FROM v_obs GROUP BY 1",
    "admission_rows": f"{D.with_views('v_obs')} SELECT seq, coalesce({_CODE}, '') AS code FROM v_obs",
    "rejection_ledger": f"""{D.with_views('v_obs')}, r AS (SELECT *, {_CODE} AS code FROM v_obs)
        SELECT source_id, substr(sha256(company || '|' || title || '|' || location || '|' || apply_url || '|' || source_native_id), 1, 32) AS fingerprint, code,
               '{admission.POLICY_VERSION}' AS policy_version, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at, count(*) AS observation_count
        FROM r WHERE code IS NOT NULL GROUP BY ALL""",
}
