"""Candidate resolution, fetched pages, market names and generations of files over the driver tables; the SQL says by hand what must come out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from snapledger.operators import market_names, resolution
from snapledger.plans import domain as D
from snapledger.scratch import scratch_path
from snapledger.sources import fetched, generations

AGGREGATORS = ("own7.example.com",)


def _candidates(spark, sf_dir):
    return D.table(spark, sf_dir, "customer").selectExpr(
        "concat('c', c_custkey) AS id", "c_name AS name", "CASE WHEN c_custkey % 11 <> 0 THEN concat('https://www.own', c_custkey, '.example.com/about') END AS website",
        "CASE WHEN c_custkey % 5 = 0 THEN array('curated', 'auto-market-search') ELSE array('curated') END AS tags",
    )


def _results(spark, sf_dir):
    """Few orders are results that lead to their customer's board; others lead to someone else's, or speak of nobody."""
    o, c = D.table(spark, sf_dir, "orders"), D.table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_name", "replace(c_name, '#', '') AS slug")
    return o.join(c, "o_custkey").selectExpr(
        "concat('c', o_custkey) AS candidate_id", "o_orderkey AS position",
        """CASE o_orderkey % 97 WHEN 1 THEN concat('https://boards.greenhouse.io/', slug, '/jobs/', o_orderkey) WHEN 2 THEN concat('https://jobs.lever.co/', lower(slug), '?x=', o_orderkey)
           WHEN 3 THEN concat('https://', slug, '.wd5.myworkdayjobs.com/en-US/Jobs') ELSE 'https://jobs.lever.co/someone-else/x' END AS url""",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'Nobody in particular' ELSE concat('Jobs  at ', c_name) END AS title", "CAST(NULL AS string) AS snippet",
    )


def _pages(spark, sf_dir):
    o, c = D.table(spark, sf_dir, "orders"), D.table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "replace(c_name, '#', '') AS slug")
    return o.where("o_orderkey % 13 IN (4, 5)").join(c, "o_custkey").selectExpr(
        "concat('c', o_custkey) AS candidate_id", "CASE WHEN o_orderkey % 2 = 0 THEN concat('https://own', o_custkey, '.example.com/careers') ELSE 'https://blog.example.org/x' END AS url", "'Careers' AS title",
        "concat('Roles [here](', CASE WHEN o_orderkey % 13 = 4 THEN concat('https://jobs.ashbyhq.com/', slug, '/abc') ELSE 'https://own.example.com' END, '), or at https://apply.workable.com/someone-else.') AS text",
    )


def resolved_candidates(spark, sf_dir):
    return resolution.resolve(_candidates(spark, sf_dir), _results(spark, sf_dir), _pages(spark, sf_dir), AGGREGATORS)


def candidate_searches(spark, sf_dir):
    return resolution.search_summary(_candidates(spark, sf_dir), _results(spark, sf_dir), AGGREGATORS)


def candidate_pages(spark, sf_dir):
    return resolution.pages_to_fetch(_candidates(spark, sf_dir), _results(spark, sf_dir), 4)


_TITLES = ("'Software Intern'", "'# Careers\\n\\n## Backend Intern - Team\\n'", "'Staff Engineer'", "'300 Software Intern Jobs'", "'Intern Spotlight: Software'", "'jobs at Acme'", "'### Platform New Grad at Acme'")
_TEXTS = ("'Software in London.'", "'Software, this job is closed. Singapore'", "'Software in Berlin.'", "'A resume review of software in Singapore'", "'Infrastructure in New York, posted on 2026-05-04'")


def _fetched(spark, sf_dir):
    pick = lambda values, k: f"element_at(array({', '.join(values)}), cast({k} AS int) + 1)"
    o = D.table(spark, sf_dir, "orders")
    pages = o.selectExpr("concat('https://jobs.lever.co/acme-labs/', o_orderkey) AS url", "CAST(NULL AS string) AS title", f"concat({pick(_TITLES, 'o_orderkey % 7')}, '\\n', {pick(_TEXTS, 'o_orderkey DIV 8 % 5')}) AS text")
    results = o.where("o_orderkey % 3 <> 0").selectExpr("concat('https://jobs.lever.co/acme-labs/', o_orderkey) AS url", "o_orderkey AS position", "'Result' AS title", "'as found' AS snippet", "CASE WHEN o_orderkey % 2 = 0 THEN 'Acme Jobs' ELSE 'Acme Inc' END AS site_name")
    return fetched.fetched_postings(results, pages, datetime(2026, 8, 22))


def page_postings(spark, sf_dir):
    return _fetched(spark, sf_dir)


def page_rejections(spark, sf_dir):
    return fetched.rejections(_fetched(spark, sf_dir)).select("reject_reason", "pages", *(F.col(f"sample_{k}.url").alias(f"url_{k}") for k in (1, 2, 3)))


_NAMES = "element_at(array('Builtin Place', 'SonyGlobal', ' Blue  Sky ', 'hirify', 'The Job Board', 'WalleyeCapital external students'), cast(c_custkey % 6 AS int) + 1)"


def _named(spark, sf_dir):
    """Customers as candidates, named as market searches name them, some on job sites."""
    return D.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", f"{_NAMES} AS name", "CASE c_custkey % 7 WHEN 0 THEN 'https://jobs.indeed.com/x' WHEN 1 THEN 'https://notindeed.com' ELSE '' END AS website",
        "CASE WHEN c_custkey % 4 = 0 THEN array('curated') ELSE array('x', 'auto-market-search') END AS tags",
        "element_at(array('pending', 'retry', 'validating', 'promoted', 'parked'), cast(c_nationkey % 5 AS int) + 1) AS state", "'' AS last_error",
    )


def screened_candidates(spark, sf_dir):
    return market_names.screen_candidates(_named(spark, sf_dir)).select("id", "name", "state", "last_error")


def renamed_sources(spark, sf_dir):
    c = _named(spark, sf_dir)
    found = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS candidate_id", "'as before' AS company")
    return market_names.renamed_sources(found, c, market_names.screen_candidates(c)).select("id", "company")


def mixed_generations(spark, sf_dir):
    """Orders as three generations of files have them, read back as one table."""
    o = D.table(spark, sf_dir, "orders")
    made = (
        o.where("o_orderkey % 3 = 0").selectExpr("cast(o_orderkey AS string) AS id", "o_orderstatus AS note"),
        o.where("o_orderkey % 3 = 1").selectExpr("o_orderkey AS id", "o_orderpriority AS priority", "cast(o_orderdate AS date) AS ordered"),
        o.where("o_orderkey % 3 = 2").selectExpr("o_orderkey AS id", "named_struct('priority', o_orderpriority, 'status', o_orderstatus) AS handling", "cast(o_orderdate AS timestamp) AS ordered_at"),
    )
    folders = [scratch_path(spark, f"generation-{k}") for k in range(len(made))]
    for rows, folder in zip(made, folders, strict=True):
        rows.write.parquet(folder)
    layout = {"id": ("bigint", "id"), "priority": ("string", "handling.priority", "priority", "'none'"), "ordered": ("date", "ordered_at", "ordered", "NULL")}
    return generations.scan(spark, folders, layout)


QUERIES = {f.__name__: f for f in (resolved_candidates, candidate_searches, candidate_pages, page_postings, page_rejections, screened_candidates, renamed_sources, mixed_generations)}
_SCREEN = """WITH c AS (SELECT c_custkey AS id, (['Builtin Place', 'SonyGlobal', ' Blue  Sky ', 'hirify', 'The Job Board', 'WalleyeCapital external students'])[c_custkey % 6 + 1] AS old,
        c_custkey % 4 <> 0 AS market, c_custkey % 6 IN (0, 3) OR c_custkey % 7 = 0 AS site, (['pending', 'retry', 'validating', 'promoted', 'parked'])[c_nationkey % 5 + 1] AS state FROM customer),
    s AS (SELECT id, old, CASE WHEN market AND NOT site THEN CASE id % 6 WHEN 1 THEN 'Sony' WHEN 2 THEN 'Blue Sky' WHEN 5 THEN 'Walleye Capital' ELSE old END ELSE old END AS name,
        market AND site AND state NOT IN ('promoted', 'parked') AS ended, state FROM c)"""
_CUSTOMERS = """WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey AS cid, c_name AS name, lower(replace(c_name, '#', '')) AS slug FROM customer),
    o AS (SELECT o_orderkey AS n, c.*, n % 3 <> 0 AS said FROM orders JOIN c ON o_custkey = k)"""
# what the titles and texts of pages must come out as, by their numbers
_READ = """WITH p AS (SELECT o_orderkey AS n, o_orderkey % 7 AS t, o_orderkey // 8 % 5 AS b, o_orderkey % 3 <> 0 AS found FROM orders),
    r AS (SELECT n, found, t, b, 'https://jobs.lever.co/acme-labs/' || n AS url,
            CASE t WHEN 0 THEN 'Software Intern' WHEN 1 THEN 'Backend Intern' WHEN 2 THEN CASE WHEN found THEN 'Result' ELSE 'Staff Engineer' END WHEN 3 THEN '300 Software Intern Jobs'
                   WHEN 4 THEN 'Intern Spotlight: Software' WHEN 5 THEN CASE WHEN found THEN 'Result' ELSE 'jobs' END ELSE 'Platform New Grad' END AS title,
            CASE b WHEN 0 THEN 'London, United Kingdom' WHEN 2 THEN '' WHEN 4 THEN 'New York, NY, United States' ELSE 'Singapore' END AS location,
            CASE WHEN b = 4 THEN TIMESTAMP '2026-05-04' END AS posted_at,
            round(0.68 + CASE WHEN t IN (3, 5) OR b = 1 THEN 0.05 ELSE 0 END + CASE WHEN t NOT IN (2, 5) THEN 0.08 ELSE 0 END + CASE WHEN b = 4 THEN 0.04 ELSE 0 END, 2) AS score FROM p),
    f AS (SELECT url, title, CASE WHEN found AND n % 2 = 1 THEN 'Acme Inc' ELSE 'Acme Labs' END AS company, location, posted_at, least(score, 0.88)::DOUBLE AS confidence,
            CASE WHEN b = 3 THEN 'blocked_source' WHEN b = 1 THEN 'closed_or_not_live' WHEN t = 4 THEN 'content_or_program_page' WHEN t IN (2, 5) THEN 'not_specific_early_career_software'
                 WHEN t = 3 THEN 'aggregate_listing' WHEN location = '' THEN 'missing_location' END AS reject_reason FROM r)"""
ORACLE = {
    "screened_candidates": f"""{_SCREEN} SELECT id, name, CASE WHEN ended THEN 'duplicate' ELSE state END AS state, CASE WHEN ended THEN 'market result points to blocked job aggregator' ELSE '' END AS last_error FROM s""",
    "renamed_sources": f"{_SCREEN} SELECT o_orderkey AS id, CASE WHEN name <> old THEN name ELSE 'as before' END AS company FROM orders LEFT JOIN s ON o_custkey = id",
    "mixed_generations": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS ordered FROM orders",
    "resolved_candidates": f"""{_CUSTOMERS},
        b AS (SELECT DISTINCT k, 1 AS rank, CASE n % 97 WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' ELSE 'workday' END AS provider,
                CASE n % 97 WHEN 1 THEN 'https://job-boards.greenhouse.io/' || slug WHEN 2 THEN 'https://jobs.lever.co/' || slug ELSE 'https://' || slug || '.wd5.myworkdayjobs.com/Jobs' END AS url, 'Jobs at ' || name AS evidence
              FROM o WHERE said AND n % 97 IN (1, 2, 3)
              UNION ALL SELECT DISTINCT k, 2, 'ashby', 'https://jobs.ashbyhq.com/' || slug, 'https://own' || k || '.example.com/careers' FROM o WHERE n % 13 = 4 AND n % 2 = 0 AND k % 11 <> 0
              UNION ALL SELECT k, 3, 'official_careers', 'https://www.own' || k || '.example.com', 'the candidate''s own site' FROM c WHERE k % 5 <> 0 AND k % 11 <> 0 AND k <> 7),
        w AS (SELECT * FROM b QUALIFY rank = min(rank) OVER (PARTITION BY k))
        SELECT 'c' || k AS candidate_id, row_number() OVER (PARTITION BY k ORDER BY provider || '|' || url) AS nth, (['search', 'page', 'official'])[rank] AS way, provider, url,
               'auto-c' || k || '-' || replace(provider, '_', '-') || '-' || substr(sha256(provider || '|' || url), 1, 8) AS source_id, name AS company, ([0.96, 0.92, 0.84])[rank]::DOUBLE AS confidence, evidence FROM w JOIN c USING (k)""",
    "candidate_searches": f"""{_CUSTOMERS} SELECT cid AS candidate_id, count(*) AS results, count(*) FILTER (said) AS matched, count(*) FILTER (said AND n % 97 IN (1, 2, 3)) AS accepted,
        count(*) FILTER (said AND n % 97 NOT IN (1, 2, 3)) AS rejected FROM o GROUP BY 1""",
    "candidate_pages": f"""{_CUSTOMERS}, u AS (SELECT cid, -1 AS n, 'https://www.own' || k || '.example.com/about' AS url FROM c WHERE k % 11 <> 0
            UNION ALL SELECT cid, min(n), CASE n % 97 WHEN 1 THEN 'https://boards.greenhouse.io/' || replace(name, '#', '') || '/jobs/' || n WHEN 2 THEN 'https://jobs.lever.co/' || slug || '?x=' || n
                WHEN 3 THEN 'https://' || replace(name, '#', '') || '.wd5.myworkdayjobs.com/en-US/Jobs' ELSE 'https://jobs.lever.co/someone-else/x' END AS url FROM o WHERE said GROUP BY cid, url)
        SELECT cid AS candidate_id, row_number() OVER (PARTITION BY cid ORDER BY n) AS rank, url FROM u QUALIFY rank <= 4""",
    "page_postings": f"{_READ} SELECT * FROM f",
    "page_rejections": f"""{_READ}, s AS (SELECT reject_reason, url, row_number() OVER (PARTITION BY reject_reason ORDER BY url) AS nth, count(*) OVER (PARTITION BY reject_reason) AS pages FROM f WHERE reject_reason IS NOT NULL)
        SELECT reject_reason, any_value(pages) AS pages, max(url) FILTER (nth = 1) AS url_1, max(url) FILTER (nth = 2) AS url_2, max(url) FILTER (nth = 3) AS url_3 FROM s GROUP BY 1""",
}
