"""Candidates are resolved by search results, else by pages, else by their own site."""

import pytest
from pyspark.sql import functions as F

from snapledger.functions.board_route import board_of
from snapledger.operators import resolution

CANDIDATES = [
    ("acme", "Acme", "https://www.acme.com", ["priority-1"]), ("blue", "Blue Sky", "https://bluesky.example.com:8443/x", []), ("cold", "Cold", "https://cold.example.com", None),
    ("market", "Market Co", "https://market.example.com", ["Auto-Market-Search"]), ("agg", "Agg", "https://board.startup.jobs", []), ("none", "None Such", None, []), ("cita", "Citadel", "https://www.citadel.com", []),
]
RESULTS = [
    ("acme", 2, "https://jobs.lever.co/acme/123?x=1", "Acme jobs", ""), ("acme", 1, "https://boards.greenhouse.io/Acme/jobs/1", "Roles at Acme", ""), ("acme", 3, "https://jobs.lever.co/ACME", "Acme again", ""),
    ("acme", 4, "https://jobs.lever.co/acmestaffing", "Acme staffing", ""), ("acme", 5, "https://jobs.ashbyhq.com/acmerobots", "Unrelated", None),
    ("blue", 1, "https://bluesky.example.com/careers", "Careers", ""), ("blue", 2, "https://jobs.lever.co/other", "Blue Sky is mentioned", ""), ("cold", 1, "ftp://cold.example.com/x", "Cold", ""),
    ("cita", 1, "https://www.citadel.com/careers/open", "Citadel", ""), (None, 1, "https://jobs.lever.co/acme", "Acme", ""), ("unheard", 1, "https://jobs.lever.co/unheard", "Unheard", ""),
]
PAGES = [
    ("blue", "https://bluesky.example.com/careers", "Careers", "[Roles](https://apply.workable.com/BlueSky/j/1). See https://jobs.lever.co/other, \"https://jobs.ashbyhq.com/bluesky\"!"),
    ("cold", "https://elsewhere.example.org", "Elsewhere", "https://jobs.lever.co/coldbrew"), ("acme", "https://acme.com", "Acme", "https://jobs.gem.com/acme"), ("none", "https://x.example.com", None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(CANDIDATES, "id string, name string, website string, tags array<string>"),
        spark.createDataFrame(RESULTS, "candidate_id string, position int, url string, title string, snippet string"),
        spark.createDataFrame(PAGES, "candidate_id string, url string, title string, text string"),
    )


def test_each_way_is_taken(tables):
    got = [(r.candidate_id, r.nth, r.way, r.provider, r.url, r.confidence, r.evidence) for r in resolution.resolve(*tables, ("startup.jobs",)).orderBy("candidate_id", "nth").collect()]
    assert got == [
        ("acme", 1, "search", "greenhouse", "https://job-boards.greenhouse.io/acme", 0.96, "Roles at Acme"), ("acme", 2, "search", "lever", "https://jobs.lever.co/acme", 0.96, "Acme jobs"),
        ("blue", 1, "page", "ashby", "https://jobs.ashbyhq.com/bluesky", 0.92, "https://bluesky.example.com/careers"), ("blue", 2, "page", "workable", "https://apply.workable.com/bluesky", 0.92, "https://bluesky.example.com/careers"),
        ("cita", 1, "search", "citadel_careers", "https://www.citadel.com/career-sitemap.xml", 0.96, "Citadel"), ("cold", 1, "official", "official_careers", "https://cold.example.com", 0.84, "the candidate's own site"),
    ]


def test_ids_of_sources(tables):
    import hashlib

    got = {r.candidate_id: r.source_id for r in resolution.resolve(*tables).where("way = 'official'").collect()}
    url = "https://cold.example.com"
    assert got["cold"] == "auto-cold-official-careers-" + hashlib.sha256(f"official_careers|{url}".encode()).hexdigest()[:8]
    assert "agg" in got and "market" not in got and "none" not in got


def test_pages_to_fetch(tables):
    got = [(r.candidate_id, r.rank, r.url) for r in resolution.pages_to_fetch(*tables[:2]).where("candidate_id IN ('blue', 'cold', 'none')").orderBy("candidate_id", "rank").collect()]
    assert got == [("blue", 1, "https://bluesky.example.com:8443/x"), ("blue", 2, "https://bluesky.example.com/careers"), ("blue", 3, "https://jobs.lever.co/other"), ("cold", 1, "https://cold.example.com")]
    assert resolution.pages_to_fetch(*tables[:2], limit=1).groupBy("candidate_id").count().agg(F.max("count")).first()[0] == 1


def test_summary_of_results(tables):
    got = {r.candidate_id: tuple(r)[1:] for r in resolution.search_summary(*tables[:2]).collect()}
    assert got == {"acme": (5, 4, 3, 1), "blue": (2, 2, 0, 1), "cold": (1, 1, 0, 0), "cita": (1, 1, 1, 0)}


def test_empty_tables(tables):
    empty = [t.where("false") for t in tables]
    assert resolution.resolve(*empty).count() == 0
    assert {r.way for r in resolution.resolve(tables[0], *empty[1:]).collect()} == {"official"}


@pytest.mark.parametrize(("url", "want"), [
    ("https://boards-api.greenhouse.io/v1/boards/Acme/jobs", ("greenhouse", "https://job-boards.greenhouse.io/acme")), ("https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/1", ("workday", "https://acme.wd5.myworkdayjobs.com/Careers")),
    ("https://acme.wd5.myworkdayjobs.com/External", ("workday", "https://acme.wd5.myworkdayjobs.com/External")), ("https://www.ycombinator.com/companies/Acme/jobs/x", ("yc_jobs", "https://www.ycombinator.com/companies/acme/jobs")),
    ("https://www.deshaw.com/careers/internships/1", ("deshaw_careers", "https://www.deshaw.com/careers/internships")), ("https://notlever.co/acme", None), ("https://jobs.lever.co/", None), ("ftp://jobs.lever.co/acme", None), (None, None),
])
def test_boards_of_addresses(spark, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(board_of(F.col("u"))).first()[0]
    assert (got and tuple(got)) == want
