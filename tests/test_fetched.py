"""Pages read as postings: titles by rank, companies, and each reason of rejection."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.sources import fetched

NOW = datetime(2026, 8, 22)
BODY = "Build software in Singapore. Apply now. Posted 2 weeks ago"
#: address, page title, text, result title, site name, then title, company and reason
PAGES = [
    ("https://jobs.ashbyhq.com/acmelabs/1", "Software Engineer Intern at Acme", BODY, "x", None, "Software Engineer Intern", "Acme Labs", None),
    ("https://jobs.example.com/2", "Careers", f"# Careers\n## Backend Intern | Acme\n{BODY}", "y", "Acme Corp", "Backend Intern", "Acme Corp", None),
    ("https://x.example.com/company/blue-sky/3", None, f"Platform New Grad Blue Sky\n{BODY}", None, "jobs", "Platform New Grad", "Blue Sky", None),
    ("https://www.reddit.com/r/4", "Software Intern", BODY, None, None, "Software Intern", "Reddit", "blocked_source"),
    ("https://github.com/a/b", "Software Intern", BODY, None, None, "Software Intern", "Github", "blocked_source"),
    ("https://a.example.com/5", "Software Intern", f"{BODY}. This position has been filled.", None, None, "Software Intern", "A", "closed_or_not_live"),
    ("https://a.example.com/6", "Software Internship Program", BODY, None, None, "Software Internship Program", "A", "content_or_program_page"),
    ("https://a.example.com/7", "Staff Engineer", BODY, None, None, "Staff Engineer", "A", "not_specific_early_career_software"),
    ("https://a.example.com/8", "1,200+ Software Intern Jobs", BODY, None, None, "1,200+ Software Intern Jobs", "A", "aggregate_listing"),
    ("https://a.example.com/9", "Software Intern", "Build software in Berlin", None, None, "Software Intern", "A", "missing_location"),
    ("https://a.example.com/10", None, None, None, None, "see", "A", "not_specific_early_career_software"),
    ("https://jobs.lever.co/openai/11", "", f"Intro line\n# About\n# More\n# Third\n# Fourth\n# Fifth\n# Sixth\n# LLM Intern OpenAI\n{BODY}", None, None, "LLM Intern OpenAI", "Open AI", None),
]


@pytest.fixture(scope="module")
def read(spark):
    pages = spark.createDataFrame([p[:3] for p in PAGES], "url string, title string, text string")
    results = spark.createDataFrame([(i, p[0], p[3], "see", p[4]) for i, p in enumerate(PAGES)] + [(99, PAGES[0][0], "later", "late", "Late")], "position int, url string, title string, snippet string, site_name string")
    return fetched.fetched_postings(results, pages, NOW)


def test_pages_and_their_reasons(read):
    got = {r.url: (r.title, r.company, r.reject_reason) for r in read.collect()}
    assert got == {p[0]: tuple(p[5:]) for p in PAGES}


def test_places_dates_and_confidence(read):
    rows = {r.url: r for r in read.collect()}
    first, far = rows[PAGES[0][0]], rows[PAGES[9][0]]
    assert (first.location, first.posted_at, first.confidence) == ("Singapore", datetime(2026, 8, 8), 0.81)
    assert (far.location, far.posted_at, far.confidence) == ("", None, 0.76)


def test_rejections_are_counted_with_samples(read):
    got = {r.reject_reason: r for r in fetched.rejections(read, 2).collect()}
    assert {k: r.pages for k, r in got.items()} == {
        "blocked_source": 2, "closed_or_not_live": 1, "content_or_program_page": 1, "not_specific_early_career_software": 2, "aggregate_listing": 1, "missing_location": 1,
    }
    two = got["blocked_source"]
    assert (two.sample_1.url, two.sample_2.url, got["aggregate_listing"].sample_2) == ("https://github.com/a/b", "https://www.reddit.com/r/4", None)


@pytest.mark.parametrize(("given", "want"), [
    ("## Software Intern - Remote", "Software Intern"), ("- | ML New Grad | ", "ML New Grad"), ("Look at us at Acme", "Look at us"), ("  ", fetched.NO_TITLE), ("Full-stack Intern", "Full-stack Intern"), (None, None),
])
def test_clean_titles(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(fetched.clean_title(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("slug", "want"), [("acme-robotics", "Acme Robotics"), ("jumptrading", "Jump Trading"), ("scaleai", "Scale AI"), ("labs", "Labs"), ("xai", "Xai"), ("_", ""), ("NotionHQ", "Notion HQ")])
def test_names_of_boards(spark, slug, want):
    assert spark.createDataFrame([(slug,)], "s string").select(fetched.hosted_company(F.col("s"))).first()[0] == want


def test_confidence_of_runs_and_blocks(spark):
    df = spark.createDataFrame([(0.95, "completed"), (0.5, "COMPLETED"), (0.5, "failed"), (None, None)], "best double, status string")
    assert [r[0] for r in df.select(fetched.run_confidence(F.col("best"), F.col("status"))).collect()] == [0.9, 0.72, 0.68, 0.68]
    assert spark.range(1).select(fetched.block_confidence(F.lit("apply, posted for an intern"))).first()[0] == 0.8


def test_no_pages(spark, read):
    assert fetched.rejections(read.where("false")).count() == 0
