"""Boards and companies: whose board it is."""

import pytest
from pyspark.sql import functions as F

from snapledger.functions.board_match import board_matches, website_brand
from snapledger.operators import triage

CASES = [
    ("smartrecruiters", "https://careers.smartrecruiters.com/CitadelSearch", "Citadel", "citadel", "https://www.citadel.com", False),
    ("greenhouse", "https://job-boards.greenhouse.io/citadelsecurities", "Citadel", "citadel", "https://www.citadel.com", True),
    ("greenhouse", "https://job-boards.greenhouse.io/TalentCitadel", "Citadel", "citadel", "", False),
    ("lever", "https://jobs.lever.co/acme2", "Acme", "acme", "", False),
    ("lever", "https://jobs.lever.co/theacmehealth/x", "Acme", "acme", "", False),
    ("lever", "https://jobs.lever.co/acme-robotics", "Acme", "acme", "", True),
    ("lever", "https://jobs.lever.co/xai", "xAI", "x-ai", "", True),
    ("lever", "https://jobs.lever.co/xaiworld", "xAI", "x", "", False),
    ("ashby", "https://jobs.ashbyhq.com/Acme%20Robotics", "Acme Robotics", "acme", "", True),
    ("ashby", "https://user@jobs.ashbyhq.com:443/Acme Robotics|x/y?z", "Acme", "acme", "", True),
    ("ashby", "https://jobs.ashbyhq.com/", "Acme", "acme", "", False),
    ("greenhouse", "https://boards.greenhouse.io/acmeexperienced", "Acme", "acme", "", False),
    ("workday", "https://acme.wd5.myworkdayjobs.com/Careers", "Acme", "acme", "", True),
    ("workday", "https://other.wd5.myworkdayjobs.com/Careers", "Acme", "acme", "", False),
    ("greenhouse", "https://boards.greenhouse.io/braid", "Something Else", "s", "https://jobs.braid.io", True),
    ("greenhouse", "https://boards.greenhouse.io/systems", "Quiet Systems", "q", "", True),
    ("greenhouse", "https://boards.greenhouse.io/tradingsystems", "Loud Systems", "l", "", False),
    ("yc_jobs", "https://www.ycombinator.com/companies/acme-labs/jobs", "Acme", "x", "", True),
    ("yc_jobs", "https://www.ycombinator.com/companies/other/jobs", "Acme", "x", "", False),
    ("yc_jobs", "https://www.ycombinator.com/companies/acme", "Acme", "x", "", False),
    ("official_careers", "https://jobs.aumovio.com", "Aumovio", "aumovio", "https://jobs.aumovio.com/en/careers", True),
    ("official_careers", "https://aumovio.com", "Aumovio", "aumovio", "https://www.jobs.aumovio.com", True),
    ("official_careers", "https://startup.jobs/company/acme", "Acme", "acme", "https://startup.jobs/company/acme", False),
    ("official_careers", "https://acme.com", "Acme", "acme", None, False),
    ("lever", "https://jobs.lever.co/c61/2x2", "Zz", "c61", "", True),
    ("unheard_of", "https://unheard.example/acme", "Acme", "acme", "", False),
    ("lever", "not an address", "Acme", "acme", "", False),
    ("lever", None, "Acme", "acme", "", False),
    ("lever", "https://jobs.lever.co/acme", None, None, None, False),
    (None, "https://jobs.lever.co/acme", "Acme", "acme", "", False),
]


def test_whose_board(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, provider string, url string, name string, cid string, site string, want boolean")
    got = df.withColumn("got", board_matches(*(F.col(c) for c in ("provider", "url", "name", "cid", "site")), aggregators=("startup.jobs",)))
    assert [(r.provider, r.url, r.name, r.got) for r in got.orderBy("i").collect()] == [(c[0], c[1], c[2], c[5]) for c in CASES]


@pytest.mark.parametrize(("url", "brand"), [("https://www.acme.com", "acme"), ("https://careers.acme.co.uk/x", "acme"), ("https://ai.io", ""), ("https://localhost", ""), (None, "")])
def test_brand_of_a_website(spark, url, brand):
    assert spark.createDataFrame([(url,)], "u string").select(website_brand(F.col("u"))).first()[0] == brand


def test_demotion_asks_whose_board_it_is(spark):
    found = spark.createDataFrame(
        [(1, "c", "Acme", "lever", "https://jobs.lever.co/acme", "promoted"), (2, "c", "Acme", "lever", "https://jobs.lever.co/acmestaffing", "promoted"), (3, "c", "Acme", "lever", None, "candidate")],
        "id long, candidate_id string, company string, provider string, url string, state string",
    )
    candidates = spark.createDataFrame([("c", "Acme", "https://acme.com", ["priority-1", "yc-top"])], "id string, name string, website string, tags array<string>")
    health = spark.createDataFrame([], "source_id long, state string, consecutive_failures int")
    got = {r.id: (r.state, r.reason) for r in triage.demote(found, candidates, health, ()).collect()}
    foreign = "discovered board identity does not match candidate company"
    assert got == {1: ("promoted", None), 2: ("unhealthy", foreign), 3: ("unhealthy", foreign)}
