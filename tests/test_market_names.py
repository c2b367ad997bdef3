"""Names and sites of market searches."""

import pytest
from pyspark.sql import functions as F

from snapledger.operators import market_names as M

SITES = [
    ("a", "Builtin NYC", "https://x.example.com", True, "retry"), ("b", "Acme", "https://www.jobs.indeed.com/x", True, "pending"), ("c", "Acme", "https://notindeed.com", True, "pending"), ("d", "Hirify", "", True, "promoted"),
    ("e", "Sony-Global", "", True, "pending"), ("f", "SonyGlobal", "", True, "promoted"), ("g", "SonyGlobal", "", False, "pending"), ("h", "hirify", "", False, "pending"), ("i", None, None, True, "validating"), ("j", "  Two   Words ", None, True, "pending"),
]


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(i, n, w, [M.MARKET_TAG] if m else ["curated"], s, "", 7) for i, n, w, m, s in SITES]
    return spark.createDataFrame(rows, "id string, name string, website string, tags array<string>, state string, last_error string, extra int")


def test_screened_candidates(candidates):
    got = M.screen_candidates(candidates)
    assert got.columns == candidates.columns
    rows = {r.id: (r.name, r.state, r.last_error) for r in got.collect()}
    want = {i: (n, s, "") for i, n, _, _, s in SITES}
    want |= {"a": ("Builtin NYC", "duplicate", M.WHY), "b": ("Acme", "duplicate", M.WHY), "f": ("Sony", "promoted", ""), "j": ("Two Words", "pending", "")}
    assert rows == want


def test_sources_follow_their_candidates(spark, candidates):
    found = spark.createDataFrame([(1, "f", "SonyGlobal"), (2, "c", "Other"), (3, "absent", "X"), (4, None, "Y")], "id int, candidate_id string, company string")
    got = M.renamed_sources(found, candidates, M.screen_candidates(candidates))
    assert got.columns == found.columns and sorted(tuple(r) for r in got.select("id", "company").collect()) == [(1, "Sony"), (2, "Other"), (3, "X"), (4, "Y")]


@pytest.mark.parametrize(("name", "want"), [
    ("WalleyeCapital External  Students", "Walleye Capital"), ("A", ""), ("x" * 101, ""), ("é" * 51, ""), ("The Job Board Co", ""), ("Jobboard Co", "Jobboard Co"), ("!!!", ""), (None, ""), ("Work at a Startup", ""), ("Base Power", "Base Power"),
])
def test_names_that_are_kept(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(M.market_company(F.col("n"))).first()[0] == want
