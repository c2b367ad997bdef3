from datetime import datetime

from snapledger.sources import search

NOW = datetime(2026, 8, 22)
CASES = [
    ("https://a/1", "Software Intern", "Posted on 2026-08-01. Build things.", None), ("https://a/2", "Software Intern", "This job has expired", "closed"), ("https://a/3", "Intern Spotlight: Kim", "A day", "content_page"),
    ("https://a/4", "Intern jobs in Berlin", "many", "listing"), ("https://a/5", "Staff Engineer", "senior", "not_early_career"), ("https://a/6", "Junior Developer", None, None), ("https://a/7", "Junior Developer", "", "empty"),
]


def test_results_keep_their_reason(spark):
    results = spark.createDataFrame([("q", i, u, t, "posted 2 weeks ago" if m is None else "") for i, (u, t, m, _) in enumerate(CASES)], "query string, position int, url string, title string, snippet string")
    pages = spark.createDataFrame([(u, t, m) for u, t, m, _ in CASES if m is not None], "url string, title string, markdown string")
    got = {r["url"]: r for r in search.candidates(results, pages, NOW).collect()}
    assert {u: got[u]["reject_reason"] for u, *_ in CASES} == {u: why for u, _, _, why in CASES}
    assert (got["https://a/1"]["posted_at"], got["https://a/6"]["posted_at"]) == (datetime(2026, 8, 1), datetime(2026, 8, 8)) and not got["https://a/6"]["fetched"]


def test_blocks_of_a_page(spark):
    pages = spark.createDataFrame([("u", "# Jobs\n## Software Intern\nBerlin\n\n### Senior Dev ###\nno\n## New Grad Engineer\n"), ("v", None)], "url string, markdown string")
    assert [(r["pos"], r["title"], r["body"]) for r in search.page_rows(pages).orderBy("pos").collect()] == [(1, "Software Intern", "Berlin"), (3, "New Grad Engineer", "")]


def test_agent_output_is_repaired(spark):
    raw = ['Sure:\n```json\n{"jobs": [{"title": "A {x}", "url": "u"}]}\n```', 'x [{"title": "B"}] y', '{"jobs": [{"title": "cut', "nothing", None]
    outputs = spark.createDataFrame([(str(i), r) for i, r in enumerate(raw)], "source_id string, raw string")
    assert sorted((r["source_id"], r["title"]) for r in search.agent_rows(outputs).collect()) == [("0", "A {x}"), ("1", "B")]
