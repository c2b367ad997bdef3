"""Linked boards, paging, sitemap loops and strict seeds."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.functions import html
from snapledger.operators.identity import employment_of
from snapledger.sources import boards, hosted

NOW = datetime(2026, 8, 22)


def _boards(spark, *rows):
    return spark.createDataFrame([(*r, NOW) for r in rows], "source_id string, provider string, source_company string, url string, payload string, observed_at timestamp")


def test_a_board_that_is_a_posting_links_to_itself_and_bad_rows_give_nothing(spark):
    b = _boards(spark, ("a", "jobvite", "", "https://jobs.jobvite.com/acme/job/o1?x=1", None), ("b", "jobvite", "", "https://jobs.jobvite.com/acme/jobs", ""), ("c", "jobvite", "", None, '<a href="/acme/job/o2">x</a>'))
    assert [(r["source_id"], r["page_url"], r["id"]) for r in hosted.links(b, "jobvite").collect()] == [("a", "https://jobs.jobvite.com/acme/job/o1", "o1")]
    pages = spark.createDataFrame([("https://jobs.jobvite.com/acme/job/o1", "<p>no title</p>"), (None, None)], "url string, payload string")
    assert hosted.postings(b, pages, "jobvite").count() == 0


def test_frames_keep_the_query(spark):
    b = _boards(spark, ("a", "icims", "", "https://i/", "<urlset><url><loc> https://i/jobs/7/dev?z=1&amp;a=2#f </loc></url><url><loc>https://i/jobs/x/dev</loc></url></urlset>"))
    assert [(r["page_url"], r["id"]) for r in hosted.links(b, "icims").collect()] == [("https://i/jobs/7/dev?a=2&in_iframe=1&z=1", "7")]


def test_paging_and_short_sources(spark):
    pages = spark.createDataFrame([("full", 0, 2, 3), ("full", 1, 1, 3), ("short", 0, 2, 9), ("open", 0, 2, None), ("none", 0, 0, 0), ("over", 0, 5, 0)], "source_id string, page long, rows long, total long")
    assert {r["source_id"]: r["has_more"] for r in hosted.paging(pages, 2, 4).collect()} == {"full": False, "short": True, "open": True, "none": False, "over": True}
    payload = lambda total, n: json.dumps({"total": total, "jobPostings": [{}] * n})
    p = spark.createDataFrame([("a", "workday", payload(3, 2)), ("a", "workday", payload(3, 1)), ("b", "workday", payload(3, 2)), ("c", "lever", "[]")], "source_id string, provider string, payload string")
    found = spark.createDataFrame([("a",), ("b",)], "source_id string")
    assert {r["source_id"]: r["complete"] for r in boards.passes(p, found).collect()} == {"a": True, "b": False, "c": True}


def test_loops_of_sitemaps_end(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    docs = spark.createDataFrame([("h://a/i.xml", index("/j.xml", "/i.xml", "/gone.xml")), ("h://a/j.xml", index("i.xml", "m.xml")), ("h://a/m.xml", "<urlset><url><loc>/p</loc></url><url><loc>/p</loc></url></urlset>")], "url string, payload string")
    roots = spark.createDataFrame([("h://a/i.xml",), ("h://a/i.xml",), ("h://b",)], "url string")
    assert [tuple(r) for r in hosted.crawl_sitemaps(roots, docs).collect()] == [("h://a/i.xml", "h://a/p")]
    assert hosted.crawl_sitemaps(roots.limit(0), docs).count() == 0


@pytest.mark.parametrize("growth", [4, 0])
def test_a_chain_of_indexes_takes_few_rounds(spark, monkeypatch, growth):
    n, rounds, put = 12, [], hosted.stored
    monkeypatch.setattr(hosted, "stored", lambda df, name: rounds.append(name) or put(df, name))
    monkeypatch.setattr(hosted, "LEAP_GROWTH", growth)
    docs = [(f"h://a/{i}", f"<sitemapindex><sitemap><loc>/{i + 1 if i < n else 0}</loc></sitemap><sitemap><loc>/m{i}</loc></sitemap></sitemapindex>") for i in range(n + 1)]
    docs += [(f"h://a/m{i}", f"<urlset><url><loc>/p{i}</loc></url></urlset>") for i in range(n + 1)]
    roots = spark.createDataFrame([("h://a/0",), ("h://a/m3",)], "url string")
    found = hosted.crawl_sitemaps(roots, spark.createDataFrame(docs, "url string, payload string").coalesce(2))
    assert {tuple(r) for r in found.collect()} == {("h://a/0", f"h://a/p{i}") for i in range(n + 1)} | {("h://a/m3", "h://a/p3")}
    assert growth == 0 or len(rounds) < n + 1


@pytest.mark.parametrize(("candidates", "fault"), [
    ([{"id": "a", "name": "A", "tags": ["t-1"]}, {"id": "b", "name": "B", "website": "https://b"}], None),
    ([{"id": "A b", "name": "A"}], "invalid id"), ([{"id": "a", "name": " "}], "name is required"), ([{"id": "a", "name": "A", "website": "ftp://x"}], "invalid website"),
    ([{"id": "a", "name": "A"}, {"id": "a", "name": "B"}], "duplicate id"), ([{"id": "a", "name": "A", "tags": ["t", "t"]}], "duplicate tag"), ([{"id": "a", "name": "A", "more": 1}], "unknown field more"),
])
def test_seeds_are_read_strictly(spark, tmp_path, candidates, fault):
    (tmp_path / "s.json").write_text(json.dumps({"candidates": candidates}))
    rows = boards.read_seed(spark, str(tmp_path / "s.json"))
    if fault is None:
        assert [(r["id"], r["website"], r["tags"]) for r in rows.collect()] == [("a", "", ["t-1"]), ("b", "https://b", [])]
    else:
        with pytest.raises(Exception, match=fault):
            rows.collect()


def test_unknown_fields_inside_a_catalog_are_errors(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"companies": [{"id": "b", "name": "B", "sources": [{"id": "b-1", "provider": "lever", "url": "https://l", "odd": 1}]}]}))
    with pytest.raises(Exception, match="unknown field odd"):
        boards.read_catalog(spark, str(tmp_path / "c.json")).collect()


def test_attributes_segments_and_employment(spark):
    row = spark.createDataFrame([("<meta content='a &amp; b' name=\"og:title\"><p class=\"x jv\">in<hr>out", "New Grad, Contract", "")], "h string, t string, e string")
    got = row.select(html.meta_value(F.col("h"), "og:title"), html.class_segment(F.col("h"), "jv", "<hr"), html.class_segment(F.col("h"), "none", "<hr"), employment_of(F.col("t"), F.col("e")), employment_of(F.col("e"), F.col("e"))).first()
    assert tuple(got) == ("a & b", "in", "", "contract", "full_time")
