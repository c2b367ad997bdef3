"""Linked boards read their pages in few Python steps, and sort them by shares."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.functions.html import unescaped
from snapledger.sources import hosted

BOARD = "source_id string, provider string, source_company string, url string, payload string, observed_at timestamp"


def _plan(spark, provider):
    boards = spark.createDataFrame([("a", provider, "", "https://x/acme", "", datetime(2026, 8, 22))], BOARD)
    pages = spark.createDataFrame([("https://x/acme/job/o1", "")], "url string, payload string")
    return hosted.postings(boards, pages, provider)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("provider", list(hosted.SITES))
def test_filters_do_not_repeat_what_python_reads(spark, provider):
    # one step for links (sitemaps have none), one for pages, one for their items
    assert _plan(spark, provider).count("ArrowEvalPython") == (2 if hosted.SITES[provider].sitemap else 3)


def test_links_are_decoded_and_joined_in_one_step(spark):
    refs = [
        "../a", "a&amp;b", "&#46;./x", "./", ".", "a/..", "x/...", "..?q", "..\n", "../y ", " ../y", "#f", "?p=1&amp;q", "//h/&amp;", "", None, "https://z/&amp;", ".. ", "&", "a&ampb/./c",
        " ..", "&nbsp;/../z",
    ]
    rows = spark.createDataFrame([(b, r) for r in refs for b in ("https://x/a/b/c?d#e", "", None)], "b string, r string")
    old = hosted.resolve(F.col("b"), unescaped(F.col("r")))
    new = hosted._absolute(F.col("b"), F.col("r"), F.col("read"))
    found = rows.withColumn("read", hosted._decoded_link(F.col("b"), F.col("r"))).select("b", "r", old.alias("old"), new.alias("new")).collect()
    assert [(r.b, r.r, r.new) for r in found] == [(r.b, r.r, r.old) for r in found]


@pytest.mark.parametrize("provider", list(hosted.SITES))
def test_pages_are_merged_by_shares_not_broadcast(spark, provider):
    plan = _plan(spark, provider)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan
