"""What is dear to read is read once: reasons of rejection, texts that countries are looked for in, dates by the layouts that may fit."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.functions import dates, url
from snapledger.functions.text import once
from snapledger.operators import identity
from snapledger.sources import fetched, search


def test_rejections_read_pages_once(spark, monkeypatch):
    put, names = fetched.stored if hasattr(fetched, "stored") else None, []
    monkeypatch.setattr(fetched, "stored", lambda df, name: names.append(name) or put(df, name))
    rows = spark.createDataFrame([("b", "t", "x"), ("a", "t", "x"), ("c", "t", None)], "url string, title string, reject_reason string")
    assert [(r.reject_reason, r.pages, r.sample_1.url, r.sample_2.url, r.sample_3) for r in fetched.rejections(rows).collect()] == [("x", 2, "a", "b", None)]
    assert len(names) == 1


def test_countries_normalise_a_text_once(spark):
    place = spark.createDataFrame([("London; Paris",), ("nowhere",), (None,)], "place string")
    found = place.select("place", identity.detected_countries(F.col("place")).alias("codes"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert {r.place: r.codes for r in found.collect()} == {"London; Paris": ["FR", "GB"], "nowhere": [], None: []}


@pytest.mark.parametrize("layout", list(dates.LAYOUTS))
def test_every_layout_may_fit_what_it_writes(spark, layout):
    shown = spark.sql(f"SELECT date_format(timestamp'2026-05-04 01:02:03', \"{layout}\") AS s")
    for text in (F.col("s"), F.lower("s"), F.concat(F.lit(" "), "s", F.lit(" "))):
        want, got = shown.select(F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in dates.LAYOUTS)), dates.parse_time(text)).first()
        assert want == got
    assert shown.select(dates.parse_time(F.col("s"))).first()[0] is not None


def test_texts_that_no_layout_fits_are_not_tried(spark):
    assert isinstance(dates.LAYOUTS, dict)
    none = [signs for signs in dates.LAYOUTS.values() if spark.range(1).select(F.lit("").rlike(signs)).first()[0]]
    assert none == [] and spark.range(1).select(dates.parse_time(F.lit("soon"))).first()[0] is None


def test_plain_addresses_are_taken_apart_in_one_pass(spark):
    urls = [
        "https://Jobs.Example.com/7/8/?utm_source=A", "http://x.com:80/", "https://x.com:8443/a/?b=2&a=1=3&c&=5", "HTTP://X.com", "https://boards.greenhouse.io/a/jobs/1?gh_jid=3&q=1", "ftp://x.com/a", "https://x.com/a//?x=1#f",
        "https://x.com?ref=a", " https://x.com/a/b/ ",
    ]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url.canonical_url_plain(F.col("u")).alias("c"))
    assert {r.u: r.c for r in rows.collect()} == {u: url._canonical(u) for u in urls if u != urls[2]} | {urls[2]: "https://x.com:8443/a?=5&a=1=3&b=2&c="}
    assert "regexp_extract(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_prose_is_searched_for_dates_in_one_reading(spark):
    texts = ["Posted on 2026-05-04", "a 2026-05-04 b", "published: May 4, 2026", "3 weeks ago", "posted 2026-99-99", "today", "no yesterday\tat all", "todays", "a 12, 2026", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", search.posted_in_prose(F.col("x"), datetime(2026, 8, 22)).alias("t"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    day = datetime(2026, 5, 4)
    assert [r.t for r in rows.collect()] == [day, day, day, datetime(2026, 8, 1), None, datetime(2026, 8, 22), datetime(2026, 8, 21), None, None, None, None]


def test_a_page_reads_its_address_for_a_company_once(spark):
    pages = spark.createDataFrame([("https://jobs.lever.co/acme-labs/1", None, "## Backend Intern - Team at X\nLondon")], "url string, title string, text string")
    results = spark.createDataFrame([("https://jobs.lever.co/acme-labs/1", 1, "Result", "as found", "Acme Jobs")], "url string, position int, title string, snippet string, site_name string")
    found = fetched.fetched_postings(results, pages, datetime(2026, 8, 22))
    plan = found.select("title", "company", "posted_at")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") == 1
    assert (found.first().title, found.first().company, found.first().location) == ("Backend Intern", "Acme Labs", "London, United Kingdom")


def test_ends_are_stripped_as_a_pattern_would(spark):
    texts = [" a b\t", "\n-| a |-\r\n", "a \u0085", "a  ", " a ", "|", "", None, "--", "a\x0b\x0c"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    for signs in ("", "|-", "_-"):
        want = F.regexp_replace("x", f"^[\\s{signs}]+|[\\s{signs}]+$", "")
        assert rows.where(~fetched._strip(F.col("x"), signs).eqNullSafe(want)).count() == 0


def test_held_values_are_not_asked_for_their_type_at_every_row(spark):
    plan = spark.range(1).select(once(F.col("id") + 1, lambda x: x * x))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan
    assert spark.range(2).select(once(F.nullif("id", F.lit(0)), lambda x: F.coalesce(x * x, F.lit(-1)))).collect() == [(-1,), (1,)]
