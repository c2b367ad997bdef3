"""Pages of the feed: gone links, hidden companies, totals, updates and cached bodies."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.operators import feed
from snapledger.plans import feed_queries

BODY = "id string, body struct<company:string>"


def groups(spark, n):
    rows = spark.range(n).selectExpr("cast(id AS string) AS id", "concat('c', id % 3) AS company", "'t' AS title", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id AS int)) AS first_seen_at")
    return rows.withColumn("_order", F.struct((-F.unix_micros(F.col("first_seen_at").cast("timestamp"))).alias("t"), "company", "title", "id"))


def test_links_that_are_gone_and_hidden_companies_leave(spark):
    jobs = spark.createDataFrame([("a", " Acme ", "gone"), ("b", "ACME", "live"), ("c", None, None), ("d", "Other", "unchecked"), ("e", "Other", "live")], "id string, company string, link_state string")
    shown = feed.shown_links(jobs)
    assert sorted(r.id for r in shown.collect()) == ["b", "c", "d", "e"]
    hidden = spark.createDataFrame([("acme",), ("acme ",), (None,)], "company string")
    ids = spark.createDataFrame([("e",), (None,)], "id string")
    assert sorted(r.id for r in feed.without_hidden(shown, hidden, ids).collect()) == ["c", "d"]
    assert feed.without_hidden(shown, hidden.limit(0)).count() == 4


@pytest.mark.parametrize("sort", ["recent", "company"])
def test_the_total_is_that_before_the_limit(spark, sort):
    rows = feed.numbered_page(groups(spark, 10), sort, 4).orderBy("position").collect()
    want = sorted(range(10), key=lambda i: (-i, i) if sort == "recent" else (i % 3, -i))[:4]
    assert [(r.position, int(r.id), r.total) for r in rows] == [(k + 1, i, 10) for k, i in enumerate(want)]
    assert feed.numbered_page(groups(spark, 0), sort, 4).collect() == []


def test_updates_bring_new_bodies_and_all_ids_in_order(spark):
    update = feed.page_update(feed.numbered_page(groups(spark, 6), "recent", 5), datetime(2024, 1, 5))
    rows = {r.id: r.body for r in update.collect()}
    assert {k for k, b in rows.items() if b is not None} == {"4", "5"} and rows["5"].company == "c2"
    assert feed.active_ids(update).first().active_ids == ["5", "4", "3", "2", "1"]
    assert feed.active_ids(update.limit(0)).first().active_ids == []


def test_a_cache_that_lacks_one_row_is_reloaded_as_a_whole(spark):
    update = spark.createDataFrame([(1, "n", ("new",)), (2, "o", None)], "position long, " + BODY)
    full = spark.createDataFrame([(1, "n", ("new",)), (2, "o", ("full",))], "position long, " + BODY)
    cache = lambda *rows: spark.createDataFrame(list(rows), BODY)
    out = lambda c: [(r.position, r.id, r.body.company, r.reloaded) for r in feed.from_cache(c, update, full).orderBy("position").collect()]
    assert out(cache(("o", ("old",)), ("n", ("stale",)), ("gone", ("x",)))) == [(1, "n", "new", False), (2, "o", "old", False)]
    assert out(cache(("n", ("stale",)))) == [(1, "n", "new", True), (2, "o", "full", True)]
    assert out(cache()) == [(1, "n", "new", True), (2, "o", "full", True)]
    assert feed.from_cache(cache(), update.limit(0), full).collect() == []


def test_counts_of_sources(spark):
    opened = spark.createDataFrame([("g", "k", datetime(2024, 1, 2), datetime(2024, 1, 3))], "group_key string, company_key string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    status = spark.createDataFrame([("a", "success"), ("b", "failure"), ("c", "pending"), ("d", None)], "source_id string, state string")
    counts = lambda s, n=0: tuple(feed.summary_with_sources(opened, datetime(2024, 1, 2), s, n).first()[k] for k in ("sources_healthy", "sources_failed", "sources_total"))
    assert counts(status) == (1, 1, 4) and counts(status, 9) == (1, 1, 9) and counts(status.limit(0)) == (0, 0, 0)


def test_a_lost_cache_is_reloaded_whatever_the_dates_of_the_page(spark, monkeypatch):
    page = feed.numbered_page(groups(spark, 6), "recent", 5)
    monkeypatch.setattr(feed_queries, "_page", lambda spark, sf_dir: page)
    assert [(r.position, r.id, r.company, r.reloaded) for r in feed_queries.feed_reloaded(spark, "").orderBy("position").collect()] == [(k + 1, str(5 - k), f"c{(5 - k) % 3}", True) for k in range(5)]
    assert not any(r.reloaded for r in feed_queries.feed_from_cache(spark, "").collect())
