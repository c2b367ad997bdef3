import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.operators import fold
from snapledger.sources import boards
from snapledger.state.store import Conflict, StateStore
from snapledger.streaming import machines

NOW = datetime(2026, 8, 22)
PAYLOADS = {
    "greenhouse": {"jobs": [{"id": 7, "title": "Software  Intern", "updated_at": "2026-08-01T00:00:00Z", "location": {"name": ""}, "offices": [{"name": "HQ", "location": "Austin, TX"}], "absolute_url": "https://x/7", "content": "&lt;p&gt;hi&lt;/p&gt;"}]},
    "lever": [{"id": "L", "text": "Dev", "categories": {"location": "", "allLocations": ["Oslo", "Rome"], "commitment": "Intern"}, "country": "NO", "hostedUrl": "https://l/1", "createdAt": 1754000000000}],
    "ashby": {"jobs": [{"title": "A", "location": "NYC", "secondaryLocations": [{"location": "SF"}], "isListed": True, "jobUrl": "https://a/11"}, {"title": "B", "isListed": False, "jobUrl": "https://a/12"}]},
    "smartrecruiters": {"totalFound": 5, "content": [{"id": "S", "name": "Dev", "company": {"identifier": "acme", "name": "Acme"}, "location": {"city": "Berlin", "country": "de"}, "releasedDate": "2026-08-01"}]},
    "workable": {"name": "Acme", "jobs": [{"shortcode": "W", "title": "Dev", "state": "published", "url": "https://w/1", "location": {"city": "Paris", "country": "France"}}, {"shortcode": "X", "title": "Draft", "state": "draft", "url": "https://w/2"}]},
    "recruitee": {"offers": [{"id": 3, "title": "Dev", "careers_url": "https://r/3", "status": "published", "location": "Delft"}]},
    "comeet": [{"uid": "C", "name": "Dev", "url_active_page": "https://c/1", "location": {"city": "Tel Aviv", "country": "IL"}}, {"uid": "D", "name": "Secret", "is_internal": True, "url_active_page": "https://c/2"}],
    "bamboohr": {"result": [{"id": "5", "jobOpeningName": "Dev", "location": {"city": "Lima"}}]},
    "breezy": [{"id": "Z", "name": "Dev", "url": "https://z/1", "type": {"name": "Internship"}, "location": {"city": "Rome", "country": {"name": "Italy"}}}],
    "pinpoint": {"data": [{"id": "9", "title": "Dev", "url": "https://p/9", "location": {"name": "Leeds"}}]},
    "workable_jobs": {"nextPageToken": "t", "jobs": [{"id": "N", "title": "Co-op Dev", "url": "https://n/1", "company": {"title": "Net Co"}}]},
    "oracle_recruiting": {"items": [{"TotalJobsCount": 2, "requisitionList": [{"Id": "8", "Title": "Dev", "JobSchedule": "Part time", "LegalEmployer": "Ora"}]}]},
    "workday": {"total": 40, "jobPostings": [{"title": "Dev", "externalPath": "/job/1", "locationsText": "Remote", "bulletFields": ["R1"]}]},
}


def payloads(spark):
    rows = [(f"src-{p}", p, "", f"https://{p}.example/board" + "?siteNumber=CX.1" * (p == "oracle_recruiting"), json.dumps(body), NOW) for p, body in PAYLOADS.items()]
    rows.append(("src-personio", "personio", "Given", "https://per.example/", "<workzag-jobs><position><id>4</id><name>Dev</name><office>Bonn</office></position></workzag-jobs>", NOW))
    ld = '<script type="application/ld+json">[{"@type":"JobPosting","title":"Dev","url":"https://j/1"},{"@type":"JobPosting","title":"Old","url":"https://j/2","validThrough":"2020-01-01"}]</script>'
    rows.append(("src-jsonld", "jsonld", "Acme", "https://j/", ld, NOW))
    return spark.createDataFrame(rows, "source_id string, provider string, source_company string, url string, payload string, observed_at timestamp")


def test_every_provider_is_parsed(spark):
    got = {r["provider"]: r for r in boards.observations(payloads(spark), NOW).collect()}
    assert set(got) == {*boards.LAYOUTS, "jsonld"}
    assert (got["greenhouse"]["source_native_id"], got["greenhouse"]["title"], got["greenhouse"]["location"], got["greenhouse"]["description"], got["greenhouse"]["level"]) == ("greenhouse:7", "Software Intern", "Austin, TX", "hi", "internship")
    assert (got["lever"]["location"], got["lever"]["apply_url"], got["lever"]["posted_at"].year) == ("Oslo; Rome", "https://l/1", 2025)
    assert got["ashby"]["location"] == "NYC; SF" and got["smartrecruiters"]["apply_url"] == "https://jobs.smartrecruiters.com/acme/S" and got["smartrecruiters"]["country"] == "Germany"
    assert got["workday"]["apply_url"] == "https://workday.example/board/job/1" and got["bamboohr"]["apply_url"] == "https://bamboohr.example/board/5"
    assert (got["personio"]["company"], got["personio"]["location"], got["personio"]["apply_url"]) == ("Given", "Bonn", "https://per.example/job/4") and got["jsonld"]["title"] == "Dev"
    assert (got["workable_jobs"]["source_native_id"], got["workable_jobs"]["company"], got["workable_jobs"]["employment_type"]) == ("workable_jobs:net-co:N", "Net Co", "internship")
    oracle = got["oracle_recruiting"]
    assert (oracle["source_native_id"], oracle["employment_type"], oracle["company"]) == ("oracle_recruiting:cx-1:8", "part_time", "Ora")
    assert oracle["apply_url"] == "https://oracle_recruiting.example/hcmUI/CandidateExperience/en/sites/CX.1/job/8"


def test_unknown_providers_and_bad_payloads_fail(spark):
    bad = payloads(spark).limit(1).withColumn("provider", F.lit("nobody"))
    with pytest.raises(Exception, match="no route for provider"):
        boards.observations(bad, NOW).collect()
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        boards.observations(payloads(spark).where("provider = 'greenhouse'").withColumn("payload", F.lit("{broken")), NOW).collect()


def test_passes_details_and_sitemaps(spark):
    p = spark.createDataFrame([("a", "lever"), ("b", "jsonld"), ("c", "lever")], "source_id string, provider string")
    found = spark.createDataFrame([("c",)], "source_id string")
    assert {r["source_id"]: (r["complete"], r["failed"]) for r in boards.passes(p, found).collect()} == {"a": (True, False), "b": (False, True), "c": (True, False)}
    s = spark.createDataFrame([(1, "short", "x"), (2, "kept", "y")], "id int, title string, place string")
    d = spark.createDataFrame([(1, "long", " ")], "id int, title string, place string")
    assert sorted(map(tuple, boards.with_details(s, d, "id", ["title", "place"]).collect())) == [(1, "long", "x"), (2, "kept", "y")]
    maps = spark.createDataFrame([("i", '<sitemapindex xmlns="http://s"><sitemap><loc>http://a</loc></sitemap></sitemapindex>'), ("u", "<urlset><url><loc>http://b</loc></url></urlset>")], "url string, payload string")
    assert sorted(map(tuple, boards.sitemap_urls(maps).collect())) == [("i", "http://a", True), ("u", "http://b", False)]


def test_catalogs_are_read_strictly(spark, tmp_path):
    doc = {"companies": [{"id": "b", "name": "B", "sources": [{"id": "b-1", "provider": "lever", "url": "https://l"}]}, {"id": "a", "name": "A", "sources": [{"id": "a-2", "provider": "x", "url": "u"}, {"id": "a-1", "provider": "x", "url": "u"}]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert [r["source_id"] for r in boards.catalog_sources(boards.read_catalog(spark, str(tmp_path / "c.json"))).collect()] == ["a-1", "a-2", "b-1"]
    (tmp_path / "d.json").write_text(json.dumps(doc | {"more": 1}))
    with pytest.raises(Exception, match="unknown field more"):
        boards.read_catalog(spark, str(tmp_path / "d.json")).collect()


def test_commits_are_atomic_and_exclusive(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "v long")
    assert store.version() == 0 and store.read("a") is None
    store.commit({"a": rows(1), "b": rows(2)})
    pinned = store.version()
    store.commit({"a": rows(3)})
    assert [r["v"] for r in store.read("a").collect()] == [3] and [r["v"] for r in store.read("a", pinned).collect()] == [1] and [r["v"] for r in store.read("b").collect()] == [2]
    with pytest.raises(Conflict):
        store.commit({"a": rows(4)}, pinned)
    assert [r["v"] for r in store.read("a").collect()] == [3]
    store.append("log", rows(1))
    store.append("log", rows(2))
    assert sorted(r["v"] for r in store.read("log").collect()) == [1, 2]


def test_streams_equal_batch_folds(spark, tmp_path):
    attempts = spark.range(120).select(F.concat(F.lit("s"), F.col("id") % 5).alias("source_id"), F.col("id").alias("arrival"), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(500))).alias("at"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).alias("ok"))
    checks = spark.range(90).select(F.concat(F.lit("j"), F.col("id") % 7).alias("job_id"), F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, ("live", "gone", "unchecked"))), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int")).alias("outcome"), (F.col("id") % 17 == 0).alias("url_changed"))
    for name, df, stream, batch, columns in (("a", attempts, machines.source_health, fold.failure_streaks, ["source_id", "state", "consecutive_failures"]), ("c", checks, machines.link_health, fold.link_health, ["job_id", "state", "consecutive_gone"])):
        for k in range(3):  # three files, read one at a time
            df.where(F.col("arrival" if name == "a" else "seq").between(k * 40, k * 40 + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            source = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
            q = stream(source).writeStream.outputMode("update").foreachBatch(lambda b, i, name=name: b.withColumn("i", F.lit(i)).write.mode("append").parquet(str(tmp_path / f"{name}-out"))).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        out = spark.read.parquet(str(tmp_path / f"{name}-out"))
        last = out.groupBy(columns[0]).agg(*(F.max_by(c, "i").alias(c) for c in columns[1:]))
        assert sorted(map(tuple, last.select(*columns).collect())) == sorted(map(tuple, batch(df).select(*columns).collect()))


def test_ingest_folds_snapshots_once(spark, tmp_path):
    schema = "job_id string, source_id string, source_native_id string, company string, title string, location string, country string, employment_type string, level string, apply_url string, posted_at timestamp, observed_at timestamp, pass_complete boolean"
    row = lambda job, day, title="Software Engineer Intern", whole=True: (job, "cat-1", job, "Acme", title, "Austin, TX", "", "", "", f"https://x/{job}", None, datetime(2026, 8, day), whole)
    store = StateStore(spark, str(tmp_path / "state"))
    runs = ([row("a", 1), row("b", 1), row("c", 1, "Barista")], [row("a", 2)], [row("b", 3, whole=False)])
    want = [{"a": True, "b": True}, {"a": True, "b": False}, {"a": True, "b": False}]
    for rows, active in zip(runs, want, strict=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        machines.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, NOW, str(tmp_path / "cp")).start().awaitTermination()
        assert {r["job_id"]: r["active"] for r in store.read("provenance").collect()} == active
    assert [(r["code"], r["observation_count"]) for r in store.read("rejections").collect()] == [("role", 1)]
    before = store.version()
    machines.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, NOW, str(tmp_path / "cp")).start().awaitTermination()
    assert store.version() == before
