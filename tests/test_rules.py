import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.functions import classify, dates, html, text, url
from snapledger.operators import admission, identity

NOW = datetime(2026, 8, 22)


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_the_normalisers_differ(spark):
    odd = ["  Ünïted — Söft\tCo. ", "K(elvin)", "", "A&B"]
    assert column(spark, odd, text.canonical_text) == ["ünïted söft co", "k elvin", "", "a b"]
    assert column(spark, ["A-B c", "", "!!"], text.padded_text) == [" a b c ", " ", " "]
    assert column(spark, ["Kelvin A", "x  Y"], text.feed_text) == ["elvin a", "x y"]
    assert column(spark, ["Citadel Securities, LLC", "Citadelsecurities", "Inc", "Acme Co. Ltd", ""], text.company_key) == ["citadelsecurities", "citadelsecurities", "inc", "acme", ""]


def test_text_helpers(spark):
    assert column(spark, ["héllo", "abc", None], lambda c: text.truncate_bytes(c, 2)) == ["h", "ab", None]
    assert column(spark, ["x" * 80, "short"], text.ellipsis) == ["x" * 71 + "…", "short"]
    assert column(spark, [[" A", "a", "", "B "]], text.compact_list, "array<string>") == [["A", "B"]]
    assert column(spark, ["<a & 'b'>"], text.escape_html) == ["&lt;a &amp; &#39;b&#39;&gt;"]
    assert column(spark, ["a/b/senior-data_engineer/"], text.title_from_slug) == ["Senior Data Engineer"]


URLS = {
    "HTTPS://Jobs.Example.com:443/a/b/?utm_source=x&b=2&a=1#top": "https://jobs.example.com/a/b?a=1&b=2", "http://x.com": "http://x.com", "http://x.com/": "http://x.com",
    "http://x.com:8080//a/../b/": "http://x.com:8080//a/../b", "ftp://x.com/a": "", "https://user@x.com/a": "", "not a url": "", "": "",
    "https://boards.greenhouse.io/acme/jobs/1?gh_jid=1&gh_src=q": "https://job-boards.greenhouse.io/acme/jobs/1", "http://x.com/job?gh_jid=7": "http://x.com/job?gh_jid=7",
    "https://x.com/a%2fb%c3%a9?q=a%20b&ref=z": "https://x.com/a%2Fb%C3%A9?q=a+b", "https://x.com/a?b=2&b=1": "https://x.com/a?b=1&b=2", "https://x.com/%zz": "",
}


def test_canonical_urls(spark):
    assert column(spark, list(URLS), url.canonical_url) == list(URLS.values())


def test_sites(spark):
    df = spark.createDataFrame([("a.example.com", "example.com"), ("www.example.com", "example.com"), ("badexample.com", "example.com"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(url.same_site(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


POSTING = dict(company="Acme", title="Software Engineer Intern", location="New York, NY", country="", employment_type="", level="", apply_url="https://x.com/jobs/1", posted_at=None)
CASES = [
    ({}, None), ({"company": "Lockheed Martin Corp"}, "company"), ({"title": "WeChat Software Engineer Intern"}, "company"), ({"title": "Software Engineer Intern - Berlin"}, "geography"),
    ({"title": "Software Engineer Intern 2025"}, "stale"), ({"title": "Software Engineer Intern Summer 2026"}, "stale"), ({"title": "Software Engineer Intern Fall 2026"}, None),
    ({"posted_at": datetime(2026, 2, 22)}, "stale"), ({"posted_at": datetime(2026, 2, 23)}, None), ({"title": "Your guide to software engineer intern roles"}, "editorial"),
    ({"apply_url": "https://x.com/Blog/1"}, "editorial"), ({"location": "Lagos"}, "geography"), ({"location": "Berlin", "country": "US"}, "geography"), ({"location": "Remote", "title": "Software Engineer Intern, Austin"}, None),
    ({"location": "Springfield, IL"}, None), ({"location": "", "country": "SG"}, None), ({"title": "Defense Software Engineer Intern"}, "sector"), ({"title": "Software Engineer Hackathon Intern"}, "sector"),
    ({"company": "Palantir", "title": "Software Engineer Intel Intern"}, "sector"), ({"title": "Senior Software Engineer Intern"}, "role"), ({"title": "Staff Software Engineer Intern"}, "role"),
    ({"title": "Member of Technical Staff, New Grad"}, None), ({"title": "Data Analyst Intern"}, "role"), ({"title": "Quantitative Analyst Intern"}, None), ({"title": "Barista Intern"}, "role"),
    ({"title": "Research Scientist, NLP (New Grad)"}, None), ({"title": "GenAI Engineering Internship"}, None), ({"title": "Software Engineer"}, "career_stage"), ({"title": "Software Engineer", "level": "Entry Level"}, None),
    ({"title": "Software Engineer", "employment_type": "Experienced, early career"}, "career_stage"), ({"title": "Software Engineer", "employment_type": "Internship"}, None),
]


def test_admission_codes(spark):
    schema = "i int, " + ", ".join(f"{k} {'timestamp' if k == 'posted_at' else 'string'}" for k in POSTING)
    df = spark.createDataFrame([(i, *(POSTING | change).values()) for i, (change, _) in enumerate(CASES)], schema)
    got = [r["c"] for r in df.select("i", admission.rejection_code(NOW).alias("c")).orderBy("i").collect()]
    assert got == [code for _, code in CASES]


def test_dates(spark):
    given = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05+02:00", "2026-01-02", "January 2, 2026", "2 Jan 2026", "soon", ""]
    want = [datetime(2026, 1, 2, 3, 4, 5), datetime(2026, 1, 2, 1, 4, 5), *[datetime(2026, 1, 2)] * 3, None, None]
    assert column(spark, given, lambda c: dates.parse_time(c).cast("timestamp_ntz")) == want
    assert column(spark, ["Posted 3 weeks ago", "2 days ago", "posted yesterday", "never"], lambda c: dates.relative_time(c, NOW).cast("timestamp_ntz")) == [datetime(2026, 8, 1), datetime(2026, 8, 20), datetime(2026, 8, 21), None]
    assert column(spark, [1, 2, 3, 7, 8, 50], dates.retry_delay, "int") == [900, 1800, 3600, 57_600, 86_400, 86_400]
    assert column(spark, [1_700_000_000, 1_700_000_000_000, 0], lambda c: F.unix_timestamp(dates.epoch_time(c)), "long") == [1_700_000_000, 1_700_000_000, None]


def test_classes(spark):
    assert column(spark, ["Quant Trader", "AI Engineer", "Data Engineer", "Linux Engineer", "Web Developer"], classify.category) == ["quant", "ai_ml", "data", "infra_security", "software"]
    assert column(spark, ["https://x.com/acme-university", "https://x.com/acme/new_grad/", "https://x.com/acme"], classify.early_career_scope) == [True, True, False]
    assert column(spark, ["New York; London", "Tokyo", "Mars"], lambda c: identity.place_marker(identity.detected_countries(c))) == ["🌐", "🇯🇵", "📍"]
    got = column(spark, ["https://boards-api.greenhouse.io/v1/boards/Acme/jobs", "https://api.lever.co/v0/postings/foo", "https://evil-lever.co/x"], lambda c: identity.route_of(c)["board"])
    assert got == ["https://job-boards.greenhouse.io/acme", "https://jobs.lever.co/foo", None]


def test_html_and_jsonld(spark):
    page = '<script type="application/ld+json">{"@graph":[{"@type":["JobPosting"],"title":"Dev","hiringOrganization":{"name":"Acme"},"jobLocation":{"address":{"addressLocality":"Oslo","addressCountry":{"name":"NO"}}}}]}</script><script type="application/ld+json">broken</script>'
    got = column(spark, [page, "", None], html.jsonld_postings)
    assert got[0][0].asDict() | {} == {"native_id": "", "title": "Dev", "company": "Acme", "location": "Oslo, NO", "country": "NO", "employment_type": "", "posted": "", "valid_through": "", "url": "", "description": ""}
    assert got[1:] == [[], []]
    assert column(spark, ["<p>a &lt;b&gt; &amp; c</p>"], html.clean_html) == ["a & c"]


@pytest.mark.parametrize("replay", [False, True])
def test_identity_collisions(spark, replay):
    t = [datetime(2026, 1, d) for d in range(1, 20)]
    U = "https://x.com/jobs"
    rows = [
        (1, "cat-a", "1", "Acme", "Dev", U, 10, t[0]), (2, "cat-a", "2", "Acme", "Dev", U, 10, t[1]),  # one source, generic URL: apart
        (3, "cat-b", "9", "Acme Inc.", "Dev", "https://y.com/1", 10, t[2]), (4, "auto-c", "5", "ACME", "Dev", "https://y.com/1", 20, t[3]),  # other source, same URL: together
        (5, "cat-b", "9", "Renamed", "Dev", "https://y.com/1", 10, t[4]),  # native id outlives the company's name
        (6, "cat-d", "1", "Other", "Dev", U, 10, t[5]),  # another company: apart
        (7, "cat-e", "", "Solo", "Dev", "", 10, t[6]), (8, "cat-f", "", "Solo", "Dev", "", 10, t[7]),  # weak key: together
        (9, "cat-g", "x", "", "Dev", U, 10, t[8]),
    ]
    df = spark.createDataFrame(rows, "seq long, source_id string, source_native_id string, company string, title string, apply_url string, authority int, observed_at timestamp").withColumn("location", F.lit("NY"))
    got = {r["seq"]: r["job_id"] for r in identity.resolve(df.repartition(3), url.canonical_url_plain(F.col("apply_url")), ["observed_at", "seq"], replay).collect()}
    assert got[1] != got[2] and got[3] == got[4] == got[5] and got[6] not in (got[1], got[2]) and got[7] == got[8] and got[9] is None
    assert len({got[i] for i in (1, 2, 3, 6, 7)}) == 5


@pytest.mark.parametrize("replay", [False, True])
def test_a_company_is_split_without_changing_its_jobs(spark, replay, monkeypatch):
    rnd = random.Random(7)
    rows = [
        (i, f"s{rnd.randrange(6)}", rnd.choice(["", str(rnd.randrange(60))]), rnd.choice(["Acme", "Acme", "Acme Inc.", "Other", ""]), "Dev", f"https://x.com/{rnd.randrange(150)}", rnd.randrange(3), datetime(2026, 1, 1 + i // 20))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "seq long, source_id string, source_native_id string, company string, title string, apply_url string, authority int, observed_at timestamp").withColumn("location", F.lit("NY"))
    canonical = url.canonical_url_plain(F.col("apply_url"))
    monkeypatch.setattr(identity, "TASK_ROWS", 50)
    df = df.withColumn("job_id", F.lit("clash"))
    out = identity.resolve(df.repartition(3), canonical, ["observed_at", "seq"], replay)
    keyed = df.withColumn("keys", identity.identity_keys(canonical)).where("keys IS NOT NULL").withColumn("company_id", identity.company_key(F.col("company")))
    keyed = identity.blocks(keyed.withColumn("native", F.when(F.element_at("keys", 1).startswith("native:"), F.element_at("keys", 1))))
    want = {r[0]: None for r in rows}
    for _, block in keyed.toPandas().sort_values(["observed_at", "seq"]).groupby("block"):
        want |= dict(zip(block["seq"], identity._resolve_block(block, replay), strict=True))
    assert out.columns == [*df.columns, "keys"] and {r["seq"]: r["job_id"] for r in out.collect()} == want
    sizes = identity.chains(keyed).groupBy("block", "chain").count().toPandas()
    assert sizes.groupby("block")["count"].sum().max() > 3 * sizes["count"].max()
