"""Boards, sitemaps and pages made of the driver's part table, read by the sources; the SQL says what must come out.

A board shows 50 parts. Titles have loose spaces; every third is an internship; some are blank, unlisted or out of date.
"""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import functions as F

from snapledger.plans import domain as D
from snapledger.sources import boards, hosted

NOW = datetime(2026, 8, 20)
BOARD = 50
_ID = "cast(p_partkey AS string)"
_FIELDS = f"""p_partkey AS k, {_ID} AS id, cast(p_partkey div {BOARD} AS string) AS board,
    CASE WHEN p_partkey % 25 = 7 THEN '  ' WHEN p_partkey % 3 = 0 THEN concat('  ', p_name, '  Intern ') ELSE concat(p_name, ' ') END AS title,
    CASE p_partkey % 4 WHEN 0 THEN 'Contract role' WHEN 1 THEN '' WHEN 2 THEN 'Full-time' ELSE 'Part Time' END AS kind, concat('2026-08-', lpad(cast(1 + p_partkey % 28 AS string), 2, '0')) AS day,
    concat('&lt;b&gt;Fine&lt;/b&gt;  work &amp; ', {_ID}) AS text, concat('https://x.example/', {_ID}) AS link, p_partkey % 10 = 9 AS hidden"""

# what a posting of each provider looks like, and what holds the postings of a board
_ITEMS = {
    "greenhouse": ("k AS id, title, day AS updated_at, named_struct('name', IF(k % 2 = 0, '', ' Zug ')) AS location, link AS absolute_url, text AS content, array(named_struct('name', 'HQ', 'location', 'Arica'), named_struct('name', 'Lab', 'location', '')) AS offices", "jobs"),
    "lever": ("id, title AS text, named_struct('location', IF(k % 2 = 0, '', 'Zug'), 'commitment', kind, 'allLocations', array('Arica', 'Lab')) AS categories, 'Chile' AS country, text AS description, link AS hostedUrl, IF(k % 5 = 0, concat(link, '/apply'), '') AS applyUrl,"
              " unix_seconds(to_timestamp(concat(day, 'T12:00:00Z'))) * IF(k % 2 = 0, 1000, 1) AS createdAt", ""),
    "ashby": ("IF(k % 2 = 0, '', id) AS id, title, 'Zug' AS location, array(named_struct('location', 'Arica'), named_struct('location', 'Zug')) AS secondaryLocations, NOT hidden AS isListed, concat('Fine  work ', id) AS descriptionPlain, day AS publishedAt, kind AS employmentType, link AS jobUrl", "jobs"),
    "smartrecruiters": ("id, title AS name, day AS releasedDate, named_struct('identifier', concat('b', board), 'name', 'Board  Co') AS company, named_struct('city', 'Arica', 'region', '', 'country', 'chile') AS location, named_struct('label', kind) AS typeOfEmployment, named_struct('label', 'Senior') AS experienceLevel", "content"),
    "workable": ("id AS shortcode, title, IF(hidden, 'draft', 'published') AS state, text AS description, link AS url, kind AS employment_type, named_struct('location_str', IF(k % 2 = 0, '', 'Zug'), 'country', 'Chile', 'city', 'Arica', 'region', '') AS location, day AS published_on", "jobs"),
    "recruitee": ("k AS id, title, IF(hidden, 'draft', 'Published') AS status, link AS careers_url, text AS description, 'More' AS requirements, 'Zug' AS location, day AS created_at, kind AS employment_type", "offers"),
    "comeet": ("id AS uid, title AS name, 'Board  Co' AS company_name, kind AS employment_type, 'Senior' AS experience_level, link AS position_url, day AS time_updated, hidden AS is_internal, named_struct('name', '', 'country', 'Chile', 'city', 'Arica', 'state', '') AS location", ""),
    "bamboohr": ("id, title AS jobOpeningName, kind AS employmentStatusLabel, named_struct('city', IF(k % 2 = 0, '', 'Zug'), 'state', 'X') AS location, named_struct('country', 'Chile', 'city', 'Arica', 'state', 'Y') AS atsLocation", "result"),
    "breezy": ("id, title AS name, link AS url, day AS published_date, named_struct('name', kind) AS type, named_struct('name', IF(k % 2 = 0, '', 'Zug'), 'city', 'Arica', 'country', named_struct('name', 'Chile')) AS location, named_struct('name', 'Board  Co') AS company, text AS description", ""),
    "pinpoint": ("id, title, link AS url, kind AS employment_type_text, named_struct('name', IF(k % 2 = 0, '', 'Zug'), 'city', 'Arica') AS location, text AS description, 'More' AS key_responsibilities", "data"),
    "workday": ("title, concat('/job/', id) AS externalPath, 'Zug' AS locationsText, IF(k % 2 = 0, array(), array(concat('R', id))) AS bulletFields", "jobPostings"),
    "workable_jobs": ("id, title, IF(k % 2 = 0 OR trim(title) = '', '', concat('Lead ', title)) AS full_title, IF(hidden, 'draft', '') AS state, text AS description, link AS url, kind AS worktype, named_struct('location_str', 'Zug') AS location, day AS created, named_struct('id', IF(k % 2 = 0, '', 'c1'), 'title', 'Net  Co') AS company", "jobs"),
    "oracle_recruiting": ("id AS Id, title AS Title, day AS PostedDate, 'Chile' AS PrimaryLocationCountry, 'Zug' AS PrimaryLocation, text AS ShortDescriptionStr, kind AS WorkerType, '' AS LegalEmployer, 'Org' AS Organization", "requisitionList"),
}


def _parts(spark, sf_dir):
    return D.table(spark, sf_dir, "part").selectExpr(*[f.strip() for f in _split(_FIELDS)])


def _split(fields: str) -> list[str]:
    """The select list at its outer commas."""
    out, depth, quoted = [""], 0, False
    for c in fields:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


def _payloads(spark, sf_dir, provider):
    item, holder = _ITEMS[provider]
    rows = _parts(spark, sf_dir).select("board", F.struct(*(F.expr(x) for x in _split(item))).alias("item"))
    found = rows.groupBy("board").agg(F.collect_list("item").alias("items"))
    body = F.to_json("items")
    if provider == "oracle_recruiting":
        body = F.to_json(F.struct(F.array(F.struct(F.lit(60).alias("TotalJobsCount"), F.col("items").alias(holder))).alias("items")))
    elif holder:
        totals = {"smartrecruiters": [F.lit(60).alias("totalFound")], "workday": [F.size("items").alias("total")]}.get(provider, [])
        body = F.to_json(F.struct(*totals, F.col("items").alias(holder)))
    return _sources(found.withColumn("payload", body), provider)


def _sources(rows, provider):
    """Boards of even number belong to a company of their own."""
    url = {"oracle_recruiting": "https://o.example/hcmUI/CandidateExperience/fr/sites/CX_", "jobvite": "https://jobs.jobvite.com/acme-", "teamtailor": "https://acme.teamtailor.com/jobs?b="}.get(provider, "https://b.example/")
    end = "/jobs" if provider == "jobvite" else ""
    even = F.col("board").cast("bigint") % 2 == 0
    return rows.select(
        F.concat(F.lit("s"), "board").alias("source_id"), F.lit(provider).alias("provider"), F.when(even, F.concat(F.lit("Own "), "board")).otherwise("").alias("source_company"),
        F.concat(F.lit(url), "board", F.lit(end)).alias("url"), "payload", F.lit(NOW).alias("observed_at"),
    )


def _shown(rows):
    posted = F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit(""))
    return rows.select("source_id", "source_native_id", "company", "title", "location", "country", "employment_type", "level", "apply_url", posted.alias("posted"), "description")


def board(spark, sf_dir, provider):
    return _shown(boards.observations(_payloads(spark, sf_dir, provider), NOW, (provider,)))


def board_personio(spark, sf_dir):
    tag = lambda name, value: f"'<{name}>', {value}, '</{name}>'"
    item = f"concat('<position>', {tag('id', 'id')}, {tag('office', repr('Zug'))}, {tag('name', 'title')}, {tag('schedule', 'kind')}, {tag('createdAt', 'day')}, {tag('seniority', repr('Senior'))}, '</position>')"
    rows = _parts(spark, sf_dir).selectExpr("board", f"{item} AS item").groupBy("board").agg(F.concat(F.lit("<workzag-jobs>"), F.array_join(F.collect_list("item"), ""), F.lit("</workzag-jobs>")).alias("payload"))
    return _shown(boards.observations(_sources(rows, "personio"), NOW, ("personio",)))


#: Each part's page: its posting as JSON-LD, out of date for every sixth, relative to the page for every fifth.
_LD = """concat('<html><script type="application/ld+json">', to_json(named_struct('@graph', array(named_struct('@type', 'JobPosting', 'title', title, 'url', IF(k % 5 = 0, '', link), 'hiringOrganization', named_struct('name', 'Ld Co'),
    'jobLocation', named_struct('address', named_struct('addressLocality', 'Arica', 'addressCountry', 'Chile')), 'employmentType', kind, 'datePosted', IF(k % 2 = 0, '', day), 'validThrough', IF(k % 6 = 0, '2020-01-01', '2030-01-01'), 'description', text)))), '</script></html>')"""


def board_jsonld(spark, sf_dir):
    rows = _sources(_parts(spark, sf_dir).selectExpr("id AS board", f"{_LD} AS payload"), "jsonld")
    return _shown(boards.observations(rows, NOW, ()))


def _hosted(spark, sf_dir, provider, link, page_url, page, payload):
    parts = _parts(spark, sf_dir)
    held = parts.selectExpr("board", f"{link} AS l").groupBy("board").agg(F.array_join(F.collect_list("l"), "").alias("ls"))
    pages = parts.where("NOT hidden").selectExpr(f"{page_url} AS url", f"{page} AS payload")
    return _shown(hosted.postings(_sources(held.selectExpr("board", f"{payload} AS payload"), provider), pages, provider))


def board_icims(spark, sf_dir):
    loc = "'https://i.example/jobs/', id, '/x/job'"
    return _hosted(
        spark, sf_dir, "icims", f"concat('<url><loc>', {loc}, '</loc><lastmod>2026-07-01</lastmod></url><url><loc>https://i.example/about</loc></url>')", f"concat({loc}, '?in_iframe=1')",
        f"concat({_LD}, IF(k % 4 = 1, '<a class=\"b\" href=\"?mode=apply&amp;apply=yes\">Apply</a>', ''))", "concat('<urlset xmlns=\"http://s\">', ls, '</urlset>')",
    )


def board_jobvite(spark, sf_dir):
    plain = """concat('<h2 class="x jv-header">', title, '</h2><p class="jv-job-detail-meta">Sales <br> Zug</p><hr/><div class="jv-job-detail-description"><p>Plain &amp; ', id, '</p></div><div class="job-description-meta"><ul><li><strong>Employment Type</strong> ', kind, '</li></ul></div>',
        '<script>function getCompanyName() { return "Vite &amp; Co"; }</script><a href="./', id, '/apply">go</a>')"""
    return _hosted(
        spark, sf_dir, "jobvite", "concat('<a href=\"/acme-', board, '/job/o', id, '?x=1\">x</a><a href=\"/ACME-', board, '/JOB/O', id, '\">again</a><a href=\"/other/job/o', id, '\">not ours</a>')",
        "concat('https://jobs.jobvite.com/acme-', board, '/job/o', id)", f"IF(k % 2 = 0, {_LD}, {plain})", "ls",
    )


def board_teamtailor(spark, sf_dir):
    return _hosted(
        spark, sf_dir, "teamtailor", "concat('<a href=\"jobs/', id, '-slug#top\">x</a><a href=\"/people\">p</a>')", "concat('https://acme.teamtailor.com/jobs/', id, '-slug')",
        f"concat({_LD}, IF(k % 4 = 1, '<i data-careersite--jobs--form-overlay-job-application-url-value=\"/go?a=1&amp;b=2\">', ''))", "ls",
    )


def result_paging(spark, sf_dir):
    pages = D.table(spark, sf_dir, "orders").selectExpr("o_custkey AS source_id", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page", "CASE WHEN o_orderkey % 3 = 0 THEN 20 ELSE 20 - o_custkey % 4 END AS rows", "CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 200 ELSE 100 END AS total")
    return hosted.paging(pages, 20, 150)


def source_passes(spark, sf_dir):
    p = _payloads(spark, sf_dir, "smartrecruiters").unionByName(_payloads(spark, sf_dir, "workday").withColumn("source_id", F.concat(F.lit("w"), "source_id")))
    return boards.passes(p, boards.observations(p, NOW, ("smartrecruiters", "workday")))


def sitemap_crawl(spark, sf_dir):
    """Index documents over boards, each naming the next index (the last the first) and the maps of its boards."""
    parts = _parts(spark, sf_dir)
    maps = parts.selectExpr("board", "concat('<url><loc>', link, '</loc></url>') AS l").groupBy("board").agg(F.array_join(F.collect_list("l"), "").alias("ls"))
    last = maps.agg((F.max(F.col("board").cast("bigint")) / 10).cast("bigint").alias("z"))
    index = maps.selectExpr("cast(board AS bigint) div 10 AS i", "concat('<sitemap><loc>/map/', board, '.xml</loc></sitemap>') AS l").groupBy("i").agg(F.array_join(F.collect_list("l"), "").alias("ls")).join(last, F.lit(True))
    index = index.selectExpr("concat('https://m.example/index/', i, '.xml') AS url", "concat('<sitemapindex xmlns=\"http://s\"><sitemap><loc>', IF(i = z, 0, i + 1), '.xml</loc></sitemap>', ls, '</sitemapindex>') AS payload")
    documents = maps.selectExpr("concat('https://m.example/map/', board, '.xml') AS url", "concat('<urlset>', ls, '</urlset>') AS payload").unionByName(index)
    roots = spark.createDataFrame([("https://m.example/index/0.xml",), ("https://m.example/map/1.xml",), ("https://m.example/none.xml",)], "url string")
    return hosted.crawl_sitemaps(roots, documents)


def job_like_urls(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ("/jobs/1", "/blog/jobs/1", "/Careers/x", "/about", "/Opportunities", "/legal/position/2", ""))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return D.table(spark, sf_dir, "part").select("p_partkey", hosted.job_like(F.concat(F.lit("https://x.example"), path)).alias("job_like"))


def resolved_links(spark, sf_dir):
    refs = ("https://y/z", "//y/z", "/z?q", "?p=1", "#f", "z/w", "../z", "./z", "", "../../../z")
    ref = F.element_at(F.array(*map(F.lit, refs)), (F.col("p_partkey") % len(refs) + 1).cast("int"))
    return D.table(spark, sf_dir, "part").select("p_partkey", hosted.resolve(F.concat(F.lit("https://x/a/b"), "p_partkey", F.lit("/c?d#e")), ref).alias("url"))


def search_feed_urls(spark, sf_dir):
    specs = D.table(spark, sf_dir, "part").selectExpr("concat('m', p_partkey) AS id", "concat('site:x.com (\"', p_name, '\" OR a*b~c) ü&=+') AS query", "CASE WHEN p_partkey % 2 = 0 THEN 'New York' ELSE '' END AS location")
    return hosted.search_feeds(specs, "search")


QUERIES = {
    **{f"board_{p}": functools.partial(board, provider=p) for p in _ITEMS},
    **{f.__name__: f for f in (board_personio, board_jsonld, board_icims, board_jobvite, board_teamtailor, result_paging, source_passes, sitemap_crawl, job_like_urls, resolved_links, search_feed_urls)},
}

_P = f"""p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_partkey // {BOARD} AS board, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Intern' ELSE '' END AS title, 'https://x.example/' || p_partkey AS link,
    (['Contract role', '', 'Full-time', 'Part Time'])[p_partkey % 4 + 1] AS kind, '2026-08-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') AS day, 'Fine work & ' || p_partkey AS text FROM part WHERE p_partkey % 25 <> 7)"""
_KIND = "CASE WHEN k % 3 = 0 THEN 'internship' WHEN k % 4 = 0 THEN 'contract' WHEN k % 4 = 1 THEN 'full_time' ELSE kind END"
_OWN = lambda other: f"CASE WHEN board % 2 = 0 THEN 'Own ' || board ELSE {other} END"
_LISTED = "k % 10 <> 9"
_EVEN = lambda a, b: f"CASE WHEN k % 2 = 0 THEN {a} ELSE {b} END"


def _expected(native, location, company="''", title="title", country="'Chile'", kind=_KIND, level="CASE WHEN k % 3 = 0 THEN 'internship' ELSE 'unknown' END", url="link", posted="day", text="text", where="true", network=False):
    return f"""WITH {_P} SELECT 's' || board AS source_id, {native} AS source_native_id, {company if network else _OWN(company)} AS company, {title} AS title, {location} AS location, {country} AS country, {kind} AS employment_type,
        {level} AS level, {url} AS apply_url, {posted} AS posted, {text} AS description FROM p WHERE {where}"""


_LD_POSTED = _EVEN("''", "day")
_LD_URL = lambda page: f"CASE WHEN k % 5 = 0 THEN {page} ELSE link END"
_VITE = "'https://jobs.jobvite.com/acme-' || board || '/job/'"
_PLACE = _EVEN("'Arica'", "'Zug'")
ORACLE = {
    "board_greenhouse": _expected("'greenhouse:' || id", _EVEN("'Arica; Lab'", "'Zug'"), country="'unknown'", kind="CASE WHEN k % 3 = 0 THEN 'internship' ELSE 'full_time' END"),
    "board_lever": _expected("'lever:' || id", _EVEN("'Arica; Lab'", "'Zug'"), kind="kind", url="link || CASE WHEN k % 5 = 0 THEN '/apply' ELSE '' END"),
    "board_ashby": _expected("'ashby:' || id", "'Zug; Arica'", country="'unknown'", kind="kind", text="'Fine work ' || id", where=_LISTED),
    "board_smartrecruiters": _expected("'smartrecruiters:' || id", "'Arica, CHILE'", "'Board Co'", country="'chile'", kind="CASE WHEN k % 3 = 0 THEN 'internship' WHEN k % 4 = 0 THEN 'contract' WHEN k % 4 = 1 THEN 'Senior' ELSE kind END", level="'Senior'", url="'https://jobs.smartrecruiters.com/b' || board || '/' || id", text="''"),
    "board_workable": _expected("'workable:' || id", _EVEN("'Arica, Chile'", "'Zug'"), where=_LISTED),
    "board_recruitee": _expected("'recruitee:' || id", "'Zug'", country="'unknown'", text="text || ' More'", where=_LISTED),
    "board_comeet": _expected("'comeet:' || id", "'Arica, Chile'", "'Board Co'", level="'Senior'", text="''", where=_LISTED),
    "board_bamboohr": _expected("'bamboohr:' || id", _EVEN("'Arica, X'", "'Zug, X'"), url="'https://b.example/' || board || '/' || id", posted="''", text="''"),
    "board_breezy": _expected("'breezy:' || id", _EVEN("'Arica, Chile'", "'Zug'"), "'Board Co'"),
    "board_pinpoint": _expected("'pinpoint:' || id", _PLACE, country="'unknown'", posted="''", text="text || ' More'"),
    "board_workday": _expected("'workday:' || " + _EVEN("'/job/' || id", "'R' || id"), "'Zug'", country="'unknown'", kind="CASE WHEN k % 3 = 0 THEN 'internship' ELSE 'full_time' END", url="'https://b.example/' || board || '/job/' || id", posted="''", text="''"),
    "board_workable_jobs": _expected("'workable_jobs:' || " + _EVEN("'net--co'", "'c1'") + " || ':' || id", "'Zug'", "'Net Co'", title=_EVEN("title", "'Lead ' || title"), country="'unknown'", where=_LISTED, network=True),
    "board_oracle_recruiting": _expected("'oracle_recruiting:cx-' || board || ':' || id", "'Zug'", "'Org'", kind="CASE WHEN k % 3 = 0 THEN 'internship' ELSE (['contract', 'full_time', 'full_time', 'part_time'])[k % 4 + 1] END", url="'https://o.example/hcmUI/CandidateExperience/fr/sites/CX_' || board || '/job/' || id"),
    "board_personio": _expected("'personio:' || id", "'Zug'", country="'unknown'", level="'Senior'", url="'https://b.example/' || board || '/job/' || id", text="''"),
    "board_jsonld": _expected("''", "'Arica, Chile'", "'Ld Co'", kind="kind", url=_LD_URL("'https://b.example/' || id"), posted=_LD_POSTED, where="k % 6 <> 0").replace("'s' || board", "'s' || k").replace("board % 2", "k % 2").replace("'Own ' || board", "'Own ' || k"),
    "board_icims": _expected("'icims:' || id", "'Arica, Chile'", "'Ld Co'", kind="lower(kind)", posted=_EVEN("'2026-07-01'", "day"), where=_LISTED,
                             url=f"CASE WHEN k % 4 = 1 THEN 'https://i.example/jobs/' || id || '/x/job?mode=apply&apply=yes' ELSE {_LD_URL(chr(39) + 'https://i.example/jobs/' + chr(39) + ' || id || ' + chr(39) + '/x/job' + chr(39))} END"),
    "board_jobvite": _expected("'jobvite:acme-' || board || ':o' || id", _EVEN("'Arica, Chile'", "'Sales Zug'"), _EVEN("'Ld Co'", "'Vite & Co'"), country=_EVEN("'Chile'", "'unknown'"), kind=_EVEN("lower(kind)", f"lower({_KIND})"),
                               url=_EVEN(_LD_URL(f"{_VITE} || 'o' || id"), f"{_VITE} || id || '/apply'"), posted="''", text=_EVEN("text", "'Plain & ' || id"), where=_LISTED),
    "board_teamtailor": _expected("'teamtailor:acme:' || id", "'Arica, Chile'", "'Ld Co'", kind="lower(kind)", posted=_LD_POSTED, where=_LISTED,
                                  url="CASE WHEN k % 4 = 1 THEN 'https://acme.teamtailor.com/go?a=1&b=2' ELSE 'https://acme.teamtailor.com/jobs/' || id || '-slug/applications/new' END"),
    "result_paging": """WITH r AS (SELECT o_custkey AS source_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, CASE WHEN o_orderkey % 3 = 0 THEN 20 ELSE 20 - o_custkey % 4 END AS rows, ([0, 200, 100])[o_custkey % 3 + 1] AS total FROM orders),
        g AS (SELECT source_id, count(*) AS pages_fetched, CAST(sum(rows) AS BIGINT) AS fetched, max_by(total, page) AS total_available, max(page) AS z, max_by(rows, page) AS n FROM r GROUP BY 1),
        h AS (SELECT *, (n >= 20 AND fetched < 150 AND NOT (total_available > 0 AND z * 20 + n >= total_available)) OR fetched > 150 OR total_available > fetched AS has_more FROM g)
        SELECT source_id, pages_fetched, fetched, total_available, has_more, CASE WHEN has_more THEN 'truncated' ELSE 'complete' END AS status, CASE WHEN has_more THEN 'result_or_page_limit_reached' ELSE 'all_pages_exhausted' END AS reason FROM h""",
    "source_passes": f"""WITH g AS (SELECT p_partkey // {BOARD} AS board, count(*) FILTER (p_partkey % 25 <> 7) AS rows FROM part GROUP BY 1)
        SELECT 's' || board AS source_id, rows, false AS complete, false AS failed FROM g UNION ALL SELECT 'ws' || board, rows, rows > 0, rows = 0 FROM g""",
    "sitemap_crawl": f"""SELECT 'https://m.example/index/0.xml' AS root, 'https://x.example/' || p_partkey AS url FROM part UNION ALL SELECT 'https://m.example/map/1.xml', 'https://x.example/' || p_partkey FROM part WHERE p_partkey // {BOARD} = 1""",
    "job_like_urls": "SELECT p_partkey, p_partkey % 7 IN (0, 2, 4) AS job_like FROM part",
    "resolved_links": """SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'https://y/z' WHEN 1 THEN 'https://y/z' WHEN 2 THEN 'https://x/z?q' WHEN 3 THEN 'https://x/a/b' || p_partkey || '/c?p=1' WHEN 4 THEN 'https://x/a/b' || p_partkey || '/c?d#f'
        WHEN 5 THEN 'https://x/a/b' || p_partkey || '/z/w' WHEN 6 THEN 'https://x/a/z' WHEN 7 THEN 'https://x/a/b' || p_partkey || '/z' WHEN 8 THEN '' ELSE 'https://x/z' END AS url FROM part""",
    "search_feed_urls": """SELECT 'm' || p_partkey AS id, 'Market discovery' AS company, 'market_search' AS provider, 'search://search/m' || p_partkey || '?' || CASE WHEN p_partkey % 2 = 0 THEN 'location=New+York&' ELSE '' END
        || 'query=site%3Ax.com+%28%22' || replace(p_name, ' ', '+') || '%22+OR+a%2Ab~c%29+%C3%BC%26%3D%2B' AS url FROM part""",
}
