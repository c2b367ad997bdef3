"""Scalar functions over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from snapledger.functions import classify, dates, html, text, url
from snapledger.operators import identity
from snapledger.plans import domain as D
from snapledger.plans import sqltext as S

PHRASES = ("of the", "in the", "worthless trash")


def canonical_text(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.canonical_text(F.col("text"))).alias("digest"))


def padded_text(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.padded_text(F.col("text"))).alias("digest"))


def feed_text(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.feed_text(F.col("text"))).alias("digest"))


def company_key(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    name = F.concat("c_name", F.element_at(F.array(*map(F.lit, ("", ", Inc.", " Ltd", " Co. LLC", " GmbH"))), (F.col("c_custkey") % 5 + 1).cast("int")))
    return c.select("c_custkey", text.company_key(name).alias("key"))


def phrase_match(spark, sf_dir):
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.has_phrase(text.padded_text(F.col("text")), PHRASES).alias("hit"))


def stable_ids(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", text.digest_prefix(F.concat_ws("|", "p_name", "p_type"), 32).alias("id"))


def identity_keys(spark, sf_dir):
    # as columns of their own: each is used several times
    o = D.observations(spark, sf_dir).withColumn("safe_url", url.canonical_url_plain(F.col("apply_url")))
    o = o.withColumn("keys", identity.identity_keys(F.col("safe_url")))
    both = lambda k: F.struct(F.array_join(k, "\n").alias("keys"), identity.stable_id(k).alias("id"))
    return o.select("seq", text.once(F.col("keys"), both).alias("x")).select("seq", "x.*")


def identity_resolution(spark, sf_dir):
    """Jobs of the observations, every other one without a native id; too order-dependent for SQL, tested against fixtures."""
    o = D.observations(spark, sf_dir).withColumn("source_native_id", F.when(F.col("seq") % 2 == 0, F.col("source_native_id")).otherwise(""))
    found = identity.resolve(o, url.canonical_url_plain(F.col("apply_url")), ["observed_at", "seq"])
    return found.select("seq", "job_id")


def canonical_url(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", url.canonical_url(F.col("url")).alias("url"))


def same_site(spark, sf_dir):
    h = url.host(F.col("url"))
    return D.table(spark, sf_dir, "pages").select("page_id", h.alias("host"), url.same_site(h, F.lit("example.com")).alias("same"), url.blocked_host(h, ("spam-farm.example.org", "example.net")).alias("blocked"))


def path_segments(spark, sf_dir):
    segments = url.path_segments(F.col("url"))
    return D.table(spark, sf_dir, "pages").select("page_id", F.array_join(segments, "|").alias("segments"), F.size(segments).cast("bigint").alias("n"))


def route_classify(spark, sf_dir):
    hosts = F.element_at(F.array(*map(F.lit, ("boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "x.example.com", "apply.workable.com"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    route = identity.route_of(F.concat(F.lit("https://"), hosts, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/jobs")))
    return D.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(route["provider"], F.lit("")).alias("provider"), F.coalesce(route["board"], F.lit("")).alias("board"))


def track_category(spark, sf_dir):
    o = D.observations(spark, sf_dir)
    return o.select("seq", classify.track(F.col("title"), F.col("employment_type"), F.col("level")).alias("track"), classify.category(F.col("title")).alias("category"), classify.region(F.col("country"), F.col("location")).alias("region"))


def level_family(spark, sf_dir):
    o = D.observations(spark, sf_dir)
    return o.select("seq", identity.infer_level(F.col("title")).alias("level"), identity.infer_family(F.col("title")).alias("family"), identity.normal_country(F.col("country"), F.col("location")).alias("country"))


def countries(spark, sf_dir):
    o = D.observations(spark, sf_dir)
    found = identity.detected_countries(F.concat_ws("; ", "country", "location"))
    both = lambda codes: F.struct(F.array_join(codes, ",").alias("codes"), identity.place_marker(codes).alias("marker"))
    return o.select("seq", text.once(found, both).alias("x")).select("seq", "x.*")


def source_authority(spark, sf_dir):
    s = D.controls(spark, sf_dir)
    return s.select("source_id", classify.source_authority(F.col("source_id"), F.lit("")).alias("authority"))


def failure_classes(spark, sf_dir):
    msgs = ("HTTP 429 from host", "request timed out", "page not found", "incomplete snapshot", "provider mismatch", "odd thing")
    e = D.table(spark, sf_dir, "events")
    c = classify.failure_class(F.element_at(F.array(*map(F.lit, msgs)), (F.col("event_id") % len(msgs) + 1).cast("int")))
    return e.groupBy(c["code"].alias("code"), c["terminal"].alias("terminal")).agg(F.count(F.lit(1)).alias("n"))


def parse_times(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    shown = F.element_at(
        F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("soon")),
        (F.col("o_orderkey") % 5 + 1).cast("int"),
    )
    return o.select("o_orderkey", dates.parse_time(shown).cast("timestamp_ntz").alias("at"))


def stale_years(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    title = F.concat(F.lit("Intern "), (F.col("doc_id") % 6 + 1998).cast("string"), F.when(F.col("doc_id") % 2 == 0, " Summer").otherwise(" spring"))
    return d.select("doc_id", dates.stale_years(text.padded_text(title), datetime(2001, 7, 1)).alias("stale"))


def tags_contains(spark, sf_dir):
    return D.candidates(spark, sf_dir).select("id", F.array_contains("tags", "quant").alias("quant"), F.exists("tags", lambda t: t.startswith("curated-")).alias("curated"), classify.lane(F.col("tags")).alias("lane"))


def json_props(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy("event_type").agg(F.sum(F.col("p.k").cast("bigint")).alias("total"), F.max("p.k").alias("top"))


def html_meta(spark, sf_dir):
    p = D.table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(html.title_of(F.col("html"))).alias("title"), F.size(html.anchors(F.col("html"))).cast("bigint").alias("links"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_text, padded_text, feed_text, company_key, phrase_match, stable_ids, identity_keys, identity_resolution, canonical_url, same_site, path_segments, route_classify,
        track_category, level_family, countries, source_authority, failure_classes, parse_times, stale_years, tags_contains, json_props, html_meta,
    )
}
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1)"
_SEGS = f"list_filter(string_split({_PATH}, '/'), lambda s: s <> '')"
_NAME = "c_name || (['', ', Inc.', ' Ltd', ' Co. LLC', ' GmbH'])[c_custkey % 5 + 1]"
_URL = S.plain_url("apply_url")
_DETECT = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {S.in_feed(S.feed(chr(99) + 'c'), p)} THEN '{c}' END" for c, p in identity.COUNTRY_PHRASES.items()) + "], lambda x: x IS NOT NULL))"
ORACLE = {
    "canonical_text": f"SELECT doc_id, md5({S.canonical('text')}) AS digest FROM documents",
    "padded_text": f"SELECT doc_id, md5({S.padded('text')}) AS digest FROM documents",
    "feed_text": f"SELECT doc_id, md5({S.feed('text')}) AS digest FROM documents",
    "company_key": f"SELECT c_custkey, {S.company_key(_NAME)} AS key FROM customer",
    "phrase_match": f"SELECT conv_id, turn, {S.phrase(S.padded('text'), PHRASES)} AS hit FROM conversations",
    "stable_ids": "SELECT p_partkey, substr(sha256(p_name || '|' || p_type), 1, 32) AS id FROM part",
    "identity_keys": f"""{D.with_views('v_obs')}, k AS (SELECT seq, 'native:' || {S.canonical('source_id')} || ':' || source_native_id AS a, 'company-url:' || {S.canonical('company')} || '|url:' || {_URL} AS b, 'url:' || {_URL} AS c FROM v_obs)
        SELECT seq, a || chr(10) || b || chr(10) || c AS keys, substr(sha256(a), 1, 32) AS id FROM k""",
    "canonical_url": f"SELECT page_id, {S.plain_url('url')} AS url FROM pages",
    "same_site": f"SELECT page_id, {_HOST} AS host, regexp_matches({_HOST}, '(^|[.])example[.]com$') AS same, regexp_matches({_HOST}, '(^|[.])(spam-farm[.]example[.]org|example[.]net)$') AS blocked FROM pages",
    "path_segments": f"SELECT page_id, array_to_string({_SEGS}, '|') AS segments, len({_SEGS}) AS n FROM pages",
    "route_classify": """SELECT p_partkey, (['greenhouse', 'lever', 'ashby', '', 'workable'])[p_partkey % 5 + 1] AS provider,
        CASE WHEN p_partkey % 5 = 3 THEN '' ELSE (['https://job-boards.greenhouse.io/', 'https://jobs.lever.co/', 'https://jobs.ashbyhq.com/', '', 'https://apply.workable.com/'])[p_partkey % 5 + 1] || lower(replace(p_name, ' ', '-')) END AS board FROM part""",
    "track_category": f"{D.with_views('v_obs')} SELECT seq, {S.track('title', 'employment_type', 'level')} AS track, {S.category('title')} AS category, {S.region('country', 'location')} AS region FROM v_obs",
    "level_family": f"""{D.with_views('v_obs')}, t AS (SELECT seq, lower(title) AS t, country AS c, lower(location) AS l FROM v_obs)
        SELECT seq, CASE WHEN regexp_matches(t, '\\b(?:intern|internship|co-op|coop)\\b') THEN 'internship' WHEN regexp_matches(t, '\\b(?:new grad|new graduate|graduate)\\b') THEN 'new_grad'
                         WHEN regexp_matches(t, '\\b(?:early career|entry level|entry-level|junior)\\b') THEN 'early_career' ELSE 'unknown' END AS level,
               CASE WHEN t LIKE '%machine learning%' THEN 'ml_ai' WHEN t LIKE '%data%' THEN 'data' WHEN t LIKE '%web%' THEN 'frontend' WHEN t LIKE '%platform%' THEN 'backend' ELSE 'software_engineering' END AS family,
               CASE c WHEN 'SG' THEN 'Singapore' WHEN 'United States' THEN 'US' WHEN 'USA' THEN 'US' WHEN 'Germany' THEN 'Germany' ELSE 'unknown' END AS country FROM t""",
    "countries": f"""{D.with_views('v_obs')}, x AS (SELECT seq, country || '; ' || location AS cc FROM v_obs), d AS (SELECT seq, {_DETECT} AS codes FROM x)
        SELECT seq, array_to_string(codes, ',') AS codes, CASE WHEN len(codes) > 1 THEN '🌐' WHEN len(codes) = 1 THEN chr(ord(codes[1][1]) - 65 + 127462) || chr(ord(codes[1][2]) - 65 + 127462) ELSE '📍' END AS marker FROM d""",
    "source_authority": f"{D.with_views('v_ctrl')} SELECT source_id, CASE WHEN source_id LIKE 'market-%' THEN 30 WHEN source_id LIKE 'auto-%' THEN 20 ELSE 10 END AS authority FROM v_ctrl",
    "failure_classes": "SELECT (['rate_limited', 'timeout', 'route_missing', 'incomplete', 'provider_mismatch', 'unknown'])[event_id % 6 + 1] AS code, event_id % 6 = 4 AS terminal, count(*) AS n FROM events GROUP BY ALL",
    "parse_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 IN (1, 2) THEN date_trunc('second', o_orderdate) ELSE date_trunc('day', o_orderdate) END AS \"at\" FROM orders",
    "stale_years": "SELECT doc_id, doc_id % 6 + 1998 < 2001 OR (doc_id % 6 + 1998 = 2001 AND doc_id % 2 = 1) AS stale FROM documents",
    "tags_contains": f"{D.with_views('v_cand')} SELECT id, list_contains(tags, 'quant') AS quant, len(list_filter(tags, lambda t: t LIKE 'curated-%')) > 0 AS curated, CASE " + " ".join(f"WHEN list_contains(tags, '{t}') THEN {i}" for i, t in enumerate(classify.LANES)) + " ELSE 5 END AS lane FROM v_cand",
    "json_props": "SELECT event_type, sum((props::JSON ->> 'k')::BIGINT) AS total, max((props::JSON ->> 'k')::INTEGER) AS top FROM events GROUP BY event_type",
    "html_meta": "SELECT page_id, md5(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) AS title, len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=[\"'']([^\"'']*)[\"'']', 1)) AS links FROM pages",
}
