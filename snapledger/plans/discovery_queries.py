"""Discovery and message queries over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from snapledger.functions.board_match import board_matches
from snapledger.functions.text import company_key
from snapledger.operators import discovery, messages, triage
from snapledger.plans import domain as D
from snapledger.plans import sqltext as S


def _probes(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    return e.select(
        F.lit("lever").alias("provider"), F.concat(F.lit("https://x/"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("A"), F.col("user_id").cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("a"), F.col("user_id").cast("string")))).alias("url"),
        F.col("event_id").alias("seq"), F.concat(F.lit("c"), (F.col("event_id") % 9).cast("string")).alias("candidate_id"), (F.col("event_type") == "view").alias("ok"), (F.col("value") > 15).cast("int").alias("observed"),
    )


def probe_fold(spark, sf_dir):
    return discovery.fold_probes(_probes(spark, sf_dir))


_BOARDS = (
    "o_orderkey AS id", "concat('c', o_custkey) AS candidate_id",
    "element_at(array('greenhouse', 'Lever', 'ashby', 'workday', 'official_careers', 'smartrecruiters', 'gem', 'unheard_of', 'yc_jobs'), cast(o_orderkey % 9 AS int) + 1) AS provider",
    """CASE o_orderkey % 9 WHEN 3 THEN concat('https://www.C', o_custkey, '.wd1.example.com/en/jobs') WHEN 4 THEN concat('https://own', o_custkey % 10, '.example.com/jobs')
        WHEN 8 THEN concat('https://ycombinator.com/companies/x', o_custkey % 7, CASE WHEN o_custkey % 3 = 0 THEN '/jobs' ELSE '' END)
        ELSE concat('https://b.example.com/', CASE o_custkey % 8 WHEN 0 THEN 'The-' WHEN 1 THEN 'staffing' ELSE '' END, CASE o_custkey % 3 WHEN 0 THEN 'Customer%23' WHEN 1 THEN 'c' ELSE 'other' END,
            CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat(o_custkey) END,
            CASE o_orderkey % 7 WHEN 0 THEN 'Search' WHEN 1 THEN '-health' WHEN 2 THEN '9' WHEN 3 THEN 'executive' WHEN 4 THEN ' labs' ELSE '' END, '/x') END AS url""",
)


def _boards(spark, sf_dir):
    """Boards of orders and the customers that they may belong to."""
    c = D.table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS candidate_id", "c_name AS name", "concat('https://www.own', c_nationkey % 10, '.example.com/about') AS website")
    return D.table(spark, sf_dir, "orders").selectExpr(*_BOARDS), c


def board_owners(spark, sf_dir):
    found, c = _boards(spark, sf_dir)
    match = board_matches(*(F.col(k) for k in ("provider", "url", "name", "candidate_id", "website")), ("own3.example.com",))
    return found.join(c, "candidate_id").select("id", match.alias("belongs"))


def foreign_boards(spark, sf_dir):
    """What demotion does with boards that belong to nobody or to others."""
    found, c = _boards(spark, sf_dir)
    found = found.selectExpr("*", "'Some Company' AS company", "CASE WHEN id % 2 = 0 THEN 'promoted' ELSE 'candidate' END AS state")
    health = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS source_id", "'failure' AS state", "o_orderkey % 6 AS consecutive_failures")
    tagged = c.withColumnRenamed("candidate_id", "id").withColumn("tags", F.array(F.lit("priority-1"), F.lit("yc-top")))
    return triage.demote(found, tagged, health, ("own3.example.com",)).select("id", "state", "reason", "candidate_state")


def _discovered(spark, sf_dir):
    """Routes of slug providers and of others, spelt in either case, in every state."""
    c = D.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    states = F.element_at(F.array(*map(F.lit, ("promoted", "candidate", "unhealthy", "duplicate", "rejected"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    provider = F.element_at(F.array(*map(F.lit, ("lever", "Lever", "workday"))), (F.floor(k / 4) % 3 + 1).cast("int"))
    url = F.concat(F.when(k % 2 == 0, "HTTPS://B/Board").otherwise("https://b/board"), (k % 60).cast("string"), F.when(k % 3 == 0, "/").otherwise(""))
    return c.select(
        k.alias("id"), provider.alias("provider"), url.alias("url"), states.alias("state"),
        F.when(k % 4 == 0, F.lit(datetime(2001, 1, 1)) + F.make_dt_interval(days=(k % 50).cast("int"))).alias("promoted_at"), (k % 17).alias("last_checked_at"),
    )


def route_duplicates(spark, sf_dir):
    return discovery.suppress_duplicates(_discovered(spark, sf_dir)).select("id", "state")


def catalog_duplicates(spark, sf_dir):
    s = D.table(spark, sf_dir, "supplier")
    catalog = s.select(F.lit("LEVER").alias("provider"), F.concat(F.lit("HTTPS://b/BOARD"), F.col("s_suppkey").cast("string")).alias("url"))
    return discovery.suppress_catalogued(_discovered(spark, sf_dir), catalog).select("id", "state")


def market_targets(spark, sf_dir):
    obs = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Customer "), (F.col("o_custkey") % 700).cast("string"), F.lit(" Inc")).alias("company"))
    targets = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("id"), F.concat(F.lit("customer"), (F.col("c_custkey") % 450).cast("string")).alias("name"))
    return discovery.market_targets(obs, targets).select("seq", "target_id")


def refresh_candidates(spark, sf_dir):
    c = D.candidates(spark, sf_dir).withColumn("website", F.lit("")).withColumn("n", F.substring("id", 3, 9).cast("int"))
    old = c.where("n % 3 <> 0").select("id", F.upper("name").alias("name"), "website", "tags", "state", F.when((F.col("state") == "parked") & (F.col("n") % 2 == 0), "company_quality").otherwise("").alias("failure_code"))
    new = c.where("n % 5 <> 0").select("id", "name", "website", "tags")
    return discovery.refresh_candidates(old, new).select("id", "name", "state", "failure_code")


def search_results(spark, sf_dir):
    p = D.table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("query"), F.col("page_id").alias("position"), "url")
    return discovery.filter_results(p, ("spam-farm.example.org", "example.net"), 8).select("query", "position", "rank")


def company_equality(spark, sf_dir):
    o = D.observations(spark, sf_dir)
    return o.groupBy(company_key(F.col("company")).alias("key")).agg(F.countDistinct("company").alias("spellings"))


def rendered_messages(spark, sf_dir):
    p = D.postings(spark, sf_dir)
    text = messages.message_html(F.concat_ws(" & ", "title", "company"), F.col("company"), F.concat_ws(";", "location", "country"), F.lit("new_grad"), F.col("apply_url"))
    return p.select("id", F.md5(text).alias("digest"))


QUERIES = {f.__name__: f for f in (board_owners, foreign_boards, probe_fold, route_duplicates, catalog_duplicates, market_targets, refresh_candidates, search_results, company_equality, rendered_messages)}
_DISC = """WITH d AS (SELECT c_custkey AS id, (['lever', 'Lever', 'workday'])[c_custkey // 4 % 3 + 1] AS provider,
    (CASE WHEN c_custkey % 2 = 0 THEN 'HTTPS://B/Board' ELSE 'https://b/board' END) || (c_custkey % 60) || CASE WHEN c_custkey % 3 = 0 THEN '/' ELSE '' END AS url,
    (['promoted', 'candidate', 'unhealthy', 'duplicate', 'rejected'])[c_nationkey % 5 + 1] AS state,
    CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2001-01-01' + to_days((c_custkey % 50)::INTEGER) END AS promoted_at, c_custkey % 17 AS last_checked_at FROM customer)"""
_ESC = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"
_T = "title || ' & ' || company"
_OWNERS = f"""WITH o AS (SELECT {', '.join(_BOARDS).replace('element_at(array(', 'list_extract(list_value(').replace("concat('c', o_custkey)", "'c' || o_custkey").replace('AS int)', 'AS INTEGER)')} FROM orders),
    r AS (SELECT o.id, lower(provider) AS provider, url, c_name AS name, o.candidate_id AS cid, 'own' || (c_nationkey % 10) AS brand, regexp_replace(lower(regexp_extract(url, '^https://([^/]*)', 1)), '^www[.]', '') AS host,
                 string_split(replace(regexp_extract(url, '^https://[^/]*/(.*)$', 1), '%23', '#'), '/') AS path FROM o JOIN customer ON o.candidate_id = 'c' || c_custkey),
    k AS (SELECT *, regexp_replace(lower(CASE provider WHEN 'workday' THEN string_split(host, '.')[1] ELSE '' END || path[1]), '[^a-z0-9]', '', 'g') AS board,
                 [regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), cid, brand] AS ids,
                 list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) >= 4) AS words FROM r),
    v AS (SELECT *, board IN ('staffing' || ids[1], 'staffing' || ids[2], ids[1] || 'search', ids[2] || 'search', 'staffing' || ids[3], ids[3] || 'search')
                    OR len(list_filter(ids, lambda i: starts_with(regexp_replace(board, '^the', ''), i) AND regexp_matches(substr(regexp_replace(board, '^the', ''), length(i) + 1), '^([0-9]+|health)$'))) > 0 AS veto,
                 len(list_filter(ids, lambda i: i = board OR (length(i) >= 4 AND (contains(board, i) OR contains(i, board))))) > 0 OR len(list_filter(words, lambda w: contains(board, w))) > 0 AS named FROM k),
    b AS (SELECT id, CASE provider WHEN 'unheard_of' THEN false WHEN 'official_careers' THEN host = brand || '.example.com' AND host <> 'own3.example.com'
                 WHEN 'yc_jobs' THEN len(path) >= 3 AND path[3] = 'jobs' AND (contains(ids[1], path[2]) OR contains(path[2], ids[1]) OR contains(cid, path[2]) OR contains(path[2], cid))
                 ELSE NOT veto AND NOT contains(board, 'executive') AND named END AS belongs, host, provider FROM v)"""
ORACLE = {
    "board_owners": f"{_OWNERS} SELECT id, belongs FROM b",
    "foreign_boards": f"""{_OWNERS}, w AS (SELECT *, CASE WHEN provider = 'official_careers' AND host_of_site = 'own3.example.com' THEN 'official route belongs to a job aggregator'
            WHEN NOT belongs THEN 'discovered board identity does not match candidate company' END AS reason FROM (SELECT b.*, v.brand || '.example.com' AS host_of_site FROM b JOIN v USING (id)))
        SELECT id, CASE WHEN reason IS NOT NULL OR (id % 2 = 0 AND id % 6 >= 3) THEN 'unhealthy' WHEN id % 2 = 0 THEN 'promoted' ELSE 'candidate' END AS state, reason,
               CASE WHEN reason LIKE 'official%' THEN 'duplicate' WHEN reason IS NOT NULL OR (id % 2 = 0 AND id % 6 >= 3) THEN 'retry' END AS candidate_state FROM w""",
    "probe_fold": """WITH p AS (SELECT 'lever' AS provider, 'https://x/a' || user_id AS route, event_id AS seq, 'c' || (event_id % 9) AS candidate_id, event_type = 'view' AS ok, value > 15 AS seen FROM events),
        o AS (SELECT *, first_value(candidate_id) OVER (PARTITION BY route ORDER BY seq) AS owner FROM p), m AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM o WHERE owner = candidate_id),
        l AS (SELECT *, max(island) OVER (PARTITION BY route) AS last_island FROM m),
        f AS (SELECT provider, route, first(owner) AS candidate_id, bool_or(ok AND seen) AS ever, count(*) FILTER (island = last_island AND NOT ok) AS consecutive_failures FROM l GROUP BY provider, route)
        SELECT f.provider, f.route, candidate_id, CASE WHEN consecutive_failures >= 3 THEN 'unhealthy' WHEN ever THEN 'promoted' ELSE 'candidate' END AS state, consecutive_failures,
               (SELECT count(*) FROM o WHERE o.route = f.route AND o.owner <> o.candidate_id) AS duplicates FROM f""",
    # scheme and host are told apart by case nowhere, the path only where the provider is no slug provider
    "route_duplicates": f"""{_DISC}, k AS (SELECT *, lower(provider) || '|' || lower(split_part(url, '://', 1)) || '://' || lower(split_part(url, '/', 3)) || '/'
            || CASE WHEN lower(provider) = 'lever' THEN lower(split_part(url, '/', 4)) ELSE split_part(url, '/', 4) END AS route FROM d),
        live AS (SELECT id, row_number() OVER (PARTITION BY route ORDER BY CASE state WHEN 'promoted' THEN 0 WHEN 'candidate' THEN 1 ELSE 2 END, promoted_at NULLS LAST, last_checked_at, id) AS nth
            FROM k WHERE state <> 'duplicate')
        SELECT d.id, CASE WHEN nth > 1 THEN 'duplicate' ELSE state END AS state FROM d LEFT JOIN live USING (id)""",
    "catalog_duplicates": f"""{_DISC} SELECT id, CASE WHEN lower(provider) = 'lever' AND lower(rtrim(url, '/')) IN (SELECT 'https://b/board' || s_suppkey FROM supplier) THEN 'duplicate' ELSE state END AS state FROM d""",
    "market_targets": "WITH t AS (SELECT c_custkey % 450 AS k, min(c_custkey) AS target_id FROM customer GROUP BY 1) SELECT o_orderkey AS seq, target_id FROM orders JOIN t ON o_custkey % 700 = k",
    "refresh_candidates": f"""{D.with_views('v_cand')}, c AS (SELECT *, substr(id, 3, 9)::INTEGER AS n FROM v_cand),
        o AS (SELECT id, upper(name) AS name, tags, state, CASE WHEN state = 'parked' AND n % 2 = 0 THEN 'company_quality' ELSE '' END AS failure_code FROM c WHERE n % 3 <> 0), s AS (SELECT id, name, tags FROM c WHERE n % 5 <> 0),
        j AS (SELECT o.id AS oid, s.id AS sid, o.name AS oname, s.name AS sname, o.state, o.failure_code, s.id IS NOT NULL AND o.state = 'parked' AND o.failure_code = 'company_quality' AND list_contains(s.tags, 'priority-1') AND list_has_any(s.tags, ['curated-2026', 'yc-top']) AS freed FROM o FULL JOIN s ON o.id = s.id)
        SELECT coalesce(sid, oid) AS id, CASE WHEN sid IS NOT NULL THEN sname ELSE oname END AS name, CASE WHEN oid IS NULL OR freed THEN 'pending' ELSE state END AS state, CASE WHEN oid IS NULL OR freed THEN '' ELSE failure_code END AS failure_code FROM j""",
    "search_results": """WITH p AS (SELECT page_id % 7 AS query, page_id AS position, url FROM pages WHERE NOT regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '(^|[.])(spam-farm[.]example[.]org|example[.]net)$')),
        o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY position) = 1) SELECT query, position, row_number() OVER (PARTITION BY query ORDER BY position, url) AS rank FROM o QUALIFY rank <= 8""",
    "company_equality": f"{D.with_views('v_obs')} SELECT {S.company_key('company')} AS key, count(DISTINCT company) AS spellings FROM v_obs GROUP BY 1",
    "rendered_messages": f"""{D.with_views('v_post')}, m AS (SELECT *, CASE WHEN length({_T}) > 72 THEN rtrim(substr({_T}, 1, 71)) || '…' ELSE {_T} END AS head FROM v_post)
        SELECT id, md5('<b>' || {_ESC('head')} || '</b>' || chr(10) || {_ESC('company')} || chr(10) || CASE WHEN country = '' THEN {_ESC('location')} ELSE {_ESC("location || ' · ' || country")} END || chr(10) || 'New Grad' || chr(10) || {_ESC('apply_url')}) AS digest FROM m""",
}
