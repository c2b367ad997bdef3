"""Merges, demotions, the end of a pass, and what pages and messages say, over the driver tables.

Input views are one text for both engines; the SQL of the operators is written out by hand.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from snapledger.functions import outcomes
from snapledger.functions.classify import link_outcome
from snapledger.operators import merge, snapshot, triage
from snapledger.plans import domain as D

POLICY = "p2"
_JOBS = (
    "cast(o_orderkey AS string) AS id", "concat('Clerk ', cast(o_custkey % 97 AS string)) AS company", "concat('Role ', cast(o_orderkey % 5 AS string)) AS title",
    "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS location", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('https://x/', cast(o_orderkey AS string)) END AS apply_url",
    "o_orderstatus AS link_state", "o_orderkey % 2 AS link_gone", "concat('s', cast(o_orderkey % 11 AS string)) AS source_id", "10 * (1 + o_orderkey % 3) AS authority",
    "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS posted_at", "CASE WHEN o_orderkey % 7 = 0 THEN 'p2' ELSE 'p1' END AS policy_version",
    "o_orderdate AS first_seen_at", "o_orderdate AS last_seen_at",
)
_DELIVERIES = (
    "cast(o_orderkey AS string) AS job_id", "'mail' AS channel", "concat('r', cast(o_orderkey % 2 AS string)) AS recipient",
    "CASE o_orderkey % 6 WHEN 0 THEN 'sent' WHEN 1 THEN 'staged' WHEN 2 THEN 'claimed' WHEN 3 THEN 'pending' WHEN 4 THEN 'failed' ELSE 'suppressed' END AS status",
    "o_orderkey % 5 AS attempts", "CASE WHEN o_orderkey % 6 = 2 THEN 'w1' ELSE '' END AS claim_owner", "o_orderdate AS next_attempt_at",
    "CASE WHEN o_orderkey % 4 = 0 THEN concat('e', cast(o_orderkey AS string)) ELSE '' END AS last_error", "o_orderdate AS created_at", "CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate END AS sent_at",
)
_TITLES = (
    "p_partkey AS id",
    "concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ' - NYC' WHEN 1 THEN ' (Singapore)' WHEN 2 THEN ' USA' WHEN 3 THEN ' – us' WHEN 4 THEN ' New York' WHEN 5 THEN ' bus' WHEN 6 THEN ' (New York City) ' ELSE '' END) AS title",
    "concat(CASE p_partkey % 7 WHEN 0 THEN 'About the role: This is a new graduate role.' WHEN 1 THEN 'Role: Entry-Level.' WHEN 2 THEN 'About the role. Not intended for internship. It is an entry level role'"
    " WHEN 3 THEN 'It is an entry level role. About the role' WHEN 4 THEN concat('About the role ', repeat('word ', 90), 'is an entry level role') ELSE 'nothing' END, '.') AS description",
    "concat(CASE p_partkey % 8 WHEN 0 THEN 'TinyFish: RATE_LIMITED' WHEN 1 THEN 'board returned HTTP 503' WHEN 2 THEN 'http status: 404 again' WHEN 3 THEN 'fetch failed: 429' WHEN 4 THEN 'TLS handshake'"
    " WHEN 5 THEN 'context deadline exceeded' WHEN 6 THEN ' ' ELSE 'incomplete snapshot' END, CASE WHEN p_partkey % 16 < 8 THEN '' ELSE ' x' END) AS message",
)


def _table(spark, sf_dir, name, view):
    return D.table(spark, sf_dir, name).selectExpr(*view)


def _pairs(spark, sf_dir):
    """Of each customer's orders the first takes in those of its first third of numbers."""
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    first = o.groupBy("o_custkey").agg(F.min("k").alias("c"))
    return o.join(first, "o_custkey").where("k <> c AND k % 3 <> 1").select(F.col("c").cast("string").alias("canonical_id"), F.col("k").cast("string").alias("duplicate_id"), F.col("k").alias("seq"))


def merged_jobs(spark, sf_dir):
    return merge.merge_jobs(_table(spark, sf_dir, "orders", _JOBS), _pairs(spark, sf_dir), POLICY)


def merged_deliveries(spark, sf_dir):
    return merge.merge_deliveries(_table(spark, sf_dir, "orders", _DELIVERIES), _pairs(spark, sf_dir))


def merged_provenance(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey AS string) AS job_id", "l_suppkey % 20 AS source_id", "l_partkey % 50 AS source_native_id", "l_shipdate AS first_observed_at", "l_shipdate AS last_observed_at", "l_linestatus = 'O' AS active")
    return merge.merge_provenance(rows, _pairs(spark, sf_dir))


def merged_identities(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").selectExpr("concat('key', cast(o_orderkey AS string)) AS key", "cast(o_orderkey AS string) AS job_id")
    return merge.merge_identities(rows, _pairs(spark, sf_dir))


def _chains(spark, sf_dir):
    """Each customer's orders as a tree: the n-th goes into the order n // 2, the last ones first."""
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    up = n.select("o_custkey", F.col("n").alias("p"), F.col("o_orderkey").alias("c"))
    return n.withColumn("p", F.expr("n DIV 2")).join(up, ["o_custkey", "p"]).select(
        F.col("c").cast("string").alias("canonical_id"), F.col("o_orderkey").cast("string").alias("duplicate_id"), (-F.col("n")).alias("seq")
    )


def merged_chain_survivors(spark, sf_dir):
    return merge.survivors(_chains(spark, sf_dir))


def merged_chain_provenance(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey AS string) AS job_id", "l_suppkey % 20 AS source_id", "l_partkey % 50 AS source_native_id", "l_shipdate AS first_observed_at", "l_shipdate AS last_observed_at", "l_linestatus = 'O' AS active")
    return merge.merge_provenance(rows, _chains(spark, sf_dir))


def merged_chain_deliveries(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders", _DELIVERIES).withColumn("payload", F.concat(F.lit('{"ID":"'), "job_id", F.lit('","Company":"x"}')))
    return merge.merge_deliveries(rows, _chains(spark, sf_dir)).select("job_id", "channel", "recipient", "status", "attempts", "next_attempt_at", "created_at", F.get_json_object("payload", "$.Company").alias("company"))


_CANDIDATES = (
    "concat('c', cast(c_custkey AS string)) AS id", "CASE WHEN c_custkey % 23 = 0 THEN 'Anduril Industries' ELSE c_name END AS name",
    "CASE WHEN c_custkey % 5 = 0 THEN 'https://www.jobs.example.net/x' ELSE 'https://own.example.com' END AS website", "c_nationkey % 4 AS kind",
)


def demotions(spark, sf_dir):
    c = _table(spark, sf_dir, "customer", _CANDIDATES)
    tags = F.when(F.col("kind") == 0, F.array(F.lit("priority-2"))).otherwise(F.array(F.lit("priority-1"), F.lit("yc-top")))
    found = D.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "concat('c', cast(o_custkey AS string)) AS candidate_id", "'Some Company' AS company", "CASE WHEN o_orderkey % 2 = 0 THEN 'official_careers' ELSE 'lever' END AS provider",
        "concat('https://b/', cast(o_orderkey % 10 AS string)) AS url", "CASE o_orderstatus WHEN 'O' THEN 'promoted' WHEN 'F' THEN 'candidate' ELSE 'duplicate' END AS state",
    )
    health = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS source_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'success' ELSE 'failure' END AS state", "o_orderkey % 6 AS consecutive_failures")
    out = triage.demote(found, c.withColumn("tags", tags), health, ("example.net",), ~F.endswith("url", F.lit("7")))
    return out.select("id", "state", "reason", "failure_code", "candidate_state")


def demotion_candidates(spark, sf_dir):
    """Live discovered routes with their candidates' names."""
    c = _table(spark, sf_dir, "customer", _CANDIDATES).select(F.col("id").alias("candidate_id"), "name", "website")
    o = D.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS id", "concat('c', cast(o_custkey AS string)) AS candidate_id")
    return o.join(c, "candidate_id").select("id", "candidate_id", "name", "website")


def activated_exactly(spark, sf_dir):
    d = _table(spark, sf_dir, "orders", _DELIVERIES).select(F.col("job_id").alias("id"), "status")
    return triage.activate_exactly(d, d.where("status = 'staged' AND id LIKE '%7'").select("id"))


def first_statuses(spark, sf_dir):
    modes = D.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "CASE s_suppkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'rebaseline' END AS mode")
    return modes.select("id", triage.first_delivery_status(F.col("mode")).alias("status"), triage.first_delivery_status(F.col("mode"), True).alias("published"))


def link_results(spark, sf_dir):
    p = D.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 410 ELSE 200 END AS status",
        "concat(coalesce(html, ''), CASE page_id % 11 WHEN 0 THEN '<TITLE>Page not found' WHEN 1 THEN '\"statusCode\":404' WHEN 2 THEN '>Job not found<' ELSE '' END) AS body",
    )
    return p.select("page_id", link_outcome(F.col("status"), outcomes.soft_missing(F.col("body"))).alias("outcome"), outcomes.transient_status(F.col("status")).alias("again"))


def title_places(spark, sf_dir):
    return _table(spark, sf_dir, "part", _TITLES).select("id", outcomes.title_place(F.col("title")).alias("p")).select("id", "p.location", "p.country")


def role_levels(spark, sf_dir):
    return _table(spark, sf_dir, "part", _TITLES).select("id", outcomes.states_entry_level(F.col("description")).alias("entry_level"))


def error_texts(spark, sf_dir):
    t = _table(spark, sf_dir, "part", _TITLES)
    return t.select("id", outcomes.shown_error(F.col("message")).alias("shown"), outcomes.transient_message(F.col("message"), "tinyfish").alias("again"))


def company_labels(spark, sf_dir):
    """Each supplier with the label of its catalogue entry, if that has one."""
    s = D.table(spark, sf_dir, "supplier")
    entries = s.where("s_suppkey % 4 <> 0").select(
        outcomes.shown_company(F.concat(F.lit("  "), F.upper("s_name"))).alias("key"),
        outcomes.company_label(F.array(F.element_at(F.array(*map(F.lit, ("unicorn", " AI ", "big-tech", "other", "quant"))), (F.col("s_suppkey") % 5 + 1).cast("int")), F.lit("yc-top"))).alias("label"),
    )
    return s.select("s_suppkey", outcomes.shown_company(F.col("s_name")).alias("key")).join(entries, "key", "left").select("s_suppkey", F.coalesce("label", F.lit(outcomes.PLAIN_LABEL)).alias("label"))


def company_keys(spark, sf_dir):
    s = D.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('  ', s_name, '  & Söhne-Co.  ') AS name")
    return s.select("s_suppkey", outcomes.shown_company(F.col("name")).alias("shown"), outcomes.exact_company(F.col("name")).alias("exact"), outcomes.compact_identity(F.col("name")).alias("compact"))


def links_not_gone(spark, sf_dir):
    """Jobs whose link is not known to be gone, of companies that the reader has not hidden."""
    jobs = _table(spark, sf_dir, "orders", _JOBS).where("link_state <> 'F'")
    hidden = D.table(spark, sf_dir, "orders").where("o_orderkey % 500 = 0").select(outcomes.exact_company(F.concat(F.lit("CLERK "), (F.col("o_custkey") % 97).cast("string"))).alias("hidden")).distinct()
    return jobs.join(hidden, outcomes.exact_company(F.col("company")) == F.col("hidden"), "left_anti").select("id")


def snapshot_quality(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS source_id", "l_orderkey * 10 + l_linenumber AS pos", "CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat('Title ', cast(l_partkey AS string)) END AS title",
        "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'u' END AS apply_url", "CASE WHEN l_partkey % 4 = 0 THEN 'role' END AS code",
    )
    q = snapshot.quality(rows)
    return q.select("source_id", "usable", "relevant", "rejected", F.concat_ws("|", "titles").alias("titles"))


def roster_order(spark, sf_dir):
    """Place of each source in the roster (by company without regard to case, then id) and, of failing ones, among the failures."""
    from pyspark.sql import Window

    s = D.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN upper(concat('n', cast(s_suppkey % 7 AS string))) ELSE concat('n', cast(s_suppkey % 7 AS string)) END AS company", "s_suppkey % 4 AS failures", "s_nationkey AS region")
    # the roster of a region is read as a whole; places are numbered within it
    return s.select("id", F.row_number().over(Window.partitionBy("region").orderBy(F.lower("company"), "id")).alias("place"),
                    F.when(F.col("failures") > 0, F.row_number().over(Window.partitionBy("region", F.col("failures") > 0).orderBy(F.desc("failures"), "id"))).alias("failure_place"))


QUERIES = {
    f.__name__: f
    for f in (
        merged_jobs, merged_deliveries, merged_provenance, merged_identities, merged_chain_survivors, merged_chain_provenance, merged_chain_deliveries, demotions, demotion_candidates, activated_exactly, first_statuses, link_results,
        title_places, role_levels, error_texts, company_labels, company_keys, links_not_gone, snapshot_quality, roster_order,
    )
}


def _view(name: str, table: str, columns: tuple[str, ...]) -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM {table})".replace("AS string)", "AS VARCHAR)")


_PAIRS = """pairs AS (SELECT CAST(c AS VARCHAR) AS canonical_id, CAST(o_orderkey AS VARCHAR) AS duplicate_id, o_orderkey AS seq
    FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE o_orderkey <> c AND o_orderkey % 3 <> 1)"""
_PAD = lambda x: f"(' ' || trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')) || ' ')"
_STRONG = "d.authority < c.authority"
_GAP = lambda f: f"{f} := CASE WHEN {_STRONG} THEN coalesce(nullif(d.{f}, ''), c.{f}) ELSE coalesce(nullif(c.{f}, ''), d.{f}) END"
_SET = lambda f: f"{f} := CASE WHEN {_STRONG} THEN d.{f} ELSE c.{f} END"
_WITH_URL = lambda f: f"{f} := CASE WHEN {_STRONG} AND d.apply_url <> '' THEN d.{f} ELSE c.{f} END"
_FIELDS = "company, title, location, apply_url, link_state, link_gone, source_id, authority, posted_at, policy_version, first_seen_at, last_seen_at"
_ROOTS = """roots AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders)"""
ORACLE = {
    # whatever the tree, all orders of a customer end in the first one
    "merged_chain_survivors": f"WITH {_ROOTS} SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(root AS VARCHAR) AS survivor FROM roots WHERE o_orderkey <> root",
    "merged_chain_provenance": f"""WITH {_ROOTS} SELECT CAST(coalesce(root, l_orderkey) AS VARCHAR) AS job_id, l_suppkey % 20 AS source_id, l_partkey % 50 AS source_native_id,
        min(l_shipdate) AS first_observed_at, max(l_shipdate) AS last_observed_at, bool_or(l_linestatus = 'O') AS active
        FROM lineitem LEFT JOIN roots ON l_orderkey = o_orderkey GROUP BY ALL""",
    # status, attempts and times do not depend on the way
    "merged_chain_deliveries": f"""WITH {_view('j', 'orders', _DELIVERIES)}, {_ROOTS}
        SELECT CAST(root AS VARCHAR) AS job_id, channel, recipient,
               CASE WHEN count(*) = 1 THEN min(status) WHEN bool_or(status = 'sent') THEN 'sent' WHEN bool_or(status = 'suppressed') THEN 'suppressed' WHEN bool_or(status IN ('pending', 'claimed')) THEN 'pending'
                    WHEN bool_or(status = 'staged') THEN 'staged' ELSE 'failed' END AS status,
               max(attempts) AS attempts, min(next_attempt_at) AS next_attempt_at, min(created_at) AS created_at, 'x' AS company
        FROM j JOIN roots ON job_id = CAST(o_orderkey AS VARCHAR) GROUP BY ALL""",
    # the merges of a job, one after the other
    "merged_jobs": f"""WITH {_view('j', 'orders', _JOBS)}, {_PAIRS},
        m AS (SELECT coalesce(canonical_id, id) AS to_id, coalesce(seq, 0) AS seq, j.* FROM j LEFT JOIN pairs ON id = duplicate_id),
        g AS (SELECT to_id, list_reduce(list(struct_pack({', '.join(f'{f} := {f}' for f in _FIELDS.split(', '))}) ORDER BY seq), lambda c, d: struct_pack(
            {_SET('company')}, {_SET('title')}, {_GAP('location')}, {_GAP('apply_url')}, {_WITH_URL('link_state')}, {_WITH_URL('link_gone')}, {_SET('source_id')},
            authority := least(c.authority, d.authority), posted_at := CASE WHEN {_STRONG} THEN coalesce(d.posted_at, c.posted_at) ELSE coalesce(c.posted_at, d.posted_at) END,
            policy_version := CASE WHEN c.policy_version = 'p2' THEN c.policy_version ELSE d.policy_version END,
            first_seen_at := least(c.first_seen_at, d.first_seen_at), last_seen_at := greatest(c.last_seen_at, d.last_seen_at))) AS s FROM m GROUP BY to_id)
        SELECT to_id AS id, {', '.join(f's.{f} AS {f}' for f in _FIELDS.split(', '))} FROM g""",
    "merged_deliveries": f"""WITH {_view('j', 'orders', _DELIVERIES)}, {_PAIRS},
        m AS (SELECT coalesce(canonical_id, job_id) AS to_id, coalesce(seq, 0) AS seq, j.* FROM j LEFT JOIN pairs ON job_id = duplicate_id)
        SELECT to_id AS job_id, channel, recipient,
               CASE WHEN count(*) = 1 THEN min(status) WHEN bool_or(status = 'sent') THEN 'sent' WHEN bool_or(status = 'suppressed') THEN 'suppressed' WHEN bool_or(status IN ('pending', 'claimed')) THEN 'pending'
                    WHEN bool_or(status = 'staged') THEN 'staged' ELSE 'failed' END AS status,
               max(attempts) AS attempts, CASE WHEN count(*) = 1 THEN min(claim_owner) ELSE '' END AS claim_owner, min(next_attempt_at) AS next_attempt_at,
               coalesce(first(last_error ORDER BY seq) FILTER (last_error <> ''), '') AS last_error, min(created_at) AS created_at, first(sent_at ORDER BY seq) FILTER (sent_at IS NOT NULL) AS sent_at
        FROM m GROUP BY ALL""",
    "merged_provenance": f"""WITH {_PAIRS} SELECT coalesce(canonical_id, CAST(l_orderkey AS VARCHAR)) AS job_id, l_suppkey % 20 AS source_id, l_partkey % 50 AS source_native_id,
        min(l_shipdate) AS first_observed_at, max(l_shipdate) AS last_observed_at, bool_or(l_linestatus = 'O') AS active
        FROM lineitem LEFT JOIN pairs ON CAST(l_orderkey AS VARCHAR) = duplicate_id GROUP BY 1, 2, 3""",
    "merged_identities": f"WITH {_PAIRS} SELECT 'key' || o_orderkey AS key, coalesce(canonical_id, CAST(o_orderkey AS VARCHAR)) AS job_id FROM orders LEFT JOIN pairs ON CAST(o_orderkey AS VARCHAR) = duplicate_id",
    "demotions": """WITH r AS (
            SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS official, o_orderkey % 10 = 7 AS foreign_board, c_nationkey % 4 = 0 AS low, c_custkey % 23 = 0 AS blocked, c_custkey % 5 = 0 AS listed,
                   CASE o_orderstatus WHEN 'O' THEN 'promoted' WHEN 'F' THEN 'candidate' ELSE 'duplicate' END AS was, o_orderkey % 3 <> 0 AND o_orderkey % 6 >= 3 AS failing
            FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
        t AS (SELECT *, CASE WHEN was = 'duplicate' OR low IS NULL THEN NULL WHEN low THEN 1 WHEN blocked THEN 2 WHEN official AND listed THEN 3 WHEN foreign_board THEN 4 END AS why FROM r)
        SELECT id, CASE WHEN why = 1 THEN 'rejected' WHEN why > 1 THEN 'unhealthy' WHEN was = 'promoted' AND failing THEN 'unhealthy' ELSE was END AS state,
               (['company lacks high-signal target evidence', 'company excluded by target policy', 'official route belongs to a job aggregator', 'discovered board identity does not match candidate company'])[why] AS reason,
               CASE WHEN why = 1 THEN 'company_quality' ELSE '' END AS failure_code,
               CASE WHEN why = 1 THEN 'parked' WHEN why IN (2, 3) THEN 'duplicate' WHEN why = 4 OR (was = 'promoted' AND failing) THEN 'retry' END AS candidate_state FROM t""",
    "demotion_candidates": f"WITH {_view('c', 'customer', _CANDIDATES)} SELECT o_orderkey AS id, c.id AS candidate_id, name, website FROM orders JOIN c ON c.id = 'c' || o_custkey WHERE o_orderstatus <> 'P'",
    "activated_exactly": f"WITH {_view('d', 'orders', _DELIVERIES)} SELECT job_id AS id, CASE WHEN status = 'staged' AND job_id LIKE '%7' THEN 'pending' ELSE status END AS status FROM d",
    "first_statuses": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'staged' ELSE 'suppressed' END AS status, 'staged' AS published FROM supplier",
    "link_results": """WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 410 ELSE 200 END AS status,
            lower(coalesce(html, '') || CASE page_id % 11 WHEN 0 THEN '<TITLE>Page not found' WHEN 1 THEN '"statusCode":404' WHEN 2 THEN '>Job not found<' ELSE '' END) AS body FROM pages)
        SELECT page_id, CASE WHEN status IN (404, 410) THEN 'gone' WHEN status NOT BETWEEN 200 AND 299 THEN 'unchecked'
            WHEN contains(body, 'dbexception404page') OR contains(body, '<title>404') OR contains(body, '<title>page not found') OR contains(body, 'data-testid="not-found"') OR contains(body, 'data-testid=''not-found''')
                 OR contains(body, '"statuscode":404') OR contains(body, '>job not found<') THEN 'gone' ELSE 'live' END AS outcome, status = 503 AS again FROM p""",
    "title_places": f"""WITH {_view('v', 'part', _TITLES)}, t AS (SELECT id, lower(trim(title)) AS t FROM v),
        k AS (SELECT id, CASE WHEN regexp_matches(t, '[(](new york|new york city|nyc)[)]|[-–] (new york|nyc)| (new york|new york city|nyc)$') THEN 1
                              WHEN regexp_matches(t, '[(]singapore[)]|[-–] singapore| singapore$') THEN 2
                              WHEN regexp_matches(t, '[(](united states|usa|us)[)]|[-–] (united states|us)| (united states|usa|us)$') THEN 3 ELSE 4 END AS k FROM t)
        SELECT id, (['New York, NY, United States', 'Singapore', 'United States', ''])[k] AS location, (['United States', 'Singapore', 'United States', ''])[k] AS country FROM k""",
    "role_levels": f"""WITH {_view('v', 'part', _TITLES)}, t AS (SELECT id, {_PAD('description')} AS t FROM v), s AS (SELECT *, instr(t, ' about the role ') AS begins FROM t)
        SELECT id, NOT regexp_matches(t, ' (not intended for (internship|new graduate|entry level)|(students? or )?recent graduates? please see our campus postings) ')
            AND (contains(t, ' role entry level ') OR (begins > 0 AND regexp_matches(substr(t, begins, 320), ' (is an entry level individual contributor role|is an entry level role|is a new graduate role) '))) AS entry_level FROM s""",
    "error_texts": f"""WITH {_view('v', 'part', _TITLES)}, t AS (SELECT id, lower(trim(message)) AS t FROM v)
        SELECT id, CASE WHEN t = '' THEN 'Source check failed' WHEN contains(t, '429') OR contains(t, 'rate limit') THEN 'Provider rate limited this source' WHEN contains(t, '400') THEN 'Provider rejected the source request'
            WHEN contains(t, 'timeout') OR contains(t, 'deadline exceeded') THEN 'Source request timed out' WHEN contains(t, 'tls') OR contains(t, 'certificate') THEN 'Secure connection to the source failed'
            WHEN contains(t, 'identity does not match') THEN 'Discovered board identity no longer matches the company' WHEN contains(t, 'incomplete snapshot') THEN 'Source returned an incomplete job snapshot'
            ELSE 'Source check failed; inspect service logs for the private diagnostic' END AS shown, contains(t, 'tinyfish') OR contains(t, 'http 503') OR contains(t, 'failed: 429') AS again FROM t""",
    "company_labels": """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '💻 Tech' ELSE (['🟠 YC company', '🧠 AI company', '🏙 Big tech', '🟠 YC company', '📈 Quant / trading'])[s_suppkey % 5 + 1] END AS label FROM supplier""",
    "company_keys": """SELECT s_suppkey, lower(s_name) || ' & söhne-co.' AS shown, lower(s_name) || '  & söhne-co.' AS exact, replace(regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'), ' ', '') || 'shneco' AS compact FROM supplier""",
    "links_not_gone": "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 97 NOT IN (SELECT o_custkey % 97 FROM orders WHERE o_orderkey % 500 = 0)",
    "snapshot_quality": """WITH r AS (SELECT l_suppkey AS source_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'Title ' || l_partkey END AS title, l_partkey % 5 <> 0 AS has_url, l_partkey % 4 = 0 AS out FROM lineitem)
        SELECT source_id, count(*) FILTER (title <> '' AND has_url) AS usable, count(*) FILTER (title <> '' AND has_url AND NOT out) AS relevant, count(*) FILTER (out) AS rejected,
               coalesce(array_to_string((list(title ORDER BY pos) FILTER (title <> ''))[1:3], '|'), '') AS titles FROM r GROUP BY 1""",
    "roster_order": """WITH s AS (SELECT s_suppkey AS id, 'n' || (s_suppkey % 7) AS company, s_suppkey % 4 AS failures, s_nationkey AS region FROM supplier)
        SELECT id, row_number() OVER (PARTITION BY region ORDER BY company, id) AS place, CASE WHEN failures > 0 THEN row_number() OVER (PARTITION BY region, failures > 0 ORDER BY failures DESC, id) END AS failure_place FROM s""",
}
