"""Joins, aggregates, folds, queues and reconciliation over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from snapledger.functions import classify
from snapledger.functions.dates import doubling_delay
from snapledger.operators import audit, dedupe, fold, queues, snapshot, status, visibility
from snapledger.plans import domain as D

DUE = datetime(1999, 6, 1)


def _visible(spark, sf_dir, require_active=True):
    return visibility.visible_observations(D.provenance_rows(spark, sf_dir), D.discovered(spark, sf_dir), D.controls(spark, sf_dir), require_active)


def _jobs(spark, sf_dir):
    return D.provenance_rows(spark, sf_dir).select(F.col("job_id").alias("id")).distinct()


def visible_jobs(spark, sf_dir):
    return visibility.visible_jobs(_jobs(spark, sf_dir), _visible(spark, sf_dir))


def visible_jobs_any(spark, sf_dir):
    return visibility.visible_jobs(_jobs(spark, sf_dir), _visible(spark, sf_dir, False))


def quarantine_anti(spark, sf_dir):
    return visibility.without_quarantined(D.controls(spark, sf_dir).select("source_id"), D.controls(spark, sf_dir))


def multi_source_jobs(spark, sf_dir):
    # parts are the jobs here: a job of one supplier has one source
    rows = D.observations(spark, sf_dir).select(F.col("l_partkey").cast("string").alias("job_id"), "source_id")
    return visibility.multi_source_jobs(rows)


def grouped_state_counts(spark, sf_dir):
    return D.deliveries(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def next_wakeup(spark, sf_dir):
    return queues.next_wakeup(D.deliveries(spark, sf_dir))


def due_counts(spark, sf_dir):
    return status.due_counts(D.deliveries(spark, sf_dir), D.candidates(spark, sf_dir), DUE)


def status_rollup(spark, sf_dir):
    return status.rollup(status.roster(_configured(spark, sf_dir), _health(spark, sf_dir), _source_controls(spark, sf_dir)))


def roster_full_outer(spark, sf_dir):
    return status.roster(_configured(spark, sf_dir), _health(spark, sf_dir), _source_controls(spark, sf_dir))


def _configured(spark, sf_dir):
    # every other source that was tried, and some that never were
    users = D.table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 2 = 0")
    more = users.select((F.col("user_id") + 100_000).alias("user_id")).where("user_id % 20 = 0")
    return users.unionByName(more).select(F.concat(F.lit("src-"), F.col("user_id").cast("string")).alias("source_id"), F.concat(F.lit("Company "), (F.col("user_id") % 9).cast("string")).alias("company"))


def _source_controls(spark, sf_dir):
    users = D.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.where("user_id % 11 = 0").select(F.concat(F.lit("src-"), F.col("user_id").cast("string")).alias("source_id"), F.lit("quarantined").alias("control"))


def _health(spark, sf_dir):
    return fold.failure_streaks(D.attempts(spark, sf_dir))


def lane_round_robin(spark, sf_dir):
    c = D.candidates(spark, sf_dir).where(F.col("state").isin("pending", "promoted")).where(queues.due("next_attempt_at", datetime(2001, 9, 1)))
    order = [classify.queue_priority(F.col("tags")), F.when(F.col("state") == "promoted", 1).otherwise(0), F.col("next_attempt_at"), F.col("id")]
    return dedupe.round_robin(c, classify.lane(F.col("tags")), order, 100).select("id", "lane", "lane_rank")


def first_wins(spark, sf_dir):
    return dedupe.first_wins(D.observations(spark, sf_dir).select("job_id", "source_native_id", "observed_at", "seq"), ["job_id"], ["observed_at", "seq"])


def authority_fold(spark, sf_dir):
    rows = D.observations(spark, sf_dir).select(
        F.col("l_partkey").alias("part"), "seq", "observed_at", "authority", "title", "company", "location", "level", "employment_type"
    )
    folded = fold.authority_fold(rows, "part", ["observed_at", "seq"], ["title", "company"], ["location", "level", "employment_type"])
    return folded.withColumn("accepted", F.col("accepted").cast("bigint"))


def failure_streaks(spark, sf_dir):
    return _health(spark, sf_dir)


def link_health(spark, sf_dir):
    return fold.link_health(D.link_checks(spark, sf_dir))


def provenance_fold(spark, sf_dir):
    return fold.provenance(D.observations(spark, sf_dir))


def schedule_topk(spark, sf_dir):
    health = _health(spark, sf_dir).select("source_id", "state", "last_attempt_at", "last_failure_at", "consecutive_failures")
    return queues.schedule_sources(_configured(spark, sf_dir), health, datetime(2024, 1, 31), 60).select("source_id", "last_attempt_at")


def link_queue_topk(spark, sf_dir):
    checks = fold.link_health(D.link_checks(spark, sf_dir))
    seen = D.link_checks(spark, sf_dir).groupBy("job_id").agg(F.min("checked_at").alias("first_seen_at"), F.max("checked_at").alias("checked_at"))
    jobs = checks.join(seen, "job_id").select(
        F.col("job_id").alias("id"), F.concat(F.lit("https://x.example/"), "job_id").alias("apply_url"), "state", "first_seen_at", "checked_at",
        F.when(F.col("consecutive_gone") > 0, F.col("checked_at") + F.expr("INTERVAL 1 DAY")).alias("next_check_at"),
    )
    visible = D.link_checks(spark, sf_dir).where("seq % 3 = 0").select("job_id")
    return queues.link_queue(jobs, visible, D.deliveries(spark, sf_dir), datetime(2024, 1, 31), 40).select("id", "rank", "state")


def claim_topn(spark, sf_dir):
    return queues.claim(D.deliveries(spark, sf_dir), DUE, "me", 60, 25).select("id", "status", "claim_owner", "attempts", "claim_expires_at")


def outbox_insert_absent(spark, sf_dir):
    d = D.deliveries(spark, sf_dir)
    key = ["job_id", "channel", "recipient"]
    old = dedupe.first_wins(d.where("id % 2 = 0").select("id", *key, "status"), key, ["id"])
    new = dedupe.first_wins(d.where("id % 2 = 1").select("id", *key, F.lit("staged").alias("status")), key, ["id"])
    return queues.insert_absent(old, new, key)


def outbox_transitions(spark, sf_dir):
    d = D.deliveries(spark, sf_dir)
    kinds = F.element_at(F.array(*map(F.lit, ("sent", "claim", "failed", "activate", "release"))), (F.col("id") % 5 + 1).cast("int"))
    events = d.where("id % 2 = 0").select("id", kinds.alias("event"), F.when(F.col("id") % 4 == 0, "worker").otherwise("other").alias("owner"))
    return queues.transition(d, events).select("id", "status", "applied")


def snapshot_reconcile(spark, sf_dir):
    prov = D.provenance_rows(spark, sf_dir).groupBy("source_id", "job_id").agg(F.bool_or("active").alias("active"))
    part = F.substring_index("job_id", "-", -1).cast("bigint")
    shown = prov.where(part % 3 != 0).select("source_id", "job_id")
    passes = prov.select("source_id").distinct().select("source_id", (F.length("source_id") % 2 == 0).alias("complete"))
    return snapshot.reconcile(prov, shown, passes)


def source_merge_priority(spark, sf_dir):
    s = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("key"), F.col("s_name").alias("label"))
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), F.col("c_name").alias("label"))
    p = D.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("key"), F.col("p_name").alias("label"))
    return dedupe.merge_by_priority([s, c, p], "key")


def seed_minus_catalog(spark, sf_dir):
    seed = D.candidates(spark, sf_dir).select("id", "name")
    catalog = D.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c-"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("id")).distinct()
    return seed.join(catalog, "id", "left_anti")


def missing_critical(spark, sf_dir):
    """Of what the orders name, in two spellings of which one is never known, what no candidate has."""
    named = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "d-").otherwise("c-"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    critical = D.table(spark, sf_dir, "orders").select(named.alias("id")).distinct()
    return critical.join(D.candidates(spark, sf_dir).select("id"), "id", "left_anti")


def coverage_audit(spark, sf_dir):
    return audit.tag_counts(D.candidates(spark, sf_dir)).select("kind", "tag", "n")


def coverage_thresholds(spark, sf_dir):
    return audit.below_minimum(audit.tag_counts(D.candidates(spark, sf_dir)), {"quant": 40, "unicorn": 100_000, "big-tech": 10, "security": 45})


def high_signal(spark, sf_dir):
    return D.candidates(spark, sf_dir).where(classify.high_signal(F.col("tags"))).select("id")


def keep_best(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_discount").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return dedupe.keep_best(rows, "key", "confidence", "seq")


def owner_by_key_rank(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    wanted = o.select(F.col("o_orderkey").alias("id"), F.array(*(F.concat(F.lit(f"k{i}:"), (F.col("o_custkey") % m).cast("string")) for i, m in ((1, 997), (2, 50), (3, 7)))).alias("keys"))
    c = D.table(spark, sf_dir, "customer")
    bound = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("k1:"), F.col("c_custkey").cast("string")).alias("identity_key"), F.col("c_name").alias("job_id"))
    bound = bound.unionByName(c.select(F.concat(F.lit("k2:"), F.col("c_custkey").cast("string")).alias("identity_key"), F.concat(F.lit("b-"), "c_name").alias("job_id")))
    return dedupe.owners_by_rank(wanted, bound)


def substring_key_join(spark, sf_dir):
    p = D.postings(spark, sf_dir)
    scoped = p.select(F.concat(F.lit("company-url:"), "company", F.lit("|url:"), "apply_url").alias("key"), F.col("id").alias("scoped_id"))
    bare = p.where("l_returnflag = 'A'").select(F.concat(F.lit("url:"), "apply_url").alias("url_key"), F.col("id").alias("bare_id"))
    keyed = scoped.withColumn("url_key", F.regexp_extract("key", "^company-url:[^|]*\\|(.*)$", 1))
    return keyed.join(bare, "url_key").select("scoped_id", "bare_id")


def ci_route_join(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages")
    route = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "/+$", ""))
    left = pages.where("page_id % 2 = 0").select("page_id", route(F.upper("url")).alias("route"))
    right = pages.select(F.col("page_id").alias("other_id"), route("url").alias("route"))
    return left.join(right, "route").where("page_id <> other_id").select("page_id", "other_id")


def backoff(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select("o_orderkey", doubling_delay(900, F.col("o_custkey") % 12, 86_400).alias("delay"))


def report_merge(spark, sf_dir):
    a = D.attempts(spark, sf_dir)
    return a.groupBy("source_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))


def quality_ratios(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select((F.col("event_type") == "purchase").alias("good"), (F.col("value") > 20).alias("kept"))
    return audit.gate(e, "good", "kept")


def explain_source(spark, sf_dir):
    return status.explain(D.attempts(spark, sf_dir), fold.failure_streaks(D.attempts(spark, sf_dir)), _source_controls(spark, sf_dir), "src-22")


QUERIES = {
    f.__name__: f
    for f in (
        visible_jobs, visible_jobs_any, quarantine_anti, multi_source_jobs, grouped_state_counts, next_wakeup, due_counts, status_rollup, roster_full_outer,
        lane_round_robin, first_wins, authority_fold, failure_streaks, link_health, provenance_fold, schedule_topk, link_queue_topk, claim_topn,
        outbox_insert_absent, outbox_transitions, snapshot_reconcile, source_merge_priority, seed_minus_catalog, missing_critical, coverage_audit,
        coverage_thresholds, high_signal, keep_best, owner_by_key_rank, substring_key_join, ci_route_join, backoff, report_merge, quality_ratios, explain_source,
    )
}

_W = D.with_views
_LANE = " ".join(f"WHEN list_contains(tags, '{t}') THEN {i}" for i, t in enumerate(classify.LANES))
_PRIO = f"CASE WHEN list_contains(tags, '{classify.LANES[0]}') THEN 0 " + " ".join(f"WHEN list_contains(tags, 'priority-{i}') THEN {i}" for i in (1, 2, 3)) + " ELSE 4 END"
_STREAK = """, k AS (SELECT * FROM (SELECT *, max("at") OVER (PARTITION BY source_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM v_att) WHERE latest IS NULL OR latest <= "at"),
    i AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY source_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS island FROM k),
    l AS (SELECT *, max(island) OVER (PARTITION BY source_id) AS last_island FROM i),
    streak AS (SELECT source_id, max("at") AS last_attempt_at, max("at") FILTER (ok) AS last_success_at, max("at") FILTER (NOT ok) AS last_failure_at,
                      count(*) FILTER (NOT ok AND island = last_island) AS consecutive_failures, arg_max(CASE WHEN ok THEN 'success' ELSE 'failure' END, arrival) AS state FROM l GROUP BY source_id)"""
_HEALTH = """, r AS (SELECT *, sum((outcome = 'live' OR url_changed)::INTEGER) OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM v_link),
    z AS (SELECT *, max(island) OVER (PARTITION BY job_id) AS last_island FROM r),
    health AS (SELECT job_id, consecutive_gone, CASE WHEN consecutive_gone >= 2 THEN 'gone' WHEN live THEN 'live' ELSE 'unchecked' END AS state
               FROM (SELECT job_id, count(*) FILTER (outcome = 'gone') AS consecutive_gone, bool_or(outcome = 'live') AS live FROM z WHERE island = last_island GROUP BY job_id))"""
_ROSTER = _STREAK + """,
    u AS (SELECT DISTINCT user_id FROM events),
    conf AS (SELECT 'src-' || user_id AS source_id, 'Company ' || (user_id % 9) AS company FROM (SELECT user_id FROM u WHERE user_id % 2 = 0 UNION ALL SELECT user_id + 100000 FROM u WHERE user_id % 2 = 0 AND (user_id + 100000) % 20 = 0)),
    ctl AS (SELECT 'src-' || user_id AS source_id, 'quarantined' AS control FROM u WHERE user_id % 11 = 0),
    roster AS (SELECT coalesce(c.source_id, s.source_id) AS source_id, coalesce(c.company, '') AS company, c.source_id IS NOT NULL AS configured,
                      CASE WHEN t.control IS NOT NULL THEN t.control WHEN s.state IS NULL THEN 'pending' WHEN s.state = 'success' THEN 'healthy' ELSE 'failed' END AS state,
                      coalesce(s.consecutive_failures, 0) AS consecutive_failures, s.last_attempt_at
               FROM conf c FULL JOIN streak s ON c.source_id = s.source_id LEFT JOIN ctl t ON t.source_id = coalesce(c.source_id, s.source_id))"""

ORACLE = {
    "visible_jobs": f"{_W('v_vis')} SELECT DISTINCT job_id AS id FROM v_vis",
    "visible_jobs_any": _W("v_vis").replace("WHERE o.active AND", "WHERE") + " SELECT DISTINCT job_id AS id FROM v_vis",
    "quarantine_anti": f"{_W('v_ctrl')} SELECT source_id FROM v_ctrl WHERE state <> 'quarantined'",
    "multi_source_jobs": f"{_W('v_obs')} SELECT l_partkey::VARCHAR AS job_id, count(DISTINCT source_id) AS sources FROM v_obs GROUP BY 1 HAVING count(DISTINCT source_id) > 1",
    "grouped_state_counts": f"{_W('v_del')} SELECT status, count(*) AS n FROM v_del GROUP BY status",
    "next_wakeup": f"{_W('v_del')} SELECT min(CASE WHEN status = 'claimed' THEN claim_expires_at WHEN status = 'pending' THEN next_attempt_at END) AS next_at FROM v_del",
    "due_counts": f"""{_W('v_del', 'v_cand')} SELECT (SELECT count(*) FROM v_del WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '1999-06-01') AS deliveries_due,
        (SELECT count(*) FROM v_del WHERE status = 'claimed' AND claim_expires_at <= TIMESTAMP '1999-06-01') AS claims_expired,
        (SELECT count(*) FROM v_cand WHERE state IN ('pending', 'retry', 'validating', 'promoted') AND next_attempt_at <= TIMESTAMP '1999-06-01') AS candidates_due""",
    "roster_full_outer": f"{_W('v_att')}{_ROSTER} SELECT * FROM roster",
    "status_rollup": f"""{_W('v_att')}{_ROSTER} SELECT count(*) FILTER (state = 'healthy') AS healthy, count(*) FILTER (state = 'failed') AS failed,
        count(*) FILTER (state = 'quarantined') AS quarantined, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (configured) AS configured,
        CASE WHEN count(*) FILTER (state = 'failed') > 0 THEN 'degraded' WHEN count(*) FILTER (state = 'healthy') > 0 THEN 'healthy' ELSE 'pending' END AS state FROM roster""",
    "lane_round_robin": f"""{_W('v_cand')}, d AS (SELECT *, CASE {_LANE} ELSE 5 END AS lane FROM v_cand WHERE state IN ('pending', 'promoted') AND next_attempt_at <= TIMESTAMP '2001-09-01'),
        w AS (SELECT id, lane, row_number() OVER (PARTITION BY lane ORDER BY {_PRIO}, (state = 'promoted')::INTEGER, next_attempt_at, id) AS lane_rank FROM d)
        SELECT id, lane, lane_rank FROM w ORDER BY lane_rank, lane LIMIT 100""",
    "first_wins": f"{_W('v_obs')} SELECT job_id, source_native_id, observed_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY observed_at, seq) AS nth FROM v_obs) WHERE nth = 1",
    "authority_fold": f"""{_W('v_obs')}, a AS (SELECT l_partkey AS part, *, row_number() OVER w AS nth, min(authority) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
            FROM v_obs WINDOW w AS (PARTITION BY l_partkey ORDER BY observed_at, seq)), c AS (SELECT *, best IS NULL OR authority <= best AS counts FROM a)
        SELECT part, arg_max(title, nth) FILTER (counts) AS title, arg_max(company, nth) FILTER (counts) AS company,
               coalesce(arg_max(location, nth) FILTER (counts AND location <> ''), '') AS location, coalesce(arg_max(level, nth) FILTER (counts AND level <> ''), '') AS level,
               coalesce(arg_max(employment_type, nth) FILTER (counts AND employment_type <> ''), '') AS employment_type, min(authority) AS authority,
               count(*) FILTER (counts) AS accepted, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at FROM c GROUP BY part""",
    "failure_streaks": f"{_W('v_att')}{_STREAK} SELECT * FROM streak",
    "link_health": f"{_W('v_link')}{_HEALTH} SELECT * FROM health",
    "provenance_fold": f"""{_W('v_obs')} SELECT job_id, source_id, source_native_id, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at,
        bool_or(NOT snapshot_pending) AS active FROM v_obs GROUP BY ALL""",
    "schedule_topk": f"""{_W('v_att')}{_ROSTER} SELECT c.source_id, s.last_attempt_at FROM conf c LEFT JOIN streak s ON s.source_id = c.source_id
        WHERE NOT coalesce(s.state = 'failure' AND TIMESTAMP '2024-01-31' < date_trunc('second', s.last_failure_at) + to_seconds(least(86400, 900 * 2 ** least(greatest(s.consecutive_failures - 1, 0), 40))::BIGINT), false)
        ORDER BY s.last_attempt_at NULLS FIRST, c.source_id LIMIT 60""",
    "link_queue_topk": f"""{_W('v_link', 'v_del')}{_HEALTH}, s AS (SELECT job_id, min(checked_at) AS first_seen_at, max(checked_at) AS checked_at FROM v_link GROUP BY job_id),
        j AS (SELECT h.job_id AS id, h.state, s.first_seen_at, s.checked_at, CASE WHEN consecutive_gone > 0 THEN s.checked_at + INTERVAL 1 DAY END AS next_check_at FROM health h JOIN s ON s.job_id = h.job_id),
        q AS (SELECT *, CASE WHEN state = 'unchecked' THEN 0 WHEN EXISTS (SELECT 1 FROM v_del d WHERE d.job_id = j.id AND d.status IN ('staged', 'pending', 'claimed')) THEN 1 WHEN state = 'live' THEN 2 ELSE 3 END AS rank FROM j
              WHERE (next_check_at IS NULL OR next_check_at <= TIMESTAMP '2024-01-31') AND EXISTS (SELECT 1 FROM v_link v WHERE v.job_id = j.id AND v.seq % 3 = 0))
        SELECT id, rank, state FROM q ORDER BY rank, first_seen_at DESC, next_check_at NULLS FIRST, checked_at NULLS FIRST, id LIMIT 40""",
    "claim_topn": f"""{_W('v_del')} SELECT id, 'claimed' AS status, 'me' AS claim_owner, attempts + 1 AS attempts, TIMESTAMP '1999-06-01 00:01:00' AS claim_expires_at FROM v_del
        WHERE (status = 'pending' AND next_attempt_at <= TIMESTAMP '1999-06-01') OR (status = 'claimed' AND claim_expires_at <= TIMESTAMP '1999-06-01') ORDER BY id LIMIT 25""",
    "outbox_insert_absent": f"""{_W('v_del')}, o AS (SELECT * FROM v_del WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY job_id, channel, recipient ORDER BY id) = 1),
        n AS (SELECT * FROM v_del WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY job_id, channel, recipient ORDER BY id) = 1)
        SELECT id, job_id, channel, recipient, status, false AS inserted FROM o UNION ALL
        SELECT id, job_id, channel, recipient, 'staged', true FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.job_id = n.job_id AND o.channel = n.channel AND o.recipient = n.recipient)""",
    "outbox_transitions": f"""{_W('v_del')}, e AS (SELECT *, CASE WHEN id % 2 = 0 THEN (['sent', 'claim', 'failed', 'activate', 'release'])[id % 5 + 1] END AS event, CASE WHEN id % 4 = 0 THEN 'worker' ELSE 'other' END AS owner FROM v_del),
        t AS (SELECT *, CASE WHEN event = 'activate' AND status = 'staged' THEN 'pending' WHEN event = 'claim' AND status = 'pending' THEN 'claimed'
                             WHEN status = 'claimed' AND owner = claim_owner THEN CASE event WHEN 'sent' THEN 'sent' WHEN 'failed' THEN 'pending' WHEN 'release' THEN 'pending' END END AS after FROM e)
        SELECT id, coalesce(after, status) AS status, CASE WHEN event IS NOT NULL THEN after IS NOT NULL END AS applied FROM t""",
    "snapshot_reconcile": f"""{_W('v_prov')}, p AS (SELECT source_id, job_id, bool_or(active) AS active FROM v_prov GROUP BY ALL)
        SELECT source_id, job_id, CASE WHEN length(source_id) % 2 = 0 THEN split_part(job_id, '-', 2)::BIGINT % 3 <> 0 ELSE active END AS active FROM p""",
    "source_merge_priority": """SELECT key, arg_min(label, rank) AS label FROM (SELECT s_suppkey AS key, s_name AS label, 0 AS rank FROM supplier UNION ALL
        SELECT c_custkey, c_name, 1 FROM customer UNION ALL SELECT p_partkey, p_name, 2 FROM part) GROUP BY key""",
    "seed_minus_catalog": f"{_W('v_cand')} SELECT id, name FROM v_cand WHERE id NOT IN (SELECT 'c-' || lpad(o_custkey::VARCHAR, 9, '0') FROM orders WHERE o_orderpriority = '1-URGENT')",
    "missing_critical": f"""{_W('v_cand')} SELECT DISTINCT CASE WHEN o_orderkey % 4 = 0 THEN 'd-' ELSE 'c-' END || lpad(o_custkey::VARCHAR, 9, '0') AS id FROM orders
        WHERE CASE WHEN o_orderkey % 4 = 0 THEN 'd-' ELSE 'c-' END || lpad(o_custkey::VARCHAR, 9, '0') NOT IN (SELECT id FROM v_cand)""",
    "coverage_audit": f"""{_W('v_cand')}, t AS (SELECT id, unnest(tags) AS tag FROM v_cand) SELECT CASE WHEN tag LIKE 'priority-%' THEN 'priority' WHEN tag LIKE 'curated-%' OR tag LIKE 'benchmark-%' THEN 'provenance' ELSE 'category' END AS kind,
        tag, count(DISTINCT id) AS n FROM t GROUP BY ALL""",
    "coverage_thresholds": f"""{_W('v_cand')}, t AS (SELECT unnest(tags) AS tag, id FROM v_cand), n AS (SELECT tag, count(DISTINCT id) AS n FROM t GROUP BY tag)
        SELECT m.tag, m.minimum, coalesce(n.n, 0) AS n FROM (VALUES ('quant', 40), ('unicorn', 100000), ('big-tech', 10), ('security', 45)) m(tag, minimum) LEFT JOIN n ON n.tag = m.tag WHERE coalesce(n.n, 0) < m.minimum""",
    "high_signal": f"{_W('v_cand')} SELECT id FROM v_cand WHERE list_contains(tags, 'priority-1') AND list_has_any(tags, ['curated-2026', 'yc-top'])",
    "keep_best": "SELECT l_partkey AS key, l_discount AS confidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_orderkey * 10 + l_linenumber) = 1",
    "owner_by_key_rank": """WITH w AS (SELECT o_orderkey AS id, unnest([0, 1, 2]) AS rank, unnest(['k1:' || (o_custkey % 997), 'k2:' || (o_custkey % 50), 'k3:' || (o_custkey % 7)]) AS identity_key FROM orders),
        b AS (SELECT 'k1:' || c_custkey AS identity_key, c_name AS job_id FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'k2:' || c_custkey, 'b-' || c_name FROM customer)
        SELECT id, arg_min(job_id, rank) AS job_id, min(rank) AS rank FROM w JOIN b USING (identity_key) GROUP BY id""",
    "substring_key_join": f"{_W('v_post')} SELECT a.id AS scoped_id, b.id AS bare_id FROM v_post a JOIN v_post b ON a.apply_url = b.apply_url WHERE b.l_returnflag = 'A'",
    "ci_route_join": "SELECT a.page_id, b.page_id AS other_id FROM pages a JOIN pages b ON lower(rtrim(regexp_replace(a.url, '[?#].*$', ''), '/')) = lower(rtrim(regexp_replace(b.url, '[?#].*$', ''), '/')) WHERE a.page_id % 2 = 0 AND a.page_id <> b.page_id",
    "backoff": "SELECT o_orderkey, least(86400, 900 * 2 ** (o_custkey % 12))::BIGINT AS delay FROM orders",
    "report_merge": f"{_W('v_att')} SELECT source_id, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures FROM v_att GROUP BY source_id",
    "quality_ratios": """WITH e AS (SELECT event_type = 'purchase' AS good, value > 20 AS kept FROM events) SELECT count(*) FILTER (good AND kept) / count(*) FILTER (kept) AS "precision",
        count(*) FILTER (good AND kept) / count(*) FILTER (good) AS recall, count(*) FILTER (NOT good AND NOT kept) / count(*) FILTER (NOT good) AS junk_rejection FROM e""",
    "explain_source": f"""{_W('v_att')}{_STREAK} SELECT 'src-22' AS source_id, 'quarantined' AS control, state, consecutive_failures, last_attempt_at,
        (SELECT string_agg(arrival, ',' ORDER BY "at" DESC, arrival DESC) FROM (SELECT "at", arrival FROM v_att WHERE source_id = 'src-22' ORDER BY "at" DESC, arrival DESC LIMIT 20)) AS recent FROM streak WHERE source_id = 'src-22'""",
}
