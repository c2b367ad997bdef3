"""Observations in batches, and the history of controls, over the driver tables; SQL by hand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from snapledger.functions import url
from snapledger.operators import observe, passes
from snapledger.plans import domain as D

POLICY = "p2"
CUT = datetime(1995, 6, 17)


def observed_jobs(spark, sf_dir):
    """The jobs of all line items, seen without native ids, in two batches: the second one extends what the first has stored."""
    seen = D.observations(spark, sf_dir).withColumns({"source_native_id": F.lit(""), "description": F.lit("")})
    state = observe.empty_state(spark)
    for batch in (seen.where(F.col("observed_at") < F.lit(CUT)), seen.where(F.col("observed_at") >= F.lit(CUT))):
        state = observe.observe(batch, state, url.canonical_url_plain(F.col("apply_url")), ["observed_at", "seq"], POLICY)
    shown = state["provenance"].groupBy("job_id").agg(F.count(F.lit(1)).alias("sources"), F.bool_or("active").alias("active")).withColumnRenamed("job_id", "id")
    found = state["jobs"].join(shown, "id")
    return found.select(
        "company", "title", "location", "country", "employment_type", "level", "apply_url", "authority", "sources", "active", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("posted_at", "first_seen_at", "last_seen_at")),
    )


def control_history(spark, sf_dir):
    """The last control of each customer, orders being the events."""
    events = D.table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderkey % 5 = 0 THEN 'pass_failed' WHEN o_orderstatus = 'F' THEN 'control_quarantined' ELSE 'control_active' END AS kind", "cast(o_custkey AS string) AS source_id",
        "o_orderpriority AS detail", "o_orderdate AS at",
    )
    return passes.control_history(events).withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (observed_jobs, control_history)}
ORACLE = {
    "observed_jobs": f"""{D.with_views('v_obs')}
        SELECT any_value(company) AS company, any_value(title) AS title, any_value(location) AS location, any_value(country) AS country, any_value(employment_type) AS employment_type, any_value(level) AS level,
               'https://jobs.example.com/' || CASE WHEN l_partkey % 40 = 3 THEN 'blog/' ELSE '' END || l_suppkey || '/' || l_partkey AS apply_url, any_value(authority) AS authority,
               1::BIGINT AS sources, bool_or(NOT snapshot_pending) AS active, strftime(arg_max(posted_at, (observed_at, seq)), '%Y-%m-%d') AS posted_at,
               strftime(min(observed_at), '%Y-%m-%d') AS first_seen_at, strftime(max(observed_at), '%Y-%m-%d') AS last_seen_at
        FROM v_obs GROUP BY l_suppkey, l_partkey""",
    "control_history": """
        SELECT source_id, substr(max(day || kind), 19) AS control, count(*) AS changes, max(day) AS changed_at
        FROM (SELECT o_custkey::VARCHAR AS source_id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'F' THEN 'control_quarantined' ELSE 'control_active' END AS kind
              FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY source_id""",
}
