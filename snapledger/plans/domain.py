"""Postings, sources, attempts and queues as views of the driver tables: for Spark, and as DuckDB text with the same meaning.

The driver's tables hold no postings. Each view is a deterministic projection, so that an operator and its SQL see the same
rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2001, 9, 1)
EVENTS_NOW = datetime(2024, 1, 31)

ROLES = (
    "Software Engineer Intern", "Data Scientist, New Grad", "Quantitative Researcher Internship", "Machine Learning Engineer (Graduate)",
    "Site Reliability Engineer - Early Career", "Senior Software Engineer", "Product Manager Intern", "Software Engineer",
    "Security Analyst Intern", "Software Engineer Intern, Summer 2001", "Defense Software Engineer Intern", "Software Internship Guide for you",
)
PLACES = (("Singapore", "SG"), ("New York, NY", "United States"), ("Remote", ""), ("Berlin, Germany", "Germany"), ("Austin, TX", "USA"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def source_id(key):
    prefix = F.when(key % 10 == 0, "market-").when((key % 10).isin(1, 2), "auto-").otherwise("cat-")
    return F.concat(prefix, key.cast("string"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: what a source showed, and when."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # suppliers and nations are small beside line items; Spark broadcasts them by their size
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        source_id(supp).alias("source_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_native_id"),
        F.concat_ws("-", supp, part).alias("job_id"),
        F.when(supp % 50 == 7, "Tencent").when(part % 2 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit(", Inc."))).alias("company"),
        _pick(ROLES, part % len(ROLES)).alias("title"),
        _pick([p for p, _ in PLACES], F.col("n_regionkey")).alias("location"),
        _pick([c for _, c in PLACES], F.col("n_regionkey")).alias("country"),
        F.when(part % 5 == 0, "Internship").otherwise("").alias("employment_type"),
        F.when(part % 7 == 0, "Early Career").otherwise("").alias("level"),
        F.concat(
            F.lit("https://Jobs.Example.com/"), F.when(part % 40 == 3, "blog/").otherwise(""), supp.cast("string"), F.lit("/"), part.cast("string"), F.lit("/?utm_source="), "l_returnflag"
        ).alias("apply_url"),
        F.col("l_shipdate").alias("posted_at"),
        F.col("l_shipdate").alias("observed_at"),
        (F.col("l_linestatus") == "O").alias("snapshot_pending"),
        F.when(supp % 10 == 0, 30).when((supp % 10).isin(1, 2), 20).otherwise(10).alias("authority"),
        "l_suppkey", "l_partkey", "l_returnflag",
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier, part and flag: jobs as they stand, with copies of one address."""
    keys = ["job_id", "l_returnflag"]
    same = ("company", "title", "location", "country", "employment_type", "level", "apply_url")
    return (
        observations(spark, sf_dir).groupBy(*keys)
        .agg(*(F.min(c).alias(c) for c in same), F.max("posted_at").alias("posted_at"), F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"))
        .withColumn("id", F.concat_ws("-", *keys))
    )


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(source_id(F.col("s_suppkey")).alias("source_id"), F.when(F.col("s_acctbal") < 0, "quarantined").otherwise("active").alias("state"))


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where((F.col("s_suppkey") % 10).isin(1, 2))
    return s.select(source_id(F.col("s_suppkey")).alias("id"), _pick(("promoted", "candidate", "unhealthy", "duplicate"), F.col("s_nationkey") % 4).alias("state"))


def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("job_id", "source_id", "source_native_id", (~F.col("snapshot_pending")).alias("active"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts arrive in the order of a digest of the event, so many come late."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("src-"), F.col("user_id").cast("string")).alias("source_id"),
        F.concat(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 12), F.lit("-"), F.col("event_id").cast("string")).alias("arrival"),
        F.col("ts").alias("at"),
        (F.col("event_type") != "error").alias("ok"),
    )


def link_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "live").when(kind.isin("error", "signup"), "gone").otherwise("unchecked").alias("outcome"),
        ((kind == "view") & (F.col("event_id") % 97 == 0)).alias("url_changed"),
        F.col("ts").alias("checked_at"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderkey") % 3 == 0, "claimed").when(F.col("o_orderkey") % 3 == 1, "pending").otherwise("staged")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("job-"), F.col("o_custkey").cast("string")).alias("job_id"), F.col("o_orderpriority").alias("channel"),
        (F.col("o_custkey") % 3).cast("string").alias("recipient"), status.alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"),
        F.when(status == "claimed", "worker").otherwise("").alias("claim_owner"),
        F.when(status == "claimed", F.col("o_orderdate")).alias("claim_expires_at"), F.col("o_orderdate").alias("next_attempt_at"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    lane = F.when(seg == "AUTOMOBILE", "auto-market-search").when(seg == "BUILDING", "yc-top").when(seg == "FURNITURE", "quant").when(seg == "HOUSEHOLD", "big-tech").otherwise("unicorn")
    return c.select(
        F.concat(F.lit("c-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("id"), F.col("c_name").alias("name"),
        F.array_compact(F.array(F.when(nation % 6 != 5, lane), F.when(nation % 4 != 0, F.concat(F.lit("priority-"), (nation % 4).cast("string"))), F.when(nation % 5 == 1, F.lit("curated-2026")))).alias("tags"),
        F.when(F.col("c_acctbal") < 0, "promoted").when(F.col("c_custkey") % 7 == 0, "parked").otherwise("pending").alias("state"),
        (F.lit(datetime(2001, 1, 1)) + F.make_dt_interval(days=(F.col("c_custkey") % 400).cast("int"))).alias("next_attempt_at"),
    )


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sid(key: str) -> str:
    return f"(CASE WHEN {key} % 10 = 0 THEN 'market-' WHEN {key} % 10 IN (1, 2) THEN 'auto-' ELSE 'cat-' END || {key})"


SQL = {
    "v_obs": f"""v_obs AS (
        SELECT l_orderkey * 10 + l_linenumber AS seq, {_sid('l_suppkey')} AS source_id, l_orderkey || '-' || l_linenumber AS source_native_id,
               l_suppkey || '-' || l_partkey AS job_id,
               CASE WHEN l_suppkey % 50 = 7 THEN 'Tencent' WHEN l_partkey % 2 = 0 THEN s_name ELSE s_name || ', Inc.' END AS company,
               ({_list(ROLES)})[l_partkey % {len(ROLES)} + 1] AS title, ({_list(p for p, _ in PLACES)})[n_regionkey + 1] AS location,
               ({_list(c for _, c in PLACES)})[n_regionkey + 1] AS country,
               CASE WHEN l_partkey % 5 = 0 THEN 'Internship' ELSE '' END AS employment_type, CASE WHEN l_partkey % 7 = 0 THEN 'Early Career' ELSE '' END AS level,
               'https://Jobs.Example.com/' || CASE WHEN l_partkey % 40 = 3 THEN 'blog/' ELSE '' END || l_suppkey || '/' || l_partkey || '/?utm_source=' || l_returnflag AS apply_url,
               l_shipdate AS posted_at, l_shipdate AS observed_at, l_linestatus = 'O' AS snapshot_pending,
               CASE WHEN l_suppkey % 10 = 0 THEN 30 WHEN l_suppkey % 10 IN (1, 2) THEN 20 ELSE 10 END AS authority, l_suppkey, l_partkey, l_returnflag
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
    "v_post": """v_post AS (
        SELECT job_id || '-' || l_returnflag AS id, job_id, l_returnflag, min(company) AS company, min(title) AS title, min(location) AS location, min(country) AS country,
               min(employment_type) AS employment_type, min(level) AS level, min(apply_url) AS apply_url, max(posted_at) AS posted_at,
               min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at
        FROM v_obs GROUP BY job_id, l_returnflag)""",
    "v_ctrl": f"v_ctrl AS (SELECT {_sid('s_suppkey')} AS source_id, CASE WHEN s_acctbal < 0 THEN 'quarantined' ELSE 'active' END AS state FROM supplier)",
    "v_disc": f"""v_disc AS (
        SELECT {_sid('s_suppkey')} AS id, (['promoted', 'candidate', 'unhealthy', 'duplicate'])[s_nationkey % 4 + 1] AS state FROM supplier WHERE s_suppkey % 10 IN (1, 2))""",
    "v_prov": "v_prov AS (SELECT job_id, source_id, source_native_id, NOT snapshot_pending AS active FROM v_obs)",
    "v_vis": """v_vis AS (
        SELECT o.* FROM v_prov o LEFT JOIN v_disc d ON d.id = o.source_id
        WHERE o.active AND o.source_id NOT LIKE 'market-%' AND (d.id IS NULL OR d.state = 'promoted')
          AND NOT EXISTS (SELECT 1 FROM v_ctrl c WHERE c.source_id = o.source_id AND c.state = 'quarantined'))""",
    "v_att": """v_att AS (
        SELECT 'src-' || user_id AS source_id, substr(sha256(event_id::VARCHAR), 1, 12) || '-' || event_id AS arrival, ts AS "at", event_type <> 'error' AS ok FROM events)""",
    "v_link": """v_link AS (
        SELECT 'job-' || user_id AS job_id, event_id AS seq,
               CASE WHEN event_type = 'purchase' THEN 'live' WHEN event_type IN ('error', 'signup') THEN 'gone' ELSE 'unchecked' END AS outcome,
               event_type = 'view' AND event_id % 97 = 0 AS url_changed, ts AS checked_at FROM events)""",
    "v_del": """v_del AS (
        SELECT *, CASE WHEN status = 'claimed' THEN 'worker' ELSE '' END AS claim_owner, CASE WHEN status = 'claimed' THEN next_attempt_at END AS claim_expires_at
        FROM (SELECT o_orderkey AS id, 'job-' || o_custkey AS job_id, o_orderpriority AS channel, (o_custkey % 3)::VARCHAR AS recipient,
                     CASE WHEN o_orderstatus = 'F' THEN 'sent' WHEN o_orderkey % 3 = 0 THEN 'claimed' WHEN o_orderkey % 3 = 1 THEN 'pending' ELSE 'staged' END AS status,
                     (o_orderkey % 5)::INTEGER AS attempts, o_orderdate AS next_attempt_at FROM orders))""",
    "v_cand": """v_cand AS (
        SELECT 'c-' || lpad(c_custkey::VARCHAR, 9, '0') AS id, c_name AS name,
               list_filter([CASE WHEN c_nationkey % 6 <> 5 THEN CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'auto-market-search' WHEN 'BUILDING' THEN 'yc-top' WHEN 'FURNITURE' THEN 'quant'
                                       WHEN 'HOUSEHOLD' THEN 'big-tech' ELSE 'unicorn' END END,
                            CASE WHEN c_nationkey % 4 <> 0 THEN 'priority-' || (c_nationkey % 4) END, CASE WHEN c_nationkey % 5 = 1 THEN 'curated-2026' END], lambda x: x IS NOT NULL) AS tags,
               CASE WHEN c_acctbal < 0 THEN 'promoted' WHEN c_custkey % 7 = 0 THEN 'parked' ELSE 'pending' END AS state,
               TIMESTAMP '2001-01-01' + to_days((c_custkey % 400)::INTEGER) AS next_attempt_at FROM customer)""",
}
NEEDS = {"v_post": ["v_obs"], "v_prov": ["v_obs"], "v_vis": ["v_prov", "v_disc", "v_ctrl"]}


def with_views(*names: str) -> str:
    """A WITH clause of the views and of those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order)
