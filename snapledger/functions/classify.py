"""Ordered classifications of postings, sources, candidates and failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.functions.text import feed_text, in_feed_text, once

# Phrases that decide track, category and region.
INTERN = ("intern", "internship", "co op", "working student")
CATEGORIES = {
    "quant": ("quant", "trading", "algorithm developer"),
    "ai_ml": ("machine learning", "ml", "artificial intelligence", "ai", "llm", "research scientist", "applied scientist"),
    "data": ("data engineer", "data scientist", "data science", "data platform"),
    "infra_security": (
        "infrastructure", "platform", "systems", "site reliability", "production engineer", "security", "network", "linux", "devops", "cloud engineer",
    ),
}
SINGAPORE = ("singapore", "sg")
# Candidate tags, most preferred lane first, and tags that are evidence of a candidate's standing.
LANES = ("auto-market-search", "yc-top", "quant", "big-tech", "unicorn")
EVIDENCE_TAGS = (
    "benchmark-hiremepls", "benchmark-quantt-2026", "curated-2026", "curated-public-tech-2026", "forbes-ai50-2026", "forbes-cloud100-2025",
    "futuriom50-2026", "nasdaq-tech-2026", "pwc-unicorns-2025", "quant-benchmark-2026", "yc-top",
)
# Parts of error messages, the class each stands for, and whether it is final; the first match counts.
FAILURES = (
    (("blocked job aggregator", "aggregator/search listing"), "aggregator", True),
    (("high-signal target evidence", "company quality gate"), "company_quality", True),
    (("identity does not match", "does not match candidate company identity"), "ownership_mismatch", True),
    (("unsupported provider", "provider mismatch"), "provider_mismatch", True),
    (("no relevant technical", "no active job-role"), "nontechnical", True),
    (("429", "rate limit"), "rate_limited", False),
    (("timeout", "timed out", "deadline exceeded"), "timeout", False),
    (("404", "not found"), "route_missing", False),
    (("incomplete snapshot",), "incomplete", False),
)


def track(title: Column, employment: Column, level: Column) -> Column:
    return F.when(in_feed_text(feed_text(F.concat_ws(" ", title, employment, level)), INTERN), "internship").otherwise("new_grad")


def category(title: Column) -> Column:
    def first(text: Column) -> Column:
        found = F.when(F.lit(False), F.lit(""))
        for name, phrases in CATEGORIES.items():
            found = found.when(in_feed_text(text, phrases), name)
        return found.otherwise("software")

    return once(feed_text(title), first)


def region(country: Column, location: Column) -> Column:
    return F.when(in_feed_text(feed_text(F.concat_ws(" ", country, location)), SINGAPORE), "singapore").otherwise("us")


def source_authority(source_id: Column, provider: Column) -> Column:
    """10 for catalogued sources, 20 for discovered ones, 30 for market searches; less is stronger."""
    s = F.lower(F.trim(source_id))
    return F.when((F.lower(F.trim(provider)) == "market_search") | s.startswith("market-"), 30).when(s.startswith("auto-"), 20).otherwise(10)


def lane(tags: Column) -> Column:
    found = F.when(F.lit(False), 0)
    for i, tag in enumerate(LANES):
        found = found.when(F.array_contains(tags, tag), i)
    return found.otherwise(len(LANES))


def queue_priority(tags: Column) -> Column:
    found = F.when(F.array_contains(tags, LANES[0]), 0)
    for i in (1, 2, 3):
        found = found.when(F.array_contains(tags, f"priority-{i}"), i)
    return found.otherwise(4)


def high_signal(tags: Column) -> Column:
    """First priority, and backed by evidence."""
    return F.array_contains(tags, "priority-1") & F.arrays_overlap(tags, F.array(*map(F.lit, EVIDENCE_TAGS)))


def failure_class(message: Column) -> Column:
    """Struct of the class of an error message and whether trying again is of no use."""
    text = F.lower(F.trim(message))
    found = F.when(message.isNull(), F.struct(F.lit("unknown").alias("code"), F.lit(False).alias("terminal")))
    for parts, code, terminal in FAILURES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | text.contains(p)
        found = found.when(hit, F.struct(F.lit(code).alias("code"), F.lit(terminal).alias("terminal")))
    return found.otherwise(F.struct(F.lit("unknown").alias("code"), F.lit(False).alias("terminal")))


def link_outcome(status: Column, soft_missing: Column) -> Column:
    """live, gone or unchecked from an HTTP status and whether the page says that it is gone."""
    return (
        F.when(status.isin(404, 410), "gone")
        .when(status.between(200, 299) & soft_missing, "gone")
        .when(status.between(200, 299), "live")
        .otherwise("unchecked")
    )


def early_career_scope(url: Column) -> Column:
    """Whether a board's last path part names a board for beginners."""
    slug = F.lower(F.element_at(F.split(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", ""), "/"), -1))
    return F.translate(slug, "-_", "").rlike("(?:university|earlycareer|newgrad|graduates)$")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
