"""The admission policy: an ordered chain of rules, the first that fires gives the rejection code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.dates import stale_posted, stale_years
from snapledger.functions.text import digest_prefix, has_phrase, once, padded_text

# The policy's version and phrase tables.
POLICY_VERSION = "2026-08-22"
BLOCKED_COMPANIES = (
    "tencent", "wechat", "anduril", "lockheed martin", "northrop grumman", "raytheon", "rtx", "general dynamics", "l3harris", "leidos", "bae systems",
)
BLOCKED_IN_TITLE = ("tencent", "wechat")
SECTOR = ("government", "public sector", "defense", "defence", "federal", "usg")
EVENT = ("challenge", "competition", "hackathon", "talent community")
SECTOR_PAIR = ("palantir", "intel")
EDITORIAL_TITLE = ("your guide to", "career guide", "internship guide", "how to get an internship", "internship tips")
EDITORIAL_SEGMENTS = ("blog", "article", "articles", "resource", "resources", "guide", "guides", "news", "events")
REJECTED_ROLES = (
    "customer support", "technical support", "help desk", "it support", "it operations", "sales", "account executive", "business development",
    "business analyst", "business operations", "people operations", "sales operations", "recruiting operations", "operations analyst",
    "operations manager", "operations specialist", "trading operations engineer", "program manager", "product manager", "project manager",
    "engineering manager", "manager", "director", "head", "vice president", "vp", "senior", "sr", "staff", "principal", "lead engineer", "qa", "test",
    "testing", "qa engineer", "quality assurance", "quality engineer", "sdet", "engineer in test", "test engineer", "software test", "test automation",
    "automation test", "recruiter", "talent acquisition", "educator", "instructor", "teacher", "cybersecurity analyst", "security analyst",
    "fundamental research analyst", "market data specialist", "hardware", "fpga", "asic", "electrical engineer", "mechanical engineer",
    "manufacturing engineer",
)
TECHNICAL_STAFF = "member of technical staff"
ANALYSTS = ("quantitative analyst", "quantitative trading analyst", "quant trading analyst")
ACCEPTED_ROLES = (
    "software engineer", "software developer", "software engineering", "swe", "software development", "software intern", "graduate developer",
    "application developer", "kernel engineer", "backend engineer", "backend engineering", "backend developer", "frontend engineer",
    "frontend engineering", "frontend developer", "front end engineer", "front end engineering", "front end developer", "full stack", "fullstack",
    "platform engineer", "platform engineering", "infrastructure engineer", "infrastructure engineering", "site reliability engineer",
    "production engineer", "systems engineer", "systems engineering", "linux engineer", "network engineer", "operations engineer", "devops engineer",
    "cloud engineer", "security engineer", "security researcher", "cybersecurity", "application security", "information security", "data engineer",
    "data engineers", "data engineering", "data scientist", "data science", "machine learning", "ml engineer", "ml researcher",
    "artificial intelligence", "ai engineer", "ai researcher", "ai research", "ai builder", "applied scientist", "research engineer", "model shaping",
    "privacy and civil liberties engineer", "privacy civil liberties engineer", "member of technical staff", "mts", "coding llm", "coding llms",
    "llm engineer", "algorithm developer", "algorithm development", "trading systems engineer", "quantitative developer", "quantitative development",
    "quantitative researcher", "quantitative research", "quantitative technologist", "quantitative analyst", "quantitative engineer",
    "quantitative trader", "quantitative trading", "quantitative strategist", "quant developer", "quant researcher", "quant engineer", "quant trader",
    "quant trading",
)
SCIENTIST_FIELDS = ("ai", "genai", "ml", "machine learning", "llm", "nlp", "computer vision", "applied vision", "deep learning")
AI_FIELDS = ("ai", "genai", "ml", "machine learning", "artificial intelligence", "nlp", "computer vision", "applied vision", "deep learning")
AI_WORK = ("research", "engineer", "engineering", "scientist")
TIMING = (
    "intern", "internship", "new grad", "new graduate", "recent graduate", "university graduate", "graduate", "early career", "entry level",
    "college grad", "co op", "working student", "campus", "junior",
)
COUNTRIES = ("singapore", "sg", "united states", "united states of america", "usa", "us")
PLACES = (
    "singapore", "united states", "united states of america", "usa", "us", "new york", "new york city", "nyc", "chicago", "san francisco", "sf office",
    "seattle", "san jose", "san diego", "palo alto", "mountain view", "redmond", "denver", "honolulu", "austin", "foster city", "los gatos",
    "santa clara", "washington dc", "washington d c", "bellevue",
)
OTHER_PLACES = (
    "france", "poland", "germany", "berlin", "paris", "united kingdom", "london", "india", "australia", "hong kong", "china", "japan", "south korea",
    "canada",
)
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI"
    " WY DC"
).split()
VAGUE_PLACES = ("", "in office", "remote", "hybrid", "unknown", "multiple locations", "various locations")

STATE_CODE = f"(?:^|[,;/] *)(?:{'|'.join(STATES)})(?:$|[,;/])"


def editorial_url(url: Column) -> Column:
    """Whether any path segment of a URL marks a page that is no posting."""
    path = F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit(""))
    decoded = F.transform(F.split(path, "/"), lambda s: F.lower(F.trim(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))))
    return F.exists(decoded, lambda s: F.coalesce(s.isin(*EDITORIAL_SEGMENTS), F.lit(False)))


def _geography(title: Column, location: Column, country: Column, raw_title: Column, raw_location: Column) -> Column:
    """Whether a posting can be placed in a wanted place; location outweighs country, the title only helps vague ones."""
    wanted = has_phrase(location, PLACES) | F.trim(raw_location).rlike(STATE_CODE)
    foreign = has_phrase(location, OTHER_PLACES) & ~wanted
    titled = has_phrase(title, PLACES) | F.trim(raw_title).rlike(STATE_CODE)
    vague = F.trim(location).isin(*VAGUE_PLACES)
    return ~foreign & (wanted | has_phrase(country, COUNTRIES) | (vague & titled))


def rejection_code(now: datetime, posted: str | None = "posted_at") -> Column:
    """The code of the first rule that rejects a posting, null if it is admitted.

    Reads company, title, location, country, employment_type, level, apply_url (texts, none of them null) and the
    time in `posted`. Built-in expressions only, so it can be pushed into any plan; each text is normalised once.
    """
    texts = F.struct(*(padded_text(F.col(c)).alias(c) for c in ("company", "title", "location", "country", "employment_type", "level")))
    return once(texts, lambda t: _first_rule(t, now, posted))


def _first_rule(t: Column, now: datetime, posted: str | None) -> Column:
    """The rules over the normalised texts of a posting, in their order."""
    company, title, location, country, employment, level = (t[c] for c in ("company", "title", "location", "country", "employment_type", "level"))
    ai_scientist = has_phrase(title, ["research scientist"]) & has_phrase(title, SCIENTIST_FIELDS)
    ai_work = has_phrase(title, AI_FIELDS) & has_phrase(title, AI_WORK)
    staff = has_phrase(title, [TECHNICAL_STAFF])
    rejected = has_phrase(title, [p for p in REJECTED_ROLES if p != "staff"]) | (has_phrase(title, ["staff"]) & ~staff)
    analyst = has_phrase(title, ["analyst"]) & ~has_phrase(title, ANALYSTS)
    timed = has_phrase(title, TIMING)
    stale = stale_years(title, now)
    if posted:
        stale = stale | stale_posted(F.col(posted), now)
    return (
        F.when(has_phrase(company, BLOCKED_COMPANIES) | has_phrase(title, BLOCKED_IN_TITLE), "company")
        .when(has_phrase(title, OTHER_PLACES) & ~has_phrase(title, PLACES), "geography")
        .when(stale, "stale")
        .when(has_phrase(title, EDITORIAL_TITLE) | editorial_url(F.col("apply_url")), "editorial")
        .when(~_geography(title, location, country, F.col("title"), F.col("location")), "geography")
        .when(has_phrase(title, SECTOR + EVENT) | (has_phrase(company, SECTOR_PAIR[:1]) & has_phrase(title, SECTOR_PAIR[1:])), "sector")
        .when(rejected | analyst | ~(has_phrase(title, ACCEPTED_ROLES) | ai_scientist | ai_work), "role")
        .when(~timed & (has_phrase(employment, ["experienced"]) | ~(has_phrase(employment, TIMING) | has_phrase(level, TIMING))), "career_stage")
    )


def admitted(postings: DataFrame, now: datetime, posted: str | None = "posted_at") -> DataFrame:
    return postings.where(rejection_code(now, posted).isNull())


def rejection_ledger(observations: DataFrame, now: datetime, prior: DataFrame | None = None, posted: str | None = "posted_at") -> DataFrame:
    """How often and when each source showed each rejected posting, by fingerprint, code and policy version.

    prior: an earlier ledger to add to.
    """
    fields = ("company", "title", "location", "apply_url", "source_native_id")
    found = (
        # a filter on the code would be pushed down and compute it twice
        observations.select("*", F.explode(F.filter(F.array(rejection_code(now, posted)), lambda c: c.isNotNull())).alias("code"))
        .select(
            "source_id",
            digest_prefix(F.concat_ws("|", *(F.col(c) for c in fields)), 32).alias("fingerprint"),
            "code",
            F.lit(POLICY_VERSION).alias("policy_version"),
            F.col("observed_at").alias("first_observed_at"),
            F.col("observed_at").alias("last_observed_at"),
            F.lit(1).cast("bigint").alias("observation_count"),
        )
    )
    if prior is not None:
        found = found.unionByName(prior)
    return found.groupBy("source_id", "fingerprint", "code", "policy_version").agg(
        F.min("first_observed_at").alias("first_observed_at"),
        F.max("last_observed_at").alias("last_observed_at"),
        F.sum("observation_count").alias("observation_count"),
    )
